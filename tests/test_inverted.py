"""The inverted index against searches that read every text."""

import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import inverted as I, pages, search
from tamarack.operators.filters import parse_filters
from tamarack.plans.engine import Engine

WORDS = ["alpha", "alphabet", "beta", "betatron", "gamma", "Delta", "price", "priced", "the", "thing", "of", "été", "契約", "x_1"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows, docs = [], []
    for d in range(300):
        docs.append((d, f"p{d % 7}/doc{(d * 37) % 300:03d}.md", f"Doc{d % 50}.md", f'{{"lang":"{"en" if d % 3 else "de"}"}}', d % 11 == 0))
        for p in range(r.randrange(0, 5)):
            text = " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 40)))
            rows.append((d, docs[-1][1], p, r.choice([None, "The thing", "Prices"]), r.choice([text, text, text.upper(), "", None])))
    rows += [(300, "zz/rare.md", 0, None, "a needleword here"), (301, None, 0, None, "another needleword")]
    docs += [(300, "zz/rare.md", "rare.md", "{}", False), (301, None, None, "{}", None)]
    texts = spark.createDataFrame(rows, "doc_id bigint, relative_path string, position int, heading string, text string").cache()
    return texts, spark.createDataFrame(docs, "doc_id bigint, relative_path string, original_filename string, metadata_json string, is_deleted boolean").cache()


@pytest.fixture(scope="module")
def segment(corpus, tmp_path_factory):
    return I.write_segment(corpus[0], f"{tmp_path_factory.mktemp('index')}/s", block_rows=16)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("query", ["alpha price", "needleword", "zeta", "of", "契約", "", "betatron needleword gamma", "LPHAB"])
def test_keyword_search_is_that_of_all_texts(corpus, segment, query):
    texts, docs = corpus
    for limit in (1, 15):
        want = rows(search.keyword_search(texts.select("doc_id", "position", "text"), docs, query, limit))
        got = rows(I.indexed_keyword_search([segment], docs, query, limit).rows)
        # a path that is null sorts alike on both sides only where none is in the result
        assert sorted(got, key=str) == sorted(want, key=str) and [g[4] for g in got] == [w[4] for w in want]
    scope = docs.where("doc_id % 4 = 1").select("doc_id")
    assert rows(I.indexed_keyword_search([segment], docs, query, 9, scope).rows) == rows(search.keyword_search(texts.select("doc_id", "position", "text"), docs, query, 9, scope))


@pytest.mark.parametrize("query", ["the thing", "needleword here", "of", "契約 price"])
def test_page_search_is_that_of_all_texts(corpus, segment, query):
    texts, docs = corpus
    live = docs.where("doc_id < 300")
    as_pages = texts.select("doc_id", F.col("position").alias("page_no"), F.col("text").alias("markdown"), "heading")
    for limit, text in ((1, None), (12, "lang = en")):
        want = rows(pages.page_search(as_pages, live, query, parse_filters(text), limit))
        assert rows(I.indexed_page_search([segment], live, query, parse_filters(text), limit).rows) == want


def test_few_files_are_read(corpus, segment, spark):
    _, docs = corpus
    every = spark.read.parquet(f"{segment.path}/blocks").count()
    assert every > 30
    rare = I.indexed_keyword_search([segment], docs, "needleword", 5)
    assert rare.rows.count() == 2 and len(rare.files) == len(set(rare.files)) <= 2
    # many rows have the common word: the first blocks give the result, in the order of paths
    common = I.indexed_keyword_search([segment], docs, "alpha", 5)
    assert common.rows.count() == 5 and len(common.files) <= I.FIRST and common.blocks <= I.FIRST
    assert I.indexed_keyword_search([segment], docs, "zeta", 5).files == []
    page = I.indexed_page_search([segment], docs, "needleword here", limit=1)
    assert page.rows.count() == 1 and len(page.files) <= 2


def test_postings_are_read_by_bucket_and_gram(segment, spark):
    plan = I._Search(spark, [segment], ["alpha"], lambda t, f: 1.0, False, "bigint").coarse()._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "postings" in line)
    assert "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(gram" in scan.split("PushedFilters")[1]
    assert "rows:array" not in scan  # the bounds of blocks need no row's postings


def test_changed_documents_are_found_as_they_are(corpus, segment, spark, tmp_path):
    texts, docs = corpus
    new = spark.createDataFrame([(5, "p5/doc185.md", 0, None, "a needleword again"), (7, "p0/doc259.md", 0, None, "plain")], texts.schema)
    later = I.write_segment(new, f"{tmp_path}/s", 1)
    removed = spark.createDataFrame([(5, 0), (7, 0), (300, 0)], "doc_id bigint, up_to int")
    got = {r["doc_id"] for r in I.indexed_keyword_search([segment, later], docs, "needleword", 10, removed=removed).rows.collect()}
    assert got == {5, 301}
    now = texts.where("doc_id not in (5, 7, 300)").unionByName(new)
    for query in ("alpha beta", "plain", "price thing"):
        want = rows(search.keyword_search(now.select("doc_id", "position", "text"), docs, query, 15))
        assert rows(I.indexed_keyword_search([segment, later], docs, query, 15, removed=removed).rows) == want


def test_empty_tables(corpus, spark, tmp_path):
    texts, docs = corpus
    none = I.write_segment(texts.limit(0), f"{tmp_path}/s")
    assert I.indexed_keyword_search([none], docs, "alpha", 5).rows.count() == 0
    assert I.indexed_page_search([none], docs.limit(0), "alpha").rows.count() == 0
    assert I.indexed_keyword_search([], docs, "alpha", 5).rows.count() == 0


def test_engine_searches_its_index(spark, tmp_path):
    def write(name, text):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)

    write("a.md", "the needleword of one")
    write("b.md", "nothing of it")
    engine = Engine(spark, f"{tmp_path}/store", f"{tmp_path}/in")
    engine.index()
    assert [r["relative_path"] for r in engine.search("needleword", refresh=False).collect()] == ["a.md"]
    write("a.md", "now without")
    write("b.md", "the needleword has moved")
    engine.index()
    assert [r["relative_path"] for r in engine.search("needleword", refresh=False).collect()] == ["b.md"]
    assert [r["relative_path"] for r in engine.search_pages("needleword").collect()] == ["b.md"]
    assert engine.store.read("search_segments").count() == 4
    engine.compact_search()
    assert engine.store.read("search_segments").count() == 2 and engine.store.read("search_removed").count() == 0
    assert [r["relative_path"] for r in engine.search("needleword", refresh=False).collect()] == ["b.md"]
    assert [r["relative_path"] for r in engine.search_pages("needleword").collect()] == ["b.md"]


def test_a_piece_ends_by_its_grams_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PIECE_GRAMS", 300)
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.format_string("p%03d", F.col("id")).alias("relative_path"), F.lit(0).alias("position"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    I.write_segment(rows, f"{tmp_path}/s")
    held = spark.read.parquet(f"{tmp_path}/s/postings").select("block", "piece", F.explode("rows").alias("row")).distinct()
    assert held.groupBy("block", "piece").count().agg(F.max("count")).first()[0] <= 4 and held.select("block", "row").distinct().count() == 40
