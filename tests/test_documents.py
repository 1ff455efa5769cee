"""Chunks, units, texts, budgets and coverage on inputs whose answers are known."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tamarack.functions import scoring, text as T
from tamarack.operators import budget, chunking, context, coverage, events, metadata, search, sync, units
from tamarack.sources import files


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()[0]


def test_chunks_overlap(spark):
    out = chunking.chunk_documents(spark.createDataFrame([(1, "A" * 2500), (2, None), (3, " \n")], "doc_id int, text string"), size=1000, overlap=100).orderBy("position").collect()
    assert [(r["start_char"], r["end_char"]) for r in out] == [(0, 1000), (900, 1900), (1800, 2500)]
    with pytest.raises(ValueError):
        chunking.chunk_documents(spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text")), size=100, overlap=60)


def test_chunks_cover_the_text(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice(["word ", "x", "\n\n", "é🙂 ", "\n"]) for _ in range(r.randrange(1, 900)))) for i in range(30)]
    out = chunking.chunk_documents(spark.createDataFrame(texts, "doc_id int, text string"), size=200, overlap=20).collect()
    for i, t in texts:
        body, mine = t.strip(T.SPACE), sorted((r["position"], r["start_char"], r["end_char"], r["text"]) for r in out if r["doc_id"] == i)
        assert not body or (mine[0][1] == 0 and {c for _, a, b, _ in mine for c in range(a, b)} >= {k for k, ch in enumerate(body) if not ch.isspace()})
        for _, a, b, x in mine:
            assert body[a:b].strip(T.SPACE) == x


def test_unit_selection(spark):
    t = "\n\n".join(f"# H{i}\n\nbody {i}" for i in range(1, 6))
    made = units.logical_units(spark.createDataFrame([(1, t), (2, ""), (3, None)], "doc_id int, text string"), "doc_id", "text")
    assert made.count() == 5 and made.where("doc_id = 1 and unit_no = 2").first()["heading"] == "H2"
    chosen = units.select_units(made, anchor=3, window=1, max_units=3).orderBy("unit_no").collect()
    assert [r["unit_no"] for r in chosen] == [2, 3, 4]
    assert units.select_units(made, anchor=99).count() == 5
    assert [r["unit_no"] for r in units.select_units(made, query="body 4").where("unit_no = 4").collect()] == [4]


def test_page_numbers_and_shared_lines_go(spark):
    rows = [("d", 51, "Report\nText\n\n51"), ("d", 52, "Report\nMore\n- 52 -"), ("d", 53, "Report\nLast\n53/60"), ("e", 1, "Report\nOnly\n第1页")]
    out = {(r["doc"], r["page_no"]): r["markdown"] for r in units.strip_headers_and_footers(spark.createDataFrame(rows, "doc string, page_no int, markdown string"), "doc").collect()}
    assert out == {("d", 51): "\nText\n\n", ("d", 52): "\nMore\n", ("d", 53): "\nLast\n", ("e", 1): "Report\nOnly\n"}


@pytest.mark.parametrize(("path", "kind"), [("a/02_master_agreement_v2.pdf", "agreement"), ("x/2024.md", "2024"), ("04_risk_report.md", "report"), ("...", "document"), ("the_final.md", "final")])
def test_document_types(spark, path, kind):
    assert one(spark, path, T.document_type) == kind


def test_texts(spark):
    assert one(spark, "a \r\nb\t\n\n\n\n c ", T.normalize_markdown) == "a\nb\n\n c"
    assert one(spark, "<p>x&eacute;</p><p class='a'>y</p><script>no</script>", T.html_to_markdown) == "\nxé\ny\n"
    assert one(spark, "plain\n ## Head ##", T.derive_heading) == "Head ##" and one(spark, "x" * 91, T.derive_heading) is None
    assert one(spark, "pay $ 1,000.50", T.mentions_currency) and one(spark, "Sept 3, 2021", T.mentions_dates) and not one(spark, "May be", T.mentions_dates)
    assert one(spark, "--a b/c..", T.sanitize_filename) == "a-b-c" and one(spark, "///", T.sanitize_filename) == "document"
    assert one(spark, '---\na: "x"\nb: y: z\na: w\n---\n\nbody', T.front_matter) == {"a": "w", "b": "y: z"}
    assert one(spark, "---\nno end", T.strip_front_matter) == "---\nno end" and one(spark, "no end", T.front_matter) == {}
    assert one(spark, "[Source: a.pdf, 2] [Source: b] [Source: a.pdf]", T.cited_sources) == ["a.pdf", "b"]


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])]
    out = spark.createDataFrame(rows, "a array<double>, b array<double>").select(scoring.cosine(F.col("a"), F.col("b")))
    assert [r[0] for r in out.collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_ranking(spark):
    sem = spark.createDataFrame([("a", "a.md", 2, "t", 0.95), ("b", "b.md", 1, "u", 0.5), ("a", "a.md", 5, "v", 0.2), ("c", "c.md", 0, "w", -0.5)], "doc_id string, relative_path string, position int, text string, score double")
    meta = spark.createDataFrame([("b", "b.md", "p", 2), ("d", "d.md", "q", 2)], "doc_id string, relative_path string, preview string, metadata_score int")
    out = search.merge_and_rank(sem, meta, 10).collect()
    assert [(r["doc_id"], r["combined_score"], r["matched_by"], r["text"]) for r in out] == [("a", 95.0, "semantic", "t"), ("b", 70.0, "semantic+metadata", "u"), ("d", 20.0, "metadata", "q"), ("c", 0.0, "metadata", "w")]


@given(st.sets(st.integers(-3, 60)))
@settings(max_examples=8, deadline=None)
def test_ranges_are_the_units(spark, numbers):
    df = spark.createDataFrame([(1, n) for n in numbers], "s int, unit_no int")
    out = sorted((r["range_start"], r["range_end"]) for r in coverage.unit_ranges(df, ["s"]).collect())
    assert {n for a, b in out for n in range(a, b + 1)} == {n for n in numbers if n > 0}
    assert all(b + 1 < c for (_, b), (c, _) in zip(out, out[1:]))


def within(t, cap, kind):
    """A text's head and tail in a cap, or for ring2 its head and eight of the lines that name units."""
    ends = t[: int(cap * 0.6)] + budget.SHORTENED + t[len(t) - (cap - int(cap * 0.6) - 30) :]
    marks = "\n".join([l for l in (x.strip() for x in t.splitlines()) if l[:6] == "[UNIT " or l[:1] == "#"][:8])
    named = (t[: cap // 3] + budget.RING + marks).strip()
    named = named[: cap - 20] + budget.CUT if len(named) > cap else named
    return t if len(t) <= cap else {"ring2": named}.get(kind, ends)


def plain_compaction(rows, limit, anchor):
    """The same, one message after another."""
    import re

    def kind(t):
        if budget.MARK not in t:
            return "history"
        d = [abs(int(n) - anchor) for n in re.findall(r"(?i)\[UNIT\s+(\d+)\b", t)]
        return "ring2" if not d else "ring0" if min(d) == 0 else "ring1" if min(d) <= 2 else "ring2"

    last = max(i for i, _ in rows)
    live = [[i, t, k, 100 if i == last else {"ring0": 90, "ring1": 80, "ring2": 70}.get(k, 40 + min(i, 20))] for i, t, k in ((i, t, kind(t)) for i, t in rows)]
    total = lambda: sum(max(1, (len(m[1]) + 3) // 4) for m in live)

    def cap(which):
        for m in live:
            m[1] = within(m[1], budget.CAPS[which][m[2]], m[2])

    cap(0)
    if total() > limit:
        cap(1)
    for k, keep in budget.KEEP.items():
        while total() > limit and len(live) > keep and any(m[2] == k for m in live):
            live.remove(min((m for m in live if m[2] == k), key=lambda m: m[0]))
    if total() > limit:
        cap(2)
    while total() > limit and len(live) > 1:
        live.remove(min([m for m in live if m[3] < 100] or live[:-1], key=lambda m: (m[3], m[0])))
    for _ in range(200):
        if total() <= limit or not live:
            break
        m = min(live, key=lambda m: (m[3], m[0]))
        if len(m[1]) > 140:
            m[1] = within(m[1], max(120, int(len(m[1]) * 0.65)), m[2])
        else:
            live.remove(m)
    return sorted((m[0], m[1]) for m in live)


def test_compaction_is_that_of_the_loop(spark):
    r = random.Random(4)
    convs = {c: [(i, (f"{budget.MARK}\n[UNIT {r.randrange(9)} | s]\n# h\n" if r.random() < 0.5 else "") + "".join(r.choice("ab c\n") for _ in range(r.randrange(1, 5000)))) for i in range(r.randrange(1, 14))] for c in range(25)}
    df = spark.createDataFrame([(c, i, "user", t) for c, ms in convs.items() for i, t in ms], "conv_id int, idx int, role string, text string")
    for limit in (180, 1500, 4000):
        out = budget.compact(df, limit, anchor=4).collect()
        for c, ms in convs.items():
            assert sorted((x["idx"], x["text"]) for x in out if x["conv_id"] == c) == plain_compaction(ms, limit, 4), (c, limit)


def test_repeated_reads_are_stale(spark):
    turns = spark.createDataFrame([(1, t, "search" if t == 5 else "parse") for t in range(1, 7)], "session_id int, turn int, kind string")
    reads = spark.createDataFrame([(1, t, "d", 48) for t in (1, 2, 3, 6)], "session_id int, turn int, doc_id string, unit_no int")
    out = {r["turn"]: (r["streak"], r["stale"]) for r in coverage.read_streaks(turns, reads).collect()}
    assert out == {1: (0, False), 2: (1, False), 3: (2, True), 4: (3, True), 5: (0, False), 6: (1, False)}


def test_profiles(spark):
    with pytest.raises(metadata.ProfileError):
        metadata.normalize_profile({"fields": [{"name": "a", "source_classes": ["x"]}, {"name": "a", "source_classes": ["x"]}]})
    with pytest.raises(metadata.ProfileError):
        metadata.normalize_profile({"fields": [{"name": "a", "type": "boolean", "mode": "contains", "source_classes": ["x"]}]})
    p = metadata.normalize_profile({"fields": [{"name": "n", "type": "integer", "source_classes": ["X"]}]})
    assert metadata.profile_defaults(p) == {"n": 0} and metadata.merged_schema({"fields": [{"name": "n"}]}, p)[1] is False
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, content string")
    found = metadata.extract_entities(docs, lambda t: [("x", w) for w in t.split()])
    assert sorted((r["doc_id"], r["n"]) for r in metadata.aggregate_entities(docs, found, p).collect()) == [(1, 2), (2, 0)]
    calls = []
    rows = metadata.embed_texts(docs.coalesce(1).withColumnRenamed("content", "text"), lambda ts: [[float(len(t))] for t in ts], batch=1).collect()
    assert [r["embedding"] for r in rows] == [[3.0], [0.0]] and not calls


def test_mark_missing_and_images(spark):
    docs = spark.createDataFrame([("a", "x", False), ("b", "y", False), ("c", "z", True)], "doc_id string, relative_path string, is_deleted boolean")
    after, new = sync.mark_missing(docs, spark.createDataFrame([("x",), ("z",)], "relative_path string"))
    assert {r["doc_id"]: r["is_deleted"] for r in after.collect()} == {"a": False, "b": True, "c": True} and [r["doc_id"] for r in new.collect()] == ["b"]


def test_session_ends_once(spark):
    rows = [(1, 1, "start"), (1, 2, "complete"), (1, 3, "human_reply"), (2, 1, "start"), (2, 2, "ask_human"), (3, 1, "tool_call")]
    df = spark.createDataFrame([(s, i, i, k) for s, i, k in rows], "session_id int, event_id int, t int, type string").withColumn("ts", F.timestamp_seconds("t")).withColumn("data", F.lit("{}"))
    assert {r["session_id"]: r["state"] for r in events.final_states(df).collect()} == {1: "completed", 2: "awaiting_human", 3: "created"}
    assert [r["session_id"] for r in events.illegal_replies(df).collect()] == [1]


def test_schema_has_all_document_types(spark):
    types = [f"type{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(1500)]
    files = spark.createDataFrame([(f"a/some_{t}.md",) for t in types], "relative_path string")
    field = next(f for f in metadata.discovered_schema(files)["fields"] if f["name"] == "document_type")
    assert field["enum"] == sorted(types)


def test_ranges_of_a_document_outlive_a_switch(spark):
    plans = [("s", 1, "keep_ranges", "d1", [(1, 3)]), ("s", 2, "switch_document", "d2", []), ("s", 3, "summarize_stale_ranges", "d1", []), ("s", 4, "summarize_stale_ranges", None, []), ("s", 5, "keep_ranges", "d2", [(7, 9)]), ("s", 6, "summarize_stale_ranges", "d2", []), ("s", 7, "summarize_stale_ranges", "d3", [])]
    df = spark.createDataFrame([(*p[:4], "", p[4], [], "") for p in plans], "session_id string, turn int, operation string, document_id string, file_path string, ranges array<struct<start_unit:int,end_unit:int>>, evidence_ids array<int>, note string")
    selected = spark.createDataFrame([("s", d) for d in ("d1", "d2", "d3")], "session_id string, document_id string")
    covered = spark.createDataFrame([("s", d, a, a + 2) for d in ("d1", "d2", "d3") for a in (1, 7)], "session_id string, document_id string, range_start int, range_end int")
    judged = context.judged_plans(df, selected)
    got = {(r["turn"], r["document_id"], r["range_start"]) for r in context.summarized_document_ranges(judged, covered).collect()}
    # the switch keeps the ranges that it doesn't name, now of d2
    assert got == {(3, "d1", 7), (4, "d2", 7), (6, "d2", 1), (7, "d3", 1), (7, "d3", 7)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 700])
def test_values_at_ranks_are_those_of_a_sort(spark, monkeypatch, n):
    monkeypatch.setattr(metadata, "SPLITTERS", 4)
    monkeypatch.setattr(metadata, "SORTED", 3)
    r = random.Random(n)
    paths = [f"p{r.randrange(n)}" if i % 3 else "hot" for i in range(n)]
    df = spark.createDataFrame([(p, "x" * 3000) for p in paths], "relative_path string, content string").repartition(3)
    ranks = sorted({0, n // 3, n // 2, n - 1})
    assert metadata.at_ranks(df, "relative_path", ranks) == {k: sorted(paths)[k] for k in ranks}


def test_profiles_from_a_model(spark):
    files = spark.createDataFrame([(f"d/f{i:02d}.md", f"text {i} " * 1000) for i in range(10)], "relative_path string, content string")
    seen = []

    def model(samples):
        seen.extend(samples)
        return {"fields": [{"name": "lx_x", "type": "integer", "source_classes": ["x"]}]}

    made = metadata.auto_profile(files, model)
    assert [f.name for f in made.fields] == ["lx_enabled", "lx_extraction_count", "lx_entity_classes", "lx_x"]
    assert [n for n, _ in seen] == ["f00.md", "f03.md", "f06.md"] and all(len(t) == 2000 for _, t in seen)
    usual = metadata.usual_profile()
    assert metadata.auto_profile(files) == metadata.auto_profile(files, lambda s: 1 // 0) == metadata.auto_profile(files, lambda s: {"fields": [{"name": "1 bad"}]}) == metadata.auto_profile(files.limit(0), model) == usual


def test_schema_as_a_table(spark):
    files = spark.createDataFrame([("a/x_report.md",), ("b/y_report.md",), ("c/z_plan.md",)], "relative_path string")
    rows = {(r["field"], r["value"]) for r in metadata.schema_table(files, metadata.usual_profile()).collect()}
    assert {v for f, v in rows if f == "document_type"} == {"report", "plan"} and ("lx_people", None) in rows and ("file_size", None) in rows
    assert {v for f, v in ((r["field"], r["value"]) for r in metadata.schema_table(files.limit(0)).collect()) if f == "document_type"} == {"other"}
    with pytest.raises(ValueError, match="schema_table"):
        metadata.discovered_schema(files, most=1)


def test_fields_of_entities_need_two_exchanges_whatever_their_number(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    rows = spark.createDataFrame([(1, 0, " A ", "x"), (1, 1, "a", "X"), (1, 2, "b", "y"), (3, 0, "a", "z"), (1, 3, "", "w"), (1, 4, None, None)], "doc_id int, ordinal int, class string, text string")
    fields = [{"name": f"f{i}", "source_classes": ["b", "a"] if i % 2 else ["a"]} for i in range(12)]
    out = metadata.aggregate_entities(docs, rows, metadata.normalize_profile({"fields": fields}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
    got = {r["doc_id"]: (r["f0"], r["f1"]) for r in out.collect()}
    assert got == {1: ("x", "y, x"), 2: ("", "")}


def test_bytes_are_decoded_as_python_does(spark):
    r = random.Random(4)
    pieces = [b"\xff", b"\xc3", b"\xc3\xa9", b"\xe2\x82", b"\xe2\x82\xac", b"\xf0\x9f\x98", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xef\xbf\xbd", b"\xef\xbb\xbf", b"a", b"\n", b"\x80"]
    given = [None, b""] + [b"".join(r.choice(pieces) for _ in range(r.randrange(1, 9))) for _ in range(800)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(given)], "i int, b binary")
    rows = df.select("i", files.decode_utf8(F.col("b")).alias("u"), files.decode_any(F.col("b")).alias("a")).collect()
    for row in rows:
        b = given[row.i]
        assert row.u == (None if b is None else b.decode("utf-8", "ignore"))
        assert row.a == (None if b is None else next(b.decode(e) for e in files.ENCODINGS if _decodes(b, e)))
    # texts that are UTF-8 are not sent to Python
    assert "is_valid_utf8" in df.select(files.decode_any(F.col("b")))._jdf.queryExecution().analyzed().toString()


def _decodes(b, encoding):
    try:
        b.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def test_names_are_cleaned_once(spark):
    given = [None, "", "---", "a b", "é", "é.", "_", " -x- ", "Ä/B: c?.pdf", "..a..", "\n"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(given)], "i int, n string").select("i", T.sanitize_filename(F.col("n")).alias("s"))
    want = [None if n is None else re.sub(r"[^A-Za-z0-9._-]+", "-", n).strip("-.") or "document" for n in given]
    assert [r.s for r in df.orderBy("i").collect()] == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_entities_are_shuffled_once_by_document(spark):
    rows = [(1, 0, "party", "Acme"), (1, 1, "amount", "ACME"), (1, 2, "party", "acme"), (1, 3, "date", " May "), (1, 4, "date", "May"), (1, 5, "date", ""), (1, 6, "amount", "5"), (2, 0, "amount", "x"), (2, 1, "party", "X"), (4, 0, "party", "lost")]
    df = spark.createDataFrame(rows, "doc_id int, ordinal int, class string, text string")
    profile = metadata.normalize_profile({"fields": [{"name": "n", "type": "integer", "source": "runtime", "runtime": "extraction_count"}, {"name": "c", "type": "string", "source": "runtime", "runtime": "entity_classes"}, {"name": "p", "type": "string", "source_classes": ["party", "amount"], "mode": "csv"}, {"name": "d", "type": "integer", "source_classes": ["date"]}]})
    made = metadata.aggregate_entities(spark.createDataFrame([(1,), (2,), (3,)], "doc_id int"), df, profile)
    assert {r.doc_id: (r.n, r.c, r.p, r.d) for r in made.collect()} == {1: (7, "amount, date, party", "Acme, 5", 2), 2: (2, "amount, party", "X", 0), 3: (0, "", "", 0)}
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
