"""Registered queries, one for each operator family, and the SQL that says the same.

The tables of the driver stand for the engine's: ``documents`` with ``labels`` are
the corpus and its metadata, ``pages`` the HTML sources, ``embeddings`` the vectors,
``benchmark`` a set of queries, ``conversations`` chat histories, ``events`` session
logs. Where the rows lack what an operator looks for, it is derived from them by
rules that both sides share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, text as T
from ..operators import budget, catalog, chunking, context, coverage, events, filters, inverted, metadata, pages, scope, search, sync, units, vectors
from ..sources import files, objects, packs
from ..sources.scratch import scratch, written
from ..sources.store import SCHEMAS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NL2 = "chr(10) || chr(10)"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- the corpus -------------------------------------------------------------

DOCS = f"""d AS (SELECT doc_id, source || '/doc_' || lpad(doc_id::VARCHAR, 6, '0') || '.md' AS relative_path, text AS content, lang, source,
  n_chars::VARCHAR AS n_chars, quality::VARCHAR AS quality, CASE toxic WHEN 1 THEN 'true' WHEN 0 THEN 'false' END AS toxic, doc_id % 17 = 0 AS is_deleted
  FROM documents LEFT JOIN labels USING (doc_id))"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"))
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    path = chunking.document_id_column(F.col("source"), F.col("doc_id"))
    return docs.select("doc_id", path.alias("relative_path"), path.alias("original_filename"), path.alias("absolute_path"), F.col("text").alias("content"), F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic")).alias("metadata_json"), (F.col("doc_id") % 17 == 0).alias("is_deleted"), "lang", "source")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with blank lines between their lines, so that they have paragraphs."""
    return read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


PARAGRAPHS = f"SELECT doc_id, trim(replace(text, chr(10), {NL2}), {WS}) AS t FROM documents"


def chunk_ctes(base: str, size: int = 1500, overlap: int = 150) -> str:
    def end(s: str) -> str:
        tentative = f"least({s} + {size}, length(t))"
        p = f"strpos(reverse(t[{s} + {size // 2} + 1 : {tentative}]), {NL2})"
        return f"CASE WHEN {tentative} < length(t) AND {p} > 0 THEN {tentative} - {p} + 1 ELSE {tentative} END"

    return f"""base AS ({base}),
r AS (SELECT doc_id, t, 0::BIGINT AS s, ({end('0')})::BIGINT AS e FROM base WHERE t <> ''
  UNION ALL SELECT doc_id, t, e - {overlap}, ({end(f'(e - {overlap})')})::BIGINT FROM r WHERE e < length(t)),
c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS position, s::INT AS start_char, e::INT AS end_char, trim(t[s + 1 : e], {WS}) AS text
  FROM r WHERE trim(t[s + 1 : e], {WS}) <> '')"""


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(paragraphs(spark, sf_dir))


@query("chunk_documents", f"WITH RECURSIVE {chunk_ctes(PARAGRAPHS)} SELECT * FROM c")
def _(spark, sf_dir):
    return chunks_of(spark, sf_dir)


@query("chunk_documents_small", f"WITH RECURSIVE {chunk_ctes(PARAGRAPHS, 300, 30)} SELECT * FROM c")
def _(spark, sf_dir):
    return chunking.chunk_documents(paragraphs(spark, sf_dir), size=300, overlap=30)


@query("identities", f"WITH {DOCS} SELECT doc_id, 'corpus_' || sha1(source) AS corpus_id, 'doc_' || sha1('corpus_' || sha1(source) || ':' || relative_path) AS document_id, 'chunk_' || sha1(doc_id || ':0:0:' || length(content)) AS chunk_id, 'schema_' || sha1(source || ':' || lang) AS schema_id, 'collection_' || sha1(lang || ':2024-01-01') AS collection_id, sha256(content) AS content_hash FROM d")
def _(spark, sf_dir):
    c = corpus(spark, sf_dir)
    root = ids.corpus_id(F.col("source"))
    return c.select("doc_id", root.alias("corpus_id"), ids.document_id(root, F.col("relative_path")).alias("document_id"), ids.chunk_id(F.col("doc_id"), F.lit(0), F.lit(0), F.length("content")).alias("chunk_id"), ids.schema_id(F.col("source"), F.col("lang")).alias("schema_id"), ids.collection_id(F.col("lang"), F.lit("2024-01-01")).alias("collection_id"), ids.content_hash(F.col("content")).alias("content_hash"))


# --- units -------------------------------------------------------------------

MARKED = f"SELECT doc_id, t FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN '# Part ' || doc_id || {NL2} || replace(text, chr(10), {NL2} || '## Next' || {NL2}) ELSE replace(text, chr(10), {NL2}) END AS t FROM documents)"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with headings in every third and nothing in every fifth."""
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    headed = F.concat(F.lit("# Part "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n## Next\n\n")))
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 3 == 0, headed).otherwise(t).alias("text"))


def heading_sql(t: str) -> str:
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: trim(x, {WS}))"
    marks = f"list_filter({lines}, lambda x: starts_with(x, '#'))"
    return f"CASE WHEN len({marks}) > 0 THEN nullif(trim(ltrim(({marks})[1], '#'), {WS}), '') WHEN length(({lines})[1]) BETWEEN 1 AND 90 THEN ({lines})[1] END"


def normalize_sql(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({t}, chr(13) || chr(10), chr(10)), '[ \\t\\r\\f\\v]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', {NL2}, 'g'), {WS})"


#: Blocks one after another, with what has been gathered before each.
UNITS = f"""m AS ({MARKED}), b AS (SELECT doc_id, list_filter(string_split({normalize_sql('t')}, {NL2}), lambda x: x <> '') AS bs FROM m),
u AS (SELECT doc_id, bs, 1 AS i, 1 AS unit_no, length(bs[1])::BIGINT AS size FROM b WHERE len(bs) > 0
  UNION ALL SELECT doc_id, bs, i + 1,
    CASE WHEN starts_with(bs[i + 1], '#') OR (size + length(bs[i + 1]) + 2 > 1600 AND size >= 450) THEN unit_no + 1 ELSE unit_no END,
    CASE WHEN starts_with(bs[i + 1], '#') OR (size + length(bs[i + 1]) + 2 > 1600 AND size >= 450) THEN length(bs[i + 1]) ELSE size + length(bs[i + 1]) + 2 END
  FROM u WHERE i < len(bs)),
h AS (SELECT doc_id, i, unit_no, bs[i] AS block, {heading_sql('bs[i]')} AS heading FROM u),
g AS (SELECT doc_id, unit_no::INT AS unit_no, string_agg(block, {NL2} ORDER BY i) AS markdown, arg_min(heading, i) FILTER (heading IS NOT NULL) AS heading, 'unit-' || unit_no AS source_locator FROM h GROUP BY doc_id, unit_no)"""


def units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.logical_units(marked(spark, sf_dir), "doc_id", "text")


@query("logical_units", f"WITH RECURSIVE {UNITS} SELECT doc_id, unit_no, markdown, sha256(markdown) AS content_hash, heading, source_locator FROM g")
def _(spark, sf_dir):
    return units_of(spark, sf_dir)


@query("whole_units", f"WITH RECURSIVE {UNITS} SELECT doc_id, unit_no, sha256(markdown) AS content_hash FROM g UNION ALL SELECT doc_id, 1, sha256('') FROM m WHERE trim(t, {WS}) = ''")
def _(spark, sf_dir):
    return units.whole_units(marked(spark, sf_dir), "doc_id", "text").select("doc_id", "unit_no", "content_hash")


@query("single_unit", f"SELECT doc_id, sha256({normalize_sql('t')}) AS content_hash, {heading_sql(normalize_sql('t'))} AS heading FROM ({MARKED})")
def _(spark, sf_dir):
    return units.single_unit(marked(spark, sf_dir), "doc_id", "text").select("doc_id", "content_hash", "heading")


SPANS = """w AS (SELECT doc_id, unit_no, (coalesce(sum(length(markdown) + 2) OVER (PARTITION BY doc_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS unit_start, length(markdown) AS len FROM g),
spans AS (SELECT doc_id, unit_no, unit_start, (unit_start + len)::INT AS unit_end FROM w)"""


@query("join_units", f"WITH RECURSIVE {UNITS}, {SPANS} SELECT * FROM spans")
def _(spark, sf_dir):
    return chunking.join_units(units_of(spark, sf_dir)).select("doc_id", "unit_no", "unit_start", "unit_end")


@query("chunk_unit_assignment", f"""WITH RECURSIVE {UNITS}, {SPANS}, {chunk_ctes(f"SELECT doc_id, string_agg(markdown, {NL2} ORDER BY unit_no) AS t FROM g GROUP BY doc_id")},
j AS (SELECT c.doc_id, position, start_char, end_char, unit_no, row_number() OVER (PARTITION BY c.doc_id, position ORDER BY least(end_char, unit_end) - greatest(start_char, unit_start) DESC, abs((start_char + end_char) // 2 - (unit_start + unit_end) // 2), unit_no) AS k
  FROM c LEFT JOIN spans ON spans.doc_id = c.doc_id AND unit_start < end_char AND unit_end > start_char)
SELECT doc_id, position, start_char, end_char, unit_no AS source_unit_no FROM j WHERE k = 1""")
def _(spark, sf_dir):
    made = units_of(spark, sf_dir)
    pieces = chunking.chunk_documents(units.rebuilt_documents(made), "doc_id", "markdown")
    return chunking.assign_units(pieces, chunking.join_units(made)).select("doc_id", "position", "start_char", "end_char", "source_unit_no")


@query("rebuilt_documents", f"WITH RECURSIVE {UNITS} SELECT doc_id, sha256(string_agg(markdown, {NL2} ORDER BY unit_no)) AS digest FROM g GROUP BY doc_id")
def _(spark, sf_dir):
    return units.rebuilt_documents(units_of(spark, sf_dir)).select("doc_id", F.sha2("markdown", 256).alias("digest"))


@query("render_units", f"WITH RECURSIVE {UNITS} SELECT doc_id, sha256(string_agg('[UNIT ' || unit_no || ' | ' || source_locator || ' | ' || coalesce(heading, '') || ']' || chr(10) || markdown, {NL2} ORDER BY unit_no)) AS digest FROM g GROUP BY doc_id")
def _(spark, sf_dir):
    return units.render_units(units_of(spark, sf_dir)).select("doc_id", F.sha2("rendered", 256).alias("digest"))


@query("select_units_anchor", f"WITH RECURSIVE {UNITS}, f AS (SELECT *, abs(unit_no - 3) <= 1 OR unit_no = 6 AS x FROM g), a AS (SELECT *, bool_or(x) OVER (PARTITION BY doc_id) AS y FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(unit_no - 3), unit_no) AS k FROM a WHERE x OR NOT y) SELECT doc_id, unit_no FROM p WHERE k <= 3")
def _(spark, sf_dir):
    return units.select_units(units_of(spark, sf_dir), unit_nos=[6], anchor=3, window=1, max_units=3).select("doc_id", "unit_no")


@query("select_units_query", f"""WITH RECURSIVE {UNITS}, s AS (SELECT doc_id, unit_no, contains(lower(markdown), 'the thing')::INT * 100 + contains(lower(markdown), 'the')::INT * 3 + contains(lower(markdown), 'thing')::INT * 5 AS sc FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, unit_no) AS rk FROM s), f AS (SELECT *, rk <= 4 AND sc > 0 AS x FROM k), a AS (SELECT *, bool_or(x) OVER (PARTITION BY doc_id) AS y FROM f) SELECT doc_id, unit_no FROM a WHERE x OR NOT y""")
def _(spark, sf_dir):
    return units.select_units(units_of(spark, sf_dir), query="The thing").select("doc_id", "unit_no")


@query("derive_heading", f"SELECT doc_id, {heading_sql('t')} AS heading FROM ({MARKED})")
def _(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", T.derive_heading(F.col("text")).alias("heading"))


# --- pages ------------------------------------------------------------------

def html_sql(h: str) -> str:
    t = f"regexp_replace({h}, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', '', 'g')"
    t = f"regexp_replace({t}, '(?i)</?({T.BLOCK_TAGS})>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]+>', '', 'g')"
    for name, char in T.COMMON_ENTITIES.items():
        t = f"replace({t}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return t


PAGES = f"""pg AS (SELECT page_id AS doc_id, 1 AS page_no, {normalize_sql(html_sql('html'))} AS markdown FROM pages),
ph AS (SELECT doc_id, page_no, 'documents/site-' || doc_id % 7 || '/pages/page-' || lpad(doc_id::VARCHAR, 4, '0') || '.md' AS path, markdown, {heading_sql('markdown')} AS heading FROM pg)"""


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.normalize_markdown(T.html_to_markdown(F.col("html"), all_entities=False))
    made = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), body.alias("markdown"))
    path = F.concat(F.lit("documents/site-"), (F.col("doc_id") % 7).cast("string"), F.lit("/pages/page-"), F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit(".md"))
    return made.select("doc_id", "page_no", path.alias("path"), "markdown", T.derive_heading(F.col("markdown")).alias("heading"))


@query("html_to_markdown", f"SELECT page_id, sha256({normalize_sql(html_sql('html'))}) AS digest, length({normalize_sql(html_sql('html'))})::INT AS characters FROM pages")
def _(spark, sf_dir):
    body = T.normalize_markdown(T.html_to_markdown(F.col("html")))
    return read(spark, sf_dir, "pages").select("page_id", body.alias("body")).select("page_id", F.sha2("body", 256).alias("digest"), F.length("body").alias("characters"))


def occurrences_sql(t: str, term: str) -> str:
    return f"((length({t}) - length(replace({t}, '{term}', ''))) // {len(term)})::INT"


_LB, _LH = "lower(markdown)", "lower(coalesce(heading, ''))"
_QUERY_TERMS = ("the thing", "the", "thing")
_SCORE = " + ".join(f"{occurrences_sql(_LB, t)} * {w} + {occurrences_sql(_LH, t)} * {w + 2}" for t, w in zip(_QUERY_TERMS, (12.0, 3.0, 3.0), strict=True))
_COUNT = " + ".join(f"{occurrences_sql(x, t)}" for t in _QUERY_TERMS for x in (_LB, _LH))
_PLACE = "coalesce(" + ", ".join(f"nullif(strpos({_LB}, '{t}'), 0) - 1" for t in _QUERY_TERMS) + ")"


def squash_sql(t: str) -> str:
    return f"trim(regexp_replace({t}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')"


def snippet_sql(body: str, at: str, window: int = 180) -> str:
    cut = f"CASE WHEN greatest({at} - {window}, 0) > 0 THEN '...' ELSE '' END || {body}[greatest({at} - {window}, 0) + 1 : least({at} + {window}, length({body}))] || CASE WHEN least({at} + {window}, length({body})) < length({body}) THEN '...' ELSE '' END"
    return f"CASE WHEN {body} = '' THEN '' WHEN {at} IS NULL THEN {squash_sql(f'{body}[1 : {2 * window}]')} ELSE {squash_sql(cut)} END"


@query("page_search", f"""WITH {DOCS}, {PAGES}, s AS (SELECT ph.*, ({_SCORE})::DOUBLE AS sc, ({_COUNT})::INT AS match_count, {_PLACE} AS place FROM ph),
j AS (SELECT s.doc_id, relative_path AS original_filename, relative_path, page_no, heading, {snippet_sql('markdown', 'place')} AS text, round(sc, 4) AS semantic_score, 1 AS metadata_score, round(sc + 1, 4) AS score, match_count, 'page_content+metadata' AS matched_by FROM s JOIN d USING (doc_id) WHERE sc > 0 AND lower(lang) = 'en')
SELECT * FROM j ORDER BY score DESC, match_count DESC, lower(original_filename), page_no, doc_id LIMIT 25""")
def _(spark, sf_dir):
    return pages.page_search(pages_of(spark, sf_dir).drop("path"), corpus(spark, sf_dir), "The  thing", filters.parse_filters("lang = en"), 25)


@query("grep_pages", f"""WITH {PAGES}, m AS (SELECT *, regexp_extract_all(markdown, '(?mi)th[a-z]*ing', 0) AS ms FROM ph)
SELECT path, len(ms)::INT AS hits, {squash_sql("markdown[length(string_split_regex(markdown, '(?mi)th[a-z]*ing')[1]) + 1 : length(string_split_regex(markdown, '(?mi)th[a-z]*ing')[1]) + 220]")} AS snippet FROM m WHERE len(ms) > 0 ORDER BY path LIMIT 8""")
def _(spark, sf_dir):
    return pages.grep_pages(pages_of(spark, sf_dir), "th[a-z]*ing")


_GAP = "length(string_split_regex(markdown, '(?mi)th[a-z]*ing')[1])"


@query("grep_ranked", f"""WITH {PAGES}, m AS (SELECT *, regexp_extract_all(markdown, '(?mi)th[a-z]*ing', 0) AS ms FROM ph)
SELECT path, len(ms)::INT AS hits, {squash_sql(f"markdown[greatest({_GAP} - 40, 0) + 1 : {_GAP} + length(ms[1]) + 180]")} AS snippet FROM m WHERE len(ms) > 0 ORDER BY hits DESC, path LIMIT 8""")
def _(spark, sf_dir):
    return pages.grep_ranked(pages_of(spark, sf_dir), "th[a-z]*ing")


@query("grep_document", f"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '(?mi)onnt[a-z]+', 0) AS ms, string_split_regex(text, '(?mi)onnt[a-z]+') AS gs FROM documents),
e AS (SELECT doc_id, text, ms, gs, unnest(range(1, least(len(ms), 5) + 1)) AS i FROM m),
p AS (SELECT doc_id, text, i, length(ms[i]) AS n, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM e)
SELECT doc_id, i::INT AS match_no, ({squash_sql("text[greatest(s - 40, 0) + 1 : s + n + 180]")})[1:220] AS snippet FROM p""")
def _(spark, sf_dir):
    return pages.grep_document(read(spark, sf_dir, "documents"), "onnt[a-z]+")


@query("glob_pages", f"""WITH {PAGES}, x AS (SELECT path FROM ph WHERE path LIKE 'documents/site-3/%'), f AS (SELECT path FROM x ORDER BY path LIMIT 20)
SELECT count(*) AS total, min(regexp_extract(path, 'page-(\\d+)', 1)::INT) AS first_page, max(regexp_extract(path, 'page-(\\d+)', 1)::INT) AS last_page, (SELECT string_agg(path, chr(10) ORDER BY path) FROM f) AS first_pages FROM x""")
def _(spark, sf_dir):
    return pages.glob_pages(pages_of(spark, sf_dir), "documents/site-3")


_BODY = f"CASE WHEN trim(markdown, {WS}) = '' THEN '' ELSE trim(markdown, {WS}) || chr(10) END"
MANIFEST = f"""man AS (SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY unit_no))::INT AS page_no, 'documents/src' || doc_id % 20 || '-doc-' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.PDF' ELSE '.md' END AS folder, heading, length({_BODY})::INT AS char_count, doc_id % 4 <> 0 AS is_synthetic, sha256({_BODY}) AS content_hash FROM g)"""


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit(" /doc: "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".PDF").otherwise(".md")).alias("original_filename"))


def manifest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = page_names(spark, sf_dir)
    return pages.page_manifest(units_of(spark, sf_dir), names)


@query("page_manifest", f"WITH RECURSIVE {UNITS}, {MANIFEST} SELECT document_id, page_no, folder || '/pages/page-' || lpad(page_no::VARCHAR, 4, '0') || '.md' AS object_key, heading, char_count, is_synthetic, content_hash FROM man")
def _(spark, sf_dir):
    return manifest_of(spark, sf_dir)


@query("page_summary", f"WITH RECURSIVE {UNITS}, {MANIFEST} SELECT document_id, count(*) AS pages, max(page_no) AS last_page, count(*) FILTER (is_synthetic) AS synthetic_pages FROM man GROUP BY document_id")
def _(spark, sf_dir):
    return pages.page_summary(manifest_of(spark, sf_dir))


@query("load_pages", f"WITH RECURSIVE {UNITS}, {MANIFEST} SELECT document_id, page_no, char_count, content_hash AS digest FROM man")
def _(spark, sf_dir):
    m = manifest_of(spark, sf_dir)
    texts = units_of(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("unit_no").alias("page_no"), T.page_body(F.col("markdown")).alias("body"))
    bodies = m.select("document_id", "page_no", "object_key").join(texts, ["document_id", "page_no"]).select("object_key", "body")
    return pages.load_pages(m, bodies).select("document_id", "page_no", "char_count", F.sha2("markdown", 256).alias("digest"))


@query("stored_pages", f"WITH RECURSIVE {UNITS}, {MANIFEST} SELECT folder || '/pages/page-' || lpad(page_no::VARCHAR, 4, '0') || '.md' AS object_key, content_hash AS digest FROM man")
def _(spark, sf_dir):
    stored, names = packs.PackedObjects(spark, scratch(spark)), page_names(spark, sf_dir)
    stored.write(pages.page_objects(units_of(spark, sf_dir), names))
    return stored.bodies("documents").select("object_key", F.sha2("data", 256).alias("digest"))


@query("scanned_files", "SELECT source || '/doc-' || doc_id || '.md' AS relative_path, '.md' AS suffix, strlen(text) AS file_size, sha256(text) AS file_hash FROM documents")
def _(spark, sf_dir):
    root, texts = scratch(spark), read(spark, sf_dir, "documents")
    key = F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    objects.write_objects(texts.select(F.col("source").alias("prefix"), key.alias("object_key"), F.encode("text", "utf-8").alias("data")), root)
    return files.scan(spark, objects.opened(root)[1]).select("relative_path", "suffix", "file_size", "file_hash")


@query("object_heads", "SELECT 'kept/' || lang || '/' || doc_id AS object_key, strlen(text) AS size FROM documents WHERE lang = 'en' UNION ALL SELECT 'kept/de/' || doc_id, strlen(text) FROM documents WHERE lang = 'de'")
def _(spark, sf_dir):
    root, texts = scratch(spark), read(spark, sf_dir, "documents")
    place = F.when(F.col("lang").isin("en", "de"), F.concat(F.lit("kept/"), "lang")).otherwise(F.concat(F.lit("dropped/"), F.coalesce("lang", F.lit("none"))))
    objects.write_objects(texts.select(place.alias("prefix"), F.concat(place, F.lit("/"), F.col("doc_id").cast("string")).alias("object_key"), F.encode("text", "utf-8").alias("data")), root)
    objects.delete_prefix(root, "dropped")
    return objects.heads(spark, root).select("object_key", "size")


@query("page_by_path", f"WITH RECURSIVE {UNITS}, {MANIFEST} SELECT document_id, page_no FROM man WHERE document_id = 7 AND page_no = 1")
def _(spark, sf_dir):
    return pages.page_by_path(manifest_of(spark, sf_dir), "DOCUMENTS/src7-doc-7.MD/pages/page-0001.md").select("document_id", "page_no")


@query("relevant_pages", f"""WITH RECURSIVE {UNITS}, s AS (SELECT doc_id, unit_no, {' + '.join(f"contains(lower(regexp_replace(markdown, '\\s+', ' ', 'g')), '{t}')::INT * {w}" for t, w in (('onnt thing with ering', 100), ('onnt', 1), ('thing', 1), ('ering', 1)))} AS sc FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, unit_no) AS rk FROM s WHERE sc > 0) SELECT doc_id AS document_id, unit_no AS page_no FROM k WHERE rk <= 2""")
def _(spark, sf_dir):
    return pages.relevant_pages(units_of(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("unit_no").alias("page_no"), "markdown"), "onnt  thing with\nering")


IMAGES = "SELECT doc_id AS document_id, i::INT AS page_no, ('h' || (doc_id * 3 + i) % 50) AS image_hash, i::INT AS image_index FROM documents, range(1, 4) r(i)"


def images_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    return rows.select(F.col("doc_id").alias("document_id"), F.col("i").alias("page_no"), F.concat(F.lit("h"), ((F.col("doc_id") * 3 + F.col("i")) % 50).cast("string")).alias("image_hash"), F.col("i").alias("image_index"))


@query("images_by_page", f"""WITH RECURSIVE {UNITS}, im AS ({IMAGES}) SELECT im.document_id, im.page_no, min(heading) AS heading, string_agg(image_index || ':' || image_hash, ',' ORDER BY image_index) AS images FROM im LEFT JOIN g ON g.doc_id = im.document_id AND g.unit_no = im.page_no WHERE image_hash[2:]::INT % 2 = 0 GROUP BY im.document_id, im.page_no""")
def _(spark, sf_dir):
    heads = units_of(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("unit_no").alias("page_no"), "heading")
    images = images_of(spark, sf_dir)
    known = images.select("image_hash").distinct().where("cast(substring(image_hash, 2) as int) % 2 = 0").withColumn("semantic_text", F.concat(F.lit("about "), "image_hash"))
    found = pages.images_by_page(heads, images, known)
    return found.select("document_id", "page_no", "heading", F.array_join(F.transform("images", lambda i: F.concat(i["image_index"].cast("string"), F.lit(":"), i["image_hash"])), ",").alias("images"))


@query("header_footer_strip", f"""WITH p AS (SELECT doc_id % 10 AS doc, (doc_id // 10)::INT AS page_no, 'Head ' || doc_id % 10 || chr(10) || CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE 'Body ' || doc_id END || chr(10) || 'Foot ' || doc_id % 10 || chr(10) || CASE WHEN doc_id % 2 = 0 THEN (doc_id // 10) || ' / 99' ELSE 'end ' || doc_id END AS markdown FROM documents)
SELECT doc, page_no, chr(10) || string_split(markdown, chr(10))[2] || chr(10) || string_split(markdown, chr(10))[3] || chr(10) || CASE WHEN string_split(markdown, chr(10))[4] = page_no || ' / 99' THEN '' ELSE string_split(markdown, chr(10))[4] END AS markdown FROM p""")
def _(spark, sf_dir):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    page = F.floor(i / 10).cast("int")
    body = F.concat(F.lit("Head "), s(i % 10), F.lit("\n"), F.when(i % 3 == 0, s(i)).otherwise(F.concat(F.lit("Body "), s(i))), F.lit("\nFoot "), s(i % 10), F.lit("\n"), F.when(i % 2 == 0, F.concat(s(page), F.lit(" / 99"))).otherwise(F.concat(F.lit("end "), s(i))))
    rows = read(spark, sf_dir, "documents").select((i % 10).alias("doc"), page.alias("page_no"), body.alias("markdown"))
    return units.strip_headers_and_footers(rows, "doc")


# --- search -------------------------------------------------------------------

_HITS = "(contains(lower(text), 'orantion')::INT + contains(lower(text), 'thing')::INT)"
KEYWORD = f"""WITH RECURSIVE {DOCS}, {chunk_ctes(PARAGRAPHS)}, kw AS (SELECT c.doc_id, relative_path, position, c.text, {_HITS} AS score FROM c JOIN d USING (doc_id) WHERE NOT is_deleted AND {_HITS} > 0 ORDER BY score DESC, relative_path, position LIMIT {{n}})"""


@query("keyword_search", KEYWORD.format(n=20) + " SELECT * FROM kw")
def _(spark, sf_dir):
    return search.keyword_search(chunks_of(spark, sf_dir), corpus(spark, sf_dir), "orantion Thing", 20)


@query("keyword_search_scoped", f"WITH RECURSIVE {DOCS}, {chunk_ctes(PARAGRAPHS)} SELECT c.doc_id, relative_path, position, {_HITS} AS score FROM c JOIN d USING (doc_id) WHERE NOT is_deleted AND doc_id % 3 = 1 AND {_HITS} > 0 ORDER BY score DESC, relative_path, position LIMIT 15")
def _(spark, sf_dir):
    wanted = read(spark, sf_dir, "documents").where("doc_id % 3 = 1").select("doc_id")
    return search.keyword_search(chunks_of(spark, sf_dir), corpus(spark, sf_dir), "orantion thing", 15, wanted).drop("text")


@query("keyword_search_batch", f"""WITH RECURSIVE {DOCS}, {chunk_ctes(PARAGRAPHS)}, q AS (SELECT item_id AS query_id, unnest(list_distinct_ordered) AS term FROM (SELECT item_id, list_transform(list_filter(list_zip(range(1, len(ts) + 1), ts), lambda x: list_position(ts, x[2]) = x[1]), lambda x: x[2])[1:8] AS list_distinct_ordered FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}') AS ts FROM benchmark))),
s AS (SELECT query_id, c.doc_id, position, count(*)::INT AS score FROM q JOIN c ON contains(lower(c.text), term) GROUP BY ALL), k AS (SELECT query_id, doc_id, relative_path, position, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relative_path, position) AS rank FROM s JOIN d USING (doc_id) WHERE NOT is_deleted)
SELECT query_id, doc_id, relative_path, position, score, rank::INT AS rank FROM k WHERE rank <= 5""")
def _(spark, sf_dir):
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.keyword_search_batch(chunks_of(spark, sf_dir), corpus(spark, sf_dir), asked, 5)


# --- search through an inverted index -----------------------------------------

def indexed_chunks(spark: SparkSession, sf_dir: str, docs: DataFrame) -> inverted.Segment:
    named = chunks_of(spark, sf_dir).join(docs.select("doc_id", "relative_path"), "doc_id")
    return inverted.write_segment(named.select("doc_id", "relative_path", "position", "text"), scratch(spark))


@query("indexed_keyword_search", KEYWORD.format(n=20) + " SELECT * FROM kw")
def _(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return inverted.indexed_keyword_search([indexed_chunks(spark, sf_dir, docs)], docs, "orantion Thing", 20).rows


@query("indexed_keyword_search_scoped", ORACLES["keyword_search_scoped"])
def _(spark, sf_dir):
    docs, wanted = corpus(spark, sf_dir), read(spark, sf_dir, "documents").where("doc_id % 3 = 1").select("doc_id")
    return inverted.indexed_keyword_search([indexed_chunks(spark, sf_dir, docs)], docs, "orantion thing", 15, wanted).rows.drop("text")


@query("indexed_page_search", ORACLES["page_search"])
def _(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    named = pages_of(spark, sf_dir).select("doc_id", F.col("path").alias("relative_path"), F.col("page_no").alias("position"), "heading", F.col("markdown").alias("text"))
    return inverted.indexed_page_search([inverted.write_segment(named, scratch(spark))], docs, "The  thing", filters.parse_filters("lang = en"), 25).rows


META_CASES = {
    "eq": ("lang = EN", "lower(coalesce(lang, '')) = 'en'"),
    "eq_bool": ("toxic = true", "coalesce(toxic, '') = 'true'"),
    "eq_number": ("quality = 1", "coalesce(quality::DOUBLE = 1, false)"),
    "ne": ("lang != 'en'", "lower(coalesce(lang, '')) <> 'en'"),
    "ne_number": ("quality != 1", "coalesce(quality::DOUBLE <> 1, false)"),
    "gt": ("n_chars > 3000", "n_chars::DOUBLE > 3000"),
    "gte": ("quality >= 1", "coalesce(quality::DOUBLE >= 1, false)"),
    "lt": ("n_chars < 400.5", "n_chars::DOUBLE < 400.5"),
    "lte": ("quality <= 0", "coalesce(quality::DOUBLE <= 0, false)"),
    "contains": ("source ~ RC1", "contains(lower(source), 'rc1')"),
    "in": ("lang in (de, 'fr')", "lower(coalesce(lang, '')) IN ('de', 'fr')"),
    "in_number": ("quality in (0, 2)", "coalesce(quality::DOUBLE IN (0, 2), false)"),
    "and": ("lang: en and n_chars >= 500, toxic = false", "lower(lang) = 'en' AND n_chars::DOUBLE >= 500 AND coalesce(toxic, '') = 'false'"),
}


def _metadata_case(text: str) -> Query:
    return lambda spark, sf_dir: search.metadata_search(corpus(spark, sf_dir), filters.parse_filters(text), 300)


for _name, (_text, _sql) in META_CASES.items():
    QUERIES[f"metadata_filter_{_name}"] = _metadata_case(_text)
    ORACLES[f"metadata_filter_{_name}"] = f"WITH {DOCS} SELECT doc_id, relative_path, content[1:320] AS preview, {len(filters.parse_filters(_text))} AS metadata_score FROM d WHERE NOT is_deleted AND {_sql} ORDER BY relative_path LIMIT 300"


#: Fields of the corpus's metadata.
META_FIELDS = ("lang", "source", "n_chars", "quality", "toxic")


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it is indexed: metadata is parsed once, into typed columns."""
    return written(filters.shred(corpus(spark, sf_dir).drop("lang", "source"), META_FIELDS))


def _typed_case(text: str) -> Query:
    return lambda spark, sf_dir: search.metadata_search(stored_corpus(spark, sf_dir), filters.parse_filters(text), 300)


for _name, (_text, _sql) in META_CASES.items():
    QUERIES[f"typed_filter_{_name}"] = _typed_case(_text)
    ORACLES[f"typed_filter_{_name}"] = ORACLES[f"metadata_filter_{_name}"]


def hybrid_sql(meta: str, n_filters: int, limit: int) -> str:
    most = 4 * limit
    return KEYWORD.format(n=most) + f""", md AS (SELECT doc_id, relative_path, content[1:320] AS preview FROM d WHERE NOT is_deleted AND {meta} ORDER BY relative_path LIMIT {most}),
b AS (SELECT doc_id, relative_path, position, text, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS k FROM kw),
o AS (SELECT coalesce(b.doc_id, md.doc_id) AS doc_id, coalesce(b.relative_path, md.relative_path) AS relative_path, position, coalesce(text, preview) AS text, coalesce(score, 0)::DOUBLE AS semantic_score, CASE WHEN md.doc_id IS NULL THEN 0 ELSE {n_filters} END AS metadata_score FROM (SELECT * FROM b WHERE k = 1) b FULL JOIN md ON b.doc_id = md.doc_id)
SELECT *, semantic_score * 100 + metadata_score * 10 AS combined_score, CASE WHEN semantic_score > 0 AND metadata_score > 0 THEN 'semantic+metadata' WHEN semantic_score > 0 THEN 'semantic' ELSE 'metadata' END AS matched_by FROM o ORDER BY combined_score DESC, semantic_score DESC, metadata_score DESC, coalesce(position, 1000000000), relative_path LIMIT {limit}"""


@query("hybrid_search", hybrid_sql("lower(lang) = 'en' AND n_chars::DOUBLE > 2000", 2, 40))
def hybrid(spark, sf_dir):
    return search.hybrid_search(chunks_of(spark, sf_dir), corpus(spark, sf_dir), "orantion thing", filters.parse_filters("lang = en and n_chars > 2000"), 40)


@query("hybrid_search_metadata_only", hybrid_sql("lower(lang) = 'de'", 1, 10).replace(f"{_HITS} > 0 ORDER", "false ORDER"))
def _(spark, sf_dir):
    return search.hybrid_search(chunks_of(spark, sf_dir), corpus(spark, sf_dir), "orantion thing", filters.parse_filters("lang = de"), 10, use_semantic=False)


def vector_sql(where: str) -> str:
    return f"SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE {where}"


@query("vector_search", f"SELECT vec_id, score FROM ({vector_sql('a.vec_id = 3')}) ORDER BY score DESC, vec_id LIMIT 20")
def _(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 3").select("embedding").first()[0]
    return search.vector_search(vectors, q, 20)


@query("vector_search_batch", f"SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({vector_sql('a.vec_id % 50 = 0')})) WHERE rank <= 10")
def _(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return search.vector_search_batch(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)


@query("cell_vector_search_batch")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    index = vectors.write_cells(rows, scratch(spark))
    return vectors.cell_search(index, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)


@query("chunk_vector_search", f"""WITH {DOCS}, v AS (SELECT b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3)
SELECT doc_id, relative_path, 0 AS position, score FROM v JOIN d USING (doc_id) WHERE NOT is_deleted ORDER BY score DESC, relative_path, position LIMIT 20""")
def _(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("position"), "embedding")
    q = vectors.where("doc_id = 3").select("embedding").first()[0]
    pieces = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("position"), "text")
    return search.chunk_vector_search(vectors, pieces, corpus(spark, sf_dir), q, 20).drop("text")


# --- texts ------------------------------------------------------------------

@query("snippets", f"""SELECT doc_id, {snippet_sql(f'trim(text, {WS})', "nullif(strpos(text, 'thing'), 0) - 1")} AS snippet, CASE WHEN length({squash_sql('text')}) > 320 THEN ({squash_sql('text')})[1:320] || '...' ELSE {squash_sql('text')} END AS excerpt, CASE WHEN length({squash_sql('text')}) > 220 THEN rtrim(({squash_sql('text')})[1:217]) || '...' ELSE {squash_sql('text')} END AS short FROM documents""")
def _(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.match_snippet(t, F.when(F.instr(t, "thing") > 0, F.instr(t, "thing") - 1)).alias("snippet"), T.excerpt(t).alias("excerpt"), T.snippet(t).alias("short"))


@query("previews", "SELECT doc_id, CASE WHEN length(text) > 3000 THEN text[1:3000] || chr(10) || chr(10) || '[... PREVIEW TRUNCATED. Full document has ' || format('{:,}', length(text)) || ' characters. Use parse_file() to read the complete document ...]' ELSE text END AS preview FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("filenames", r"""SELECT doc_id, CASE WHEN trim(s, '-.') = '' THEN 'document' ELSE trim(s, '-.') END AS safe, trim(text) <> '' AND NOT regexp_matches(text, '[\\/:*?"<>|]') AS valid FROM (SELECT doc_id, text, regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g') AS s FROM documents)""")
def _(spark, sf_dir):
    name = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.sanitize_filename(name).alias("safe"), T.valid_storage_name(name).alias("valid"))


@query("front_matter", f"SELECT doc_id, 'src' || doc_id % 20 AS filename, doc_id::VARCHAR AS page_no, sha256(text) AS digest, CASE WHEN trim(text, {WS}) = '' THEN 0 ELSE length(trim(text, {WS})) + 1 END::INT AS body_characters FROM documents")
def _(spark, sf_dir):
    headed = F.concat(F.lit('---\nfilename: "src'), (F.col("doc_id") % 20).cast("string"), F.lit('"\npage_no: '), F.col("doc_id").cast("string"), F.lit("\n---\n\n"), F.ltrim("text"))
    rows = read(spark, sf_dir, "documents").withColumn("page", headed)
    m = T.front_matter(F.col("page"))
    return rows.select("doc_id", m["filename"].alias("filename"), m["page_no"].alias("page_no"), F.sha2(T.strip_front_matter(F.col("page")), 256).alias("digest"), F.length(T.page_body(T.strip_front_matter(F.col("page")))).alias("body_characters"))


# --- metadata -----------------------------------------------------------------

FILES = f"""f AS (SELECT doc_id, source || '/' || CASE doc_id % 5 WHEN 0 THEN 'master_agreement_v2' WHEN 1 THEN '04_risk_report' WHEN 2 THEN '2024' WHEN 3 THEN 'the_final' ELSE 'Doc ' || doc_id END || '.MD' AS relative_path, n_chars AS file_size, doc_id * 1.5 AS file_mtime,
  text || CASE WHEN doc_id % 3 = 0 THEN ' $ ' || n_chars || ',000.50' WHEN doc_id % 3 = 1 THEN ' Sept ' || (doc_id % 27 + 1) || ', 2021' ELSE '' END AS content FROM documents)"""


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    stem = F.when(i % 5 == 0, "master_agreement_v2").when(i % 5 == 1, "04_risk_report").when(i % 5 == 2, "2024").when(i % 5 == 3, "the_final").otherwise(F.concat(F.lit("Doc "), i.cast("string")))
    more = F.when(i % 3 == 0, F.concat(F.lit(" $ "), F.col("n_chars").cast("string"), F.lit(",000.50"))).when(i % 3 == 1, F.concat(F.lit(" Sept "), (i % 27 + 1).cast("string"), F.lit(", 2021"))).otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), stem, F.lit(".MD")).alias("relative_path"), F.col("n_chars").alias("file_size"), (i * F.lit(1.5)).alias("file_mtime"), F.concat("text", more).alias("content"))


TYPE_SQL = "CASE doc_id % 5 WHEN 0 THEN 'agreement' WHEN 1 THEN 'report' WHEN 2 THEN '2024' WHEN 3 THEN 'final' ELSE 'doc' END"


@query("base_metadata", f"WITH {FILES} SELECT relative_path, regexp_replace(relative_path, '^.*/', '') AS filename, '.md' AS extension, {TYPE_SQL} AS document_type, file_size, file_mtime::DOUBLE AS file_mtime, doc_id % 3 = 0 AS mentions_currency, doc_id % 3 = 1 AS mentions_dates FROM f")
def _(spark, sf_dir):
    return metadata.base_metadata(files_of(spark, sf_dir))


@query("document_types", f"WITH {FILES} SELECT string_agg(DISTINCT {TYPE_SQL}, ', ' ORDER BY {TYPE_SQL}) AS types FROM f")
def _(spark, sf_dir):
    return catalog.document_types(files_of(spark, sf_dir).select(T.document_type(F.col("relative_path")).alias("document_type")))


@query("schema_projection", f"WITH {FILES} SELECT relative_path, '{{\"document_type\":\"' || {TYPE_SQL} || '\",\"file_size\":' || file_size || '}}' AS metadata_json FROM f")
def _(spark, sf_dir):
    return metadata.as_json(metadata.base_metadata(files_of(spark, sf_dir)), ["file_size", "document_type", "unknown"])


@query("discovery_sample", f"WITH {FILES}, p AS (SELECT doc_id, relative_path || '#' || doc_id AS relative_path, content, row_number() OVER (ORDER BY relative_path || '#' || doc_id) - 1 AS i, count(*) OVER () AS n FROM f) SELECT relative_path, content[1:2000] AS sample FROM p WHERE i % (n // 3) = 0 AND i < (n // 3) * 3")
def _(spark, sf_dir):
    unique = files_of(spark, sf_dir).withColumn("relative_path", F.concat("relative_path", F.lit("#"), F.col("doc_id").cast("string")))
    return metadata.discovery_sample(unique)


@query("document_listing", f"WITH {FILES} SELECT relative_path, doc_id FROM f ORDER BY relative_path")
def _(spark, sf_dir):
    return catalog.listing(files_of(spark, sf_dir), "documents").select("relative_path", "doc_id")


def _five_words(text: str) -> list[tuple[str, str]]:
    """Stands for a model: the first words, by their length."""
    return [("long" if len(w) > 5 else "short", w) for w in text.split(" ")[:5]]


@query("extracted_entities", "SELECT doc_id, (i - 1)::INT AS ordinal, CASE WHEN length(w) > 5 THEN 'long' ELSE 'short' END AS class, w AS text FROM (SELECT doc_id, unnest(range(1, least(len(ws), 5) + 1)) AS i, ws[i] AS w FROM (SELECT doc_id, string_split(text[1:6000], ' ') AS ws FROM documents))")
def _(spark, sf_dir):
    return metadata.extract_entities(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), _five_words)


@query("embedded_texts", "SELECT doc_id, length(text)::DOUBLE AS characters, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS es FROM documents")
def _(spark, sf_dir):
    made = metadata.embed_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return made.select("doc_id", F.col("embedding")[0].cast("double").alias("characters"), F.col("embedding")[1].cast("double").alias("es"))


@query("schema_table", f"WITH {FILES} SELECT 'document_type' AS field, 'string' AS type, {TYPE_SQL} AS value FROM f GROUP BY ALL UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', NULL)" for n, t in metadata.BASE_FIELDS.items() if n != "document_type") + ") v")
def _(spark, sf_dir):
    return metadata.schema_table(files_of(spark, sf_dir))


#: The words of a text stand for extracted entities.
ENTITIES = "e AS (SELECT doc_id, i::INT - 1 AS ordinal, CASE (i - 1) % 3 WHEN 0 THEN ' Party ' WHEN 1 THEN 'DATE' ELSE 'amount' END AS class, ws[i] AS text FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)))"
PROFILE = {"fields": [
    {"name": "extraction_enabled", "type": "boolean", "source": "runtime", "runtime": "enabled"},
    {"name": "n_entities", "type": "integer", "source": "runtime", "runtime": "extraction_count"},
    {"name": "classes", "type": "string", "source": "runtime", "runtime": "entity_classes"},
    {"name": "parties", "type": "string", "source_classes": ["party", "amount"], "mode": "csv"},
    {"name": "n_dates", "type": "integer", "source_classes": ["date"]},
    {"name": "has_amount", "type": "boolean", "source_classes": ["amount"]},
    {"name": "mentions_the", "type": "boolean", "source_classes": ["party", "date"], "mode": "contains_any", "contains_any": ["The"]},
]}


def entities_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ordinal", "text"))
    return words.select("doc_id", "ordinal", F.when(F.col("ordinal") % 3 == 0, " Party ").when(F.col("ordinal") % 3 == 1, "DATE").otherwise("amount").alias("class"), "text")


@query("entity_aggregation", f"""WITH {ENTITIES}, n AS (SELECT doc_id, ordinal, lower(trim(class)) AS class, trim(text, {WS}) AS text FROM e),
f AS (SELECT doc_id, lower(text) AS k, min({{'c': CASE class WHEN 'party' THEN 1 ELSE 2 END, 'o': ordinal, 't': text}}) AS x FROM n WHERE class IN ('party', 'amount') AND text <> '' GROUP BY doc_id, lower(text)),
v AS (SELECT doc_id, array_to_string(list_transform(list_sort(list(x))[1:16], lambda y: y.t), ', ') AS parties FROM f GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT class, ', ' ORDER BY class) AS classes, count(*) FILTER (class = 'date' AND text <> '') AS dates, bool_or(class = 'amount' AND text <> '') AS am, bool_or(class IN ('party', 'date') AND contains(lower(text), 'the')) AS th FROM n GROUP BY doc_id)
SELECT doc_id, true AS extraction_enabled, coalesce(n, 0) AS n_entities, coalesce(classes, '') AS classes, coalesce(parties, '') AS parties, coalesce(dates, 0) AS n_dates, coalesce(am, false) AS has_amount, coalesce(th, false) AS mentions_the FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN v USING (doc_id)""")
def _(spark, sf_dir):
    return metadata.aggregate_entities(read(spark, sf_dir, "documents"), entities_of(spark, sf_dir), metadata.normalize_profile(PROFILE))


# --- catalog and scope ----------------------------------------------------------

FACETS = f"""x AS (SELECT 'lang' AS field, lang AS value, relative_path FROM d UNION ALL SELECT 'source', source, relative_path FROM d UNION ALL SELECT 'n_chars', n_chars, relative_path FROM d UNION ALL SELECT 'toxic', toxic, relative_path FROM d),
y AS (SELECT field, value, min(relative_path) AS p FROM x WHERE value IS NOT NULL AND value <> '' GROUP BY field, value), z AS (SELECT field, value, (row_number() OVER (PARTITION BY field ORDER BY p, value))::INT AS place FROM y)"""


@query("facet_values", f"WITH {DOCS}, {FACETS} SELECT field, value, place FROM z WHERE place <= 10")
def _(spark, sf_dir):
    return catalog.facet_values(corpus(spark, sf_dir), ["lang", "source", "n_chars", "toxic"])


@query("typed_facet_values", ORACLES["facet_values"])
def _(spark, sf_dir):
    return catalog.facet_values(stored_corpus(spark, sf_dir), ["lang", "source", "n_chars", "toxic"])


@query("field_catalog", f"""WITH {DOCS}, {FACETS} SELECT field, CASE field WHEN 'toxic' THEN 'toxic (boolean) Values: true, false' WHEN 'n_chars' THEN 'n_chars (integer) Range: ' || min(CASE WHEN field = 'n_chars' THEN value::BIGINT END) || '-' || max(CASE WHEN field = 'n_chars' THEN value::BIGINT END) ELSE field || ' (string) Values: ' || string_agg('''' || value || '''', ', ' ORDER BY place) END AS description FROM z WHERE place <= 10 GROUP BY field""")
def _(spark, sf_dir):
    return catalog.field_catalog(corpus(spark, sf_dir), {"lang": "string", "source": "string", "n_chars": "integer", "toxic": "boolean"})


@query("list_documents", f"WITH {DOCS}, x AS (SELECT doc_id, relative_path FROM d WHERE contains(lower(relative_path || lang), 'src1') OR contains(lower('\"source\":\"' || source || '\"'), 'src1')) SELECT doc_id, relative_path, (SELECT count(*) FROM x) AS total FROM x ORDER BY relative_path LIMIT 15 OFFSET 30")
def _(spark, sf_dir):
    return catalog.list_documents(corpus(spark, sf_dir), "SRC1", page=3, page_size=15).select("doc_id", "relative_path", "total")


@query("document_summaries", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'name-' || doc_id ELSE source || '.md' END AS original_filename, CASE WHEN doc_id % 5 = 0 THEN 'key-' || doc_id ELSE source || '.md' END AS source_key, CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 3 = 0 THEN 'parsed' ELSE 'uploaded' END AS status FROM documents")
def _(spark, sf_dir):
    i = F.col("doc_id")
    named = lambda p, m: F.when(i % m == 0, F.concat(F.lit(p), i.cast("string"))).otherwise("")
    rows = read(spark, sf_dir, "documents").select("doc_id", named("name-", 2).alias("original_filename"), F.concat("source", F.lit(".md")).alias("relative_path"), named("key-", 5).alias("object_key"), F.when(i % 3 == 0, "parsed").alias("upload_status"), (i % 7 == 0).alias("is_deleted"))
    return catalog.document_summaries(rows)


@query("index_status", f"WITH RECURSIVE {DOCS}, {chunk_ctes(PARAGRAPHS)} SELECT (SELECT count(*) FROM d WHERE NOT is_deleted) AS documents, (SELECT count(*) FROM d WHERE is_deleted) AS deleted, (SELECT count(*) FROM c JOIN d USING (doc_id) WHERE NOT is_deleted) AS chunks, true AS has_metadata, false AS has_embeddings")
def _(spark, sf_dir):
    return catalog.index_status(corpus(spark, sf_dir), chunks_of(spark, sf_dir))


def members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("col"), (F.col("doc_id") % 4).cast("string")).alias("collection_id"), "doc_id")


def collections_of(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("col"), F.col("id").cast("string")).alias("collection_id"), F.concat(F.lit("Name "), (5 - F.col("id")).cast("string")).alias("name"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"), (F.col("id") == 4).alias("is_deleted"))


@query("scope_union", f"WITH {DOCS} SELECT doc_id FROM d WHERE NOT is_deleted AND (doc_id % 4 = 2 OR doc_id % 10 = 1)")
def _(spark, sf_dir):
    asked = read(spark, sf_dir, "documents").where("doc_id % 10 = 1").select("doc_id")
    return scope.resolve_scope(corpus(spark, sf_dir), members_of(spark, sf_dir), collections_of(spark), "col2", asked)


@query("collection_documents", f"WITH {DOCS} SELECT doc_id, relative_path FROM d WHERE NOT is_deleted AND doc_id % 4 = 2")
def _(spark, sf_dir):
    return scope.collection_documents(corpus(spark, sf_dir), members_of(spark, sf_dir), "col2").select("doc_id", "relative_path")


@query("collection_attach", "SELECT 'col2' AS collection_id, doc_id FROM documents WHERE doc_id % 4 <> 2 AND doc_id % 9 = 0")
def _(spark, sf_dir):
    asked = read(spark, sf_dir, "documents").where("doc_id % 9 = 0").select("doc_id")
    return scope.attach(members_of(spark, sf_dir), "col2", asked.unionByName(asked))[1]


@query("collection_detach", "SELECT 'col' || doc_id % 4 AS collection_id, doc_id FROM documents WHERE NOT (doc_id % 4 = 2 AND doc_id % 9 = 0)")
def _(spark, sf_dir):
    return scope.detach(members_of(spark, sf_dir), "col2", read(spark, sf_dir, "documents").where("doc_id % 9 = 0").select("doc_id"))


@query("collection_rename", "SELECT 'col' || i AS collection_id, CASE WHEN i = 1 THEN 'Other' ELSE 'Name ' || (5 - i) END AS name, i = 4 OR i = 1 AS is_deleted FROM range(5) r(i)")
def _(spark, sf_dir):
    return scope.change_collection(collections_of(spark), "col1", "2024-02-01", "Other", True).select("collection_id", "name", "is_deleted")


# --- synchronising -----------------------------------------------------------------

@query("soft_delete_missing", f"WITH {DOCS} SELECT doc_id, is_deleted OR doc_id % 10 = 0 AS is_deleted, NOT is_deleted AND doc_id % 10 = 0 AS newly FROM d")
def _(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    after, new = sync.mark_missing(docs, docs.where("doc_id % 10 <> 0").select("relative_path"))
    return after.select("doc_id", "is_deleted").join(new.select("doc_id", F.lit(True).alias("newly")), "doc_id", "left").select("doc_id", "is_deleted", F.coalesce("newly", F.lit(False)).alias("newly"))


UNIT_PAIR = """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'delete' WHEN doc_id % 11 = 0 THEN 'insert' WHEN doc_id % 7 = 0 THEN 'update' ELSE 'keep' END AS action FROM documents"""


def unit_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The units of two snapshots: one in ten is gone, one in eleven is new, one in seven has changed."""
    base = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("unit_no"), F.col("text").alias("markdown"), F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("string").alias("heading"), F.lit("unit-1").alias("source_locator"), F.lit("[]").alias("images_json"))
    old = base.where("doc_id % 11 <> 0 or doc_id % 10 = 0")
    new = base.where("doc_id % 10 <> 0").withColumn("heading", F.when(F.col("doc_id") % 7 == 0, "New"))
    return old, new


@query("sync_units_difference", UNIT_PAIR)
def _(spark, sf_dir):
    old, new = unit_versions(spark, sf_dir)
    return sync.difference(old, new, ["doc_id", "unit_no"], sync.UNIT_ATTRIBUTES).select("doc_id", "action")


@query("sync_units_counts", f"SELECT bucket, count(*) FILTER (action IN ('insert', 'update')) AS upserted, count(*) FILTER (action = 'keep') AS untouched, count(*) FILTER (action = 'delete') AS deleted FROM (SELECT doc_id % 3 AS bucket, action FROM ({UNIT_PAIR})) GROUP BY bucket")
def _(spark, sf_dir):
    old, new = unit_versions(spark, sf_dir)
    actions = sync.difference(old, new, ["doc_id", "unit_no"], sync.UNIT_ATTRIBUTES).withColumn("bucket", F.col("doc_id") % 3)
    return sync.difference_counts(actions, ["bucket"])


@query("upsert_documents", f"WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed twice' ELSE content END AS content FROM d")
def _(spark, sf_dir):
    base = corpus(spark, sf_dir).select("doc_id", "content")
    edited = base.where("doc_id % 7 = 0")
    changes = edited.withColumn("content", F.lit("changed")).withColumn("n", F.lit(1)).unionByName(edited.withColumn("content", F.lit("changed twice")).withColumn("n", F.lit(2)))
    return sync.upsert(base, sync.deduplicated(changes, ["doc_id"], "n"), ["doc_id"])


@query("delete_cascade", f"WITH RECURSIVE {chunk_ctes(PARAGRAPHS)} SELECT doc_id, position FROM c WHERE doc_id % 13 <> 0")
def _(spark, sf_dir):
    gone = read(spark, sf_dir, "documents").where("doc_id % 13 = 0").select("doc_id")
    return sync.delete_cascade({"chunks": chunks_of(spark, sf_dir).select("doc_id", "position")}, gone)["chunks"]


@query("image_placeholder_upsert", f"""WITH im AS ({IMAGES}), n AS (SELECT image_hash, 800 AS width FROM im GROUP BY image_hash), o AS (SELECT 'h' || i AS image_hash, CASE WHEN i % 2 = 0 THEN 640 END AS width, 'text ' || i AS semantic_text FROM range(0, 60) r(i) WHERE i % 3 = 0)
SELECT coalesce(o.image_hash, n.image_hash) AS image_hash, coalesce(o.width, n.width)::INT AS width, semantic_text FROM o FULL JOIN n ON o.image_hash = n.image_hash""")
def _(spark, sf_dir):
    i = F.col("id")
    old = spark.range(60).where("id % 3 = 0").select(F.concat(F.lit("h"), i.cast("string")).alias("image_hash"), F.lit("a").alias("source_document_id"), F.lit(None).cast("string").alias("mime_type"), F.when(i % 2 == 0, 640).alias("width"), F.lit(None).cast("int").alias("height"), F.concat(F.lit("text "), i.cast("string")).alias("semantic_text"))
    seen = images_of(spark, sf_dir).select("image_hash", F.col("document_id").cast("string").alias("source_document_id"), F.lit("image/png").alias("mime_type"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    return sync.upsert_images(old, seen).select("image_hash", "width", "semantic_text")


@query("pending_images", f"WITH im AS ({IMAGES}) SELECT DISTINCT image_hash FROM im WHERE image_hash[2:]::INT % 2 = 1")
def _(spark, sf_dir):
    images = images_of(spark, sf_dir)
    known = images.select("image_hash").distinct().withColumn("semantic_text", F.when(F.expr("cast(substring(image_hash, 2) as int) % 2 = 0"), "seen").otherwise(""))
    return sync.pending_images(known, images)


@query("stale_documents", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN true WHEN doc_id % 10 = 0 THEN false ELSE doc_id % 7 = 0 OR doc_id % 8 = 0 END AS stale FROM documents")
def _(spark, sf_dir):
    i = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), i.cast("string")).alias("relative_path"), F.when(i % 9 == 0, " ").otherwise("h").alias("content_hash"), (i * F.lit(0.5)).alias("file_mtime"), F.col("n_chars").alias("file_size"))
    found = docs.where("doc_id % 10 <> 0").select("relative_path", (F.col("file_mtime") + F.when(i % 7 == 0, 0.01).otherwise(1e-7)).alias("file_mtime"), (F.col("file_size") + F.when(i % 8 == 0, 1).otherwise(0)).alias("file_size"))
    return sync.stale(docs, found)


@query("parse_cache_split", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'miss' WHEN doc_id % 5 = 0 THEN 'hit' WHEN doc_id % 3 = 0 THEN 'miss' WHEN doc_id % 3 = 1 THEN 'hit' ELSE 'partial' END AS result FROM documents")
def _(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents")
    wanted = F.when(i % 3 == 0, F.array().cast("array<int>")).when(i % 3 == 1, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3), F.lit(9)))
    asked = rows.select("doc_id", F.when(i % 7 == 0, "other").otherwise("h").alias("file_hash"), wanted.alias("unit_nos"))
    cached = rows.where("doc_id % 11 <> 0").select("doc_id", F.lit("h").alias("content_hash"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("unit_nos"), (i % 5 == 0).alias("complete"))
    return sync.cache_probe(asked, cached)


@query("parse_state", "SELECT doc_id, (doc_id % 9)::INT AS page_count, doc_id % 2 = 0 OR doc_id % 3 = 0 AS parsed_is_complete FROM documents")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("int").alias("page_count"), (F.col("doc_id") % 2 == 0).alias("parsed_is_complete"))
    return sync.set_parse_state(docs, docs.select("doc_id", (F.col("doc_id") % 9).cast("int").alias("page_count"), (F.col("doc_id") % 3 == 0).alias("complete")))


@query("save_schema", "SELECT 'c' || i % 4 AS corpus_id, 's' || i AS name, CASE WHEN i = 5 THEN 'new' ELSE 'old' END AS schema_def, i = 5 OR (i % 2 = 1 AND i % 4 <> 1) AS is_active FROM range(12) r(i)")
def _(spark, sf_dir):
    i = F.col("id")
    row = lambda df, text, active: df.select(F.concat(F.lit("c"), (i % 4).cast("string")).alias("corpus_id"), F.concat(F.lit("s"), i.cast("string")).alias("name"), F.lit(text).alias("schema_def"), active.alias("is_active"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return sync.save_schema(row(spark.range(12), "old", i % 2 == 1), row(spark.range(5, 6), "new", F.lit(True))).drop("created_at")


# --- evidence --------------------------------------------------------------------

READS = "rd AS (SELECT conv_id AS session_id, turn, conv_id % 3 AS doc_id, (turn * 7 + length(text)) % 12 AS unit_no FROM conversations)"


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", (F.col("conv_id") % 3).alias("doc_id"), ((F.col("turn") * 7 + F.length("text")) % 12).alias("unit_no"))


RANGES = """i AS (SELECT session_id, doc_id, unit_no, unit_no - row_number() OVER (PARTITION BY session_id, doc_id ORDER BY unit_no) AS k FROM (SELECT DISTINCT session_id, doc_id, unit_no FROM rd WHERE unit_no > 0)),
rg AS (SELECT session_id, doc_id, min(unit_no) AS range_start, max(unit_no) AS range_end FROM i GROUP BY session_id, doc_id, k)"""


@query("coverage_ranges", f"WITH {READS}, {RANGES} SELECT * FROM rg")
def _(spark, sf_dir):
    return coverage.unit_ranges(reads_of(spark, sf_dir), ["session_id", "doc_id"])


REQUESTS = "q AS (SELECT DISTINCT session_id, doc_id, u AS unit_no FROM (SELECT session_id, doc_id, unnest(range(greatest(unit_no - 2, 1), unit_no + 3)) AS u FROM rd))"


@query("missing_units", f"WITH {READS}, {REQUESTS} SELECT * FROM q WHERE (doc_id = 2 OR unit_no <= 9) AND NOT EXISTS (SELECT 1 FROM rd WHERE rd.session_id = q.session_id AND rd.doc_id = q.doc_id AND rd.unit_no = q.unit_no)")
def _(spark, sf_dir):
    reads = reads_of(spark, sf_dir)
    asked = coverage.requested_units(reads.select("session_id", "doc_id", F.col("unit_no").alias("anchor"), F.lit(2).alias("window")))
    totals = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, 9).alias("total_units"))
    return coverage.missing_units(asked, reads, totals)


STREAKS = f"""{READS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, doc_id, unit_no ORDER BY turn) AS k FROM rd WHERE unit_no > 0),
t AS (SELECT c.conv_id AS session_id, c.turn, count(n.unit_no) AS new_units, bool_or(c.turn % 6 = 5) AS search FROM conversations c LEFT JOIN n ON n.session_id = c.conv_id AND n.turn = c.turn AND k = 1 GROUP BY 1, 2),
s AS (SELECT *, sum(CASE WHEN new_units > 0 OR search THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS isl FROM t)"""


@query("read_streaks", f"WITH {STREAKS}, z AS (SELECT session_id, turn, new_units, (sum(CASE WHEN new_units > 0 OR search THEN 0 ELSE 1 END) OVER (PARTITION BY session_id, isl ORDER BY turn))::BIGINT AS streak FROM s) SELECT *, streak >= 2 AS stale FROM z")
def _(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.when(F.col("turn") % 6 == 5, "search").otherwise("parse").alias("kind"))
    return coverage.read_streaks(turns, reads_of(spark, sf_dir))


@query("new_units", f"WITH {READS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, doc_id, unit_no ORDER BY turn) AS k FROM rd WHERE unit_no > 0) SELECT session_id, turn, doc_id, unit_no FROM n WHERE k = 1")
def _(spark, sf_dir):
    return coverage.new_units(reads_of(spark, sf_dir))


@query("stale_ranges", f"WITH {READS}, {RANGES} SELECT * FROM rg WHERE range_end - range_start <> 0")
def _(spark, sf_dir):
    covered = coverage.unit_ranges(reads_of(spark, sf_dir), ["session_id", "doc_id"])
    return coverage.stale_ranges(covered, covered.where("range_start = range_end"))


@query("active_evidence", f"WITH {READS} SELECT * FROM rd WHERE doc_id <> 1 AND unit_no BETWEEN 3 AND 8")
def _(spark, sf_dir):
    reads = reads_of(spark, sf_dir)
    active = reads.where("doc_id <> 1").select("session_id", "doc_id").distinct().withColumn("range_start", F.lit(3)).withColumn("range_end", F.lit(8))
    return coverage.active_evidence(reads, active)


@query("ranked_evidence", f"WITH {READS} SELECT session_id, turn, (row_number() OVER (PARTITION BY session_id ORDER BY turn % 5 = 0 DESC, turn % 3 = 0 DESC, abs(unit_no - 4), trunc(-(turn * 0.7))::INT, turn))::INT AS rank FROM rd")
def _(spark, sf_dir):
    t = F.col("turn")
    rows = reads_of(spark, sf_dir).select("session_id", "turn", t.alias("evidence_id"), "unit_no", (t % 5 == 0).alias("cited"), (t % 3 == 0).alias("promoted"), (t * F.lit(0.7)).alias("score"))
    return coverage.ranked_evidence(rows, 4).select("session_id", "turn", "rank")


@query("last_notes", "SELECT conv_id AS session_id, role AS kind, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations) WHERE k <= CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 2 ELSE 0 END")
def _(spark, sf_dir):
    notes = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("kind"), "turn")
    return coverage.last_notes(notes, {"user": 4, "assistant": 2})


# --- budgets ----------------------------------------------------------------------

MESSAGES = "ms AS (SELECT conv_id, turn::INT AS idx, role, CASE WHEN turn % 2 = 1 THEN 'Tool result for parse_file' || chr(10) || '[UNIT ' || turn % 9 || ' | x]' || chr(10) || text ELSE text END AS text FROM conversations)"


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    parsed = F.concat(F.lit("Tool result for parse_file\n[UNIT "), (t % 9).cast("string"), F.lit(" | x]\n"), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", t.cast("int").alias("idx"), "role", F.when(t % 2 == 1, parsed).otherwise(F.col("text")).alias("text"))


_TOKENS = "greatest(1, (length({}) + 3) // 4)::INT"
CLASSIFIED = f"""{MESSAGES}, cb AS (SELECT *, CASE WHEN idx % 2 = 0 THEN 'history' WHEN abs(idx % 9 - 3) = 0 THEN 'ring0' WHEN abs(idx % 9 - 3) <= 2 THEN 'ring1' ELSE 'ring2' END AS bucket FROM ms),
cl AS (SELECT *, CASE WHEN idx = max(idx) OVER (PARTITION BY conv_id) THEN 100 WHEN bucket = 'ring0' THEN 90 WHEN bucket = 'ring1' THEN 80 WHEN bucket = 'ring2' THEN 70 ELSE 40 + least(idx, 20) END AS priority, {_TOKENS.format('text')} AS tokens FROM cb)"""


@query("budget_buckets", f"WITH {CLASSIFIED} SELECT conv_id, idx, bucket, priority::INT AS priority, tokens FROM cl")
def _(spark, sf_dir):
    return budget.classify(messages_of(spark, sf_dir), 3).select("conv_id", "idx", "bucket", "priority", "tokens")


@query("budget_estimate", f"WITH {CLASSIFIED} SELECT conv_id, sum(tokens)::BIGINT AS tokens FROM cl GROUP BY conv_id")
def _(spark, sf_dir):
    return budget.estimate(messages_of(spark, sf_dir))


_CAP = "CASE bucket WHEN 'ring0' THEN 900 WHEN 'ring1' THEN 600 WHEN 'ring2' THEN 350 ELSE 220 END"
_NAMED = f"trim(text[1 : cap // 3] || chr(10) || chr(10) || '...[ring2 compressed]...' || chr(10) || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), lambda x: starts_with(x, '[UNIT ') OR starts_with(x, '#'))[1:8], chr(10)), {WS})"


@query("budget_caps", f"""WITH {CLASSIFIED}, k AS (SELECT *, {_CAP} AS cap FROM cl), n AS (SELECT *, {_NAMED} AS named FROM k)
SELECT conv_id, idx, CASE WHEN length(text) <= cap THEN text WHEN bucket = 'ring2' THEN CASE WHEN length(named) > cap THEN named[1 : cap - 20] || chr(10) || '...[truncated]...' ELSE named END ELSE text[1 : floor(cap * 0.6)::INT] || chr(10) || '...[compressed]...' || chr(10) || right(text, cap - floor(cap * 0.6)::INT - 30) END AS text FROM n""")
def _(spark, sf_dir):
    return budget.cap_messages(budget.classify(messages_of(spark, sf_dir), 3), 2).select("conv_id", "idx", "text")


@query("budget_drop_oldest", f"""WITH {CLASSIFIED}, s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS alive,
  coalesce(sum(CASE WHEN bucket = 'history' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  coalesce(sum((bucket = 'history')::INT) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rk FROM cl)
SELECT conv_id, idx, tokens FROM s WHERE NOT (bucket = 'history' AND total - gone > 900 AND alive - rk > 3)""")
def _(spark, sf_dir):
    return budget.drop_oldest(budget.classify(messages_of(spark, sf_dir), 3), "history", 900, 3).select("conv_id", "idx", "tokens")


def cap_sql(which: int) -> str:
    """What a text becomes within the caps of a pass."""
    cap = "CASE bucket " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in budget.CAPS[which].items()) + " END"
    named = _NAMED.replace("cap //", f"({cap}) //")
    return f"""CASE WHEN length(text) <= {cap} THEN text WHEN bucket = 'ring2' THEN CASE WHEN length({named}) > {cap} THEN ({named})[1 : {cap} - 20] || chr(10) || '...[truncated]...' ELSE {named} END
ELSE text[1 : floor(({cap}) * 0.6)::INT] || chr(10) || '...[compressed]...' || chr(10) || right(text, {cap} - floor(({cap}) * 0.6)::INT - 30) END"""


def drop_sql(name: str, of: str, bucket: str, keep: int, most: int) -> str:
    before = "OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS alive, coalesce(sum(CASE WHEN bucket = '{bucket}' THEN tokens ELSE 0 END) {before}, 0) AS gone, coalesce(sum((bucket = '{bucket}')::INT) {before}, 0) AS rk FROM {of}),
{name} AS (SELECT conv_id, idx, role, text, bucket, priority, tokens FROM {name}_s WHERE NOT (bucket = '{bucket}' AND total - gone > {most} AND alive - rk > {keep}))"""


def recap_sql(name: str, of: str, which: int, most: int) -> str:
    return f"""{name}_o AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) > {most} AS is_over FROM {of}), {name}_t AS (SELECT conv_id, idx, role, CASE WHEN is_over THEN {cap_sql(which)} ELSE text END AS text, bucket, priority FROM {name}_o),
{name} AS (SELECT *, {_TOKENS.format('text')} AS tokens FROM {name}_t)"""


# a capped message has 225 tokens at most, so that none is left to shrink below 600
@query("budget_compaction", f"""WITH {CLASSIFIED}, c0 AS (SELECT conv_id, idx, role, {cap_sql(0)} AS text, bucket, priority FROM cl), c0t AS (SELECT *, {_TOKENS.format('text')} AS tokens FROM c0), {recap_sql('c1', 'c0t', 1, 600)},
{drop_sql('h', 'c1', 'history', 6, 600)}, {drop_sql('r2', 'h', 'ring2', 3, 600)}, {drop_sql('r1', 'r2', 'ring1', 2, 600)}, {recap_sql('c2', 'r1', 2, 600)},
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) - coalesce(sum(tokens) OVER w, 0) AS kept, count(*) OVER (PARTITION BY conv_id) - count(*) OVER w AS behind FROM c2 WINDOW w AS (PARTITION BY conv_id ORDER BY priority, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, idx, role, text, bucket, priority::INT AS priority FROM p WHERE NOT (kept > 600 AND behind > 1)""")
def _(spark, sf_dir):
    return budget.compact(messages_of(spark, sf_dir), budget=600, anchor=3)


# --- session logs --------------------------------------------------------------------

EVENTS = """ev AS (SELECT event_id, user_id AS session_id, ts, CASE event_id % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'tool_call' WHEN 2 THEN 'ask_human' WHEN 3 THEN 'human_reply' WHEN 4 THEN 'go_deeper' WHEN 5 THEN 'tool_call' ELSE CASE WHEN event_id % 5 = 0 THEN 'complete' WHEN event_id % 11 = 0 THEN 'error' ELSE 'tool_call' END END AS type, event_id % 6 AS k FROM events)"""


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 7 == 0, "start").when(i % 7 == 2, "ask_human").when(i % 7 == 3, "human_reply").when(i % 7 == 4, "go_deeper").when((i % 7 == 6) & (i % 5 == 0), "complete").when((i % 7 == 6) & (i % 11 == 0), "error").otherwise("tool_call")
    k = (i % 6).cast("string")
    data = F.to_json(F.struct(F.when(i % 6 < 3, "parse_file").otherwise("glob").alias("tool"), F.when(i % 6 != 4, F.concat(F.lit("/f"), k)).alias("file_path"), F.when((i % 6 == 5) | (i % 7 == 4), F.concat(F.lit("/d"), k)).alias("directory")))
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), data.alias("data"))


@query("event_sequence", f"WITH {EVENTS} SELECT event_id, session_id, (row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id))::INT AS sequence FROM ev")
def _(spark, sf_dir):
    return events.sequenced(events_of(spark, sf_dir)).select("event_id", "session_id", "sequence")


_STATE = "CASE {} WHEN 'start' THEN 'running' WHEN 'human_reply' THEN 'running' WHEN 'ask_human' THEN 'awaiting_human' WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'error' END"
FINAL = f"""{EVENTS}, fs AS (SELECT session_id, arg_min(type, {{'t': ts, 'e': event_id}}) FILTER (type IN ('complete', 'error')) AS ended, arg_max(type, {{'t': ts, 'e': event_id}}) FILTER (type NOT IN ('tool_call', 'go_deeper')) AS last, max(ts) AS last_event FROM ev GROUP BY session_id),
st AS (SELECT session_id, coalesce({_STATE.format('ended')}, {_STATE.format('last')}, 'created') AS state, last_event FROM fs)"""


@query("session_final_state", f"WITH {FINAL} SELECT session_id, state FROM st")
def _(spark, sf_dir):
    return events.final_states(events_of(spark, sf_dir)).select("session_id", "state")


@query("session_retention", f"WITH {FINAL} SELECT session_id, state FROM st WHERE NOT (state IN ('completed', 'error') AND last_event < (SELECT max(ts) FROM ev) - INTERVAL 15 MINUTE)")
def _(spark, sf_dir):
    rows = events_of(spark, sf_dir)
    now = rows.agg(F.max("ts")).first()[0]
    return events.retained(rows, F.lit(now)).select("session_id", "state")


@query("illegal_replies", f"WITH {EVENTS}, b AS (SELECT *, last_value({_STATE.format('type')} IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev) SELECT event_id, session_id FROM b WHERE type = 'human_reply' AND coalesce(before, 'created') <> 'awaiting_human'")
def _(spark, sf_dir):
    return events.illegal_replies(events_of(spark, sf_dir)).select("event_id", "session_id")


@query("trace_steps", f"""WITH {EVENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS step FROM ev WHERE type IN ('tool_call', 'go_deeper')),
p AS (SELECT *, CASE WHEN k = 5 OR event_id % 7 = 4 THEN '/d' || k END AS dir, CASE WHEN k <> 4 THEN '/f' || k END AS f FROM t)
SELECT session_id, step::INT AS step, step || '. ' || CASE WHEN type = 'go_deeper' THEN 'godeeper (directory=' || coalesce(dir, '') || ')' ELSE 'tool:' || CASE WHEN k < 3 THEN 'parse_file' ELSE 'glob' END || ' (' || CASE WHEN dir IS NULL AND f IS NULL THEN 'no-path-args' ELSE concat_ws(', ', 'directory=' || dir, 'file=' || f) END || ')' END AS entry FROM p""")
def _(spark, sf_dir):
    return events.trace_steps(events_of(spark, sf_dir))


@query("referenced_documents", f"WITH {EVENTS} SELECT session_id, string_agg(DISTINCT '/f' || k, ', ' ORDER BY '/f' || k) AS documents FROM ev WHERE type = 'tool_call' AND k < 3 GROUP BY session_id")
def _(spark, sf_dir):
    return events.referenced_documents(events_of(spark, sf_dir))


@query("repeated_toolcalls", f"""WITH {EVENTS}, c AS (SELECT session_id, event_id AS step, event_id % 2 AS sig, ts FROM ev), r AS (SELECT *, coalesce(lag(sig) OVER w = sig, false) AS repeated FROM c WINDOW w AS (PARTITION BY session_id ORDER BY step))
SELECT session_id, step, repeated, repeated AND coalesce(lag(repeated) OVER (PARTITION BY session_id ORDER BY step), false) AS stops FROM r""")
def _(spark, sf_dir):
    calls = events_of(spark, sf_dir).select("session_id", F.col("event_id").alias("step"), (F.col("event_id") % 2).alias("signature"))
    return events.repeated_calls(calls).drop("signature")


@query("sse_frames", f"""WITH {EVENTS}, s AS (SELECT ev.*, props, row_number() OVER (PARTITION BY session_id ORDER BY ev.ts, ev.event_id) AS sequence FROM ev JOIN (SELECT event_id, props FROM events) USING (event_id))
SELECT session_id, sequence::INT AS sequence, 'event: ' || type || chr(10) || 'data: ' || '{{"session_id":' || session_id || ',"sequence":' || sequence || ',"type":"' || type || '","data":' || to_json(props)::VARCHAR || '}}' || chr(10) || chr(10) AS frame FROM s""")
def _(spark, sf_dir):
    props = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("data"))
    return events.sse_frames(events_of(spark, sf_dir).drop("data").join(props, "event_id"))


@query("token_usage", "SELECT user_id AS session_id, count(*) AS calls, sum(event_id % 1000)::BIGINT AS input_tokens, sum(event_id % 77)::BIGINT AS output_tokens, round(sum(event_id % 1000) / 1e6 * 0.15 + sum(event_id % 77) / 1e6 * 0.6, 6) AS cost FROM events GROUP BY user_id")
def _(spark, sf_dir):
    usage = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    return events.token_usage(usage, 0.15, 0.6)


@query("cited_sources", "SELECT doc_id, 'src' || doc_id % 20 || '.pdf|b.pdf' AS sources FROM documents")
def _(spark, sf_dir):
    answer = F.concat(F.lit("As [Source: src"), (F.col("doc_id") % 20).cast("string"), F.lit(".pdf, Section 2] and [Source: b.pdf] say, [Source:  src"), (F.col("doc_id") % 20).cast("string"), F.lit(".pdf ] too."))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.cited_sources(answer), "|").alias("sources"))


# --- plans of a session, focus, and choices ------------------------------------------

OPERATIONS = (*context.SCOPING, context.PROMOTE, context.SUMMARIZE, context.STOP, "dance")
_OPS = "[" + ", ".join(f"'{o}'" for o in OPERATIONS) + "]"
PLANS = f"""pl AS (SELECT conv_id AS session_id, turn, ({_OPS})[((turn * 5 + length(text)) % 8)::INT + 1] AS operation, CASE WHEN turn % 3 = 0 THEN 'd' || (length(text) % 4) END AS document_id,
  CASE WHEN turn % 2 = 0 THEN turn::INT % 5 END AS range_start, [turn - 1, turn + 3] AS evidence_ids, CASE WHEN turn % 4 = 1 THEN role ELSE ' ' END AS note FROM conversations),
ok AS (SELECT *, coalesce(document_id = 'd3', false) AS out_of FROM pl),
sc AS (SELECT *, last_value(CASE WHEN operation IN ('keep_ranges', 'expand_range', 'narrow_to_range', 'switch_document') AND NOT out_of THEN document_id END IGNORE NULLS) OVER w AS active_document_id,
  last_value(CASE WHEN operation IN ('keep_ranges', 'expand_range', 'narrow_to_range', 'switch_document') AND NOT out_of THEN range_start END IGNORE NULLS) OVER w AS active_start FROM ok WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
jd AS (SELECT *, CASE WHEN out_of THEN '{context.OUTSIDE}' WHEN operation = '{context.SUMMARIZE}' AND coalesce(document_id, active_document_id) IS NULL THEN '{context.NO_DOCUMENT}' WHEN operation = 'dance' THEN '{context.UNSUPPORTED}' END AS error FROM sc)"""


def plans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans made from conversations; document d3 is never selected."""
    t, n = F.col("turn"), F.length("text")
    rows = read(spark, sf_dir, "conversations")
    span = F.when(t % 2 == 0, F.array(F.struct((t % 5).cast("int").alias("start_unit"), (t % 5 + 2).cast("int").alias("end_unit")))).otherwise(F.array().cast("array<struct<start_unit:int,end_unit:int>>"))
    plans = rows.select(F.col("conv_id").alias("session_id"), "turn", F.get(F.array(*(F.lit(o) for o in OPERATIONS)), ((t * 5 + n) % 8).cast("int")).alias("operation"), F.when(t % 3 == 0, F.concat(F.lit("d"), (n % 4).cast("string"))).alias("document_id"), F.lit("").alias("file_path"), span.alias("ranges"), F.array(t - 1, t + 3).alias("evidence_ids"), F.when(t % 4 == 1, F.col("role")).otherwise(" ").alias("note"))
    selected = plans.select("session_id").distinct().select("session_id", F.explode(F.array(F.lit("d0"), F.lit("d1"), F.lit("d2"))).alias("document_id"))
    return context.judged_plans(plans, selected)


@query("context_plans", f"WITH {PLANS} SELECT session_id, turn, operation, error, error IS NULL AS applied, active_document_id, active_start FROM jd")
def _(spark, sf_dir):
    return plans_of(spark, sf_dir).select("session_id", "turn", "operation", "error", "applied", "active_document_id", F.col("active_ranges")[0]["start_unit"].alias("active_start"))


@query("promoted_evidence", f"WITH {PLANS}, e AS (SELECT session_id, turn, unnest(evidence_ids) AS evidence_id FROM jd WHERE operation = '{context.PROMOTE}' AND error IS NULL) SELECT session_id, evidence_id, min(turn) AS turn FROM e WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = e.session_id AND c.turn = e.evidence_id) GROUP BY session_id, evidence_id")
def _(spark, sf_dir):
    return context.promoted_evidence(plans_of(spark, sf_dir), read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("evidence_id")))


@query("summarized_ranges", f"WITH {PLANS}, cv AS (SELECT s.session_id, d.document_id, r.range_start, (r.range_start + 2)::INT AS range_end FROM (SELECT DISTINCT session_id FROM pl) s, (VALUES ('d0'), ('d1'), ('d2')) d(document_id), (VALUES (0), (2), (4)) r(range_start)), q AS (SELECT session_id, turn, coalesce(document_id, active_document_id) AS document_id, active_document_id, active_start FROM jd WHERE operation = '{context.SUMMARIZE}' AND error IS NULL) SELECT session_id, turn, document_id, range_start, range_end FROM q JOIN cv USING (session_id, document_id) WHERE NOT coalesce(active_document_id = document_id AND active_start = range_start, false)")
def _(spark, sf_dir):
    judged = plans_of(spark, sf_dir)
    spans = F.explode(F.array(*(F.struct(F.lit(d).alias("document_id"), F.lit(a).alias("range_start"), F.lit(a + 2).alias("range_end")) for d in ("d0", "d1", "d2") for a in (0, 2, 4))))
    covered = judged.select("session_id").distinct().select("session_id", spans.alias("s")).select("session_id", "s.*")
    return context.summarized_ranges(judged, covered)


#: A document's ranges are those of the last scoping turn that it was active in.
_RANGES = f"""WITH {PLANS}, ar AS (SELECT session_id, turn, active_document_id AS document_id, active_start FROM jd WHERE operation IN ('keep_ranges', 'expand_range', 'narrow_to_range', 'switch_document') AND error IS NULL AND active_document_id IS NOT NULL),
q AS (SELECT session_id, turn, coalesce(document_id, active_document_id) AS document_id FROM jd WHERE operation = '{context.SUMMARIZE}' AND error IS NULL),
la AS (SELECT q.session_id, q.turn, q.document_id, arg_max(coalesce(ar.active_start, -1), ar.turn) AS start FROM q LEFT JOIN ar ON ar.session_id = q.session_id AND ar.document_id = q.document_id AND ar.turn < q.turn GROUP BY ALL)
SELECT la.session_id, la.turn, la.document_id, r.range_start, (r.range_start + 2)::INT AS range_end FROM la, (VALUES (0), (2), (4)) r(range_start) WHERE la.document_id IN ('d0', 'd1', 'd2') AND NOT coalesce(start = r.range_start, false)"""


@query("summarized_document_ranges", _RANGES)
def _(spark, sf_dir):
    judged = plans_of(spark, sf_dir)
    spans = F.explode(F.array(*(F.struct(F.lit(d).alias("document_id"), F.lit(a).alias("range_start"), F.lit(a + 2).alias("range_end")) for d in ("d0", "d1", "d2") for a in (0, 2, 4))))
    covered = judged.select("session_id").distinct().select("session_id", spans.alias("s")).select("session_id", "s.*")
    return context.summarized_document_ranges(judged, covered)


@query("context_gaps", f"WITH {PLANS} SELECT session_id, turn, CASE WHEN trim(note) = '' THEN '{context.INSUFFICIENT}' ELSE note END AS message FROM jd WHERE operation = '{context.STOP}' AND error IS NULL")
def _(spark, sf_dir):
    return context.gaps(plans_of(spark, sf_dir))


@query("focused_units", f"WITH RECURSIVE {UNITS}, f AS (SELECT *, min(abs(unit_no - 9)) OVER (PARTITION BY doc_id) AS nearest FROM g) SELECT doc_id, unit_no FROM f WHERE abs(unit_no - 9) <= CASE WHEN nearest <= 1 THEN 1 WHEN nearest <= 2 THEN 2 WHEN nearest <= 4 THEN 4 WHEN nearest <= 8 THEN 8 ELSE 1000000 END")
def _(spark, sf_dir):
    return units.focused_units(units_of(spark, sf_dir), 9, 1).select("doc_id", "unit_no")


@query("semantic_or_keywords", "SELECT 'some' AS branch, vec_id AS id, 1.0 AS score FROM embeddings WHERE vec_id < 5 UNION ALL SELECT 'none', doc_id, 2.0 FROM documents WHERE doc_id < 7")
def _(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").where("vec_id < 5").select(F.col("vec_id").alias("id"), F.lit(1.0).alias("score"))
    words = read(spark, sf_dir, "documents").where("doc_id < 7").select(F.col("doc_id").alias("id"), F.lit(2.0).alias("score"))
    some, none = search.semantic_or_keywords(vectors, words), search.semantic_or_keywords(vectors.where("id < 0"), words)
    return some.select(F.lit("some").alias("branch"), "id", "score").unionByName(none.select(F.lit("none").alias("branch"), "id", "score"))


@query("evidence_upsert", f"WITH {READS} SELECT session_id, turn AS evidence_id, doc_id, unit_no, CASE WHEN turn % 3 = 0 THEN 'new' ELSE 'old' END AS snippet FROM rd WHERE turn % 3 = 0 OR turn % 2 = 0")
def _(spark, sf_dir):
    rows = reads_of(spark, sf_dir).withColumnRenamed("turn", "evidence_id")
    old, new = rows.where("evidence_id % 2 = 0").withColumn("snippet", F.lit("old")), rows.where("evidence_id % 3 = 0").withColumn("snippet", F.lit("new"))
    return coverage.upsert_evidence(old, new)


_PACK = "concat_ws(chr(10), 'Active evidence:', array_to_string({a}, chr(10)), 'Supporting evidence:', array_to_string({s}, chr(10)), 'Notes:', array_to_string(notes, chr(10)))"
_SHORT = "list_transform(active, lambda t: t[1 : {n}])"


@query("context_pack", f"""WITH e AS (SELECT conv_id AS session_id, list(text ORDER BY turn) FILTER (turn % 2 = 0) AS a, list(text[1 : 80] ORDER BY turn) FILTER (turn % 2 = 1) AS s, list(role || turn ORDER BY turn) AS notes FROM conversations GROUP BY conv_id),
k AS (SELECT session_id, coalesce(a, [])[1 : 8] AS active, coalesce(s, [])[1 : 8] AS supporting, notes FROM e),
z AS (SELECT session_id, active, supporting, notes, list_concat(['Active evidence:'], active, ['Supporting evidence:'], supporting, ['Notes:'], notes) AS l0, list_concat(['Active evidence:'], {_SHORT.format(n=1200)}, ['Supporting evidence:'], supporting[1 : 4], ['Notes:'], notes) AS l1, list_concat(['Active evidence:'], {_SHORT.format(n=500)}, ['Supporting evidence:'], ['Notes:'], notes) AS l2 FROM k)
SELECT session_id, CASE WHEN length(array_to_string(l0, chr(10))) <= 1500 THEN array_to_string(l0, chr(10)) WHEN length(array_to_string(l1, chr(10))) <= 1500 THEN array_to_string(l1, chr(10)) ELSE array_to_string(l2, chr(10))[1 : 1500] END AS pack FROM z""")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    evidence = rows.select("session_id", F.col("turn").alias("rank"), (F.col("turn") % 2 == 0).alias("is_active"), "text", F.substring("text", 1, 80).alias("snippet"))
    notes = rows.select("session_id", "turn", F.concat("role", F.col("turn").cast("string")).alias("text"))
    return budget.context_pack(evidence, notes, 1500)


@query("parse_errors", "SELECT doc_id, doc_id % 4 < 3 AS failed FROM documents")
def _(spark, sf_dir):
    said = F.get(F.array(F.lit("Error parsing "), F.lit("Unsupported file extension"), F.lit("No such file:"), F.lit("")), (F.col("doc_id") % 4).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", sync.is_parse_error(F.concat(said, F.coalesce("text", F.lit("")))).alias("failed"))


@query("decoded_texts", "SELECT doc_id, md5(text) AS any_digest, md5(text || 'x') AS utf8_digest FROM documents")
def _(spark, sf_dir):
    data = F.encode("text", "UTF-8")
    spoilt = F.concat(data, F.unhex(F.lit("FF78")))  # a byte that is no UTF-8, then x
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(files.decode_any(data)).alias("any_digest"), F.md5(files.decode_utf8(spoilt)).alias("utf8_digest"))


@query("embeddings_upsert", "SELECT vec_id, label, vec_id % 5 = 0 AS renewed FROM embeddings")
def _(spark, sf_dir):
    old = read(spark, sf_dir, "embeddings").withColumn("renewed", F.lit(False))
    return sync.upsert(old, old.where("vec_id % 5 = 0").withColumn("renewed", F.lit(True)), ["vec_id"]).select("vec_id", "label", "renewed")


@query("corpora_known", "SELECT count(*) AS corpora, bool_and(created_at = TIMESTAMP '2024-01-01') AS kept FROM (VALUES (TIMESTAMP '2024-01-01')) t(created_at)")
def _(spark, sf_dir):
    none = spark.createDataFrame([], SCHEMAS["corpora"])
    first = sync.get_or_create_corpus(none, "/data", F.lit("2024-01-01").cast("timestamp"))
    again = sync.get_or_create_corpus(first, "/data", F.lit("2025-01-01").cast("timestamp"))
    return again.agg(F.count("*").alias("corpora"), F.bool_and(F.col("created_at") == F.lit("2024-01-01").cast("timestamp")).alias("kept"))


@query("document_attributes", "SELECT doc_id, doc_id % 2 = 0 AS is_deleted, CASE WHEN doc_id % 2 = 0 THEN '{\"x\":1}' ELSE 'old' END AS metadata_json FROM documents")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(False).alias("is_deleted"), F.lit("old").alias("metadata_json"))
    even = F.col("doc_id") % 2 == 0
    return sync.set_attributes(docs, is_deleted=even, metadata_json=F.when(even, '{"x":1}').otherwise(F.col("metadata_json")))
