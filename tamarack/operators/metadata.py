"""Metadata of documents: what paths and texts say, and profiles of extracted entities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import document_type, mentions_currency, mentions_dates, strip

TYPES = ("string", "integer", "number", "boolean")
#: Names under which a mode is known.
MODES = {"csv": "values", "list": "values", "joined": "values", "join": "values", "values": "values", "count": "count", "exists": "exists", "contains": "contains", "contains_any": "contains"}
DEFAULTS = {"string": "", "integer": 0, "number": 0.0, "boolean": False}
LEAST_CHARS, USUAL_CHARS, VALUES_SHOWN = 500, 6000, 16


def base_metadata(files: DataFrame) -> DataFrame:
    """Metadata columns of files (relative_path, file_size, file_mtime, content)."""
    name = F.regexp_replace("relative_path", r"^.*/", "")
    text = F.coalesce("content", F.lit(""))
    return files.select("relative_path", name.alias("filename"), F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1)).alias("extension"), document_type(F.col("relative_path")).alias("document_type"), "file_size", "file_mtime", mentions_currency(text).alias("mentions_currency"), mentions_dates(text).alias("mentions_dates"))


def as_json(metadata: DataFrame, keys: list[str] | None = None, id_col: str = "relative_path") -> DataFrame:
    """id, metadata_json of the columns, or of those that a schema declares, with sorted keys."""
    chosen = sorted(c for c in metadata.columns if c != id_col and (not keys or c in keys))
    return metadata.select(id_col, F.to_json(F.struct(*chosen)).alias("metadata_json"))


class ProfileError(ValueError):
    """The profile isn't one."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    source: str = "entities"
    runtime: str = ""
    mode: str = "values"
    source_classes: tuple[str, ...] = ()
    contains_any: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    fields: tuple[Field, ...]
    max_chars: int = USUAL_CHARS
    prompt: str = ""
    extra: dict = field(default_factory=dict)


def default_mode(kind: str) -> str:
    return {"boolean": "exists", "integer": "count", "number": "count"}.get(kind, "values")


def normalize_profile(raw: dict) -> Profile:
    """A checked profile; raises ProfileError where names, types, sources or modes are none."""
    rows, seen = [], set()
    for item in raw.get("fields") or []:
        name = str(item.get("name", "")).strip()
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or name in seen:
            raise ProfileError(f"not a new field name: {name!r}")
        seen.add(name)
        kind, source = item.get("type", "string"), item.get("source", "entities")
        if kind not in TYPES or source not in ("runtime", "entities"):
            raise ProfileError(f"field {name}: type {kind!r}, source {source!r}")
        mode = MODES.get(str(item.get("mode") or default_mode(kind)).lower())
        runtime = str(item.get("runtime", ""))
        classes = tuple(dict.fromkeys(str(c).strip().lower() for c in item.get("source_classes") or [] if str(c).strip()))
        wanted = tuple(str(t).lower() for t in item.get("contains_any") or [])
        if source == "runtime" and runtime not in ("enabled", "extraction_count", "entity_classes"):
            raise ProfileError(f"field {name}: runtime {runtime!r}")
        if source == "entities" and (mode is None or not classes or (mode == "contains" and not wanted)):
            raise ProfileError(f"field {name}: mode, source_classes or contains_any is missing")
        rows.append(Field(name, kind, source, runtime, mode or "values", classes, wanted))
    if not rows:
        raise ProfileError("a profile has fields")
    most = int(raw.get("max_chars", USUAL_CHARS))
    if most < LEAST_CHARS:
        raise ProfileError(f"max_chars is at least {LEAST_CHARS}")
    return Profile(tuple(rows), most, str(raw.get("prompt", "")))


def profile_defaults(profile: Profile) -> dict[str, object]:
    return {f.name: DEFAULTS[f.type] for f in profile.fields}


def merged_schema(schema: dict, profile: Profile) -> tuple[dict, bool]:
    """(schema with the profile's fields that it lacks, whether it has changed)."""
    have = {f["name"] for f in schema.get("fields", [])}
    new = [{"name": f.name, "type": f.type} for f in profile.fields if f.name not in have]
    return {**schema, "fields": [*schema.get("fields", []), *new]}, bool(new)


def coerce(value: Column, kind: str) -> Column:
    """Text to a field's type; what can't be read is the type's zero."""
    if kind == "boolean":
        return F.coalesce(value, F.lit("")) != ""
    if kind == "integer":
        return F.coalesce(F.btrim(value).try_cast("bigint"), F.lit(0).cast("bigint"))
    if kind == "number":
        return F.coalesce(F.btrim(value).try_cast("double"), F.lit(0.0))
    return F.coalesce(value, F.lit(""))


def aggregate_entities(documents: DataFrame, extractions: DataFrame, profile: Profile, enabled: bool = True) -> DataFrame:
    """doc_id and a column for each field of the profile, from extractions (doc_id, ordinal, class, text).

    Whatever the number of fields there is one shuffle, by document, and no join: rows of a
    document are counted by text and class, then by spelling, whatever the case, then
    summed up. A values field takes the first spellings in the order of its classes, then
    of occurrence.
    """
    rows = extractions.select("doc_id", "ordinal", F.lower(strip(F.col("class"))).alias("class"), strip(F.coalesce("text", F.lit(""))).alias("text"), F.lit(1).alias("one"))
    bare = documents.select("doc_id", F.lit(None).cast(rows.schema["ordinal"].dataType).alias("ordinal"), F.lit(None).cast("string").alias("class"), F.lit("").alias("text"), F.lit(0).alias("one"))
    told = [f for f in profile.fields if f.source == "entities"]
    # numbers alone are held for a text, so this needs no sort
    held = rows.unionByName(bare).repartition("doc_id").groupBy("doc_id", "class", "text").agg(F.min("ordinal").alias("ordinal"), F.sum("one").alias("n"), F.max(F.col("one") == 0).alias("known"))

    def of(f: Field) -> Column:
        mine = F.coalesce(F.col("class").isin(*f.source_classes), F.lit(False)) & (F.col("text") != "")
        return mine & F.exists(F.array(*(F.lit(t) for t in f.contains_any)), lambda t: F.contains(F.lower("text"), t)) if f.mode == "contains" else mine

    def first(f: Field) -> Column:
        place = F.array_position(F.array(*(F.lit(c) for c in f.source_classes)), F.col("class"))
        return F.min(F.when(of(f), F.struct(place.alias("place"), "ordinal", "text")))

    spelt = held.groupBy("doc_id", F.lower("text").alias("_spelling")).agg(
        F.sum("n").alias("_count"), F.max("known").alias("_known"), F.collect_set(F.when(F.col("class") != "", F.col("class"))).alias("_classes"),
        *((first(f) if f.mode == "values" else F.sum(F.when(of(f), F.col("n")).otherwise(0))).alias(f"_{f.name}") for f in told),
    )
    shown = lambda f: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(f"_{f.name}")), 1, VALUES_SHOWN), lambda v: v["text"]), ", ")
    summed = spelt.groupBy("doc_id").agg(
        F.sum("_count").alias("_count"), F.max("_known").alias("_known"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_classes")))), ", ").alias("_classes"),
        *((shown(f) if f.mode == "values" else F.sum(f"_{f.name}")).alias(f"_{f.name}") for f in told),
    ).where("_known")

    def value(f: Field) -> Column:
        if f.source == "runtime":
            return {"enabled": F.lit(str(enabled).lower() if enabled else None), "extraction_count": F.col("_count").cast("string"), "entity_classes": F.col("_classes")}[f.runtime]
        if f.mode == "values":
            return F.col(f"_{f.name}")
        number = F.col(f"_{f.name}")
        return F.when(number > 0, number.cast("string")) if f.type == "boolean" else (number if f.mode == "count" else (number > 0)).cast("string")

    return summed.select("doc_id", *(coerce(value(f), f.type).alias(f.name) for f in profile.fields))


#: Paths that split the range of paths in a step of the search for a rank, and rows that are sorted to find one.
SPLITTERS, SORTED = 256, 4096


def at_ranks(rows: DataFrame, column: str, ranks: list[int]) -> dict[int, str]:
    """The values that a sort by a column of texts would put at some places, without the sort.

    A sketch (the values with the smallest hashes, which merges) splits the range; one pass
    counts the rows between its values, which says exactly where each rank lies. This goes
    on within the part that holds it until that is small enough to be sorted.
    """
    values, out = rows.select(F.col(column).alias("v")).where("v is not null"), {}
    open_ranks: list[tuple[int, int, str | None, str | None]] = [(r, r, None, None) for r in ranks]  # rank, place in the part, part above and up to
    while open_ranks:
        again = []
        for low, high in sorted({(x[2], x[3]) for x in open_ranks}, key=str):
            mine = [x for x in open_ranks if (x[2], x[3]) == (low, high)]
            part = values.where((F.lit(True) if low is None else F.col("v") > low) & (F.lit(True) if high is None else F.col("v") <= high))
            sketch = sorted(r.v for r in part.distinct().orderBy(F.xxhash64("v"), "v").limit(SPLITTERS).collect())
            if not sketch:
                continue
            # places above the splitters that are smaller: a part ends with its splitter
            counts = dict(part.groupBy(F.size(F.filter(F.array(*(F.lit(s) for s in sketch)), lambda s: s < F.col("v"))).alias("i")).agg(F.count("*").alias("n")).collect())
            for rank, place, _, _ in mine:
                before = 0
                for i in range(len(sketch) + 1):
                    n = counts.get(i, 0)
                    if place < before + n:
                        a, b = (sketch[i - 1] if i else low), (sketch[i] if i < len(sketch) else high)
                        if n <= SORTED or (a, b) == (low, high) or part.where((F.lit(True) if a is None else F.col("v") > a) & (F.lit(True) if b is None else F.col("v") <= b)).select("v").distinct().limit(2).count() == 1:
                            inner = part.where((F.lit(True) if a is None else F.col("v") > a) & (F.lit(True) if b is None else F.col("v") <= b))
                            out[rank] = inner.orderBy("v").offset(place - before).limit(1).first().v if n <= SORTED else inner.agg(F.min("v")).first()[0]
                        else:
                            again.append((rank, place - before, a, b))
                        break
                    before += n
        open_ranks = again
    return out


def discovery_sample(files: DataFrame, most: int = 3, chars: int = 2000) -> DataFrame:
    """Evenly spaced files by path, with the start of their text, for a model to look at."""
    n = files.count()
    step = max(1, n // max(1, min(most, n)))
    paths = sorted(set(at_ranks(files, "relative_path", [i * step for i in range(min(most, n))]).values()))
    return files.where(F.col("relative_path").isin(paths)).select("relative_path", F.substring("content", 1, chars).alias("sample"))


#: Fields of every profile that a model makes, and those of the profile that stands in for one.
RUNTIME = [{"name": "lx_enabled", "type": "boolean", "source": "runtime", "runtime": "enabled"}, {"name": "lx_extraction_count", "type": "integer", "source": "runtime", "runtime": "extraction_count"}, {"name": "lx_entity_classes", "type": "string", "source": "runtime", "runtime": "entity_classes"}]
USUAL_FIELDS = [
    {"name": "lx_organizations", "type": "string", "source_classes": ["organization", "company", "party"], "mode": "values"},
    {"name": "lx_people", "type": "string", "source_classes": ["person", "individual", "executive"], "mode": "values"},
    {"name": "lx_deal_terms", "type": "string", "source_classes": ["deal_term", "term", "provision"], "mode": "values"},
    {"name": "lx_money_mentions", "type": "integer", "source_classes": ["money", "amount", "currency"], "mode": "count"},
    {"name": "lx_date_mentions", "type": "integer", "source_classes": ["date"], "mode": "count"},
    {"name": "lx_has_earnout", "type": "boolean", "source_classes": ["deal_term", "term", "provision"], "mode": "contains", "contains_any": ["earnout"]},
    {"name": "lx_has_escrow", "type": "boolean", "source_classes": ["deal_term", "term", "provision"], "mode": "contains", "contains_any": ["escrow"]},
]


def usual_profile() -> Profile:
    return normalize_profile({"fields": [*RUNTIME, *USUAL_FIELDS]})


def auto_profile(files: DataFrame, model: Callable[[list[tuple[str, str]]], dict] | None = None, most: int = 3, chars: int = 2000) -> Profile:
    """A profile for a corpus from an injected model, which sees (name, start of text) of a few files.

    The usual profile where there is no model or no file with text, and where the model
    fails or gives what is no profile.
    """
    shown = [(r.relative_path.rpartition("/")[2], r.sample) for r in discovery_sample(files, most, chars).orderBy("relative_path").collect() if r.sample is not None]
    if model is None or not shown:
        return usual_profile()
    try:
        raw = dict(model(shown))
        have = {str(f.get("name")) for f in raw.get("fields", []) if isinstance(f, dict)}
        return normalize_profile({**raw, "fields": [*(f for f in RUNTIME if f["name"] not in have), *raw.get("fields", [])]})
    except Exception:  # noqa: BLE001  a model may fail in any way
        return usual_profile()


#: Fields that every discovered schema has.
BASE_FIELDS = {"filename": "string", "relative_path": "string", "extension": "string", "document_type": "string", "file_size": "integer", "file_mtime": "number", "mentions_currency": "boolean", "mentions_dates": "boolean"}


def schema_table(files: DataFrame, profile: Profile | None = None) -> DataFrame:
    """field, type, value: the base fields and the profile's, with a row for each document type observed."""
    spark = files.sparkSession
    rows = [(n, t, None) for n, t in BASE_FIELDS.items() if n != "document_type"]
    rows += [(f.name, f.type, None) for f in (profile.fields if profile else ()) if f.name not in BASE_FIELDS]
    types = files.select(document_type(F.col("relative_path")).alias("value")).distinct()
    # without files there is one type, 'other'
    observed = types.unionByName(types.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("other").alias("value")))
    return spark.createDataFrame(rows, "field string, type string, value string").unionByName(observed.select(F.lit("document_type").alias("field"), F.lit(BASE_FIELDS["document_type"]).alias("type"), "value"))


def discovered_schema(files: DataFrame, profile: Profile | None = None, most: int = 10_000) -> dict:
    """The base fields, with all document types observed, and the profile's; more than ``most`` types are refused: they are a table."""
    types = sorted(r[0] for r in schema_table(files).where("field = 'document_type'").select("value").limit(most + 1).collect())
    if len(types) > most:
        raise ValueError(f"more than {most} document types: take schema_table")
    fields = [{"name": n, "type": t} | ({"enum": types} if n == "document_type" else {}) for n, t in BASE_FIELDS.items()]
    return merged_schema({"fields": fields}, profile)[0] if profile else {"fields": fields}


def resolve_schema(discover: bool, named: dict | None, active: dict | None, automatic: bool, make: Callable[[], dict]) -> dict | None:
    """Discovery comes before a named schema, the active one, and an automatic one."""
    return make() if discover else named or active or (make() if automatic else None)


def extract_entities(documents: DataFrame, extract: Callable[[str], list[tuple[str, str]]], max_chars: int = USUAL_CHARS) -> DataFrame:
    """doc_id, ordinal, class, text from an injected extractor, over the start of each text."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, c, t) for i, text in zip(pdf.doc_id, pdf.content, strict=True) for n, (c, t) in enumerate(extract((text or "")[:max_chars]))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "class", "text"])

    return documents.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, ordinal int, class string, text string")


def embed_texts(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text", batch: int = 50) -> DataFrame:
    """rows with ``embedding`` from an injected model, which is asked for at most ``batch`` texts at once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            yield pdf.assign(embedding=[v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])])

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
