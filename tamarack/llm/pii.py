"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a Spark expression. Positions come from the pieces between the
matches: the text is split by the pattern, and lengths of pieces and matches are
summed, in code points. Sums are taken over blocks of 256 matches, so that a text
with very many matches is not summed from its start for each.

Kinds ``email ip card phone`` are the base; a span of them stands if its checks
hold. Kinds ``iban ssn`` are added and stand if their score reaches a threshold:
a pattern has 0.4, a checksum (mod-97 for iban) adds 0.4, a context word within 48
characters adds 0.3, a structural rule adds 0.1.

Defined cases: a null text is an empty one and has no spans; an empty table gives
no rows; equal rows give equal results, one for each; null ids stay null; columns
of any other name are carried along by ``find_spans``, except ``spans``, which is
replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: The patterns of the base kinds, as the contract has them, and of the added kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}",
    "ssn": r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]",
}
#: The same matches, told so that no start is tried twice and no repeat recurses: a match can only
#: begin at the start of its run or where the match before has ended (\G), and what nothing follows is possessive.
_FAST = PATTERNS | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
}
#: What a text must have before a pattern is tried.
_HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9][0-9]-[0-9]"),
}
#: Words that speak for a kind when they stand near.
CONTEXT = {
    "email": r"(?i)mail|contact|@",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|credit|payment",
    "phone": r"(?i)phone|tel|call|mobile",
    "iban": r"(?i)iban|bank|account|konto",
    "ssn": r"(?i)ssn|social security|taxpayer",
}
THRESHOLD = 0.6
NEAR = 48
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column, start: Column, count: Column) -> Column:
    return F.aggregate(F.slice(values, start, count), F.lit(0), lambda a, x: a + x)


def _matches(text: Column, kind: str) -> Column:
    """array<struct<start, txt>> of the pattern's matches, leftmost and not overlapping; starts count from 0."""
    pattern = _FAST[kind]

    def placed(m: Column) -> Column:
        def starts(advance: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / _BLOCK).cast("int")), lambda b: _total(advance, F.lit(1), b * _BLOCK))
            return let(blocks, lambda base: F.transform(m, lambda x, i: F.struct((F.element_at(base, (F.floor(i / _BLOCK) + 1).cast("int")) + _total(advance, (i - i % _BLOCK + 1).cast("int"), i % _BLOCK + 1) - F.length(x)).alias("start"), x.alias("txt"))))

        gaps = F.split(text, pattern, -1)
        return let(gaps, lambda g: let(F.transform(m, lambda x, i: F.length(x) + F.length(F.element_at(g, i + 1))), starts))

    empty = F.array().cast("array<struct<start:int,txt:string>>")
    return F.when(_HINTS[kind](text), let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))).otherwise(empty)


def _digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + doubled

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod97(txt: Column) -> Column:
    """The check of ISO 7064 on the account number with its head moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(txt, 5, 100), F.substring(txt, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, txt: Column) -> Column:
    """Whether the checks of the kind hold for a match."""
    if kind == "ip":
        return F.forall(F.split(txt, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return let(_digits(txt), lambda d: F.length(d).between(12, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(txt)).between(9, 15)
    if kind == "iban":
        return _mod97(txt)
    if kind == "ssn":
        return ~txt.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


#: What a kind's checks add to the score of its pattern.
CHECKED = {"card": 0.4, "iban": 0.4, "ssn": 0.1, "ip": 0.1, "phone": 0.1, "email": 0.1}


def _scored(kind: str, text: Column) -> Column:
    """array<struct<start, order, kind, end, txt, score>> of the spans that stand."""
    checked = CHECKED[kind]

    def span(x: Column) -> Column:
        near = F.concat(F.substring(text, F.greatest(x["start"] - NEAR, F.lit(0)) + 1, F.least(x["start"], F.lit(NEAR))), F.lit("\n"), F.substring(text, x["start"] + F.length(x["txt"]) + 1, F.lit(NEAR)))
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("order"),
            F.lit(kind).alias("kind"),
            (x["start"] + F.length(x["txt"])).alias("end"),
            x["txt"].alias("txt"),
            F.round(F.lit(0.4 + checked) + F.when(near.rlike(CONTEXT[kind]), 0.3).otherwise(0.0), 2).alias("score"),
        )

    spans = F.transform(F.filter(_matches(text, kind), lambda x: _confirmed(kind, x["txt"])), span)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def find_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with ``spans``: array of struct(start, order, kind, end, txt, score), by start and then kind."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in df.columns if c != "spans"]
    return df.select(*rest, F.array_sort(F.concat(*(_scored(kind, text) for kind in KINDS))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The spans' scores in hundredths, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in brackets; spans that overlap are replaced as one."""
    found = find_spans(df, text_col)
    text = F.col(f"`{text_col}`")
    first = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["end"]
        return F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            F.when(fresh, F.concat(acc["out"], F.substring(text, acc["end"] + 1, s["start"] - acc["end"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"),
        )

    masked = F.when(F.size("spans") > 0, F.aggregate("spans", first, step, lambda a: F.concat(a["out"], F.substring(text, a["end"] + 1, F.length(text))))).otherwise(text)
    return found.select(*((masked.alias(text_col) if c == text_col else F.col(f"`{c}`")) for c in df.columns))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    found = find_spans(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores(F.col("spans")).alias("scores"))


def op6_sql() -> str:
    """The same in DuckDB's SQL."""
    def matches(kind: str) -> str:
        pat = PATTERNS[kind].replace(r"\x20", " ")
        return f"""list_transform(range(1, len(regexp_extract_all(t, '{pat}')) + 1), lambda i: {{
            'txt': regexp_extract_all(t, '{pat}')[i],
            'start': list_sum(list_transform((string_split_regex(t, '{pat}'))[1:i], lambda g: length(g)))::BIGINT
                   + coalesce(list_sum(list_transform((regexp_extract_all(t, '{pat}'))[1:i-1], lambda m: length(m))), 0)::BIGINT}})"""

    def luhn(d: str) -> str:
        return f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN {d}[length({d}) - i]::INT > 4 THEN {d}[length({d}) - i]::INT * 2 - 9 ELSE {d}[length({d}) - i]::INT * 2 END) ELSE {d}[length({d}) - i]::INT END)) % 10 = 0"

    digits = "regexp_replace(x.txt, '[^0-9]', '', 'g')"
    moved = "(x.txt[5:] || x.txt[1:4])"
    tests = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(x.txt, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT) <= 255, false)))",
        "card": f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn(digits)} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({moved}) + 1), lambda i: (CASE WHEN ascii({moved}[i]) >= 65 THEN 1000 + ascii({moved}[i]) - 55 ELSE ascii({moved}[i]) - 48 END)::BIGINT)), lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1",
        "ssn": "NOT regexp_matches(x.txt, '^(000|666|9..)|-00-|-0000$')",
    }

    def spans(kind: str) -> str:
        near = f"(CASE WHEN x.start > {NEAR} THEN t[x.start - {NEAR} + 1 : x.start] ELSE t[1 : x.start] END || chr(10) || t[x.start + length(x.txt) + 1 : x.start + length(x.txt) + {NEAR}])"
        said = f"regexp_matches({near}, '{CONTEXT[kind]}')"
        context = f" AND {said}" if kind == "ssn" else ""
        score = f"{round(100 * (0.4 + CHECKED[kind]))} + CASE WHEN {said} THEN 30 ELSE 0 END"
        return f"list_transform(list_filter({matches(kind)}, lambda x: ({tests[kind]}){context}), lambda x: {{'start': x.start, 'o': {KINDS.index(kind)}, 'kind': '{kind}', 'stop': x.start + length(x.txt), 'score': {score}}})"

    columns = ", ".join(f"{spans(k)} AS s{i}" for i, k in enumerate(KINDS))
    join = "array_to_string(list_transform(list_sort({}), lambda s: s.kind || ':' || s.start || ':' || s.stop), ',')"
    base = join.format(" || ".join(f"s{i}" for i in range(len(BASE))))
    every = join.format(" || ".join(f"s{i}" for i in range(len(KINDS))))
    scores_of = f"array_to_string(list_transform(list_sort({' || '.join(f's{i}' for i in range(len(KINDS)))}), lambda s: s.score), ',')"
    counts = ", ".join(f"len(s{i})::BIGINT AS n_{k}" for i, k in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, {columns} FROM d)
SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {every} AS spans, {scores_of} AS scores FROM s"""
