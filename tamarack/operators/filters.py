"""The filter language: text to conditions, conditions to predicates on JSON metadata.

``a = x and b >= 3, c in (p, q)``: conditions are joined by ``and`` or commas,
outside quotes and brackets. A literal is a quoted or bare string, true/false, a
whole or a decimal number; how a field is compared follows the literal's type.

Metadata is parsed once, when it is stored: ``shred`` gives a VARIANT column and, for
the fields that are asked for, typed columns beside it. A condition on such a field is
a comparison of a column, which a Parquet scan takes as a filter; others are read from
the JSON text.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: what a stored text must look like to be compared as a number.
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
OPERATORS = {"<=": "lte", ">=": "gte", "!=": "ne", "=": "eq", "<": "lt", ">": "gt", "~": "contains", ":": "eq"}
Value = str | bool | int | float


class FilterError(ValueError):
    """The filter text doesn't parse, or names an unknown field."""


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Value | tuple[Value, ...]


def split_conditions(text: str) -> list[str]:
    """The conditions' texts, cut at top-level commas and ``and``."""
    pieces, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif depth == 0 and c == ",":
            pieces.append(text[start:i])
            start = i + 1
        elif depth == 0 and c.isspace() and (m := re.match(r"\s+and(?=\s)", text[i:], re.I)):
            pieces.append(text[start:i])
            i += m.end()
            start = i
            continue
        i += 1
    pieces.append(text[start:])
    return [p.strip() for p in pieces if p.strip()]


def literal(text: str) -> Value:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    return text


def _items(text: str) -> tuple[Value, ...]:
    text = text.strip()
    if text[:1] in "([" and text[-1:] in ")]":
        text = text[1:-1]
    return tuple(literal(x) for x in split_conditions(text))


def parse_filters(text: str | None, allowed_fields: Collection[str] | None = None) -> list[Condition]:
    """Conditions of a filter text; all of them must hold."""
    out = []
    for part in split_conditions(text or ""):
        if m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", part, re.I | re.S):
            found = Condition(m[1], "in", _items(m[2]))
            if not found.value:
                raise FilterError(f"no values in {part!r}")
        elif m := re.fullmatch(r"([A-Za-z_]\w*)\s*(<=|>=|!=|=|<|>|~|:)\s*(.+)", part, re.S):
            found = Condition(m[1], OPERATORS[m[2]], literal(m[3]))
            if found.operator in ("gt", "gte", "lt", "lte") and (isinstance(found.value, (str, bool))):
                raise FilterError(f"{part!r} compares with what is no number")
        else:
            raise FilterError(f"not a condition: {part!r}")
        if allowed_fields is not None and found.field not in allowed_fields:
            raise FilterError(f"unknown field {found.field!r}; known: {', '.join(sorted(allowed_fields))}")
        out.append(found)
    return out


def text_column(field: str) -> str:
    return f"meta_{field}_text"


def lower_column(field: str) -> str:
    return f"meta_{field}_lower"


def number_column(field: str) -> str:
    return f"meta_{field}_number"


def shredded_names(fields: Collection[str]) -> list[str]:
    """The columns that ``shred`` adds."""
    return ["meta", *(name(f) for f in fields for name in (text_column, lower_column, number_column))]


def shred(documents: DataFrame, fields: Collection[str], metadata: str = "metadata_json") -> DataFrame:
    """documents with ``meta``, a VARIANT of the JSON text (null where it is none), and typed columns of fields.

    A field's text is empty where it is missing; its number is null where the text isn't one.
    """
    parsed = documents.drop(*shredded_names(fields)).withColumn("meta", F.try_parse_json(metadata))

    def text(field: str) -> Column:
        value = F.try_variant_get("meta", f"$.{field}", "variant")
        # fractions, exponents and nested values as text are those of the JSON functions, which conditions without typed columns compare
        as_written = F.get_json_object(metadata, f"$.{field}")
        return F.coalesce(F.when(F.schema_of_variant(value).isin("STRING", "BIGINT", "BOOLEAN"), F.try_variant_get("meta", f"$.{field}", "string")).otherwise(as_written), F.lit(""))

    made = parsed.withColumns({text_column(f): text(f) for f in fields})
    typed = {lower_column(f): F.lower(text_column(f)) for f in fields} | {number_column(f): F.when(F.col(text_column(f)).rlike(NUMBER), F.col(text_column(f)).try_cast("double")) for f in fields}
    return made.withColumns(typed)


def typed_predicate(condition: Condition) -> Column:
    """A condition on the typed columns of its field: comparisons that a scan can do."""
    text, low, number = (F.col(name(condition.field)) for name in (text_column, lower_column, number_column))
    value, op = condition.value, condition.operator
    if op == "contains":
        return F.contains(low, F.lit(str(value).lower()))
    values = value if isinstance(value, tuple) else (value,)
    kinds = {bool if isinstance(v, bool) else float if isinstance(v, (int, float)) else str for v in values}
    if kinds == {bool}:
        column, values = text, [str(v).lower() for v in values]
    elif kinds == {float}:
        column, values = number, [float(v) for v in values]
    else:
        column, values = low, [str(v).lower() for v in values]
    if op == "in":
        return column.isin(*values)
    return {"eq": column == values[0], "ne": column != values[0], "gt": column > values[0], "gte": column >= values[0], "lt": column < values[0], "lte": column <= values[0]}[op]


def predicate(condition: Condition, metadata: Column) -> Column:
    """A condition on a JSON text column. Missing fields are empty text, and no number."""
    text = F.get_json_object(metadata, f"$.{condition.field}")
    plain = F.lower(F.coalesce(text, F.lit("")))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    value, op = condition.value, condition.operator
    if op == "contains":
        return F.contains(plain, F.lit(str(value).lower()))
    if op == "in":
        values = value if isinstance(value, tuple) else (value,)
        if all(isinstance(v, bool) for v in values):
            return F.coalesce(text, F.lit("")).isin(*(str(v).lower() for v in values))
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            return F.coalesce(number.isin(*(float(v) for v in values)), F.lit(False))
        return plain.isin(*(str(v).lower() for v in values))
    if isinstance(value, bool):
        same = F.coalesce(text, F.lit("")) == str(value).lower()
        return same if op == "eq" else ~same
    if isinstance(value, (int, float)):
        test = {"eq": number == float(value), "ne": number != float(value), "gt": number > float(value), "gte": number >= float(value), "lt": number < float(value), "lte": number <= float(value)}[op]
        return F.coalesce(test, F.lit(False))
    return plain == value.lower() if op == "eq" else plain != value.lower()


def where(documents: DataFrame, conditions: list[Condition], metadata: str = "metadata_json") -> DataFrame:
    """Rows for which all conditions hold; by the typed columns of fields that have them."""
    have = set(documents.columns)
    parts = (typed_predicate(c) if {text_column(c.field), lower_column(c.field), number_column(c.field)} <= have else predicate(c, F.col(metadata)) for c in conditions)
    return documents.where(reduce(lambda a, b: a & b, parts, F.lit(True)))
