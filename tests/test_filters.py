from decimal import Decimal

import pytest
from hypothesis import given, strategies as st

from tamarack.operators.filters import Condition, FilterError, literal, parse_filters, predicate, shred, split_conditions, where


def test_grammar():
    found = parse_filters("document_type = agreement and mentions_currency=true, page_count >= 3 AND field in (a, 'b c', 2)")
    assert found == [Condition("document_type", "eq", "agreement"), Condition("mentions_currency", "eq", True), Condition("page_count", "gte", 3), Condition("field", "in", ("a", "b c", 2))]
    assert parse_filters("a:b")[0].operator == "eq" and parse_filters("a ~ x y")[0].value == "x y"
    assert parse_filters("t = 'this and that'")[0].value == "this and that"
    assert parse_filters(None) == parse_filters(" , ") == []


@pytest.mark.parametrize("bad", ["nope", "a > text", "a >= true", "= 3", "a in ()"])
def test_errors(bad):
    with pytest.raises(FilterError):
        parse_filters(bad)


def test_unknown_field_names_the_known():
    with pytest.raises(FilterError, match="a, b"):
        parse_filters("c = 1", ["b", "a"])


@given(st.lists(st.text(st.characters(codec="ascii", exclude_characters="\"',()[]"), min_size=1).filter(lambda s: " and " not in f" {s.lower()} " and s.strip() and not any(c.isspace() for c in s)), min_size=1, max_size=5))
def test_split_gives_the_parts_back(parts):
    assert split_conditions(", ".join(parts)) == parts
    assert split_conditions(" and ".join(parts)) == parts


def test_literals():
    assert [literal(x) for x in ("1", "-2", "1.5", "1.", "true", "False", "'1'", '"true"', "a b")] == [1, -2, 1.5, "1.", True, False, "1", "true", "a b"]


@pytest.mark.parametrize(("text", "want"), [
    ("n = 1", [1]), ("n != 1", [2, 5]), ("n > 1", [2, 5]), ("s = ABC", [1]), ("s != abc", [2, 3, 4, 5]), ("b = true", [3]), ("b != true", [1, 2, 4, 5]), ("s ~ '%'", [2]), ("n in (1, 2)", [1, 2]), ("b in (true, false)", [3, 4]), ("s = ''", [3, 4, 5]), ("n in (1, x)", [1]),
])
def test_predicates_follow_the_literal(spark, text, want):
    rows = [(1, '{"n": 1, "s": "aBc"}'), (2, '{"n": 2, "s": "50%"}'), (3, '{"n": "1e3", "b": true}'), (4, '{"b": false}'), (5, '{"n": 1.5}')]
    df = spark.createDataFrame(rows, "id int, m string")
    cond = parse_filters(text)[0]
    assert sorted(r[0] for r in df.where(predicate(cond, df.m)).select("id").collect()) == want


ODD = ['{"n": 1, "s": "aBc"}', '{"n": 2, "s": "50%"}', '{"n": "1e3", "b": true}', '{"b": false}', '{"n": 1.50}', '{"n": 12345678901234567890}', '{"n": null, "s": {"a": [1, 2]}}', '{"n": -3, "s": ["x"]}', "no json", "[1]", "", None, '{"n": "1.50", "s": "É"}', '{"n": 1e2}', '{"b": "True"}']


@pytest.mark.parametrize("text", ["n = 1", "n != 1", "n > 1", "n <= 1.5", "s = ABC", "s != abc", "b = true", "b != true", "s ~ '%'", "s ~ 'a'", "n in (1, 2)", "b in (true, false)", "s = ''", "n in (1, x)", "n = '1.50'", "s = é", "n ~ 123456789", "n = 100", "other = 1", "n > 0 and b != true"])
def test_typed_columns_say_what_the_json_says(spark, tmp_path, text):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, metadata_json string")
    typed = shred(df, ["n", "s", "b"])
    for conditions in (parse_filters(text),):
        plain, fast = (sorted(r[0] for r in where(d, conditions).select("id").collect()) for d in (df, typed))
        assert plain == fast


def test_filters_reach_the_scan(spark, tmp_path):
    shred(spark.createDataFrame(list(enumerate(ODD)), "id int, metadata_json string"), ["n", "s", "b"]).write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    pushed = lambda text: next(x for x in where(stored, parse_filters(text)).select("id")._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1:]).split("]")[0]
    assert "EqualTo(meta_s_lower,abc)" in pushed("s = ABC") and "GreaterThan(meta_n_number,1.0)" in pushed("n > 1")
    assert "StringContains(meta_s_lower,a)" in pushed("s ~ A") and "In(meta_n_number" in pushed("n in (1, 2)") and "EqualTo(meta_b_text,true)" in pushed("b = true")
    both = where(stored, parse_filters("n >= 1 and s != x")).select("id")._jdf.queryExecution().executedPlan().toString()
    read = both.split("ReadSchema: ")[1]
    assert "meta_n_number" in read and "metadata_json" not in read and "meta:variant" not in read


def test_the_variant_is_made_once(spark):
    row = shred(spark.createDataFrame([('{"n": 1.50, "s": {"a": 1}}',)], "metadata_json string"), ["n", "s"]).first()
    assert row["meta_n_text"] == "1.5" and row["meta_n_number"] == 1.5 and row["meta_s_text"] == '{"a":1}' and row["meta"].toPython() == {"n": Decimal("1.5"), "s": {"a": 1}}
