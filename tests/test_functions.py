"""Hand-computed cases of the scalar functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewright.functions import compat, dates, jsons, numbers, strings, validators


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def d(text):
    return F.lit(text).cast("date")


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("first,second,want", [
    ("2024-01-31", "2024-02-29", 0.935483871), ("2024-03-15", "2024-01-15", -2.0), ("2024-01-01", "2024-01-01", 0.0)])
def test_months_between(spark, first, second, want):
    assert value(spark, dates.months_between(d(first), d(second))) == pytest.approx(want, abs=1e-9)


def test_date_arithmetic(spark):
    assert value(spark, dates.days_between(d("2024-02-28"), d("2024-03-01"))) == 2
    assert value(spark, dates.diff_days(d("2024-02-28"), d("2024-03-01"))) == -2
    assert value(spark, dates.add_years(d("2024-02-29"), 1)) == dt.date(2025, 2, 28)
    assert value(spark, dates.add_months(d("2024-01-31"), 1)) == dt.date(2024, 2, 29)
    assert value(spark, dates.seconds_between(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:01.5"))) == 1.5
    assert value(spark, dates.extract("dow", d("2024-01-07"))) == 0
    assert value(spark, dates.age_months(ts("2024-03-30"), ts("2024-01-31"))) == 1


@pytest.mark.parametrize("unit,want", [
    ("days", 364), ("hours", 8759), ("minutes", 525599), ("seconds", 31535999), ("months", 11), ("years", 0), ("unknown", 364)])
def test_date_difference(spark, unit, want):
    assert value(spark, dates.date_difference(ts("2023-01-01 00:00:00"), ts("2023-12-31 23:59:59"), F.lit(unit))) == want


def test_date_difference_truncates_toward_zero(spark):
    assert value(spark, dates.date_difference(ts("2024-01-02 12:00:00"), ts("2024-01-01 00:00:00"), F.lit("days"))) == -1


@pytest.mark.parametrize("text,want", [
    ("2024-05-06 07:08:09", dt.datetime(2024, 5, 6, 7, 8, 9)), ("2024-05-06", dt.datetime(2024, 5, 6)),
    ("06.05.2024 07:08:09", dt.datetime(2024, 5, 6, 7, 8, 9)), ("06.05.2024", dt.datetime(2024, 5, 6)), ("nonsense", None)])
def test_parse_timestamp(spark, text, want):
    assert value(spark, dates.parse_timestamp(F.lit(text))) == want


@pytest.mark.parametrize("a,b,div,mod", [(-7, 2, -4, 1), (7, -3, -3, -2), (7, 3, 2, 1), (-6, 3, -2, 0), (5, 0, None, None)])
def test_floor_division(spark, a, b, div, mod):
    assert value(spark, numbers.floor_div(F.lit(a), F.lit(b))) == div
    assert value(spark, numbers.floor_mod(F.lit(a), F.lit(b))) == mod


def test_rounding(spark):
    assert value(spark, numbers.round_half_away(F.lit(155), -1)) == 160
    assert value(spark, numbers.round_half_away(F.lit(Decimal("-2.5")), 0)) == Decimal("-3")
    assert value(spark, numbers.truncate(F.lit(-2.7))) == -2.0
    assert value(spark, numbers.safe_sqrt(F.lit(-1.0))) is None


@pytest.mark.parametrize("text,part,start,nth,want", [
    ("abababa", "aba", 1, 2, 3), ("abababa", "aba", 2, 1, 3), ("abc", "x", 1, 1, 0), ("abc", "a", 0, 1, 0),
    ("", "a", 1, 1, 0), ("abc", "a", 9, 1, 0)])
def test_instr(spark, text, part, start, nth, want):
    assert value(spark, strings.instr(F.lit(text), F.lit(part), start, nth)) == want


@pytest.mark.parametrize("style,want", [
    ("title", "Hello World"), ("snake", "hello_world"), ("camel", "helloWorld"), ("pascal", "HelloWorld"),
    ("upper", "HELLO WORLD"), ("none", "hello world")])
def test_format_case(spark, style, want):
    assert value(spark, strings.format_case(F.lit("hello world"), style)) == want


def test_title_keeps_apostrophes_and_digits(spark):
    assert value(spark, strings.format_case(F.lit("3abc o'NEIL, x_Y9z"), "capitalize")) == "3Abc O'neil, X_y9z"


def test_text_analysis(spark):
    df = spark.createDataFrame([(1, "The cat. The DOG! a cat"), (2, "  ...  "), (3, None), (4, "éa éa b")], "id int, text string")
    got = {r.id: r for r in strings.text_analysis(df, "id", "text").collect()}
    assert got[1].word_count == 6 and got[1].avg_word_length == 2.67 and got[1].char_count == 23
    assert got[1].top_words == "the:2,cat:2,dog:1,a:1"
    assert got[2].word_count == 0 and got[2].top_words is None and got[2].avg_word_length == 0.0
    assert got[3].word_count is None
    assert got[4].top_words == "éa:2,b:1"


def test_trigrams(spark):
    assert value(spark, strings.trigram_similarity(F.lit("word"), F.lit("word"))) == 1.0
    assert value(spark, strings.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert value(spark, strings.trigram_similarity(F.lit(""), F.lit(""))) == 0.0


def test_decode(spark):
    null = F.lit(None).cast("int")
    assert value(spark, compat.decode(null, [(None, "n"), (1, "a")], "z")) == "n"
    assert value(spark, compat.decode(F.lit(2), [(1, "a")], "z")) == "z"
    assert value(spark, compat.decode(F.lit(2), [(1, "a")])) is None


def test_ratio_to_report(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 0.0), ("b", 0.0)], "g string, v double")
    got = sorted(r.x for r in df.select(compat.ratio_to_report(F.col("v"), Window.partitionBy("g")).alias("x")).collect())
    assert got == [0.0, 0.0, 0.1, 0.2, 0.3, 0.4]


def test_catalog(spark):
    rows = compat.function_catalog(spark).collect()
    assert len(rows) == 19 and [r.category for r in rows] == sorted(r.category for r in rows)


def test_to_number(spark):
    assert value(spark, strings.to_number(F.lit("abc"))) is None
    assert value(spark, strings.to_number(F.lit("12.5"))) == 12.5
    assert value(spark, strings.to_number(F.lit("1,234.50"), "9,999.99")) == 1234.5


@pytest.mark.parametrize("doc,path,want", [
    ('{"items":[{"a":1}]}', "items[0].a", "1"), ('{"items":[{"a":1}]}', "items[3].a", None), ('{"a":1}', "b", None),
    ("not json", "a", None), ('{"a":{"b":[1,2]}}', "a.b", "[1,2]")])
def test_json_path(spark, doc, path, want):
    assert value(spark, jsons.extract_path(F.lit(doc), path)) == want


def test_json_schema(spark):
    doc = F.lit('{"a": 1, "b": "x", "c": true}')
    assert value(spark, jsons.matches_schema(doc, {"a": "integer", "b": "string", "c": "boolean"}))
    assert not value(spark, jsons.matches_schema(doc, {"b": "integer"}))
    assert not value(spark, jsons.matches_schema(doc, {"missing": "string"}))
    assert not value(spark, jsons.matches_schema(F.lit("{bad"), {"a": "integer"}))
    assert not value(spark, jsons.matches_schema(F.lit('{"a": 5}'), {"a": "string"}))
    assert not value(spark, jsons.matches_schema(F.lit('{"a": "5"}'), {"a": "integer"}))
    assert value(spark, jsons.matches_schema(F.lit('{"a": 1.5, "b": {"x": 1}, "c": [1]}'), {"a": "number", "b": "object", "c": "array"}))
    assert value(spark, jsons.merge(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}'))) == '{"a":"1","b":"3"}'
    assert value(spark, jsons.merge(F.lit('{"k":5,"o":{"x":[1,null]}}'), F.lit('{"u":true,"k":2.5}'))) == '{"o":{"x":[1,null]},"u":true,"k":2.5}'


def test_whole_numbers_divide_exactly(spark):
    large = F.lit(9007199254740993)
    assert value(spark, numbers.floor_div(large, F.lit(1), whole=True)) == 9007199254740993
    assert value(spark, numbers.floor_mod(large, F.lit(1))) == 0
    for a, b in ((7, 2), (-7, 2), (7, -2), (-7, -2), (6, 3), (-6, 3), (0, 5)):
        assert value(spark, numbers.floor_div(F.lit(a), F.lit(b), whole=True)) == a // b
        assert value(spark, numbers.floor_mod(F.lit(a), F.lit(b))) == a % b
    assert value(spark, numbers.floor_div(F.lit(1), F.lit(0), whole=True)) is None and value(spark, numbers.floor_mod(F.lit(1), F.lit(0))) is None


def test_time_buckets_keep_rows_without_a_time(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01 07:59:59.5'), (timestamp_ntz'1969-12-31 23:00:00'), (NULL) AS t(ts)")
    got = [r.b for r in df.select(dates.time_bucket("6 hours", F.col("ts")).alias("b")).collect()]
    assert [str(b) for b in got] == ["2024-01-01 06:00:00", "1969-12-31 18:00:00", "None"]


def test_format_letters(spark):
    when = F.lit("2024-03-05 06:07:08").cast("timestamp")
    for fmt, want in (("DD Mon YYYY", "05 Mar 2024"), ("DDD", "065"), ("YY/MM", "24/03"), ("'y'YYYY'm'MM", "y2024m03"), ('HH24"h"MI', "06h07"),
                      ("Day, DD Month", "Tuesday, 05 March"), ("HH12:MI AM", "06:07 AM")):
        assert value(spark, dates.format_date(when, fmt)) == want
    for fmt in ("DD MON YYYY", "YYYY-XX"):
        with pytest.raises(ValueError):
            dates.spark_format(fmt)


@pytest.mark.parametrize("rule,good,bad", [
    ("email", ["user@example.com", "test.email+tag@domain.co.uk", "first.last@company-name.com"],
     ["invalid.email", "@domain.com", "user@", "user@domain", "user..double@domain.com", None]),
    ("ipv4", ["192.168.1.1", "0.0.0.0", "255.255.255.255"], ["256.1.1.1", "192.168.1", "192.168.01.1", "not.an.ip"]),
    ("port", ["1", "80", "65535"], ["0", "65536", "abc", "99999999999999999999"]),
    ("domain", ["example.com", "a-b.co"], ["-bad.com", "bad-.com", "a." + "b" * 260]),
    ("url", ["https://example.com/x", "http://a.io:8080"], ["ftp://x.com", "http://"]),
    ("memory", ["512M", "2GB"], ["512", "2T"]), ("username", ["abc", "a_b-9"], ["ab", "a b"]),
    ("password", ["Abcdef12"], ["abcdef12", "ABCDEF12", "Abcdefgh", "Ab1"]),
    ("json", ['{"a":1}', "[]"], ["{a", ""]), ("semver", ["1.2.3", "1.0.0-rc.1+b"], ["1.2", "v1.2.3"]),
    ("env_name", ["A_B9"], ["a", "9A"]),
    ("connection", ["postgresql://u:p@h:5432/db"], ["postgresql://h/db"])])
def test_rules(spark, rule, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, ok boolean")
    wrong = df.where(validators.rule(rule, F.col("v")) != F.col("ok")).collect()
    assert not wrong
    facts = validators.validate_columns(df, {"v": rule}).first()
    assert (facts.checked, facts.violations) == (len(good) + len(bad), len(bad))


@pytest.mark.parametrize("name", ["bad-schema-name!", 'table"with"quotes', None, "", "x" * 67, "a;b", "a\n"])
def test_identifier_rejected(name):
    with pytest.raises(ValueError):
        validators.identifier(name)


def test_identifier_accepted():
    assert validators.identifier("valid_table") == "valid_table"
    assert validators.column_definitions("id  bigint,\n name varchar(10)") == "id bigint, name varchar(10)"
    for text in ("id int; drop table x", "id int, x exec", "a--b", None):
        with pytest.raises(ValueError):
            validators.column_definitions(text)
