import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlens.fixed_values import TIME_BUCKETS, WEEKDAYS
from reachlens.functions import dates, files, numbers, text


# --- numbers -----------------------------------------------------------------------


def _samples(n=4000):
    rng = random.Random(7)
    ties = [0.005, 1.005, 1.115, 2.675, 0.125, 0.375, 0.285, 1.015, 4.35, 10.235, -1.115, -0.125, 0.0]
    return ties + [rng.randint(1, 400) / rng.choice([8, 16, 200, 1000, 2000, 7]) for _ in range(n)]


def test_round2_equals_array_rounding(values):
    xs = _samples()
    assert values(xs, "double", lambda X: numbers.round2(X)) == list(np.round(xs, 2))


def test_round2_exact_equals_scalar_rounding(values):
    xs = _samples()
    assert values(xs, "double", numbers.round2_exact_sql("x")) == [round(x, 2) for x in xs]


def test_display_formats_equal_python(values):
    rng = random.Random(3)
    xs = _samples(1000) + [(0.1 + rng.random()) * 10 ** rng.randint(-3, 9) for _ in range(1000)]
    assert values(xs, "double", text.two_decimals_sql("x")) == [f"{x:,.2f}".replace("-0.00", "-0.00") for x in xs]
    assert values(xs, "double", text.plain_number_sql("x")) == [f"{x:,}" for x in xs]
    rnd = random.Random(1)
    wide = [rnd.uniform(-10, 10) * 10.0 ** e for e in range(-12, 21) for _ in range(4)]
    wide += [10.0 ** e for e in range(-12, 21)] + [5e-05, 0.0001, 9999999999999998.0, 1e100, 1e-300, float("inf"), -float("inf"), float("nan")]
    assert values(wide, "double", text.plain_number_sql("x")) == [f"{x:,}" for x in wide]
    assert values([0.0, 1234.5], "double", text.two_decimals_sql("x", grouped=False)) == ["0.00", "1234.50"]
    assert values([5, 1234567, -1234], "bigint", text.thousands_sql("x")) == ["5", "1,234,567", "-1,234"]
    assert values([12.5, -3.0, 0.0, None], "double", text.signed_percent_sql("x")) == ["+12.50%", "-3.00%", "+0.00%", None]
    for sql in (text.two_decimals_sql("x"), text.plain_number_sql("x"), text.thousands_sql("x"), text.currency_sql("x")):
        assert values([None], "double", sql) == [None]
    assert values([1234.5, float("inf")], "double", text.currency_sql("x")) == ["$1,234.50", "$inf"]
    assert values([1.0, 0.0, -2.0, None], "double", text.sign_class_sql("x")) == ["positive", "negative", "negative", None]


def test_pct_diff(spark):
    rows = [(None, 1.0), (1.0, None), (5.0, 5.0), (0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (1.0, 3.0), (20001.0, 20000.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c double, p double")
    out = [r.d for r in sorted(frame.selectExpr("i", f"{numbers.pct_diff_sql('c', 'p')} AS d").collect())]
    assert out == [None, None, 0.0, 0.0, None, 50.0, -66.67, round((20001 - 20000) / 20000 * 100, 2)]


def test_pct_diff_sign_flips_when_sides_swap(spark):
    rng = random.Random(11)
    rows = [(rng.randint(1, 10**6), rng.randint(1, 10**6)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint").selectExpr(
        f"{numbers.pct_diff_sql('a', 'b')} AS f", f"{numbers.pct_diff_sql('b', 'a')} AS g")
    assert all(r.f * r.g <= 0 for r in frame.collect())


def test_ratios_and_means(spark):
    frame = spark.createDataFrame([(1, 4, 0), (1, 2, 8), (2, None, 3)], "g int, a bigint, b bigint")
    ratio = [r.r for r in frame.selectExpr(f"{numbers.safe_ratio_sql('a', 'b')} AS r").collect()]
    assert ratio == [0.0, 0.25, None]
    means = {r.g: r.m for r in frame.groupBy("g").agg(numbers.mean_of("a").alias("m")).collect()}
    assert means == {1: 3.0, 2: None}
    rate = [r.r for r in frame.select(numbers.like_rate(F.col("a"), F.col("b")).alias("r")).collect()]
    assert rate == [float("inf"), 25.0, None]
    edge = spark.createDataFrame([(0, 0), (None, 0), (3, None), (-1, 0), (1, 3)], "a bigint, b bigint")
    got = [r.r for r in edge.select(numbers.float_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [None, None, None, float("-inf"), 1 / 3]


def test_to_number_and_money(values):
    assert values(["1.5", "x", None, "7"], "string", lambda X: numbers.to_number(X)) == [1.5, None, None, 7.0]
    assert [str(v) for v in values([1.005, 2.5], "double", lambda X: numbers.money(X))] == ["1.005000000", "2.500000000"]


# --- dates --------------------------------------------------------------------------


def test_time_buckets_cover_every_hour(values):
    times = [dt.datetime(2024, 1, 1, h, 59, 59, 999999) for h in range(24)]
    got = values(times, "timestamp_ntz", lambda _: dates.time_bucket("x"))
    expected = ["12 AM"] + ["1-8 AM"] * 8 + ["9 AM", "10 AM", "11 AM", "12 PM"] + [f"{h} PM" for h in range(1, 12)]
    assert got == expected and set(got) == set(TIME_BUCKETS)
    assert values([None], "timestamp_ntz", lambda _: dates.time_bucket("x")) == [None]


def test_weekdays(values):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(i) for i in range(7)]
    assert values(days, "timestamp_ntz", lambda X: dates.weekday_name(X)) == list(WEEKDAYS)


def test_parse_time_gives_null_for_other_formats(values):
    got = values(["2024-01-02T03:04:05", "2024-01-02", "x", None], "string", lambda X: dates.parse_time(X))
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), None, None, None]


def test_yesterday_in_zone_follows_summer_time(values):
    moments = [dt.datetime(2024, 1, 2, 7, 59), dt.datetime(2024, 1, 2, 8), dt.datetime(2024, 7, 2, 6, 59), dt.datetime(2024, 7, 2, 7)]
    got = values(moments, "timestamp_ntz", lambda X: dates.yesterday_in_zone(X))
    assert got == [dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 6, 30), dt.date(2024, 7, 1)]


def test_local_day():
    assert dates.local_day("2024-01-02 07:59:00") == dt.date(2024, 1, 1)
    assert dates.local_day("2024-07-02 07:00:00") == dt.date(2024, 7, 2)
    assert dates.local_day("2024-01-02 20:00:00", "Asia/Tokyo") == dt.date(2024, 1, 3)


def test_as_of_forms(spark):
    day = dt.date(2024, 3, 15)
    assert dates.to_day("2024-03-15 10:30:00") == dates.to_day(day) == dates.to_day(dt.datetime(2024, 3, 15, 23)) == day
    assert dates.to_moment(day) == dt.datetime(2024, 3, 15)
    with pytest.raises(ValueError):
        dates.to_moment(dt.datetime(2024, 3, 15, tzinfo=dt.timezone.utc))
    row = spark.range(1).select(
        dates.month_start(day).alias("m"), dates.days_before(day, 30).alias("b"), dates.days_after(day, 3).alias("a")
    ).first()
    assert (row.m, row.b, row.a) == (dt.date(2024, 3, 1), dt.date(2024, 2, 14), dt.date(2024, 3, 18))


# --- text --------------------------------------------------------------------------------


def test_bullets(values):
    texts = ["• one\n• two • three", "only", " • \t• ", "", None, "a•  b\t\n"]
    assert values(texts, "string", lambda X: text.piece_at(text.bullets(X), 0)) == ["one", "only", "", "", "", "a"]
    assert values(texts, "string", lambda X: text.piece_at(text.bullets(X), 1)) == ["two", "", "", "", "", "b"]


def test_strip_space_equals_python(values):
    texts = [c + "x y" + c for c in map(chr, range(1, 0x3001)) if c.isspace()] + ["\u200bx", "", " \u3000 "]
    assert len(texts) > 25
    assert values(texts, "string", lambda X: text.strip_space(X)) == [v.strip() for v in texts]


def test_contains_and_filled(values):
    names = ["Post 1", "repost", "x", None]
    assert values(names, "string", lambda X: text.contains_ignoring_case(X, "Post")) == [True, True, False, False]
    assert values(["a", " \n\t", "", None], "string", lambda X: text.is_filled(X)) == [True, False, False, False]


def test_list_text(values):
    lists = [["a", "b c"], ["é\"q\"", "1"], [], ["x"]]
    got = values(lists, "array<string>", lambda X: text.list_to_json(X))
    assert got == [json.dumps(v, ensure_ascii=False) for v in lists]
    assert values([["a", "b"]], "array<string>", lambda X: text.join_list(X)) == ["a,b"]
    assert values(["a, b"], "string", lambda X: text.split_list(X)) == [["a", " b"]]


def test_labels_and_templates(values):
    assert values(["like_count", "reach"], "string", lambda X: text.title_label(X)) == ["Like Count", "Reach"]
    assert values(["v", None], "string", lambda X: text.fill("<{a}> {a}!", a=X)) == ["<v> v!", None]


def test_terms_take_any_script_and_keep_inner_apostrophes(values):
    got = values(["Don't 'STOP' été_1 日本 x--y", None], "string", lambda X: text.terms(X))
    assert got == [["don't", "stop'", "été_1", "日本", "x", "y"], []]


def test_json_object_text_is_greedy_across_lines(values):
    got = values(["a {x\n{y} z} b", "  none ", "{}"], "string", lambda X: text.json_object_text(X))
    assert got == ["{x\n{y} z}", "none", "{}"]


# --- files -------------------------------------------------------------------------------


def test_file_names(values):
    names = ["p1.mp4", "a.b.mov", "nodot", ".hidden"]
    assert values(names, "string", lambda X: files.stem_or_name(X)) == ["p1", "a.b", "nodot", ""]
    assert values(names, "string", lambda X: files.stem_or_empty(X)) == ["p1", "a.b", "", ""]
    assert values(names, "string", lambda X: files.extension(X)) == [n.split(".")[-1] for n in names]
    assert values(["video/mp4", "image", None], "string", lambda X: files.major_type(X)) == ["video", "image", None]
    assert values(["p.mp4"], "string", lambda X: files.public_url("b", X)) == ["https://storage.googleapis.com/b/p.mp4"]
    assert values(["a.b.mov"], "string", lambda X: files.renamed(F.lit("id"), X)) == ["id.mov"]
