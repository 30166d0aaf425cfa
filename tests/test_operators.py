"""Operators against brute force in pandas or numpy."""

import datetime as dt
import math
import random
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from growthgrain.functions.aggregates import pearson, sum_or_zero
from growthgrain.functions.columns import (
    cohort_week,
    joined_label,
    lifecycle_week,
    money,
    month_start,
    safe_ratio,
    thousands,
    usd,
    utc_day,
)
from growthgrain.functions.daybits import bit_of, days_between, first_day, stretch_of
from growthgrain.operators.dedup import first_row_by
from growthgrain.operators.hot import hot_keys, join_spread, n_keys
from growthgrain.operators.keys import (
    assert_unique,
    key_violations,
    null_safe_left,
    one_row_per,
    profile_id_of,
    with_key,
)
from growthgrain.operators import ordered
from growthgrain.operators.ordered import largest_first, quantiles, ranked, running_sum, top_rows
from growthgrain.operators.regression import ols_fit_predict
from growthgrain.operators.stats import weighted_sd
from growthgrain.session import shared_folder

few = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def one(df):
    return df.first()[0]


def test_lifecycle_week_rounds_down(spark):
    days = spark.createDataFrame([(d,) for d in (-8, -7, -1, 0, 6, 7, 90, 91)], "d int")
    weeks = [r[0] for r in days.select(lifecycle_week(F.col("d"))).collect()]
    assert weeks == [-2, -1, -1, 0, 0, 1, 12, 13]


def test_cohort_week_starts_on_monday(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(-7, 14)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", cohort_week(F.col("d")))
    for given_day, monday in df.collect():
        assert monday == given_day - dt.timedelta(given_day.weekday())


def test_utc_day_does_not_follow_the_session(spark):
    late = dt.datetime(2024, 1, 7, 23, 30, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(late,)], "t timestamp")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(df.select(utc_day(df, "t"))) == dt.date(2024, 1, 7)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_small_expressions(spark):
    row = (
        spark.range(1)
        .select(
            safe_ratio(F.lit(1), F.lit(0)).alias("zero"),
            safe_ratio(F.lit(1), F.lit(0), None).alias("none"),
            safe_ratio(F.lit(1), F.lit(4)).alias("quarter"),
            joined_label(F.lit("a"), F.lit(None).cast("string")).alias("label"),
            month_start("2024", "03").alias("month"),
            thousands(F.lit(1234567)).alias("text"),
        )
        .first()
    )
    assert tuple(row) == (0.0, None, 0.25, "a | NA", dt.date(2024, 3, 1), "1,234,567")


def test_sums_do_not_depend_on_order(spark):
    amounts = [round(random.Random(1).uniform(0, 9999), 2) for _ in range(5000)]
    cents = sum(round(a * 100) for a in amounts)
    for seed in range(3):
        random.Random(seed).shuffle(amounts)
        df = spark.createDataFrame([(a,) for a in amounts], "x double").repartition(seed + 1)
        assert one(df.agg(usd(F.sum(money(F.col("x")))))) == cents / 100


def test_sum_of_missing_is_zero(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert one(df.agg(usd(F.sum(money(F.col("x")))))) == 0
    assert one(df.where("false").agg(sum_or_zero(F.col("x")))) == 0


@pytest.mark.parametrize(
    "amounts, total",
    [
        ([1e12] * 40, 4e13),
        ([1e18] * 2 + [0.25], 2e18),
        ([4e-7] * 1000, 4e-4),
        ([0.1234567] * 3, 0.3703701),
        ([-5.5, 5.5], 0.0),
    ],
)
def test_money_has_no_bound_in_reach_and_loses_no_digits(spark, amounts, total):
    df = spark.createDataFrame([(a,) for a in amounts], "x double").repartition(3)
    assert one(df.agg(usd(F.sum(money(F.col("x")))))) == total


def test_ranks_equal_a_sort_and_use_no_single_task(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 0.0, -1.5, 3.25, rng.uniform(-9, 9), 10 ** rng.uniform(-9, 9)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "v double, k int").repartition(5)
    found = ranked(df, "v", ["k"], "n")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.k) for r in sorted(found.collect(), key=lambda r: r.n)] == order
    assert sorted(r.n for r in found.collect()) == list(range(1, 301))
    plan = found._jdf.queryExecution().executedPlan().toString()
    for window in plan.split("Window [")[1:]:
        assert "SinglePartition" not in window.split("Exchange")[1]
    assert ranked(df.limit(0), "v", ["k"], "n").count() == 0


def test_a_million_equal_values_are_ranked_in_many_runs(spark):
    df = spark.range(1_000_000).select(F.lit(2.5).alias("v"), F.reverse(F.col("id").cast("string")).alias("k"))
    found = ranked(df, "v", ["k"], "n")
    first = F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "k"))))
    row = found.agg(F.sum("n").alias("sum"), F.count_distinct("n").alias("n"), first.alias("first")).first()
    assert (row["sum"], row["n"]) == (500_000_500_000, 1_000_000)
    assert [r.k for r in row["first"]] == [r.k for r in df.orderBy("k").limit(5).collect()]
    keyed = df.withColumn("_key", F.struct(F.lit(False).alias("k0"), F.lit(-2.5).alias("k1"), F.lit(False).alias("k2"), F.col("k").alias("k3")))
    runs = ordered._in_runs(keyed).groupBy("_run").count().collect()
    assert len(runs) > 900
    assert max(r["count"] for r in runs) < 10_000


def test_ranks_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1.0, 2.0, None]), rng.choice(["x", None, "y"]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "v double, t string, k int")
    one, other = (sorted(ranked(df.repartition(n), "v", ["t", "k"], "n").collect(), key=lambda r: r.n) for n in (1, 7))
    assert one == other
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or "", r[2]))
    assert [(r.v, r.t, r.k) for r in one] == order


def exact_quantile(values, share):
    values = sorted(values)
    at = (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


SPREADS = {
    "one": lambda rng: 7.25,
    "ties": lambda rng: float(rng.randint(-2, 2)),
    "even": lambda rng: rng.uniform(0, 100),
    "tiny to huge": lambda rng: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
    "next to each other": lambda rng: 1.0 + rng.randint(0, 40) * 2**-52,
    "zeros": lambda rng: rng.choice([0.0, -0.0, 5e-324, -5e-324]),
}


@pytest.mark.parametrize("spread", SPREADS)
def test_quantiles_are_exact(spark, spread):
    rng = random.Random(4)
    values = [SPREADS[spread](rng) for _ in range(rng.choice([1, 2, 301]))] + [None, None]
    whole = [rng.randint(0, 9) for _ in values]
    df = spark.createDataFrame(list(zip(values, whole)), "v double, n int").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles(df, {f"v{q}": ("v", q) for q in shares} | {"n": ("n", 0.75)}).collect()
    wanted = [exact_quantile([v for v in values if v is not None], q) for q in shares]
    assert list(found[0])[:-1] == wanted
    assert found[0]["n"] == exact_quantile(whole, 0.75)
    assert len(found) == 1


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "v double, w double")
    assert tuple(quantiles(df, {"a": ("v", 0.5), "b": ("w", 0.5)}).first()) == (None, 1.0)
    assert tuple(quantiles(df.limit(0), {"a": ("v", 0.5)}).first()) == (None,)


def test_quantiles_of_ten_million_values_hold_few_in_a_task(spark):
    n = 10_000_000
    spread = (F.pmod(F.col("id") * 7_368_787, F.lit(n)) + 1) / 1000
    df = spark.range(n).select(spread.alias("v"))
    wanted = {"low": ("v", 0.1), "mid": ("v", 0.5), "high": ("v", 0.999)}
    row = quantiles(df, wanted).first()
    for name, (_, share) in wanted.items():
        at = (n - 1) * share
        low, high = (math.floor(at) + 1) / 1000, (math.ceil(at) + 1) / 1000
        assert row[name] == low + (high - low) * (at - math.floor(at))
    plan = quantiles(df, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS", "", 1)
    assert "percentile" not in plan and "collect" not in plan


def test_two_rows_for_a_key_fail_the_query(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, t string")
    assert sorted(one_row_per(df, ["k"]).collect()) == sorted(df.collect())
    assert one_row_per(df, ["k"]).columns == df.columns
    with pytest.raises(Exception, match="more than one row for"):
        one_row_per(df.unionAll(df), ["k"]).collect()


def test_key_tells_null_empty_and_text_apart(spark):
    ids = [None, "", "=", "x", "=x"]
    df = with_key(spark.createDataFrame([(i,) for i in ids], "profile_id string"))
    assert df.select("pk").distinct().count() == len(ids)
    assert [r[0] for r in df.select(profile_id_of(F.col("pk"))).collect()] == ids


def test_null_safe_left(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20), ("c", 30)], "k string, y int")
    assert sorted(null_safe_left(left, right, ["k"]).collect(), key=lambda r: r["x"]) == [
        ("a", 1, 10),
        (None, 2, 20),
        ("b", 3, None),
    ]


def test_frequent_keys_meet_their_row_in_pieces(spark):
    rows = [(k, i) for i in range(3000) for k in [["", "a=", "b=", f"{i}=", "no row="][i % 5]]]
    facts = spark.createDataFrame(rows, "pk string, n int").repartition(6)
    lookup = [("", 1, None), ("a=", 2, "x"), *((f"{i}=", i, str(i)) for i in range(0, 3000, 7))]
    table = spark.createDataFrame(lookup, "pk string, v int, t string")
    by_key = {k: (v, t) for k, v, t in lookup}
    for least in (0, 100, 10**9):
        found = join_spread(facts, table, ["v", "t"], least=least).collect()
        wanted = sorted((n, k, *by_key.get(k, (None, None))) for k, n in rows)
        assert sorted((r.n, r.pk, r.v, r.t) for r in found) == wanted
        pieces = {k: len({r.spread_key for r in found if r.pk == k}) for k in ("", "a=", "b=", "no row=")}
        assert all(n > 500 if least == 100 else n == 1 or least == 0 for n in pieces.values())
        counted = join_spread(facts, table, ["v"], least=least).groupBy("spread_key", "pk").agg(F.max("v").alias("v"))
        assert one(counted.agg(n_keys())) == len({k for k, _ in rows})
    assert sorted(r[0] for r in hot_keys(facts, least=100).collect()) == ["", "a=", "b=", "no row="]
    assert join_spread(facts.limit(0), table, ["v"]).count() == 0


def test_uniqueness(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "k string")
    assert key_violations(df, ["k"]).collect() == [(None, 2)]
    with pytest.raises(ValueError):
        assert_unique(df, ["k"])
    assert assert_unique(df.distinct(), ["k"]).count() == 2


dates = st.dates(dt.date(1969, 6, 1), dt.date(1971, 6, 1))


@few
@given(st.lists(dates, min_size=1, max_size=40), dates, st.integers(-80, 80), st.integers(0, 90))
def test_day_sets(spark, days, start, low, length):
    df = spark.createDataFrame([(d,) for d in days], "d date")
    sets = (
        df.groupBy(stretch_of(F.col("d")).alias("stretch"))
        .agg(F.bit_or(bit_of(F.col("d"))).alias("days"))
        .withColumn("first", first_day(F.col("stretch"), F.lit(start)))
    )
    part = days_between(F.col("days"), F.col("first"), F.lit(low), F.lit(low + length))
    kept = sets.agg(F.sum(F.bit_count(part)), F.sum(F.bit_count("days"))).first()
    ages = {(d - start).days for d in days}
    assert kept[0] == len([a for a in ages if low <= a <= low + length])
    assert kept[1] == len(ages)


text = st.one_of(st.none(), st.sampled_from(["", "A", "a", "b", "é", "Z"]))


@few
@given(st.lists(st.tuples(st.sampled_from(["k", "l"]), text, text, text), min_size=1, max_size=25))
def test_first_row_is_the_first_of_the_sorted_rows(spark, data):
    df = spark.createDataFrame(data, "key string, a string, b string, c string")
    got = {
        r["key"]: tuple(r["first"][c] for c in "abc")
        for r in df.groupBy("key").agg(first_row_by(["a", "b", "c"]).alias("first")).collect()
    }

    def order(row):
        return [(v is None, (v or "").encode()) for v in row]

    for key, first in got.items():
        assert first == sorted((r[1:] for r in data if r[0] == key), key=order)[0]


def exact_sd(pairs):
    """In billionths, by fractions."""
    kept = [(math.floor(x * 1e9 + 0.5), w) for x, w in pairs if x is not None]
    weight = sum(w for _, w in kept)
    mean = Fraction(sum(x * w for x, w in kept), weight)
    return math.sqrt(sum(w * (x - mean) ** 2 for x, w in kept) / weight) / 1e9


@pytest.mark.parametrize(
    "value",
    [
        lambda rng: rng.uniform(0, 40),
        lambda rng: 1e6 + rng.uniform(-1e-6, 1e-6),
        lambda rng: 5 - 1e-9 * rng.randint(0, 3),
        lambda rng: -rng.uniform(0, 1e5),
        lambda rng: 3.0,
    ],
)
def test_weighted_sd_is_exact_in_any_order(spark, value):
    rng = random.Random(8)
    pairs = [(value(rng), rng.randint(0, 10**6)) for _ in range(2000)]
    found = set()
    for parts in (1, 5):
        rng.shuffle(pairs)
        df = spark.createDataFrame([("k", x, w) for x, w in pairs], "k string, x double, w long")
        found.add(weighted_sd(df.repartition(parts), ["k"], "x", "w", "sd").first()["sd"])
    assert len(found) == 1
    assert found.pop() == pytest.approx(exact_sd(pairs), abs=1.01e-9)


@pytest.mark.parametrize(
    "value",
    [
        lambda rng: rng.uniform(0, 2e9),
        lambda rng: 1e9 + rng.uniform(-1e-6, 1e-6),
        lambda rng: -rng.uniform(0, 5e12),
        lambda rng: rng.choice([0.25, 7e9, 5.4e12]),
        lambda rng: 3e13,
    ],
)
def test_weighted_sd_of_large_values(spark, value):
    rng = random.Random(9)
    pairs = [(value(rng), rng.randint(0, 10**6)) for _ in range(2000)]
    found = set()
    for parts in (1, 5):
        rng.shuffle(pairs)
        df = spark.createDataFrame([("k", x, w) for x, w in pairs], "k string, x double, w long")
        found.add(weighted_sd(df.repartition(parts), ["k"], "x", "w", "sd").first()["sd"])
    assert len(found) == 1
    assert found.pop() == pytest.approx(exact_sd(pairs), rel=1e-14, abs=1.01e-9)


def test_weighted_sd_holds_no_group_in_one_row(spark):
    df = spark.createDataFrame([("k", 1.0, 2)], "k string, x double, w long")
    plan = weighted_sd(df, ["k"], "x", "w", "sd")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect" not in plan


numbers = st.one_of(st.none(), st.integers(-50, 50).map(float))


@few
@given(st.lists(st.tuples(numbers, st.integers(0, 5)), min_size=1, max_size=20))
def test_weighted_sd(spark, data):
    df = spark.createDataFrame([(None, x, w) for x, w in data], "k string, x double, w long")
    got = weighted_sd(df, ["k"], "x", "w", "sd").first()["sd"]
    if sum(w for _, w in data) == 0:
        assert got == 0
        return
    kept = [(x, w) for x, w in data if x is not None]
    if sum(w for _, w in kept) == 0:
        assert got is None
        return
    x, w = np.array(kept, dtype=float).T
    mean = np.average(x, weights=w)
    assert got == pytest.approx(np.sqrt(np.average((x - mean) ** 2, weights=w)), abs=1e-9)


@few
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=20))
def test_pearson_over_complete_pairs(spark, data):
    df = spark.createDataFrame(data, "x double, y double")
    got = one(df.agg(pearson(F.col("x"), F.col("y"))))
    pairs = np.array([p for p in data if None not in p], dtype=float).reshape(-1, 2)
    if len(pairs) < 2 or pairs[:, 0].std() == 0 or pairs[:, 1].std() == 0:
        assert got is None or abs(got) <= 1 + 1e-9
    else:
        assert got == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-9)


def test_pearson_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert one(df.agg(pearson(F.col("x"), F.col("y")))) is None


def test_running_sum_and_positions(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 1, 3), ("b", 1, 7), (None, 1, 1)], "k string, w int, x int")
    total = df.withColumn("t", running_sum(F.col("x"), ["k"], "w"))
    assert {(r["k"], r["w"], r["t"]) for r in total.collect()} == {
        ("a", 1, 3),
        ("a", 2, 8),
        ("b", 1, 7),
        (None, 1, 1),
    }
    order = largest_first("x", "k")
    found = ranked(df, "x", ["k"], "n").collect()
    assert {(r["x"], r["n"]) for r in found} == {(7, 1), (5, 2), (3, 3), (1, 4)}
    assert [r["x"] for r in top_rows(df, order, 2).collect()] == [7, 5]


def test_ols_matches_numpy_and_leaves_gaps_unscored(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3)) * [1, 0.1, 1000]
    y = x @ [2.0, -30.0, 0.01] + 5 + rng.normal(size=40)
    data = [(float(b), *map(float, a)) for a, b in zip(x, y)]
    gaps = [(1.0, None, 0.0, 0.0), (None, 0.5, 0.1, 3.0)]
    df = spark.createDataFrame(data + gaps, "y double, a double, b double, c double")
    got = ols_fit_predict(df, "y", ["a", "b", "c"], "fit").collect()
    design = np.column_stack([np.ones(40), x])
    coefficients = np.linalg.lstsq(design, y, rcond=None)[0]
    by_a = {r["a"]: r["fit"] for r in got}
    for a, fitted in zip(x[:, 0], design @ coefficients):
        assert by_a[float(a)] == pytest.approx(fitted, abs=1e-8)
    assert by_a[None] is None
    assert by_a[0.5] == pytest.approx(coefficients @ [1, 0.5, 0.1, 3.0], abs=1e-8)


def test_features_that_others_explain_are_left_out(spark):
    rng = np.random.default_rng(4)
    a, c = rng.normal(size=30), rng.normal(size=30)
    y = 3 * a - c + 2 + rng.normal(size=30)
    data = [(float(v), float(p), 7.0, float(2 * p - 1), float(q)) for v, p, q in zip(y, a, c)]
    df = spark.createDataFrame(data, "y double, a double, one double, twice double, c double")
    got = ols_fit_predict(df, "y", ["a", "one", "twice", "c"], "fit").collect()
    design = np.column_stack([np.ones(30), a, c])
    wanted = dict(zip(a, design @ np.linalg.lstsq(design, y, rcond=None)[0]))
    assert [r.fit for r in got] == pytest.approx([wanted[r.a] for r in got], abs=1e-9)


def test_fits_of_few_rows(spark):
    rows = [(1.0, 1.0, 5.0), (3.0, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    assert [r.fit for r in ols_fit_predict(df, "y", ["a", "b"], "fit").orderBy("y").collect()] == pytest.approx([1, 3])
    assert ols_fit_predict(df.limit(0), "y", ["a", "b"], "fit").count() == 0
    gap = spark.createDataFrame([(None, 1.0, 5.0)], "y double, a double, b double")
    assert [r.fit for r in ols_fit_predict(gap, "y", ["a", "b"], "fit").collect()] == [None]


def test_a_fit_runs_nothing_before_it_is_asked_for(spark):
    df = spark.range(9).select(F.raise_error(F.lit("read")).cast("double").alias("y"), F.col("id").cast("double").alias("a"))
    lazy = ols_fit_predict(df, "y", ["a"], "fit")
    with pytest.raises(Exception, match="read"):
        lazy.collect()


def test_a_fit_leaves_no_files(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*"))
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(9)], "y double, a double")
    assert ols_fit_predict(df, "y", ["a"], "fit").count() == 9
    assert set(folder.rglob("*")) == before
