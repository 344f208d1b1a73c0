import math
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderlens.functions.calendar import (
    as_days,
    calendar_days_between,
    later_date,
    micros_between,
    month_of,
    quarter_of,
    within,
)
from orderlens.functions.medians import middle_values
from orderlens.functions.money import from_cents, in_cents, require_cents
from orderlens.functions.probability import (
    correlation_p,
    normal_two_sided_p,
    student_two_sided_p,
    two_proportion_z,
    wald_interval,
)
from orderlens.functions.rates import growth_percent, percent, ratio, rounded, significant


def moments(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a string, b string").selectExpr(
        "CAST(a AS TIMESTAMP_NTZ) AS a", "CAST(b AS TIMESTAMP_NTZ) AS b"
    )


def test_durations_ignore_the_session_zone(spark):
    # Clocks in Sao Paulo were put forward at midnight of 2017-10-15.
    df = moments(
        spark,
        ("2017-10-15 00:30:00", "2017-10-15 03:00:00.000001"),
        ("2017-10-16 00:00:00", "2017-10-14 23:00:00"),
        ("2017-10-16 00:00:00", None),
    ).select(micros_between("a", "b").alias("m"), as_days(micros_between("a", "b")).alias("d"))
    expected = [(9_000_000_001, 9_000_000_001 / 86400e6), (-90_000_000_000, -90_000 / 86400), (None, None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [tuple(r) for r in df.collect()] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_late_is_decided_by_date(spark):
    df = moments(
        spark,
        ("2018-01-10 18:00:00", "2018-01-10 00:00:00"),
        ("2018-01-11 00:00:00", "2018-01-10 00:00:00"),
        ("2018-01-09 23:59:59", "2018-01-10 00:00:00"),
        ("2018-01-09 23:59:59", None),
    )
    assert [r[0] for r in df.select(later_date("a", "b")).collect()] == [False, True, False, None]
    assert [r[0] for r in df.select(calendar_days_between("b", "a")).collect()] == [0, 1, -1, None]


def test_grains_and_half_open_range(spark):
    df = moments(
        spark,
        ("2017-01-01 00:00:00", None),
        ("2017-11-30 23:59:59.999999", None),
        ("2018-09-01 00:00:00", None),
    ).select(
        month_of("a"), quarter_of("a"), within("a", date(2017, 1, 1), date(2018, 9, 1))
    )
    assert [tuple(r) for r in df.collect()] == [
        (date(2017, 1, 1), date(2017, 1, 1), True),
        (date(2017, 11, 1), date(2017, 10, 1), True),
        (date(2018, 9, 1), date(2018, 7, 1), False),
    ]


def test_rounding_and_ratios(spark):
    df = spark.range(1).select(
        rounded(F.lit(1.005)),
        rounded(F.lit(-1.005)),
        rounded(F.lit(2.675)),
        rounded(F.lit("123456789012345678901234567.125").cast("decimal(38,8)")),
        ratio(F.lit(1), F.lit(0)),
        percent(F.lit(1), F.lit(8)),
        growth_percent(F.lit(3), F.lit(2)),
        growth_percent(F.lit(3), F.lit(0)),
        growth_percent(F.lit(3), F.lit(None).cast("int")),
    )
    assert tuple(df.first()) == (1.01, -1.01, 2.68, 1.2345678901234568e26, None, 12.5, 50.0, None, None)


def test_cents(spark):
    amounts = [Decimal("0.01"), Decimal("-12.30"), Decimal("9999999999.99"), None]
    df = spark.createDataFrame([(a,) for a in amounts], "a decimal(12,2)")
    found = df.select(in_cents("a").alias("c")).select("c", from_cents("c")).collect()
    assert [tuple(r) for r in found] == [
        (1, amounts[0]), (-1230, amounts[1]), (999_999_999_999, amounts[2]), (None, None)]
    require_cents(df, "a")
    for kind in ("decimal(12,3)", "double"):
        with pytest.raises(TypeError, match="a must be a decimal"):
            require_cents(df.selectExpr(f"CAST(a AS {kind}) AS a"), "a")


def exact_middles(values):
    ordered = sorted(values)
    n = len(ordered)
    return ordered[(n - 1) // 2], ordered[n // 2]


@pytest.mark.parametrize("widths", [(1,), (1000, 1), (1_000_000, 1_000, 1)])
@pytest.mark.parametrize("size", [1, 2, 501])
def test_middle_values_match_sorting(spark, widths, size):
    rng = random.Random(size)
    values = [rng.randint(-5_000_000, 5_000_000) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values + [None]], "v bigint")
    assert tuple(middle_values(df, "v", widths=widths).first()) == exact_middles(values)


def test_middle_values_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v bigint")
    assert [tuple(r) for r in middle_values(df, "v").collect()] == [(None, None)]


@pytest.mark.parametrize("groups_at_most", [None, 4])
def test_middle_values_by_group_with_a_dominant_value(spark, groups_at_most):
    rng = random.Random(7)
    data = {g: [rng.randint(0, 3_000_000) for _ in range(n)] for g, n in (("a", 9), ("b", 40))}
    data["hot"] = [42] * 3000 + list(range(0, 4_000_000, 1000))
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v bigint")
    found = {
        r["g"]: (r["lower"], r["upper"])
        for r in middle_values(df, "v", keys=["g"], groups_at_most=groups_at_most).collect()
    }
    assert found == {g: exact_middles(vs) for g, vs in data.items()}


def test_a_crowded_minute_is_narrowed_by_counts(spark):
    """A million distinct values in one minute; what is ranked last is one bucket of 10,000."""
    df = spark.range(1_000_000).selectExpr("id * 59 % 60000000 AS v")
    totals = {"rows": F.count("*"), "sum": F.sum("v")}
    found = middle_values(df, "v", widths=(60_000_000, 10_000, 1), totals=totals).first()
    values = sorted(i * 59 % 60_000_000 for i in range(1_000_000))
    assert tuple(found) == (*exact_middles(values), 1_000_000, sum(values))


def test_totals_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 4)], "g string, v bigint")
    found = middle_values(df, "v", keys=["g"], totals={"rows": F.count("*")}).orderBy("g")
    assert [tuple(r) for r in found.collect()] == [("a", None, None, 2), ("b", 4, 4, 1)]


def test_widths_must_reach_single_values(spark):
    with pytest.raises(ValueError):
        middle_values(spark.range(3).withColumnRenamed("id", "v"), "v", widths=(10,))


def test_normal_tail(spark):
    points = [0.0, 0.3, -1.0, 1.96, 2.7, 2.9, -5.0, 10.07, 30.0]
    df = spark.createDataFrame([(z,) for z in points], "z double")
    for z, p in df.select("z", normal_two_sided_p(F.col("z"))).collect():
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12)


def student_tail_by_integration(t, nu):
    """Simpson's rule on the density from |t| to infinity, with x = |t| + u / (1 - u)."""
    scale = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)

    def f(u):
        if u == 1:
            return scale * nu if nu == 1 else 0.0
        x = abs(t) + u / (1 - u)
        return scale * (1 + x * x / nu) ** (-(nu + 1) / 2) / (1 - u) ** 2

    n = 20000
    total = sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i / n) for i in range(n + 1))
    return 2 * total / (3 * n)


def test_student_tail(spark):
    points = [(t, nu) for t in (0.0, 0.4, -1.3, 1.99, 3.27, 12.0) for nu in (1, 2, 3, 17, 18, 60, 201)]
    df = spark.createDataFrame(points, "t double, nu bigint")
    for t, nu, p in df.select("t", "nu", student_two_sided_p(F.col("t"), F.col("nu"))).collect():
        assert p == pytest.approx(student_tail_by_integration(t, nu), rel=1e-7, abs=1e-300)


@pytest.mark.parametrize("n", [3, 20, 1_000_002])
def test_student_tail_at_any_size(spark, n):
    """Against the normal tail where the size is large, else against integration; constant steps."""
    points = [(t, n) for t in (0.5, 1.9, 2.1, 6.0)]
    df = spark.createDataFrame(points, "t double, n bigint")
    for t, nu, p in df.select("t", F.col("n") - 2, student_two_sided_p(F.col("t"), F.col("n") - 2)).collect():
        if n > 1000:
            tail, phi = math.erfc(t / math.sqrt(2)), math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            # first term of the expansion in 1 / nu
            assert p == pytest.approx(tail + 2 * phi * (t**3 + t) / (4 * nu), rel=1e-9)
        else:
            assert p == pytest.approx(student_tail_by_integration(t, nu), rel=1e-7)


def test_p_of_perfect_and_undefined_correlations(spark):
    points = [(1.0, 10), (-1.0, 3), (1.0, 2), (-1.0, 2), (None, 5), (None, 1), (0.0, 3)]
    df = spark.createDataFrame(points, "r double, n bigint")
    found = [row[0] for row in df.select(correlation_p(F.col("r"), F.col("n"))).collect()]
    assert found[:6] == [0.0, 0.0, 1.0, 1.0, None, None]
    assert found[6] == pytest.approx(1.0)


def test_six_significant_digits(spark):
    p = normal_two_sided_p(F.lit(10.07))
    found = spark.range(1).select(significant(p), significant(F.lit(0.0)), significant(F.lit(0.25))).first()
    assert f"{found[0]:.1e}" == "7.5e-24" and found[1:] == (0.0, 0.25)
    published = spark.range(1).select(significant(normal_two_sided_p(F.lit(10.0686)))).first()[0]
    assert 7e-24 < published < 8e-24


def test_published_correlation_is_significant(spark):
    # r = -0.61 over the 20 months of the published window, p = 0.004.
    t = -0.61 * math.sqrt(18 / (1 - 0.61**2))
    p = spark.range(1).select(student_two_sided_p(F.lit(t), F.lit(18))).first()[0]
    assert round(p, 3) == 0.004


def test_published_intervals(spark):
    df = spark.createDataFrame([(15.22, 335), (13.87, 476), (12.16, 3256)], "pct double, n int")
    low, high = wald_interval("pct", "n")
    found = [tuple(r) for r in df.select(rounded(low), rounded(high)).collect()]
    assert found == [(11.37, 19.07), (10.76, 16.98), (11.04, 13.28)]


def test_two_proportions(spark):
    z = two_proportion_z(F.lit(30), F.lit(200), F.lit(60), F.lit(250))
    pooled = 90 / 450
    expected = (60 / 250 - 30 / 200) / math.sqrt(pooled * (1 - pooled) * (1 / 200 + 1 / 250))
    assert spark.range(1).select(z).first()[0] == pytest.approx(expected, rel=1e-14)
    same = two_proportion_z(F.lit(0), F.lit(10), F.lit(0), F.lit(10))
    assert spark.range(1).select(same).first()[0] is None
