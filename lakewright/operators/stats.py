"""Statistics over columns of rows: description, outliers, correlation, profiles and tests."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.probability import chi_square_upper, f_upper, t_two_sided
from lakewright.operators.percentiles import percentiles
from lakewright.operators.windows import match


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, deviation, range, quartiles, count and a normality test per group.

    The test is Jarque-Bera, given for 3 values or more; its p-value is the
    chi-square tail with two degrees of freedom, exp(-x / 2).
    """
    v = F.col(value).cast("double")
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_dev"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.skewness(v).alias("_skew"), F.kurtosis(v).alias("_kurt"))
    quartiles = percentiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    jb = F.col("n") / 6 * (F.col("_skew") * F.col("_skew") + F.col("_kurt") * F.col("_kurt") / 4)
    tested = F.col("n") >= 3
    return match(base, quartiles, keys).select(
        *keys, "n", "mean", "median", "std_dev", "min", "max", (F.col("max") - F.col("min")).alias("range"),
        "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        F.when(tested, jb).alias("jarque_bera"), F.when(tested, F.exp(-jb / 2)).alias("p_value"),
        F.when(tested, F.exp(-jb / 2) > 0.05).alias("is_normal"))


def zscore_outliers(df: DataFrame, keys: list[str], value: str, threshold: float = 2.0) -> DataFrame:
    """Rows with ``z_score`` and ``is_outlier`` against the sample deviation of their group."""
    spread = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    z = F.abs((F.col(value) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    return (match(df, spread, keys, "left").withColumn("z_score", z)
            .withColumn("is_outlier", F.coalesce(F.col("z_score") > threshold, F.lit(False))).drop("_mean", "_sd"))


def remove_outliers_iqr(df: DataFrame, keys: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """Rows within ``reach`` interquartile ranges of the quartiles of their group."""
    q = percentiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    return (match(df, q, keys).where(F.col(value).between(F.col("_q1") - iqr * reach, F.col("_q3") + iqr * reach))
            .drop("_q1", "_q3"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All ordered pairs with their correlation, from one pass."""
    pairs = list(product(columns, columns))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(f"c{i}").alias("correlation"))
                        for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, metric, value) with nulls, distinct values, minimum and maximum as text."""
    out = None
    for c in columns:
        # Equal values meet before the shuffle, and no row is multiplied for another column.
        cells = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        facts = cells.agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("v").alias("distinct_count"),
                          F.min("v").alias("min_value"), F.max("v").alias("max_value"))
        entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in facts.columns])
        own = facts.select(F.explode(entries).alias("e")).select("e.*")
        out = own if out is None else out.unionByName(own)
    return out


def regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Least-squares line per group; null slope where x does not vary."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                 F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def t_test(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Welch's t statistic, degrees of freedom and two-sided p-value between two groups."""
    def part(name):
        v = F.when(F.col(group) == name, F.col(value))
        return F.avg(v), F.var_samp(v), F.count(v)

    (ma, va, na), (mb, vb, nb) = part(a), part(b)
    row = df.where(F.col(group).isin(a, b)).agg(
        ma.alias("ma"), (va / na).alias("ea"), na.alias("na"), mb.alias("mb"), (vb / nb).alias("eb"), nb.alias("nb"))
    spread = F.col("ea") + F.col("eb")
    return row.select(
        ((F.col("ma") - F.col("mb")) / F.sqrt(spread)).alias("statistic"),
        (spread * spread / (F.col("ea") * F.col("ea") / (F.col("na") - 1)
                            + F.col("eb") * F.col("eb") / (F.col("nb") - 1))).alias("df")).withColumn(
                                "p_value", t_two_sided(F.col("statistic"), F.col("df")))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F statistic and its p-value from per-group counts, means and variances."""
    per = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    sums = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("t"),
                   F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("t") * F.col("t") / F.col("n")
    return sums.select(((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("statistic"),
                       (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within")).withColumn(
                           "p_value", f_upper(F.col("statistic"), F.col("df_between"), F.col("df_within")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence statistic, degrees of freedom and p-value of two categorical columns."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    n = F.sum("o")
    # Sum over all cells of (o - e)^2 / e equals n * sum(o^2 / (r * c)) - n; empty cells add nothing.
    return match(match(cells, rows, [a]), cols, [b]).agg(
        (n * F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))) - n).alias("statistic"),
        ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("df")).withColumn(
            "p_value", chi_square_upper(F.col("statistic"), F.col("df")))
