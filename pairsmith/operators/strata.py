"""Precision estimates from strata: a stratum is the first rule of a composition that finds a pair.

There are as many strata as rules, so windows over them hold a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.functions.predicates import named


def _up_to():
    return Window.partitionBy(F.lit(0)).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)


def _spine(df: DataFrame, n_rules: int, name: str) -> DataFrame:
    return df.sparkSession.range(n_rules).select(F.col("id").cast("int").alias(name))


def stratum_precision(df: DataFrame, n_rules: int, label: str = "label") -> DataFrame:
    """(stratum_k, n_total, n_labelled, tp, p_hat, se) of every stratum; estimates are null without labelled rows."""
    y = named(label).cast("boolean")
    counts = df.filter("stratum_k >= 0").groupBy("stratum_k").agg(F.count("*").alias("n_total"), F.count(y).alias("n_labelled"), F.count_if(y).alias("tp"))
    out = _spine(df, n_rules, "stratum_k").join(F.broadcast(counts), "stratum_k", "left").fillna(0)
    p = F.try_divide(F.col("tp").cast("double"), F.col("n_labelled").cast("double"))
    return out.withColumn("p_hat", p).withColumn("se", F.sqrt(F.try_divide(F.col("p_hat") * (1 - F.col("p_hat")), F.col("n_labelled").cast("double"))))


def cumulative_precision(strata: DataFrame) -> DataFrame:
    """(m, n_1_to_m, p_strat, se_strat): strata up to m with labelled rows, weighted by their sizes.

    n_1_to_m counts all strata up to m once any of them has labelled rows, and is 0 before.
    """
    known = F.col("n_labelled") > 0
    n = F.col("n_total").cast("double")
    sums = strata.select(
        F.col("stratum_k").alias("m"),
        F.col("n_total"),
        F.when(known, n).otherwise(0.0).alias("w"),
        F.when(known, n * F.col("p_hat")).otherwise(0.0).alias("wp"),
        F.when(known, n * n * F.col("se") * F.col("se")).otherwise(0.0).alias("wv"),
    ).select("m", F.sum("n_total").over(_up_to()).alias("n"), *(F.sum(x).over(_up_to()).alias(x) for x in ("w", "wp", "wv")))
    some = F.col("w") > 0
    return sums.select("m", F.when(some, F.col("n")).otherwise(0).cast("long").alias("n_1_to_m"), F.when(some, F.try_divide("wp", "w")).alias("p_strat"), F.when(some, F.try_divide(F.sqrt("wv"), F.col("w"))).alias("se_strat"))


def labelled_cumulative(df: DataFrame, n_rules: int, label: str = "label") -> DataFrame:
    """(m, n_lab, tp_lab, p_lab) over labelled rows first found by rule m or before; p_lab is null without any."""
    y = named(label).cast("boolean")
    counts = df.filter((F.col("stratum_k") >= 0) & y.isNotNull()).groupBy(F.col("stratum_k").alias("m")).agg(F.count("*").alias("n"), F.count_if(y).alias("t"))
    spine = _spine(df, n_rules, "m").join(F.broadcast(counts), "m", "left").fillna(0)
    out = spine.select("m", F.sum("n").over(_up_to()).alias("n_lab"), F.sum("t").over(_up_to()).alias("tp_lab"))
    return out.withColumn("p_lab", F.try_divide(F.col("tp_lab").cast("double"), F.col("n_lab").cast("double")))


def combined_precision(labelled: DataFrame, stratified: DataFrame) -> DataFrame:
    """Both curves as one, weighted by their rows; without historic evidence the labelled one, with error 0."""
    j = labelled.join(stratified, "m")
    some = F.col("p_strat").isNotNull()
    total = (F.col("n_lab") + F.col("n_1_to_m")).cast("double")

    def weighted(a: Column) -> Column:
        return F.try_divide(a, total)

    return j.select(
        "m",
        F.col("n_lab"),
        F.col("n_1_to_m"),
        F.when(some, F.col("n_lab") + F.col("n_1_to_m")).otherwise(F.col("n_lab")).alias("n_all"),
        F.when(some, weighted(F.col("n_lab") * F.col("p_lab") + F.col("n_1_to_m") * F.col("p_strat"))).otherwise(F.col("p_lab")).alias("p_combined"),
        F.when(some, F.col("se_strat") * weighted(F.col("n_1_to_m"))).otherwise(0.0).alias("se_combined"),
        some.alias("has_historic_evidence"),
    )


def expected_savings(combined: DataFrame, average_saving: float, review_cost: float) -> DataFrame:
    """The combined curve with expected true positives, net value and its error."""
    n = F.col("n_all").cast("double")
    out = combined.withColumn("tp_est", n * F.col("p_combined"))
    return out.withColumn("nv_est", F.col("tp_est") * F.lit(float(average_saving)) - n * F.lit(float(review_cost))).withColumn("se_nv", n * F.col("se_combined") * F.lit(float(average_saving)))
