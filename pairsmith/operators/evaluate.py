"""Counts, precision and recall of rules and compositions, each by one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.config import PairColumns
from pairsmith.functions.predicates import Rule, any_fires, fires, named, truth


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def census(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: n_pos, n_labelled_neg, n_unlabelled, n_total."""
    y = named(label).cast("boolean")
    return df.agg(F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_labelled_neg"), F.count_if(y.isNull()).alias("n_unlabelled"), F.count("*").alias("n_total"))


def rule_counts(df: DataFrame, rules: Sequence[Rule], label: str = "label") -> DataFrame:
    """(rule_id, tp, pp, precision) of each rule: one pass, one small row for each rule that a row fires."""
    fired = F.filter(F.array(*(F.when(fires(r), F.lit(i)) for i, r in enumerate(rules))), lambda x: x.isNotNull())
    hits = df.select(truth(label).alias("y"), F.explode(fired).alias("rule_id")).groupBy("rule_id").agg(F.count_if("y").alias("tp"), F.count("*").alias("pp"))
    spine = df.sparkSession.range(len(rules)).select(F.col("id").cast("int").alias("rule_id"))
    out = spine.join(hits, "rule_id", "left").fillna(0, ["tp", "pp"])
    return out.withColumn("precision", ratio(F.col("tp"), F.col("pp")))


def evaluate(df: DataFrame, rules: Sequence[Rule], label: str = "label") -> DataFrame:
    """One row (precision, recall) of the composition; 0 where nothing is predicted or positive."""
    fire, y = any_fires(rules), truth(label)
    counts = df.agg(F.count_if(fire & y).alias("tp"), F.count_if(fire).alias("pp"), F.count_if(y).alias("p"))
    return counts.select(ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("p")).alias("recall"))


def stack_split(df: DataFrame, rules: Sequence[Rule], c: PairColumns = PairColumns()) -> DataFrame:
    """One row: positives, predictions and true positives within and across stacks; null stacks are in neither."""
    inside = named(c.key[0]) == named(c.key_2[0])
    fire, y = any_fires(rules), truth(c.label)
    return df.agg(*(F.count_if(where & what).cast("double").alias(f"{side}_stack_{name}") for side, where in (("in", inside), ("out", ~inside)) for name, what in (("total_positives", y), ("pos_pred", fire), ("true_positives", fire & y))))


def class_table(df: DataFrame, rules: Sequence[Rule], c: PairColumns = PairColumns()) -> DataFrame:
    """For each pair of class codes: counts, precision and recall in per cent."""
    fire, y = any_fires(rules), truth(c.label)
    cells = df.groupBy(named(c.lar).alias("lar"), named(c.lar + c.suffix).alias("lar_2")).agg(F.count("*").alias("n_total"), F.count_if(y).alias("total_pos"), F.count_if(fire).alias("pos_pred"), F.count_if(fire & y).alias("tp"))
    return cells.withColumns({"precision_pct": 100 * ratio(F.col("tp"), F.col("pos_pred")), "recall_pct": 100 * ratio(F.col("tp"), F.col("total_pos"))})


def class_matrix(cells: DataFrame, value: str, classes: Sequence[str]) -> DataFrame:
    """The class table as a matrix: a row for each left class, a column for each of ``classes``, 0 where there is no pair."""
    return cells.filter(F.col("lar").isNotNull()).groupBy("lar").pivot("lar_2", list(classes)).agg(F.first(value)).fillna(0).orderBy("lar")
