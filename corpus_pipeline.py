"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's docs.  All but the
last return the columns of ``documents``.

Null texts have no words and go with the quality rules; so do empty texts and those of
white space.  Long texts are handled whole.  Rows that repeat an identifier and a text are
judged alike and are one document to the near-duplicate stage, which keeps or drops them
together.  An empty table gives an empty table with each stage's columns.  Other columns
travel in a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.llm import lines, neardup, packing, pii, quality
from pairsmith.sources import interim


def _with_text(df: DataFrame, columns: list[str], text: F.Column) -> DataFrame:
    """The row's columns with another text and its length."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return df.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, rules)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; a document of which no other line is left goes too."""
    found = lines.without_recurring_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("t", F.lit(" \t\n\x0b\x0c\r")) == "")
    return _with_text(found.filter(~emptied | F.col("t").isNull()), docs.columns, F.col("t"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least identifier."""
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by the names of their kinds."""
    clean = pii.redacted(docs, pii.learn(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 4096: one row for each piece of a document."""
    return packing.pack(docs)


#: In this order; the numbers are those of the operators.
STAGES = [
    ("9 quality rules", quality_rules),
    ("7 line dedup", line_dedup),
    ("1 near duplicates", near_duplicates),
    ("4 personal data", personal_data),
    ("3 packing", pack),
]

#: SQL cannot express the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def after(n: int) -> DataFrame:
        """What the first n stages leave; the table of the stage before goes when the next one is stored."""
        if n == 0:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        return interim.settled(spark, lambda: STAGES[n - 1][1](spark, after(n - 1), sf_dir), "stage")

    return after(len(STAGES))
