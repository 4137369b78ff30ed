"""Reading pair tables and choosing their rows; writing results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.config import Filters, PairColumns
from pairsmith.functions.predicates import named


def read_pairs(spark: SparkSession, path: str | Sequence[str], condition: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet files or a glob of them, filtered and projected; both reach the scan."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if condition is not None:
        df = df.filter(condition)
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        df = df.select(*map(named, columns))
    return df


def read_database(spark: SparkSession, url: str, query: str, key: str | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """Rows of a relational database.

    With a numeric or date ``key`` of the query they are read in as many parts, each a range
    of the key between its least and greatest value, one task and connection for each; rows of
    a null key are in the first.  Without a key one task reads all: for small mappings.
    """
    jdbc = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return jdbc.option("query", query).load()
    quoted = '"' + key.replace('"', '""') + '"'
    low, high = jdbc.option("query", f"SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM ({query}) bounds").load().first()
    if low is None:
        return jdbc.option("query", query).load()
    part = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) parts", **part, **options).load()


def read_matching(spark: SparkSession, url: str, table: str, keys: DataFrame, staging: str, key: str | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """The rows of a database table that have one of the keys; the database does the restriction.

    The distinct keys are written to the table ``staging`` there, which is overwritten; its
    columns have the names of the table's.  ``key`` and ``partitions`` as in ``read_database``.
    """
    write_database(keys.distinct(), url, staging, **options)
    names = ['"' + c.replace('"', '""') + '"' for c in keys.columns]
    same = " AND ".join(f"t.{c} = s.{c}" for c in names)
    return read_database(spark, url, f"SELECT t.* FROM {table} t WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same})", key, partitions, **options)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table whose rows are dealt by keys into buckets, and sorted in them: joins and groupings by these keys with tables of as many buckets read it without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def base_filter(f: Filters, c: PairColumns = PairColumns()) -> Column:
    """Not matched by the legacy rule, not both sides of the excluded prefix, left side not of the excluded value; null classes drop the row."""
    left, right = named(c.lar), named(c.lar + c.suffix)
    return ~named(c.legacy) & (~left.startswith(f.exclude_lar_prefix) | ~right.startswith(f.exclude_lar_prefix)) & (left != f.exclude_lar_value)


def _within(column: str, start: datetime | None, end: datetime | None) -> Column:
    out = F.lit(True)
    if start is not None:
        out = out & (named(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (named(column) < F.lit(end).cast("timestamp_ntz"))
    return out


def date_filter(f: Filters, c: PairColumns = PairColumns()) -> Column:
    """Both documents in [train_start, train_end); either bound may be missing."""
    return _within(c.import_time, f.train_start, f.train_end) & _within(c.import_time + c.suffix, f.train_start, f.train_end)


def train_filter(f: Filters, c: PairColumns = PairColumns()) -> Column:
    """The base filter; dates bind unlabelled rows only."""
    return base_filter(f, c) & (named(c.label).isNotNull() | date_filter(f, c))


def window_filter(f: Filters, c: PairColumns = PairColumns()) -> Column:
    """The evaluation window as ranges, so that row groups can be skipped."""
    start, end, start_2, end_2 = f.window
    return _within(c.import_time, start, end) & _within(c.import_time + c.suffix, start_2, end_2)


def historic_filter(f: Filters, c: PairColumns = PairColumns()) -> Column:
    """Unlabelled rows of the evaluation window whose second document is older than the historic end."""
    start, end, start_2, _ = f.window
    return named(c.label).isNull() & _within(c.import_time, start, end) & _within(c.import_time + c.suffix, start_2, f.historic_end)


def min_reimbursement_filter(threshold: float | None, c: PairColumns = PairColumns()) -> Column:
    """The smaller known amount exceeds the threshold, or none is known; no threshold keeps all."""
    if threshold is None or threshold <= 0:
        return F.lit(True)
    least = F.least(named(c.reimbursement), named(c.reimbursement + c.suffix))
    return least.isNull() | (least > threshold)


def nowhere_labelled(columns: Sequence[str]) -> Column:
    """The AND of three-valued labels is null: one is null and none is false."""
    out = named(columns[0])
    for name in columns[1:]:
        out = out & named(name)
    return out.isNull()


def write_results(results: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """One folder for each result, as parquet, csv or json."""
    for name, df in results.items():
        df.write.mode("overwrite").format(format).save(f"{folder}/{name}")


def write_database(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("overwrite").save()
