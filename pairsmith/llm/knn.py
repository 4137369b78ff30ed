"""Exact top-k search by inner product: a Voronoi join.

Every vector belongs to the cell of its nearest pivot.  For a query q and a cell with
pivot p, farthest member at distance r and greatest norm m, each member x has

    q.p - |q| r  <=  q.x  <=  min(q.p + |q| r, |q| m).

A first pass scores each query against its own cell; its k-th best score there (or the
k-th best lower bound over cells) is a floor, and only cells whose upper bound reaches
it are searched in the second pass.  Cells and query groups are dealt into blocks of
bounded size, data blocks are replicated only to the query groups that need them, and
each pair of blocks is one matrix product.

Vectors that are null, or hold null or non-finite components, take no part; nor does a
pair of different dimensions.  Ties go to the smaller identifier.  Null identifiers take
no part.  Repeated rows of one identifier count each; a query ignores all rows of its own
identifier.  Equal query rows are scored once and their results repeated as often as there
are rows, among which the k best are chosen.  Scores of 2**53 or more, which doubles cannot
tell apart, are an error.  An empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.sources import interim

#: Least and most pivots, the first vectors by a hash of the identifier: a bounded sample that shapes cells, never results.
PIVOTS, MOST_PIVOTS = 64, 4096
#: Vectors in a block of data and in a group of queries.
BLOCK_ROWS = 4096
QUERY_ROWS = 4096


def integer_vectors(df: DataFrame, vector: str, id: str, scale: float) -> DataFrame:
    """(id, v array<double>) of floor(scale * x) for the vectors that take part."""
    usable = F.col(vector).isNotNull() & F.col(id).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(usable).select(F.col(id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: list | pd.Series) -> np.ndarray:
    rows = list(column)
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(rows[0]) if rows else 0)


def top_k(df: DataFrame, vector: str = "embedding", id: str = "vec_id", k: int = 5, every: int = 50, scale: float = 256.0, pivots: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for every row whose identifier ``every`` divides.

    Without a number of pivots there are an eighth as many as the root of the number of rows,
    so that cells grow in number as in size.
    """
    return interim.settled(df.sparkSession, lambda: _top_k(df, vector, id, k, every, scale, pivots, block_rows, query_rows), "top-k")


def _top_k(df: DataFrame, vector: str, id: str, k: int, every: int, scale: float, pivots: int | None, block_rows: int, query_rows: int) -> DataFrame:
    spark = df.sparkSession
    vectors = integer_vectors(df, vector, id, scale)
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(df.count()) // 8))
    chosen = vectors.withColumn("dim", F.size("v")).orderBy(F.xxhash64("id"), "id").limit(pivots).select("dim", "v").collect()
    centres = {d: _matrix([r.v for r in chosen if r.dim == d]) for d in {r.dim for r in chosen}}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            cell, far, norm = np.zeros(len(rows), np.int32), np.zeros(len(rows)), np.zeros(len(rows))
            dims = np.array([len(r) for r in rows], dtype=np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.array([rows[i] for i in at], dtype=np.float64).reshape(len(at), d)
                norm[at] = np.sqrt((x * x).sum(1))
                c = centres.get(int(d), np.zeros((0, d)))
                if not len(c):
                    c = np.zeros((1, d))
                apart = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).clip(0)
                cell[at] = apart.argmin(1)
                far[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(cell), pa.array(far), pa.array(norm)], names=["id", "v", "dim", "cell", "far", "norm"])

    data = interim.stored(vectors.mapInArrow(cells, "id long, v array<double>, dim int, cell int, far double, norm double"), "vectors")
    # at most pivots rows for each dimension
    summary = data.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"), F.count_if(F.col("id") % every == 0).alias("nq")).collect()
    if any(r.norm**2 >= 2**53 for r in summary):
        raise ValueError("scores may reach 2**53")
    blocks = {(r.dim, r.cell): max(1, -(-r.n // block_rows)) for r in summary}
    first_group, groups = _query_groups(summary, query_rows)
    if not summary:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def counts_of(values: dict[tuple[int, int], int]) -> F.Column:
        return F.element_at(F.create_map(*(F.lit(x) for (d, c), n in values.items() for x in (d * 1_000_000 + c, n))), F.col("dim") * 1_000_000 + F.col("cell"))

    data = data.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), counts_of(blocks)).cast("int"))
    distinct = data.filter(F.col("id") % every == 0).groupBy("id", "v", "dim", "cell").agg(F.count("*").alias("copies")).withColumn("row", F.xxhash64("id", "v"))
    queries = interim.stored(distinct.withColumn("group", (counts_of(first_group) + F.pmod(F.xxhash64("row", F.lit(2)), counts_of(groups))).cast("int")), "queries")
    by_dim = {d: sorted((r for r in summary if r.dim == d), key=lambda r: r.cell) for d in {r.dim for r in summary}}

    def bounds(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
        own = by_dim[dim]
        c = centres.get(dim, np.zeros((0, dim)))
        c = c if len(c) else np.zeros((1, dim))
        q = np.array(rows, dtype=np.float64).reshape(len(rows), dim)
        length = np.sqrt((q * q).sum(1))[:, None]
        middle, reach = q @ c[[r.cell for r in own]].T, length * np.array([r.far for r in own])
        slack = 1e-6 * (1 + np.abs(middle) + reach)
        upper = np.minimum(middle + reach, length * np.array([r.norm for r in own])) + slack
        return middle - reach - slack, upper, [r.cell for r in own], np.array([r.n for r in own])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query the other cells that can still hold one of its k best."""
        for batch in batches:
            rows, dims, own, floors, selves = (batch.column(i).to_pylist() for i in (1, 2, 3, 4, 7))
            out_id, out_cell = [], []
            for d in set(dims):
                at = [i for i, x in enumerate(dims) if x == d]
                lower, upper, names, n = bounds([rows[i] for i in at], d)
                for j, i in enumerate(at):
                    order = np.argsort(-lower[j], kind="stable")
                    # k members besides all rows of the query's identifier
                    enough = np.searchsorted(np.cumsum(n[order]), k + selves[i])
                    floor = lower[j][order[enough]] if enough < len(order) else -np.inf
                    floor = max(floor, floors[i] if floors[i] is not None else -np.inf)
                    for c in np.flatnonzero(upper[j] >= floor):
                        if names[c] != own[i]:
                            out_id.append(i)
                            out_cell.append(names[c])
            take = pa.array(out_id, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), batch.column(5).take(take), pa.array(out_cell, pa.int32()), batch.column(6).take(take)], names=["id", "dim", "group", "cell", "row"])

    own_rows = data.filter(F.col("id") % every == 0).groupBy(F.col("id").alias("self")).agg(F.count("*").alias("selves"))
    own = queries.select("id", "dim", "group", "cell", "row")
    first = interim.stored(_searched(data, queries, own, blocks, k, counts_of), "first-scores")
    floors = _best(first, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    known = queries.join(floors, queries.id == floors.query_id, "left").join(own_rows, F.col("id") == F.col("self")).select("id", "v", "dim", "cell", F.col("floor").cast("double").alias("floor"), "group", "row", "selves")
    more = known.mapInArrow(needed, "id long, dim int, `group` int, cell int, row long")
    second = _searched(data, queries, interim.stored(more, "needed-cells"), blocks, k, counts_of)
    return _best(first.unionByName(second), k)


def _query_groups(summary: list, query_rows: int) -> tuple[dict, dict]:
    """(first group, groups) of each cell's queries: neighbouring small cells share a group, a large cell has several."""
    first, count, at, held = {}, {}, 0, 0
    for r in sorted(summary, key=lambda r: (r.dim, r.cell)):
        if held and held + r.nq > query_rows:
            at, held = at + 1, 0
        first[r.dim, r.cell], count[r.dim, r.cell] = at, max(1, -(-r.nq // query_rows))
        held += r.nq
        if count[r.dim, r.cell] > 1:
            at, held = at + count[r.dim, r.cell], 0
    return first, count


def _searched(data: DataFrame, queries: DataFrame, pairs: DataFrame, blocks: dict, k: int, counts_of) -> DataFrame:
    """The k best of each (distinct query row, data block) among the pairs (query id, its row and group; cell)."""

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, ids = _matrix(left["v"]), left["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for i in range(0, len(right), 256):
                part = right.iloc[i : i + 256]
                scores = _matrix(part["v"]) @ x.T
                scores[part["id"].to_numpy()[:, None] == ids] = -np.inf
                if (full := scores.shape[1]) > k:  # all that reach the k-th best, so that ties are decided by identifier
                    floor = np.partition(scores, full - k, axis=1)[:, full - k]
                else:
                    floor = np.full(len(part), -np.inf)
                for q, copies, row, f in zip(part["id"], part["copies"], scores, floor, strict=True):
                    hits = np.flatnonzero((row >= f) & (row > -np.inf))
                    hits = hits[np.argsort(-row[hits], kind="stable")][:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[hits], "score": row[hits].astype(np.int64), "copies": copies}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "copies": []}).astype("int64")

    places = pairs.select("id", "dim", "group", "cell", "row", F.explode(F.sequence(F.lit(0), counts_of(blocks) - 1)).alias("block"))
    tasks = places.select("dim", "group", "cell", "block").distinct()
    key = ["dim", "cell", "block", "group"]
    renewed = [F.col(c).alias(c) for c in (*key, "id", "v")]  # columns of their own for either side
    left = data.join(tasks, ["dim", "cell", "block"]).select(*renewed)
    right = places.join(queries.select("id", "row", "v", "copies"), ["id", "row"]).select(*renewed, F.col("copies").alias("copies"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(solve, "query_id long, vec_id long, score long, copies long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    repeated = scores.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    return repeated.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
