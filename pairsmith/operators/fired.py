"""Which rules fire on which patterns: a prefix tree of rules, walked by whole batches of patterns.

Rules that begin alike share the path of their beginning.  A batch of patterns is narrowed
predicate by predicate along the tree, so a rule costs as much as its beginning fires, and
nothing where it does not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tree: predicate's place -> (rules that end there, the tree of those that go on).
Tree = dict[int, tuple[list[int], "Tree"]]


def tree_of(rules: Sequence[Sequence[int]]) -> tuple[list[int], Tree]:
    """(rules without a predicate, tree) of rules as places of predicates, in the order given."""
    empty: list[int] = []
    tree: Tree = {}
    for i, rule in enumerate(rules):
        ends, below = empty, tree
        for p in rule:
            ends, below = below.setdefault(p, ([], {}))
        ends.append(i)
    return empty, tree


def walk(words: Sequence[np.ndarray], word_bits: int, root: tuple[list[int], Tree]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(rules, rows they fire on) for each node of the tree where some row is left; words: the patterns' bits."""
    columns: dict[int, np.ndarray] = {}

    def holds(p: int) -> np.ndarray:
        if p not in columns:
            columns[p] = (words[p // word_bits] >> np.int64(p % word_bits) & 1).astype(bool)
        return columns[p]

    todo = [(root[1], np.arange(len(words[0])))]
    if root[0]:
        yield root[0], todo[0][1]
    while todo:
        tree, rows = todo.pop()
        for p, (ends, below) in tree.items():
            own = rows[holds(p)[rows]]
            if len(own):
                if ends:
                    yield ends, own
                if below:
                    todo.append((below, own))


def counted(table: DataFrame, columns: Sequence[str], word_bits: int, rules: Sequence[Sequence[int]]) -> DataFrame:
    """(rule_id, tp, pp) sums over the table's patterns for the rules that fire on any.  table: (columns, n_pos, n)."""
    root, n_words = tree_of(rules), len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tp, pp = np.zeros(len(rules), dtype=np.int64), np.zeros(len(rules), dtype=np.int64)
        for batch in batches:
            words = [batch.column(w).to_numpy() for w in range(n_words)]
            n_pos, n = (batch.column(n_words + k).to_numpy() for k in (0, 1))
            for ends, own in walk(words, word_bits, root):
                tp[ends] += n_pos[own].sum()
                pp[ends] += n[own].sum()
        some = np.flatnonzero(pp)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(tp[some]), pa.array(pp[some])], names=["rule_id", "tp", "pp"])

    rows = table.select(*columns, F.col("n_pos").cast("long"), F.col("n").cast("long"))
    return rows.mapInArrow(sums, "rule_id int, tp long, pp long").groupBy("rule_id").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"))


def indexed(table: DataFrame, columns: Sequence[str], word_bits: int, rules: Sequence[Sequence[int]]) -> DataFrame:
    """(rules, n_pos, n): the sorted rules that fire on each pattern; patterns with the same rules are one row, those with none go."""
    root, n_words = tree_of(rules), len(columns)

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(own, r) for ends, own in walk([batch.column(w).to_numpy() for w in range(n_words)], word_bits, root) for r in ends]
            if not found:
                continue
            rows = np.concatenate([own for own, _ in found])
            ids = np.repeat(np.array([r for _, r in found], dtype=np.int32), [len(own) for own, _ in found])
            order = np.lexsort((ids, rows))
            some, sizes = np.unique(rows, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids[order]))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(n_words + k).take(pa.array(some)) for k in (0, 1))], names=["rules", "n_pos", "n"])

    rows = table.select(*columns, F.col("n_pos").cast("long"), F.col("n").cast("long"))
    return rows.mapInArrow(fired, "rules array<int>, n_pos long, n long").groupBy("rules").agg(F.sum("n_pos").alias("n_pos"), F.sum("n").alias("n"))
