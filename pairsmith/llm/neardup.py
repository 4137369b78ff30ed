"""Near-duplicates by word shingles: a MinHash LSH forest with exact verification.

Documents of one shingle set form a class; classes stand for their members.  Each class
has a label in each tree of the forest: the low bytes of ``LABEL`` min-hashes, packed
into 64 bits.  The labels of a tree in sorted order are a prefix trie: neighbours share
the longest prefixes, and a node of depth d is a run of rows that agree in their first d
bytes.  The prefix that two classes must share to meet is shortened from the whole label
until the trees together find a pair of the threshold similarity with the target recall
(``depth_for``); the bound must hold at the threshold, so it needs no data.  All trees
are sorted in one range partitioning by tree, label and class, so a frequent prefix is
cut at any place, and one pass over the rows links each to the first of its run; runs
that go on in the next partition are linked through a row for each partition's edge.

Linked classes form candidate groups (connected components, never pairs).  A group is
dealt into blocks, and blocks that share a node are verified against each other by exact
set intersection.  A verified block returns, for each member, how many documents it is
linked with and the least class it is connected to.

Words are runs of characters other than ASCII white space, as they are.  A text of fewer
words than a shingle is one shingle of all its words; a text without words (or null) is
linked to nothing.  A text of any length is one row and is held whole by the task that
signs or verifies it.  Repeated rows are copies: their class holds them all; of equally
good representatives the least identifier is taken.  An empty table gives an empty table.
Other columns are not read (``one_of_each``: they travel in a struct and cannot clash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsmith.llm import _vec
from pairsmith.operators.components import connected_components
from pairsmith.sources import interim

WORDS = 5
SIMILARITY = 0.8
TREES = 24
LABEL = 8  # bytes
RECALL = 0.999
#: Classes and shingles in a block of a candidate group.
BLOCK_CLASSES = 192
BLOCK_SHINGLES = 300_000
#: Classes that are compared pair by pair rather than by a matrix product.
FEW = 6


def depth_for(similarity: float, recall: float, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix with which pairs of that similarity meet in some tree with that probability."""
    for depth in range(label, 1, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch in ascending order within each document, and len + 1 offsets."""
    start, end = _vec.word_ranges(data, at)
    h = _vec.range_hash(_vec.prefix_sums(data), start, end)
    sums = _vec.prefix_sums(h)
    first = np.searchsorted(start, at)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    begin = first[owner] + np.arange(offsets[-1]) - offsets[owner]
    s = _vec.range_hash(sums, begin, begin + np.minimum(words, n[owner]))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(n) + 1))


def _signed_batches(batches: Iterator[pa.RecordBatch], words: int, trees: int) -> Iterator[pa.RecordBatch]:
    """(doc, class hash, shingles, label in each tree); nulls for documents without words."""
    rng = np.random.default_rng(7)
    factors, shifts = rng.integers(0, 2**31, (trees, LABEL), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (trees, LABEL), dtype=np.uint32)
    for batch, data, at in _vec.steps(batches):
        s, offsets = shingles(data, at, words)
        docs, none = np.flatnonzero(np.diff(offsets)), np.flatnonzero(np.diff(offsets) == 0)
        if len(none):
            nulls = [pa.nulls(len(none), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(none)), *nulls], names=["doc", "class", "n", "labels"])
        if not len(docs):
            continue
        begin = offsets[docs]
        same = _vec.range_hash(_vec.prefix_sums(s), begin, offsets[docs + 1])
        high = (s >> np.uint64(32)).astype(np.uint32)
        turned = np.empty_like(high)
        labels = np.zeros((len(docs), trees), dtype=np.uint64)
        for t in range(trees):
            for k in range(LABEL):
                np.bitwise_xor(high, shifts[t, k], out=turned)
                np.multiply(turned, factors[t, k], out=turned)
                least = np.minimum.reduceat(turned, begin) * np.uint32(0x9E3779B1)
                labels[:, t] = labels[:, t] << np.uint64(8) | (least >> np.uint32(24))
        flat = pa.array(_vec.signed(labels.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(docs)), pa.array(_vec.signed(same)), pa.array(np.diff(offsets)[docs]), pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1, dtype=np.int32) * trees), flat)],
            names=["doc", "class", "n", "labels"],
        )


def _meetings(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(class, node, head, edge) of the rows (tree, label, class), sorted, that share ``depth`` bytes of their label with a neighbour.

    head: the first class of the node in this partition; edge: the heads of the
    partition's first and last node, which may go on beside it.
    """

    def made(cls: np.ndarray, node: np.ndarray, head: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(_vec.signed(node)), pa.array(head), pa.array(edge)], names=["class", "node", "head", "edge"])

    shift = np.uint64(8 * (LABEL - depth))
    kept: tuple | None = None  # class, node and head of the last row so far, whether it was given out and whether its node is the first
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, label, cls = (batch.column(i).to_numpy() for i in range(3))
        node = _vec.mix((label.view(np.uint64) >> shift) * np.uint64(_vec.BASE) + tree.astype(np.uint64))
        first = kept is None
        if kept:
            cls, node = np.append(kept[0], cls), np.append(kept[1], node)
        new = np.ones(len(cls), bool)
        new[1:] = node[1:] != node[:-1]
        run = np.cumsum(new) - 1
        head = cls[new][run]
        shared = ~new
        shared[:-1] |= ~new[1:]
        edge = np.zeros(len(cls), bool)
        if kept:
            head[run == 0] = kept[2]
            shared[0] &= not kept[3]
        if first:
            edge[0] = shared[0] = True
        last = (cls[-1:], node[-1:], head[-1], bool(shared[-1] or (kept and len(cls) == 1 and kept[3])))
        kept = last
        yield made(cls[shared], node[shared], head[shared], edge[shared])
    if kept:
        cls, node, head, given = kept
        yield made(cls, node, np.array([head]), np.array([True]))


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    trees: int = TREES,
    block_classes: int = BLOCK_CLASSES,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc struct<id, h>, rep_id, class_id, n_links) for every row.

    rep_id: the least identifier of equal shingle sets; class_id: of all documents
    connected by links; n_links: other documents with the similarity or more.
    """
    return interim.settled(df.sparkSession, lambda: _near_duplicates(df, text, id, words, similarity, depth_for(similarity, recall, trees), trees, block_classes, block_shingles), "near-duplicates")


def text_components(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(h, component) for every text with words: the hash of the text and of the documents connected to it by links."""

    def make() -> DataFrame:
        signed, facts = _class_facts(df, text, id, WORDS, SIMILARITY, depth_for(SIMILARITY, RECALL), TREES, BLOCK_CLASSES, BLOCK_SHINGLES)
        # equal texts are of one class: copies go before the join
        return signed.filter("class IS NOT NULL").groupBy(F.col("doc.h").alias("h")).agg(F.min("class").alias("class")).join(facts.select("class", "component"), "class").select("h", "component")

    return interim.settled(df.sparkSession, make, "text-components")


def _near_duplicates(df: DataFrame, text: str, id: str, words: int, similarity: float, depth: int, trees: int, block_classes: int, block_shingles: int) -> DataFrame:
    signed, facts = _class_facts(df, text, id, words, similarity, depth, trees, block_classes, block_shingles)
    least = facts.groupBy("component").agg(F.min("rep_id").alias("class_id"))
    facts = facts.join(least, "component").select("class", "rep_id", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = signed.select("doc", "class").join(facts, "class").drop("class")
    none = signed.filter("class IS NULL").select("doc", F.col("doc.id").alias("rep_id"), F.col("doc.id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(none)


def _class_facts(df: DataFrame, text: str, id: str, words: int, similarity: float, depth: int, trees: int, block_classes: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and for each class its size, least identifier, links and component."""
    doc = F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("h"))
    rows = df.select(doc.alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["doc"].dataType.simpleString()
    signed = interim.stored(rows.mapInArrow(lambda b: _signed_batches(b, words, trees), f"doc {kind}, class long, n long, labels array<long>"), "signatures")
    classes = interim.stored(signed.filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("size"), F.min("doc").alias("rep"), F.max("n").alias("n"), F.max("labels").alias("labels")), "classes")

    tries = classes.select("class", F.posexplode("labels").alias("tree", "label")).select("tree", "label", "class").repartitionByRange("tree", "label", "class").sortWithinPartitions("tree", "label", "class")
    meetings = interim.stored(tries.mapInArrow(lambda b: _meetings(b, depth), "class long, node long, head long, edge boolean"), "meetings")
    # a few rows for each partition
    edges = meetings.filter("edge")
    across = edges.join(edges.groupBy("node").agg(F.min("head").alias("least")), "node").select("head", "least").filter("head <> least")
    links = meetings.filter("class <> head").select("class", "head").unionByName(across.select(F.col("head").alias("class"), F.col("least").alias("head")))
    groups = connected_components(links, "class", "head").select(F.col("node").alias("class"), F.col("component").alias("grp"))
    members = classes.select("class", "size", "rep", "n").join(groups, "class")
    sizes = members.groupBy("grp").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("grp", F.greatest(F.ceil(F.col("c") / block_classes), F.ceil(F.col("s") / block_shingles)).cast("int").alias("blocks"))
    members = interim.stored(members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "members")

    # which blocks of a group are compared: those that share a node
    large = meetings.join(members.filter("blocks > 1").select("class", "grp", "block"), "class")
    met = large.groupBy("grp", "node").agg(F.collect_set("block").alias("b"))
    pairs = met.select("grp", F.explode("b").alias("i"), "b").select("grp", "i", F.explode("b").alias("j")).filter("i <= j").distinct()
    whole = members.filter("blocks = 1").select("grp", F.lit(0).alias("i"), F.lit(0).alias("j")).distinct()
    tasks = interim.stored(whole.unionByName(pairs), "tasks")
    sides = tasks.select("grp", F.col("i").alias("block"), "i", "j").unionByName(tasks.filter("i < j").select("grp", F.col("j").alias("block"), "i", "j"))

    texts = rows.select(F.col("doc.id").alias("id"), F.col("doc.h").alias("h"), "t")
    reps = members.select("grp", "block", "class", "size", F.col("rep.id").alias("rep_id"), F.col("rep.h").alias("rep_h"))
    with_text = texts.join(reps.hint("merge"), F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("h") == F.col("rep_h"))).select("grp", "block", "class", "size", "t")
    # a row that is there twice has one class but two rows
    to_verify = with_text.join(sides, ["grp", "block"]).select("grp", "i", "j", "block", "class", "size", "t")
    sorted_tasks = to_verify.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "class")
    verified = interim.stored(sorted_tasks.mapInArrow(lambda b: _verified(b, words, similarity), "class long, links long, root long"), "links")

    linked = verified.groupBy("class").agg(F.sum("links").alias("links"))
    joined = connected_components(verified, "class", "root")
    facts = classes.select("class", "size", F.col("rep.id").alias("rep_id")).join(joined.select(F.col("node").alias("class"), "component"), "class", "left").join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    return signed, interim.stored(facts, "class-facts")


def _verified(batches: Iterator[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(class, links, root) for the linked classes of each run of rows (grp, i, j, block, class, size, t) with one task."""
    task: list = []  # shingle sets and (block, class, size) of a task's classes so far
    key, out = None, []

    def closed() -> None:
        if len(task) > 1:
            sets = [s for s, _ in task]
            block, cls, size = np.array([facts for _, facts in task], dtype=np.int64).T
            linked = _linked(sets, similarity, block if key[1] != key[2] else None)
            links = linked.astype(np.int64) @ size
            has = links > 0
            if has.any():
                out.append((cls[has], links[has], cls[_least_connected(linked)[has]]))
        task.clear()

    def found() -> pa.RecordBatch:
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["class", "links", "root"])

    for batch, data, at in _vec.steps(batches, text=6):
        s, offsets = shingles(data, at, words)
        rows = zip(*(batch.column(k).to_pylist() for k in range(6)), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        for grp, i, j, block, cls, size, a, b in rows:
            if (grp, i, j) != key:
                closed()
                key = (grp, i, j)
            if not task or task[-1][1][1] != cls:  # a row that is there twice is one class
                task.append((s[a:b], (block, cls, size)))
        yield found()
    closed()
    yield found()


def _linked(sets: list[np.ndarray], similarity: float, block: np.ndarray | None) -> np.ndarray:
    """Which of the sorted sets have the similarity or more; with blocks only those of different ones, as each pair of one block is another task's."""
    n = np.array([len(s) for s in sets])
    if len(sets) <= FEW:
        linked = np.zeros((len(n), len(n)), bool)
        for i in range(len(n)):
            for j in range(i):
                least, most = sorted((n[i], n[j]))
                if least >= similarity * most - 1e-6 and (block is None or block[i] != block[j]):
                    both = np.concatenate([sets[i], sets[j]])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    linked[i, j] = linked[j, i] = common >= similarity * (n[i] + n[j] - common) - 1e-6
        return linked
    owner = np.repeat(np.arange(len(n)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(n), len(n)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        m = np.zeros((len(n), width), dtype=np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        common += m @ m.T
    linked = common >= similarity * (n[:, None] + n[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    return linked if block is None else linked & (block[:, None] != block[None, :])


def _least_connected(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that links connect it to."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def one_of_each(df: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of df whose identifier is the least of all that links connect them to.

    Columns are those of df; texts without words all stay.  Rows of one identifier and
    text are one document and stay or go together.
    """
    found = near_duplicates(df, text, id, **options)
    keep = found.filter(F.col("doc.id").eqNullSafe(F.col("class_id"))).select(F.col("doc.id").alias("keep_id"), F.col("doc.h").alias("keep_h"))
    rows = df.select(F.struct("*").alias("row"), F.col(id).alias("id"), F.xxhash64(text).alias("h"))
    return rows.join(keep.hint("merge"), F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")), "left_semi").select("row.*")
