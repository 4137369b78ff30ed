"""Exact removal of long repeated substrings, by prefix-free parsing.

A string of ``length`` bytes is looked for at every byte of every text, documents apart.
Rolling-hash triggers parse the texts: the trigger of a string is the least hash of the
short words inside it (leftmost among equals), which depends on the string alone.  So
the starts of strings form phrases, one for each trigger, and a repeated string stands at
the same distance from its trigger wherever it occurs.

As in prefix-free parsing, a suffix is ordered by what stands before its phrase's
trigger and what follows.  Only equality over ``length`` bytes matters here, so ranks
of the dictionary's and the parse's suffixes are replaced by names (hashes of content),
and neighbours of equal rank by counts of equal names.  Names are refined from phrases
to stretches of starts to single starts:

1. phrase halves: the bytes that all strings of a half share (its core), named and counted;
   a half whose core is unique in the corpus has no repeated string;
2. a half that occurs whole twice or more is repeated in all its strings;
3. what is left, near the ends of repeats, is carried with its bytes: stretches of 16 starts
   are named in the same two ways, and the single strings of stretches still open.

Cores are found by 64-bit names, which only choose what is compared; content counts as
equal by 128-bit names.  Groups of copies only add to counts: nothing is collected or
paired within a group.

Null and short texts lose nothing.  A text of any length is one step of the parse, in
memory of about 100 bytes for each of its bytes.  Repeated rows are occurrences of their
own: both lose what they share.  Rows are told apart by identifier and 128 bits of their
text; rows alike in both are copies and lose the same, so repeated or null identifiers
are no harm.  An empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.llm import _vec
from pairsmith.sources import interim

LENGTH = 400
#: Bytes of a trigger word, and starts in a stretch.
WORD = 12
STRETCH = 16


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` values in a row stands, leftmost among equals, from the running minima of blocks in both directions.

    Values give their lowest bits for the place behind the start of the block that the row starts in.
    As many bits at any place and in any step: what is chosen depends on the row's values alone.
    """
    bits = np.uint64((2 * width - 1).bit_length())
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    grid = (padded >> bits << bits).reshape(blocks, width)
    grid |= np.arange(width, dtype=np.uint64)
    # a row ends in the block that it starts in, which counts by ``behind``, or in the next
    ahead = np.minimum.accumulate(grid, axis=1).ravel()[width - 1 : width - 1 + n] + np.uint64(width)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    place = (np.minimum(behind, ahead) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return np.repeat(np.arange(0, blocks * width, width), width)[:n] + place


def _halves(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each run of starts with one trigger and within one half of the distances: document, first and last start, trigger, half."""
    distances = length - WORD + 1  # 0 .. length - WORD
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    words = np.arange(len(data) - WORD + 1)
    h = _vec.range_hash(_vec.prefix_sums(data), words, words + WORD)
    trigger = _sliding_least(h, distances)
    start = np.arange(len(trigger))
    doc = np.searchsorted(at, start, side="right") - 1
    whole = start + length <= at[doc + 1]
    start, trigger, doc = start[whole], trigger[whole], doc[whole]
    half = (trigger - start) // _half_width(length)
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(trigger) != 0) | (np.diff(half) != 0) | (np.diff(doc) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return doc[first], start[first], start[last], trigger[first], half[first]


def _half_width(length: int) -> int:
    return -(-(length - WORD + 1) // 2)


def _core(trigger: int, low: int, high: int, length: int) -> tuple[int, int]:
    """The bytes that strings at distances low .. high before their trigger all hold."""
    return trigger - low, trigger - high + length


def _filter_name(view: memoryview, a: int, b: int, seed: int) -> int:
    """64 bits: equal content has equal names; others seldom, which costs work and no result."""
    return xxhash.xxh3_64_intdigest(view[a:b], seed=seed) - (1 << 63)


def _name(view: memoryview, a: int, b: int, seed: int) -> bytes:
    """128 bits, by which content counts as equal."""
    return xxhash.xxh3_128_digest(view[a:b], seed=seed)


def _halved(names: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """128-bit names as two columns of 64."""
    both = np.frombuffer(b"".join(names), dtype=np.int64)
    return pa.array(both[::2]), pa.array(both[1::2])


_NAMED = ["doc", "core", "whole", "whole2", "piece", "place"]
_WHOLE = ["core", "whole", "whole2"]


def _phrases(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    width = _half_width(length)
    for batch, data, at in _vec.steps(batches, text=1):
        doc, first, last, trigger, half = _halves(data, at, length)
        if not len(doc):
            continue
        view = memoryview(np.ascontiguousarray(data))
        core, whole = [], []
        for f, e, t, j in zip(first.tolist(), last.tolist(), trigger.tolist(), half.tolist(), strict=True):
            low, high = j * width, min((j + 1) * width - 1, length - WORD)
            core.append(_filter_name(view, *_core(t, low, high, length), 2 * j))
            # equal content at equal distances: the distances are part of the name
            whole.append(_name(view, f, e + length, (t - f) << 20 | (t - e) << 1 | 1))
        place = pa.array((first - at[doc]) << 32 | (last - first) << 16 | (trigger - first))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array(core, pa.int64()), *_halved(whole), place, place],
            names=_NAMED,
        )


def _with_repeated(rows: DataFrame, *name: str) -> DataFrame:
    """The rows whose ``name`` occurs twice or more.

    Counts are combined before their shuffle.  They are stored, so that the join has
    nothing but a shuffle on either side and a hot name can be split at run time.
    """
    counts = interim.stored(rows.groupBy(*name).agg(F.count("*").alias("n")).filter("n > 1").select(*name), f"repeated-{name[0]}")
    return rows.join(counts.hint("merge"), list(name), "left_semi")


def _settled(rows: DataFrame, length: int, step: str) -> tuple[DataFrame, DataFrame]:
    """(ranges that repeat as a whole, one row of each class still to be compared).

    Rows of one core and one whole form a class.  A class of two rows or more is settled.
    A core with a class of one row is open: one row of each of its classes goes on, the
    settled classes' as witnesses.
    """
    candidates = interim.stored(_with_repeated(rows, "core"), f"candidate-{step}")
    least = F.min(F.struct("doc", "piece", "place"))
    classes = interim.stored(candidates.groupBy(*_WHOLE).agg(F.count("*").alias("n"), least.alias("one")), f"class-{step}")
    whole = candidates.join(classes.filter("n > 1").select(*_WHOLE), _WHOLE, "left_semi")
    start, span = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(0xFFFF)
    found = whole.select("doc", start.alias("a"), (start + span + length).alias("b"))
    cores = classes.groupBy("core").agg(F.count("*").alias("c"), F.min("n").alias("n")).filter("c > 1 AND n = 1").select("core")
    return found, classes.join(cores, "core", "left_semi").select("one.*")


def _row_key(text: str) -> list[Column]:
    """128 bits of the text; with the identifier they tell rows apart."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def _same_row(other: str) -> Column:
    return F.col("id").eqNullSafe(F.col(f"{other}_id")) & (F.col("h") == F.col(f"{other}_h")) & (F.col("g") == F.col(f"{other}_g"))


def repeated_ranges(df: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(doc struct, ranges array<struct<a, b>>): bytes [a, b) to remove from each document that has any; unmerged."""
    doc = F.struct(F.col(id).alias("id"), *_row_key(text))
    rows = df.select(doc.alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["doc"].dataType.simpleString()
    named = f"doc {kind}, core long, whole long, whole2 long, piece long, place long"
    phrases = rows.filter(F.octet_length("t") >= length).mapInArrow(lambda b: _phrases(b, length), named)
    found, open_ = _settled(phrases, length, "phrases")

    # what is still open, with its bytes; a row that is there twice has no class of one row
    wanted = open_.groupBy("doc").agg(F.collect_set("place").alias("places")).select(F.col("doc.id").alias("open_id"), F.col("doc.h").alias("open_h"), F.col("doc.g").alias("open_g"), "places")
    texts = rows.select("doc.*", "t")
    joined = texts.join(wanted.hint("merge"), _same_row("open")).select(F.struct("id", "h", "g").alias("doc"), "t", "places")
    pieces = interim.stored(joined.mapInArrow(lambda b: _pieces(b, length), f"doc {kind}, piece long, bytes binary"), "open-phrases")
    more, open_ = _settled(pieces.mapInArrow(lambda b: _stretches(b, length), named), length, "stretches")
    lists = open_.groupBy("doc", "piece").agg(F.collect_set("place").alias("places"))
    single = lists.join(pieces.withColumnsRenamed({"doc": "d", "piece": "p"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("piece") == F.col("p"))).select("doc", "piece", "bytes", "places")
    strings = single.mapInArrow(lambda b: _strings(b, length), f"doc {kind}, name long, name2 long, a long")
    last = _with_repeated(interim.stored(strings, "open-strings"), "name", "name2").select("doc", "a", (F.col("a") + length).alias("b"))
    # a set: rows of one identifier and text share their ranges
    return found.unionByName(more).unionByName(last).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that the strings of each open phrase half cover."""
    for batch in batches:
        data, at = _vec.flat(batch.column(1))
        owner, places, out = [], [], []

        def made(batch=batch, owner=owner, places=places, out=out) -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(places, pa.int64()), pa.array(out, pa.binary())], names=["doc", "piece", "bytes"])
            for x in (owner, places, out):
                x.clear()
            return done

        for d, row in enumerate(batch.column(2).to_pylist()):
            for p in row:
                a = int(at[d]) + (p >> 32)
                owner.append(d)
                places.append(p)
                out.append(data[a : a + (p >> 16 & 0xFFFF) + length].tobytes())
            if len(out) >= 20_000:
                yield made()
        yield made()


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each open half cut at multiples of STRETCH of the distance to its trigger."""
    for batch in batches:
        owner, core, whole, places = [], [], [], []
        for i, (p, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
            view = memoryview(b.as_buffer())
            n, t = (p >> 16 & 0xFFFF) + 1, p & 0xFFFF  # starts, and the trigger's place behind the first of them
            f = 0
            while f < n:
                low = (t - f) // STRETCH * STRETCH
                e = min(t - low, n - 1)
                owner.append(i)
                core.append(_filter_name(view, *_core(t, low, min(low + STRETCH - 1, length - WORD), length), low << 1))
                whole.append(_name(view, f, e + length, (t - f) << 20 | (t - e) << 1 | 1))
                places.append(((p >> 32) + f) << 32 | (e - f) << 16 | (t - f))
                f = e + 1
        take = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(core, pa.int64()), *_halved(whole), batch.column(1).take(take), pa.array(places, pa.int64())], names=_NAMED)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each string of the open stretches."""
    for batch in batches:
        owner, names, starts = [], [], []
        for i, (piece, b, row) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)):
            view, base = memoryview(b.as_buffer()), piece >> 32
            for p in row:
                for f in range((p >> 32) - base, (p >> 32) - base + (p >> 16 & 0xFFFF) + 1):
                    owner.append(i)
                    names.append(_name(view, f, f + length, 0))
                    starts.append(base + f)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *_halved(names), pa.array(starts, pa.int64())], names=["doc", "name", "name2", "a"])


def without_repeats(df: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept binary) for every row."""
    ranges = interim.settled(df.sparkSession, lambda: repeated_ranges(df, text, id, length), "repeats").select(F.col("doc.id").alias("r_id"), F.col("doc.h").alias("r_h"), F.col("doc.g").alias("r_g"), "ranges")
    rows = df.select(F.col(id).alias("id"), *_row_key(text), F.coalesce(F.col(text), F.lit("")).alias("t"))
    joined = rows.join(ranges.hint("merge"), _same_row("r"), "left").select("id", "t", F.transform("ranges", lambda x: F.shiftleft(x["a"], 32).bitwiseOR(x["b"])).alias("ranges"))
    names = [id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _vec.steps(batches, text=1):
            removed, spans, digests, kept = [], [], [], []
            for d, own in enumerate(batch.column(2)):
                own_bytes = data[at[d] : at[d + 1]]
                n = len(own_bytes)
                if own.is_valid and len(own):
                    r = own.values.to_numpy()
                    change = np.bincount(r >> 32, minlength=n + 1) - np.bincount(r & 0xFFFFFFFF, minlength=n + 1)
                    gone = np.cumsum(change)[:n] > 0
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    own_bytes = own_bytes[~gone]
                else:
                    spans.append(0)
                removed.append(n - len(own_bytes))
                digests.append(hashlib.sha256(own_bytes.tobytes()).hexdigest())
                if with_bytes:
                    kept.append(own_bytes.tobytes())
            out = [batch.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.binary())] if with_bytes else out, names=names)

    kind = df.schema[id].dataType.simpleString()
    return joined.mapInArrow(cut, f"{_vec.quoted(id)} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
