"""Line deduplication by a fixed-depth template tree.

A line goes down a tree of fixed depth: by its number of tokens, then by its ``DEPTH``
leading tokens, where a token with a digit counts as a variable field; lines with a field
that early go down a second tree, by their last tokens.  Within a leaf, tokens are counted
for each place: a token that stands there in many of the leaf's texts is constant, the
others are fields of any kind.  Lines that agree in their constant tokens are of one
template, whatever their fields hold.  A line of more than ``SLOTS`` tokens has as many
places, each with a stretch of them.  So a template is a key, not a cluster that someone
has to hold: one for the line as it is, with digits as fields, and one for each leaf and
each share of a leaf's texts (``SHARES``) that makes a token constant.  At most
``max(SHARES)`` tokens of a place have such a share, which bounds what is known of a leaf.

A template needs constant tokens: one for each ``TOKENS_PER_CONSTANT`` tokens where digits
are fields (lines with fewer, such as rows of numbers, count as they are, so distinct data
are never one template), and two thirds of the places, at least ``LEAST_CONSTANT``, where
words are.

Copies are not recurrence: they are left whole for near-duplicate removal.  Documents
that verified near-duplicate links connect (``neardup``), among those with a template in
texts enough, are one origin, whatever passages unlike documents share.  A template recurs if it has ``min_documents`` origins or more.
Its lines are dropped everywhere but in the document of the least identifier (and its
exact copies).

Lines of fewer than ``min_bytes`` bytes recur by chance: a template that has only such
lines needs ``short_documents`` origins.  Length is in
bytes, so lines of scripts without spaces count as others do.  A line of fewer than
``min_tokens`` tokens or ``min_bytes`` bytes counts if it has a letter (or any non-ASCII
character); one without, such as a brace or a number, is never dropped.  Null text has no lines and
stays null.  A text of any length is one step, in memory of about 100 bytes for each of
its bytes.  Of documents of equal identifiers the text of the lesser hash keeps a line.  Repeated rows are copies of one document.  An empty table gives an empty
table.  Other columns travel in a struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsmith.llm import _vec, neardup
from pairsmith.sources import interim

MIN_DOCUMENTS = 3
MIN_TOKENS = 3
MIN_BYTES = 20
#: Origins that templates of lines shorter than MIN_BYTES need.
SHORT_DOCUMENTS = 10
#: Leading (or last) tokens that choose a leaf, and the least tokens of a line with fields that are words.
DEPTH = 3
OPEN_TOKENS = 6
#: Places of a line at most, and of how many of a leaf's texts one has a constant token in its place.
SLOTS = 16
SHARES = (4, 32)
#: Constant places that a template with word fields has at least, besides two thirds of them.
LEAST_CONSTANT = 5
#: Tokens of a template for each constant one at most.
TOKENS_PER_CONSTANT = 3
_FIELD = np.uint64(0x5EED)
_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _keyed_lines(batches: Iterator[pa.RecordBatch], min_tokens: int, min_bytes: int) -> Iterator[pa.RecordBatch]:
    """(key of the document, class of its text, line, whether it is short, key of the whole line, its leaves, its places) of the lines that count."""
    for batch, data, at in _vec.steps(batches, text=2):
        breaks = np.flatnonzero(data == 10) + 1
        line_start = np.unique(np.concatenate([at[:-1], breaks[breaks < len(data)]])) if len(data) else np.zeros(0, np.int64)
        start, end = _vec.word_ranges(data, at)
        if not len(start):
            continue
        h = _vec.range_hash(_vec.prefix_sums(data), start, end)
        is_field = np.logical_or.reduceat(_DIGIT[data], start)  # what stands between words is no digit
        exact = _vec.prefix_sums(h)
        h[is_field] = _FIELD
        constants = np.concatenate([[0], np.cumsum(~is_field)])
        first = np.searchsorted(start, line_start)
        n = np.diff(np.append(first, len(start)))
        last = first + n - 1
        width = np.where(n > 0, end[last.clip(0)] - start[first.clip(max=len(start) - 1)], 0)
        worded = np.zeros(len(n), bool)
        in_text = line_start < len(data)  # empty texts may stand at the end
        worded[in_text] = np.logical_or.reduceat(_LETTER[data], line_start[in_text])
        chosen = np.flatnonzero((n >= 1) & (worded | (n >= min_tokens) & (width >= min_bytes)))
        if not len(chosen):
            continue
        first, n = first[chosen], n[chosen]
        sums = _vec.prefix_sums(h)
        generic = (constants[first + n] - constants[first]) * TOKENS_PER_CONSTANT >= n

        def tokens(begin: np.ndarray, stop: np.ndarray, generic: np.ndarray, sums=sums, exact=exact) -> np.ndarray:
            return np.where(generic, _vec.range_hash(sums, begin, stop), _vec.range_hash(exact, begin, stop))

        key = _vec.mix(tokens(first, first + n, generic) * np.uint64(_vec.BASE) + n.astype(np.uint64))
        opened = n >= OPEN_TOKENS
        ends = [tokens(first, first + np.minimum(n, DEPTH), generic), tokens(first + np.maximum(n - DEPTH, 0), first + n, generic)]
        leaves = np.stack([_vec.mix(h * np.uint64(_vec.BASE) + (2 * n + k).astype(np.uint64)) for k, h in enumerate(ends)], axis=1)
        slots = np.where(opened, np.minimum(n, SLOTS), 0)
        offsets = np.concatenate([[0], np.cumsum(slots)])
        line_of = np.repeat(np.arange(len(n)), slots)
        place = np.arange(offsets[-1]) - offsets[line_of]
        cut = lambda k, first=first, n=n, line_of=line_of, slots=slots: first[line_of] + n[line_of] * k // slots[line_of]
        placed = (_vec.mix(tokens(cut(place), cut(place + 1), generic[line_of])) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        doc = np.searchsorted(at[1:], line_start[chosen], side="right")
        line = chosen - np.searchsorted(line_start, at)[doc]
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k).take(take) for k in (0, 1)),
                pa.array(line.astype(np.int32)),
                pa.array(width[chosen] < min_bytes),
                pa.array(_vec.signed(key)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * opened)]).astype(np.int32)), pa.array(_vec.signed(leaves[opened].ravel()))),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(placed)),
            ],
            names=["doc", "class", "line", "short", "key", "leaves", "places"],
        )


def _differing(lines: DataFrame, key: str, *values: str) -> DataFrame:
    """The rows whose key has more than one of each value: most have one only; min and max tell, whatever the key's size."""
    ends = [f(v).alias(f"{f.__name__} {v}") for v in values for f in (F.min, F.max)]
    differ = " AND ".join(f"`min {v}` <> `max {v}`" for v in values)
    keys = interim.stored(lines.groupBy(key).agg(*ends).filter(differ).select(key), "keys")
    return lines.join(keys.hint("merge"), key, "left_semi")


def _with_fields(lines: DataFrame, min_documents: int) -> DataFrame:
    """(doc, class, line, short, key) of the lines of leaves in texts enough, with what is not constant in them left out of the key.

    A leaf of one line only, in whatever many texts, has no fields and is left out first.
    """
    each = lines.filter(F.size("leaves") > 0).select("doc", "class", "line", "short", "places", "key", F.explode("leaves").alias("leaf"))
    own = interim.stored(_differing(each, "leaf", "class", "key").drop("key"), "leaf-lines")
    # at each place, and for the leaf itself at place -1, the texts that have a token
    placed = own.select("leaf", "class", F.posexplode("places").alias("place", "token")).unionByName(own.select("leaf", "class", F.lit(-1).alias("place"), F.lit(0).alias("token")))
    texts = placed.distinct().groupBy("leaf", "place", "token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents)
    held = lambda share: F.transform(F.filter("found", lambda x: (x["place"] >= 0) & (x["n"] * share >= F.col("all"))), lambda x: F.shiftleft(x["place"].cast("long"), 32) + x["token"])
    # tokens too rare for any share go before the leaf's are brought together
    common = texts.join(texts.filter("place = -1").select("leaf", F.col("n").alias("all")), "leaf").filter((F.col("n") * max(SHARES) >= F.col("all")) & (F.col("place") >= 0))
    found = common.groupBy("leaf").agg(F.max("all").alias("all"), F.collect_list(F.struct("place", "token", "n")).alias("found"))
    leaves = interim.stored(found.select("leaf", *(held(s).alias(f"share{s}") for s in SHARES)), "leaf-tokens")
    joined = own.join(leaves.hint("merge"), "leaf")
    out = None
    for share in SHARES:
        is_held = lambda x, i: F.array_contains(F.col(f"share{share}"), F.shiftleft(i.cast("long"), 32) + x)  # noqa: B023, E731
        masked = joined.select("doc", "class", "line", "short", "leaf", F.transform("places", lambda x, i: F.when(is_held(x, i), x)).alias("left"))  # noqa: B023
        constant = F.size(F.filter("left", lambda x: x.isNotNull()))
        enough = (constant >= LEAST_CONSTANT) & (3 * constant >= 2 * F.size("left")) & (constant < F.size("left"))
        keyed = masked.filter(enough).select("doc", "class", "line", "short", F.xxhash64(F.lit(share), "leaf", F.transform("left", lambda x, i: F.when(x.isNotNull(), F.struct(i, x)))).alias("key"))
        out = keyed if out is None else out.unionByName(keyed)
    return out


def recurring_lines(df: DataFrame, text: str = "text", id: str = "doc_id", min_documents: int = MIN_DOCUMENTS, min_tokens: int = MIN_TOKENS, min_bytes: int = MIN_BYTES, short_documents: int = SHORT_DOCUMENTS) -> DataFrame:
    """(doc struct, drop array<int>): the lines to drop, counted from 0, of the documents that have any."""
    doc = F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("h"))
    rows = df.select(doc.alias("doc"), F.xxhash64(text).alias("class"), F.col(text).alias("t"))
    kind = rows.schema["doc"].dataType.simpleString()
    lines = interim.stored(rows.mapInArrow(lambda b: _keyed_lines(b, min_tokens, min_bytes), f"doc {kind}, class long, line int, short boolean, key long, leaves array<long>, places array<int>"), "lines")
    whole = _differing(lines.select("doc", "class", "line", "short", "key"), "key", "class")
    keyed = interim.stored(whole.unionByName(_with_fields(lines, min_documents)), "template-keys")
    # one row for each key and text: a key of many copies shrinks before it is counted
    texts = interim.stored(keyed.groupBy("key", "class").agg(F.min("doc").alias("doc"), F.min("short").alias("short")), "template-texts")
    # a template is short if all its lines are
    needed = F.when(F.min("short"), max(min_documents, short_documents)).otherwise(min_documents)
    frequent = interim.stored(texts.groupBy("key").agg(F.count("*").alias("n"), needed.alias("needed")).filter("n >= needed").select("key", "needed"), "frequent-templates")
    texts = interim.stored(texts.join(frequent.hint("merge"), "key").select("key", "class", "doc", "needed"), "frequent-template-texts")
    # origins matter for texts of these templates only
    wanted = interim.stored(texts.select(F.col("class").alias("wanted")).distinct(), "wanted-texts")
    sharing = df.select(F.col(id), F.col(text)).join(wanted.hint("merge"), F.xxhash64(text) == F.col("wanted"), "left_semi")
    origins = neardup.text_components(sharing, text, id).select(F.col("h").alias("class"), F.col("component").alias("origin"))
    counted = texts.join(origins.hint("merge"), "class").groupBy("key", "origin").agg(F.min(F.struct("doc", "class")).alias("first"), F.first("needed").alias("needed")).groupBy("key").agg(F.count("*").alias("origins"), F.min("first").alias("first"), F.first("needed").alias("needed"))
    templates = interim.stored(counted.filter("origins >= needed").select("key", F.col("first.class").alias("first")), "templates")
    dropped = keyed.join(templates.hint("merge"), "key").filter(F.col("class") != F.col("first"))
    return dropped.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("drop"))


def without_recurring_lines(df: DataFrame, text: str = "text", id: str = "doc_id", min_documents: int = MIN_DOCUMENTS, min_tokens: int = MIN_TOKENS, min_bytes: int = MIN_BYTES, short_documents: int = SHORT_DOCUMENTS) -> DataFrame:
    """(row struct, t, n_lines, n_dropped): t is the text without the dropped lines."""
    drops = interim.settled(df.sparkSession, lambda: recurring_lines(df, text, id, min_documents, min_tokens, min_bytes, short_documents), "dropped-lines").select(F.col("doc.id").alias("drop_id"), F.col("doc.h").alias("drop_h"), "drop")
    rows = df.select(F.struct("*").alias("row"), F.col(id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    # the same join at every size: both sides dealt by document
    joined = rows.join(drops.hint("merge"), F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("h") == F.col("drop_h")), "left")
    lines = F.split("t", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n")
    n_lines = F.when(F.col("t").isNull(), 0).otherwise(F.size(lines))
    return joined.select("row", F.when(F.col("drop").isNull(), F.col("t")).otherwise(left).alias("t"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
