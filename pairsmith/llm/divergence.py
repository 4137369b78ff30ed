"""How the sources of a language differ in their terms: sketch-prefiltered counting and sparse pair joins.

1. Every task counts the documents of each (language, term) into a count-min sketch.  The
   sketches are merged block by block in a stream; merged counters are never below the true
   number of documents, as each is a sum of numbers that are not.  What is kept of a counter
   is one bit, whether it reaches the threshold, so the bits have a fixed size and go to
   every task.
2. A term of which some counter stays below the threshold cannot be frequent and is left out
   before anything is shuffled.  The survivors are counted exactly, by (language, source,
   term), and those that the sketch let through wrongly go by their exact numbers.
3. Two sources differ at a term by the distance of their shares.  Terms that both lack differ
   by the same amount, terms that one lacks by an amount that depends on its count alone, so
   only terms that both have are joined; all else follows from histograms of counts.

The sketch's size is a parameter: too small, it lets more terms through, and results stay.

Null text, language and source count as ''.  A text has the terms of its whole; a document
without terms still makes its (language, source) occur.  Repeated rows count as often as
they are there.  Ties in value are ordered by item, by UTF-8 bytes.  A language without
frequent terms has pairs of value 0 and no term rows; one of a single source has no pairs.
An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.functions.predicates import named
from pairsmith.sources import interim

#: Counters in a row of the sketch, and rows: 16 MB for each row while a task counts, half a MB of bits after.
SKETCH_WIDTH = 1 << 22
SKETCH_ROWS = 3
_BLOCK = 1 << 13
#: Bytes of text that a task looks at together.
_BYTES_AT_ONCE = 8 << 20
_SALTS = 16
#: Letters, with A-Z as a-z, and all bytes of characters beyond ASCII stay; the rest divides terms.
_TERM_BYTES = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], dtype=np.uint8)


def _hashes(lang: str, terms: list[str]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), dtype=np.uint64, count=len(terms))


def _cells(hashes: np.ndarray, width: int, rows: int) -> np.ndarray:
    """The counter of each hash in every row of the sketch, one row of the result for each."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * mixed) % np.uint64(width) + np.uint64(i * width) for i in range(rows)]).astype(np.int64)


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, the document of each (document, term), its term, how often): of texts without nulls, in arrays throughout."""
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    clean = pa.StringArray.from_buffers(n, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_TERM_BYTES[data]))
    words = pc.ascii_split_whitespace(clean)
    found = words.flatten().dictionary_encode()
    codes = found.indices.to_numpy().astype(np.int64)
    docs = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
    if (blank := found.dictionary.index("").as_py()) >= 0:
        docs, codes = docs[codes != blank], codes[codes != blank]
    pairs, times = np.unique(docs * len(found.dictionary) + codes, return_counts=True)
    return found.dictionary, *np.divmod(pairs, max(1, len(found.dictionary))), times


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some rows of a batch at a time, so that their texts are few bytes or one text."""
    ends = np.frombuffer(batch.column("text").buffers()[1], dtype=np.int32)[batch.column("text").offset :][: batch.num_rows + 1]
    first = 0
    while first < batch.num_rows:
        after = max(first + 1, int(np.searchsorted(ends, ends[first] + _BYTES_AT_ONCE, side="right")) - 1)
        yield batch.slice(first, after - first)
        first = after


def _coded(values: pa.Array) -> tuple[list[str], np.ndarray]:
    found = values.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


def _fields(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    empty = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    return df.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))


def frequent_bits(df: DataFrame, min_docs: int, width: int = SKETCH_WIDTH, rows: int = SKETCH_ROWS) -> np.ndarray:
    """One bit for each counter of the merged sketch, packed: whether it reaches ``min_docs``.  df: (lang, source, text)."""
    if width % _BLOCK:
        raise ValueError(f"the width is a multiple of {_BLOCK}")
    kind = np.uint8 if min_docs < 256 else np.int32
    n_blocks = width // _BLOCK

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, counters) of this task's documents, counters no greater than the threshold."""
        counters = np.zeros(rows * width, dtype=np.int32)
        for batch in batches:
            for part in _slices(batch):
                langs, lang_of = _coded(part.column("lang"))
                words, docs, codes, _ = _split(part.column("text"))
                found, n = np.unique(lang_of[docs] * len(words) + codes, return_counts=True)
                for k, lang in enumerate(langs):
                    own = found // max(1, len(words)) == k
                    terms = words.take(pa.array(found[own] % max(1, len(words)))).to_pylist()
                    for row in _cells(_hashes(lang, terms), width, rows):
                        np.add.at(counters, row, n[own].astype(np.int32))
        blocks = np.minimum(counters, min_docs).astype(kind).reshape(-1, _BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        for first in range(0, len(some), 256):
            own = some[first : first + 256]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([blocks[i].tobytes() for i in own], pa.binary())], names=["block", "counters"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums in a stream: this task holds one array for each of its blocks, however many sketches there are."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counters in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counters.as_buffer(), dtype=kind).astype(np.int32)
                sums[block] = np.minimum(sums[block] + own, min_docs) if block in sums else own
        bits = [np.packbits(s >= min_docs).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])

    parts = df.select("lang", "text").mapInArrow(sketched, "block int, counters binary").repartition("block").mapInArrow(merged, "block int, bits binary")
    bits = np.zeros((rows * n_blocks, _BLOCK // 8), dtype=np.uint8)
    for r in parts.toLocalIterator():  # rows * width bits in all
        bits[r.block] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits.reshape(-1)


def term_counts(df: DataFrame, min_docs: int = 30, width: int = SKETCH_WIDTH, rows: int = SKETCH_ROWS) -> DataFrame:
    """(lang, source, term, n, n_lang): exact occurrences of each language's frequent terms, in a source that has them and in the language.  df: (lang, source, text)."""
    bits = df.sparkSession.sparkContext.broadcast(frequent_bits(df, min_docs, width, rows))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs) of the terms that the sketch doesn't rule out, summed over some documents at a time."""
        frequent = bits.value
        for batch in batches:
            for part in _slices(batch):
                langs, lang_of = _coded(part.column("lang"))
                sources, source_of = _coded(part.column("source"))
                words, docs, codes, times = _split(part.column("text"))
                possible = np.zeros((len(langs), len(words)), dtype=bool)
                for k, lang in enumerate(langs):
                    own = np.unique(codes[lang_of[docs] == k])
                    cells = _cells(_hashes(lang, words.take(pa.array(own)).to_pylist()), width, rows)
                    possible[k, own] = (frequent[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).all(axis=0)
                kept = possible[lang_of[docs], codes]
                docs, codes, times = docs[kept], codes[kept], times[kept]
                if not len(docs):
                    continue
                groups = lang_of * len(sources) + source_of
                order = np.argsort(key := groups[docs] * len(words) + codes, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                group, code = np.divmod(key[order][first], len(words))
                columns = [pa.array(langs).take(pa.array(group // len(sources))), pa.array(sources).take(pa.array(group % len(sources))), words.take(pa.array(code))]
                sums = [np.add.reduceat(times[order], first), np.diff(first, append=len(order))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.astype(np.int64)) for x in sums)], names=["lang", "source", "term", "n", "docs"])

    survivors = df.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    # dealt by term once, for the counts by source and those of the language
    exact = survivors.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    return exact.withColumns({"n_lang": F.sum("n").over(w), "docs": F.sum("docs").over(w)}).filter(F.col("docs") >= min_docs).drop("docs")


def _share(count: str, total: str, scale: int, prior: int) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * n_terms)), exactly; null where there are no terms."""
    return F.expr(f"cast(1 + (cast({scale} AS decimal(20,0)) * (cast({count} AS decimal(18,0)) + {prior})) div nullif(cast({total} AS decimal(20,0)) + {prior} * cast(n_terms AS decimal(18,0)), 0) AS long)")


def _pairs(p: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each two sources of a language, summed over all terms."""
    a, b = F.abs, F.col
    base = a(b("z") - b("z_2"))
    other = groups.select("lang", b("source").alias("item"), b("z").alias("z_2"))
    salted = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    # terms that the source has, as if the other lacked them: by the distinct shares of a source
    shares = p.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.hash("source", "p"), F.lit(_SALTS)))
    one = shares.join(salted, ["lang", "salt"]).filter(b("source") != b("item")).groupBy("lang", "source", "item").agg(F.sum(b("n") * (a(b("p") - b("z_2")) - base)).alias("v"))
    # terms that both have
    right = p.select("lang", "term", b("source").alias("item"), b("p").alias("p_2"), b("z").alias("z_2"))
    both = p.join(right, ["lang", "term"]).filter(b("source") < b("item"))
    change = a(b("p") - b("p_2")) - a(b("p") - b("z_2")) - a(b("z") - b("p_2")) + base
    both = both.groupBy("lang", "source", "item").agg(F.sum(change).alias("v"))
    swapped = lambda df: df.select("lang", b("item").alias("source"), b("source").alias("item"), "v")
    left = groups.withColumn("salt", F.pmod(F.hash("source"), F.lit(_SALTS)))
    neither = left.join(salted, ["lang", "salt"]).filter(b("source") != b("item")).select("lang", "source", "item", F.coalesce(b("n_terms") * base, F.lit(0)).alias("v"))
    parts = [neither, one, swapped(one), both, swapped(both)]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, most_terms: int = 50, prior: int = 5, scale: int = 1_000_000_000, width: int = SKETCH_WIDTH, rows: int = SKETCH_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by distance, part ``term`` the terms that the source has more of than its language."""

    def made() -> DataFrame:
        fields = _fields(df, text, lang, source)
        counts = interim.stored(term_counts(fields, min_docs, width, rows), "term-counts")
        of_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        of_lang = counts.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n_lang").alias("total_lang"))
        groups = fields.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0)
        groups = interim.stored(groups.withColumn("z", _share("0", "total", scale, prior)), "groups")
        p = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", scale, prior))
        q = _share("n_lang", "total_lang", scale, prior)
        more = p.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
        w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
        return ranked(_pairs(p.select("lang", "source", "term", "p", "z"), groups), "pair").unionByName(ranked(more, "term").filter(F.col("rank") <= most_terms))

    return interim.settled(df.sparkSession, made, "divergence")
