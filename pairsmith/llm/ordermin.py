"""Order MinHash fingerprints, in DataFrame functions only (Marçais et al., "Locality-sensitive hashing for the edit distance", 2019).

A text's k-mers are runs of ``k`` words, the first ones of fewer; each is numbered by how
often it came before, so repeats count.  For each sketch the ``minimal`` least k-mers of an
order of hashes are chosen, put back into the order of the text, and hashed as one tuple.
Two texts agree in a sketch if they share these k-mers and have them in the same order, so
moving passages about lowers the likeness, as it does the edit similarity.  The sketches'
orders are rotations of one order of hashes: that of sketch j begins at the j-th of evenly
spaced points, and goes on at the least hash after the greatest.  So a text is hashed and
sorted once for all sketches, and short texts fill every sketch too.

A share p of equal sketches says that a share j = p ** (1 / minimal) of the texts' distinct
numbered k-mers is common; the likeness is 2 j / (1 + j), the common share of two texts of
equal length.

Words are divided by ASCII white space; each character of scripts that have no spaces is a
word.  Null counts as the empty text, which has no k-mers and an empty fingerprint: two of
them are alike (1), and unlike any other (0).  A text of fewer k-mers than a tuple has a
tuple of them again and again.  Equal texts have equal fingerprints.  Texts of any length are read
whole; positions beyond 2**23 words tie and are ordered by hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.functions.predicates import named
from pairsmith.operators.ranks import segmented
from pairsmith.sources import interim

K = 2
MINIMAL = 2
SKETCHES = 64
_POSITION = 24
_MASK = (1 << _POSITION) - 1
_LAST = (1 << 23) - 1
_HASH = (1 << 64 - _POSITION) - 1
_WHITE = " \t\n\x0b\x0c\r"
#: Scripts without spaces between words: Thai and Lao, Burmese, Khmer, Japanese, Chinese (fixed values; as ranges, which are found much faster than named scripts).
_UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def _hash(x: Column) -> Column:
    """The upper bits of a numbered k-mer: its hash."""
    return F.shiftright(x, _POSITION)


def _packed(h: Column, at: Column) -> Column:
    """A hash with a position in its lower bits, so that one number sorts and carries both."""
    return h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(at.cast("bigint"))


def _words(text: Column) -> Column:
    spaced = F.when(text.rlike(_UNSPACED), F.regexp_replace(text, _UNSPACED, " $0 ")).otherwise(text)
    return F.split(F.btrim(spaced, F.lit(_WHITE)), r"[\x20\x09-\x0D]+")


def _kmers(words: Column, k: int) -> Column:
    kmer = lambda i: F.xxhash64(*(F.get(words, i - j) for j in reversed(range(k))))
    each = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _packed(kmer(i), F.least(i, F.lit(_LAST))))
    return F.when((F.size(words) == 1) & (words[0] == ""), _longs()).otherwise(F.sort_array(each))


def _run_starts(kmers: Column) -> Column:
    """Where another k-mer begins in the sorted array."""
    differs = lambda i: (i == 0) | (_hash(kmers[i]) != _hash(F.get(kmers, i - 1)))
    return F.when(F.size(kmers) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.size(kmers) - 1), differs))


def _numbered(kmers: Column, starts: Column) -> Column:
    """Each k-mer hashed with the number of equal ones before it; the first as it is."""
    again = lambda x, n: F.when(n == 0, x).otherwise(_packed(F.xxhash64(_hash(x), n), x.bitwiseAND(F.lit(_MASK))))
    run = lambda start, j: F.transform(F.slice(kmers, start + 1, F.coalesce(F.get(starts, j + 1), F.size(kmers)) - start), again)
    return F.sort_array(F.flatten(F.transform(starts, run)))


def _sketches(numbered: Column, halves: Column, minimal: int, sketches: int) -> Column:
    """halves: the powers of two up to the number of k-mers, falling."""
    n = F.size(numbered)

    def first_from(point: Column) -> Column:
        """How many lie before the point, by halving."""
        return F.aggregate(halves, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(numbered, low + step - 1) < point), low + step).otherwise(low))

    def turned(x: Column) -> Column:
        """The position above the hash, to sort by."""
        return F.shiftleft(x.bitwiseAND(F.lit(_MASK)), 64 - _POSITION).bitwiseOR(F.shiftrightunsigned(x, _POSITION))

    def chosen(first: Column) -> Column:
        """The hash of the least k-mers from there on, in the order of the text."""
        ordered = F.array_sort(F.array(*(turned(numbered[(first + d) % n]) for d in range(minimal))))
        return F.shiftrightunsigned(F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND(F.lit(_HASH)))), 33).cast("int")

    points = F.array(*(F.lit(-(1 << 63) + j * ((1 << 64) // sketches)).cast("bigint") for j in range(sketches)))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.transform(points, first_from), chosen))


def _halves(numbered: Column) -> Column:
    return F.filter(F.array(*(F.lit(1 << i) for i in reversed(range(31)))), lambda x: x <= F.size(numbered))


def with_sketches(df: DataFrame, columns: Sequence[str], k: int = K, minimal: int = MINIMAL, sketches: int = SKETCHES) -> DataFrame:
    """Text columns become arrays of their sketches; each step is a projection, so nothing is computed twice."""
    others = [named(c) for c in df.columns if c not in columns]
    step = lambda df, f: df.select(*others, *(f(c).alias(c) for c in columns))
    df = step(df, lambda c: _words(F.coalesce(named(c).cast("string"), F.lit(""))))
    df = step(df, lambda c: _kmers(named(c), k))
    df = df.select(*others, *(named(c) for c in columns), *(_run_starts(named(c)).alias(f"{c} starts") for c in columns))
    df = step(df, lambda c: _numbered(named(c), named(f"{c} starts")))
    df = df.select(*others, *(named(c) for c in columns), *(_halves(named(c)).alias(f"{c} halves") for c in columns))
    return step(df, lambda c: _sketches(named(c), named(f"{c} halves"), minimal, sketches))


def fingerprint(sketches: Column) -> Column:
    """The sketches as hexadecimal text, eight digits each."""
    return F.array_join(F.transform(sketches, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint")), 8, "0"))), "")


def likeness(a: Column, b: Column, minimal: int = MINIMAL) -> Column:
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.greatest(F.size(a), F.size(b))
    j = F.pow(F.coalesce(equal, F.lit(0.0)), F.lit(1 / minimal))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2 * j / (1 + j))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """(row, fingerprint) of every row."""
    return with_sketches(df.select(F.struct("*").alias("row"), named(text).alias("fingerprint")), ["fingerprint"]).select("row", fingerprint(F.col("fingerprint")).alias("fingerprint"))


def _followers(documents: DataFrame) -> tuple[DataFrame, bool]:
    """(key, id, next_key, need) of each distinct document, and whether some are repeated.  The last is followed by the first."""
    each = documents.groupBy("key").agg(F.min("id").alias("id"), F.min(F.char_length("text")).alias("n"), F.count("*").alias("rows"))
    ranked = interim.stored(segmented(each, [], [F.col("id"), F.col("key")]), "order")
    after = ranked.select(F.col("key").alias("next_key"), F.pmod(F.col("rank") - 1, F.col("size")).alias("rank"))
    pairs = interim.stored(ranked.join(after, "rank").select("key", "id", "next_key", F.expr("n div 2").alias("need")), "followers")
    return pairs, not ranked.filter("rows > 1").isEmpty()


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint and that of its edited text, and how near the edited text and the next document are.

    The edited text has its last half of characters replaced by as many first ones of the
    next document.  Documents follow one another by identifier, null first, those of one
    identifier by a hash of their text; equal rows are one document there and get the same
    figures.  A single document is followed by itself.
    """

    def made() -> DataFrame:
        t = F.coalesce(named(text).cast("string"), F.lit(""))
        name = F.coalesce(F.concat(F.lit("="), named(key).cast("string")), F.lit("-"))
        keyed = df.select(F.concat_ws("/", name, F.md5(t)).alias("key"), named(key).alias("id"), t.alias("text"))
        followers, repeated = _followers(keyed)
        once = lambda x: x.dropDuplicates(["key"]) if repeated else x
        # dealt by key once, for both joins: no other column, so that the exchange is the same
        documents = keyed.select("key", "text")
        heads = documents.join(followers.withColumnsRenamed({"key": "own", "next_key": "key"}).hint("merge"), "key").select(F.col("own").alias("key"), F.col("key").alias("next_key"), "id", "need", F.left("text", F.col("need").cast("int")).alias("head"))
        n = F.char_length("text")
        joined = documents.join(once(heads).hint("merge"), "key").select("key", "next_key", "id", n.cast("long").alias("n_chars"), "text", F.concat(F.left("text", (n - F.col("need")).cast("int")), "head").alias("edited"))
        joined = joined.select("*", F.sha2("edited", 256).alias("edited_sha256"))
        found = interim.stored(with_sketches(joined, ["text", "edited"]), "sketches")
        nexts = once(found.select("key", F.col("text").alias("next"))).withColumnRenamed("key", "next_key")
        return found.join(nexts, "next_key").select(
            F.col("id").alias(key),
            "n_chars",
            "edited_sha256",
            fingerprint(F.col("text")).alias("fingerprint"),
            fingerprint(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("text"), F.col("edited")).alias("near_edited"),
            likeness(F.col("text"), F.col("next")).alias("near_next"),
        )

    return interim.settled(df.sparkSession, made, "fingerprints")
