"""Source divergence, order MinHash and the Merkle manifest against plain versions, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairsmith.llm import divergence, merkle, ordermin, queries
from pairsmith.sources import interim

from .test_llm import DOCUMENT, ODD, odd_rows, prose


def table(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCUMENT)


@pytest.mark.parametrize("name", ["op11_divergence", "op13_merkle"])
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = c.sql(queries.ORACLE_SQL[name])
    rows = [tuple(r[x] for x in found.columns) for r in queries.QUERIES[name](spark, sf).collect()]
    assert sorted(rows) == sorted(found.fetchall())


# 11


def naive_audit(rows, min_docs, most=50):
    of, docs = defaultdict(Counter), Counter()
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        of[lang, source].update(found)
        docs.update({(lang, x) for x in found})
    out = []
    for lang in {g for g, _ in of}:
        kept = sorted(x for g, x in docs if g == lang and docs[g, x] >= min_docs)
        sources = [s for g, s in of if g == lang]
        shares = lambda n: {x: 1 + 10**9 * (n[x] + 5) // (sum(n[y] for y in kept) + 5 * len(kept)) for x in kept}
        whole = shares(sum((of[lang, s] for s in sources), Counter()))
        own = {s: shares(of[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(own[s][x] - own[o][x]) for x in kept), o) for o in sources if o != s]
            more = [(whole[x] - own[s][x], x) for x in kept if of[lang, s][x] and own[s][x] > whole[x]]
            out += [(lang, s, part, item, -v, i + 1) for part, found, n in (("pair", pairs, len(pairs)), ("term", more, most)) for i, (v, item) in enumerate(sorted(found, key=lambda r: (r[0], r[1].encode()))[:n])]
    return out


WORDS = ["the", "The", "of", "été", "ÉTÉ", "naïve", "x", "日本", "語", "and", "zu", "it's", "a1b", "data-base"]


def corpus(seed, n=150):
    rng = random.Random(seed)
    langs, sources = ["en", "fr", None, ""], ["s0"] * 5 + ["s1", "s2", None, "", "é"]
    rows = [(i, rng.choice([None, "", " 1 2"]) if rng.random() < 0.1 else " ".join(rng.choice(WORDS[: rng.randint(3, 14)]) for _ in range(rng.randint(1, 30))), rng.choice(langs), rng.choice(sources)) for i in range(n)]
    return [*rows, (1000, "rare", "de", "only"), (1001, None, "it", None), (1002, "", "it", "z")]


@pytest.mark.parametrize("width,n_rows", [(1 << 22, 3), (1 << 13, 1)])
def test_divergence(spark, monkeypatch, width, n_rows):
    rows = corpus(1)
    if n_rows == 1:
        monkeypatch.setattr(divergence, "_BYTES_AT_ONCE", 40)  # a few documents at a time
    df = table(spark, rows).repartition(5)
    found = [tuple(r) for r in divergence.audit(df, min_docs=12, most_terms=3, width=width, rows=n_rows).collect()]
    assert sorted(found) == sorted(naive_audit(rows, 12, 3))
    assert {r[0] for r in found} == {"en", "fr", "", "it"}  # a language of one source has no pair, one without terms has


def test_sketch_never_underestimates(spark):
    rows = [(i, prose(i, 60), "en", "s") for i in range(80)]
    df = table(spark, rows).select("lang", "source", "text").repartition(7)
    docs = Counter(x for _, t, _, _ in rows for x in set(t.lower().split()))
    width, n_rows = 1 << 13, 2
    for least in (3, 300):  # counters of a byte, and greater ones
        bits = np.unpackbits(divergence.frequent_bits(df, least, width, n_rows))
        says = dict(zip(docs, bits[divergence._cells(divergence._hashes("en", list(docs)), width, n_rows)].all(axis=0), strict=True))
        assert all(says[x] for x in docs if docs[x] >= least)
    assert not any(says.values())


# 12


def spark_hash(values, seed=42):
    """xxhash64 of columns: each value's hash seeds the next, nulls are passed over."""
    h = seed
    for v in values:
        if v is not None:
            h = xxhash.xxh64(v, seed=h).intdigest()
    return h


def naive_fingerprint(text, k=2, minimal=2, sketches=64):
    unspaced = lambda c: any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
    words = "".join(f" {c} " if unspaced(c) else c for c in text)
    words = [w.encode() for w in re.split("[ \t-\r]+", words.strip(" \t\n\x0b\x0c\r")) if w]
    if not words:
        return ""
    signed = lambda x, n: x - (1 << n) if x >> (n - 1) else x
    seen, kmers = Counter(), []
    for i in range(len(words)):
        h = spark_hash(words[max(0, i - k + 1) : i + 1]) >> 24
        n = seen[h]
        seen[h] += 1
        if n:
            h = spark_hash([signed(h, 40).to_bytes(8, "little", signed=True), n.to_bytes(4, "little")]) >> 24
        kmers.append((signed(h, 40), i))
    kmers.sort()
    out = []
    for j in range(sketches):
        point = -(1 << 63) + j * ((1 << 64) // sketches)
        first = sum((h << 24 | i) < point for h, i in kmers)
        chosen = sorted(((kmers[(first + d) % len(kmers)]) for d in range(minimal)), key=lambda x: x[1])
        out.append(f"{spark_hash([(h % (1 << 40)).to_bytes(8, 'little') for h, _ in chosen]) >> 33:08x}")
    return "".join(out)


def naive_likeness(a, b, minimal=2):
    a, b = ([x[i : i + 8] for i in range(0, len(x), 8)] for x in (a, b))
    if not a or not b:
        return float(not a and not b)
    j = (sum(x == y for x, y in zip(a, b, strict=True)) / len(a)) ** (1 / minimal)
    return 2 * j / (1 + j)


def naive_edited(rows):
    """For rows of distinct identifiers."""
    order = sorted((i is not None, i or 0, t or "") for i, t in rows)
    after = {order[n][:2]: order[(n + 1) % len(order)][2] for n in range(len(order))}
    out = {}
    for i, t in rows:
        t = t or ""
        half, following = len(t) // 2, after[i is not None, i or 0]
        edited = t[: len(t) - half] + following[:half]
        prints = [naive_fingerprint(x) for x in (t, edited, following)]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], naive_likeness(prints[0], prints[1]), naive_likeness(prints[0], prints[2]))
    return out


def test_order_minhash(spark):
    rng = random.Random(5)
    rows = [(i * 3, " ".join(rng.choice("a b c dd ee the of in".split()) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (2000, prose(3, 400)), (2001, prose(3, 400)), (2002, "same " * 500), (-7, "one")]
    found = {r.doc_id: tuple(r)[1:] for r in ordermin.edited_fingerprints(table(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)).collect()}
    expected = naive_edited(rows)
    assert found.keys() == expected.keys()
    for i, own in expected.items():
        assert found[i][:4] == own[:4], (i, dict(rows)[i])
        assert found[i][4:] == pytest.approx(own[4:])


def test_order_minhash_of_the_table(spark, sf):
    found = queries.op12_order_minhash(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = naive_edited(list(texts.items()))
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint) for r in found} == {i: x[:3] for i, x in expected.items()}
    some = [r for r in found if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in some) > 0.98 * len(some)


def test_order_counts(spark):
    """Moved blocks are less alike, though their words are the same; near copies are alike."""
    words = prose(1, 600).split()
    turned = words[300:] + words[:300]
    near = words[:299] + ["new"] + words[300:]
    shuffled = words[::-1]
    df = spark.createDataFrame([(" ".join(words), " ".join(x)) for x in (words, near, turned, shuffled)], "a string, b string")
    like = [r[0] for r in ordermin.with_sketches(df, ["a", "b"]).select(ordermin.likeness(F.col("a"), F.col("b"))).collect()]
    assert like[0] == 1 and like[1] > 0.9 and 0.5 < like[2] < 0.95 and like[3] < 0.2


def test_order_minhash_is_native(spark, sf):
    df = ordermin.with_sketches(spark.read.parquet(f"{sf}/documents.parquet").select("text"), ["text"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_repeated_rows_follow_each_other_once(spark):
    rows = [(1, "a b c d", "en", "s")] * 3 + [(1, "other words here", "en", "s"), (2, "last of all", "en", "s")] * 2
    found = Counter(tuple(r) for r in ordermin.edited_fingerprints(table(spark, rows)).collect())
    assert sorted(found.values()) == [2, 2, 3]


# 13


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def naive_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text); a row's figures by its place in the list."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(field, r))
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        """The root, and each node's path: (hashes of its run, its place there), from below."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for i, p in enumerate(paths):
                p.append((runs[at[i] // 16], at[i] % 16))
                at[i] //= 16
            nodes = [h(*run) for run in runs]
        return nodes[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf(rows[i]))) for s in sources}
    trees = {s: climb([leaf(rows[i]) for i in of[s]]) for s in sources}
    root, above = climb([trees[s][0] for s in sources])
    out = {}
    for k, s in enumerate(sources):
        for i, path in zip(of[s], trees[s][1], strict=True):
            r, whole = rows[i], path + above[k]
            now = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for run, place in whole:
                now = h(*run[:place], now, *run[place + 1 :])
            out[i] = (r[0], leaf(r), trees[s][0], root, h(*(x for run, place in whole for n, x in enumerate(run) if n != place)), now, now == root)
    return [out[i] for i in range(len(rows))]


@pytest.mark.parametrize("n_sources", [1, 3, 40])
def test_merkle(spark, n_sources):
    rng = random.Random(n_sources)
    sizes = [rng.choice([1, 2, 16, 17, 40]) for _ in range(n_sources)]
    sizes[0] = 300
    names = [None, "", "-", "é"] + [f"s{i}" for i in range(40)]
    ids = iter(rng.sample(range(-50, 5000), sum(sizes)))
    rows = [(next(ids), names[s], rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "Upper Éa", "lower", "-", "x:y"])) for s, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame([(i, t, g, s, n) for i, s, g, n, t in rows], DOCUMENT).repartition(4)
    found = sorted(tuple(r) for r in merkle.audit_tampering(df).collect())
    assert found == sorted(naive_merkle(rows))
    assert {r[-1] for r in found} == {True, False}


def test_a_changed_row_changes_the_root_and_no_sibling_proof(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}") for i in range(100)]
    with interim.scope(spark):
        df = table(spark, rows)
        manifest = merkle.build(df.select("*", merkle.leaf().alias("leaf")))
        root = manifest.top[-1].filter("n = 1").first().hash
        assert merkle.proofs(manifest).filter("not verified").isEmpty()
        other = merkle.proofs(manifest, F.when(F.col("row.doc_id") == 7, F.sha2(F.lit("forged"), 256))).filter("not verified").collect()
        assert [r.row.doc_id for r in other] == [7] and other[0].root == root


def test_odd_tables(spark):
    none = table(spark, [])
    assert divergence.audit(none).count() == ordermin.edited_fingerprints(none).count() == merkle.audit_tampering(none).count() == 0
    odd = odd_rows(spark)
    rows = [tuple(r)[:5] for r in odd.collect()]
    assert Counter(tuple(r) for r in divergence.audit(odd, min_docs=1).collect()) == Counter(naive_audit([(i, t, g, s) for i, t, g, s, _ in rows], 1))
    in_order = [(i, s, g, n, t) for i, t, g, s, n in rows]
    assert sorted(map(repr, (tuple(r) for r in merkle.audit_tampering(odd).collect()))) == sorted(map(repr, naive_merkle(in_order)))
    found = ordermin.edited_fingerprints(odd).collect()
    expected = naive_edited(list({i: t for i, t, *_ in rows}.items()))
    assert Counter((r.doc_id, *tuple(r)[1:4]) for r in found) == Counter((i, *expected[i][:3]) for i, *_ in rows)
