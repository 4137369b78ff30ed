"""Every training-data operator against a plain version of itself, and on odd tables."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pairsmith.llm import _tokens, bpe, knn, lines, neardup, packing, pii, quality, queries, sst, substrings, toxicity
from pairsmith.sources import interim

DOCUMENT = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
ODD = ["", " ", "İstanbul ΣΑΣ ΣΑΣ. éa  \n x", "a<|endoftext|> b <|endoftext|>", "it's we'LL 12²½ \x1c x\x1f y  z", "  lead\ttab \r\n end  ", "日本語 テスト😀 é", "́x", "A  B \u0085 c", "x" * 3000, "wor d" * 900, "\n\n\n"]


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCUMENT)


def library(name):
    return Tokenizer.from_file(_tokens.vocabulary_path(name))


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "er", "th", "ou", "st", "é", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# 2, 3, 6: tokens


def test_tree_merges_like_a_scan():
    rng = random.Random(4)
    merges = [(a, b, 10 + i) for i, (a, b) in enumerate(rng.sample([(a, b) for a in range(8) for b in range(8)], 30))]
    merges += [(10 + i, rng.randrange(10), 60 + i) for i in range(20)]
    ranks = {}
    for r, (a, b, m) in enumerate(merges):
        ranks.setdefault((a, b), (r, m))
    pairs = bpe.pair_entries(merges)
    for _ in range(500):
        ids = [rng.randrange(8) for _ in range(rng.randint(0, 40))]
        expected = list(ids)
        while found := [(ranks[p][0], i) for i, p in enumerate(zip(expected, expected[1:], strict=False)) if p in ranks]:
            _, i = min(found)
            expected[i : i + 2] = [ranks[expected[i], expected[i + 1]][1]]
        assert bpe.merge_with_tree(ids, pairs) == expected


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_encoded_as_texts(name):
    rng = random.Random(1)
    pool = ["a", "B", " ", " ", "\n", "\t", "é", "1", ",", "'", "s", " ", "\x1c", "<|endoftext|>", "Σ", "ing", "th"]
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    plain = library(name)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in _tokens.LibraryWords(_tokens.vocabulary_path(name), "<u4").encode(texts)] == expected
    if name.startswith("byte"):
        assert [x.tolist() for x in bpe.codec(_tokens.vocabulary_path(name)).encode(texts)] == expected


def test_memory_forgets_the_oldest_generation():
    made = []
    m = _tokens.Memory(lambda w: made.append(w) or w.upper(), room=2)
    assert [m[w] for w in ("a", "b", "a", "c", "a", "d", "e", "b")] == list("ABACADEB")
    assert len(m) <= 2 and len(m.old) <= 2 and made.count("a") == 1


def test_bpe_digests(spark, sf, texts):
    plain = library("byte_bpe_50k.json")
    for r in queries.op2_bpe(spark, sf).collect():
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip_of_odd_texts(spark):
    df = documents(spark, [*ODD, None], [*range(len(ODD)), None])
    ids = bpe.encode(df)
    back = {r.doc_id: r.text for r in bpe.decode(ids).collect()}
    assert back == {**dict(enumerate(ODD)), None: ""}
    plain = library("byte_bpe_50k.json")
    some = [[200, 300, 128], [50256], [], [255, 254]]
    broken = spark.createDataFrame(list(enumerate(some)), "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(broken).collect()} == {i: plain.decode(x, skip_special_tokens=False) for i, x in enumerate(some)}


def test_place_covers_every_token_once():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.choice([0, 1, 7, 16, 17, 40, rng.randint(0, 60)]) for _ in range(rng.randint(0, 40))]
        pieces = packing.place(lengths, 16)
        filled, got = defaultdict(list), defaultdict(list)
        for d, start, n, s, at in pieces:
            filled[s].append((at, n))
            got[d].append((start, n))
        for d, n in enumerate(lengths):
            at = 0
            for start, m in sorted(got[d]):
                assert start == at and m > 0
                at += m
            assert at == n
        for s in filled.values():
            at = 0
            for start, m in sorted(s):
                assert start == at
                at += m
            assert at == 16 or at & (at - 1) == 0


def test_place_balances_cost():
    pieces = packing.place([9, 8, 7, 3, 3, 2], 16)
    sums = Counter()
    for _, _, n, s, _ in pieces:
        sums[s] += n
    assert sorted(sums.values()) == [16, 16]


@pytest.mark.parametrize("lengths", [[3000] * 5333, [900] * 17777])
def test_place_of_equal_lengths_is_quick(lengths):
    began = time.process_time()
    pieces = packing.place(lengths)
    assert time.process_time() - began < 1
    assert sum(n for _, _, n, _, _ in pieces) == sum(lengths)


@pytest.mark.parametrize("group", [100, packing.GROUP_TOKENS])
def test_packing(spark, group):
    texts = [prose(i, 40 * i) for i in range(8)] + ["", None]
    plain = library("word_bpe_49k.json")
    rows = packing.pack(documents(spark, texts), group_tokens=group, capacity=64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        got = [x for r in sorted(by[i], key=lambda r: r.start) for x in r.ids]
        assert got == ids
        assert all(zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) == r.ids_crc32 and r.doc_tokens == len(ids) for r in by[i])


def test_shards(spark, tmp_path):
    texts = [*ODD, None, prose(1, 3000), "twice", "twice"]
    ids = [5, -3, 100, 2**40, -(2**40), *range(200, 200 + len(texts) - 7), 7, 7]
    df = documents(spark, texts, ids)
    manifest = sst.write(df, f"file://{tmp_path}/shards", shard_bytes=2000)
    assert manifest.count() > 1
    plain = library("byte_bpe_50k.json")
    got = sorted(sst.read(spark, manifest).collect(), key=lambda r: r.start)
    expected = sorted((i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in zip(ids, texts, strict=True))
    assert sorted((r.doc_id, r.ids) for r in got) == expected and [r.doc_id for r in got] == [i for i, _ in expected]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)))
        at += r.n_tokens
    assert sst.lookup(spark, manifest, 2**40) == dict(expected)[2**40]
    assert sst.lookup(spark, manifest, 6) is None and sst.lookup(spark, manifest, 2**41) is None


def test_shards_of_one_identifier_and_of_long_texts(spark, tmp_path):
    """A repeated identifier and a range of long texts are divided; shards stay near the size asked for."""
    texts = [prose(i, 40) for i in range(300)] + ["same"] * 200 + [prose(i, 2000) for i in range(20)]
    ids = [7] * 300 + [None] * 200 + list(range(100, 120))
    manifest = sst.write(documents(spark, texts, ids), f"file://{tmp_path}/shards", shard_bytes=20_000)
    shards = {r.shard: r for r in manifest.collect()}
    assert sum(r.first_id <= 7 <= r.last_id for r in shards.values()) > 2 and max(r.n_docs for r in shards.values() if r.first_id == 7) < 300
    got = sorted(sst.read(spark, manifest).collect(), key=lambda r: r.start)
    plain = library("byte_bpe_50k.json")
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple([*plain.encode(t, add_special_tokens=False).ids, 0])) for i, t in zip(ids, texts, strict=True))
    assert [r.doc_id for r in got] == [None] * 200 + [7] * 300 + list(range(100, 120)) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_shard_format():
    writer = sst.ShardWriter(2)
    values = {i * 3 - 50: np.arange(i % 900, dtype="<u2") for i in range(700)}
    data = b"".join([*(writer.add(k, v.tobytes()) for k, v in values.items()), writer.finish()])
    reader = sst.ShardReader(lambda at, n: data[at : at + n], len(data))
    assert len(reader.blocks) > 1 and [k for k, _ in reader] == list(values)
    for k in range(-60, 2100):
        found = reader.get(k)
        assert (found is None) == (k not in values) and (found is None or found.tolist() == values[k].tolist())


# 1: near duplicates


def naive_links(texts, words=5, least=0.8):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    common = Counter()
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    for own in having.values():
        common.update((a, b) for a in own for b in own if a != b)
    links = {i: set() for i in sets}
    for (a, b), n in common.items():
        if n >= least * (len(sets[a]) + len(sets[b]) - n):
            links[a].add(b)
    root = {i: i for i in sets}
    while True:
        now = {i: min([root[i], *(root[j] for j in links[i])]) for i in sets}
        if now == root:
            return links, root
        root = now


def near_copies():
    texts = {}
    base = [prose(s, 120).split() for s in range(6)]
    rng = random.Random(9)
    for k in range(90):
        w = list(base[k % 6])
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            w[rng.randrange(len(w))] = f"new{k}{rng.random()}"
        texts[k] = " ".join(w)
    return texts | {100: "", 101: None, 102: "one two", 103: "one  two", 104: "  ", 105: "one two three four five six"}


@pytest.mark.parametrize("block", [192, 7])
def test_near_duplicates(spark, block):
    texts = near_copies()
    links, root = naive_links(texts)
    df = documents(spark, list(texts.values()), list(texts))
    rows = neardup.near_duplicates(df, block_classes=block).collect()
    assert {r.doc.id: (r.class_id, r.n_links) for r in rows} == {i: (root[i], len(links[i])) for i in texts}
    kept = neardup.one_of_each(df.withColumn("row", F.lit(1)).withColumn("id", F.lit("x")), block_classes=block)
    assert kept.columns == [*df.columns, "row", "id"]
    assert {r.doc_id for r in kept.collect()} == {i for i in texts if root[i] == i}


def test_near_duplicates_of_the_table(spark, sf, texts):
    links, root = naive_links(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op1_near_duplicates(spark, sf).collect()}
    assert got == {i: (root[i], len(links[i])) for i in texts}


def test_tries_link_all_that_share_a_prefix():
    rng = np.random.default_rng(12)
    for depth in (1, 2, 8):
        n = 300
        labels = rng.integers(0, 2, (n, 8)) * rng.integers(0, 2, (n, 8)) * np.where(rng.random((n, 8)) < 0.1, 7, 1)
        packed = sum(labels[:, k].astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(8)).view(np.int64)
        rows = sorted(zip(rng.integers(0, 3, n).tolist(), packed.tolist(), range(n), strict=True))
        cuts = sorted({0, n, *rng.integers(0, n, 40).tolist()})
        partitions, emitted = [[]], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            t, x, c = (pa.array(list(v), k) for v, k in zip(zip(*rows[a:b], strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True))
            partitions[-1].append(pa.RecordBatch.from_arrays([t, x, c], names=["tree", "label", "class"]))
            if rng.random() < 0.3:
                partitions.append([])
        for p in partitions:
            emitted += [r for b in neardup._meetings(iter(p), depth) for r in b.to_pylist()]
        least = {}
        for r in emitted:
            if r["edge"]:
                least[r["node"]] = min(least.get(r["node"], n), r["head"])
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for r in emitted:
            for a, b in [(r["class"], r["head"]), *([(r["head"], least[r["node"]])] if r["edge"] else [])]:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes, of_class = defaultdict(set), defaultdict(set)
        for t, x, c in rows:
            nodes[t, (x & (2**64 - 1)) >> 8 * (8 - depth)].add(c)
        for r in emitted:
            of_class[r["class"]].add(r["node"])
        for own in nodes.values():
            first = min(find(c) for c in own)
            assert all(find(c) == first for c in own)
            assert len(own) == 1 or len(set.intersection(*(of_class[c] for c in own))) == 1


def test_pairs_at_the_threshold_meet():
    """The measured share of pairs of similarity 0.8 that share a prefix of the shortened depth."""
    rng = random.Random(21)
    depth, met, pairs = neardup.depth_for(0.8, neardup.RECALL), 0, 400
    texts = []
    for k in range(pairs):  # 40 one-word shingles of 50 in common
        own = [f"w{k}.{rng.random()}" for _ in range(50)]
        texts += [" ".join(own[:45]), " ".join(own[:40] + own[45:])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * pairs)), pa.array(texts)], names=["doc", "t"])
    labels = {r["doc"]: r["labels"] for b in neardup._signed_batches(iter([batch]), 1, neardup.TREES) for r in b.to_pylist()}
    for k in range(pairs):
        a, b = (np.array(labels[d], dtype=np.int64).view(np.uint64) >> np.uint64(8 * (8 - depth)) for d in (2 * k, 2 * k + 1))
        met += bool((a == b).any())
    assert met >= 0.985 * pairs


def test_depth_is_shortened_until_the_recall():
    assert neardup.depth_for(0.8, 0.5) == neardup.LABEL
    d = neardup.depth_for(0.8, 0.999)
    assert 1 - (1 - 0.8**d) ** neardup.TREES >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** neardup.TREES


# 4: personal data


def naive_base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("a1@.+ -()25.%@1é") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == naive_base(t)
    long = "9" * 6000 + " 1.2.3.4"
    assert pii.base_spans(long) == naive_base(long) == [(1, 6001, 6008)]


def test_random_field_finds_what_patterns_miss(spark):
    card = "4465758382889437"
    texts = [f"pay {card} {card} now", f"a {card} b", "call +1 (826) 555-4081 190.137.223.20 end", "plain words only", None, "", f"version 1.2.3 of 2024-10-12, {card[:-1]}1 and 12345678901234567890123"]
    df = documents(spark, texts)
    model = pii.learn(df)
    rows = {r.doc_id: r for r in pii.find(df, model).collect()}
    assert rows[0].n_card == 0 and rows[0].spans == "card:4:20,card:21:37"
    assert rows[1].spans == "card:2:18" and rows[1].n_added == 0
    assert "ip:" in rows[2].spans and "phone:" in rows[2].spans
    assert [rows[i].spans for i in (3, 4, 5, 6)] == ["", "", "", ""]
    assert rows[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.redacted(df.withColumn("row", F.lit("kept")).withColumn("t", F.lit("kept")), model)
    assert clean.columns == [*df.columns, "row", "t"]
    assert [r.text for r in clean.orderBy("doc_id").limit(2).collect()] == ["pay <CARD> <CARD> now", "a <CARD> b"]


def test_base_digests(spark, sf, texts):
    for r in queries.op4_pii(spark, sf).collect():
        base = naive_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))


def plain_features(text, start, end):
    """Names of the features of a span, by regular expressions."""
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    n, g = len(digits), len(groups)
    rest = set(re.sub(r"[0-9A-Za-z]", "", s))
    f = {"at" if "@" in s else "no_at", "plus" if s[:1] == "+" else "no_plus"}
    if pii._emails(s) == [(0, len(s))]:
        f.add("dotted_domain")
    if g == 4 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s):
        f.add("four_parts" if all(int(x) <= 255 for x in groups) else "part_over_255")
    if 13 <= n <= 19:
        f.add("luhn" if pii.luhn(digits) else "no_luhn")
    if re.search("[A-Za-z]", s):
        f.add("letters")
    f.add(next(name for most, name in ((6, "digits_6_less"), (8, "digits_7_8"), (12, "digits_9_12"), (15, "digits_13_15"), (19, "digits_16_19"), (10**9, "digits_20_more")) if n <= most))
    if g == 1:
        f.add("groups_1")
    elif set(map(len, groups)) == {4}:
        f.add("groups_4_equal")
    elif g:
        f.add("groups_3_6" if g <= 6 else "groups_7_more")
    if rest == {"."}:
        f.add("dots_only")
    f |= {name for name, marks in (("spaces", " "), ("hyphens", "-"), ("brackets", "()")) if rest & set(marks)}
    if not (start and text[start - 1].isalnum()):
        f.add("starts_at_edge")
    if not (end < len(text) and text[end].isalnum()):
        f.add("ends_at_edge")
    if start > 1 and text[start - 1] in " -." and text[start - 2].isdigit():
        f.add("before_digit")
    if end + 1 < len(text) and text[end] in " -." and text[end + 1].isdigit():
        f.add("after_digit")
    if not s[-1:].isalnum() or s[:1] in " -.)":
        f.add("ends_in_mark")
    return f


def test_segments_and_their_features():
    rng = random.Random(13)
    for _ in range(150):
        text = "".join(rng.choice(["1", "23", "0004", "256", "4465758382889437", " ", "-", ".", "+", "(", ")", "a", "@", "b.c", "é", "²", "😀"]) for _ in range(rng.randint(1, 30)))
        start = rng.randrange(len(text))
        end = rng.randint(start + 1, len(text))
        tokens = pii.Tokens(text, start, end)
        bounds = [m.span() for m in re.finditer(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]", text[start:end])]
        assert [tokens.span(k, k + 1) for k in range(tokens.n)] == [(a + start, b + start) for a, b in bounds]
        expected = []
        for i, (a, _) in enumerate(bounds):
            for j in range(i + 1, min(len(bounds), i + pii.MAX_TOKENS) + 1):
                s = text[a + start : bounds[j - 1][1] + start]
                d = sum(c.isdigit() for c in s)
                if (s[0].isalnum() or s[0] in "+(") and s[-1].isalnum() and d <= 19 + 30 * ("@" in s) and (d >= 4 or "@" in s):
                    expected.append((i, j))
        i, j = tokens.segments(0, tokens.n)
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == expected
        if expected:
            for (i, j), row in zip(expected, tokens.features(i, j), strict=True):
                assert {f for f, k in pii._FEATURES.items() if row[k]} == plain_features(text, *tokens.span(i, j)), text


def test_segmentation_is_the_best(monkeypatch):
    rng = np.random.default_rng(2)
    text = "+1 (826) 555-4081 1.2.3.4"
    lattice = pii.Lattice(text, 0, len(text))
    scores = rng.normal(0, 2, (len(lattice.segments), 4))
    row = {segment: k for k, segment in enumerate(lattice.segments)}

    def every(i):
        if i == lattice.n:
            yield 0.0, []
            return
        yield from every(i + 1)
        for k in lattice.starting[i]:
            for v, rest in every(lattice.segments[k][1]):
                for kind in range(4):
                    yield v + scores[k, kind], [(kind, k), *rest]

    all_of_them = list(every(0))
    best = max(all_of_them, key=lambda x: x[0])
    expected = [(kind, *lattice.tokens.span(*lattice.segments[k])) for kind, k in best[1]]
    for block in (1, 3, 2048):
        monkeypatch.setattr(pii, "BLOCK_TOKENS", block)
        assert pii.best_spans(lattice.tokens, lambda i, j: scores[[row[x] for x in zip(i.tolist(), j.tolist(), strict=True)]]) == expected
    z = sum(np.exp(v) for v, _ in all_of_them)
    p = np.zeros_like(scores)
    for v, s in all_of_them:
        for kind, k in s:
            p[k, kind] += np.exp(v) / z
    assert np.allclose(p, lattice.marginals(scores))


def test_a_long_table_of_digits():
    """1 MB of digits in one region: seconds, and the spans of each block are those of a short region."""
    model = pii.Model(np.random.default_rng(4).normal(0, 1, (len(pii._FEATURES), 4)))
    for unit, n in (("1 ", 500_000), ("17 4.5 +1234-5 6789 ", 50_000)):
        began = time.process_time()
        spans = model.added_spans(unit * n, [])
        assert time.process_time() - began < 60
        assert spans == sorted(spans, key=lambda x: x[1]) and all(a < b for _, a, b in spans)
        some = model.added_spans(unit * 200, [])
        assert spans[: len(some) // 2] == some[: len(some) // 2]


# 5: repeated substrings


def naive_repeats(rows, length):
    count = Counter(b[i : i + length] for b in rows for i in range(len(b) - length + 1))
    out = []
    for b in rows:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 40])
def test_repeated_substrings(spark, length):
    rng = random.Random(length)
    bits = [prose(s, length // 5 + 10 * s) for s in range(5)]
    texts = []
    for k in range(40):
        parts = [prose(1000 + k, 30)]
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(bits)
            lo = rng.choice([0, 0, rng.randrange(len(b) // 2)])
            parts += [b[lo : rng.choice([len(b), lo + length + rng.randint(-2, 2)])], prose(rng.random(), rng.randint(0, 8))]
        texts.append("".join(parts))
    texts += ["ab" * length, "a" * (length + 1), "a" * length, "xyz" * (length // 3 + 1), "", None, texts[0], "é" * length]
    ids = [*range(len(texts) - 1), None]
    df = documents(spark, texts, ids)
    df = df.union(df.filter("doc_id = 1"))
    texts, ids = [*texts, texts[1]], [*ids, 1]
    expected = naive_repeats([(t or "").encode() for t in texts], length)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.without_repeats(df, length=length).collect())
    assert got == Counter((i, *e) for i, e in zip(ids, expected, strict=True))


def test_null_identifiers_and_texts_of_one_short_hash(spark):
    """Two texts of equal 32-bit hashes under null identifiers: one has a repeat, the other must lose nothing."""
    passage, other = prose(31, 120), prose(32, 120)
    texts = lambda body: spark.range(130_000).select(F.concat(F.lit(body), F.lit(" "), F.col("id").cast("string")).alias("text"))
    a, b = (texts(x).select("text", F.hash("text").alias("h")) for x in (passage, other))
    pair = a.join(b.withColumnRenamed("text", "text_b"), "h").first()
    df = documents(spark, [pair.text, pair.text_b, f"{passage} end"], [None, None, 1])
    got = {r.kept_sha256: (r.doc_id, r.n_removed) for r in substrings.without_repeats(df).collect()}
    assert got[hashlib.sha256(pair.text_b.encode()).hexdigest()] == (None, 0)
    assert sorted(n for _, n in got.values()) == [0, len(passage.encode()) + 1, len(passage.encode()) + 1]


def test_repeats_in_texts_of_unlike_lengths(spark):
    """Two words whose hashes agree in their upper 44 bits are the least of a passage: its trigger must not depend on the text around it."""
    passage = f"{'a' * 100}myrezbkilcsi{'a' * 100}nhbibibydajr{'a' * 176}"
    texts = [passage, f"{passage} {prose(3, 120_000)}"]
    assert len(passage) == 400 and len(texts[1].encode()) > 1 << 19
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.without_repeats(documents(spark, texts)).collect()}
    assert got == {i: (400, 1, hashlib.sha256(t[400:].encode()).hexdigest()) for i, t in enumerate(texts)}


def test_repeated_substrings_of_the_table(spark, sf, texts):
    ids = sorted(texts)
    expected = dict(zip(ids, naive_repeats([texts[i].encode() for i in ids], 400), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_substrings(spark, sf).collect()} == expected


# 7: lines


def naive_lines(rows):
    """rows: (id, text). Lines to drop of each: lines by their constant places as tuples, texts by their shingles."""

    def tokens_of(line):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        width = len(line.strip(" \t\n\x0b\x0c\r").encode())
        if not w or not (re.search("[A-Za-z\x80-\U0010ffff]", line) or len(w) >= lines.MIN_TOKENS and width >= lines.MIN_BYTES):
            return None, False
        fields = ["<number>" if re.search("[0-9]", x) else x for x in w]
        return tuple(fields if sum(x != "<number>" for x in fields) * lines.TOKENS_PER_CONSTANT >= len(w) else w), width < lines.MIN_BYTES

    every = [(i, t, n, *tokens_of(line)) for i, t in rows for n, line in enumerate((t or "").split("\n"))]
    every = [x for x in every if x[3]]
    seen = defaultdict(set)  # texts that have a token in a place of a leaf
    leaves = lambda w: [(len(w), "first", w[: lines.DEPTH]), (len(w), "last", w[-lines.DEPTH :])] if len(w) >= lines.OPEN_TOKENS else []

    def places(w):
        k = min(len(w), lines.SLOTS)
        return [w[len(w) * j // k : len(w) * (j + 1) // k] for j in range(k)]

    for _, t, _, w, _ in every:
        for leaf in leaves(w):
            seen[leaf].add(t)
            for j, x in enumerate(places(w)):
                seen[leaf, j, x].add(t)

    def templates(w):
        yield ("whole", w)
        for leaf in leaves(w):
            for share in lines.SHARES:
                left = tuple(x if len(seen[leaf, j, x]) >= max(lines.MIN_DOCUMENTS, len(seen[leaf]) / share) else None for j, x in enumerate(places(w)))
                constant = sum(x is not None for x in left)
                if lines.LEAST_CONSTANT <= constant < len(left) and 3 * constant >= 2 * len(left):
                    yield (share, leaf, left)

    texts, short, first = defaultdict(set), defaultdict(lambda: True), {}
    for i, t, _, w, is_short in every:
        for k in templates(w):
            texts[k].add(t)
            short[k] &= is_short
            first[k] = min(first.get(k, (i, t)), (i, t))
    needed = {k: lines.SHORT_DOCUMENTS if short[k] else lines.MIN_DOCUMENTS for k in texts}
    sharing = {t for k, own in texts.items() if len(own) >= needed[k] for t in own}
    _, origin = naive_links({i: t for i, t in rows if t in sharing})
    of_text = {t: origin[i] for i, t in rows if t in sharing}
    recurring = {k for k, own in texts.items() if len(own) >= needed[k] and len({of_text[t] for t in own}) >= needed[k]}
    gone = {i: [] for i, _ in rows}
    for i, t, n, w, _ in every:
        if any(k in recurring and first[k][1] != t for k in templates(w)):
            gone[i].append(n)
    return gone


FIELDS = [
    "Posted by {} in the general discussion forum today",
    "This story was written by {} for our readers today",
    "{} shared this article with you and friends through the newsletter service",
    "Thank you {} for visiting our web site and for reading about the news of the day here with us again",
    "Our warmest thanks go to {} of {} who wrote to us about the old bridge and who sent the pictures that you see below",
    "Our editors wish to thank the writer {} whose letters about the town we have read with great pleasure this year",
]


def test_lines_with_word_fields_go(spark):
    """In 200 unlike documents, each with other words in the fields; lines that merely begin alike stay."""
    name = lambda k: prose(40_000 + k, 1)
    fields = lambda i: (f"{name(i)}x{chr(97 + i % 26)}{chr(97 + i // 26)}", name(i + 500))
    rows = [(i, "\n".join([prose(30_000 + i, 60), *(line.format(*fields(i)) for line in FIELDS), "Posted by " + prose(50_000 + i, 7)])) for i in range(200)]
    page = [prose(60_000 + k, 30) for k in range(12)]
    rows += [(500 + i, "\n".join([*page[: i % 12], page[i % 12] + f" edit{i}", *page[i % 12 + 1 :]])) for i in range(20)]  # near copies stay whole
    got = {r.row.doc_id: r for r in lines.without_recurring_lines(documents(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    assert {i: r.n_dropped for i, r in got.items()} == {i: len(FIELDS) * int(0 < i < 200) for i, _ in rows}
    own = lambda t: "\n".join([t.split("\n")[0], t.split("\n")[-1]])
    assert all(got[i].t == own(rows[i][1]) for i in range(1, 200))


def test_lines(spark):
    license_line = "Licensed under the Apache License, Version 2.0."
    rows = [(i, "\n".join([prose(i, 20), license_line, f"page {i} of 99 printed on paper by the office of the printer at night", prose(i + 50, 9), "All right.", ""])) for i in range(6)]
    varied = prose(77, 24).split()
    rows += [(10 + i, prose(200 + i, 5) + "\n" + " ".join([*varied[:20], f"x{chr(97 + i)}", *varied[21:]]) + "\r\n tail") for i in range(4)]
    rows += [(20, rows[0][1]), (21, None), (22, ""), (23, license_line)]
    page = [prose(900 + k, 30) for k in range(12)]
    rows += [(30 + i, "\n".join([*page[:i], page[i] + f" edit{i}", *page[i + 1 :]])) for i in range(9)]  # near copies
    expected = naive_lines(rows)
    assert not any(expected[30 + i] for i in range(9))
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("row", F.lit(1)).withColumn("drop", F.lit(2))
    got = {r.row.doc_id: r for r in lines.without_recurring_lines(df).collect()}
    assert any(expected.values()) and not expected[0] and not expected[20]
    for i, t in rows:
        left = None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if n not in expected[i])
        assert (got[i].t, got[i].n_dropped) == (left, len(expected[i]))
    assert got[23].t == "" and got[21].n_lines == 0


def test_lines_of_the_table(spark, sf, texts):
    expected = naive_lines(sorted(texts.items()))
    assert {r.doc_id: r.n_dropped for r in queries.op7_lines(spark, sf).collect()} == {i: len(d) for i, d in expected.items()}


def test_lines_of_a_passage_in_unlike_documents(spark):
    """The least shingle of most of these lies in the passage; they are unlike and each an origin."""
    passage = prose(4000, 60)
    rows = [(i, prose(4001 + i, 25) + "\n" + passage) for i in range(40)]
    got = {r.row.doc_id: r.n_dropped for r in lines.without_recurring_lines(documents(spark, [t for _, t in rows])).collect()}
    assert got == {i: int(i > 0) for i in range(40)}


@pytest.mark.parametrize("own", [40, 8, 4])
def test_a_line_in_many_distinct_documents_goes(spark, own):
    line = prose(7000, 30)
    rows = [(i, prose(7001 + i, own) + "\n" + line) for i in range(400)]
    page = [prose(7900 + k, 30) for k in range(12)]
    rows += [(500 + i, "\n".join([*page[: i % 12], page[i % 12] + f" edit{i}", *page[i % 12 + 1 :]])) for i in range(60)]  # near copies stay whole
    got = {r.row.doc_id: r.n_dropped for r in lines.without_recurring_lines(documents(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    assert got == {i: int(0 < i < 400) for i, _ in rows}


def test_short_lines_and_lines_without_spaces(spark):
    rows = [(i, "\n".join([prose(5000 + i, 12), "Read more", "}", "7", "转载请注明出处谢谢合作" if i < 3 else prose(5100 + i, 8), "Ah so" if i < 9 else prose(5200 + i, 8)])) for i in range(12)]
    got = {r.row.doc_id: r.t for r in lines.without_recurring_lines(documents(spark, [t for _, t in rows])).collect()}
    for i, t in rows:
        gone = {"Read more", "转载请注明出处谢谢合作"} if i else set()  # in 12 and in 3 documents; "Ah so" in 9 is too few
        assert got[i] == "\n".join(x for x in t.split("\n") if x not in gone)


def test_rows_of_numbers_are_no_template(spark):
    rows = [(i, "\n".join([prose(6000 + i, 15), f"2024-01-0{i + 1} 17.{i} 1013.{i} 0.{i}5 88.{i}", "1999-12-31 10.5 1000.25 0.75 12.5", f"Printed page {i} of 12345"])) for i in range(5)]
    got = {r.row.doc_id: r.t for r in lines.without_recurring_lines(documents(spark, [t for _, t in rows])).collect()}
    assert got == {i: t if i == 0 else "\n".join(t.split("\n")[:2]) for i, t in rows}


# 8: nearest neighbours


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(0, 0.3, 8).tolist() for _ in range(400)] + [[0.5] * 8] * 60 + [None, [float("nan")] * 8, [None] * 8, [float("inf")] * 8, [], [0.1] * 3, [0.2] * 3]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    usable = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for q in (i for i in usable if i % 20 == 0):
        scored = sorted((-int(usable[q] @ usable[c]), c) for c in usable if c != q and len(usable[c]) == len(usable[q]))[:5]
        expected |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    rows = knn.top_k(df, every=20, pivots=12, block_rows=50, query_rows=4).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows} == expected


def test_top_k_of_repeated_rows(spark):
    """OP8_SQL's semantics: each pair of a query row and another identifier's row is a row to rank."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(120)]
    rows += [rows[0]] + [rows[20]] * 7 + [(40, rng.normal(0, 0.3, 6).tolist()) for _ in range(3)] + [rows[7]] * 2
    v = [(i, np.floor(256 * np.array(x, np.float32).astype(float))) for i, x in rows]
    scored = defaultdict(list)
    for q, x in v:
        if q % 20 == 0:
            scored[q] += [(-int(x @ y), c) for c, y in v if c != q]
    expected = sorted((q, r + 1, c, -s) for q, found in scored.items() for r, (s, c) in enumerate(sorted(found)[:5]))
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20, pivots=6, block_rows=16, query_rows=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == expected


# 9: quality


def test_quality_measures(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "bé", "C", " ", "\n", "\t", "#", "|", "!", " a b c ", "\x0b", "😀"]) for _ in range(rng.randint(0, 120))) for _ in range(300)] + ["", None, " \n ", "a b c " * 200, prose(1, 20_000)]
    rows = quality.judge(documents(spark, texts), []).select("row.doc_id", *quality.BASE_COLUMNS, "base_failed", "kept").collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        with_word = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert tuple(r)[1:] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(with_word) - len(set(with_word)), len(covered), failed, not failed)


def test_decision_list(spark):
    good = [prose(i, 80) for i in range(150)]
    bad = [" ".join(w + "***" for w in prose(500 + i, 80).split()) for i in range(150)]
    df = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rules = quality.learn(df, labels)
    assert rules and all(r.precision >= 0.9 for r in rules)
    kept = quality.accepted(df.withColumn("row", F.lit(1)).withColumn("words", F.lit(1)), rules)
    assert kept.columns == [*df.columns, "row", "words"]
    assert {r.doc_id for r in kept.collect()} == set(range(150))
    assert {r.row.doc_id for r in quality.judge(df, rules).filter("kept").collect()} == set(range(150))
    assert quality.learn(df, labels.limit(0)) == [] and quality.learn(df, labels.filter("quality = 1")) == []


def test_quality_uses_no_python(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = quality.judge(df, [quality.Rule((quality.Condition("words", True, 3.0),), 1.0, 1)])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("split(") <= 4


# 10: toxicity


def toxic_corpus(spark):
    rng = random.Random(6)
    texts, y = [], []
    for i in range(600):
        w = prose(i, 60).split()
        toxic = i % 5 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["moron", "idiot!", "SCUM,"]))
        texts.append(" ".join(w))
        y.append(int(toxic))
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    return documents(spark, [*texts, None, "", "é" * 20 + " idiot"]), labels, y


def test_toxicity(spark):
    df, labels, y = toxic_corpus(spark)
    model = toxicity.learn(df, labels)
    rows = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600))
    held = [i for i in range(600) if rows[i].held_out]
    assert sum(rows[i].predicted == y[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert rows[600].score == rows[601].score < 0.5
    assert [(s.start, s.end) for s in rows[602].spans] == [(21, 26)]


def test_toxic_words_beside_unicode_punctuation_and_without_spaces(spark):
    rng = random.Random(9)
    df, labels, y = toxic_corpus(spark)
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id < 600]
    for i in range(600, 1200):  # clauses without spaces
        clause = [chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(40)]
        y.append(int(i % 5 == 0))
        clause[20:20] = ["笨蛋"] if y[i] else []
        rows.append((i, "".join(clause) + "。"))
    rows = [(i, t + " ÉCUME" if y[i] and i < 600 else t) for i, t in rows]
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    odd = ["you “moron” there", "a moron… no", "quel\u00a0moron\u00a0!", "une écume, là", "你是笨蛋！", "他说“笨蛋”。"]
    model = toxicity.learn(documents(spark, [t for _, t in rows], [i for i, _ in rows]), labels)
    got = {r.doc_id: r for r in toxicity.score(documents(spark, [*odd, "“more” … là"]), model).collect()}
    found = [{odd[i][s.start : s.end].lower() for s in got[i].spans} for i in range(len(odd))]
    assert all(w in f for w, f in zip(["moron"] * 3 + ["écume"] + ["笨蛋"] * 2, found, strict=True)) and not got[len(odd)].spans


def test_other_inflections_of_a_toxic_stem(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("aeioubdfgklmnprst") for _ in range(6))
    texts, y = [], []
    for i in range(900):
        w = prose(8000 + i, 60).split()
        y.append(int(i % 5 == 0))
        for _ in range(3 if y[i] else 0):
            w.insert(rng.randrange(len(w)), "zwolk" + word())
        texts.append(" ".join(w))
    df, labels = documents(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    rows = [r for r in toxicity.score(df, toxicity.learn(df, labels)).collect() if r.held_out]
    assert all(r.predicted == y[r.doc_id] for r in rows) and all(texts[r.doc_id][s.start : s.end].startswith("zwolk") for r in rows for s in r.spans)


def test_marginals_are_those_of_every_labelling():
    rng = np.random.default_rng(3)
    model = toxicity.Model(np.arange(3, dtype=np.uint64), rng.normal(0, 2, 3), -1.0, rng.normal(0, 1, (2, 2)), np.zeros(4))
    for n, at, place in ((7, [0, 3, 6], [0, 1, 2]), (5, [2], [1]), (6, [1, 2], [0, 0]), (1, [0], [2])):
        weights = np.zeros(n) + model.bias
        weights[at] += model.weights[place]
        total, hit = 0.0, np.zeros(n)
        for mask in range(1 << n):
            s = [mask >> i & 1 for i in range(n)]
            v = np.exp(sum(weights[i] for i in range(n) if s[i]) + sum(model.step[s[i], s[i + 1]] for i in range(n - 1)))
            total += v
            hit += v * np.array(s)
        assert np.allclose(model.marginals(n, at, [model.bias + model.weights[p] for p in place]), (hit / total)[at])


def test_labels_of_held_out_rows_are_not_used(spark):
    df, labels, _ = toxic_corpus(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(df, labels), toxicity.learn(df, turned)
    assert (a.lexicon == b.lexicon).all() and np.allclose(a.weights, b.weights) and np.allclose(a.document, b.document)
    empty = toxicity.learn(df, labels.limit(0))
    assert toxicity.score(df, empty).filter("score <> 0").count() == 0


# odd tables for all


def operators(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return {
        "1": lambda d: neardup.near_duplicates(d),
        "1 keep": lambda d: neardup.one_of_each(d),
        "2": lambda d: bpe.round_trip_digests(d),
        "3": lambda d: packing.pack(d),
        "4": lambda d: pii.find(d, pii.learn(d, rounds=5)),
        "4 redact": lambda d: pii.redacted(d, pii.learn(d, rounds=5)),
        "5": lambda d: substrings.without_repeats(d),
        "6": lambda d: sst.read(spark, sst.write(d, interim.new_path(spark, "odd"))),
        "7": lambda d: lines.without_recurring_lines(d),
        "9": lambda d: quality.judge(d, quality.learn(d, labels)),
        "10": lambda d: toxicity.score(d, toxicity.learn(d, labels)),
    }


ODD_ROWS = [(0, None), (1, ""), (None, " "), (3, "word"), (4, "x" * 300_000), (5, "a b c d e f " * 20_000), (6, "tie"), (6, "tie")]
CLASHING = ("row", "t", "id", "h", "g", "class", "place", "words", "keys", "score", "key", "labels", "size")


def odd_rows(spark):
    return documents(spark, [t for _, t in ODD_ROWS], [i for i, _ in ODD_ROWS]).select("*", *(F.lit(1).alias(c) for c in CLASHING))


def n_ids(name, end):
    plain = library(name)
    return Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids) + end) for i, t in ODD_ROWS)


def odd_results():
    """What each operator gives for ODD_ROWS, from its rows."""
    plain = library("byte_bpe_50k.json")
    words = lambda t: len((t or "").split())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    no_spans = sha("")
    digest = lambda t: sha(",".join(map(str, plain.encode(t or "", add_special_tokens=False).ids)))
    repeated = lambda t: len(t or "") if len(t or "") > 1000 else 0
    n_bytes = lambda t: len(t or "")
    return {
        "1": (lambda r: (r.doc.id, r.rep_id, r.class_id, r.n_links), [(i, i, i, int(t == "tie")) for i, t in ODD_ROWS]),
        "1 keep": (lambda r: (r.doc_id, r.text, r.row), [(i, t, 1) for i, t in ODD_ROWS]),
        "2": (lambda r: (r.doc_id, r.ids_sha256, r.decoded_sha256), [(i, digest(t), sha(t or "")) for i, t in ODD_ROWS]),
        "3": (lambda r: (r.doc_id, r.doc_tokens) if r.start == 0 else None, n_ids("word_bpe_49k.json", 1)),
        "4": (lambda r: (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans), [(i, 0, 0, 0, 0, no_spans, "") for i, t in ODD_ROWS]),
        "4 redact": (lambda r: (r.doc_id, r.text, r.t), [(i, t, 1) for i, t in ODD_ROWS]),
        "5": (lambda r: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans), [(i, n_bytes(t), repeated(t), int(repeated(t) > 0)) for i, t in ODD_ROWS]),
        "6": (lambda r: (r.doc_id, r.n_tokens), n_ids("byte_bpe_50k.json", 1)),
        "7": (lambda r: (r.row.doc_id, r.t, r.n_lines, r.n_dropped), [(i, t, int(t is not None), 0) for i, t in ODD_ROWS]),
        "9": (lambda r: (r.row.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept), [(i, words(t), words(t) if words(t) > 3 else 0, True, False) for i, t in ODD_ROWS]),
        "10": (lambda r: (r.doc_id, r.held_out, r.score, r.predicted, len(r.spans)), [(i, i is None or zlib.crc32(str(i).encode()) % 3 == 1, 0.0, 0, 0) for i, t in ODD_ROWS]),
    }


@pytest.mark.parametrize("which", ["1", "1 keep", "2", "3", "4", "4 redact", "5", "6", "7", "9", "10"])
def test_odd_tables(spark, which):
    """Nulls, empty and long texts, ties, repeated rows and clashing names give the rows that the docstrings define; an empty table gives none."""
    f = operators(spark)[which]
    assert f(documents(spark, [])).count() == 0
    of_row, expected = odd_results()[which]
    assert Counter(x for r in f(odd_rows(spark)).collect() if (x := of_row(r)) is not None) == Counter(expected)


def test_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, docs = {name[0]: f for name, f in pipeline.STAGES}, odd_rows(spark)
    for f in stages.values():
        assert f(spark, documents(spark, []), str(tmp_path)).count() == 0
    assert stages["9"](spark, docs, str(tmp_path)).count() == 0  # fewer than 50 words, or repeats throughout
    good = documents(spark, [prose(1, 80), None, ""])
    assert [r.doc_id for r in stages["9"](spark, good, str(tmp_path)).collect()] == [0]
    for k in "714":  # nothing recurs, no two rows but equal ones are alike, nothing is personal
        out = stages[k](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and Counter((r.doc_id, r.text, r.n_chars, r.row) for r in out.collect()) == Counter((i, t, None if t is None else len(t), 1) for i, t in ODD_ROWS)
    assert Counter((r.doc_id, r.doc_tokens) for r in stages["3"](spark, docs, str(tmp_path)).collect() if r.start == 0) == n_ids("word_bpe_49k.json", 1)


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, score int, cell int, row int, `group` int"
    given = lambda *rows: spark.createDataFrame([(i, v, 1, 1, 1, 1) for i, v in rows], schema)
    found = lambda df: sorted(tuple(r) for r in knn.top_k(df, k=3).collect())
    assert found(given()) == [] and found(given((0, [1.0]))) == []
    one = 256 * 256
    assert found(given((0, [1.0]), (None, [1.0]), (1, [1.0]), (2, None), (3, [None]), (4, [float("nan")]), (5, []), (6, [1.0, 1.0]))) == [(0, 1, 1, one)]
    # two rows of the query, each with both others as partners; ties to the smaller identifier
    assert found(given((0, [1.0]), (0, [1.0]), (2, [1.0]), (1, [1.0]))) == [(0, 1, 1, one), (0, 2, 1, one), (0, 3, 2, one)]


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stage = docs.columns, {}
    for name, f in pipeline.STAGES:
        docs = interim.stored(f(spark, docs, sf), "stage-test")
        stage[name[0]] = docs
        assert name[0] == "3" or docs.columns == columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    after_quality, after_lines, after_near, after_pii = (texts(stage[k]) for k in "9714")
    dropped = naive_lines(sorted(after_quality.items()))
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in dropped[i]) for i, t in after_quality.items()}
    assert after_lines == {i: t for i, t in left.items() if t.strip() or not dropped[i]}
    _, root = naive_links(after_lines)
    assert set(after_near) == {i for i in after_lines if root[i] == i}
    assert set(after_pii) == set(after_near) and not any(pii.base_spans(t) for t in after_pii.values())
    plain = library("word_bpe_49k.json")
    assert {r.doc_id: r.doc_tokens for r in stage["3"].collect()} == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in after_pii.items()}
