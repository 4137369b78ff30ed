"""Toxic spans by a linear-chain conditional random field.

States: 0 clean, 1 toxic.  A token's features are its identity and its affixes (so other
inflections of a toxic stem are found) if they belong to the lexicon, which is learned
with the weights from documents labelled as wholes: features that stand far more often in
toxic documents mark the labelled tokens.  Forward-backward
gives each token's marginal; a document's score is a logistic function of its marginals,
fitted on the same rows.  Runs of tokens outside the lexicon all take the same step, so
they are passed by a matrix power, and the cost of a text is that of finding its tokens.

Tokens are runs of Unicode letters, marks and numbers in lower case (both small sigmas are
one; a dotted capital I is i); punctuation, spaces, controls and mathematical and currency
signs part them.  Runs of scripts without spaces give overlapping n-grams of characters:
pairs for Han and kana, fours for Thai, Lao, Khmer and Myanmar.  A pictograph (or another
character of no known kind) is a token of its own.
Null and empty texts have no tokens and get the score of no evidence.  Rows with a null
identifier are scored and count as held out.  Repeated rows get equal scores; of labels
that repeat an identifier the toxic one counts.  A text of any length is scored whole, in
memory of about 100 bytes for each of its bytes.  Without any labelled row of both classes
every score is the share of toxic rows (0 if none).  An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.llm import _vec
from pairsmith.sources import interim

#: Labelled rows that the model is learned from, the first by a hash of the identifier.
LABELLED_ROWS = 12_000
#: Features of the lexicon, those that tell the classes apart best, and training sequences around them.
LEXICON_TOKENS = 2_000
#: Toxic labelled documents that a feature of the lexicon stands in, and how far from chance.
LEAST_TOXIC, LEAST_Z = 5, 6.5
TRAINING_WINDOWS = 20_000
#: Parts in which the windows anywhere are drawn.
PARTS = 64
#: Tokens on either side of a lexicon token in a training sequence.
CONTEXT = 8

#: Kinds of characters: separators, those of words, of two groups of scripts without spaces, and single symbols.
WORD, PAIRS, FOURS, SINGLE = 1, 2, 3, 4
#: Characters in a token of each kind; 0: the whole run.
_GRAM = np.array([0, 0, 2, 4, 1])
_PAIRED = ((0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3041, 0x30FF), (0x3100, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
_FOURED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F))


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """The kind and the lower case of every code point."""
    names = [unicodedata.category(chr(c)) for c in range(0x110000)]
    of = {c: WORD if c[0] in "LMN" else SINGLE if c in ("So", "Sk", "Co", "Cn") else 0 for c in set(names)}
    kind = np.array([of[c] for c in names], dtype=np.uint8)
    kind[:128][kind[:128] == SINGLE] = 0
    for ranges, which in ((_PAIRED, PAIRS), (_FOURED, FOURS)):
        for first, last in ranges:
            kind[first : last + 1][kind[first : last + 1] == WORD] = which
    lower = np.arange(0x110000, dtype=np.uint32)
    for c, name in enumerate(names):
        if name[0] in "LMNS" and (low := chr(c).lower()) != chr(c):
            lower[c] = ord(low[0])  # only the dotted capital I has two
    lower[ord("ς")] = ord("σ")
    return kind, lower


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 bytes begin, and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.uint32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        head = points[wide]
        more = 1 + (head >= 0xE0).astype(np.int64) + (head >= 0xF0)
        value = head & (np.uint32(0x3F) >> more.astype(np.uint32))
        for k in range(1, 4):
            use = more >= k
            value[use] = (value[use] << np.uint32(6)) | (data[(at[wide[use]] + k).clip(max=len(data) - 1)] & 0x3F)
        points[wide] = value.clip(max=0x10FFFF)
    return at, points


def held_out(id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(True))


#: Affixes of how many characters are features of a longer token, besides the token itself.
PREFIXES, SUFFIXES = (4, 5, 6), (4, 5)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a batch, and their features: hashes of the token and its affixes, 0 for none."""
    where, points = _code_points(data)
    kinds, lower = _characters()
    kind = kinds[points]
    new = np.ones(len(points), bool)
    new[1:] = kind[1:] != kind[:-1]
    edge = np.searchsorted(where, at[1:-1])
    new[edge[edge < len(points)]] = True
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(points)) if len(begin) else begin
    run = kind[begin] > 0
    begin, stop = begin[run], stop[run]
    gram = _GRAM[kind[begin]]
    count = np.where(gram > 0, (stop - begin - gram + 1).clip(min=1), 1)
    gram, stop = np.repeat(gram, count), np.repeat(stop, count)
    first = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(stop))
    last = np.where(gram > 0, np.minimum(first + gram, stop), stop)
    bytes_at = np.append(where, len(data))
    sums, size = _vec.prefix_sums(lower[points]), last - first
    features = np.zeros((len(first), 1 + len(PREFIXES) + len(SUFFIXES)), dtype=np.uint64)
    features[:, 0] = _vec.range_hash(sums, first, last)
    for column, (n, ahead) in enumerate([*((n, True) for n in PREFIXES), *((n, False) for n in SUFFIXES)], 1):
        use = np.flatnonzero(size > n)
        a, b = (first[use], first[use] + n) if ahead else (last[use] - n, last[use])
        features[use, column] = _vec.mix(_vec.range_hash(sums, a, b) + np.uint64(column))
    return bytes_at[first], bytes_at[last], features


@dataclass
class Model:
    """lexicon: sorted hashes of tokens and affixes; weights: of the toxic state for each; step: the transition scores."""

    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))  # weights of the document's evidence
    prior: float = 0.0

    def found(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens have a feature in the lexicon, and the places of their features there, -1 for the others."""
        # the low bits tell most features apart
        known = np.zeros(1 << 16, bool)
        known[(self.lexicon & np.uint64(0xFFFF)).astype(np.int64)] = True
        hits = np.flatnonzero(known[(features & np.uint64(0xFFFF)).astype(np.int64)].any(axis=1))
        if not len(self.lexicon) or not len(hits):
            return hits[:0], np.zeros((0, features.shape[1]), np.int64)
        i = np.searchsorted(self.lexicon, features[hits]).clip(max=len(self.lexicon) - 1)
        place = np.where(self.lexicon[i] == features[hits], i, -1)
        use = (place >= 0).any(axis=1)
        return hits[use], place[use]

    def emission(self, place: np.ndarray) -> np.ndarray:
        """The score of the toxic state for tokens with features at these places."""
        return self.bias + np.append(self.weights, 0.0)[place].sum(axis=-1)

    def marginals(self, n: int, at: list[int], scores: list[float]) -> list[float]:
        """P(toxic) of the tokens ``at`` of a text of n tokens, whose toxic state scores ``scores``; the others are outside the lexicon."""
        t, b = np.exp(self.step), math.exp(self.bias)
        a = [[t[0, 0], t[0, 1] * b], [t[1, 0], t[1, 1] * b]]  # one step onto a token outside the lexicon
        run = _Power(a)
        emit = [math.exp(min(50.0, x)) for x in scores]
        (t00, t01), (t10, t11) = t.tolist()
        # forward: scores just after each token, scaled to sum 1
        forward, x, y, last = [], 1.0, 1.0, -1
        for i, e in zip(at, emit, strict=True):
            if last < 0:
                if i > 0:
                    x, y = run(1.0, b, i - 1)
                    x, y = x * t00 + y * t10, (x * t01 + y * t11) * e
                else:
                    x, y = 1.0, e
            else:
                x, y = run(x, y, i - last - 1)
                x, y = x * t00 + y * t10, (x * t01 + y * t11) * e
            s = x + y
            x, y, last = x / s, y / s, i
            forward.append(y)
        # backward: what follows each token, the matrix applied from the right
        back = _Power([[a[0][0], a[1][0]], [a[0][1], a[1][1]]])
        out = [0.0] * len(at)
        x, y = back(1.0, 1.0, n - 1 - at[-1])
        for k in range(len(at) - 1, -1, -1):
            if k < len(at) - 1:
                e = emit[k + 1]
                x, y = x * t00 + y * e * t01, x * t10 + y * e * t11
                x, y = back(x, y, at[k + 1] - at[k] - 1)
            s = x + y
            x, y = x / s, y / s
            f = forward[k]
            out[k] = f * y / (f * y + (1 - f) * x)
        return out

    def score(self, marginals: list[float]) -> float:
        if not len(self.lexicon):
            return self.prior
        return float(_sigmoid(evidence(marginals) @ self.document))


class _Power:
    """(x, y) times the n-th power of a positive 2 x 2 matrix, scaled."""

    def __init__(self, m: list[list[float]]):
        self.m, self.powers = m, [m]

    def __call__(self, x: float, y: float, n: int) -> tuple[float, float]:
        k = 0
        while n > 0:
            if k == len(self.powers):
                (a, b), (c, d) = self.powers[-1]
                s = max(a * a + b * c, a * b + b * d, c * a + d * c, c * b + d * d)
                self.powers.append([[(a * a + b * c) / s, (a * b + b * d) / s], [(c * a + d * c) / s, (c * b + d * d) / s]])
            if n & 1:
                (a, b), (c, d) = self.powers[k]
                x, y = x * a + y * c, x * b + y * d
                s = x + y
                x, y = x / s, y / s
            n >>= 1
            k += 1
        return x, y


def evidence(marginals: list[float]) -> np.ndarray:
    """What a document's score is a function of: 1, log odds of the largest marginal, log of expected toxic tokens, log odds of any."""
    none = sum(math.log1p(-min(p, 1 - 1e-9)) for p in marginals)
    most = min(max(max(marginals, default=0.0), 1e-4), 1 - 1e-4)
    return np.array([1.0, math.log(most / (1 - most)), math.log1p(sum(marginals)), min(20.0, -none)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", max_rows: int = LABELLED_ROWS, max_tokens: int = LEXICON_TOKENS, max_windows: int = TRAINING_WINDOWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out, a lexicon of at most ``max_tokens`` and about ``max_windows`` windows.

    Tokens are counted, windows cut out and marginals summed up where the texts are: the
    driver gets the lexicon, windows of places in it, and four numbers for each document.
    """
    with interim.scope(documents.sparkSession):
        return _learn(documents, labels, text, id, label, max_rows, max_tokens, max_windows)


def _learn(documents: DataFrame, labels: DataFrame, text: str, id: str, label: str, max_rows: int, max_tokens: int, max_windows: int) -> Model:
    usable = labels.select(F.col(id).alias("label_id"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out(F.col("label_id")))
    chosen = usable.groupBy("label_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    rows = documents.select(F.col(id).alias("label_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "label_id").select(F.xxhash64("label_id").alias("key"), "t", "y")
    rows = interim.stored(rows, "labelled-texts")
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    model = Model(prior=toxic / n if n else 0.0)
    if not n or toxic in (0, n):
        return model
    # features that toxic texts share, then in how many texts each of them stands
    often = rows.filter("y = 1").mapInArrow(_document_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TOXIC)
    toxic_in = {r.feature: r.n for r in often.orderBy(F.desc("n"), "feature").limit(50 * max_tokens).collect()}
    wanted = np.sort(np.array(list(toxic_in), dtype=np.int64).view(np.uint64))
    counts = rows.mapInArrow(lambda b: _document_counts(b, wanted), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    model.lexicon = _lexicon(toxic_in, {r.feature: r.n for r in counts}, toxic / n, max_tokens)
    if not len(model.lexicon):
        return model
    each = max(8, max_windows // len(model.lexicon))
    windows = rows.mapInArrow(lambda b: _windows(b, model, each), "centre int, draw long, x array<int>, toxic boolean")
    place = F.row_number().over(Window.partitionBy("centre").orderBy("draw", "x", "toxic"))
    # each token of the lexicon keeps some windows, and as many windows anywhere are taken beside them
    kept = windows.withColumn("place", place).filter(F.col("place") <= F.when(F.col("centre") < 0, max(1, max_windows // PARTS)).otherwise(each)).select("centre", "x", "toxic").orderBy("centre", "x", "toxic").toArrow()
    _fit_chain(model, np.array(kept.column("x").to_pylist(), dtype=np.int64), np.array(kept.column("toxic").to_pylist(), dtype=bool))
    facts = rows.mapInArrow(lambda b: _evidence(b, model), "e array<double>, y int").orderBy("y", "e").toArrow()
    model.document = _logistic(np.array(facts.column("e").to_pylist(), dtype=np.float64), np.array(facts.column("y").to_pylist(), dtype=np.float64))
    return model


def _document_counts(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(feature, documents with it) of each step's texts (key, t, y)."""
    for batch, data, at in _vec.steps(batches):
        start, _, features = tokens(data, at)
        owner = np.repeat(np.searchsorted(at, start, side="right") - 1, features.shape[1])
        features = features.ravel()
        use = features > 0
        if wanted is not None:
            use &= wanted[np.searchsorted(wanted, features).clip(max=len(wanted) - 1)] == features if len(wanted) else False
        features, owner = features[use], owner[use]
        order = np.lexsort((features, owner))
        features, owner = features[order], owner[order]
        once = np.ones(len(features), bool)
        once[1:] = (features[1:] != features[:-1]) | (owner[1:] != owner[:-1])
        found, n = np.unique(features[once], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(_vec.signed(found)), pa.array(n)], names=["feature", "n"])


def _lexicon(toxic_in: dict[int, int], in_all: dict[int, int], rate: float, most: int) -> np.ndarray:
    """Features that stand far more often in toxic documents than in others: the largest z of the two shares.

    With many features tested, as many standard deviations by chance are rare.
    """
    key = np.array(sorted(toxic_in), dtype=np.int64)
    toxic, n = (np.array([d[k] for k in key.tolist()], dtype=np.float64) for d in (toxic_in, in_all))
    z = (toxic - n * rate) / np.sqrt(n * rate * (1 - rate) + 1e-12)
    good = (z >= LEAST_Z) & ((toxic + rate) / (n + 1) >= min(0.9, 3 * rate))
    return np.sort(key[good][np.argsort(-z[good], kind="stable")][:most].view(np.uint64))


def _windows(batches: Iterator[pa.RecordBatch], model: Model, each: int) -> Iterator[pa.RecordBatch]:
    """(centre's lexicon place or a part below 0, draw, lexicon places of the tokens around it or -1, whether the text is toxic).

    At most ``each`` windows for each lexicon token of a step, the first by their draw, and
    as many anywhere.
    """
    for batch, data, at in _vec.steps(batches):
        start, _, features = tokens(data, at)
        owner = np.searchsorted(at, start, side="right") - 1
        draw = _vec.mix(batch.column(0).to_numpy().view(np.uint64)[owner] + np.arange(len(start), dtype=np.uint64) - np.searchsorted(owner, owner).astype(np.uint64))
        hits, own = model.found(features)
        if not len(hits):
            continue
        place = np.full(features.shape, -1, dtype=np.int32)
        place[hits] = own
        main = own.max(axis=1)  # one of the token's features stands for it
        order = np.lexsort((draw[hits], main))
        hits, main = hits[order], main[order]
        few = np.arange(len(hits)) - np.searchsorted(main, main) < each
        hits, main = hits[few], main[few]
        anywhere = np.argsort(draw, kind="stable")[: len(hits)]
        centres = np.concatenate([hits, anywhere])
        around = centres[:, None] + np.arange(-CONTEXT, CONTEXT + 1)
        inside = (around >= 0) & (around < len(place))
        around = around.clip(0, len(place) - 1)
        x = np.where((inside & (owner[around] == owner[centres][:, None]))[:, :, None], place[around], -1).reshape(len(centres), -1)
        centre = np.concatenate([main, -1 - (draw[anywhere] % np.uint64(PARTS)).astype(np.int64)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(_vec.signed(draw[centres])), lists, pa.array(batch.column(2).to_numpy()[owner[centres]] == 1)], names=["centre", "draw", "x", "toxic"])


def _evidence(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(evidence, y) of each text (key, t, y)."""
    for batch, data, at in _vec.steps(batches):
        start, _, features = tokens(data, at)
        hits, place = model.found(features)
        emission, begin = model.emission(place), np.searchsorted(start, at)
        first = np.searchsorted(hits, begin)
        out = []
        for d in range(batch.num_rows):
            own = slice(first[d], first[d + 1])
            p = model.marginals(int(begin[d + 1] - begin[d]), (hits[own] - begin[d]).tolist(), emission[own].tolist()) if first[d] < first[d + 1] else []
            out.append(evidence(p).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), batch.column(2)], names=["e", "y"])


def _fit_chain(model: Model, x: np.ndarray, toxic: np.ndarray, rounds: int = 150) -> None:
    """Weights, bias and transitions by gradient ascent on windows x of lexicon places, -1 outside; in toxic texts the lexicon's tokens are the toxic ones."""
    width = 2 * CONTEXT + 1
    x = x.reshape(len(x), width, -1)
    gold = (x >= 0).any(axis=2) & toxic[:, None]
    n_tokens = len(model.lexicon)
    theta = np.concatenate([np.zeros(n_tokens), [-4.0], np.zeros(4)])
    flat, known = np.where(x >= 0, x, n_tokens), x >= 0
    speed, square = np.zeros_like(theta), np.zeros_like(theta)
    gold_step = np.zeros((2, 2))
    np.add.at(gold_step, (gold[:, :-1].astype(int).ravel(), gold[:, 1:].astype(int).ravel()), 1)
    for k in range(1, rounds + 1):
        w, b, t = np.append(theta[:n_tokens], 0.0), theta[n_tokens], np.exp(theta[n_tokens + 1 :].reshape(2, 2))
        e = np.exp(np.clip(w[flat].sum(axis=2) + b, -30, 30))
        forward, backward = np.empty((len(x), width, 2)), np.ones((len(x), width, 2))
        forward[:, 0] = np.stack([np.ones(len(x)), e[:, 0]], 1)
        forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
        for i in range(1, width):
            f = forward[:, i - 1] @ t
            f[:, 1] *= e[:, i]
            forward[:, i] = f / f.sum(1, keepdims=True)
        for i in range(width - 2, -1, -1):
            g = backward[:, i + 1].copy()
            g[:, 1] *= e[:, i + 1]
            g = g @ t.T
            backward[:, i] = g / g.sum(1, keepdims=True)
        p = forward * backward
        p = p[:, :, 1] / p.sum(2)
        off = gold - p
        grad = np.zeros_like(theta)
        grad[:n_tokens] = np.bincount(flat[known], weights=np.broadcast_to(off[:, :, None], x.shape)[known], minlength=n_tokens)
        grad[n_tokens] = off.sum()
        after = backward[:, 1:].copy()
        after[:, :, 1] *= e[:, 1:]
        pair = forward[:, :-1, :, None] * t * after[:, :, None, :]
        grad[n_tokens + 1 :] = (gold_step - (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))).ravel()
        grad = grad / len(x) - 1e-4 * theta
        speed, square = 0.9 * speed + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta = theta + 0.15 * (speed / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    model.weights, model.bias, model.step = theta[:n_tokens], float(theta[n_tokens]), theta[n_tokens + 1 :].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge; a step that does not lower the loss is halved."""

    def loss(w: np.ndarray) -> float:
        score = x @ w
        return float((np.logaddexp(0, score) - y * score).sum() + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - then < 1e-9:
            break
        w, now = w + step, then
    return w


def score(df: DataFrame, model: Model, text: str = "text", id: str = "doc_id", threshold: float = 0.7, span_threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted, spans): spans are code points [start, end) with the marginal of each toxic token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_evidence = model.score([])
        for batch, data, at in _vec.steps(batches):
            start, end, features = tokens(data, at)
            hits, place = model.found(features)
            emission = model.emission(place)
            scores = np.full(batch.num_rows, no_evidence)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            begin = np.searchsorted(start, at)
            owner = np.searchsorted(at, start[hits], side="right") - 1
            for lo, hi in _runs(owner):
                d = owner[lo]
                own = hits[lo:hi]
                p = model.marginals(int(begin[d + 1] - begin[d]), (own - begin[d]).tolist(), emission[lo:hi].tolist())
                scores[d] = model.score(p)
                if any(x >= span_threshold for x in p):
                    points = np.cumsum((data[at[d] : at[d + 1]] & 0xC0) != 0x80)  # code points up to each byte
                    spans[d] = [{"start": int(points[start[i] - at[d]]) - 1, "end": int(points[end[i] - at[d] - 1]), "p": x} for i, x in zip(own, p, strict=True) if x >= span_threshold]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))],
                names=[id, "held_out", "score", "predicted", "spans"],
            )

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id), F.col(text), held_out(F.col(id)).alias("held_out")).mapInArrow(run, f"{_vec.quoted(id)} {kind}, held_out boolean, score double, predicted int, spans array<struct<start:bigint,end:bigint,p:double>>")


def _runs(owner: np.ndarray) -> list[tuple[int, int]]:
    if not len(owner):
        return []
    cut = np.flatnonzero(np.diff(owner)) + 1
    return list(zip([0, *cut], [*cut, len(owner)], strict=True))
