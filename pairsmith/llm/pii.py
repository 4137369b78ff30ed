"""Personal data by fixed patterns and a semi-Markov conditional random field.

Fixed patterns give the base spans, which always stay.  The random field then reads
regions of digits or around an at-sign: a region is a row of tokens, a segment is a run
of at most ``MAX_TOKENS`` tokens, and whole-span features (digits, groups, separators,
checksum, part values, surroundings) score it as one of four kinds or as plain text.
Dynamic programming over segments chooses boundaries and kinds together, so that for
instance two card numbers divided by one space, which form one failing match, are
found as two.  Its spans are added where they overlap no base span of any kind.  Of
segmentations of equal score the one with the earlier and shorter spans stays.

Null and empty texts have no spans.  Of a long region, such as a table of digits, only the
segments of ``BLOCK_TOKENS`` tokens are held at a time, besides two numbers for each token.
Rows are judged one by one; repeated rows get equal results.  An empty table gives an empty
table and a model from generated examples alone.  ``find`` reads no other columns, and in
``redacted`` they travel in a struct and cannot clash.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsmith.llm import _vec

KINDS = ("email", "ip", "card", "phone")
#: Longest segment in tokens, and the rows, first by a hash of the identifier, whose regions train the field.
MAX_TOKENS = 20
TRAINING_ROWS = 4_000
TRAINING_REGIONS = 300
#: Longer regions train nothing and are not remembered; they are searched like others.
SHORT_REGION = 200
_REMEMBERED_REGIONS = 50_000
#: Tokens whose segments are scored at a time.
BLOCK_TOKENS = 2048

# fixed patterns of the contract; possessive where it cannot change a match
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Regions: digits with what may stand between their groups, or what surrounds an at-sign.
_REGION = re.compile(r"(?:[+(] ?)?[0-9](?:[ ().+-]{0,3}[0-9])++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, last := m.end()))
        at = text.find("@", at + 1)
    return out


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; code points."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_at_most_255, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def regions(text: str) -> list[tuple[int, int]]:
    """Where the random field looks: disjoint ranges with digits enough, or with an at-sign."""
    found = [m.span() for m in _REGION.finditer(text) if m.end() - m.start() >= 7] if _DIGIT.search(text) else []
    at = text.find("@")
    while at >= 0:
        a = at
        while a > 0 and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1)
        found.append((a, m.end() if m else at + 1))
        at = text.find("@", at + 1)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


_FEATURES = {f: i for i, f in enumerate(["at", "no_at", "dotted_domain", "four_parts", "part_over_255", "luhn", "no_luhn", "plus", "no_plus", "letters", "starts_at_edge", "ends_at_edge", "digits_7_8", "digits_9_12", "digits_13_15", "digits_16_19", "digits_20_more", "digits_6_less", "groups_1", "groups_4_equal", "groups_3_6", "groups_7_more", "dots_only", "spaces", "hyphens", "brackets", "before_digit", "after_digit", "ends_in_mark"])}
_N = len(_FEATURES)


class Tokens:
    """The tokens of a region (runs of digits, runs of letters, single others) and counts up to each, from which segments are described."""

    def __init__(self, text: str, start: int, end: int):
        lo = max(0, start - 2)
        codes = np.frombuffer(text[lo : end + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        inside = np.arange(start - lo, end - lo)
        digit = (codes >= 48) & (codes <= 57)
        letter = (codes >= 65) & (codes <= 90) | (codes >= 97) & (codes <= 122)
        kind = (digit + 2 * letter)[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
        self.at = at = np.append(inside[new], end - lo)  # within the codes
        self.shift, self.n = lo, len(at) - 1
        own = codes[at[:-1]]
        is_digit, is_letter = digit[at[:-1]], letter[at[:-1]]
        wide = {c for c in np.unique(codes[codes > 127]).tolist()}
        alnum = digit | letter | np.isin(codes, [c for c in wide if chr(c).isalnum()])
        any_digit = digit | np.isin(codes, [c for c in wide if chr(c).isdigit()])
        size = np.diff(at)
        counts = {
            "any_digits": np.where(is_digit, size, any_digit[at[:-1]]),
            "groups": is_digit,
            "fours": is_digit & (size == 4),
            "letters": is_letter,
            "marks": ~is_digit & ~is_letter,
            "dots": own == 46,
            "spaces": own == 32,
            "hyphens": own == 45,
            "brackets": (own == 40) | (own == 41),
            "ats": own == 64,
        }
        self.upto = {name: np.concatenate([[0], np.cumsum(c)]) for name, c in counts.items()}
        # digits up to each character, and their checksums with every second one doubled
        value = np.where(digit, codes - 48, 0)
        before = np.concatenate([[0], np.cumsum(digit)])
        doubled = 2 * value - 9 * (value > 4)
        odd = (before[:-1] & 1).astype(bool)
        self.digits = before[at]
        self.checksums = [np.concatenate([[0], np.cumsum(np.where(odd == bool(turn), value, doubled))])[at] for turn in (0, 1)]
        # a group of digits is at most 255: nothing but zeros before its last three
        nonzero = np.concatenate([[0], np.cumsum(value > 0)])
        last = at[1:] - 1
        figure = sum(10**k * np.where(size > k, value[(last - k).clip(0)], 0) for k in range(3))
        self.low_part = is_digit & (figure <= 255) & (nonzero[(at[1:] - 3).clip(at[:-1])] == nonzero[at[:-1]])
        self.is_digit, self.is_dot = is_digit, own == 46
        padded_alnum, padded_digit, padded = (np.concatenate([[0, 0], x, [0, 0]]) for x in (alnum, any_digit, codes))
        stop = np.isin(padded, [32, 45, 46])
        self.starts_at_edge = ~padded_alnum[at[:-1] + 1].astype(bool)
        self.ends_at_edge = ~padded_alnum[at[1:] + 2].astype(bool)
        self.before_digit = stop[at[:-1] + 1] & padded_digit[at[:-1]].astype(bool)
        self.after_digit = stop[at[1:] + 2] & padded_digit[at[1:] + 3].astype(bool)
        self.ends_alnum = alnum[at[1:] - 1]
        self.first_plus = own == 43
        self.first_mark = np.isin(own, [32, 45, 46, 41])
        self.can_start = alnum[at[:-1]] | np.isin(own, [43, 40])
        self.text = text

    def span(self, i: int, j: int) -> tuple[int, int]:
        return int(self.at[i]) + self.shift, int(self.at[j]) + self.shift

    def segments(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ranges [i, j) that may be spans, with first <= i < last, by i and j."""
        starts = np.flatnonzero(self.can_start[first:last]) + first
        i = np.repeat(starts, MAX_TOKENS)
        j = i + np.tile(np.arange(1, MAX_TOKENS + 1), len(starts))
        i, j = i[j <= self.n], j[j <= self.n]
        digits, ats = (self.upto[c][j] - self.upto[c][i] for c in ("any_digits", "ats"))
        use = self.ends_alnum[j - 1] & (digits <= 19 + 30 * (ats > 0)) & ((digits >= 4) | (ats > 0))
        return i[use], j[use]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Features of whole segments and of the characters beside them, one row of ``_FEATURES`` for each."""
        c = {name: x[j] - x[i] for name, x in self.upto.items()}
        n, g = self.digits[j] - self.digits[i], c["groups"]
        checksum = np.where(self.digits[j] & 1, self.checksums[0][j] - self.checksums[0][i], self.checksums[1][j] - self.checksums[1][i])
        card_size, whole = (n >= 13) & (n <= 19), checksum % 10 == 0
        parts = (j - i == 7) & (g == 4) & (c["dots"] == 3)
        if parts.any():
            k = i[parts]
            parts[parts] = np.all([self.is_digit[k + x] for x in (0, 2, 4, 6)], axis=0)
        low = np.zeros(len(i), bool)
        if parts.any():
            low[parts] = np.all([self.low_part[i[parts] + x] for x in (0, 2, 4, 6)], axis=0)
        domain = np.zeros(len(i), bool)
        for k in np.flatnonzero(c["ats"] > 0):
            a, b = self.span(i[k], j[k])
            domain[k] = _emails(self.text[a:b]) == [(0, b - a)]
        fours = (g > 1) & (c["fours"] == g)
        f = {
            "at": c["ats"] > 0,
            "no_at": c["ats"] == 0,
            "plus": self.first_plus[i],
            "no_plus": ~self.first_plus[i],
            "dotted_domain": domain,
            "four_parts": parts & low,
            "part_over_255": parts & ~low,
            "luhn": card_size & whole,
            "no_luhn": card_size & ~whole,
            "letters": c["letters"] > 0,
            "digits_6_less": n <= 6,
            "digits_7_8": (n >= 7) & (n <= 8),
            "digits_9_12": (n >= 9) & (n <= 12),
            "digits_13_15": (n >= 13) & (n <= 15),
            "digits_16_19": (n >= 16) & (n <= 19),
            "digits_20_more": n >= 20,
            "groups_1": g == 1,
            "groups_4_equal": fours,
            "groups_3_6": (g > 1) & ~fours & (g <= 6),
            "groups_7_more": (g > 6) & ~fours,
            "dots_only": (c["marks"] > 0) & (c["marks"] == c["dots"]),
            "spaces": c["spaces"] > 0,
            "hyphens": c["hyphens"] > 0,
            "brackets": c["brackets"] > 0,
            "starts_at_edge": self.starts_at_edge[i],
            "ends_at_edge": self.ends_at_edge[j - 1],
            "before_digit": self.before_digit[i],
            "after_digit": self.after_digit[j - 1],
            "ends_in_mark": ~self.ends_alnum[j - 1] | self.first_mark[i],
        }
        return np.stack([f[name] for name in _FEATURES], axis=1).astype(np.float64)


def best_spans(tokens: Tokens, scored) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation; a token outside segments scores 0.

    ``scored`` gives the scores of the four kinds for segments [i, j).  Values are handed
    on from each token to the ends of the segments that start there, so only the segments
    of one block of tokens are held.
    """
    n = tokens.n
    value, kind, start = array("d", [0.0]) + array("d", [-math.inf]) * n, array("b", [-1]) * (n + 1), array("q", [0]) * (n + 1)
    done = 0  # tokens whose value is final
    for first in range(0, n, BLOCK_TOKENS):
        i, j = tokens.segments(first, min(n, first + BLOCK_TOKENS))
        if len(i):
            scores = scored(i, j)
            best = scores.argmax(axis=1)
            for a, b, k, v in zip(i.tolist(), j.tolist(), best.tolist(), scores[np.arange(len(i)), best].tolist(), strict=True):
                while done < a:
                    done += 1
                    if value[done] <= value[done - 1]:
                        value[done], kind[done] = value[done - 1], -1
                if (v := value[a] + v) > value[b]:
                    value[b], kind[b], start[b] = v, k, a
    while done < n:
        done += 1
        if value[done] <= value[done - 1]:
            value[done], kind[done] = value[done - 1], -1
    out, j = [], n
    while j > 0:
        if kind[j] < 0:
            j -= 1
        else:
            out.append((kind[j], *tokens.span(start[j], j)))
            j = start[j]
    return out[::-1]


class Lattice:
    """All segments of a short region, with their features, for training."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens = Tokens(text, start, end)
        self.n = self.tokens.n
        i, j = self.tokens.segments(0, self.n)
        self.x = self.tokens.features(i, j)
        self.segments = list(zip(i.tolist(), j.tolist(), strict=True))
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]
        self.starting: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (a, b) in enumerate(self.segments):
            self.ending[b].append(k)
            self.starting[a].append(k)

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """P(segment, kind) by the forward-backward sums over all segmentations."""
        forward, backward = [0.0] + [-math.inf] * self.n, [-math.inf] * self.n + [0.0]
        total = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        for j in range(1, self.n + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[self.segments[k][0]] + total[k] for k in self.ending[j])])
        for i in range(self.n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[self.segments[k][1]] + total[k] for k in self.starting[i])])
        around = np.array([forward[i] + backward[j] - forward[-1] for i, j in self.segments])
        return np.exp(np.minimum(scores + around[:, None], 0)) if len(scores) else scores


def _log_sum(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


class Model:
    def __init__(self, weights: np.ndarray):
        self.weights = weights  # features x kinds
        self.known: dict[tuple[str, str, str], list[tuple[int, int, int]]] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "known": {}}

    def region_spans(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(kind, start, end) within a region; two characters beside it count as surroundings."""
        if end - start > SHORT_REGION:
            return self._best(text, start, end)
        key = (text[max(0, start - 2) : start], text[start:end], text[end : end + 2])
        if (found := self.known.get(key)) is None:
            shift = len(key[0])
            found = [(kind, a - shift, b - shift) for kind, a, b in self._best("".join(key), shift, shift + end - start)]
            if len(self.known) >= _REMEMBERED_REGIONS:
                self.known.clear()
            self.known[key] = found
        return [(kind, a + start, b + start) for kind, a, b in found]

    def _best(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        tokens = Tokens(text, start, end)
        return best_spans(tokens, lambda i, j: tokens.features(i, j) @ self.weights)

    def added_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """What the field finds beyond the base spans; overlaps with a base span of any kind are left to that."""
        out, taken = [], sorted((a, b) for _, a, b in base)
        reach = list(itertools.accumulate((b for _, b in taken), max))
        for a, b in regions(text):
            for s in self.region_spans(text, a, b):
                k = bisect.bisect_left(taken, (s[2],))  # base spans that start before the end of this one
                if not k or reach[k - 1] <= s[1]:
                    out.append(s)
        return out


def generated_examples(n: int = 120, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with known spans for every kind, and texts without any."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid: bool = True) -> str:
        body = rng.choice("3456") + digits(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        s = body + (check if valid else str((int(check) + 1 + rng.randrange(8)) % 10))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(20, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}"])

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def email() -> str:
        word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(3, 8)))
        return f"{word()}.{rng.randint(1, 99)}@{word()}.{rng.choice(['com', 'org', 'example'])}"

    makers = (email, ip, card, phone)
    plain = (lambda: card(False), lambda: digits(rng.randint(5, 12)), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: digits(rng.randint(20, 30)), lambda: f"{digits(4)} {digits(5)} {digits(3)}", lambda: f"@{digits(3)} x")
    out = []
    for i in range(n):
        text, spans = "xx ", []
        for _ in range(1 + (i % 3 == 0)):
            if rng.random() < 0.6:
                kind = rng.randrange(4)
                s = makers[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = rng.choice(plain)()
            text += s + " "
        out.append((text + "yy", spans))
    return out


def learn(df: DataFrame, text: str = "text", id: str = "doc_id", max_rows: int = TRAINING_ROWS, rounds: int = 120) -> Model:
    """Fit on the driver: at most ``TRAINING_REGIONS`` short regions of at most ``max_rows`` rows with their base spans, pairs of them side by side, generated examples.

    Regions are cut out where the texts are; only those that train reach the driver.
    """
    chosen = df.select(F.col(id).alias("chosen")).dropna().orderBy(F.xxhash64("chosen"), "chosen").limit(max_rows)
    rows = df.select(F.col(id).alias("chosen"), F.col(text).alias("t")).filter(F.col("t").rlike("[0-9]{3}|@")).join(F.broadcast(chosen), "chosen").select(F.xxhash64("chosen").alias("key"), "t")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in _vec.steps(batches):
            found = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                short = [(a, b) for a, b in regions(t) if b - a <= SHORT_REGION][:TRAINING_REGIONS]  # no more can be of use
                base = base_spans(t) if short else []
                for place, (a, b) in enumerate(short):
                    lo = max(0, a - 2)
                    found.append((key, place, t[lo : b + 2], [(k, x - lo, y - lo) for k, x, y in base if a <= x and y <= b]))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            spans = [[{"kind": k, "a": a, "b": b} for k, a, b in own] for own in columns[3]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(spans, pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])))], names=["key", "place", "region", "spans"])

    found = rows.mapInArrow(cut_out, "key long, place int, region string, spans array<struct<kind:int,a:int,b:int>>").orderBy("key", "place", "region").limit(TRAINING_REGIONS).collect()
    examples, single = generated_examples(), [(r.region, [tuple(x) for x in r.spans]) for r in found]
    examples += single
    labelled = [(t[s[0][1] : s[0][2]], s[0][0]) for t, s in single if len(s) == 1]
    for (a, j), (b, k) in zip(labelled[::2], labelled[1::2], strict=False):
        examples.append((f"x {a} {b} y", [(j, 2, 2 + len(a)), (k, 3 + len(a), 3 + len(a) + len(b))]))
    lattices, gold = [], []
    for t, spans in examples:
        for a, b in regions(t):
            lattice = Lattice(t, a, b)
            y = np.zeros((len(lattice.segments), len(KINDS)))
            for k, (i, j) in enumerate(lattice.segments):
                for kind, x, e in spans:
                    if lattice.tokens.span(i, j) == (x, e):
                        y[k, kind] = 1
            if len(lattice.segments):
                lattices.append(lattice)
                gold.append(y)
    w, speed, square = np.zeros((_N, len(KINDS))), 0.0, 0.0
    for r in range(1, rounds + 1):
        grad = -2e-4 * w
        for lattice, y in zip(lattices, gold, strict=True):
            grad += lattice.x.T @ (y - lattice.marginals(lattice.x @ w)) / len(lattices)
        speed, square = 0.9 * speed + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w = w + 0.3 * (speed / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-9)
    return Model(w)


def find(df: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone of the base spans, base_sha256, spans, n_added, redacted): spans of both, redacted null where there are none."""
    names = [id, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch, _, _ in _vec.steps(batches):
            counts, digests, spans, added_n, redacted = [[] for _ in KINDS], [], [], [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t) if t else []
                added = model.added_spans(t, base) if t else []
                both = sorted(base + added) if added else base
                for k, c in enumerate(counts):
                    c.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else nothing)
                spans.append(joined(both))
                added_n.append(len(added))
                redacted.append(redact(t, both) if both else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added_n, pa.int64()), pa.array(redacted, pa.string())], names=names)

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id), F.col(text)).mapInArrow(run, f"{_vec.quoted(id)} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by the name of its kind."""
    out, last = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redacted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The same rows and columns, spans replaced in the text; other columns travel in a struct."""
    packed = df.select(F.struct("*").alias("row"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, t in enumerate(texts):
                if t and (base := base_spans(t)) + (added := model.added_spans(t, base)):
                    texts[i] = redact(t, base + added)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "t"])

    from pyspark.sql import types as T

    out = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("t", T.StringType())]))
    return out.select(*(F.col("t").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns))
