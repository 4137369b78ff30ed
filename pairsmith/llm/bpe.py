"""Byte-pair encoding and decoding of whole texts.

A piece's adjacent pairs stand in the leaves of a segment tree as (rank, place).
The root is the least of them: the leftmost pair of the lowest rank.  A merge
changes at most three leaves, each in logarithmic time, and the piece is done
when no leaf holds a mergeable pair.

Null text counts as empty and gives no ids.  A text of any length is encoded whole; a
piece of n bytes takes memory in proportion to n and time to n log n.  Of equal ranks the
leftmost pair merges.  An empty table gives an empty table;
repeated rows give repeated results; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsmith.llm import _tokens, _vec

_NONE = 1 << 80
#: A pair's entry is rank, merged id and place, from high bits to low; ids stay below 2**20.
_PLACE_BITS, _ID_BITS = 32, 20
_PLACE, _ID = (1 << _PLACE_BITS) - 1, (1 << _ID_BITS) - 1
#: Merging here costs more than in the library, so more words are remembered.
REMEMBERED_WORDS = 500_000
SPLIT = regex.compile(_tokens.BYTE_LEVEL_SPLIT)


def pair_entries(merges: list[tuple[int, int, int]]) -> dict[int, int]:
    """Both ids of a pair -> its entry without a place, from (left, right, merged) in the order of rank."""
    return {a << _ID_BITS | b: (rank << _ID_BITS | merged) << _PLACE_BITS for rank, (a, b, merged) in reversed(list(enumerate(merges)))}


def merge_with_tree(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge adjacent pairs, lowest rank first and leftmost among equals, until none can merge."""
    n = len(ids)
    if n < 2:
        return ids
    get = pairs.get
    size = 1 << (n - 2).bit_length()
    leaves = [_NONE if (e := get(a << _ID_BITS | b)) is None else e | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
    tree = [_NONE] * size + leaves + [_NONE] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    ids = list(ids)
    following, before = list(range(1, n + 1)), list(range(-1, n))
    while (top := tree[1]) != _NONE:
        i = top & _PLACE
        j = following[i]
        k = following[j]
        merged = ids[i] = top >> _PLACE_BITS & _ID
        ids[j] = -1
        following[i] = k
        before[k] = i
        h = before[i]
        changes = [(i, _NONE if k == n or (e := get(merged << _ID_BITS | ids[k])) is None else e | i)]
        if k < n:
            changes.append((j, _NONE))
        if h >= 0:
            changes.append((h, _NONE if (e := get(ids[h] << _ID_BITS | merged)) is None else e | h))
        for leaf, value in changes:
            at = size + leaf
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value
    return [x for x in ids if x >= 0]


class ByteLevelBpe:
    """A byte-level vocabulary in the tokenizers file format: encodes by segment tree, decodes by table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = pair_entries([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        of_byte = _tokens.byte_characters()
        self.first_ids = [0] * 256
        for c, b in of_byte.items():
            self.first_ids[b] = vocab[c]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {k: [v] for k, v in added.items()}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        words = {i: bytes(of_byte[c] if c in of_byte else 0x3F for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        table = [words.get(i, b"") for i in range(max(words) + 1)]
        self.token_bytes = self._table(table)
        self.token_decimals = self._table([b"%d," % i for i in range(len(table))])
        self.pieces = _tokens.Memory(self._encode_piece)
        self.memory = _tokens.Memory(self._spaced_word, REMEMBERED_WORDS)

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(e) for e in entries], dtype=np.int64)
        return np.frombuffer(b"".join(entries), dtype=np.uint8), np.cumsum(n) - n, n

    def _encode_piece(self, piece: str) -> list[int]:
        return merge_with_tree(list(map(self.first_ids.__getitem__, piece.encode("utf-8", "surrogatepass"))), self.pairs)

    def _encode_plain(self, text: str) -> list[int]:
        return [i for piece in SPLIT.findall(text) for i in self.pieces[piece]]

    def encode_ids(self, text: str) -> list[int]:
        """The ids of one text; the strings of added tokens give their ids, as in the library."""
        if self.added_split is None or "<" not in text:
            return self._encode_plain(text)
        return [i for part in self.added_split.split(text) if part for i in (self.added.get(part) or self._encode_plain(part))]

    def _spaced_word(self, word: str) -> bytes:
        """The word behind a space; letters are one piece, and so is one mark behind them."""
        if word.isalpha():
            return array("I", self._encode_piece(" " + word)).tobytes()
        if word[-1:] in _tokens.LibraryWords._MARKS and word[:-1].isalpha():
            return self.memory[word[:-1]] + self._as_bytes(word[-1])
        if word[:1] == "\n":
            return self._as_bytes("\n") + self._as_bytes(word[1:])
        return self._as_bytes(" " + word)

    def _as_bytes(self, text: str) -> bytes:
        return array("I", self.encode_ids(text)).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, dtype="<u4") for b in _tokens.encode_texts(texts, self.memory, _tokens.words_with_space, self._as_bytes)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        return [bytes(_vec.gather(*self.token_bytes, x)[0]).decode("utf-8", "replace") for x in ids]

    def decimals(self, ids: list[np.ndarray]) -> list[bytes]:
        """The ids in decimal, joined by commas."""
        return [bytes(_vec.gather(*self.token_decimals, x)[0][:-1]) for x in ids]


_codecs: dict[str, ByteLevelBpe] = {}


def codec(path: str) -> ByteLevelBpe:
    """One codec, with its memory of recent words, for each worker process and file."""
    if path not in _codecs:
        _codecs[path] = ByteLevelBpe(path)
    return _codecs[path]


def encode(df: DataFrame, text: str = "text", id: str = "doc_id", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, ids array<int>) for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(_tokens.vocabulary_path(vocabulary))
        for batch, _, _ in _vec.steps(batches):
            ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=[id, "ids"])

    return df.select(id, text).mapInArrow(run, f"{_vec.quoted(id)} {df.schema[id].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", id: str = "doc_id", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, text) for every row; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(_tokens.vocabulary_path(vocabulary))
        for batch in batches:
            texts = bpe.decode([np.array(x or [], dtype=np.int64) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id, "text"])

    return df.select(id, ids).mapInArrow(run, f"{_vec.quoted(id)} {df.schema[id].dataType.simpleString()}, text string")


def round_trip_digests(df: DataFrame, text: str = "text", id: str = "doc_id", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Encode and decode every text and return digests of both: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(_tokens.vocabulary_path(vocabulary))
        for batch, _, _ in _vec.steps(batches):
            ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decimals(ids)], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in bpe.decode(ids)], pa.string()),
                ],
                names=[id, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(id), F.col(text)).mapInArrow(run, f"{_vec.quoted(id)} {df.schema[id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
