"""Token ids of whole texts, with a bounded memory of recent words.

Both tokenizer files cut a text at a space that follows a character other than
white space, whatever stands around it.  So a text can be encoded word by word
and a word that was seen before need not be encoded again.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import regex

#: Words that a worker remembers, in each of two generations, and the most characters of such a word: with at
#: most four bytes of text or ids for each character, and 200 bytes of overhead, a generation takes 100 MB at most.
REMEMBERED_WORDS = 200_000
REMEMBERED_CHARACTERS = 40
#: How byte-level vocabularies of this family split a text before merging (fixed value of the format).
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space beside a space or a line break: pairs of those two, or others, which seldom stand in a text.
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_OTHERS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ASCII_OTHERS = [c for c in _OTHERS if c.isascii()]


def words_with_space(text: str) -> tuple[str, list[str]]:
    """The text up to its first cut, and the words after each cut's space (the space left out).

    In texts whose only white space is single spaces and line breaks, a line break begins a
    word too, and stays with it; in others no word begins with white space.
    """
    if any(map(text.__contains__, _PAIRS)) or any(map(text.__contains__, _ASCII_OTHERS if text.isascii() else _OTHERS)):
        first, *rest = _CUT.split(text)
    else:
        first, *rest = text.replace("\n", " \n").split(" ")
    return first, rest


def words_without_space(text: str) -> tuple[str, list[str]]:
    """The words between spaces and line breaks, for vocabularies that drop white space."""
    return "", text.replace("\n", " ").split(" ")


class Memory(dict):
    """word -> value, made by ``make`` where it isn't known; the oldest generation is forgotten, long words are at once."""

    def __init__(self, make: Callable[[str], object], room: int = REMEMBERED_WORDS):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > REMEMBERED_CHARACTERS:
                return value
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for shift, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + shift)] = b
    return out


_SPACE_CHARACTER = next(c for c, b in byte_characters().items() if b == 0x20)
_OF_BYTE = {b: c for c, b in byte_characters().items()}


def byte_text(piece: str) -> str:
    """The piece in the characters that stand for its bytes."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_OF_BYTE)


class LibraryWords:
    """Ids of a word by the tokenizers library, as bytes.

    For the two known settings of normaliser and pre-tokeniser, words are split here
    and only the pieces' merges are asked of the library, which is several times
    faster; words with added tokens, or with characters whose normal form or lower
    case depends on more than themselves, go through the whole tokenizer.
    """

    #: Below U+0180 texts are their own NFC, and lower case goes by single characters (but for U+0130).
    _SIMPLE = re.compile("[\x00-įı-ſ]*")

    _MARKS = (",", ".", ";", ":", "!", "?")

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)").search
        self.mark = os.path.commonprefix(added)[:1]  # a quick test: without it no added token is there
        self.split, self.lower = None, False
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        byte_level = {"type": "ByteLevel", "add_prefix_space": False}
        if norm is None and byte_level.items() <= pre.items() and pre.get("use_regex", True):
            self.split = regex.compile(BYTE_LEVEL_SPLIT).findall
        elif norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence":
            first, second = pre["pretokenizers"]
            if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and byte_level.items() <= second.items() and not second["use_regex"]:
                self.split, self.lower = regex.compile(first["pattern"]["Regex"]).findall, True
        self.pieces = Memory(self._piece, REMEMBERED_WORDS // 4)  # of words that are not plain letters
        self.words = Memory(self._lower_word if self.lower else self._spaced_word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        if self.split is None:
            return [self.alone(t) for t in texts]
        return encode_texts(texts, self.words, words_without_space if self.lower else words_with_space, self.alone)

    def _piece(self, piece: str) -> bytes:
        return self._merged(piece if piece.isascii() and piece.isalpha() else byte_text(piece))

    def _merged(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.merge(letters)]).tobytes()

    def _spaced_word(self, word: str) -> bytes:
        """The word behind a space; letters are one piece, and so is one mark behind them."""
        if word.isalpha():
            return self._merged(_SPACE_CHARACTER + (word if word.isascii() else byte_text(word)))
        if word[-1:] in self._MARKS and word[:-1].isalpha():
            return self.words[word[:-1]] + self.pieces[word[-1]]
        if word[:1] == "\n":
            return self.pieces["\n"] + self.alone(word[1:])
        return self.alone(" " + word)

    def _lower_word(self, word: str) -> bytes:
        if word.isascii() or self._SIMPLE.fullmatch(word):
            low = word.lower()
            if low.isalpha():
                return self._piece(low) if low == word else self.words[low]
            if low[-1:] in self._MARKS and low[:-1].isalpha():
                return self.words[low[:-1]] + self.pieces[low[-1]]
        return self.alone(word)

    def alone(self, word: str) -> bytes:
        if self.split is None or self.mark in word and self.added(word) or self.lower and not word.isascii() and not self._SIMPLE.fullmatch(word):
            return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        pieces = self.split(word.lower() if self.lower else word)
        return self.pieces[pieces[0]] if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))


_libraries: dict[tuple[str, str], LibraryWords] = {}


def library(path: str, dtype: str) -> LibraryWords:
    """One encoder, with its memory of recent words, for each worker process and file."""
    if (path, dtype) not in _libraries:
        _libraries[path, dtype] = LibraryWords(path, dtype)
    return _libraries[path, dtype]


def encode_texts(texts: list[str], memory: Memory, cut: Callable[[str], tuple[str, list[str]]], alone: Callable[[str], bytes]) -> list[bytes]:
    """The ids of each text as bytes; ``alone`` encodes what stands before the first cut."""
    get, out = memory.__getitem__, []
    for t in texts:
        first, rest = cut(t)
        ids = b"".join(map(get, rest))
        out.append(alone(first) + ids if first else ids)
    return out


def vocabulary_path(name: str) -> str:
    """Where the public tokenizer file stands on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
