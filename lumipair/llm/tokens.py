"""What the token operators share: vocabulary files and memory for the pieces of text seen before.

A vocabulary whose words end in a suffix and that lowers its text drops white space, so that no token crosses ASCII white space and a text is
tokenized piece by piece. Natural text repeats its pieces, so every worker remembers them, up to a number of bytes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Collection, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

WORD_BPE = "word_bpe_49k.json"
# What each Python worker remembers of pieces, in bytes of its own memory, and as much of parts.
REMEMBERED_BYTES = 160_000_000
ENTRY_BYTES = 150  # of a piece besides its text
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GROUP_BYTES = 4_000_000
# Longer pieces are rare and not worth remembering.
LONGEST_REMEMBERED = 64


def vocabulary_path(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library_tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Memory:
    """``make(pieces)`` for pieces of text, with the results of short pieces remembered up to a bound of bytes."""

    def __init__(self, make: Callable[[list[bytes]], list[Any]], most_bytes: int = REMEMBERED_BYTES):
        self.make, self.most_bytes, self.held = make, most_bytes, 0
        self.known: dict[bytes, Any] = {}

    def learn(self, pieces: set[bytes]) -> list[bytes]:
        """Make what is not known of ``pieces``; returns the long ones among them, which are to be forgotten after use."""
        new = list(pieces.difference(self.known))
        if new and self.held > self.most_bytes:
            # The pieces at hand stay, as those that are common are among them.
            self.known = {p: self.known[p] for p in pieces.intersection(self.known)}
            self.held = self._bytes(self.known, self.known.values())
        made = self.make(new) if new else []
        self.known.update(zip(new, made, strict=True))
        self.held += self._bytes(new, made)
        return [p for p in new if len(p) > LONGEST_REMEMBERED]

    def forget(self, pieces: list[bytes]) -> None:
        for piece in pieces:
            self.held -= self._bytes([piece], [self.known.pop(piece)])

    @staticmethod
    def _bytes(pieces: Collection[bytes], made: Iterable[Any]) -> int:
        return ENTRY_BYTES * len(pieces) + sum(map(len, pieces)) + sum(len(m) for m in made if isinstance(m, bytes))

    def each(self, groups: list[list[bytes]]) -> Iterator[list[Any]]:
        """The results for each list of pieces; what is not known is made together."""
        long = self.learn(set().union(*groups))
        for pieces in groups:
            yield list(map(self.known.__getitem__, pieces))
        self.forget(long)

    def of(self, pieces: list[bytes]) -> list[Any]:
        return next(iter(list(self.each([pieces]))))


def remembered(texts: list[bytes], own: Vocabulary, memory: Memory, group_bytes: int = GROUP_BYTES) -> Iterator[list[Any]]:
    """What ``memory`` holds for the pieces of each text, ``group_bytes`` of text at a time."""
    group, size = [], 0
    for text in texts:
        group.append(own.pieces(text))
        size += len(text)
        if size >= group_bytes:
            yield from memory.each(group)
            group, size = [], 0
    yield from memory.each(group)


def by_parts(
    own: Vocabulary, make: Callable[[list[bytes]], list[Any]], join: Callable[[list[Any]], Any], most_bytes: int = REMEMBERED_BYTES
) -> Memory:
    """Memory for pieces whose results are joined from those of their parts, which are remembered as well."""
    known = Memory(make, most_bytes)

    def made(pieces: list[bytes]) -> list[Any]:
        cut = list(map(own.parts, pieces))
        long = known.learn(set(chain.from_iterable(cut)))
        of = known.known.__getitem__
        joined = [of(c[0]) if len(c) == 1 else join(map(of, c)) for c in cut]
        known.forget(long)
        return joined

    return Memory(made, most_bytes)


class Vocabulary:
    """Merges, symbols and the cutting of text of a byte-pair vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-pair vocabulary")
        self.ids: dict[str, int] = model["vocab"]
        self.word_end: str = model.get("end_of_word_suffix") or ""
        self.pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on their surroundings")
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path} has a decoder that is not supported: {self.decoder}")
        self._library = library_tokenizer(path)
        self._letters: dict[str, bool] = {}
        normalizers = (spec.get("normalizer") or {}).get("normalizers") or []
        self.by_piece = bool(self.word_end) and any(n["type"] == "Lowercase" for n in normalizers)

    def pieces(self, text: bytes) -> list[bytes]:
        return text.split() if self.by_piece else [text] if text else []

    def parts(self, piece: bytes) -> list[bytes]:
        """A piece as parts that are tokenized like the whole, and that repeat more often than pieces do.

        Letters with marks behind them are two words of their own, and ASCII letters are lowered; anything else stays whole.
        For vocabularies that drop white space and case.
        """
        if not self.by_piece:
            return [piece]
        core = piece.rstrip(MARKS)
        mark = [piece[len(core):]] if len(core) < len(piece) else []
        if core.isalpha():  # of bytes: ASCII letters only
            return [core.lower(), *mark]
        return [core, *mark] if mark and core and all(map(self.is_letter, core.decode("utf-8", "replace"))) else [piece]

    def is_letter(self, character: str) -> bool:
        """Whether the library, after normalisation, takes a character as letters only and so parts it from a mark behind it."""
        known = self._letters.get(character)
        if known is None:
            normalized = self._library.normalizer.normalize_str(character)
            alone = all(unicodedata.category(c)[0] == "L" for c in normalized)
            known = self._letters[character] = alone and [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normalized + '"')][1:] == ['"']
        return known

    def words(self, piece: bytes) -> list[str | int]:
        """The words of a piece, as strings of byte symbols; a special token is given by its id."""
        text, found = piece.decode("utf-8", "replace"), []
        parts = self._special.split(text) if self._special and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                normalizer = self._library.normalizer
                part = normalizer.normalize_str(part) if normalizer else part
                found.extend(word for word, _ in self._library.pre_tokenizer.pre_tokenize_str(part))
        return found

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.word_end]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
