"""Ids of the public BPE vocabularies by the tokenizers library, with a cache of whitespace-delimited units.

Both vocabularies split a text before merging, and no split crosses from a non-space character to a following ASCII
whitespace character. So the ids of a text are those of its units (whitespace, then other characters) one after the other,
and a unit that was met before needs no second encoding. Where single spaces and line ends are all the white space, units
are found by splitting at spaces, else by a pattern. Texts with other kinds of white space, and texts in which one of
the vocabularies' special tokens may stand, go to the library whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import regex
from tokenizers import Tokenizer

#: How the two vocabularies split text before the merges.
SPLIT = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: White space (or what a library may count as such) beyond [\x20\x09-\x0D].
ODD = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
#: What each special token of the two vocabularies begins with.
SPECIAL = "<|"
#: A unit of Latin letters (one piece by the rules above) with closing punctuation, which is a piece of its own.
PLAIN = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")
UNIT = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


class _Odd(Exception):
    pass


class _Uneven(Exception):
    """A text holds other white space than a single space or line end before each word."""


def swapped(unit: bytes) -> bytes:
    """A unit's key, and a key's unit: a space before a word goes, where none is one comes; the rest stays.

    So a text's keys are what stands between its spaces.
    """
    if unit[:1] == b" ":
        return unit[1:] if unit[1:2].strip() else unit
    return unit if unit[:1].isspace() else b" " + unit


def even(key: bytes) -> bool:
    """Is it the key of a word with at most a space or a line end before it?"""
    word = key[1:] if key[:1] in (b" ", b"\n") else key
    return word.split() == [word]


def byte_letters() -> str:
    """The printable stand-in of each byte, as byte-level vocabularies spell them."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class UnitEncoder(dict):
    """Key of a unit -> its ids as packed little-endian integers. kind: byte (white space kept) or word (dropped, lower case).

    Units are their own keys for word and have those of swapped() for byte, where only even keys are kept. When units are
    known, they become the old ones and a new generation begins; what is met again comes back from the old ones, so that
    frequent units stay and memory is bounded by two generations.
    """

    def __init__(self, path: str, kind: str, width: int = 4, units: int = 500_000, pieces: int = 100_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.code, self.units, self.most_pieces = kind, {2: "H", 4: "I"}[width], units, pieces
        self.split, self.model, self.pieces, self.old = regex.compile(SPLIT[kind]), self.tokenizer.model, {}, {}
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.packers = [struct.Struct(f"<{n}{self.code}").pack for n in range(64)]
        self.line_end = self.piece("\n")

    def pack(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def merged(self, spelled: str) -> bytes:
        """The packed ids of a piece spelled in the vocabulary's letters, by the library's model."""
        ids = [t.id for t in self.model.tokenize(spelled)]
        return self.packers[len(ids)](*ids) if len(ids) < 64 else self.pack(ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> bytes:
        return self.merged(text.encode().decode("latin-1").translate(self.letters))

    def plain(self, unit: bytes) -> bytes:
        """Of a unit of Latin letters, with a space before it or none: one piece."""
        if self.kind == "byte":
            spelled = unit.decode("latin-1").translate(self.letters)
        elif unit.isascii():
            spelled = unit.lower().decode()
        else:
            return self.piece(unicodedata.normalize("NFC", unit.decode()).lower())
        return self.merged(spelled)

    def __missing__(self, key: bytes) -> bytes:
        ids = self.old.get(key)
        if ids is not None:
            pass
        elif self.kind == "word":
            ids = self.made(key)
        elif key.isalpha():  # ASCII letters spell themselves; a space is before them
            ids = self.merged(self.space + key.decode())
        elif (word := key.rstrip(b".,;:!?")) != key and (word.isalpha() or PLAIN.fullmatch(word)):  # closing punctuation is a piece of its own
            ids = self[word] + self[b" " + key[len(word) :]]
        elif key[:1] == b"\n" and key[1:2] != b" " and PLAIN.fullmatch(key, 1):  # so is a line end before a word
            ids = self.line_end + self[b" " + key[1:]]
        elif even(key):
            ids = self.made(swapped(key))
        else:
            raise _Uneven
        if len(key) < 200:
            if len(self) >= self.units:
                self.old = self.copy()
                self.clear()
            self[key] = ids
        return ids

    def unit(self, unit: bytes) -> bytes:
        """The ids of any unit."""
        key = unit if self.kind == "word" else swapped(unit)
        return self[key] if even(key) else self.made(unit)

    def made(self, unit: bytes) -> bytes:
        word = unit[1:] if unit[:1] == b" " else unit
        if word.isalpha():  # ASCII letters spell themselves
            spelled = word.lower().decode() if self.kind == "word" else word.decode() if word is unit else self.space + word.decode()
            return self.merged(spelled)
        if found := PLAIN.fullmatch(unit):
            return self.unit(found[1]) + self.unit(found[2]) if found[2] else self.plain(unit)
        text = unit.decode()
        if ODD.search(text):
            raise _Odd
        if max(text) <= "\xff":
            if self.kind == "word":
                text = unicodedata.normalize("NFC", text).lower()
            known, found = self.pieces, []
            for piece in self.split.findall(text):
                ids = known.get(piece)
                if ids is None:
                    if len(known) >= self.most_pieces:
                        known.clear()
                    ids = known[piece] = self.piece(piece)
                found.append(ids)
            return b"".join(found)
        return self.whole(text)

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a text; null counts as empty."""
        if not text:
            return b""
        if SPECIAL in text:
            return self.whole(text)
        data = text.encode()
        try:
            if self.kind == "word":
                return b"".join(map(self.__getitem__, data.split()))
            keys = data.replace(b"\n", b" \n").split(b" ")
            keys[0] = b" " + keys[0]
            try:
                return b"".join(map(self.__getitem__, keys))
            except _Uneven:
                return b"".join(map(self.unit, UNIT.findall(data)))
        except _Odd:
            return self.whole(text)


_encoders: dict[tuple, UnitEncoder] = {}


def encoder(path: str, kind: str, width: int = 4) -> UnitEncoder:
    """One for each Python worker; its cache lasts over tasks, until forget()."""
    key = (path, kind, width)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(path, kind, width)
    return _encoders[key]


def forget() -> None:
    """This worker's encoders go, with what they have cached (some 200 MB when full); the next encoder() loads them again."""
    _encoders.clear()
