"""Exact token ids of public tokenizers, with memoised text units.

A text is cut at spaces where the tokenizer is bound to cut as well, and each
distinct unit is encoded by the ``tokenizers`` library once per worker and cache
filling. Texts for which the cut could differ go to the library whole:

* texts with ``<|`` (special strings), and
* for byte-level vocabularies, texts with a space between two white-space
  characters, where the split pattern looks ahead across the cut.

The byte-level pattern starts a pre-token at every space that is followed by a
character other than white space, and a run of white space gives up its last
space to what follows; so cutting before a space is safe unless white space
stands on both of its sides. Word vocabularies drop white space, and neither NFC
nor lower-casing acts across a space.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Most units held by one worker for one vocabulary (about 80 MB with their ids).
CACHE_UNITS = 400_000
#: ASCII marks that always end a run of letters, and never join it.
MARKS = ".,;:!?*%&#$|"

_SPACED = re.compile(r"[\s᠎] (?:[\s᠎]|\Z)")
#: Letters that every Unicode version knows, that NFC leaves alone and that have one lower-case letter.
_LETTERS = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(MARKS)}]*)").fullmatch
if array("I").itemsize != 4 or sys.byteorder != "little":
    raise RuntimeError("ids are written as the machine's unsigned integers: 4 bytes, little-endian")
_encoders: dict[int, "Encoder"] = {}


class Vocabulary:
    """A tokenizer file of the ``tokenizers`` library, sent to executors by broadcast.

    The broadcast is the file's text: a few MB whatever the corpus.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.byte_level = json.loads(text).get("normalizer") is None
        self.shared = spark.sparkContext.broadcast(text)

    def __getstate__(self):
        return {"byte_level": self.byte_level, "shared": self.shared}

    def encoder(self) -> "Encoder":
        """This worker's encoder; it lives as long as the worker."""
        key = hash((self.shared.value, self.byte_level))
        if key not in _encoders:
            _encoders[key] = Encoder(self.shared.value, self.byte_level)
        return _encoders[key]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Units(dict):
    """Unit -> little-endian unsigned 32-bit ids. Letters with marks behind them are letters, then marks."""

    def __init__(self, whole, letters, lead: str, after_line: "_Units | None" = None, line: bytes = b""):
        self.whole, self.letters, self.lead, self.tails = whole, letters, lead, {}
        self.line = line  # ids of a line end, where that is a pre-token
        self.after_line = self if after_line is None else after_line

    def once(self, unit: str) -> bytes:
        """The ids of a unit that the caller keeps itself; nothing is kept here but marks."""
        found = _LETTERS(unit)
        if found is None:
            return self.whole(self.lead + unit)
        core, tail = found.groups()
        return self.letters(core) + self.end(tail) if tail else self.letters(core)

    def end(self, tail: str) -> bytes:
        """The ids of marks behind letters."""
        end = self.tails.get(tail)
        if end is None:
            end = self.whole(tail)
            if len(self.tails) < 10_000:
                self.tails[tail] = end
        return end

    def __missing__(self, unit: str) -> bytes:
        found = _LETTERS(unit)
        if found is None:
            one, _, two = unit.partition("\n")
            if self.line and _LETTERS(one) and _LETTERS(two):  # a lone line end between words
                ids = self[one] + self.line + self.after_line[two]
            else:
                ids = self.whole(self.lead + unit)
        else:
            core, tail = found.groups()
            ids = self[core] + self.end(tail) if tail else self.letters(core)
        if len(self) < CACHE_UNITS:
            self[unit] = ids
        return ids


class Encoder:
    """A vocabulary's ids. Runs of plain letters are single pre-tokens and go straight to the library's merge model."""

    def __init__(self, text: str, byte_level: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model.tokenize
        self.byte_level = byte_level
        letter = {b: c for c, b in byte_letters().items()}
        self.written = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x20, 0x100)}
        self.space = self.written[0x20]
        if byte_level:
            self.firsts = _Units(self.whole, self.merged, "", line=self.whole("\n"))
            self.units = _Units(self.whole, self._after_space, " ", self.firsts, self.firsts.line)
        else:
            self.units = _Units(self.whole, self._lowered, "")

    def merged(self, letters: str) -> bytes:
        """Ids of a pre-token of letters."""
        return array("I", [t.id for t in self.model(letters if letters.isascii() else letters.translate(self.written))]).tobytes()

    def letters(self, lead: str, letters: str) -> list:
        """Tokens of a pre-token of letters, with a space before them if ``lead`` is one."""
        return self.model((self.space if lead else "") + (letters if letters.isascii() else letters.translate(self.written)))

    def _after_space(self, letters: str) -> bytes:
        """Ids of a pre-token of letters with a space before them."""
        return array("I", [t.id for t in self.model(self.space + (letters if letters.isascii() else letters.translate(self.written)))]).tobytes()

    def _lowered(self, letters: str) -> bytes:
        low = letters.lower()
        return self.merged(low) if low == letters else self.units[low]

    def whole(self, text: str) -> bytes:
        """The library's ids of a text."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if "<|" in text or (self.byte_level and _SPACED.search(text)):
            return self.whole(text)
        if self.byte_level:
            first, *rest = text.split(" ")
            return self.firsts[first] + b"".join(map(self.units.__getitem__, rest))
        return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" ")))


def strings(column: pa.Array) -> Iterator[str | None]:
    """The texts of a batch's column, with bytes that aren't UTF-8 replaced as Spark shows them."""
    try:
        yield from column.to_pylist()
    except UnicodeDecodeError:
        for x in column.cast(pa.binary()).to_pylist():
            yield None if x is None else x.decode("utf-8", "replace")
