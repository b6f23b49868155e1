"""Token counts by the whole-token shortcut.

Offline (once, before the job; the proved strings are broadcast, fewer than the
vocabulary has), every vocabulary string is proved or refuted as a *whole token*: it is
one pre-token of the split pattern and the library encodes it alone as its own
id. A text is then counted by pre-tokens: one that is a proved string counts 1
without any merging, and only the rest is merged by the library (each distinct
one once per worker and cache filling). Runs of plain letters with marks behind them are
two pre-tokens by their form and need no split pattern.

Null and empty texts count 0 tokens and 0 bytes. Repeated rows and ids are
counted one by one; columns other than the two named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.tokens import _LETTERS, _SPACED, CACHE_UNITS, Vocabulary, byte_letters, strings

#: The split pattern of byte-level vocabularies, a fixed value of their file format.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class no Unicode version has changed; other units are left to the library.
_KNOWN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*\Z")
_counters: dict[int, "Counter"] = {}


def whole_tokens(library) -> set[str]:
    """The vocabulary strings that are one pre-token and encode alone as their own id."""
    letters, texts, ids = byte_letters(), [], []
    for token, i in library.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(letters[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: no text has it as a pre-token
        if _KNOWN.match(text) and SPLIT.findall(text) == [text]:
            texts.append(text)
            ids.append(i)
    return {t for t, i, e in zip(texts, ids, library.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids == [i]}


class _Counts(dict):
    """Unit -> number of tokens."""

    def __init__(self, counter: "Counter", lead: str):
        self.counter, self.lead = counter, lead

    def __missing__(self, unit: str) -> int:
        n = self.counter.count_unit(self.lead, unit)
        if len(self) < CACHE_UNITS:
            self[unit] = n
        return n


class Counter:
    def __init__(self, vocabulary: Vocabulary, one: frozenset[str]):
        self.encoder, self.one = vocabulary.encoder(), one
        self.merged: dict[str, int] = {}
        self.units, self.firsts = _Counts(self, " "), _Counts(self, "")

    def merge(self, pre: str) -> int:
        n = self.merged.get(pre)
        if n is None:
            n = len(self.encoder.library.encode(pre, add_special_tokens=False).ids)
            if len(self.merged) < CACHE_UNITS:
                self.merged[pre] = n
        return n

    def count_unit(self, lead: str, unit: str) -> int:
        found, one = _LETTERS(unit), self.one
        if found:
            core, tail = found.groups()
            n = 1 if lead + core in one else len(self.encoder.letters(lead, core))
            return n + (0 if not tail else 1 if tail in one else self.merge(tail))
        unit = lead + unit
        if not _KNOWN.match(unit):
            return self.merge(unit)
        merge = self.merge
        return sum(1 if pre in one else merge(pre) for pre in SPLIT.findall(unit))

    def count(self, text: str) -> int:
        if "<|" in text or _SPACED.search(text):
            return len(self.encoder.whole(text)) // 4
        first, *rest = text.split(" ")
        return self.firsts[first] + sum(map(self.units.__getitem__, rest))


def _count_batches(vocabulary: Vocabulary, one, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = id(vocabulary.encoder())
    if key not in _counters:
        _counters[key] = Counter(vocabulary, one.value)
    count = _counters[key].count
    for batch in batches:
        n = [count(t) if t else 0 for t in strings(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: Column | int = 1024) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row of ``docs``.

    ``vocabulary_path`` names a byte-level file of the ``tokenizers`` library.
    No shuffle: one pass of the two columns.
    """
    vocabulary = Vocabulary(docs.sparkSession, vocabulary_path)
    if not vocabulary.byte_level:
        raise ValueError("the whole-token shortcut needs a byte-level vocabulary without a normalizer")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    one = docs.sparkSession.sparkContext.broadcast(frozenset(whole_tokens(vocabulary.encoder().library)))  # of fixed size: the vocabulary
    out = rows.mapInArrow(partial(_count_batches, vocabulary, one), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
