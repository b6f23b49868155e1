"""Tokenizers: bytes and words, whose counts need no Python; others plug in as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Ids below this are reserved; the last of them ends a document (fixed values).
RESERVED, END = 8, 7


class Tokenizer(Protocol):
    end: int

    def count(self, text: Column) -> Column: ...

    def encode(self, text: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...


@F.arrow_udf(ArrayType(IntegerType()))
def _byte_ids(texts: pa.Array) -> pa.Array:
    """A batch of texts as lists of ids: one numpy sum over all bytes, whatever the number of texts."""
    data = b"".join(x for x in texts.cast(pa.binary()).to_pylist() if x)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = np.frombuffer(data, np.uint8).astype(np.int32) + RESERVED
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=texts.is_null())


class Bytes:
    """An id a UTF-8 byte: the byte's value plus the reserved ids. Counts stay in the JVM; ids are made in Arrow batches."""

    end = END

    def count(self, text: Column) -> Column:
        return F.octet_length(text)

    def encode(self, text: Column) -> Column:
        return _byte_ids(text)

    def decode(self, ids: Column) -> Column:
        kept = F.filter(ids, lambda i: i >= RESERVED)
        return F.decode(F.unhex(F.array_join(F.transform(kept, lambda i: F.lpad(F.hex(i - RESERVED), 2, "0")), "")), "UTF-8")


class Words:
    """Counts of words, for tests and quotas; it has no ids."""

    end = END

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))

    def encode(self, text: Column) -> Column:
        raise NotImplementedError("words are only counted")

    decode = encode


class Plugged:
    """A tokenizer given as functions on lists; ids outside the vocabulary and reserved ids from texts are errors."""

    def __init__(self, encode: Callable[[Sequence[str]], list[list[int]]], decode: Callable[[Sequence[list[int]]], list[str]], size: int, reserved: Sequence[int], end: int):
        self._encode, self._decode, self.size, self.reserved, self.end = encode, decode, size, list(reserved), end

    def encode(self, text: Column) -> Column:
        run = self._encode

        @F.pandas_udf(ArrayType(IntegerType()))
        def ids(texts: pd.Series) -> pd.Series:
            some = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out[some] = run(texts[some].tolist())
            return out

        found = ids(text)
        bad = F.exists(found, lambda i: (i < 0) | (i >= self.size)) | F.arrays_overlap(found, F.array(*map(F.lit, self.reserved)).cast("array<int>"))
        return F.when(bad, F.raise_error(F.lit("the text encodes to an id that is reserved or outside the vocabulary")).cast("array<int>")).otherwise(found)

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))

    def decode(self, ids: Column) -> Column:
        run, reserved = self._decode, set(self.reserved)

        @F.pandas_udf(StringType())
        def texts(xs: pd.Series) -> pd.Series:
            return pd.Series(run([[i for i in x if i not in reserved] for x in xs]))

        return texts(ids)


def with_end(ids: Column, end: int = END) -> Column:
    return F.array_append(ids, F.lit(end))


def byte_fallbacks(pieces: Column) -> Column:
    """Pieces that stand for a single byte, such as <0x0A>."""
    return F.size(F.filter(pieces, lambda p: p.rlike("^<0x[0-9A-F]{2}>$")))
