"""Text identity, quality and script functions as column expressions.

Only Unicode normalisation needs Python (Spark has no NFC): one Arrow-batched function that
unifies line ends, normalises and strips in a single pass. Its result is a column of the
plan, so what follows never runs it twice. Letters are counted as ASCII ones and
those of the non-ASCII rest, which is short in most texts.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass
from decimal import ROUND_FLOOR, Decimal, InvalidOperation
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code points that Python's str.strip() takes for white space (fixed values).
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Ranges that count as Japanese (fixed values).
JAPANESE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]"
HEX64 = r"^[0-9a-f]{64}$"


@cache
def latin() -> str:
    """Ranges, as in a regular expression's class, of the code points with LATIN in their Unicode name."""
    points = [c for c in range(0x80) if chr(c).isalpha()] + [c for c in [*range(0x80, 0x20000), *range(0xE0000, 0xE0080)] if "LATIN" in unicodedata.name(chr(c), "")]
    out, start = [], None
    for c, after in zip(points, points[1:] + [0], strict=True):
        start = c if start is None else start
        if after != c + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{c:X}}}")
            start = None
    return "".join(out)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _plain(t: str | None) -> str | None:
    if t is None:
        return None
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    return (t if t.isascii() else unicodedata.normalize("NFC", t)).strip()


@F.pandas_udf(StringType())
def normal(texts: pd.Series) -> pd.Series:
    """Line ends as LF, normal form C, white space off both ends."""
    return texts.map(_plain)


@F.pandas_udf(StringType())
def identity_text(texts: pd.Series) -> pd.Series:
    """One leading byte-order mark off, then as ``normal``."""
    return texts.map(lambda t: t if t is None else _plain(t.removeprefix("\ufeff")))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A{BLANK}+", ""), rf"{BLANK}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{BLANK}+\z", "")


def unify_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_sha256(text: Column) -> Column:
    return F.sha2(identity_text(text), 256)


def normal_sha256(text: Column) -> Column:
    """The same of a text that is ``normal`` already, or a prefix of one: only a byte-order mark is left to take off."""
    return F.sha2(F.when(text.startswith("\ufeff"), strip(F.substring(text, 2, 2**31 - 1))).otherwise(text), 256)


def document_id_v1(source: Column, sha: Column, upstream: Column) -> Column:
    """The upstream id with its source, or else the content with its source; an empty upstream id is an error.

    A document without a text or a source has no id.
    """
    named = F.to_json(F.struct(source.alias("source_identity"), upstream.cast("string").alias("upstream_id")))
    bound = F.to_json(F.struct(sha.alias("content_sha256"), source.alias("source_identity")))
    return F.when(source.isNotNull() & sha.isNotNull(), F.sha2(F.when(upstream.isNull(), bound).otherwise(_not_empty(upstream, named)), 256))


def document_id_v2(source: Column, sha: Column, upstream: Column) -> Column:
    """Content and source always, the upstream id where there is one."""
    whole = F.to_json(F.struct(sha.alias("content_sha256"), source.alias("source_identity"), upstream.cast("string").alias("upstream_id")))
    return F.when(source.isNotNull() & sha.isNotNull(), F.sha2(_not_empty(upstream, whole), 256))


def _not_empty(upstream: Column, value: Column) -> Column:
    return F.when(upstream.cast("string") == "", F.raise_error(F.lit("upstream_id must not be empty")).cast("string")).otherwise(value)


def validation_threshold(fraction: str) -> str:
    """The split threshold as 16 hexadecimal digits: these order as the numbers do."""
    try:
        share = Decimal(fraction) if isinstance(fraction, str) else Decimal("nan")
    except InvalidOperation:
        share = Decimal("nan")
    if not share.is_finite() or not 0 < share < 1:
        raise ValueError("the validation fraction must be a decimal string between 0 and 1")
    return f"{int((share * 2**64).to_integral_value(ROUND_FLOOR)):016x}"


def assign_split(sha: Column, salt: str, fraction: str) -> Column:
    """``validation`` where the salted hash of the content hash lies below the threshold, else ``train``."""
    if not salt:
        raise ValueError("the salt must not be empty")
    score = F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\0"), sha), 256), 1, 16)
    return F.when(sha.isNull(), None).when(score < validation_threshold(fraction), "validation").otherwise("train")


def count_of(text: Column, members: str) -> Column:
    """Code points of a class in a text."""
    return F.length(F.regexp_replace(text, f"[^{members}]+", ""))


def beyond_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x7F]+", "")


def script_counts(text: Column) -> Column:
    """Struct of ``latin``, ``japanese`` and ``other`` letters."""
    rest = beyond_ascii(text)
    other = F.regexp_replace(F.regexp_replace(rest, f"[{JAPANESE}{latin()}]+", ""), r"[^\p{L}]+", "")
    return F.struct((count_of(text, "A-Za-z") + count_of(rest, latin())).alias("latin"), count_of(rest, JAPANESE).alias("japanese"), F.length(other).alias("other"))


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]") | beyond_ascii(text).rlike(f"[{latin()}]")


def has_japanese(text: Column) -> Column:
    return text.rlike(f"[{JAPANESE}]")


def classify_language(japanese: Column, latin_: Column, other: Column) -> Column:
    return F.when((japanese > 0) & (latin_ > 0), "mixed").when(japanese > 0, "ja").when(latin_ > 0, "en").otherwise("other")


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    data = F.encode(text, "UTF-8")
    cut = F.coalesce(*[F.when(F.is_valid_utf8(F.substring(data, 1, max(most - k, 0)).cast("string")), F.substring(data, 1, max(most - k, 0)).cast("string")) for k in range(4)])
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)


@dataclass(frozen=True)
class DocumentPolicy:
    """What a document must be to be kept."""

    version: int = 1
    language: str = "any"
    max_utf8_bytes: int | None = None
    reject_controls: bool = True
    reject_wrong_script: bool = False

    def __post_init__(self):
        most = self.max_utf8_bytes
        if self.version != 1 or self.language not in ("any", "en", "ja"):
            raise ValueError("policy version 1 and language any, en or ja are known")
        if most is not None and (isinstance(most, bool) or not isinstance(most, int) or most < 1):
            raise ValueError("max_utf8_bytes must be a positive integer")
        if not isinstance(self.reject_controls, bool) or not isinstance(self.reject_wrong_script, bool):
            raise ValueError("reject_controls and reject_wrong_script must be booleans")


def verdict(df, text: str, policy: DocumentPolicy, invalid: Column | None = None):
    """Adds ``clean`` (the kept text), ``reason`` (null if kept), ``truncated``, ``scripts`` and ``content_sha256``.

    ``invalid`` marks rows whose raw text held lone surrogates, which only a strict
    reader can see.
    """
    df = df.withColumn("_n", normal(F.col(text)))
    over = F.octet_length("_n") > policy.max_utf8_bytes if policy.max_utf8_bytes else F.lit(False)
    df = df.withColumn("_over", F.coalesce(over, F.lit(False)))
    cut = F.when(F.col("_over"), rstrip(truncate_utf8(F.col("_n"), policy.max_utf8_bytes))).otherwise(F.col("_n")) if policy.max_utf8_bytes else F.col("_n")
    df = df.withColumn("_t", cut).withColumn("scripts", script_counts(F.col("_t")))
    wrong = F.lit(False)
    if policy.reject_wrong_script and policy.language == "ja":
        wrong = ~has_japanese(F.col("_t"))
    elif policy.reject_wrong_script and policy.language == "en":
        wrong = has_japanese(F.col("_t")) & ~has_latin(F.col("_t"))
    controls = F.col("_n").rlike(CONTROL) if policy.reject_controls else F.lit(False)
    reason = (
        F.when(F.col(text).isNull(), "non_string").when(invalid if invalid is not None else F.lit(False), "invalid_unicode").when(F.col("_n") == "", "empty")
        .when(controls, "control_character").when(F.col("_over") & (F.col("_t") == ""), "empty_after_truncation").when(wrong, "wrong_script")
    )
    df = df.withColumn("reason", reason)
    early = F.coalesce(F.col("reason").isin("non_string", "invalid_unicode", "empty", "control_character"), F.lit(False))
    kept = F.col("reason").isNull()
    return df.withColumns({"truncated": F.col("_over") & ~early, "clean": F.when(kept, F.col("_t")), "content_sha256": F.when(kept, normal_sha256(F.col("_t")))}).drop("_n", "_over", "_t")


def canonical_json(value) -> bytes:
    """Sorted keys, no spaces, no escapes of letters, no NaN."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def _pieces(batches):
    """Sorted entries -> pieces of the document, a piece a batch."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([",".join(batch.column(0).to_pylist())])], names=["piece"])


def dataset_fingerprint(rows, split: str | None = None):
    """A row ``fingerprint`` over (document_id, content_sha256, split): all rows, or those of one split.

    Rows without an id are documents that were refused and take no part. The digest is
    defined over one sorted document: it is sorted by ranges, and its pieces pass the
    driver in order, one partition at a time, so no array or task holds the whole.
    """
    if split is not None:
        rows = rows.where(F.col("split") == split)
    names = ("document_id", "content_sha256") + (() if split is not None else ("split",))
    rows = rows.where(F.col("document_id").isNotNull()).select(*names).orderBy(*names)
    entries = rows.select(F.to_json(F.struct(*sorted(names))).alias("entry"))
    digest, first = hashlib.sha256(b'{"documents":['), True
    for r in entries.mapInArrow(_pieces, "piece string").toLocalIterator():
        digest.update((b"" if first else b",") + r.piece.encode())
        first = False
    digest.update(b"]}" if split is None else f'],"split":{json.dumps(split, ensure_ascii=False)}}}'.encode())
    return rows.sparkSession.createDataFrame([(digest.hexdigest(),)], "fingerprint string")
