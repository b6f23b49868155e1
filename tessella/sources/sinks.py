"""Output forms of one token pipeline, and report and metrics writers."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Forms of output: the text, its bytes, ids of a document, or packed windows.
FORMS = ("raw_text", "bytes", "tokenized_docs", "packed_sequences")


def as_form(df: DataFrame, form: str, width: int | None = None, full: int | None = None) -> DataFrame:
    """``df`` has source, text and ids (and start for windows)."""
    if form == "raw_text":
        return df.select("source", "text")
    if form == "bytes":
        return df.select("source", F.encode("text", "UTF-8").alias("bytes"))
    if form == "tokenized_docs":
        return df.select("source", F.col("ids").alias("input_ids"), F.size("ids").alias("n_tokens"))
    if form == "packed_sequences":
        from tessella.operators.fixed_windows import window_ids

        return window_ids(df, "start", "ids", width, full)
    raise ValueError(f"unknown output form {form!r}; known: {', '.join(FORMS)}")


def append_metrics(df: DataFrame, path: str, keep_null: tuple[str, ...] = ()) -> None:
    """JSON lines of metrics rows; null fields are left out, but for those named in ``keep_null``."""
    if not keep_null:
        df.write.mode("append").json(path)
        return
    some = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    nulls = F.concat_ws(",", *[F.when(F.col(f"`{c}`").isNull(), F.lit(json.dumps(c, ensure_ascii=False) + ":null")) for c in keep_null])
    body = F.substring(some, F.lit(2), F.length(some) - 2)
    line = F.concat(F.lit("{"), F.concat_ws(",", F.when(body != "", body), F.when(nulls != "", nulls)), F.lit("}"))
    df.select(line.alias("value")).write.mode("append").text(path)


def write_json(value: Any, path: str, pretty: bool = True) -> None:
    """A small driver-side result: written beside its place, synced and renamed."""
    body = json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2 if pretty else None, allow_nan=False) + "\n"
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def markdown(report: Mapping[str, Any], title: str) -> str:
    """Tables of a report of scalars, mappings and lists of rows; it holds no texts of documents."""
    lines = [f"# {title}", ""]
    for name, value in report.items():
        if isinstance(value, list) and value and isinstance(value[0], Mapping):
            heads = list(value[0])
            lines += [f"## {name}", "", f"| {' | '.join(heads)} |", f"| {' | '.join('---' for _ in heads)} |"]
            lines += [f"| {' | '.join(str(r.get(h)) for h in heads)} |" for r in value] + [""]
        elif isinstance(value, Mapping):
            lines += [f"## {name}", ""] + [f"- {k}: {v}" for k, v in value.items()] + [""]
        else:
            lines += [f"- {name}: {value}"]
    return "\n".join(lines) + "\n"
