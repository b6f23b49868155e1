"""Readers: memory, iterables, JSON lines, strict JSON lines, Parquet with provenance, and evidence formats."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.measures import number_or_null

DOCUMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def _plain(x: Any) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _document(record: Any, index: int, text_field: str, fields: list[str] | None, most: int | None) -> tuple[str, dict[str, str | None]]:
    if isinstance(record, str):
        text, rest = record, {"index": str(index)}
    elif isinstance(record, Mapping):
        if text_field not in record:
            raise KeyError(f"record {index} has no field {text_field!r}")
        text = record[text_field]
        rest = {k: _plain(v) for k, v in record.items() if k != text_field and (fields is None or k in fields)}
        rest.setdefault("index", str(index))
    else:
        raise TypeError(f"record {index} is neither a text nor a mapping")
    if not isinstance(text, str):
        raise TypeError(f"field {text_field!r} of record {index} is not a text")
    return text[:most] if most else text, rest


def memory(spark: SparkSession, records: Iterable[Any], text_field: str = "text", fields: list[str] | None = None, max_chars: int | None = None) -> DataFrame:
    """Documents held by the driver: texts or mappings. Other fields, or the named ones, are metadata; the index is always there."""
    rows = [_document(r, i, text_field, fields, max_chars) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, DOCUMENT)


def iterable(spark: SparkSession, source: Iterable[Any] | Callable[[], Iterable[Any]], **options) -> DataFrame:
    """Documents of an iterable, or of a function that opens one anew."""
    return memory(spark, source() if callable(source) else source, **options)


def with_metadata(df: DataFrame, text_field: str, fields: list[str] | None = None, max_chars: int | None = None) -> DataFrame:
    """``text`` and ``metadata`` of a table's rows."""
    names = [c for c in df.columns if c != text_field and (fields is None or c in fields)]
    pairs = [x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    text = F.substring(F.col(text_field), 1, max_chars) if max_chars else F.col(text_field)
    return df.select(text.alias("text"), meta.alias("metadata"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def strict_json(text: str) -> Any:
    """JSON with no key twice."""
    return json.loads(text, object_pairs_hook=_unique)


def _has_surrogate(text: str) -> bool:
    try:
        text.encode()
    except UnicodeEncodeError:
        return True
    return False


def _strict_lines(text_field: str, id_field: str | None, path_index: str, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        rows = []
        for at, line in zip(pdf[path_index], pdf["value"], strict=True):
            line = line.removeprefix("﻿") if at == 0 else line
            if not line.strip():
                continue
            text = upstream = problem = None
            try:
                record = strict_json(line)
                if not isinstance(record, dict):
                    problem = "not an object"
                elif not isinstance(record.get(text_field), str):
                    problem = "non_string"
                elif _has_surrogate(record[text_field]):
                    problem = "invalid_unicode"
                else:
                    text = record[text_field]
                raw = record.get(id_field) if id_field and isinstance(record, dict) else None
                if raw is not None:
                    upstream = str(raw)
                    if not upstream or isinstance(raw, bool) or not isinstance(raw, str | int):
                        problem = "empty id" if raw == "" else "id is neither text nor integer"
            except ValueError as e:
                problem = f"not strict JSON: {e}"
            rows.append((at, text, upstream, problem))
        yield pd.DataFrame(rows, columns=["line", "text", "upstream_id", "problem"]).astype({"line": "int64"})


def strict_json_lines(spark: SparkSession, path: str, text_field: str = "text", id_field: str | None = "id", fail: bool = True) -> DataFrame:
    """``line`` (physical, from 0), ``text``, ``upstream_id`` and ``problem`` of each line that isn't blank.

    Lines are parsed in Python: a JSON reader keeps the last of equal keys and rewrites
    lone surrogates, both of which must be seen. With ``fail`` any problem but an
    unusable text is an error. Files are read one after another in path order.
    """
    from tessella.operators.totals import running_total

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = running_total(lines.withColumn("one", F.lit(1).cast("long")), "one", ["file", "at"], "line").select("line", "value")
    out = lines.mapInPandas(lambda it: _strict_lines(text_field, id_field, "line", it), "line long, text string, upstream_id string, problem string")
    if fail:
        bad = F.col("problem").isNotNull() & ~F.col("problem").isin("non_string", "invalid_unicode")
        out = out.withColumn("problem", F.when(bad, F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("problem"))).cast("string")).otherwise(F.col("problem")))
    return out


def parquet_documents(spark: SparkSession, paths: list[str], text_field: str, id_field: str | None, fields: list[str]) -> DataFrame:
    """``artifact_index``, ``row_index``, text, id and metadata columns of Parquet files, which are scanned for these columns only.

    Order is (artifact, row); a file without one of the columns is an error.
    """
    names = list(dict.fromkeys([text_field, *fields, *([id_field] if id_field else [])]))
    out = None
    for i, path in enumerate(paths):
        df = spark.read.parquet(path)
        if missing := [n for n in names if n not in df.columns]:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        part = df.select(F.lit(i).alias("artifact_index"), F.col("_metadata.row_index").alias("row_index"), *names)
        out = part if out is None else out.unionByName(part)
    return out


def artifact_order(files: DataFrame) -> DataFrame:
    """Files (``path``, ``size_bytes``) with their ``artifact_index``: by size, then path."""
    from pyspark.sql import Window

    return files.withColumn("artifact_index", F.row_number().over(Window.orderBy("size_bytes", "path")) - 1)


def artifact_url(host: str, repository: str, revision: str, path: str) -> str:
    """The address of a file of a repository at a revision."""
    return f"{host}/datasets/{quote(repository, safe='/')}/resolve/{quote(revision, safe='')}/{quote(path, safe='/')}"


def key_values(df: DataFrame, line: str = "value") -> DataFrame:
    """``key`` and ``bytes`` of lines such as ``MemFree:  12 kB``."""
    parts = F.split(F.trim(F.split(line, ":", 2)[1]), r"\s+")
    number = parts[0].try_cast("long")
    return df.where(F.col(line).contains(":")).select(F.trim(F.split(line, ":", 2)[0]).alias("key"), F.when(F.get(parts, F.lit(1)) == "kB", number * 1024).otherwise(number).alias("bytes"))


def vmstat(df: DataFrame, order: str, line: str = "value") -> DataFrame:
    """Samples of a header-driven table: ``order``, ``sampled_at`` and a map of its numbers; the first sample and rows that don't fit are left out.

    ``order`` is the line's place in the file.
    """
    from pyspark.sql import Window

    words = df.select(order, F.split(F.trim(line), r"\s+").alias("w"))
    header = words.where(F.array_contains("w", "free") & F.array_contains("w", "swpd")).orderBy(order).limit(1).select(F.col("w").alias("h"))
    rows = words.crossJoin(F.broadcast(header))  # one row
    n = F.size("h")
    values = F.transform(F.slice("w", 1, n), lambda x: x.try_cast("double"))
    at = F.try_to_timestamp(F.array_join(F.slice(F.col("w"), n + 1, F.lit(2)), " "))
    rows = rows.where(F.size("w") >= n + 2).select(order, at.alias("sampled_at"), F.map_from_arrays("h", values).alias("values"))
    rows = rows.where(F.col("sampled_at").isNotNull() & ~F.exists(F.map_values("values"), lambda x: x.isNull()))
    return rows.withColumn("_n", F.row_number().over(Window.orderBy(order))).where("_n > 1").drop("_n")


def separated(df: DataFrame, names: list[str], separator: str, times: Mapping[str, str] | None = None, numbers: tuple[str, ...] = (), line: str = "value") -> DataFrame:
    """Columns of separated lines with as many fields as ``names``; ``numbers`` may be missing, ``times`` have a format. Rows whose time can't be read go."""
    parts = F.transform(F.split(line, separator, -1), lambda x: F.trim(x))
    rows = df.select(parts.alias("_p")).where(F.size("_p") == len(names))
    cols = [F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)]
    rows = rows.select(*cols)
    for n, form in (times or {}).items():
        rows = rows.withColumn(n, F.try_to_timestamp(F.col(n), F.lit(form))).where(F.col(n).isNotNull())
    return rows.withColumns({n: number_or_null(F.col(n)) for n in numbers}) if numbers else rows


def needs_network(kind: str) -> Callable[..., DataFrame]:
    def refuse(*_, **__) -> DataFrame:
        raise RuntimeError(f"the {kind} source downloads, and this installation has no network: stage the files and read them as json_lines or parquet")

    return refuse


#: Readers by the type name of a configuration.
READERS: dict[str, Callable[..., DataFrame]] = {
    "memory": memory, "iterable": iterable, "jsonl": json_lines, "strict_jsonl": strict_json_lines, "parquet": parquet_documents,
    "url_jsonl": needs_network("url_jsonl"), "hf": needs_network("hf"),
}


def read(spark: SparkSession, kind: str, *args, **options) -> DataFrame:
    if kind == "manifest":
        from tessella.sources import manifests  # noqa: F401  it adds its reader
    if kind not in READERS:
        raise ValueError(f"unknown source type {kind!r}; known: {', '.join(READERS)}")
    return READERS[kind](spark, *args, **options)


def missing_texts(raw: Column) -> Column:
    """A number column from texts that say so when there is none."""
    return number_or_null(raw)
