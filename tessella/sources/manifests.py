"""Manifests: strict JSON that binds a data set's files, split, policy and fingerprints."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import reduce
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import HEX64, DocumentPolicy, assign_split, canonical_json, content_sha256, document_id_v1, document_id_v2, validation_threshold, verdict
from tessella.sources.readers import READERS, parquet_documents, strict_json, strict_json_lines

#: Fields of a manifest of local JSON lines and of its parts (fixed values of the format).
FIELDS = (
    "dataset_fingerprint", "index_path", "index_sha256", "manifest_fingerprint", "name", "purpose",
    "schema_version", "source", "split", "split_fingerprints", "usage",
)
SOURCE_FIELDS = ("id_field", "kind", "path", "sha256", "size_bytes", "text_field")
#: Fields of a manifest of remote Parquet files and of its parts (fixed values of the format).
LAZY_FIELDS = ("dataset_fingerprint", "document_policy", "manifest_fingerprint", "name", "purpose", "schema_version", "source", "split", "usage")
LAZY_SOURCE_FIELDS = ("config_name", "data_files", "id_field", "kind", "metadata_fields", "repo_id", "revision", "split", "text_field")
INDEX_FIELDS = ("content_sha256", "document_id", "source_index", "split", "upstream_id")
PURPOSES = ("pretraining", "memorization_smoke", "benchmark_dev", "benchmark_reserved")
ACCESSES = ("training", "evaluation")
SPLIT_METHOD = "normalized_content_sha256_v1"


class ManifestError(ValueError):
    """A manifest, its index or its source isn't what it claims to be."""


def exact(value: Any, fields: tuple[str, ...], what: str) -> dict[str, Any]:
    if not isinstance(value, dict) or set(value) != set(fields):
        have = set(value) if isinstance(value, dict) else set()
        raise ManifestError(f"{what}: missing {sorted(set(fields) - have)}, unknown {sorted(have - set(fields))}")
    return value


def inside(root: Path, path: str) -> Path:
    """A path below ``root``, written with forward slashes and without ways out."""
    pure = PurePosixPath(path)
    if not path or pure.is_absolute() or ".." in pure.parts or "\\" in path:
        raise ManifestError(f"{path!r} is not a path inside the package")
    full = (root / pure).resolve()
    if not full.is_relative_to(root.resolve()):
        raise ManifestError(f"{path!r} leads out of the package")
    return full


def file_sha256(path: Path) -> tuple[str, int]:
    digest, size = hashlib.sha256(), 0
    with path.open("rb") as f:
        while data := f.read(1 << 20):
            digest.update(data)
            size += len(data)
    return digest.hexdigest(), size


def load(path: Path) -> Any:
    try:
        return strict_json(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ManifestError(f"{path}: {e}") from e


def fingerprint(manifest: dict[str, Any]) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in manifest.items() if k != "manifest_fingerprint"})).hexdigest()


def index_rows(spark: SparkSession, path: str, source: str, split: dict[str, str], text_field: str, id_field: str | None) -> DataFrame:
    """The index of a source: ids, content hashes and splits by position."""
    docs = strict_json_lines(spark, path, text_field, id_field).withColumn("content_sha256", content_sha256(F.col("text")))
    from pyspark.sql import Window

    position = F.row_number().over(Window.orderBy("line")) - 1  # an eager manifest is small by definition
    ids = document_id_v1(F.lit(source), F.col("content_sha256"), F.col("upstream_id"))
    return docs.select("content_sha256", ids.alias("document_id"), position.alias("source_index"), assign_split(F.col("content_sha256"), split["salt"], split["validation_fraction"]).alias("split"), "upstream_id", "text")


def fingerprints(rows: list[dict[str, Any]]) -> tuple[str, dict[str, str]]:
    """Of the data set and of its splits, from the index."""
    def of(names: tuple[str, ...], some: list, extra: dict) -> str:
        docs = sorted(({n: r[n] for n in names} for r in some), key=lambda r: (r["document_id"], r["content_sha256"], r.get("split", "")))
        return hashlib.sha256(canonical_json({"documents": docs, **extra})).hexdigest()

    whole = of(("content_sha256", "document_id", "split"), rows, {})
    return whole, {s: of(("content_sha256", "document_id"), [r for r in rows if r["split"] == s], {"split": s}) for s in ("train", "validation")}


@dataclass(frozen=True)
class Resolved:
    """A verified data set, and the documents that were asked for."""

    manifest: dict[str, Any]
    selection: str
    index: DataFrame | None
    documents: DataFrame | None

    @property
    def lazy(self) -> bool:
        return self.index is None

    @property
    def split_policy(self) -> str:
        return hashlib.sha256(canonical_json(self.manifest["split"])).hexdigest()


def guard(manifest: dict[str, Any], selection: str, access: str = "training", grant: bool = False) -> None:
    """What a purpose is open to: pre-training for one split, a memorisation check and benchmarks for all documents, benchmarks for evaluation only, and reserved ones by an explicit grant."""
    purpose = manifest["purpose"]
    if access not in ACCESSES:
        raise ManifestError(f"access must be one of {ACCESSES}")
    if purpose.startswith("benchmark_") and access == "training":
        raise ManifestError("benchmarks are closed to training")
    if purpose == "benchmark_reserved" and not grant:
        raise ManifestError("a reserved benchmark opens by an explicit grant only")
    if selection not in (("train", "validation") if purpose == "pretraining" else ("all",)):
        raise ManifestError(f"selection {selection!r} isn't open to {purpose}")


def verify(spark: SparkSession, path: str, selection: str, access: str = "training", grant: bool = False, expected: str | None = None) -> Resolved:
    """Check a manifest: fields, fingerprints, purpose, file hashes, index invariants, and the index against the source.

    ``expected`` is the fingerprint that a configuration has bound.
    """
    at = Path(path)
    manifest = load(at)
    version = manifest.get("schema_version") if isinstance(manifest, dict) else None
    if version == 2:
        _check_lazy(manifest)
    else:
        _check_indexed(manifest)
    if expected is not None and expected != manifest["manifest_fingerprint"]:
        raise ManifestError("the manifest isn't the one that the configuration names")
    guard(manifest, selection, access, grant)
    if version == 2:
        if manifest["purpose"] != "pretraining":
            raise ManifestError("manifests of remote Parquet files are for pre-training")
        return Resolved(manifest, selection, None, None)
    return _indexed(spark, at, manifest, selection)


def _check_indexed(manifest: dict[str, Any]) -> None:
    exact(manifest, FIELDS, "manifest")
    source = exact(manifest["source"], SOURCE_FIELDS, "source")
    _common(manifest, 1)
    split = exact(manifest["split"], ("salt", "validation_fraction"), "split")
    _split_values(split)
    if source["kind"] != "local_jsonl" or not isinstance(source["text_field"], str) or not source["text_field"] or not (source["id_field"] is None or isinstance(source["id_field"], str) and source["id_field"]):
        raise ManifestError("a source of local JSON lines needs a text field, and an id field or none")
    exact(manifest["split_fingerprints"], ("train", "validation"), "split fingerprints")


def _split_values(split: dict[str, Any]) -> None:
    if not isinstance(split["salt"], str) or not split["salt"]:
        raise ManifestError("a split needs a salt")
    try:
        validation_threshold(split["validation_fraction"])
    except ValueError as e:
        raise ManifestError(str(e)) from e


def _indexed(spark: SparkSession, at: Path, manifest: dict[str, Any], selection: str) -> Resolved:
    source, split = manifest["source"], manifest["split"]
    data, index = inside(at.parent, source["path"]), inside(at.parent, manifest["index_path"])
    for file, sha, size in ((data, source["sha256"], source["size_bytes"]), (index, manifest["index_sha256"], None)):
        found = file_sha256(file)
        if found[0] != sha or size not in (None, found[1]):
            raise ManifestError(f"{file.name} isn't the file that the manifest names")
    rows = exact(load(index), ("documents", "schema_version"), "index")["documents"]
    for r in rows:
        exact(r, INDEX_FIELDS, "index entry")
    for name in ("document_id", "content_sha256"):
        if len({r[name] for r in rows}) != len(rows):
            raise ManifestError(f"the index repeats a {name}")
    if [r["source_index"] for r in rows] != list(range(len(rows))):
        raise ManifestError("source positions must run from 0")
    whole, parts = fingerprints(rows)
    if whole != manifest["dataset_fingerprint"] or parts != manifest["split_fingerprints"]:
        raise ManifestError("the index doesn't have the manifest's fingerprints")
    if manifest["purpose"] == "pretraining" and {r["split"] for r in rows} != {"train", "validation"}:
        raise ManifestError("pre-training needs documents in both splits")
    schema = "content_sha256 string, document_id string, source_index int, split string, upstream_id string"
    kept = spark.createDataFrame([tuple(r[n] for n in INDEX_FIELDS) for r in rows], schema)
    from tessella.operators.accounting import differences

    texts = index_rows(spark, f"file://{data}", manifest["name"], split, source["text_field"], source["id_field"])
    actual = texts.drop("text")
    if not (bad := differences(actual, kept, "source_index", ["content_sha256", "document_id", "split", "upstream_id"])).isEmpty():
        raise ManifestError(f"the index doesn't match its source at {[r.source_index for r in bad.orderBy('source_index').take(3)]}")
    chosen = texts if selection == "all" else texts.where(F.col("split") == selection)
    if chosen.isEmpty():
        raise ManifestError(f"selection {selection!r} has no documents")
    return Resolved(manifest, selection, kept, chosen)


def _common(manifest: dict[str, Any], version: int) -> None:
    if manifest["schema_version"] != version or isinstance(manifest["schema_version"], bool):
        raise ManifestError("unknown schema version")
    if manifest["purpose"] not in PURPOSES or not isinstance(manifest["name"], str) or not manifest["name"]:
        raise ManifestError("a manifest needs a name and a known purpose")
    usage = exact(manifest["usage"], ("license", "terms_url"), "usage")
    if not all(isinstance(v, str) and v for v in usage.values()):
        raise ManifestError("usage needs a license and its address")
    if fingerprint(manifest) != manifest["manifest_fingerprint"]:
        raise ManifestError("the manifest was changed after its fingerprint was made")


def dataset_fingerprint_of(manifest: dict[str, Any]) -> str:
    """What binds a lazy data set: its name, its source with all files, and its document policy."""
    return hashlib.sha256(canonical_json({k: manifest[k] for k in ("name", "source", "document_policy")})).hexdigest()


def _check_lazy(manifest: dict[str, Any]) -> None:
    exact(manifest, LAZY_FIELDS, "manifest")
    source = exact(manifest["source"], LAZY_SOURCE_FIELDS, "source")
    _common(manifest, 2)
    if source["kind"] != "hf_parquet" or not all(isinstance(source[n], str) and source[n] for n in ("repo_id", "config_name", "split", "text_field")):
        raise ManifestError("a source of remote Parquet files needs a repository, a configuration, a split and a text field")
    if not isinstance(source["revision"], str) or not re.fullmatch(r"[0-9a-f]{40}", source["revision"]):
        raise ManifestError("a revision is 40 hexadecimal digits")
    fields, special = source["metadata_fields"], {source["text_field"], source["id_field"]}
    if not isinstance(fields, list) or not all(isinstance(n, str) and n for n in fields) or len(set(fields)) != len(fields) or special & set(fields):
        raise ManifestError("metadata fields must be distinct names, and neither text nor id")
    if not (source["id_field"] is None or isinstance(source["id_field"], str) and source["id_field"]):
        raise ManifestError("the id field must be a name or none")
    policy = exact(manifest["document_policy"], ("language", "max_utf8_bytes", "reject_controls", "reject_wrong_script", "version"), "document policy")
    try:
        DocumentPolicy(**policy)
    except (TypeError, ValueError) as e:
        raise ManifestError(f"document policy: {e}") from e
    split = exact(manifest["split"], ("method", "salt", "validation_fraction"), "split")
    if split["method"] != SPLIT_METHOD:
        raise ManifestError(f"the split method must be {SPLIT_METHOD}")
    _split_values(split)
    files = source["data_files"]
    if not isinstance(files, list) or not files:
        raise ManifestError("a source needs data files")
    for f in files:
        exact(f, ("path", "sha256", "size_bytes"), "data file")
        inside(Path("/"), f["path"])
        if not f["path"].endswith(".parquet") or not re.match(HEX64, f["sha256"]) or isinstance(f["size_bytes"], bool) or not isinstance(f["size_bytes"], int) or f["size_bytes"] < 0:
            raise ManifestError("a data file needs a .parquet path, its hash and its size")
    if len({f["path"] for f in files}) != len(files):
        raise ManifestError("data files need distinct paths")
    if manifest["dataset_fingerprint"] != dataset_fingerprint_of(manifest):
        raise ManifestError("the data set's fingerprint isn't that of its files and policy")


def scan(spark: SparkSession, resolved: Resolved, paths: list[str]) -> DataFrame:
    """Every row of a lazy data set's staged files, judged: policy, then split, then id, then metadata.

    ``paths`` are the files in the manifest's order, wherever they are staged; only the
    named columns are read. ``reason`` is null for documents of the selection; others
    say why they are left out: the policy's reason, or ``other_split_<split>``. Null cells
    are counted by ``null_events`` over the same rows.
    """
    m, source = resolved.manifest, resolved.manifest["source"]
    files = source["data_files"]
    if len(paths) != len(files):
        raise ManifestError("a path for each data file is needed")
    df = parquet_documents(spark, paths, source["text_field"], source["id_field"], source["metadata_fields"])
    names = F.array(*[F.lit(f["path"]) for f in files])
    df = df.withColumn("artifact_path", F.get(names, F.col("artifact_index")))
    df = verdict(df, source["text_field"], DocumentPolicy(**m["document_policy"]))
    split = assign_split(F.col("content_sha256"), m["split"]["salt"], m["split"]["validation_fraction"])
    upstream = F.col(source["id_field"]).cast("string") if source["id_field"] else F.lit(None).cast("string")
    df = df.withColumns({"assigned_split": split, "upstream_id": upstream})
    other = F.when(F.col("assigned_split") != resolved.selection, F.concat(F.lit("other_split_"), "assigned_split"))
    df = df.withColumn("reason", F.coalesce("reason", other))
    accepted = F.col("reason").isNull()
    ident = F.when(accepted, document_id_v2(F.lit(m["name"]), F.col("content_sha256"), F.col("upstream_id")))
    return df.withColumns({"document_id": ident, "fallback_id": F.when(accepted, F.col("upstream_id").isNull())})


def replay(resolved: Resolved) -> DataFrame:
    """``text`` and ``metadata`` of an indexed data set's selected documents."""
    m = resolved.manifest
    pairs = {"content_sha256": F.col("content_sha256"), "document_id": F.col("document_id"), "assigned_split": F.col("split"), "source_index": F.col("source_index").cast("string"), "upstream_id": F.col("upstream_id"), "dataset_fingerprint": F.lit(m["dataset_fingerprint"]), "manifest_fingerprint": F.lit(m["manifest_fingerprint"])}
    return resolved.documents.select("text", F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("metadata"))


def manifest_documents(spark: SparkSession, path: str, selection: str, access: str = "training", grant: bool = False, expected: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """The source type ``manifest``: ``text`` and ``metadata`` of the selected documents of either kind of manifest."""
    resolved = verify(spark, path, selection, access, grant, expected)
    if not resolved.lazy:
        return replay(resolved)
    if paths is None:
        raise ManifestError("the files of a lazy manifest must be staged and their paths given")
    m, fields = resolved.manifest, resolved.manifest["source"]["metadata_fields"]
    df = scan(spark, resolved, paths).where("reason IS NULL")
    cols = {n: F.col(f"`{n}`") for n in fields} | {n: F.col(n) for n in ("artifact_path", "assigned_split", "content_sha256", "document_id", "fallback_id", "row_index", "truncated", "upstream_id")}
    cols |= {"japanese_count": F.col("scripts.japanese"), "latin_count": F.col("scripts.latin"), "dataset_fingerprint": F.lit(m["dataset_fingerprint"]), "manifest_fingerprint": F.lit(m["manifest_fingerprint"])}
    return df.select(F.col("clean").alias("text"), F.create_map(*[x for k, v in cols.items() for x in (F.lit(k), v.cast("string"))]).alias("metadata"))


def build(spark: SparkSession, data: str, target: str, name: str, purpose: str, split: dict[str, str], usage: dict[str, str], text_field: str = "text", id_field: str | None = "id") -> dict[str, Any]:
    """Write a manifest and its index beside a file of JSON lines."""
    out, file = Path(target), Path(data)
    rows = [r.asDict() for r in index_rows(spark, f"file://{file.resolve()}", name, split, text_field, id_field).drop("text").orderBy("source_index").collect()]
    if not rows:
        raise ManifestError("a source needs documents")
    index = out.with_suffix("").with_suffix(".index.json")
    index.write_text(json.dumps({"documents": rows, "schema_version": 1}, ensure_ascii=False, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    sha, size = file_sha256(file)
    whole, parts = fingerprints(rows)
    manifest = {
        "dataset_fingerprint": whole, "index_path": index.name, "index_sha256": file_sha256(index)[0], "name": name, "purpose": purpose, "schema_version": 1,
        "source": {"id_field": id_field, "kind": "local_jsonl", "path": file.resolve().relative_to(out.resolve().parent).as_posix(), "sha256": sha, "size_bytes": size, "text_field": text_field},
        "split": split, "split_fingerprints": parts, "usage": usage,
    }
    manifest["manifest_fingerprint"] = fingerprint(manifest)
    out.write_text(json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    return manifest


def disjoint(train: list[Resolved], validation: list[Resolved]) -> None:
    """Training and validation sets share no document and no content.

    Indexed sets are compared; lazy ones are disjoint if all have one split policy and
    select its two sides. A mix of both can't be proven.
    """
    if not train or not validation:
        raise ManifestError("training needs data sets on both sides")
    every = [*train, *validation]
    if any(r.lazy for r in every):
        if not all(r.lazy for r in every):
            raise ManifestError("lazy and indexed data sets can't be proven disjoint")
        if any(r.selection != "train" for r in train) or any(r.selection != "validation" for r in validation):
            raise ManifestError("lazy data sets must select train on one side and validation on the other")
        if len({r.split_policy for r in every}) != 1:
            raise ManifestError("lazy data sets are disjoint only under one split policy")
        return
    from tessella.operators.accounting import overlap

    def union(side: list[Resolved]) -> DataFrame:
        return reduce(DataFrame.unionByName, [r.documents.select("document_id", "content_sha256") for r in side])

    for key in ("document_id", "content_sha256"):
        if shared := [r[0] for r in overlap(union(train), union(validation), key).orderBy(key).take(3)]:
            raise ManifestError(f"shared {key}: {shared}")


READERS["manifest"] = manifest_documents
