"""Driver-side records: fingerprints of configurations, guards, and walks over JSON values."""

from __future__ import annotations

import copy
import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from tessella.functions.text import canonical_json

#: Parts of a configuration that don't make another experiment of it (fixed values).
NOT_IDENTITY = (("measurement",), ("wandb",), ("artifacts", "resume_path"))
#: Words that mark a key as holding a secret (fixed values).
SECRET_WORDS = ("api_key", "token", "password", "secret", "credential")


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def experiment_id(config: Mapping[str, Any]) -> str:
    """``exp-`` and 20 digits of the fingerprint of what identifies an experiment."""
    kept = copy.deepcopy(dict(config))
    for path in NOT_IDENTITY:
        at: Any = kept
        for part in path[:-1]:
            at = at.get(part) if isinstance(at, Mapping) else None
        if isinstance(at, dict):
            at.pop(path[-1], None)
    return "exp-" + fingerprint(kept)[:20]


def walk(value: Any, path: tuple = ()) -> Iterator[tuple[tuple, Any]]:
    """Every path of a JSON value, parents first."""
    yield path, value
    children = value.items() if isinstance(value, Mapping) else enumerate(value) if isinstance(value, Sequence) and not isinstance(value, str | bytes) else ()
    for k, v in children:
        yield from walk(v, (*path, k))


def secret_keys(value: Any) -> list[str]:
    """Paths whose key names a secret and which hold something; counts and limits of tokens are none."""
    found = []
    for path, v in walk(value):
        key = str(path[-1]).lower() if path else ""
        if isinstance(v, str) and v and any(key == w or key.endswith("_" + w) for w in SECRET_WORDS):
            found.append(".".join(map(str, path)))
    return found


def types_in(value: Any) -> list[str]:
    """Distinct ``type`` values of a JSON value, in order of appearance."""
    return list(dict.fromkeys(v for path, v in walk(value) if path and path[-1] == "type" and isinstance(v, str)))


def check_sources(sources: Sequence[Mapping[str, Any]], manifest_only: bool = False) -> None:
    """Names are distinct, ratios positive and sum to 1, hub revisions are pinned."""
    names = [s.get("name") for s in sources]
    if not sources or len(set(names)) != len(names) or not all(isinstance(n, str) and n for n in names):
        raise ValueError("sources need distinct names")
    ratios = [s.get("ratio") for s in sources]
    if any(isinstance(r, bool) or not isinstance(r, int | float) or r <= 0 for r in ratios) or not math.isclose(sum(ratios), 1, abs_tol=1e-6):
        raise ValueError("ratios must be positive and sum to 1")
    for s in sources:
        if manifest_only and s.get("type") != "manifest":
            raise ValueError(f"source {s['name']!r} must be a manifest")
        revision = s.get("revision", "")
        if s.get("type") == "hf" and not (len(revision) == 40 and set(revision) <= set("0123456789abcdef")):
            raise ValueError(f"source {s['name']!r} needs a pinned revision")


def reproduction(config: Mapping[str, Any], command: Sequence[str]) -> dict[str, Any]:
    """What it takes to run again; refused if the configuration holds secrets."""
    if found := secret_keys(config):
        raise ValueError(f"the configuration holds secrets: {', '.join(found)}")
    return {"command": list(command), "config": dict(config), "config_fingerprint": fingerprint(config)}


def reproduction_holds(payload: Mapping[str, Any]) -> bool:
    return fingerprint(payload["config"]) == payload["config_fingerprint"]


def effective_tokens(batch: int, length: int, accumulation: int) -> int:
    """Target tokens of an optimizer update."""
    return batch * length * accumulation


def split_seed(base: int, split: str) -> int:
    """The seed of a side: training has the run's, validation the next."""
    return base + ("train", "validation").index(split)


def check_tokenizer(manifest: Mapping[str, Any], files: Mapping[str, bytes], vocabulary: Mapping[str, int], encode: Callable[[str], list[int]], decode: Callable[[list[int]], str]) -> None:
    """A tokenizer is what its manifest says: file hashes and sizes, ids without gaps from 0, distinct special tokens at their ids, and probes that come back.

    The manifest has ``files`` (name -> sha256, size_bytes), ``vocabulary_size``, ``special_tokens`` (token -> id) and ``probes`` (text, ids).
    """
    for name, want in manifest["files"].items():
        data = files.get(name)
        if data is None or len(data) != want["size_bytes"] or hashlib.sha256(data).hexdigest() != want["sha256"]:
            raise ValueError(f"{name} isn't the file that the manifest names")
    if sorted(vocabulary.values()) != list(range(manifest["vocabulary_size"])):
        raise ValueError("ids must run from 0 without gaps")
    special = manifest["special_tokens"]
    if len(set(special.values())) != len(special) or any(vocabulary.get(t) != i for t, i in special.items()):
        raise ValueError("special tokens must be distinct and have their ids")
    for probe in manifest["probes"]:
        ids = encode(probe["text"])
        if ids != list(probe["ids"]) or decode(ids) != probe["text"]:
            raise ValueError(f"the probe {probe['text']!r} doesn't come back")


def check_plan(plan: Mapping[str, Any], regenerated: Sequence[Mapping[str, Any]], authority: Sequence[str]) -> None:
    """An immutable plan: its hash binds it, its runs are the regenerated matrix, and its authority keys are distinct and those expected."""
    if fingerprint({k: v for k, v in plan.items() if k != "plan_id"}) != plan.get("plan_id"):
        raise ValueError("the plan was changed after its hash was made")
    if list(plan["runs"]) != list(regenerated):
        raise ValueError("the plan's runs aren't those of the matrix")
    if len(set(authority)) != len(authority) or set(authority) != {f"{r['candidate_id']}/{r['repetition']}" for r in regenerated}:
        raise ValueError("the authority keys aren't those of the plan")


def comparable(signatures: Sequence[Mapping[str, Any]]) -> None:
    """Reports can be compared if what they were made with is the same."""
    if len({fingerprint(s) for s in signatures}) > 1:
        raise ValueError("reports of different signatures can't be compared")


def numbers_in(value: Any) -> dict[str, float]:
    """Every finite number of a JSON value by its dotted path; booleans are none."""
    return {".".join(map(str, path)): float(v) for path, v in walk(value) if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)}


def run_manifest(config: Mapping[str, Any], command: Sequence[str], inputs: Mapping[str, bytes], git_commit: str, lock: bytes) -> dict[str, Any]:
    """What binds a run: its reproduction payload, the hashes of its inputs and of the lock of its packages, and its commit."""
    hashes = {name: hashlib.sha256(data).hexdigest() for name, data in sorted(inputs.items())}
    return reproduction(config, command) | {"inputs": hashes, "git_commit": git_commit, "lock_sha256": hashlib.sha256(lock).hexdigest()}


def run_differences(manifest: Mapping[str, Any], inputs: Mapping[str, bytes], git_commit: str, lock: bytes) -> list[str]:
    """What no longer is as the manifest of a run has it: inputs that are gone, changed or new, the commit, the lock, the configuration."""
    now = {name: hashlib.sha256(data).hexdigest() for name, data in inputs.items()}
    out = [f"input {n}" for n in sorted(set(now) | set(manifest["inputs"])) if now.get(n) != manifest["inputs"].get(n)]
    out += ["git commit"] if git_commit != manifest["git_commit"] else []
    out += ["lock"] if hashlib.sha256(lock).hexdigest() != manifest["lock_sha256"] else []
    return out + ([] if reproduction_holds(manifest) else ["configuration"])
