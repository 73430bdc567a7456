"""Manifests, output files, and a project's own managed state."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import re
import stat

from pyspark.sql import SparkSession

from ..errors import DigestMismatch, ForceRequired, InputNotFound, ManifestError, OutputError, StateError
from ..functions import dimensions as d
from ..operators import ledger
from ..operators.manifests import MANIFEST, first_error, manifest_errors
from ..sources import release
from ..sources.repository import fetch_snapshot
from ..sources.tree import read_tree
from .analysis import analyse_path, database, label_of, zstd_version

IGNORE, SNAPSHOT, CACHE = ".gitignore", "analysis.json", "cache.json"
IGNORED = b"*\n!.gitignore\n"
DOMAIN = "stratum-recognised-source-manifest-v1"
FIELDS = ("name", "version", "revision", "source_url", "archive_sha256", "path")


def write_atomic(path: str, data: bytes) -> None:
    """A new sibling, synced and renamed over the target; removed if anything fails."""
    folder, name = os.path.split(path)
    try:
        handle, made = tempfile.mkstemp(prefix=f".{name}-", suffix=".part", dir=folder or ".")
    except FileExistsError as e:
        raise OutputError(f"no temporary name beside {path}") from e
    try:
        with os.fdopen(handle, "wb") as f:
            os.fchmod(handle, 0o644)
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(made, path)
    except BaseException:
        if os.path.lexists(made):
            os.unlink(made)
        raise


def pretty(value: dict) -> bytes:
    return json.dumps(value, indent=2, ensure_ascii=False).encode() + b"\n"


def load_manifest(spark: SparkSession, path: str) -> list[dict]:
    """Projects of a manifest whose fields and values hold; unknown fields are errors."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except ValueError as e:
        raise ManifestError(str(e)) from e
    if not isinstance(held, dict) or set(held) != {"schema_version", "projects"}:
        raise ManifestError("fields of the manifest")
    if held["schema_version"] != d.DATABASE_SCHEMA:
        raise ManifestError(f"schema version {held['schema_version']}")
    projects = held["projects"]
    for i, p in enumerate(projects):
        if set(p) - set(FIELDS) or not {"name", "version", "source_url"} <= set(p):
            raise ManifestError(f"fields of project {i}")
    validate_projects(spark, projects)
    return projects


def validate_projects(spark: SparkSession, projects: list[dict]) -> None:
    rows = []
    for i, p in enumerate(projects):
        where = p.get("path")
        rows.append((i, *(p.get(k) for k in FIELDS), bool(where) and os.path.exists(where), bool(where) and os.path.isdir(where)))
    found = first_error(manifest_errors(spark.createDataFrame(rows, MANIFEST))).first()
    if found["error"] == "input not found":
        raise InputNotFound(projects[found["idx"]]["path"])
    if found["error"]:
        raise ManifestError(f"project {found['idx']}: {found['error']}")


def _managed_only(resolved: str, roots: dict[str, str]) -> list[str]:
    """Roots that hold the output, each in its managed directory."""
    out = []
    for root, project in roots.items():
        relative = os.path.relpath(resolved, root)
        if relative.split(os.sep)[0] == os.pardir:
            continue
        parts = relative.split(os.sep)
        if parts[0] != d.MANAGED:
            raise OutputError(f"{resolved} is inside project {project}")
        if len(parts) == 1 or parts[1:] == [IGNORE]:
            raise OutputError(f"{resolved} is reserved")
        out.append(root)
    return out


def prepare_output(path: str, roots: dict[str, str]) -> str:
    """Where to write: outside all projects (root -> name), or in the managed directory of each that holds it."""
    parent, name = os.path.split(path)
    parent = parent or "."
    if not name or name in (".", ".."):
        raise OutputError(path)
    if not os.path.exists(parent):
        owner = os.path.realpath(os.path.dirname(parent) or ".")
        if os.path.basename(parent) != d.MANAGED or owner not in roots:
            raise OutputError(f"no directory {parent}")
        _managed_only(os.path.join(owner, d.MANAGED, name), roots)
        ensure_managed(owner)
    resolved = os.path.join(os.path.realpath(parent), name)
    for root in _managed_only(resolved, roots):
        ensure_managed(root)
    return resolved


def ensure_managed(root: str) -> str:
    """The managed directory with its ignore file, made if absent and never mended."""
    managed = os.path.join(root, d.MANAGED)
    if not os.path.lexists(managed):
        os.mkdir(managed)
    if not stat.S_ISDIR(os.lstat(managed).st_mode):
        raise StateError(f"{managed} is not a directory")
    ignore = os.path.join(managed, IGNORE)
    if not os.path.lexists(ignore):
        write_atomic(ignore, IGNORED)
    if not stat.S_ISREG(os.lstat(ignore).st_mode) or _read(ignore) != IGNORED:
        raise StateError(f"contents of {ignore}")
    return managed


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def build_database(spark: SparkSession, manifest: str, output: str, fetch=None) -> dict:
    """The cohort database of a manifest, written once all projects are analysed."""
    projects = load_manifest(spark, manifest)
    roots: dict[int, object] = {}
    for i, p in enumerate(projects):
        if p.get("path") and os.path.exists(p["path"]):
            roots[i] = os.path.realpath(p["path"])
            continue
        if fetch is None:
            raise InputNotFound(p["source_url"])
        snapshot = fetch_snapshot(f"{p['source_url'].rstrip('/')}/commit/{p['revision']}", fetch)
        if snapshot.archive_sha256 != p["archive_sha256"].lower():
            raise DigestMismatch(p["name"])
        roots[i] = snapshot
    target = prepare_output(output, {r: projects[i]["name"] for i, r in roots.items() if isinstance(r, str)})
    made = database(spark, projects, roots)
    write_atomic(target, pretty(made))
    return made


def update_database(fetch, output: str, tag: str | None = None, **where) -> dict:
    """A verified release database, byte for byte."""
    made, data = release.fetch_database(fetch, tag, **where)
    write_atomic(output, data)
    return made


def requires_force(path: str) -> bool:
    home = os.environ.get("HOME")
    return os.path.dirname(path) == path or (bool(home) and os.path.realpath(home) == path)


def _root(path: str) -> str:
    root = os.path.realpath(path)
    if not os.path.isdir(root):
        raise InputNotFound(path)
    return root


def source_digest(spark: SparkSession, root: str) -> str:
    """Over paths and contents of the recognised files."""
    found = ledger.source_manifest(read_tree(spark, root, "tree"), DOMAIN).first()
    return found["digest"] if found else hashlib.sha256(DOMAIN.encode() + b"\0").hexdigest()


def initialise(spark: SparkSession, path: str, force: bool = False) -> tuple[dict, bool]:
    """The analysis of a project, and whether its stored one still held."""
    root = _root(path)
    if not force and requires_force(root):
        raise ForceRequired(root)
    label = label_of(path)
    if os.path.lexists(os.path.join(root, d.MANAGED)):
        ensure_managed(root)
    digest = source_digest(spark, root)
    stored = _stored(root, label, digest)
    if stored is not None:
        return stored, True
    analysis = analyse_path(spark, root, label)
    managed = ensure_managed(root)
    snapshot = os.path.join(managed, SNAPSHOT)
    write_atomic(snapshot, pretty(analysis))
    state = _state(analysis, digest, hashlib.sha256(_read(snapshot)).hexdigest())
    write_atomic(os.path.join(managed, CACHE), pretty(state))
    return analysis, False


def _state(analysis: dict, digest: str, snapshot: str) -> dict:
    return {
        "schema_version": d.CACHE_SCHEMA, "source_manifest_sha256": digest, "snapshot_sha256": snapshot,
        "analysis_schema_version": analysis["schema_version"], **{k: analysis[k] for k in ("stratum_version", "zstd_version", "protocol", "input_label")},
    }


def _stored(root: str, label: str, digest: str) -> dict | None:
    """The stored analysis if all that it depends on is as it was."""
    held = []
    for name in (SNAPSHOT, CACHE):
        path = os.path.join(root, d.MANAGED, name)
        if not os.path.lexists(path):
            return None
        if not stat.S_ISREG(os.lstat(path).st_mode):
            raise StateError(path)
        held.append(_read(path))
    try:
        analysis, state = map(json.loads, held)
        want = _state(analysis, digest, hashlib.sha256(held[0]).hexdigest())
    except (ValueError, KeyError, TypeError):
        return None
    now = {"analysis_schema_version": d.ANALYSIS_SCHEMA, "stratum_version": d.VERSION, "zstd_version": zstd_version(), "protocol": d.PROTOCOL, "input_label": label}
    return analysis if state == want and all(state[k] == v for k, v in now.items()) else None


def clean(path: str, force: bool = False) -> None:
    """Remove a project's managed directory if it holds what belongs there and nothing else."""
    root = _root(path)
    if not force and requires_force(root):
        raise ForceRequired(root)
    managed = os.path.join(root, d.MANAGED)
    if not os.path.lexists(managed):
        raise StateError(f"no {managed}")
    if not stat.S_ISDIR(os.lstat(managed).st_mode):
        raise StateError(f"{managed} is not a directory")
    names = os.listdir(managed)
    for name in names:
        full = os.path.join(managed, name)
        if name not in (IGNORE, SNAPSHOT, CACHE) or not stat.S_ISREG(os.lstat(full).st_mode):
            raise StateError(full)
        if name == IGNORE and _read(full) != IGNORED:
            raise StateError(f"contents of {full}")
    if IGNORE not in names:
        raise StateError(f"no {IGNORE} in {managed}")
    for name in names:
        os.unlink(os.path.join(managed, name))
    os.rmdir(managed)


def is_remote(source: str) -> bool:
    return re.match("https://github.com/", source) is not None
