"""Verified release databases."""

from __future__ import annotations

import hashlib
import json
import re

from ..errors import ReleaseError
from ..functions.dimensions import DATABASE_SCHEMA, PROTOCOL

ASSET = "database-v1.json"
#: Where this library's own releases would live; a caller names its own.
API = "https://api.github.com/repos/stratum/stratum/releases"
DOWNLOADS = "https://github.com/stratum/stratum/releases/download/"


def release_url(tag: str | None, api: str = API) -> str:
    if tag is None:
        return f"{api}/latest"
    if not re.fullmatch(r"[A-Za-z0-9._-]+", tag):
        raise ReleaseError(f"tag {tag!r}")
    return f"{api}/tags/{tag}"


def parse_digest(text: str | None) -> str:
    if not re.fullmatch(r"sha256:[0-9A-Fa-f]{64}", text or ""):
        raise ReleaseError("asset digest")
    return text.removeprefix("sha256:").lower()


def validate(database: dict, protocol: str = PROTOCOL) -> None:
    if database.get("schema_version") != DATABASE_SCHEMA:
        raise ReleaseError("schema version")
    if database.get("protocol") != protocol:
        raise ReleaseError("protocol")
    names = [(p["name"], p["version"]) for p in database.get("projects", [])]
    if len(set(names)) != len(names):
        raise ReleaseError("repeated project")


def fetch_database(fetch, tag: str | None = None, *, api: str = API, downloads: str = DOWNLOADS, protocol: str = PROTOCOL) -> tuple[dict, bytes]:
    """The database of a release and its exact bytes, once name, address, digest, schema and identities hold."""
    release = json.loads(fetch(release_url(tag, api)))
    asset = next((a for a in release.get("assets", []) if a.get("name") == ASSET), None)
    if asset is None:
        raise ReleaseError("no such asset")
    digest = parse_digest(asset.get("digest"))
    if not asset["browser_download_url"].startswith(downloads):
        raise ReleaseError("asset address")
    data = fetch(asset["browser_download_url"])
    if hashlib.sha256(data).hexdigest() != digest:
        raise ReleaseError("digest mismatch")
    database = json.loads(data)
    validate(database, protocol)
    return database, data
