"""A source tree as a table: a Python data source that lists on the driver and reads in tasks.

Hidden files count; links are not followed; ignore files inside the tree are
honoured; directories of excluded names are not entered. Only files of a known
language are opened; others are rows without content.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InputNotFound, PathError
from ..functions.dimensions import EXCLUDED, LANGUAGES

_extensions = {x: (name, i) for i, (name, some) in enumerate(LANGUAGES) for x in some}


def language_of(path: str) -> tuple[str, int] | None:
    """By the last extension; a name that only begins with a point has none."""
    stem, dot, extension = path.rpartition("/")[2].rpartition(".")
    return _extensions.get(extension) if dot and stem else None


def _pattern(glob: str) -> str:
    """A regular expression for one glob without a leading slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (found := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(glob, i)):
            body = found[2].replace("\\", "\\\\")
            out += f"[{'^' if found[1] else ''}{body}]"
            i = found.end() - 1
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def _rules(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern over paths below the file's directory, for directories only, negated) in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        only = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        out.append((re.compile(("" if anchored else "(?:.*/)?") + _pattern(line.removeprefix("/")), re.S), only, negated))
    return out


class Ignore:
    """Ignore files by directory ('' is the root): the last rule that matches decides, deeper files after higher ones."""

    def __init__(self, files: dict[str, str] | None = None):
        self.rules: dict[str, list] = {}
        for directory, text in (files or {}).items():
            self.add(directory, text)

    def add(self, directory: str, text: str) -> None:
        self.rules[directory] = _rules(text)

    def matches(self, path: str, is_dir: bool) -> bool:
        parts = path.split("/")
        out = False
        for depth in range(len(parts)):
            base = "/".join(parts[:depth])
            rest = "/".join(parts[depth:])
            for pattern, only, negated in self.rules.get(base, ()):
                if (is_dir or not only) and pattern.fullmatch(rest):
                    out = not negated
        return out

    def ignored(self, path: str) -> bool:
        """Also through a directory above: nothing below an ignored directory comes back."""
        parts = path.split("/")
        return any(self.matches("/".join(parts[:k]), k < len(parts)) for k in range(1, len(parts) + 1))


def list_tree(root: str) -> Iterator[tuple[str, str]]:
    """(path below the root, full path) of regular files; for a file, its own name."""
    if not os.path.lexists(root):
        raise InputNotFound(root)
    if os.path.isfile(root):
        yield os.path.basename(root), root
        return
    ignore = Ignore()
    todo = [""]
    while todo:
        here = todo.pop()
        full = os.path.join(root, here) if here else root
        entries = sorted(os.scandir(full), key=lambda e: os.fsencode(e.name))
        for entry in entries:
            if entry.name == ".gitignore" and entry.is_file(follow_symlinks=False):
                with open(entry.path, encoding="utf-8", errors="replace") as f:
                    ignore.add(here, f.read())
        for entry in entries:
            path = f"{here}/{entry.name}" if here else entry.name
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in EXCLUDED and not ignore.matches(path, True):
                    todo.append(path)
            elif entry.is_file(follow_symlinks=False) and not ignore.matches(path, False):
                yield path, entry.path


class _Files(InputPartition):
    def __init__(self, files):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, corpus: str, batch: int):
        self.root, self.corpus, self.batch = root, corpus, batch

    def partitions(self):
        """Batches of about ``batch`` bytes."""
        out, some, size = [], [], 0
        for path, full in sorted(list_tree(self.root), key=lambda x: os.fsencode(x[0])):
            known = language_of(path)
            if known:
                try:
                    path.encode("utf-8")
                except UnicodeEncodeError as e:
                    raise PathError(repr(path)) from e
            some.append((path.encode("utf-8", "replace").decode(), full, known))
            size += os.path.getsize(full) if known else 64
            if size >= self.batch:
                out, some, size = [*out, _Files(some)], [], 0
        return [*out, _Files(some)] if some or not out else out

    def read(self, partition):
        for path, full, known in partition.files:
            if known is None:
                yield self.corpus, path, None, None, None, None
                continue
            with open(full, "rb") as f:
                data = f.read()
            yield self.corpus, path, known[0], known[1], data, len(data)


class TreeSource(DataSource):
    """``spark.read.format("source_tree").option("path", root)``; options: corpus, batch_bytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "corpus string, path string, language string, lang_ord int, content binary, size long"

    def reader(self, schema) -> DataSourceReader:
        root = self.options["path"]
        return _Reader(root, self.options.get("corpus", root), int(self.options.get("batch_bytes", 64 << 20)))


def read_tree(spark: SparkSession, root: str, corpus: str | None = None) -> DataFrame:
    """Files of a tree that all executors can read."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("path", root)
    return (reader if corpus is None else reader.option("corpus", corpus)).load()
