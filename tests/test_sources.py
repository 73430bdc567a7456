import gzip
import hashlib
import io
import os
import tarfile

import pytest

from stratum import errors
from stratum.functions.dimensions import EXCLUDED, LANGUAGES
from stratum.sources import release, repository
from stratum.sources.tree import Ignore, language_of, list_tree, read_tree

SHA = "0123456789abcdef0123456789abcdef01234567"


def paths(root):
    return sorted(p for p, _ in list_tree(root))


def test_language_table_and_last_extension():
    assert len(LANGUAGES) == 25 and sum(len(x) for _, x in LANGUAGES) == 40
    assert language_of("a.rs")[0] == "Rust" and language_of("x/a.tar.rs")[0] == "Rust" and language_of("..rs")[0] == "Rust"
    assert language_of("x.S")[0] == language_of("x.s")[0] == "Assembly"
    assert language_of(".rs") is None and language_of("a.") is None and language_of("a.RS") is None


def test_tree_prunes_hides_and_follows_no_links(tree):
    root = tree({**{f"{x}/a.rs": "x" for x in EXCLUDED}, "kept.rs": "x", ".hidden.rs": "x", ".hid/b.rs": "x", "src/target.rs": "x", "empty.py": ""})
    os.symlink(f"{root}/kept.rs", f"{root}/link.rs")
    os.symlink(f"{root}/src", f"{root}/linked")
    assert paths(root) == [".hid/b.rs", ".hidden.rs", "empty.py", "kept.rs", "src/target.rs"]
    assert paths(f"{root}/kept.rs") == ["kept.rs"]
    with pytest.raises(errors.InputNotFound):
        paths(f"{root}/gone")


def test_ignore_files_without_a_repository(tree):
    root = tree({".gitignore": "ignored.rs\n*.log.py\n/only.rs\nsub/\n!keep.log.py\n", "ignored.rs": "", "kept.rs": "", "a.log.py": "", "keep.log.py": "",
                 "only.rs": "", "d/only.rs": "", "sub/x.rs": "", "d/.gitignore": "!ignored.rs\nz?.rs\n", "d/ignored.rs": "", "d/z1.rs": "", "d/z12.rs": ""})
    assert [p for p in paths(root) if not p.endswith(".gitignore")] == ["d/ignored.rs", "d/only.rs", "d/z12.rs", "keep.log.py", "kept.rs"]


def test_ignore_patterns():
    ignore = Ignore({"": "a/**/b.rs\n**/deep.rs\nlogs/**\n[ab].c\n\\#x.c\n# comment\nd/\n!d/in.rs"})
    for path in ("a/b.rs", "a/x/y/b.rs", "p/q/deep.rs", "deep.rs", "logs/x", "a.c", "#x.c", "d/in.rs"):
        assert ignore.ignored(path), path
    for path in ("b.rs", "c.c", "x/logs/y", "comment"):
        assert not ignore.ignored(path), path


def test_tree_source(spark, tree):
    root = tree({"b.py": b"\xff\x00", "a.rs": "fn", "note.txt": "n", "empty.go": ""})
    rows = {r["path"]: r for r in read_tree(spark, root, "c").collect()}
    assert bytes(rows["b.py"]["content"]) == b"\xff\x00" and rows["a.rs"]["language"] == "Rust"
    assert rows["note.txt"]["language"] is None and rows["note.txt"]["content"] is None and rows["empty.go"]["size"] == 0


def test_unknown_files_are_not_opened(spark, tree):
    root = tree({"known.rs": "x", "unknown.bin": "x"})
    os.chmod(f"{root}/unknown.bin", 0)
    assert read_tree(spark, root).count() == 2


@pytest.mark.parametrize("text, want", [
    ("https://github.com/o/r", ("o", "r", None)), (" https://github.com/o/r.git/ ", ("o", "r", None)),
    ("https://github.com/o/r/tree/main", ("o", "r", "main")), (f"https://github.com/o/r/commit/{SHA}", ("o", "r", SHA)),
])
def test_addresses(text, want):
    a = repository.parse_address(text)
    assert (a.owner, a.repository, a.revision) == want


@pytest.mark.parametrize("text", ["http://github.com/o/r", "https://github.com/o", "https://github.com/o/r/tree/a/b", "https://github.com/o/r/commit/ab", "https://github.com/o/r/pull/1", "https://github.com//r"])
def test_bad_addresses(text):
    with pytest.raises(errors.UnsupportedUrl):
        repository.parse_address(text)


def line(text):
    data = text.encode()
    return f"{len(data) + 4:04x}".encode() + data


def advertisement(*refs):
    body = b"".join(line(f"{c} {n}\0caps\n" if i == 0 else f"{c} {n}\n") for i, (c, n) in enumerate(refs))
    return line("# service=git-upload-pack\n") + b"0000" + body + b"0000"


def test_advertisement_and_precedence():
    refs = repository.parse_advertisement(advertisement(("A" * 40, "HEAD"), ("b" * 40, "refs/heads/x"), ("c" * 40, "refs/tags/x"), ("d" * 40, "refs/tags/t"), ("e" * 40, "refs/tags/t^{}")))
    at = lambda r: repository.resolve(repository.Address("o", "r", r), refs)
    assert (at(None), at("x"), at("t")) == ("a" * 40, "b" * 40, "e" * 40)
    with pytest.raises(errors.RevisionNotFound):
        at("none")


@pytest.mark.parametrize("data", [b"00", b"zzzz", line("# service=x\n") + b"0000", advertisement(("a" * 40, "HEAD"), ("b" * 40, "HEAD")), advertisement(("a" * 39, "HEAD")),
                                  advertisement(("a" * 40, "HEAD"))[:-4], advertisement(("a" * 40, "HEAD")) + line("x"), b"0000"])
def test_bad_advertisements(data):
    with pytest.raises(errors.AdvertisementError):
        repository.parse_advertisement(data)


def test_commit_page():
    mark = b'"currentOid":"' + b"F" * 40 + b'"'
    assert repository.commit_of_page(b"<html>" + mark + mark) == "f" * 40
    for page in (b"", b'"currentOid":"ab"', mark + mark.replace(b"F", b"e")):
        with pytest.raises(errors.CommitPageError):
            repository.commit_of_page(page)


def archive(members, commit=SHA):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name if name.startswith(("/", "other")) else f"r-{commit}/{name}")
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "a.rs"
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return gzip.compress(out.getvalue())


def test_archives():
    commit, files = repository.archive_files(archive([("a.rs", b"x"), ("link.rs", None), ("d/b.py", b"y")]))
    assert commit == SHA and files == [("a.rs", b"x"), ("d/b.py", b"y")]
    for bad in ([("../x", b"")], [("/abs", b"")], [("a\\b", b"")], [("c:d", b"")], [("a", b""), ("a", b"")], [("a", b""), ("other/b", b"")]):
        with pytest.raises(errors.ArchiveError):
            repository.archive_files(archive(bad))
    with pytest.raises(errors.ArchiveError):
        repository.archive_files(archive([("a", b"")], "short"))
    with pytest.raises(errors.ArchiveError):
        repository.archive_files(b"not gzip")


def fetcher(data, broken=False, refs=None):
    def fetch(url, most):
        if "info/refs" in url:
            if broken:
                raise OSError("no")
            if refs is not None:
                return refs
            return advertisement((SHA, "HEAD"))
        return b'"currentOid":"' + SHA.encode() + b'"' if "/commit/" in url else data

    return fetch


@pytest.mark.parametrize("broken", [False, True])
def test_snapshot(broken):
    data = archive([("a.rs", b"x"), ("target/b.rs", b"y"), (".gitignore", b"c.rs\n"), ("c.rs", b"")])
    s = repository.fetch_snapshot("https://github.com/o/r", fetcher(data, broken))
    assert s.commit == SHA and s.archive_sha256 == hashlib.sha256(data).hexdigest()
    assert [p for _, p, _ in repository.snapshot_rows(s, EXCLUDED)] == [".gitignore", "a.rs"]


def test_a_malformed_advertisement_is_an_error():
    for refs in (b"", b"<html>", advertisement((SHA, "HEAD"))[:-4]):
        with pytest.raises(errors.AdvertisementError):
            repository.fetch_snapshot("https://github.com/o/r", fetcher(b"", refs=refs))


def test_fetches_are_capped_by_kind_and_expansion(monkeypatch):
    asked = {}
    monkeypatch.setattr(repository, "EXPANDED", 10)
    good = fetcher(archive([("a.rs", b"x" * 8), ("b.rs", b"y" * 8)]), broken=True)

    def fetch(url, most):
        asked[url.split("/")[2] + ("/page" if "/commit/" in url else "/refs" if "info/refs" in url else "")] = most
        return good(url, most)

    with pytest.raises(errors.SizeLimit):
        repository.fetch_snapshot("https://github.com/o/r", fetch)
    assert asked == {"github.com/refs": 8 << 20, "github.com/page": 4 << 20, "codeload.github.com": 256 << 20}


def test_snapshot_limits(monkeypatch):
    monkeypatch.setitem(repository.LIMITS, "archive", 3)
    with pytest.raises(errors.SizeLimit):
        repository.fetch_snapshot("https://github.com/o/r", fetcher(archive([("a.rs", b"x")])))
    monkeypatch.undo()
    with pytest.raises(errors.DigestMismatch):
        repository.fetch_snapshot("https://github.com/o/r", fetcher(archive([("a.rs", b"x")], "f" * 40)))


def test_release():
    import json

    database = {"schema_version": 1, "protocol": release.PROTOCOL, "projects": [{"name": "a", "version": "1"}]}
    data = json.dumps(database).encode()
    url = release.DOWNLOADS + "v1/database-v1.json"

    def fetch(meta, body=data):
        return lambda u: json.dumps({"assets": [meta]}).encode() if "/releases/latest" in u or "/tags/" in u else body

    good = {"name": release.ASSET, "digest": "sha256:" + hashlib.sha256(data).hexdigest(), "browser_download_url": url}
    assert release.fetch_database(fetch(good)) == (database, data)
    twice = json.dumps({**database, "projects": database["projects"] * 2}).encode()
    for meta, body in (({**good, "name": "x"}, data), ({**good, "digest": None}, data), ({**good, "browser_download_url": "https://x"}, data), (good, b"{}"),
                       ({**good, "digest": "sha256:" + hashlib.sha256(twice).hexdigest()}, twice)):
        with pytest.raises(errors.ReleaseError):
            release.fetch_database(fetch(meta, body))
    with pytest.raises(errors.ReleaseError):
        release.release_url("a/b")
