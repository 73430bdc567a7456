import hashlib
import json
import os
import threading

import pytest

from stratum import __main__ as cli
from stratum import errors
from stratum.functions import dimensions as d
from stratum.operators import streams
from stratum.operators.ledger import NoSourceBytes
from stratum.plans import analysis, render, state
from stratum.sources.repository import Snapshot

PYTHON = "def compute(value):\n    return value * value + 1\n" * 2048


def test_analysis_is_complete_and_repeats(spark, tree):
    root = tree({"a.py": PYTHON, "b.rs": "fn main() {}\n", "empty.rs": "", "x.bin": "q"})
    one, two = (analysis.analyse_path(spark, root) for _ in range(2))
    assert one == two and one["skipped_file_count"] == 1 and one["overall"]["file_count"] == 3
    assert [x["language"] for x in one["languages"]] == ["Rust", "Python"]
    score = one["profile"]["score"]
    assert sum(score["weights"].values()) == pytest.approx(1) and max(score["weights"].values()) <= 0.30
    python = next(b for b in one["profile"]["baselines"] if b["language"] == "Python")
    assert python["sample_count"] == 3 and python["percentile"] is not None
    text = render.analysis(one)
    assert "information_density:" in text and render.bar(0.5) == "[" + "█" * 6 + "·" * 6 + "]"


def test_ledger_has_no_profile_and_labels_hide_parents(spark, tree):
    root = tree({"a.rs": "first", "b.rs": "second"})
    made = analysis.analyse_path(spark, root, profile=False)
    assert "profile" not in made and made["schema_version"] == 1 and made["input_label"] == "project"
    assert made["overall"]["sha256"] == hashlib.sha256(b"firstsecond").hexdigest()
    assert analysis.label_of(".") == "." and analysis.label_of("/a/b/") == "b"


@pytest.mark.parametrize("files", [{"a.rs": "", "b.py": ""}, {"data.bin": "x"}])
def test_no_source_bytes(spark, tree, files):
    with pytest.raises(NoSourceBytes):
        analysis.analyse_path(spark, tree(files))


def test_noise_scores_low(spark, tree):
    from test_operators import xorshift

    score = analysis.analyse_path(spark, tree({"a.rs": xorshift(16384)}))["profile"]
    assert score["noise"]["noise_ratio"] > 0.9 and score["score"]["signal"] < 10 and score["score"]["information_density"] < 50


def test_granular(spark, tree):
    root = tree({"src/main.rs": "fn outer() { let c = |x| x; }\nimpl S { fn method(&self) {} }\n", "src/helper.py": "x = 1\n"})
    made = analysis.granular_path(spark, root, True, True)
    assert [f["path"] for f in made["files"]] == ["src/helper.py", "src/main.rs"]
    assert {f["symbol"].split("-")[0] for f in made["functions"]} == {"outer", "closure", "method"}
    assert made["unsupported_function_languages"] == ["Python"] and "functions:" in render.granular(made)
    assert analysis.granular_path(spark, root, False, True)["functions"] == []


def test_streams_of_an_analysis_are_one_job(spark, tree, monkeypatch):
    calls, made = [], streams.stream_sizes
    monkeypatch.setattr(streams, "stream_sizes", lambda *a, **b: calls.append(a[1]) or made(*a, **b))
    analysis.analyse_path(spark, tree({"a.rs": "fn a() {}\n", "b.py": "x = 1\n"}))
    assert len(calls) == 1


def test_files_are_made_beside_streams(spark, tree, monkeypatch):
    root = tree({"a.rs": "fn a() {}\n", "b.py": "x = 1\n"})
    want = analysis.granular(analysis.read_tree(spark, root, "tree"), analysis.analyse_path(spark, root), True, True)
    both = threading.Barrier(2)
    for module, name in ((streams, "stream_sizes"), (analysis.ledger, "by_file")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **b: both.wait(60) * 0 or f(*a, **b))
    assert analysis.granular_path(spark, root, True, True) == want


def test_relation(spark, tree):
    line = "pub fn item() -> usize { 1 }\n" * 512
    root = tree({"a.rs": line, "b.rs": line, "c.txt": "x"})
    one, two = analysis.relate_paths(spark, root, "a.rs", "b.rs"), analysis.relate_paths(spark, root, "./b.rs", "a.rs")
    assert one == two and one["adjusted_cross_stream_gain_bytes"] > 0 and "raw_cross_stream_gain" in render.relation(one)
    for pair in (("a.rs", "a.rs"), ("../x.rs", "a.rs"), ("/a.rs", "b.rs"), ("a.rs", "c.txt"), ("a.rs", "gone.rs")):
        with pytest.raises(errors.RelationError):
            analysis.relate_paths(spark, root, *pair)


def snapshot(url, files, commit="a" * 40):
    return Snapshot(url, commit, hashlib.sha256(url.encode()).hexdigest(), [(p, c.encode()) for p, c in files.items()])


def test_comparison_ignores_the_order(spark):
    body = "fn shared() -> u64 { " + "let value = compute(value, 17); " * 8 + "}\n"
    a = snapshot("https://github.com/o/a", {"a.rs": body, "z.rs": "fn one() {}\n"})
    b = snapshot("https://github.com/o/b", {"b.rs": body, "y.rs": "fn two() {}\n"})
    one, two = analysis.compare_snapshots(spark, a, b, True), analysis.compare_snapshots(spark, b, a, True)
    assert one == two and one["first"]["repository_url"].endswith("/a")
    assert [(p["first"]["symbol"], p["second"]["symbol"]) for p in one["function_similarities"]] == [("shared", "shared")]
    assert not one["function_similarity_truncated"] and "<->" in render.comparison(one)
    single = analysis.analyse_snapshot(spark, a, True, True)
    assert single["provenance"]["commit"] == "a" * 40 and "snapshot_interpretation" in render.repository(single)


def manifest(tmp_path, projects, version=1, **more):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"schema_version": version, "projects": projects, **more}))
    return str(path)


def project(root, name="alpha", **more):
    return {"name": name, "version": "1", "source_url": "https://example.org", "path": root, **more}


def test_database(spark, tree, tmp_path):
    a, z = tree({"a.rs": "fn a() {}"}, "a"), tree({"z.py": "z = 1"}, "z")
    out = tmp_path / "database.json"
    made = state.build_database(spark, manifest(tmp_path, [project(z, "zeta"), project(a)]), str(out))
    assert [p["name"] for p in made["projects"]] == ["alpha", "zeta"] and out.read_bytes().endswith(b"}\n")
    assert json.loads(out.read_bytes()) == made and a not in out.read_text()
    assert all("profile" not in p["analysis"] for p in made["projects"])


def test_bad_manifests_leave_the_target(spark, tree, tmp_path):
    root = tree({"a.rs": "x"})
    out = tmp_path / "database.json"
    out.write_text("kept")
    file = os.path.join(root, "a.rs")
    for bad in (manifest(tmp_path, [], 2), manifest(tmp_path, [], extra=1)):
        with pytest.raises(errors.ManifestError):
            state.build_database(spark, bad, str(out))
    for projects, error in (([project(root)] * 2, errors.ManifestError), ([project(file)], errors.ManifestError), ([project(root, unknown=1)], errors.ManifestError),
                            ([project("/gone")], errors.InputNotFound), ([project(root, archive_sha256="x")], errors.ManifestError)):
        with pytest.raises(error):
            state.build_database(spark, manifest(tmp_path, projects), str(out))
    with pytest.raises(NoSourceBytes):
        state.build_database(spark, manifest(tmp_path, [project(tree({"x.bin": ""}, "none"))]), str(out))
    assert out.read_text() == "kept"


def test_output_placement(tree):
    root = tree({"a.rs": "x"})
    roots = {os.path.realpath(root): "p"}
    for bad in ("out.json", "sub/out.json", f"{d.MANAGED}/.gitignore"):
        os.makedirs(os.path.join(root, "sub"), exist_ok=True)
        os.makedirs(os.path.join(root, d.MANAGED), exist_ok=True)
        with pytest.raises(errors.OutputError):
            state.prepare_output(os.path.join(root, bad), roots)
    os.rmdir(os.path.join(root, d.MANAGED))
    good = state.prepare_output(os.path.join(root, d.MANAGED, "out.json"), roots)
    assert os.path.dirname(good).endswith(d.MANAGED) and open(os.path.join(root, d.MANAGED, ".gitignore"), "rb").read() == state.IGNORED
    os.symlink(root, root + "-link")
    with pytest.raises(errors.OutputError):
        state.prepare_output(root + "-link/out.json", roots)
    with pytest.raises(errors.OutputError):
        state.prepare_output(root + "-gone/out.json", roots)


def test_state_hits_misses_and_cleans(spark, tree):
    root = tree({"a.rs": "fn a() {}\n"})
    first, hit = state.initialise(spark, root)
    again, second = state.initialise(spark, root)
    assert not hit and second and first == again
    open(os.path.join(root, "a.rs"), "a").write("fn b() {}\n")
    assert not state.initialise(spark, root)[1]
    cache = os.path.join(root, d.MANAGED, state.CACHE)
    open(cache, "w").write("{}")
    assert not state.initialise(spark, root)[1] and state.initialise(spark, root)[1]
    extra = os.path.join(root, d.MANAGED, "extra")
    open(extra, "w").close()
    with pytest.raises(errors.StateError):
        state.clean(root)
    os.unlink(extra)
    state.clean(root)
    assert not os.path.exists(os.path.join(root, d.MANAGED))
    with pytest.raises(errors.StateError):
        state.clean(root)


def test_clean_refuses_links_and_changed_ignore_files(tree):
    root = tree({f"{d.MANAGED}/.gitignore": "other", "a.rs": ""})
    with pytest.raises(errors.StateError):
        state.clean(root)
    other = tree({"b.rs": ""}, "other")
    os.symlink(root, os.path.join(other, d.MANAGED))
    with pytest.raises(errors.StateError):
        state.clean(other)


def test_force(monkeypatch, tree, spark):
    root = tree({"a.rs": "x"})
    monkeypatch.setenv("HOME", root)
    for refuse in (lambda: state.initialise(spark, root), lambda: state.clean(root), lambda: state.clean("/")):
        with pytest.raises(errors.ForceRequired):
            refuse()


def test_atomic_write_keeps_the_old_file(tmp_path, monkeypatch):
    target = tmp_path / "x.json"
    target.write_text("old")
    monkeypatch.setattr(os, "replace", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        state.write_atomic(str(target), b"new")
    assert target.read_text() == "old" and os.listdir(tmp_path) == ["x.json"]


def test_command_line(spark, tree):
    root = tree({"a.rs": "fn a() {}\n", "b.rs": "fn b() {}\n"})
    assert "compression:" in cli.run(spark, ["analyse", root])
    assert json.loads(cli.run(spark, ["analyse", root, "--ledger-only", "--format", "json"]))["schema_version"] == 1
    assert "a.rs:1-1 function a" in cli.run(spark, ["analyse", root, "--granularity", "function"])
    assert "combined:" in cli.run(spark, ["relate", root, "a.rs", "b.rs"])
    assert cli.run(spark, ["init", root]).endswith("cache: miss\n") and cli.run(spark, ["clean", root]) == "removed\n"
    with pytest.raises(errors.StratumError):
        cli.run(spark, ["analyse", root, "--ledger-only", "--granularity", "file"])
    with pytest.raises(errors.StratumError):
        cli.run(spark, ["compare", "https://github.com/o/a", "https://github.com/o/b", "--granularity", "file"])


def test_profile_and_granular_compress_each_stream_once(spark, monkeypatch, tmp_path):
    from stratum.operators import ledger, streams

    kinds = [("p", "Rust", 0), ("p", "Python", 1), ("q", "Rust", 0), ("q", None, None), ("q", "Rust", 0)] * 3
    rows = [(c, f"{i:03d}", lang, o, bytearray(b"fn a() { b(%d) }\n" % i * (i + 1))) for i, (c, lang, o) in enumerate(kinds)]
    files = spark.createDataFrame([(*r, len(r[4]) if r[2] else None) for r in rows], "corpus string, path string, language string, lang_ord int, content binary, size long").cache()
    want = {r["corpus"]: r for r in ledger.overall(files).collect()}
    fed, metric, sizes = tmp_path / "fed", ledger.file_metric, streams.stream_sizes

    def counted(table, what):
        def note(batches):
            for b in batches:
                with open(fed, "a") as f:
                    f.write(f"{what}\n" * b.num_rows)
                yield b

        return table.mapInArrow(note, table.schema)

    monkeypatch.setattr(ledger, "file_metric", lambda table, keys: metric(counted(table, "file"), keys))
    monkeypatch.setattr(streams, "stream_sizes", lambda *a: counted(sizes(*a), "stream"))
    found = analysis.analyse(files)
    lines = fed.read_text().splitlines()
    assert lines.count("stream") == 5  # two corpora and three languages of them
    for c, a in found.items():
        assert a["overall"] == {k: want[c][k] for k in analysis.METRIC}
        assert a["overall"]["compressed_bytes"] == next(x["compressed_bytes"] for x in a["profile"]["compression"]["zstd_curve"] if x["level"] == 19)
    assert found["q"]["skipped_file_count"] == 3 and found["p"]["skipped_file_count"] == 0
    one = files.where("corpus = 'p'")
    made = analysis.granular(one, found["p"], True, False)
    assert [r["path"] for r in made["files"]] == sorted(r[1] for r in rows if r[0] == "p")
    assert fed.read_text().splitlines().count("file") == len(made["files"])
