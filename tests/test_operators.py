import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.errors import FunctionSyntaxError
from stratum.functions import dimensions as d
from stratum.functions import expressions as x
from stratum.operators import corpus, ledger, scoring, signals, similarity, streams, structure
from stratum.storage import numbered
from stratum.operators.rust_functions import functions

FILES = "corpus string, path string, language string, lang_ord int, content binary, size long"


def files(spark, contents, corpus="c", language="Rust"):
    rows = [(corpus, f"{i:04d}", language, 0, bytes(b), len(b)) for i, b in enumerate(contents)]
    return spark.createDataFrame(rows, FILES)


def xorshift(n, x=0x123456789ABCDEF0):
    out = bytearray()
    for _ in range(n):
        x ^= (x << 13) & (2**64 - 1)
        x ^= x >> 7
        x ^= (x << 17) & (2**64 - 1)
        out.append(x & 255)
    return bytes(out)


def brute_duplicates(contents):
    seen, out = set(), []
    for data in contents:
        covered = set()
        if 0 < len(data) < 64:
            spans = [(0, len(data))]
        else:
            spans = [(a, a + 64) for a in range(len(data) - 63) if sum(data[a : a + 64]) % 64 == 0]
        for a, b in spans:
            if data[a:b] in seen:
                covered.update(range(a, b))
            seen.add(data[a:b])
        out.append(len(covered))
    return out


def test_duplicates_match_brute_force(spark):
    rnd = random.Random(1)
    block = bytes(rnd.randrange(256) for _ in range(200))
    contents = [block, b"short", b"short", block[50:] + b"abc", b"", b"a" * 300, bytes(64), block + block, bytes(rnd.randrange(4) for _ in range(2000))]
    got = {r["path"]: r["bytes"] for r in signals.duplicates(files(spark, contents), ["corpus"], F.col("path")).collect()}
    assert [got.get(f"{i:04d}", 0) for i in range(len(contents))] == brute_duplicates(contents)


def test_sampling_equals_the_rolling_hash():
    data = xorshift(3000)
    want = []
    for a in range(len(data) - 63):
        h = 0
        for b in data[a : a + 64]:
            h = (h * 257 + b + 1) % 2**64
        if h & 63 == 0:
            want.append(a)
    assert signals.sampled_windows(data).tolist() == want


@given(st.binary(max_size=200))
@settings(max_examples=150, deadline=None)
def test_random_tokens_match_brute_force(data):
    data = data.translate(bytes(b"aB3+ /_=-."[i % 10] for i in range(256)))
    out, at = [], 0
    allowed = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    while at < len(data):
        end = at
        while end < len(data) and data[end] in allowed:
            end += 1
        token = data[at:end]
        kinds = any(97 <= c <= 122 for c in token) + any(65 <= c <= 90 for c in token) + any(48 <= c <= 57 for c in token)
        if len(token) >= 24 and kinds >= 2 and signals.bits_per_byte(np.bincount(np.frombuffer(token, np.uint8), minlength=256)) >= 3.5:
            out.append((at, end))
        at = end + 1
    assert signals.random_tokens(data) == out


def test_entropy_windows_at_the_edges():
    noise = xorshift(4096 + 300)
    assert signals.entropy_windows(noise[:255]) == [] and signals.entropy_windows(b"a" * 5000) == []
    assert signals.entropy_windows(noise[:4096]) == [(0, 4096)] == signals.entropy_windows(noise[: 4096 + 255])


def test_noise_of_random_bytes_and_union(spark):
    row = signals.noise(files(spark, [xorshift(16384), b"fn a() {}\n" * 50, b"// DO NOT EDIT\n" + b"x" * 10]), ["corpus"]).first()
    assert row["high_entropy_bytes"] == 16384 and row["generated_marker_bytes"] == 25 and row["flagged_bytes"] >= 16409
    alone = signals.noise(files(spark, [xorshift(16384)]), ["corpus"]).first()
    assert alone["noise_ratio"] > 0.90 and alone["flagged_bytes"] == 16384


def test_paths_of_numbers_keep_their_order(spark):
    ids = [-(1 << 63), -5, -1, 0, 7, 1234567890123, 1234567890124, (1 << 63) - 1, None]
    rows = spark.createDataFrame([(i, "t", "en", "s") for i in ids], "doc_id long, text string, lang string, source string")
    paths = [r["path"] for r in corpus.documents(rows).collect()]
    assert len(set(paths)) == len(ids) and paths == sorted(paths, key=str.encode)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_plans_read_contents_once_and_where_they_are(spark):
    rows = spark.createDataFrame([("c", f"p{i}", "Rust", 0, bytearray(b"fn x() {}\n" * 90), 900) for i in range(9)], "corpus string, path string, language string, lang_ord int, content binary, size long")
    assert shuffles(ledger.by_file(rows)) == 0
    noise = signals.noise(rows, ["corpus"])
    assert noise._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and shuffles(noise) == 1
    got, want = ledger.by_file(rows).first(), streams.stream_metric(rows.where("path = 'p0'"), ["corpus", "path", "language"]).first()
    assert got.asDict() == want.asDict()


def test_rows_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, f"x{i % 3}") for i in range(1000)], "a long, b string").repartition(7)
    got = {(r["a"], r["b"]): r["i"] for r in numbered(rows, ["b", "a"], "i", 1).collect()}
    assert [got[k] for k in sorted(got, key=lambda k: (k[1], k[0]))] == list(range(1, 1001))
    assert numbered(rows.where("false"), ["a"], "i").collect() == []


def test_union_length(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 3, 4), ("a", 10, 12), ("a", 11, 15), ("b", 0, 1)], "k string, begin long, end long")
    assert {r["k"]: r["bytes"] for r in signals.union_length(rows, ["k"]).collect()} == {"a": 12, "b": 1}


def test_two_copies_of_a_block(spark):
    block = b"// repeated line of a template with some more text to reach this length\n" * 128
    row = signals.duplication(files(spark, [block, block]), ["corpus"]).first()
    assert row["duplicate_ratio"] > 0.30


def test_minified_and_markers(spark):
    rows = files(spark, [b"a" * 1024, b"a" * 1023, b"\n".join([b"a" * 1000] + [b""] * 9), b"x\n" * 2000, b" " * 8190 + b"@generated", b" " * 8100 + b"@GENERATED"])
    got = rows.select("path", x.minified(F.col("content")).alias("m"), x.generated_marker(F.col("content")).alias("g")).orderBy("path").collect()
    assert [r["m"] for r in got][:4] == [True, False, False, False] and [r["g"] for r in got][4:] == [False, True]


def brute_structure(sizes):
    up = sorted(sizes)
    n, total = len(up), sum(up)
    held = k = 0
    for s in reversed(up):
        held, k = held + s, k + 1
        if held >= total * 0.8:
            break
    gini = max(0.0, 2 * sum((i + 1) * s for i, s in enumerate(up)) / (n * total) - (n + 1) / n)
    return up[(n - 1) // 2], up[-(-95 * n // 100) - 1], up[-1] / total, sum(up[-10:]) / total, gini, n >= 5 and 2 * k >= n


@pytest.mark.parametrize("sizes", [[1], [5, 5, 5, 5, 5], [0, 0, 7], list(range(40)), [3] * 30 + [1000], [1, 2, 2, 2, 9, 9, 100]])
def test_structure(spark, sizes):
    rows = spark.createDataFrame([("c", s) for s in sizes], "corpus string, size long")
    r = structure.structure(rows, "corpus").first()
    got = (r["median_file_bytes"], r["p95_file_bytes"], r["largest_file_share"], r["top_10_file_share"], r["gini"], r["long_tail"])
    assert got == pytest.approx(brute_structure(sizes))


def test_streams_are_ordered_and_independent_of_partitions(spark):
    import hashlib

    rows = files(spark, [b"first", b"second", b""])
    want = hashlib.sha256(b"firstsecond").hexdigest()
    for n in (1, 3):
        r = streams.stream_metric(rows.repartition(n).orderBy(F.desc("path")), ["corpus"]).first()
        assert (r["file_count"], r["original_bytes"], r["sha256"]) == (3, 11, want)
    both = rows.withColumn("language", F.when(F.col("path") == "0000", "A").otherwise("B"))
    parts = streams.stream_metric(both, ["corpus", "language"]).agg(F.sum("compressed_bytes")).first()[0]
    assert parts != streams.stream_metric(rows, ["corpus"]).first()["compressed_bytes"]


def test_empty_stream_has_no_ratio(spark):
    r = streams.stream_metric(files(spark, [b""]), ["corpus"]).first()
    assert (r["original_bytes"], r["compressed_bytes"], r["ratio"], r["savings"]) == (0, d.EMPTY_FRAME, None, None)


def test_compression_profile(spark):
    r = streams.compression_profile(files(spark, [b"a line of thirty-nine bytes in the file\n" * 128]), ["corpus"]).first()
    assert [a["algorithm"] for a in r["algorithms"]] == ["gzip", "zstd", "brotli", "xz"]
    assert [c["level"] for c in r["zstd_curve"]] == [1, 3, 9, 19, 22] and all(0 < c["ratio"] < 0.1 for c in r["zstd_curve"])
    ratios = sorted(a["ratio"] for a in r["algorithms"])
    assert r["consensus_ratio"] == (ratios[1] + ratios[2]) / 2 and r["ratio_spread"] == ratios[3] - ratios[0]


def test_streams_are_placed_by_cost_and_encoders_side_by_side(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [bytes(rnd.choices(b"abcdef \n", k=rnd.randrange(1, 900))) for _ in range(60)]
    rows = [(None if i % 7 == 0 else f"c{i % 7}", f"{i:04d}", "Rust", i % 2, x * (20 if i % 7 == 3 else 1), len(x)) for i, x in enumerate(texts)]
    table = spark.createDataFrame([(*r[:4], bytearray(r[4]), r[5]) for r in rows], FILES)
    names = ["gzip", "brotli", "xz", *(f"zstd-{n}" for n in streams.LEVELS)]
    sides = streams.lanes(names)
    assert sorted(sum(sides, [])) == sorted(names) and sides[0] == ["brotli"] and len(sides) == 3
    want = {}
    for key in {r[0] for r in rows}:
        data = b"".join(r[4] for r in rows if r[0] == key)
        want[key] = (sum(r[0] == key for r in rows), len(data), {n: streams.compressed_size(data, n) for n in names})
    for most in (streams.PLACED, 2):  # with 2, the other streams are dealt by hash
        monkeypatch.setattr(streams, "PLACED", most)
        got = streams.stream_sizes(table.orderBy(F.desc("path")), ["corpus"], ["path"], names).collect()
        assert {r["corpus"]: (r["file_count"], r["original_bytes"], r["sizes"]) for r in got} == want and len(got) == 7
        at = streams._dealt(table, ["corpus"], ["path"], [3.7, 3.6, 1.3]).select("corpus", "_lane", F.spark_partition_id().alias("t")).distinct().collect()
        assert len(at) == 21  # a stream and a lane are in one task
        first = {r["_lane"]: r["t"] for r in at if r["corpus"] == "c3"}
        assert sorted(first) == [0, 1, 2] and len(set(first.values())) == 3 and first[0] == 0  # its lanes apart, and the dearest first


def test_corpora_and_languages_are_dealt_together(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for i in range(40):
        text = bytes(rnd.choices(b"abcdef \n", k=rnd.randrange(1, 400) * (20 if i % 4 == 0 else 1)))
        rows.append((f"c{i % 4}", f"{i:04d}", "AB"[i % 8 // 4], i % 8 // 4, bytearray(text), len(text)))
    table = spark.createDataFrame(rows, FILES)
    for most in (streams.PLACED, 2):  # with 2, the other streams are dealt by hash
        monkeypatch.setattr(streams, "PLACED", most)
        for profile in (True, False):
            whole, languages = streams.whole_and_languages(table, profile)
            alone = streams.compression_profile(table, ["corpus"]) if profile else streams.stream_metric(table, ["corpus"])
            by = streams.stream_metric(table, ["corpus", "lang_ord", "language"])
            assert whole.columns == alone.columns and sorted(whole.collect()) == sorted(alone.collect())
            assert languages.columns == by.columns and sorted(languages.collect()) == sorted(by.collect()) and languages.count() == 8
    monkeypatch.undo()
    kinds = table.withColumn("kind", F.explode(F.array(F.lit("corpus"), F.lit("language"))))
    at = streams._dealt(kinds, ["kind", "corpus"], ["path"], [3.7, 3.6, 1.5], {"corpus": (0, 2), "language": (2, 3)})
    found = at.select("kind", "corpus", "_lane", F.spark_partition_id().alias("t")).distinct().collect()
    assert {(r["kind"], r["_lane"]) for r in found} == {("corpus", 0), ("corpus", 1), ("language", 2)} and len(found) == 12
    assert next(r["t"] for r in found if (r["corpus"], r["_lane"]) == ("c0", 0)) == 0  # the dearest of all kinds begins first


def test_placing_evens_tasks():
    at, tasks = streams.places([100, 10, 10, 10, 0], [2.0, 1.0], 4)
    load = [0.0] * tasks
    for size, own in zip([100, 10, 10, 10, 0], at):
        for cost, t in zip([2.0, 1.0], own):
            load[t] += size * cost
    assert tasks == 4 and load == sorted(load, reverse=True) and load[:2] == [200, 100] and load[2] - load[3] <= 20
    assert streams.places([], [1.0], 8) == ([], 1)


def test_flush_costs_three_bytes_at_other_levels():
    import zstandard

    data = b"some text " * 1000
    plain = zstandard.ZstdCompressor(level=3).compressobj()
    assert streams.compressed_size(data, "zstd-3") == len(plain.compress(data)) + len(plain.flush()) + 3


def test_small_streams_share_their_tables(monkeypatch):
    import zstandard

    rnd = random.Random(5)
    words = [bytes(rnd.randrange(97, 123) for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    texts = [b" ".join(rnd.choices(words, k=k)) for k in (300, 0, 1, 20, 40000, 2, 5000, 300, 12)]
    texts += [texts[0], bytes(1 << 18), texts[4][1000:]]
    want = [{n: streams.encoder(n) for n in ("zstd-1", "zstd-19")} for _ in texts]
    for data, own in zip(texts, want):
        for e in own.values():
            e.update(data)
    want = [[e.size() for e in own.values()] for own in want]
    made, new = [], zstandard.ZstdCompressor
    monkeypatch.setattr(zstandard, "ZstdCompressor", lambda **k: made.append(k) or new(**k))
    monkeypatch.setattr(streams, "_thread", type("", (), {})())
    assert [[streams.compressed_size(x, n) for n in ("zstd-1", "zstd-19")] for x in texts] == want
    assert len(made) == 2  # a compressor for each level, not for each file


def test_counts_skip_unknown(spark):
    rows = files(spark, [b"a", b"bb"]).unionByName(files(spark, [b""]).withColumn("language", F.lit(None).cast("string")))
    assert ledger.skipped(rows).first()["skipped_file_count"] == 1
    assert {r["level"]: r["original_bytes"] for r in ledger.counts(rows).collect()} == {0: 3, 1: 3, 3: 3}


def test_baseline_percentile(spark):
    rows = spark.createDataFrame([("c", "Python", 100, d.BASELINES["Python"][1]), ("c", "Go", 100, 0.1), ("c", "Zig", 1, 0.1)], "corpus string, language string, original_bytes long, ratio double")
    got = {r["language"]: r for r in scoring.baselines(rows).collect()}
    assert got["Python"]["percentile"] == 50.0 and got["Python"]["median_ratio"] == d.BASELINES["Python"][1]
    assert got["Go"]["percentile"] is None and "Zig" not in got


def test_high_confidence_cannot_be_reached_with_these_samples():
    assert max(map(len, d.BASELINES.values())) == 3 and sum(map(len, d.BASELINES.values())) == 28 and len(d.BASELINES) == 19


def test_gain_and_relation(spark):
    same = b"fn line() -> u32 { 1 }\n" * 512
    a = similarity.relate(files(spark, [same, same]), "0000", "0001").first()
    b = similarity.relate(files(spark, [same, same]), "0001", "0000").first()
    assert a == b and a["adjusted_gain"] == a["raw_gain"] - 9 > 0


def test_candidates(spark):
    schema = "idx int, kind string, symbol string, content binary"
    one, two = b"A" * 64 + b"x" * 20, b"B" * 30
    first = spark.createDataFrame([(0, "function", "same", two), (1, "function", "a", one)], schema)
    second = spark.createDataFrame([(0, "function", "same", b"C" * 40), (1, "method", "b", one[:64] + b"other")], schema)
    found, cut = similarity.similarities(first, second)
    assert sorted((r["i"], r["j"]) for r in found.collect()) == [(0, 0), (1, 1)] and not cut
    assert all(r["high_variance"] for r in found.collect())
    few, cut = similarity.candidates(first, second, limit=1)
    assert [(r["i"], r["j"]) for r in few.collect()] == [(0, 0)] and cut


RUST = b"""//! inner
/// Documented.
#[inline]
pub fn outer<'a>(x: &'a str) -> usize {
    let f = |y: u32| y + 1;
    items.iter().filter(|&&z| z > 1 || z < 0).map(move |q| { q });
    println!("{}", |hidden| 1);
    fn nested() {}
    f(1)
}
trait T { fn declared(&self); fn defaulted(&self) -> char { '}' } }
impl<X: Clone> S<X> { pub(crate) const unsafe fn method(&self) { r#"fn no() {"#; } }
extern "C" { fn foreign(); }
macro_rules! m { () => { fn hidden() {} } }
/* fn c() { /* nested */ } */
async fn last(f: fn(u8) -> u8) {}
"""


def test_rust_functions():
    got = functions(RUST)
    assert [(k, s.split("-")[0] + ("-" + s.split("-")[1] if k == "closure" else "")) for k, s, *_ in got] == [
        ("function", "outer"), ("closure", "closure-1"), ("closure", "closure-2"), ("closure", "closure-3"), ("function", "nested"),
        ("trait_method", "declared"), ("trait_method", "defaulted"), ("method", "method"), ("function", "last"),
    ]
    outer = got[0]
    assert outer[2:4] == (2, 10) and outer[4].startswith(b"/// Documented.") and outer[4].endswith(b"}")
    assert got[1][4] == b"|y: u32| y + 1" and got[2][4] == b"|&&z| z > 1 || z < 0" and got[3][4] == b"move |q| { q }"


@pytest.mark.parametrize("source", [b"fn a() {", b"fn a() }", b'fn a() { "x }', b"\xff", b"/* x", b"fn a()"])
def test_unreadable_rust(source):
    with pytest.raises(FunctionSyntaxError):
        functions(source)


def closures(source):
    return [c[4].decode() for c in functions(source.encode()) if c[0] == "closure"]


def test_bars_of_patterns_are_no_closures():
    assert closures("fn f(x: T) { match x { | A => |y| y, | B | C if p(|z| z) => { g(|w| w) } | D => match x { | E => 1, _ => 2 } | F => 3, } }") == ["|y| y", "|z| z", "|w| w"]
    assert closures("fn f() { let a = match x.iter().map(|v| v) { Some(| 1 | 2) => if c { 1 } else { h(|k| k) } None => |q| q, }; }") == ["|v| v", "|k| k", "|q| q"]
    assert closures("fn f() { a.map(|x| x | 1).all(|&(a, b)| a || b) }") == ["|x| x | 1", "|&(a, b)| a || b"]


@pytest.mark.parametrize(
    "bad",
    ["struct S { a: }", "fn f() { foo(1 2 3) }", "fn f() { let x = ; }", 'fn f() { "a" "b" }', "fn f() { match x { A } }", "fn f() { match x { => 1 } }", "fn f()", "fn f() { 1 x }", "fn f() { a. }", "fn f() { a = }"],
)
def test_source_that_does_not_parse_is_an_error(bad):
    with pytest.raises(FunctionSyntaxError):
        functions(bad.encode())


def test_source_that_parses_is_read():
    source = """
    //! inner
    extern "C" { fn c(x: i32) -> i32; }
    pub extern "C" fn e(x: u8) -> u8 { x as u8 }
    /// doc
    struct S<T: Clone> where T:, { a: u8, b: [u8; 4] }
    enum E { A = 1, B, C { x: u8 }, D(u8, u16) }
    impl<T: Clone> S<T> { fn m<'a>(&'a self) -> impl Fn(u8) -> u8 + 'a { move |x| x + 1 } }
    trait Q { const N: usize = 5; type T; fn d(&self) {} fn r(&self); }
    fn g() -> Result<(), ()> { let Some(x) = y() else { return Err(()) }; for i in 0..5 { if i > 3 { break } } let t = (1, 2.5, "s", 'c', b"x", r#"raw"#);
      let _ = match t.0 { 0 => "zero", 1 | 2 => "few", 3..=9 if x => "some", n @ 10.. => { "n" } _ => unsafe { z() }, /* end */ };
      let v = vec![1 2 3]; let r = ..; let s = &a[1..]; let c: fn(u8) -> u8 = |x| -> u8 { x }; loop {} }
    """
    names = [(k, n.split("-")[0]) for k, n, *_ in functions(source.encode())]
    assert names == [("function", "e"), ("method", "m"), ("closure", "closure"), ("trait_method", "d"), ("trait_method", "r"), ("function", "g"), ("closure", "closure")]
