"""Each operator on small tables against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.llm import common, embeddings, jaccard_join, licenses, media, mixing, packing, quality, sharding, tokens, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, sid long, part int, n long, label string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def documents(spark, texts, first=0):
    rows = [(first + i, t, None if i % 7 == 3 else "en", None if i % 5 == 4 else f"s{i % 3}", None, 0.5, 1, 2, 3, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    out = [None, "", " ", "\n\n", "a", "one two three", "Ünïcode  double  spaces　wide", "x" * 5000, "<|endoftext|> inside <|endoftext|>", "tail \n", "don't can't I'll"]
    out += [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 300))) + rnd.choice(["", ".", "\n"]) for _ in range(40)]
    out += [out[20], out[20], out[21] + " more", "long " * 30000]
    return out


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# Token counts ------------------------------------------------------------------


def test_counts(spark, texts, tokenizer):
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, BPE).collect()}
    for i, t in enumerate(texts):
        n = len(ids_of(tokenizer, t))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024)


def test_counts_of_nothing(spark):
    assert tokens.count_tokens(documents(spark, ["x"]).where("false"), BPE).collect() == []


@given(st.lists(st.text(alphabet="ab \n\t.,'é　\x1c|1_", max_size=80), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_units_give_the_tokenizers_ids(tokenizer, some):
    got = tokens.worker(BPE, False).of_many(some)
    assert [x.tolist() for x in got] == [ids_of(tokenizer, t) for t in some]


def test_units_after_compaction_and_in_slices(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "CACHED", 20)
    monkeypatch.setattr(tokens, "SLICE", 50)
    monkeypatch.setattr(tokens, "GROUP", 60)
    rnd = random.Random(2)
    some = [" ".join("".join(rnd.choice("abcdé.") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 40))) for _ in range(200)]
    for counts in (False, True):
        got = tokens.Units(BPE, counts).of_many(some)
        want = [ids_of(tokenizer, t) for t in some]
        assert got == [len(x) for x in want] if counts else [x.tolist() for x in got] == want


def thue_morse(n):
    """Two words of n letters whose polynomial hashes modulo 2^64 agree, whatever the odd base, from some length on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_units_with_one_hash_are_told_apart(tokenizer, n):
    a, b = thue_morse(n)
    some = [a, b, f"see {a}", f"see {b} {a}  {b}", f"{a} x {b} y {a}"]
    for counts in (False, True):
        units = tokens.Units(BPE, counts)
        for texts in (some, some[::-1], [x for x in some for _ in range(2)]):
            want = [ids_of(tokenizer, t) for t in texts]
            got = units.of_many(texts)
            assert (got == [len(x) for x in want]) if counts else ([x.tolist() for x in got] == want)


def test_counts_of_colliding_units_long_texts_and_repeated_rows(spark, tokenizer):
    a, b = thue_morse(2048)
    rnd = random.Random(3)
    long = " ".join(rnd.choice(WORDS) + rnd.choice(["", "é", " ", "\n"]) for _ in range(150_000))
    assert len(long) > 2 * tokens.SLICE
    some = [a, b, f"see {a}", f"see {b}", long, long, "x" * 300_000]
    docs = documents(spark, some)
    got = tokens.count_tokens(docs.unionByName(docs), BPE).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len(ids_of(tokenizer, t))) for i, t in enumerate(some) for _ in range(2))
    pieces = packing.pack(docs, BPE, keep_ids=True).toPandas()
    for i, t in enumerate(some):
        mine = pieces[pieces.doc_id == i].sort_values("piece")
        assert b"".join(map(bytes, mine.ids)) == np.asarray([*ids_of(tokenizer, t), 0], "<u4").tobytes()


# Packing -------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [7, 30, 64])
def test_plans_are_exact_and_near_the_bound(capacity):
    rnd = random.Random(capacity)
    for _ in range(60):
        counts = {k: rnd.choice([0, 1, 1, 2, 40]) for k in range(1, capacity + 1)}
        runs, bins = packing.plan_runs(counts, capacity)
        seen, held = {}, {}
        for length, rank, n, first, per, offset in runs:
            assert rank == seen.get(length, 0)
            seen[length] = rank + n
            for i in range(n):
                held.setdefault(first + i // per, []).append((offset + i % per * length, length))
        assert seen == {k: n for k, n in counts.items() if n} and len(held) == bins
        for some in held.values():
            at = 0
            for offset, length in sorted(some):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * k > capacity for _, k in some) <= 2
        low = max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
        assert low <= bins <= 1.25 * low + 2
    assert packing.plan_runs({}, capacity) == ([], 0)


def test_packing(spark, texts, tokenizer):
    got = packing.pack(documents(spark, texts), BPE, keep_ids=True).toPandas()
    assert set(got.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    for i, t in enumerate(texts):
        ids = np.asarray([*ids_of(tokenizer, t), 0], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and mine.length.sum() == len(ids)
        assert all(mine.length[1:] == 2048) and (len(mine) == 1 or len(ids) > 2048)
        for r in mine.itertuples():
            part = ids[r.start : r.start + r.length].tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and bytes(r.ids) == part
    for _, some in got.sort_values("offset").groupby("sequence_id"):
        assert some.offset.tolist() == [0, *some.length.cumsum().tolist()[:-1]] and some.length.sum() <= 2048
    assert packing.pack(documents(spark, ["x"]).where("false"), BPE).collect() == []


# Jaccard join ----------------------------------------------------------------------


def sets_of(text):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(texts):
    sets = [sets_of(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [len(s) for s in sets], label


def near_texts(seed, groups=6, size=14):
    rnd = random.Random(seed)
    shared = " ".join(rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(60))
    out = []
    for g in range(groups):
        base = [rnd.choice(WORDS) + str(rnd.randrange(500)) for _ in range(rnd.choice([6, 40, 120]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            if rnd.random() < 0.2:
                w = w[: int(len(w) * 0.85)]
            out.append(" ".join(w) + (" " + shared if g % 2 else ""))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(spark, texts, seed):
    some = near_texts(seed) + [t for t in texts if t is None or len(t) < 10000]
    n, label = brute_classes(some)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_classes(documents(spark, some)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(some))] == n
    assert [got[i]["component_id"] for i in range(len(some))] == label


def test_classes_of_poor_centres(spark, monkeypatch):
    """Rounds of neighbours and chunks of large classes, with a table of common shingles at work."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    some = near_texts(9, groups=3, size=25)
    some += [f"{t} zz" for t in some]
    _, label = brute_classes(some)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(documents(spark, some)).collect()}
    assert [got[i] for i in range(len(some))] == label


def test_classes_of_colliding_words_long_texts_and_null_keys(spark, monkeypatch):
    a, b = thue_morse(2048)
    rnd = random.Random(6)
    long = [rnd.choice(WORDS) + str(rnd.randrange(3000)) for _ in range(200_000)]
    near = list(long)
    for _ in range(3000):
        near[rnd.randrange(len(near))] = f"new{rnd.randrange(10**6)}"
    some = [" ".join([a] * 6), " ".join([b] * 6), " ".join([a] * 6 + [b]), " ".join(long), " ".join(near), "x" * 3_000_000, "y " * 700_000, "y y y y y", " " * 2_000_000]
    n, label = brute_classes(some)
    assert max(map(len, some)) > jaccard_join.SLICE
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_classes(documents(spark, some)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(some))] == n and [got[i]["component_id"] for i in range(len(some))] == label
    # links that run through a row without a key
    base = [f"w{i}" for i in range(60)]
    one, two, three = " ".join(base), " ".join([*base[:-1], "u"]), " ".join([*base[:-2], "v", "u"])
    docs = spark.createDataFrame([(5, one), (None, two), (7, three), (None, "alone by itself it is here"), (None, None)], "doc_id long, text string")
    found = jaccard_join.jaccard_classes(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in found if r["n_shingles"] > 10) == [(0, 5), (5, 5), (7, 5)]
    assert [r["component_id"] for r in found if r["n_shingles"] < 10] == [None, None]


def test_classes_with_frequent_members_in_parts(spark, monkeypatch):
    """One group that holds most rows, whose members are dealt to several tasks; sets that share their first 64 bits."""
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    some = near_texts(12, groups=1, size=60) + near_texts(3, groups=2, size=8)
    _, label = brute_classes(some)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(documents(spark, some)).collect()}
    assert [got[i] for i in range(len(some))] == label
    rows = spark.createDataFrame([(1, 5, 10, 3), (2, 5, 11, 4), (3, 6, 12, 5), (4, 5, 10, 3), (5, 0, 0, 0)], "doc_id long, sid long, s2 long, n long")
    sids = {r["doc_id"]: r["sid"] for r in jaccard_join._parted(rows).collect()}
    assert sids[1] == sids[4] and len({sids[1], sids[2], sids[3]}) == 3 and sids[3] == 6


def test_repeated_rows_and_empty_tables_have_classes(spark):
    docs = documents(spark, ["a b c d e f g h", "a b c d e f g h"])
    twice = docs.unionByName(docs).unionByName(documents(spark, ["other text of five words here"], 9))
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_classes(twice).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (9, 9)]
    assert jaccard_join.jaccard_classes(docs.where("false")).collect() == []


def test_a_pair_that_may_link_is_never_ruled_out():
    rnd = random.Random(5)
    for _ in range(3000):
        order = list(range(400))
        n = rnd.randint(3, 60)
        x = set(rnd.sample(order, n))
        y = set(rnd.sample(sorted(x), rnd.randint(max(1, int(0.75 * n)), n))) | set(rnd.sample(order, rnd.randint(0, n // 5)))
        both = len(x & y)
        cut = lambda s: {t: i for i, t in enumerate(sorted(s)[: len(s) - -(-80 * len(s) // 100) + 1])}
        if 100 * both >= 80 * (len(x) + len(y) - both):
            assert jaccard_join._may_reach(len(x), cut(x), len(y), cut(y), 80)


def test_components(spark):
    rnd = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(200 + rnd.randrange(50), 200 + rnd.randrange(50)) for _ in range(60)] + [(-5, 7), (900, 901)]
    label = {x: x for e in links if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["component"] for r in common.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label


# Embeddings -------------------------------------------------------------------------


def brute_links(vectors, threshold=0.9):
    good = {i: np.asarray(v, float) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(v)}
    links, label = [0] * len(vectors), list(range(len(vectors)))
    for i, a in good.items():
        for j, b in good.items():
            if j < i and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return links, label


@pytest.mark.parametrize("tile", [8, 16384])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 12))
    rows = [list(map(float, base[i % 8] + rng.normal(size=12) * (0.1 + 0.3 * (i % 4)))) for i in range(90)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] + [0.0] * 11, [], [1.0, 0.0], [1.0, 0.1], [1e-30] * 12, [1.0] * 12]
    links, label = brute_links(rows)
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n_links int, rep int")
    got = {r["vec_id"]: r for r in embeddings.embedding_components(docs, tile=tile).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == links and [got[i]["component_id"] for i in range(len(rows))] == label
    assert [got[i]["kept"] for i in range(len(rows))] == [i == x for i, x in enumerate(label)]
    assert embeddings.embedding_components(docs.where("false")).collect() == []


def test_quantisation_error_holds():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 300, 33)) * 10 ** rng.uniform(-8, 8, (2, 300, 1))
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    (q, s, e, _, q2, s2, e2), (r, t, f, size, r2, t2, f2) = embeddings.quantised(x), embeddings.quantised(y)
    near = (q * s[:, None]) @ (r * t[:, None]).T
    assert (np.abs(near - unit(x) @ unit(y).T) <= f[None, :] + e[:, None] * size[None, :] + 1e-9).all()
    fine = (q * s[:, None] + q2 * s2[:, None]) @ (r * t[:, None] + r2 * t2[:, None]).T
    assert (np.abs(fine - unit(x) @ unit(y).T) <= f2[None, :] + 1.001 * e2[:, None] + embeddings.FINE).all() and e2.max() < e.max() / 50


def test_embeddings_of_extreme_size_repeated_keys_and_open_pairs(spark):
    """Cosines within 10^-13 of the threshold are decided in double precision."""
    at = [[1.0, 0.0], [0.9, float(np.sqrt(1 - 0.81)) + 1e-13], [0.9, float(np.sqrt(1 - 0.81)) - 1e-13]]
    rows = [[1e200, 4.843e199], [1.0, 0.01], [1e-200, 0.0], [-1.0, 0.3], *at, [5e-324, 0.0]]
    small = [[1.0, 0.4843], rows[1], [1.0, 0.0], *rows[3:-1], [1.0, 0.0]]
    links, label = brute_links(small)
    docs = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.embedding_components(docs).collect()}
    assert got[0]["n_links"] >= 1 and got[0]["component_id"] == 0
    assert [got[i]["n_links"] for i in range(len(rows))] == links and [got[i]["component_id"] for i in range(len(rows))] == label
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (2, None), (None, [1.0, 0.05]), (None, None)], "vec_id long, embedding array<double>")
    found = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_components(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (2, 0, 2, True), (None, 2, 1, None), (None, 0, None, None)], key=str)


# Sharding, mixing -----------------------------------------------------------------------


def test_sharding(spark, texts):
    docs = documents(spark, texts)
    got = sharding.extendible_shards(docs, limit=3000).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts)))
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i in range(len(texts))}
    size = {i: len((t or "").encode()) for i, t in enumerate(texts)}
    for r in got.itertuples():
        assert r.shard == bits[r.doc_id][: r.depth] and r.oversize == (size[r.doc_id] > 3000)
        for depth in range(r.depth + 1):
            mates = [i for i in bits if bits[i].startswith(r.shard[:depth])]
            fits = sum(size[i] for i in mates) <= 3000 or len(mates) == 1
            assert fits == (depth == r.depth)


def test_sharding_parts_one_key(spark):
    docs = spark.createDataFrame([(5, "x" * 100)] * 50 + [(None, "y" * 100)] * 3, "doc_id long, text string")
    got = sharding.extendible_shards(docs, limit=450).toPandas()
    assert len(got) == 53 and got.groupby("shard").n_bytes.sum().max() <= 450 and got.shard.str.contains("/").sum() == 50
    assert sharding.extendible_shards(docs.where("false")).collect() == []


def test_written_shards_hold_every_row(spark, texts, tmp_path):
    docs = documents(spark, [*texts, *["same key " * 30] * 20]).withColumn("doc_id", F.expr("if(doc_id >= 50, 50, doc_id)"))
    sharding.write_shards(docs, f"file://{tmp_path}/shards", limit=3000)
    back = spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/shards")
    assert back.columns == docs.columns and docs.exceptAll(back).count() == 0 and back.count() == docs.count()
    sizes = spark.read.schema(docs.schema.add("shard_id", "string")).parquet(f"file://{tmp_path}/shards").groupBy("shard_id").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
    assert sizes.where("b > 3000 AND n > 1").count() == 0 and sizes.count() > 5


def brute_mixture(rows, alpha=0.5, rate=0.5, rounds=30):
    cells = {}
    for key, n in rows:
        cells[key] = cells.get(key, 0) + n
    total, goal = sum(cells.values()), []
    for k in range(3):
        sums = {}
        for c, t in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + t
        whole = sum(t**alpha for t in sums.values() if t)
        goal.append({v: t**alpha / whole * rate * total for v, t in sums.items() if t})
    x = {c: float(t) for c, t in cells.items()}
    for _ in range(rounds):
        for k in range(3):
            sums = {}
            for c, v in x.items():
                sums[c[k]] = sums.get(c[k], 0) + v
            x = {c: v * goal[k].get(c[k], 0) / sums[c[k]] if sums[c[k]] else 0 for c, v in x.items()}
    low, high = 0.0, 1e9
    for _ in range(200):  # the factor with which the whole is met
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(t, mid * x[c]) for c, t in cells.items()) < rate * total else (low, mid)
    return {c: min(1.0, low * x[c] / t) if t else 1.0 for c, t in cells.items()}


@pytest.mark.parametrize("local", [1 << 17, 0])
def test_mixture(spark, texts, local):
    some = [*texts, "All rights reserved.", "see https://x.org now", "a | b | c", "BUY!! NOW!! x"]
    rounds = 30 if local else 3
    got = mixing.mixture(documents(spark, some), local=local, rounds=rounds).toPandas()
    rows = [((r.source, r.lang, r.topic), r.n_tokens) for r in got.itertuples()]
    want = brute_mixture(rows, rounds=rounds)
    for (cell, _), r in zip(rows, got.itertuples()):
        draw = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) / 2**52
        assert r.probability == pytest.approx(want[cell], abs=1e-6) and r.kept == (draw < want[cell] or abs(draw - want[cell]) < 1e-6)
        assert r.n_tokens == -(-len((some[r.doc_id] or "").encode()) // 4)
    assert {"terms", "contact", "tabular", "shouting", "prose"} == set(got.topic)
    assert mixing.mixture(documents(spark, ["x"]).where("false"), local=local, rounds=1).collect() == []


def test_mixture_reaches_given_targets(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i % 3 else "de", f"s{i % 2}", "t") for i in range(3000)], "doc_id long, text string, lang string, source string, topic string")
    got = mixing.mixture(docs, targets={"lang": {"en": 1, "de": 1, "absent": 5}, "source": {"s0": 3, "s1": 1}}, rate=0.3).toPandas()
    kept = got[got.kept]
    report = {}
    again = mixing.mixture(docs.unionByName(docs).withColumn("n", F.lit(5)), targets={"lang": {"en": 1, "de": 1}}, tokens="n", rate=0.3, report=report).toPandas()
    assert report["residual"] <= mixing.CLOSE and report["factor"] == pytest.approx(1) and (again.groupby("doc_id").kept.nunique() == 1).all() and len(again) == 6000
    assert again[again.kept].shape[0] == pytest.approx(1800, rel=0.1)
    assert len(kept) == pytest.approx(900, rel=0.1)
    assert (kept.lang == "de").mean() == pytest.approx(0.5, abs=0.05) and (kept.source == "s0").mean() == pytest.approx(0.75, abs=0.05)


# Licences ---------------------------------------------------------------------------------


def test_licences(spark, texts):
    notices = [(family, x) for family, some in licenses.NOTICES.items() for x in some]
    prose = "Some words of prose before it. "
    some = [*texts, *(x for _, x in notices), *(prose + x.upper() + " And after." for _, x in notices), *licenses.OTHERS, "word " * 400 + "Released under the MIT License."]
    got = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, some)).collect()}
    n, k = len(texts), len(notices)
    assert all(got[i]["families"] == [] for i in range(n)) and all(got[i]["families"] == [] for i in range(n + 2 * k, n + 2 * k + len(licenses.OTHERS)))
    hits = sum(notices[i % k][0] in got[n + i]["families"] for i in range(2 * k))
    assert hits >= 0.93 * 2 * k and got[len(some) - 1]["families"] == ["MIT"]
    assert licenses.license_scan(documents(spark, ["x"]).where("false")).collect() == []


def test_a_paragraph_names_every_licence(spark):
    prose = " ".join(["some words of prose"] * 10)
    cases = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "SPDX-License-Identifier: MIT OR Apache-2.0 OR GPL-3.0-or-later": ["Apache-2.0", "GPL", "MIT"],
        "Dual-licensed under the MIT License and the Apache License, Version 2.0": ["Apache-2.0", "MIT"],
        f"Released under the ISC License. {prose} Licensed under CC BY-SA 4.0. {prose} All rights reserved.": ["CC-BY-SA", "ISC", "all rights reserved"],
        "Licensed under the GNU General Public License, version 3. Licensed under the GNU Lesser General Public License, version 2.1.": ["GPL", "LGPL"],
        "SPDX-License-Identifier: Apache-2.0 OR MIT": ["Apache-2.0", "MIT"],
        # look-alikes of one notice
        "Licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC"],
        "SPDX-License-Identifier: AGPL-3.0-only": ["AGPL"],
    }
    got = {r["doc_id"]: r for r in licenses.license_scan(documents(spark, cases)).collect()}
    assert [got[i]["families"] for i in range(len(cases))] == list(cases.values())
    assert all(r["n_paragraphs"] == 1 and r["confirmed"] for r in got.values())


#: Notices in other words than those that are taught, with their families.
UNSEEN = {
    "The source code of this library is released under the MIT license, see the file LICENSE.": ["MIT"],
    "This software may be used under the Apache License, Version 2.0 (the license).": ["Apache-2.0"],
    "Distributed under the GNU General Public License version 2 or later.": ["GPL"],
    "You may copy it under the terms of the GNU Lesser General Public License.": ["LGPL"],
    "Code in this folder is covered by the 3-Clause BSD License.": ["BSD"],
    "This file is subject to the Mozilla Public License, v. 2.0.": ["MPL-2.0"],
    "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License.": ["CC-BY-SA"],
    "Copyright 2021 by the editors. All rights reserved.": ["all rights reserved"],
    "The licence plates of both cars were stolen in the general area of the library.": [],
    "All members of the public have the right to a copy of the report.": [],
    "He paid for the license to sell software in the state, and so did she.": [],
    "The foundation published the second version of its public report.": [],
}


def test_unseen_notices(spark):
    got = {r["doc_id"]: r["families"] for r in licenses.license_scan(documents(spark, UNSEEN)).collect()}
    right = [got[i] == want for i, want in enumerate(UNSEEN.values())]
    assert sum(right) >= 10 and all(right[-4:]), [(x, got[i]) for i, x in enumerate(UNSEEN) if not right[i]]


def test_licences_in_wrapped_lines_underscores_and_repeated_rows(spark):
    wrapped = "Intro line.\nThis work is licensed\nunder the GNU General\nPublic License, version 3.\n\nOther words.\r\n\r\nReleased under\r\nthe ISC License."
    some = [wrapped, "__Released_under_the_MIT_License__", "x\n\n" * 50_000 + "Released under the MIT License.\n\n" + "word " * 50_000]
    docs = documents(spark, some)
    docs = docs.unionByName(docs).unionByName(documents(spark, ["Released under the ISC License.", None], 0)).unionByName(docs.select(*docs.columns).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((str(r["doc_id"]), ",".join(r["families"]), r["n_paragraphs"]) for r in licenses.license_scan(docs).collect())
    three = [("GPL,ISC", 2), ("MIT", 1), ("MIT", 1)]
    want = [*((str(i), *x) for i, x in enumerate(three) for _ in range(2)), ("0", "ISC", 1), ("1", "", 0), *(("None", *x) for x in three)]
    assert got == sorted(want)


# Media --------------------------------------------------------------------------------------


def test_media_round_trip(spark, texts):
    got = {r["doc_id"]: r for r in media.decode_media(media.encode_media(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["width"] * r["height"] == len(payload) and len(r["feature_bits"]) == 8
    assert got[0]["media_sha256"] == got[1]["media_sha256"]


@given(st.binary(min_size=1, max_size=600), st.lists(st.integers(0, 4), min_size=10, max_size=10))
@settings(max_examples=80, deadline=None)
def test_all_filters_are_undone(data, kinds):
    data = (data * 64)[: len(data) // 8 * 8 or 8]
    rows = np.frombuffer((data + bytes(8))[: max(8, len(data) // 8 * 8)], np.uint8).reshape(-1, 8).astype(int)
    out, above = [], np.zeros(8, int)
    for i, row in enumerate(rows):
        kind, left, corner = kinds[i % 10], np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        near = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(near.argmin(0), [left, above, corner])
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        out.append(np.concatenate([[kind], (row - guess) % 256]))
        above = row
    assert (media.unfilter(np.array(out, np.uint8)) == rows).all()


def test_damaged_images():
    good = media.write_png(b"ab" * 64)
    assert media.read_png(good).tobytes() == b"ab" * 64
    for at in (0, 20, 40, len(good) - 20):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(media.DamagedImage):
            media.read_png(bytes(bad))
    with pytest.raises(media.DamagedImage):
        media.read_png(good[:-5])
    short = media.SIGNATURE + media._chunk(b"IHDR", b"abc") + media._chunk(b"IEND", b"")
    with pytest.raises(media.DamagedImage):
        media.read_png(short)


def test_media_of_nothing_repeats_and_damage(spark):
    docs = documents(spark, ["a", "a", None])
    assert media.decode_media(media.encode_media(docs.where("false"))).collect() == []
    got = media.decode_media(media.encode_media(docs.unionByName(docs))).collect()
    assert len(got) == 6 and len({r["media_sha256"] for r in got if r["doc_id"] < 2}) == 1
    bad = spark.createDataFrame([(1, 5, b"no image"), (2, 5, None)], "doc_id long, n_bytes long, media binary")
    assert [r["payload_sha256"] for r in media.decode_media(bad, strict=False).collect()] == [None, None]


def test_cosine_hash_by_definition():
    """64 bits of the lowest frequencies of 32 x 32 means, by sums over the definition."""
    rng = np.random.default_rng(2)
    for height in (20, 70):
        samples = rng.integers(0, 256, (height, 64)).astype(np.uint8)
        rows = [[samples[i * height // 32 : (i + 1) * height // 32] if height >= 32 else samples[i * height // 32 :][:1]] for i in range(32)]
        grid = [[float(np.mean([r[0][:, 2 * j : 2 * j + 2].mean(0) if height < 32 else r[0][:, 2 * j : 2 * j + 2]])) for j in range(32)] for r in rows]
        k = np.arange(32)
        low = [[sum(grid[y][x] * np.cos(np.pi * (y + 0.5) * u / 32) * np.cos(np.pi * (x + 0.5) * v / 32) for y in k for x in k) for v in range(8)] for u in range(8)]
        low = np.rint(np.array(low) * 1e6).ravel()
        bits = np.unpackbits(np.frombuffer(media.cosine_hash(samples), np.uint8))
        sure = np.abs(low - np.median(low)) > 10
        assert sure.sum() > 40 and (bits[sure] == (low > np.median(low))[sure]).all()


def test_quality_of_long_and_repeated_texts(spark):
    docs, labels = labelled(spark, n=150)
    more = documents(spark, [" ".join(WORDS * 30_000), "tie", "tie"], 5000)
    got = quality.quality_scores(docs.unionByName(docs).unionByName(more), labels.unionByName(labels)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(got) == 2 * 154 + 3 and all(len(x) == 1 for x in by_id.values()) and by_id[5001] == by_id[5002]


# Classifiers -----------------------------------------------------------------------------------


def labelled(spark, seed=1, n=600):
    """Documents of which a fifth are noisy and another fifth hold words of a toxic kind."""
    rnd = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = [rnd.choice(WORDS) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randint(40, 200))]
        bad, toxic = i % 5 == 0, i % 5 == 1
        if toxic:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["venomous", "hateful", "stemming" + rnd.choice(WORDS)])
        t = " ".join(x.upper() + "!!" if bad else x for x in w)
        texts.append(t)
        labels.append((i, None if i % 50 == 7 else int(not bad), None if i % 50 == 7 else int(toxic)))
    labels += [labels[3], (10**6, 1, 1), (None, 1, 0)]
    return documents(spark, [*texts, None, "", "?", texts[0]]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(600))
    assert np.mean([got[i]["predicted"] == (i % 5 != 0) for i in held]) > 0.97 and got[0]["score"] == got[603]["score"]


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == (i % 5 == 1) for i in held]) > 0.97
    listed = model.weights.listed
    assert min(listed["venomous"][1], listed["hateful"][1]) > 1 and any(x.endswith("-") and x.startswith("stem") and w > 1 for x, (_, w) in listed.items())
    some = next(r for i, r in got.items() if i % 5 == 1 and i < 600 and r["passages"])
    span = docs.where(F.col("doc_id") == some["doc_id"]).first()["text"][some["passages"][0]["begin"] : some["passages"][0]["end"]]
    assert any(w in span for w in ("venomous", "hateful", "stemming"))
    assert got[600]["score"] == got[601]["score"] < 0.3


def test_a_bound_on_taught_rows_keeps_the_shares_of_classes(spark):
    """A word of which one text in ten is toxic: the score is that share, whatever part of each class is taught."""
    rnd = random.Random(8)
    toxic = [i % 10 == 0 and i % 20 != 10 or i % 100 == 10 for i in range(2000)]
    words = [[rnd.choice(WORDS) for _ in range(30)] + ["venomous" if i % 20 == 0 else "murky" if i % 10 in (0, 5) or i % 4 == 1 else "plain"] for i in range(2000)]
    docs = documents(spark, [" ".join(w) for w in words])
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    for taught in (5000, 80, 40):
        got = {r["doc_id"]: r for r in toxicity.toxicity(docs, toxicity.fit_toxicity(docs, labels, taught=taught)).collect()}
        murky = [i for i in range(2000) if words[i][-1] == "murky"]
        assert abs(np.mean([r["score"] for r in got.values()]) - np.mean(toxic)) < 0.04
        assert np.mean([got[i]["predicted"] for i in murky]) < 0.05 and got[0]["predicted"] == 1


@pytest.mark.parametrize("labels", ["false", "toxic = 0 AND quality = 1"])
def test_classifiers_without_both_classes(spark, labels):
    docs, held = labelled(spark, n=60)
    held = held.where(labels)
    assert quality.quality_scores(docs, held).count() == 64
    assert toxicity.toxicity(docs, toxicity.fit_toxicity(docs, held)).count() == 64
    assert quality.quality_scores(docs.where("false"), held).collect() == []


@given(st.lists(st.one_of(st.just(-1.0), st.integers(-300, 600).map(lambda x: x / 100)), max_size=30))
@settings(max_examples=150, deadline=None)
def test_maximal_segments(values):
    """By definition: segments of positive score that no other such segment with all its prefixes and suffixes positive extends."""
    got = toxicity.maximal_segments(np.array(values, float))

    def split(lo, hi):
        best = max(((sum(values[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return [*split(lo, a), (a, b - 1), *split(b, hi)]

    total = lambda some: sorted(round(sum(values[a : b + 1]), 6) for a, b in some)
    assert sorted(round(s, 6) for _, _, s in got) == pytest.approx(total(split(0, len(values))), abs=1e-5)


def test_pool_adjacent():
    assert common.pool_adjacent(np.ones(5), np.array([1.0, 3, 2, 2, 5])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])


def test_log_odds_are_signed_and_shrunk():
    z, w = toxicity.log_odds(np.array([50.0, 5, 5, 0]), np.array([5.0, 50, 5, 50]), 1000, 1000, (1.0, 1.0))
    assert w[0] > 0.5 and w[1] < -0.5 and abs(w[2]) < 1e-9 and w[3] < w[1] and np.sign(z).tolist() == np.sign(w).tolist()
    # by definition: both classes' log-odds with the pooled frequency times the smaller class as prior counts
    alpha = 1000 * 55 / 2000
    one = np.log((50 + alpha) / (2000 - 50 - alpha)) - np.log((5 + alpha) / (2000 - 5 - alpha))
    score = one / np.sqrt(1 / (50 + alpha) + 1 / (5 + alpha))
    assert z[0] == pytest.approx(score) and w[0] == pytest.approx(one * score**4 / (score**4 + toxicity.Z**4))


def test_toxicity_of_long_repeated_and_tied_texts(spark):
    docs, labels = labelled(spark, n=200)
    model = toxicity.fit_toxicity(docs.unionByName(docs), labels)
    prose = " ".join(WORDS * 5000)
    some = [prose, f"{prose} {"venomous hateful " * 8} {prose}", "venomous hateful", "venomous hateful", "", None]
    table = documents(spark, some)
    got = sorted((r["doc_id"], r["score"], r["predicted"], len(r["passages"])) for r in toxicity.toxicity(table.unionByName(table), model).collect())
    assert got[::2] == got[1::2] and [x[1] for x in got[4:8]] == [got[4][1]] * 4 and got[8][1] == got[10][1]
    assert got[2][3] == 1 and got[0][3] == 0 and got[4][2] == 1
    assert toxicity.toxicity(table.where("false"), model).collect() == []


def auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1.0
    for v in np.unique(scores):
        order[scores == v] = order[scores == v].mean()
    pos = truth.sum()
    return (order[truth == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(truth) - pos))


@pytest.mark.parametrize("name, label", [("op3_toxicity", "toxic"), ("op8_quality_classifier", "quality")])
def test_held_out_labels(spark, name, label):
    from stratum.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    truth = got[label].to_numpy()
    assert len(truth) > 50 and auc(got.score.to_numpy(), truth) > 0.97 and (got.predicted == truth).mean() > 0.95
