"""Self-join of documents on the Jaccard similarity of their word shingles, by vertical partitioning.

A document is the set of its distinct 5-word shingles. Words are hashed to 128
bits by keyed chains of eight bytes a step (long ones by BLAKE2b), shingles are 64 bits mixed from those of their words, and
a set is named by 128 bits of all its shingles. (Two shingles of a compared pair
share 64 bits with a chance of |A| |B| / 2^64, some 10^-13 for thousands.)

One global order holds for all documents: shingles by hash, and after them those
that the corpus repeats most (a bounded table gathered from all documents, the
most frequent last). It is cut into ``FRAGMENTS`` fragments: ranges of hashes,
and the frequent ones as the last. Every set is cut so, each fragment of two sets
meets on its own and its partial overlap is counted, and partial overlaps are
summed per pair. The first ``FIRST`` fragments and the sizes of the others rule
most pairs out before the rest is sent.

Only pairs that share a member of their prefixes in that order are counted: two
sets at the threshold t share a member of their first n - ceil(t n) + 1, and of
the smaller set the first n - ceil(2 t n / (1 + t)) + 1 do (its head).

Documents with equal sets are one node. A node's class is what is asked for,
so links inside a class that is already known are not counted again:

1. each node is compared with the most central node (by the lengths of its
   lists) of the list that most of its prefix shares, and links are united
   into classes;
2. where the centres link with less than a quarter of the nodes, nodes of lists
   that still hold two classes are compared with a few others of other
   classes, taken in shuffled order, while that finds links;
3. all pairs of different classes that are left in any list and whose prefixes
   overlap enough are compared.

After step 3 every pair that shares a prefix member is compared or has one
class, so no link between classes is lost, and a group of n near copies costs
about n comparisons. No task holds a list: frequent members are dealt to several
tasks by the set's name (``HOT``), and a list's least and largest class and its
centre are partial aggregates that are joined back.

Texts without words, null texts among them, have empty sets and are alone in
their class. Equal rows are kept and share a class. Fewer than five words are
one shingle. Rows with a null key link like others; such a class is named by its
least key that is not null, and is null without one. Long texts are cut into
slices at white space; a task holds the hashes of one whole text.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, durable, importable, pieces, string_column, table, tidied

WORDS = 5
PERCENT = 80
FRAGMENTS = 8
#: Fragments that are counted first, for all candidates.
FIRST = 2
#: Shingles that the corpus repeats most.
COMMON = 1 << 19
#: A shingle with more occurrences is dealt to several tasks.
HOT = 4096
#: Bytes of the longest words that are hashed together, of texts that are, and of a slice of a long text.
LONG = 64
GROUP = 1 << 19
SLICE = 1 << 20
#: Most ids that a broadcast may hold; beyond, the join is shuffled.
BROADCAST = 1 << 19
#: Partners of a node in a round of step 2, and most such rounds.
PARTNERS = 12
ROUNDS = 3
#: Nodes with one centre that are joined as one row.
CHUNK = 64

_blank = re.compile(rb"[\x20\x09-\x0d]")
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_none = np.zeros(0, np.uint64)
#: Keys of the two lanes, and the bytes of a word that its last eight bytes hold.
_keys = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_odd = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(lane: np.ndarray, x: np.ndarray, odd: np.uint64) -> np.ndarray:
    """The lane with eight more bytes: one-to-one in either."""
    lane = lane ^ x
    lane *= odd
    lane ^= lane >> np.uint64(29)
    lane *= np.uint64(0xA0761D6478BD642F)
    lane ^= lane >> np.uint64(32)
    return lane


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes, as two lanes, of data[start:end]; eight bytes or more follow the last one.

    Both lanes take eight bytes a step, so words of up to eight bytes have hashes of their own. Words over ``LONG`` bytes are hashed by BLAKE2b.
    """
    size = ends - starts
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = np.empty((2, len(size)), np.uint64)
    with np.errstate(over="ignore"):
        x = eight[starts] & _mask[np.minimum(size, 8)]
        for k in (0, 1):
            out[k] = _mixed(size.astype(np.uint64) * _keys[k], x, _odd[k])
        at = np.flatnonzero((size > 8) & (size <= LONG))
        step = 8
        while len(at):
            x = eight[starts[at] + step] & _mask[np.minimum(size[at] - step, 8)]
            out[0, at] = _mixed(out[0, at], x, _odd[0])
            out[1, at] = _mixed(out[1, at], (x << np.uint64(23)) | (x >> np.uint64(41)), _odd[1])
            step += 8
            at = at[size[at] > step]
    for i in np.flatnonzero(size > LONG).tolist():
        out[:, i] = np.frombuffer(blake2b(data[starts[i] : ends[i]], digest_size=16, key=b"shingle words").digest(), np.uint64)
    return out


def _hashed(raw: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words of all texts, and the number of the first word of each text and of the last one's end."""
    data = np.frombuffer(b" ".join([*raw, b"       "]), np.uint8)
    turns = np.flatnonzero(np.diff(_space[data], prepend=True, append=True))
    starts, ends = turns[::2], turns[1::2]
    return word_hashes(data, starts, ends), np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)])).tolist()


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, h.shape[1] - size + 1)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n else 0):
            out ^= h[0, k : k + n]
            out *= _keys[0]
            out ^= out >> np.uint64(32)
            out += h[1, k : k + n]
            out *= _odd[0]
        out ^= out >> np.uint64(29)
    return out


def _long(raw: bytes, words: int) -> np.ndarray:
    """Distinct shingles of a long text, slice by slice."""
    at, seen, held, parts = 0, 0, np.zeros((2, 0), np.uint64), []
    while at < len(raw):
        found = _blank.search(raw, min(at + SLICE, len(raw)))
        to = found.start() if found else len(raw)
        mine, _ = _hashed([raw[at:to]])
        seen += mine.shape[1]
        held = np.concatenate([held, mine], axis=1)
        parts.append(np.unique(_windows(held, words)))
        held, at = held[:, max(0, held.shape[1] - words + 1) :], to + 1
    if seen < words:
        return _windows(held, seen) if seen else _none
    return np.unique(np.concatenate(parts))


def raw_shingles(texts: list[str], words: int = WORDS):
    """For each text the hashes (uint64) of its shingles; those of short texts in their order and with repetition."""

    def of_group(group: list[bytes]):
        h, edges = _hashed(group)
        whole = _windows(h, words)
        for first, last in zip(edges, edges[1:]):
            n = last - first
            yield whole[first : last - words + 1] if n >= words else _windows(h[:, first:last], n) if n else _none

    group, n = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
        if len(raw) <= SLICE:
            group.append(raw)
            n += len(raw)
        if n > GROUP or len(raw) > SLICE:
            yield from of_group(group)
            group, n = [], 0
        if len(raw) > SLICE:
            yield _long(raw, words)
    yield from of_group(group)


def shingle_sets(texts: list[str], words: int = WORDS):
    """Sorted distinct shingle hashes of each text."""
    return map(np.unique, raw_shingles(texts, words))


def common_shingles(docs: DataFrame, text: str, words: int, size: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur most, rarest of them first, at most ``size``, and about how often each does.

    Every partition counts its shingles in blocks and hands over a bounded
    summary. The table sets an order, and how rows are dealt; any table gives
    the same result.
    """
    block, cells, held_most = 1 << 21, 1 << 21, 2 * size

    def summarise(batches):
        held, n = [], 0
        names, counts = _none, np.zeros(0, np.int64)

        def merge():
            nonlocal names, counts, held, n
            x = np.concatenate(held)
            held, n = [], 0
            place = (x >> np.uint64(43)).astype(np.int32)
            # a shingle that occurs three times is in a cell with three or more
            x = np.sort(x[np.bincount(place, minlength=cells)[place] > 2])
            first = np.flatnonzero(np.diff(x, prepend=~x[:1]))
            c = np.diff(first, append=len(x))
            x, c = x[first[c > 2]], c[c > 2]
            both, counts = np.concatenate([names, x]), np.concatenate([counts, c])
            order = np.argsort(both, kind="stable")
            both, counts = both[order], counts[order]
            first = np.flatnonzero(np.diff(both, prepend=~both[:1]))
            names, counts = both[first], np.add.reduceat(counts, first) if len(first) else counts
            if len(names) > held_most:
                top = np.sort(np.argpartition(-counts, held_most)[:held_most])
                names, counts = names[top], counts[top]

        for batch in pieces(batches):
            for x in raw_shingles(string_column(batch, text), words):
                held.append(x)
                n += len(x)
                if n > block:
                    merge()
        if held:
            merge()
        top = np.argsort(-counts, kind="stable")[: size // 8]
        yield pa.RecordBatch.from_arrays([pa.array(names[top].view(np.int64)), pa.array(counts[top])], ["x", "n"])

    top = (
        docs.select(text)
        .mapInArrow(tidied(summarise), "x long, n long")
        .groupBy("x")
        .agg(F.sum("n").alias("n"))
        .where("n >= 8")
        .orderBy(F.desc("n"), "x")
        .limit(size)
        .toArrow()
    )
    names, counts = (top.column(c).to_numpy().astype(np.int64)[::-1].copy() for c in ("x", "n"))
    return names.view(np.uint64), counts


def set_name(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed numbers."""
    raw = blake2b(x.tobytes(), digest_size=16, key=b"shingle sets").digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class _Order:
    """Sets in the global order."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.argsort(names, kind="stable")
        self.names, self.rank, self.counts = names[order], order.astype(np.int32), counts[order]

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members that aren't frequent, by hash; frequent ones, the most frequent last; and how often those are."""
        if not len(self.names):
            return x, _none, np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, x), len(self.names) - 1)
        known = self.names[at] == x
        late = at[known]
        late = late[np.argsort(self.rank[late], kind="stable")]
        return x[~known], self.names[late], self.counts[late]


def shingle_prefixes(docs: DataFrame, order, *, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(key, sid, s2, n, prefix, deal): the set's name and size, and its prefix where this task meets the set first.

    deal: -1, or for a frequent member the one of its parts that the set falls in.
    """

    hot = HOT

    def cut(batches):
        seen: set[tuple[int, int]] = set()
        for batch in pieces(batches):
            names, sizes, prefixes, deals = [], [], [], []
            for x in shingle_sets(string_column(batch, text), words):
                n = len(x)
                name = set_name(x)
                names.append(name)
                sizes.append(n)
                if not n or name in seen:
                    prefixes.append(None)
                    deals.append(None)
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(name)
                rare, often, counts = order.value.split(x)
                take = n - -(-percent * n // 100) + 1
                some = often[: max(0, take - len(rare))]
                parts = counts[: len(some)] // hot + 1
                prefixes.append(np.concatenate([rare[:take], some]).view(np.int64))
                deals.append(np.concatenate([np.full(min(take, len(rare)), -1, np.int32), np.where(parts > 1, name[1] % parts, -1).astype(np.int32)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(deals, pa.list_(pa.int32())),
                ],
                [key, "sid", "s2", "n", "prefix", "deal"],
            )

    return docs.select(key, text).mapInArrow(
        tidied(cut), f"`{key}` {docs.schema[key].dataType.simpleString()}, sid long, s2 long, n long, prefix array<long>, deal array<int>"
    )


def _parted(rows: DataFrame) -> DataFrame:
    """Rows whose ``sid`` is one set's: of different sets that share their first 64 bits each gets another number."""
    while True:
        names = rows.where("n > 0").groupBy("sid").agg(F.min("s2").alias("_a"), F.max("s2").alias("_b"))
        shared = [r["sid"] for r in names.where("_a <> _b").select("sid").collect()]  # about N^2 / 2^65 of N sets
        if not shared:
            return rows
        rows = durable(rows.withColumn("sid", F.when(F.col("sid").isin(shared), F.xxhash64("sid", "s2")).otherwise(F.col("sid"))))


def set_fragments(docs: DataFrame, order, *, words: int, fragments: int = FRAGMENTS) -> DataFrame:
    """(sid, part, members, sizes): every set of (text, sid, s2), cut in the global order; sizes are of all its fragments."""

    def cut(batches):
        edges = (np.arange(1, fragments - 1, dtype=np.float64) / (fragments - 1) * 2.0**64).astype(np.uint64)
        for batch in pieces(batches):
            sids, parts, members, sizes = [], [], [], []
            wanted = zip(batch.column("sid").to_pylist(), batch.column("s2").to_pylist())
            for (sid, s2), y in zip(wanted, shingle_sets(string_column(batch, "text"), words)):
                if set_name(y)[1] != s2:  # another text under an equal key
                    continue
                rare, often, _ = order.value.split(y)
                cut_up = [*np.split(rare, np.searchsorted(rare, edges)), often]
                size = [len(x) for x in cut_up]
                for part, x in enumerate(cut_up):
                    sids.append(sid)
                    parts.append(part)
                    members.append(x.view(np.int64))
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sids, pa.int64()), pa.array(parts, pa.int32()), pa.array(members, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                ["sid", "part", "members", "sizes"],
            )

    return docs.select("sid", "s2", "text").mapInArrow(tidied(cut), "sid long, part int, members array<long>, sizes array<int>")


def _close(a, b, percent: int):
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def overlaps(pairs: DataFrame, fragments: DataFrame, few: bool) -> DataFrame:
    """Pairs (a, b, na, nb, c0) with c, the overlap of the given fragments, and more, the most that the later ones can add.

    A fragment goes to each of its node's pairs; both sides of a pair meet in
    one shuffle. The pairs are broadcast when they are few.
    """
    side = F.explode(F.array(F.struct(F.col("a").alias("sid"), F.lit(0).alias("side")), F.struct(F.col("b").alias("sid"), F.lit(1).alias("side"))))
    keys = ["a", "b", "na", "nb", "c0"]
    ends = pairs.select(*keys, side.alias("_e")).select("_e.sid", "_e.side", *keys)
    sent = fragments.join(F.broadcast(ends) if few else ends, "sid")
    of = lambda k, c: F.first(F.when(F.col("side") == k, F.col(c)), ignorenulls=True)  # noqa: E731  equal rows bring a fragment twice
    met = sent.groupBy(*keys, "part").agg(of(0, "members").alias("_x"), of(1, "members").alias("_y"), of(0, "sizes").alias("_s"), of(1, "sizes").alias("_t"))
    later = F.aggregate(F.slice(F.zip_with("_s", "_t", lambda x, y: F.least(x, y)), FIRST + 1, FRAGMENTS), F.lit(0), lambda t, x: t + x)
    counts = met.select(*keys, F.size(F.array_intersect("_x", "_y")).cast("long").alias("c"), later.cast("long").alias("more"))
    return counts.groupBy(*keys).agg(F.sum("c").alias("c"), F.max("more").alias("more"))


def _beyond(n, percent: int):
    """Members of a set of n that are not in its prefix."""
    return F.ceil(percent * n / 100) - 1


def _least(na, nb, percent: int):
    """The overlap that sets of these sizes need."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, na, nb): those that may reach the threshold.

    An overlap of c in the prefixes leaves at most the rest of one set besides.
    """
    left = nodes.select(F.col("sid").alias("a"), F.col("tokens.token").alias("_ta"))
    right = nodes.select(F.col("sid").alias("b"), F.col("tokens.token").alias("_tb"))
    na, nb = F.col("na"), F.col("nb")
    most = F.size(F.array_intersect("_ta", "_tb")) + F.greatest(_beyond(na, percent), _beyond(nb, percent))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(most >= _least(na, nb, percent)).select("a", "b", "na", "nb")


def _classed(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Nodes with their class."""
    named = classes.select(F.col("id").alias("sid"), F.col("component").alias("_c"))
    return nodes.join(named, "sid", "left").select(*nodes.columns, F.coalesce("_c", "sid").alias("class"))


def _chunks(centres: DataFrame) -> DataFrame:
    """(sid, chunk) of centres and their nodes (b, a): about ``CHUNK`` nodes with one centre, which is its own."""
    own = centres.select(F.col("b").alias("sid")).distinct()
    other = durable(centres.select(F.col("a").alias("sid"), F.col("b").alias("centre")).join(own, "sid", "left_anti"))
    sizes = durable(other.groupBy("centre").agg((F.count("*") + 1).alias("_k")))
    # short rows and a join alone in its stage: skewed ones are split
    held = durable(other.join(sizes, "centre", "left"))
    held = held.unionByName(own.withColumn("centre", F.col("sid")).join(sizes, "centre", "left"))
    piece = F.pmod(F.xxhash64("sid"), F.ceil(F.coalesce("_k", F.lit(1)) / CHUNK)).cast("int")
    return held.select("sid", F.struct("centre", piece.alias("piece")).alias("chunk"))


def _chunked(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes with their chunk; nodes without a centre are one each."""
    alone = F.struct(F.col("sid").alias("centre"), F.lit(0).alias("piece"))
    return nodes.join(chunks.withColumnRenamed("chunk", "_q"), "sid", "left").select(*nodes.columns, F.coalesce("_q", alone).alias("chunk"))


def _listed(classed: DataFrame) -> DataFrame:
    names = [c for c in classed.columns if c != "tokens"]
    return classed.select(F.explode("tokens").alias("_t"), *names).select("_t.token", "_t.at", *names)


def _lists(classed: DataFrame) -> DataFrame:
    """(token, at, sid, n, class[, chunk], size) of the lists that hold more than one class, with their lengths."""
    each = _listed(classed.drop("hub"))
    of_list = each.groupBy("token").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi"), F.count("*").alias("size"))
    # one short row for each list: a long list is a skewed join
    return each.join(of_list.where("_lo <> _hi").select("token", "size"), "token")


def _star(nodes: DataFrame, percent: int) -> DataFrame:
    """Each node with the most central node of the list that most of its prefix shares."""
    each = _listed(nodes).select("token", "sid", F.col("n").cast("int").alias("n"), F.col("hub").cast("float").alias("hub"))
    centre = each.groupBy("token").agg(F.max(F.struct("hub", "sid", "n")).alias("_z"))
    found = (
        each.select("token", "sid", "n")
        .join(centre.select("token", F.col("_z.sid").alias("b"), F.col("_z.n").alias("nb")), "token")
        .where((F.col("sid") != F.col("b")) & _close(F.col("n"), F.col("nb"), percent))
        .groupBy(F.col("sid").alias("a"), F.col("n").alias("na"), "b", "nb")
        .agg(F.count("*").alias("_k"))
    )
    best = found.groupBy("a", "na").agg(F.max(F.struct("_k", "b", "nb")).alias("_m"))
    return best.select("a", F.col("_m.b").alias("b"), F.col("na").cast("long").alias("na"), F.col("_m.nb").cast("long").alias("nb"))


def _neighbours(lists: DataFrame, percent: int, seed: int, most: int = PARTNERS) -> DataFrame:
    """Each node with at most ``most`` of the nodes before it when lists are shuffled, each list in its own way; long lists in parts."""
    shuffled = F.xxhash64("token", "sid", F.lit(seed))
    part = F.pmod(F.xxhash64("sid", "token", F.lit(seed)), F.ceil(F.col("size") / HOT))
    row = Window.partitionBy("token", "_part").orderBy("_h", "sid")
    last = F.lag(F.struct("class", "sid", "n")).over(row)
    found = (
        lists.select("token", "sid", "n", "class", shuffled.alias("_h"), part.alias("_part"))
        .withColumn("_z", last)
        .where((F.col("class") != F.col("_z.class")) & _close(F.col("n"), F.col("_z.n"), percent))
        .select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("_z.sid").alias("b"), F.col("_z.n").alias("nb"))
        .distinct()
    )
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b", F.lit(seed)), "b"))
    return found.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def _rest(classed: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of different classes whose prefixes overlap enough for the threshold.

    A pair's first common member lies in the smaller set's head, at places i
    and j that leave min(n - i, m - j) members or more for the overlap. Lists
    are joined by chunks of about ``CHUNK`` nodes with one centre, so a group
    that shares a token with a node, or in itself, is few rows; the nodes of
    two chunks are then compared where both are at hand.
    """
    node = F.struct("sid", "n", "class", F.col("tokens.token").alias("tokens"), F.col("tokens.at").alias("places")).alias("node")
    chunks = durable(classed.select("chunk", node).groupBy("chunk").agg(F.collect_list("node").alias("nodes")))
    head = F.col("at") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    side = lambda k: [F.col("chunk").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("lo", "hi", "room", "k"))]
    near = (100 * F.col("p_hi") >= percent * F.col("q_lo")) & (100 * F.col("q_hi") >= percent * F.col("p_lo"))
    room = F.least("p_room", "q_room") >= _least(F.col("p_lo"), F.col("q_lo"), percent)

    def units_of(some: DataFrame) -> DataFrame:
        spots = (
            some.groupBy("token", "chunk")
            .agg(F.max("head").alias("head"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("room"), F.count("*").alias("k"))
        )
        found = spots.where("head").select("token", *side("p")).join(spots.select("token", *side("q")), "token")
        found = found.where(near & room & ((F.col("p") != F.col("q")) | (F.col("p_k") > 1)))
        return found.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))

    spots = lists.select("token", "n", "chunk", "size", head.alias("head"), (F.col("n") - F.col("at")).alias("room"))
    # short lists are dealt once for the sums and the join; long ones are summed in parts and their join is split
    units = units_of(spots.where(F.col("size") <= HOT).repartition("token")).union(units_of(spots.where(F.col("size") > HOT))).distinct()
    both = units.join(chunks.select(F.col("chunk").alias("p"), F.col("nodes").alias("left")), "p")
    both = both.join(chunks.select(F.col("chunk").alias("q"), F.col("nodes").alias("right")), "q").select("p", "q", "left", "right")
    both = both.select((F.col("p") == F.col("q")).alias("same"), "left", "right")

    def compare(batches):
        for batch in pieces(batches, 64):
            out = []
            for same, left, right in zip(batch.column("same").to_pylist(), batch.column("left"), batch.column("right")):
                one = left.as_py()
                other = one if same else right.as_py()
                where: dict[int, list[int]] = {}
                for i, x in enumerate(one):
                    x["shared"] = dict(zip(x["tokens"], x["places"]))
                    for t in x["tokens"]:
                        where.setdefault(t, []).append(i)
                for k, y in enumerate(other):
                    mine = y.get("shared") or dict(zip(y["tokens"], y["places"]))
                    for i in {i for t in mine for i in where.get(t, ()) if not same or i < k}:
                        x = one[i]
                        if x["class"] != y["class"] and _may_reach(x["n"], x["shared"], y["n"], mine, percent):
                            out.append((x["sid"], y["sid"], x["n"], y["n"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "na", "nb"])

    return both.mapInArrow(tidied(compare), "a long, b long, na long, nb long")


def _may_reach(n: int, x: dict[int, int], m: int, y: dict[int, int], percent: int) -> bool:
    """Whether sets of n and m can be similar, by the places of what their prefixes share.

    The overlap is at most the k shared, and what follows the last of them, in
    either set; and at most the k and the rest beyond one of the prefixes.
    """
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = x.keys() & y.keys()
    if not both:
        return False
    i, j = max(x[t] for t in both), max(y[t] for t in both)
    beyond = max(-(-percent * n // 100) - 1, -(-percent * m // 100) - 1)
    return len(both) + min(n - i - 1, m - j - 1, beyond) >= -(-percent * (n + m) // (100 + percent))


def jaccard_classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, report: dict | None = None
) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``; see the module's notes."""
    spark = docs.sparkSession
    importable(spark)
    order = spark.sparkContext.broadcast(_Order(*common_shingles(docs, text, words)))  # at most COMMON entries
    rows = _parted(durable(shingle_prefixes(docs, order, key=key, text=text, words=words, percent=percent)))
    each = rows.where("prefix is not null").select(F.posexplode(F.arrays_zip("prefix", "deal")).alias("at", "_z"), "sid", "n")
    each = each.select("at", F.col("_z.prefix").alias("token"), F.col("_z.deal").alias("deal"), "sid", "n")
    # of members that are dealt to several tasks, at most COMMON
    dealt = durable(each.where("deal >= 0").groupBy("token").agg(F.count("*").alias("_n"), F.min("sid").alias("_min"), F.max("sid").alias("_max")))
    token = Window.partitionBy("token", "deal")
    shared = (
        each.select(
            "*", F.lag("sid").over(token.orderBy("sid")).alias("_last"), F.count("*").over(token).alias("_k"),
            F.min("sid").over(token).alias("_lo"), F.max("sid").over(token).alias("_hi"),
        )
        .join(F.broadcast(dealt), "token", "left")
        .where("coalesce(_min, _lo) <> coalesce(_max, _hi) AND (_last IS NULL OR _last <> sid)")
        .withColumn("_df", F.coalesce("_n", "_k"))
    )
    # what a node shares is no longer than its prefix
    nodes = durable(
        shared.groupBy("sid").agg(
            F.first("n").alias("n"), F.collect_list(F.struct("token", "at")).alias("tokens"), (F.sum(F.log2("_df")) / F.first("n")).alias("hub")
        )
    )
    # some row of a set tells where its text is found again
    sets = rows.where("n > 0").groupBy("sid").agg(F.first("s2").alias("s2"), F.min(key).alias("_key"))
    owners = durable(sets.join(nodes.select("sid"), "sid"))

    def decided(pairs: DataFrame) -> tuple[DataFrame, int, int]:
        """The links among pairs, and the numbers of both; sets are made again from the texts of their nodes."""
        pairs = durable(pairs.withColumn("c0", F.lit(0).cast("long")))
        count = pairs.count()
        need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
        some = durable(overlaps(pairs, fragments_of(pairs, count, "part < {}"), count <= BROADCAST))
        # pairs that the first fragments rule out send no others
        left = durable(some.where(F.col("c") + F.col("more") >= need).select("a", "b", "na", "nb", F.col("c").alias("c0")))
        n = left.count()
        whole = overlaps(left, fragments_of(left, n, "part >= {}"), n <= BROADCAST).withColumn("c", F.col("c") + F.col("c0"))
        links = durable(whole.where(F.lit(100) * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b"))
        return links, count, links.count()

    def fragments_of(pairs: DataFrame, count: int, which: str) -> DataFrame:
        sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        wanted = durable(owners.join(sids, "sid"))
        every = docs.select(F.col(key).alias("_k"), F.col(text).alias("text"))
        chosen = every.join(F.broadcast(wanted) if count <= BROADCAST else wanted, F.col("_k").eqNullSafe(F.col("_key")))
        return set_fragments(chosen, order, words=words).where(which.format(FIRST))

    found, classes, step, good = None, None, 0, True
    while True:
        last = step > ROUNDS or (step > 0 and good)
        if step:
            classed = durable(_classed(_chunked(nodes, chunks), classes))
        if step == 0:
            centres = durable(_star(nodes, percent))
            chunks = durable(_chunks(centres))
            pairs = bounded(centres, nodes, percent)
        else:
            lists = durable(_lists(classed))
            pairs = _rest(classed, lists, percent) if last else bounded(_neighbours(lists, percent, step), nodes, percent)
        links, tried, made = decided(pairs)
        if report is not None:
            report[step] = (tried, made)
        found = links if found is None else found.union(links)
        classes = durable(components(spark, found))
        if last:
            break
        # centres that most nodes link with, or partners that hardly any do, leave little to settle before step 3
        good = 4 * made >= tried if step == 0 else 20 * made < tried
        step += 1
    order.destroy()
    # the class is named by its least key; both joins stand alone in their stages, so that skewed ones are split
    least = rows.where("n > 0").groupBy("sid").agg(F.min(key).alias("_own"), F.count("*").alias("_rows"))
    named = durable(
        least.join(classes.select(F.col("id").alias("sid"), "component"), "sid", "left").select("sid", "_own", "_rows", F.coalesce("component", "sid").alias("_c"))
    )
    lows = named.groupBy("_c").agg(F.min("_own").alias("_least"), F.sum("_rows").alias("_all")).where("_all > 1").select("_c", "_least")
    of_set = durable(named.join(durable(lows), "_c").select("sid", "_least"))
    return (
        rows.select(key, "sid", "n")
        .join(of_set, "sid", "left")
        .select(
            key, F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.coalesce("_least", key)).otherwise(F.col(key)).alias("component_id"),
        )
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
members AS (SELECT doc_id, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = doc_id) AS component_id FROM sizes
"""
