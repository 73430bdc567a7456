"""Token counts through a two-tier lookup of pre-token units.

A unit is a run of white space with the characters after it up to the next
cut; a cut lies before an ASCII space that follows a character which is white
space under no definition. Byte-level BPE never merges across such a cut, so a
text's ids are the concatenated ids of its units.

Units are found and hashed with numpy over the bytes of many texts at once and
looked up in an open-addressing table of arrays. The hash only finds an entry:
its bytes are compared with the unit's, and units whose hash belongs to others
are encoded by themselves.
Tier one of the table holds frequent units, gathered by bounded per-partition
summaries over all documents and broadcast (at most ``FREQUENT`` entries of at
most ``UNIT`` bytes). Tier two is what the tokenizer adds in each Python
worker; at ``CACHED`` entries the half that was used most stays.
Units are never shuffled; only the bounded summaries are.

Null text counts as empty (0 tokens). Rows keep their duplicates. Special
strings inside a text are handled by the tokenizer (one id). Very long texts
are taken in slices.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_hashes, grouped, importable, kept, pieces, string_column, table, tidied

FREQUENT = 65_536
SUMMARY = 8_192
UNIT = 48
CACHED = 500_000
SLICE = 1 << 18
GROUP = 1 << 16
LIMIT = 1024

_cut = re.compile(r"(?<=\S)(?= )")
#: A space after one of these is no cut.
_before = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_ascii_before = [x for x in _before if x.isascii()]
#: Sets the hashes of units without a space before them apart.
_ODD = np.uint64(0x8A91A6D40BF42041)


def is_plain(text: str) -> bool:
    """Whether every space in the text is a cut and a character follows it."""
    return not (
        text[:1] == " " or text[-1:] == " " or any(x in text for x in (_ascii_before if text.isascii() else _before))
    )


def slices(text: str, size: int = SLICE):
    """The text in parts that end at cuts, each a little over ``size`` characters."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        found = _cut.search(text, min(at + size, len(text)))
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


class Table:
    """An open-addressing map from 64-bit hashes to (offset, number) of ids, for whole arrays of hashes."""

    def __init__(self, size: int = 1 << 17):
        self.count = 0
        self.keys, self.where = np.zeros(size, np.uint64), np.full(size, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where a hash is new."""
        mask = np.uint64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        out = self.where[at]
        open_ = np.flatnonzero((self.keys[at] != h) & (out >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            i = at[open_]
            out[open_] = self.where[i]
            open_ = open_[(self.keys[i] != h[open_]) & (self.where[i] >= 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct new hashes become the next entries."""
        if 2 * (self.count + len(h)) > len(self.keys):
            keys, where = self.keys, self.where
            size = len(keys)
            while 2 * (self.count + len(h)) > size:
                size *= 2
            self.keys, self.where = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            full = where >= 0
            self._place(keys[full], where[full])
        self._place(h, np.arange(self.count, self.count + len(h), dtype=np.int32))
        self.count += len(h)

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.where[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.where[at[won]] = h[won], entry[won]
            left = np.ones(len(h), bool)
            left[won] = False
            h, entry, at = h[left], entry[left], (at[left] + 1) & mask


class Units:
    """Ids of units, or their number, in this worker.

    ``first`` (units joined by spaces, numbers of ids) stays for good when only numbers are asked for.
    """

    def __init__(self, path: str, counts: bool, first: tuple[bytes, np.ndarray] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.counts, self.first = counts, first
        vocabulary = self.tokenizer.get_vocab()
        #: bytes of each id: a character of a byte-level token stands for one byte
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self._start()

    def _start(self) -> None:
        self.table, self.used = Table(), 0
        self.number, self.offset = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.hash, self.uses = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, "<u4")
        # bytes of every entry, one after another
        self.spelt, self.begin, self.long = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.head, self.written = np.zeros(1 << 16, np.uint64), 0  # the first eight bytes of every entry
        if self.first is not None and len(self.first[1]):
            data = np.frombuffer(self.first[0] + b" ", np.uint8)
            ends = np.flatnonzero(data == 32)
            starts = np.concatenate([[0], ends[:-1] + 1])
            h = byte_hashes(data, starts, ends)
            _, pick = np.unique(h, return_index=True)  # of units with one hash the first
            self._enter(h[pick], self.first[1][pick], None, data, starts[pick], ends[pick])
        self.base = self.table.count

    def _enter(self, hashes, numbers, ids, data, starts, ends) -> None:
        at = self.table.count
        self.table.add(hashes)
        size = ends - starts
        self.begin = _room(self.begin, at, self.written + np.cumsum(size) - size)
        self.long = _room(self.long, at, size)
        self.head = _room(self.head, at, _heads(data, starts, size))
        self.spelt = _room(self.spelt, self.written, data[_places(starts, size)])
        self.written += int(size.sum())
        self.number = _room(self.number, at, numbers)
        self.hash = _room(self.hash, at, hashes)
        self.uses = _room(self.uses, at, np.zeros(len(hashes), np.int32))
        if ids is not None:
            self.offset = _room(self.offset, at, self.used + np.cumsum(numbers) - numbers)
            self.pool = _room(self.pool, self.used, ids)
            self.used += len(ids)

    def _compact(self) -> None:
        """Start again with the half of tier two that was used most."""
        keep = self.base + np.argsort(-self.uses[self.base : self.table.count], kind="stable")[: CACHED // 2]
        hashes, numbers = self.hash[keep], self.number[keep]
        ids = None
        if not self.counts:
            ends = np.cumsum(numbers, dtype=np.int64)
            ids = self.pool[np.repeat(self.offset[keep] - ends + numbers, numbers) + np.arange(ends[-1])]
        data, starts = self.spelt, self.begin[keep]
        ends = starts + self.long[keep]
        self._start()
        self._enter(hashes, numbers, ids, data, starts, ends)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of a space and a piece, and how many each has.

        They are encoded in one text; ids end where units do, so the byte
        lengths of ids tell the units apart.
        """
        ids, numbers = [], []
        for at in range(0, len(pieces), 256):
            part = pieces[at : at + 256]
            got = self.encode([" " + " ".join(part)])[0]
            ends = np.cumsum([(len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))) + 1 for x in part])
            ids.append(got)
            numbers.append(np.diff(np.searchsorted(np.cumsum(self.sizes[got]), ends) + 1, prepend=0))
        return (np.concatenate(ids), np.concatenate(numbers)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def of_many(self, texts: list[str]) -> list:
        """The ids (arrays), or their number, of whole texts; equal ones are looked up once."""
        once: dict = dict.fromkeys(texts)
        plain = []
        for text in once:
            if any(x in text for x in self.special):
                once[text] = self._value(self.encode([text])[0])
            elif len(text) > SLICE or not is_plain(text):
                got = [self.of_slice(x) for x in slices(text)]
                once[text] = sum(got) if self.counts else np.concatenate(got)
            else:
                plain.append(text)
        for group in grouped(plain, GROUP):
            once.update(zip(group, self.of_plain(group)))
        return [once[x] for x in texts]

    def _value(self, ids: np.ndarray):
        return len(ids) if self.counts else ids

    def of_slice(self, text: str):
        """Of a part of a text between cuts, of any form: plain stretches by the table, others by the tokenizer."""
        got = []
        for spaced, units in _runs(_cut.split(text)):
            # a plain stretch goes without its first space, which stands in for the space before a text's second unit
            got += self.of_plain(["".join(units)[1:]], odd=False) if spaced else [self._value(x) for x in self.encode(["".join(units)])]
        return sum(got) if self.counts else np.concatenate(got)

    def of_plain(self, texts: list[str], odd: bool = True) -> list:
        """Of plain texts. Without ``odd``, their first unit has a space before it as well."""
        data = np.frombuffer(b" ".join([*(x.encode("utf-8", "surrogatepass") for x in texts), b""]), np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = byte_hashes(data, starts, ends)
        last = np.cumsum([x.count(" ") + 1 for x in texts])
        first = np.concatenate([[0], last[:-1]])
        if odd:
            h[first] ^= _ODD
        entry = self.table.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.table.count - self.base > CACHED:
                self._compact()
                entry = self.table.find(h)
                new = np.flatnonzero(entry < 0)
            _, pick = np.unique(h[new], return_index=True)
            self._learn(data, starts, ends, h, new[pick], set(first.tolist()) if odd else set())
            entry[new] = self.table.find(h[new])
        self.uses[entry] += 1
        number = self.number[entry]
        other = self._other(entry, data, starts, ends)
        alone = {}
        if len(other):  # their hash is another unit's
            plain = set(first.tolist()) if odd else set()
            raw = data.tobytes()
            for i in other.tolist():
                name = raw[starts[i] : ends[i]].decode("utf-8", "surrogatepass")
                alone[i] = self.encode([name if i in plain else " " + name])[0]
                number[i] = len(alone[i])
        total = np.cumsum(number, dtype=np.int64)
        to = total[last - 1]
        if self.counts:
            return np.diff(to, prepend=0).tolist()
        offset = self.offset[entry].astype(np.int64)
        offset[other] = 0
        ids = self.pool[np.repeat(offset - total + number, number) + np.arange(total[-1])]
        for i, x in alone.items():
            ids[total[i] - len(x) : total[i]] = x
        return np.split(ids, to[:-1])

    def _other(self, entry, data, starts, ends) -> np.ndarray:
        """Units whose entry holds other bytes."""
        size = ends - starts
        wrong = (self.head[entry] != _heads(data, starts, size)) | (self.long[entry] != size)
        more = np.flatnonzero((size > 8) & ~wrong)  # the rest of longer ones
        if len(more):
            size = size[more] - 8
            unlike = np.flatnonzero(data[_places(starts[more] + 8, size)] != self.spelt[_places(self.begin[entry[more]] + 8, size)])
            if len(unlike):
                wrong[more[np.searchsorted(np.cumsum(size), unlike, "right")]] = True
        return np.flatnonzero(wrong)

    def _learn(self, data, starts, ends, h, new, odd: set[int]) -> None:
        raw = data.tobytes()
        spaced = [i for i in new.tolist() if i not in odd]
        alone = [i for i in new.tolist() if i in odd]
        names = lambda some: [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[some].tolist(), ends[some].tolist())]
        if spaced:
            ids, numbers = self.encode_spaced(names(spaced))
            self._enter(h[spaced], numbers, None if self.counts else ids, data, starts[spaced], ends[spaced])
        if alone:
            each = self.encode(names(alone))
            self._enter(h[alone], np.array([len(x) for x in each]), None if self.counts else np.concatenate(each), data, starts[alone], ends[alone])


_mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _heads(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight first bytes of each data[start:start + size], as a number."""
    whole = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", whole, strides=(1,))
    return eight[starts] & _mask[np.minimum(size, 8)]


def _places(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, ..., start + size - 1 of each, in one array."""
    total = np.cumsum(size, dtype=np.int64)
    return np.repeat(starts - total + size, size) + np.arange(total[-1] if len(total) else 0)


def _room(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The array with ``values`` at ``at``, made larger where they need it."""
    if at + len(values) > len(array):
        grown = np.zeros(max(2 * len(array), at + len(values)), array.dtype)
        grown[:at] = array[:at]
        array = grown
    array[at : at + len(values)] = values
    return array


def _runs(units: list[str]):
    """Stretches of units that are a space and more, or are not."""
    kinds = [len(u) > 1 and u[0] == " " and u[1] != " " and not u[-1].isspace() for u in units]
    at = 0
    for to in range(1, len(units) + 1):
        if to == len(units) or kinds[to] != kinds[at]:
            yield kinds[at], units[at:to]
            at = to


def worker(path: str, counts: bool, first: tuple[bytes, np.ndarray] | None = None) -> Units:
    """The units of this Python worker, kept between tasks as long as ``first`` is the same object."""
    return kept("units", (path, counts, id(first)), lambda: Units(path, counts, first))


def frequent_units(docs: DataFrame, path: str, text: str = "text", size: int = FREQUENT) -> tuple[bytes, np.ndarray]:
    """The most frequent units of all documents, joined by spaces, and their token counts; at most ``size``.

    Each partition counts its units by hash in blocks, keeps a bounded number
    of them, and hands over its ``SUMMARY`` most frequent; which units these
    are affects only speed.
    """

    def summarise(batches):
        names, counts, spelt, held, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}, [], 0

        def merge():
            nonlocal names, counts, spelt, held, n
            h = np.concatenate([x for x, _, _, _ in held])
            both, at = np.unique(np.concatenate([names, h]), return_inverse=True)
            total = np.bincount(at, np.concatenate([counts, np.ones(len(h), np.int64)]), len(both)).astype(np.int64)
            top = np.argsort(-total, kind="stable")[: 4 * SUMMARY]
            names, counts = both[top], total[top]
            wanted = np.sort(names)
            for x, data, starts, ends in held:
                known = wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x
                _, pick = np.unique(x[known], return_index=True)
                for i in np.flatnonzero(known)[pick].tolist():
                    if x[i] not in spelt:
                        spelt[x[i]] = data[starts[i] : ends[i]].tobytes()
            spelt = {k: spelt[k] for k in names}
            held, n = [], 0

        for batch in pieces(batches):
            for group in grouped([x for x in string_column(batch, text) if len(x) <= SLICE and is_plain(x)], GROUP):
                data = np.frombuffer(b" ".join(x.encode("utf-8", "surrogatepass") for x in group), np.uint8)
                gaps = np.flatnonzero(data == 32)
                starts, ends = gaps[:-1] + 1, gaps[1:]
                some = (ends > starts) & (ends - starts <= UNIT)
                starts, ends = starts[some], ends[some]
                held.append((byte_hashes(data, starts, ends), data, starts, ends))
                n += len(starts)
                if n > 1 << 20:
                    merge()
        if held:
            merge()
        top = np.argsort(-counts, kind="stable")[:SUMMARY]
        top = top[counts[top] > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([spelt[names[i]] for i in top], pa.binary()), pa.array(counts[top], pa.int64())], ["unit", "n"]
        )

    top = (
        docs.select(text)
        .mapInArrow(tidied(summarise), "unit binary, n long")
        .groupBy("unit")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "unit")
        .limit(size)
        .collect()
    )
    units = Units(path, counts=True)
    names = [bytes(r["unit"]).decode("utf-8", "surrogatepass") for r in top]
    names = [x for x in names if not x[-1].isspace() and not any(y in x for y in units.special)]
    return b" ".join(x.encode("utf-8", "surrogatepass") for x in names), units.encode_spaced(names)[1]


def count_tokens(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row of ``docs``; see the module's notes."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(frequent_units(docs, path, text))
    kind = docs.schema[key].dataType

    def count(batches):
        units = worker(path, True, shared.value)
        for batch in pieces(batches):
            texts = string_column(batch, text)
            n = units.of_many(texts)
            size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(
        tidied(count), f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
