"""Operator 9, removal of repeated 50-byte strings by a prefix-free parse.

Triggers. A rolling hash of 16 bytes is taken at every position; in each 50-byte string the least of them is its trigger.
So every 50-byte string holds a trigger that depends on its own bytes alone, and equal strings hold equal triggers at
equal places. The strings with the same trigger position are contiguous and lie in one phrase; phrases overlap by 49
bytes, which makes the parse prefix-free for this depth: what follows a string's phrase cannot change its place in the
order of 50-byte strings, and the parse needs no order beyond that of its phrases.

Dictionary. Each distinct phrase (by 128 bits) once, with the smallest and the largest document that holds it. It is dealt out
by triggers; in each part the suffixes of its phrases are sorted by their bytes (suffix array, eight bytes a round, only
ties going on), and neighbours with 50 equal bytes form a group, whose least document is the smallest one that has the
string. A trigger in a large part of all documents may have as many phrases as there are documents, at the edges of a
shared passage: the strings of such triggers' phrases are dealt out one by one, by their own hash. What still grows with the
documents that share a passage is the part of a string at the passage's very edge: it has a row for each phrase that holds
the string, and thus one for each different continuation.

Parse. The phrases of all documents in order, as (phrase, document, place). Joined to the dictionary's results (AQE splits what
is frequent), it gives the corpus order its documents: each string whose group has a smaller document is a span.

Three passes over the texts. The first counts the triggers with the 17 bytes on either side (every equal string shares one of
the two) over documents, in 4 bytes each, and leaves a filter of fixed size (FILTER_BITS) of those in two documents or more,
and a smaller one of frequent triggers. The second makes the dictionary of the phrases that pass, and its results another
filter; the third makes the parse of phrases that pass both. The filters only save work: when they are full, more phrases
travel and the result is the same.

Defined cases: a null text has no bytes; texts under 50 bytes keep all; texts are read in pieces of CHUNK_BYTES; rows
without an id are left whole and remove nothing; rows that repeat an id are one document, and each is cut where any of them
is marked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, U64, mix, read, stored

DEPTH, K, SIDE = 50, 16, 17
FILTER_BITS, HOT_BITS, BLOCK = 28, 24, 1 << 17
HOT = 50_000  #: a trigger counted so often is frequent
BUCKET_BYTES = 3_000_000  #: bytes of text for each part of the dictionary
CHUNK_BYTES, TOGETHER_BYTES = 500_000, 8_000_000  #: bytes of text, and of phrases, handled at a time
_PLACE = U64((1 << 28) - 1)
_TOP = U64(32)


def words_at(buf: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of n positions as integers; buf has at least n + 7 bytes."""
    out = np.empty(n, dtype=U64)
    raw = buf.tobytes()
    for k in range(8):
        out[k::8] = np.frombuffer(raw, dtype="<u8", offset=k, count=len(range(k, n, 8)))
    return out


@dataclass
class Phrases:
    """Of some pieces of text that lie end to end: each phrase's piece, first string, number of strings, trigger and its hash."""

    g: np.ndarray  # the word at every position
    piece: np.ndarray
    start: np.ndarray
    count: np.ndarray
    trigger: np.ndarray
    hash: np.ndarray

    def pick(self, at: np.ndarray) -> Phrases:
        return Phrases(self.g, self.piece[at], self.start[at], self.count[at], self.trigger[at], self.hash[at])

    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (32 bits) of the trigger with what stands before and after it, and whether a string has all of that."""
        out = []
        for first, seed in ((-SIDE, 0xA0761D6478BD642F), (0, 0xE7037ED1A0B428DB)):
            h = np.full(len(self.start), U64(seed))
            at = np.clip(self.trigger + first, 0, len(self.g) - K - SIDE + 7)  # out of bounds only where the side is not whole
            for k in (0, 8, 16, 24, K + SIDE - 8):
                h = mix(h * GOLDEN + self.g[at + k])
            out.append((h >> _TOP).astype(np.uint32))
        left = self.trigger - self.start >= SIDE
        right = self.trigger - (self.start + self.count - 1) < SIDE
        return out[0], left, out[1], right

    def digests(self, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the bytes of each phrase."""
        size = self.count + depth - 1
        a, b = size.astype(U64), mix(size.astype(U64))
        for k in range(0, 2 * depth, 8):
            on = size >= k + 8
            if not on.any():
                break
            w = self.g[np.where(on, self.start + k, 0)]
            a, b = np.where(on, mix(a * GOLDEN + w), a), np.where(on, mix(b + (w ^ U64(0x8EBC6AF09C88C6E3))) * GOLDEN, b)
        w = self.g[self.start + size - 8]
        return mix(a * GOLDEN + w), mix(b + (w ^ U64(0x589965CC75374CC3)))


def phrases(buf: np.ndarray, ends: np.ndarray, depth: int = DEPTH) -> Phrases:
    n = len(buf) - depth + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return Phrases(np.zeros(1, dtype=U64), none, none, none, none, np.zeros(0, dtype=U64))
    g = words_at(np.concatenate([buf, np.zeros(8, dtype=np.uint8)]), len(buf))
    h = mix(g[:-8] * U64(0x9E3779B97F4A7C15) + mix(g[8:] * U64(0xC2B2AE3D27D4EB4F)))[: len(buf) - K + 1]
    key = (h & ~_PLACE) | np.arange(len(h), dtype=U64)
    width, reach = depth - K + 1, 1
    least = key
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    trigger = (least[:n] & _PLACE).astype(np.int64)
    piece = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n]
    at = np.flatnonzero(np.arange(n) + depth <= ends[1:][piece])
    t = trigger[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return Phrases(g, piece[at[first]], at[first], count, t[first], mix(h[t[first]] ^ U64(0xD6E8FEB86659FD93)))


def _chunks(batch: pa.RecordBatch, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, places in their texts, end-to-end bytes and ends of pieces of text, about CHUNK_BYTES at a time. Each string starts
    in one piece and lies whole in it."""
    ids, at, some, size = [], [], [], 0

    def out():
        return np.array(ids, dtype=np.int64), np.array(at, dtype=np.int64), np.frombuffer(b"".join(some), dtype=np.uint8), np.cumsum([0, *map(len, some)])

    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        for first in range(0, max(0, len(raw) - depth + 1), CHUNK_BYTES):
            ids.append(i)
            at.append(first)
            some.append(raw[first : first + CHUNK_BYTES + depth - 1])
            size += len(some[-1])
            if size >= CHUNK_BYTES:
                yield out()
                ids, at, some, size = [], [], [], 0
    if some:
        yield out()


def _split(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    return list(zip(keys.tolist(), np.split(order, first[1:]), strict=True))


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _bits(slots: np.ndarray, kind: bool) -> pa.Table:
    """The sorted slots as bits, in blocks of BLOCK bytes: from the byte of the first slot of a block on."""
    byte = slots.astype(np.int64) >> 3
    rows = []
    for block in np.unique(byte // BLOCK).tolist():
        on = byte // BLOCK == block
        at = byte[on]
        bits = np.zeros(int(at[-1] - at[0]) + 1, dtype=np.uint8)
        np.bitwise_or.at(bits, at - at[0], (1 << (slots[on] & 7)).astype(np.uint8))
        rows.append((kind, block, int(at[0]), bits.tobytes()))
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("kind", pa.bool_()), ("block", pa.int64()), ("at", pa.int64()), ("bits", pa.binary())))})


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers as the bytes of their steps, all first bytes first: small steps leave planes of zeros, which compress."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def filters(docs: DataFrame, buckets: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """One bit for each slot of the hash range: of triggers with a side in two documents or more, and of frequent triggers."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, often = [], []
            for ids, _, buf, ends in _chunks(batch):
                p = phrases(buf, ends)
                left, has_left, right, has_right = p.sides()
                piece = np.concatenate([p.piece[has_left], p.piece[has_right]]).astype(U64)
                both = np.unique(piece << _TOP | np.concatenate([left[has_left], right[has_right]]))
                sides.append((both & U64(0xFFFFFFFF)).astype(np.uint32))
                slot, n = np.unique((p.hash >> U64(64 - HOT_BITS)).astype(np.uint32), return_counts=True)
                often.append(np.repeat(slot[n >= 3], n[n >= 3]))
            rows = []
            if sides:
                x = np.concatenate(sides)
                rows += [(p, _planes(np.sort(x[at]))) for p, at in _split((x.astype(U64) * U64(buckets) >> _TOP).astype(np.int64))]
                slot, n = np.unique(np.concatenate(often), return_counts=True)
                rows += [(-1 - p, np.stack([slot[at], n[at].astype(np.uint32)]).tobytes()) for p, at in _split(slot % min(64, buckets))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["bucket", "slots"])

    def twice(table: pa.Table) -> pa.Table:
        bucket, raws = table.column("bucket")[0].as_py(), table.column("slots").to_pylist()
        if bucket >= 0:
            x = np.sort(np.concatenate(list(map(_unplaned, raws))))
            return _bits(np.unique(x[1:][x[1:] == x[:-1]] >> (32 - FILTER_BITS)), False)
        parts = [np.frombuffer(r, dtype=np.uint32).reshape(2, -1) for r in raws]
        slot, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return _bits(slot[np.bincount(back, np.concatenate([p[1] for p in parts])) > hot], True)

    told = docs.mapInArrow(tell, "bucket bigint, slots binary").groupBy("bucket").applyInArrow(twice, _BITS)
    return tuple(_gathered(told, (FILTER_BITS, HOT_BITS)))


_BITS = "kind boolean, block bigint, at bigint, bits binary"


def _gathered(told: DataFrame, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """The bits of all parts, of one or two kinds, put together block by block: at most as many rows as the filters have blocks."""

    def merged(table: pa.Table) -> pa.Table:
        block = np.zeros(BLOCK, dtype=np.uint8)
        for at, bits in zip(table.column("at").to_pylist(), table.column("bits").to_pylist(), strict=True):
            block[at % BLOCK : at % BLOCK + len(bits)] |= np.frombuffer(bits, dtype=np.uint8)
        return pa.table({"kind": table.column("kind").slice(0, 1), "block": table.column("block").slice(0, 1), "bits": pa.array([block.tobytes()], pa.binary())})

    out = [np.zeros(max(BLOCK, 1 << (n - 3)), dtype=np.uint8) for n in sizes]
    for r in told.groupBy("kind", "block").applyInArrow(merged, "kind boolean, block bigint, bits binary").collect():
        out[r.kind][r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def marked_phrases(runs: DataFrame, buckets: int) -> np.ndarray:
    """A filter of FILTER_BITS of the phrases that have a run."""

    def bits(table: pa.Table) -> pa.Table:
        d1 = table.column("d1").to_numpy().view(U64)
        return _bits(np.unique(d1 >> U64(64 - FILTER_BITS)).astype(np.uint32), False)

    part = F.shiftrightunsigned(F.shiftrightunsigned("d1", 32) * buckets, 32)
    return _gathered(runs.select("d1").withColumn("part", part).groupBy("part").applyInArrow(bits, _BITS), (FILTER_BITS,))[0]


class Known:
    """The filters in a task."""

    def __init__(self, both: tuple[bytes, bytes]):
        self.repeated, self.hot = (np.frombuffer(x, dtype=np.uint8) for x in both)

    def passing(self, p: Phrases) -> Phrases:
        left, has_left, right, has_right = p.sides()
        low = 32 - FILTER_BITS
        return p.pick(np.flatnonzero((has_left & _has(self.repeated, left >> low)) | (has_right & _has(self.repeated, right >> low))))

    def frequent(self, trigger: np.ndarray) -> np.ndarray:
        return _has(self.hot, (trigger >> U64(64 - HOT_BITS)).astype(np.int64))


def _bytes_of(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return buf[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _distinct(d1: np.ndarray, d2: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal digests: the place of one, and the least and greatest document."""
    order = np.lexsort((d2, d1))
    a, b = d1[order], d2[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    if not len(new):
        return new, low[:0], high[:0]
    return order[new], np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new)


DICTIONARY = "bucket bigint, low binary, above binary, counts binary, d1 binary, d2 binary, bytes binary"
_NAMES = ["bucket", "low", "above", "counts", "d1", "d2", "bytes"]


def dictionary(docs: DataFrame, seen: Broadcast, buckets: int, depth: int = DEPTH) -> DataFrame:
    """The distinct phrases of some texts at a time (low: the smallest document, above: how far the largest is above it), dealt
    out by trigger. Strings of frequent triggers' phrases go one by one to buckets from `buckets` on: counts is the place of the
    string in its phrase then, and d1, d2 the phrase's digest, which the bytes of others tell."""

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[j].tobytes() for r in rows], pa.binary()) for j in range(1, 7))], names=_NAMES)

    def packed(columns: list[list[np.ndarray]], texts: list[np.ndarray], known: Known) -> Iterator[pa.RecordBatch]:
        trigger, d1, d2, low, high, count = map(np.concatenate, columns)
        text, size = np.concatenate(texts), count + depth - 1
        begin = np.cumsum(size) - size
        at, low, high = _distinct(d1, d2, low, high)
        trigger, d1, d2, count, size, begin = (x[at] for x in (trigger, d1, d2, count, size, begin))
        above, none = high - low, np.zeros(0, dtype=np.int64)
        often = known.frequent(trigger)
        of_bucket = _split(np.where(often, -1, ((trigger >> _TOP) * U64(buckets) >> _TOP).astype(np.int64)))
        yield rows_of([(b, low[k], above[k], count[k].astype(np.uint8), none, none, _bytes_of(text, begin[k], size[k])) for b, k in of_bucket if b >= 0])
        one = np.flatnonzero(often)
        if not len(one):
            return
        for first in range(0, len(one), 10_000):  # some 200,000 strings at a time
            some = one[first : first + 10_000]
            own = _bytes_of(text, begin[some], size[some])
            g = words_at(np.concatenate([own, np.zeros(8, dtype=np.uint8)]), len(own))
            of = np.repeat(some, count[some])
            inner = np.arange(len(of)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            start = np.repeat(np.cumsum(size[some]) - size[some], count[some]) + inner
            h = np.zeros(len(of), dtype=U64)
            for j in [*range(0, depth - 7, 8), depth - 8]:
                h = mix(h * GOLDEN + g[start + j])
            of_bucket = _split(buckets + ((h >> _TOP) * U64(buckets) >> _TOP).astype(np.int64))
            yield rows_of([(b, low[of[k]], above[of[k]], inner[k].astype(np.uint8), d1[of[k]], d2[of[k]], _bytes_of(own, start[k], np.full(len(k), depth))) for b, k in of_bucket])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(seen.value)
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        texts: list[np.ndarray] = []
        for batch in batches:
            for ids, _, buf, ends in _chunks(batch):
                p = known.passing(phrases(buf, ends))
                doc = ids[p.piece]
                d1, d2 = p.digests(depth)
                at, low, high = _distinct(d1, d2, doc, doc)
                p = p.pick(at)
                for c, x in zip(columns, (p.hash, d1[at], d2[at], low, high, p.count), strict=True):
                    c.append(x)
                texts.append(_bytes_of(buf, p.start, p.count + depth - 1))
                if sum(map(len, texts)) > TOGETHER_BYTES:
                    yield from packed(columns, texts, known)
                    columns, texts = [[] for _ in range(6)], []
        if texts:
            yield from packed(columns, texts, known)

    return docs.mapInArrow(run, DICTIONARY)


def suffix_array(buf: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of depth bytes at the places, in the order of their bytes, and the number of each one's group of equal ones."""
    g = words_at(np.concatenate([buf, np.zeros(8, dtype=np.uint8)]), len(buf)).byteswap()  # so that integers are in the order of bytes
    order = np.argsort(g[at], kind="stable")
    first = g[at[order]]
    group = np.cumsum(np.append(0, first[1:] != first[:-1]))[: len(at)]
    for k in [*range(8, depth - 7, 8), depth - 8]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        word = g[at[order[tied]] + k]
        again = np.lexsort((word, group[tied]))
        order[tied] = order[tied][again]
        word = word[again]
        apart = np.zeros(len(order), dtype=np.int64)
        apart[tied[1:]] = word[1:] != word[:-1]
        same = np.append(0, group[1:] != group[:-1])
        group = np.cumsum(np.maximum(same, apart))
    return order, group


def _runs(d1: np.ndarray, d2: np.ndarray, high: np.ndarray, phrase: np.ndarray, inner: np.ndarray, least: np.ndarray) -> list[pa.Array]:
    """Rows of phrase, first string, number of strings and least document, for strings that a larger document has too."""
    on = np.flatnonzero(least < high[phrase])
    phrase, inner, least = phrase[on], inner[on], least[on]
    new = np.flatnonzero(np.append(True, (phrase[1:] != phrase[:-1]) | (inner[1:] != inner[:-1] + 1) | (least[1:] != least[:-1]))[: len(on)])
    n = np.diff(np.append(new, len(on)))
    of = phrase[new]
    return [pa.array(d1[of].view(np.int64)), pa.array(d2[of].view(np.int64)), pa.array(inner[new], pa.int64()), pa.array(n, pa.int64()), pa.array(least[new], pa.int64())]


RUNS = "d1 bigint, d2 bigint, first bigint, n bigint, least bigint"
_RUN_NAMES = ["d1", "d2", "first", "n", "least"]


def repeated_runs(entries: DataFrame, buckets: int, depth: int = DEPTH) -> DataFrame:
    """Of each phrase of the dictionary, the runs of strings that a smaller document than its largest has."""

    def compare(table: pa.Table) -> pa.Table:
        kinds = (("low", np.int64), ("above", np.int64), ("counts", np.uint8), ("d1", U64), ("d2", U64), ("bytes", np.uint8))
        low, above, counts, d1, d2, buf = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=d) for c, d in kinds)
        high, counts = low + above, counts.astype(np.int64)
        if table.column("bucket")[0].as_py() < buckets:  # phrases
            size = counts + depth - 1
            begin = np.cumsum(size) - size
            g = words_at(np.concatenate([buf, np.zeros(8, dtype=np.uint8)]), len(buf))
            d1, d2 = Phrases(g, begin, begin, counts, begin, begin).digests(depth)
            at, low, high = _distinct(d1, d2, low, high)
            d1, d2, n, begin = d1[at], d2[at], counts[at], begin[at]
            phrase = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
            place = begin[phrase] + inner
        else:  # strings; the same one of the same phrase may have come from several batches
            key = mix(d2 ^ mix(counts.astype(U64)))
            at, low, high = _distinct(d1, key, low, high)
            d1, d2, inner, place, phrase = d1[at], d2[at], counts[at], at * depth, np.arange(len(at))
        order, group = suffix_array(buf, place, depth)
        least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, low[phrase[order]])
        of = np.empty(len(order), dtype=np.int64)
        of[order] = least[group]
        return pa.Table.from_arrays(_runs(d1, d2, high, phrase, inner, of), names=_RUN_NAMES)

    return entries.groupBy("bucket").applyInArrow(compare, RUNS)


def parse(docs: DataFrame, seen: Broadcast, marked: Broadcast, depth: int = DEPTH) -> DataFrame:
    """doc_id, start, d1, d2: the documents as phrases, those that pass both filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, runs = Known(seen.value), np.frombuffer(marked.value, dtype=np.uint8)
        for batch in batches:
            for ids, place, buf, ends in _chunks(batch):
                p = known.passing(phrases(buf, ends))
                d1, d2 = p.digests(depth)
                ok = _has(runs, (d1 >> U64(64 - FILTER_BITS)).astype(np.int64))
                p, d1, d2 = p.pick(ok), d1[ok], d2[ok]
                yield pa.RecordBatch.from_arrays([pa.array(ids[p.piece]), pa.array(p.start - ends[p.piece] + place[p.piece]), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["doc_id", "start", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id bigint, start bigint, d1 bigint, d2 bigint")


def repeated_spans(docs: DataFrame, buckets: int, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """doc_id, spans array<bigint> (start << 32 | end, unordered) of the strings that start in a smaller document too."""
    repeated, frequent = filters(docs, buckets, hot)
    seen = docs.sparkSession.sparkContext.broadcast((repeated.tobytes(), frequent.tobytes()))  # 34 MB at any size of input
    runs = stored(repeated_runs(dictionary(docs, seen, buckets, depth), buckets, depth), "runs")
    marked = docs.sparkSession.sparkContext.broadcast(marked_phrases(runs, buckets).tobytes())
    found = parse(docs, seen, marked, depth).join(runs, ["d1", "d2"]).filter("least < doc_id")
    first = F.col("start") + F.col("first")
    span = F.shiftleft(first, 32).bitwiseOR(first + F.col("n") + (depth - 1))
    return found.groupBy("doc_id").agg(F.collect_list(span).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, removed array<struct<start,end>> (maximal runs, in bytes), kept binary."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.filter("doc_id is not null and text is not null")
    buckets = max(8, (known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    joined = docs.join(repeated_spans(known, int(buckets), hot=hot), "doc_id", "left").select("doc_id", "text", "spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                n, gone, runs, kept = [], [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    raw = text.encode("utf-8", "surrogatepass") if text else b""
                    out = []
                    if spans.is_valid and raw:
                        packed = np.sort(spans.values.to_numpy())
                        a, b = packed >> 32, np.minimum(packed & 0xFFFFFFFF, len(raw))
                        reach = np.maximum.accumulate(b)
                        new = np.append(True, a[1:] > reach[:-1])
                        out = [(int(x), int(y)) for x, y in zip(a[new], np.maximum.reduceat(b, np.flatnonzero(new)), strict=True) if y > x]
                    n.append(len(raw))
                    gone.append(sum(y - x for x, y in out))
                    runs.append([{"start": x, "end": y} for x, y in out])
                    kept.append(b"".join(raw[x:y] for x, y in zip([0, *(y for _, y in out)], [*(x for x, _ in out), len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], depth: int = DEPTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by a table of all strings, for tests: id -> n_bytes, n_removed, n_spans, kept_sha256."""
    least: dict[bytes, int] = {}
    raws = {i: (t or "").encode() for i, t in texts.items()}
    for i in sorted(raws):
        for k in range(len(raws[i]) - depth + 1):
            least.setdefault(raws[i][k : k + depth], i)
    out = {}
    for i, raw in raws.items():
        gone = bytearray(len(raw))
        for k in range(len(raw) - depth + 1):
            if least[raw[k : k + depth]] < i:
                gone[k : k + depth] = b"\1" * depth
        spans = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(raw, gone, strict=True) if not x)).hexdigest())
    return out
