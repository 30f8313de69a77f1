"""Operator 10, benchmark decontamination by the q-gram lemma.

A passage of L characters that occurs with at most e edits shares at least L - q + 1 - q e of its q-grams with the
document, all of them within a band of e + 1 diagonals. Texts and passages are compared as lower-case letters and digits
(white space, ASCII punctuation and symbols left out), character by character. Per text:

1. a table look-up of every 8-gram against those of the passages, and a running sum that passes only stretches with
   enough hits for the easiest passage. For this a character is one byte: its code point, or one of 128 values for those
   beyond ASCII, so that equal characters stay equal and chance likenesses are told apart by the last step;
2. exact hits of those stretches counted in overlapping bands of diagonals (each twice e wide, a new one every e);
   regions that meet the bound of their passage go on;
3. edit distance of the passage within the band, widened by e on both sides: at most e edits confirms it.

The passages are a stated query set against all rows. They go to the workers in blocks of BLOCK_CHARS: the driver holds one
block at a time, each block is one pass over the texts, and texts are never shuffled. e = 10 % of the passage, less where
the lemma could not hold.

Defined cases: null and empty texts or passages match nothing; a passage without q letters must occur unchanged; passages
that several items share are reported for each item; empty tables give empty results or rows without spans; other columns
pass through, but for columns named spans, _more or _row, which the result replaces or leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, U64, read, stored

Q, EDIT_RATE, BLOCK_CHARS, TABLE_BITS = 8, 0.1, 4_000_000, 22
DROPPED = bytes(c for c in range(128) if not chr(c).isalnum())
_DROPPED = np.zeros(128, dtype=bool)
_DROPPED[list(DROPPED)] = True
_FAR = 1 << 40  #: added to diagonals, which may be negative


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters that are compared."""
    low = text.lower() if text else ""
    if low.isascii():
        return np.frombuffer(low.encode().translate(None, DROPPED), dtype=np.uint8)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes[(codes > 127) | ~_DROPPED[codes & 127]]


def _codes(x: np.ndarray | bytes | str) -> np.ndarray:
    if isinstance(x, str):
        return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return x if isinstance(x, np.ndarray) else np.frombuffer(x, dtype=np.uint8)


def packed(codes: np.ndarray) -> bytes:
    """One byte for each character."""
    if codes.dtype == np.uint8:
        return codes.tobytes()
    return np.where(codes < 128, codes, 128 + ((codes * np.uint32(0x9E3779B1)) >> np.uint32(25))).astype(np.uint8).tobytes()


def grams(text: bytes, q: int = Q) -> np.ndarray:
    """The packed 8-byte grams of text, in order."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.empty(n, dtype=U64)
    for k in range(q):
        part = np.frombuffer(text, dtype="<u8", offset=k, count=(len(text) - k) // q)
        out[k::q] = part
    return out


def banded_distance(pattern: np.ndarray | bytes | str, text: np.ndarray | bytes | str, e: int, low: int | None = None, high: int | None = None) -> int:
    """Least edits that turn pattern into some substring of text, or e + 1 if more than e. Only cells on the diagonals low to
    high (place in text less place in pattern; all of them if not given) are computed, one row for each character of pattern."""
    p, t = _codes(pattern), _codes(text)
    m, n = len(p), len(t)
    low = -m if low is None else max(low, -m)
    high = n if high is None else min(high, n)
    width = high - low + 1
    if width <= 0:
        return e + 1
    # places low .. m + high of the text, with what lies outside of it
    padded = np.full(m + width + 1, -1, dtype=np.int64)
    first, last = max(0, low), min(n, m + high + 1)
    padded[first - low : last - low] = t[first:last]
    far = m + n + 1
    outside = np.full(m + width + 1, far, dtype=np.int64)  # by the number of characters of text before a cell
    outside[max(0, -low) : max(0, n - low + 1)] = 0
    step = np.arange(width)
    row = outside[:width].copy()
    for i in range(1, m + 1):
        new = row + (padded[i - 1 : i - 1 + width] != p[i - 1])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new = np.minimum.accumulate(np.minimum(new, far) - step) + step
        row = np.maximum(new, outside[i : i + width])
        if row.min() > e:
            return e + 1
    return min(int(row.min()), e + 1)


class Passages:
    def __init__(self, items: tuple[tuple[int, str], ...], rate: float = EDIT_RATE):
        self.items = [(i, c, packed(c)) for i, t in items if len(c := letters(t))]
        size = np.array([len(c) for _, c, _ in self.items], dtype=np.int64)
        self.short = [k for k, n in enumerate(size) if n < Q]
        self.edits = np.maximum(0, np.minimum((rate * size).astype(np.int64), (size - Q) // Q))
        self.bound = np.maximum(1, size - Q + 1 - Q * self.edits)
        self.size = size
        long = [k for k, n in enumerate(size) if n >= Q]
        keys = [grams(self.items[k][2]) for k in long]
        item = np.repeat(np.array(long, dtype=np.int64), [len(g) for g in keys])
        at = np.concatenate([np.arange(len(g)) for g in keys]) if keys else np.zeros(0, dtype=np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, dtype=U64)
        order = np.argsort(key, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, self.first, self.n = np.unique(key[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
        self.table[self._slot(self.keys)] = 1
        self.window = int((self.size[long] + self.edits[long]).max()) if long else 0
        self.least = int(self.bound[long].min()) if long else 0
        self.step = np.maximum(1, self.edits)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * GOLDEN) >> U64(64 - TABLE_BITS)).astype(np.int32)

    def _unchanged(self, k: int, codes: np.ndarray, text: bytes, a: int = 0, b: int | None = None) -> int:
        """Where the k-th passage stands unchanged in text[a:b], or -1."""
        _, own, short = self.items[k]
        at = text.find(short, a, b)
        while at >= 0 and not np.array_equal(codes[at : at + len(own)], own):
            at = text.find(short, at + 1, b)
        return at

    def find(self, text: np.ndarray | bytes | str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) in the letters of a text, the best region of each item."""
        codes = _codes(text)
        text = packed(codes)
        found = [(self.items[k][0], p, p + int(self.size[k]), 0) for k in self.short if (p := self._unchanged(k, codes, text)) >= 0]
        g = grams(text)
        if not len(g) or not len(self.keys):
            return found
        maybe = self.table.take(self._slot(g))
        run = np.concatenate([[0], np.cumsum(maybe, dtype=np.int32)])
        if run[-1] < self.least:
            return found
        w = min(self.window, len(g))
        near = np.flatnonzero(maybe)
        lo, hi = np.maximum(0, near - w), np.minimum(len(g), near + w)
        near = near[run[hi] - run[lo] >= self.least]  # a region has this many hits within w of each of its hits
        pos = np.searchsorted(self.keys, g[near])
        pos[pos == len(self.keys)] = 0
        same = self.keys[pos] == g[near]
        near, pos = near[same], pos[same]
        if not len(near):
            return found
        n = self.n[pos]
        skip = np.repeat(self.first[pos] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, diagonal, where = self.item[skip], np.repeat(near, n) - self.at[skip], np.repeat(near, n)
        low = diagonal + _FAR
        band = np.concatenate([low // self.step[item], low // self.step[item] - 1])  # each covers two steps of diagonals
        item2, where2 = np.tile(item, 2), np.tile(where, 2)
        key = item2 * (1 << 42) + band
        keys, back, count = np.unique(key, return_inverse=True, return_counts=True)
        enough = count >= self.bound[keys >> 42]
        if not enough.any():
            return found
        best: dict[int, tuple[int, int, int]] = {}
        for k in np.flatnonzero(enough):
            it = int(keys[k] >> 42)
            e, size = int(self.edits[it]), int(self.size[it])
            start = int((keys[k] & ((1 << 42) - 1)) * self.step[it]) - _FAR
            low, high = start - e, start + 2 * int(self.step[it]) - 1 + e
            a, b = max(0, low), min(len(text), high + size)
            d = 0 if self._unchanged(it, codes, text, a, b) >= 0 else banded_distance(self.items[it][1], codes[a:b], e, low - a, high - a)
            if d <= e and (it not in best or d < best[it][2]):
                hits = where2[back == k]
                best[it] = (int(hits.min()), int(hits.max()) + Q, d)
        return found + [(self.items[it][0], *v) for it, v in sorted(best.items())]


@lru_cache(2)
def _passages(items: tuple[tuple[int, str], ...]) -> Passages:
    return Passages(items)


SPANS = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:bigint>>"


def _one_block(docs: DataFrame, items, text_col: str) -> DataFrame:
    """docs with _more: the spans of a block of passages (a broadcast tuple)."""
    names = docs.columns
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "edits")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _passages(items.value)
        for batch in batches:
            spans = [[dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in known.find(letters(t))] for t in batch.column(names.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*names, "_more"])

    return docs.mapInArrow(run, docs.withColumn("_more", F.lit(None).cast(SPANS)).schema)


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", passage_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with spans: item_id, start, end (in the letters of the text), edits; one for each item that occurs in it."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("spans", "_more", "_row")]
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(passage_col).alias("text")).filter("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)

    def block(b: int):
        rows = items.filter(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}")).collect()  # about block_chars characters
        return spark.sparkContext.broadcast(tuple(sorted((r.item_id, r.text) for r in rows)))

    docs = docs.select(*names)
    none = F.expr(f"cast(array() as {SPANS})")
    if not blocks:
        return docs.withColumn("spans", none)
    if blocks == 1:
        return _one_block(docs, block(0), text_col).withColumnRenamed("_more", "spans")
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # so that rows keep their numbers
    found = []
    for b in range(blocks):
        passages = block(b)
        found.append(stored(_one_block(docs.select("_row", text_col), passages, text_col).filter(F.size("_more") > 0).select("_row", "_more"), "spans"))
        passages.destroy()
    more = found[0]
    for x in found[1:]:
        more = more.unionByName(x)
    more = more.groupBy("_row").agg(F.flatten(F.collect_list("_more")).alias("_more"))  # one list from each block at most
    return docs.join(more, "_row", "left").select(*names, F.coalesce(F.array_sort("_more"), none).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: contaminated, kept (its opposite), n_items, item_ids (in order) and the spans."""
    out = find_passages(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.col("spans.item_id")))
    return out.select("doc_id", (F.size("spans") > 0).alias("contaminated"), (F.size("spans") == 0).alias("kept"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"), F.to_json("spans").alias("spans"))
