"""Operator 5, near-duplicates by SuperMinHash.

1. Each text becomes the set of its distinct word shingles (64-bit hashes). For an element, SuperMinHash walks a random
   permutation of the registers and offers register p(j) the value j + u; a document stops as soon as every register
   holds a value below the next rank, so long texts need one step per element.
2. Documents with the same set (a 128-bit digest of it and its size) are one class; its smallest id stands for all, so
   groups of copies never meet as pairs.
3. Signatures are cut into bands. First each class is linked to one other: of all classes in its buckets the one whose own
   buckets are largest, which is in the middle of a group of near copies. Every try is confirmed on the full sets, and
   the links found are grouped by union-find.
4. What is left: classes that share a bucket but not yet a component. In large buckets, pairs that have a rare shingle in
   common come from the lists of these; for all others the rare shingles bound what a class could still link to, and take out members for
   which no partner is possible. While the pairs left are many, only one member for each component and bucket is tried
   against the bucket's first component; then every remaining pair within the bounds, which a bit map of either set tightens
   where the pair is made, is confirmed. No bucket is capped and no possible link dropped.

With 32 bands of 4 registers a pair at similarity 0.8 shares a bucket with probability 1 - 5e-8.

Defined cases: a null text, or one without words, has 0 shingles and links with nothing; a text with fewer words than a
shingle is one shingle; rows that repeat an id count once as a document (each row is returned), and if their texts differ,
the least of them is the one whose set is compared; rows without an id keep component null and are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, U64, mix, read, stored
from .components import compose, connected_components, rename

log = logging.getLogger(__name__)

REGISTERS, BANDS = 128, 32
RARE, LARGE = 64, 64  #: see _could_link
CHUNK, TOGETHER = 60_000, 1_000_000  #: shingles handled at a time
MAP_WORDS = 8  #: a set's map has 64 bits in each
MAP = tuple(f"m{k}" for k in range(MAP_WORDS))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes. bytes.lower() changes A-Z alone and bytes.split() cuts at \\x09-\\x0D and space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=U64, count=len(parts))
    n = max(1, len(h) - words + 1)
    out = np.full(n, U64(min(words, len(h))))
    for k in range(min(words, len(h))):
        out = mix(out * GOLDEN + h[k : k + n])
    return np.unique(out)


def superminhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """(sets, m) register values as float64: rank + uniform, infinity for the empty set."""
    sig = np.full(len(sets) * m, np.inf)
    size = np.array([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last = first + 1
        total = size[first]
        while last < len(sets) and total + size[last] <= CHUNK:
            total += size[last]
            last += 1
        if total:
            _registers(np.concatenate(sets[first:last]), np.repeat(np.arange(first, last), size[first:last]), sig, m)
        first = last
    return sig.reshape(len(sets), m)


def _registers(h: np.ndarray, doc: np.ndarray, sig: np.ndarray, m: int) -> None:
    perm = None
    for j in range(m):
        z = mix(h + U64(int(GOLDEN) * (j + 1) % 2**64))
        u = (z >> U64(11)).astype(np.float64) * 2.0**-53
        k = j + ((mix(z ^ GOLDEN) >> U64(40)) * U64(m - j) >> U64(24)).astype(np.int64)
        rows = np.arange(len(h))
        if perm is None:
            at = k
        else:
            at = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, doc * m + at, u + j)
        lo = doc[0]
        open_ = sig[lo * m : (doc[-1] + 1) * m].reshape(-1, m).max(axis=1) >= j + 1
        stay = open_[doc - lo]
        if not stay.any():
            return
        if perm is None:
            h, doc, k = h[stay], doc[stay], k[stay]
            perm = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(h), 1))
            perm[np.arange(len(h)), k] = 0
            perm[:, 0] = k
        elif not stay.all():
            h, doc, perm = h[stay], doc[stay], perm[stay]


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, s1, s2 (digest of the set), buckets array<bigint> (empty for an empty set)."""
    rows = REGISTERS // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                n = np.array([len(s) for s in sets])
                digest = np.array([[mix(s).sum(dtype=U64), mix(s ^ GOLDEN).sum(dtype=U64)] for s in sets], dtype=U64).reshape(-1, 2).view(np.int64)
                sig = superminhash(sets).view(U64).reshape(len(sets), BANDS, rows)
                band = np.arange(1, BANDS + 1, dtype=U64) * GOLDEN
                for r in range(rows):
                    band = mix(band * GOLDEN + sig[:, :, r])
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), buckets], names=["doc_id", "n_shingles", "s1", "s2", "buckets"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, buckets array<bigint>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                on = np.zeros((len(sets), 64 * MAP_WORDS), dtype=bool)
                for k, s in enumerate(sets):
                    on[k, (s % U64(64 * MAP_WORDS)).astype(np.int64)] = True
                maps = np.packbits(on, axis=1, bitorder="little").view("<i8")
                columns = [part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(maps[:, k]) for k in range(MAP_WORDS))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "elements", "n_el", *MAP])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"node bigint, elements binary, n_el bigint, {', '.join(f'{m} bigint' for m in MAP)}")


def could_be_alike(percent: int) -> Column:
    """Whether the maps of two sets (one bit for each of so many hash values) leave room for a link: a bit that only one of them
    has is an element that the other lacks, so the intersection is at most either set's size less such bits."""
    lacks = lambda x, y: reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{m}{x}").bitwiseAND(F.bitwise_not(F.col(f"{m}{y}")))) for m in MAP))
    i = F.least(F.col("n_el_a") - lacks("_a", "_b"), F.col("n_el_b") - lacks("_b", "_a"))
    return 100 * i >= percent * (F.col("n_el_a") + F.col("n_el_b") - i)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """e, n, nodes: each shingle of a part of the sets once, how many have it, and which (null if more than RARE: it is not rare
    then). The parts are as few as their shingles need: near copies have most in common, and a part names that once."""
    parts = (sets.agg(F.sum("n_el")).first()[0] or 0) // TOGETHER + 1

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            size = np.array([len(s.as_buffer()) // 8 for s in batch.column(1)], dtype=np.int64)
            part = np.cumsum(size) // TOGETHER
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                e = np.concatenate([np.frombuffer(batch.column(1)[k].as_buffer(), dtype=np.int64) for k in at.tolist()])
                order = np.argsort(e, kind="stable")
                e, holder = e[order], np.repeat(node[at], size[at])[order]
                new = np.flatnonzero(np.append(True, e[1:] != e[:-1])[: len(e)])
                n = np.diff(np.append(new, len(e)))
                few = n <= RARE
                kept = np.repeat(few, n)
                ends = np.cumsum([0, *np.where(few, n, 0)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(e[new]), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(holder[kept]), mask=pa.array(~few))], names=["e", "n", "nodes"])

    return sets.select("node", "elements").coalesce(parts).mapInArrow(together, "e bigint, n bigint, nodes array<bigint>")


def _could_link(members: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of buckets that hold two components or more: what is left to confirm. In buckets of LARGE members or fewer that is
    every pair (linear in their members); in larger ones exact bounds on the full sets come first.

    A shingle is rare if at most RARE of these classes have it. A pair shares c rare shingles and at most the others of
    either class, so it can link only if 100 i >= percent (size + size - i) with i = c + the fewer others. First result: the
    pairs with c > 0 within that bound, from the lists of rare shingles (RARE long at most). Second: for pairs with c = 0,
    members with size and cap (the largest size of a partner), without those whose cap lies below every size in the bucket."""
    held = rename(members.withColumn("c", F.col("node")), "c", components)
    mixed = held.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).filter("c0 != c1").select("bucket", "n")
    members = stored(members.join(mixed, "bucket"), "mixed-members")
    small = members.filter(F.col("n") <= LARGE).drop("n").withColumns({"size": F.lit(0).cast("bigint"), "cap": F.lit(2**62)})
    members = members.filter(F.col("n") > LARGE).drop("n")
    own = stored(sets.join(members.select("node").distinct(), "node", "left_semi").select("node", "elements", "n_el"), "large-sets")
    held_by = shared_shingles(own).groupBy("e").agg(F.sum("n").alias("k"), F.flatten(F.collect_list("nodes")).alias("nodes"))
    lists = stored(held_by.filter(F.col("k") <= RARE).select("e", F.sort_array("nodes").alias("nodes")), "rare")
    count = lists.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("rare"))
    size = own.select("node", F.col("n_el").alias("size")).join(count, "node", "left")
    others = F.col("size") - F.coalesce("rare", F.lit(0))
    size = stored(size.select("node", "size", others.alias("others"), F.floor(others * (100 + percent) / percent + 1e-6 - F.col("size")).alias("cap")), "sizes")

    smaller = F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", F.lit(1), i), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = lists.filter(F.size("nodes") > 1).select(F.explode(F.flatten(smaller)).alias("x")).select("x.a", "x.b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    pairs = rename(rename(pairs.withColumns({"x": F.col("a"), "y": F.col("b")}), "x", components), "y", components).filter("x != y")
    for side in ("a", "b"):
        pairs = pairs.join(size.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("others").alias(f"others_{side}")), side)
    i = F.col("c") + F.least("others_a", "others_b")
    pairs = pairs.filter(100 * i >= percent * (F.col("size_a") + F.col("size_b") - i)).select("a", "b")

    members = members.join(size.drop("others"), "node")
    least = members.groupBy("bucket").agg(F.min("size").alias("least"))
    large = members.join(least, "bucket").filter("cap >= least").drop("least")
    return pairs, stored(large.unionByName(small), "mixed-members")


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """components after more links, which are first renamed to what is already joined."""
    more = connected_components(rename(rename(links, "a", components), "b", components).select("a", "b"))
    return stored(compose(components, more), "names")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", many: float = 4.0) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. many: while more pairs than this for each class are left,
    a round of trial links between components goes before the confirmation of all."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sig = stored(signatures(docs, words), "signatures")
    filled = sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(filled.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    n_classes = classes.count()
    stands = classes.select("node").distinct()
    one = filled.join(classes, ["s1", "s2", "n_shingles"]).filter(F.col("doc_id") == F.col("node"))
    members = one.select("node", F.explode("buckets").alias("bucket")).distinct()
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(members.join(shared, "bucket"), "members")  # of buckets with two classes or more
    # a class near the middle of a group is in the large buckets of all bands: it is tried first
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    members = stored(members.drop("n").join(fame, "node").withColumn("lead", F.struct(F.col("fame"), (-F.col("node")).alias("minus"))).drop("fame"), "members")
    sets = stored(full_sets(docs.join(stands.join(members.select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), words), "sets")

    leaders = members.groupBy("bucket").agg(F.max("lead").alias("first"))
    star = members.select("node", "bucket").join(leaders, "bucket").groupBy("node").agg((-F.max("first")["minus"]).alias("first")).filter("node != first")
    components = connected_components(confirmed(star.select(F.col("node").alias("a"), F.col("first").alias("b")), sets, percent))
    pairs, members = _could_link(members, components, sets, percent)
    components = _joined(components, confirmed(pairs, sets, percent))
    tried = float("inf")
    while True:
        held = rename(members.withColumn("c", F.col("node")), "c", components)
        groups = held.groupBy("bucket", "c").agg(F.max("lead").alias("rep"), F.count("*").alias("k"))
        mixed = groups.groupBy("bucket").agg(F.max_by("c", "rep").alias("c0"), F.count("*").alias("cs"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("k2")).filter("cs > 1")
        mixed = stored(mixed, "mixed")
        left = mixed.agg(F.sum((F.col("n") * F.col("n") - F.col("k2")) / 2)).first()[0] or 0
        log.info("%s pairs share a bucket and no component", left)
        if not left:
            break
        if left <= many * n_classes + 1000 or left > 0.9 * tried:
            # every pair that shares a bucket and no component yet, each once
            rest = held.join(mixed.select("bucket"), "bucket").join(sets.drop("elements"), "node").select("bucket", "node", "c", "size", "cap", "n_el", *MAP)
            one, other = (rest.select("bucket", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("c", "size", "cap", "n_el", *MAP))) for x in ("a", "b"))
            pairs = one.join(other, "bucket").filter("c_a != c_b and a > b and size_a <= cap_b and size_b <= cap_a").filter(could_be_alike(percent)).select("a", "b").distinct()
            components = _joined(components, confirmed(pairs, sets, percent))
            break
        tried = left
        reps = groups.join(mixed.select("bucket", "c0"), "bucket").withColumn("rep", -F.col("rep.minus"))
        first = reps.filter("c = c0").select("bucket", F.col("rep").alias("b"))
        pairs = reps.filter("c != c0").join(first, "bucket").select(F.col("rep").alias("a"), "b").distinct()
        components = _joined(components, confirmed(pairs, sets, percent))

    named = classes.join(components, "node", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "node").alias("c"))
    out = sig.join(named, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2)
