"""Operator 11, conversation prefix trie: the shared beginnings of conversations, by adaptive radix trees.

A turn's id is 16 bytes of the digest of its role and text, so the ids of a conversation's turns, end to end, are a key of
fixed-width steps. Texts never travel: a turn is shuffled as its id and its number of words. Keys are dealt out in order of
(key, conv_id), so that a first turn that a third of all conversations share, or one conversation in a million copies, is
spread over many tasks. Each task puts its keys into one adaptive radix tree (inner nodes of 4, 16, 48 or 256 places, grown
when full, with compressed paths), and gives out a trie node wherever a byte depth is a whole number of turns.

A node that another task may have too is a beginning of the task's first or last key: these few are the task's seam. All
others are complete where they are. What the seams hold is added up by node; subtree sums over the seam nodes, whose own
ancestors are seam nodes, go up by jumps of doubled length. Ids that end in a seam node come in ordered pieces, which are
hashed one after the other as they stream by: a digest of one text has no other way, but nothing of it is held.

A task holds TURNS_IN_TASK turns (a key and a few numbers for each), besides one whole key: 16 bytes for each turn of the
longest conversation.

Defined cases: rows without conv_id belong to no conversation and are left out; a null role or text counts as ''; null
turns come first and repeated turns in the order of their ids; rows that repeat a turn are turns of their own; % has the
sign of its first operand; a conversation without turns ends in the root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

STEP = 16  #: bytes of a turn's id
BLOCK, HEADS = 20, 4
TURNS_IN_TASK, ROWS_AT_A_TIME, IDS_IN_PIECE, SMALL_ROWS = 500_000, 10_000, 500, 200_000
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Node:
    """An inner node or leaf: path leads to it from its parent, kids lie in a layout of `places` places."""

    __slots__ = ("path", "rep", "ends", "places", "keys", "kids")

    def __init__(self, path: bytes, rep: int):
        self.path, self.rep, self.ends = path, rep, []
        self.places, self.keys, self.kids = 4, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.places <= 16:  # keys in order beside their kids
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.places == 48:  # keys: the place of each byte's kid, from 1
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        if self.find(byte) is not None:
            self.kids[self.keys.find(byte) if self.places <= 16 else self.keys[byte] - 1 if self.places == 48 else byte] = kid
            return
        if self.places < 256 and len(self.kids) == self.places:
            self._grow()
        if self.places <= 16:
            at = bisect(self.keys, byte)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.places == 48:
            self.kids.append(kid)
            self.keys[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.keys):
                index[byte] = at + 1
            self.places, self.keys = 48, index
        else:
            self.places, self.kids, self.keys = 256, [self.kids[at - 1] if at else None for at in self.keys], bytearray()

    def in_order(self) -> list[Node]:
        if self.places <= 16:
            return self.kids
        return [self.kids[at - 1] for at in self.keys if at] if self.places == 48 else [k for k in self.kids if k is not None]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes of a and of b from `at` are the same."""
    if b.startswith(a, at):
        return len(a)
    n, most = 0, min(len(a), len(b) - at)
    while n + 64 <= most and a[n : n + 64] == b[at + n : at + n + 64]:
        n += 64
    while n < most and a[n] == b[at + n]:
        n += 1
    return n


def insert(root: Node, key: bytes, rep: int, conv_id: int) -> None:
    node, at = root, 0
    while at < len(key):
        kid = node.find(key[at])
        if kid is None:
            kid = Node(key[at:], rep)
            node.put(key[at], kid)
            node = kid
            break
        n = common(kid.path, key, at)
        if n < len(kid.path):
            mid = Node(kid.path[:n], kid.rep)
            kid.path = kid.path[n:]
            mid.put(kid.path[0], kid)
            node.put(key[at], mid)
            kid = mid
        node, at = kid, at + n
    node.ends.append(conv_id)


def beginnings(key: bytes) -> list[bytes]:
    """The digest of each turn-aligned beginning of a key, from the empty one."""
    h, out = hashlib.sha256(), []
    for at in range(0, len(key) + 1, STEP):
        out.append(h.copy().digest()[:STEP])
        h.update(key[at : at + STEP])
    return out


NODE, SEAM, PIECE = 0, 1, 2
FIELDS = "kind int, id binary, parent_id binary, conv_id bigint, depth bigint, parent_conv_id bigint, words bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"


def trie_rows(keys: list[bytes], words: list[np.ndarray], conv_ids: list[int]) -> Iterator[tuple]:
    """Rows of FIELDS for keys in order of (key, conv_id). A seam node has what hangs on it outside the seam."""
    root = Node(b"", 0)
    for rep, (key, conv_id) in enumerate(zip(keys, conv_ids, strict=True)):
        insert(root, key, rep, conv_id)
    first, last = keys[0], keys[-1]
    ids_first, ids_last = beginnings(first), beginnings(last)

    # from the root down: place of the parent, byte depths of begin and end, turns on the seam
    order, parent, begin, seam = [root], [-1], [-1], [0]
    at = 0
    while at < len(order):
        node, end = order[at], begin[at] + (len(order[at].path) if at else 1)
        for kid in node.in_order():
            key, depth = keys[kid.rep], seam[at]
            if depth * STEP >= end - STEP:  # else the seam has ended above
                depth = max(common(first, key), common(last, key)) // STEP
            order.append(kid)
            parent.append(at)
            begin.append(end)
            seam.append(min(depth, (end + len(kid.path)) // STEP))
        at += 1
    # from the leaves up: members, least member, and the sums of what lies below
    m = len(order)
    count, least = [len(n.ends) for n in order], [n.ends[0] if n.ends else None for n in order]
    kids, leaves, saved = [0] * m, [0] * m, [0] * m
    own: list[list[tuple[int, int, int, int]]] = [[]] * m
    for at in range(m - 1, -1, -1):
        node, end = order[at], begin[at] + (len(order[at].path) if at else 1)
        fr, lv, sv, mine = kids[at], leaves[at], saved[at], []
        for t in range(end // STEP, begin[at] // STEP, -1):  # of the root: 0 alone
            if t > seam[at]:
                lv, sv = lv if fr else 1, sv + (count[at] - 1) * int(words[node.rep][t - 1])
            mine.append((t, fr, lv, sv))
            fr, lv, sv = (1, lv, sv) if t > seam[at] else (0, 0, 0)
        own[at] = mine[::-1]
        if at:
            up = parent[at]
            count[up] += count[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
            kids[up], leaves[up], saved[up] = kids[up] + fr, leaves[up] + lv, saved[up] + sv
    above: list[int] = [0] * m  # the place of the nearest tree node at or above that has a turn-aligned depth
    for at, node in enumerate(order):
        before = above[parent[at]] if at else 0
        end = begin[at] + (len(node.path) if at else 1)
        ids = None
        for t, fr, lv, sv in own[at]:
            ends = node.ends if t * STEP == end else []
            if t <= seam[at]:
                ids = ids or (ids_first if common(first, keys[node.rep]) >= t * STEP else ids_last)
                yield SEAM, ids[t], ids[t - 1] if t else None, least[at], t, None, int(words[node.rep][t - 1]) if t else 0, count[at], fr, lv, sv, None
                for k in range(0, len(ends), IDS_IN_PIECE):
                    yield PIECE, ids[t], None, ends[k], t, None, None, None, None, None, None, ",".join(map(str, ends[k : k + IDS_IN_PIECE]))
            else:
                on_seam = t - 1 <= seam[at]
                # the turn before is in this tree node's own path, or the last one of the tree node above
                up = None if on_seam else least[at] if t - 1 > begin[at] // STEP else least[before]
                up_id = ids_of(first, last, ids_first, ids_last, keys[node.rep], t - 1) if on_seam else None
                digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else NO_ENDS
                yield NODE, None, up_id, least[at], t, up, None, count[at], fr, lv, sv, digest
        above[at] = at if own[at] else before


def ids_of(first: bytes, last: bytes, ids_first: list[bytes], ids_last: list[bytes], key: bytes, t: int) -> bytes:
    return ids_first[t] if common(first, key) >= t * STEP else ids_last[t]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id, words: what is needed of a turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 2 * STEP)).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words"))


def rebuild(turns: DataFrame) -> DataFrame:
    """conv_id, key, words (32-bit numbers end to end): each conversation with the first crc32(conv_id) % HEADS turns taken from
    the first of its block of BLOCK. A block is sorted so that this one comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((block, conv_id, id, n) for batch in batches for block, conv_id, id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple[int, bytes, bytes]] = []
        base, base_turns = None, []
        for (block, conv_id), turns in groupby(rows, key=itemgetter(0, 1)):
            turns = [(id, n) for _, _, id, n in turns]
            if conv_id == block:
                base, base_turns = block, turns[: HEADS - 1]
            h = zlib.crc32(str(conv_id).encode()) % HEADS
            made = (base_turns[:h] if base == block else []) + turns[h:]
            out.append((conv_id, b"".join(id for id, _ in made), np.array([n for _, n in made], dtype=np.int32).tobytes()))
            if len(out) == 1000:
                yield given(out)
                out = []
        if out:
            yield given(out)

    def given(out: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["conv_id", "key", "words"])

    placed = turns.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).repartition("block")
    placed = placed.sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.asc_nulls_first("turn"), "id")
    return placed.select("block", "conv_id", "id", "words").mapInArrow(run, "conv_id bigint, key binary, words binary")


def tries(rebuilt: DataFrame, parts: int) -> DataFrame:
    """Rows of FIELDS from one tree for each range of the keys."""
    types = [{"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]] for f in FIELDS.split(", ")]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, conv_ids = [], [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            conv_ids += batch.column(1).to_pylist()
            words += [np.frombuffer(w, dtype=np.int32) for w in batch.column(2).to_pylist()]
        rows: list[tuple] = []
        for row in trie_rows(keys, words, conv_ids) if keys else ():
            rows.append(row)
            if len(rows) == ROWS_AT_A_TIME:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    dealt = rebuilt.select("key", "conv_id", "words").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(run, FIELDS)


def ends_digests(pieces: DataFrame) -> DataFrame:
    """id, ends_sha256: the pieces of each seam node's ids, in order, as one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, h = None, None
        for batch in batches:
            ids, out = [], []
            for id, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if id != of:
                    if of is not None:
                        ids.append(of)
                        out.append(h.hexdigest())
                    of, h = id, hashlib.sha256(piece.encode())
                else:
                    h.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], names=["id", "ends_sha256"])
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["id", "ends_sha256"])

    return pieces.repartition("id").sortWithinPartitions("id", "conv_id").select("id", "ends").mapInArrow(run, "id binary, ends_sha256 string")


def seam_nodes(rows: DataFrame) -> DataFrame:
    """id, conv_id, depth, parent_id, n_convs, n_children, n_leaves, saved_tokens: the nodes of all seams, complete."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    seams = stored(rows.filter(F.col("kind") == SEAM).groupBy("id").agg(F.max("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"), *sums), "trie-seams")
    more = seams.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("_more"))
    whole = seams.join(more, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    whole = whole.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
    whole = stored(whole.drop("_more", "words"), "trie-seams")
    up = whole.select("id", F.col("parent_id").alias("to"), "n_leaves", "saved_tokens")  # sums over the next 2^k generations; to: the node 2^k above
    while up.filter("to is not null").limit(1).count():
        below = up.filter("to is not null").groupBy(F.col("to").alias("id")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        on = up.select(F.col("id").alias("to"), F.col("to").alias("_to"))
        added = up.join(below, "id", "left").join(on, "to", "left")
        up = stored(added.select("id", F.col("_to").alias("to"), (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_s", F.lit(0))).alias("saved_tokens")), "trie-seams")
    return whole.drop("n_leaves", "saved_tokens").join(up.drop("to"), "id")


def prefix_trie(conversations: DataFrame, turns_in_task: int = TURNS_IN_TASK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    rebuilt = stored(rebuild(turn_ids(conversations)), "trie-keys")
    turns = rebuilt.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    parts = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // (STEP * turns_in_task)))
    rows = stored(tries(rebuilt, parts), "trie-rows")
    seams = stored(seam_nodes(rows), "trie-seams")
    at = seams.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("_up"))
    at = F.broadcast(at) if seams.count() <= SMALL_ROWS else at
    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = rows.filter(F.col("kind") == NODE).join(at, "parent_id", "left")
    inner = inner.select("conv_id", "depth", F.coalesce("parent_conv_id", "_up").alias("parent_conv_id"), *numbers, F.col("ends").alias("ends_sha256"))
    outer = seams.join(at, "parent_id", "left").join(ends_digests(rows.filter(F.col("kind") == PIECE)), "id", "left")
    return inner.union(outer.select("conv_id", "depth", F.col("_up").alias("parent_conv_id"), *numbers, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLE = f"""
with crc as (select list(v order by k) as tab from (select k, list_reduce(list_prepend(k::bigint, range(8)), lambda x, i : case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v from range(256) r(k))),
turns as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as n,
 md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as w
 from conversations where conv_id is not null),
own as (select c, list(id order by n) as ids, list(w order by n) as ws from turns group by c),
heads as (select own.*, c - c % {BLOCK} as b, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(c::varchar) + 1), lambda i : ascii(substr(c::varchar, i::integer, 1))::bigint)),
 lambda x, y : xor(x >> 8, crc.tab[(xor(x, y) & 255) + 1])), 4294967295) % {HEADS} as h from own, crc),
rebuilt as (select a.c, list_concat(coalesce(b.ids, [])[:a.h], a.ids[a.h + 1:]) as ids, list_concat(coalesce(b.ws, [])[:a.h], a.ws[a.h + 1:]) as ws from heads a left join own b on b.c = a.b),
prefixes as (select c, d, len(ids) = d as at_end, array_to_string(ids[:d], '') as key, ws[d] as w from (select *, unnest(range(0, len(ids) + 1)) as d from rebuilt)),
nodes as (select d, key, min(c) as c, count(*) as n, any_value(w) as w, coalesce(string_agg(c::varchar, ',' order by c) filter (where at_end), '') as ends from prefixes group by d, key),
kids as (select d - 1 as d, left(key, 32 * (d - 1)::integer) as key, count(*) as n from nodes where d > 0 group by 1, 2),
full_nodes as (select n.*, coalesce(k.n, 0) as kids from nodes n left join kids k on k.d = n.d and k.key = n.key),
sums as (select p.d, p.key, sum((f.kids = 0)::integer) as leaves, sum((f.n - 1) * coalesce(f.w, 0)) as saved from full_nodes f join prefixes p on p.c = f.c and p.d <= f.d group by 1, 2)
select f.c as conv_id, f.d::bigint as depth, u.c as parent_conv_id, f.n as n_convs, f.kids::bigint as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(f.ends) as ends_sha256
from full_nodes f join sums s on s.d = f.d and s.key = f.key left join nodes u on f.d > 0 and u.d = f.d - 1 and u.key = left(f.key, 32 * (f.d - 1)::integer)
"""
