"""Operator 12, source divergence audit: how far the word use of each (lang, source) group is from every other source of its
language, and which terms set it apart, by count-level bitmaps.

Terms are counted by Arrow batches within (lang, source) and added up by Spark, once per group and once per language; a
language keeps the terms of MIN_DOCS documents or more. The kept terms are dealt into blocks of terms of one order of
magnitude, by hash, so that a block has few different counts. A block holds, for each group and each count that occurs in
it, the bitset of the terms with that count; the terms that a group lacks are the complement of all its bitsets. AND and
popcount of two groups' bitsets give the number of terms in each joint cell, and that number times the cell's f is the
block's part of the pair's sum. What a task holds is one block and the sums of one language's pairs; beyond HELD_GROUPS
sources these are given out block by block. The pairs of a language's sources are the result itself: nothing else is
paired. Terms of a group are ranked in two steps, the first over SALTS parts of the group.

p = 1 + floor(10^9 (count + 1) / (N + V)) with N the occurrences of all V kept terms, f = floor((p - q)^2 / q). Sums of p
are at most 10^9 + V, which bounds every sum of f by its square: all of it is exact in 64 bits below 2 * 10^9 kept terms, and
p itself is found by long division (in blocks) or decimals, which no count can overflow.

Defined cases: a null text, lang or source counts as ''; rows that repeat an id are documents of their own; a group without
terms has count 0 for all; a language without kept terms has pairs of value 0 and no terms; equal values are ranked by
item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
HELD_TERMS = 200_000  #: distinct terms that a task counts before it gives them out
BLOCK, FINE_BLOCK, FINE_FROM = 1024, 64, 9  #: terms in a block; from so many bits of the count on the smaller number
HELD_GROUPS, SALTS, SMALL_ROWS = 1024, 16, 100_000
CELLS_AT_A_TIME = 1 << 21

#: A-Z in lower case, other characters that are not part of a term become spaces; what lies above 7F is part of one
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """docs: lang, source, text (no nulls). lang, source, term, n (occurrences), docs (documents that have it)."""

    def given(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, within) in counts.items():
            terms = list(n)
            m = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(within.__getitem__, terms), pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.translate(_TERM_BYTES).split()
                if words:
                    n, within = counts.setdefault((lang, source), (Counter(), Counter()))
                    n.update(words)
                    within.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > HELD_TERMS:
                yield from given(counts)
                counts = {}
        yield from given(counts)

    found = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def keep_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, n, uses (array of source and n): the terms of min_docs or more documents of a language."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return by_term.filter(F.col("docs") >= min_docs).drop("docs")


def share(count: str, total: str, kept: str) -> Column:
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0)) div cast({total} + {kept} as decimal(20,0))")


def few(df: DataFrame) -> DataFrame:
    """df, for every task if it is counted to have at most SMALL_ROWS rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """share() by long division, in steps of three digits."""
    of = total + kept
    whole, rest = np.divmod(count + 1, of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return whole + 1


def joint_sums(source: np.ndarray, term: np.ndarray, count: np.ndarray, totals: np.ndarray, n_terms: int, kept: int) -> Iterator[tuple[int, np.ndarray]]:
    """(source a, sum of f of a against each source) for one block; source, term and count are its non-zero counts. A source
    comes more than once."""
    if not n_terms:
        return
    n_sources, words = len(totals), (n_terms + 63) // 64
    by_level = np.lexsort((count, source))
    s, c = source[by_level], count[by_level]
    new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))[: len(s)]
    bits = np.zeros((int(new.sum()), words * 64), dtype=bool)
    bits[np.cumsum(new) - 1, term[by_level]] = True
    zero = np.zeros((n_sources, words * 64), dtype=bool)
    zero[:, :n_terms] = True
    zero[source, term] = False  # the complement of all levels of a source
    group, level = np.concatenate([s[new], np.arange(n_sources)]), np.concatenate([c[new], np.zeros(n_sources, dtype=np.int64)])
    maps = np.packbits(np.concatenate([bits, zero]), axis=1).view(np.uint64)
    order = np.argsort(group, kind="stable")
    group, level, maps = group[order], level[order], maps[order]
    p = _shares(level, totals[group], kept)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    step = max(1, CELLS_AT_A_TIME // (len(maps) * words))
    for at in range(0, len(maps), step):
        cells = np.bitwise_count(maps[at : at + step, None, :] & maps[None, :, :]).sum(axis=2, dtype=np.int64)
        apart = p[at : at + step, None] - p[None, :]
        sums = np.add.reduceat(cells * (apart * apart // p[None, :]), first, axis=1)
        for k, row in enumerate(sums):
            yield int(group[at + k]), row


def pair_sums(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item, value: the summed f of each pair of a language's sources, from blocks of its kept terms."""
    magnitude = F.length(F.bin("n"))
    wide = F.when(F.col("magnitude") >= FINE_FROM, FINE_BLOCK).otherwise(BLOCK)
    sized = stored(kept.groupBy("lang", magnitude.alias("magnitude")).agg(F.count("*").alias("_terms")).withColumn("slots", F.ceil(F.col("_terms") / wide)).drop("_terms"), "audit-slots")
    slot = F.pmod(F.xxhash64("term"), F.col("slots"))
    terms = kept.withColumn("magnitude", magnitude).join(few(sized), ["lang", "magnitude"]).select("lang", "magnitude", slot.alias("slot"), F.lit(1).alias("place"), F.lit(None).cast("bigint").alias("kept"), "uses")
    groups = stats.groupBy("lang").agg(F.max("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("source", F.col("total").alias("n")))).alias("uses"))
    heads = sized.select("lang", "magnitude", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("slot")).join(groups, "lang").select("lang", "magnitude", "slot", F.lit(0).alias("place"), "kept", "uses")
    blocks = heads.union(terms).repartition("lang", "magnitude", "slot").sortWithinPartitions("lang", "magnitude", "slot", "place").select("lang", "place", "kept", "uses")

    def given(lang: str, sources: list[str], a: int, values: np.ndarray) -> pa.RecordBatch:
        other = np.flatnonzero(np.arange(len(sources)) != a)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(other), pa.string()), pa.array([sources[a]] * len(other), pa.string()), pa.array(sources, pa.string()).take(pa.array(other)), pa.array(values[other], pa.int64())], names=["lang", "source", "item", "value"]
        )

    def one_block(rows: pa.Table) -> tuple[str, list[str], Iterator[tuple[int, np.ndarray]]]:
        rows = rows.combine_chunks()
        uses = rows.column("uses").combine_chunks()
        sizes, flat = uses.value_lengths().to_numpy(), uses.flatten()
        m = int(sizes[0])
        names, n = flat.field("source"), flat.field("n").to_numpy()
        sources = names.slice(0, m)
        term = np.repeat(np.arange(len(sizes) - 1), sizes[1:])
        source = pc.index_in(names.slice(m), value_set=sources).to_numpy().astype(np.int64)
        return rows.column("lang")[0].as_py(), sources.to_pylist(), joint_sums(source, term, n[m:], n[:m], len(sizes) - 1, rows.column("kept")[0].as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sources, held = None, [], None

        def take(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal of, sources, held
            lang, names, sums = one_block(pa.Table.from_batches(parts))
            if lang != of:
                if held is not None:
                    yield from (given(of, sources, a, held[a]) for a in range(len(held)))
                of, sources, held = lang, names, np.zeros((len(names), len(names)), dtype=np.int64) if len(names) <= HELD_GROUPS else None
            for a, row in sums:
                if held is None:
                    yield given(lang, names, a, row)
                else:
                    held[a] += row

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            for head in np.flatnonzero(batch.column(1).to_numpy() == 0):
                parts += [batch.slice(at, head - at)] if head > at else []
                if parts:
                    yield from take(parts)
                parts, at = [], head
            parts.append(batch.slice(at))
        if parts:
            yield from take(parts)
        if held is not None:
            yield from (given(of, sources, a, held[a]) for a in range(len(held)))

    return blocks.mapInArrow(run, "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value bigint, rank int."""
    named = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    docs = docs.select(named(lang_col, "lang"), named(source_col, "source"), named(text_col, "text"))
    kept = stored(keep_terms(count_terms(docs), min_docs), "audit-terms")
    uses = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("uses").alias("_u")).select("lang", "term", "lang_n", "_u.source", "_u.n")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    of_group = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left")
    stats = stored(groups.na.fill(0, ["kept", "lang_total", "total"]), "audit-groups")

    seen = uses.join(few(stats), ["lang", "source"]).withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")}).filter("p > q")
    seen = seen.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    best = [F.desc("value"), F.asc("item")]
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(*best)
    some = seen.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top_terms)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))
    terms = some.withColumn("rank", ranked).filter(F.col("rank") <= top_terms)

    bare = stats.filter("kept = 0").select("lang", "source")
    nothing = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    pairs = pair_sums(kept, stats).union(nothing).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked)
    return pairs.union(terms)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as a from documents),
t as (select r, lang, source, unnest(a) as term from d),
kept as (select lang, term, count(*) as lang_n from t group by 1, 2 having count(distinct r) >= {MIN_DOCS}),
c as (select t.lang, t.source, t.term, count(*) as n from t join kept k on k.lang = t.lang and k.term = t.term group by 1, 2, 3),
g as (select d.lang, d.source, coalesce(any_value(v.kept), 0) as kept, coalesce(any_value(v.lang_total), 0) as lang_total, coalesce(any_value(s.total), 0) as total
 from (select distinct lang, source from d) d left join (select lang, count(*) as kept, sum(lang_n) as lang_total from kept group by 1) v on v.lang = d.lang
 left join (select lang, source, sum(n) as total from c group by 1, 2) s on s.lang = d.lang and s.source = d.source group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + {SCALE}::hugeint * (coalesce(c.n, 0) + 1) // (g.total + g.kept) as p,
 1 + {SCALE}::hugeint * (k.lang_n + 1) // (g.lang_total + g.kept) as q
 from g join kept k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
 from p a join p b on b.lang = a.lang and b.term = a.term where a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
 from g a join g b on b.lang = a.lang and b.source <> a.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
