"""Decisions on rows: keyword rules, priorities among sources, answers held against candidates, and judges' scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gamelode.functions.hashing import hash_order
from gamelode.operators.ranking import rank_rows, topk_per_group
from gamelode.operators.sampling import global_row_number

Rules = tuple[tuple[str, tuple[str, ...]], ...]


def classify_by_keyword(df: DataFrame, name: str, rules: Rules, out: str = "decision") -> DataFrame:
    """The decision of the first rule one of whose words the name holds; a name without any stops the job. rules are few and
    become one expression."""
    decision: Column | None = None
    for label, words in rules:
        for w in words:
            test = F.contains(F.col(name), F.lit(w))
            decision = F.when(test, label) if decision is None else decision.when(test, label)
    unmatched = F.raise_error(F.concat(F.lit("no rule for "), F.coalesce(F.col(name), F.lit("null")))).cast("string")
    return df.withColumn(out, unmatched if decision is None else decision.otherwise(unmatched))


def priority_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first table, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def ground(told: DataFrame, candidates: DataFrame, keys: list[str], item: str, place: str, k: int) -> DataFrame:
    """told: keys, item, place; candidates: the same. What was told and is a candidate, in the order told, then the other
    candidates in theirs; k of each group: keys, item, is_told, rank. Made-up items are dropped, repeated ones count once."""
    once = lambda d: d.groupBy(*keys, item).agg(F.min(place).alias("_at"))
    known = once(told.join(candidates.select(*keys, item).distinct(), [*keys, item], "left_semi")).withColumn("is_told", F.lit(True))
    rest = once(candidates).join(known.select(*keys, item), [*keys, item], "left_anti").withColumn("is_told", F.lit(False))
    return topk_per_group(known.unionByName(rest), keys, [F.desc("is_told"), F.col("_at"), F.col(item)], k).drop("_at")


def variant_corpus(base: DataFrame, changes: DataFrame, key: str, value: str, names: list[str]) -> DataFrame:
    """The base once for each name of a variant, with the value that changes (variant, key, value) has for it, if any."""
    copies = base.withColumn("variant", F.explode(F.array(*map(F.lit, names))))
    put = changes.select("variant", key, F.col(value).alias("_new"), F.lit(True).alias("_put"))
    return copies.join(put, ["variant", key], "left").withColumn(value, F.when(F.col("_put"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_put")


def first_hit(ranked: DataFrame, allowed: DataFrame, group: str, item: str, rank: str = "rank", depth: int = 50) -> DataFrame:
    """The best-ranked item of each group, among its first `depth`, that is allowed."""
    return ranked.filter(F.col(rank) <= depth).join(allowed.select(item), item, "left_semi").groupBy(group).agg(F.min_by(item, rank).alias(item))


def partner_results(df: DataFrame, key: str, ids: str) -> DataFrame:
    """ids: a JSON list as text. Its whole numbers in order, ranked from 1: key, appid, rank, text (empty)."""
    rows = df.select(key, F.posexplode(F.from_json(ids, "array<string>")).alias("_pos", "_v")).withColumn("appid", F.expr("try_cast(_v as bigint)")).filter("appid is not null")
    return rank_rows(rows, [key], ["_pos"]).select(key, "appid", F.col("rank").cast("bigint").alias("rank"), F.lit("").alias("text"))


def judge_tiers(scores: DataFrame, axes: list[str], verdict: str = "verdict") -> DataFrame:
    """tier: critical with a 0 on any axis, minor with a 1 or the verdict review, else auto."""
    least = F.least(*axes)
    return scores.withColumn("tier", F.when(least == 0, "critical").when((F.col(verdict) == "review") | (least == 1), "minor").otherwise("auto"))


def review_queue(tiered: DataFrame, axes: list[str], key: str, audit: int = 60, seed: int | str = 42) -> DataFrame:
    """What people look at: every critical row, lowest score first, then a sample of the minor ones in hash order. Adds place."""
    critical = tiered.filter("tier = 'critical'").withColumns({"_a": F.least(*axes).cast("string"), "_b": F.lit("")})
    minor = tiered.filter("tier = 'minor'").orderBy(hash_order(seed, key), key).limit(audit).withColumns({"_a": F.lit("9"), "_b": hash_order(seed, key)})
    return global_row_number(critical.unionByName(minor), ["_a", "_b", key], "place").drop("_a", "_b")


def score_distribution(scores: DataFrame, axes: list[str]) -> DataFrame:
    """axis, score, n."""
    long = scores.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("score")) for a in axes))).alias("x"))
    return long.groupBy("x.axis", "x.score").agg(F.count("*").alias("n"))


def marker_targets(df: DataFrame, key: str, text: str, markers: tuple[str, ...], critical: DataFrame) -> DataFrame:
    """Rows whose text has any of the markers, as plain text, and whose key is not among the critical ones."""
    has = F.lit(False)
    for m in markers:
        has = has | F.contains(F.col(text), F.lit(m))
    return df.filter(F.coalesce(has, F.lit(False))).join(critical.select(key), key, "left_anti")


def fixes_of(judged: DataFrame, key: str, before: str = "before", after: str = "after", supported: str = "supported") -> DataFrame:
    """judged: key, before, after, supported (null where there is no verdict). What is to be put in: rewrites of texts that are not
    supported, if they are neither blank nor what stood there."""
    changed = ~F.col(supported) & (F.trim(F.coalesce(after, F.lit(""))) != "") & ~F.col(after).eqNullSafe(F.col(before))
    return judged.filter(F.coalesce(changed, F.lit(False))).select(key, F.col(after).alias("text"))


def fix_report(judged: DataFrame, key: str, before: str = "before", after: str = "after", supported: str = "supported") -> DataFrame:
    """One row: targets, supported, unsupported, applied_fixes."""
    applied = fixes_of(judged, key, before, after, supported).agg(F.count("*").alias("applied_fixes"))
    counts = judged.agg(F.count("*").alias("targets"), F.count_if(F.col(supported)).alias("supported"), F.count_if(~F.col(supported)).alias("unsupported"))
    return counts.crossJoin(F.broadcast(applied))  # one row each
