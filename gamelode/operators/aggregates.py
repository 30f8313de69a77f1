"""Reports over columns: three percentile rules, distributions, duplicates, topic panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelode.operators.sampling import global_row_number
from gamelode.sources.scratch import stored


def value_at(df: DataFrame, col: str, places: dict[str, int]) -> dict:
    """Values at 0-based places of the sorted non-null column, by name; equal values may stand in any order."""
    wanted = df.sparkSession.createDataFrame([(k, v + 1) for k, v in places.items()], "name string, rn bigint")
    rows = global_row_number(df.select(col).filter(F.col(col).isNotNull()), [col]).join(F.broadcast(wanted), "rn").select("name", col).collect()  # a few named places
    return {r[0]: r[1] for r in rows}


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """n, min, int(median), mean to 1 decimal, p90, p99, max; a percentile is the value at min(n-1, int(q n)). The median keeps a
    count of each distinct value in one task, which is few for lengths."""
    base = df.agg(F.count(col).alias("n"), F.min(col).alias("min"), F.floor(F.percentile(col, F.lit(0.5))).alias("median"), F.round(F.avg(col), 1).alias("mean"), F.max(col).alias("max"))
    n = base.first()["n"]
    at = value_at(df, col, {p: min(n - 1, int(q * n)) for p, q in (("p90", 0.9), ("p99", 0.99))}) if n else {}
    return base.select("n", "min", "median", "mean", *(F.lit(at.get(p)).cast("bigint").alias(p) for p in ("p90", "p99")), "max")


def pct_round(df: DataFrame, col: str, percents: list[float]) -> DataFrame:
    """Third rule: the value at place round half even(p/100 (n-1))."""
    n = df.agg(F.count(col)).first()[0]
    at = value_at(df, col, {str(p): round(p / 100 * (n - 1)) for p in percents}) if n else {}
    return df.sparkSession.createDataFrame([(float(p), None if (v := at.get(str(p))) is None else float(v)) for p in percents], "p double, value double")


SKETCH_K = 800  #: of a quantile sketch: ranks are then right to about 0.4 % of the rows


def describe(df: DataFrame, col: str, groups: list[str], quantiles: list[float], exact: bool = True) -> DataFrame:
    """count, mean, sample deviation, min, linear quantiles, max. Exact quantiles keep a count of each distinct value of a group;
    exact=False takes mergeable quantile sketches (quantile_sketch), for groups with very many values."""
    q = [F.percentile(col, F.lit(p)) for p in quantiles] if exact else [sketched_quantile(F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(SKETCH_K)), p) for p in quantiles]
    return df.groupBy(*groups).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), *(c.alias(f"q{round(p * 100)}") for c, p in zip(q, quantiles, strict=True)), F.max(col).alias("max"))


def quantile_sketch(df: DataFrame, col: str, groups: list[str], k: int = SKETCH_K) -> DataFrame:
    """groups, sketch: a sketch (KLL) of a fixed size for each group, made in every task and merged. Sketches of parts are kept
    and merged later by merge_sketches(), so that new rows need no second look at old ones."""
    return df.groupBy(*groups).agg(F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantile(sketch: Column, p: float) -> Column:
    """The value whose rank is p, to the sketch's rank error; null for a group without values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))


def value_distribution(df: DataFrame, value: Column, missing: str = "missing") -> DataFrame:
    counts = df.groupBy(F.coalesce(value.cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def duplicate_audit(df: DataFrame, key: str, text: str, approximate: bool = False) -> DataFrame:
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.count_distinct(c))
    full = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.sha2(F.col(text), 256))
    return df.agg(
        F.count("*").alias("rows_in"), (F.count(key) - distinct(key)).alias("duplicate_ids"), (F.count(full) - distinct(full)).alias("duplicate_texts"),
        F.count_if(F.col(text).isNull()).alias("null_texts"), F.count_if(F.trim(F.col(text)) == "").alias("empty_texts"),
    )


def topic_counts(picked: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """picked: row_id, appid, polarity, topic. Per app, polarity and mapped topic the rows that name it; a topic that the
    mapping lacks stops the job."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    known = F.coalesce(pairs[F.col("topic")], F.raise_error(F.concat(F.lit("unknown topic "), F.col("topic"))))
    once = picked.select("row_id", "appid", "polarity", known.alias("topic")).distinct()
    return once.groupBy("appid", "polarity", "topic").agg(F.count("*").alias("n"))


def top_topics(counts: DataFrame, n: int = 3, other: str = "other") -> DataFrame:
    """The n most frequent topics of an app and polarity; `other` only where nothing else is."""
    group = Window.partitionBy("appid", "polarity")
    named = counts.withColumn("_k", F.count_if(F.col("topic") != other).over(group)).filter((F.col("topic") != other) | (F.col("_k") == 0))
    return named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("n"), "topic"))).filter(F.col("rank") <= n).drop("_k")


def topic_panel(rows: DataFrame, picked: DataFrame, mapping: dict[str, str], n: int = 3) -> DataFrame:
    """Per app: review_count, top topics and count maps (as ordered JSON) of both polarities; apps without topics stay."""
    counts = topic_counts(picked, mapping)
    tops = top_topics(counts, n)
    out = rows.groupBy("appid").agg(F.count_distinct("row_id").alias("review_count"))
    for p in ("positive", "negative"):
        entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "topic", "n")))
        maps = counts.filter(F.col("polarity") == p).groupBy("appid").agg(entries.alias("e"))
        maps = maps.select("appid", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["topic"], x["n"].cast("string"))), ",").alias(f"{p}_counts"))
        best = tops.filter(F.col("polarity") == p).groupBy("appid").agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("t"))
        best = best.select("appid", F.array_join(F.transform("t", lambda x: x["topic"]), ",").alias(f"top_{p}"))
        out = out.join(best, "appid", "left").join(maps, "appid", "left")
    return out.fillna("", [f"{x}{p}{y}" for p in ("positive", "negative") for x, y in (("top_", ""), ("", "_counts"))])


def pos_weights(scored: DataFrame, power: float = 0.5, cap: float = 10.0) -> DataFrame:
    """Per label clip((negatives / positives) ** power, 1, cap); a label without a positive stops the job."""
    c = scored.groupBy("label").agg(F.count_if("gold").alias("pos"), F.count_if(~F.col("gold")).alias("neg"))
    w = F.least(F.lit(cap), F.greatest(F.lit(1.0), F.pow(F.col("neg") / F.col("pos"), F.lit(power))))
    return c.withColumn("weight", F.when(F.col("pos") == 0, F.raise_error(F.concat(F.lit("no positive for "), F.col("label"))).cast("double")).otherwise(w))


def qc_rules(flags: DataFrame) -> DataFrame:
    """flags: hard, soft (arrays). How often each rule (a flag's part before the colon) was broken."""
    return flags.select(F.explode(F.concat("hard", "soft")).alias("r")).groupBy(F.substring_index("r", ":", 1).alias("rule")).agg(F.count("*").alias("n"))


def qc_summary(flags: DataFrame) -> DataFrame:
    """flags: hard, soft, overlap. One row: how many fail, are only doubtful, or are clean, and how the overlap is distributed
    (a percentile is the value at min(n-1, int(q n)))."""
    flags = stored(flags.select("hard", "soft", "overlap"), "flags")
    hard, soft = F.size("hard") > 0, F.size("soft") > 0
    base = flags.agg(
        F.count("*").alias("total"), F.count_if(hard).alias("hard_fail"), F.count_if(~hard & soft).alias("soft_only"), F.count_if(~hard & ~soft).alias("clean"), F.count_if(F.col("overlap") >= 0.5).alias("copied"),
        F.round(F.min("overlap"), 3).alias("min"), F.round(F.percentile("overlap", F.lit(0.5)), 3).alias("median"), F.round(F.avg("overlap"), 3).alias("mean"), F.round(F.max("overlap"), 3).alias("max"),
    )
    n = base.first()["total"]
    at = value_at(flags, "overlap", {p: min(n - 1, int(q * n)) for p, q in (("p90", 0.9), ("p99", 0.99))}) if n else {}
    shown = [F.round(F.lit(at.get(p)).cast("double"), 3).alias(p) for p in ("p90", "p99")]
    return base.select("total", "hard_fail", "soft_only", "clean", "copied", "min", "median", "mean", *shown, "max")
