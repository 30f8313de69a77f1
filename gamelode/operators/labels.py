"""Multi-label evaluation over long tables (row_id, label, gold boolean, predicted boolean)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelode.functions import text as T


def probability(logit: str = "logit") -> Column:
    return 1 / (1 + F.exp(-F.col(logit)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def per_label(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    g, p = F.col("gold"), F.col("predicted")
    c = df.groupBy(*keys, "label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return c.withColumns({"support": F.col("tp") + F.col("fn"), "n_predicted": F.col("tp") + F.col("fp"), "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": f1(F.col("tp"), F.col("fp"), F.col("fn"))})


def multilabel_metrics(df: DataFrame, keys: list[str] = (), gold_only: bool = False) -> DataFrame:
    """Micro and macro scores, exact match, labels for each row. Macro: mean over all labels, or over those in gold."""
    lab = per_label(df, keys)
    lab = lab.filter("support > 0") if gold_only else lab
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    micro = lab.groupBy(*keys).agg(
        _ratio(tp, tp + fp).alias("micro_precision"), _ratio(tp, tp + fn).alias("micro_recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.count_if(F.col("n_predicted") > 0).alias("types_predicted"),
    )
    rows = df.groupBy(*keys, "row_id").agg(F.every(F.col("gold") == F.col("predicted")).alias("same"), F.count_if("predicted").alias("k"))
    rows = rows.groupBy(*keys).agg(F.avg(F.col("same").cast("int")).alias("exact"), F.avg("k").alias("labels_per_row"))
    return micro.join(rows, list(keys)) if keys else micro.crossJoin(F.broadcast(rows))


def threshold_sweep(scored: DataFrame, low: int = 5, high: int = 50) -> DataFrame:
    """Metrics at thresholds low/100 .. high/100 without a copy of the rows for each: probabilities fall into steps, one
    histogram for each label, and reverse running sums give the counts at every threshold. Exact match: a row is right at
    the thresholds above its largest wrong and up to its smallest right probability."""
    spark = scored.sparkSession
    p = probability()
    step = F.least(F.lit(high), F.floor(p * 100 + F.lit(1e-9)).cast("int"))
    hist = scored.groupBy("label", step.alias("step")).agg(F.count_if("gold").alias("g"), F.count_if(~F.col("gold")).alias("n"))
    grid = scored.select("label").distinct().crossJoin(F.broadcast(spark.range(0, high + 1).select(F.col("id").cast("int").alias("step"))))
    full = grid.join(hist, ["label", "step"], "left").fillna(0, ["g", "n"])
    down = Window.partitionBy("label").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    counts = full.withColumns({"tp": F.sum("g").over(down), "fp": F.sum("n").over(down), "pos": F.sum("g").over(Window.partitionBy("label"))}).filter(F.col("step") >= low)
    fn = F.col("pos") - F.col("tp")
    tp, fp, fns = F.sum("tp"), F.sum("fp"), F.sum(fn)
    micro = counts.groupBy("step").agg(_ratio(2 * tp, 2 * tp + fp + fns).alias("micro_f1"), F.avg(f1(F.col("tp"), F.col("fp"), fn)).alias("macro_f1"))
    rows = scored.groupBy("row_id").agg(F.coalesce(F.max(F.when(~F.col("gold"), step)), F.lit(-1)).alias("wrong"), F.coalesce(F.min(F.when(F.col("gold"), step)), F.lit(high)).alias("right"))
    total = rows.agg(F.count("*").alias("rows"))
    spans = rows.select(F.greatest(F.col("wrong") + 1, F.lit(low)).alias("a"), F.least("right", F.lit(high)).alias("b")).filter("a <= b").groupBy("a", "b").agg(F.count("*").alias("k"))
    hits = spans.select(F.explode(F.sequence("a", "b")).alias("step"), "k").groupBy("step").agg(F.sum("k").alias("exact_rows"))
    out = micro.join(hits, "step", "left").crossJoin(F.broadcast(total))
    return out.select((F.col("step") / 100).alias("threshold"), "micro_f1", "macro_f1", (F.coalesce("exact_rows", F.lit(0)) / F.col("rows")).alias("exact"))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """Of a sweep's rows: by (micro_f1, macro_f1), threshold, and both scores at it. The least threshold wins a tie."""
    parts = [sweep.agg(F.max_by(F.struct("threshold", "micro_f1", "macro_f1"), F.struct(F.col(by), -F.col("threshold"))).alias("x")).select(F.lit(by).alias("by"), "x.*") for by in ("micro_f1", "macro_f1")]
    return parts[0].unionByName(parts[1])


def rouge_n(pred: Column, ref: Column, n: int) -> dict[str, Column]:
    """Clipped n-gram overlap of two token arrays: match, p, r, f."""
    grams = lambda a: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a) - n + 1)), lambda i: F.array_join(F.slice(a, i, n), " "))).otherwise(F.array().cast("array<string>"))
    pg, rg = grams(pred), grams(ref)
    match = F.aggregate(F.array_intersect(pg, rg), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(pg, lambda y: y == x)), F.size(F.filter(rg, lambda y: y == x))))
    p, r = _ratio(match, F.size(pg)), _ratio(match, F.size(rg))
    return {"match": match, "p": p, "r": r, "f": _ratio(2 * p * r, p + r)}


def rouge_n_table(pairs: DataFrame, keys: list[str], n: int, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """The same for long texts: n-grams of both sides exploded, counted, and their smaller counts added."""

    def side(col: str, name: str) -> DataFrame:
        tokens = pairs.select(*keys, T.tokenize(col).alias("a"))
        grams = tokens.select(*keys, F.explode(F.when(F.size("a") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("a") - n + 1)), lambda i: F.array_join(F.slice("a", i, n), " ")))).alias("g"))
        return grams.groupBy(*keys, "g").agg(F.count("*").alias(name))

    both = side(pred, "x").join(side(ref, "y"), [*keys, "g"], "full")
    sums = both.groupBy(*keys).agg(F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("m"), F.coalesce(F.sum("x"), F.lit(0)).alias("x"), F.coalesce(F.sum("y"), F.lit(0)).alias("y"))
    out = pairs.select(*keys).join(sums, keys, "left").fillna(0, ["m", "x", "y"])
    p, r = _ratio(F.col("m"), F.col("x")), _ratio(F.col("m"), F.col("y"))
    return out.select(*keys, p.alias("p"), r.alias("r"), _ratio(2 * p * r, p + r).alias("f"))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of token arrays: for each token of a, where it stands in b, from the last place
    to the first; the longest increasing chain of these places is as long. The chain's state is, for each length, the least
    place that such a chain can end with."""
    places = F.transform(a, lambda x: F.reverse(F.filter(F.transform(b, lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull())))

    def put(ends: Column, at: Column) -> Column:
        n = F.size(F.filter(ends, lambda e: e < at))
        return F.concat(F.slice(ends, F.lit(1), n), F.array(at), F.slice(ends, n + 2, F.greatest(F.lit(0), F.size(ends) - n - 1)))

    return F.size(F.aggregate(F.flatten(places), F.array().cast("array<int>"), put))


def rouge_l(pred: Column, ref: Column, lcs: Column | None = None) -> dict[str, Column]:
    """lcs: a column that has lcs_length() already, so that the three measures share it."""
    lcs = lcs_length(pred, ref) if lcs is None else lcs
    p, r = _ratio(lcs, F.size(pred)), _ratio(lcs, F.size(ref))
    return {"p": p, "r": r, "f": _ratio(2 * p * r, p + r)}


def summary_report(pairs: DataFrame, keys: list[str], checks: dict[str, Column], pred: str = "pred", gold: str = "gold", lcs: bool = True) -> DataFrame:
    """pairs: keys, and the structs pred and gold of the same text fields; one row for each gold summary, pred null where it has
    none. Rows of metric and value, to four places: how many were scored and lack a prediction, the mean scores of the whole
    summaries and of each field, and the share of predictions that pass each of the checks (columns over pred)."""
    fields = pairs.schema[gold].dataType.fieldNames()
    scored = pairs.filter(F.col(pred).isNotNull())
    counts = pairs.agg(F.count("*").alias("gold_total"), F.count_if(F.col(pred).isNotNull()).alias("scored"), F.count_if(F.col(pred).isNull()).alias("missing"))
    rates = scored.agg(*(F.avg(c.cast("int")).alias(f"format.{n}") for n, c in checks.items()))
    side = lambda c: {"all": F.concat_ws(" ", *(F.col(f"{c}.{f}") for f in fields)), **{f: F.coalesce(F.col(f"{c}.{f}"), F.lit("")) for f in fields}}
    p, g = side(pred), side(gold)
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("part"), p[n].alias("_p"), g[n].alias("_g")) for n in p)))
    long = scored.select(*keys, parts.alias("_x")).select(*keys, "_x.*")
    scores = None
    for n in (1, 2):
        one = rouge_n_table(long, [*keys, "part"], n, "_p", "_g").groupBy("part").agg(F.avg("f").alias("f")).select(F.concat(F.lit(f"rouge{n}."), "part").alias("metric"), F.col("f").alias("value"))
        scores = one if scores is None else scores.unionByName(one)
    if lcs:
        tokens = long.select("part", T.tokenize("_p").alias("_a"), T.tokenize("_g").alias("_b"))
        tokens = tokens.withColumn("_lcs", lcs_length(F.col("_a"), F.col("_b")))
        l = tokens.select("part", rouge_l(F.col("_a"), F.col("_b"), F.col("_lcs"))["f"].alias("f")).groupBy("part").agg(F.avg("f").alias("f"))  # noqa: E741
        scores = scores.unionByName(l.select(F.concat(F.lit("rougeL."), "part").alias("metric"), F.col("f").alias("value")))
    flat = lambda d: d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in d.columns))).alias("x")).select("x.*")
    return flat(counts).unionByName(flat(rates)).unionByName(scores).select("metric", F.round("value", 4).alias("value"))
