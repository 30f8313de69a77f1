"""A keyword index that lives in a folder: blocks of postings, bucketed and sorted by term, with exact pruning.

A block is one row: the postings of a term in one range of `span` document ids, with the largest tf and the least length in
it, which bound what any of its documents can score, whatever the statistics and parameters of a later search are. A search
goes through the blocks in two rounds.

1. The rarest words of each query, up to the part SHARE of what all its words could score at most, are read whole. Their
   sums are lower bounds of scores, so the k-th best of them is a score that the result has to reach.
2. Of the other words only the bounds are read first. A range whose bounds cannot reach that score is skipped; in a range
   that can reach it only together with the first round's sums, only documents of that round are looked up; the rest is read
   whole. Head words are therefore read in few ranges, and the result is that of reading everything.

Numbers of documents and words stand in the blocks of the empty term, which has every document once. Documents are added
under new ids; the table's files are appended in the same buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gamelode.functions import text as T
from gamelode.operators.ranking import topk_per_group
from gamelode.sources.scratch import scratch, stored

SPAN, BUCKETS, SHARE = 2048, 16, 0.35  #: SHARE: of the bound that the second round may hold
LITERAL_TERMS, SLACK = 1000, 1e-5  #: up to so many different words are a filter of the scan; scores are rounded to 6 places


@dataclass(frozen=True)
class Found:
    """hits: query_id, doc_id, score, rank. blocks: query_id, n_blocks (of its words), n_read."""

    hits: DataFrame
    blocks: DataFrame


def _stored_where_dealt(df: DataFrame, tag: str) -> DataFrame:
    """stored(), with Spark told that rows dealt out by one of the columns that a join or sum is by need not be dealt out again."""
    conf, name = df.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return stored(df, tag)
    finally:
        conf.set(name, before)


def tf_part(tf: Column, length: Column, avg: Column, k1: float, b: float) -> Column:
    return tf / (tf + k1 * (1 - b + b * length / avg))


class PostingsIndex:
    """path: the index's folder. It is opened if it has an index, else the first add() makes one."""

    def __init__(self, spark: SparkSession, path: str | None = None, span: int = SPAN, buckets: int = BUCKETS):
        self.spark, self.span, self.buckets = spark, span, buckets
        self.path = path or scratch(spark, "postings")
        self.name = f"postings_{uuid.uuid4().hex}"
        try:
            about = spark.read.schema("span int, buckets int").json(f"{self.path}/about").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            about = None
        self.made = about is not None
        if about:
            self.span, self.buckets = about.span, about.buckets
            columns = "term string, range bigint, n int, max_tf bigint, min_len bigint, docs array<bigint>, tfs array<bigint>, lens array<bigint>"
            spark.sql(f"create table {self.name} ({columns}) using parquet clustered by (term) sorted by (term, range) into {self.buckets} buckets location '{self.path}/blocks'")

    def close(self) -> None:
        """Takes the table out of the session's catalogue; the folder stays and can be opened again."""
        self.spark.sql(f"drop table if exists {self.name}")

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> PostingsIndex:
        """docs have ids that the index lacks. Texts are dealt out by their range of ids and split once, so that words are counted
        and blocks made where they are; a null text has no words. Each task appends a file to the buckets that it has terms of."""
        at = F.floor(F.col(key).cast("bigint") / self.span)
        placed = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), at.alias("range")).repartition("range")
        words = placed.select("range", "doc_id", F.coalesce(T.tokenize("text"), F.array().cast("array<string>")).alias("t"))
        rows = words.select("range", "doc_id", F.size("t").cast("bigint").alias("len"), F.explode(F.array_append("t", F.lit(""))).alias("term"))
        postings = rows.groupBy("range", "doc_id", "len", "term").agg(F.count("*").alias("tf"))
        blocks = postings.groupBy("term", "range").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list(F.struct("doc_id", "tf", "len")).alias("p"))
        blocks = blocks.select("term", "range", "n", "max_tf", "min_len", F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"))
        blocks.write.format("parquet").mode("append").option("path", f"{self.path}/blocks").bucketBy(self.buckets, "term").sortBy("term", "range").saveAsTable(self.name)
        if not self.made:
            self.spark.createDataFrame([(self.span, self.buckets)], "span int, buckets int").coalesce(1).write.json(f"{self.path}/about")
            self.made = True
        return self

    def blocks(self) -> DataFrame:
        return self.spark.table(self.name)

    def terms(self) -> DataFrame:
        """term, df, max_tf, min_len."""
        return self.blocks().filter("term <> ''").groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))

    def statistics(self) -> DataFrame:
        """One row: n documents, total words."""
        return self.blocks().filter("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("total"))

    def idf(self) -> DataFrame:
        """term, df, max_tf, min_len, idf (a negative one replaced by a quarter of the mean), floor (that quarter), avg."""
        raw = self.terms().crossJoin(F.broadcast(self.statistics())).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg((0.25 * F.avg("raw")).alias("floor"))
        return raw.crossJoin(F.broadcast(mean)).select("term", "df", "max_tf", "min_len", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"), "floor", (F.col("total") / F.col("n")).alias("avg"))

    def search(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, share: float = SHARE) -> Found:
        """queries: query_id, query. The k best documents that share a word with the query; repeated words count again."""
        words = queries.select("query_id", F.explode(T.tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
        bound = lambda tf, length: F.greatest(F.lit(0.0), F.col("w")) * tf_part(F.col(tf), F.col(length), F.col("avg"), k1, b)
        wanted = words.join(self.idf(), "term").withColumn("w", F.col("qf") * F.col("idf") * (k1 + 1)).withColumn("u", bound("max_tf", "min_len"))
        common = Window.partitionBy("query_id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("query_id")
        # the commonest words wait for the second round while they stay below the share; with a negative floor sums are no bounds
        late = (F.sum("u").over(common) <= share * F.sum("u").over(whole)) & (F.col("floor") >= 0)
        wanted = stored(wanted.withColumn("late", late).select("query_id", "term", "w", "avg", "late"), "wanted")
        table = self.blocks()
        some = [r.term for r in wanted.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        table = table.filter(F.col("term").isin(some)) if len(some) <= LITERAL_TERMS else table.filter("term <> ''")
        part = F.col("w") * tf_part(F.col("tf"), F.col("len"), F.col("avg"), k1, b)

        def opened(rows: DataFrame) -> DataFrame:
            each = rows.withColumn("p", F.explode(F.arrays_zip("docs", "tfs", "lens")))
            return each.select("*", F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len")).drop("p", "docs", "tfs", "lens")

        # blocks meet by range before they are opened for each query, so that a document's postings are added up where they are
        asked = wanted.select("term", "late").distinct()
        placed = table.join(asked.filter("not late"), "term", "left_semi").repartition("range")
        first = opened(placed.join(wanted.filter("not late"), "term")).groupBy("query_id", "range", "doc_id").agg(F.sum(part).alias("s"))
        first = stored(first, "first-round")
        reached = stored(topk_per_group(first, ["query_id"], [F.desc("s"), F.col("doc_id")], k).filter(F.col("rank") == k).select("query_id", (F.col("s") - SLACK).alias("least")), "reached")
        # bounds of the late words, range by range: no posting is read for them
        bounds = table.select("term", "range", "max_tf", "min_len").join(wanted.filter("late"), "term").groupBy("query_id", "range").agg(F.sum(bound("max_tf", "min_len")).alias("more"), F.count("*").alias("n"))
        bounds = stored(bounds.join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "bounds")
        # of the first round, what all late words of its range could still bring to that score
        least = F.coalesce("_least", F.lit(float("-inf")))
        strong = first.join(reached.withColumnRenamed("least", "_least"), "query_id", "left").join(bounds.select("query_id", "range", "more"), ["query_id", "range"], "left")
        strong = stored(strong.filter(F.col("s") + F.coalesce("more", F.lit(0.0)) >= least).select("query_id", "range", "doc_id", "s", "more"), "strong")
        chosen = strong.filter("more is not null").groupBy("query_id", "range").agg(F.collect_set("doc_id").alias("chosen"))
        live = bounds.join(chosen, ["query_id", "range"], "left").withColumn("open", F.col("more") >= F.col("least"))
        live = stored(live.filter("open or chosen is not null").select("query_id", "range", "n", F.when(~F.col("open"), F.col("chosen")).alias("chosen")), "live")
        # the late words' blocks meet the queries by range too; a document's sum leaves its range only if it can be among the k best
        late_blocks = table.join(asked.filter("late"), "term", "left_semi").join(F.broadcast(live.select("range").distinct()), "range", "left_semi").drop("late", "n", "max_tf", "min_len")
        asking = wanted.filter("late").join(live.select("query_id", "range", "chosen"), "query_id")
        second = opened(late_blocks.repartition("range").join(asking.repartition("range").hint("merge"), ["range", "term"])).filter("chosen is null or array_contains(chosen, doc_id)")
        second = second.groupBy("query_id", "range", "doc_id").agg(F.sum(part).alias("t"))
        both = strong.select("query_id", "range", "doc_id", "s").repartition("range").hint("merge").join(second, ["range", "query_id", "doc_id"], "full")
        sums = both.select("query_id", "doc_id", F.round(F.coalesce("s", F.lit(0.0)) + F.coalesce("t", F.lit(0.0)), 6).alias("score"))
        sums = sums.join(F.broadcast(reached.withColumnRenamed("least", "_least")), "query_id", "left").filter(F.col("score") >= least).drop("_least")
        hits = _stored_where_dealt(topk_per_group(sums, ["query_id"], [F.desc("score"), F.col("doc_id")], k), "hits")
        early = table.select("term").join(wanted.filter("not late"), "term").groupBy("query_id").agg(F.count("*").alias("e"))
        of = lambda df, name: df.groupBy("query_id").agg(F.sum("n").alias(name))
        read = early.join(of(bounds, "a"), "query_id", "full").join(of(live, "r"), "query_id", "left").na.fill(0)
        return Found(hits, read.select("query_id", (F.col("e") + F.col("a")).alias("n_blocks"), (F.col("e") + F.col("r")).alias("n_read")))
