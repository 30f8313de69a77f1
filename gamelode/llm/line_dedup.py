"""Operator 8, line de-duplication by site-relative frequency.

The pages of a host that contain a line, divided by the pages of the host, give the line's ratio; lines above the
boilerplate ratio are dropped from every page of that host. Only expressions and joins: the distinct lines of each page
are counted under a 64-bit hash (partial sums before the shuffle), and what exceeds the ratio is gathered to one list
per host. Such a list holds at most (mean distinct lines of a page / ratio) hashes, whatever the host's size. The lists go
to every task if they hold BROADCAST_LINES hashes at most in all (they are counted), so that texts are not shuffled; beyond
that, texts and lists are joined by host and salt, with a list for each of SALTS salts, so that no host meets in one task.

Defined cases: a null text stays null with 0 lines; a null host is the host ''; lines of white space only are never
boilerplate; a host with fewer than min_pages pages has no boilerplate; a page left without lines has the empty text;
repeated rows are separate pages; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

RATIO, MIN_PAGES = 0.1, 10
BROADCAST_LINES, SALTS = 1_000_000, 64


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_gl_host, _hash of boilerplate lines."""
    host = F.coalesce(F.col(host_col), F.lit("")).alias("_gl_host")
    pages = docs.groupBy(host).agg(F.count("*").alias("_pages")).filter(F.col("_pages") >= min_pages)
    lines = docs.select(host, F.explode(F.array_distinct(F.split(text_col, "\n", -1))).alias("_line")).filter(F.trim("_line") != "")
    counts = lines.groupBy("_gl_host", F.xxhash64("_line").alias("_hash")).agg(F.count("*").alias("_with"))
    frequent = counts.filter(F.col("_with") > ratio * min_pages).join(pages, "_gl_host").filter(F.col("_with") > ratio * F.col("_pages"))
    return frequent.select("_gl_host", "_hash")


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with the boilerplate lines taken out of text_col, and n_lines and n_dropped (bigint) beside it."""
    found = stored(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    common = found.groupBy("_gl_host").agg(F.sort_array(F.collect_list("_hash")).alias("_gl_common"))
    hosts = docs.withColumn("_gl_host", F.coalesce(F.col(host_col), F.lit("")))
    if found.count() <= broadcast_lines:
        joined = hosts.join(F.broadcast(common), "_gl_host", "left")
    else:
        salt = F.pmod(F.xxhash64(text_col, F.spark_partition_id()), F.lit(SALTS)).cast("int")
        salts = common.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_gl_salt"))
        joined = hosts.withColumn("_gl_salt", salt).join(salts, ["_gl_host", "_gl_salt"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    # which of the page's own lines are in the host's list, by one hash table for each page
    joined = joined.withColumn("_gl_bad", F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), "_gl_common"))
    some = F.coalesce(F.size("_gl_bad") > 0, F.lit(False))
    kept = F.when(some, F.filter(lines, lambda x: ~F.array_contains(F.col("_gl_bad"), F.xxhash64(x)) | (F.trim(x) == ""))).otherwise(lines)
    names = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return joined.withColumn("_gl_kept", kept).select(*names, F.array_join("_gl_kept", "\n").alias(text_col), size(lines).alias("n_lines"), (size(lines) - size(F.col("_gl_kept"))).alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", "n_lines", "n_dropped")


ORACLE = f"""
with pages as (select coalesce(source, '') as host, count(*) as n from documents group by 1 having count(*) >= {MIN_PAGES}),
lines as (select coalesce(source, '') as host, unnest(list_distinct(string_split(text, chr(10)))) as line from documents),
common as (select l.host, list(l.line) as bad from (select host, line, count(*) as c from lines where trim(line) <> '' group by 1, 2) l
 join pages p on p.host = l.host where l.c > {RATIO} * p.n group by 1),
cut as (select d.doc_id, d.source, string_split(d.text, chr(10)) as a,
 list_filter(string_split(d.text, chr(10)), lambda x : not coalesce(list_contains(c.bad, x), false)) as k
 from documents d left join common c on c.host = coalesce(d.source, ''))
select doc_id, source, array_to_string(k, chr(10)) as text, coalesce(len(a), 0) as n_lines, coalesce(len(a), 0) - coalesce(len(k), 0) as n_dropped from cut
"""
