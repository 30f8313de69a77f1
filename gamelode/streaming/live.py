"""A search index that grows with a stream: segments of postings, lengths and vectors, searched while more are written.

Every micro-batch writes a segment under a new name and then a line in the log, which lists the segments that count: readers
take the last line, so they see a batch whole or not at all, and a batch that runs again replaces its own segment. A
document that comes again is in a later segment; the earlier rows are marked removed by that alone, as a document's rows
count in the last segment that has it. compact() writes what counts as one segment. Rows without an id get ids from the
largest one on. There is one writer."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gamelode.functions import text as T
from gamelode.operators import ranking as K
from gamelode.operators.retrieval import Bm25Index, bm25_search
from gamelode.operators.sampling import global_row_number
from gamelode.sources.scratch import stored

TABLES = {"docs": "doc_id bigint, len bigint, vec array<double>", "postings": "doc_id bigint, term string, tf bigint"}
PART_BYTES = 8 * 2**20  #: bytes of text in a task of put()
MERGE_FROM = 8  #: segments; write_live_index() merges them when there are so many


@dataclass(frozen=True)
class Segment:
    name: str
    batches: tuple[int, ...]


class LiveIndex:
    """path: the index's folder, which readers in other sessions may open too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def segments(self) -> list[Segment]:
        return self._log()[1]

    def _log(self) -> tuple[int, list[Segment]]:
        try:
            last = self.spark.read.schema("version bigint, segments array<struct<name:string,batches:array<bigint>>>").json(f"{self.path}/log").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        return (last.version, [Segment(s["name"], tuple(s["batches"])) for s in last.segments]) if last else (0, [])

    def _commit(self, version: int, segments: list[Segment]) -> None:
        row = [(version, [(s.name, list(s.batches)) for s in segments])]
        self.spark.createDataFrame(row, "version bigint, segments array<struct<name:string,batches:array<bigint>>>").coalesce(1).write.mode("append").json(f"{self.path}/log")

    def _rows(self, table: str, segments: list[Segment] | None = None) -> DataFrame:
        """A table of the segments, with their place in the list."""
        out = self.spark.createDataFrame([], f"{TABLES[table]}, seg int")
        for k, s in enumerate(self.segments() if segments is None else segments):
            out = out.unionByName(self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/{s.name}").withColumn("seg", F.lit(k)))
        return out

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """batch: doc_id (may be null), text, and vec or no such column. Of rows that repeat an id, the one with the greatest text
        counts."""
        version, segments = self._log()
        before = [s for s in segments if batch_id not in s.batches]
        if len(before) < len(segments) and any(batch_id in s.batches and len(s.batches) > 1 for s in segments):
            return  # it has been merged with others already, and merging comes after its commit
        name = f"batch-{batch_id}-{uuid.uuid4().hex}"
        parts = 1 + (batch.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
        rows = batch.select("doc_id", "text", (F.col("vec").cast("array<double>") if "vec" in batch.columns else F.lit(None).cast("array<double>")).alias("vec"))
        # texts are dealt out by id once, into parts of a fixed size whatever the batch is; their words are counted where they are
        known = rows.filter("doc_id is not null").repartition(parts, "doc_id").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("text")))).filter("_n = 1").drop("_n")
        new = rows.filter("doc_id is null")
        if not new.isEmpty():
            most = max((x for x in (known.agg(F.max("doc_id")).first()[0], self._rows("docs", before).agg(F.max("doc_id")).first()[0]) if x is not None), default=-1)
            new = global_row_number(new, ["text"], "_rn").select((F.col("_rn") + most).alias("doc_id"), "text", "vec")
            known = known.unionByName(new).repartition(parts, "doc_id")
        words = known.select("doc_id", "vec", F.coalesce(T.tokenize("text"), F.array().cast("array<string>")).alias("t"))
        words.select("doc_id", F.size("t").cast("bigint").alias("len"), "vec").write.mode("overwrite").parquet(f"{self.path}/docs/{name}")
        words.select("doc_id", F.explode("t").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{self.path}/postings/{name}")
        self._commit(version + 1, [*before, Segment(name, (batch_id,))])

    def live(self) -> tuple[DataFrame, DataFrame]:
        """docs and postings that count: of each document, those of the last segment that has it. Only what is marked removed is
        listed and taken out, so that postings are not shuffled while that list is short."""
        segments = self.segments()
        docs, postings = self._rows("docs", segments), self._rows("postings", segments)
        if len(segments) < 2:
            return docs, postings
        again = docs.groupBy("doc_id").agg(F.max("seg").alias("last"), F.count("*").alias("n")).filter("n > 1")
        removed = stored(docs.select("doc_id", "seg").join(again, "doc_id").filter("seg < last").select("doc_id", "seg"), "removed")
        return docs.join(removed, ["doc_id", "seg"], "left_anti"), postings.join(removed, ["doc_id", "seg"], "left_anti")

    def index(self) -> Bm25Index:
        docs, postings = self.live()
        lengths = docs.select("doc_id", "len")
        postings = postings.select("doc_id", "term", "tf")
        return Bm25Index(postings, lengths, postings.groupBy("term").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: query_id, query: query_id, doc_id, score, rank, over what has been committed."""
        return bm25_search(queries, self.index(), k)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: query_id, query_vec: the k nearest documents that have a vector."""
        docs = self.live()[0].filter("vec is not null")
        return K.dense_topk(queries, docs, k, key="doc_id", vec="vec")

    def compact(self) -> None:
        """One segment of what counts. The old ones stay for readers that have begun."""
        version, segments = self._log()
        if len(segments) < 2:
            return
        name = f"merged-{uuid.uuid4().hex}"
        docs, postings = self.live()
        docs.select("doc_id", "len", "vec").write.parquet(f"{self.path}/docs/{name}")
        postings.select("doc_id", "term", "tf").write.parquet(f"{self.path}/postings/{name}")
        self._commit(version + 1, [Segment(name, tuple(b for s in segments for b in s.batches))])


def write_live_index(docs: DataFrame, path: str, checkpoint: str, merge_from: int = MERGE_FROM):
    """docs: a stream of doc_id, text and vec (or none). Starts a query that adds every micro-batch to the index at path."""

    def put(batch: DataFrame, batch_id: int) -> None:
        index = LiveIndex(batch.sparkSession, path)
        batch = batch.persist()
        index.put(batch, batch_id)
        batch.unpersist()
        if len(index.segments()) >= merge_from:
            index.compact()

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
