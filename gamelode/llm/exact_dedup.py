"""Operator 4, exact de-duplication: a persistent digest index, bucketed and sorted by hash.

The index is a table with one row for each distinct text. A new batch is digested once, reduced to one row per digest, and
joined to the index by a sort-merge join in which the index is read as bucketed, without a shuffle. What the index lacks
is appended in the same buckets, and the batch takes its answer from that one join: nothing of the index but the digests
that the batch has goes further. Documents then meet their digest's row in a join that AQE may split at hot digests.

An index lives in its folder: data in the buckets, and a note of where these lie. It is opened again by that folder, in any
session; compact() puts the files that appends have left back into one for each bucket.

Defined cases: a null text counts as the empty text; rows without an id are never the row that stays; rows that repeat
an id and a text are one document and all carry the same flags; of equal texts in one batch the largest id stays, and a
text that came in an earlier batch has its row there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, stored

BUCKETS = 32  #: at some ten million digests a bucket, a sort of it fits in a task's memory


def with_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))


class DigestIndex:
    """path: the index's folder (a new one if not given); name: that of its table in this session's catalogue; buckets: for a
    new index, as an old one keeps its own."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets, self.data, self.version = spark, buckets, None, -1
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        self._reopen()

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _note(self) -> None:
        """Tells where the data lie; the row of the highest version counts."""
        self.version += 1
        self.spark.createDataFrame([(self.version, self.buckets, self.data)], "version bigint, buckets bigint, data string").coalesce(1).write.mode("append").json(f"{self.path}/about")

    def _reopen(self) -> None:
        try:
            notes = self.spark.read.schema("version bigint, buckets bigint, data string").json(f"{self.path}/about")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        last = notes.orderBy(F.desc("version")).first()
        if last is None:
            return
        self.version, self.buckets, self.data = last.version, int(last.buckets), last.data
        if not self.exists():
            schema = self.spark.read.parquet(self.data).schema
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"create table {self.name} ({columns}) using parquet clustered by (text_sha256) sorted by (text_sha256) into {self.buckets} buckets location '{self.data}'")

    def _write(self, rows: DataFrame) -> None:
        known = self.exists()
        if not known:
            self.data = f"{self.path}/data-{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.format("parquet").mode("append").option("path", self.data)
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)
        )
        if not known:
            self._note()

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds the digests of a batch (doc_id, text_sha256) that the index lacks; the largest doc_id of a digest stays. Returns
        the index's rows for the digests of the batch."""
        own = batch.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n_rows"))
        if not self.exists():
            found = stored(own.withColumn("is_new", F.lit(True)), "digests")
        else:
            known = self.spark.table(self.name).select("text_sha256", F.col("keep_id").alias("old_id"), F.col("n_rows").alias("old_rows"), F.lit(True).alias("is_old"))
            is_new = F.col("is_old").isNull()
            old = lambda c, o: F.when(is_new, F.col(c)).otherwise(F.col(o)).alias(c)
            found = stored(own.hint("merge").join(known, "text_sha256", "left").select("text_sha256", old("keep_id", "old_id"), old("n_rows", "old_rows"), is_new.alias("is_new")), "digests")
        self._write(found.filter("is_new").drop("is_new"))
        return found.drop("is_new")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def compact(self) -> None:
        """One file for each bucket again. The old files stay for readers that have begun."""
        rows = self.rows()
        columns = rows.schema
        self.spark.sql(f"drop table {self.name}")
        self._write(self.spark.read.schema(columns).parquet(self.data))

    def close(self) -> None:
        """Takes the table out of the catalogue; its files stay, and the folder can be opened again."""
        self.spark.sql(f"drop table if exists {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (of the batch in which the text first came), kept, text_sha256."""
    digests = stored(with_digest(docs, id_col, text_col), "digested")
    found = index.append(digests)
    return digests.join(found, "text_sha256", "left").select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    out = exact_dedup(read(spark, sf_dir, "documents"), index)
    index.close()
    return out


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
 coalesce(doc_id = max(doc_id) over w, false) as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
