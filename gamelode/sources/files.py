"""Readers and writers: explicit schemas, permissive parsing, and the commit protocol of Spark for resumable output."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gamelode.functions.text import extract_json, parse_summary
from gamelode.operators.sampling import request_chunks
from gamelode.sources.ranges import RANGE_BYTES, read_float_files

NAMED = "array<struct<id:string,description:string>>"
GAME = f"struct<type:string,name:string,is_free:boolean,detailed_description:string,short_description:string,genres:{NAMED},categories:{NAMED},release_date:struct<date:string>>"
GAMES_SCHEMA = f"games array<struct<appid:bigint,app_details:struct<success:boolean,data:{GAME}>>>"
REVIEW_COLUMNS = ("recommendationid", "appid", "language", "review_text", "voted_up", "votes_up", "weighted_vote_score", "author_playtime_at_review", "steam_purchase", "received_for_free", "written_during_early_access")
REVIEW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REVIEW_COLUMNS])


def read_game_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per game. A whole gzip document is read by one task; give line files (lines=True) at scale."""
    if lines:
        return spark.read.schema(f"appid bigint, app_details struct<success:boolean,data:{GAME}>").json(path)
    return spark.read.schema(GAMES_SCHEMA).json(path, multiLine=True).select(F.explode("games").alias("g")).select("g.*")


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None, position: str | None = None) -> DataFrame:
    """key: the last row of each key by `position` wins (a column that orders the lines)."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE")
    df = df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    if key:
        cols = df.columns
        df = df.groupBy(key).agg(F.max_by(F.struct(*cols), position).alias("_r")).select(*(F.col(f"_r.{c}").alias(c) for c in cols))
    return df


def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The columns without personal data; the schema may name more columns than are kept."""
    df = spark.read.csv(path, schema=schema or REVIEW_SCHEMA, header=True, multiLine=True, quote='"', escape='"')
    return df.select(*(c for c in REVIEW_COLUMNS if c in df.columns))


def read_pg_copy(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Rows of one table in a dump: lines after `COPY public.<table> ` up to `\\.`. Each line knows the file and its place
    in it; the block's bounds are one small aggregate per file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    starts = lines.filter(F.col("value").startswith(f"COPY public.{table} ")).groupBy("_f").agg(F.min("_i").alias("_a"))
    ends = lines.filter(F.col("value") == "\\.").join(starts, "_f").filter("_i > _a").groupBy("_f", "_a").agg(F.min("_i").alias("_b"))
    body = lines.join(ends, "_f").filter("_i > _a and _i < _b").select(F.split("value", "\t", -1).alias("v")).filter(F.size("v") >= len(columns))
    mark = "\x00"

    def plain(c: Column) -> Column:
        out = F.replace(c, F.lit("\\\\"), F.lit(mark))
        for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(c != "\\N", F.replace(out, F.lit(mark), F.lit("\\")))

    return body.select(*(plain(F.col("v")[k]).alias(name) for k, name in enumerate(columns)))


def read_f32_matrix(spark: SparkSession, path: str, dim: int, rows: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """vector_index, vector of a file of float32 records without a header, or with `size - 4 dim rows` bytes of one; or of a
    folder of such files without headers, as write_f32_matrix() makes them, in order of their names. A task reads range_bytes
    of records at most, whatever the header; the store is one that Arrow knows."""
    files = spark.read.format("binaryFile").load(path)
    found = sorted((r.path, r.length) for r in files.select("path", "length").filter("length > 0").collect())  # names alone
    size = sum(n for _, n in found)
    offset = size - 4 * dim * rows if rows is not None else 0
    if offset < 0 or (size - offset) % (4 * dim) or len(found) > 1 and (offset or any(n % (4 * dim) for _, n in found)):
        raise ValueError(f"{size} bytes are no whole number of rows of {dim} floats")
    before, ranges = 0, []
    for name, n in found:
        ranges.append((name, offset, before, (n - offset) // (4 * dim)))
        before += (n - offset) // (4 * dim)
    return read_float_files(spark, ranges, dim, range_bytes)


def write_f32_matrix(df: DataFrame, path: str, key: str, vector: str, parts: int = 8) -> int:
    """Vectors in order of their key as float32 records without a header, in files whose names are in that order too, written by
    the tasks. path: a folder of a store that Arrow knows (local, hdfs, s3, gs). Returns how many were written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = FileSystem.from_uri(path)
        store.create_dir(folder)
        n = 0
        with store.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():05d}.f32") as out:
            for batch in batches:
                n += batch.num_rows
                out.write(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.select(key, F.col(vector).cast("array<float>").alias("v")).repartitionByRange(parts, key).sortWithinPartitions(key).select("v")
    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def parse_embedding_json(c: str | Column) -> Column:
    return F.from_json(c, "array<float>")


def write_parts(df: DataFrame, path: str, keys: list[str], done: DataFrame | None = None) -> None:
    """Appends what `done` lacks by key; Spark commits each task's files at once or not at all."""
    (df.join(done.select(*keys).distinct(), keys, "left_anti") if done is not None else df).write.mode("append").parquet(path)


def write_split_jsonl(df: DataFrame, path: str, split: str) -> None:
    df.write.partitionBy(split).json(path)


def write_panel_json(df: DataFrame, path: str) -> None:
    """Arrays and maps as JSON text; gzip CSV and gzip JSON lines beside each other."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
    flat.write.option("compression", "gzip").option("header", True).option("escape", '"').csv(f"{path}/csv")
    flat.write.option("compression", "gzip").json(f"{path}/json")


def build_request_chunks(df: DataFrame, key: str, text: str, done: DataFrame, size: int = 25_000, limit: int = 2000) -> DataFrame:
    """key, chunk, request (JSON) of rows that are not done; chunks of at most `size` rows in key order."""
    rest = df.join(done.select(key).distinct(), key, "left_anti").select(key, F.substring(text, 1, limit).alias("_t"))
    request = F.to_json(F.struct(F.col(key).cast("string").alias("key"), F.col("_t").alias("text")))
    return request_chunks(rest, [key], size).select(key, "chunk", request.alias("request"))


ENVELOPE = "key string, response string, input_tokens bigint, output_tokens bigint"


def collect_responses(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(appid, summary) of whole answers, and one row of token sums and cost."""
    e = lines.select(F.from_json(column, ENVELOPE).alias("e")).select("e.*")
    good = e.select(F.expr("try_cast(key as bigint)").alias("appid"), parse_summary(extract_json("response")).alias("summary")).filter("appid is not null and summary is not null")
    cost = F.sum(F.coalesce("input_tokens", F.lit(0))) * 0.05 / 1e6 + F.sum(F.coalesce("output_tokens", F.lit(0))) * 0.20 / 1e6
    return good, e.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.round(cost, 9).alias("cost"))
