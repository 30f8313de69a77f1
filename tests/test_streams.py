"""The live index against an index of the same rows, and the users' state against the batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gamelode.operators import ranking as K
from gamelode.operators import retrieval as V
from gamelode.streaming import events as E
from gamelode.streaming.live import LiveIndex, write_live_index


def _found(hits, score="score"):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r[score], 5)) for r in hits.collect())


def test_the_live_index_is_that_of_the_rows_so_far(spark, tmp_path):
    """Documents that come again, rows without ids, a batch that runs twice, empty texts and batches, merging, another reader."""
    draw = random.Random(8)
    text = lambda: " ".join(draw.choice(["ring", "gear", "bolt", "red", "blue", "hot"]) for _ in range(draw.randrange(9)))
    vec = lambda: [draw.uniform(-1, 1) for _ in range(4)]
    batches = [[(draw.randrange(60), text(), vec()) for _ in range(25)] for _ in range(4)] + [[(None, f"new text {k} ring", vec()) for k in range(5)], []]
    queries = spark.createDataFrame([(1, "red ring"), (2, "gear gear blue"), (3, "new"), (4, "none at all")], "query_id bigint, query string")
    near = spark.createDataFrame([(1, vec()), (2, vec())], "query_id bigint, query_vec array<double>")
    index, now = LiveIndex(spark, str(tmp_path / "index")), {}
    assert index.search(queries, 5).count() == 0
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, vec array<double>")
        index.put(df.limit(3) if n == 1 else df, n)
        if n == 1:
            index.put(df, n)  # the batch runs again, whole
        if n == 3:
            index.compact()
            assert len(index.segments()) == 1
            index.put(df, n)  # and once more after it was merged: nothing changes
        best = {}
        for k, t, v in rows:
            if k is not None and (k not in best or t > best[k][0]):
                best[k] = (t, v)
        most = max(now, default=-1)
        now |= best | {most + 1 + k: (t, v) for k, (i, t, v) in enumerate(rows) if i is None}
        docs = spark.createDataFrame([(k, t, v) for k, (t, v) in now.items()], "doc_id bigint, text string, vec array<double>")
        reader = LiveIndex(spark, index.path)
        assert _found(reader.search(queries, 5)) == _found(V.bm25_search(queries, V.bm25_index(docs), 5))
        if n in (0, 4):
            assert _found(reader.nearest(near, 7)) == _found(K.dense_topk(near, docs, 7, key="doc_id", vec="vec"))


def test_the_stream_merges_its_segments(spark, tmp_path):
    for k in range(5):
        spark.createDataFrame([(k, f"word{'abcde'[k]} same")], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / f"in/b={k}"))
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = write_live_index(stream, str(tmp_path / "index"), str(tmp_path / "ckpt"), merge_from=2)
    query.awaitTermination()
    index = LiveIndex(spark, str(tmp_path / "index"))
    assert len(index.segments()) == 1 and {r.term: r.df for r in index.index().terms.collect()}["same"] == 5


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def _states(spark, tmp_path, batches, **how):
    """The last rows of each user after each batch."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, sec bigint, type string, appid bigint, query string").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/b={k}"))
    events = spark.readStream.schema(E.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    events = events.withWatermark("ts", "0 seconds") if how.get("lifetime") else events
    state, seen = {}, []

    def put(batch, n):
        rows = batch.collect()
        for u in {r.user_id for r in rows}:
            state[u] = (sorted((r.place, r.event_id) for r in rows if r.user_id == u and r.place is not None), next(r.clicked for r in rows if r.user_id == u))
        seen.append(dict(state))

    query = E.recent_state(events, **how).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen


def test_late_events_and_the_clicked_set(spark, tmp_path, rocksdb):
    batches = [
        [(k, 1, 100 + k, "click", 7 + k % 2, None) for k in range(3)] + [(50, 2, 100, "search", None, "x")],
        [(10, 1, 50, "click", 99, None), (11, 1, 300, "search", None, "y")],  # 10 is late: older than the three newest, but a click
        [(12, 1, 200, "click", 5, None)],  # late, and among the newest
    ]
    seen = _states(spark, tmp_path, batches, size=3)
    assert seen[0] == {1: ([(0, 2), (1, 1), (2, 0)], [7, 8]), 2: ([(0, 50)], [])}
    assert seen[1][1] == ([(0, 11), (1, 2), (2, 1)], [7, 8, 99])
    assert seen[2][1] == ([(0, 11), (1, 12), (2, 2)], [5, 7, 8, 99])


def test_what_is_older_than_its_lifetime_goes(spark, tmp_path, rocksdb):
    batches = [
        [(1, 1, 1000, "click", 7, None), (2, 1, 3000, "click", 8, None)], [(3, 2, 4700, "search", None, "x")], [(4, 2, 4800, "search", None, "x")],  # the watermark of 4700 passes 1000 + 3600
        [(5, 2, 9000, "click", 1, None)], [(6, 2, 9100, "click", 1, None)],
    ]
    seen = _states(spark, tmp_path, batches, lifetime=3600)
    assert seen[0][1] == ([(0, 2), (1, 1)], [7, 8])
    assert [s[1] for s in seen if s[1] == ([(0, 2)], [8])] and seen[-1][1] == ([], [])
    assert seen[-1][2][1] == [1] and (0, 6) in seen[-1][2][0]
