"""Queries on tables that are larger, or harder, than the given ones in one respect."""

from __future__ import annotations

import time
import tracemalloc
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gamelode.functions import text as T
from gamelode.operators import bitmaps as M
from gamelode.operators import funnel as W
from gamelode.operators import ranking as K
from gamelode.operators import retrieval as V
from gamelode.operators import search as S
from gamelode.operators.postings import PostingsIndex
from gamelode.plans import catalogue
from gamelode.plans.bindings import TABLES, view
from gamelode.streaming import live
from gamelode.streaming.events import RecentActions
from tests.compare import difference


@pytest.fixture
def tables(spark, sf, tmp_path):
    """tables(name=rows, ...): a folder with these tables and the given ones for all others."""

    def put(**own):
        for name in TABLES:
            df = own.get(name, spark.read.parquet(f"{sf}/{name}.parquet"))
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def _same_as_sql(spark, folder: str, name: str) -> int:
    got = catalogue.queries()[name](spark, folder).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    assert difference(got, con.execute(catalogue.oracle_sql()[name]).fetchdf()) == ""
    return len(got)


def test_panel_fields_of_a_thousand_reviews_and_more(spark, sf, tables):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(60)
    many = e.crossJoin(spark.range(30).select(F.col("id").alias("i"))).withColumn("vec_id", (F.col("vec_id") + 1000 * F.col("i")) * 50).drop("i")
    folder = tables(embeddings=many)
    assert _same_as_sql(spark, folder, "j10_panel_join")
    fields = [r.fields for r in catalogue.queries()["j10_panel_join"](spark, folder).filter("status = 'ok'").collect()]
    assert any(f.startswith("reviews=1,800; top=") for f in fields)


def _shuffled(spark, run) -> int:
    """Rows that a query writes to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def so_far() -> dict[tuple[int, int], int]:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = so_far()
    run().write.format("noop").mode("overwrite").save()
    return sum(n for k, n in so_far().items() if k not in before)


def test_text_examples_shuffle_no_pairs_of_texts(spark):
    words = lambda n: F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), (F.col("id") % (k + 2)).cast("string")) for k in range(n)))
    gold = spark.range(1500).select(F.col("id").alias("key"), words(6).alias("text"))
    q = spark.range(0, 1500, 5).select(F.col("id").alias("key"), words(6).alias("text"))
    assert _shuffled(spark, lambda: V.tfidf_examples(q, gold, stop=V.STOP)) < 300 * 1500 / 4
    whole = sorted(map(tuple, V.tfidf_examples(q, gold, stop=V.STOP).collect()))
    assert whole == sorted(map(tuple, V.tfidf_examples(q, gold, stop=V.STOP, block=40).collect()))
    assert len(whole) == 900


def test_text_examples_cost_what_rows_and_queries_share():
    """Most terms of a row are in few queries: the time is not that of all terms times all queries; some are in many."""
    draw = np.random.default_rng(5)

    def vector() -> tuple[np.ndarray, np.ndarray]:
        i = np.unique(np.concatenate([draw.integers(0, 20_000, 200), draw.integers(0, 40, 10)]))
        v = draw.random(len(i))
        return i, v / np.sqrt(v @ v)

    queries = [Row(key=k, h=f"q{k}", i=i.tolist(), v=v.tolist()) for k in range(2000) for i, v in [vector()]]
    gold = [(k, f"q{k % 2500}" if k % 7 == 0 else f"g{k}", *(vector() if k % 11 else (np.array(queries[k % 2000].i), np.array(queries[k % 2000].v)))) for k in range(3000)]
    batches = pa.table({"key": pa.array([g[0] for g in gold], pa.int64()), "h": [g[1] for g in gold], "i": pa.array([g[2].tolist() for g in gold], pa.list_(pa.int32())), "v": [g[3].tolist() for g in gold]}).to_batches(1000)
    run = V._nearest_texts(queries, 3, 0.05)
    began = time.perf_counter()
    found = pd.concat([b.to_pandas() for b in run(iter(batches))])
    assert time.perf_counter() - began < 2.5
    x, y = np.zeros((2000, 20_000)), np.zeros((3000, 20_000))
    for n, q in enumerate(queries):
        x[n, q.i] = q.v
    for n, g in enumerate(gold):
        y[n, g[2]] = g[3]
    s = np.floor(x @ y.T * 1e6 + 0.5) / 1e6
    for k in range(0, 2000, 37):
        able = [(-s[k, n], n) for n in range(3000) if n != k and gold[n][1] != f"q{k}" and s[k, n] >= 0.05]
        got = found[found["query_id"] == k]
        assert sorted(zip(-got["score"], got["doc_id"], strict=True))[:3] == sorted(able)[:3]


def test_an_index_of_postings_shuffles_texts_and_not_words(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{chr(97 + k)}"), F.translate((F.col("id") % (k + 2)).cast("string"), "0123456789", "abcdefghij")) for k in range(20))).alias("text"))
    index = PostingsIndex(spark, span=256)
    assert _shuffled(spark, lambda: index.add(docs).blocks()) < 3000 * 20 / 4
    assert _shuffled(spark, lambda: V.bm25_index(docs).postings) < 3000 * 20 / 2
    ask = docs.filter("doc_id % 600 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    found = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    want = found(V.bm25_search(ask, V.bm25_index(docs), 10))
    assert found(index.search(ask, 10).hits) == want and len(want) == 50


def test_a_search_shuffles_blocks_and_not_the_postings_of_each_query(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{k:02d}")
    words = [F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3 if k < 40 else 29)) == 0, F.lit(f"w{name(k)}")) for k in range(60)]
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *words).alias("text"))
    ask = docs.filter("doc_id % 60 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    index = PostingsIndex(spark, span=256).add(docs)
    found = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    want = found(V.bm25_search(ask, V.bm25_index(docs), 100))
    assert _shuffled(spark, lambda: index.search(ask, 100).hits) < 50 * 4000
    assert found(index.search(ask, 100).hits) == want and len(want) == 5000


def _vectors(spark, n: int):
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * (k + 1)) for k in range(8))).alias("embedding"))


def test_near_search_shuffles_no_pairs(spark):
    e = _vectors(spark, 4000)
    q = e.filter("vec_id % 20 = 0").toDF("query_id", "query_vec")
    assert _shuffled(spark, lambda: K.near_topk(q, e, 3)) < 200 * 4000 / 10
    assert K.near_topk(q, e, 3).filter("rank = 1 and score > 0.999").count() == 199  # all but the query without a direction


def test_dense_search_holds_few_scores_at_a_time(spark, monkeypatch):
    e = _vectors(spark, 2000)
    kept = []
    plain = type(e).mapInPandas
    monkeypatch.setattr(type(e), "mapInPandas", lambda df, f, schema: kept.append(f) or plain(df, f, schema))
    K.dense_topk(e.toDF("query_id", "query_vec"), e, 10)
    batch = pd.concat([e.toPandas()] * 5, ignore_index=True)
    tracemalloc.start()
    n = sum(len(x) for x in kept[0](iter([batch])))
    assert n >= 2000 * 10 and tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_the_overlap_of_quality_flags_is_made_once(spark, sf):
    plan = catalogue.queries()["f14_qc_flags"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1


def _points(n: int, seed: int) -> np.ndarray:
    return np.round(np.random.default_rng(seed).normal(size=(n, 4)), 1)


def test_a_task_hands_on_the_k_best_of_its_points():
    """Whatever the number of batches and of equal vectors; before, each batch handed on its own and all that tied."""
    v, q = np.repeat(_points(60, 1), 20, axis=0), _points(5, 2)
    pdfs = [pd.DataFrame({"vec_id": np.arange(at, at + 100), "embedding": v[at : at + 100].tolist()}) for at in range(0, len(v), 100)]
    got = pd.concat(K._nearest([(i, x) for i, x in enumerate(q.tolist())], 7, ("query_id", "vec_id", "embedding", None), False, None)(iter(pdfs)))
    assert len(got) == 7 * len(q)
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    s = np.round(unit(q) @ unit(v).T, 9)
    for i, rows in got.groupby("query_id"):
        assert rows["vec_id"].tolist() == np.lexsort((np.arange(len(v)), -s[i]))[:7].tolist()


def test_queries_that_ask_the_same_share_their_list_of_apps(spark, sf):
    t = lambda name: view(spark, sf, name)
    terms = {f: F.lit(None).cast("array<string>") for f in S.TERM_FIELDS} | {"platforms": F.when(F.col("query_id") % 3 == 0, F.array(F.lit("linux")))}
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, 950.0).alias("max_price_usd"), F.lit(None).cast("boolean").alias("free_only"), F.lit(None).cast("int").alias("min_players")).withColumns(terms)
    index = M.catalogue_index(S.catalog_join(t("apps"), t("app_genres"), t("genres")))
    of, fits = W._kinds(asked, index)
    assert of.count() == 40 and {r.kind for r in of.collect()} == {0, 1, 2, 3} and fits.count() <= 4 * index.apps.count()
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(_points(120, 3).tolist())], "vec_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(k, v) for k, v in enumerate(_points(40, 4).tolist())], "query_id bigint, query_vec array<double>")
    meets = {(r.query_id, r.appid) for r in M.constraint_match(asked, index).collect()}
    near = {}
    for r in K.dense_topk(queries, vectors, 120).orderBy("query_id", "rank").collect():
        if (r.query_id, r.vec_id) in meets:
            near.setdefault(r.query_id, []).append(r.vec_id)
    for block in (1000, 1):
        got = {}
        for r in W.filter_then_vector(queries, vectors, asked, index, 9, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: x[:9] for q, x in near.items()}
    assert {(r.query_id, r.vec_id) for r in W.vector_then_filter(queries, vectors, asked, index, 20).collect()} <= meets


def test_a_batch_of_the_live_index_has_parts_of_a_fixed_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "PART_BYTES", 500)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("red ring number "), F.col("id").cast("string")).alias("text")).coalesce(1)
    index = live.LiveIndex(spark, str(tmp_path))
    index.put(docs, 0)
    index.put(docs.filter("doc_id < 3").withColumn("text", F.lit("blue")), 1)
    assert len(list((tmp_path / "postings" / index.segments()[0].name).glob("part-*.parquet"))) > spark.sparkContext.defaultParallelism
    assert {r.term: r.df for r in index.index().terms.collect() if not r.term.isdigit()} == {"red": 397, "ring": 397, "number": 397, "blue": 3}
    assert "SortMergeJoin" not in index.live()[1]._jdf.queryExecution().executedPlan().toString()


def test_the_state_is_read_and_written_once_for_a_user_and_batch():
    class Kept:
        rows, calls = (), 0

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def put(self, rows):
            self.calls, self.rows = self.calls + 1, rows

    kept = {"recent": Kept(), "clicked": Kept()}
    users = RecentActions(3)
    users.init(type("Handle", (), {"getListState": lambda self, name, schema: kept[name]})())
    event = Row("event_id", "ts", "type", "appid", "query")
    events = [event(k, datetime(2026, 1, 1) + timedelta(seconds=k * 7 % 1000), "click", k % 40, None) for k in range(1000)]
    got = list(users.handleInputRows((5,), iter(events), None))
    last = sorted(events, key=lambda e: (e.ts, e.event_id))[-3:][::-1]
    assert [r.event_id for r in got] == [e.event_id for e in last] and got[0].clicked == list(range(40))
    assert sum(k.calls for k in kept.values()) <= 4
    assert dict(kept["clicked"].rows) == {a: max(int(e.ts.timestamp()) * 10**6 for e in events if e.appid == a) for a in range(40)}


def test_trigrams_are_counted_without_lists_of_texts(spark, sf):
    bare = lambda t: "".join(c for c in t if c not in " \t\n\x0b\f\r")
    grams = lambda t: {t} if len(t) < 3 else {t[k : k + 3] for k in range(len(t) - 2)}
    texts = ["", " ", "ab", "a b", "abc", "abcab cabc", "가나다라 마바", "나다라", "\U0001f600\U0001f601 xy\U0001f600\U0001f601x", "\U0001f601xy", None]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", T.trigram_similarity("a", "b").alias("s")).collect():
        if r.a is None or r.b is None:
            assert r.s is None
        else:
            x, y = grams(bare(r.a)), grams(bare(r.b))
            assert r.s == len(x & y) / len(x | y)
    assert "array_distinct(" not in catalogue.queries()["x05_jaccard"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_a_reason_makes_each_of_its_parts_once(spark, sf):
    plan = catalogue.queries()["p26_build_reason"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and plan.count("from_json") <= 2
