"""Sources, sinks, behaviour scores and streams: each query writes data derived from the given tables and reads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from gamelode.operators import behaviour as B
from gamelode.plans.bindings import Registry
from gamelode.plans.label_queries import PANEL, panel
from gamelode.sources import files as S
from gamelode.sources.scratch import scratch
from gamelode.streaming import events as E
from gamelode.streaming.live import LiveIndex, write_live_index

R = Registry()


@R.add("s01_read_game_json", "select doc_id as appid, source as name, lang as type, length(text) as len from documents")
def _(t):
    d = t("documents")
    data = F.struct(F.col("lang").alias("type"), F.col("source").alias("name"), F.lit(False).alias("is_free"), F.col("text").alias("detailed_description"), F.lit("").alias("short_description"))
    path = scratch(d.sparkSession, "games")
    d.select(F.col("doc_id").alias("appid"), F.struct(F.lit(True).alias("success"), data.alias("data")).alias("app_details")).write.option("compression", "gzip").json(path)
    x = F.col("app_details.data")
    return S.read_game_json(d.sparkSession, path, lines=True).select("appid", x["name"].alias("name"), x["type"].alias("type"), F.length(x["detailed_description"]).alias("len"))


@R.add("s02_read_jsonl", "select conv_id, arg_max(role, turn) as role, max(turn) as turn from conversations group by conv_id")
def _(t):
    c = t("conversations")
    path = scratch(c.sparkSession, "jsonl")
    c.write.json(path)
    return S.read_jsonl(c.sparkSession, path, "conv_id bigint, turn bigint, role string, text string", "conv_id", "turn").select("conv_id", "role", "turn")


@R.add("s03_read_reviews_csv", "select recommendationid, appid, language, review_text, voted_up from reviews", "reviews")
def _(t):
    r = t("reviews")
    path = scratch(r.sparkSession, "csv")
    r.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = S.read_reviews_csv(r.sparkSession, path, r.schema)
    return back.select("recommendationid", "appid", "language", "review_text", "voted_up")


@R.add("s04_read_pg_copy", "select p_partkey::varchar as id, concat(p_name, chr(9), 'x\\y') as name, case when p_partkey % 5 <> 0 then p_brand end as brand from part")
def _(t):
    p = t("part")
    spark, path = p.sparkSession, scratch(p.sparkSession, "copy")
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
    name = esc(F.concat("p_name", F.lit("\tx\\y")))
    row = F.concat_ws("\t", F.col("p_partkey").cast("string"), name, F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise("\\N"))
    key = F.pmod(F.xxhash64("p_partkey"), F.lit(8)).alias("k")  # a dump file each; lines are rows, put in order file by file
    head = ["-- dump", "COPY public.other (a) FROM stdin;", "1", "\\.", "COPY public.part (id, name, brand) FROM stdin;"]
    fixed = spark.range(8).select("id", F.posexplode(F.array(*map(F.lit, [*head, "short", "\\."]))).alias("at", "value"))
    around = fixed.select(F.col("id").alias("k"), F.when(F.col("at") < len(head), F.col("at")).otherwise(F.col("at") + 1).alias("at"), F.lit(0).cast("bigint").alias("n"), "value")
    lines = around.unionByName(p.select(key, F.lit(len(head)).alias("at"), F.col("p_partkey").cast("bigint").alias("n"), row.alias("value")))
    lines.repartition("k").sortWithinPartitions("k", "at", "n").select("k", "value").write.partitionBy("k").text(path)
    return S.read_pg_copy(spark, path, "part", ["id", "name", "brand"])


@R.add("s06_parse_embedding_json", "select vec_id, len(embedding) as dim, round(list_sum(embedding::double[]), 4) as total from embeddings")
def _(t):
    v = S.parse_embedding_json(F.to_json("embedding"))
    return t("embeddings").select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@R.add("s07_write_parts", "select recommendationid, appid from reviews", "reviews")
def _(t):
    r = t("reviews").select("recommendationid", "appid")
    spark, path = r.sparkSession, scratch(r.sparkSession, "parts")
    S.write_parts(r.filter("recommendationid % 3 = 0"), path, ["recommendationid"])
    S.write_parts(r, path, ["recommendationid"], spark.read.parquet(path))
    return spark.read.parquet(path)


@R.add("s08_write_split_jsonl", "select doc_id, case doc_id % 10 when 0 then 'test' when 1 then 'valid' else 'train' end as split from documents")
def _(t):
    d = t("documents").select("doc_id", "text", F.expr("case doc_id % 10 when 0 then 'test' when 1 then 'valid' else 'train' end").alias("split"))
    path = scratch(d.sparkSession, "split")
    S.write_split_jsonl(d, path, "split")
    return d.sparkSession.read.schema("doc_id bigint, text string, split string").json(path).select("doc_id", "split")


@R.add("s09_write_panel_json", f"with {PANEL} select appid, review_count, top_positive from panel", "rows_of picked")
def _(t):
    p = panel(t)
    path = scratch(p.sparkSession, "panel")
    S.write_panel_json(p.withColumn("tops", F.split("top_positive", ",")), path)
    return p.sparkSession.read.schema("appid bigint, review_count bigint, top_positive string").json(f"{path}/json").select("appid", "review_count", F.coalesce("top_positive", F.lit("")).alias("top_positive"))


ANSWER = """case when turn % 4 = 3 then 'no json' else concat('{"장르":"', role, '","핵심플레이":"p', conv_id, '","특징":"f"}') end"""


@R.add("s11_collect_responses", f"with e as (select conv_id * 100 + turn as appid, {ANSWER} as a from conversations) select appid, a::json->>'장르' as genre, a::json->>'핵심플레이' as core_play from e where a <> 'no json'")
def _(t):
    c = t("conversations")
    env = F.to_json(F.struct((F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("key"), F.expr(ANSWER).alias("response"), F.lit(10).alias("input_tokens"), F.lit(5).alias("output_tokens")))
    good, _ = S.collect_responses(c.select(env.alias("value")))
    return good.select("appid", F.col("summary.genre").alias("genre"), F.col("summary.core_play").alias("core_play"))


@R.add("s11_response_cost", "select count(*) * 10 as input_tokens, count(*) * 5 as output_tokens, round(count(*) * 10 * 0.05 / 1e6 + count(*) * 5 * 0.20 / 1e6, 9) as cost from conversations")
def _(t):
    env = F.to_json(F.struct(F.lit("1").alias("key"), F.lit("").alias("response"), F.lit(10).alias("input_tokens"), F.lit(5).alias("output_tokens")))
    return S.collect_responses(t("conversations").select(env.alias("value")))[1]


@R.add("s05_read_f32_matrix", "select vec_id as vector_index, len(embedding) as dim, round(list_sum(embedding::double[]), 4) as total from embeddings")
def _(t):
    """All vectors of the table written as float files by the tasks, and read as records."""
    e = t("embeddings")
    dim, path = e.agg(F.max(F.size("embedding"))).first()[0] or 1, scratch(e.sparkSession, "f32")
    S.write_f32_matrix(e, path, "vec_id", "embedding")
    m = S.read_f32_matrix(e.sparkSession, path, dim)
    return m.select("vector_index", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


PREF = """recent as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as place from interactions), r as (select *, pow(0.7, place) as w from recent where place < 10),
g as (select p_partkey as appid, lower(p_name) as name, lower(concat(p_name, ' ', p_brand, ' ', p_type)) as ctx, [p_brand, p_type] as tags from part),
asked as (select distinct lower(trim(query)) as query from r where type = 'search' and query is not null),
hit as (select query, appid from asked, g where contains(g.name, query) or len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x : len(list_filter(regexp_split_to_array(ctx, '[^0-9a-z가-힣]+'), lambda y : contains(y, x))) > 0)) > 0),
s as (select user_id, hit.appid as appid, 0.35 * w as s from r join hit on hit.query = lower(trim(r.query)) where r.type = 'search' union all
 select r.user_id, b.appid as appid, 0.15 * w * len(list_intersect(list_distinct(a.tags), list_distinct(b.tags))) from r join g a on a.appid = r.appid join g b on len(list_intersect(a.tags, b.tags)) > 0 where r.type = 'click'),
gone as (select distinct user_id, appid from r where type = 'click' and appid is not null)
select user_id, appid, round(0.5 + sum(s), 12) as score from s where not exists (select 1 from gone where gone.user_id = s.user_id and gone.appid = s.appid) group by 1, 2"""


def _games(t):
    return t("part").select(F.col("p_partkey").alias("appid"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("context"), F.array("p_brand", "p_type").alias("tags"))


@R.add("t02_preference_scores", f"with {PREF}", "interactions")
def _(t):
    return B.preference_scores(t("interactions"), _games(t)).select("user_id", "appid", "score")


@R.add("t02_preference_topk", f"with p as (with {PREF}) select user_id, appid, score, rank from (select *, row_number() over (partition by user_id order by score desc, appid) as rank from p) where rank <= 20", "interactions")
def _(t):
    return B.best_games(t("interactions"), _games(t), 20).best.select("user_id", "appid", "score", F.col("rank").cast("bigint").alias("rank"))


@R.add("t08_recent_context", """with recent as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as place from interactions)
select user_id, string_agg(concat(type, ':', coalesce(query, appid::varchar, ''), '(', round(pow(0.7, place), 2)::decimal(4,2), ')'), ', ' order by place) as context from recent where place < 3 group by 1""", "interactions")
def _(t):
    return B.recent_context(t("interactions"))


LOGGED = "select event_id, user_id, i.type, nullif(trim(query), '') as query, case when i.type = 'click' then coalesce(a.name, 'unknown game') end as game_name from interactions i left join apps a on a.appid = i.appid where (i.type = 'search' and nullif(trim(query), '') is not null) or (i.type = 'click' and i.appid is not null)"


@R.add("t01_event_log_batch", LOGGED, "interactions apps")
def _(t):
    return E.event_log(t("interactions"), t("apps")).select("event_id", "user_id", "type", "query", "game_name")


def _stream(t, parts: int = 4):
    """interactions as files, and the stream over them."""
    i = t("interactions").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "type", "appid", "query")
    spark, path = i.sparkSession, scratch(i.sparkSession, "stream")
    i.repartition(parts, "event_id").write.parquet(path)
    return spark, E.read_events(spark, path)


def _finished(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@R.add("t01_event_log_stream", LOGGED, "interactions apps")
def _(t):
    spark, events = _stream(t)
    out = scratch(spark, "log")
    log = E.event_log(events, t("apps")).select("event_id", "user_id", "type", "query", "game_name")
    _finished(log.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "ckpt")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


@R.add("t07_running_counters", "select type, count(*) as n from interactions group by 1", "interactions")
def _(t):
    spark, events = _stream(t)
    out = scratch(spark, "counters")
    put = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    _finished(E.running_counters(events).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", scratch(spark, "ckpt")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


@R.add("t05_live_index", "select term, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(text, '[가-힣]+|[a-zA-Z]+|[0-9]+')) as term from documents) group by 1")
def _(t):
    d = t("documents").select("doc_id", "text")
    spark, path = d.sparkSession, scratch(d.sparkSession, "docs")
    d.repartition(4, "doc_id").write.parquet(path)
    out = scratch(spark, "index")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(path)
    _finished(write_live_index(stream, out, scratch(spark, "ckpt")))
    return LiveIndex(spark, out).index().terms


@R.add("t09_stream_quality", "select recommendationid from reviews where lower(trim(language)) = 'english' and trim(regexp_replace(review_text, '\\s+', ' ', 'g')) <> ''", "reviews")
def _(t):
    r = t("reviews").select("recommendationid", "language", "review_text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("recommendationid") % 60).alias("ts"))
    spark, path, out = r.sparkSession, scratch(r.sparkSession, "reviews"), scratch(r.sparkSession, "quality")
    r.write.parquet(path)
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 4).parquet(path)
    _finished(E.stream_quality(stream).select("recommendationid").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "ckpt")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


@R.add("t06_recent_state", """with c as (select user_id, string_agg(appid::varchar, ',' order by appid) as clicked from (select distinct user_id, appid from interactions where type = 'click' and appid is not null) group by 1)
select n.user_id, event_id, n - 1 as place, coalesce(clicked, '') as clicked from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from interactions) n left join c on c.user_id = n.user_id where n <= 10""", "interactions")
def _(t):
    """State needs the RocksDB store, which is set for this query alone. The last output of each user is its state."""
    spark, events = _stream(t)
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    out, before = scratch(spark, "state"), spark.conf.get(key)
    put = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")
    spark.conf.set(key, store)
    try:
        _finished(E.recent_state(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", scratch(spark, "ckpt")).trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    rows = spark.read.parquet(out)
    last = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["user_id", "batch"]).select("user_id", "event_id", "place", F.array_join(F.transform("clicked", lambda x: x.cast("string")), ",").alias("clicked"))
