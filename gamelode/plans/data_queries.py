"""Review and document funnels: filters, joins, de-duplication, sampling, reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gamelode.functions import text as T
from gamelode.functions.hashing import hash_order
from gamelode.operators import aggregates as G
from gamelode.operators import decisions as D
from gamelode.operators import ranking as K
from gamelode.operators import sampling as U
from gamelode.operators.behaviour import STRIDES, cold_start
from gamelode.plans.bindings import Registry

R = Registry()
AXES = ["ax1", "ax2", "ax3"]
WORDS = "(case when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) end)"
H = "md5(concat('{0}:', {1}))"


@R.add("f02_min_length", "select doc_id, n_chars from documents where n_chars >= 200")
def _(t):
    return t("documents").filter("n_chars >= 200").select("doc_id", "n_chars")


@R.add("f03_length_band", f"select doc_id, {WORDS} as words from documents where {WORDS} between 5 and 500")
def _(t):
    return t("documents").select("doc_id", T.word_count("text").alias("words")).filter("words between 5 and 500")


@R.add("f04_language_filter", "select recommendationid from reviews where lower(trim(language)) = 'english'", "reviews")
def _(t):
    return t("reviews").filter(F.lower(F.trim("language")) == "english").select("recommendationid")


RARE = {"pos__rest": ("\\brest\\b", "\\beast\\b"), "pos__other": ("\\bother\\b", "\\bthe that\\b", "thion"), "neg__trash": ("\\btrash\\b", "\\bdisgusting\\b", "\\bscum\\b"), "neg__stupid": ("\\bstupid\\b", "\\bworthless\\b"), "pos__legal": ("\\blicensed?\\b", "\\ball rights\\b"), "neg__secret": ("password=", "token = ")}
RARE_SQL = " union all ".join(f"select doc_id, '{k}' as target_label from documents where regexp_matches(text, '(?i){'|'.join(v)}')" for k, v in RARE.items())


def _rare(t):
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike("(?i)" + "|".join(v)), F.lit(k)) for k, v in RARE.items())))
    return t("documents").select("doc_id", F.explode(found).alias("target_label"))


@R.add("f12_rare_topic_match", RARE_SQL)
def _(t):
    return _rare(t)


@R.add("f13_gold_row_filter", "select doc_id from labels where quality = 1 and toxic is not null")
def _(t):
    rows = t("labels")
    for column, test in (("quality", F.col("quality") == 1), ("status", F.lit(True)), ("toxic", F.col("toxic").isNotNull())):
        rows = rows.filter(test) if column in rows.columns else rows
    return rows.select("doc_id")


@R.add("f17_pending_rows", "select doc_id from labels where coalesce(nullif(trim(case when doc_id % 3 = 0 then ' ' when doc_id % 3 = 1 then 'done' end), ''), 'pending') = 'pending' order by doc_id limit 50")
def _(t):
    status = F.expr("case when doc_id % 3 = 0 then ' ' when doc_id % 3 = 1 then 'done' end")
    return t("labels").filter(F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("pending")) == "pending").orderBy("doc_id").limit(50).select("doc_id")


@R.add("j02_embedding_join", "select e.vec_id, p.p_name, len(e.embedding) as dim from embeddings e join part p on p.p_partkey = e.vec_id")
def _(t):
    return t("embeddings").join(t("part"), F.col("vec_id") == F.col("p_partkey")).select("vec_id", "p_name", F.size("embedding").alias("dim"))


@R.add("j03_split_semi_join", "with d as (select doc_id, doc_id % 3 as split from documents) select split, count(*) as orig, count(*) filter (where doc_id in (select doc_id from labels)) as kept from d group by split")
def _(t):
    d = t("documents").select("doc_id", (F.col("doc_id") % 3).alias("split"))
    kept = d.join(t("labels").select("doc_id"), "doc_id", "left_semi").groupBy("split").agg(F.count("*").alias("kept"))
    return d.groupBy("split").agg(F.count("*").alias("orig")).join(kept, "split", "left").select("split", "orig", F.coalesce("kept", F.lit(0)).alias("kept"))


@R.add("j04_anti_done", "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@R.add("j05_apply_decisions", """
select d.doc_id, case when d.doc_id % 11 = 3 then concat('fixed ', d.lang) when d.doc_id % 13 = 0 and l.quality = 0 then 'early access' else d.source end as summary,
 case when d.doc_id % 11 = 3 then 'fix' when d.doc_id % 7 = 2 then 'keep_reviewed' when d.doc_id % 13 = 0 and l.quality = 0 then 'ea_fix' else 'auto' end as review
 from documents d left join labels l on l.doc_id = d.doc_id where d.doc_id % 17 <> 5 and not (d.doc_id % 11 <> 3 and d.doc_id % 7 = 2 and d.doc_id % 13 = 0 and l.quality = 0 and false)""".replace("when d.doc_id % 13 = 0 and l.quality = 0 then 'early access'", "when d.doc_id % 7 <> 2 and d.doc_id % 13 = 0 and l.quality = 0 then 'early access'"))
def _(t):
    d = t("documents")
    decisions = d.select("doc_id", F.expr("case when doc_id % 17 = 5 then 'drop' when doc_id % 11 = 3 then 'fix' when doc_id % 7 = 2 then 'keep' end").alias("decision")).filter("decision is not null")
    fixes = t("labels").filter("quality = 0 and doc_id % 13 = 0").select("doc_id", F.lit("early access").alias("text_fix"))
    j = d.select("doc_id", "lang", "source").join(decisions, "doc_id", "left").join(fixes, "doc_id", "left").filter("decision is null or decision <> 'drop'")
    review = F.when(F.col("decision") == "fix", "fix").when(F.col("decision") == "keep", "keep_reviewed").when(F.col("text_fix").isNotNull(), "ea_fix").otherwise("auto")
    out = j.withColumn("review", review)
    return out.select("doc_id", F.when(F.col("review") == "fix", F.concat(F.lit("fixed "), "lang")).when(F.col("review") == "ea_fix", F.col("text_fix")).otherwise(F.col("source")).alias("summary"), "review")


DECISIONS = (("drop", ("ring", "old anvil")), ("fix", ("gear", "red")), ("keep", ("rod", "plate", "bolt", "widget", "gizmo", "anvil")))
DECISION_SQL = " ".join(f"when contains(p_name, '{w}') then '{d}'" for d, words in DECISIONS for w in words)


@R.add("j06_classify_by_keyword", f"select p_partkey, case {DECISION_SQL} end as decision from part")
def _(t):
    return D.classify_by_keyword(t("part"), "p_name", DECISIONS).select("p_partkey", "decision")


@R.add("j07_priority_union", "select doc_id, source as name, 'primary' as origin from documents where doc_id % 3 <> 0 union all select doc_id, lang, 'secondary' from documents where doc_id % 3 = 0")
def _(t):
    d = t("documents")
    first = d.filter("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("name"), F.lit("primary").alias("origin"))
    second = d.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", F.col("lang").alias("name"), F.lit("secondary").alias("origin"))
    return D.priority_union(first, second, "doc_id")


@R.add("j11_ground", """
with e as (select l_orderkey, l_partkey, l_linenumber from lineitem where l_linenumber % 2 = 0), c as (select l_orderkey, l_partkey, min(l_linenumber) as pos from lineitem where l_linenumber <> 4 group by 1, 2),
a as (select c.l_orderkey, c.l_partkey, min(e.l_linenumber) as pos, 'told' as text from c join e on e.l_orderkey = c.l_orderkey and e.l_partkey = c.l_partkey group by 1, 2),
b as (select l_orderkey, l_partkey, 100 + pos as pos, '' as text from c where not exists (select 1 from a where a.l_orderkey = c.l_orderkey and a.l_partkey = c.l_partkey)),
u as (select * from a union all select * from b)
select l_orderkey, l_partkey, text, rank from (select *, row_number() over (partition by l_orderkey order by pos, l_partkey) as rank from u) where rank <= 3""")
def _(t):
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    out = D.ground(line.filter("l_linenumber % 2 = 0"), line.filter("l_linenumber <> 4"), ["l_orderkey"], "l_partkey", "l_linenumber", 3)
    return out.select("l_orderkey", "l_partkey", F.when(F.col("is_told"), "told").otherwise("").alias("text"), F.col("rank").cast("bigint").alias("rank"))


@R.add("j12_common_ids", "select conv_id from conversations group by conv_id having count(distinct role) = (select count(distinct role) from conversations)")
def _(t):
    c = t("conversations").select("conv_id", "role")
    n = c.agg(F.count_distinct("role").alias("n"))
    return c.groupBy("conv_id").agg(F.count_distinct("role").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("conv_id")


@R.add("j13_variant_corpus", "select v.variant, e.vec_id, case when v.variant = 'b' and e.vec_id % 10 = 0 then e.label + 100 else e.label end as label from embeddings e cross join (values ('a'), ('b')) v(variant)")
def _(t):
    e = t("embeddings").select("vec_id", "label")
    put = e.filter("vec_id % 10 = 0").select(F.lit("b").alias("variant"), "vec_id", (F.col("label") + 100).alias("label"))
    return D.variant_corpus(e, put, "vec_id", "label", ["a", "b"]).select("variant", "vec_id", "label")


@R.add("j14_first_game_hit", "with r as (select l_orderkey as query_id, l_partkey as appid, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rank from lineitem) select query_id, arg_min(r.appid, rank) as appid from r join apps a on a.appid = r.appid and a.type = 'game' and a.name is not null where rank <= 50 group by 1", "apps")
def _(t):
    r = K.rank_rows(t("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("appid"), "l_extendedprice", "l_linenumber"), ["query_id"], [F.desc("l_extendedprice"), F.col("l_linenumber")])
    return D.first_hit(r, t("apps").filter("type = 'game' and name is not null"), "query_id", "appid")


PARTNER = "case when event_id % 3 = 0 then concat('[\"', event_id, '\",\"x\",\"', user_id, '\"]') when event_id % 3 = 1 then '[\"7\",null]' else '[]' end"


@R.add("j15_partner_results", f"""with l as (select event_id, json_extract_string({PARTNER}, '$[*]') as a from events), e as (select event_id, unnest(a) as v, generate_subscripts(a, 1) as pos from l)
select event_id, try_cast(v as bigint) as appid, row_number() over (partition by event_id order by pos) as rank, '' as text from e where try_cast(v as bigint) is not null""")
def _(t):
    return D.partner_results(t("events").select("event_id", F.expr(PARTNER).alias("ids")), "event_id", "ids")


@R.add("j16_eval_targets", "select d.doc_id, coalesce(l.quality::varchar, '') as short from documents d left join labels l on l.doc_id = d.doc_id where length(d.text) > 0 and d.doc_id in (select doc_id from labels where toxic = 0)")
def _(t):
    good = t("documents").filter(F.length("text") > 0).select("doc_id").join(t("labels").filter("toxic = 0").select("doc_id"), "doc_id", "left_semi")
    return good.join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("short"))


@R.add("u01_dedup_key", "select doc_id, lang, source from (select *, row_number() over (partition by lang, source order by doc_id) as n from documents) where n = 1")
def _(t):
    return U.dedup_key(t("documents"), ["lang", "source"], ["doc_id"]).select("doc_id", "lang", "source")


@R.add("u02_dedup_id_then_text", "with a as (select *, row_number() over (partition by doc_id order by doc_id) as n from documents), b as (select *, row_number() over (partition by case when coalesce(text, '') = '' then 'row ' || doc_id else text end order by doc_id) as k from a where n = 1) select doc_id from b where k = 1")
def _(t):
    return U.dedup_id_then_text(t("documents"), "doc_id", "text", ["doc_id"]).select("doc_id")


@R.add("u03_dedup_text", "select min(doc_id) as doc_id from documents group by text")
def _(t):
    return U.dedup_text(t("documents"), "text", ["doc_id"], "doc_id").select("doc_id")


@R.add("u04_split_exact", f"with n as (select count(*) as n from documents), r as (select doc_id, row_number() over (order by {H.format(42, 'doc_id')}, doc_id) as rn from documents) select doc_id, case when rn <= floor(n * 0.8) then 'train' when rn <= floor(n * 0.8) + floor(n * 0.1) then 'valid' else 'test' end as split from r, n")
def _(t):
    return U.split_exact(t("documents").select("doc_id"), (0.8, 0.1, 0.1), ("train", "valid", "test"), 42, "doc_id").select("doc_id", "split")


@R.add("u05_global_row_number", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as rn from orders")
def _(t):
    return U.global_row_number(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "rn")


@R.add("u06_sample_n", f"select doc_id from documents order by {H.format(7, 'doc_id')}, doc_id limit 100")
def _(t):
    return U.sample_n(t("documents").select("doc_id"), 100, 7, "doc_id")


@R.add("u07_sample_per_label", f"""with d as (select d.doc_id, quality, doc_id % 50 as appid from documents d join labels using (doc_id)), a as (select *, row_number() over (partition by quality, appid order by {H.format(42, 'doc_id')}, doc_id) as k from d),
b as (select *, row_number() over (partition by quality order by {H.format(42, 'doc_id')}, doc_id) as n from a where k <= 2) select doc_id, quality, row_number() over (order by {H.format('42 order', 'doc_id')}, doc_id) as annotation_id from b where n <= 5""")
def _(t):
    d = t("documents").select("doc_id", (F.col("doc_id") % 50).alias("appid")).join(t("labels"), "doc_id")
    return U.sample_per_label(d, "quality", "appid", "doc_id", 5, 2, 42).select("doc_id", "quality", "annotation_id")


@R.add("u08_reservoir_per_group", f"select doc_id, lang from (select *, row_number() over (partition by lang order by {H.format(3, 'doc_id')}, doc_id) as n from documents) where n <= 20")
def _(t):
    return U.sample_per_group(t("documents").select("doc_id", "lang"), "lang", "doc_id", 20, 3).select("doc_id", "lang")


@R.add("u09_stratified_sample", f"""with d as (select doc_id, case when n_chars < 500 then 'short' when n_chars < 1500 then 'mid' else 'long' end as bucket from documents), c as (select bucket, count(*) as nb from d group by 1),
q as (select bucket, greatest(1, round_even(60.0 * nb / (select sum(nb) from c), 0)) as q from c), r as (select d.*, row_number() over (partition by bucket order by {H.format(5, 'doc_id')}, doc_id) as n from d)
select doc_id, r.bucket from r join q on q.bucket = r.bucket where n <= q order by {H.format(5, 'doc_id')}, doc_id limit 60""")
def _(t):
    d = t("documents").select("doc_id", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 1500, "mid").otherwise("long").alias("bucket"))
    return U.stratified_sample(d, "bucket", "doc_id", 60, 5).select("doc_id", "bucket")


@R.add("u10_quantile_sample", "with r as (select doc_id, n_chars, row_number() over (order by n_chars, doc_id) - 1 as rn, count(*) over () as n from documents) select doc_id, n_chars from r where rn in (select cast(round_even(i * (n - 1) / 24.0, 0) as bigint) from range(25) t(i), (select count(*) as n from documents))")
def _(t):
    return U.quantile_sample(t("documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 25).select("doc_id", "n_chars")


@R.add("u11_multilabel_split", f"""with l as (select distinct doc_id, x as label from (select doc_id, unnest([lang, source]) as x from documents)), c as (select label, count(*) as c from l group by 1),
r as (select l.doc_id, arg_min(l.label, c.c * 1000 + ascii(right(l.label, 1)) / 1000.0) as label from l join c on c.label = l.label group by 1), k as (select doc_id, count(*) as n from l group by 1),
m as (select l.doc_id, first(l.label order by c.c, l.label) as rarest from l join c on c.label = l.label group by 1)
select doc_id, case when row_number() over (partition by rarest order by {H.format(9, 'doc_id')}, doc_id) % 10 = 0 then 'valid' else 'train' end as split from m""")
def _(t):
    d = t("documents").select("doc_id", F.array("lang", "source").alias("labels"))
    return U.multilabel_split(d, "labels", "doc_id", 0.1, 9).select("doc_id", "split")


@R.add("u11_iterative_split")
def _(t):
    d = t("documents").select("doc_id", F.array("lang", "source").alias("labels"))
    return U.iterative_split(d, "labels", "doc_id", 0.1, 9).select("doc_id", "split")


@R.add("u12_eval_subset", f"(select vec_id from embeddings where label = 0) union all (select vec_id from embeddings where label <> 0 order by {H.format(4, 'vec_id')}, vec_id limit (select greatest(0, 120 - count(*)) from embeddings where label = 0))")
def _(t):
    e = t("embeddings").select("vec_id", "label")
    return U.eval_subset(e, e.filter("label = 0"), "vec_id", 120, 4).select("vec_id")


@R.add("u13_merge_targets", f"select doc_id, string_agg(distinct target_label, '|' order by target_label) as targets from ({RARE_SQL}) group by doc_id")
def _(t):
    return _rare(t).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("target_label")), "|").alias("targets"))


@R.add("u14_set_ops", "select 'both' as part, count(*) as n from (select c_custkey from customer intersect select o_custkey from orders) union all select 'only', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'all', count(*) from (select c_custkey from customer union select o_custkey from orders)")
def _(t):
    a, b = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    one = lambda d, name: d.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return one(a.intersect(b), "both").union(one(a.subtract(b), "only")).union(one(a.union(b).distinct(), "all"))


@R.add("p20_cyclic_assign", "select c_custkey, ['a', 'b', 'c'][(row_number() over (order by c_custkey) - 1) % 3 + 1] as assigned from customer")
def _(t):
    return U.cyclic_assign(t("customer").select("c_custkey"), ["c_custkey"], ["a", "b", "c"])


@R.add("s10_request_chunks", "with d as (select doc_id, substr(text, 1, 2000) as text from documents where doc_id not in (select doc_id from labels)) select doc_id, (row_number() over (order by doc_id) - 1) // 250 as chunk, length(text) as chars from d")
def _(t):
    d = t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.substring("text", 1, 2000).alias("text"))
    return U.request_chunks(d, ["doc_id"], 250).select("doc_id", "chunk", F.length("text").alias("chars"))


@R.add("g01_length_stats", """with r as (select n_chars, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents)
select count(*) as n, min(n_chars) as min, cast(floor(median(n_chars)) as bigint) as median, round(avg(n_chars), 1) as mean, max(n_chars) filter (where i = least(n - 1, floor(0.9 * n))) as p90, max(n_chars) filter (where i = least(n - 1, floor(0.99 * n))) as p99, max(n_chars) as max from r""")
def _(t):
    return G.length_stats(t("documents"), "n_chars")


@R.add("g02_describe", "select lang, count(n_chars) as n, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 6) as std, min(n_chars) as min, round(quantile_cont(n_chars, 0.01), 6) as q1, round(quantile_cont(n_chars, 0.5), 6) as q50, round(quantile_cont(n_chars, 0.99), 6) as q99, max(n_chars) as max from documents group by lang")
def _(t):
    d = G.describe(t("documents"), "n_chars", ["lang"], [0.01, 0.5, 0.99])
    return d.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", *(F.round(c, 6).alias(c) for c in ("q1", "q50", "q99")), "max")


@R.add("g03_pct_round", "with r as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events where value is not null) select p::double as p, max(value) as value from r, (values (50), (90), (99)) v(p) where i = round_even(p / 100.0 * (n - 1), 0) group by p")
def _(t):
    return G.pct_round(t("events"), "value", [50.0, 90.0, 99.0])


@R.add("g04_funnel_counts", f"select count(*) as rows_in, count(*) filter (where lang = 'en') as english, count(*) filter (where lang = 'en' and length(text) > 0) as filled, count(*) filter (where lang = 'en' and {WORDS} between 5 and 500) as in_band from documents")
def _(t):
    en, words = F.col("lang") == "en", T.word_count("text")
    return t("documents").agg(F.count("*").alias("rows_in"), F.count_if(en).alias("english"), F.count_if(en & (F.length("text") > 0)).alias("filled"), F.count_if(en & words.between(5, 500)).alias("in_band"))


@R.add("g05_value_distribution", "select coalesce(nullif(lang, 'es'), 'missing') as value, count(*) as n, round(100.0 * count(*) / (select count(*) from documents), 4) as percent from documents group by 1")
def _(t):
    return G.value_distribution(t("documents"), F.nullif("lang", F.lit("es")))


@R.add("g06_reviews_per_app", "with c as (select l_partkey, count(*) as n from lineitem where l_partkey is not null group by 1) select count(*) as apps, sum(n)::bigint as reviews, round(avg(n), 6) as mean, quantile_cont(n, 0.5) as median, max(n) as max from c")
def _(t):
    c = t("lineitem").filter("l_partkey is not null").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("apps"), F.sum("n").alias("reviews"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("max"))


@R.add("g07_duplicate_audit", "select count(*) as rows_in, count(doc_id) - count(distinct doc_id) as duplicate_ids, count(t) - count(distinct t) as duplicate_texts, count(*) filter (where text is null) as null_texts, count(*) filter (where trim(text) = '') as empty_texts from (select *, case when trim(coalesce(text, '')) <> '' then text end as t from documents)")
def _(t):
    return G.duplicate_audit(t("documents"), "doc_id", "text")


@R.add("g08_popularity_map", "select l_partkey as appid, count(*) as popularity from lineitem group by 1 having count(*) > 0")
def _(t):
    raw = t("lineitem").groupBy("l_partkey").agg(F.count("*").cast("string").alias("n"))
    return raw.select(F.col("l_partkey").alias("appid"), F.expr("try_cast(n as bigint)").alias("popularity")).filter("popularity > 0")


@R.add("g16_judge_tiers", """with t as (select *, case when least(ax1, ax2, ax3) = 0 then 'critical' when verdict = 'review' or least(ax1, ax2, ax3) = 1 then 'minor' else 'auto' end as tier from judge_scores)
select tier, count(*) as n, round(avg(ax1), 6) as mean1, round(avg(ax2), 6) as mean2, round(avg(ax3), 6) as mean3, count(*) filter (where ax1 = 0) as zero1 from t group by tier""", "judge_scores")
def _(t):
    return D.judge_tiers(t("judge_scores"), AXES).groupBy("tier").agg(F.count("*").alias("n"), *(F.round(F.avg(f"ax{k}"), 6).alias(f"mean{k}") for k in (1, 2, 3)), F.count_if(F.col("ax1") == 0).alias("zero1"))


@R.add("g16_review_queue", f"""with t as (select id, least(ax1, ax2, ax3) as low, case when least(ax1, ax2, ax3) = 0 then 'critical' when verdict = 'review' or least(ax1, ax2, ax3) = 1 then 'minor' else 'auto' end as tier from judge_scores),
m as (select id, tier, 9 as a, {H.format(42, 'id')} as b from t where tier = 'minor' order by b, id limit 60), u as (select id, tier, low as a, '' as b from t where tier = 'critical' union all select * from m)
select id, tier, row_number() over (order by a, b, id) as place from u""", "judge_scores")
def _(t):
    return D.review_queue(D.judge_tiers(t("judge_scores"), AXES), AXES, "id").select("id", "tier", "place")


@R.add("g16_score_distribution", "select axis, score, count(*) as n from (select 'ax1' as axis, ax1 as score from judge_scores union all select 'ax2', ax2 from judge_scores union all select 'ax3', ax3 from judge_scores) group by 1, 2", "judge_scores")
def _(t):
    return D.score_distribution(t("judge_scores"), AXES)


JUDGED = """t as (select d.doc_id, d.text as before, l.quality = 1 as supported, case doc_id % 4 when 0 then d.text when 1 then ' ' else substr(d.text, 1, 80) end as after
 from documents d left join labels l using (doc_id) where regexp_matches(d.text, 'License|trash|stupid|!!|%%') and doc_id not in (select doc_id from labels where toxic = 1)),
fixes as (select doc_id, after as text from t where supported = false and trim(after) <> '' and after <> before)"""


def _judged(t):
    hit = D.marker_targets(t("documents"), "doc_id", "text", ("License", "trash", "stupid", "!!", "%%"), t("labels").filter("toxic = 1")).join(t("labels"), "doc_id", "left")
    after = F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, " ").otherwise(F.substring("text", 1, 80))
    return hit.select("doc_id", F.col("text").alias("before"), (F.col("quality") == 1).alias("supported"), after.alias("after"))


@R.add("g17_marker_targets", f"with {JUDGED} select count(*) as targets, count(*) filter (where supported) as supported, count(*) filter (where not supported) as unsupported, (select count(*) from fixes) as applied_fixes from t")
def _(t):
    return D.fix_report(_judged(t), "doc_id")


@R.add("g17_fixes", f"with {JUDGED} select * from fixes")
def _(t):
    return D.fixes_of(_judged(t), "doc_id")


@R.add("g19_source_summary", f"with r as ({RARE_SQL}), s as (select * from (select *, row_number() over (partition by target_label order by {H.format(3, 'doc_id')}, doc_id) as n from r) where n <= 10) select target_label, count(*) as matched, (select count(*) from s where s.target_label = r.target_label) as sampled, (select count(*) from s join r r2 on r2.doc_id = s.doc_id where r2.target_label = r.target_label and s.target_label = r.target_label) as mentions from r group by target_label")
def _(t):
    r = _rare(t)
    s = U.sample_per_group(r, "target_label", "doc_id", 10, 3)
    mentions = s.join(r, ["doc_id", "target_label"]).groupBy("target_label").agg(F.count("*").alias("mentions"))
    return r.groupBy("target_label").agg(F.count("*").alias("matched")).join(s.groupBy("target_label").agg(F.count("*").alias("sampled")), "target_label", "left").join(mentions, "target_label", "left").fillna(0)


@R.add("g20_match_counts", "with e as (select event_type, least(1.0, greatest(0.0, coalesce(try_cast(case when event_id % 9 = 0 then 'bad' else (value / 50)::varchar end as double), 0.0))) as c from events) select event_type, count(*) filter (where c >= 0.5) as verified, count(*) as n from e group by 1")
def _(t):
    c = F.expr("least(1D, greatest(0D, coalesce(try_cast(case when event_id % 9 = 0 then 'bad' else cast(value / 50 as string) end as double), 0D)))")
    return t("events").select("event_type", c.alias("c")).groupBy("event_type").agg(F.count_if(F.col("c") >= 0.5).alias("verified"), F.count("*").alias("n"))


@R.add("x15_usage_cost", "select l_returnflag, round(sum(l_quantity * 0.05 / 1e6 + l_extendedprice * 0.20 / 1e6), 6) as cost, round(sum(l_quantity * 0.05 / 1e6 + l_extendedprice * 0.20 / 1e6) / count(*), 9) as per_item, count(*) as n from lineitem group by 1")
def _(t):
    cost = F.sum(F.col("l_quantity") * 0.05 / 1e6 + F.col("l_extendedprice") * 0.20 / 1e6)
    return t("lineitem").groupBy("l_returnflag").agg(F.round(cost, 6).alias("cost"), F.round(cost / F.count("*"), 9).alias("per_item"), F.count("*").alias("n"))


@R.add("w08_last_n_per_user", "select user_id, event_id, n - 1 as place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from interactions) where n <= 10", "interactions")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t("interactions").withColumn("n", F.row_number().over(w)).filter("n <= 10").select("user_id", "event_id", (F.col("n") - 1).cast("bigint").alias("place"))


NUMBER = "('0x' || substr(md5({0}), 1, 8))::bigint"


@R.add("t04_cold_start", f"""with new as (select c_custkey from customer where c_custkey not in (select user_id from events)),
placed as (select appid, row_number() over (order by {H.format(1, 'appid')}, appid) - 1 as at, count(*) over () as n from apps where type = 'game'),
s as (select list(p order by o) as strides from (values {', '.join(f'({p}, {k})' for k, p in enumerate(STRIDES))}) v(p, o) where (select max(n) from placed) % p <> 0),
u as (select c_custkey, {NUMBER.format("concat('1 begin own:', c_custkey)")} as b, strides[{NUMBER.format("concat('1 stride own:', c_custkey)")} % len(strides) + 1] as s from new, s)
select c_custkey, p.appid, k + 1 as rank, round(0.72 + 0.17 * ({NUMBER.format("concat('1 score own:', c_custkey, ':', p.appid)")} / 4294967296.0), 4) as score
from u, range(5) r(k) join placed p on p.at = (b + k * s) % p.n""", "apps")
def _(t):
    new = t("customer").select("c_custkey").join(t("events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")
    return cold_start(new, t("apps").filter("type = 'game'"), t("apps"), 5, "c_custkey", 1)
