"""Search over documents and vectors, fusion, metrics: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gamelode.operators import funnel as W
from gamelode.operators import ranking as K
from gamelode.operators import retrieval as V
from gamelode.operators import search as S
from gamelode.operators.postings import PostingsIndex
from gamelode.plans import search_queries as Q
from gamelode.plans.bindings import Registry
from gamelode.sources.scratch import stored

R = Registry()
PAT = "'[가-힣]+|[a-zA-Z]+|[0-9]+'"
BM25 = f"""tok as (select doc_id, unnest(regexp_extract_all(text, {PAT})) as term from documents), post as (select doc_id, term, count(*) as tf from tok group by 1, 2),
len as (select doc_id, len(regexp_extract_all(text, {PAT})) as l from documents), st as (select count(*) as n, avg(l) as av from len), df as (select term, count(*) as df from post group by 1),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, st), idf as (select term, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw),
q as (select item_id as query_id, term, count(*) as qf from (select item_id, unnest(regexp_extract_all(text, {PAT})) as term from benchmark) group by 1, 2),
bm as (select query_id, p.doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / av))), 6) as score from q join idf using (term) join post p using (term) join len on len.doc_id = p.doc_id, st group by 1, 2),
bmr as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm) where rank <= 200)"""
DEEP = BM25.replace("rank <= 200", "rank <= 1000")


def _bm25(t, k=200):
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return PostingsIndex(q.sparkSession).add(t("documents")).search(q, k).hits


@R.add("r01_bm25_index", f"with {BM25} select term, df, round(idf, 6) as idf from idf join df using (term)")
def _(t):
    d = t("documents")
    return PostingsIndex(d.sparkSession).add(d).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@R.add("r02_bm25_search", f"with {BM25} select query_id, doc_id, rank from bmr where rank <= 10")
def _(t):
    return _bm25(t, 10).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@R.add("r15_live_add", f"with {BM25} select term, df, round(idf, 6) as idf from idf join df using (term)")
def _(t):
    d = t("documents")
    index = V.bm25_index(d.filter("doc_id % 2 = 0")).add(d.filter("doc_id % 2 <> 0"))
    return V.bm25_idf(index).join(index.terms, "term").select("term", "df", F.round("idf", 6).alias("idf"))


DENSE = """qv as (select vec_id as query_id, embedding as q, label as ql from embeddings where vec_id % 100 = 0),
sc as (select query_id, vec_id, ql, label, round(list_cosine_similarity(q::double[], embedding::double[]), 9) as score from qv, embeddings),
de as (select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from sc) where rank <= 200)"""


def _dense(t, k=200, apart=False):
    e = t("embeddings")
    return K.dense_topk(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), e, k, apart=apart)


@R.add("r03_dense_search", f"with {DENSE} select query_id, vec_id, rank from de where rank <= 10")
def _(t):
    return _dense(t, 10).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@R.add("r03_near_search")
def _(t):
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return K.near_topk(q, e, 10).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@R.add("r04_cosine_to_unit", f"with {DENSE} select query_id, vec_id, round(least(1.0, greatest(0.0, (score + 1) / 2)), 6) as unit from de where rank <= 10")
def _(t):
    return _dense(t, 10).select("query_id", "vec_id", F.round(V.cosine_to_unit(F.col("score")), 6).alias("unit"))


def _second(t, depth=200):
    """A second ranking of the same documents: by length of the text within the first one's candidates."""
    bm = stored(_bm25(t, depth), "ranking")
    d = bm.select("query_id", "doc_id").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return bm, K.topk_per_group(d, ["query_id"], ["n_chars", "doc_id"], depth)


SECOND = "sec as (select query_id, doc_id, row_number() over (partition by query_id order by n_chars, doc_id) as rank from bmr join documents using (doc_id))"


@R.add("r05_rrf", f"with {BM25}, {SECOND}, u as (select query_id, doc_id, 1.0 / (60 + rank) as s from bmr union all select query_id, doc_id, 1.0 / (60 + rank) from sec) select query_id, doc_id, round(sum(s), 9) as score from u group by 1, 2")
def _(t):
    return V.rrf(list(_second(t))).select("query_id", "doc_id", F.round("score", 9).alias("score"))


@R.add("r06_hybrid_pop", f"""with {DEEP}, {SECOND}, u as (select query_id, doc_id, 1.0 / (59 + rank) as s from bmr union all select query_id, doc_id, 1.0 / (59 + rank) from sec),
f as (select query_id, u.doc_id, sum(s) as score, ln(1 + any_value(doc_id % 97)) as pop from u group by 1, 2),
a as (select *, round((score - min(score) over w) / (max(score) over w - min(score) over w + 1e-9) + 0.6 * (pop - min(pop) over w) / (max(pop) over w - min(pop) over w + 1e-9), 9) as first from f window w as (partition by query_id)),
b as (select * from (select *, row_number() over (partition by query_id order by first desc, doc_id) as n from a) where n <= 40),
c as (select *, round((score - min(score) over w) / (max(score) over w - min(score) over w + 1e-9) + 0.3 * (pop - min(pop) over w) / (max(pop) over w - min(pop) over w + 1e-9), 9) as final from b window w as (partition by query_id))
select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by final desc, doc_id) as rank from c) where rank <= 5""")
def _(t):
    pop = t("documents").select("doc_id", (F.col("doc_id") % 97).alias("popularity"))
    return V.hybrid_pop(list(_second(t, 1000)), pop, 5).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@R.add("r13_retrieval_metrics", f"with {BM25}, g as (select b.item_id as query_id, min(d.doc_id) as gold_doc from benchmark b join documents d on position(b.text in d.text) > 0 group by 1), h as (select g.query_id, r.rank from g left join bmr r on r.query_id = g.query_id and r.doc_id = g.gold_doc) select count(*) as queries, round(avg(coalesce((rank <= 1)::int, 0)), 6) as r1, round(avg(coalesce((rank <= 5)::int, 0)), 6) as r5, round(avg(coalesce((rank <= 10)::int, 0)), 6) as r10, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr from h")
def _(t):
    b = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    bm = _bm25(t)
    # a passage's documents are looked for among those with its rarest word; then the text itself is compared
    index = V.bm25_index(t("documents"))
    words = b.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("query", F.lit("([가-힣]+|[a-zA-Z]+|[0-9]+)"), F.lit(1)))).alias("term"))
    rarest = words.join(index.terms, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    cands = rarest.join(index.postings.select("doc_id", "term"), "term").join(b, "query_id").join(t("documents").select("doc_id", "text"), "doc_id")
    gold = cands.filter(F.contains("text", "query")).groupBy("query_id").agg(F.min("doc_id").alias("gold_doc"))
    return V.retrieval_metrics(bm, gold).select("queries", *(F.round(c, 6).alias(c) for c in ("r1", "r5", "r10", "mrr")))


STOP = "'" + "','".join(V.STOP) + "'"
TERMS = "select {0} as key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i : concat(w[i], ' ', w[i + 1])))) as term from (select *, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda x : x not in (" + STOP + ")) as w from {1})"
TFIDF = f"""gold as (select doc_id, text from documents where doc_id in (select doc_id from labels where quality = 1)), ask as (select doc_id, text from documents where doc_id % 100 = 0),
gt as (select key, term, count(*) as tf from ({TERMS.format('doc_id', 'gold')}) group by 1, 2), qt as (select key, term, count(*) as tf from ({TERMS.format('doc_id', 'ask')}) group by 1, 2),
idf as (select term, ln((1 + (select count(*) from gold)) / (1 + count(*))) + 1 as idf from gt group by term order by sum(tf) desc, term limit 20000),
gv as (select key, term, tf * idf as v from gt join idf using (term)), qv as (select key, term, tf * idf as v from qt join idf using (term)),
gn as (select key, sqrt(sum(v * v)) as n from gv group by 1), qn as (select key, sqrt(sum(v * v)) as n from qv group by 1),
s as (select qv.key as query_id, gv.key as doc_id, round(sum(qv.v / qn.n * gv.v / gn.n), 6) as score from qv join gv using (term) join qn on qn.key = qv.key join gn on gn.key = gv.key group by 1, 2),
k as (select s.* from s join ask a on a.doc_id = s.query_id join gold g on g.doc_id = s.doc_id where score >= 0.05 and query_id <> s.doc_id and a.text <> g.text)
select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from k) where rank <= 3"""


@R.add("r07_tfidf_examples", f"with {TFIDF}")
def _(t):
    d = t("documents").join(t("labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("key"), "text")
    q = t("documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("key"), "text")
    return V.tfidf_examples(q, d, stop=V.STOP).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@R.add("r08_embedding_examples", "with qv as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0), sc as (select query_id, vec_id, round(list_cosine_similarity(q::double[], embedding::double[]), 9) as score from qv, embeddings where query_id <> vec_id and q <> embedding) select query_id, vec_id, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from sc) where rank <= 3")
def _(t):
    return _dense(t, 3, apart=True).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


CANDS = "cands as (select p_size % 5 as query_id, p_partkey as doc_id, row_number() over (partition by p_size % 5 order by p_retailprice desc, p_partkey) as rank from part join embeddings on vec_id = p_partkey)"


def _cands(t):
    p = t("part").join(t("embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("vec")), "p_partkey").select((F.col("p_size") % 5).alias("query_id"), F.col("p_partkey").alias("doc_id"), "p_retailprice", "vec")
    return K.rank_rows(p, ["query_id"], [F.desc("p_retailprice"), F.col("doc_id")])


@R.add("r09_semantic_rerank", f"with {CANDS}, s as (select query_id, doc_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 6) as score from cands join embeddings e on e.vec_id = doc_id join embeddings q on q.vec_id = query_id) select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 50")
def _(t):
    q = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = _cands(t).drop("rank").join(q, "query_id").withColumn("score", F.round(V.dot("vec", "q"), 6))
    return K.topk_per_group(s, ["query_id"], [F.desc("score"), F.col("doc_id")], 50).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


REVIEW_VEC = """top as (select vec_id, label as appid, row_number() over (partition by label order by vec_id % 97 desc, vec_id) as n from embeddings), d as (select appid, idx, avg(v::double) as v from top join emb_long using (vec_id) where n <= 5 group by 1, 2),
nrm as (select appid, sqrt(sum(v * v)) as s from d group by 1), rv as (select appid, idx, v / s as v from d join nrm using (appid))"""


def _review_vectors(t):
    e = t("embeddings")
    return V.review_vectors(e.select(F.col("vec_id").alias("key"), F.col("label").alias("appid"), (F.col("vec_id") % 97).alias("votes")), e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec")))


@R.add("r10_review_vectors", f"with {REVIEW_VEC} select appid, idx, round(v, 6) as v from rv", "emb_long")
def _(t):
    return _review_vectors(t).select("appid", F.posexplode("vec").alias("idx", "v")).select("appid", F.col("idx").cast("bigint").alias("idx"), F.round("v", 6).alias("v"))


@R.add("r11_review_rerank", f"with {REVIEW_VEC}, {CANDS}, s as (select c.query_id, c.doc_id, rank, round(coalesce((select sum(rv.v * q.v) from rv join emb_long q on q.idx = rv.idx where rv.appid = c.doc_id % 12 and q.vec_id = c.query_id), 0), 6) as score from cands c where rank <= 20) select query_id, doc_id, row_number() over (partition by query_id order by score desc, rank) as place from s", "emb_long")
def _(t):
    q = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rv = _review_vectors(t).select(F.col("appid").alias("a"), F.col("vec").alias("rv"))
    s = _cands(t).filter("rank <= 20").drop("vec").withColumn("a", F.col("doc_id") % 12).join(rv, "a", "left").join(q, "query_id")
    s = s.withColumn("score", F.round(F.coalesce(V.dot("rv", "q"), F.lit(0.0)), 6))
    return K.rank_rows(s.withColumnRenamed("rank", "r"), ["query_id"], [F.desc("score"), F.col("r")], "place").select("query_id", "doc_id", F.col("place").cast("bigint").alias("place"))


@R.add("r12_pair_table", f"with {CANDS} select query_id, doc_id, rank, concat(p_name, ': ', substr(p_type, 1, 200)) as pair from cands join part on p_partkey = doc_id where rank <= 50")
def _(t):
    c = _cands(t).filter("rank <= 50").join(t("part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type"), "doc_id")
    return c.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.concat("p_name", F.lit(": "), F.substring("p_type", 1, 200)).alias("pair"))


@R.add("r12_apply_pair_scores", f"with {CANDS}, s as (select *, doc_id * 7 % 101 as score from cands where rank <= 50) select query_id, doc_id, new_rank from (select *, row_number() over (partition by query_id order by score desc, rank) as new_rank from s) where new_rank <= 10")
def _(t):
    c = _cands(t).filter("rank <= 50").select("query_id", "doc_id", "rank")
    scores = c.select("query_id", "doc_id", (F.col("doc_id") * 7 % 101).cast("double").alias("score"))
    return V.apply_pair_scores(c, scores, 10).select("query_id", "doc_id", F.col("new_rank").cast("bigint").alias("new_rank"))


VARIANT = "va as (select 'a' as variant, vec_id, embedding from embeddings union all select 'b', vec_id, case when vec_id % 10 = 0 then list_reverse(embedding) else embedding end from embeddings)"


@R.add("r14_compare_corpora", f"""with {VARIANT}, qv as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0),
sc as (select variant, query_id, vec_id, round(list_cosine_similarity(q::double[], embedding::double[]), 9) as score from qv, va),
r as (select *, row_number() over (partition by variant, query_id order by score desc, vec_id) as rank from sc)
select variant, count(*) as queries, round(avg(case when rank <= 10 then 1.0 / rank else 0 end), 6) as mrr from r where vec_id = query_id group by 1""")
def _(t):
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    swapped = e.withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    gold = q.select("query_id", F.col("query_id").alias("gold_doc"))
    parts = [V.retrieval_metrics(K.dense_topk(q, c, 10).withColumnRenamed("vec_id", "doc_id"), gold).withColumn("variant", F.lit(v)) for v, c in (("a", e), ("b", swapped))]
    return parts[0].unionByName(parts[1]).select("variant", "queries", F.round("mrr", 6).alias("mrr"))


BOUND = "(required_age is null or required_age < 18) and (is_free or price_cents <= 95000) and (query_id % 200 <> 0 or linux)"


def _bounded(t):
    """Queries by vector, each with a constraint: a maximum price, and for every second one a platform."""
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    terms = {f: F.lit(None).cast("array<string>") for f in S.TERM_FIELDS} | {"platforms": F.when(F.col("query_id") % 200 == 0, F.array(F.lit("linux")))}
    c = q.select("query_id", F.lit(950.0).alias("max_price_usd"), F.lit(None).cast("boolean").alias("free_only"), F.lit(None).cast("int").alias("min_players")).withColumns(terms)
    return q, e, c, S.catalog_join(t("apps"), t("app_genres"), t("genres"))


@R.add("r16_vector_then_filter", f"with {DENSE.replace('rank <= 200', 'rank <= 500')} select query_id, vec_id, rank from de join apps a on a.appid = vec_id where {BOUND}", "apps")
def _(t):
    return W.vector_then_filter(*_bounded(t)).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@R.add("r16_filter_then_vector", f"with {DENSE}, ok as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as rank from sc join apps a on a.appid = vec_id where {BOUND}) select query_id, vec_id, rank from ok where rank <= 100", "apps")
def _(t):
    return W.filter_then_vector(*_bounded(t), 100).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


def _recommended(t, diversity: bool) -> W.Funnel:
    cat = S.catalog_join(t("apps"), t("app_genres"), t("genres")).filter("type = 'game'")
    e, told = t("embeddings"), t("part").select((F.col("p_partkey") % 25).alias("query_id"), F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("bigint").alias("place"))
    q, v = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    reviews = _review_vectors(t).select(F.col("appid").alias("a"), F.col("vec").alias("review_vec"))
    reviews = e.select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 12).alias("a")).join(reviews, "a").drop("a")
    scorer = lambda pairs: pairs.withColumn("score", (F.col("doc_id") * 7 % 101).cast("double"))
    return W.recommend(S.constraint_rows(t("constraint_scalars"), t("constraint_terms")), cat, q, v, told, scorer, reviews, diversity=diversity)


FUNNEL = f"""{Q.LISTS}, {Q.WANTED}, {REVIEW_VEC},
c0 as (select * from (select w.query_id, w.xc, a.*, row_number() over (partition by w.query_id order by {Q.ORDER}) as place from wanted w join catalogue a on a.type = 'game' and {Q._condition('on', 'on', 'open')}) where place <= 200),
c1 as (select query_id, appid as doc_id, coalesce(genres[1], 'Unknown') as genre, place from c0 where xc is null or len(list_filter(xc, lambda x : contains(english_categories, x))) = 0),
s2 as (select c1.query_id, doc_id, genre, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 6) as score from c1 join embeddings e on e.vec_id = doc_id join embeddings q on q.vec_id = query_id),
c2 as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s2) where rank <= 50),
s3 as (select *, count(*) over (partition by query_id) as n from c2),
c3 as (select query_id, doc_id, genre, pos as rank from (select *, row_number() over (partition by query_id order by case when n > 30 then -(doc_id * 7 % 101) else 0 end, rank) as pos from s3) where pos <= 30),
s4 as (select *, round(coalesce((select sum(rv.v * q.v) from rv join emb_long q on q.idx = rv.idx where rv.appid = doc_id % 12 and q.vec_id = query_id), 0), 6) as near from c3),
c4 as (select query_id, doc_id, genre, pos as rank from (select *, row_number() over (partition by query_id order by near desc, rank) as pos from s4) where pos <= 30),
s5 as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id, genre order by rank) as b from c4),
c5 as (select * from (select *, row_number() over (partition by query_id order by rank) as pos from s5 where n <= 5 or b <= 2) where n <= 5 or pos <= 5),
s6 as (select c5.query_id, doc_id, genre, p_partkey is not null as is_told, case when p_partkey is not null then p_size else rank end as spot from c5 left join part on p_partkey = doc_id and p_partkey % 25 = c5.query_id),
c6 as (select * from (select query_id, doc_id, genre, is_told, row_number() over (partition by query_id order by is_told desc, spot, doc_id) as rank from s6) where rank <= 5)"""
STAGES = (("candidates", "c0"), ("not_excluded", "c1"), ("semantic", "c2"), ("pairs", "c3"), ("reviews", "c4"), ("quota", "c5"), ("grounded", "c6"))
NEEDED = "apps genres constraint_scalars constraint_terms emb_long"


@R.add("r19_without_diversity", f"with {FUNNEL} select * from c6", NEEDED)
def _(t):
    return _recommended(t, False).rows.select("query_id", "doc_id", "genre", "is_told", F.col("rank").cast("bigint").alias("rank"))


@R.add("r19_stage_counts", f"with {FUNNEL} " + " union all ".join(f"select {k}::integer as stage, '{name}' as name, count(*) as n_rows from {c}" for k, (name, c) in enumerate(STAGES, 1)), NEEDED)
def _(t):
    return _recommended(t, False).counts().select("stage", "name", "n_rows")


@R.add("r19_recommend")
def _(t):
    """The whole funnel, greedy diversity included."""
    return _recommended(t, True).rows.select("query_id", "doc_id", "genre", "is_told", "rank")
