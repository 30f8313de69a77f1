"""Catalogue, review, score and event tables derived from the given tables.

One SQL text serves both engines; only the exploded vectors differ. Spark builds a view as a DataFrame, and sql_for()
puts the texts of the needed views before a query as common table expressions, for the SQL side by side check.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

EMB_LONG_DUCK = "select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as idx from embeddings"
EMB_LONG_SPARK = "select vec_id, label, idx, v from embeddings lateral view posexplode(embedding) t as idx, v"

VIEWS = {
    "apps": """
select p.p_partkey as appid, p.p_name as name, case when p.p_partkey % 20 = 7 then 'dlc' else 'game' end as type,
 (p.p_size % 10 = 0) as is_free, case when p.p_partkey % 17 <> 3 then cast(round(p.p_retailprice * 100) as bigint) end as price_cents,
 case when p.p_partkey % 50 = 0 then p.p_size + 50 end as metacritic_score,
 case when p.p_size > 45 then 18 when p.p_size % 3 = 0 then 0 end as required_age, l.n as recommendations_total,
 true as win, (p.p_partkey % 2 = 0) as mac, (p.p_partkey % 3 = 0) as linux,
 case p.p_type when 'ECONOMY' then '["Single-player"]' when 'SMALL' then '["Single-player","Co-op"]'
  when 'MEDIUM' then '["Multi-player","Online Co-op"]' when 'PROMO' then '["Multi-player"]' else '["Steam Cloud"]' end as english_categories
 from part p left join (select l_partkey, count(*) as n from lineitem group by l_partkey) l on l.l_partkey = p.p_partkey""",
    "app_genres": """
select p_partkey as appid, cast(substr(p_brand, 7) as int) as genre_id from part
 union all select p_partkey, 100 + p_size % 5 from part""",
    "genres": """
select distinct genre_id as id, case when genre_id % 6 <> 5 then concat('Genre ', cast(genre_id as string)) end as english_name,
 concat('G', cast(genre_id as string)) as name from app_genres""",
    "constraint_scalars": """
select n_nationkey as query_id, case when n_nationkey % 3 = 0 then cast(905 + n_nationkey as double) end as max_price_usd,
 case when n_nationkey % 4 = 1 then true end as free_only, case when n_nationkey % 5 = 2 then 2 end as min_players from nation""",
    "constraint_terms": """
select n_nationkey as query_id, 'genres' as field, concat('Genre ', cast(100 + n_nationkey % 5 as string)) as term from nation where n_nationkey % 2 = 0
 union all select n_nationkey, 'categories', 'Co-op' from nation where n_nationkey % 7 = 0
 union all select n_nationkey, 'platforms', 'linux' from nation where n_nationkey % 6 = 0
 union all select n_nationkey, 'exclude_categories', 'Single-player' from nation where n_nationkey % 8 = 3""",
    "reviews": """
select d.doc_id as recommendationid, d.doc_id % 50 as appid,
 case d.lang when 'en' then ' English ' when 'fr' then 'french' when 'de' then 'german' end as language, d.text as review_text,
 case when b.quality is null then null when d.doc_id % 4 = 0 then cast(b.quality as string) when b.quality = 1 then 'True' else ' false' end as voted_up,
 d.n_chars % 97 as votes_up from documents d left join labels b on b.doc_id = d.doc_id""",
    "logits": """
select vec_id as row_id, vec_id % 50 as appid, idx as label_id,
 concat(case when idx < 19 then 'pos__t' else 'neg__t' end, cast(idx % 19 as string)) as label,
 8 * cast(v as double) - 2 as logit, (idx = label or idx = label + 19 + vec_id % 3) as gold from emb_long where idx < 38""",
    "interactions": """
select event_id, user_id, ts, case event_type when 'click' then 'click' else 'search' end as type,
 case when event_type = 'click' then cast(regexp_extract(props, '([0-9]+)', 1) as bigint) end as appid,
 case when event_type = 'view' then case event_id % 5 when 0 then 'red' when 1 then 'small ring' when 2 then 'blue' when 3 then 'hot gear' else 'widget' end end as query
 from events where event_type in ('click', 'view')""",
    "rouge_pairs": """
select a.conv_id, a.turn, a.text as ref, b.text as pred from conversations a
 join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'""",
    "judge_scores": """
select l_orderkey * 10 + l_linenumber as id, l_linenumber % 3 as ax1, cast(l_quantity as int) % 3 as ax2, cast(l_orderkey % 3 as int) as ax3,
 case when l_returnflag = 'R' then 'review' else 'pass' end as verdict from lineitem""",
    "eval_queries": """
select b.item_id as query_id, b.text as query, min(d.doc_id) as gold_doc from benchmark b
 join documents d on position(b.text in d.text) > 0 group by b.item_id, b.text""",
    # topics at the threshold .39, as one row for each selected label; t12 plays 'other'
    "picked": """
select row_id, appid, label_id, label, gold, logit, case when label_id < 19 then 'positive' else 'negative' end as polarity,
 concat('t', cast(label_id % 19 as string)) as topic from logits where 1 / (1 + exp(-logit)) >= 0.39""",
    "rows_of": "select distinct row_id, appid from logits",
}
NEEDS = {
    "genres": ("app_genres",), "logits": ("emb_long",), "picked": ("logits",), "rows_of": ("logits",),
}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*_order(NEEDS.get(n, ())), n] if x not in out]
    return list(dict.fromkeys(out))


def _ctes(names: tuple[str, ...], duck: bool) -> str:
    texts = VIEWS | {"emb_long": EMB_LONG_DUCK if duck else EMB_LONG_SPARK}
    return ",\n".join(f"{n} as ({texts[n].strip()})" for n in _order(names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view of it, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = f"with {_ctes((name,), duck=False)} select * from {name}"
    used = {t: view(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", text)}
    return spark.sql(re.sub(r"\b(from|join) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text), **used)


def sql_for(names: tuple[str, ...], query: str) -> str:
    """query with the views that it needs before it; a query of its own 'with' list is joined to them."""
    query = query.strip()
    if not names:
        return query
    head = f"with {_ctes(names, duck=True)}"
    return f"{head},\n{query[5:]}" if query.lower().startswith("with ") else f"{head}\n{query}"


class Registry:
    """Queries with their SQL, by name. views: what the SQL needs of VIEWS."""

    def __init__(self):
        self.run: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = ""):
        def put(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            self.run[name] = lambda spark, sf_dir: f(lambda table: view(spark, sf_dir, table))
            if sql:
                self.sql[name] = sql_for(tuple(views.split()), sql)
            return f

        return put
