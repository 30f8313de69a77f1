"""Catalogue filters, constraint search, ranking: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gamelode.functions import notes as N
from gamelode.operators import bitmaps as M
from gamelode.operators import ranking as K
from gamelode.operators import search as S
from gamelode.plans.bindings import Registry

R = Registry()
APP = ("appid", "name", "type", "is_free", "price_cents")
A = ", ".join(APP)


@R.add("f01_keep_games", "select count(*) filter (where type = 'game') as kept, count(*) filter (where type <> 'game') as not_games, count(*) as rows_in from apps", "apps")
def _(t):
    return t("apps").agg(F.count_if(F.col("type") == "game").alias("kept"), F.count_if(F.col("type") != "game").alias("not_games"), F.count("*").alias("rows_in"))


@R.add("f05_adult_filter", f"select {A} from apps where required_age is null or required_age < 18", "apps")
def _(t):
    return S.adult_filter(t("apps")).select(*APP)


@R.add("f06_price_filter", f"select {A} from apps where is_free or (price_cents is not null and price_cents <= 95000)", "apps")
def _(t):
    return S.price_filter(t("apps"), 950.0, True).select(*APP)


@R.add("f06_free_only", f"select {A} from apps where is_free", "apps")
def _(t):
    return S.price_filter(t("apps"), None, True).select(*APP)


GENRE_HIT = """hit as (select b.appid, count(distinct n.name) as n from app_genres b join genres g on g.id = b.genre_id
 join (values ('Genre 10'), ('Genre 2')) n(name) on coalesce(g.english_name, g.name) ilike '%' || n.name || '%' group by 1)"""


@R.add("f07_genre_filter", f"with {GENRE_HIT} select {A} from apps where appid in (select appid from hit where n = 2)", "apps genres")
def _(t):
    return S.genre_filter(t("apps"), t("app_genres"), t("genres"), ["Genre 10", "Genre 2"]).select(*APP)


@R.add("f07_genre_any", f"with {GENRE_HIT} select {A} from apps where appid in (select appid from hit)", "apps genres")
def _(t):
    return S.genre_filter(t("apps"), t("app_genres"), t("genres"), ["Genre 10", "Genre 2"], "union").select(*APP)


@R.add("f08_category_filter", f"select {A} from apps where english_categories ilike '%single-player%' and english_categories ilike '%co-op%'", "apps")
def _(t):
    return S.category_filter(t("apps"), ["Single-player", "Co-op"]).select(*APP)


@R.add("f08_category_any", f"select {A} from apps where english_categories ilike '%single-player%' or english_categories ilike '%cloud%'", "apps")
def _(t):
    return S.category_filter(t("apps"), ["Single-player", "Cloud"], "union").select(*APP)


TOGETHER = "regexp_matches(english_categories, '(?i)" + "|".join(S.TOGETHER) + "')"


@R.add("f09_min_players", f"select {A} from apps where {TOGETHER}", "apps")
def _(t):
    return S.min_players_filter(t("apps"), 2).select(*APP)


@R.add("f10_platform_filter", f"select {A} from apps where mac and linux", "apps")
def _(t):
    return S.platform_filter(t("apps"), ["linux", "mac"]).select(*APP)


LISTS = """named as (select b.appid, list_sort(list_distinct(list(g.english_name) filter (where g.english_name is not null))) as genres, list_sort(list_distinct(list(coalesce(g.english_name, g.name)))) as match_genres
 from app_genres b join genres g on g.id = b.genre_id group by 1),
catalogue as (select a.*, coalesce(n.genres, []) as genres, coalesce(n.match_genres, []) as match_genres from apps a left join named n on n.appid = a.appid)"""


@R.add("f11_exclude_filter", f"with {LISTS} select {A} from catalogue where not list_contains(genres, 'Genre 102') and not contains(english_categories, 'Multi-player') and not linux and not is_free", "apps genres")
def _(t):
    cat = S.catalog_join(t("apps"), t("app_genres"), t("genres"))
    return S.exclude_filter(cat, ["Genre 102"], ["Multi-player"], ["linux"], True).select(*APP)


@R.add("j01_catalog_join", f"with {LISTS} select appid, name, array_to_string(genres, ',') as genres, array_to_string(match_genres, ',') as match_genres from catalogue", "apps genres")
def _(t):
    return S.catalog_join(t("apps"), t("app_genres"), t("genres")).select("appid", "name", F.array_join("genres", ",").alias("genres"), F.array_join("match_genres", ",").alias("match_genres"))


WANTED = """wanted as (select s.*, (select list(term order by term) from constraint_terms c where c.query_id = s.query_id and field = 'genres') as g,
 (select list(term order by term) from constraint_terms c where c.query_id = s.query_id and field = 'categories') as c, (select list(term order by term) from constraint_terms c where c.query_id = s.query_id and field = 'platforms') as p,
 (select list(term order by term) from constraint_terms c where c.query_id = s.query_id and field = 'exclude_categories') as xc from constraint_scalars s)"""


def _condition(price="true", genres="true", rest="true"):
    price_sql = "case when w.max_price_usd is not null then a.is_free or coalesce(a.price_cents <= cast(w.max_price_usd * 100 as bigint), false) when coalesce(w.free_only, false) then a.is_free else true end"
    genre_sql = "(w.g is null or len(list_filter(w.g, lambda x : len(list_filter(a.match_genres, lambda m : contains(lower(m), lower(x)))) = 0)) = 0)"
    cat_sql = "(w.c is null or len(list_filter(w.c, lambda x : not contains(lower(a.english_categories), lower(x)))) = 0)"
    open_sql = f"(w.p is null or len(list_filter(w.p, lambda x : not ((x = 'linux' and a.linux) or (x = 'mac' and a.mac) or x = 'windows'))) = 0) and (coalesce(w.min_players, 0) < 2 or {TOGETHER})"
    rest_sql = open_sql + " and (w.xc is null or len(list_filter(w.xc, lambda x : contains(a.english_categories, x))) = 0)"
    return " and ".join(["(a.required_age is null or a.required_age < 18)", price_sql if price == "on" else "true", f"{genre_sql} and {cat_sql}" if genres == "on" else "true", {"on": rest_sql, "open": open_sql}.get(rest, "true")])


MATCHED = f"matched as (select w.query_id, a.* from wanted w join catalogue a on {_condition('on', 'on', 'on')})"
ORDER = "metacritic_score desc nulls last, recommendations_total desc nulls last, appid"


def _constraints(t):
    return S.constraint_rows(t("constraint_scalars"), t("constraint_terms"))


def _catalogue(t):
    return S.catalog_join(t("apps"), t("app_genres"), t("genres"))


@R.add("j08_constraint_match", f"with {LISTS}, {WANTED}, {MATCHED} select query_id, appid from matched", "apps genres constraint_scalars constraint_terms")
def _(t):
    return M.constraint_match(_constraints(t), _catalogue(t)).select("query_id", "appid")


@R.add("constraint_topk", f"""with {LISTS}, {WANTED}, {MATCHED},
ranked as (select *, row_number() over (partition by query_id order by {ORDER}) as rank from matched where type = 'game'),
few as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id, coalesce(genres[1], 'Unknown') order by rank) as b from ranked where rank <= 50),
cut as (select *, row_number() over (partition by query_id order by rank) as pos from few where n <= 10 or b <= 2)
select query_id, pos as rank, appid, name, coalesce(genres[1], 'Unknown') as genre, case when is_free then 0.0 else price_cents / 100.0 end as price from cut where n <= 10 or pos <= 10""", "apps genres constraint_scalars constraint_terms")
def _(t):
    games = _catalogue(t).filter("type = 'game'")
    top = M.constraint_match(_constraints(t), games, 50).withColumn("genre", F.coalesce(F.get("genres", 0), F.lit("Unknown")))
    few = K.bucket_quota(top, "query_id", "genre", "rank", 10)
    price = F.when(F.col("is_free"), 0.0).otherwise(F.col("price_cents") / 100.0)
    return K.rank_rows(few.withColumnRenamed("rank", "_r"), ["query_id"], ["_r"]).select("query_id", F.col("rank").cast("bigint").alias("rank"), "appid", "name", "genre", price.alias("price"))


@R.add("j09_filter_candidates", f"""with {LISTS}, {WANTED}, {MATCHED}, cands as (select query_id, p_partkey as appid, row_number() over (partition by query_id order by p_retailprice, p_partkey) as rank from constraint_scalars, part where p_partkey % 7 = query_id % 7)
select c.query_id, c.appid, c.rank from cands c join matched m on m.query_id = c.query_id and m.appid = c.appid""", "apps genres constraint_scalars constraint_terms")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("appid"), "p_retailprice", (F.col("p_partkey") % 7).alias("m"))
    cands = K.rank_rows(t("constraint_scalars").select("query_id", (F.col("query_id") % 7).alias("m")).join(p, "m"), ["query_id"], ["p_retailprice", "appid"])
    hit = M.constraint_match(_constraints(t), _catalogue(t)).select("query_id", "appid")
    return cands.join(hit, ["query_id", "appid"]).select("query_id", "appid", F.col("rank").cast("bigint").alias("rank"))


@R.add("r17_fallback_levels", f"""with {LISTS}, {WANTED},
hits as (select w.query_id, 0 as level, a.* from wanted w join catalogue a on {_condition('on', 'on', 'on')} union all select w.query_id, 1, a.* from wanted w join catalogue a on {_condition('on', 'on')}
 union all select w.query_id, 2, a.* from wanted w join catalogue a on {_condition('on')} union all select w.query_id, 3, a.* from wanted w join catalogue a on {_condition()}),
best as (select query_id, min(level) as level from hits group by 1),
ranked as (select h.query_id, h.level, h.appid, row_number() over (partition by h.query_id order by {ORDER}) as rank from hits h join best b on b.query_id = h.query_id and b.level = h.level)
select query_id, ['strict', 'relaxed', 'minimal', 'popular'][level + 1] as level, rank, appid from ranked where rank <= 5""", "apps genres constraint_scalars constraint_terms")
def _(t):
    out = M.fallback_levels(_constraints(t), _catalogue(t), 5)
    return out.select("query_id", "level", F.col("rank").cast("bigint").alias("rank"), "appid")


HAS = {"min_players": "w.min_players >= 2", "platforms": "w.p is not null", "exclude_categories": "w.xc is not null", "categories": "w.c is not null", "genres": "w.g is not null", "price": "w.max_price_usd is not null or w.free_only"}
DROPPED = "case " + " ".join(f"when {HAS[f]} then '{f}'" for f in M.RELAX_ORDER if f in HAS) + " end"
LESS = {"min_players": "min_players", "platforms": "p", "exclude_categories": "xc", "categories": "c", "genres": "g"}


@R.add("r18_relax_once", f"""with {LISTS}, {WANTED}, {MATCHED}, none as (select w.*, {DROPPED} as dropped from wanted w where query_id not in (select query_id from matched)),
less as (select query_id, dropped, case when dropped <> 'price' then max_price_usd end as max_price_usd, case when dropped <> 'price' then free_only end as free_only, {', '.join(f"case when dropped <> '{f}' then {c} end as {c}" for f, c in LESS.items())} from none),
again as (select w.query_id, w.dropped, a.* from less w join catalogue a on {_condition('on', 'on', 'on')})
select query_id, 'all' as used, count(*) as n, min(appid) as least from matched group by 1 union all select query_id, dropped, count(*), min(appid) from again group by 1, 2""", "apps genres constraint_scalars constraint_terms")
def _(t):
    out = M.relax_once(_constraints(t), _catalogue(t))
    return out.groupBy("query_id", "used").agg(F.count("*").alias("n"), F.min("appid").alias("least"))


@R.add("w04_order_nulls_last", f"select appid, metacritic_score, recommendations_total from apps order by {ORDER} limit 200", "apps")
def _(t):
    return t("apps").orderBy(*S.popularity_order()).limit(200).select("appid", "metacritic_score", "recommendations_total")


@R.add("w05_bucket_quota", """with r as (select p_size % 5 as query_id, p_brand, p_partkey, row_number() over (partition by p_size % 5 order by p_retailprice desc, p_partkey) as rank from part),
few as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id, p_brand order by rank) as b from r),
cut as (select *, row_number() over (partition by query_id order by rank) as pos from few where n <= 20 or b <= 2) select query_id, p_partkey, rank from cut where n <= 20 or pos <= 20""")
def _(t):
    r = K.rank_rows(t("part").withColumn("query_id", F.col("p_size") % 5), ["query_id"], [F.desc("p_retailprice"), F.col("p_partkey")])
    return K.bucket_quota(r, "query_id", "p_brand", "rank", 20).select("query_id", "p_partkey", F.col("rank").cast("bigint").alias("rank"))


@R.add("w09_sort_scores", "select appid, round(coalesce(s, 0.5), 4) as score, row_number() over (order by s desc nulls last, appid) as place from (select appid, metacritic_score / 100.0 as s from apps order by s desc nulls last, appid limit 300)", "apps")
def _(t):
    few = t("apps").select("appid", (F.col("metacritic_score") / 100.0).alias("s")).orderBy(F.desc_nulls_last("s"), "appid").limit(300)
    return K.rank_rows(few.withColumn("one", F.lit(1)), ["one"], [F.desc_nulls_last("s"), F.col("appid")], "place").select("appid", F.round(F.coalesce("s", F.lit(0.5)), 4).alias("score"), F.col("place").cast("bigint").alias("place"))


NOTE_SQL = """with k as (select *, cast(floor(max_price_usd * 1300) as bigint) as krw from constraint_scalars),
r as (select *, cast(round_even(krw / 5000.0, 0) as bigint) * 5000 as w from k)
select query_id, coalesce(nullif(concat_ws(' / ', case when max_price_usd = 0 then '무료' when max_price_usd is not null and w >= 10000 then concat('가격 ', w // 10000, '만', case when w % 10000 // 1000 > 0 then concat(' ', w % 10000 // 1000, '천') else '' end, '원 이하')
 when max_price_usd is not null then concat('가격 ', w, '원 이하') when free_only then '무료' end, case when min_players is not null then concat(min_players, '인 이상') end), ''), '조건에 맞는 게임 없음') as note from r"""


@R.add("p25_format_note", NOTE_SQL, "constraint_scalars")
def _(t):
    return t("constraint_scalars").select("query_id", N.format_note("max_price_usd", "free_only", "min_players").alias("note"))


GENRE_SQL = "case appid % 9 when 0 then 'Horror' when 1 then 'Action RPG' when 2 then 'Simulation' when 3 then 'Casual' when 4 then 'Strategy' when 5 then 'Puzzle Action' when 6 then 'Adventure' when 7 then 'Indie' end"
MOOD_SQL = " ".join(f"when contains(lower(genre), '{w}') then '{p}'" for w, p in N.GENRE_MOODS)
_AFTER = "(unicode(right({0}, 1)) - 44032) % 28 <> 0 and unicode(right({0}, 1)) between 44032 and 55203"
REASON_SQL = f"""with c as (select *, {GENRE_SQL} as genre, price_cents / 100.0::double as usd, json_extract_string(english_categories, '$[*]') as cats from apps),
d as (select *, cast(floor(usd * 1300) as bigint) as krw, case when list_has_any(cats, ['Multi-player', 'Co-op', 'Online Co-op', 'Local Co-op', 'Cross-Platform Multiplayer', 'PvP']) then '{N.TOGETHER}' when list_contains(cats, 'Single-player') then '{N.ALONE}' end as company, case {MOOD_SQL} end as mood from c),
e as (select *, case when is_free then '무료로 즐길 수 있으며' when krw // 10000 > 0 then concat('약 ', krw // 10000, '만원대 가격이며') when usd is not null then concat('약 ', krw, '원대 가격이며') end as price,
 case when company is not null and mood is not null then concat(company, case when {_AFTER.format('company')} then '과' else '와' end, ' ', mood) else coalesce(company, mood) end as joined from d),
f as (select *, joined || case when {_AFTER.format('joined')} then '을' else '를' end || ' 즐길 수 있는' as x from e)
select appid, concat(case when price is not null and x is not null then concat(price, ' ', x, ' 게임입니다.') when price is not null then concat(replace(price, '있으며', '있는'), ' 게임입니다.')
 when x is not null then concat(x, ' 게임입니다.') else '추천 조건에 부합하는 게임입니다.' end, case when win or mac or linux then ' 다양한 플랫폼을 지원합니다.' else '' end) as reason from f"""


@R.add("p26_build_reason", REASON_SQL, "apps")
def _(t):
    genre = F.expr(GENRE_SQL)
    genres = F.when(genre.isNull(), F.array().cast("array<string>")).otherwise(F.array(genre))
    return t("apps").select("appid", N.build_reason("is_free", F.col("price_cents") / 100.0, F.from_json("english_categories", "array<string>"), genres, S.platforms_of()).alias("reason"))


@R.add("n01_normalize_constraint", "select query_id, case when max_price_usd <> 0 then max_price_usd end as max_price_usd, case when max_price_usd = 0 then true else free_only end as free_only from (select query_id, case when query_id % 6 = 0 then 0.0 else max_price_usd end as max_price_usd, free_only from constraint_scalars)", "constraint_scalars")
def _(t):
    c = t("constraint_scalars").withColumn("max_price_usd", F.expr("case when query_id % 6 = 0 then 0.0D else max_price_usd end"))
    return S.normalize_constraint(c).select("query_id", "max_price_usd", "free_only")


@R.add("n02_repair_constraint", """
with raw as (select query_id, max_price_usd, free_only, min_players, case when query_id % 3 = 0 then ['fps', 'Horror'] when query_id % 3 = 1 then ['Action'] end as genres,
 case when query_id % 2 = 0 then ['Racing', 'Co-op', 'Story', 'LAN', 'VR'] end as categories, case when query_id % 5 = 0 then '무료 게임 4인용' else '게임' end as query from constraint_scalars),
g as (select *, list_transform(coalesce(genres, []), lambda x : case when lower(x) = 'fps' then 'Action' else x end) as gs, coalesce(categories, []) as cs from raw
 where genres is not null or categories is not null or max_price_usd is not null or free_only is not null or min_players is not null)
select query_id, nullif(array_to_string(list_sort(list_distinct(list_concat(list_filter(gs, lambda x : x in ('Action', 'Racing')), list_filter(cs, lambda x : x in ('Action', 'Racing'))))), ','), '') as genres,
 nullif(array_to_string(list_filter(cs, lambda x : x not in ('Action', 'Racing', 'Story'))[1:2], ','), '') as categories,
 nullif(trim(regexp_replace(concat(array_to_string(list_filter(gs, lambda x : x not in ('Action', 'Racing')), ' '), ' ', array_to_string(list_filter(cs, lambda x : x = 'Story'), ' ')), '\\s+', ' ', 'g')), '') as free_text,
 coalesce(free_only, case when contains(query, '무료') then true end) as free_only, coalesce(min_players, case when contains(query, '4인용') then 4 end) as min_players from g""", "constraint_scalars")
def _(t):
    none = F.lit(None).cast("array<string>")
    c = t("constraint_scalars").selectExpr(
        "query_id", "max_price_usd", "free_only", "min_players", "case when query_id % 3 = 0 then array('fps', 'Horror') when query_id % 3 = 1 then array('Action') end as genres",
        "case when query_id % 2 = 0 then array('Racing', 'Co-op', 'Story', 'LAN', 'VR') end as categories", "case when query_id % 5 = 0 then '무료 게임 4인용' else '게임' end as query", "cast(null as string) as free_text",
    ).withColumns({f: none for f in ("platforms", "exclude_genres", "exclude_categories", "exclude_platforms")})
    out = S.repair_constraint(c, {"fps": "Action"}, ("Action", "Racing"), ("Story",))
    return out.select("query_id", F.array_join(F.array_sort("genres"), ",").alias("genres"), F.array_join("categories", ",").alias("categories"), "free_text", "free_only", "min_players")


@R.add("n03_first_valid_attempt", "with a as (select n_nationkey as query_id, n_regionkey as attempt, case when n_nationkey % 3 = 0 then n_name end as genre from nation union all select n_nationkey, n_regionkey + 10, case when n_nationkey % 2 = 0 then 'late' end from nation), f as (select query_id, arg_min(genre, attempt) filter (where genre is not null) as genre from a group by 1) select n_nationkey as query_id, genre from nation left join f on f.query_id = n_nationkey")
def _(t):
    n = t("nation")
    a = n.selectExpr("n_nationkey as query_id", "n_regionkey as attempt", "case when n_nationkey % 3 = 0 then n_name end as genre").union(n.selectExpr("n_nationkey", "n_regionkey + 10", "case when n_nationkey % 2 = 0 then 'late' end"))
    first = K.first_per_key(a.filter("genre is not null"), ["query_id"], ["attempt"]).select("query_id", "genre")
    return n.select(F.col("n_nationkey").alias("query_id")).join(first, "query_id", "left")


@R.add("n04_normalize_price", "select appid, case when is_free then 0.0 else price_cents / 100.0 end as price from apps", "apps")
def _(t):
    return t("apps").select("appid", F.when(F.col("is_free"), 0.0).otherwise(F.col("price_cents") / 100.0).alias("price"))


@R.add("n05_input_screen", "select item_id, case when contains(lower(text), 'ignore previous') or contains(lower(text), 'the onon') then 'blocked' else 'ok' end as status from benchmark")
def _(t):
    bad = F.contains(F.lower("text"), F.lit("ignore previous")) | F.contains(F.lower("text"), F.lit("the onon"))
    return t("benchmark").select("item_id", F.when(bad, "blocked").otherwise("ok").alias("status"))


@R.add("w01_first_per_key", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def _(t):
    return K.first_per_key(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@R.add("w02_rank_rows", "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders")
def _(t):
    return K.rank_rows(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "o_custkey", F.col("rank").cast("bigint").alias("rank"))


@R.add("w03_topk_per_group", "select l_suppkey, l_orderkey, l_linenumber, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 5")
def _(t):
    return K.topk_per_group(t("lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("bigint").alias("rank"))


@R.add("w06_mmr_select")
def _(t):
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    top = K.dense_topk(q, e, 50)
    return K.mmr_select(top.join(e.select("vec_id", "embedding"), "vec_id").join(q, "query_id"), "query_id", "rank", "query_vec", "embedding", 5).select("query_id", "vec_id", "mmr_rank")


@R.add("w07_minmax_norm", "select o_orderkey, round((o_totalprice - min(o_totalprice) over w) / (max(o_totalprice) over w - min(o_totalprice) over w + 1e-9), 6) as norm from orders window w as (partition by o_custkey)")
def _(t):
    return K.minmax_norm(t("orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", F.round("norm", 6).alias("norm"))
