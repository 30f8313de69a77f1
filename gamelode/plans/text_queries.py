"""Queries over text functions (cleaning, parsing, quality rules), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gamelode.functions import hashing as H
from gamelode.functions import notes as N
from gamelode.functions import text as T
from gamelode.operators import aggregates as G
from gamelode.operators import ranking as K
from gamelode.plans.bindings import Registry

R = Registry()

MARKUP = "concat('[b]', text, '[/b] see [url=http://a.b/c]link one[/url] [url]http://x.y[/url] [img]http://i.j/k.png[/img] https://q.r/s?t=1 <br> &lt;i&gt; fish &amp; chips')"


@R.add("p01_html_to_text")
def _(t):
    return t("pages").select("page_id", T.html_to_text("html").alias("text"), T.html_to_text("html", void_fix=False).alias("text_faithful"))


@R.add("p02_strip_tags", "select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def _(t):
    return t("pages").select("page_id", T.strip_tags("html").alias("text"))


@R.add("p03_clean_review", f"""
with m as (select doc_id, replace(replace(replace(replace(replace(replace({MARKUP}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as x from documents),
a as (select doc_id, regexp_replace(x, '\\[url=[^\\]]+\\](.*?)\\[/url\\]', ' \\1 ', 'gis') as x from m),
b as (select doc_id, regexp_replace(x, '\\[url\\].*?\\[/url\\]', ' [URL] ', 'gis') as x from a),
c as (select doc_id, regexp_replace(regexp_replace(x, '\\[img\\].*?\\[/img\\]', ' ', 'gis'), '\\[img=[^\\]]+\\].*?\\[/img\\]', ' ', 'gis') as x from b),
d as (select doc_id, regexp_replace(x, '(?:https?://|www\\.)[^\\s<>\\[\\]"'']+', ' [URL] ', 'gi') as x from c),
e as (select doc_id, regexp_replace(x, '\\[/?(?:h[1-6]|b|i|u|s|strike|spoiler|quote|code|list|olist|table|tr|th|td|center|left|right|noparse|\\*)(?:=[^\\]]*)?\\]', ' ', 'gi') as x from d)
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')) as clean from e
""")
def _(t):
    return t("documents").select("doc_id", T.clean_review(F.expr(MARKUP)).alias("clean"))


@R.add("p04_normalize_bool", "select recommendationid, case when lower(trim(voted_up)) in ('true', '1') then true when lower(trim(voted_up)) in ('false', '0') then false end as voted from reviews", "reviews")
def _(t):
    return t("reviews").select("recommendationid", T.normalize_bool("voted_up").alias("voted"))


@R.add("p05_parse_bool_loose", "select recommendationid, coalesce(lower(trim(voted_up)) in ('true', '1', 'yes', 'y'), false) as voted from reviews", "reviews")
def _(t):
    return t("reviews").select("recommendationid", T.parse_bool_loose("voted_up").alias("voted"))


@R.add("p06_text_lengths", """select doc_id, length(text) as chars, case when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 0
 else len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) end as words from documents""")
def _(t):
    return t("documents").select("doc_id", T.char_count("text").alias("chars"), T.word_count("text").alias("words"))


@R.add("p07_extract_names", "select p_partkey, concat(p_brand, '|', coalesce(p_type, '')) as names from part")
def _(t):
    made = F.array(F.struct(F.lit(1).alias("id"), F.col("p_brand").alias("description")), F.struct(F.lit(2).alias("id"), F.col("p_type").alias("description")))
    return t("part").select("p_partkey", F.array_join(T.extract_names(made), "|").alias("names"))


@R.add("p08_build_game_record", """
select page_id as appid, url as name, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as description_clean, length(html) as len_raw,
 length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as len_clean, false as is_free from pages""")
def _(t):
    data = F.struct(F.col("url").alias("name"), F.col("html").alias("detailed_description"), F.lit(None).cast("boolean").alias("is_free"))
    raw = t("pages").select(F.col("page_id").alias("appid"), F.struct(F.lit(True).alias("success"), data.alias("data")).alias("app_details"))
    clean = T.strip_tags(F.coalesce("app_details.data.detailed_description", F.lit("")))
    return raw.select(
        "appid", F.col("app_details.data.name").alias("name"), clean.alias("description_clean"), F.length("app_details.data.detailed_description").alias("len_raw"),
        F.length(clean).alias("len_clean"), F.coalesce("app_details.data.is_free", F.lit(False)).alias("is_free"),
    )


@R.add("p09_coalesce_text", """select doc_id, nullif(trim(coalesce(nullif(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then null else lang end, ''), nullif(text, ''))), '') as body
 from documents where nullif(trim(coalesce(nullif(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then null else lang end, ''), nullif(text, ''))), '') is not null""")
def _(t):
    first = F.expr("case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then null else lang end")
    return t("documents").select("doc_id", T.coalesce_text(first, "text").alias("body")).filter("body is not null")


@R.add("p10_search_doc", "select p_partkey, trim(concat(p_name, ' 장르 ', p_brand, ' ', p_type, ' ', cast(p_size as varchar))) as doc from part")
def _(t):
    return t("part").select("p_partkey", T.search_doc("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("doc"))


@R.add("p11_tokenize", "select doc_id, len(regexp_extract_all(text, '[가-힣]+|[a-zA-Z]+|[0-9]+')) as n, array_to_string(regexp_extract_all(text, '[가-힣]+|[a-zA-Z]+|[0-9]+'), ' ') as tokens from documents")
def _(t):
    return t("documents").select("doc_id", F.size(T.tokenize("text")).alias("n"), F.array_join(T.tokenize("text"), " ").alias("tokens"))


SPELLED = """case event_id % 8 when 0 then concat('["', event_type, '","x', event_id % 9, '"]') when 1 then concat('[''', event_type, ''', ''b'']') when 2 then concat(event_type, ', c , ', event_id % 5)
 when 3 then 'nan' when 4 then '[]' when 5 then '-' when 6 then null else concat(event_type, '|d;e') end"""
SPLIT_SQL = """
with s as (select event_id, trim(coalesce({0}, '')) as x from events),
y as (select event_id, x, case when lower(x) in ('', 'nan', 'none', 'null', '[]', '-') then []
 when json_valid(x) and x like '[%' then json_extract_string(x, '$[*]') when json_valid(translate(x, '''', '"')) and x like '[%' then json_extract_string(translate(x, '''', '"'), '$[*]')
 else list_transform(regexp_split_to_array(x, '[{1}]'), lambda k : trim(k)) end as a from s)
select event_id, array_to_string(list_filter(a, lambda k : k <> ''), '#') as topics from y
"""


@R.add("p12_parse_topics", SPLIT_SQL.format(SPELLED, ","))
def _(t):
    return t("events").select("event_id", F.array_join(T.split_topics(F.expr(SPELLED)), "#").alias("topics"))


@R.add("p13_split_topics", SPLIT_SQL.format(SPELLED, ",|;/"))
def _(t):
    return t("events").select("event_id", F.array_join(T.split_topics(F.expr(SPELLED), ",|;/"), "#").alias("topics"))


WRAPPED = "case event_id % 3 when 0 then concat('{\"k\":', event_id, '}') when 1 then concat('Answer: ```json {\"k\":', event_id, '} ``` done') else concat('no object ', event_id) end"


@R.add("p14_extract_json", f"""
with s as (select event_id, {WRAPPED} as x from events)
select event_id, nullif(regexp_extract(x, '(\\{{.*\\}})', 1, 's'), '') as whole,
 nullif(case when regexp_extract(x, '```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1, 's') <> '' then regexp_extract(x, '```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1, 's') else regexp_extract(x, '(\\{{.*\\}})', 1, 's') end, '') as fence,
 nullif(regexp_extract(regexp_replace(x, '```(?:json)?', '', 'g'), '(\\{{.*\\}})', 1, 's'), '') as strip from s
""")
def _(t):
    x = F.expr(WRAPPED)
    return t("events").select("event_id", *(T.extract_json(x, m).alias(m) for m in ("whole", "fence", "strip")))


SUMMARY = """case event_id % 4 when 0 then concat('{"장르":"', event_type, '","핵심플레이":"p', event_id, '","특징":"f"}') when 1 then concat('text {"장르":"a","핵심플레이":"b', event_id, '","특징":"c"} end')
 when 2 then '{"장르":"only"}' else 'nothing' end"""


@R.add("p15_parse_summary", f"""
with s as (select event_id, regexp_extract({SUMMARY}, '(\\{{.*\\}})', 1, 's') as x from events),
j as (select event_id, case when json_valid(x) then x::json end as x from s where x <> ''),
k as (select event_id, x->>'장르' as genre, x->>'핵심플레이' as core_play, x->>'특징' as feature from j)
select event_id, genre, core_play, feature from k where genre is not null and core_play is not null and feature is not null
""")
def _(t):
    return t("events").select("event_id", T.parse_summary(F.expr(SUMMARY)).alias("s")).filter("s is not null").select("event_id", "s.*")


TOPIC_TEXT = "concat(upper(event_type), ',', case when event_id % 5 = 0 then 'Strange' else 'click' end, ',view')"


@R.add("p16_normalize_topics", f"""
with s as (select event_id, string_split({TOPIC_TEXT}, ',') as a from events),
k as (select event_id, list_filter(a, lambda x : lower(x) in ('click', 'view', 'purchase')) as known, list_filter(a, lambda x : lower(x) not in ('click', 'view', 'purchase')) as odd from s)
select event_id, array_to_string(odd, '#') as unknown, case when len(odd) > 0 then 'invalid_topic' end as reason,
 case when len(odd) > 0 then '' else array_to_string(list_sort(list_distinct(list_transform(known, lambda x : lower(x)))), '#') end as topics from k
""")
def _(t):
    allowed = ("click", "view", "purchase")
    arr = F.split(F.expr(TOPIC_TEXT), ",")
    odd = T.unknown_topics(arr, allowed)
    good = F.when(F.size(odd) > 0, "").otherwise(F.array_join(F.array_sort(T.known_topics(arr, allowed)), "#"))
    return t("events").select("event_id", F.array_join(odd, "#").alias("unknown"), F.when(F.size(odd) > 0, "invalid_topic").alias("reason"), good.alias("topics"))


@R.add("p17_drop_other", """
with a as (select event_id, list_sort(list_distinct([event_type, case when event_id % 2 = 0 then 'other' else event_type end])) as x from events)
select event_id, array_to_string(case when len(x) > 1 then list_filter(x, lambda k : k <> 'other') else x end, '#') as topics from a""")
def _(t):
    arr = F.expr("array(event_type, case when event_id % 2 = 0 then 'other' else event_type end)")
    return t("events").select("event_id", F.array_join(F.array_sort(T.drop_other(arr)), "#").alias("topics"))


@R.add("p18_strip_han", "select doc_id, trim(regexp_replace(concat(text, ' 漢字 끝'), '[一-鿿]', '', 'g')) as text from documents")
def _(t):
    return t("documents").select("doc_id", T.strip_han(F.concat("text", F.lit(" 漢字 끝"))).alias("text"))


@R.add("p19_repair_text", """select doc_id, case when regexp_matches(text, '(\\d+kg|\\d+m){2,}') or length(text) < 10 or contains(text, 'License') then concat('repaired ', lang) else text end as text,
 (regexp_matches(text, '(\\d+kg|\\d+m){2,}') or length(text) < 10 or contains(text, 'License')) as fixed from documents""")
def _(t):
    bad = F.col("text").rlike(r"(\d+kg|\d+m){2,}") | (F.length("text") < 10) | F.contains("text", F.lit("License"))
    text, fixed = N.repair_text("text", bad, F.concat(F.lit("repaired "), "lang"))
    return t("documents").select("doc_id", text.alias("text"), fixed.alias("fixed"))


WORDS = {"the onon": "alpha beta", "the": "gamma", "and": "delta gamma", "erst": "epsilon"}


@R.add("p21_expand_query", """
with a as (select item_id, text, case when contains(text, 'the onon') then concat(text, ' alpha beta') else text end as x0 from benchmark),
b as (select *, case when contains(text, 'erst') and not list_contains(regexp_split_to_array(lower(x0), '\\s+'), 'epsilon') then concat(x0, ' epsilon') else x0 end as x1 from a),
c as (select *, case when contains(text, 'and') then concat(x1, ' delta gamma') else x1 end as x2 from b)
select item_id, case when contains(text, 'the') and not list_contains(regexp_split_to_array(lower(x2), '\\s+'), 'gamma') then concat(x2, ' gamma') else x2 end as expanded from c""")
def _(t):
    return t("benchmark").select("item_id", T.expand_query("text", WORDS).alias("expanded"))


@R.add("p22_prompt_rows", """
select doc_id, concat('Genres: ', case when doc_id % 3 = 0 then '(정보 없음)' else concat(lang, ', ', source) end, chr(10), 'Text: ', substr(text, 1, 2000), chr(10), 'Answer with JSON only.') as prompt from documents""")
def _(t):
    genres = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    return t("documents").select("doc_id", N.prompt(genres, "text").alias("prompt"))


TOPICS = {"story": "what is told", "price": "what it costs"}
RULES = ("Only these topics.", "No other words.")
FEW_HEAD = "Sort the topics of the last review.\n\nTopics: story, price\n- story: what is told\n- price: what it costs\n\nRules:\n- Only these topics.\n- No other words.\n\n"


@R.add("p22_few_shot_prompts", f"""
with ex as (select doc_id, source, text, quality, row_number() over (partition by source order by doc_id) as n from documents join labels using (doc_id)),
shown as (select source, string_agg(concat('Example ', n, chr(10), 'Review: ', substr(text, 1, 100), chr(10), 'positive: ', case when quality = 1 then '["story"]' else '[]' end, chr(10), 'negative: ', case when quality = 0 then '["price"]' else '[]' end), chr(10) || chr(10) order by n) as blocks from ex where n <= 3 group by 1)
select doc_id, concat('{FEW_HEAD}', coalesce(blocks, '(no examples)'), chr(10), chr(10), 'Review: ', substr(text, 1, 2000), chr(10), 'Answer as {{"positive": [], "negative": []}}.') as prompt from documents d left join shown on shown.source = d.source""")
def _(t):
    ex = K.topk_per_group(t("documents").join(t("labels"), "doc_id"), ["source"], ["doc_id"], 3)
    topics = lambda value, name: F.when(F.col("quality") == value, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    block = F.struct(F.col("rank"), F.substring("text", 1, 100).alias("review"), topics(1, "story").alias("positive"), topics(0, "price").alias("negative"))
    shown = ex.groupBy("source").agg(F.sort_array(F.collect_list(block)).alias("examples"))
    return t("documents").join(shown, "source", "left").select("doc_id", N.few_shot_prompt("text", "examples", TOPICS, RULES).alias("prompt"))


@R.add("p23_chat_messages", """
select conv_id, min(turn) as turn, first(text order by turn) as query, cast(len(list_distinct(regexp_extract_all(first(text order by turn), '[0-9A-Za-z_]+'))) as bigint) as n_tags from conversations where role = 'user' group by conv_id""")
def _(t):
    c = t("conversations").filter("role = 'user'")
    made = c.select("conv_id", "turn", F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit("Game: g\nAppID:"), F.col("conv_id").cast("string"), F.lit("\nQuery: "), "text").alias("content")))).alias("line"))
    back = made.select("turn", F.from_json("line", "array<struct<role:string,content:string>>")[1]["content"].alias("c"))
    back = back.select("turn", F.regexp_extract("c", r"AppID:(\d+)", 1).cast("bigint").alias("conv_id"), F.regexp_extract("c", r"(?s)Query: (.*)$", 1).alias("query")).filter("conv_id is not null")
    first = back.groupBy("conv_id").agg(F.min_by(F.struct("turn", "query"), "turn").alias("x")).select("conv_id", "x.turn", "x.query")
    tags = F.array_distinct(F.regexp_extract_all("query", F.lit("([0-9A-Za-z_]+)"), F.lit(1)))
    return first.withColumn("n_tags", F.size(tags).cast("bigint"))


@R.add("p24_rule_reason", """select appid, case when is_free then concat(name, ' is free to play') when coalesce(metacritic_score, 0) >= 80 then concat(name, ' is acclaimed')
 when price_cents > 0 and price_cents <= 100000 then concat(name, ' is good value') else concat(name, ' may suit you') end as reason from apps""", "apps")
def _(t):
    return t("apps").select("appid", N.rule_reason("name", "is_free", "metacritic_score", "price_cents").alias("reason"))


@R.add("p27_pick_text_column", "select doc_id, text as body from documents")
def _(t):
    docs = t("documents")
    found = [c for c in ("input_text", "review_text_clean", "clean_text", "review_text", "review", "text", "content") if c in docs.columns]
    if not found:
        raise ValueError("no text column")
    return docs.select("doc_id", F.col(found[0]).alias("body"))


FIELDS = {
    "genre": "case when doc_id % 4 = 0 then concat(lang, ' (RPG)') when doc_id % 4 = 1 then '액션 RPG' when doc_id % 4 = 2 then '' else '퍼즐 css' end",
    "play": "case when doc_id % 2 = 0 then '적을 물리치며 성장하는 최고의 게임' when doc_id % 9 = 1 then '  이 게임은 짧다' else text end",
    "feature": "case when doc_id % 5 = 0 then concat('- ', lang) when doc_id % 5 = 1 then cast(null as varchar(9)) else '협동 플레이와 다양한 장비를 갖춘 작품이다.' end",
    "short": "case when doc_id % 7 = 0 then '협동 플레이와 다양한 장비를 갖춘 작품이다.' else text end",
}
FIELD_SQL = ", ".join(f"{v} as {k}" for k, v in FIELDS.items())
FIELD_COLUMNS = [v.replace("varchar(9)", "string") + f" as {k}" for k, v in FIELDS.items()]
RATIO = """case when length(regexp_replace({0}, '[^가-힣ᄀ-ᇿ一-鿿A-Za-z]', '', 'g')) = 0 then 1.0 else length(regexp_replace({0}, '[^가-힣ᄀ-ᇿ]', '', 'g'))::double / length(regexp_replace({0}, '[^가-힣ᄀ-ᇿ一-鿿A-Za-z]', '', 'g')) end"""


def _fields(t):
    return t("documents").selectExpr("doc_id", *FIELD_COLUMNS)


@R.add("f16_hangul_ratio", f"with f as (select doc_id, {FIELD_SQL} from documents) select doc_id, round({RATIO.format('concat(genre, play)')}, 6) as ratio from f")
def _(t):
    return _fields(t).select("doc_id", F.round(T.hangul_ratio(F.concat("genre", "play")), 6).alias("ratio"))


def _latin(words: tuple[str, ...]) -> str:
    listed = "','".join(words)
    return f"list_filter(regexp_extract_all(genre, '[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*'), lambda w : lower(w) not in ('{listed}'))"


STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
BULLET, EMOJI = "'(^|\\n)\\s*[-*•·▪◦]\\s'", "'[\\x{1F000}-\\x{10FFFF}]'"
SUMMARY_SQL = f"""
f as (select doc_id, {FIELD_SQL} from documents), d as (select doc_id, genre, coalesce(play, '') as play, coalesce(feature, '') as feature, coalesce(short, '') as short from f),
b as (select *, concat_ws(chr(10), genre, play, feature) as whole, concat_ws(chr(10), play, feature) as pf from d),
c as (select *, {RATIO.format('whole')} as ratio, regexp_matches(genre, '[()（）]') as paren, regexp_matches(whole, {BULLET}) as bullet, regexp_matches(whole, {EMOJI}) as emoji,
 {STRIPPED.format('genre')} as g, {STRIPPED.format('play')} as p, {STRIPPED.format('feature')} as t from b)
"""
CHECKS = f"""{SUMMARY_SQL}, k as (select doc_id, g <> '' and p <> '' and t <> '' as "schema", not paren and len({_latin(T.FORMAT_LATIN_WORDS)}) = 0 as genre_noun, not bullet and not emoji as no_bullet, ratio >= 0.4 as korean from c)"""


@R.add("f15_format_checks", f'with {CHECKS} select *, "schema" and genre_noun and no_bullet and korean as compliant from k')
def _(t):
    return _fields(t).select("doc_id", *(v.alias(k) for k, v in T.format_checks("genre", "play", "feature").items()))


GRAMS = "case when length({0}) < 3 then [{0}] else list_distinct(list_transform(range(1, length({0}) - 1), lambda i : substr({0}, i::int, 3))) end"
BARE = "regexp_replace({0}, '\\s+', '', 'g')"
_SENTENCES = "greatest(1, len(list_filter(regexp_split_to_array({0}, '[.!?。！？]\\s|\\n'), lambda x : trim(x) <> '')))"
_HYPE = "','".join(T.HYPE)
_LEAD = "|".join(T.LEAD_INS)
QC_SQL = f"""
with {SUMMARY_SQL},
x as (select *, {BARE.format('pf')} as pfx, {BARE.format('short')} as shx, {_latin(T.LATIN_GENRE_WORDS)} as latin, list_filter(['{_HYPE}'], lambda w : contains(whole, w)) as hype from c),
h as (select *, {GRAMS.format('pfx')} as a, {GRAMS.format('shx')} as z from x),
o as (select *, case when short = '' then 0.0 else len(list_intersect(a, z))::double / len(list_distinct(list_concat(a, z))) end as overlap from h),
flags as (select doc_id, overlap, concat_ws('|', case when g = '' then 'H1_field_empty:장르' end, case when p = '' then 'H1_field_empty:핵심플레이' end, case when t = '' then 'H1_field_empty:특징' end, case when paren then 'H2_genre_paren' end,
 case when bullet then 'H3_bullet' end, case when emoji then 'H3_emoji' end, case when regexp_matches(play, '^\\s*({_LEAD})') then 'H4_leadin:핵심플레이' end, case when regexp_matches(feature, '^\\s*({_LEAD})') then 'H4_leadin:특징' end,
 case when ratio < 0.4 then printf('H5_low_hangul:%.2f', ratio) end) as hard,
 concat_ws('|', case when len(latin) > 0 then 'S1_genre_latin:' || array_to_string(latin[1:3], ',') end, case when len(hype) > 0 then 'S2_hype:' || array_to_string(hype[1:3], ',') end,
 case when {_SENTENCES.format('p')} > 3 or length(play) > 220 then 'S3_long:핵심플레이' end, case when length(p) < 10 then 'S4_short:핵심플레이' end,
 case when {_SENTENCES.format('t')} > 3 or length(feature) > 220 then 'S3_long:특징' end, case when length(t) < 10 then 'S4_short:특징' end,
 case when length(g) < 2 then 'S4_short:장르' end, case when overlap >= 0.5 then printf('S5_copy:%.2f', overlap) end) as soft from o)
"""


def _flags(t):
    of = ("genre", "play", "feature", "short")
    q = T.qc_flags(*of, overlap=F.col("_overlap"))
    return _fields(t).withColumn("_overlap", T.qc_overlap(*of)).select("doc_id", q["hard"].alias("hard"), q["soft"].alias("soft"), q["overlap"].alias("overlap"))


@R.add("f14_qc_flags", QC_SQL + "select doc_id, hard, soft, round(overlap, 6) as overlap from flags")
def _(t):
    return _flags(t).select("doc_id", F.array_join("hard", "|").alias("hard"), F.array_join("soft", "|").alias("soft"), F.round("overlap", 6).alias("overlap"))


@R.add("g18_qc_report", QC_SQL + ", one as (select unnest(string_split(concat_ws('|', nullif(hard, ''), nullif(soft, '')), '|')) as rule from flags) select split_part(rule, ':', 1) as rule, count(*) as n from one where rule <> '' group by 1 order by 1")
def _(t):
    return G.qc_rules(_flags(t))


@R.add("g18_qc_summary", QC_SQL + """, r as (select *, row_number() over (order by overlap) - 1 as i, count(*) over () as n from flags)
select count(*) as total, count(*) filter (where hard <> '') as hard_fail, count(*) filter (where hard = '' and soft <> '') as soft_only, count(*) filter (where hard = '' and soft = '') as clean, count(*) filter (where overlap >= 0.5) as copied,
 round(min(overlap), 3) as min, round(median(overlap), 3) as median, round(avg(overlap), 3) as mean, round(max(overlap) filter (where i = least(n - 1, floor(0.9 * n))), 3) as p90, round(max(overlap) filter (where i = least(n - 1, floor(0.99 * n))), 3) as p99, round(max(overlap), 3) as max from r""")
def _(t):
    return G.qc_summary(_flags(t))


@R.add("x04_char_ngrams", f"with d as (select doc_id, {BARE.format('text')} as s from documents), g as (select doc_id, {GRAMS.format('s')} as a from d) select doc_id, len(a) as n, array_to_string(list_sort(a), '#') as grams from g")
def _(t):
    g = t("documents").select("doc_id", T.char_ngrams("text").alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.array_join(F.array_sort("g"), "#").alias("grams"))


@R.add("x05_jaccard", f"with d as (select a.doc_id, {BARE.format('a.text')} as s, {BARE.format('b.text')} as u from documents a join documents b on b.doc_id = a.doc_id + 1), g as (select doc_id, {GRAMS.format('s')} as a, {GRAMS.format('u')} as b from d) select doc_id, round(case when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 6) as similarity from g")
def _(t):
    d = t("documents").select("doc_id", "text")
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("u"))
    return d.join(b, "doc_id").select("doc_id", F.round(T.trigram_similarity("text", "u"), 6).alias("similarity"))


@R.add("x06_sentence_count", "select doc_id, greatest(1, len(list_filter(regexp_split_to_array(trim(text), '[.!?。！？]\\s|\\n'), lambda x : trim(x) <> ''))) as sentences from documents")
def _(t):
    return t("documents").select("doc_id", T.sentence_count("text").alias("sentences"))


@R.add("t03_explore_noise", """select event_id, least(0.96, round(0.5 * (0.8 + 0.4 * (('0x' || substr(md5(concat('7:', user_id, ':', event_id)), 1, 8))::bigint / 4294967296.0)) + 0.01
 + 0.09 * (('0x' || substr(md5(concat('8:', user_id, ':', event_id)), 1, 8))::bigint / 4294967296.0), 2)) as score from events""")
def _(t):
    u, v = H.uniform(7, "user_id", "event_id"), H.uniform(8, "user_id", "event_id")
    return t("events").select("event_id", F.least(F.lit(0.96), F.round(0.5 * (0.8 + 0.4 * u) + 0.01 + 0.09 * v, 2)).alias("score"))
