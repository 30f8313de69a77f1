"""Topic labels, multi-label metrics and text overlap: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gamelode.functions import text as T
from gamelode.operators import aggregates as G
from gamelode.operators import labels as L
from gamelode.plans.bindings import Registry

R = Registry()
MAPPING = {f"t{k}": "other" if k in (0, 12) else f"t{k - 1}" if k in (11, 15) else f"t{k}" for k in range(19)}
MAP_SQL = "case when topic in ('t0', 't12') then 'other' when topic = 't11' then 't10' when topic = 't15' then 't14' else topic end"
SCORED = "scored as (select row_id, appid, label, gold, 1 / (1 + exp(-logit)) as p, 1 / (1 + exp(-logit)) >= 0.39 as predicted from logits)"
ONCE = f"once as (select distinct row_id, appid, polarity, {MAP_SQL} as topic from picked), counts as (select appid, polarity, topic, count(*) as n from once group by 1, 2, 3)"


def _scored(t):
    return t("logits").withColumn("p", L.probability()).withColumn("predicted", F.col("p") >= 0.39)


@R.add("x07_sigmoid_threshold", """select l.row_id, coalesce(string_agg(topic, ',' order by p.label_id) filter (where polarity = 'positive'), '') as positive, coalesce(string_agg(topic, ',' order by p.label_id) filter (where polarity = 'negative'), '') as negative
 from rows_of l left join picked p on p.row_id = l.row_id group by l.row_id""", "rows_of picked")
def _(t):
    s = _scored(t)
    arr = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("predicted") & test, F.struct("label_id", "label")))), lambda x: F.substring(x["label"], 6, 9)), ",")
    return s.groupBy("row_id").agg(arr(F.col("label_id") < 19).alias("positive"), arr(F.col("label_id") >= 19).alias("negative"))


@R.add("x08_signed_labels", "select row_id, string_agg(case when polarity = 'positive' then 'pos__' || topic else 'neg__' || topic end, ',' order by label_id) as labels from picked group by row_id", "picked")
def _(t):
    g = t("picked").groupBy("row_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.struct("label_id", "topic")))).alias(p) for p in ("positive", "negative")))
    sign = lambda c, s: F.transform(c, lambda x: F.concat(F.lit(s), x["topic"]))
    return g.select("row_id", F.array_join(F.concat(sign("positive", "pos__"), sign("negative", "neg__")), ",").alias("labels"))


METRICS = """lab as (select {0}label, count(*) filter (where gold and predicted) as tp, count(*) filter (where not gold and predicted) as fp, count(*) filter (where gold and not predicted) as fn from scored group by {0}label),
sc as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as pr, case when tp + fn = 0 then 0 else tp / (tp + fn) end as re, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f from lab {1}),
ro as (select {0}row_id, bool_and(gold = predicted) as same, count(*) filter (where predicted) as k from scored group by {0}row_id)"""
COLS = ("micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1", "exact", "labels_per_row")
TOTAL = """round(sum(tp) / (sum(tp) + sum(fp)), 6) as micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) as micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1,
 round(avg(pr), 6) as macro_precision, round(avg(re), 6) as macro_recall, round(avg(f), 6) as macro_f1"""
ROWS = "round((select avg(same::int) from ro), 6) as exact, round((select avg(k) from ro), 6) as labels_per_row"


@R.add("x09_multilabel_metrics", f"with {SCORED}, {METRICS.format('', '')} select {TOTAL}, {ROWS}, count(*) filter (where tp + fp > 0) as types_predicted from sc", "logits")
def _(t):
    return L.multilabel_metrics(_scored(t)).select(*(F.round(c, 6).alias(c) for c in COLS), "types_predicted")


@R.add("x10_gold_only_metrics", f"with {SCORED}, {METRICS.format('', 'where tp + fn > 0')} select {TOTAL}, {ROWS} from sc", "logits")
def _(t):
    return L.multilabel_metrics(_scored(t), gold_only=True).select(*(F.round(c, 6).alias(c) for c in COLS))


@R.add("x11_per_label_metrics", f"with {SCORED}, {METRICS.format('', '')}, m as (select label, round(avg(p), 6) as mean_p from scored group by 1) select label, tp + fn as support, tp + fp as n_predicted, round(pr, 6) as precision, round(re, 6) as recall, round(f, 6) as f1, mean_p from sc join m using (label)", "logits")
def _(t):
    s = _scored(t)
    m = s.groupBy("label").agg(F.round(F.avg("p"), 6).alias("mean_p"))
    return L.per_label(s).join(m, "label").select("label", "support", "n_predicted", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "mean_p")


SWEEP = """with s as (select row_id, label, gold, least(50, cast(floor(100 / (1 + exp(-logit)) + 1e-9) as int)) as k from logits), th as (select unnest(range(5, 51)) as step),
lab as (select step, label, count(*) filter (where gold and k >= step) as tp, count(*) filter (where not gold and k >= step) as fp, count(*) filter (where gold and k < step) as fn from s, th group by 1, 2),
f as (select step, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) as micro_f1, avg(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end) as macro_f1 from lab group by 1),
r as (select step, row_id, bool_and(gold = (k >= step)) as same from s, th group by 1, 2), e as (select step, avg(same::int) as exact from r group by 1)
select step / 100.0::double as threshold, round(micro_f1, 6) as micro_f1, round(macro_f1, 6) as macro_f1, round(exact, 6) as exact from f join e using (step)"""


@R.add("x12_threshold_sweep", SWEEP, "logits")
def _(t):
    return L.threshold_sweep(t("logits")).select("threshold", *(F.round(c, 6).alias(c) for c in ("micro_f1", "macro_f1", "exact")))


@R.add("x12_best_threshold", SWEEP.replace("select step / 100.0", ", curve as (select step / 100.0", 1) + """)
select 'micro_f1' as by, threshold, micro_f1, macro_f1 from (select * from curve order by micro_f1 desc, threshold limit 1) union all select 'macro_f1', threshold, micro_f1, macro_f1 from (select * from curve order by macro_f1 desc, threshold limit 1)""", "logits")
def _(t):
    sweep = L.threshold_sweep(t("logits")).select("threshold", *(F.round(c, 6).alias(c) for c in ("micro_f1", "macro_f1")))
    return L.best_thresholds(sweep).select("by", "threshold", "micro_f1", "macro_f1")


STRATEGY = "scored as (select row_id % 3 as strategy, row_id, label, gold, 1 / (1 + exp(-logit)) >= 0.39 and row_id % 10 <> 0 as predicted, row_id % 10 <> 0 as valid from logits)"


@R.add("x13_strategy_eval", f"with {STRATEGY}, {METRICS.format('strategy, ', '')}, v as (select strategy, count(distinct row_id) filter (where valid) as valid, count(distinct row_id) filter (where not valid) as invalid from scored group by 1) select sc.strategy, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1, round(avg(f), 6) as macro_f1, any_value(valid) as valid, any_value(invalid) as invalid from sc join v on v.strategy = sc.strategy group by sc.strategy", "logits")
def _(t):
    s = _scored(t).withColumn("strategy", F.col("row_id") % 3).withColumn("valid", F.col("row_id") % 10 != 0).withColumn("predicted", F.col("predicted") & F.col("valid"))
    v = s.groupBy("strategy").agg(F.count_distinct(F.when(F.col("valid"), F.col("row_id"))).alias("valid"), F.count_distinct(F.when(~F.col("valid"), F.col("row_id"))).alias("invalid"))
    return L.multilabel_metrics(s, ["strategy"]).join(v, "strategy").select("strategy", F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"), "valid", "invalid")


@R.add("x14_few_shot_examples", "select topic, row_id from (select *, row_number() over (partition by topic order by row_id) as n from picked where polarity = 'positive') where n <= 3", "picked")
def _(t):
    w = Window.partitionBy("topic").orderBy("row_id")
    return t("picked").filter("polarity = 'positive'").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("topic", "row_id")


@R.add("g09_topic_counts", f"with {ONCE} select * from counts", "picked")
def _(t):
    return G.topic_counts(t("picked"), MAPPING)


TOP = "named as (select *, count(*) filter (where topic <> 'other') over (partition by appid, polarity) as k from counts), top as (select *, row_number() over (partition by appid, polarity order by n desc, topic) as rank from named where topic <> 'other' or k = 0)"


@R.add("g10_top_topics", f"with {ONCE}, {TOP} select appid, polarity, topic, n, rank from top where rank <= 3", "picked")
def _(t):
    return G.top_topics(G.topic_counts(t("picked"), MAPPING)).select("appid", "polarity", "topic", "n", F.col("rank").cast("bigint").alias("rank"))


PANEL = f"""{ONCE}, {TOP}, c as (select appid, count(*) as review_count from rows_of group by 1),
tt as (select appid, string_agg(topic, ',' order by rank) filter (where polarity = 'positive') as tp, string_agg(topic, ',' order by rank) filter (where polarity = 'negative') as tn from top where rank <= 3 group by 1),
cc as (select appid, string_agg(topic || ':' || n, ',' order by n desc, topic) filter (where polarity = 'positive') as cp, string_agg(topic || ':' || n, ',' order by n desc, topic) filter (where polarity = 'negative') as cn from counts group by 1),
panel as (select c.appid, review_count, coalesce(tp, '') as top_positive, coalesce(cp, '') as positive_counts, coalesce(tn, '') as top_negative, coalesce(cn, '') as negative_counts from c left join tt on tt.appid = c.appid left join cc on cc.appid = c.appid)"""


def panel(t):
    return G.topic_panel(t("rows_of"), t("picked"), MAPPING)


@R.add("g11_topic_panel", f"with {PANEL} select * from panel", "rows_of picked")
def _(t):
    return panel(t)


@R.add("j10_panel_join", f"""with {PANEL} select d.doc_id, case when p.appid is null then 'unavailable' else 'ok' end as status, coalesce('reviews=' || format('{{:,}}', p.review_count) || '; top=' || replace(p.top_positive, ',', ', '), '') as fields from documents d left join panel p on p.appid = d.doc_id""", "rows_of picked")
def _(t):
    d = t("documents").select("doc_id")
    j = d.join(panel(t).withColumnRenamed("appid", "doc_id"), "doc_id", "left")
    fields = F.array(F.struct(F.lit("reviews").alias("k"), F.format_string("%,d", "review_count").alias("v")), F.struct(F.lit("top").alias("k"), F.array_join(F.split("top_positive", ","), ", ").alias("v")))
    text = F.array_join(F.transform(fields, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "; ")
    return j.select("doc_id", F.when(F.col("review_count").isNull(), "unavailable").otherwise("ok").alias("status"), F.when(F.col("review_count").isNull(), "").otherwise(text).alias("fields"))


@R.add("g12_pseudo_label_audit", """with r as (select l.row_id, count(*) filter (where polarity = 'positive') as p, count(*) filter (where polarity = 'negative') as n from rows_of l left join picked k on k.row_id = l.row_id group by 1)
select count(*) as rows_in, count(*) filter (where p = 0) as empty_positive, count(*) filter (where n = 0) as empty_negative, count(*) filter (where p = 0 and n = 0) as empty_both, round(avg(p + n), 6) as mean_topics, max(p + n) as max_topics from r""", "rows_of picked")
def _(t):
    r = _scored(t).groupBy("row_id").agg(F.count_if(F.col("predicted") & (F.col("label_id") < 19)).alias("p"), F.count_if(F.col("predicted") & (F.col("label_id") >= 19)).alias("n"))
    return r.agg(F.count("*").alias("rows_in"), F.count_if(F.col("p") == 0).alias("empty_positive"), F.count_if(F.col("n") == 0).alias("empty_negative"), F.count_if(F.expr("p = 0 and n = 0")).alias("empty_both"), F.round(F.avg(F.expr("p + n")), 6).alias("mean_topics"), F.max(F.expr("p + n")).alias("max_topics"))


@R.add("g13_multi_hot", "select row_id, string_agg((1 / (1 + exp(-logit)) >= 0.39)::int::varchar, '' order by label_id) as hot from logits group by row_id", "logits")
def _(t):
    names = [f"{s}__t{k}" for s in ("pos", "neg") for k in range(19)]
    have = _scored(t).groupBy("row_id").agg(F.collect_set(F.when(F.col("predicted"), F.col("label"))).alias("have"))
    hot = F.transform(F.array(*map(F.lit, names)), lambda x: F.array_contains("have", x).cast("int"))
    return have.select("row_id", F.array_join(hot, "").alias("hot"))


@R.add("g14_label_distribution", "select label, count(*) filter (where gold) as total, count(*) filter (where gold and row_id % 10 <> 0) as train, count(*) filter (where gold and row_id % 10 = 0) as valid, count(*) filter (where gold and row_id % 10 = 0) = 0 as missing from logits group by 1", "logits")
def _(t):
    valid = F.col("row_id") % 10 == 0
    g = t("logits").groupBy("label").agg(F.count_if("gold").alias("total"), F.count_if(F.col("gold") & ~valid).alias("train"), F.count_if(F.col("gold") & valid).alias("valid"))
    return g.withColumn("missing", F.col("valid") == 0)


@R.add("g15_pos_weights", "select label, count(*) filter (where gold) as pos, count(*) filter (where not gold) as neg, round(least(10.0, greatest(1.0, sqrt(count(*) filter (where not gold) / count(*) filter (where gold)))), 6) as weight from logits group by 1 having count(*) filter (where gold) > 0", "logits")
def _(t):
    """Labels of the whole table; those without a positive, which would stop the operator, are taken out first."""
    s = t("logits")
    named = s.filter("gold").select("label").distinct()
    return G.pos_weights(s.join(named, "label", "left_semi")).select("label", "pos", "neg", F.round("weight", 6).alias("weight"))


@R.add("g21_leaderboard", f"with {STRATEGY}, {METRICS.format('strategy, ', '')}, m as (select strategy, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) as micro, avg(f) as macro from sc group by 1) select strategy, round(micro, 6) as micro_f1, row_number() over (order by micro desc, macro desc, strategy) as place from m", "logits")
def _(t):
    s = _scored(t).withColumn("strategy", F.col("row_id") % 3).withColumn("predicted", F.col("predicted") & (F.col("row_id") % 10 != 0))
    m = L.multilabel_metrics(s, ["strategy"]).withColumn("one", F.lit(1))
    w = Window.partitionBy("one").orderBy(F.desc("micro_f1"), F.desc("macro_f1"), "strategy")  # one row for each model
    return m.select("strategy", F.round("micro_f1", 6).alias("micro_f1"), F.row_number().over(w).cast("bigint").alias("place"))


@R.add("g22_allowed_topics", "select distinct topic from picked", "picked")
def _(t):
    topics = t("picked").select("topic").distinct()
    guide = topics.sparkSession.createDataFrame([(f"t{k}", f"topic {k}") for k in range(19)], "topic string, guide string")
    checked = topics.join(F.broadcast(guide), "topic", "left")
    return checked.select(F.when(F.col("guide").isNull(), F.raise_error(F.concat(F.lit("no guide for "), "topic")).cast("string")).otherwise(F.col("topic")).alias("topic"))


@R.add("w10_sort_selected_scores", "select row_id, string_agg(label || ':' || round(1 / (1 + exp(-logit)), 4)::decimal(10,4)::varchar, ',' order by round(1 / (1 + exp(-logit)), 6) desc, label) as scores from picked group by row_id", "picked")
def _(t):
    p = F.round(L.probability(), 6)
    g = t("picked").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct((-p).alias("k"), "label", F.round(L.probability(), 4).cast("decimal(10,4)").cast("string").alias("v")))).alias("a"))
    return g.select("row_id", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["label"], x["v"])), ",").alias("scores"))


@R.add("w11_extremes_report", f"with {SCORED}, {METRICS.format('', 'where tp + fn > 0')}, r as (select label, tp + fn as support, f, row_number() over (order by f, tp + fn desc, label) as low, row_number() over (order by f desc, tp + fn desc, label) as high from sc) select label, support, round(f, 6) as f1, low <= 20 as lowest, high <= 15 as highest from r where low <= 20 or high <= 15", "logits")
def _(t):
    lab = L.per_label(_scored(t)).filter("support > 0").withColumn("one", F.lit(1))  # one row for each label
    low = F.row_number().over(Window.partitionBy("one").orderBy("f1", F.desc("support"), "label"))
    high = F.row_number().over(Window.partitionBy("one").orderBy(F.desc("f1"), F.desc("support"), "label"))
    return lab.withColumns({"low": low, "high": high}).filter("low <= 20 or high <= 15").select("label", "support", F.round("f1", 6).alias("f1"), (F.col("low") <= 20).alias("lowest"), (F.col("high") <= 15).alias("highest"))


TOK = "regexp_extract_all({0}, '[가-힣]+|[a-zA-Z]+|[0-9]+')"


def _rouge_sql(n):
    grams = lambda c: f"(select conv_id, turn, g, count(*) as c from (select conv_id, turn, unnest(list_transform(range(1, greatest(0, len(a) - {n} + 1) + 1), lambda i : array_to_string(a[i:i + {n - 1}], ' '))) as g from (select conv_id, turn, {TOK.format(c)} as a from rouge_pairs)) group by 1, 2, 3)"
    return f"""p{n} as {grams('pred')}, r{n} as {grams('ref')}, m{n} as (select p.conv_id, p.turn, sum(least(p.c, r.c)) as m from p{n} p join r{n} r on r.conv_id = p.conv_id and r.turn = p.turn and r.g = p.g group by 1, 2),
f{n} as (select k.conv_id, k.turn, coalesce(m, 0) / greatest(1, len({TOK.format('pred')}) - {n} + 1) as p, coalesce(m, 0) / greatest(1, len({TOK.format('ref')}) - {n} + 1) as r from rouge_pairs k left join m{n} m on m.conv_id = k.conv_id and m.turn = k.turn),
o{n} as (select conv_id, turn, p, r, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f from f{n})"""


@R.add("x01_rouge_n", f"with {_rouge_sql(1)}, {_rouge_sql(2)} select o1.conv_id, o1.turn, round(o1.p, 6) as p1, round(o1.r, 6) as r1, round(o1.f, 6) as f1, round(o2.f, 6) as f2 from o1 join o2 on o2.conv_id = o1.conv_id and o2.turn = o1.turn", "rouge_pairs")
def _(t):
    pairs = t("rouge_pairs")
    one = L.rouge_n_table(pairs, ["conv_id", "turn"], 1).toDF("conv_id", "turn", "p1", "r1", "f1")
    two = L.rouge_n_table(pairs, ["conv_id", "turn"], 2).toDF("conv_id", "turn", "p2", "r2", "f2")
    return one.join(two, ["conv_id", "turn"]).select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in ("p1", "r1", "f1", "f2")))


@R.add("x02_rouge_l")
def _(t):
    tokens = t("rouge_pairs").select("conv_id", "turn", T.tokenize("pred").alias("a"), T.tokenize("ref").alias("b"))
    m = L.rouge_l(F.col("a"), F.col("b"), F.col("lcs"))
    return tokens.withColumn("lcs", L.lcs_length(F.col("a"), F.col("b"))).select("conv_id", "turn", *(F.round(v, 6).alias(k) for k, v in m.items()))


def _summary_of(text: str) -> str:
    return f"case when turn % 3 = 0 then 'RPG' else split_part({text}, ' ', 1) end as genre, case when turn % 4 < 2 then '적을 물리치며 성장하는 게임' else {text} end as core_play, {text} as feature"


def _x03() -> str:
    """The SQL of the report: each part of the summaries as rows, scored by n-grams, beside the format checks."""
    checks = f"""select conv_id, turn, trim(genre) <> '' and trim(core_play) <> '' and trim(feature) <> '' as s, not regexp_matches(genre, '[()（）]') and len(list_filter(regexp_extract_all(genre, '[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*'), lambda w : lower(w) not in ('{"','".join(T.FORMAT_LATIN_WORDS)}'))) = 0 as g,
 not regexp_matches(w, '(^|\\n)\\s*[-*•·▪◦]\\s') and not regexp_matches(w, '[\\x{{1F000}}-\\x{{10FFFF}}]') as b,
 case when length(regexp_replace(w, '[^가-힣ᄀ-ᇿ一-鿿A-Za-z]', '', 'g')) = 0 then true else length(regexp_replace(w, '[^가-힣ᄀ-ᇿ]', '', 'g')) / length(regexp_replace(w, '[^가-힣ᄀ-ᇿ一-鿿A-Za-z]', '', 'g')) >= 0.4 end as k from (select *, concat_ws(chr(10), genre, core_play, feature) as w from preds)"""
    body = ""
    for n in (1, 2):
        grams = lambda c, n=n: f"(select conv_id, turn, part, g, count(*) as c from (select conv_id, turn, part, unnest(list_transform(range(1, greatest(0, len(a) - {n} + 1) + 1), lambda i : array_to_string(a[i:i + {n - 1}], ' '))) as g from (select conv_id, turn, part, {TOK.format(c)} as a from parts)) group by 1, 2, 3, 4)"
        body += f""", p{n} as {grams('p')}, r{n} as {grams('r')}, m{n} as (select conv_id, turn, part, sum(least(p{n}.c, r{n}.c)) as m from p{n} join r{n} using (conv_id, turn, part, g) group by 1, 2, 3),
 f{n} as (select part, coalesce(m, 0) / greatest(1, len({TOK.format('p')}) - {n} + 1) as x, coalesce(m, 0) / greatest(1, len({TOK.format('r')}) - {n} + 1) as y from parts left join m{n} using (conv_id, turn, part)),
 o{n} as (select 'rouge{n}.' || part as metric, avg(case when x + y = 0 then 0 else 2 * x * y / (x + y) end) as value from f{n} group by 1)"""
    return f"""with preds as (select conv_id, turn, {_summary_of('pred')} from rouge_pairs), golds as (select conv_id, turn, {_summary_of('ref')} from rouge_pairs),
both_ as (select p.conv_id, p.turn, p.genre as pg, p.core_play as pc, p.feature as pf, g.genre as gg, g.core_play as gc, g.feature as gf from preds p join golds g using (conv_id, turn)),
parts as (select conv_id, turn, 'all' as part, concat_ws(' ', pg, pc, pf) as p, concat_ws(' ', gg, gc, gf) as r from both_ union all select conv_id, turn, 'genre', pg, gg from both_ union all select conv_id, turn, 'core_play', pc, gc from both_ union all select conv_id, turn, 'feature', pf, gf from both_),
chk as ({checks}){body},
users as (select count(*) as n from conversations where role = 'user'), have as (select count(*) as n from rouge_pairs),
every_ as (select 'gold_total' as metric, users.n::double as value from users union all select 'scored', have.n from have union all select 'missing', users.n - have.n from users, have
 union all select 'format.schema', avg(s::int) from chk union all select 'format.genre_noun', avg(g::int) from chk union all select 'format.no_bullet', avg(b::int) from chk union all select 'format.korean', avg(k::int) from chk
 union all select 'format.compliant', avg((s and g and b and k)::int) from chk union all select * from o1 union all select * from o2)
select metric, round(value, 4) as value from every_"""


@R.add("x03_summary_report", _x03(), "rouge_pairs")
def _(t):
    pairs = t("rouge_pairs")
    struct = lambda c: F.struct(
        F.expr(f"case when turn % 3 = 0 then 'RPG' else split_part({c}, ' ', 1) end").alias("genre"), F.expr(f"case when turn % 4 < 2 then '적을 물리치며 성장하는 게임' else {c} end").alias("core_play"), F.col(c).alias("feature"))
    users = t("conversations").filter("role = 'user'").select("conv_id", "turn", F.lit(True).alias("user"))
    j = users.join(pairs, ["conv_id", "turn"], "left")
    j = j.select("conv_id", "turn", F.when(F.col("pred").isNotNull(), struct("pred")).alias("pred"), struct("ref").alias("gold"))
    return L.summary_report(j, ["conv_id", "turn"], T.format_checks("pred.genre", "pred.core_play", "pred.feature"), lcs=False)
