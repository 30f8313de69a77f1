"""Constraint search over a bitmap index of the catalogue.

Apps are numbered in order of popularity. For each genre, category text, platform and price step the index has the bitmap of
the apps that have it, one 64-bit word for each 64 numbers. A constraint is a set of clauses, each the OR of some bitmaps;
a query's words are the AND of its clauses without those that it excludes. Names that only have to lie inside a genre or
category are looked up among the distinct ones (substring_pairs). A maximum price falls between two steps: the bitmap of the
upper one holds every app that may do, that of the lower one those that surely do, and the apps between are compared.

As low numbers are the most popular apps, the k best of a query lie in its first words; no list of all its apps is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelode.operators import search as S
from gamelode.operators.sampling import global_row_number
from gamelode.operators.substrings import substring_pairs
from gamelode.sources.scratch import stored

#: cents; a bitmap holds the apps with a price up to its step, the last one all with a known price
STEPS = tuple(m * 10**e for e in range(1, 7) for m in (1, 2, 5))
FIELDS = ("genres", "categories", "platforms", "min_players", "exclude_genres", "exclude_categories", "exclude_platforms", "price")
LEVELS = (("strict", FIELDS), ("relaxed", ("price", "genres", "categories")), ("minimal", ("price",)), ("popular", ()))
RELAX_ORDER = ("min_players", "platforms", "exclude_platforms", "exclude_categories", "exclude_genres", "categories", "genres", "price")


@dataclass(frozen=True)
class CatalogueIndex:
    """apps: the catalogue's rows with no, their place by popularity from 0. words: facet, value, word, bits. values: facet,
    value of the names that constraints may give a part of."""

    apps: DataFrame
    words: DataFrame
    values: DataFrame


def catalogue_index(catalogue: DataFrame) -> CatalogueIndex:
    """catalogue: as of catalog_join. Apps that not all may see are left out, as no constraint finds them."""
    numbered = global_row_number(S.adult_filter(catalogue), S.popularity_order(), "no")
    apps = stored(numbered.withColumn("no", F.col("no") - 1), "apps")
    one = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    each = lambda facet, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: one(facet, v))
    steps = F.filter(F.array(*map(F.lit, STEPS)), lambda s: F.col("price_cents") <= s)
    none = F.array().cast("array<struct<facet:string,value:string>>")
    facets = F.concat(
        F.array(one("all", F.lit(""))), F.when(F.col("is_free"), F.array(one("free", F.lit("")))).otherwise(none),
        F.when(F.col("price_cents").isNotNull(), F.concat(each("price", steps.cast("array<string>")), F.array(one("price", F.lit("known"))))).otherwise(none),
        each("genre", F.array_distinct(F.transform("match_genres", F.lower))), each("genre_exact", F.array_distinct("genres")),
        F.array(F.when(F.col("english_categories").isNull(), one("no_category", F.lit(""))).otherwise(one("category", F.col("english_categories")))),
        each("platform", S.platforms_of()), F.when(S.plays_together(), F.array(one("together", F.lit("")))).otherwise(none),
    )
    rows = apps.select("no", F.explode(facets).alias("f")).filter("f.value is not null")
    bit = F.expr("shiftleft(1L, cast(no % 64 as int))")
    words = stored(rows.groupBy("f.facet", "f.value", F.expr("no div 64").alias("word")).agg(F.bit_or(bit).alias("bits")), "bitmaps")
    return CatalogueIndex(apps, words, words.filter(F.col("facet").isin("genre", "category")).select("facet", "value").distinct())


def clauses(constraints: DataFrame, index: CatalogueIndex) -> tuple[DataFrame, DataFrame]:
    """Of constraint rows (one for each query_id): the bitmaps that each clause ORs, as query_id, field, clause, wanted (else
    excluded), facet, value, sure; and query_id, field, n: how many wanted clauses each field has."""
    steps = F.array(*map(F.lit, STEPS))
    cents = F.floor(F.col("max_price_usd") * 100 + F.lit(1e-6))
    upper = F.coalesce(F.array_min(F.filter(steps, lambda s: s >= cents)).cast("string"), F.lit("known"))
    under = F.array_max(F.filter(steps, lambda s: s <= cents)).cast("string")
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")

    def row(field: str, term: Column | str, wanted: bool, facet: str, value: Column | str = "", part: Column | None = None, fold: bool = False, sure: bool = True) -> Column:
        named = {"field": F.lit(field), "clause": text(term), "wanted": F.lit(wanted), "facet": F.lit(facet), "value": text(value), "part": part if part is not None else F.lit(None).cast("string"), "fold": F.lit(fold), "sure": F.lit(sure)}
        return F.struct(*(c.alias(n) for n, c in named.items()))

    def each(field: str, *made) -> list[Column]:
        terms = F.array_distinct(F.array_compact(F.coalesce(field, F.array().cast("array<string>"))))
        return [F.transform(terms, f) for f in made]

    def where(condition: Column, *rows: Column) -> Column:
        return F.filter(F.array(*(F.when(F.coalesce(condition, F.lit(False)), r) for r in rows)), lambda r: r.isNotNull())

    capped = F.col("max_price_usd").isNotNull()
    every = F.concat(
        *each("genres", lambda t: row("genres", t, True, "genre", part=F.lower(t), fold=True)),
        *each("categories", lambda t: row("categories", t, True, "category", part=F.lower(t), fold=True), lambda t: row("categories", t, True, "no_category")),
        *each("platforms", lambda t: row("platforms", t, True, "platform", t)), *each("exclude_genres", lambda t: row("exclude_genres", t, False, "genre_exact", t)),
        *each("exclude_categories", lambda t: row("exclude_categories", t, False, "category", part=t)), *each("exclude_platforms", lambda t: row("exclude_platforms", t, False, "platform", t)),
        where(F.col("min_players") >= 2, row("min_players", "", True, "together")), where(capped | F.col("free_only"), row("price", "", True, "free")),
        where(capped, row("price", "", True, "price", upper, sure=False)), where(capped & under.isNotNull(), row("price", "", True, "price", under)),
    )
    asked = stored(constraints.select("query_id", F.explode(every).alias("r")).select("query_id", "r.*"), "asked")
    texts = index.values.select("facet", "value", F.explode(F.array(F.struct(F.lit(True).alias("fold"), F.lower("value").alias("text")), F.struct(F.lit(False).alias("fold"), F.col("value").alias("text")))).alias("x"))
    texts = stored(texts.select("facet", "value", "x.fold", "x.text"), "texts")
    named = asked.filter("part is not null")
    found = substring_pairs(named, texts).join(texts, "text")
    columns = ["query_id", "field", "clause", "wanted", "facet", "value", "sure"]
    rows = asked.filter("part is null").select(*columns).union(named.drop("value").join(found, ["facet", "fold", "part"]).select(*columns))
    return stored(rows, "clauses"), asked.groupBy("query_id", "field").agg(F.count_distinct(F.when(F.col("wanted"), F.col("clause"))).alias("n"))


def match_words(clause_rows: DataFrame, counts: DataFrame, plans: DataFrame, index: CatalogueIndex) -> DataFrame:
    """plans: query_id, level, fields (array): which fields count at which level. query_id, level, word, bits, sure: the apps
    that may and that surely do meet all clauses of a level."""
    of = plans.select("query_id", "level", F.explode("fields").alias("field"))
    needed = plans.select("query_id", "level").join(of.join(counts.filter("n > 0"), ["query_id", "field"]).groupBy("query_id", "level").agg(F.sum("n").cast("bigint").alias("n")), ["query_id", "level"], "left")
    bare = needed.filter("n is null").select("query_id", "level", F.lit("").alias("field"), F.lit("").alias("clause"), F.lit(True).alias("wanted"), F.lit("all").alias("facet"), F.lit("").alias("value"), F.lit(True).alias("sure"))
    rows = clause_rows.join(of, ["query_id", "field"]).select(*bare.columns).union(bare)
    bits, sure = F.bit_or("bits"), F.bit_or(F.when(F.col("sure"), F.col("bits")).otherwise(F.lit(0).cast("bigint")))
    ored = rows.join(index.words, ["facet", "value"]).groupBy("query_id", "level", "field", "clause", "wanted", "word").agg(bits.alias("bits"), sure.alias("sure"))
    wanted = F.col("wanted")
    anded = ored.groupBy("query_id", "level", "word").agg(
        F.bit_and(F.when(wanted, F.col("bits"))).alias("bits"), F.bit_and(F.when(wanted, F.col("sure"))).alias("sure"), F.bit_or(F.when(~wanted, F.col("bits"))).alias("out"), F.count_if(wanted).alias("met")
    )
    left = F.bitwise_not(F.coalesce("out", F.lit(0).cast("bigint")))
    found = anded.join(needed, ["query_id", "level"]).filter(F.col("met") == F.coalesce("n", F.lit(1)))
    return found.select("query_id", "level", "word", F.col("bits").bitwiseAND(left).alias("bits"), F.col("sure").bitwiseAND(left).alias("sure")).filter("bits <> 0")


def apps_of(words: DataFrame, constraints: DataFrame, index: CatalogueIndex) -> DataFrame:
    """One row for each app of match_words(), with the catalogue's columns: those that may do are compared by price."""
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
    each = words.select("query_id", "level", "word", "sure", F.explode(on).alias("_at"))
    each = each.select("query_id", "level", (F.col("word") * 64 + F.col("_at")).alias("no"), (F.call_function("shiftright", F.col("sure"), F.col("_at")).bitwiseAND(F.lit(1)) == 1).alias("_sure"))
    rows = each.join(index.apps, "no").join(constraints.select("query_id", F.col("max_price_usd").alias("_max"), F.col("free_only").alias("_free")), "query_id")
    return rows.filter(F.col("_sure") | S.price_ok(F.col("_max"), F.col("_free"))).drop("_sure", "_max", "_free")


def first_words(words: DataFrame, k: int) -> DataFrame:
    """The words of each query and level in which its k first apps lie."""
    before = F.sum(F.bit_count("sure")).over(Window.partitionBy("query_id", "level").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < k).drop("_before")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "level").orderBy("no")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _plans(constraints: DataFrame, levels: list[tuple[int, Column]]) -> DataFrame:
    return constraints.select("query_id", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), f.alias("fields")) for n, f in levels))).alias("_l")).select("query_id", "_l.level", "_l.fields")


def _names(fields: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, fields)).cast("array<string>")


def _index(catalogue: DataFrame | CatalogueIndex) -> CatalogueIndex:
    return catalogue if isinstance(catalogue, CatalogueIndex) else catalogue_index(catalogue)


def constraint_match(constraints: DataFrame, catalogue: DataFrame | CatalogueIndex, k: int | None = None) -> DataFrame:
    """query_id, the columns of the catalogue and no, of all apps that meet a constraint, or of its k most popular ones with
    their rank."""
    index = _index(catalogue)
    rows, counts = clauses(constraints, index)
    words = match_words(rows, counts, _plans(constraints, [(0, _names(FIELDS))]), index)
    found = apps_of(words if k is None else first_words(words, k), constraints, index)
    return (found if k is None else _top(found, k)).drop("level")


def fallback_levels(constraints: DataFrame, catalogue: DataFrame | CatalogueIndex, k: int) -> DataFrame:
    """query_id, level, rank and the catalogue's columns: the k most popular apps at the first of LEVELS that has any. All
    levels come from the same bitmaps in one pass."""
    index = _index(catalogue)
    rows, counts = clauses(constraints, index)
    words = match_words(rows, counts, _plans(constraints, [(n, _names(fields)) for n, (_, fields) in enumerate(LEVELS)]), index)
    priced = apps_of(first_words(words.filter("level < 3"), k), constraints, index)
    anything = apps_of(first_words(words.filter("level = 3"), k), _any_price(constraints), index)
    top = _top(priced.unionByName(anything), k)
    found = top.withColumn("_least", F.min("level").over(Window.partitionBy("query_id"))).filter("level = _least")
    name = F.element_at(F.array(*(F.lit(n) for n, _ in LEVELS)), F.col("level") + 1)
    return found.withColumn("level", name).select("query_id", "level", "rank", *[c for c in index.apps.columns if c != "no"])


def _any_price(constraints: DataFrame) -> DataFrame:
    return constraints.select("query_id", F.lit(None).cast("double").alias("max_price_usd"), F.lit(None).cast("boolean").alias("free_only"))


def relax_once(constraints: DataFrame, catalogue: DataFrame | CatalogueIndex, order: tuple[str, ...] = RELAX_ORDER, k: int | None = None) -> DataFrame:
    """As constraint_match; a query without any app is asked once more without one field: the first of `order` that it has.
    Adds used: 'all', or the field that was left out."""
    index = _index(catalogue)
    rows, counts = clauses(constraints, index)
    has = counts.groupBy("query_id").agg(F.collect_set("field").alias("_has"))
    plans = constraints.select("query_id").join(has, "query_id", "left").withColumn("_has", F.coalesce("_has", F.array().cast("array<string>")))
    drop = F.get(F.filter(_names(order), lambda f: F.array_contains("_has", f)), 0)
    plans = stored(plans.withColumn("dropped", drop), "relaxed")
    both = F.array(F.struct(F.lit(0).alias("level"), _names(FIELDS).alias("fields")), F.struct(F.lit(1).alias("level"), F.array_except(_names(FIELDS), F.array("dropped")).alias("fields")))
    levels = plans.filter("dropped is not null").select("query_id", F.explode(both).alias("_l")).select("query_id", "_l.level", "_l.fields")
    levels = levels.union(plans.filter("dropped is null").select("query_id", F.lit(0).alias("level"), _names(FIELDS).alias("fields")))
    words = match_words(rows, counts, levels, index)
    words = words if k is None else first_words(words, k)
    free = plans.filter("dropped = 'price'").select("query_id")
    unpriced = _any_price(constraints.join(free, "query_id", "left_semi"))
    priced = constraints.join(free, "query_id", "left_anti").select("query_id", "max_price_usd", "free_only")
    found = apps_of(words.filter("level = 0"), constraints, index).unionByName(apps_of(words.filter("level = 1"), priced.union(unpriced), index))
    found = found.withColumn("_least", F.min("level").over(Window.partitionBy("query_id"))).filter("level = _least").drop("_least")
    found = found.join(plans.select("query_id", "dropped"), "query_id").withColumn("used", F.when(F.col("level") == 0, "all").otherwise(F.col("dropped"))).drop("dropped")
    return (found if k is None else _top(found, k)).drop("level")
