"""Catalogue filters and constraint rows. The search for many constraints at once is in bitmaps.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories that stand for two players or more.
TOGETHER = ("Multi-player", "Co-op", "Online Co-op", "Online Multi-Player", "Local Co-op", "Shared/Split Screen", "Cross-Platform Multiplayer")
TERM_FIELDS = ("genres", "categories", "platforms", "exclude_genres", "exclude_categories", "exclude_platforms")


def adult_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.col("required_age").isNull() | (F.col("required_age") < 18))


def price_ok(max_usd: Column, free_only: Column) -> Column:
    """A maximum lets free apps and known prices up to it pass, and then free_only is not looked at."""
    cents = F.floor(max_usd * 100 + F.lit(1e-6))
    return F.when(max_usd.isNotNull(), F.col("is_free") | F.coalesce(F.col("price_cents") <= cents, F.lit(False))).when(F.coalesce(free_only, F.lit(False)), F.col("is_free")).otherwise(F.lit(True))


def price_filter(df: DataFrame, max_usd: float | None = None, free_only: bool | None = None) -> DataFrame:
    return df.filter(price_ok(F.lit(max_usd).cast("double"), F.lit(free_only).cast("boolean")))


def genre_filter(apps: DataFrame, app_genres: DataFrame, genres: DataFrame, names: list[str], mode: str = "intersection") -> DataFrame:
    """Apps with a genre like each name (or like any): one pass over the bridge, counted by distinct name."""
    wanted = F.explode(F.array(*(F.lit(n) for n in names))).alias("_name")
    dims = genres.select(F.col("id").alias("genre_id"), F.coalesce("english_name", "name").alias("_g"), wanted)
    dims = dims.filter(F.contains(F.lower("_g"), F.lower("_name"))).select("genre_id", "_name")
    hit = app_genres.join(dims, "genre_id").groupBy("appid").agg(F.count_distinct("_name").alias("_n"))
    return apps.join(hit.filter(F.col("_n") >= (len(names) if mode == "intersection" else 1)).select("appid"), "appid", "left_semi")


def category_filter(df: DataFrame, names: list[str], mode: str = "intersection") -> DataFrame:
    tests = [F.contains(F.lower("english_categories"), F.lit(n.lower())) for n in names]
    out = tests[0]
    for t in tests[1:]:
        out = (out & t) if mode == "intersection" else (out | t)
    return df.filter(out)


def plays_together(categories: str = "english_categories") -> Column:
    return F.coalesce(F.col(categories).rlike("(?i)" + "|".join(t.replace("/", "\\/") for t in TOGETHER)), F.lit(False))


def min_players_filter(df: DataFrame, n: int) -> DataFrame:
    return df.filter(plays_together()) if n >= 2 else df


def platforms_of() -> Column:
    return F.array_compact(F.array(F.when(F.col("win"), F.lit("windows")), F.when(F.col("mac"), F.lit("mac")), F.when(F.col("linux"), F.lit("linux"))))


def platform_filter(df: DataFrame, names: list[str]) -> DataFrame:
    have = platforms_of()
    return df.filter(F.size(F.array_except(F.array(*(F.lit(n) for n in set(names))), have)) == 0)


def exclude_filter(df: DataFrame, genres: list[str] = (), categories: list[str] = (), platforms: list[str] = (), free: bool = False) -> DataFrame:
    """Genres exactly, categories as a part of the joined list, both with case; any excluded platform; free apps."""
    if genres:
        df = df.filter(~F.arrays_overlap(F.coalesce("genres", F.array().cast("array<string>")), F.array(*map(F.lit, genres))))
    for c in categories:
        df = df.filter(~F.contains(F.coalesce("english_categories", F.lit("")), F.lit(c)))
    if platforms:
        df = df.filter(~F.arrays_overlap(platforms_of(), F.array(*map(F.lit, platforms))))
    return df.filter(~F.col("is_free")) if free else df


def catalog_join(apps: DataFrame, app_genres: DataFrame, genres: DataFrame) -> DataFrame:
    """Apps with genres array<string> (English names, sorted) and match_genres (English or local names)."""
    dims = genres.select(F.col("id").alias("genre_id"), "english_name", F.coalesce("english_name", "name").alias("_any"))
    lists = app_genres.join(dims, "genre_id").groupBy("appid").agg(F.sort_array(F.collect_set("english_name")).alias("genres"), F.sort_array(F.collect_set("_any")).alias("match_genres"))
    none = F.array().cast("array<string>")
    return apps.join(lists, "appid", "left").withColumns({"genres": F.coalesce("genres", none), "match_genres": F.coalesce("match_genres", none)})


def constraint_rows(scalars: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per query: the scalars and an array for each field of terms (null where it has none)."""
    lists = [F.sort_array(F.collect_set(F.when(F.col("field") == f, F.col("term")))).alias(f) for f in TERM_FIELDS]
    wide = scalars.join(terms.groupBy("query_id").agg(*lists), "query_id", "left")
    return wide.withColumns({f: F.when(F.size(f) > 0, F.col(f)) for f in TERM_FIELDS})


POPULAR = ("metacritic_score", "recommendations_total")


def popularity_order() -> list[Column]:
    return [F.desc_nulls_last("metacritic_score"), F.desc_nulls_last("recommendations_total"), F.col("appid")]


def normalize_constraint(c: DataFrame) -> DataFrame:
    """Empty lists and texts become null; a maximum price of 0 means free only."""
    lists = {f: F.when(F.size(f) > 0, F.col(f)) for f in TERM_FIELDS if f in c.columns}
    free = F.when(F.col("max_price_usd") == 0, F.lit(True)).otherwise(F.col("free_only"))
    more = {"free_only": free, "max_price_usd": F.when(F.col("max_price_usd") != 0, F.col("max_price_usd"))}
    return c.withColumns(lists | more | ({"free_text": F.nullif(F.trim("free_text"), F.lit(""))} if "free_text" in c.columns else {}))


# Genre names of the store, tags that are no categories, words for free games.
STORE_GENRES = ("Action", "Adventure", "Casual", "Indie", "Massively Multiplayer", "RPG", "Racing", "Simulation", "Sports", "Strategy", "Early Access", "Free To Play", "Utilities")
FREE_WORDS = ("무료", "공짜", "프리", "free to play", "f2p")


def repair_constraint(c: DataFrame, synonyms: dict[str, str], official: tuple[str, ...], tags: tuple[str, ...]) -> DataFrame:
    """Genre synonyms, unofficial genres to free_text, genres rescued from categories, tags to free_text, two categories
    at most, free and player words of the query. Rows with nothing in any field are dropped."""
    none = F.array().cast("array<string>")
    low = {k.lower(): v for k, v in synonyms.items()}
    pairs = F.create_map(*(F.lit(x) for kv in low.items() for x in kv)) if low else F.lit(None).cast("map<string,string>")
    as_genre = lambda x: F.coalesce(F.get(F.transform(F.array(x), lambda y: pairs[F.lower(y)]), 0), x)
    is_official = lambda x: x.isin(*official)
    has = F.lit(False)
    for f in (*TERM_FIELDS, "max_price_usd", "free_only", "min_players", "free_text"):
        has = has | F.col(f).isNotNull()
    c = c.filter(has)
    genres = F.transform(F.coalesce("genres", none), as_genre)
    cats = F.coalesce("categories", none)
    rescued = F.filter(F.transform(cats, as_genre), is_official)
    plain = F.filter(cats, lambda x: ~is_official(as_genre(x)))
    demoted = F.filter(plain, lambda x: x.isin(*tags)) if tags else none
    kept = F.slice(F.filter(plain, lambda x: ~x.isin(*tags)) if tags else plain, 1, 2)
    loose = F.filter(genres, lambda x: ~is_official(x))
    text = F.nullif(F.trim(F.concat_ws(" ", F.coalesce("free_text", F.lit("")), F.array_join(loose, " "), F.array_join(demoted, " "))), F.lit(""))
    text = F.regexp_replace(text, r"\s+", " ")
    all_genres = F.array_distinct(F.concat(F.filter(genres, is_official), rescued))
    q = F.lower(F.coalesce("query", F.lit("")))
    free = F.coalesce("free_only", F.when(q.rlike("|".join(FREE_WORDS)), F.lit(True)))
    n = F.regexp_extract(F.coalesce("query", F.lit("")), r"(\d+)\s*(?:인\s*용|명이\s*서)", 1)
    players = F.coalesce("min_players", F.when(n != "", n.cast("int")))
    return normalize_constraint(c.withColumns({"genres": all_genres, "categories": kept, "free_text": text, "free_only": free, "min_players": players}))
