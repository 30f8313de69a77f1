"""Keyword blocks, bitmaps, substrings and grouped preferences against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gamelode.operators import behaviour as B
from gamelode.operators import bitmaps as M
from gamelode.operators import ranking as K
from gamelode.operators import retrieval as V
from gamelode.operators import search as S
from gamelode.operators.postings import PostingsIndex
from gamelode.operators.substrings import substring_pairs
from gamelode.plans.bindings import view


def test_substrings_are_those_of_all_pairs(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abé漢") for _ in range(draw.randrange(9))) for _ in range(200)] + [None, "", "abab", "abab"]
    parts = ["".join(draw.choice("abé漢") for _ in range(draw.randrange(6))) for _ in range(100)] + [None, "", "zzz", "\U0001f600"]
    got = substring_pairs(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in words], "text string")).collect()
    want = {(p, w) for p in parts for w in words if p is not None and w is not None and p in w}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def _ranks(hits):
    return {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 5)) for r in hits.collect()}


def test_pruned_keyword_search_is_the_whole_one(spark, sf):
    """Passages and short queries, several parameters, an index in two parts that is opened again by its folder."""
    docs = view(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "the the the of rareword")], "doc_id bigint, text string"))
    asked = view(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    short = asked.select((F.col("query_id") + 1000).alias("query_id"), F.substring_index("query", " ", 3).alias("query")).union(spark.createDataFrame([(5000, "the the of"), (5001, "rareword the"), (5002, "nowhere"), (5003, "")], "query_id bigint, query string"))
    asked = asked.union(short)
    whole = V.bm25_index(docs)
    index = PostingsIndex(spark, span=16).add(docs.filter("doc_id % 3 = 0"))
    index.close()
    index = PostingsIndex(spark, index.path)
    assert index.span == 16
    index.add(docs.filter("doc_id % 3 <> 0"))
    again = PostingsIndex(spark, index.path)
    for k, k1, b, share in ((10, 1.5, 0.75, 0.35), (3, 0.9, 0.4, 0.8), (2000, 1.5, 0.75, 0.5)):
        want = _ranks(V.bm25_search(asked, whole, k, k1, b))
        assert _ranks(again.search(asked, k, k1, b, share).hits) == want and want


def test_a_head_word_is_read_in_few_blocks(spark):
    rows = [(k, "head " * (1 + k % 3) + ("rare gem" if k in (7, 4003) else f"filler{chr(97 + k % 26)}{chr(97 + k % 7)}")) for k in range(5000)]
    index = PostingsIndex(spark, span=64).add(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = index.search(spark.createDataFrame([(1, "head rare gem")], "query_id bigint, query string"), 2)
    assert {r.doc_id for r in found.hits.collect()} == {7, 4003}
    r = found.blocks.first()
    assert r.n_blocks > 75 and r.n_read <= 6


def _meets(c, a, fields):
    """A constraint row and an app of the catalogue, as plain Python."""
    has = lambda f: (getattr(c, f) or []) if f in fields else []
    cats = a.english_categories
    platforms = [p for p, on in (("windows", a.win), ("mac", a.mac), ("linux", a.linux)) if on]
    if not (a.required_age is None or a.required_age < 18):
        return False
    if "price" in fields:
        if c.max_price_usd is not None:
            if not (a.is_free or (a.price_cents is not None and a.price_cents <= int(c.max_price_usd * 100 + 1e-6))):
                return False
        elif c.free_only and not a.is_free:
            return False
    return (
        all(any(g.lower() in m.lower() for m in a.match_genres) for g in has("genres")) and (cats is None or all(x.lower() in cats.lower() for x in has("categories")))
        and all(p in platforms for p in has("platforms")) and ("min_players" not in fields or (c.min_players or 0) < 2 or any(w.lower() in (cats or "").lower() for w in S.TOGETHER))
        and not any(g in a.genres for g in has("exclude_genres")) and not any(x in (cats or "") for x in has("exclude_categories")) and not any(p in platforms for p in has("exclude_platforms"))
    )


def _catalogue(spark):
    draw = random.Random(11)
    some = lambda xs, n: [draw.choice(xs) for _ in range(draw.randrange(n))]
    genres, cats = ["Action", "Action RPG", "Indie", "인디", "Racing"], ["Single-player", "Multi-player", "Co-op", "Online Co-op"]
    apps = []
    for k in range(700):
        g = sorted(set(some(genres, 4)))
        text = None if k % 50 == 3 else str(some(cats, 3))
        apps.append((3 * k + 10**6, f"n{k}", draw.random() < 0.1, None if draw.random() < 0.1 else draw.choice([0, 99, 100, 101, 499, 999, 5000, 10**7, 3 * 10**7]), draw.choice([None, 50, 90]), draw.choice([None, 0, 17, 18]), draw.choice([None, 5, 9]), True, k % 2 == 0, k % 3 == 0, text, g, g))
    fields = "appid bigint, name string, is_free boolean, price_cents bigint, metacritic_score int, required_age int, recommendations_total bigint, win boolean, mac boolean, linux boolean, english_categories string, genres array<string>, match_genres array<string>"
    asked = []
    for k in range(60):
        list_of = lambda xs: draw.choice([None, None, [], some(xs, 3) or None])
        asked.append((k, draw.choice([None, None, 0.0, 0.99, 1.0, 4.995, 10.0, 60.0, 10.0**6]), draw.choice([None, True, False]), draw.choice([None, 1, 2, 4]), list_of(["action", "RPG", "인", "nothing", "i"]), list_of(["co-op", "single", "PLAYER", "x"]), list_of(["linux", "mac", "beos"]), list_of(["Action", "action"]), list_of(["Co-op", "co-op"]), list_of(["mac", "linux"])))
    of = "query_id int, max_price_usd double, free_only boolean, min_players int, genres array<string>, categories array<string>, platforms array<string>, exclude_genres array<string>, exclude_categories array<string>, exclude_platforms array<string>"
    return spark.createDataFrame(asked, of), spark.createDataFrame(apps, fields)


def _by_popularity(apps):
    low = lambda x: (x is None, -(x or 0))
    return sorted(apps, key=lambda a: (low(a.metacritic_score), low(a.recommendations_total), a.appid))


def test_bitmaps_find_what_comparing_all_finds(spark):
    """Names as parts, case, nulls, empty lists, repeated terms, prices on, between and beyond steps, exclusions."""
    asked, catalogue = _catalogue(spark)
    index = M.catalogue_index(catalogue)
    rows, apps = asked.collect(), _by_popularity(catalogue.collect())
    want = {c.query_id: [a.appid for a in apps if _meets(c, a, M.FIELDS)] for c in rows}
    got = M.constraint_match(asked, index)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r.query_id, r.appid) for r in got.collect()} == {(q, a) for q, found in want.items() for a in found}
    top = {(r.query_id, r["rank"]): r.appid for r in M.constraint_match(asked, index, 7).collect()}
    assert top == {(q, k): a for q, found in want.items() for k, a in enumerate(found[:7], 1)}
    # levels
    level = {}
    for c in rows:
        name, found = next((n, f) for n, fields in M.LEVELS if (f := [a.appid for a in apps if _meets(c, a, fields)]))
        level |= {(c.query_id, name, k): a for k, a in enumerate(found[:4], 1)}
    assert {(r.query_id, r.level, r["rank"]): r.appid for r in M.fallback_levels(asked, index, 4).collect()} == level
    # one field less where nothing is found
    relaxed = set()
    for c in rows:
        if want[c.query_id]:
            relaxed |= {(c.query_id, "all", a) for a in want[c.query_id]}
            continue
        on = {f: bool(getattr(c, f)) for f in S.TERM_FIELDS} | {"min_players": (c.min_players or 0) >= 2, "price": c.max_price_usd is not None or bool(c.free_only)}
        drop = next(f for f in M.RELAX_ORDER if on[f])
        relaxed |= {(c.query_id, drop, a.appid) for a in apps if _meets(c, a, [f for f in M.FIELDS if f != drop])}
    assert {(r.query_id, r.used, r.appid) for r in M.relax_once(asked, index).collect()} == relaxed
    assert any(used != "all" for _, used, _ in relaxed)


def test_bitmaps_of_nothing(spark):
    asked, catalogue = _catalogue(spark)
    assert M.constraint_match(asked.limit(0), catalogue).count() == 0 and M.constraint_match(asked, catalogue.limit(0)).count() == 0


def test_best_games_are_those_of_the_full_table(spark, sf):
    games = view(spark, sf, "part").select(F.col("p_partkey").alias("appid"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand").alias("context"), F.array("p_brand", "p_type").alias("tags"))
    events = view(spark, sf, "interactions")
    full = B.preference_scores(events, games).withColumn("score", F.round("score", 12))
    lists = B.game_groups(B.recent_actions(events).filter("type = 'search' and query is not null"), games).lists
    groups = lists.select("grp").distinct().count()
    for k, share in ((1, 0.4), (20, 0.4), (20, 0.9), (400, 0.2)):
        got = B.best_games(events, games, k, share)
        want = {(r.user_id, r["rank"]): (r.appid, round(r.score, 9)) for r in K.topk_per_group(full, ["user_id"], [F.desc("score"), F.col("appid")], k).collect()}
        assert {(r.user_id, r["rank"]): (r.appid, round(r.score, 9)) for r in got.best.collect()} == want and want
        assert all(r.n_first <= groups and r.n_looked_up <= groups for r in got.made.collect())


def test_best_games_by_parts_and_blocks(spark, monkeypatch):
    """Many ties, few groups with many games and many with one, users that clicked the best: any dealing gives the full
    table's rows. No pair of a user and a group is written."""
    draw, words = random.Random(5), "red blue ring gear".split()
    name = lambda: " ".join(draw.sample(words, 2))
    games = spark.createDataFrame([(a, n, f"{n} z", draw.sample("abcdefgh", draw.randrange(4)) + ["all"] * (a % 2)) for a in range(240) for n in [name()]], "appid bigint, name string, context string, tags array<string>")
    actions = [(u, "search", None, draw.choice([*words, "red ring", " ", "none"])) if draw.random() < 0.4 else (u, "click", draw.randrange(250), None) for u in range(60) for _ in range(draw.randrange(1, 14))]
    events = spark.createDataFrame([(n, u, n % 50, kind, a, q) for n, (u, kind, a, q) in enumerate(actions)], "event_id bigint, user_id bigint, ts int, type string, appid bigint, query string")
    full = B.preference_scores(events, games).withColumn("score", F.round("score", 12)).cache()
    written, stored = {}, B.stored

    def counted(df, tag):
        out = stored(df, tag)
        written[tag] = max(written.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(B, "stored", counted)
    for k, share, part, block in ((20, 0.4, 16, 25), (3, 0.9, 4096, 5)):
        got = B.best_games(events, games, k, share, part, block)
        want = {(r.user_id, r["rank"], r.appid, round(r.score, 9)) for r in K.topk_per_group(full, ["user_id"], [F.desc("score"), F.col("appid")], k).collect()}
        assert {(r.user_id, r["rank"], r.appid, round(r.score, 9)) for r in got.best.collect()} == want and want
        blocks = -(-written["game-groups"] // block)
        assert written.pop("block-best") <= 60 * blocks and max(written.values()) <= max(len(actions), 240) < full.count() / 4


def test_listed_games_are_those_that_were_not_clicked(spark, monkeypatch):
    """A group in lists of about two games, users that clicked some, all or none of it; scores are rounded as they are summed."""
    monkeypatch.setattr(B, "LISTED", 2)
    games = spark.createDataFrame([(a, "n", "n", ["x"] if a < 9 else ["x", "y"]) for a in range(11)], "appid bigint, name string, context string, tags array<string>")
    clicks = {1: [0, 3], 2: [9, 10], 3: list(range(9)), 4: [77]}
    events = spark.createDataFrame([(u * 100 + n, u, n, "click", a, None) for u, of in clicks.items() for n, a in enumerate(of)], "event_id bigint, user_id bigint, ts int, type string, appid bigint, query string")
    got = [tuple(r) for r in B.preference_scores(events, games).collect()]
    x = {u: sum(0.15 * 0.7**n for n in range(len(of))) for u, of in clicks.items()}
    want = {(u, a): 0.5 + x[u] * (2 if u == 2 and a > 8 else 1) for u in (1, 2, 3) for a in range(11) if a not in clicks[u]}
    assert sorted(got) == [(u, a, round(s, 12)) for (u, a), s in sorted(want.items())]


def test_preferences_add_up_game_by_game(spark, sf):
    """The full table again in plain Python for some users."""
    games = {r.p_partkey: (r.p_name.lower(), f"{r.p_name} {r.p_brand}".lower(), {r.p_brand, r.p_type}) for r in view(spark, sf, "part").collect()}
    frame = view(spark, sf, "part").select(F.col("p_partkey").alias("appid"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand").alias("context"), F.array("p_brand", "p_type").alias("tags"))
    events = view(spark, sf, "interactions").filter("user_id % 5 = 0")
    got: dict = {}
    for r in B.preference_scores(events, frame).collect():
        got.setdefault(r.user_id, {})[r.appid] = round(r.score, 9)
    by_user: dict = {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id), reverse=True):
        by_user.setdefault(r.user_id, []).append(r)
    for user, rows in by_user.items():
        scores: dict = {}
        rows = rows[:10]
        for place, r in enumerate(rows):
            for appid, (name, context, tags) in games.items():
                if r.type == "search" and r.query:
                    q = r.query.lower().strip()
                    s = 0.35 if q in name or any(p in w for p in q.split() for w in "".join(c if c.isalnum() else " " for c in context).split()) else 0
                else:
                    s = 0.15 * len(tags & games[r.appid][2]) if r.appid in games else 0
                if s:
                    scores[appid] = scores.get(appid, 0.5) + s * 0.7**place
        gone = {r.appid for r in rows if r.type == "click"}
        assert got.get(user, {}) == pytest.approx({a: s for a, s in scores.items() if a not in gone}, abs=2e-9)
