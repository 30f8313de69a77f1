"""Sentences and prompts made of a row's fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gamelode.functions.text import C, _c

# A genre word, and what its games feel like, in the order in which they are looked for.
GENRE_MOODS = (
    ("horror", "공포 분위기"),
    ("rpg", "캐릭터 성장과 서사"),
    ("simulation", "현실감 있는 시뮬레이션 경험"),
    ("strategy", "치밀한 전략적 사고가 필요한 플레이"),
    ("puzzle", "차근차근 풀어가는 퍼즐 경험"),
    ("action", "긴장감 있는 액션 플레이"),
    ("adventure", "탐험하며 이야기를 즐기는 어드벤처"),
    ("indie", "개성 있는 인디 게임 특유의 매력"),
)
PLAYED_TOGETHER = ("Multi-player", "Co-op", "Online Co-op", "Local Co-op", "Cross-Platform Multiplayer", "PvP")
TOGETHER, ALONE = "다른 유저와 함께하는 멀티플레이 경험", "혼자서 편하게 즐기는 플레이"
WON_PER_USD = 1300


def _text(c: Column) -> Column:
    return c.cast("string")


def format_note(max_price_usd: C, free_only: C, min_players: C) -> Column:
    """A constraint in a few words: its price limit, rounded to 5,000 won, and its number of players."""
    usd, players = _c(max_price_usd), _c(min_players)
    won = (F.bround(F.floor(usd * WON_PER_USD).cast("double") / 5000.0, 0) * 5000).cast("bigint")
    man, cheon = F.floor(won / 10000), F.floor(F.pmod(won, F.lit(10000)) / 1000)
    large = F.concat(F.lit("가격 "), _text(man), F.lit("만"), F.when(cheon > 0, F.concat(F.lit(" "), _text(cheon), F.lit("천"))).otherwise(""), F.lit("원 이하"))
    price = F.when(usd == 0, "무료").when(won >= 10000, large).when(usd.isNotNull(), F.concat(F.lit("가격 "), _text(won), F.lit("원 이하"))).when(_c(free_only), "무료")
    note = F.concat_ws(" / ", price, F.when(players.isNotNull(), F.concat(_text(players), F.lit("인 이상"))))
    return F.coalesce(F.nullif(note, F.lit("")), F.lit("조건에 맞는 게임 없음"))


def _closed(word: str) -> bool:
    """Whether the last character is a Hangul syllable with a final consonant, as final_consonant() of a fixed word."""
    code = ord(word[-1]) - 0xAC00
    return 0 <= code <= 11171 and code % 28 != 0


def _bound(values: dict[str, Column], f) -> Column:
    """f of the values, each made once for a row, however often f names it."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), f), F.lit(0))


def build_reason(is_free: C, price_usd: C, categories: C, genres: C, platforms: C, explanation: C | None = None) -> Column:
    """Why a game fits, in one Korean sentence: its price, whether it is played together, and the mood of its genre.
    categories, genres and platforms are arrays; an explanation that is there is taken as it is."""
    usd, all_genres = _c(price_usd), F.lower(F.array_join(_c(genres), "\n"))
    won = F.floor(usd * WON_PER_USD)
    man = F.floor(won / 10000)
    price = F.when(_c(is_free), "무료로 즐길 수 있으며").when(man > 0, F.concat(F.lit("약 "), _text(man), F.lit("만원대 가격이며"))).when(usd.isNotNull(), F.concat(F.lit("약 "), _text(won), F.lit("원대 가격이며")))
    known = F.size(F.filter(F.coalesce(_c(platforms), F.array().cast("array<string>")), lambda p: p != "")) > 0
    as_object = lambda w: w + ("을" if _closed(w) else "를")
    # all phrases are fixed, and so are their particles
    company = lambda c: F.when(F.arrays_overlap(c, F.array(*map(F.lit, PLAYED_TOGETHER))), TOGETHER).when(F.array_contains(c, "Single-player"), ALONE)
    with_and = lambda c: F.when(c == TOGETHER, f"{TOGETHER}{'과' if _closed(TOGETHER) else '와'} ").when(c == ALONE, f"{ALONE}{'과' if _closed(ALONE) else '와'} ")
    mood = F.lit(None).cast("string")
    for word, phrase in reversed(GENRE_MOODS):
        mood = F.when(F.contains(all_genres, F.lit(word)), as_object(phrase)).otherwise(mood)
    cats = F.coalesce(_c(categories), F.array().cast("array<string>"))
    end = F.lit(" 게임입니다.")

    def fit(x: Column) -> Column:
        alone = F.when(x["company"] == TOGETHER, as_object(TOGETHER)).when(x["company"] == ALONE, as_object(ALONE))
        return F.coalesce(F.concat(with_and(x["company"]), x["mood"]), alone, x["mood"])

    def body(x: Column) -> Column:
        experience = F.concat(x["fit"], F.lit(" 즐길 수 있는"), end)
        return F.coalesce(F.concat(x["price"], F.lit(" "), experience), F.concat(F.replace(x["price"], F.lit("있으며"), F.lit("있는")), end), experience, F.lit("추천 조건에 부합하는 게임입니다."))

    companied = _bound({"c": cats}, lambda x: company(x["c"]))
    fits = _bound({"company": companied, "mood": mood}, fit)
    made = F.concat(_bound({"price": price, "fit": fits}, body), F.when(known, " 다양한 플랫폼을 지원합니다.").otherwise(""))
    return made if explanation is None else F.coalesce(F.nullif(_c(explanation), F.lit("")), made)


def rule_reason(name: C, is_free: C, metacritic: C, price_cents: C, cheap: int = 100_000) -> Column:
    n, cents = _c(name), _c(price_cents)
    said = F.when(_c(is_free), " is free to play").when(F.coalesce(_c(metacritic), F.lit(0)) >= 80, " is acclaimed").when((cents > 0) & (cents <= cheap), " is good value").otherwise(" may suit you")
    return F.concat(n, said)


def prompt(genres: C, text: C, question: str = "Answer with JSON only.", limit: int = 2000, missing: str = "(정보 없음)") -> Column:
    """A request for a model: the genres, the first `limit` characters of the text, and what is asked for."""
    known = F.when(F.size(_c(genres)) == 0, missing).otherwise(F.array_join(_c(genres), ", "))
    return F.concat(F.lit("Genres: "), known, F.lit("\nText: "), F.substring(_c(text), 1, limit), F.lit(f"\n{question}"))


def repair_text(text: C, broken: Column, replacement: C) -> tuple[Column, Column]:
    """The text, or the replacement where it is broken; and whether it was."""
    return F.when(broken, _c(replacement)).otherwise(_c(text)), broken


def few_shot_prompt(text: C, examples: C, topics: dict[str, str], rules: tuple[str, ...] = (), task: str = "Sort the topics of the last review.", limit: int = 2000) -> Column:
    """A request with the topics and their definitions, rules, and the row's own labelled examples: an array of structs review,
    positive, negative (arrays of topics), in their order. Null or empty examples give a line that says so."""
    listed = "\n".join(f"- {name}: {says}" for name, says in topics.items())
    ruled = "\n".join(f"- {r}" for r in rules) or "- none"
    names = lambda a: F.to_json(F.coalesce(a, F.array().cast("array<string>")))
    block = lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\nReview: "), F.coalesce(e["review"], F.lit("")), F.lit("\npositive: "), names(e["positive"]), F.lit("\nnegative: "), names(e["negative"]))
    shown = F.when(F.size(_c(examples)) > 0, F.array_join(F.transform(_c(examples), block), "\n\n")).otherwise(F.lit("(no examples)"))
    head = f"{task}\n\nTopics: {', '.join(topics)}\n{listed}\n\nRules:\n{ruled}\n\n"
    return F.concat(F.lit(head), shown, F.lit("\n\nReview: "), F.substring(F.coalesce(_c(text), F.lit("")), 1, limit), F.lit('\nAnswer as {"positive": [], "negative": []}.'))
