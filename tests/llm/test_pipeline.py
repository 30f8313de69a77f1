from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from gamelode.llm import minhash_dedup, sentencepiece_codec
from gamelode.llm.common import read
from tests.llm.test_dedup import brute_components
from tests.llm.test_text import leaks


def test_each_stage_on_its_input(spark, sf):
    docs = read(spark, sf, "documents")
    known = P.stored(P.keep_known_languages(spark, docs, sf), "t")
    assert known.columns == list(P.COLUMNS) and known.count() >= 0.98 * docs.count()
    lines = P.stored(P.drop_boilerplate(spark, known, sf), "t")
    assert lines.columns == list(P.COLUMNS) and lines.count() == known.count()
    near = P.stored(P.keep_one_of_near_duplicates(spark, lines, sf), "t")
    groups = minhash_dedup.near_duplicates(lines, words=5).select("component_id").distinct().count()
    assert near.columns == list(P.COLUMNS) and near.count() == groups
    clean = P.stored(P.drop_contaminated(spark, near, sf), "t")
    passages = [r.text for r in read(spark, sf, "benchmark").collect()]
    assert not any(p in r.text for r in clean.collect() for p in passages) and clean.count() > 0.8 * near.count()
    out = P.encode_pieces(spark, clean, sf)
    assert out.count() == clean.count() and out.filter("n_ids <> size(ids)").count() == 0


def without_boilerplate(docs: dict[int, tuple[str | None, str | None]]) -> dict[int, str | None]:
    """doc_id -> (text, source): the texts without lines that more than a tenth of a source's pages hold."""
    pages = Counter(s or "" for _, s in docs.values())
    having = Counter((s or "", line) for t, s in docs.values() for line in set((t or "").split("\n")) if t is not None and line.strip(" "))
    bad = {(s, line) for (s, line), n in having.items() if pages[s] >= 10 and n > 0.1 * pages[s]}
    return {k: t if t is None else "\n".join(line for line in t.split("\n") if (s or "", line) not in bad) for k, (t, s) in docs.items()}


def test_run_is_what_plain_python_makes(spark, sf):
    """All five stages again without the operators' methods."""
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = {r.doc_id: (r.text, r.source) for r in read(spark, sf, "documents").collect() if any(map(str.isalpha, r.text or ""))}
    texts = without_boilerplate(docs)
    kept = {k: texts[k] for k, (_, c) in brute_components(texts, 5).items() if c == k}
    passages = {r.item_id: r.text for r in read(spark, sf, "benchmark").collect()}
    dirty = {k for k, _ in leaks(kept, passages)}
    codec = sentencepiece_codec.codec(sentencepiece_codec.MODEL)
    want = {k: codec.encode(t).tolist() if t else [] for k, t in kept.items() if k not in dirty}
    assert {r.doc_id: list(r.ids or []) for r in P.run(spark, sf).collect()} == want and dirty and len(kept) < len(docs)


def test_first_stage_drops_only_texts_without_a_letter(spark, tmp_path):
    texts = ["one", "rose", "def f(x): return x", "漢字", "Anna Meier", "12 34", None, "", "the same words of all samples"] * 4
    for name, langs in (("tie", ("en", "fr")), ("none", (None, None)), ("und", ("und", "und"))):
        rows = [(k, t, langs[k % 2], "a", len(t or "")) for k, t in enumerate(texts)]
        path = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        docs.write.parquet(f"{path}/documents.parquet")
        assert sorted(r.doc_id for r in P.keep_known_languages(spark, docs, path).collect()) == [k for k, t in enumerate(texts) if any(map(str.isalpha, t or ""))]
