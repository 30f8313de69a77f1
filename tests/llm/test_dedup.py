from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from gamelode.llm import exact_dedup, line_dedup, minhash_dedup, registry, suffix_dedup
from gamelode.llm.common import read
from gamelode.llm.components import connected_components
from tests.compare import difference, duck


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    assert difference(got, duck(sf).execute(registry.oracle_sql()[name]).fetchdf()) == ""


def test_exact_odd_rows(spark, odd_docs, no_docs):
    rows = exact_dedup.exact_dedup(odd_docs, exact_dedup.DigestIndex(spark)).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].keep_id == 2 and not by[1].kept and by[2].kept and by[2].group_size == 2
    assert by[3].keep_id == 4 and by[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(r.kept for r in rows if r.doc_id == 8) == 2
    assert by[None].keep_id is None and not by[None].kept
    assert exact_dedup.exact_dedup(no_docs, exact_dedup.DigestIndex(spark)).count() == 0


def test_exact_index_takes_only_what_is_new(spark):
    index = exact_dedup.DigestIndex(spark)
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    two = spark.createDataFrame([(7, "b"), (8, "c")], "doc_id bigint, text string")
    exact_dedup.exact_dedup(one, index).collect()
    kept = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(two, index).collect()}
    assert kept == {7: (2, False), 8: (8, True)} and index.rows().count() == 3


def test_exact_index_is_opened_again_by_its_folder(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "doc_id bigint, text string")
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.exact_dedup(df((1, "a"), (2, "b"), (None, "n")), index).collect()
    index.close()
    again = exact_dedup.DigestIndex(spark, path=index.path)
    assert again.buckets == 4 and again.rows().count() == 3
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df((7, "b"), (8, "c"), (9, "n")), again).collect()}
    assert got == {7: (2, 1, False), 8: (8, 1, True), 9: (None, 1, False)}
    exact_dedup.exact_dedup(df(*((100 + k, f"x{k}") for k in range(30))), again).collect()
    before = len(again.rows().inputFiles())
    again.compact()
    assert again.rows().count() == 34 and len(again.rows().inputFiles()) == 4 < before
    again.close()
    third = exact_dedup.DigestIndex(spark, path=index.path)
    plan = exact_dedup.with_digest(df((1, "a"))).hint("merge").join(third.rows().select("text_sha256", "keep_id"), "text_sha256", "left")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.keep_id for r in plan.collect()} == {1}


def test_exact_anti_join_reads_the_index_without_a_shuffle(spark):
    index = exact_dedup.DigestIndex(spark)
    df = spark.range(50).selectExpr("id as doc_id", "cast(id as string) as text")
    index.append(exact_dedup.with_digest(df))
    fresh = exact_dedup.with_digest(df).groupBy("text_sha256").count().hint("merge").join(spark.table(index.name).select("text_sha256"), "text_sha256", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_line_odd_rows(spark, odd_docs, no_docs):
    out = line_dedup.line_dedup(odd_docs)
    assert out.count() == odd_docs.count() and line_dedup.line_dedup(no_docs).count() == 0
    assert {r.doc_id: r.text for r in out.filter("doc_id in (3, 4, 5)").collect()} == {3: None, 4: "", 5: "   \n\t "}
    assert set(odd_docs.columns) == set(out.columns) - {"n_dropped"} and {r._host for r in out.collect()} == {"h"}


def test_line_drops_by_host_only(spark):
    rows = [(k, f"menu\nown line {k}\n\nlast {k}", "h1" if k < 20 else "h2") for k in range(40)] + [(99, "menu", "h3")]
    rows = [(k, t.replace("menu", "menu" if h != "h2" or k == 20 else f"m{k}"), h) for k, t, h in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out, salted = ({r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df, broadcast_lines=n).collect()} for n in (100, 0))
    assert out == salted and out[0] == ("own line 0\n\nlast 0", 4, 1) and out[20][0].startswith("menu\n") and out[99] == ("menu", 1, 0)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_components(texts: dict[int, str | None], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations([i for i in sets if sets[i]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, sf, words):
    docs = read(spark, sf, "documents")
    want = brute_components({r.doc_id: r.text for r in docs.collect()}, words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, words=words).collect()}
    assert got == want


def test_near_group_with_a_middle_and_a_chain(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]

    def edit(words, n):
        out = list(words)
        for p in r.sample(range(len(out)), n):
            out[p] = f"e{r.randrange(10**9)}"
        return out

    texts = {k: " ".join(edit(base, r.choice((1, 3, 5, 6, 9, 14)))) for k in range(150)} | {500: " ".join(base)}
    chain = [f"c{k}" for k in range(60)]
    for k in range(30):
        chain = edit(chain, 2)
        texts[1000 + k] = " ".join(chain)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_components(texts, 2)
    for many in (4.0, 0.0):  # with and without trial rounds
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.near_duplicates(df, words=2, many=many).collect()}
        assert got == want


def test_near_strays_in_the_buckets_of_a_large_group(spark):
    """Links that only the rare shingles find."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    texts = {}
    for k in range(220):
        words = list(base)
        for p in r.sample(range(90), r.choice((2, 4, 7, 10))):
            words[p] = f"x{r.randrange(40)}"
        texts[k] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_components(texts, 2)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.near_duplicates(df, words=2).collect()}
    assert got == want
    two = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, "d e f"), (3, "a b c")], "doc_id bigint, text string")
    assert {(x.doc_id, x.component_id) for x in minhash_dedup.near_duplicates(two, words=2).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_shingles_of_near_copies_are_named_once(spark):
    """However many files the copies lie in, there is a row for each shingle and not one for each shingle and file."""
    texts = {k: " ".join(f"w{j}" if j != k % 80 else f"x{k}" for j in range(80)) for k in range(300)}
    sets = minhash_dedup.full_sets(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(50), 2)
    rows = minhash_dedup.shared_shingles(sets).collect()
    having = Counter(s for t in texts.values() for s in set(zip(t.split(), t.split()[1:], strict=False)))
    assert sorted(r.n for r in rows) == sorted(having.values()) and all((r.nodes is None) == (r.n > minhash_dedup.RARE) for r in rows)
    assert all(len(r.nodes) == r.n for r in rows if r.nodes is not None)


def test_near_odd_rows(odd_docs, no_docs):
    rows = minhash_dedup.near_duplicates(odd_docs, words=2).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and by[2].component_id == 1 and by[7].component_id == 6
    assert (by[3].n_shingles, by[3].component_id, by[3].kept) == (0, 3, True) and by[8].n_shingles == 1
    assert by[None].component_id is not None or by[None].kept
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def test_registers_estimate_similarity():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(2))
    sets = [np.unique(a), np.unique(np.concatenate([a[:300], b[:100]])), np.unique(a[:3]), np.zeros(0, dtype=np.uint64)]
    sig = minhash_dedup.superminhash(sets, 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1 and np.isfinite(sig[2]).all() and np.isinf(sig[3]).all()
    alone = np.concatenate([minhash_dedup.superminhash([s], 256) for s in sets])
    assert (alone == sig).all()


def test_components(spark):
    links = [(k + 1, k) for k in range(100, 140)] + [(7, 3), (9, 7), (3, 12), (50, 51), (51, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(101, 141)} | {7: 3, 9: 3, 12: 3, 51: 50}


def test_suffix_on_all_documents(spark, sf):
    docs = read(spark, sf, "documents")
    want = suffix_dedup.brute_force({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op9_suffix_dedup(spark, sf).collect()}
    assert got == want


def test_suffix_small_cases(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared, edge = text(300), text(60)
    texts = {1: text(100) + shared + text(80), 2: shared, 3: text(40) + shared[:49] + text(40), 4: edge + text(30) + shared[10:200] + edge, 5: edge + edge, 6: "a" * 400, 7: "b" + "a" * 120, 8: None, 9: "", 10: text(49), 11: shared[100:150]}
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    want = suffix_dedup.brute_force(texts)
    assert {x.doc_id: (x.n_bytes, x.n_removed, len(x.removed), hashlib.sha256(x.kept).hexdigest()) for x in got} == want


def test_suffix_frequent_triggers_and_pieces(spark, monkeypatch):
    """A passage in all documents between texts of their own, by both ways of grouping and with texts read in pieces; chunks
    in which nothing repeats."""
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdefgh ij") for _ in range(n))
    shared = text(130)
    texts = {k: text(r.randint(0, 90)) + shared + text(r.randint(0, 90)) for k in range(60)} | {90: "a" * 500, 91: "b" + "a" * 77, 92: text(400), 93: shared[:52] + shared[40:]}
    want = suffix_dedup.brute_force(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(2)

    def got(**options):
        return {x.doc_id: (x.n_bytes, x.n_removed, len(x.removed), hashlib.sha256(x.kept).hexdigest()) for x in suffix_dedup.remove_repeats(df, **options).collect()}

    assert got() == want and got(hot=2) == want
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 64)
    assert len(list(suffix_dedup._chunks(df.toArrow().to_batches()[0]))) > 60
    unique = {k: text(300) for k in range(5)}
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(list(unique.items()), "doc_id bigint, text string")).collect()
    assert all(x.n_removed == 0 and bytes(x.kept).decode() == unique[x.doc_id] for x in rows)


def test_suffix_array_is_that_of_the_bytes():
    r = random.Random(2)
    for alphabet in (b"a", b"ab", bytes(range(256))):
        buf = np.frombuffer(bytes(r.choice(alphabet) for _ in range(300)), dtype=np.uint8)
        raw, at = buf.tobytes(), np.arange(251)
        order, group = suffix_dedup.suffix_array(buf, at, 50)
        found = [raw[k : k + 50] for k in order.tolist()]
        assert found == sorted(raw[k : k + 50] for k in range(251))
        assert all((a == b) == (x == y) for a, b, x, y in zip(found, found[1:], group.tolist(), group.tolist()[1:], strict=False))


def test_suffix_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd_docs).collect()}
    assert rows[7].n_removed == rows[7].n_bytes and rows[6].n_removed == 0 and rows[None].n_removed == 0 and rows[3].n_bytes == 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
