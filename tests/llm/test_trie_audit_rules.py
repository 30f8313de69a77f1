"""Operators 11 to 13 against brute force, SQL, enumeration and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gamelode.llm import prefix_trie, quality_rules, source_audit
from gamelode.llm.common import read
from tests.compare import difference, duck

# --- operator 11


def slow_trie(rows):
    """rows: conv_id, turn, role, text with turns that differ. The nodes as the contract states them."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(x, key=lambda r: r[:2])] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        made = tuple(own.get(int(c / 20) * 20, [])[:h] + own[c][h:])  # the sign of % is that of SQL
        for d in range(len(made) + 1):
            members[made[:d]].append(c)
        ends[made].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    return sorted(
        (m[0], len(k), members[k[:-1]][0] if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()
    )


def trie_of(spark, rows, **how):
    df = spark.createDataFrame([(*r, "p", 7) for r in rows], "conv_id bigint, turn int, role string, text string, parent_id string, depth int")
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.prefix_trie(df, **how).collect())


def test_trie_is_that_of_brute_force(spark):
    """Shared heads, many copies over several tasks, one long conversation, an ancestor that ends within another, nulls, empty
    texts, negative ids, turnless conversations, and columns with the operator's own names."""
    draw = random.Random(3)
    rows = []
    for c in range(-30, 130):
        for t in range(draw.choice([1, 1, 2, 3, 5])):
            rows.append((c, t if t or c % 3 else None, draw.choice(["user", None, "a"]), f"word {draw.randrange(3)}  x" if c % 4 else draw.choice(["", None, "x"])))
    for c in range(200, 420):
        rows += [(c, t, "user", f"same text {t}") for t in range(3)]
    rows += [(500, t, "user", f"long {t}") for t in range(400)] + [(501, t, "user", f"long {t}") for t in range(350)] + [(None, 0, "user", "nobody")]
    want = slow_trie(rows)
    assert trie_of(spark, rows) == want
    assert trie_of(spark, rows, turns_in_task=40) == want  # some forty tasks: most nodes are on a seam


def test_trie_of_nothing_and_of_one(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(7, 1, None, None)]) == slow_trie([(7, 1, None, None)])


def test_trie_as_sql(spark, sf):
    got = prefix_trie.op11_prefix_trie(spark, sf).toPandas()
    assert difference(got, duck(sf).execute(prefix_trie.ORACLE).fetchdf()) == ""


def test_tree_layouts_grow_and_paths_are_split():
    draw = random.Random(1)
    keys = sorted({bytes(draw.choice([0, 1, draw.randrange(256)]) for _ in range(16 * draw.randrange(0, 4))) for _ in range(3000)})
    root = prefix_trie.Node(b"", 0)
    for k, key in enumerate(keys):
        prefix_trie.insert(root, key, k, k)
    found, layouts, stack = {}, set(), [(root, b"")]
    while stack:
        node, key = stack.pop()
        layouts.add(node.places)
        found |= {key: node.ends} if node.ends else {}
        kids = node.in_order()
        assert [k.path[0] for k in kids] == sorted(k.path[0] for k in kids) and len(kids) <= node.places
        assert node is root or node.ends or len(kids) > 1  # else the path would be one
        stack += [(k, key + k.path) for k in kids]
    assert found == {key: [k] for k, key in enumerate(keys)} and layouts == {4, 16, 48, 256}


# --- operator 12


def slow_audit(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        within = Counter(t for *_, a in mine for t in set(a))
        kept = sorted(t for t, n in within.items() if n >= 3)
        v = len(kept)

        def shares(some, kept=kept, v=v):
            n = Counter(t for *_, a in some for t in a)
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + v) for t in kept}, n

        q, _ = shares(mine)
        of = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (p, n) in of.items():
            pairs = [(sum((p[t] - of[o][0][t]) ** 2 // of[o][0][t] for t in kept), o) for o in of if o != s]
            terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if n[t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audited(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, value int, item string")
    return sorted(tuple(r) for r in source_audit.audit(df, **how).collect())


def test_audit_is_that_of_brute_force(spark):
    """Nulls, empty texts, a language without kept terms, a group without terms, ties, frequent and rare terms, repeated rows."""
    draw = random.Random(5)
    words = [f"{w}{u}" for w in "abcdefghijklmnopqrstuvwxyz" for u in ("", "é", "漢", "\U0001f600", "zz", "qx", "Ab", "mn", "op", "rs", "tu")]
    rows = [("en", f"s{draw.randrange(6)}", " ".join(words[min(int(draw.expovariate(0.03)), len(words) - 1)] for _ in range(draw.randrange(120)))) for _ in range(300)]
    rows += [("en", "s0", "the_the the-the THE0the " * 500)] * 3 + [("en", None, None), ("en", "empty", "1234 !!"), (None, None, "x y"), ("xx", "a", "once"), ("xx", "b", ""), ("xx", "c", None)]
    assert audited(spark, rows) == slow_audit(rows)


def test_audit_of_a_few_terms_at_a_time(spark, monkeypatch):
    """Blocks of one term, sums given out block by block, and cells in strips."""
    draw = random.Random(6)
    rows = [("en", f"s{k % 5}", " ".join(f"w{'abcdefgh'[draw.randrange(8)]}" for _ in range(30))) for k in range(60)]
    want = slow_audit(rows)
    for name, value in (("BLOCK", 1), ("FINE_BLOCK", 1), ("HELD_GROUPS", 1), ("CELLS_AT_A_TIME", 1), ("HELD_TERMS", 3), ("SMALL_ROWS", 0)):
        monkeypatch.setattr(source_audit, name, value)
    assert audited(spark, rows) == want


def test_audit_of_nothing(spark):
    assert audited(spark, []) == []


def test_audit_as_sql(spark, sf):
    got = source_audit.op12_source_audit(spark, sf).toPandas()
    assert difference(got, duck(sf).execute(source_audit.ORACLE).fetchdf()) == ""


def test_shares_of_huge_counts():
    count, total = np.array([0, 5, 10**14]), np.array([10**15] * 3)
    assert source_audit._shares(count, total, 7).tolist() == [1 + 10**9 * (int(c) + 1) // (10**15 + 7) for c in count]


# --- operator 13


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    again = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def test_counts_are_those_of_brute_force(spark, sf, odd_docs, no_docs):
    draw = random.Random(9)
    texts = ["".join(draw.choice(["a", "b", " ", "\n", "é", "\t", "#", " ", "\x0b", "\U0001f600", "|", "."]) for _ in range(draw.randrange(300))) for _ in range(300)]
    texts += [None, "", " ", "\n\n", "a b c d e " * 9, "one line\none line\n one line\none line\n", "x" * 10, "a b c d a b c d e f g h i j k l"]
    made = spark.createDataFrame([(k, t, "k") for k, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    for docs in (made, odd_docs.select("doc_id", "text"), read(spark, sf, "documents").select("doc_id", "text")):
        got = sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:7]) for r in quality_rules.judge(docs).collect())
        assert got == sorted(((r.doc_id is None, r.doc_id or 0), slow_counts(r.text)) for r in docs.collect())
    assert quality_rules.judge(no_docs).count() == 0


def test_counts_do_not_depend_on_how_texts_are_cut(monkeypatch, spark, sf):
    docs = read(spark, sf, "documents")
    want = sorted(quality_rules.judge(docs).collect())
    monkeypatch.setattr(quality_rules, "BYTES_AT_A_TIME", 1)
    assert sorted(quality_rules.judge(docs).collect()) == want


def test_decoding_finds_the_best_of_all_labellings():
    draw = np.random.default_rng(4)
    texts = [b"plain words in a line here.\n### $$$ ***\n\nA | B | C\nSHOUT!! SHOUT!!\nwords words words words", b"", b"one", b"x\ny\nz 1 2 3\n" * 2]
    lines = quality_rules.Lines(texts)
    for _ in range(20):
        field = quality_rules.Field(draw.normal(size=quality_rules.N_FEATURES), draw.normal(size=(2, 2)), draw.normal(size=2))
        got, e = field.decode(lines), field.for_content(lines.features)
        for t in range(len(texts)):
            at = np.flatnonzero(lines.text == t)
            score = lambda y, at=at, e=e, field=field: field.start[y[0]] + sum(e[k] * b for k, b in zip(at, y, strict=True)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))
            if len(at):
                assert score(got[at].astype(int).tolist()) == pytest.approx(max(score(y) for y in product((0, 1), repeat=len(at))))


def test_the_gradient_is_that_of_the_likelihood():
    """After many rounds no small change of any parameter raises the penalised likelihood, summed over all labellings."""
    draw = np.random.default_rng(2)
    texts = [np.stack([quality_rules.OFFSETS[k] + draw.integers(0, len(s) + 1, 4) for k, s in enumerate(quality_rules.STEPS.values())], axis=1) for _ in range(6)]
    labels = [draw.integers(0, 2, 4) for _ in texts]
    field = quality_rules.fit(texts, labels, rounds=1500)

    def value(w, moves, start):
        out = 0.0
        for x, y in zip(texts, labels, strict=True):
            e = w[x].sum(axis=1)
            all_of = [start[z[0]] + sum(e[k] * b for k, b in enumerate(z)) + sum(moves[a, b] for a, b in zip(z, z[1:], strict=False)) for z in product((0, 1), repeat=len(x))]
            z = y.tolist()
            out += start[z[0]] + sum(e[k] * b for k, b in enumerate(z)) + sum(moves[a, b] for a, b in zip(z, z[1:], strict=False)) - np.logaddexp.reduce(all_of)
        return out / len(texts) - quality_rules.PENALTY / 2 * sum((p**2).sum() for p in (w, moves, start))

    best = value(field.weights, field.moves, field.start)
    for name in ("weights", "moves", "start"):
        p = getattr(field, name)
        for k in np.ndindex(p.shape):
            for d in (0.05, -0.05):
                p[k] += d
                assert value(field.weights, field.moves, field.start) <= best + 1e-6
                p[k] -= d


def test_good_texts_stay_and_bad_ones_go(spark):
    """Held-out labels of the larger table: all good texts of ten words or more stay, nine of ten bad ones go."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    field = quality_rules.train(docs, labels.filter(~held))
    found = quality_rules.judge(docs.join(labels.filter(held).select("doc_id"), "doc_id", "left_semi"), field).join(labels, "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_without_labels_every_line_is_content(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id bigint, quality int, toxic int")
    assert quality_rules.train(odd_docs, labels) is quality_rules.NEUTRAL and quality_rules.train(no_docs, labels) is quality_rules.NEUTRAL
    assert quality_rules.judge(odd_docs).filter("content_share < 1").count() == 0
