"""Operator 7, language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is parsed greedily into
the longest phrases that occur in that sample; phrases x log2(sample size) / symbols estimates the cross entropy, and the
language with the least wins. The automaton, completed with its restarts, is a plain transition table, so a batch of
texts is parsed in lockstep: one table look-up moves every text and every language on by one symbol.

Bound of the sample, the only thing learnt from: ROWS_PER_LANG labelled rows of a language, the smallest by hash of the
id, CHARS_PER_ROW characters of each, SYMBOLS_PER_LANG symbols in all. It does not grow with the corpus; every text is
parsed whole.

Defined cases: a null text, or one without a letter, is 'und' with score 0; ties go to the first language by name;
without labelled rows every text is 'und'; repeated rows are separate; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

ROWS_PER_LANG, CHARS_PER_ROW, SYMBOLS_PER_LANG = 96, 600, 24_000
UNDETERMINED = "und"
SPACE, OTHER = 0, 1  #: the symbols of non-letters (a run is one) and of letters that no sample has


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def symbols(texts: list[str], code_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts in one array, where each text starts (and the end), and whether each has a letter."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, low)])
    codes = code_of[points]
    starts = np.zeros(len(codes), dtype=bool)
    starts[ends[:-1][ends[:-1] < len(codes)]] = True
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE) | starts[1:]
    at = np.concatenate([[0], np.cumsum(keep)])[ends]
    letters = np.concatenate([[0], np.cumsum(codes != SPACE)])[ends]
    return codes[keep], at, np.diff(letters) > 0


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of codes; state 0 is its root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


class CrossParser:
    """samples: text by language. Built once in each Python worker from the samples, which are all that is sent."""

    def __init__(self, samples: tuple[tuple[str, str], ...], limit: int = SYMBOLS_PER_LANG):
        self.langs = [lang for lang, _ in samples]
        seen = sorted({c for _, text in samples for c in text.lower() if c.isalpha()})
        self.code_of = np.where(_letters(), OTHER, SPACE).astype(np.int32)
        for k, c in enumerate(seen):
            self.code_of[ord(c)] = 2 + k
        self.width = width = 2 + len(seen)
        tables, self.roots, self.bits, base = [], [], [], 0
        for _, text in samples:
            codes = symbols([text], self.code_of)[0][:limit]
            go = suffix_automaton(codes.tolist())
            root = np.full(width, len(go), dtype=np.int64)  # a symbol that the sample lacks is a phrase of its own: one more state
            root[list(go[0])] = list(go[0].values())
            table = np.tile((base + root) * width * 2 + 1, (len(go) + 1, 1))  # a break, then on from the root
            table[0] -= 1
            for s, out in enumerate(go):
                if out:
                    table[s, list(out)] = (base + np.fromiter(out.values(), dtype=np.int64)) * width * 2
            tables.append(table)
            self.roots.append(base * width)
            self.bits.append(np.log2(max(2, len(codes))))
            base += len(go) + 1
        self.table = np.concatenate([np.zeros((0, width), dtype=np.int64), *tables]).ravel().astype(np.int32 if base * width * 2 < 2**31 else np.int64)

    def breaks(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(languages, texts): where the greedy parse had to begin a new phrase. Texts of like length move in lockstep."""
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(self.langs), len(size)), dtype=np.int64)
        roots = np.array(self.roots, dtype=self.table.dtype)[:, None]
        first = 0
        while first < len(order) and size[order[first]]:
            top = size[order[first]]
            last = first + max(1, min(len(order) - first, 4_000_000 // int(top), 512))
            some = order[first:last]
            lanes = np.zeros((top, len(some)), dtype=self.table.dtype)
            for k, i in enumerate(some):
                lanes[: size[i], k] = codes[at[i] : at[i + 1]]
            active = np.searchsorted(-size[some], -np.arange(1, top + 1), side="right").tolist()
            state, count = np.repeat(roots, len(some), axis=1), np.zeros((len(self.langs), len(some)), dtype=np.int64)
            n, s, c = -1, state, count
            for t in range(top):
                if active[t] != n:
                    n = active[t]
                    state[:, : s.shape[1]], count[:, : c.shape[1]] = s, c
                    s, c = state[:, :n].copy(), count[:, :n].copy()
                v = self.table.take(s + lanes[t, :n])
                c += v & 1
                s = v >> 1
            count[:, : c.shape[1]] = c
            out[:, some] = count
            first = last
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, at, has = symbols([t or "" for t in texts], self.code_of)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        size = np.maximum(1, np.diff(at))
        bits = (self.breaks(codes, at) + 1) * np.array(self.bits)[:, None] / size
        best = bits.argmin(axis=0)
        two = np.sort(bits, axis=0)
        score = 1 - two[0] / two[1] if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], np.where(has, np.clip(score, 0, 1), 0.0)


@lru_cache(2)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(samples)


def training_samples(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANG, chars: int = CHARS_PER_ROW) -> tuple[tuple[str, str], ...]:
    """At most rows x chars characters of each language come to the driver."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    few = (
        labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, chars).alias("text"))
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows)
    )
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in few.select("lang", "n", "text").collect():
        by_lang.setdefault(r.lang, []).append((r.n, r.text))
    return tuple((lang, "\n".join(t for _, t in sorted(by_lang[lang]))) for lang in sorted(by_lang))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text", chunk_chars: int = 2_000_000) -> DataFrame:
    """docs with lang_pred string and score double; all other columns pass through."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in batches:
            first, texts = 0, batch.column(names.index(text_col))
            size = np.array([len(t) if t else 0 for t in texts.to_pylist()])
            total = np.cumsum(size)
            while first < len(size):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + chunk_chars, side="right")))
                part = batch.slice(first, last - first)
                lang, score = parser.predict(part.column(names.index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])
                first = last

    return docs.mapInArrow(run, docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    samples = training_samples(docs.filter(~is_held_out()))
    out = identify(docs.select("doc_id", "text"), samples)
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
