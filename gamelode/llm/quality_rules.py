"""Operator 13, quality rules: counts that rule out a text, and a labelling of its lines by a conditional random field.

Counts come first: a text of fewer than MIN_WORDS words, or with more than MAX_REPEATED of its words in 5-word windows that it
holds twice or more, fails. Of the others, the lines with a word are one sequence; a linear-chain conditional random field
over what a line looks like (symbols, capitals, bars, digits, repeated words and lines, lengths, endings) marks each as
content or boilerplate by Viterbi decoding, and a text stays if MIN_CONTENT of its words or more stand in content lines.

The field is trained from labelled texts: SAMPLE of each quality at most, by hash of their id, of MAX_CHARS characters or
less, in sequences of LINES lines; that bounds what the driver gathers, which are numbers of features and never texts. Labels
are of texts, not lines: all lines of a good text are content, those of a bad one boilerplate at first; a second training
takes those lines of bad texts for content that the first one's features speak for. Everything else reads every text whole,
in Arrow batches cut to some megabytes; nothing is shuffled.

Defined cases: a null text has no words and fails; a text without words likewise; rows that repeat an id are judged each;
without labelled texts of both qualities every line is content; labels that contradict each other count as bad; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

MIN_WORDS, MAX_REPEATED, MIN_CONTENT, WINDOW = 10, 20, 0.5, 5  #: the second in percent
SAMPLE, MAX_CHARS, LINES = 800, 20_000, 64
BYTES_AT_A_TIME = 4 << 20
ROUNDS, RATE, PENALTY = 150, 0.1, 0.02

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL, _UPPER, _LOWER, _DIGIT, _SHOUT = _bytes(b"#*$%&|<>"), _bytes(bytes(range(65, 91))), _bytes(bytes(range(97, 123))), _bytes(b"0123456789"), _bytes(b"!?")
_END = _bytes(b".!?:;\"')")

#: steps of each of a line's measures; a measure's bin is the number of steps that it exceeds
STEPS: dict[str, list[float]] = {
    "symbols": [0, 0.05, 0.2, 0.6, 1.5], "shouts": [0.05, 0.2, 0.6], "capitals": [0.05, 0.15, 0.3, 0.6, 0.9], "digits": [0, 0.05, 0.2, 0.5],
    "same_as_before": [0, 0.05, 0.2, 0.5], "different": [0.2, 0.4, 0.6, 0.8, 0.95], "in_repeats": [0, 0.2, 0.5, 0.9], "seen_line": [0.5],
    "ends": [0.5], "words": [1, 3, 6, 12, 25, 60, 150], "word_length": [2, 3, 4, 5, 7, 10],
}
OFFSETS = np.cumsum([0, *(len(s) + 1 for s in STEPS.values())])
N_FEATURES = int(OFFSETS[-1])


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key comes twice or more."""
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[at] > 1


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def _runs(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each distinct run of bytes; runs are in order and do not overlap."""
    if not len(begins):
        return np.zeros(0, dtype=np.int64)
    edges = np.empty(2 * len(begins) + 1, dtype=np.int64)
    edges[:-1:2], edges[1::2], edges[-1] = begins, ends, ends[-1]
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(begins), [None, pa.py_buffer(edges), pa.py_buffer(buf)])
    return both.take(pa.array(np.arange(0, 2 * len(begins), 2))).dictionary_encode().indices.to_numpy().astype(np.int64)


class Lines:
    """Counts of some texts and measures of their lines that have a word."""

    def __init__(self, texts: list[bytes | None]):
        m = len(texts)
        buf = np.frombuffer(b"".join((t or b"") + b"\n" for t in texts), dtype=np.uint8)
        ends = np.cumsum([len(t or b"") + 1 for t in texts])  # of the texts, their added line end included
        white = _WHITE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
        word_begin, word_end = edge[0::2], edge[1::2]  # the last byte is white
        line_end = np.flatnonzero(buf == 10)
        line_begin = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else line_end
        line_text = np.searchsorted(ends, line_begin, side="right")
        word_line = np.searchsorted(line_end, word_begin)
        word_text = line_text[word_line]
        words = _runs(buf, word_begin, word_end)

        def in_lines(of: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(of)])
            return sums[line_end] - sums[line_begin]

        def in_texts(of_lines: np.ndarray) -> np.ndarray:
            return np.bincount(line_text, of_lines, minlength=m).astype(np.int64)

        n_words = np.bincount(word_line, minlength=len(line_end))
        chars = in_lines(~white & (buf & 0xC0 != 0x80))
        symbols = in_lines(_SYMBOL[buf])
        some = n_words > 0
        seen = np.zeros(len(line_end), dtype=bool)
        numbers = _runs(buf, line_begin[some], line_end[some])
        first = np.unique(line_text[some] * (len(numbers) + 1) + numbers, return_index=True)[1]
        again = np.ones(len(numbers), dtype=bool)
        again[first] = False
        seen[some] = again
        repeats = self._in_repeats(words, word_text)

        self.n_words, self.word_chars, self.n_symbols = in_texts(n_words), in_texts(chars), in_texts(symbols)
        self.n_dup_lines, self.n_repeat_words = in_texts(seen), np.bincount(word_text, repeats, minlength=m).astype(np.int64)
        self.failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEATED * self.n_words)
        # measures of the lines with a word
        n = n_words[some]
        upper, lower = in_lines(_UPPER[buf])[some], in_lines(_LOWER[buf])[some]
        same = np.zeros(len(words), dtype=bool)
        same[1:] = (words[1:] == words[:-1]) & (word_line[1:] == word_line[:-1])
        kinds = np.unique(word_line * (int(words.max(initial=0)) + 1) + words) // (int(words.max(initial=0)) + 1)
        per_line = lambda x: np.bincount(word_line, x, minlength=len(line_end))[some]
        last_word_end = word_end[np.cumsum(n_words)[some] - 1]
        measures = {
            "symbols": symbols[some] / n, "shouts": in_lines(_SHOUT[buf])[some] / n, "capitals": upper / np.maximum(1, upper + lower), "digits": in_lines(_DIGIT[buf])[some] / np.maximum(1, chars[some]),
            "same_as_before": per_line(same) / n, "different": np.bincount(kinds, minlength=len(line_end))[some] / n, "in_repeats": per_line(repeats) / n, "seen_line": seen[some],
            "ends": _END[buf[last_word_end - 1]], "words": n, "word_length": chars[some] / n,
        }
        self.text, self.line_words = line_text[some], n
        self.features = np.stack([OFFSETS[k] + np.searchsorted(STEPS[name], measures[name].astype(float), side="left") for k, name in enumerate(STEPS)], axis=1).astype(np.int16)

    @staticmethod
    def _in_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether each word is in a window that its text holds twice or more. Windows are numbered exactly: pairs, fours, fives."""
        out = np.zeros(len(words), dtype=bool)
        if len(words) < WINDOW:
            return out
        pair = _dense(words[:-1] * (int(words.max()) + 1) + words[1:])
        four = _dense(pair[:-2] * (int(pair.max()) + 1) + pair[2:])
        five = _dense(four[:-1] * (int(words.max()) + 1) + words[WINDOW - 1 :])
        inside = np.flatnonzero(text[: len(five)] == text[WINDOW - 1 :])
        twice = inside[_repeated(text[inside] * (int(five.max()) + 1) + five[inside])]
        for k in range(WINDOW):
            out[twice + k] = True
        return out


def sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Lines]]:
    """Ids and Lines of a batch (id, text in bytes), some megabytes at a time."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES_AT_A_TIME, side="right")))
        part = batch.slice(at, end - at)
        yield part.column(0), Lines(part.column(1).to_pylist())
        at = end


@dataclass
class Field:
    """Scores of a linear chain over two labels, 0 boilerplate and 1 content."""

    weights: np.ndarray  #: of a line's features, for content
    moves: np.ndarray  #: [from, to]
    start: np.ndarray

    def for_content(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)

    def decode(self, lines: Lines) -> np.ndarray:
        """The best labelling of each text's lines; of equally good ones, that with content."""
        e = self.for_content(lines.features).tolist()
        if not e:
            return np.zeros(0, dtype=bool)
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = self.start.tolist()
        back, starts, of = [], [], lines.text.tolist()
        a = b = 0.0
        before = -1
        for k, x in enumerate(e):
            if of[k] != before:
                before = of[k]
                starts.append(k)
                a, b = s0, s1 + x
                back.append((0, 1))
            else:
                back.append((0 if a + m00 > b + m10 else 1, 0 if a + m01 > b + m11 else 1))
                a, b = max(a + m00, b + m10), max(a + m01, b + m11) + x
            if k + 1 == len(e) or of[k + 1] != before:
                back.append((a, b))  # scores at a text's end
        out = np.zeros(len(e), dtype=bool)
        at = len(back) - 1
        for first, end in zip(reversed(starts), reversed([*starts[1:], len(e)]), strict=True):
            a, b = back[at]
            label = 0 if a > b else 1
            at -= 1
            for k in range(end - 1, first - 1, -1):
                out[k] = label
                label = back[at][label]
                at -= 1
        return out


NEUTRAL = Field(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2))


def _sequences(texts: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and a mask, padded: sequences of LINES lines at most."""
    cut = [(f[k : k + LINES], y[k : k + LINES]) for f, y in zip(texts, labels, strict=True) for k in range(0, len(f), LINES)]
    longest = max(len(y) for _, y in cut)
    x, y, mask = np.zeros((len(cut), longest, len(STEPS)), dtype=np.int64), np.zeros((len(cut), longest), dtype=np.int64), np.zeros((len(cut), longest), dtype=bool)
    for k, (f, labels_of) in enumerate(cut):
        x[k, : len(f)], y[k, : len(f)], mask[k, : len(f)] = f, labels_of, True
    return x, y, mask


def fit(texts: list[np.ndarray], labels: list[np.ndarray], rounds: int = ROUNDS) -> Field:
    """Conditional likelihood with a quadratic penalty, by Adam on its exact gradient (forward-backward over all sequences
    side by side)."""
    x, y, mask = _sequences(texts, labels)
    n, length = y.shape
    params = np.zeros(N_FEATURES + 4 + 2)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    inner = mask[:, 1:]
    seen = np.zeros_like(params)  # what the labelling has of each parameter
    np.add.at(seen, x[mask][y[mask] == 1].ravel(), 1)
    np.add.at(seen, N_FEATURES + 2 * y[:, :-1][inner] + y[:, 1:][inner], 1)
    np.add.at(seen, N_FEATURES + 4 + y[:, 0], 1)
    for step in range(1, rounds + 1):
        w, moves, start = params[:N_FEATURES], params[N_FEATURES : N_FEATURES + 4].reshape(2, 2), params[N_FEATURES + 4 :]
        e = np.zeros((n, length, 2))
        e[:, :, 1] = w[x].sum(axis=2)
        alpha, beta = np.zeros((length, n, 2)), np.zeros((length, n, 2))
        alpha[0] = start + e[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp(alpha[t - 1, :, :1] + moves[0], alpha[t - 1, :, 1:] + moves[1]) + e[:, t]
            alpha[t] = np.where(mask[:, t, None], nxt, alpha[t - 1])
        total = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        for t in range(length - 2, -1, -1):
            ahead = beta[t + 1] + e[:, t + 1]
            prev = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            beta[t] = np.where(mask[:, t + 1, None], prev, 0.0)
        expected = np.zeros_like(params)
        content = np.where(mask, np.exp((alpha + beta)[:, :, 1].T - total[:, None]), 0.0)
        np.add.at(expected, x.reshape(n * length, -1), np.repeat(content.reshape(-1, 1), len(STEPS), axis=1))
        ahead = (beta[1:] + e.transpose(1, 0, 2)[1:])[:, :, None, :] + alpha[:-1][:, :, :, None] + moves - total[None, :, None, None]
        expected[N_FEATURES : N_FEATURES + 4] = (np.exp(np.minimum(ahead, 0)) * inner.T[:, :, None, None]).sum(axis=(0, 1)).ravel()
        expected[N_FEATURES + 4 :] = np.exp(alpha[0] + beta[0] - total[:, None]).sum(axis=0)
        gradient = (seen - expected) / n - PENALTY * params
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        params = params + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(params[:N_FEATURES].copy(), params[N_FEATURES : N_FEATURES + 4].reshape(2, 2).copy(), params[N_FEATURES + 4 :].copy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """docs: id and text; labels: id and quality (0 or 1). The sample is of ids first, then of their rows."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("quality"))
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    some = known.filter("quality = 1").orderBy(*by_hash).limit(sample).union(known.filter("quality = 0").orderBy(*by_hash).limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.length("_text") <= MAX_CHARS).join(F.broadcast(some), "_id").select("quality", F.col("_text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for quality, lines in sliced(batch):
                at = np.searchsorted(lines.text, np.arange(len(quality) + 1))
                yield pa.RecordBatch.from_arrays([quality.cast(pa.int32()), pa.array([lines.features[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["quality", "features"])

    found = rows.mapInArrow(run, "quality int, features binary").filter(F.octet_length("features") > 0).limit(4 * sample).toArrow()
    pairs = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))  # the same in any partitioning
    texts = [np.frombuffer(f, dtype=np.int16).reshape(-1, len(STEPS)).astype(np.int64) for _, f in pairs]
    good = [q for q, _ in pairs]
    if len(set(good)) < 2:
        return NEUTRAL
    whole = fit(texts, [np.full(len(f), q, dtype=np.int64) for f, q in zip(texts, good, strict=True)])
    first = [np.ones(len(f), dtype=np.int64) if q else (whole.for_content(f) > 0).astype(np.int64) for f, q in zip(texts, good, strict=True)]
    return fit(texts, first)


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double"


def judge(docs: DataFrame, field: Field = NEUTRAL, id_col: str = "doc_id", text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """One row per row of docs: SCHEMA. content_share is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in sliced(batch):
                content = field.decode(x)
                share = np.bincount(x.text, x.line_words * content, minlength=len(ids)) / np.maximum(1, x.n_words)
                kept = ~x.failed & (share >= min_content)
                numbers = [pa.array(c, pa.int64()) for c in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)]
                yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(x.failed), pa.array(kept), pa.array(share, pa.float64(), mask=x.n_words == 0)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, train(docs, read(spark, sf_dir, "labels")))
