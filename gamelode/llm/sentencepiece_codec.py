"""Operator 1, SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reports, at each position, every piece that ends there, by following output
links; a single-pass Viterbi relaxes the best score at that position from each piece's start. Scores are those of the
model file. On equal scores the longest last piece wins.

White space is escaped and a space put before the text as the model file asks. No piece has a space mark after another
character (checked when the model is loaded), so the path never crosses the places where a run of marks begins, and none
crosses a line break: texts are cut there. The distinct segments of some megabytes of text go through the automaton once and
through the Viterbi side by side, one position of all of them after the other; ids are put together, and decoded, by
look-ups over whole arrays. Characters without a piece become byte pieces, or the unknown id where the model has none.

The model file is read on the driver, when the operator is called, and travels with the tasks (about half a megabyte).

Defined cases: a null text has no ids and decodes to null; the empty text has no ids; very long segments are encoded like
any other, in time proportional to their length; bytes that form no character decode to U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
AT_A_TIME = 1_500_000  #: bytes of text whose ids are held at a time (one text at least)
TOGETHER = 200  #: characters of a segment that goes through the Viterbi beside others; longer ones go alone


class Automaton:
    """Aho-Corasick over words, in arrays. States are the words' beginnings, 0 the empty one; fail leads to the longest proper
    suffix that is a state; link to the longest suffix that is a word (0 for none). Moves on the DENSE most frequent
    characters are one table; others are looked up among the trie's edges, down the fails."""

    DENSE = 128

    def __init__(self, words: dict[str, int]):
        states = sorted({w[:n] for w in words for n in range(len(w) + 1)}, key=len)
        number = {x: k for k, x in enumerate(states)}
        counts: dict[str, int] = {}
        for w in words:
            for c in w:
                counts[c] = counts.get(c, 0) + 1
        frequent = sorted(counts, key=lambda c: (-counts[c], c))[: self.DENSE]
        self.column = np.full(0x110000, self.DENSE, dtype=np.uint8)
        self.column[[ord(c) for c in frequent]] = np.arange(len(frequent))
        n = len(states)
        self.word = np.array([words.get(x, -1) for x in states], dtype=np.int32)
        self.fail, self.link = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        children: list[list[tuple[str, int]]] = [[] for _ in states]
        for k, x in enumerate(states[1:], 1):
            children[number[x[:-1]]].append((x[-1], k))
        edges = {(k, c): to for k, found in enumerate(children) for c, to in found}
        self.move = np.zeros((n, self.DENSE), dtype=np.int32)
        for k in range(n):  # shorter states first
            if k:
                x = states[k]
                f = self.fail[number[x[:-1]]] if len(x) > 1 else 0
                while f and (int(f), x[-1]) not in edges:
                    f = self.fail[f]
                self.fail[k] = edges.get((int(f), x[-1]), 0) if len(x) > 1 else 0
                f = self.fail[k]
                self.link[k] = f if self.word[f] >= 0 else self.link[f]
                self.move[k] = self.move[f]
            for c, to in children[k]:
                if (at := self.column[ord(c)]) < self.DENSE:
                    self.move[k, at] = to
        rare = sorted(((k << 21) | ord(c), to) for (k, c), to in edges.items() if self.column[ord(c)] == self.DENSE)
        self.edge, self.edge_to = np.array([e for e, _ in rare], dtype=np.int64), np.array([t for _, t in rare], dtype=np.int32)
        self.first = np.where(self.word >= 0, np.arange(n, dtype=np.int32), self.link)  # the longest word that ends in a state

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        column = self.column[code]
        dense = column < self.DENSE
        if dense.all():
            return self.move[state, column]
        out = np.zeros_like(state)
        out[dense] = self.move[state[dense], column[dense]]
        at = np.flatnonzero(~dense) if len(self.edge) else dense[:0]
        here = state[at].astype(np.int64)
        while len(at):
            key = here << 21 | code[at]
            e = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[e] == key
            out[at[hit]] = self.edge_to[e[hit]]
            on = ~hit & (here > 0)
            at, here = at[on], self.fail[here[on]].astype(np.int64)
        return out


class PieceCodec:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap:
            raise ValueError("this model rewrites characters; only models that keep them are supported")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        pieces: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        normal: dict[str, int] = {}
        for k, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = k
                pieces.append(bytes([int(p.piece[3:-1], 16)]))
            elif p.type in (p.NORMAL, p.USER_DEFINED):
                normal[p.piece] = k
                pieces.append(p.piece.replace(MARK, " ").encode())
            else:
                self.unknown = k if p.type == p.UNKNOWN else self.unknown
                pieces.append(b"")
        if crossing := [p for p in normal if re.search(f"[^{MARK}]{MARK}|.\n|\n.", p, re.S)]:
            raise ValueError(f"pieces across a space or line break: {crossing[:3]}")
        self.pieces = pa.array(pieces, pa.binary())
        self.sizes = np.array(list(map(len, pieces)), dtype=np.int64)
        self.letters, self.scores = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces))  # characters and score of a piece
        for p, k in normal.items():
            self.letters[k], self.scores[k] = len(p), proto.pieces[k].score
        self.fallback_score = float(min((self.scores[k] for k in normal.values()), default=0.0)) - 10.0
        self.automaton = Automaton(normal)

    def _alone(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def viterbi(self, segment: str) -> list[int]:
        """Ids of the best path: best[i] is final once the words that end at i have been followed."""
        a, n = self.automaton, len(segment)
        best, back, ids = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        state = np.zeros(1, dtype=np.int32)
        for i, c in enumerate(segment, 1):
            state = a.step(state, np.array([ord(c)]))
            best[i], back[i] = best[i - 1] + self.fallback_score, i - 1
            word = int(a.first[state[0]])
            while word:
                k = int(a.word[word])
                if (s := best[i - int(self.letters[k])] + float(self.scores[k])) > best[i]:
                    best[i], back[i], ids[i] = s, i - int(self.letters[k]), k
                word = int(a.link[word])
        path: list[int] = []
        i = n
        while i:
            path.extend([ids[i]] if ids[i] >= 0 else reversed(self._alone(segment[back[i] : i])))
            i = back[i]
        return path[::-1]

    def paths(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments' best paths end to end, and how many each has: viterbi() for many at once.

        Segments lie end to end with a line break after each, which no piece crosses; the place of a character in that string
        is also the number of the node before it."""
        joined = b"\n".join([*segments, b""])
        text = joined.decode("utf-8", "surrogatepass").replace(" ", MARK)
        heads = np.cumsum((np.frombuffer(joined, dtype=np.uint8) & 0xC0) != 0x80)
        stop = heads[np.cumsum([len(x) + 1 for x in segments]) - 1]  # the node after each break
        begin = np.concatenate([[0], stop[:-1]])
        size = stop - begin - 1
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        a, word_letters, word_scores = self.automaton, self.letters, self.scores
        best, back, via = np.zeros(len(text) + 1), np.arange(-1, len(text)), np.full(len(text) + 1, -1)
        together = np.flatnonzero(size <= TOGETHER)
        together = together[np.argsort(-size[together], kind="stable")]
        first, length = begin[together], size[together]
        state = np.zeros(len(together), dtype=np.int32)
        for p in range(1, int(length.max(initial=0)) + 1):
            n = np.searchsorted(-length, -p, side="right")  # segments that are p long or more
            node = first[:n] + p
            state = a.step(state[:n], code[node - 1])
            best[node] = best[node - 1] + self.fallback_score
            ends = a.first[state]
            node, ends = node[ends > 0], ends[ends > 0]
            while len(node):  # along the output links
                k = a.word[ends]
                start = node - word_letters[k]
                s = best[start] + word_scores[k]
                more = s > best[node]
                t = node[more]
                best[t], back[t], via[t] = s[more], start[more], k[more]
                ends = a.link[ends]
                node, ends = node[ends > 0], ends[ends > 0]
        ids, of = [], []
        node, alive = begin[together] + size[together], together
        while len(alive):
            going = node > begin[alive]
            node, alive = node[going], alive[going]
            ids.append(np.where(via[node] >= 0, via[node], -node))
            of.append(alive)
            node = back[node]
        ids, of = (np.concatenate(x[::-1]) if x else np.zeros(0, dtype=np.int64) for x in (ids, of))
        if (ids < 0).any() or len(together) < len(segments):  # characters without a piece, and long segments
            rows = [[i] if i >= 0 else self._alone(text[-i - 1]) for i in ids.tolist()]
            long = {k: self.viterbi(text[begin[k] : begin[k] + size[k]]) for k in np.flatnonzero(size > TOGETHER).tolist()}
            of = np.concatenate([np.repeat(of, list(map(len, rows))), np.repeat(np.array(list(long), dtype=np.int64), list(map(len, long.values())))])
            ids = np.array([i for r in (*rows, *long.values()) for i in r], dtype=np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.int32), np.bincount(of, minlength=len(segments))

    def _spaced(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if self.prefix and text else text

    def escape(self, text: str) -> str:
        return self._spaced(text).replace(" ", MARK)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        raw, places = self.decode_all(ids, np.array([0, len(ids)]))
        return _text_array(raw, places, [True])[0].as_py()

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids end (0 first)."""
        raws = [self._spaced(t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ends = np.cumsum([0, *map(len, raws)])
        buf = np.frombuffer(b"".join(raws), dtype=np.uint8)
        if not len(buf):
            return np.zeros(0, dtype=np.int32), np.zeros(len(ends), dtype=np.int64)
        space, line = buf == 32, buf == 10
        cut = np.empty(len(buf), dtype=bool)  # a segment begins here: a run of spaces, a line break, or what follows one
        cut[0] = True
        cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        cut[ends[:-1][np.diff(ends) > 0]] = True
        begins = np.flatnonzero(cut)
        segments = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(buf)).astype(np.int64)), pa.py_buffer(buf)]).dictionary_encode()
        which = segments.indices.to_numpy()
        known, size = self.paths(segments.dictionary.to_pylist())
        first = np.cumsum(size) - size
        n = size[which]
        stop = np.cumsum(n)
        ids = known[np.repeat(first[which] - (stop - n), n) + np.arange(stop[-1])]
        return ids, np.concatenate([[0], stop])[np.searchsorted(begins, ends)]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The UTF-8 bytes of all texts end to end, and where each begins and ends (two rows)."""
        taken = self.pieces.take(pa.array(ids))
        raw = (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends]
        begin, stop = at[:-1].copy(), at[1:]
        if self.prefix:
            begin[[b < s and raw[b] == 32 for b, s in zip(begin.tolist(), stop.tolist(), strict=True)]] += 1
        return raw, np.stack([begin, stop])


@lru_cache(2)
def _codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def codec(model_file: str) -> PieceCodec:
    return _codec(_read_model(model_file))


def _text_array(raw: bytes, places: np.ndarray, valid: list[bool]) -> pa.Array:
    """Strings at the places; whole bytes are checked at once, and text by text only where that fails."""
    try:
        raw.decode("utf-8")
        good = True  # pieces are whole characters or single bytes; a text may still end within a character
        buf = np.frombuffer(raw + b"\0", dtype=np.uint8)
        good = not ((buf[places] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        good = False
    read_as = "strict" if good else "replace"
    return pa.array([raw[a:b].decode("utf-8", read_as) if v else None for a, b, v in zip(*places.tolist(), valid, strict=True)], pa.string())


def _read_model(model_file: str) -> bytes:
    with open(model_file, "rb") as f:
        return f.read()


def _pieces_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about AT_A_TIME bytes of text, or a third as many ids."""
    x = batch.column(column)
    size = x.value_lengths() if pa.types.is_list(x.type) else pc.binary_length(x)
    part = np.cumsum(size.fill_null(0).to_numpy() * (3 if pa.types.is_list(x.type) else 1)) // AT_A_TIME
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _apply(docs: DataFrame, model_file: str, text_col: str | None, ids_col: str, out_col: str | None) -> DataFrame:
    """One pass: ids from text_col (where given), decoded to out_col (where given)."""
    made = [c for c in (ids_col if text_col else None, out_col) if c]
    names = [c for c in docs.columns if c not in made]
    docs = docs.select(*names)
    model = docs.sparkSession.sparkContext.broadcast(_read_model(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _codec(model.value)
        for batch in batches:
            for part in _pieces_of(batch, names.index(text_col or ids_col)):
                columns = list(part.columns)
                if text_col:
                    texts = part.column(names.index(text_col)).to_pylist()
                    valid = [t is not None for t in texts]
                    ids, ends = tool.encode_all(texts)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=pa.array([not v for v in valid])))
                else:
                    lists = part.column(names.index(ids_col))
                    valid = lists.is_valid().to_pylist()
                    ids = lists.flatten().to_numpy(zero_copy_only=False)
                    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                if out_col:
                    columns.append(_text_array(*tool.decode_all(ids, ends), valid))
                yield pa.RecordBatch.from_arrays(columns, names=names + made)

    for c in made:
        docs = docs.withColumn(c, F.lit(None).cast("string" if c == out_col else "array<int>"))
    return docs.select(*names).mapInArrow(run, docs.schema)


def encode(docs: DataFrame, model_file: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids array<int> added (null for a null text); all other columns pass through."""
    return _apply(docs, model_file, text_col, ids_col, None)


def decode(encoded: DataFrame, model_file: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text of ids_col added (null for null ids); all other columns pass through."""
    return _apply(encoded, model_file, None, ids_col, out_col)


def round_trip(docs: DataFrame, model_file: str = MODEL, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with both, the ids and the text they decode to, in one pass of Python workers."""
    return _apply(docs, model_file, text_col, ids_col, out_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids, their number, and whether they decode to the text again."""
    both = round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
