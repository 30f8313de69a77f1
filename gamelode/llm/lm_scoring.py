"""Operator 6, language-model scores with stupid backoff, computed relationally.

Words are lower-cased runs without white space; marks that no text can hold stand before each text. The model is a set of
count tables: for each length up to `order`, how often a sequence of so many words (or marks) was seen. A word is scored by the
longest gram that ends with it and was seen, ln(c(gram) / c(gram without the word)), plus ln ALPHA for every word that had to
be left off the gram's front; where no gram of two words or more was seen, by c(word) / N, with 1 for a word that was never
seen. A document's score is the sum.

count() makes the tables from the documents of a model, score() scores other documents with them, and score_each_by_others()
scores each document of a corpus by a model of all the others: what a row has itself is taken off every count, so that most
rare grams of a text are unseen there and back off.

Everything is counted and looked up under 64-bit hashes: within a document or a batch in Arrow batches, between them by
Spark's joins, if asked for one slice of the hash range after the other, so that the shuffled data of one slice at a time has
to fit on disk. Pairs of words take a shorter way: what a document scores if all its words back off needs no join for the
broadcast_keys words seen most often, nor do the HEAD_KEYS pairs seen most often, which every task holds; of all other words
and pairs, those whose bits in a filter of fixed size say that they may have been seen are looked up, for what they change. A
pair with a looked-up word is scored as if that word had been seen once, and put right if the pair was seen. Of many texts,
one part after the other is looked up, so that what is shuffled for one part at a time has to fit on disk; each text is in one
part. Longer grams of every word are joined to the tables, and the longest one seen is taken. Nothing is sampled or cut off.

Defined cases: a null text, or one without words, has 0 words and a null score; rows that repeat an id are scored each,
as what they add up to, under that id once; rows without an id are counted by the model and returned as one row with a
null id; a model without words scores every word as seen once among one; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, U64, mix, read, stored

ALPHA, ORDER, SLICES = 0.4, 3, 1  #: slices: a power of two
BROADCAST_KEYS = 2_000_000  #: 32 MB
PART_BYTES, PARTS = 1 << 25, 4  #: texts beyond so many bytes are looked up in parts; parts at most, each of which reads the tables again
HEAD_KEYS = 1 << 20  #: 16 MB
FILTER_WORDS = 1 << 21  #: 64 bits each
START = U64(xxhash.xxh3_64_intdigest(b" "))  #: no word has a space
ROWS_AT_A_TIME = 512
LONG = 64  #: bytes of a word
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)  #: the first n of eight bytes
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _hashes(data: bytes, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of runs of bytes: eight bytes after the other for all that have them; the few long ones one by one."""
    eight = np.ndarray(len(data), dtype="<u8", buffer=data + bytes(7), strides=(1,))  # the eight bytes from each on
    h, at = mix(sizes.astype(U64)), np.flatnonzero(sizes <= LONG)
    for k in range(0, LONG, 8):
        at = at[sizes[at] > k]
        h[at] = mix(h[at] * GOLDEN + (eight[begins[at] + k] & _LOW[np.minimum(sizes[at] - k, 8)]))
    for j in np.flatnonzero(sizes > LONG):
        h[j] = xxhash.xxh3_64_intdigest(data[begins[j] : begins[j] + sizes[j]])
    return h


class Words:
    """The word hashes of some texts, end to end, and the text that each belongs to."""

    def __init__(self, texts: list[str | None]):
        raws = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = b"\n".join([*raws, b""])
        white = _WHITE[np.frombuffer(data, dtype=np.uint8)]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        edges = np.concatenate([np.zeros(min(1, len(data)), dtype=np.int64), edges, [len(data)]])
        first = int(len(data) > 0 and white[0])  # runs of words and of white space take turns
        begins = edges[:-1][first::2]
        self.hash = _hashes(data, begins, edges[1:][first::2] - begins)
        ends = np.cumsum([len(r) + 1 for r in raws])
        self.text = np.searchsorted(ends, begins, side="right")
        self.count = np.bincount(self.text, minlength=len(texts))

    def ending(self, size: int) -> np.ndarray:
        """The hash of the `size` words up to each word, with marks before each text."""
        at = np.arange(len(self.hash)) + (size - 1) * (self.text + 1)
        padded = np.full(len(self.hash) + (size - 1) * len(self.count), START, dtype=U64)
        padded[at] = self.hash
        h = padded[at - size + 1]
        for k in range(1, size):
            h = mix(h * GOLDEN + padded[at - size + 1 + k])
        return h

    def before(self, of: np.ndarray, first: U64) -> np.ndarray:
        """For each word, what `of` has for the word before it, or `first` at the begin of a text."""
        out = np.empty_like(of)
        if len(of):
            out[1:] = of[:-1]
            out[np.append(True, self.text[1:] != self.text[:-1])] = first
        return out

    def own(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of keys of the words: the places of the first of each key in each text, which of these each word is, and how often
        the text has it. Within a batch a key's text stands in for its last bits."""
        _, first, which, n = np.unique(self._of_text(keys), return_index=True, return_inverse=True, return_counts=True)
        return first, which, n

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """own() without which key each word has."""
        _, first, n = np.unique(self._of_text(keys), return_index=True, return_counts=True)
        return first, n

    def _of_text(self, keys: np.ndarray) -> np.ndarray:
        return (self.text.astype(U64) << U64(55)) | (keys >> U64(9))


def marks(size: int) -> U64:
    """The hash of `size` marks."""
    h = np.array([START])
    for _ in range(1, size):
        h = mix(h * GOLDEN + START)
    return h[0]


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, Words(part.column(1).to_pylist())


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """stored(), with Spark told to delete the shuffle files of the write when it ends."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return stored(df, tag)
    finally:
        conf.set(name, before)


@dataclass(frozen=True)
class Counts:
    """tables: for each length from 1 to order, and of the longest one for each slice of the hash range, key and c of sequences
    seen `least` times or more. words: how many words there are, n_texts: in how many texts."""

    order: int
    slices: int
    least: int
    tables: list[list[DataFrame]]
    words: int
    n_texts: int


def count(docs: DataFrame, text_col: str = "text", order: int = ORDER, slices: int = SLICES, least: int = 1) -> Counts:
    """The model of some documents. least: 2 for a model from which every scored document is to be taken off again."""
    texts = docs.select(F.lit(0).alias("_"), F.col(text_col).alias("text"))

    def totals(size: int, k: int, of: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, words in _parts(batches, 4 * ROWS_AT_A_TIME):
                x = words.ending(size)
                x = np.append(x, np.full(int((words.count > 0).sum()) if size < order or size == 1 else 0, marks(size), dtype=U64))
                key, n = np.unique(x[x & U64(of - 1) == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

        seen = texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("c"))
        return _stored(seen if size == 1 else seen.filter(F.col("c") >= least), "counts")

    tables = [[totals(size, k, slices if size == order else 1) for k in range(slices if size == order else 1)] for size in range(1, order + 1)]
    mark = F.col("key") == F.lit(int(marks(1).view(np.int64)))
    n = [t.agg(F.sum("c"), F.sum(F.when(mark, F.col("c")))).first() for t in tables[0]]
    n_texts = sum(t or 0 for _, t in n)
    tables[0] = [t.filter(F.col("c") >= least) for t in tables[0]]
    return Counts(order, slices, least, tables, sum(w or 0 for w, _ in n) - n_texts, n_texts)


def _by_key(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and their counts."""
    rows = table.select("key", "c").toArrow()
    keys, counts = rows.column("key").to_numpy().view(U64), rows.column("c").to_numpy()
    at = np.argsort(keys)
    return keys[at], counts[at]


def _look_up(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The counts of keys, 0 for those that are not known."""
    of, c = known
    if not len(of):
        return np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return np.where(of[at] == keys, c[at], 0)


def _frequent(table: DataFrame, most: int) -> int:
    """The least count for which no more than `most` keys have it or a larger one, of those that begin a step of an eighth of a
    doubling."""
    steps = table.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    n, least = 0, 2**62
    for step in sorted(steps, key=lambda r: -r["step"]):
        n += step["n"]
        if n > most:
            break
        least = step["c"]
    return least


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each key, in FILTER_WORDS words."""
    at = F.col("key").bitwiseAND(F.lit(64 * FILTER_WORDS - 1))
    bits = keys.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_WORDS, dtype=np.int64)
    out[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    return out.view(U64)


def _pairs(docs: DataFrame, model: Counts, leave_out: bool, broadcast_keys: int) -> DataFrame:
    """doc_id, n_words, s: parts of the scores by pairs of words, to be added up."""
    spark, every, single = docs.sparkSession, reduce(DataFrame.union, model.tables[1]), model.tables[0][0]
    often, common = F.col("c") >= _frequent(every, HEAD_KEYS), F.col("c") >= _frequent(single, broadcast_keys)
    known, head = (spark.sparkContext.broadcast(_by_key(t)) for t in (single.filter(common), every.filter(often)))
    rare_words = single.filter(~common)
    has_rare = not rare_words.isEmpty()
    n_all, n_texts, slices, back = model.words, model.n_texts, model.slices, np.log(ALPHA)

    def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        slot = keys & U64(64 * FILTER_WORDS - 1)
        return (bits[slot >> U64(6)] >> (slot & U64(63)) & U64(1)) == 1

    def rows(k: int, bits) -> Callable:
        """A row for each text (n 0, n_words and s of the k-th slice), and for each of its words and pairs that the join has to
        look up; of these, a and b are the words that are looked up."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, words in _parts(batches, ROWS_AT_A_TIME):
                at, which, own = words.own(words.hash)
                seen = _look_up(known.value, words.hash[at])
                asked = (seen == 0) & has_bit(bits.value, words.hash[at]) if has_rare else np.zeros(len(at), dtype=bool)
                seen = np.maximum(0, seen - own) if leave_out else seen
                each, late = seen[which].astype(np.int64), asked[which]
                context, late_context = words.before(each, n_texts - leave_out), words.before(late, False)
                total = np.maximum(1, n_all - leave_out * words.count)
                off = back + np.log(np.maximum(1, each) / total[words.text])
                gram = words.ending(2)
                first, n = words.distinct(gram)
                may = (gram[first] & U64(slices - 1) == k) & ((each[first] > 0) | late[first]) & ((context[first] > 0) | late_context[first])
                first, n = first[may], n[may]
                less = n * (np.log(np.maximum(1, context[first])) + off[first])
                pair, text, lacks = gram[first], words.text[first], late[first] | late_context[first]
                c = _look_up(head.value, pair)
                left = c - n if leave_out else c
                gain = np.where((left > 0) & ~lacks, n * np.log(np.maximum(1, left)) - less, 0.0)
                s = np.bincount(text, gain, minlength=part.num_rows) + (np.bincount(words.text, off, minlength=part.num_rows) if k == 0 else 0.0)
                ask = (c == 0) & has_bit(bits.value, pair) | (c > 0) & lacks
                docs = part.column(0).cast(pa.int64())
                nowhere = mix(docs.fill_null(0).to_numpy().view(U64) ^ GOLDEN)  # spreads texts over the join, whose n is 0
                of = np.concatenate([words.text[at[asked]], text[ask]])
                rest, word, none = len(of), words.hash[at[asked]], np.zeros(len(docs), dtype=np.int64)
                key, n, less = np.concatenate([nowhere, word, pair[ask]]), np.concatenate([none, own[asked], n[ask]]), np.concatenate([none, np.zeros(len(word)), less[ask]])
                n_words = pa.concat_arrays([pa.array(words.count if k == 0 else none, pa.int64()), pa.nulls(rest, pa.int64())])
                s = pa.concat_arrays([pa.array(s, pa.float64(), mask=words.count == 0), pa.nulls(rest, pa.float64())])
                out = [pa.concat_arrays([docs, docs.take(pa.array(of))]), pa.array(key.view(np.int64)), pa.array(n), pa.array(less), n_words, s]
                if has_rare:
                    looked_up = lambda of, mask: pa.array(of[first[ask]].view(np.int64), mask=~mask[first[ask]])
                    out.append(pa.concat_arrays([pa.nulls(len(docs), pa.int64()), pa.array(word.view(np.int64)), looked_up(words.before(words.hash, START), late_context)]))
                    out.append(pa.concat_arrays([pa.nulls(len(docs) + len(word), pa.int64()), looked_up(words.hash, late)]))
                    out.append(part.column(2).take(pa.array(np.concatenate([np.arange(len(docs)), of]))))
                yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in schema.split(", ")])

        return run

    schema = "doc_id bigint, key bigint, n bigint, less double, n_words bigint, s double" + ", a bigint, b bigint, row bigint" * has_rare
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts, out = min(PARTS, max(1, -(-size // PART_BYTES))), []
    for k, table in enumerate(model.tables[1]):
        bits = spark.sparkContext.broadcast(_filter(table.filter(~often).union(rare_words)))
        table = table.union(rare_words) if has_rare else table.filter(~often)
        left = F.col("c") - F.col("n") if leave_out else F.col("c")
        hit, of_word = (F.col("n") > 0) & (left > 0), F.col("a") == F.col("key")
        for part in range(n_parts):
            some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)) == part) if n_parts > 1 else docs
            some = some.withColumn("row", F.monotonically_increasing_id()) if has_rare else some
            met = some.mapInArrow(rows(k, bits), schema).join(table, "key", "left").filter((F.col("n") == 0) | hit)
            s = F.coalesce("s", F.when(hit, F.col("n") * F.log(left) - F.col("less")))
            if has_rare:
                met = _put_right(met.withColumn("s", s if k == 0 else F.when(of_word, 0.0).otherwise(s)), of_word, F.log(left))
                s = F.col("s")
            out.append(_stored(met.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum(s).alias("s")), "sums"))
    return reduce(DataFrame.union, out)


def _put_right(met: DataFrame, of_word: Column, log_c: Column) -> DataFrame:
    """doc_id, n_words, s of each text: seen pairs were scored as if their looked-up words a and b had been seen once."""
    none = F.lit(None)
    entry = lambda word, n_words, s, log_c, n: F.struct(word.cast("bigint").alias("word"), n_words.cast("bigint").alias("n_words"), s.cast("double").alias("s"), log_c.cast("double").alias("log_c"), n.cast("bigint").alias("n"))
    own = entry(none, F.col("n_words"), F.col("s"), none, none)
    word = F.array(entry(F.col("key"), none, F.col("s"), log_c, none))
    pair = F.array(own, entry(F.col("a"), none, none, none, F.col("n")), entry(F.col("b"), none, none, none, F.col("n")))
    plain = F.col("a").isNull() & F.col("b").isNull()
    each = met.select("doc_id", "row", F.inline(F.when(plain, F.array(own)).when(of_word, word).otherwise(pair)))
    each = each.groupBy("doc_id", "row", "word").agg(F.sum("n_words").alias("n_words"), F.sum("s").alias("s"), F.max("log_c").alias("log_c"), F.sum("n").alias("n"))
    fix = F.when(F.col("word").isNotNull() & F.col("n").isNotNull() & F.col("log_c").isNotNull(), F.col("n") * F.col("log_c"))
    return each.select("doc_id", "n_words", F.when(fix.isNotNull(), F.coalesce("s", F.lit(0.0)) - fix).otherwise(F.col("s")).alias("s"))


def _by_place(docs: DataFrame, model: Counts, leave_out: bool) -> DataFrame:
    """As _pairs(), for grams of any length: every word's grams are joined to the tables."""
    order, n_all = model.order, model.words
    base = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _parts(batches, ROWS_AT_A_TIME):
            place, total = np.arange(len(words.hash)), np.maximum(1, n_all - leave_out * words.count)[words.text]
            row = part.column(2).take(pa.array(words.text))
            doc = part.column(0).take(pa.array(words.text))
            shorter = own_shorter = None
            for size in range(1, order + 1):
                key = words.ending(size)
                _, which, n = words.own(key)
                own = n[which] if len(key) else n
                context = words.before(shorter, marks(size - 1)) if size > 1 else key
                own_context = words.before(own_shorter, 1) if size > 1 else own
                columns = [doc, row, pa.array(place), pa.array(np.full(len(key), size)), pa.array(key.view(np.int64)), pa.array(own), pa.array(context.view(np.int64)), pa.array(own_context), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "place", "size", "key", "own", "context", "own_context", "total"])
                shorter, own_shorter = key, own

    asked = base.mapInArrow(grams, "doc_id bigint, row bigint, place bigint, size bigint, key bigint, own bigint, context bigint, own_context bigint, total bigint")
    table = None
    for t in [t for tables in model.tables for t in tables]:
        table = t if table is None else table.union(t)
    off = lambda c, own: F.coalesce(F.col(c), F.lit(0)) - (F.col(own) if leave_out else F.lit(0))
    met = asked.join(table, "key", "left").withColumn("c", off("c", "own"))
    met = met.filter("size = 1 or c > 0").join(table.select(F.col("key").alias("context"), F.col("c").alias("d")), "context", "left").withColumn("d", off("d", "own_context"))
    value = F.when(F.col("size") == 1, F.log(F.greatest(F.lit(1), F.col("c")) / F.col("total"))).otherwise(F.log(F.col("c") / F.col("d"))) + (order - F.col("size")) * F.lit(float(np.log(ALPHA)))
    best = met.groupBy("doc_id", "row", "place").agg(F.max_by(value, "size").alias("v"))
    sums = best.groupBy("doc_id", "row").agg(F.count("*").alias("n_words"), F.sum("v").alias("s")).select("doc_id", "n_words", "s")
    return sums.union(docs.select("doc_id", F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast("double").alias("s")))


def score(docs: DataFrame, model: Counts, id_col: str = "doc_id", text_col: str = "text", leave_out: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_words bigint, score double (sum of natural logarithms). leave_out: every row is one of the model's, and is
    taken off it."""
    if model.least > 1 and not leave_out:
        raise ValueError("a model of what was seen twice serves leave_out alone")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = _pairs(docs, model, leave_out, broadcast_keys) if model.order == 2 else _by_place(docs, model, leave_out)
    return out.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("s").alias("score"))


def score_each_by_others(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", slices: int = SLICES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """score() of each document by a model of all the others."""
    return score(docs, count(docs, text_col, order, slices, least=2), id_col, text_col, leave_out=True, broadcast_keys=broadcast_keys)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_each_by_others(read(spark, sf_dir, "documents"), order=2)
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"))


ORACLE = f"""
with words as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as a from documents),
tokens as (select r, unnest(a) as w, unnest(list_prepend(' ', a[:len(a) - 1])) as p from words where len(a) > 0),
seen as (select r, w from tokens union all select r, ' ' from words where len(a) > 0),
one as (select w, count(*) as c from seen group by 1), own1 as (select r, w, count(*) as c from seen group by 1, 2),
two as (select p, w, count(*) as c from tokens group by 1, 2), own2 as (select r, p, w, count(*) as c from tokens group by 1, 2, 3),
n as (select sum(len(a)) as n from words), own as (select r, len(a) as n from words),
scored as (select o.r, o.c as times, t.c - o.c as c2, x.c - xo.c as cp, u.c - uo.c as c1, n.n - own.n as total
 from own2 o join two t on t.p = o.p and t.w = o.w join one x on x.w = o.p join own1 xo on xo.r = o.r and xo.w = o.p
 join one u on u.w = o.w join own1 uo on uo.r = o.r and uo.w = o.w join own on own.r = o.r, n),
sums as (select r, sum(times * case when c2 > 0 then ln(c2::double / cp) else ln({ALPHA}) + ln(greatest(1, c1)::double / greatest(1, total)) end) as s from scored group by 1)
select doc_id, cast(sum(len(a)) as bigint) as n_words, round(sum(sums.s), 4) as score from words left join sums on sums.r = words.r group by doc_id
"""
