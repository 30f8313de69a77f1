"""De-duplication, deterministic sampling and splitting, and dense row numbers that no single task has to make."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelode.functions.hashing import hash_order
from gamelode.sources.scratch import stored


def dedup_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedup_text(df: DataFrame, text: str, order: list[Column | str], key: str) -> DataFrame:
    """First row of each exact text, over its digest; empty texts are never duplicates of each other."""
    same = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.concat(F.lit("row "), F.col(key).cast("string"))).otherwise(F.sha2(F.col(text), 256))
    return dedup_key(df.withColumn("_t", same), ["_t"], order).drop("_t")


def dedup_id_then_text(df: DataFrame, key: str, text: str, order: list[Column | str]) -> DataFrame:
    return dedup_text(dedup_key(df, [key], order), text, order, key)


def global_row_number(df: DataFrame, order: list[str], name: str = "rn", parts: int | None = None) -> DataFrame:
    """1..N in the given order: rows are dealt out by range, counted per part, and numbered inside each part.

    The dealt rows are stored once: ranges are sampled anew whenever such a plan runs, so counting and numbering must not
    each deal the rows out. Rows that the order does not tell apart are numbered in any order among themselves."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row per part
    w = Window.partitionBy("_part").orderBy(*order)
    out = placed.withColumn("_k", F.row_number().over(w)).join(F.broadcast(offsets.select("_part", "_before")), "_part")
    return out.withColumn(name, (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_part", "_k", "_before")


def sample_n(df: DataFrame, n: int, seed: int | str, key: str) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(n)


def split_exact(df: DataFrame, ratios: tuple[float, ...], names: tuple[str, ...], seed: int | str, key: str) -> DataFrame:
    """int(n * ratio) rows for each part in hash order, the rest for the last."""
    total = df.count()
    numbered = global_row_number(df.withColumn("_h", hash_order(seed, key)), ["_h", key], "_rn")
    ends, at = [], 0
    for r in ratios[:-1]:
        at += int(total * r)
        ends.append(at)
    split = F.lit(names[-1])
    for end, name in reversed(list(zip(ends, names, strict=False))):
        split = F.when(F.col("_rn") <= end, name).otherwise(split)
    return numbered.withColumn("split", split).drop("_h", "_rn")


def sample_per_label(df: DataFrame, label: str, app: str, key: str, n: int, cap: int, seed: int | str, strict: bool = True) -> DataFrame:
    """At most cap rows of an app in a label, then n of the label, all in hash order; the sample then gets an order of its own
    and annotation_id from 1 in it. strict: a label with fewer than n rows left is an error."""
    h = hash_order(seed, key)
    a = Window.partitionBy(label, app).orderBy(h, key)
    b = Window.partitionBy(label).orderBy(h, key)
    few = df.withColumn("_a", F.row_number().over(a)).filter(F.col("_a") <= cap)
    few = few.withColumn("_b", F.row_number().over(b)).filter(F.col("_b") <= n).drop("_a", "_b")
    few = stored(few, "sample")
    if strict:
        short = [f"{r[0]}: {r[1]}" for r in few.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") < n).orderBy(label).limit(20).collect()]
        if short:
            raise ValueError(f"fewer than {n} rows for {', '.join(short)}")
    shuffled = few.withColumn("_o", hash_order(f"{seed} order", key))
    return global_row_number(shuffled, ["_o", key], "annotation_id").drop("_o")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int | str) -> DataFrame:
    """The n rows with the least hash of each group: a uniform sample that merges like a reservoir."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def stratified_sample(df: DataFrame, bucket: str, key: str, n: int, seed: int | str) -> DataFrame:
    """max(1, round half even(n * size / total)) rows of each bucket; the union is cut to n in hash order."""
    sizes = df.groupBy(bucket).agg(F.count("*").alias("_nb"))
    total = sizes.agg(F.sum("_nb").alias("_total"))
    quota = sizes.crossJoin(F.broadcast(total)).select(bucket, F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_nb") / F.col("_total"))).alias("_q"))
    w = Window.partitionBy(bucket).orderBy(hash_order(seed, key), key)
    some = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).join(quota, bucket).filter(F.col("_n") <= F.col("_q"))
    return sample_n(some.drop("_n", "_q"), n, seed, key)


def quantile_sample(df: DataFrame, length: str, key: str, m: int) -> DataFrame:
    """Rows at the places round half even(i (n-1) / (m-1)) in order of length."""
    n = df.count()
    places = [round(i * (n - 1) / (m - 1)) + 1 for i in range(m)] if m > 1 and n else [1]
    wanted = df.sparkSession.createDataFrame([(p,) for p in sorted(set(places))], "rn bigint")
    return global_row_number(df, [length, key]).join(F.broadcast(wanted), "rn")


def eval_subset(pool: DataFrame, targets: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """All targets of the pool, and others in hash order up to n rows."""
    have = pool.join(targets.select(key).distinct(), key, "left_semi")
    rest = pool.join(targets.select(key).distinct(), key, "left_anti")
    return have.unionByName(sample_n(rest, max(0, n - have.count()), seed, key))


def multilabel_split(df: DataFrame, labels: str, key: str, ratio: float, seed: int | str) -> DataFrame:
    """Rows in order of (rarest label, hash): each 1/ratio-th of a label goes to validation. Rows without labels likewise, and
    one of them at least. Rows are numbered over all labels at once, and a row's place in its label is its number less what
    stands before."""
    counts = df.select(F.explode(labels).alias("_l")).groupBy("_l").agg(F.count("*").alias("_c"))
    rare = df.select(key, F.explode(labels).alias("_l")).join(counts, "_l").groupBy(key).agg(F.min_by("_l", F.struct("_c", "_l")).alias("_rarest"))
    out = df.join(rare, key, "left").withColumns({"_rarest": F.coalesce("_rarest", F.lit("")), "_h": hash_order(seed, key)})
    numbered = stored(global_row_number(out, ["_rarest", "_h", key], "_rn"), "numbered")
    first = numbered.groupBy("_rarest").agg(F.min("_rn").alias("_first"), F.count("*").alias("_n"))
    place = F.col("_rn") - F.col("_first") + 1
    every = round(1 / ratio)
    alone = (F.col("_rarest") == "") & (F.col("_n") < every) & (place == 1)
    return numbered.join(first, "_rarest").withColumn("split", F.when((place % every == 0) | alone, "valid").otherwise("train")).drop("_rarest", "_h", "_rn", "_first", "_n")


MAX_SETS = 200_000  #: distinct sets of labels that are looked at one by one; beyond it, sets are told apart by their rarest labels


def quotas(sets: list[tuple[tuple[str, ...], int]], ratio: float, size: int) -> dict[tuple[str, ...], int]:
    """How many rows of each set of labels (with its number of rows) go to validation, `size` in all. In rounds, the label with
    the fewest rows left sends as many as validation still wants of it, spread over its sets in proportion; what a set sends
    counts for its other labels, whose rounds come later. A round's sets are taken in order of how many labels they have, so
    that rows with few and many labels are sent alike. The last round takes what is missing in all."""
    have: Counter = Counter()
    of: dict[str, list[int]] = {}
    for k, (labels, n) in enumerate(sets):
        for x in labels:
            have[x] += n
            of.setdefault(x, []).append(k)
    wanted = {x: n * ratio for x, n in have.items()}
    out, left, sent = {}, dict(have), 0
    while left:
        label = min(left, key=lambda x: (left[x], x))
        mine = sorted((k for k in of[label] if sets[k][0] not in out), key=lambda k: (len(sets[k][0]), sorted(sets[k][0], key=lambda x: (-have[x], x))))
        rows = sum(sets[k][1] for k in mine)
        last = len(out) + len(mine) == len(sets)
        send = max(0, min(rows, size - sent, size - sent if last else round(wanted[label])))
        sent += send
        before = 0
        for k in mine:
            labels, n = sets[k]
            out[labels] = (2 * (before + n) * send + rows) // (2 * rows) - (2 * before * send + rows) // (2 * rows)
            before += n
            for x in labels:
                wanted[x] -= out[labels]
                left[x] -= n
        left = {x: n for x, n in left.items() if n > 0 and x != label}
    return out


def iterative_split(df: DataFrame, labels: str, key: str, ratio: float, seed: int | str, max_sets: int = MAX_SETS) -> DataFrame:
    """Multi-label stratification: validation gets round(ratio * n) rows, with each label's share as near to ratio as quotas()
    can make it; which rows of a set of labels go is by hash. Rows without labels are split apart, one at least to
    validation. The driver sees the number of rows of each set of labels, max_sets at most; of the rows nothing."""
    none = F.array().cast("array<string>")
    rows = df.withColumns({"_set": F.array_sort(F.array_distinct(F.array_compact(F.coalesce(labels, none)))), "_h": hash_order(seed, key)})
    counts = rows.groupBy("_set").agg(F.count("*").alias("_n"))
    if counts.count() > max_sets:
        each = rows.select(F.explode("_set").alias("_l")).groupBy("_l").agg(F.count("*").alias("_c"))
        rarest = rows.select(key, F.explode("_set").alias("_l")).join(each, "_l").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_c", "_l"))).alias("_r"))
        for depth in (3, 2, 1):
            cut = rows.drop("_set").join(rarest.select(key, F.array_sort(F.transform(F.slice("_r", 1, depth), lambda x: x["_l"])).alias("_set")), key, "left").withColumn("_set", F.coalesce("_set", none))
            counts = cut.groupBy("_set").agg(F.count("*").alias("_n"))
            if counts.count() <= max_sets:
                break
        rows = cut
    known = sorted((tuple(r["_set"]), r["_n"]) for r in counts.collect())
    n, empty = sum(c for _, c in known), dict(known).get((), 0)
    bare = min(empty, max(1, round(empty * ratio)))
    size = round(n * ratio) - bare
    if size <= 0 < n - empty:
        raise ValueError("validation has no room for rows with labels")
    quota = {(): bare} | quotas([x for x in known if x[0]], ratio, size)
    table = df.sparkSession.createDataFrame([(list(k), v) for k, v in quota.items()] or [([], 0)], "_set array<string>, _v bigint")
    numbered = stored(global_row_number(rows, ["_set", "_h", key], "_rn"), "numbered")
    first = numbered.groupBy("_set").agg(F.min("_rn").alias("_first"))
    placed = numbered.join(first, "_set").join(F.broadcast(table), "_set")  # one row for each set
    return placed.withColumn("split", F.when(F.col("_rn") - F.col("_first") < F.col("_v"), "valid").otherwise("train")).drop("_set", "_h", "_rn", "_first", "_v")


def cyclic_assign(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """The i-th row gets value i mod n."""
    arr = F.array(*(F.lit(v) for v in values))
    return global_row_number(df, order, "_rn").withColumn("assigned", F.get(arr, F.pmod(F.col("_rn") - 1, F.lit(len(values))).cast("int"))).drop("_rn")


def request_chunks(df: DataFrame, order: list[str], size: int = 25_000) -> DataFrame:
    """Rows in order, cut into chunks of `size`: adds chunk, from 0."""
    return global_row_number(df, order, "_rn").withColumn("chunk", F.floor((F.col("_rn") - 1) / size)).drop("_rn")
