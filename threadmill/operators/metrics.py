"""Agreement, classification, prevalence and association measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.session import cut


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n) of the pairs in which both labels are known."""
    return df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """(label, n_true, n_guessed, n_right, precision, recall, f1) from a confusion table.

    A measure whose denominator is 0 is null.
    """
    rows = cells.select(F.inline(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("r")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("r")))))
    sums = rows.groupBy("label").agg(F.sum("t").alias("n_true"), F.sum("g").alias("n_guessed"), F.sum("r").alias("n_right"))
    over = lambda a, b: F.when(b > 0, a / b)
    return sums.select("*", over(F.col("n_right"), F.col("n_guessed")).alias("precision"), over(F.col("n_right"), F.col("n_true")).alias("recall"), over(2 * F.col("n_right"), F.col("n_true") + F.col("n_guessed")).alias("f1"))


def agreement(cells: DataFrame) -> DataFrame:
    """One row (n, observed, kappa, ac1): Cohen's kappa and Gwet's AC1 of a confusion table."""
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("same"))
    margin = cells.select(F.inline(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))))).groupBy("label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    joint = margin.join(F.broadcast(total), how="cross").agg(
        F.first("n").alias("n"), F.first("same").alias("same"), F.sum(F.col("a") * F.col("b") / (F.col("n") * F.col("n"))).alias("pe"), F.count("*").alias("q"), F.sum((F.col("a") + F.col("b")) / (2 * F.col("n")) * (1 - (F.col("a") + F.col("b")) / (2 * F.col("n")))).alias("g")
    )
    po, pg = F.col("same") / F.col("n"), F.col("g") / (F.col("q") - 1)
    return joint.select("n", po.alias("observed"), F.when(F.col("pe") < 1, (po - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"), F.when((F.col("q") > 1) & (pg < 1), (po - pg) / (1 - pg)).alias("ac1"))


def prevalence(items: DataFrame, eligible: DataFrame, by: str) -> DataFrame:
    """(by, item, n, share): rows of a corpus that hold an item over its eligible rows.

    ``items`` is (by, row, item), ``eligible`` (by, row). An item counts once a row.
    """
    base = eligible.groupBy(by).agg(F.count_distinct("row").alias("base"))
    return items.groupBy(by, "item").agg(F.count_distinct("row").alias("n")).join(base, by).select(by, "item", "n", (F.col("n") / F.col("base")).alias("share"))


def npmi(items: DataFrame, rows: int, least: int = 5) -> DataFrame:
    """(a, b, n, pmi, npmi) of items that occur together in at least ``least`` rows, a < b.

    ``items`` is (row, item). Items below ``least`` are dropped before pairs are made, and
    pairs are made within a row from its own sorted list, so the only shuffle is by pair.
    """
    once = items.where("item is not null").distinct()
    df = once.groupBy("item").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    lists = once.join(df, "item").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item", "df"))).alias("s")).where(F.size("s") > 1)
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x["item"].alias("a"), y["item"].alias("b"), x["df"].alias("da"), y["df"].alias("db")))))
    n = F.lit(float(rows))
    counted = lists.select(F.inline(pair)).groupBy("a", "b", "da", "db").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pmi = F.ln(F.col("n") * n / (F.col("da") * F.col("db")))
    return counted.select("a", "b", "n", pmi.alias("pmi"), F.when(F.col("n") < n, pmi / -F.ln(F.col("n") / n)).alias("npmi"))


def overall_scores(cells: DataFrame) -> DataFrame:
    """One row (n, accuracy, micro_f1, macro_precision, macro_recall, macro_f1) of a confusion table.

    With one label per row micro precision, recall and F1 are all the accuracy. Macro
    measures are means over the classes that occur; a class without a guess has precision
    0, one that never is true recall 0.
    """
    scores = class_scores(cells).select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    macro = scores.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    right = cells.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return right.join(F.broadcast(macro), how="cross").select("n", "accuracy", F.col("accuracy").alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1")


def multilabel_scores(df: DataFrame, truth: str, guess: str, labels: Sequence[str]) -> DataFrame:
    """One row (n, subset_accuracy, hamming_loss, micro_precision, micro_recall, micro_f1, macro_f1).

    ``truth`` and ``guess`` are arrays; labels outside ``labels`` don't count, null is empty.
    """
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    one = [F.struct(has(truth, x).alias("t"), has(guess, x).alias("g")) for x in labels]
    rows = df.select(F.array(*one).alias("p"))
    count = lambda i, c: F.count_if(c(F.col("p")[i]["t"], F.col("p")[i]["g"]))
    both, wrong, missed = (F.array(*[count(i, c) for i in range(len(labels))]) for c in (lambda t, g: t & g, lambda t, g: ~t & g, lambda t, g: t & ~g))
    exact = F.count_if(~F.exists("p", lambda x: x["t"] != x["g"]))
    sums = rows.agg(F.count("*").alias("n"), exact.alias("e"), both.alias("b"), wrong.alias("w"), missed.alias("m"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    over = lambda a, b: F.when(b > 0, a / b)
    b, w, m = add("b"), add("w"), add("m")
    each = [over(2 * F.col("b")[i], 2 * F.col("b")[i] + F.col("w")[i] + F.col("m")[i]) for i in range(len(labels))]
    macro = sum((F.coalesce(x, F.lit(0.0)) for x in each), F.lit(0.0)) / len(labels)
    return sums.select("n", over(F.col("e"), F.col("n")).alias("subset_accuracy"), over(w + m, F.col("n") * len(labels)).alias("hamming_loss"), over(b, b + w).alias("micro_precision"), over(b, b + m).alias("micro_recall"), over(2 * b, 2 * b + w + m).alias("micro_f1"), macro.alias("macro_f1"))


def fdr(tests: DataFrame, p: str) -> DataFrame:
    """tests with q, the Benjamini-Hochberg adjusted p: min over larger p of p * m / rank.

    Equal p have equal q. Rows are range-partitioned by p and written; ranks and minima are computed within the
    partitions and carried on by one row a partition. Tests without p are left out.
    """
    rows = cut(tests.where(F.col(p).isNotNull()).repartitionByRange(F.col(p))).withColumn("__part", F.spark_partition_id())
    sizes = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    total, before, at = sum(sizes.values()), {}, 0
    for part in sorted(sizes):
        before[part], at = at, at + sizes[part]
    spark = tests.sparkSession
    offsets = spark.createDataFrame(list(before.items()) or [(-1, 0)], "__part int, __before bigint")
    ranked = rows.join(F.broadcast(offsets), "__part").selectExpr("*", f"{p} * {total}D / (__before + row_number() over (partition by __part order by {p})) as __x")
    least = {r["__part"]: r["x"] for r in ranked.groupBy("__part").agg(F.min("__x").alias("x")).collect()}
    later, low = {}, 1.0
    for part in sorted(sizes, reverse=True):
        later[part], low = low, min(low, least[part])
    behind = spark.createDataFrame(list(later.items()) or [(-1, 1.0)], "__part int, __later double")
    within = ranked.join(F.broadcast(behind), "__part").selectExpr("*", f"least(__later, min(__x) over (partition by __part order by {p} desc range unbounded preceding)) as q")
    return within.drop("__part", "__before", "__x", "__later")


def bootstrap_ci(df: DataFrame, value: str, key: str, rounds: int = 200, level: float = 0.95, seed: int = 7) -> DataFrame:
    """One row (mean, low, high): a Poisson bootstrap of the mean, weights drawn from (seed, key).

    Every task sums the weighted values of all rounds in arrays; one row per task and
    round is shuffled.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_sum, v_sum = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            v = b.column(1).to_numpy(zero_copy_only=False)
            for k, x in zip(b.column(0).to_pylist(), v):
                w = np.random.default_rng([seed, k & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, rounds)
                w_sum += w
                v_sum += w * x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds), pa.int32()), pa.array(w_sum), pa.array(v_sum)], names=["b", "w", "v"])

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("x"))
    means = rows.mapInArrow(sums, "b int, w double, v double").groupBy("b").agg((F.sum("v") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return df.agg(F.avg(value).alias("mean")).join(F.broadcast(ends), how="cross").select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def permutation_null(items: DataFrame, rounds: int = 20, least: int = 5, seed: int = 7) -> DataFrame:
    """(a, b, n, n_reached, p) of items that occur together, a < b, against shuffled data.

    ``items`` is (row, item). Each round deals the items anew over all places, which keeps
    every item's frequency and every row's number of places; an item dealt twice to a row
    counts once. n_reached is in how many rounds a pair occurs at least n times, p is
    (n_reached + 1) / (rounds + 1). Places are numbered by sorting on a hash of the round,
    range-partitioned, so no task sees them all.
    """
    once = cut(items.where("item is not null").distinct())

    def pairs(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("s")).where(F.size("s") > 1)
        pair = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        return lists.select(F.inline(pair)).groupBy("a", "b").agg(F.count("*").alias("n"))

    seen = cut(pairs(once).where(F.col("n") >= least))
    reached = None
    for r in range(rounds):
        dealt = numbered(once.select("item"), F.xxhash64("item", F.rand(seed + r))).join(numbered(once.select("row"), F.xxhash64("row", F.lit(r))), "place").select("row", "item")
        hit = cut(seen.join(pairs(dealt).select("a", "b", F.col("n").alias("m")), ["a", "b"]).where("m >= n").select("a", "b"))
        reached = hit if reached is None else reached.union(hit)
    counts = reached.groupBy("a", "b").agg(F.count("*").alias("n_reached"))
    n = F.coalesce("n_reached", F.lit(0))
    return seen.join(counts, ["a", "b"], "left").select("a", "b", "n", n.alias("n_reached"), ((n + 1) / (rounds + 1)).alias("p"))


def numbered(df: DataFrame, order: Column) -> DataFrame:
    """df with place, the rows numbered from 0 in some order, partition by partition."""
    rows = cut(df.withColumn("__o", order).repartitionByRange(F.col("__o"))).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"), F.min("__id").alias("__first")).orderBy("__part").collect()  # one row a partition
    at, offsets = 0, []
    for r in sizes:
        offsets.append((r["__part"], at - r["__first"]))
        at += r["n"]
    table = df.sparkSession.createDataFrame(offsets or [(-1, 0)], "__part int, __shift bigint")
    return rows.join(F.broadcast(table), "__part").withColumn("place", F.col("__id") + F.col("__shift")).drop("__o", "__part", "__id", "__shift")


def network_measures(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, degree, strength), one row (n_nodes, n_edges, density, mean_degree, mean_strength)).

    ``edges`` is (a, b, weight), each pair once.
    """
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), "weight"), F.struct(F.col("b").alias("node"), "weight"))))
    nodes = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    whole = nodes.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.avg("strength").alias("mean_strength"))
    return nodes, whole.select("n_nodes", "n_edges", F.when(n > 1, 2 * m / (n * (n - 1))).alias("density"), "mean_degree", "mean_strength")


def edge_stability(items: DataFrame, rounds: int = 20, least: int = 5, share: float = 0.5, seed: int = 7) -> DataFrame:
    """(a, b, selected): in what part of the rounds a pair occurs ``least`` x share times among half of the rows.

    Every round keeps each row with a chance of ``share`` by a hash of (row, round).
    """
    once = cut(items.where("item is not null").distinct())
    lists = cut(once.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("s")).where(F.size("s") > 1))
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    kept = lambda r: F.pmod(F.xxhash64("row", F.lit(seed), F.lit(r)), F.lit(1 << 20)) < int(share * (1 << 20))
    counts = lists.select(F.inline(pair), *[kept(r).alias(f"k{r}") for r in range(rounds)]).groupBy("a", "b").agg(*[F.count_if(F.col(f"k{r}")).alias(f"n{r}") for r in range(rounds)])
    hits = sum((F.when(F.col(f"n{r}") >= least * share, 1).otherwise(0) for r in range(1, rounds)), F.when(F.col("n0") >= least * share, 1).otherwise(0))
    return counts.select("a", "b", (hits / rounds).alias("selected")).where("selected > 0")
