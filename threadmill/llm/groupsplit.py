"""Splits that keep related records together.

Records are related through keys they share: an author, a note, a post. Posts with one
author hang on that author, so only posts shared by several authors make edges, and the
components are found on that small author graph by alternating large-star and small-star
steps, each written to the shared checkpoint folder. Labels are smallest author ids, so a
component's label is its group key.

Components are then assigned to splits by swap search: from a hashed start, whole
components move or are exchanged, under annealing, so that sizes and label counts come
close to their targets; blocks of components anneal in parallel, several replicas each,
and the best replica of each block stays.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.joins import hot_groups, hot_keys, lookup
from threadmill.session import cut

_PAD = r"^[\s\x{a0}\x{3000}\x{200b}\x{feff}]+|[\s\x{a0}\x{3000}\x{200b}\x{feff}]+$"


def author_key(author: Column) -> Column:
    """The 24 hex digits of an author id, lower case; null for values without them."""
    found = F.regexp_extract(F.lower(author), r"(?:^|[^0-9a-f])([0-9a-f]{24})(?![0-9a-f])", 1)
    return F.nullif(found, F.lit(""))


def canonical_post(post: Column) -> Column:
    """A post id without padding and prefix; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(post, _PAD, ""), r"^(?:CHI|JPN|KOR|XHS)_", ""), F.lit(""))


def post_key(country: Column, post: Column) -> Column:
    """'COUNTRY:canonical id', null where either is missing."""
    return F.concat(F.nullif(F.regexp_replace(country, _PAD, ""), F.lit("")), F.lit(":"), canonical_post(post))


def record_keys(notes: DataFrame, posts: DataFrame) -> DataFrame:
    """(tbl, row_id, author, post, label) of every note and source post."""
    return notes.select(
        F.lit("notes").alias("tbl"), F.col("id").alias("row_id"), author_key(F.col("author_id")).alias("author"), post_key(F.lit("CHI"), F.col("note_id")).alias("post"), F.lit("notes").alias("label")
    ).union(
        posts.select(F.lit("source_posts"), F.col("row_id"), F.lit(None).cast("string"), post_key(F.col("country"), F.col("post_id")), F.concat(F.lit("posts:"), F.coalesce("country", F.lit(""))))
    )


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Large-star and small-star steps alternate until the edges no longer change; each step
    is written to the shared checkpoint folder, so a lost executor costs one step. Every
    step halves the distance to the root, so a chain of n nodes takes O(log n) steps. A
    hub's edges meet its minimum under a salt.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        hot = hot_keys(e, "u", "v")
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup(both, least, "u", ["v"], "inner", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, least, "u", ["v"], "inner", hot)
        e = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        state = tuple(now)


def group_records(keys: DataFrame) -> DataFrame:
    """(tbl, row_id, label, group_key) of every record; group_key is null for records without key.

    ``keys`` has tbl, row_id, author, post, label. Authors and posts are pre-aggregated
    before any shuffle, hot ones found in one pass and looked up under a salt.
    """
    keys = cut(keys)
    hot = hot_keys(keys, "author", "post")
    owned = keys.where("author is not null and post is not null").select("post", "author").distinct()
    owner = cut(owned.groupBy("post").agg(F.min("author").alias("first"), F.count("*").alias("n")))
    shared = lookup(owned, owner.where("n > 1").select("post", "first"), "post", ["author"], "inner", hot)
    roots = star_components(shared.select(F.col("author").alias("a"), F.col("first").alias("b")))
    spread = ["tbl", "row_id"]
    lone = lookup(keys.where("author is null").select("tbl", "row_id", "label", "post"), owner.select("post", "first"), "post", spread, hot=hot)
    named = keys.where("author is not null").select("tbl", "row_id", "label", F.col("author").alias("k")).union(lone.select("tbl", "row_id", "label", F.coalesce("first", "post")))
    rooted = lookup(named, roots.select(F.col("node").alias("k"), "root"), "k", spread, hot=hot)
    return rooted.select("tbl", "row_id", "label", F.coalesce("root", "k").alias("group_key"))


def related_records(keys: DataFrame, shares: Mapping[str, float] | None = None) -> DataFrame:
    """(tbl, row_id, group_key) of the records that belong to a group of at least two.

    They are read off the assigned records: the groups are those the splits keep whole.

    Defined results: records without any key are in no group; a repeated record is two
    rows of its group; null ids are kept; empty tables give an empty result.
    """
    return assigned_records(keys, shares or SHARES).where("keyed and n_rows > 1").select("tbl", "row_id", "group_key")


# ---------------------------------------------------------------- assignment
def _cost(s: np.ndarray, t: np.ndarray) -> float:
    return float((((s - t) ** 2) / np.maximum(t.sum(0), 1)).sum())


def hashed_start(place: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The split of each component by its hashed place in [0, 1) and the splits' shares."""
    share = np.maximum(target[:, 0], 1e-9)
    return np.minimum(np.searchsorted(np.cumsum(share / share.sum()), place, "right"), len(target) - 1)


def anneal(sizes: np.ndarray, target: np.ndarray, place: np.ndarray, seed: int, moves: int) -> tuple[np.ndarray, float]:
    """Assign components to splits: sizes (n, d) of each in rows and labels, target (k, d).

    The start is the hashed assignment of ``place``; the same input in the same order
    gives the same result.
    """
    rng = np.random.default_rng(seed)
    n, k = len(sizes), len(target)
    at = hashed_start(place, target)
    s = np.zeros_like(target)
    np.add.at(s, at, sizes)
    weight = 1 / np.maximum(target.sum(0), 1)
    cost = best = _cost(s, target)
    kept = at.copy()
    heat = max(cost / 50, 1e-9)
    picks, others, draws = rng.integers(0, n, (moves, 2)), rng.integers(1, max(k, 2), moves), rng.random((moves, 2))
    for m in range(moves):
        i, j = picks[m]
        p = at[i]
        if draws[m, 0] < 0.5 and at[j] != p:  # exchange
            q, change = at[j], sizes[j] - sizes[i]
        elif k > 1:  # move
            j, q, change = -1, (p + others[m]) % k, -sizes[i]
        else:
            break
        dp, dq = s[p] - target[p], s[q] - target[q]
        delta = float(((2 * (dp - dq) * change + 2 * change**2) * weight).sum())
        if delta < 0 or draws[m, 1] < math.exp(-delta / heat):
            s[p] += change
            s[q] -= change
            at[i] = q
            if j >= 0:
                at[j] = p
            cost += delta
            if cost < best and m >= moves // 2 and m % 32 == 0:
                best, kept = cost, at.copy()
        heat *= 1 - 6 / moves
    return (at, cost) if cost <= best else (kept, best)


#: Default proportions.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
_BLOCK = 20_000
#: The most frequent labels count each by itself, all others in so many hashed buckets.
_MAX_LABELS = 64
_LABEL_BUCKETS = 64


def assign_components(groups: DataFrame, shares: Mapping[str, float], seed: int = 7, replicas: int = 4, moves_each: float = 2.0, least_moves: int = 20_000) -> DataFrame:
    """(group_key, split, n_rows) for every component of ``groups`` (group_key, label).

    ``shares`` are the splits' proportions, summing to 1. Every component starts where the
    hash of its key puts it. Components of more than a hundredth of the rows are at most a
    hundred; the driver anneals these first. The others are hashed into blocks of about
    20,000, each annealed by itself towards what the large ones leave, in ``replicas``
    copies of ``moves_each`` steps a component (``least_moves`` at least), of which the
    best stays. A block is annealed in the order of its keys, so neither the order nor the
    partitioning of the rows matters.

    The 64 most frequent labels are balanced each by itself; the others are hashed into 64
    buckets, and what is balanced of these is the rows of each bucket.
    """
    total = groups.count()
    label = F.coalesce("label", F.lit(""))
    labels = [r[0] for r in groups.groupBy(label.alias("label")).count().orderBy(F.desc("count"), "label").limit(_MAX_LABELS + 1).collect()]
    rarer, labels = len(labels) > _MAX_LABELS, labels[:_MAX_LABELS]
    columns = [label == x for x in labels]
    if rarer:
        bucket = F.when(~label.isin(labels), F.pmod(F.xxhash64(label), F.lit(_LABEL_BUCKETS)))
        columns += [F.coalesce(bucket == b, F.lit(False)) for b in range(_LABEL_BUCKETS)]
    counts = [F.sum(c.cast("int")).cast("double") for c in columns]
    place = (F.pmod(F.xxhash64("group_key", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("place")
    parts = cut(groups.groupBy("group_key").agg(F.array(F.count("*").cast("double"), *counts).alias("v")).select("group_key", "v", place))
    names, share = list(shares), np.array(list(shares.values()), float)[:, None]
    whole = np.array(parts.agg(F.array(*[F.sum(F.col("v")[i]) for i in range(len(counts) + 1)])).first()[0] or [0.0] * (len(counts) + 1), float)
    whole = np.nan_to_num(np.array([x or 0.0 for x in whole]))
    big = parts.where(F.col("v")[0] > max(total / 100, 1)).toPandas().sort_values("group_key")  # at most 100 rows
    left = share * whole[None, :]
    steps = lambda n: max(least_moves, int(moves_each * n))

    def search(rows: pd.DataFrame, target: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        sizes, place = np.stack(rows["v"].to_numpy()).astype(float), rows["place"].to_numpy()
        at, _ = min((anneal(sizes, target, place, first + r, steps(len(rows))) for r in range(replicas)), key=lambda x: x[1])
        return sizes, at

    chosen: list[tuple[str, str, int]] = []
    if len(big):
        sizes, at = search(big, left, seed)
        np.subtract.at(left, at, sizes)
        chosen = [(k, names[a], int(v[0])) for k, a, v in zip(big["group_key"], at, sizes)]
    left = np.maximum(left, 0)
    ratio = left / np.maximum(left.sum(0, keepdims=True), 1e-9)
    small = parts.where(F.col("v")[0] <= max(total / 100, 1))
    blocks = max(1, math.ceil(small.count() / _BLOCK))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_key")
        sizes = np.stack(pdf["v"].to_numpy()).astype(float)
        _, at = search(pdf, ratio * sizes.sum(0)[None, :], seed + 1000 * (1 + int(pdf["b"].iloc[0])))
        return pd.DataFrame({"group_key": pdf["group_key"], "split": [names[a] for a in at], "n_rows": sizes[:, 0].astype(np.int64)})

    schema = "group_key string, split string, n_rows bigint"
    done = small.withColumn("b", F.pmod(F.xxhash64("group_key"), F.lit(blocks))).groupBy("b").applyInPandas(block, schema)
    large = groups.sparkSession.createDataFrame(chosen, schema)
    return done.union(large)


def assigned_records(keys: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """(tbl, row_id, label, keyed, group_key, n_rows, split) for every record.

    Related records have one group_key and one split; n_rows is the number of records with
    it. A record without any key (keyed is false) is a component by itself.
    """
    groups = group_records(keys)
    own = F.concat_ws("#", F.lit(""), "tbl", F.coalesce(F.col("row_id").cast("string"), F.lit("")))
    labelled = cut(groups.select("tbl", "row_id", "label", F.col("group_key").isNotNull().alias("keyed"), F.coalesce("group_key", own).alias("group_key")))
    assigned = cut(assign_components(labelled, shares))
    return lookup(labelled, assigned, "group_key", ["tbl", "row_id"], "inner", hot_groups(assigned, "group_key", "n_rows")).select("tbl", "row_id", "label", "keyed", "group_key", "n_rows", "split")


def split_records(keys: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """(tbl, row_id, split) for every record, related records in one split.

    A record without key is its own component. The splits follow from the keys, labels and
    the seed alone: a repeated run gives the same, in whatever order the rows come.
    """
    return assigned_records(keys, shares).select("tbl", "row_id", "split")


def split_report(assigned: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """(split, label, n_rows, n_label, target): the rows of each label in each split of ``assigned_records``."""
    splits = assigned.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "split string, target double")
    counts = assigned.groupBy("split", "label").agg(F.count("*").alias("n_rows"))
    whole = counts.groupBy("label").agg(F.sum("n_rows").alias("n_label"))
    every = whole.join(F.broadcast(splits), how="cross").select("split", "label", "n_label", "target")
    return every.join(counts, ["split", "label"], "left").select("split", "label", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_label", "target")
