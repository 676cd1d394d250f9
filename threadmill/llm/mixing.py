"""Mixing sources to target weights.

Documents are hashed into blocks of about equal size within their source. A source's
target is met by whole passes over it and part of a last one: whole blocks in a permuted
order, then documents of one more block. How many block draws of every source each
output shard receives is decided by a splitting tree: the shards are halved again and
again, and at each node the blocks that go left are one multivariate-hypergeometric draw,
so quotas are exact and every split is as if all blocks had been shuffled. Shards then
take disjoint runs of each source's permuted blocks and shuffle their documents locally.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.session import cut

#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; 0 for null and empty texts.

    ``tokenizer`` is a rank file the driver can read; it travels to the workers with the job.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = _encoding(SparkFiles.get(name))
            n = [len(enc.encode_ordinary(s)) if s else 0 for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, shard, count) of the counts above 0: exact quotas, split by multivariate-hypergeometric draws.

    A node of the tree only knows the sources that reach it, so the work and the result
    grow with the blocks drawn and not with sources x shards.
    """
    rng = np.random.default_rng(seed)
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    open_ = [(np.flatnonzero(quotas), quotas[np.flatnonzero(quotas)].astype(np.int64), 0, shards)]
    while open_:
        who, have, first, last = open_.pop()
        if not len(who):
            continue
        if last - first == 1:
            out.append((who, first, have))
            continue
        middle = (first + last) // 2
        # Shards are filled as evenly as whole blocks allow.
        goes = int(have.sum()) * (middle - first) // (last - first)
        left = rng.multivariate_hypergeometric(have, goes, method="marginals")
        for part, x, y in ((have - left, middle, last), (left, first, middle)):
            open_.append((who[part > 0], part[part > 0], x, y))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *x]) for x in ([w for w, _, _ in out], [np.full(len(w), k) for w, k, _ in out], [c for _, _, c in out]))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, shards: int | None = None, block_tokens: int = 50_000, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """(shard, position, source, doc_id, copy, n_tokens): the combined corpus.

    ``targets`` is (source, target_share, max_repeats). ``total_tokens`` defaults to the
    tokens of all documents that have a target. A source takes its share of the total, at most max_repeats
    times its own tokens; what it lacks is not given to others, so the report shows it.

    Without ``shards`` there is one for every 200 million tokens, 16 at least. Blocks have
    ``block_tokens`` tokens or a millionth of the corpus and of the total, whichever is more.

    The block table (one row per source and block, a million rows at most and one more a
    source) is the only thing that meets a window over a source; documents are windowed
    within their block. The driver sees one row per source and computes the runs of block
    draws of every shard, of which there are no more than draws; blocks meet their shard by
    the number of the draw.

    Defined results: documents of a source without target, of null source, null id or
    without tokens are not used; a target without documents gives nothing; several target
    rows of one source count once, the largest share first; equal documents each count;
    empty tables give an empty result; other columns aren't read.
    """
    spark = documents.sparkSession
    sized = token_counts(documents.where("doc_id is not null and source is not null"), tokenizer).where("n_tokens > 0")
    goals = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), "target_share").alias("g"))
    sized = cut(sized.join(F.broadcast(goals.select("source")), "source", "left_semi") if _few(goals) else sized.join(goals.select("source"), "source", "left_semi"))
    whole = sized.agg(F.sum("n_tokens")).first()[0] or 0
    total = total_tokens if total_tokens is not None else whole
    shards = shards or max(16, -(-total // 200_000_000))
    block_tokens = max(block_tokens, whole // 1_000_000, int(total) // 1_000_000)
    have = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).join(goals, "source").select("source", "t").collect()}
    wanted = {r["source"]: (r["g"]["target_share"], r["g"]["max_repeats"]) for r in goals.collect()}
    plan = []
    for s in sorted(have):
        share, most = wanted[s]
        need = min(share * total, have[s] * most)
        passes = int(need // have[s])
        plan.append((s, max(1, -(-have[s] // block_tokens)), passes, float(need - passes * have[s])))
    schema = "source string, blocks bigint, passes int, rest double"
    planned = spark.createDataFrame(plan, schema)
    # Documents -> blocks of their source, blocks in a permuted order.
    placed = sized.join(F.broadcast(planned), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    blocks = placed.groupBy("source", "block", "passes", "rest").agg(F.sum("n_tokens").alias("t"))
    blocks = cut(blocks.selectExpr("*", f"row_number() over (partition by source order by xxhash64(block, {seed}), block) - 1 as nr", f"sum(t) over (partition by source order by xxhash64(block, {seed}), block) - t as before"))
    # Draws: every block once a pass, and in the last pass the blocks that begin before the rest ends.
    draws = blocks.select("source", "block", "nr", "before", "rest", "passes", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("copy")).where("copy < passes or before < rest")
    order = draws.selectExpr("*", f"row_number() over (partition by source order by xxhash64(block, copy, {seed + 1}), block, copy) - 1 as draw")
    order = cut(order)
    quotas = {r["source"]: r["n"] for r in order.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = sorted(quotas)
    who, shard, count = splitting_tree(np.array([quotas[s] for s in names], np.int64), shards, seed)
    by_source = np.lexsort((shard, who))
    who, shard, count = who[by_source], shard[by_source], count[by_source]
    first = np.cumsum(count) - count
    if len(who):
        first -= np.repeat(first[np.flatnonzero(np.diff(who, prepend=-1))], np.unique(who, return_counts=True)[1])
    runs = spark.createDataFrame(pa.table({"source": pa.array([names[k] for k in who], pa.string()), "shard": pa.array(shard, pa.int32()), "first": pa.array(first, pa.int64()), "count": pa.array(count, pa.int64())}))
    drawn = runs.select("source", "shard", F.explode(F.expr("sequence(first, first + count - 1)")).alias("draw"))
    assigned = order.join(drawn, ["source", "draw"])
    assigned = assigned.select("source", "block", "copy", "shard", (F.col("copy") == F.col("passes")).alias("partial"), (F.col("rest") - F.col("before")).alias("room"))
    members = placed.select("source", "block", "doc_id", "n_tokens").selectExpr("*", f"sum(n_tokens) over (partition by source, block order by xxhash64(doc_id, {seed + 2}), doc_id rows unbounded preceding) as upto")
    chosen = members.join(assigned, ["source", "block"]).where("not partial or upto - n_tokens < room")
    # A document is taken while the rest isn't full, the last one only if it comes nearer.
    chosen = chosen.where("not partial or upto <= room or upto - room <= room - (upto - n_tokens)")
    return chosen.selectExpr("shard", f"row_number() over (partition by shard order by xxhash64(doc_id, copy, {seed + 3}), doc_id, copy) as position", "source", "doc_id", "copy", "n_tokens")


def _few(goals: DataFrame, bound: int = 100_000) -> bool:
    """Whether a table has at most ``bound`` rows, and may be broadcast."""
    return goals.limit(bound + 1).count() <= bound


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, most_uses) per target."""
    used = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.sum("t").alias("t"), F.count("*").alias("d"), F.max("uses").alias("u"))
    every = used.agg(F.sum("t").alias("all"))
    return (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"))
        .join(used, "source", "left")
        .join(F.broadcast(every), how="cross")
        .select("source", "target_share", F.round(F.coalesce(F.col("t") / F.col("all"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("t", F.lit(0)).alias("n_tokens"), F.coalesce("d", F.lit(0)).alias("n_documents"), F.coalesce("u", F.lit(0)).alias("most_uses"))
    )


def mix_limits(mixed: DataFrame, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, has_documents, within_repeats, share_met) of every target: whether a default mix keeps its limits."""
    have = token_counts(documents.where("doc_id is not null and source is not null"), tokenizer).where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("longest"))
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    both = cut(goals.join(have, "source", "left"))
    used = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.sum("t").alias("t"), F.max("uses").alias("uses"))
    total = both.where("share > 0 and most > 0").agg(F.sum("have").alias("total"))
    limits = both.join(F.broadcast(total), how="cross").join(used, "source", "left")
    met = F.expr("abs(coalesce(t, 0) - least(share * total, coalesce(have, 0) * most)) <= coalesce(longest, 0)")
    return limits.select("source", F.col("have").isNotNull().alias("has_documents"), F.expr("coalesce(uses, 0) <= most").alias("within_repeats"), met.alias("share_met"))
