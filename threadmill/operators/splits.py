"""Leak-checked splits: keys, exclusion reasons, disjointness and stratified replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.joins import lookup
from threadmill.functions.text import canonical_id, combined_text, filled, fingerprint, joined, strip
from threadmill.session import cut


def row_keys(posts: DataFrame) -> DataFrame:
    """posts with id_key 'COUNTRY:canonical' and both fingerprints of each row.

    fp_clean hashes the cleaned text alone (or title and text without one), fp_source
    always title and text: a pair of equal posts is met by either. A supplied fingerprint
    counts as well, in lower case.
    """
    cid = filled(canonical_id(F.col("post_id")))
    return posts.select(
        "*",
        F.concat(F.col("country"), F.lit(":"), cid).alias("id_key"),
        fingerprint(combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text"))).alias("fp_clean"),
        fingerprint(joined(F.col("original_title"), F.col("original_text"))).alias("fp_source"),
        filled(F.lower(strip(F.col("text_fingerprint")))).alias("fp_given"),
    )


def long_keys(keyed: DataFrame, *keep: str) -> DataFrame:
    """(keep..., key_type, key): each row's distinct keys in long form."""
    pairs = F.array_distinct(F.array(F.struct(F.lit("id").alias("key_type"), F.col("id_key").alias("key")), *[F.struct(F.lit("fingerprint").alias("key_type"), F.col(c).alias("key")) for c in ("fp_clean", "fp_source", "fp_given")]))
    return keyed.select(*keep, F.inline(pairs)).where("key is not null")


def exclusion_reasons(pool: DataFrame, protected: DataFrame, row: str) -> DataFrame:
    """(row, reasons): every reason why a pool row must not be used for training.

    ``protected`` is (set_name, key_type, key). All sets meet the pool in one join on
    (key_type, key) instead of one join a set; a row without reason has an empty array.
    Protected keys are made distinct first, so a repeated one can't multiply rows; a key
    that very many pool rows share is spread over salts.
    """
    typed = F.concat_ws(":", "key_type", "key").alias("typed")
    named = protected.where("key is not null").select(typed, F.concat_ws("_", "set_name", "key_type").alias("reason")).distinct()
    keys = cut(long_keys(pool, row).select(row, typed).distinct())
    hits = lookup(keys, named, "typed", [row], "inner").groupBy(row).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return pool.select(row).join(hits, row, "left").select(row, F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def disjointness(members: DataFrame, sample: int = 20) -> DataFrame:
    """(set_a, set_b, key_type, n_shared, examples) for each pair of sets that share keys.

    ``members`` is (set_name, key_type, key). Sets are few, keys many: keys are grouped
    once and their sets paired within the row, so no join of keys with themselves is
    needed. Examples are the ``sample`` smallest keys, kept bounded while aggregating.
    """
    sets = members.where("key is not null").distinct().groupBy("key_type", "key").agg(F.array_sort(F.collect_set("set_name")).alias("s")).where(F.size("s") > 1)
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("set_a"), b.alias("set_b")))))
    pairs = sets.select("key_type", "key", F.inline(pair))
    ranked = pairs.selectExpr("*", "row_number() over (partition by set_a, set_b, key_type order by key) as rn")
    few = ranked.where(F.col("rn") <= sample).groupBy("set_a", "set_b", "key_type").agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return pairs.groupBy("set_a", "set_b", "key_type").agg(F.count("*").alias("n_shared")).join(few, ["set_a", "set_b", "key_type"])


def strata_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Row counts of every stratum, of every single column and overall, in one pass."""
    every = df.groupingSets([[], *[[F.col(c)] for c in columns], [F.col(c) for c in columns]], *[F.col(c) for c in columns])
    return every.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def stratified_replacement(leaked: DataFrame, pool: DataFrame, taken: DataFrame, strata: list[str], key: str, on_missing: str = "error") -> DataFrame:
    """(leaked, strata..., replacement): every leaked row gets a row of its stratum, in order of ``key``.

    A row's replacement is the first candidate of its stratum, by id as text, whose id_key
    and fingerprint neither stand in ``taken`` (key_type, key: what protected or remaining
    evaluation rows hold) nor belong to a replacement of an earlier leaked row of any
    stratum. A row without candidate is an error, or with ``on_missing`` 'null' has none.
    ``leaked`` and ``pool`` are row_keys with ``key`` and the strata; a null stratum is one
    of its own, rows of one key count once and rows without key are left out.

    Rows and candidates of a stratum meet by rank. Where two rows, of one stratum or of
    two, would share an id or a fingerprint, all rows before the first that would repeat an
    earlier one are settled, and what they took is taken from the rest; so a round settles
    everything where nothing repeats.
    """
    by, out = ", ".join(f"s{i}" for i in range(len(strata))), None
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"s{i}") for i, c in enumerate(strata)]
    held = taken.where("key is not null").select("key_type", "key").distinct()
    once = lambda df: df.where(F.col(key).isNotNull()).dropDuplicates([key])
    left = cut(once(leaked).select(F.col(key).alias("leaked"), *named, *[F.col(c).alias(f"__{c}") for c in strata]))
    free = cut(_free(once(pool).select(F.col(key).alias("c"), F.col(key).cast("string").alias("o"), *named, "id_key", F.col("fp_clean").alias("fp")), held))
    while True:
        most = left.groupBy(*[f"s{i}" for i in range(len(strata))]).count().agg(F.max("count")).first()[0] or 0
        ranked = free.selectExpr("*", f"row_number() over (partition by {by} order by o, c) as rn").where(F.col("rn") <= most)
        wanted = left.selectExpr("*", f"row_number() over (partition by {by} order by leaked) as rn")
        got = cut(wanted.join(ranked, [*[f"s{i}" for i in range(len(strata))], "rn"], "left"))
        repeats = [got.where(f"{k} is not null").selectExpr("leaked", f"row_number() over (partition by {k} order by leaked) as nth").where("nth > 1").select("leaked") for k in ("id_key", "fp")]
        first = repeats[0].union(repeats[1]).agg(F.min("leaked")).first()[0]
        settled = got if first is None else got.where(F.col("leaked") < first)
        result = settled.select("leaked", *[F.col(f"__{c}").alias(c) for c in strata], F.col("c").alias("replacement"))
        out = result if out is None else out.union(result)
        if first is None:
            break
        used = settled.select(F.inline(F.array(F.struct(F.lit("id").alias("key_type"), F.col("id_key").alias("key")), F.struct(F.lit("fingerprint").alias("key_type"), F.col("fp").alias("key"))))).where("key is not null")
        left, free = cut(left.where(F.col("leaked") >= first)), cut(_free(free, used))
    if on_missing == "error":
        none = [r[0] for r in out.where("replacement is null").select("leaked").orderBy("leaked").limit(20).collect()]
        if none:
            raise ValueError(f"No replacement candidate for leaked rows {none}")
    return out


def _free(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """Candidates whose id and fingerprint aren't held."""
    for kind, c in (("id", "id_key"), ("fingerprint", "fp")):
        keys = held.where(F.col("key_type") == kind).select(F.col("key").alias(c)).distinct()
        candidates = candidates.join(keys, c, "left_anti")
    return candidates


def length_bands(df: DataFrame, length: str, by: str) -> DataFrame:
    """df with length_band short / medium / long by exact tertile cut points per group.

    Cut points are percentiles computed with partial aggregation and joined back: one row
    per group, so no window runs over a whole country.
    """
    cuts = df.groupBy(by).agg(F.percentile(length, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__q"))
    band = F.when(F.col(length) <= F.col("__q")[0], "short").when(F.col(length) <= F.col("__q")[1], "medium").when(F.col(length).isNotNull(), "long")
    return df.join(cuts, by, "left").withColumn("length_band", band).drop("__q")
