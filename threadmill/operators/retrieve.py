"""Example retrieval: lexical and dense top-k, and a diverse few-shot pick."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.joins import lookup
from threadmill.functions.text import words
from threadmill.session import cut


def token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, token): each distinct word of a text with the number of distinct words."""
    sets = df.select(key, F.array_distinct(words(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    return sets.select(key, F.size("t").alias("n"), F.explode_outer("t").alias("token"))


def lexical_topk(queries: DataFrame, gold: DataFrame, k: int = 5, same_language: float = 0.15, same_country: float = 0.05) -> DataFrame:
    """(qid, gid, score, rank): overlap of word sets plus bonuses, ties by language, country, gid.

    Both sides are (id, text, language, country). The overlaps come from an inverted index:
    words meet words, so work follows shared words. Texts without a shared word score their
    bonus only; of those a query can need at most the first k of a (language, country) that
    don't overlap, so no query meets the whole gold side.
    """
    q = token_sets(queries.withColumnRenamed("id", "qid"), "qid", "text").withColumnRenamed("n", "nq")
    g = token_sets(gold.withColumnRenamed("id", "gid"), "gid", "text").withColumnRenamed("n", "ng")
    # A word that very many examples hold is spread over salts, the queries with it repeated.
    both = lookup(g, q, "token", ["gid"], "inner").groupBy("qid", "gid", "nq", "ng").agg(F.count("*").alias("common"))
    overlap = both.select("qid", "gid", (F.col("common") / (F.col("nq") + F.col("ng") - F.col("common"))).alias("overlap"))
    about_q = queries.select(F.col("id").alias("qid"), F.col("language").alias("ql"), F.col("country").alias("qc"))
    about_g = gold.select(F.col("id").alias("gid"), F.col("language").alias("gl"), F.col("country").alias("gc"))
    met = overlap.join(about_q, "qid").join(about_g, "gid")
    first = about_g.selectExpr("*", "row_number() over (partition by gl, gc order by gid) as rn")
    # A class of n examples that overlap with the query needs its n + k first at most.
    classes = about_g.select("gl", "gc").distinct()
    n_met = met.groupBy("qid", "gl", "gc").agg(F.count("*").alias("met"))
    slots = about_q.join(F.broadcast(classes), how="cross").withColumn("__l", F.coalesce("gl", F.lit(""))).withColumn("__c", F.coalesce("gc", F.lit("")))
    n_met = n_met.select("qid", F.coalesce("gl", F.lit("")).alias("__l"), F.coalesce("gc", F.lit("")).alias("__c"), "met")
    slots = slots.join(n_met, ["qid", "__l", "__c"], "left").select("qid", "ql", "qc", "__l", "__c", F.explode(F.sequence(F.lit(1), (F.coalesce("met", F.lit(0)) + k).cast("int"))).alias("rn"))
    spare = slots.join(first.withColumn("__l", F.coalesce("gl", F.lit(""))).withColumn("__c", F.coalesce("gc", F.lit(""))), ["__l", "__c", "rn"])
    spare = spare.join(overlap.select("qid", "gid"), ["qid", "gid"], "left_anti").withColumn("overlap", F.lit(0.0))
    cols = ["qid", "gid", "overlap", "ql", "qc", "gl", "gc"]
    rows = met.select(cols).union(spare.select(cols))
    lang, country = F.coalesce(F.col("ql") == F.col("gl"), F.lit(False)), F.coalesce(F.col("qc") == F.col("gc"), F.lit(False))
    scored = rows.select("qid", "gid", (F.col("overlap") + F.when(lang, same_language).otherwise(0.0) + F.when(country, same_country).otherwise(0.0)).alias("score"), lang.cast("int").alias("l"), country.cast("int").alias("c"))
    return scored.selectExpr("qid", "gid", "score", "row_number() over (partition by qid order by score desc, l desc, c desc, gid) as rank").where(F.col("rank") <= k)


#: Bytes of query vectors in one broadcast block of dense_topk.
BLOCK_BYTES = 64 << 20


def dense_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, digits: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, id, score, rank): the k vectors of largest dot product for each query vector.

    ``queries`` are hashed by key into blocks of about ``block_bytes``; each block is
    broadcast against all vectors, and each task keeps its own k best of a query before the
    shuffle (a row-number limit is pushed below it). Of several blocks each is finished
    before the next is broadcast, so one is held at a time. Scores are rounded, ties go to
    the smaller id.
    """
    q = queries.select(F.col(key).alias("qid"), F.col(vector).alias("__q"))
    dot = F.aggregate(F.zip_with(F.col(vector), F.col("__q"), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    # An array element takes 8 bytes at most, a row about 64 besides.
    size = q.agg(F.sum(F.coalesce(F.size("__q"), F.lit(0)) * F.lit(8) + F.lit(64))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def nearest(q: DataFrame) -> DataFrame:
        pairs = vectors.select(F.col(key).alias("id"), vector).join(F.broadcast(q), F.col("id") != F.col("qid"))
        scored = pairs.select("qid", "id", F.round(dot, digits).alias("score"))
        return scored.selectExpr("qid", "id", "score", "row_number() over (partition by qid order by score desc, id) as rank").where(F.col("rank") <= k)

    if blocks == 1:
        return nearest(q)
    return reduce(DataFrame.union, [cut(nearest(q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b))) for b in range(blocks)])


def fewshot_pick(queries: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """(qid, gid, rank): k examples per query, own language first, label pairs spread first.

    Sides are (id, country, canonical, language) and, for gold, (label_a, label_b). The
    query's own post is left out. Within a pool the first row of every label pair comes
    before the rest, in id order. Queries of one language and country see the same order,
    so candidates are kept per language on the gold side and the query's own post is
    removed afterwards. A post may have any number of gold rows: of each label pair the
    first row of the two earliest posts is kept, and the first 2k of all rows when each
    post counts with its first k, so that whatever post drops out, k and every pair's
    first remain.
    """
    classes = queries.select("language").distinct().withColumnRenamed("language", "ql")
    g = gold.select(F.col("id").alias("gid"), F.col("country").alias("gc"), F.col("canonical").alias("gk"), F.col("language").alias("gl"), "label_a", "label_b")
    pooled = F.broadcast(classes).join(g, how="cross").withColumn("pool", F.when(F.coalesce(F.col("ql") == F.col("gl"), F.lit(False)), 0).otherwise(1))
    firsts = pooled.selectExpr("*", "row_number() over (partition by ql, label_a, label_b, gc, gk order by pool, gid) as r").where(F.col("r") == 1)
    firsts = firsts.selectExpr("* except (r)", "row_number() over (partition by ql, label_a, label_b order by pool, gid) as r").where(F.col("r") <= 2)
    rest = pooled.selectExpr("*", "row_number() over (partition by ql, gc, gk order by pool, gid) as r").where(F.col("r") <= k)
    rest = rest.selectExpr("* except (r)", "row_number() over (partition by ql order by pool, gid) as r").where(F.col("r") <= 2 * k)
    # A row in both counts once, rows that are equal in all columns as often as they are there.
    both = firsts.withColumn("of", F.lit(0)).union(rest.withColumn("of", F.lit(1))).drop("r")
    short = both.selectExpr("*", f"row_number() over (partition by {', '.join(both.columns)} order by gid) as same").drop("of").distinct()
    q = queries.select(F.col("id").alias("qid"), F.col("country").alias("qc"), F.col("canonical").alias("qk"), F.col("language").alias("ql"))
    cand = q.join(short.drop("same").withColumnRenamed("ql", "cl"), F.col("ql").eqNullSafe(F.col("cl"))).where("not (qc <=> gc and qk <=> gk)")
    first = cand.selectExpr("*", "row_number() over (partition by qid, label_a, label_b order by pool, gid) as nth")
    return first.selectExpr("qid", "gid", "row_number() over (partition by qid order by pool, case when nth = 1 then 0 else 1 end, gid) as rank").where(F.col("rank") <= k)


def rerank(candidates: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """(qid, gid, score, rank): the first 3k candidates by rank, reordered by a second score.

    ``scores`` is (qid, gid, rerank_score), of any pairs. A pair without a finite score
    keeps its place behind those that have one.
    """
    pool = candidates.where(F.col("rank") <= 3 * k).join(scores, ["qid", "gid"], "left")
    s = F.when(~F.isnan("rerank_score") & (F.abs("rerank_score") != float("inf")), F.col("rerank_score"))
    return pool.withColumn("rerank_score", s).selectExpr("qid", "gid", "score", "row_number() over (partition by qid order by rerank_score desc nulls last, rank, gid) as rank").where(F.col("rank") <= k)


def with_fallback(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """(qid, gid, score, rank): the dense results of every query that has any, else its lexical ones.

    A query without a vector, or whose vector meets none, has no dense result. Both sides
    are (qid, gid, score, rank).
    """
    names = ["qid", "gid", "score", "rank"]
    served = dense.select("qid").distinct()
    return dense.select(*names).union(lexical.join(served, "qid", "left_anti").select(*names))


def trace_rows(found: DataFrame, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """(post_id, rank, score, gold columns): one row for each retrieved example (qid, gid, rank, score).

    ``queries`` is (qid, post_id), ``gold`` (gid, post_id, country, language and labels);
    a score that isn't finite is null, a missing label ''.
    """
    score = F.when(~F.isnan("score") & (F.abs("score") != float("inf")), F.col("score"))
    labels = [F.coalesce(c, F.lit("")).alias(f"gold_{c}") for c in ("experiencer_label", "content_function")]
    about = gold.select("gid", *[F.col(c).alias(f"gold_{c}") for c in ("post_id", "country", "language")], *labels)
    return found.join(queries, "qid").join(about, "gid").select("post_id", "rank", score.alias("score"), *[f"gold_{c}" for c in ("post_id", "country", "language", "experiencer_label", "content_function")])
