"""Queries on posts, splits, notes, ledgers and labels, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.text import canonical_id, combined_text, cue_count, digits_as_count, distinct_tags, marks, note_id_of, occurrences, page_type
from threadmill.operators import clean, metrics, notes as store, retrieve, splits
from threadmill.session import cut, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Fixed values in SQL form: the white space that strip() removes.
_W = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def _joined(t: str, x: str) -> str:
    return _strip(f"concat_ws(chr(10), nullif({_strip(t)}, ''), nullif({_strip(x)}, ''))")


def _combined() -> str:
    return f"coalesce(nullif({_strip('text_clean')}, ''), {_joined('original_title', 'original_text')})"


_CANON = f"regexp_replace({_strip('post_id')}, '^(CHI|JPN|KOR|XHS)_', '')"
_KEYED = f"""keyed as (select row_id, country, source_file, country || ':' || nullif({_CANON}, '') as id_key,
    case when {_combined()} <> '' then sha256({_combined()}) end as fp_clean, case when {_joined('original_title', 'original_text')} <> '' then sha256({_joined('original_title', 'original_text')}) end as fp_source,
    nullif(lower({_strip('text_fingerprint')}), '') as fp_given from source_posts),
    lk as (select distinct row_id, key_type, key from (select row_id, 'id' as key_type, id_key as key from keyed union all select row_id, 'fingerprint', fp_clean from keyed
    union all select row_id, 'fingerprint', fp_source from keyed union all select row_id, 'fingerprint', fp_given from keyed) where key is not null)"""
_LISTED = f"""listed as (select distinct p.row_id, m.split from project_split_manifest m join source_posts p on p.country = m.country and {_strip('p.post_id')} = {_strip('m.post_id')} where m.split is not null)"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_posts")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, split): the source rows of every manifest entry."""
    key = lambda df: F.concat(df["country"], F.lit(":"), splits.strip(df["post_id"]))
    m, p = table(spark, d, "project_split_manifest"), _posts(spark, d)
    m = m.where("split is not null").select(key(m).alias("k"), "split")
    return p.select(key(p).alias("k"), "row_id").join(m, "k").select("row_id", "split").distinct()


@query(f"select row_id, {_CANON} as canonical, country || ':' || nullif({_CANON}, '') as id_key from source_posts")
def canonical_ids(spark, d):
    """Canonical ids and keys of all posts."""
    cid = canonical_id(F.col("post_id"))
    return _posts(spark, d).select("row_id", cid.alias("canonical"), F.concat("country", F.lit(":"), F.nullif(cid, F.lit(""))).alias("id_key"))


@query(f"select row_id, {_combined()} as text, length({_combined()}) as n_chars from source_posts")
def combined_texts(spark, d):
    """The text each post stands for, with its length in characters."""
    t = combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text"))
    return _posts(spark, d).select("row_id", t.alias("text"), F.length(t).cast("bigint").alias("n_chars"))


@query(f"with {_KEYED} select case when fp_given is null then 'missing' when fp_given in (fp_clean, fp_source) then 'current' else 'stale' end as state, count(*) as n from keyed group by 1")
def fingerprint_states(spark, d):
    """How many supplied fingerprints are missing, current or stale."""
    k = splits.row_keys(_posts(spark, d))
    fresh = F.coalesce(F.col("fp_given") == F.col("fp_clean"), F.lit(False)) | F.coalesce(F.col("fp_given") == F.col("fp_source"), F.lit(False))
    return k.groupBy(F.when(F.col("fp_given").isNull(), "missing").when(fresh, "current").otherwise("stale").alias("state")).agg(F.count("*").alias("n"))


def _protected(spark, d) -> DataFrame:
    keys = splits.long_keys(splits.row_keys(_posts(spark, d)), "row_id")
    return keys.join(_listed(spark, d).where("split <> 'main'"), "row_id").select(F.col("split").alias("set_name"), "key_type", "key").distinct()


_REASONS = f"""with {_KEYED}, {_LISTED}, prot as (select distinct listed.split || '_' || key_type as reason, key_type, key from lk join listed using (row_id) where split <> 'main')"""


@query(f"{_REASONS} select reason, count(distinct lk.row_id) as n from lk join prot using (key_type, key) group by 1")
def exclusion_reason_counts(spark, d):
    """Rows of the pool by each reason that keeps them out of training."""
    r = splits.exclusion_reasons(splits.row_keys(_posts(spark, d)), _protected(spark, d), "row_id")
    return r.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"{_REASONS} select source_file, count(*) as n from source_posts where row_id not in (select lk.row_id from lk join prot using (key_type, key)) group by 1")
def clean_pool_by_file(spark, d):
    """Rows without any reason to be excluded, per source file."""
    p = _posts(spark, d)
    r = splits.exclusion_reasons(splits.row_keys(p), _protected(spark, d), "row_id").where(F.size("reasons") == 0)
    return p.join(r, "row_id", "left_semi").groupBy("source_file").agg(F.count("*").alias("n"))


@query(
    f"""with {_KEYED}, {_LISTED}, mem as (select distinct split, key_type, key from lk join listed using (row_id)),
    pr as (select a.split as set_a, b.split as set_b, key_type, key, row_number() over (partition by a.split, b.split, key_type order by key) as rn from mem a join mem b using (key_type, key) where a.split < b.split)
    select set_a, set_b, key_type, count(*) as n_shared, string_agg(key, ',' order by key) filter (rn <= 20) as examples from pr group by all"""
)
def disjointness_audit(spark, d):
    """Keys that pairs of splits share, with the smallest 20."""
    keys = splits.long_keys(splits.row_keys(_posts(spark, d)), "row_id").join(_listed(spark, d), "row_id").select(F.col("split").alias("set_name"), "key_type", "key")
    return splits.disjointness(keys).withColumn("examples", F.array_join("examples", ","))


_SHARED = f"""with {_KEYED}, {_LISTED}, mk as (select distinct key_type, key from lk join listed using (row_id) where split = 'main'), ev as (select distinct row_id from listed where split <> 'main'),
    hit as (select distinct row_id from lk join mk using (key_type, key) where row_id in (select row_id from ev))"""


def _shared_keys(spark, d) -> tuple[DataFrame, DataFrame]:
    """(evaluation rows, those that share a key with a training row)."""
    keys, l = splits.long_keys(splits.row_keys(_posts(spark, d)), "row_id"), _listed(spark, d)
    ev = l.where("split <> 'main'").select("row_id").distinct()
    train = keys.join(l.where("split = 'main'"), "row_id", "left_semi").select("key_type", "key").distinct()
    return ev, keys.join(ev, "row_id", "left_semi").join(train, ["key_type", "key"], "left_semi").select("row_id").distinct()


@query(f"{_SHARED} select row_id from hit")
def holdout_semi(spark, d):
    """Evaluation rows that share an id or a fingerprint with a training row."""
    return _shared_keys(spark, d)[1]


@query(f"{_SHARED} select row_id from ev where row_id not in (select row_id from hit)")
def holdout_anti(spark, d):
    """Evaluation rows that share none."""
    ev, hit = _shared_keys(spark, d)
    return ev.join(hit, "row_id", "left_anti")


@query("select country, length_band, count(*) as n, cast(grouping(country, length_band) as bigint) as level from source_posts group by grouping sets ((), (country), (length_band), (country, length_band))")
def strata(spark, d):
    """Row counts by country, by length band, by both and overall."""
    return splits.strata_counts(_posts(spark, d), "country", "length_band").withColumn("level", F.col("level").cast("bigint"))


_REPLACED = f"""with recursive {_KEYED}, {_LISTED},
    k as (select row_id, p.country, length_band, id_key, coalesce(fp_given, fp_clean) as fp from keyed join source_posts p using (row_id)),
    gold as (select * from k where row_id in (select row_id from listed where split in ('classification_gold', 'csm_gold'))), ev as (select * from k where row_id in (select row_id from listed where split = 'eval_holdout')),
    bad as (select * from ev where id_key in (select id_key from gold) or fp in (select fp from gold)), leaked as (select *, row_number() over (order by row_id) as n from bad),
    held as (select id_key, fp from gold union all select id_key, fp from ev where row_id not in (select row_id from bad)),
    cand as (select * from k where row_id in (select row_id from listed where split = 'main') and not exists (select 1 from held h where h.id_key = k.id_key) and not exists (select 1 from held h where h.fp = k.fp)),
    step as (select 0::bigint as n, []::varchar[] as ids, []::varchar[] as fps, null::bigint as pick
        union all select s.n + 1, list_append(any_value(s.ids), min(struct_pack(o := cast(c.row_id as varchar), r := c.row_id, i := c.id_key, f := c.fp)).i), list_append(any_value(s.fps), min(struct_pack(o := cast(c.row_id as varchar), r := c.row_id, i := c.id_key, f := c.fp)).f),
            min(struct_pack(o := cast(c.row_id as varchar), r := c.row_id, i := c.id_key, f := c.fp)).r
        from step s join leaked l on l.n = s.n + 1 left join cand c on c.country is not distinct from l.country and c.length_band is not distinct from l.length_band and not coalesce(list_contains(s.ids, c.id_key), false) and not coalesce(list_contains(s.fps, c.fp), false) group by s.n)"""


@query(f"{_REPLACED} select l.row_id as leaked, l.country, l.length_band, step.pick as replacement from leaked l join step using (n)")
def stratified_replacements(spark, d):
    """For every holdout row that leaked into the gold sets, the training row that replaces it in its stratum."""
    k, l = splits.row_keys(_posts(spark, d)).withColumn("fp_clean", F.coalesce("fp_given", "fp_clean")), _listed(spark, d)
    of = lambda *names: k.join(l.where(F.col("split").isin(*names)), "row_id", "left_semi")
    keys = lambda df: df.select("row_id", F.inline(F.array(F.struct(F.lit("id").alias("key_type"), F.col("id_key").alias("key")), F.struct(F.lit("fingerprint").alias("key_type"), F.col("fp_clean").alias("key"))))).where("key is not null")
    gold, ev = keys(of("classification_gold", "csm_gold")).select("key_type", "key").distinct(), of("eval_holdout")
    bad = cut(keys(ev).join(gold, ["key_type", "key"], "left_semi").select("row_id").distinct())
    taken = gold.union(keys(ev.join(bad, "row_id", "left_anti")).select("key_type", "key"))
    return splits.stratified_replacement(ev.join(bad, "row_id", "left_semi"), of("main"), taken, ["country", "length_band"], "row_id", on_missing="null")


@query(
    """with c as (select country, quantile_cont(text_length_chars, 1.0/3) as a, quantile_cont(text_length_chars, 2.0/3) as b from source_posts group by 1)
    select country, case when text_length_chars <= a then 'short' when text_length_chars <= b then 'medium' when text_length_chars is not null then 'long' end as length_band, count(*) as n
    from source_posts left join c using (country) group by all"""
)
def length_tertiles(spark, d):
    """Posts per country and exact length tertile."""
    return splits.length_bands(_posts(spark, d).drop("length_band"), "text_length_chars", "country").groupBy("country", "length_band").agg(F.count("*").alias("n"))


def _gold(spark, d) -> DataFrame:
    return _posts(spark, d).join(_listed(spark, d).where("split in ('classification_gold', 'csm_gold')"), "row_id", "left_semi")


_TOKENS = f"list_distinct(regexp_extract_all(lower(coalesce({_combined()}, '')), '([\\p{{L}}\\p{{N}}_]+)', 1))"


@query(
    f"""with {_LISTED}, p as (select row_id as id, country, language, {_TOKENS} as t from source_posts),
    g as (select * from p where id in (select row_id from listed where split in ('classification_gold', 'csm_gold'))),
    s as (select q.id as qid, g.id as gid, len(list_intersect(q.t, g.t)) as c, len(q.t) + len(g.t) as n, coalesce(q.language = g.language, false) as l, coalesce(q.country = g.country, false) as k from p q cross join g where q.id % 20 = 0),
    r as (select qid, gid, (case when c = 0 then 0.0::double else c / (n - c)::double end + case when l then 0.15::double else 0.0::double end) + case when k then 0.05::double else 0.0::double end as score, l, k from s)
    select qid, gid, round(score, 9) as score, rank from (select *, row_number() over (partition by qid order by score desc, l desc, k desc, gid) as rank from r) where rank <= 5"""
)
def lexical_topk(spark, d):
    """The five gold posts closest in wording to every twentieth post."""
    def side(df):
        text = F.coalesce(combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text")), F.lit(""))
        return df.select(F.col("row_id").alias("id"), text.alias("text"), "language", "country")

    top = retrieve.lexical_topk(side(_posts(spark, d).where("row_id % 20 = 0")), side(_gold(spark, d)))
    return top.withColumn("score", F.round("score", 9)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""with {_LISTED}, p as (select row_id as id, country, nullif({_CANON}, '') as canonical, language, platform, length_band from source_posts),
    g as (select * from p where id in (select row_id from listed where split in ('classification_gold', 'csm_gold'))),
    c as (select q.id as qid, g.id as gid, case when coalesce(q.language = g.language, false) then 0 else 1 end as pool, g.length_band as a, g.platform as b from p q cross join g
          where q.id % 20 = 0 and not (q.country is not distinct from g.country and q.canonical is not distinct from g.canonical)),
    f as (select *, row_number() over (partition by qid, a, b order by pool, gid) as nth from c)
    select qid, gid, rank from (select qid, gid, row_number() over (partition by qid order by pool, case when nth = 1 then 0 else 1 end, gid) as rank from f) where rank <= 8"""
)
def fewshot_examples(spark, d):
    """Eight varied gold posts for every twentieth post, its own language first."""
    side = lambda df, *x: df.select(F.col("row_id").alias("id"), "country", F.nullif(canonical_id(F.col("post_id")), F.lit("")).alias("canonical"), "language", *x)
    picked = retrieve.fewshot_pick(side(_posts(spark, d).where("row_id % 20 = 0")), side(_gold(spark, d), F.col("length_band").alias("label_a"), F.col("platform").alias("label_b")))
    return picked.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    """with s as (select q.vec_id as qid, e.vec_id as id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::double * x[2]::double)), 6) as score
    from embeddings e join embeddings q on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id)
    select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 5"""
)
def dense_topk(spark, d):
    """The five nearest vectors of every twentieth vector, against all."""
    e = table(spark, d, "embeddings")
    return retrieve.dense_topk(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""with {_LISTED}, p as (select row_id as id, country, language, {_TOKENS} as t from source_posts), gid as (select distinct row_id as id from listed where split in ('classification_gold', 'csm_gold')),
    v as (select vec_id as id, embedding from embeddings), d as (select q.id as qid, e.id as gid, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::double * x[2]::double)), 6) as score
          from v q join p on p.id = q.id and q.id % 20 = 0 and q.id % 40 <> 0 join v e on e.id <> q.id join gid on gid.id = e.id),
    s as (select q.id as qid, g.id as gid, len(list_intersect(q.t, g.t)) as c, len(q.t) + len(g.t) as n, coalesce(q.language = g.language, false) as l, coalesce(q.country = g.country, false) as k from p q cross join (select p.* from p join gid using (id)) g where q.id % 20 = 0),
    r as (select qid, gid, (case when c = 0 then 0.0::double else c / (n - c)::double end + case when l then 0.15::double else 0.0::double end) + case when k then 0.05::double else 0.0::double end as score, l, k from s),
    x as (select qid, gid, score, row_number() over (partition by qid order by score desc, gid) as rank from d qualify rank <= 5), y as (select qid, gid, round(score, 9) as score, row_number() over (partition by qid order by r.score desc, l desc, k desc, gid) as rank from r qualify rank <= 5)
    select * from x union all select * from y where qid not in (select qid from x)"""
)
def retrieval_with_fallback(spark, d):
    """The five gold posts nearest by vector to every twentieth post, by wording where it has no vector."""
    def side(df):
        text = F.coalesce(combined_text(F.col("text_clean"), F.col("original_title"), F.col("original_text")), F.lit(""))
        return df.select(F.col("row_id").alias("id"), text.alias("text"), "language", "country")

    asked, gold, e = _posts(spark, d).where("row_id % 20 = 0"), _gold(spark, d), table(spark, d, "embeddings")
    vectors = e.join(gold.select(F.col("row_id").alias("vec_id")), "vec_id", "left_semi")
    known = e.join(asked.where("row_id % 40 <> 0").select(F.col("row_id").alias("vec_id")), "vec_id", "left_semi")
    dense = retrieve.dense_topk(vectors, known, "vec_id", "embedding").withColumnRenamed("id", "gid")
    found = retrieve.with_fallback(dense, retrieve.lexical_topk(side(asked), side(gold)))
    return found.select("qid", "gid", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("select id, note_id, title, author_name, liked_count, collected_count, comment_count, publish_time from notes where (contains(lower(title), '智齿') or contains(lower(content), '智齿')) and liked_count >= 1 order by liked_count desc nulls last, id limit 200")
def note_search(spark, d):
    """The most liked notes on a keyword (a top-200 report)."""
    return store.top(store.search(table(spark, d, "notes"), "智齿", min_likes=1))


@query(
    """select count(*) as total, avg(liked_count) as avg_likes, avg(collected_count) as avg_collects, cast(sum(liked_count) as bigint) as total_likes, count(*) filter (images <> '[]' and images <> '') as with_images,
    count(*) filter (video_url <> '') as with_video, min(created_at) as first_created, max(created_at) as last_created from notes"""
)
def note_stats(spark, d):
    """Totals and averages of the note store."""
    return store.stats(table(spark, d, "notes"))


@query("select keyword, count(*) as n, cast(sum(liked_count) as bigint) as likes from notes group by 1")
def note_keywords(spark, d):
    """Notes and likes per keyword."""
    return table(spark, d, "notes").groupBy("keyword").agg(F.count("*").alias("n"), F.sum("liked_count").alias("likes"))


@query("select author_name, count(*) as n, avg(liked_count) as avg_likes from notes group by 1 order by n desc, author_name nulls first limit 10")
def note_top_authors(spark, d):
    """The ten authors of most notes."""
    return store.top_authors(table(spark, d, "notes"))


@query("with c as (select title, count(*) as n from notes where title <> '' group by 1 having count(*) > 1 order by n desc, title limit 20) select title, n, note_id from notes join c using (title)")
def note_repeated_titles(spark, d):
    """The twenty titles of most notes with the ids of all of them."""
    return store.repeated_titles(table(spark, d, "notes"))


@query("select note_id, id, keyword, title from notes where note_id is null union all select note_id, id, keyword, title from (select *, row_number() over (partition by note_id order by id) as rn from notes where note_id is not null) where rn = 1")
def note_first_wins(spark, d):
    """The first note of every note_id; notes without one all stay."""
    return store.first_wins(table(spark, d, "notes").select("note_id", "id", "keyword", "title"), "note_id", "id")


@query(
    """with e as (select note_id, id from (select *, row_number() over (partition by note_id order by id) as rn from notes where note_id is not null and keyword = '牙痛') where rn = 1),
    n as (select note_id, id from (select *, row_number() over (partition by note_id order by id) as rn from notes where note_id is not null and keyword is distinct from '牙痛') where rn = 1)
    select * from e union all select * from n where note_id not in (select note_id from e)"""
)
def note_merge(spark, d):
    """One keyword's store extended by the notes of all others, known ids first."""
    n = table(spark, d, "notes").where("note_id is not null").select("note_id", "id", "keyword")
    mine = F.coalesce(F.col("keyword") == "牙痛", F.lit(False))
    have = store.first_wins(n.where(mine).drop("keyword"), "note_id", "id")
    return store.merge_stores(have, n.where(~mine).drop("keyword"), "note_id", "id").select("note_id", "id")


@query(
    r"""with u as (select id, coalesce(nullif(regexp_extract(source_url, '/(?:explore|search_result)/([0-9a-f]+)', 1), ''), regexp_extract(source_url, '/discovery/item/([0-9a-f]+)', 1)) as url_note_id,
    case when source_url is null then 'unknown' when regexp_matches(source_url, '/explore/|/discovery/item/') then 'note_detail' when contains(source_url, '/search_result') then 'search_result'
    when regexp_matches(source_url, '^https?://[^/]+/?(explore/?)?$') then 'home' else 'unknown' end as page_type, note_id from notes)
    select id, url_note_id, page_type, coalesce(url_note_id = note_id, false) as same from u"""
)
def link_ids(spark, d):
    """The note id in every note's link, the kind of page, and whether it is the note's own."""
    u = F.col("source_url")
    return table(spark, d, "notes").select("id", note_id_of(u).alias("url_note_id"), page_type(u).alias("page_type"), F.coalesce(note_id_of(u) == F.col("note_id"), F.lit(False)).alias("same"))


@query(
    f"""select id, cast(length(content) - length(replace(content, '#', '')) as bigint) as n_hashes, coalesce(len(regexp_extract_all(content, '[#@]([^#@{_W}]+)', 1)), -1)::bigint as n_marks,
    coalesce(try_cast(regexp_replace(content, '[^0-9]', '', 'g') as bigint), 0) as digits, ((contains(content, '疼'))::int + (contains(content, '痛'))::int + (contains(content, '肿'))::int)::bigint as pain_cues from notes"""
)
def text_marks(spark, d):
    """Hash signs, tags and mentions, digits and cue words of every note."""
    c = F.col("content")
    return table(spark, d, "notes").select("id", occurrences(c, "#").cast("bigint").alias("n_hashes"), F.coalesce(F.size(marks(c)), F.lit(-1)).cast("bigint").alias("n_marks"), digits_as_count(c).alias("digits"), cue_count(c, ["疼", "痛", "肿"]).cast("bigint").alias("pain_cues"))


@query("select note_id, id, keyword from (select *, row_number() over (partition by note_id order by collected_at, id) as rn from keyword_progress where note_id is not null) where rn = 1")
def ledger_first(spark, d):
    """The first time every note was collected."""
    k = table(spark, d, "keyword_progress").where("note_id is not null")
    return k.groupBy("note_id").agg(F.min(F.struct("collected_at", "id", "keyword")).alias("r")).select("note_id", "r.id", "r.keyword")


@query("select keyword, count(distinct note_id) as n_notes, count(*) as n_rows, epoch_us(max(collected_at)) as last_micros from keyword_progress group by 1")
def ledger_progress(spark, d):
    """Collected notes per keyword."""
    return table(spark, d, "keyword_progress").groupBy("keyword").agg(F.count_distinct("note_id").alias("n_notes"), F.count("*").alias("n_rows"), F.unix_micros(F.max("collected_at")).alias("last_micros"))


@query("select keyword, count(*) as n, count(*) filter (ended_at is null or ended_at = '') as n_open, cast(sum(actions) as bigint) as actions, cast(sum(notes_opened) as bigint) as opened, arg_max(started_at, id) as last_start from sessions group by 1")
def session_ledger(spark, d):
    """Sessions per keyword: open ones, actions, and the start of the last by id."""
    s = table(spark, d, "sessions")
    return s.groupBy("keyword").agg(F.count("*").alias("n"), F.count_if(F.col("ended_at").isNull() | (F.col("ended_at") == "")).alias("n_open"), F.sum("actions").alias("actions"), F.sum("notes_opened").alias("opened"), F.max_by("started_at", "id").alias("last_start"))


@query(
    """with f as (select note_id, min(collected_at) as t from keyword_progress where note_id is not null group by 1),
    b as (select date_trunc('hour', collected_at) as h, count(*) filter (collected_at = f.t) as fresh from keyword_progress k left join f using (note_id) where collected_at is not null group by 1),
    m as (select *, sum(case when fresh > 0 then 1 else 0 end) over (order by h) as run from b)
    select cast(run as bigint) as run, epoch_us(min(h)) as first, epoch_us(max(h)) as last, count(*) as n from m where fresh = 0 group by 1 having count(*) >= 2"""
)
def stale_hours(spark, d):
    """Stretches of at least two hourly batches that brought no new note."""
    k = table(spark, d, "keyword_progress").where("collected_at is not null")
    f = k.where("note_id is not null").groupBy("note_id").agg(F.min("collected_at").alias("t"))
    b = k.join(f, "note_id", "left").groupBy(F.date_trunc("hour", "collected_at").alias("h")).agg(F.count_if(F.col("collected_at") == F.col("t")).alias("fresh"))
    return store.stale_runs(b, "h", "fresh", 2).withColumn("first", F.unix_micros("first")).withColumn("last", F.unix_micros("last"))


_RATED = "r as (select doc_id, max(reading_level) filter (rater = 'rater_1') as a, max(reading_level) filter (rater = 'rater_2') as b from level_labels group by 1)"


def _cells(spark, d) -> DataFrame:
    l = table(spark, d, "level_labels")
    one = lambda r: F.max(F.when(F.col("rater") == r, F.col("reading_level")))
    return metrics.confusion(l.groupBy("doc_id").agg(one("rater_1").alias("a"), one("rater_2").alias("b")), "a", "b")


@query(f"with {_RATED} select a as truth, b as guess, count(*) as n from r where a is not null and b is not null group by all")
def rater_confusion(spark, d):
    """How the second rater judged what the first did."""
    return _cells(spark, d)


@query(
    f"""with {_RATED}, p as (select * from r where a is not null and b is not null), l as (select a as label from p union select b from p),
    s as (select label, (select count(*) from p where a = label) as n_true, (select count(*) from p where b = label) as n_guessed, (select count(*) from p where a = label and b = label) as n_right from l)
    select *, round(case when n_guessed > 0 then n_right / n_guessed end, 9) as precision, round(case when n_true > 0 then n_right / n_true end, 9) as recall, round(case when n_true + n_guessed > 0 then 2 * n_right / (n_true + n_guessed) end, 9) as f1 from s"""
)
def rater_scores(spark, d):
    """Precision, recall and F1 per level, the first rater taken as truth."""
    s = metrics.class_scores(_cells(spark, d))
    return s.select("label", "n_true", "n_guessed", "n_right", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""with {_RATED}, p as (select * from r where a is not null and b is not null), t as (select count(*)::double as n, count(*) filter (a = b)::double as same from p),
    l as (select label, sum(x)::double as x, sum(y)::double as y from (select a as label, 1 as x, 0 as y from p union all select b, 0, 1 from p) group by 1),
    j as (select sum(x * y / (n * n)) as pe, count(*) as q, sum((x + y) / (2 * n) * (1 - (x + y) / (2 * n))) as g from l, t)
    select n::bigint as n, round(same / n, 9) as observed, round((same / n - pe) / (1 - pe), 9) as kappa, round((same / n - g / (q - 1)) / (1 - g / (q - 1)), 9) as ac1 from t, j"""
)
def rater_agreement(spark, d):
    """Cohen's kappa and Gwet's AC1 of the two raters."""
    return metrics.agreement(_cells(spark, d)).select("n", *[F.round(c, 9).alias(c) for c in ("observed", "kappa", "ac1")])


_TAGS = f"t as (select id, keyword, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(hashtags, '[;；,，、|{_W}]+'), lambda x: regexp_replace(x, '^#+', '')), lambda x: x <> ''))) as tag from notes)"


def _tags(spark, d) -> DataFrame:
    return table(spark, d, "notes").select("id", "keyword", F.explode(distinct_tags(F.col("hashtags"))).alias("tag"))


@query(f"with {_TAGS}, b as (select keyword, count(distinct id) as base from notes group by 1) select keyword, tag as item, count(distinct id) as n, round(count(distinct id) / base, 9) as share from t join b using (keyword) group by keyword, tag, base")
def tag_prevalence(spark, d):
    """Share of a keyword's notes that carry a tag."""
    n = table(spark, d, "notes")
    p = metrics.prevalence(_tags(spark, d).select("keyword", F.col("id").alias("row"), F.col("tag").alias("item")), n.select("keyword", F.col("id").alias("row")), "keyword")
    return p.withColumn("share", F.round("share", 9))


@query(
    f"""with {_TAGS}, c as (select tag, count(*) as df from t group by 1 having count(*) >= 5), k as (select t.id, t.tag, df from t join c using (tag)), n as (select count(*)::double as n from notes),
    p as (select x.tag as a, y.tag as b, x.df as da, y.df as db, count(*) as n from k x join k y on x.id = y.id and x.tag < y.tag group by all having count(*) >= 5)
    select a, b, p.n, round(ln(p.n * n.n / (da * db)), 6) as pmi, round(case when p.n < n.n then ln(p.n * n.n / (da * db)) / -ln(p.n / n.n) end, 6) as npmi from p, n"""
)
def tag_pairs(spark, d):
    """Tags that occur together, with pointwise mutual information."""
    rows = table(spark, d, "notes").count()
    pairs = metrics.npmi(_tags(spark, d).select(F.col("id").alias("row"), F.col("tag").alias("item")), rows)
    return pairs.withColumn("pmi", F.round("pmi", 6)).withColumn("npmi", F.round("npmi", 6))


@query(
    f"""with h as (select id, created_at, nullif({_strip(f"regexp_replace(content, '[{_W}]+', ' ', 'g')")}, '') as t from notes)
    select sha256(t) as text_hash, arg_min(id, (created_at is null, created_at, id)) as representative, count(*) as n from h where t is not null group by 1"""
)
def exact_duplicates(spark, d):
    """Texts equal after white space is collapsed, the first collected standing for all."""
    return clean.exact_representatives(table(spark, d, "notes"), "id", "content", ["created_at"])


@query()
def cleaned_notes(spark, d):
    """Title and content of every note after the nine cleaning steps."""
    return table(spark, d, "notes").select("id", clean.clean_text(F.col("title"), F.col("content")).alias("clean"))


@query("select event_type, count(*) as n, count(json_extract_string(props, '$.k')) as n_k, cast(sum(coalesce(try_cast(json_extract_string(props, '$.n') as bigint), 0)) as bigint) as total from events group by 1")
def event_props(spark, d):
    """Counts read from the JSON properties of events; values that are no number count 0."""
    p = F.col("props")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object(p, "$.k")).alias("n_k"), F.sum(store.count_of(p, "n")).alias("total"))


