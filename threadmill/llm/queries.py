"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.crosssplit import cross_split_pairs, overlap_report, text_classes
from threadmill.llm.formatdups import collapse, duplicate_members
from threadmill.llm.groupsplit import SHARES, assigned_records, record_keys, related_records, split_records, split_report
from threadmill.llm.leakage import leak_report, leaks, overlaps
from threadmill.llm.mixing import mix, mix_limits, mix_shares
from threadmill.llm.pii import find_pii, redact
from threadmill.llm.readlevel import hard_documents, reading_levels
from threadmill.llm.truncation import truncated, truncation_rates
from threadmill.session import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct personal items of each record: (tbl, row_id, pii_type, pii_text)."""
    parts = []
    for name, key, field in (("notes", "id", "content"), ("source_posts", "row_id", "original_text")):
        items = find_pii(table(spark, sf_dir, name), key, field)
        parts.append(items.select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), "pii_type", "pii_text"))
    return parts[0].union(parts[1])


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note and post with its text after replacement: (tbl, row_id, redacted, n_items)."""
    notes = redact(table(spark, sf_dir, "notes"), "id", "content")
    posts = redact(table(spark, sf_dir, "source_posts"), "row_id", "original_text")
    return notes.select(F.lit("notes").alias("tbl"), F.col("id").alias("row_id"), "redacted", "n_items").union(posts.select(F.lit("source_posts").alias("tbl"), "row_id", "redacted", "n_items"))


def p2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replacing must satisfy: (tbl, n_records, n_wrong).

    n_wrong counts records that gained another number of placeholders than they had items,
    or changed without an item.
    """
    parts = []
    for name, key, field in (("notes", "id", "content"), ("source_posts", "row_id", "original_text")):
        df = table(spark, sf_dir, name).withColumn("content", F.col(field))
        both = redact(df.select(F.struct(F.col(key).alias("k"), "content").alias("r"), "content"), "r", "content")
        marks = lambda c: F.coalesce(F.regexp_count(c, F.lit(r"\[(?:NAME|PHONE|EMAIL|ID|ADDRESS)\]")), F.lit(0))
        wrong = (marks(F.col("redacted")) - marks(F.col("r.content")) != F.col("n_items")) | ((F.col("n_items") == 0) & ~F.col("redacted").eqNullSafe(F.col("r.content")))
        parts.append(both.agg(F.count("*").alias("n_records"), F.count_if(wrong).alias("n_wrong")).select(F.lit(name).alias("tbl"), "n_records", "n_wrong"))
    return parts[0].union(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy with the smallest id of its group: (id_a, id_b)."""
    pairs = duplicate_members(table(spark, sf_dir, "notes"), "id", "title", "content")
    return pairs.select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with its number of copies: (id, n_copies)."""
    return collapse(table(spark, sf_dir, "notes"), "id", "title", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row that shares a group with another: (tbl, row_id, group_key)."""
    return related_records(record_keys(table(spark, sf_dir, "notes"), table(spark, sf_dir, "source_posts")))


def p5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every note and post: (tbl, row_id, split)."""
    return split_records(record_keys(table(spark, sf_dir, "notes"), table(spark, sf_dir, "source_posts")), SHARES)


def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splits must satisfy: (n_rows, n_torn_groups, near_shares, near_labels).

    n_torn_groups counts groups whose rows are in several splits; near_shares and
    near_labels say whether every split's part of all rows, and of each label, is within
    a hundredth of its proportion.
    """
    assigned = assigned_records(record_keys(table(spark, sf_dir, "notes"), table(spark, sf_dir, "source_posts")), SHARES)
    per = assigned.groupBy("split").agg(F.count("*").alias("n"))
    torn = assigned.groupBy("group_key").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").agg(F.count("*").alias("n_torn_groups"))
    target = F.element_at(F.create_map(*[F.lit(x) for pair in SHARES.items() for x in pair]), F.col("split"))
    near = lambda n, whole: F.bool_and(F.abs(F.col(n) / F.col(whole) - target) < 0.01)
    whole = per.agg(F.sum("n").alias("n_rows"))
    shares = per.join(F.broadcast(whole), how="cross").groupBy("n_rows").agg(near("n", "n_rows").alias("near_shares"))
    labels = split_report(assigned, SHARES).where("n_label >= 1000").agg(F.coalesce(near("n_rows", "n_label"), F.lit(True)).alias("near_labels"))
    return shares.join(F.broadcast(torn), how="cross").join(F.broadcast(labels), how="cross")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note field cut inside a sentence: (id, field)."""
    return truncated(table(spark, sf_dir, "notes"), "id", ["title", "content"])


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each site's fields are cut: (site, field, n_values, n_cut, rate)."""
    return truncation_rates(table(spark, sf_dir, "notes"), "id", ["title", "content"], "source_url")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates' denominators, and whether no more values are cut than there are: (site, field, n_values, possible)."""
    rates = p6_rates(spark, sf_dir)
    return rates.select("site", "field", "n_values", ((F.col("n_cut") <= F.col("n_values")) & (F.abs(F.col("rate") * F.col("n_values") - F.col("n_cut")) < 1)).alias("possible"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping entries across the splits: (entry_a, entry_b)."""
    return cross_split_pairs(table(spark, sf_dir, "project_split_manifest"), table(spark, sf_dir, "source_posts"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source file."""
    return overlap_report(table(spark, sf_dir, "project_split_manifest"), table(spark, sf_dir, "source_posts"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of listed posts with their entries and links: (class_id, n_train, n_eval, n_links)."""
    return text_classes(table(spark, sf_dir, "project_split_manifest"), table(spark, sf_dir, "source_posts"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a stretch of an evaluation item: (doc_id, item_id)."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items per item set."""
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p8_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a stretch of an item with substitutions: (doc_id, item_id, run, overlap)."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of reading level 4: (doc_id)."""
    return hard_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per script and reading level: (script, level, n_documents)."""
    levels = reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))
    return levels.groupBy("script", "level").agg(F.count("*").alias("n_documents"))


def p10_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a level of 1 to 4, as far as they hold a word: (n_levelled)."""
    levels = reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))
    return levels.agg(F.count_if(F.col("level").between(1, 4)).alias("n_levelled"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined corpus: (shard, position, source, doc_id, copy, n_tokens)."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    targets = table(spark, sf_dir, "mix_targets")
    return mix_shares(cut(mix(table(spark, sf_dir, "documents"), targets)), targets)


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix must satisfy for every target: (source, has_documents, within_repeats, share_met).

    share_met: the source's tokens are within one document of its share of the total, or
    of all its tokens as often as they may be repeated.
    """
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mix_limits(cut(mix(documents, targets)), documents, targets)


QUERIES = {
    "p4_found": p4_found,
    "p4_copies": p4_copies,
    "p5_found": p5_found,
    "p5_split": p5_split,
    "p5_balance": p5_balance,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p6_totals": p6_totals,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_classes": p3_classes,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p8_overlaps": p8_overlaps,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
    "p10_totals": p10_totals,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_limits": p9_limits,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p2_balance": p2_balance,
}
# ---------------------------------------------------------------- oracles
def _letters(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _canonical(c: str) -> str:
    """SQL: letters and digits of a field; "label: value" lines in sorted order."""
    lines = f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[\\r\\n]+'), lambda x: {_letters('x')} <> '')"
    labelled = f"len({lines}) > 1 and len(list_filter({lines}, lambda x: not regexp_matches(x, '^[^\\n:：]{{1,40}}[:：]'))) = 0"
    return f"case when {labelled} then 'L' || array_to_string(list_sort(list_transform({lines}, lambda x: {_letters('x')})), chr(10)) else 'T' || {_letters(f"coalesce({c}, '')")} end"


_COPIES = f"""f as (select id, {_canonical('title')} as t, {_canonical('content')} as c from notes where id is not null and {_letters("coalesce(content, '')")} <> ''),
    g as (select id, min(id) over (partition by least(t, c), greatest(t, c)) as rep from f)"""
_PAD = r"[\s\x{a0}\x{3000}\x{200b}\x{feff}]+"
_POST = lambda c: f"nullif(regexp_replace(regexp_replace({c}, '^{_PAD}|{_PAD}$', '', 'g'), '^(CHI|JPN|KOR|XHS)_', ''), '')"
_RELATED = f"""with recursive k as (select 'notes' as tbl, id as row_id, nullif(regexp_extract(lower(author_id), '(?:^|[^0-9a-f])([0-9a-f]{{24}})(?:[^0-9a-f]|$)', 1), '') as author, 'CHI:' || {_POST('note_id')} as post from notes
    union all select 'source_posts', row_id, null, nullif(regexp_replace(country, '^{_PAD}|{_PAD}$', '', 'g'), '') || ':' || {_POST('post_id')} from source_posts),
    o as (select distinct post, author from k where author is not null and post is not null),
    e as (select distinct x.author as a, y.author as b from o x join o y using (post) where x.author <> y.author),
    r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
    m as (select a as author, least(a, min(b)) as root from r group by a),
    p as (select post, min(author) as first from o group by 1),
    n as (select tbl, row_id, coalesce(m.root, k.author, m2.root, p.first, k.post) as group_key from k left join m on m.author = k.author left join p on p.post = k.post and k.author is null left join m m2 on m2.author = p.first),
    c as (select *, count(*) over (partition by group_key) as size from n where group_key is not null)"""
_STRIPPED = lambda c: f"regexp_replace({c}, '^{_PAD}|{_PAD}$', '', 'g')"
_OVERLAPS = f"""with e as (select entry_id, split, split = 'main' as main, {_STRIPPED('country')} || ':' || {_STRIPPED('post_id')} as ckey, nullif({_STRIPPED('country')}, '') || ':' || {_POST('post_id')} as post from project_split_manifest where split is not null and entry_id is not null),
    p as (select row_id, {_STRIPPED('country')} || ':' || {_STRIPPED('post_id')} as ckey, coalesce(source_file, '') as source_file, {_letters("case when text_clean is not null and " + _STRIPPED('text_clean') + " <> '' then text_clean else concat_ws(chr(10), original_title, original_text) end")} as t from source_posts),
    held as (select distinct entry_id, main, t from e join p using (ckey) where t <> ''),
    side as (select t, bool_or(main) as m, bool_or(not main) as v from held group by 1),
    g as (select t, m, v, x, row_number() over (partition by t, x) as nth from (select t, m, v, unnest(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3))) as x from side)),
    near as (select a.t as a, b.t as b, count(*) as c from g a join g b on a.x = b.x and a.nth = b.nth where a.v and b.m group by all),
    tp as (select a, b from near where c / greatest(length(a) - 2, length(b) - 2, 1) >= 0.7),
    ep as (select x.entry_id as a, y.entry_id as b from held x join tp on tp.a = x.t and not x.main join held y on y.t = tp.b and y.main union select x.entry_id, y.entry_id from e x join e y using (post) where not x.main and y.main)"""
_SENTENCES = "regexp_split_to_array(text, '[。！？!?\\n]+|\\.\\s|\\.$')"
_LEAKED = f"""with s as (select item_id, lang, list_filter(list_transform({_SENTENCES}, lambda x: {_letters('x')}), lambda x: x <> '') as l from eval_passages),
    stock as (select x from (select distinct item_id, unnest(l) as x from s) group by 1 having count(*) >= 3),
    i as (select item_id, case when lang = 'en' then 60 else 30 end as n, array_to_string(list_transform(l, lambda x: case when list_contains(st, x) then '|' else x end), '') as t from s, (select list(x) as st from stock)),
    ig as (select item_id, n, substr(t, p, n) as g from (select item_id, n, t, unnest(range(1, length(t) - n + 2)) as p from i) where not contains(substr(t, p, n), '|')),
    d as (select doc_id, {_letters('text')} as t from documents where text is not null),
    dg as (select distinct doc_id, substr(t, p, n) as g from (select doc_id, n, t, unnest(range(1, length(t) - n + 2)) as p from d, (values (30), (60)) v(n))),
    found as (select distinct doc_id, item_id from dg join ig using (g))"""

ORACLE_SQL: dict[str, str] = {
    "p6_totals": r"""with s as (select coalesce(regexp_replace(regexp_extract(lower(trim(source_url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)', 1), '^((www|m)[.])+', ''), '') as site, title, content from notes)
        select site, 'title' as field, count(*) as n_values, true as possible from s where trim(title) <> '' group by 1 union all select site, 'content', count(*), true from s where trim(content) <> '' group by 1""",
    "p10_totals": r"select count(*) as n_levelled from documents where doc_id is not null and regexp_matches(text, '[A-Za-z]|[\x{ac00}-\x{d7a3}]|[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]{2}')",
    "p2_balance": "select 'notes' as tbl, count(*) as n_records, 0 as n_wrong from notes union all select 'source_posts', count(*), 0 from source_posts",
    "p3_found": f"{_OVERLAPS} select distinct least(a, b) as entry_a, greatest(a, b) as entry_b from ep",
    "p3_report": f"{_OVERLAPS}, f as (select distinct ckey, source_file from p where ckey is not null) select split, coalesce(source_file, '') as source_file, count(*) as n_entries, count_if(entry_id in (select a from ep)) as n_overlapping from e left join f using (ckey) where not main group by all",
    "p3_classes": f"{_OVERLAPS}, id as (select t, min(row_id) as class_id from p group by 1), l as (select t, count(distinct o) as n from (select a as t, b as o from tp union select b, a from tp) group by 1) select class_id, count_if(main) as n_train, count_if(not main) as n_eval, coalesce(any_value(l.n), 0) as n_links from held join id using (t) left join l using (t) group by 1",
    "p4_found": f"with {_COPIES} select rep as id_a, id as id_b from g where id <> rep",
    "p4_copies": f"with {_COPIES} select rep as id, count(*) as n_copies from g group by 1",
    "p5_balance": "select count(*) as n_rows, 0 as n_torn_groups, true as near_shares, true as near_labels from (select id from notes union all select row_id from source_posts)",
    "p5_found": f"{_RELATED} select tbl, row_id, group_key from c where size > 1",
    "p9_limits": "select source, count(doc_id) > 0 as has_documents, true as within_repeats, true as share_met from mix_targets left join (select * from documents where length(text) > 0) using (source) group by 1",
    "p8_found": f"{_LEAKED} select doc_id, item_id from found",
    "p8_items": f"{_LEAKED}, c as (select item_id, count(*) as docs from found group by 1) select item_set, count(*) as n_items, count(docs) as n_leaked, coalesce(sum(docs), 0)::bigint as n_documents from eval_passages left join c using (item_id) group by 1",
}
