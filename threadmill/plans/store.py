"""Queries on cards, details, pages, dimensions and measures, each with its DuckDB oracle.

The tables hold no raw cards or pages, so raw JSON and markup are built from their rows;
the oracles say what must be read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.text import long_prefix, marks
from threadmill.operators import clean, dims, metrics, neardup, notes as store, pages, sampling
from threadmill.plans.extractions import _X, extractions
from threadmill.session import table
from threadmill.sources.files import eval_manifest, session_summary

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes")


# ---------------------------------------------------------------- cards and details
def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Three kinds of raw cards: flat, under noteCard, and under a noteCard that lacks a title the card itself has."""
    info = F.struct(F.col("liked_count").cast("string").alias("likedCount"), F.concat(F.col("collected_count").cast("string"), F.lit("+")).alias("collectedCount"), F.col("comment_count").alias("commentCount"), F.lit(None).cast("string").alias("shareCount"))
    user = F.struct(F.col("author_name").alias("nickname"), F.col("author_id").alias("userId"))
    parts = [F.col("note_id").alias("noteId"), user.alias("user"), info.alias("interactInfo")]
    flat = F.to_json(F.struct(*parts, F.col("title").alias("title"), F.lit("tok").alias("xsecToken")))
    inner = F.to_json(F.struct(F.struct(*parts, F.col("title").alias("displayTitle"), F.lit("video").alias("type")).alias("noteCard"), F.concat(F.lit("n"), "id").alias("id")))
    poor = F.to_json(F.struct(F.struct(*parts).alias("noteCard"), F.col("title").alias("title"), F.lit("video").alias("type")))
    return _notes(spark, d).select("id", F.when(F.col("id") % 3 == 0, flat).when(F.col("id") % 3 == 1, inner).otherwise(poor).alias("raw"))


@query(
    """select id, case when id % 3 = 1 then 'n' || id else coalesce(note_id, '') end as note_id, case when id % 3 = 0 then 'tok' else '' end as xsec_token, case when id % 3 = 2 then '' else coalesce(title, '') end as title,
    case when id % 3 = 1 then 'video' else 'normal' end as type, coalesce(author_name, '') as author_name, coalesce(author_id, '') as author_id, coalesce(liked_count, 0) as liked_count, 0::bigint as collected_count, coalesce(comment_count, 0) as comment_count, 0::bigint as share_count from notes"""
)
def note_cards(spark, d):
    """Ten columns of raw feed cards."""
    return _cards(spark, d).select("id", *store.card_fields(F.col("raw")))


def _details(spark: SparkSession, d: str) -> DataFrame:
    url = lambda k: F.concat(F.lit("http://i/"), "id", F.lit(f"/{k}"))
    image = lambda k: F.struct(F.when(F.col("id") % 4 != k, url(k)).alias("urlDefault"))
    stream = lambda c: F.array(F.struct(F.when(F.col("id") % 5 != 0, F.concat(F.lit(f"v{c}/"), "id")).alias("masterUrl")))
    video = F.struct(F.struct(F.struct(F.when(F.col("id") % 2 == 0, stream("265")).alias("h265"), stream("264").alias("h264")).alias("stream")).alias("media"))
    info = F.struct(F.when(F.col("id") % 7 == 0, "1.2万").otherwise(F.col("liked_count").cast("string")).alias("likedCount"), F.col("collected_count").alias("collected"), F.col("comment_count").alias("commenCount"), F.col("share_count").alias("sharedCount"))
    tags = F.array(F.struct(F.col("keyword").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("tag").alias("name")))
    detail = F.struct(
        F.col("note_id").alias("noteId"), "title", F.col("content").alias("desc"), F.when(F.col("id") % 6 != 0, F.col("id") * 86_400_123).alias("time"), F.struct(F.col("author_name").alias("nickName"), F.col("author_id").alias("userId")).alias("user"), info.alias("interactInfo"),
        F.array(image(0), image(1), image(2)).alias("imageList"), F.when(F.col("id") % 3 != 0, video).alias("video"), tags.alias("tagList"),
    )
    return _notes(spark, d).select("id", F.to_json(detail).alias("raw"))


def _detail_sql(sep: str) -> str:
    images = f"array_to_string(list_filter([case when id % 4 <> 0 then 'http://i/' || id || '/0' end, case when id % 4 <> 1 then 'http://i/' || id || '/1' end, case when id % 4 <> 2 then 'http://i/' || id || '/2' end], lambda x: x is not null), '{sep}')"
    return f"""select id, nullif(note_id, '') as note_id, coalesce(title, '') as title, coalesce(author_name, '') as author_name, case when id % 7 = 0 then 0 else coalesce(liked_count, 0) end as liked_count, coalesce(collected_count, 0) as collected_count,
    coalesce(comment_count, 0) as comment_count, coalesce(share_count, 0) as share_count, case when id % 6 <> 0 and id <> 0 then strftime(make_timestamp(id * 86400123000), '%Y-%m-%d %H:%M:%S') else '' end as publish_time, {images} as images,
    case when id % 3 = 0 or id % 5 = 0 then '' when id % 2 = 0 then 'v265/' || id else 'v264/' || id end as video_url, array_to_string(list_filter([keyword, 'tag'], lambda x: x <> ''), '{sep}') as hashtags from notes"""


_DETAIL = ["note_id", "title", "author_name", "liked_count", "collected_count", "comment_count", "share_count", "publish_time", "images", "video_url", "hashtags"]


@query(_detail_sql("; "))
def note_details(spark, d):
    """A note's columns from its detail object."""
    return _details(spark, d).select("id", *store.detail_fields(F.col("raw"))).select("id", *_DETAIL)


@query(_detail_sql("|"))
def note_detail_arrays(spark, d):
    """The same with lists as arrays, joined here to be compared."""
    rows = _details(spark, d).select("id", *store.detail_arrays(F.col("raw"))).select("id", *_DETAIL)
    return rows.withColumns({c: F.array_join(c, "|") for c in ("images", "hashtags")})


@query("select id, case when id % 4 = 0 then null when id % 4 = 1 then 'a' || id when id % 4 = 2 then 'b' || id else 'a' || id end as note_id from notes")
def state_notes(spark, d):
    """The note a page's state shows: the current id's, nothing if that is null, else the first that has one."""
    note = lambda k: F.concat(F.lit(f'{{"note":{{"noteId":"{k}'), "id", F.lit('"}}'))
    entries = F.concat(F.lit('{"x":{},"a":'), F.when(F.col("id") % 4 == 0, F.lit("null")).otherwise(note("a")), F.lit(',"b":'), note("b"), F.lit("}"))
    current = F.when(F.col("id") % 4 == 0, '"a"').when(F.col("id") % 4 == 2, '"b"').when(F.col("id") % 4 == 1, '"gone"').otherwise(F.lit("null"))
    state = F.concat(F.lit('{"note":{"currentNoteId":'), current, F.lit(',"noteDetailMap":'), entries, F.lit("}}"))
    return _notes(spark, d).select("id", F.get_json_object(store.note_of_state(state), "$.noteId").alias("note_id"))


_PAGE = "p as (select keyword, id, note_id, title, row_number() over (partition by keyword order by id) - 1 as pos from notes where keyword is not null)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """One page for each session: the session's keyword and its cards, note ids made of numbers."""
    return table(spark, d, "sessions").selectExpr("id as page", "keyword", "transform(sequence(1, cast(id % 20 + 1 as int)), k -> id * 7 + k % 16) as ids")


_ON_PAGE = "s as (select id as page, k - 1 as pos, id * 7 + k % 16 as nr from (select id, unnest(range(1, id % 20 + 2)) as k from sessions))"


@query(
    f"""with {_ON_PAGE}, c as (select note_id, max(liked_count) as liked_count, max(collected_count) as collected_count, max(comment_count) as comment_count from (select 'n' || id as note_id, liked_count, collected_count, comment_count from notes) group by 1)
    select page, cast(pos + 1 as int) as index, 'n' || nr as note_id, coalesce(liked_count, 0) as liked_count, coalesce(collected_count, 0) as collected_count, coalesce(comment_count, 0) as comment_count from s left join c on c.note_id = 'n' || nr where pos < 15"""
)
def page_first_cards(spark, d):
    """The first fifteen cards of every search page, with known counts."""
    items = F.transform("ids", lambda x: F.concat(F.lit('{"id":"n'), x, F.lit('","noteCard":{"displayTitle":"t"}}')))
    where = F.when(F.col("page") % 3 == 0, '{"search":{"noteItems":[').when(F.col("page") % 3 == 1, '{"search":{"feeds":[').otherwise('{"items":[')
    state = F.concat(where, F.array_join(items, ","), F.lit("]}"), F.when(F.col("page") % 3 != 2, "}").otherwise(""))
    cards = pages.search_cards(_pages(spark, d).select("page", state.alias("state")), "page", "state").select("page", "pos", "note_id")
    counts = _notes(spark, d).select(F.concat(F.lit("n"), "id").alias("note_id"), "liked_count", "collected_count", "comment_count")
    return pages.first_cards(cards, counts, "page").select("page", "index", "note_id", "liked_count", "collected_count", "comment_count")


@query(
    f"""with {_ON_PAGE}, h as (select page, pos, lower(printf('%x', nr)) as note_id, case when nr % 2 = 0 and pos > 2 then 'tk' || pos else '' end as token from s),
    r as (select *, row_number() over (partition by page, note_id order by token = '', pos) as rn from h)
    select page, note_id, case when pos % 3 = 0 then 'title ' || pos else 'span ' || pos end as title, token as xsec_token from r where rn = 1"""
)
def page_link_cards(spark, d):
    """One card for every note a page links to, one with a token before one without."""
    def link(x, k):
        href = F.concat(F.lit("/explore/"), F.lower(F.hex(x)), F.lit("?k="), k.cast("string"), F.when((x % 2 == 0) & (k > 2), F.concat(F.lit("&amp;xsec_token=tk"), k.cast("string"))).otherwise(""))
        title = F.when(k % 3 == 0, F.concat(F.lit(' title="title '), k.cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit('<a href="'), href, F.lit('"'), title, F.lit("><img alt='a'><span>span "), k.cast("string"), F.lit("</span></a>"))

    html = F.concat(F.lit("<div><a href='/user/1'>me</a>"), F.array_join(F.transform("ids", link), "\n"), F.lit("</div>"))
    return pages.link_cards(_pages(spark, d).select("page", html.alias("html")), "page", "html").select("page", "note_id", "title", "xsec_token")


@query(r"select id, regexp_extract(coalesce(publish_time, ''), '[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}') as day from notes")
def written_dates(spark, d):
    """The first date written as digits in publish_time."""
    return _notes(spark, d).select("id", pages.written_date(F.col("publish_time")).alias("day"))


# ---------------------------------------------------------------- the store
@query("select id, keyword, liked_count from notes where contains(lower(keyword), '牙')")
def export_by_keyword(spark, d):
    """What an export of one keyword holds."""
    return store.export(_notes(spark, d), "牙").select("id", "keyword", "liked_count")


@query("select substr(coalesce(note_id, ''), 1, 16) as note_id, substr(coalesce(title, ''), 1, 28) as title, substr(coalesce(author_name, ''), 1, 12) as author, coalesce(liked_count, 0)::varchar as likes, coalesce(collected_count, 0)::varchar as collects, substr(coalesce(publish_time, ''), 1, 10) as time from notes")
def result_listing(spark, d):
    """Notes as a result list prints them."""
    return _notes(spark, d).select(*store.listing())


@query("with n as (select note_id from notes), f as (select count(distinct note_id) as k from n where note_id not in (select note_id from keyword_progress where note_id is not null)), c as (select count(*) as n_read, count_if(note_id is null) as z from n) select n_read, k + z as n_inserted, n_read - k - z as n_skipped from f, c")
def merge_accounting(spark, d):
    """What merging the notes into the store of collected ids would insert and skip."""
    return store.merge_counts(table(spark, d, "keyword_progress").select("note_id"), _notes(spark, d).select("note_id"), "note_id")


@query("with p as (select max(substr(started_at, 1, 10)) as today from sessions) select (select count(*) from sessions, p where started_at >= today) as n_today, today from p")
def sessions_today(spark, d):
    """How many sessions began on the last day there were any."""
    s = table(spark, d, "sessions")
    last = s.agg(F.max(F.substring("started_at", 1, 10)).alias("today"))
    return s.join(F.broadcast(last), how="cross").groupBy("today").agg(F.count_if(F.col("started_at") >= F.col("today")).alias("n_today"))


@query("select id, round((epoch(try_cast(started_at as timestamp)) - epoch(lag(try_cast(started_at as timestamp)) over (partition by keyword order by id))) / 3600, 1) as hours_since from sessions")
def session_gaps(spark, d):
    """Hours since the session of the same keyword before, to one decimal."""
    at = table(spark, d, "sessions").select("id", "keyword", F.col("started_at").try_cast("timestamp").alias("t"))
    before = at.selectExpr("id", "t", "lag(t) over (partition by keyword order by id) as before")
    return before.select("id", F.round((F.unix_seconds("t") - F.unix_seconds("before")) / 3600, 1).alias("hours_since"))


_VARIANTS = {"牙疼": ["牙痛", "牙齿敏感"], "智齿": ["阻生", "Wisdom"]}
_TERMS = ["根管", "龋"]
_RELEVANT = "coalesce(title <> '' and (coalesce(contains(lower(title), lower(keyword)), false) or coalesce(keyword = '牙疼' and (contains(lower(title), '牙痛') or contains(lower(title), '牙齿敏感')), false) or coalesce(keyword = '智齿' and (contains(lower(title), '阻生') or contains(lower(title), 'wisdom')), false) or contains(title, '根管') or contains(title, '龋')), false)"


@query(f"select keyword, count(*) as n, count_if({_RELEVANT}) as n_relevant from notes group by 1")
def relevant_titles(spark, d):
    """How many titles of each keyword are about it."""
    relevant = store.title_relevant(F.col("title"), F.col("keyword"), _VARIANTS, _TERMS)
    return _notes(spark, d).groupBy("keyword").agg(F.count("*").alias("n"), F.count_if(relevant).alias("n_relevant"))


@query(f"select keyword, id, e as engagement from (select keyword, id, coalesce(liked_count, 0) + coalesce(collected_count, 0) as e, row_number() over (partition by keyword order by coalesce(liked_count, 0) + coalesce(collected_count, 0) desc, id) as rn from notes where {_RELEVANT}) where rn = 1")
def most_engaged(spark, d):
    """The relevant note of most likes and collects for each keyword."""
    n = _notes(spark, d).where(store.title_relevant(F.col("title"), F.col("keyword"), _VARIANTS, _TERMS))
    return store.most_engaged(n, "keyword", "id")


@query("select doc_id, lang from documents order by doc_id limit 100")
def first_documents(spark, d):
    """The first hundred documents by id (a head limit is the feature)."""
    return table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


@query("select origin, count(*) as n, count(label) as n_labelled from (select 'eval' as origin, split as label from project_split_manifest where split = 'eval_holdout' union all select 'main', null from project_split_manifest where split = 'main') group by 1")
def pool_union(spark, d):
    """Evaluation and training entries as one bag, a column of one side null on the other."""
    m = table(spark, d, "project_split_manifest")
    ev = m.where("split = 'eval_holdout'").select(F.lit("eval").alias("origin"), F.col("split").alias("label"))
    both = ev.unionByName(m.where("split = 'main'").select(F.lit("main").alias("origin")), allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.count("label").alias("n_labelled"))


_W2 = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(f"select id, len(list_filter(regexp_extract_all(coalesce(content, ''), '[#@]([^#@{_W2}]+)', 1), lambda x: contains(x, '牙') and length(string_split(x, '牙')[1]) >= 2))::int as n from notes")
def tags_behind_prefix(spark, d):
    """How many tags of a note hold a marker behind at least two characters."""
    tags = F.filter(marks(F.coalesce("content", F.lit(""))), lambda x: long_prefix(x, "牙", 2))
    return _notes(spark, d).select("id", F.size(tags).alias("n"))


# ---------------------------------------------------------------- dimensions
_DIMS = ["pain", "cost", "fear"]


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """Two outputs for every post; a dimension may be missing, no object, or of odd values."""
    def output(shift: int):
        parts = []
        for i, dim in enumerate(_DIMS):
            h = F.col("row_id") + shift * (i + 1) + i
            label = F.when(h % 5 == 0, '"Yes"').when(h % 5 == 1, "1").when(h % 5 == 2, "true").when(h % 5 == 3, '"no"').otherwise("null")
            confidence = F.when(h % 4 == 0, F.lit('"high"')).otherwise(F.concat((h % 6).cast("string"), F.lit(".5")))
            body = F.concat(F.lit('{"label":'), label, F.lit(',"confidence":'), confidence, F.lit(',"reasoning":"r'), (h % 9).cast("string"), F.lit('"}'))
            parts.append(F.concat(F.lit(f'"{dim}":'), F.when(h % 7 == 0, F.lit('"odd"')).otherwise(body)))
        return F.when(F.col("row_id") % 11 == 0, "[]").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))

    return table(spark, d, "source_posts").select("row_id", output(0).alias("a"), output(3).alias("b"))


def _dims_sql(shift: int, name: str) -> str:
    return f"""{name} as (select row_id, dim, h, case when row_id % 11 = 0 or h % 7 = 0 then 0 when h % 5 in (0, 1, 2) then 1 else 0 end as label, case when row_id % 11 = 0 or h % 7 = 0 or h % 4 = 0 then 0.0 else (h % 6) + 0.5 end::double as confidence,
    case when row_id % 11 = 0 or h % 7 = 0 then '' else 'r' || (h % 9) end as reasoning from (select row_id, d.dim, row_id + {shift} * (d.i + 1) + d.i as h from source_posts, (values (0, 'pain'), (1, 'cost'), (2, 'fear')) d(i, dim)))"""


@query(f"with {_dims_sql(0, 'a')} select row_id, dim, label, confidence, reasoning from a")
def dimension_values(spark, d):
    """Label, confidence and reasoning of every dimension."""
    return dims.by_dimension(_outputs(spark, d), "row_id", "a", _DIMS)


@query(f'with {_dims_sql(0, "a")}, {_dims_sql(3, "b")} select row_id, dim, a.label as "from", b.label as "to" from a join b using (row_id, dim) where a.label <> b.label')
def changed_dimensions(spark, d):
    """Dimensions whose label changed between two outputs."""
    return dims.changed_dimensions(_outputs(spark, d), "row_id", "a", "b", _DIMS)


@query(f"with {_dims_sql(0, 'a')} select row_id, string_agg(dim || '=' || case when label = 1 then 'A2' else '' end, ',' order by dim) as final_source, string_agg(dim || '=' || case when h % 2 = 0 then 'rejected' else 'approved' end, ',' order by dim) as approved from a group by 1")
def dimension_trace(spark, d):
    """Where each dimension's label came from and whether it was approved; no verdict is approval."""
    rows = dims.by_dimension(_outputs(spark, d), "row_id", "a", _DIMS)
    nr = F.array_position(F.array(*[F.lit(x) for x in _DIMS]), F.col("dim")) - 1
    verdicts = rows.where((F.col("row_id") + nr) % 2 == 0).select("row_id", "dim", F.lit("rejected").alias("verdict"))
    told = dims.dim_verdicts(rows, verdicts, "row_id").select("row_id", "dim", F.when(F.col("label") == 1, "A2").alias("final_source"), F.col("verdict").alias("approved"))
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(c)
    return dims.trace_meta(told, "row_id").select("row_id", flat("final_source"), flat("approved"))


# ---------------------------------------------------------------- study design
@query("select case when collected_at is null then 'missing' when collected_at::date between date '2023-07-01' and date '2026-06-30' then 'inside' else 'outside' end as state, count(*) as n from documents group by 1")
def study_period(spark, d):
    """Documents inside and outside the study period."""
    return table(spark, d, "documents").groupBy(sampling.in_period(F.col("collected_at").cast("date")).alias("state")).agg(F.count("*").alias("n"))


@query("select cast(m as date) as month, true as inside from (select unnest(generate_series(date '2023-07-01', date '2026-06-30', interval 1 month)) as m)")
def sampling_dates(spark, d):
    """One day for every month, and whether it lies in it; the same on every run."""
    dates = sampling.monthly_dates(spark)
    again = sampling.monthly_dates(spark).select(F.col("month").alias("m"), F.col("day").alias("d"))
    same = dates.join(F.broadcast(again), F.col("month") == F.col("m"))
    return same.select("month", ((F.trunc("day", "month") == F.col("month")) & (F.col("day") == F.col("d"))).alias("inside"))


@query("select count(*) > 0 as has_rows, true as only_sampled from documents where collected_at::date between date '2023-07-01' and date '2026-06-30'")
def sampled_documents(spark, d):
    """Whether the documents of the sampled days all lie on such days."""
    docs = table(spark, d, "documents").where(F.col("collected_at").isNotNull()).select("doc_id", F.col("collected_at").cast("date").alias("day"))
    dates = sampling.monthly_dates(spark)
    taken = sampling.sample_days(docs, "day", dates)
    left = taken.join(F.broadcast(dates.select("day")), "day", "left_anti").agg(F.count("*").alias("n"))
    inside = docs.where(sampling.in_period(F.col("day")) == "inside").agg(F.count("*").alias("m"))
    return left.join(F.broadcast(inside), how="cross").select((F.col("m") > 0).alias("has_rows"), (F.col("n") == 0).alias("only_sampled"))


@query(
    """with e as (select lower(trim(keyword)) as k, keyword from (select keyword from sessions union all select keyword from sessions)), x as (select distinct lower(trim(keyword)) as k, 'c' || length(keyword) as concept from sessions where keyword is not null union select distinct lower(trim(keyword)), 'other' from sessions where length(keyword) = 2),
    g as (select k, min(concept) as a, max(concept) as b from x group by 1) select n.id, case when a = b then a end as concept, case when a is null then 'new_candidate' when a = b then 'existing_dictionary' else 'ambiguous' end as status from notes n left join g on g.k = lower(trim(n.keyword))"""
)
def mapped_concepts(spark, d):
    """Keywords mapped to a dictionary made of the sessions' keywords, some of two concepts."""
    s = table(spark, d, "sessions").where("keyword is not null")
    dictionary = s.select(F.col("keyword").alias("expression"), F.concat(F.lit("c"), F.length("keyword")).alias("concept")).union(s.where("length(keyword) = 2").select("keyword", F.lit("other")))
    return sampling.map_concepts(_notes(spark, d).select("id", F.col("keyword").alias("expression")), dictionary).select("id", "concept", "status")


_SHINGLES = """w as (select id, regexp_extract_all(lower(coalesce(content, '')), '([a-z0-9]+|[\\p{L}])', 1) as t from notes),
    s as (select distinct id, array_to_string(t[i:i + 4], ' ') as x from (select id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) as i from w where len(t) > 0)),
    h as (select id, string_agg(x, '|' order by x) as h, count(*) as n from s group by 1), m as (select id, min(id) over (partition by h) as class_id, n from h)"""


@query(f"with {_SHINGLES} select id, class_id from m")
def near_duplicate_classes(spark, d):
    """The class of texts with the same runs of five words that each note belongs to."""
    return neardup.near_duplicate_classes(_notes(spark, d), "id", "content")


@query(
    f"""with {_SHINGLES}, c as (select s.id, x, n from s join m using (id) where m.id = m.class_id), p as (select a.id as class_a, b.id as class_b, a.n as na, b.n as nb, count(*) as k from c a join c b using (x) where a.id < b.id group by all)
    select class_a, class_b, round(k / (na + nb - k), 6) as similarity from p where k / (na + nb - k) >= 0.8 - 1e-9"""
)
def near_duplicate_pairs(spark, d):
    """Pairs of such classes that share at least 0.8 of their runs."""
    return neardup.near_duplicate_pairs(_notes(spark, d), "id", "content").withColumn("similarity", F.round("similarity", 6))


@query(
    """with f as (select *, row_number() over (partition by nullif(note_id, '') order by created_at is null, created_at, id) as rn, first_value(id) over (partition by nullif(note_id, '') order by created_at is null, created_at, id) as first, nullif(regexp_replace(regexp_replace(content, '[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), '^ | $', '', 'g'), '') as c from notes),
    k as (select *, case when nullif(note_id, '') is null or rn = 1 then id else first end as pick from f), t as (select *, case when pick = id and c is not null then first_value(id) over (partition by pick = id, c order by created_at is null, created_at, id) end as same from k)
    select id, case when pick <> id then pick when same <> id then same else id end as representative, case when pick <> id then 'platform_id' when same <> id then 'exact_text' else '' end as reason from t"""
)
def deduplicated_notes(spark, d):
    """Every note with the one that stands for it: by note_id first, then by equal text."""
    return clean.deduplicate(_notes(spark, d), "id", ["note_id"], "content", ["created_at"]).select("id", "representative", "reason")


_DATES = [
    ("2024-03-05 发布", "2024-05-01 10:00:00", "2024-03-05", "day"), ("编辑于 03-05", "2024-05-01 10:00:00", "2024-03-05", "year_inferred"), ("12月31日", "2024-05-01 10:00:00", "2023-12-31", "year_inferred"),
    ("3天前 上海", "2024-05-01 10:00:00", "2024-04-28", "day"), ("昨天 12:30", "2024-05-01 10:00:00", "2024-04-30", "day"), ("11 小时前", "2024-05-01 10:00:00", "2024-04-30", "day"), ("9小时前", "2024-05-01 10:00:00", "2024-05-01", "day"),
    ("5 minutes ago", "2024-05-01 00:03:00", "2024-04-30", "day"), ("今天", "2024-05-01 00:03:00", "2024-05-01", "day"), ("不明", "2024-05-01 00:03:00", None, None),
]


@query("select * from (values " + ", ".join(f"({i}, {'cast(' + repr(x[2]) + ' as date)' if x[2] else 'null'}, {repr(x[3]) if x[3] else 'null'})" for i, x in enumerate(_DATES)) + ") t(id, day, precision)")
def recovered_dates(spark, d):
    """Dates as notes show them, made absolute."""
    rows = spark.createDataFrame([(i, x[0], x[1]) for i, x in enumerate(_DATES)], "id int, text string, at string")
    day = clean.recover_date(F.col("text"), F.col("at").cast("timestamp"))
    return rows.select("id", day.alias("r")).select("id", "r.day", "r.precision")


# ---------------------------------------------------------------- measures
_CELLS = "j as (select least(reading_level, 3) as t, greatest(reading_level - cast(doc_id % 2 as int), 1) as g from level_labels where reading_level is not null), l as (select unnest([1, 2, 3, 4]) as x), c as (select x, count_if(t = x and g = x) as r, count_if(t = x) as nt, count_if(g = x) as ng from j, l group by 1 having nt + ng > 0)"


@query(f"with {_CELLS}, a as (select count(*) as n, avg((t = g)::int) as accuracy from j) select n, accuracy, accuracy as micro_f1, avg(case when ng > 0 then r / ng else 0 end) as macro_precision, avg(case when nt > 0 then r / nt else 0 end) as macro_recall, avg(2 * r / (nt + ng)) as macro_f1 from c, a group by n, accuracy")
def overall_scores(spark, d):
    """Accuracy, micro and macro scores of one labelling against another."""
    j = table(spark, d, "level_labels").where("reading_level is not null").selectExpr("least(reading_level, 3) as t", "greatest(reading_level - cast(doc_id % 2 as int), 1) as g")
    return metrics.overall_scores(metrics.confusion(j, "t", "g"))


_ML = "m as (select row_id, l.i, (row_id * 3 + l.i) % 4 < 2 as t, (row_id * 5 + l.i) % 3 = 0 as g from source_posts, (values (0), (1), (2)) l(i))"


@query(
    f"""with {_ML}, e as (select row_id, bool_and(t = g) as same from m group by 1), s as (select count_if(t and g) as b, count_if(not t and g) as w, count_if(t and not g) as x, count_if(t <> g) as o from m),
    f as (select i, 2 * count_if(t and g) / nullif(2 * count_if(t and g) + count_if(t <> g), 0) as f1 from m group by 1)
    , y as (select count(*) as n, avg(same::int) as subset_accuracy from e), z as (select avg(coalesce(f1, 0)) as macro_f1 from f) select n, subset_accuracy, o / (3 * n) as hamming_loss, b / (b + w) as micro_precision, b / (b + x) as micro_recall, 2 * b / (2 * b + w + x) as micro_f1, macro_f1 from s, y, z"""
)
def multilabel_scores(spark, d):
    """Scores of label sets against label sets."""
    of = lambda a, m, c: F.array_compact(F.array(*[F.when(F.expr(f"(row_id * {a} + {i}) % {m} {c}"), F.lit(x)) for i, x in enumerate("xyz")]))
    rows = table(spark, d, "source_posts").select(of(3, 4, "< 2").alias("t"), of(5, 3, "= 0").alias("g"))
    return metrics.multilabel_scores(rows, "t", "g", ["x", "y", "z"])


_P = "cast((id * 7919) % 1009 as double) / 1009"


@query(f"with t as (select id, {_P} as p from notes where id % 9 <> 0), r as (select *, p * (select count(*) from t) / rank() over (order by p) as lo, row_number() over (order by p, id) as rn, (select count(*) from t) as m from t), x as (select id, p, p * m / (count(*) over (order by p)) as v from r) select id, round(least(1.0, min(v) over (order by p desc range unbounded preceding)), 9) as q from x")
def adjusted_p_values(spark, d):
    """Benjamini-Hochberg adjusted p values, many of them tied."""
    p = F.when(F.col("id") % 9 != 0, F.expr(_P)).alias("p")
    return metrics.fdr(_notes(spark, d).select("id", p), "p").select("id", F.round("q", 9).alias("q"))


@query("select round(avg(liked_count), 6) as mean, true as inside, true as narrow from notes")
def bootstrapped_likes(spark, d):
    """The mean of likes, whether its bootstrap interval holds it, and is no wider than six standard errors."""
    n = _notes(spark, d)
    ci = metrics.bootstrap_ci(n, "liked_count", "id")
    error = n.agg((F.stddev("liked_count") / F.sqrt(F.count("liked_count"))).alias("se"))
    return ci.join(F.broadcast(error), how="cross").select(F.round("mean", 6).alias("mean"), ((F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high"))).alias("inside"), (F.col("high") - F.col("low") < 6 * F.col("se")).alias("narrow"))


_EDGES = "e as (select a.source as a, b.source as b, count(*) as weight from (select distinct source, date_trunc('month', collected_at) as day from documents where source is not null and collected_at is not null) a join (select distinct source, date_trunc('month', collected_at) as day from documents where source is not null and collected_at is not null) b using (day) where a.source < b.source group by all)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Sources that collected in the same months; the number of such months weighs the edge."""
    days = table(spark, d, "documents").where("source is not null and collected_at is not null").select("source", F.date_trunc("month", "collected_at").alias("day")).distinct()
    lists = days.groupBy("day").agg(F.array_sort(F.collect_set("source")).alias("s"))  # one entry a source
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select(F.inline(pair)).groupBy("a", "b").agg(F.count("*").alias("weight"))


@query(f"with {_EDGES} select node, count(*) as degree, sum(weight)::bigint as strength from (select a as node, weight from e union all select b, weight from e) group by 1")
def network_nodes(spark, d):
    """Degree and strength of every source in the network of common months."""
    return metrics.network_measures(_edges(spark, d))[0]


@query(f"with {_EDGES}, n as (select node, count(*) as d, sum(weight) as s from (select a as node, weight from e union all select b, weight from e) group by 1), k as (select count(*) as n_edges from e), m as (select count(*) as n_nodes, avg(d) as mean_degree, avg(s) as mean_strength from n) select n_nodes, n_edges, case when n_nodes > 1 then 2 * n_edges / (n_nodes * (n_nodes - 1)) end as density, mean_degree, mean_strength from m, k")
def network_summary(spark, d):
    """Size, density and means of that network."""
    return metrics.network_measures(_edges(spark, d))[1]


@query(f"with {_X}, h as (select 'country' as dim, country as value from x union all select 'language', language from x union all select 'experiencer_label', experiencer_label from x union all select 'content_function', content_function from x union all select 'source_sheet', (select p.source_sheet from source_posts p where p.row_id = x.row_id) from x) select dim, value, count(*) as n from h group by all")
def classification_histograms(spark, d):
    """The five histograms of labelled examples, in one pass."""
    rows = extractions(spark, d).join(table(spark, d, "source_posts").select("row_id", "source_sheet"), "row_id")
    names = ["country", "language", "experiencer_label", "content_function", "source_sheet"]
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in names]))).groupBy("dim", "value").agg(F.count("*").alias("n"))


def _counts_json(c: str) -> str:
    return f"(select '{{' || string_agg('\"' || k || '\":' || n, ',' order by k) || '}}' from (select {c} as k, count(*) as n from r group by 1))"


@query(f"with r as (select coalesce(country, '') as country, coalesce(length_band, '') as band from source_posts) select (select count(*) from r) as rows, {_counts_json('country')} as countries, {_counts_json('band')} as length_bands, {_counts_json(chr(99) + 'ountry || chr(58) || band')} as country_length_bands")
def eval_counts(spark, d):
    """The counts that go beside an evaluation file."""
    return eval_manifest(table(spark, d, "source_posts"))


@query(
    """with t as (select keyword, title, liked_count, row_number() over (partition by keyword order by liked_count desc nulls last, id) as rank from notes where keyword is not null)
    select keyword, count(*)::bigint as notes, coalesce(sum(liked_count), 0)::bigint as likes, (select string_agg(coalesce(title, ''), '|' order by rank) from t where t.keyword = n.keyword and rank <= 3) as top from notes n where keyword is not null group by 1"""
)
def session_summaries(spark, d):
    """The summary of each keyword's collection: notes, likes and most liked titles."""
    s = session_summary(_notes(spark, d).where("keyword is not null").withColumn("session", F.col("keyword")), "session", 3)
    at = lambda p: F.get_json_object("summary", f"$.{p}")
    return s.select(F.col("session").alias("keyword"), at("notes").cast("bigint").alias("notes"), at("likes").cast("bigint").alias("likes"), F.array_join(F.from_json(at("top"), "array<string>"), "|").alias("top"))
