import json

import pytest
from pyspark.sql import functions as F

from threadmill import schema
from threadmill.functions import text
from threadmill.functions.joins import lookup
from threadmill.operators import clean, metrics, notes, repair, retrieve, splits, units
from threadmill.sources import files
from threadmill.streaming import ledger


def unit(**k):
    base = dict(unit_id="", domain="Symptom Description", evidence_span_original="疼", surface_text_working="疼", working_language="zh", normalized_concept_en="pain", concept_status="new_candidate", support_type="explicit", assertion="present", temporality="current", sentiment_or_outcome="neutral", confidence=0.9, judge_verdict="accept")
    return base | k


def extraction(spark, *rows):
    full = []
    for r in rows:
        base = {f.name: None for f in schema.EXTRACTION.fields} | dict(post_id="p", country="CHI", language="zh", original_text="牙疼了三天", relevance_label="R1", experiencer_label="E1", content_function="C1", units=[])
        full.append(base | r)
    return spark.createDataFrame(full, schema.EXTRACTION)


def test_strip_equals_python(spark):
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    df = spark.createDataFrame([(s + "x y" + s,) for s in spaces] + [("​x",)], "s string")
    assert [r[0] for r in df.select(text.strip(F.col("s"))).collect()] == ["x y"] * len(spaces) + ["​x"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("#牙痛 @张三 好，疼疼痛", "CHI_a_b ", None), ("", None, "t")], "s string, i string, n string")
    r = df.select(text.marks(F.col("s")), text.canonical_id(F.col("i")), text.cue_count(F.col("s"), ["疼", "痛"]), text.first_cue(F.col("s"), ["肿", "痛", "疼"]), text.contains_any(F.col("s"), ["a.b", "疼"]), text.combined_text(F.col("n"), F.col("i"), F.col("s"))).collect()
    assert tuple(r[0])[:5] == (["牙痛", "张三"], "a_b", 2, "痛", True)
    assert r[1][5] == "t" and r[0][5].startswith("CHI_a_b\n#")


def test_unit_ids_skip_those_in_use(spark):
    df = extraction(spark, {"units": [unit(), unit(unit_id="p_u001"), unit(unit_id=" "), unit(unit_id="x")]}, {"units": None})
    got = units.assign_unit_ids(df).select(F.expr("transform(units, u -> u.unit_id)")).collect()
    assert got[0][0] == ["p_u002", "p_u001", "p_u003", "x"] and got[1][0] is None


def test_flatten_keeps_accepted_units(spark):
    df = extraction(spark, {"units": [unit(), unit(judge_verdict="reject"), unit(assertion="negated"), unit(support_type="unsupported"), unit(judge_verdict=None)], "content_function": None})
    assert units.flatten_units(df).count() == 1
    assert units.flatten_units(df, False).count() == 5
    assert units.flatten_units(df).first()["content_function"] == ""


def test_issues(spark):
    df = extraction(
        spark,
        {"post_id": "good", "units": [unit()]},
        {"post_id": "late", "relevance_label": "R0", "units": [unit()]},
        {"post_id": "bad", "units": [unit(domain="x", evidence_span_original="不在"), unit(confidence=1.5, normalized_concept_en=" "), unit(evidence_span_original=None)]},
        {"post_id": "none", "relevance_label": None, "experiencer_label": None, "content_function": None, "units": None},
    )
    got = {r[0]: set(r[1]) for r in units.unit_issues(df).collect()}
    assert got["good"] == set()
    assert got["late"] == {"downstream_after_non_r1", "units_after_non_r1", "units_for_ineligible_row"}
    assert got["bad"] == {"invalid_csm_domain", "evidence_span_not_found", "confidence_out_of_range", "missing_concept", "missing_evidence_span"}
    assert "missing_relevance" in got["none"]


def test_summary_and_verdicts(spark):
    df = extraction(spark, {"units": [unit(unit_id="a"), unit(unit_id="b")]}, {"post_id": "q", "experiencer_label": "E2", "units": []})
    s = {(r[0], r[1]): r[2] for r in units.gold_summary(df).collect()}
    assert (s["posts", ""], s["units", ""], s["primary_posts", ""], s["proxy_posts", ""], s["domain", "Symptom Description"]) == (2, 2, 1, 1, 2)
    v = spark.createDataFrame([("p", 1, "a", "reject"), ("p", 2, "a", "accept"), ("p", 3, "b", "nonsense")], "post_id string, seq int, unit_id string, judge_verdict string")
    got = units.apply_verdicts(df.where("post_id = 'p'"), v).select(F.expr("transform(units, u -> u.judge_verdict)")).first()[0]
    assert got == ["accept", "needs_human_review"]


def test_repair():
    good = unit(unit_id="u1")
    broken = '{"units": [' + json.dumps(good, ensure_ascii=False) + " " + json.dumps(good, ensure_ascii=False) + "]}"
    assert repair.read_units("<think>{x}</think>" + json.dumps({"units": [good]}))[0] == "ok"
    status, found = repair.read_units(broken)
    assert status == "recovered" and len(json.loads(found)) == 2
    assert repair.read_units("no json")[0] == "none" and repair.read_units(None)[0] == "none"
    assert repair.read_units('{"a": }')[0] == "malformed"
    assert repair.read_labels('{"label": "R1", "evidence": "cut', ["label"]) == ("recovered", {"label": "R1"})
    assert repair.read_labels("nothing", ["label"])[0] == "missing"
    assert repair.read_verdicts('{"unit_verdicts": [{"unit_id": "a", "judge_verdict": "accept"} {"unit_id": "b"}]}') == ("recovered", [("a", "accept")])


def test_page_state(spark):
    page = '<script>window.__INITIAL_STATE__={"note":{"currentNoteId":"n1","noteDetailMap":{"n1":{"note":{"noteId":"n1","title":"a } \\" undefined","time":1700000000000,"imageList":[{"urlDefault":"http://i"},{}],"tagList":[{"name":"x"}],"interactInfo":{"likedCount":"12","commenCount":"1.2万"},"x":undefined}}}}}</script>'
    state = repair.page_state(page)
    assert "undefined" in json.loads(state)["note"]["noteDetailMap"]["n1"]["note"]["title"]
    assert repair.page_state("<p>") is None and repair.page_state(None) is None
    df = spark.createDataFrame([(state,)], "s string").select(notes.note_of_state(F.col("s")).alias("n"))
    r = df.select(*notes.detail_fields(F.col("n"))).first()
    assert (r["note_id"], r["liked_count"], r["comment_count"], r["images"], r["hashtags"], r["publish_time"]) == ("n1", 12, 0, "http://i", "x", "2023-11-14 22:13:20")


def test_cards(spark):
    raw = json.dumps({"id": "7", "noteCard": {"displayTitle": "", "title": "t", "user": {"nickName": "n"}, "interactInfo": {"likedCount": "5", "sharedCount": "x"}}})
    r = spark.createDataFrame([(raw,)], "r string").select(*notes.card_fields(F.col("r"))).first()
    assert (r["note_id"], r["title"], r["type"], r["author_name"], r["liked_count"], r["share_count"]) == ("7", "t", "normal", "n", 5, 0)


def test_first_wins_and_merge(spark):
    df = spark.createDataFrame([(3, "a", "z"), (1, "a", "y"), (2, None, "x"), (4, None, "w"), (5, "", "v"), (6, "", "u")], "id long, note_id string, t string")
    assert sorted(r["id"] for r in notes.first_wins(df, "note_id", "id").collect()) == [1, 2, 4, 5]
    have = df.where("id = 3")
    assert sorted(r["id"] for r in notes.merge_stores(have, df.where("note_id is not null"), "note_id", "id").collect()) == [3, 5]


def test_exclusion_reasons_lists_all(spark):
    keyed = spark.createDataFrame([(1, "CHI:a", "f1", None, None), (2, "CHI:b", "f2", None, "g"), (3, None, None, None, None)], "row_id long, id_key string, fp_clean string, fp_source string, fp_given string")
    prot = spark.createDataFrame([("gold", "id", "CHI:a"), ("gold", "id", "CHI:a"), ("eval", "fingerprint", "f1"), ("eval", "fingerprint", "g")], "set_name string, key_type string, key string")
    got = {r[0]: r[1] for r in splits.exclusion_reasons(keyed, prot, "row_id").collect()}
    assert got == {1: ["eval_fingerprint", "gold_id"], 2: ["eval_fingerprint"], 3: []}


def test_lookup_spreads_and_keeps_nulls(spark):
    left = spark.range(200).selectExpr("id", "case when id % 3 = 0 then null else 'hot' end as k")
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    rows = lookup(left, right, "k", ["id"]).collect()
    assert len(rows) == 200 and {(r["k"], r["v"]) for r in rows} == {(None, None), ("hot", 1)}


def test_fewshot_equals_loop(spark):
    import random

    rng = random.Random(4)
    gold = [(i, rng.choice("AB"), str(rng.randrange(6)), rng.choice(["zh", "ja"]), rng.choice("xy"), rng.choice("pq")) for i in range(40)]
    qs = [(100 + i, rng.choice("AB"), str(rng.randrange(6)), rng.choice(["zh", "ja"])) for i in range(12)]
    got = {}
    df = retrieve.fewshot_pick(spark.createDataFrame(qs, "id long, country string, canonical string, language string"), spark.createDataFrame(gold, "id long, country string, canonical string, language string, label_a string, label_b string"), 8)
    for r in df.collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["gid"]
    for qid, c, k, lang in qs:
        out, seen = [], set()
        for pool in (True, False):
            rows = [g for g in gold if (g[3] == lang) == pool and (g[1], g[2]) != (c, k)]
            lead = []
            for g in rows:
                if g[4:] not in seen:
                    seen.add(g[4:])
                    lead.append(g)
            out += lead + [g for g in rows if g not in lead]
        assert [got[qid][i + 1] for i in range(8)] == [g[0] for g in out[:8]]


def test_fewshot_of_a_post_with_many_rows(spark):
    # The query's own post leads both label pairs and has more rows than k allows for.
    own = [(i, "A", "1", "zh", "x", "p" if i < 40 else "q") for i in range(60)]
    rest = [(100 + i, "A", str(2 + i % 4), "zh", "x", "p") for i in range(6)] + [(200, "B", "9", "zh", "x", "q"), (200, "B", "9", "zh", "x", "q"), (201, "B", "1", "ja", "y", "p")]
    q = spark.createDataFrame([(1, "A", "1", "zh"), (2, "B", "9", "zh")], "id long, country string, canonical string, language string")
    g = spark.createDataFrame(own + rest, "id long, country string, canonical string, language string, label_a string, label_b string")
    got = {}
    for r in retrieve.fewshot_pick(q, g, 8).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["gid"])
    assert got == {1: [100, 200, 101, 102, 103, 104, 105, 200], 2: [0, 40, 1, 2, 3, 4, 5, 6]}


def test_dense_blocks_are_bounded(spark, monkeypatch):
    import random

    rng = random.Random(5)
    v = {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(200)}
    e = spark.createDataFrame(list(v.items()), "id long, v array<float>").cache()
    sizes, real = [], retrieve.F.broadcast
    monkeypatch.setattr(retrieve.F, "broadcast", lambda df: (sizes.append(df.count()), real(df))[1])
    got = [sorted(map(tuple, retrieve.dense_topk(e, e.where("id % 2 = 0"), "id", "v", **x).collect())) for x in ({"block_bytes": 128 * 20}, {})]
    assert got[0] == got[1] and len(got[0]) == 500
    assert sizes[-1] == 100 and len(sizes) == 6 and sum(sizes[:-1]) == 100 and max(sizes[:-1]) <= 40


def test_cleaning_and_dates(spark):
    df = spark.createDataFrame([("ｔ&amp;t", "a​b\r\n\n\n\nhttps://x.y/z  c", "3天前"), (None, "", "05-20"), (None, None, "2023年1月2日")], "t string, b string, d string")
    rows = df.select(clean.clean_text(F.col("t"), F.col("b")).alias("c"), clean.recover_date(F.col("d"), F.to_date(F.lit("2024-03-01"))).alias("d")).collect()
    assert rows[0]["c"] == "t&t\nab\n\n[URL] c" and str(rows[0]["d"]["day"]) == "2024-02-27"
    assert rows[1]["c"] == "" and (str(rows[1]["d"]["day"]), rows[1]["d"]["precision"]) == ("2023-05-20", "year_inferred")
    assert str(rows[2]["d"]["day"]) == "2023-01-02"


def test_fdr_and_bootstrap(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, None)], "id long, p double")
    got = {r["id"]: round(r["q"], 6) for r in metrics.fdr(p, "p").collect()}
    assert got == {1: 0.04, 2: 0.053333, 3: 0.053333, 4: 0.5}
    r = metrics.bootstrap_ci(spark.range(500).selectExpr("id", "cast(id % 10 as double) as v"), "v", "id", 100).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.2


def test_files(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text("Post_ID,Text\n0012,好疼\n0013,\n", encoding="utf-8")
    df = files.load_posts(files.read_table(spark, str(p)), country="CHI", language="zh")
    assert [(r["post_id"], r["issues"]) for r in df.collect()] == [("0012", []), ("0013", ["missing_text"])]
    p.write_text("Post_ID,Text,Title\n1,,好疼\n2,,\n", encoding="utf-8")  # a title alone is a text
    df = files.load_posts(files.read_table(spark, str(p)), country="CHI", language="zh", drop_empty=True)
    assert [(r["post_id"], r["original_title"], r["issues"]) for r in df.collect()] == [("1", "好疼", [])]
    p.write_text("Post_ID,Text\n0012,好疼\n0013,\n", encoding="utf-8")
    with pytest.raises(ValueError, match="Ambiguous post_id"):
        files.infer_columns(["post_id", "id", "text"])
    with pytest.raises(ValueError, match="country must be provided"):
        files.load_posts(files.read_table(spark, str(p)))
    with pytest.raises(ValueError, match="Unsupported"):
        files.read_table(spark, "x.txt")
    j = tmp_path / "x.jsonl"
    j.write_text('{"record_id": "a", "text": "t"}\n\n{"post_id": null, "record_id": "b", "odd": 1}\nnonsense\n', encoding="utf-8")
    rows = {r["line"]: (r["post_id"], r["issues"]) for r in files.read_jsonl(spark, str(j), schema.POST).collect()}
    assert rows == {1: ("a", []), 3: (None, ["unknown_keys:odd"]), 4: (None, ["malformed_json"])}
    out = tmp_path / "collect_a_b_c" / "note_1"
    out.mkdir(parents=True)
    (out / "note_parsed.json").write_text('{"note_id": "1"}')
    (tmp_path / "snapshot_k_1").mkdir()
    (tmp_path / "snapshot_k_1" / "all_notes.json").write_text('[{"note_id": "2"}, {"note_id": "3"}]')
    assert sorted((r["keyword"], json.loads(r["raw"])["note_id"]) for r in files.read_collected(spark, str(tmp_path)).collect()) == [("a", "1"), ("k", "2"), ("k", "3")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    kind = "keyword string, note_id string, at timestamp"
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(src))
    for k, rows in enumerate([[("a", "1"), ("a", "1"), ("b", "2")], [("a", "1")], [("a", "1"), ("b", "3")]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"keyword": w, "note_id": n, "at": "2024-01-01T00:00:00Z"}) for w, n in rows))
    target, q = str(tmp_path / "out"), None
    q = stream.writeStream.foreachBatch(ledger.append_new(target)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["note_id"] for r in spark.read.parquet(target).collect()) == ["1", "2", "3"]
    q = ledger.progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["keyword"]: r["n"] for r in spark.table("progress").collect()} == {"a": 1, "b": 2}
    q = ledger.stale_sources(stream, "keyword", "note_id", 2).writeStream.format("memory").queryName("stale").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max((r["stale"], r["stopped"]) for r in spark.table("stale").where("keyword = 'a'").collect()) == (2, True)


def test_annotation_flow(spark):
    from threadmill.plans.annotate import annotate

    posts = spark.createDataFrame([(str(i), "CHI", "zh", f"牙疼 {i}") for i in range(6)], "post_id string, country string, language string, original_text string")
    seen = []

    def relevance(df):
        return df.select("post_id", F.when(F.col("post_id") == "0", "R0").otherwise("R1").alias("relevance_label"), F.when(F.col("post_id") == "5", F.lit("boom")).alias("error"))

    def labels(df):
        seen.append(sorted(r[0] for r in df.select("post_id").collect()))
        return df.select("post_id", F.lit("E1").alias("experiencer_label"), F.when(F.col("post_id") == "1", "C4").otherwise("C1").alias("content_function"))

    def extract(df):
        seen.append(sorted(r[0] for r in df.select("post_id").collect()))
        u = spark.createDataFrame([(unit(judge_verdict="accept"),)], f"u {schema.UNIT.simpleString()}")
        return df.select("post_id").crossJoin(u).groupBy("post_id").agg(F.collect_list("u").alias("units"))

    def judge(df):
        return df.where("post_id <> '4'").select("post_id", F.lit(1).alias("seq"), F.col("units")[0]["unit_id"].alias("unit_id"), F.lit("accept").alias("judge_verdict"))

    done, errors = annotate(posts, relevance, labels, extract, judge)
    rows = {r["post_id"]: r for r in done.collect()}
    assert seen == [["1", "2", "3", "4"], ["2", "3", "4"]]
    assert rows.keys() == {"0", "1", "2", "3", "4"} and [tuple(r) for r in errors.collect()] == [("5", "relevance", "boom")]
    assert rows["0"]["stages"] == ["relevance"] and rows["1"]["stages"] == ["relevance", "labels"] and rows["2"]["stages"][-1] == "judge"
    assert rows["2"]["units"][0]["unit_id"] == "2_u001" and rows["2"]["units"][0]["judge_verdict"] == "accept"
    assert rows["4"]["units"][0]["judge_verdict"] == "needs_human_review" and all(r["issues"] == [] for r in rows.values())


def test_rerank(spark):
    c = spark.createDataFrame([("q", g, 1.0 - g / 10, g) for g in range(1, 8)], "qid string, gid long, score double, rank long")
    s = spark.createDataFrame([("q", 3, 9.0), ("q", 2, float("nan")), ("q", 7, 99.0)], "qid string, gid long, rerank_score double")
    assert [r["gid"] for r in retrieve.rerank(c, s, 2).orderBy("rank").collect()] == [3, 1]


def test_pages(spark):
    from threadmill.operators import pages

    html = '<a href="/explore/ab12"><span>x</span><span>A long title</span></a><a href="/explore/ab12?xsec_token=T&y=1" title="t2"></a><a href="/search_result/cd34"><img alt="pic"></a><a href="/about">no</a><a href="/discovery/item/ef56"> own text </a>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "<a href")], "id long, html string")
    got = {r["note_id"]: (r["title"], r["xsec_token"]) for r in pages.link_cards(df, "id", "html").collect()}
    assert got == {"ab12": ("t2", "T"), "cd34": ("pic", ""), "ef56": ("own text", "")}
    states = [
        (1, json.dumps({"search": {"feeds": [{"id": "a", "noteCard": {"displayTitle": "x", "interactInfo": {"likedCount": "3"}}}, {"nope": 1}, {"id": "b", "note": {"title": "y"}}]}, "items": [{"id": "z"}]})),
        (2, json.dumps({"search": {"noteItems": []}, "items": [{"id": "z"}]})),
        (3, json.dumps({"note": {"noteDetailMap": {"k": {"note": {"noteId": "n", "title": "t"}}, "m": None}}})),
        (4, None),
    ]
    rows = pages.search_cards(spark.createDataFrame(states, "id long, s string"), "id", "s").collect()
    assert sorted((r["id"], r["note_id"], r["title"], r["liked_count"]) for r in rows) == [(1, "a", "x", 3), (1, "b", "y", 0), (3, "n", "t", 0)]
    cards = spark.createDataFrame([(1, k, f"n{k}") for k in range(20)], "id long, pos int, note_id string")
    counts = spark.createDataFrame([("n3", 5, 1, 0)], "note_id string, liked_count long, collected_count long, comment_count long")
    first = {r["note_id"]: (r["index"], r["liked_count"]) for r in pages.first_cards(cards, counts, "id").collect()}
    assert len(first) == 15 and first["n3"] == (4, 5) and first["n0"] == (1, 0)
