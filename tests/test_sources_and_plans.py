"""Sources, sinks, splits, measures and providers on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadmill import schema
from threadmill.operators import metrics, notes, retrieve, splits
from threadmill.operators.neardup import near_duplicates
from threadmill.plans import models
from threadmill.plans.annotate import annotate
from threadmill.sources import config, files

GOLD = {"post_id": "p", "country": "CHI", "language": "zh", "original_title": "", "original_text": "牙疼两天", "relevance_label": "R1", "experiencer_label": "E1", "content_function": "C1", "units": [{"unit_id": "a", "domain": "Symptom Description", "evidence_span": "牙疼", "confidence": 0.5}]}


def test_lines_are_numbered_in_their_file(spark, tmp_path):
    for name, n in (("a", 1000), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}\n" for k in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 1003 and all(r["raw"][1:] == str(r["line"]) for r in got)


def test_extraction_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    odd = {**GOLD, "units": [{**GOLD["units"][0], "colour": 1}]}
    p.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in (GOLD, odd)) + "\n", encoding="utf-8")
    rows = {r["line"]: r for r in files.read_jsonl(spark, str(p), schema.EXTRACTION).collect()}
    assert rows[1]["issues"] == [] and rows[1]["units"][0]["evidence_span_original"] == "牙疼"
    assert rows[2]["issues"] == ["unknown_keys:units.colour"]


def test_gold_files(spark, tmp_path):
    good = {**GOLD, "units": [{**GOLD["units"][0], "evidence_span_original": "牙疼"}]}
    write = lambda name, x: (tmp_path / name).write_text(json.dumps(x, ensure_ascii=False), encoding="utf-8") and str(tmp_path / name)
    a, b = write("a.json", [good]), write("b.json", [{**good, "post_id": "q"}])
    assert files.load_gold(spark, [a, b]).count() == 2
    with pytest.raises(ValueError, match="Duplicate post_id"):
        files.load_gold(spark, [a, a])
    with pytest.raises(ValueError, match="JSON list"):
        files.load_gold(spark, [a, write("c.json", good)])
    bad = {**good, "post_id": "r", "units": [{**good["units"][0], "evidence_span_original": "头疼"}]}
    with pytest.raises(ValueError, match="not found in source text of"):
        files.load_gold(spark, [write("d.json", [bad])])
    assert files.load_gold(spark, [write("d.json", [bad])], validate_spans=False).count() == 1


def test_classification_gold(spark, tmp_path):
    def sheet(rows):
        return spark.createDataFrame(rows, "`帖子ID` string, `原文标题` string, `原文正文` string, `经历主体` string, `内容功能` string")

    rows = files.classification_gold({"中文": sheet([("CHI_1", "题", "文", "E1", "C1")]), "日文": sheet([("1", None, "痛い", "E2", "C2")])})
    got = {r["country"]: (r["canonical_id"], r["language"], r["analysis_text_en"]) for r in rows.collect()}
    assert got == {"CHI": ("1", "zh", ""), "JPN": ("1", "ja", "")}
    with pytest.raises(ValueError, match="Duplicate canonical id"):
        files.classification_gold({"中文": sheet([("CHI_1", "a", "b", "E1", "C1"), ("XHS_1", "c", "d", "E1", "C1")])})
    with pytest.raises(ValueError, match="Missing source text"):
        files.classification_gold({"中文": sheet([("1", " ", None, "E1", "C1")])})
    out = str(tmp_path / "gold")
    rows.select(files.gold_json().alias("value")).write.text(out)
    again = files.load_classification_gold(spark, out)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.select(*files.GOLD_COLUMNS).collect()))
    assert [f.name for f in schema.POST.fields if f.name not in files.gold_posts(rows).columns] == []


def test_run_and_split_sinks(spark, tmp_path):
    posts = spark.createDataFrame([("1",), ("2",), ("3",)], "post_id string")
    results = spark.createDataFrame([("1", ["relevance"], []), ("2", [], ["x"])], "post_id string, stages array<string>, issues array<string>")
    errors = spark.createDataFrame([("3", "relevance", "boom")], "post_id string, stage string, error string")
    files.write_run(str(tmp_path / "run"), posts, results, errors, {"backend": "rules"})
    m = json.loads(spark.read.text(str(tmp_path / "run" / "run_manifest")).first()[0])
    assert (m["backend"], m["rows_attempted"], m["rows_completed"], m["rows_failed"], m["rows_with_stage_errors"], m["validation_ok"], m["validation_failed"]) == ("rules", 3, 2, 1, 1, 1, 1)
    assert spark.read.json(str(tmp_path / "run" / "errors")).count() == 1
    folder = str(tmp_path / "splits")
    rows = spark.createDataFrame([("a", "CHI", "zh", "short", None), ("b", "JPN", "ja", "long", "f")], "record_id string, country string, language string, length_band string, text_fingerprint string")
    files.write_splits(folder, {"main": rows}, files.eval_manifest(rows))
    files.write_splits(folder, {"main": spark.read.json(f"{folder}/main").limit(1)}, files.eval_manifest(rows))  # read from where it goes
    assert spark.read.json(f"{folder}/main").count() == 1
    files.write_eval_sidecars(rows, str(tmp_path / "eval"))
    lines = {r[0] for r in spark.read.text(str(tmp_path / "eval" / "ids")).collect()}
    assert lines == {"record_id,country,language,length_band,text_fingerprint", "a,CHI,zh,short,", "b,JPN,ja,long,f"}
    assert json.loads(spark.read.json(str(tmp_path / "eval" / "manifest")).first()["country_length_bands"]) == {"CHI:short": 1, "JPN:long": 1}


def test_pages_and_fallback(spark, tmp_path):
    (tmp_path / "note_1").mkdir()
    (tmp_path / "note_1" / "ssr.json").write_text("{}")
    (tmp_path / "note_1" / "other.txt").write_text("no")
    assert [tuple(r) for r in files.read_pages(spark, str(tmp_path)).collect()] == [("note_1", "ssr.json", "{}")]
    assert files.existing_or(str(tmp_path / "no"), str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.existing_or(str(tmp_path / "no"), str(tmp_path / "neither"))


def test_replacement_takes_what_is_free_in_any_stratum(spark):
    schema_ = "row_id long, country string, id_key string, fp_clean string"
    leaked = spark.createDataFrame([(100, "A", "x", "x"), (101, "B", "y", "y")], schema_)
    pool = spark.createDataFrame([(1, "A", "a", "f"), (2, "B", "b", "f"), (3, "B", "c", "g"), (4, "B", "kept", "h")], schema_)
    taken = spark.createDataFrame([("id", "kept")], "key_type string, key string")
    pick = lambda t, **k: {r["leaked"]: r["replacement"] for r in splits.stratified_replacement(leaked, pool, t, ["country"], "row_id", **k).collect()}
    # Row 2 shares its fingerprint with row 1, which stands in another stratum.
    assert pick(taken) == {100: 1, 101: 3}
    # Where row 1 may not be taken, row 2 is free.
    none = taken.union(spark.createDataFrame([("id", "a")], "key_type string, key string"))
    with pytest.raises(ValueError, match="No replacement candidate"):
        pick(none)
    assert pick(none, on_missing="null") == {100: None, 101: 2}
    # Repeated rows count once, rows without key not at all.
    leaked, pool = leaked.union(leaked).union(spark.createDataFrame([(None, "A", None, None)], schema_)), pool.union(pool)
    assert pick(taken) == {100: 1, 101: 3}


def test_replacement_equals_the_loop(spark):
    import random

    rng = random.Random(4)
    for _ in range(4):
        row = lambda k: (k, rng.choice("AB"), f"i{rng.randrange(14)}", f"f{rng.randrange(14)}")
        leaked, pool = [row(100 + k) for k in range(6)], [row(k) for k in range(25)]
        ids, fps, want = {"i0"}, {"f1"}, {}
        for k, c, *_ in leaked:
            free = [x for x in sorted(pool, key=lambda x: str(x[0])) if x[1] == c and x[2] not in ids and x[3] not in fps]
            want[k] = free[0][0] if free else None
            if free:
                ids.add(free[0][2])
                fps.add(free[0][3])
        frame = lambda rows: spark.createDataFrame(rows, "row_id long, country string, id_key string, fp_clean string")
        taken = spark.createDataFrame([("id", "i0"), ("fingerprint", "f1")], "key_type string, key string")
        got = splits.stratified_replacement(frame(leaked), frame(pool), taken, ["country"], "row_id", on_missing="null")
        assert {r["leaked"]: r["replacement"] for r in got.collect()} == want


def test_all_ids_of_a_title(spark):
    df = spark.createDataFrame([(f"n{k}", "same") for k in range(120)] + [("x", "one")], "note_id string, title string")
    assert notes.repeated_titles(df).where("title = 'same' and n = 120").select("note_id").distinct().count() == 120


def test_fewshot_leaves_out_the_own_post_only(spark):
    gold = spark.createDataFrame([(k, "CHI", "own", "zh", "a", "b") for k in range(1, 8)] + [(8, "CHI", "other", "zh", "a", "b")], "id long, country string, canonical string, language string, label_a string, label_b string")
    q = spark.createDataFrame([(1, "CHI", "own", "zh")], "id long, country string, canonical string, language string")
    assert [r["gid"] for r in retrieve.fewshot_pick(q, gold, 1).collect()] == [8]


def test_permutation_null_and_stability(spark):
    rows = [(r, x) for r in range(60) for x in (("a", "b") if r % 2 else ("c", "d"))] + [(r, "e") for r in range(0, 60, 3)]
    items = spark.createDataFrame(rows, "row long, item string")
    p = {(r["a"], r["b"]): r["p"] for r in metrics.permutation_null(items, rounds=8).collect()}
    assert p["a", "b"] == p["c", "d"] == pytest.approx(1 / 9) and all(0 < x <= 1 for x in p.values())
    one = metrics.permutation_null(spark.createDataFrame([(r, x) for r in range(20) for x in "abc"], "row long, item string"), rounds=4)
    assert {r["n"] for r in one.collect()} == {20}
    stable = {(r["a"], r["b"]): r["selected"] for r in metrics.edge_stability(items, rounds=10, least=20).collect()}
    assert stable["a", "b"] == 1.0 and stable.get(("b", "e"), 0) < 0.5


def test_ties_of_p_have_one_q(spark):
    got = {r["id"]: round(r["q"], 9) for r in metrics.fdr(spark.createDataFrame([(k, p) for k, p in enumerate([0.2, 0.2, 0.2, 0.9, 0.01])], "id long, p double"), "p").collect()}
    assert got == {0: 0.25, 1: 0.25, 2: 0.25, 3: 0.9, 4: 0.05}
    assert metrics.fdr(spark.createDataFrame([], "id long, p double"), "p").count() == 0


def test_near_duplicates_edge_cases(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words).upper() + "!"), (3, " ".join([*words[:-1], "x"])), (4, None), (5, ""), (6, "one two"), (7, " ".join(words[20:])), (None, "a b c d e")]
    members, pairs = near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (6, 6), (7, 7)}
    assert [(r["class_a"], r["class_b"], round(r["similarity"], 6)) for r in pairs.collect()] == [(1, 3, round(35 / 37, 6))]
    empty = near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_near_duplicates_of_stock_sentences_keep_no_shingles(spark, tmp_path):
    import random

    r = random.Random(5)
    stock = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(12)) for _ in range(30)]
    texts = ["".join(r.sample(stock, 8)) for _ in range(500)]
    texts += [t[:-3] + "甲乙丙" for t in texts[:20]] + [t[:4] for t in texts[:9]]
    sets = [{t[i : i + 5] for i in range(max(len(t) - 4, 1))} for t in texts]
    first = {frozenset(s): k for k, s in reversed(list(enumerate(sets)))}.values()
    of = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b, round(of(a, b), 6)) for a in first for b in first if a < b and of(a, b) >= 0.8}
    was = spark.sparkContext.getCheckpointDir()
    try:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        pairs = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")[1]
        assert {(x["class_a"], x["class_b"], round(x["similarity"], 6)) for x in pairs.collect()} == want and len(want) >= 20
    finally:
        if was:
            spark.sparkContext.setCheckpointDir(was.rsplit("/", 1)[0])
    kept = sum(p.stat().st_size for p in tmp_path.rglob("part-*"))
    assert kept < sum(len(t.encode()) for t in texts)


def test_near_duplicates_broadcast_only_hot_keys(spark, monkeypatch):
    from threadmill.functions import joins
    from threadmill.operators import neardup

    kept = []
    for module in (joins, neardup):
        monkeypatch.setattr(module, "PER_SALT", 30)
    monkeypatch.setattr(neardup, "cut", lambda df, cut=neardup.cut: [kept.append(df), cut(df)][1])
    of = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    texts = [" ".join(f"w{j}" for j in range(12)) + f" end{k}" for k in range(40)]  # all meet at one shingle: 8 of 10 are shared
    some = [" ".join(f"{k}w{j}" for j in range(30)) + end for k in range(9) for end in ("", " x")]
    for rows, similar, hot in ((texts, 40 * 39 // 2, 1), (some, 9, 0)):
        kept.clear()
        pairs = neardup.near_duplicate_pairs(of(rows), "id", "text")
        assert {(r["class_a"], r["class_b"]) for r in pairs.collect()} == {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if hot or a // 2 == b // 2} and pairs.count() == similar
        met, texts_met = (df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0] for df in (kept[-1], pairs))
        assert met.count("SortMergeJoin") == 1 and (met.count("BroadcastHashJoin") > 0) == bool(hot)
        assert texts_met.count("SortMergeJoin") == 2


class Model:
    loaded = 0

    def close(self):
        pass


def run(model, prompts):
    if any("bad" in p for p in prompts):
        raise RuntimeError("no")
    return ['{"relevance_label": "R1", "experiencer_label": "E1", "content_function": "C1"}' if "units" not in p else '{"units": [{"domain": "Symptom Description", "evidence_span_original": "牙疼", "confidence": 0.5}]}' for p in prompts]


def judge(model, prompts):
    return ['{"unit_verdicts": [{"unit_id": "%s_u001", "judge_verdict": "accept"}]}' % p for p in prompts]


def test_providers_from_models(spark):
    posts = spark.createDataFrame([("1", "CHI", "zh", "牙疼"), ("2", "CHI", "zh", "bad"), ("3", "CHI", "zh", "牙疼了")], "post_id string, country string, language string, original_text string")
    text = F.col("original_text")
    relevance = models.label_provider(text, Model, run, ["relevance_label"])
    labels = models.label_provider(text, Model, run, ["experiencer_label", "content_function"])
    extract = models.unit_provider(F.concat(F.lit("units "), text), Model, run)
    done, failed = annotate(posts, relevance, labels, extract, models.judge_provider(F.col("post_id"), Model, judge))
    assert {(r["post_id"], r["units"][0]["judge_verdict"]) for r in done.collect()} == {("1", "accept"), ("3", "accept")}
    assert [(r["post_id"], r["stage"], r["error"]) for r in failed.collect()] == [("2", "relevance", "RuntimeError: no")]


def test_retriever_needs_a_ready_seed(spark):
    gold = spark.createDataFrame([("g", "CHI", "zh", "", "牙疼 两天", "", "R1", "E1", "C1", [])], f"post_id string, country string, language string, original_title string, original_text string, text_clean string, relevance_label string, experiencer_label string, content_function string, units array<{schema.UNIT.simpleString()}>")
    posts = gold.select(F.lit("p").alias("post_id"), "country", "language", "original_text")
    of = models.retriever(gold, F.col("original_text"))
    assert json.loads(of(posts).first()["examples"][0])["post_id"] == "g"
    assert models.retriever(gold, F.col("original_text"), k=0)(posts).first()["examples"] == []
    with pytest.raises(ValueError, match="Not ready"):
        models.retriever(gold, F.col("original_text"), min_proxy=1)


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    assert config.load_settings(str(p)) == config.DEFAULTS and p.exists()
    p.write_text('{"scheduler": {"daily_count": 7, "unknown": 1, "keywords": null}}')
    got = config.load_settings(str(p))["scheduler"]
    assert (got["daily_count"], got["keywords"]) == (7, config.DEFAULTS["scheduler"]["keywords"]) and "unknown" not in got
    p.write_text('{"session_limits": {"max_scrolls": 0}}')
    with pytest.raises(ValueError, match="session_limits.max_scrolls"):
        config.load_settings(str(p))
    stack = config.model_stack({"model_stack": {"a": {"model_id": "m"}, "reranker": {"model_id": "n"}}, "runtime": {"use_reranker": True}})
    assert stack.active() == ["a", "reranker"] and stack.missing(str(tmp_path)) == ["a", "reranker"]
    with pytest.raises(ValueError, match="Unknown model role"):
        stack.spec("b")


def test_stale_tracking_in_a_store(spark, tmp_path):
    from threadmill.streaming import ledger

    src, target, counters = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "counters")
    src.mkdir()
    batches = [[("a", "1"), ("b", "2")], [("a", "1"), ("b", "3")], [("a", "1"), ("a", "")], [("a", "4")]]
    for k, rows in enumerate(batches):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"keyword": s, "note_id": n}) for s, n in rows))
        os.utime(src / f"{k}.json", (1000 + k, 1000 + k))  # files are read in the order of their times
    stream = spark.readStream.schema("keyword string, note_id string").option("maxFilesPerTrigger", 1).json(str(src))
    sink = ledger.track_stale(target, counters, "keyword", 2)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["batch"], r["keyword"]): (r["batches"], r["stale"], r["stopped"]) for r in spark.read.parquet(counters).collect()}
    assert [got[k, "a"] for k in range(4)] == [(1, 0, False), (2, 1, False), (3, 2, True), (4, 0, False)]
    assert [got[k, "b"] for k in range(4)] == [(1, 0, False), (2, 0, False), (2, 0, False), (2, 0, False)]
    sink(spark.createDataFrame([("a", "4")], "keyword string, note_id string"), 3)  # replayed
    assert sorted(r["note_id"] for r in spark.read.parquet(target).collect()) == ["1", "2", "3", "4"]
    assert spark.read.parquet(counters).where("batch = 3 and keyword = 'a'").first()["stale"] == 0


def test_sqlite_store(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "other.db")
    with sqlite3.connect(path) as db:
        db.execute("create table notes (note_id text, title text, liked_count integer)")
        db.executemany("insert into notes values (?, ?, ?)", [(f"n{k}", "t", k) for k in range(100)] + [(None, None, None)])
    got = notes.scan_store(spark, path)
    assert got.columns == schema.NOTE.fieldNames()
    assert (got.count(), got.agg(F.sum("liked_count")).first()[0], notes.pool_ids(got).count()) == (101, 4950, 100)
