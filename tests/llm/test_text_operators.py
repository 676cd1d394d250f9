import random

import numpy as np
import pytest

from threadmill.llm.leakage import _Index, _run, codes_of, leaked_items, leaks, overlaps
from threadmill.llm.mixing import mix, mix_shares, splitting_tree, token_counts
from threadmill.llm.readlevel import MAX_BROADCAST_WORDS, coverage, hard_documents, reading_levels
from threadmill.llm.truncation import truncated, truncation_rates

STOCK = "转载请注明出处图片均为本人拍摄禁止用于任何形式的商业宣传与二次销售。"


def words(rng, n, pool="牙疼痛医生看了左上第二颗磨突然像针扎一跳的吃冰甲乙丙丁戊己庚辛"):
    return "".join(rng.choice(pool) for _ in range(n))


@pytest.mark.parametrize("broadcast_chars", [4_000_000, 100])
def test_stock_counts_items_not_rows(spark, broadcast_chars):
    # One sentence twice in an item (or in two rows of it) and once in another isn't stock.
    rng = random.Random(8)
    twice, rows, three = (words(rng, 40) + "。" for _ in range(3))
    items = [(1, twice + three + twice), (2, twice), (3, rows + three), (3, rows), (4, rows + three)]
    i = spark.createDataFrame([(k, "test", "zh", t) for k, t in items], "item_id long, item_set string, lang string, text string")
    d = spark.createDataFrame([(k, t) for k, t in enumerate((twice, rows, three))], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(d, i, broadcast_chars=broadcast_chars).collect()} == {(0, 1), (0, 2), (1, 3), (1, 4)}


def test_items_far_apart_on_one_diagonal():
    code = codes_of(words(random.Random(6), 40))
    empty = np.zeros(0, np.uint32)
    found = _Index(list(range(4097)), [code, *[empty] * 4095, code]).overlaps(code)
    assert set(found) == {0, 4096} and found[0] == found[4096]


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    items = [(k, "test", "en" if k % 5 == 0 else "zh", words(rng, 70) + "，" + words(rng, 50) + "。" + STOCK) for k in range(12)]
    norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
    docs = []
    for k in range(80):
        item = items[k % 12][3]
        a, n = rng.randrange(60), rng.choice([10, 29, 30, 31, 45, 59, 60, 80])
        piece = " ".join(norm(item)[a : a + n])
        docs.append((k, words(rng, 40) + piece + ("，" + STOCK if k % 2 else words(rng, 30))))
    docs += [(100, None), (101, ""), (None, items[1][3]), (1, docs[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items + [(50, "test", "zh", None), (51, "test", None, STOCK)], "item_id long, item_set string, lang string, text string")
    want = set()
    for doc, s in docs:
        for item, _, lang, t in items:
            if doc is not None and s:
                n, q = 60 if lang == "en" else 30, norm(t.replace(STOCK, ""))
                if any(q[x : x + n] in norm(s) for x in range(len(q) - n + 1)):
                    want.add((doc, item))
    assert {tuple(r) for r in leaks(d, i).collect()} == want
    # Items that are joined give the same.
    again = leaked_items(d, i, broadcast_chars=0)
    assert {(r["doc_id"], r["item_id"]) for r in again.collect() if r["run"] >= (60 if r["lang"] == "en" else 30)} == want
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def test_substitutions_are_tolerated(spark):
    rng = random.Random(8)
    t = words(rng, 120)
    s = list(t)
    for k in range(15, 120, 31):
        s[k] = "X"
    d = spark.createDataFrame([(1, "".join(s))], "doc_id long, text string")
    i = spark.createDataFrame([(1, "test", "zh", t)], "item_id long, item_set string, lang string, text string")
    r = leaked_items(d, i).first()
    assert r["run"] == 30 and r["overlap"] > 100


def test_overlaps_with_substitutions_against_brute_force(spark):
    # Stretches of 40 to 120 letters of an item with every letter substituted with a chance of up to 12 %.
    rng = random.Random(21)
    items = [(k, "test", "zh", words(rng, 200)) for k in range(20)]
    docs, want, got_by = [], set(), {}
    for k in range(400):
        a, n, rate = rng.randrange(80), rng.randrange(40, 120), rng.random() * 0.12
        piece = "".join(rng.choice("XYZ") if rng.random() < rate else c for c in items[k % 20][3][a : a + n])
        docs.append((k, words(rng, 30) + piece + words(rng, 30)))
        x, y = codes_of(docs[-1][1]), codes_of(items[k % 20][3])
        best = max(_run(x, y, max(d, 0), max(-d, 0))[1] for d in range(-len(y) + 1, len(x)))
        if best >= 30:
            want.add((k, k % 20))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, item_set string, lang string, text string")
    got_by = {(r["doc_id"], r["item_id"]) for r in overlaps(d, i).collect()}
    assert len(want) > 250 and len(want & got_by) >= 0.9 * len(want)


def test_repeated_letters_stay_cheap(spark):
    d = spark.createDataFrame([(1, "a" * 200_000 + "b"), (2, "ab" * 100_000), (3, "x" + "abc" * 12)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "t", "zh", "a" * 5000), (2, "t", "zh", "ab" * 3000), (3, "t", "zh", "y" + "abc" * 2000)], "item_id long, item_set string, lang string, text string")
    want = {(1, 1): 5000, (2, 2): 6000, (3, 3): 36}
    for chars in (10**6, 0):
        assert {(r["doc_id"], r["item_id"]): r["run"] for r in leaked_items(d, i, broadcast_chars=chars).where("run >= 30").collect()} == want


def test_truncation(spark):
    rng = random.Random(6)
    parts = ["医生说门牙要先拍了片子，过{}天再去。", "昨天冰敷之后好多了，今天又开始疼。", "去校医院看了一下，花了{}块，有点害怕。", "My dentist wants to start with icing the cheek, then see me in {} days."]
    line = lambda: rng.choice(parts).format(rng.randrange(2, 30))
    rows = [(k, "".join(line() for _ in range(3)) + rng.choice(["", "就这样吧……", "求推荐靠谱的牙医"]), None, "http://www.a.example/x") for k in range(600)]
    cuts = {1000: "医生说门牙要先拍了片", 1001: line() + "去校医院看了一下，花了3", 1002: line() + "昨天冰敷之后…展开", 1003: line() + "今天又�", 1004: line() + "My dentist wants to sta", 1005: line() + "医生说门牙要…"}
    rows += [(k, s, None, "http://b.example") for k, s in cuts.items()]
    rows += [(2000, None, None, None), (2001, " ", "", ""), (None, "一", None, None)]
    # However much white space follows, the end is seen.
    blanks = "。" + " " * 70
    rows += [(3000, "今天又开始疼" + blanks, None, None)]
    cuts[1006] = line() + "昨天冰敷之后see more…展开" + " " * 90
    rows += [(1006, cuts[1006], None, "http://b.example")]
    df = spark.createDataFrame(rows, "id long, content string, title string, source_url string")
    got = {tuple(r) for r in truncated(df, "id", ["title", "content"]).collect()}
    assert got == {(k, "content") for k in cuts}
    rates = {(r["site"], r["field"]): (r["n_values"], r["n_cut"]) for r in truncation_rates(df, "id", ["title", "content"], "source_url").collect()}
    assert rates["b.example", "content"] == (7, 7) and rates["a.example", "content"] == (600, 0)
    assert truncated(df.limit(0), "id", ["content"]).count() == 0


def test_reading_level_on_held_out_documents(spark):
    rng = random.Random(4)
    easy = [f"w{c}" for c in "abcdefghij"]
    hard = ["".join(rng.choice("bcdfghklmnprst") for _ in range(8)) for _ in range(400)]
    docs, labels = [], []
    for k in range(400):
        level = 1 + k % 4
        share = (level - 1) / 3
        docs.append((k, " ".join(rng.choice(hard) if rng.random() < share else rng.choice(easy) for _ in range(60)), "x"))
        if k < 200:
            labels.append((k, "r", level))
    docs += [(900, None, "x"), (901, "", "x"), (902, "12 ?!", "x"), (None, "wa", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, script string")
    l = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    got = {r[0] for r in hard_documents(d, l).collect()}
    held = range(200, 400)
    right = sum((k in got) == (k % 4 == 3) for k in held)
    assert right >= 0.97 * len(held) and not got & {900, 901, 902, None}
    assert reading_levels(d, l.limit(0)).where("level is not null").count() == 0
    assert hard_documents(d.limit(0), l).count() == 0


def test_coverage_rank_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30))) for k in range(20)]
    counts = {}
    for _, s in docs:
        for w in s.split():
            counts[w] = counts.get(w, 0) + 1
    rank = {w: 1 + sum(c > counts[w] for c in counts.values()) for w in counts}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for bound in (MAX_BROADCAST_WORDS, 0):  # both ways to look up ranks agree
        monkeypatch.setattr("threadmill.llm.readlevel.MAX_BROADCAST_WORDS", bound)
        got = {r["doc_id"]: r["cover"] for r in coverage(d).collect()}
        for k, s in docs:
            q = np.quantile(np.log1p(np.array([rank[w] for w in s.split()], np.float32)), [0.1, 0.5, 0.9])
            assert np.allclose([got[k][0], got[k][4], got[k][8]], q, atol=1e-5)


def test_mixing(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(["tooth"] * rng.randrange(5, 60)), "abc"[k % 3] if k < 300 else "tiny") for k in range(303)]
    docs += [(900, None, "a"), (901, "x", None), (None, "x", "a"), (902, "x y", "nogoal")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 3), ("c", 0.2, 3), ("tiny", 0.1, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    total = 9000
    rows = mix(d, t, total_tokens=total, shards=4, block_tokens=200).collect()
    uses, tokens = {}, {}
    for r in rows:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
    for s, share in (("a", 0.5), ("b", 0.2), ("c", 0.2)):
        assert abs(tokens[s] - share * total) <= 60
    assert all(uses[k] == 2 for k in (300, 301, 302)) and max(uses.values()) <= 3 and 902 not in uses
    assert len({(r["shard"], r["position"]) for r in rows}) == len(rows) and {r["shard"] for r in rows} == set(range(4))
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    shares = {r["source"]: r["actual_share"] for r in mix_shares(mix(d, t, total), t).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-4 and shares["absent"] == 0
    assert mix(d.limit(0), t).count() == 0 and mix(d, t.limit(0)).count() == 0
    assert {r["n_tokens"] for r in token_counts(d).where("doc_id = 900").collect()} == {0}


def test_splitting_tree_is_exact():
    q = np.array([7, 0, 100, 33])
    who, shard, count = splitting_tree(q, 6, 1)
    got = np.zeros((6, 4), int)
    got[shard, who] = count
    assert (count > 0).all() and len(count) == np.count_nonzero(got)
    assert (got.sum(0) == q).all() and got.sum(1).max() - got.sum(1).min() <= 2 and (got >= 0).all()
