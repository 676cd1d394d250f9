import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm.crosssplit import cross_split_pairs, overlap_report, shared_wording, text_classes
from threadmill.llm.groupsplit import _cost, anneal, assign_components, hashed_start, record_keys, related_records, split_records, star_components

A, B, C = "a" * 24, "b" * 24, "c" * 24


def keys(spark, notes, posts=()):
    n = spark.createDataFrame(notes, "id long, author_id string, note_id string, label int, post string")
    p = spark.createDataFrame(list(posts), "row_id long, country string, post_id string, tbl string")
    return record_keys(n, p)


def test_groups(spark):
    notes = [
        (1, f"uid:{A.upper()}", "n1", None, None),
        (2, f"https://x/user/{B}?from=share", "n1", None, None),
        (3, B, "n2", None, None),
        (4, "unknown", "n2", None, None),
        (5, C, "n9", None, None),
        (6, None, "n7", None, None),
        (7, "", "", None, None),
        (8, None, None, None, None),
        (None, C, None, None, None),
    ]
    posts = [(1, "CHI", " XHS_n7", None), (2, "JPN", "n7", None), (3, "KOR", "KOR_5 ", None), (4, "KOR", "5", None), (5, None, "5", None), (6, "KOR", None, None)]
    got = {(r[0], r[1]): r[2] for r in related_records(keys(spark, notes, posts)).collect()}
    assert got == {**{("notes", k): A for k in (1, 2, 3, 4)}, ("notes", 5): C, ("notes", None): C, ("notes", 6): "CHI:n7", ("source_posts", 1): "CHI:n7", ("source_posts", 3): "KOR:5", ("source_posts", 4): "KOR:5"}
    assert related_records(keys(spark, notes[:0], posts[:0])).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_against_union_find(spark, shape):
    rng = random.Random(3)
    n = 60
    edges = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(n, i) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]}[shape]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_split_keeps_groups_whole(spark):
    rng = random.Random(5)
    notes = [(i, A if i % 3 == 0 else f"{rng.randrange(80):024x}", f"m{rng.randrange(400)}", None, None) for i in range(900)]
    k = keys(spark, notes)
    got = {(r[0], r[1]): r[2] for r in split_records(k, {"train": 0.5, "validation": 0.25, "test": 0.25}).collect()}
    assert len(got) == 900
    groups = {}
    for r in related_records(k).collect():
        groups.setdefault(r[2], set()).add(got[r[0], r[1]])
    assert all(len(v) == 1 for v in groups.values())


def text(seed, n=30):
    rng = random.Random(seed)
    return "。".join("".join(rng.choice("牙疼痛医生看了左上第二颗磨突然像针扎一跳的吃冰") for _ in range(14)) for _ in range(n // 5))


def entries(spark, manifest, posts):
    m = spark.createDataFrame(manifest, "entry_id long, split string, post_id string, country string, rep long")
    p = spark.createDataFrame(posts, "row_id long, post_id string, country string, original_title string, original_text string, text_clean string, source_file string, e long")
    return m, p


def test_cross_split(spark):
    t = text(1)
    near = "转一下 " + t.replace("。", " ,", 2)[:-2]
    half = t[: len(t) // 2] + text(2)[: len(t) // 2]
    manifest = [(1, "main", "CHI_1", "CHI", 0), (2, "eval_holdout", "2", "CHI", 0), (3, "csm_gold", "XHS_1 ", "CHI", 0), (4, "main", "4", "JPN", 0), (5, "eval_holdout", "5", "CHI", 0), (6, "eval_holdout", "1", "JPN", 0), (7, None, "1", "CHI", 0), (8, "eval_holdout", None, None, 0), (9, "main", "9", "KOR", 0)]
    posts = [
        (1, " CHI_1", "CHI", None, None, t, "f", 0),
        (2, "2", "CHI", "", near, "", "g", 0),
        (4, "4", "JPN", None, text(7), None, None, 0),
        (5, "5", "CHI", None, half, None, "g", 0),
        (6, "1", "JPN", None, "", None, None, 0),
        (9, "9", "KOR", None, None, None, None, 0),
    ]
    m, p = entries(spark, manifest, posts)
    assert {tuple(r) for r in cross_split_pairs(m, p).collect()} == {(1, 2), (1, 3)}
    report = {(r[0], r[1]): (r[2], r[3]) for r in overlap_report(m, p).collect()}
    assert report["eval_holdout", "g"] == (2, 1)
    # A post delivered in two files counts in both.
    again = p.union(p.where("row_id = 2").withColumn("row_id", F.lit(20).cast("long")).withColumn("source_file", F.lit("h")))
    report = {(r[0], r[1]): (r[2], r[3]) for r in overlap_report(m, again).collect()}
    assert report["eval_holdout", "g"] == (2, 1) and report["eval_holdout", "h"] == (1, 1)
    classes = {r["class_id"]: (r["n_train"], r["n_eval"], r["n_links"]) for r in text_classes(m, p).collect()}
    assert classes[2] == (0, 1, 1) and classes[4] == (1, 0, 0) and classes[5] == (0, 1, 0)
    assert cross_split_pairs(m.limit(0), p).count() == 0 and cross_split_pairs(m, p.limit(0)).count() == 1


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(9)
    base = [text(100 + k) for k in range(40)]
    manifest, posts = [], []
    for k in range(160):
        s = list(base[k % 40])
        for _ in range(rng.choice([0, 1, 3, 6, 40])):
            s[rng.randrange(len(s))] = rng.choice("甲乙丙丁")
        manifest.append((k, "main" if k % 4 else "eval_holdout", f"p{k}", "CHI", 0))
        posts.append((k, f"p{k}", "CHI", None, "".join(s), None, None, 0))
    m, p = entries(spark, manifest, posts)
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a, x in zip(manifest, posts) if a[1] != "main" for b, y in zip(manifest, posts) if b[1] == "main" and shared_wording(x[4], y[4]) >= 0.7}
    got = {tuple(r) for r in cross_split_pairs(m, p).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_pairs_at_three_quarters_all_meet(spark):
    # Texts of several lengths, edited to 0.70-0.80 shared triples: the end cut off, letters
    # exchanged here and there, a stretch inserted.
    rng = random.Random(12)
    manifest, posts = [], []
    for k in range(240):
        a = s = text(500 + k, 20 + 15 * (k % 4))
        while shared_wording(a, s) > 0.80:
            at = rng.randrange(len(s))
            if k % 3 == 0:
                s = s[:-1]
            elif k % 3 == 1:
                s = s[:at] + rng.choice("甲乙丙丁戊己") + s[at + 1 :]
            else:
                s = s[:at] + "".join(rng.choice("甲乙丙丁戊己") for _ in range(4)) + s[at:]
        for j, (split, x) in enumerate((("main", a), ("eval_holdout", s))):
            manifest.append((2 * k + j, split, f"p{2 * k + j}", "CHI", 0))
            posts.append((2 * k + j, f"p{2 * k + j}", "CHI", None, x, None, None, 0))
    m, p = entries(spark, manifest, posts)
    want = {(2 * k, 2 * k + 1) for k in range(240) if shared_wording(posts[2 * k][4], posts[2 * k + 1][4]) >= 0.7}
    assert len(want) > 200
    assert want <= {tuple(r) for r in cross_split_pairs(m, p).collect()}


def test_rare_labels_are_balanced(spark):
    # 64 labels of 12 rows and six of 10 rows beyond them; each row is a component of its own.
    rows = [(f"g{k}", f"often{k % 64}") for k in range(64 * 12)] + [(f"r{r}-{k}", f"rare{r}") for r in range(6) for k in range(10)]
    g = spark.createDataFrame(rows, "group_key string, label string")
    at = {r["group_key"]: r["split"] for r in assign_components(g, {"train": 0.5, "test": 0.5}).collect()}
    assert len(at) == len(rows)
    off = [abs(sum(at[f"r{r}-{k}"] == "train" for k in range(10)) - 5) for r in range(6)]
    assert sum(off) <= 3


def test_splits_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(15)
    notes = [(i, f"{rng.randrange(300):024x}", f"m{rng.randrange(2000)}", None, None) for i in range(1500)]
    shares = {"train": 0.6, "validation": 0.2, "test": 0.2}
    k = keys(spark, notes)
    one = {(r[0], r[1]): r[2] for r in split_records(k, shares).collect()}
    two = {(r[0], r[1]): r[2] for r in split_records(keys(spark, rng.sample(notes, len(notes))).repartition(7, "row_id"), shares).collect()}
    assert one == two


def test_proportions_and_labels_are_met(spark):
    rng = random.Random(16)
    rows = [(f"g{rng.randrange(1200)}", rng.choice("abbccc")) for _ in range(6000)]
    g = spark.createDataFrame(rows, "group_key string, label string")
    shares = {"train": 0.7, "validation": 0.2, "test": 0.1}
    got = {r["group_key"]: r for r in assign_components(g, shares).collect()}
    assert sum(r["n_rows"] for r in got.values()) == len(rows)
    for label in "abc":
        of = [got[k]["split"] for k, x in rows if x == label]
        assert all(abs(of.count(s) / len(of) - share) < 0.01 for s, share in shares.items())


def test_the_search_improves_on_the_hashed_start():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, (500, 3)).astype(float)
    target = np.array([[0.8], [0.2]]) * sizes.sum(0)[None, :]
    place = rng.random(500)
    start = np.zeros_like(target)
    np.add.at(start, hashed_start(place, target), sizes)
    assert anneal(sizes, target, place, 1, 4000)[1] < _cost(start, target) / 20


def test_a_hot_author_is_spread(spark, monkeypatch):
    monkeypatch.setattr("threadmill.functions.joins.PER_SALT", 50)
    notes = [(i, A if i % 3 == 0 else f"{i:024x}", f"m{i % 40 if i % 5 == 0 else i}", None, None) for i in range(900)]
    k = keys(spark, notes)
    want = {tuple(r) for r in related_records(k).collect()}
    monkeypatch.undo()
    assert want and want == {tuple(r) for r in related_records(k).collect()}
