import random

from threadmill.llm.formatdups import _digest, collapse, duplicate_members, field_hashes, same_record, same_skipping


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "id long, title string, content string, rep string, h1 int")
    return {tuple(r) for r in duplicate_members(df, "id", "title", "content").collect()}


def test_groups(spark):
    rows = [
        (1, "Title", "Some text, here!", None, 0),
        (2, "title", "some​ text\nHERE", None, 0),
        (3, "some text here", "Title.", None, 0),  # exchanged
        (4, "Title", "Some text there", None, 0),
        (5, None, "a：1\nb：2\nNo：3", None, 0),
        (6, "", "No: 3\n*b*：2\na:1。", None, 0),  # other order
        (7, None, "a：1\nb：2\nNo：4", None, 0),
        (8, "x", None, None, 0),
        (9, "x", " ,. ", None, 0),
        (10, None, "one sentence.\ntwo sentence.", None, 0),
        (11, None, "two sentence.\none sentence.", None, 0),
        (None, "Title", "Some text, here!", None, 0),
    ]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (5, 6)}
    assert pairs(spark, rows + rows[:1]) == {(1, 2), (1, 3), (5, 6)}
    df = spark.createDataFrame(rows, "id long, title string, content string, rep string, h1 int")
    assert {tuple(r) for r in collapse(df, "id", "title", "content").collect()} == {(1, 3), (4, 1), (5, 2), (7, 1), (10, 1), (11, 1)}
    assert duplicate_members(df.limit(0), "id", "title", "content").count() == 0


def test_hot_group_and_brute_force(spark):
    rng = random.Random(1)
    words = ["tooth", "牙", "痛い", "gum", "7"]
    texts = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(60)]
    rows = [(i, "t", texts[0] if i % 3 == 0 else rng.choice(texts) + rng.choice(["", "!", " \n"]), None, 0) for i in range(600)]
    canon = lambda s: "".join(c for c in s.lower() if c.isalnum())
    first = {}
    for i, _, s, *_ in rows:
        first.setdefault(canon(s), i)
    assert pairs(spark, rows) == {(first[canon(s)], i) for i, _, s, *_ in rows if first[canon(s)] != i}


def test_hashes_and_comparison():
    a, b, n = field_hashes(["Ab-c", "aB C", "", None, "x" * 300_000])
    assert a[0] == a[1] and b[0] == b[1] and n.tolist() == [3, 3, 0, 0, 300_000]
    assert same_skipping("A, b", "ab!") and not same_skipping("ab", "abc")
    assert same_record("t", "c: 1\nd: 2", "t", "d: 2\nc: 1") and not same_record("t", "c", "t", "d")
    assert _digest("T", "c: 1\nd: 2") == _digest("d 2", "t") or _digest("T", "x y") == _digest("XY", "t!")
