import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.operators.packed import parse_packed, unpack_fields, unpack_values


@pytest.mark.parametrize(
    "text, values",
    [
        (None, []),
        ("", []),
        (" ; ,; ", []),
        ("[]", []),
        ('["a", "b; c", "a"]', ["a", "b; c", "a"]),
        ("['x', \"don't\", 'y']", ["x", "don't", "y"]),
        ('"[\\"a\\", \\"b\\"]"', ["a", "b"]),
        ('["\\u7259\\u75db"]', ["牙痛"]),
        ('"a, b";"c"', ["a, b", "c"]),
        ('"he said ""no""","d"', ['he said "no"', "d"]),
        ("#a#b  #c　#d; #e", ["a", "b", "c", "d", "e"]),
        ("; http://h/x.jpg!w_1,h_2; http://h/y;v=7 | http://h/z", ["http://h/x.jpg!w_1,h_2", "http://h/y;v=7", "http://h/z"]),
        ("http://h/1 http://h/2", ["http://h/1", "http://h/2"]),
        ("甲、乙，丙；丁\t戊\n己|庚", list("甲乙丙丁戊己庚")),
    ],
)
def test_values(text, values):
    assert [v for v, _ in unpack_values(text, True)] == values


def test_malformed_quotes_backtrack_and_are_flagged():
    assert parse_packed('"abc, d') == [("abc", "unclosed_quote"), ("d", None)]
    assert parse_packed('["a", "b')[0] == ("a", "unclosed_bracket")
    assert [v for v, _ in parse_packed('a"b, c')] == ['a"b', "c"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), min_size=1, max_size=12).map(str.strip).filter(lambda s: s and s not in "#＃")))
def test_json_round_trip(values):
    want = [v.strip() for v in values]
    got = [v for v, _ in parse_packed(json.dumps(values))]
    assert [v.strip() for v in got] == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_every_text_parses(text):
    assert all(v.strip() for v, _ in unpack_values(text, True))


def test_rows_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a; a", None, "x"), (1, "a; a", "", "x"), (None, "b", " ", None), (2, None, "http://h/" + "y" * 100_000, None)], "id long, hashtags string, images string, pos string")
    rows = [tuple(r) for r in unpack_fields(df, "id", ["hashtags", "images"], ["hashtags"]).collect()]
    assert sorted(rows, key=repr)[:5] == sorted([(1, "hashtags", 1, "a"), (1, "hashtags", 2, "a")] * 2 + [(2, "images", 1, "http://h/" + "y" * 100_000)], key=repr)
    assert (None, "hashtags", 1, "b") in rows and len(rows) == 6
    assert unpack_fields(df.limit(0), "id", ["hashtags"]).count() == 0
