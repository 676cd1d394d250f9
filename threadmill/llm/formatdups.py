"""Duplicates hidden by formatting: records equal but for spacing, case, punctuation or order.

Text streams piece by piece through one lookup table, indexed by code point, that skips
all but letters and digits and folds case; the values that remain feed two polynomial
hashes modulo 2^64, which roll on from piece to piece. No canonical string is made: what
is held at a time is one piece of bounded size. A field that consists of "label: value"
lines is the sum of the mixed hashes of its lines, so their order doesn't matter; a record
is the unordered pair of its two fields, so they may be exchanged. Rows of one hash are
then compared with their group's representative by two pointers that skip what doesn't
count, each moving through its text in pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.joins import hot_groups, lookup
from threadmill.session import cut

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers never vanish
_LABELLED = re.compile(r"[^\n:：]{1,40}[:：]")
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads sums over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> folded code point, 0 for what is skipped: built by rule, not listed."""
    t = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalnum():
            t[cp] = ord(c.lower()[0])
    return t


#: Characters of text in one piece.
_PIECE = 1 << 16


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    p = np.full(_PIECE, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def folded(text: str, start: int = 0, end: int | None = None) -> np.ndarray:
    """What counts of a stretch of text, as folded code points."""
    codes = fold_table()[np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), "<u4")]
    return codes[codes != 0]


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, pieces of consecutive texts): _PIECE characters at most."""
    first, part, size = 0, [], 0
    for k, s in enumerate(texts):
        if part and size + len(s) > _PIECE:
            yield first, part
            part, size = [], 0
        if len(s) > _PIECE:
            for at in range(0, len(s), _PIECE):
                yield k, [s[at : at + _PIECE]]
            continue
        if not part:
            first = k
        part.append(s)
        size += len(s)
    if part:
        yield first, part


def poly_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the number of characters that count, for each text."""
    out = [np.zeros(len(texts), np.uint64) for _ in _BASES]
    counts = np.zeros(len(texts), np.int64)
    for first, part in _pieces(texts):
        codes = fold_table()[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")]
        ends = np.cumsum([len(s) for s in part])
        kept = np.concatenate(([0], np.cumsum(codes != 0)))[np.concatenate(([0], ends))]  # kept characters before each text
        values = _mix(codes[codes != 0])
        new = np.diff(kept)
        place = np.arange(len(values)) - np.repeat(kept[:-1], new)
        at = slice(first, first + len(part))
        for base, total in zip(_BASES, out):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base)[place], dtype=np.uint64)))
            # Only a text longer than a piece has characters before this one.
            before = np.uint64(pow(base, int(counts[first]), 1 << 64)) if len(part) == 1 else np.uint64(1)
            total[at] += (sums[kept[1:]] - sums[kept[:-1]]) * before
        counts[at] += new
    h1, h2 = (_mix(h + counts.astype(np.uint64)) for h in out)
    return h1, h2, counts


def _lines(s: str) -> list[str] | None:
    """The lines of a text that consists of at least two "label: value" lines, else None."""
    if "\n" not in s and "\r" not in s:
        return None
    lines = [x for x in re.split(r"[\r\n]+", s) if any(c.isalnum() for c in x)]
    return lines if len(lines) > 1 and all(_LABELLED.match(x) for x in lines) else None


def field_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """poly_hashes of each field, free of the order of its lines where it is labelled."""
    plain = [s or "" for s in texts]
    a, b, n = poly_hashes(plain)
    parts = [(k, x) for k, s in enumerate(plain) for x in (_lines(s) or ())]
    if parts:
        where = np.array([k for k, _ in parts])
        la, lb, _ = poly_hashes([x for _, x in parts])
        for h, lh in ((a, la), (b, lb)):
            h[np.unique(where)] = 0
            np.add.at(h, where, _mix(lh + np.uint64(1)))
    return a, b, n


def same_skipping(x: str, y: str) -> bool:
    """Whether two texts agree in all characters that count: two pointers, a piece at a time."""
    if x == y:
        return True
    i = j = 0
    a = b = np.zeros(0, np.uint32)
    while True:
        while not len(a) and i < len(x):
            a, i = folded(x, i, i + _PIECE), i + _PIECE
        while not len(b) and j < len(y):
            b, j = folded(y, j, j + _PIECE), j + _PIECE
        n = min(len(a), len(b))
        if not n:
            return len(a) == len(b)
        if (a[:n] != b[:n]).any():
            return False
        a, b = a[n:], b[n:]


def same_field(x: str, y: str) -> bool:
    """same_skipping, with the lines of labelled fields matched by their hash."""
    p, q = _lines(x), _lines(y)
    if p is None or q is None:
        return same_skipping(x, y)
    if len(p) != len(q):
        return False
    order = lambda lines: [lines[k] for k in np.lexsort(poly_hashes(lines)[:2])]
    return all(same_skipping(u, v) for u, v in zip(order(p), order(q)))


def same_record(t1: str, c1: str, t2: str, c2: str) -> bool:
    """Whether two records are equal, title and content exchanged or not."""
    return (same_field(t1, t2) and same_field(c1, c2)) or (same_field(t1, c2) and same_field(c1, t2))


def _digest(t: str, c: str) -> str:
    """An exact key for the rows of a hash collision only, from the same stream of pieces."""

    def stream(s: str) -> bytes:
        h = hashlib.sha256()
        for at in range(0, len(s), _PIECE):
            h.update(folded(s, at, at + _PIECE).tobytes())
        return h.digest()

    field = lambda s: hashlib.sha256(b"".join(sorted(map(stream, _lines(s) or [s])))).digest()
    return hashlib.sha256(b"".join(sorted((field(t), field(c))))).hexdigest()


def record_hashes(df: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """(id, h1, h2) of every row whose content has a letter or digit."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fields = [field_hashes(b.column(k).to_pylist()) for k in (1, 2)]
            (ta, tb, _), (ca, cb, n) = fields
            # Unordered pair: both hashes are symmetric in the two fields.
            h1 = _mix(ta + ca) ^ _mix(ta ^ ca)
            h2 = _mix(tb + cb + np.uint64(7)) + _mix((ta + tb) ^ (ca + cb))
            keep = pa.array(n > 0)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["id", "h1", "h2"])
            yield out.filter(keep)

    return df.select(F.col(key).cast("bigint"), title, content).mapInArrow(hashes, "id bigint, h1 bigint, h2 bigint")


def duplicate_members(df: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """(rep, id) for each row that repeats the record of a smaller id; verified.

    Groups are pre-aggregated to (smallest id, size) map-side; only groups of two or more
    go on. Rows meet their group's one row, and their representative's text, under as many
    salts as the group's size asks for, so a group that holds a third of all rows is spread
    over many tasks. Texts are moved for rows of such groups only.

    Defined results: null and '' fields are equal; rows whose content has no letter or
    digit are left out; rows without id can't be named and are left out; an id that occurs
    on several rows is paired once; empty tables give an empty result; columns other than
    the three aren't read, so names may clash.
    """
    return _members(df, key, title, content, cut(record_hashes(df, key, title, content).where("id is not null")))


def _members(df: DataFrame, key: str, title: str, content: str, hashes: DataFrame) -> DataFrame:
    groups = cut(hashes.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    met = lookup(hashes, groups.select("h1", F.col("h2").alias("g2"), "rep"), "h1", ["id"], "inner", hot_groups(groups, "h1", "n")).where("h2 = g2 and id <> rep")
    members = cut(met.select("id", "rep").distinct())
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(title, F.lit("")).alias("t"), F.coalesce(content, F.lit("")).alias("c"))
    rep_texts = texts.join(groups.select(F.col("rep").alias("id")).distinct(), "id").groupBy("id").agg(F.min(F.struct("t", "c")).alias("__x")).select(F.col("id").alias("rep"), F.col("__x.t").alias("t2"), F.col("__x.c").alias("c2"))
    rows = lookup(texts.join(members, "id"), rep_texts, "rep", ["id"], "inner", hot_groups(groups, "rep", "n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, t1, c1, t2, c2 = (b.column(k).to_pylist() for k in range(6))
            other = [None if same_record(*x) else _digest(x[0], x[1]) for x in zip(t1, c1, t2, c2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(other, pa.string())], names=["rep", "id", "other"])

    checked = cut(rows.select("rep", "id", "t", "c", "t2", "c2").mapInArrow(compare, "rep bigint, id bigint, other string"))
    equal = checked.where("other is null").select("rep", "id").distinct()
    # Rows whose hash collided form groups of their own, by an exact digest.
    apart = checked.where("other is not null")
    first = apart.groupBy("other").agg(F.min("id").alias("rep"))
    again = apart.select("other", "id").join(first, "other").where("id <> rep").select("rep", "id").distinct()
    return equal.union(again)


def collapse(df: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """One row per record: (id, n_copies), id being the smallest of its group.

    Rows whose content has no letter or digit are left out, as in duplicate_members.
    """
    hashes = cut(record_hashes(df, key, title, content).where("id is not null"))
    members = _members(df, key, title, content, hashes)
    every = hashes.select("id").distinct()
    counts = members.groupBy("rep").agg(F.count("*").alias("n"))
    return every.join(members.select("id"), "id", "left_anti").join(counts, F.col("id") == F.col("rep"), "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
