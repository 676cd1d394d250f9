"""Near-duplicate texts within one corpus: candidates with their similarity, nothing is deleted.

Texts of equal words are one class. A class is the set of its shingles of five words; two
classes whose sets have a Jaccard similarity of at least 0.8 share one of the rarest
shingles of both (prefix filter), so classes meet at these only, and no pair is missed.
Which shingles are rare is read off a table of counts of fixed size, by hash: shingles that
fall together count together, which moves them in the order, but the order is the same for
all classes, and any such order misses no pair. A shingle that many texts share is
frequent, so it comes last and is rarely met at.

Texts made of the same stock sentences still meet in numbers that grow with the square of
the corpus. They are turned away inside the join: by the place of the shingle they meet at,
and by fingerprints of 128 bits, the parities of the numbers of shingles that fall on each
bit, which differ in no more bits than the sets differ in shingles.

Shingles are an order of magnitude more than their text, so they are made anew, in place,
wherever they are needed: what is moved or kept are compressed texts, the few rare
shingles, and pairs of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.joins import PER_SALT, hot_keys, lookup
from threadmill.session import cut

WORDS = 5
SIMILARITY = 0.8
#: Slots of the table of counts: it takes 16 MB where it is sent, four times as much while it is counted.
_SLOT_BITS, _PART_BITS = 24, 16
#: Characters of text taken up at once by a worker; one longer text is taken up alone.
_CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads sums over all bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Code point -> 1 for Latin letters and digits, 2 for other letters, 0 for the rest."""
    t = np.fromiter((2 if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint8, 0x110000)
    t[0x30:0x3A] = t[0x61:0x7B] = 1
    return t


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, hashes, sizes): the distinct runs of five words of lower-case texts, sorted by text and hash.

    A word is a run of Latin letters or digits, or one other letter; a shorter text is one run.
    """
    n = len(texts)
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")  # a line end behind each text
    ends = np.cumsum(np.fromiter((len(s) + 1 for s in texts), np.int64, n))
    kind = _kinds()[codes]
    edge = (kind == 2) | ((kind == 1) & (np.concatenate(([0], kind[:-1])) != 1))
    starts, at = np.flatnonzero(edge), np.flatnonzero(kind)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n, np.int64)
    place = at - starts[np.cumsum(edge)[at] - 1]
    letters = _mix(codes[at].astype(np.uint64) | (place + 1).astype(np.uint64) << np.uint64(21))
    word = _mix(np.add.reduceat(letters, np.flatnonzero(edge[at])))
    counts = np.bincount(np.searchsorted(ends, starts, "right"), minlength=n)
    runs = np.where(counts > 0, np.maximum(counts - (words - 1), 1), 0)
    owner = np.repeat(np.arange(n), runs)
    first = (np.cumsum(counts) - counts)[owner] + np.arange(len(owner)) - (np.cumsum(runs) - runs)[owner]
    h = word[first]
    for j in range(1, words):
        longer = _mix(h * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(first + j, len(word) - 1)])
        h = np.where(j < counts[owner], longer, h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
    owner, h = owner[new], h[new]
    return owner, h, np.bincount(owner, minlength=n)


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK characters each."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > _CHUNK:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) with the hash of the text's set of shingles, 16 bytes; texts without a word go."""
    for whole in batches:
        texts = whole.column(1).to_pylist()
        for first, last in _chunks([len(s) for s in texts]):
            owner, h, sizes = shingles(texts[first:last])
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            at = (np.cumsum(sizes) - sizes)[some]
            sums = np.stack([_mix(np.add.reduceat(_mix(h ^ np.uint64(seed)), at) + sizes[some].astype(np.uint64)) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
            data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(0, 16 * len(some) + 1, 16, dtype=np.int32)), pa.py_buffer(sums.tobytes())])
            part = whole.slice(first, last - first).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([data, part.column(0), part.column(1)], names=["h", "k", "t"])


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(h, k, t) for every row with a key and a word."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return rows.mapInArrow(_hashed, "h binary, k bigint, t string")


def near_duplicate_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id): the smallest key of the texts with the same shingles as the row's."""
    rows = cut(_rows(df, key, text).select(F.hex("h").alias("h"), F.col("k").alias(key)))
    classes = rows.groupBy("h").agg(F.min(key).alias("class_id"))
    return lookup(rows, classes, "h", [key], "inner").select(key, "class_id")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, t) as compressed blocks of (row, k, t); row numbers the classes once the result is written."""
    row = TaskContext.get().partitionId() << 33
    for whole in batches:
        for first, last in _chunks([len(s) for s in whole.column(1).to_pylist()]):
            b = whole.slice(first, last - first)
            table = pa.RecordBatch.from_arrays([pa.array(np.arange(row + first, row + last)), *b.columns], names=["row", "k", "t"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(table)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])
        row += whole.num_rows


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in b.column(0):
            yield from pa.ipc.open_stream(block.as_buffer())


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _counted(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each slot is hit by the hashes of all batches, as 1 + 8 log2(count), 0 for never.

    Every task sends one table, in compressed parts that are added up part by part.
    """
    width = 1 << _PART_BITS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << _SLOT_BITS, np.uint32)
        for h in hashes(batches):
            at, times = np.unique(_slots(h), return_counts=True)
            n[at] += times.astype(np.uint32)
        for p in range(len(n) // width):
            part = n[p * width : (p + 1) * width]
            if part.any():  # byte by byte: the upper ones are mostly 0
                data = pa.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1)):
                planes = np.frombuffer(pa.decompress(data.as_buffer(), 4 * width, codec="zstd"), np.uint8).reshape(4, width)
                n = np.ascontiguousarray(planes.T).view(np.uint32)[:, 0]
                sums[p] = sums[p] + n if p in sums else n.astype(np.int64)
        for p, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_code(n).tobytes()], pa.binary())], names=["part", "data"])

    schema = "part int, data binary"
    got = df.mapInArrow(local, schema).repartition(16, "part").mapInArrow(merged, schema).toArrow()  # 16 MB at most
    codes = np.zeros(1 << _SLOT_BITS, np.uint8)
    for p, data in zip(got.column("part").to_pylist(), got.column("data").to_pylist()):
        codes[p * width : (p + 1) * width] = np.frombuffer(data, np.uint8)
    return codes


def _code(n: np.ndarray | int) -> np.ndarray:
    return np.where(np.asarray(n) > 0, 1 + np.round(8 * np.log2(np.maximum(n, 1))), 0).astype(np.uint8)


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in _unpacked(batches):
        yield shingles(b.column(2).to_pylist())[1]


def _all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for c in b.columns:
            yield _mix(c.to_numpy())


def _leads(blocks: DataFrame, counts: Broadcast, similarity: float, least: int = 2) -> DataFrame:
    """(x, row, size, place, f, g) for the rarest shingles of every class, those that count ``least`` in their slot.

    f and g are the fingerprint. A shingle of one class can't be shared: it stands in front but is not met at.
    """
    code = int(_code(least))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unpacked(batches):
            owner, h, sizes = shingles(b.column(2).to_pylist())  # none is empty
            bit = np.uint64(1) << (h & np.uint64(63))
            halves = [np.bitwise_xor.reduceat(np.where(h >> np.uint64(6) & np.uint64(1) == half, bit, np.uint64(0)), np.cumsum(sizes) - sizes).view(np.int64) for half in (0, 1)]
            c = counts.value[_slots(h)]
            order = np.lexsort((h, c, owner))  # the owners stay as they are
            h, c, size = h[order], c[order], sizes[owner]
            place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[owner] + 1
            keep = (c >= code) & (place <= size - np.ceil(size * similarity - 1e-6) + 1)
            of = owner[keep]
            columns = [h[keep].view(np.int64), b.column(0).to_numpy()[of], size[keep].astype(np.int32), place[keep].astype(np.int32), *(x[of] for x in halves)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["x", "row", "size", "place", "f", "g"])

    return blocks.mapInArrow(leads, "x bigint, row bigint, size int, place int, f bigint, g bigint")


def _texts(blocks: DataFrame, needed: Broadcast, side: str) -> DataFrame:
    """(row_side, class_side, text_side) of the classes whose slot is among the needed ones."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unpacked(batches):
            yield b.filter(pa.array(needed.value[_slots(_mix(b.column(0).to_numpy()))] > 0))

    return blocks.mapInArrow(texts, "row bigint, k bigint, t string").toDF(f"row_{side}", f"class_{side}", f"text_{side}")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_a, class_b, text_a, text_b) with the similarity of the sets in place of the texts."""
    for whole in batches:
        a, b = (whole.column(i).to_pylist() for i in (2, 3))
        for first, last in _chunks([len(x) + len(y) for x, y in zip(a, b)]):
            n = last - first
            owner, h, sizes = shingles([*a[first:last], *b[first:last]])
            pair = owner % n
            order = np.lexsort((h, pair))
            pair, h = pair[order], h[order]
            common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=n)
            part = whole.slice(first, n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(common / (sizes[:n] + sizes[n:] - common))], names=["class_a", "class_b", "similarity"])


def near_duplicate_pairs(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(class_a, class_b, similarity): the pairs of classes at least that similar, a < b."""
    spark = df.sparkSession
    blocks = cut(_rows(df, key, text).groupBy("h").agg(F.min(F.struct("k", "t")).alias("c")).select("c.k", "c.t").mapInArrow(_packed, "block binary"))
    counts = _counted(blocks, _all_shingles)
    shared = spark.sparkContext.broadcast(counts)
    lead = _leads(blocks, shared, similarity)
    # Only shingles in a slot of so many can be hot, and these are hardly ever among the rarest of a text.
    hot = hot_keys(_leads(blocks, shared, similarity, PER_SALT), "x") if counts.max() >= _code(PER_SALT) else {}
    least = similarity - 1e-9

    def common(size: Column, other: Column) -> Column:
        """The least number of shingles that similar sets of these sizes share."""
        return F.ceil((size + other) * F.lit(least / (1 + least)) - F.lit(1e-6))

    def side(s: str) -> DataFrame:
        return lead.toDF("x", f"row_{s}", f"n{s}", f"place_{s}", f"f{s}", f"g{s}")

    # Two sets meet at the first shingle they share: behind it each has enough left to share.
    need = common(F.col("na"), F.col("nb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("row_a") < F.col("row_b")))
    differ = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) + F.bit_count(F.col("ga").bitwiseXOR(F.col("gb")))
    fits = smaller & (F.col("place_a") <= F.col("na") - need + 1) & (F.col("place_b") <= F.col("nb") - need + 1) & (differ <= F.col("na") + F.col("nb") - need * 2)
    met = cut(lookup(side("a"), side("b"), "x", ["row_a"], "inner", hot, merge=True).where(fits).select("row_a", "row_b").distinct())
    needed = spark.sparkContext.broadcast(_counted(met, _all_rows))
    halves = lookup(met, _texts(blocks, needed, "a"), "row_a", ["row_b"], "inner", merge=True)
    pairs = lookup(halves, _texts(blocks, needed, "b"), "row_b", ["row_a"], "inner", merge=True)
    scored = pairs.select("class_a", "class_b", "text_a", "text_b").where("class_a <> class_b").mapInArrow(_scored, "class_a bigint, class_b bigint, similarity double")
    return scored.where(F.col("similarity") >= least).select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "similarity")


def near_duplicates(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((key, class_id), (class_a, class_b, similarity)): membership, and pairs of classes, a < b.

    class_id is the smallest key of the texts with the same shingles. Texts without a word
    are in no class; null keys are left out; a repeated key may be in several classes.
    """
    return near_duplicate_classes(df, key, text), near_duplicate_pairs(df, key, text, similarity)
