"""Same or nearly the same records across splits.

Texts are reduced to letters and digits; equal ones are one text from then on. A text is
the set of its character triples, repeated ones numbered. The triples are ordered by
frequency, rarest first, the same order for all texts; two texts that share enough of
them share one of the first triples of both (prefix filter), so texts of the evaluation
splits meet training texts at these. No pair that reaches SHARED is missed, whatever the
order. Pairs are dropped by bounds that hold for every pair (lengths, places of the triple
they met at, Hamming distance of 512-bit fingerprints), and what remains has its wording
compared. Fingerprints alone can't find the pairs: at three quarters of shared wording they
differ in so many bits that no segments or permuted blocks that are selective meet surely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.joins import lookup
from threadmill.llm.formatdups import _mix, folded, poly_hashes
from threadmill.llm.groupsplit import _PAD, post_key
from threadmill.llm.readlevel import chunks
from threadmill.session import cut

BITS = 512
WORDS = BITS // 64
SHARED = 0.7
#: Triples are counted in 2^20 cells; triples of one cell take its count together.
CELL_BITS = 20


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): the character triples of every text, by text; the k-th of equal ones of a
    text has a hash of its own. A text of fewer than three characters is one triple."""
    kept = [folded(s) for s in texts]
    kept = [c if len(c) > 2 else np.pad(c, (0, 3 - len(c))) for c in kept]
    sizes = np.array([len(c) for c in kept], np.int64)
    c = np.concatenate([*kept, np.zeros(0, np.uint32)]).astype(np.uint64)
    ends = np.cumsum(sizes)
    whole = np.ones(max(len(c) - 2, 0), bool)
    for k in (1, 2):  # triples over the end of a text
        whole[(ends[:-1] - k)[: len(ends) - 1]] = False
    h = _mix(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])[whole] if len(c) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes - 2)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(owner) != 0))) if len(h) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(h)]))))
    return _mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), owner


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def leading(h: np.ndarray, owner: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number for each text): the rarest triples of every text, in order. Any text that
    shares SHARED of a text's triples has one of these."""
    order = np.lexsort((h, counts[_cells(h)], owner))
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    few = sizes - np.ceil(SHARED * sizes - 1e-9).astype(np.int64) + 1
    return h[order][place < np.repeat(few, sizes)], few


def parities(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, WORDS): 512-bit fingerprints, each bit the parity of its triples: two texts differ in no
    more bits than triples."""
    bits = np.bincount(owner * BITS + (h & np.uint64(BITS - 1)).astype(np.int64), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(bits.astype(bool), axis=1).view(">i8").astype(np.int64)


def shared_wording(a: str, b: str) -> float:
    """Share of the longer text's character triples that the other has as well."""
    x, y = ("".join(map(chr, folded(s))) for s in (a, b))
    if x == y:
        return 1.0
    p, q = (Counter(s[k : k + 3] for k in range(max(1, len(s) - 2))) for s in (x, y))
    return sum((p & q).values()) / max(1, p.total(), q.total())


def post_texts(posts: DataFrame) -> DataFrame:
    """(row_id, ckey, text) of source posts: text_clean if not empty, else title and text."""
    filled = lambda c: F.col(c).isNotNull() & (F.regexp_replace(F.col(c), _PAD, "") != "")
    text = F.when(filled("text_clean"), F.col("text_clean")).otherwise(F.concat_ws("\n", "original_title", "original_text"))
    return posts.select("row_id", _entry_key(F.col("country"), F.col("post_id")).alias("ckey"), text.alias("text"))


def _entry_key(country: Column, post: Column) -> Column:
    return F.concat(F.regexp_replace(country, _PAD, ""), F.lit(":"), F.regexp_replace(post, _PAD, ""))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, np.int64)
    for b in batches:
        texts = b.column(0).to_pylist()
        for first, last in chunks(texts):
            total += np.bincount(_cells(triples(texts[first:last])[0]), minlength=1 << CELL_BITS)
    cells = np.flatnonzero(total)
    for at in range(0, len(cells), 1 << 16):
        part = cells[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])


def triple_counts(texts: DataFrame) -> np.ndarray:
    """How many triples of ``texts`` fall into each of the cells."""
    rows = texts.select("text").mapInArrow(_counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most 2^CELL_BITS rows
    counts = np.zeros(1 << CELL_BITS, np.int64)
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            h1, h2, n = poly_hashes([s or "" for s in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["row_id", "h1", "h2"]).filter(pa.array(n > 0))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [shared_wording(x, y) >= SHARED for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["e", "m"]).filter(pa.array(keep, pa.bool_()))


def similar_texts(texts: DataFrame, sides: DataFrame) -> DataFrame:
    """(e, m): evaluation texts and the training texts of nearly the same wording.

    ``texts`` is (rep, text) of distinct texts, ``sides`` (rep, main, eval) says on which
    sides a text stands. Triples of very many training texts are spread under salts; only
    pairs across the splits are formed, never pairs within a group.
    """
    texts = cut(texts.join(sides, "rep").select("rep", "text"))
    counts = texts.sparkSession.sparkContext.broadcast(triple_counts(texts))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in chunks(texts):
                h, owner = triples(texts[x:y])
                sizes = np.bincount(owner, minlength=y - x)
                words, (first, few) = parities(h, owner, y - x), leading(h, owner, sizes, counts.value)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(few))), pa.int32()), pa.array(first.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(sizes, pa.int32()), *(pa.array(words[:, k]) for k in range(WORDS)), lists], names=["rep", "n", *(f"c{k}" for k in range(WORDS)), "leading"])

    sided = cut(texts.mapInArrow(coded, f"rep bigint, n int, {', '.join(f'c{k} bigint' for k in range(WORDS))}, leading array<bigint>")).join(sides, "rep")
    a = sided.where("eval").select(F.col("rep").alias("e"), F.col("n").alias("ne"), *[F.col(f"c{k}").alias(f"e{k}") for k in range(WORDS)], F.posexplode("leading").alias("pe", "triple"))
    m = sided.where("main").select(F.col("rep").alias("m"), F.col("n").alias("nm"), *[F.col(f"c{k}").alias(f"m{k}") for k in range(WORDS)], F.posexplode("leading").alias("pm", "triple"))
    need = F.ceil(F.greatest("ne", "nm") * F.lit(SHARED) - F.lit(1e-9))
    # At the first triple a pair shares, no more are left than stand from there on in either.
    left = F.least(F.col("ne") - F.col("pe"), F.col("nm") - F.col("pm")) >= need
    far = sum((F.bit_count(F.col(f"e{k}").bitwiseXOR(F.col(f"m{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("e0").bitwiseXOR(F.col("m0"))))
    near = cut(lookup(m, a, "triple", ["m"], "inner").where((F.col("e") != F.col("m")) & left & (far <= F.col("ne") + F.col("nm") - 2 * need)).select("e", "m").distinct())
    t = texts.join(near.select(F.col("e").alias("rep")).union(near.select(F.col("m").alias("rep"))).distinct(), "rep", "left_semi")
    t = cut(t)
    pairs = lookup(lookup(near, t.select(F.col("rep").alias("e"), F.col("text").alias("x")), "e", ["m"], "inner"), t.select(F.col("rep").alias("m"), F.col("text").alias("y")), "m", ["e"], "inner")
    return pairs.select("e", "m", "x", "y").mapInArrow(_verified, "e bigint, m bigint").union(sides.where("eval and main").select(F.col("rep"), F.col("rep")))


class Overlaps:
    """What entries and texts of the splits have to do with each other.

    entries (entry_id, main, ckey, post), held (entry_id, main, rep) says which distinct
    texts an entry has, pairs (e, m) which evaluation text is nearly which training text.
    """

    def __init__(self, manifest: DataFrame, posts: DataFrame, training: str):
        key = _entry_key(F.col("country"), F.col("post_id"))
        self.entries = manifest.where("split is not null and entry_id is not null").select("entry_id", (F.col("split") == training).alias("main"), key.alias("ckey"), post_key(F.col("country"), F.col("post_id")).alias("post"))
        rows = post_texts(posts)
        hashed = rows.select("row_id", "text").mapInArrow(_hashed, "row_id bigint, h1 bigint, h2 bigint")
        hashed = cut(hashed.select("row_id", F.concat_ws(":", "h1", "h2").alias("h")))
        groups = hashed.groupBy("h").agg(F.min("row_id").alias("rep"))
        reps = lookup(hashed, groups, "h", ["row_id"], "inner").select("row_id", "rep")
        carried = cut(rows.select("row_id", "ckey").where("ckey is not null").join(reps, "row_id").select("ckey", "rep").distinct())
        self.held = cut(lookup(self.entries.where("ckey is not null").select("entry_id", "main", "ckey"), carried, "ckey", ["entry_id"], "inner").select("entry_id", "main", "rep").distinct())
        self.sides = cut(self.held.groupBy("rep").agg(F.bool_or("main").alias("main"), F.bool_or(~F.col("main")).alias("eval")))
        self.pairs = cut(similar_texts(rows.select(F.col("row_id").alias("rep"), "text"), self.sides))

    def entry_pairs(self) -> DataFrame:
        """(a, b): evaluation and training entries that are one post or have nearly the same text.

        One text or post may have a third of all entries: these are spread over salts.
        """
        side = lambda main, name, rep: self.held.where(F.col("main") == main).select(F.col("entry_id").alias(name), F.col("rep").alias(rep))
        by_text = lookup(side(False, "a", "e"), self.pairs, "e", ["a"], "inner").select("a", "m")
        by_text = lookup(side(True, "b", "m"), by_text, "m", ["b"], "inner").select("a", "b")
        of = lambda main, name: self.entries.where(F.col("post").isNotNull() & (F.col("main") == main)).select(F.col("entry_id").alias(name), "post")
        by_post = lookup(of(True, "b"), of(False, "a"), "post", ["b"], "inner").select("a", "b")
        return by_text.union(by_post).distinct()


def cross_split_pairs(manifest: DataFrame, posts: DataFrame, training: str = "main") -> DataFrame:
    """(entry_a, entry_b), smaller first: entries across the splits that overlap.

    They overlap where they are the same post (country and canonical id) or a text of one
    has nearly the same wording as a text of the other.

    Defined results: entries without a post row overlap by id only; null or empty ids
    and countries match nothing; empty texts match nothing; an entry listed twice gives
    its pairs under each entry_id; a split of null is an evaluation split of no name and
    is left out; empty tables give an empty result; other columns aren't read.
    """
    pairs = Overlaps(manifest, posts, training).entry_pairs()
    return pairs.select(F.least("a", "b").alias("entry_a"), F.greatest("a", "b").alias("entry_b")).distinct()


def text_classes(manifest: DataFrame, posts: DataFrame, training: str = "main") -> DataFrame:
    """(class_id, n_train, n_eval, n_links): every distinct text, its entries on both sides, and
    how many distinct texts of the other side it nearly is, itself included.

    class_id is the smallest row_id with the text. Copies aren't expanded into pairs.
    """
    found = Overlaps(manifest, posts, training)
    counts = found.held.groupBy(F.col("rep").alias("class_id")).agg(F.count_if("main").alias("n_train"), F.count_if(~F.col("main")).alias("n_eval"))
    ends = found.pairs.select(F.inline(F.array(F.struct(F.col("e").alias("class_id"), F.col("m").alias("other")), F.struct(F.col("m").alias("class_id"), F.col("e").alias("other"))))).distinct()
    links = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return counts.join(links, "class_id", "left").select("class_id", "n_train", "n_eval", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_report(manifest: DataFrame, posts: DataFrame, training: str = "main") -> DataFrame:
    """(split, source_file, n_entries, n_overlapping) per evaluation split and source file.

    An entry counts under every file that has its post, under '' where none has.
    """
    pairs = Overlaps(manifest, posts, training).entry_pairs()
    hit = pairs.select(F.col("a").alias("entry_id")).distinct().withColumn("hit", F.lit(1))
    files = posts.select(_entry_key(F.col("country"), F.col("post_id")).alias("ckey"), F.coalesce("source_file", F.lit("")).alias("source_file")).where("ckey is not null").distinct()
    evals = manifest.where((F.col("split") != training) & F.col("entry_id").isNotNull()).select("entry_id", "split", _entry_key(F.col("country"), F.col("post_id")).alias("ckey"))
    told = lookup(evals.join(hit, "entry_id", "left"), files, "ckey", ["entry_id"])
    return told.groupBy("split", F.coalesce("source_file", F.lit("")).alias("source_file")).agg(F.count("*").alias("n_entries"), F.count("hit").alias("n_overlapping"))
