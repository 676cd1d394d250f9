"""Evaluation passages that stand, whole or in part, in a training corpus.

Texts are read as letters and digits only. Spaced seeds, fixed masks over a window of
positions of which some are ignored, are hashed at every position of items and documents;
equal hashes are hits. Every hit is verified on its diagonal: the exact run around it, and
the overlap that tolerates substitutions. A run of at least the masks' span always gives a
hit, so no run of that length is missed; a window with a substitution is hit by a mask that
ignores its place.

Items of bounded size in total are broadcast with their sorted seeds, and documents are
scanned once and never shuffled. More items are joined: a bitmap of their seeds, of fixed
size, keeps the positions of documents that may hit, and these meet the seeds by hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.joins import lookup
from threadmill.llm.formatdups import _mix, fold_table, folded
from threadmill.llm.readlevel import chunks
from threadmill.session import cut

#: The masks: 1 where a position counts. Span 30 in blocks of five, weight 20; every place of
#: a window is ignored by one of the three, so a window with one substitution is still hit.
_BLOCK = 5
_COUNTED = ((1, 2, 4, 5), (0, 2, 3, 5), (0, 1, 3, 4))
MASKS = tuple("".join("1" * _BLOCK if k in blocks else "0" * _BLOCK for k in range(6)) for blocks in _COUNTED)
SPAN = len(MASKS[0])
_END = np.uint32(0x1FFFFF)  # stands between texts and equals nothing in them
_CHUNK = 1 << 20
#: Characters of items that are broadcast at most; more are joined.
BROADCAST_CHARS = 1_000_000
#: Bits of the bitmap of seeds: 4 MB where it stays in a worker, 16 MB where it is sent.
_NEAR_BITS, _FAR_BITS = 22, 27
#: Repeats of up to this period are looked at where they begin and end only.
_PERIODS, _MANY = 32, 512
_BREAK = "\U0010ffff"  # no character; stands between texts that are read together


def codes_of(text: str) -> np.ndarray:
    """Folded letters and digits of a text as code points."""
    return folded(text)


def seed_hashes(codes: np.ndarray) -> np.ndarray:
    """(masks, positions): each seed's hash at every position at which the whole mask fits."""
    n = len(codes) - SPAN + 1
    if n <= 0:
        return np.zeros((len(MASKS), 0), np.uint64)
    v = _mix(codes)
    block = np.zeros(len(codes) - _BLOCK + 1, np.uint64)
    for k in range(_BLOCK):
        block = block * np.uint64(0x9E3779B97F4A7C15) + v[k : k + len(block)]
    out = np.empty((len(MASKS), n), np.uint64)
    for i, blocks in enumerate(_COUNTED):
        h = np.full(n, i + 1, np.uint64)
        for k in blocks:
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + block[k * _BLOCK : k * _BLOCK + n]
        out[i] = _mix(h)
    return out


def outer(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which positions ``at`` of the hashes of a text stand where a repeat begins or ends.

    Inside a stretch that repeats with a short period the same hashes come again and again;
    its first and its last period show every run the whole stretch takes part in. Few
    positions are all kept.
    """
    if len(at) < _MANY:
        return np.ones(len(at), bool)
    keep = np.ones(len(at), bool)
    for p in range(1, min(_PERIODS, len(h) - 1) + 1):
        inner = (at >= p) & (at < len(h) - p)
        inner[inner] = (h[at[inner] - p] == h[at[inner]]) & (h[at[inner] + p] == h[at[inner]])
        keep &= ~inner
    return keep


def _sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^。！？!?\n]+?(?:[。！？!?\n]+|\.(?=\s|$)|$)", text)]


def prepared_items(items: DataFrame, several: int) -> DataFrame:
    """(item_row, item_id, codes): items as code points, a break in place of every stock sentence.

    Stock sentences are those that stand in at least ``several`` different items; they are
    counted, and taken out again, by joins on the sentence.
    """

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, r, k, c.tobytes()) for i, r, text in zip(*(b.column(x).to_pylist() for x in range(3))) for k, (x, y) in enumerate(_sentences(text)) if len(c := codes_of(text[x:y]))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(kinds)], names=["item_id", "item_row", "nr", "codes"])

    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), F.xxhash64("item_id", "text").alias("item_row"), "text").distinct()
    each = cut(rows.mapInArrow(sentences, "item_id bigint, item_row bigint, nr int, codes binary").withColumn("sentence", F.sha2("codes", 256)))
    stock = each.groupBy("sentence").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") >= several).select("sentence", F.lit(True).alias("stock"))
    told = lookup(each, stock, "sentence", ["item_row", "nr"])
    part = F.when(F.col("stock"), F.lit(_END.tobytes())).otherwise(F.col("codes"))
    whole = told.groupBy("item_id", "item_row").agg(F.array_sort(F.collect_list(F.struct("nr", part.alias("c")))).alias("parts"))  # the sentences of one item
    return cut(whole.select("item_row", "item_id", F.concat(F.lit(b""), F.aggregate(F.transform("parts", lambda x: x["c"]), F.lit(b""), lambda a, x: F.concat(a, x))).alias("codes")))


def _run(x: np.ndarray, y: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """(longest exact run, tolerant overlap) on the diagonal of x[i] and y[j].

    The tolerant overlap is the best stretch of the diagonal where a match counts 1 and a
    substitution -4: its length.
    """
    back = min(i, j)
    a, b = x[i - back :], y[j - back :]
    m = min(len(a), len(b))
    stop = np.flatnonzero((a[:m] == _END) | (b[:m] == _END))
    lo = stop[stop < back].max(initial=-1) + 1
    hi = stop[stop > back].min(initial=m)
    same = a[lo:hi] == b[lo:hi]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    runs = edge[1::2] - edge[::2]
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.argmin(score[: end + 1]))
    return int(runs.max(initial=0)), end - start


def item_seeds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, breaks before it) of an item's seeds; windows over a break hash what isn't text."""
    h = seed_hashes(codes)
    ends = np.concatenate(([0], np.cumsum(codes == _END)))
    n = h.shape[1]
    whole = ends[SPAN : SPAN + n] == ends[:n]
    out = [(row[at], at) for row in h for at in [np.flatnonzero(whole)] for at in [at[outer(row, at)]]]
    pos = np.concatenate([at for _, at in out])
    return np.concatenate([x for x, _ in out]), pos, ends[pos]


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def document_hits(codes: np.ndarray, may: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of a document at which the bitmap ``may`` allows a hit."""
    for at in range(0, max(len(codes) - SPAN + 1, 0), _CHUNK):
        for h in seed_hashes(codes[at : at + _CHUNK + SPAN - 1]):
            hit = np.flatnonzero(may[_cells(h, bits)] if may.dtype == bool else (may[_cells(h, bits) >> 3] >> (_cells(h, bits) & 7).astype(np.uint8)) & 1)
            if len(hit):
                hit = hit[outer(h, hit)]
                yield h[hit], hit + at


class _Index:
    """The seeds of items that are broadcast, sorted by hash."""

    def __init__(self, ids: list[int], codes: list[np.ndarray]):
        self.ids, self.codes = ids, codes
        seeds = [item_seeds(c) for c in codes]
        self.hash = np.concatenate([*(h for h, _, _ in seeds), np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(codes)), [len(h) for h, _, _ in seeds])
        self.pos = np.concatenate([*(p for _, p, _ in seeds), np.zeros(0, np.int64)])
        # A number for each unbroken piece of each item.
        pieces = np.array([np.count_nonzero(c == _END) + 1 for c in codes], np.int64)
        self.piece = (np.cumsum(pieces) - pieces)[self.item] + np.concatenate([*(b for _, _, b in seeds), np.zeros(0, np.int64)])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.pos, self.piece = (x[order] for x in (self.hash, self.item, self.pos, self.piece))
        self.may = np.zeros(1 << _NEAR_BITS, bool)
        self.may[_cells(self.hash, _NEAR_BITS)] = True

    def overlaps(self, codes: np.ndarray) -> dict[int, tuple[int, int]]:
        """item index -> (longest exact run, longest tolerant overlap) in one document."""
        return {i: x for (_, i), x in self.search(codes).items()}

    def search(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(number of the text, item index) -> overlaps, for texts with a break between any two."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        breaks = np.flatnonzero(codes == _END)
        for h, pos in document_hits(codes, self.may, _NEAR_BITS):
            left = np.searchsorted(self.hash, h, "left")
            counts = np.searchsorted(self.hash, h, "right") - left
            entry = np.repeat(left, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            pos = np.repeat(pos, counts)
            # One look a diagonal, text and unbroken piece of an item shows all its runs.
            piece, diagonal, doc = self.piece[entry], pos - self.pos[entry], np.searchsorted(breaks, pos)
            order = np.lexsort((diagonal, piece, doc))
            new = order[np.concatenate(([True], (np.diff(piece[order]) != 0) | (np.diff(diagonal[order]) != 0) | (np.diff(doc[order]) != 0)))] if len(order) else order
            for k in new:
                if (look := (int(doc[k]), int(piece[k]), int(diagonal[k]))) in seen:
                    continue
                seen.add(look)
                i = int(self.item[entry[k]])
                got = _run(codes, self.codes[i], int(pos[k]), int(self.pos[entry[k]]))
                old = found.get((look[0], i), (0, 0))
                found[look[0], i] = (max(old[0], got[0]), max(old[1], got[1]))
        return found


def together(texts: list[str]) -> np.ndarray:
    """Folded letters and digits of several texts, with a break between any two."""
    raw = np.frombuffer(_BREAK.join(s.replace(_BREAK, "") for s in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(raw == 0x10FFFF, _END, fold_table()[raw])
    return codes[codes != 0]


_FOUND = "doc_id bigint, item_id bigint, run int, overlap int"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "run", "overlap"])


def _by_broadcast(docs: DataFrame, prepared: DataFrame) -> DataFrame:
    part = prepared.select("item_id", "codes").toArrow()  # at most BROADCAST_CHARS characters
    items = [np.frombuffer(x, np.uint32) for x in part.column("codes").to_pylist()]
    shared = docs.sparkSession.sparkContext.broadcast((part.column("item_id").to_pylist(), items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for b in batches:
            index = index or _Index(*shared.value)
            ids, texts = b.column(0).to_pylist(), [s or "" for s in b.column(1).to_pylist()]
            for first, last in chunks(texts):
                yield _table([(ids[first + k], index.ids[i], *x) for (k, i), x in index.search(together(texts[first:last])).items()])

    return docs.mapInArrow(search, _FOUND)


def _by_join(docs: DataFrame, prepared: DataFrame) -> DataFrame:
    spark = docs.sparkSession

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                h, pos, piece = item_seeds(np.frombuffer(c, np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), row, np.int64)), pa.array(pos.astype(np.int32)), pa.array(piece.astype(np.int32))], names=["h", "item_row", "ipos", "piece"])

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << _FAR_BITS, bool)
        for b in batches:
            bits[_cells(b.column(0).to_numpy().view(np.uint64), _FAR_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    seeds = cut(prepared.mapInArrow(seeds_of, "h bigint, item_row bigint, ipos int, piece int"))
    may = np.zeros(1 << (_FAR_BITS - 3), np.uint8)
    for part in seeds.select("h").coalesce(8).mapInArrow(bitmap, "bits binary").toLocalIterator():
        may |= np.frombuffer(part["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(may)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for h, pos in document_hits(codes_of(text or ""), shared.value, _FAR_BITS):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), doc, np.int64)), pa.array(pos.astype(np.int32))], names=["h", "doc_id", "dpos"])

    met = lookup(cut(docs.mapInArrow(hits, "h bigint, doc_id bigint, dpos int")), seeds, "h", ["doc_id", "dpos"], "inner")
    looks = cut(met.groupBy("doc_id", "item_row", "piece", (F.col("dpos") - F.col("ipos")).alias("diagonal")).agg(F.min(F.struct("dpos", "ipos")).alias("at")).select("doc_id", "item_row", "at.dpos", "at.ipos"))
    # Each pair of texts meets once, with all the places to look at.
    places = looks.groupBy("doc_id", "item_row").agg(F.collect_list(F.struct("dpos", "ipos")).alias("places"))
    told = lookup(places, prepared.select("item_row", "item_id", "codes"), "item_row", ["doc_id"], "inner")
    with_text = docs.join(told, "doc_id").select("doc_id", "item_id", "text", "codes", F.transform("places", lambda x: x["dpos"]).alias("d"), F.transform("places", lambda x: x["ipos"]).alias("i"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc, item, text, codes, d, i in zip(*(b.column(k).to_pylist() for k in range(6))):
                x, y = codes_of(text or ""), np.frombuffer(codes, np.uint32)
                got = [_run(x, y, p, q) for p, q in zip(d, i) if p < len(x)]
                if got:
                    found.append((doc, item, max(r for r, _ in got), max(o for _, o in got)))
            yield _table(found)

    return with_text.mapInArrow(verify, _FOUND)


def leaked_items(documents: DataFrame, items: DataFrame, several: int = 3, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, lang, item_set, run, overlap) for every document and item that meet in a seed.

    run is the longest stretch of consecutive letters and digits they share, overlap the
    longest that tolerates substitutions. Items of ``broadcast_chars`` characters in all
    are broadcast, more are joined; both ways give the same.

    Defined results: null and empty texts meet nothing; items shorter than the masks' span
    meet nothing; repeated documents and items each count; null ids are left out; empty
    tables give an empty result; columns other than those named aren't read.
    """
    prepared = prepared_items(items, several)
    chars = prepared.agg(F.sum(F.octet_length("codes")) / 4).first()[0] or 0
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    found = _by_broadcast(docs, prepared) if chars <= broadcast_chars else _by_join(docs, prepared)
    about = items.select("item_id", "lang", "item_set")
    return lookup(found, about, "item_id", ["doc_id"], "inner", {}).select("doc_id", "item_id", "lang", "item_set", "run", "overlap")


MIN_RUN, MIN_RUN_EN = 30, 60


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with at least 30 (lang en: 60) consecutive letters or digits of an item."""
    need = F.when(F.col("lang") == "en", F.lit(MIN_RUN_EN)).otherwise(F.lit(MIN_RUN))
    return leaked_items(documents, items).where(F.col("run") >= need).select("doc_id", "item_id").distinct()


def overlaps(documents: DataFrame, items: DataFrame, least: int = MIN_RUN, least_en: int = MIN_RUN_EN) -> DataFrame:
    """(doc_id, item_id, run, overlap): documents that share with an item a stretch of 30 (lang en: 60)
    letters or digits of which some may be substituted."""
    need = F.when(F.col("lang") == "en", F.lit(least_en)).otherwise(F.lit(least))
    found = leaked_items(documents, items).where(F.col("overlap") >= need)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("overlap").alias("overlap"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_set, n_items, n_leaked, n_documents) per item set."""
    found = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("docs"))
    return items.select("item_set", "item_id").join(found, "item_id", "left").groupBy("item_set").agg(F.count("*").alias("n_items"), F.count("docs").alias("n_leaked"), F.coalesce(F.sum("docs"), F.lit(0)).alias("n_documents"))
