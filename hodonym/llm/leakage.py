"""Test passages that leaked into a corpus, whole, in part or edited (problem 9).

Texts become words without case, diacritics, punctuation and the differences of look-alikes, each word a 32-bit code. The corpus is
tokenised once: of every document that holds an n-gram of the test items, the codes and the places of these n-grams are written to the
shared folder. The n-grams' document frequencies then choose the seeds: all rare n-grams, and of every window of ``WINDOW`` words of an
item the rarest that occur at all, so a document that holds such a window holds a seed of it. Seeds join documents to
items, and Smith-Waterman over words aligns the region around them with the item, which finds edited copies and gives the longest run of
equal words. The number of items changes nothing in the number of passes over the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodonym.llm.skeletons import skeleton
from hodonym.session import materialize, parallelism, ship_code

#: Words of a seed, and the consecutive words that make a leak.
SEED, WINDOW = 4, 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: What makes a hit: the score of ``WINDOW`` equal words in a row, and of the score that the aligned stretch could have at least this part.
LEAST_SCORE, LEAST_DENSITY = MATCH * WINDOW, 0.6
#: n-grams in common, and words of the item that they cover about one diagonal, below which no hit can be: ``WINDOW`` equal words have more.
LEAST_GRAMS, LEAST_COVERED = 4, WINDOW
#: An n-gram is rare if at most so many documents hold it, or at most so many times as many as hold the rarest of its window.
RARE_DOCS, RARE_TIMES = 16, 8
#: Bits of the filter of the items' n-grams that goes to every task: at least so many per n-gram, within these bounds. A fuller filter only lets more through.
FILTER_BITS, FILTER_BOUNDS = 16, (1 << 20, 1 << 28)
_MARKS = dict.fromkeys([*range(0x0300, 0x0370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100)])
_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class _Plain(dict):
    """Character -> what counts of it: its look-alike in lower case without marks, or nothing."""

    def __missing__(self, code: int) -> str | None:
        self[code] = skeleton(chr(code)).translate(_MARKS).lower() or None
        return self[code]


_PLAIN = _Plain()


def plain_words(text: str) -> list[str]:
    return _WORDS.findall(text.lower() if text.isascii() else text.translate(_PLAIN))


class _Codes(dict):
    """Word -> its code, never 0."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = (zlib.crc32(word.encode("utf-8", "surrogatepass")) or 1) - (1 << 31)
        return code


_CODES = _Codes()


def coded(text: str) -> np.ndarray:
    return np.array([_CODES[w] for w in plain_words(text)], np.int32)


def grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams of ``SEED`` words."""
    n = len(codes) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wide, h = codes.astype(np.int64).view(np.uint64), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            h = (h + wide[k : k + n]) * _BASE
            h ^= h >> np.uint64(29)
        h *= _MIX
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of ``size`` bits."""
    u = hashes.view(np.uint64)
    return (u % np.uint64(size)).astype(np.int64), ((u >> np.uint64(20)) % np.uint64(size)).astype(np.int64)


def sweep(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """(best local alignment score, its last place in the document and in the item, longest run of equal words) of two arrays of word codes."""
    n = len(doc)
    steps = np.arange(1, n + 1) * -GAP
    row, runs, best, longest = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), (0, 0, 0), 0
    for k, w in enumerate(item):
        same = doc == w
        here = np.maximum(np.maximum(row[:-1] + np.where(same, MATCH, MISMATCH), row[1:] + GAP), 0)
        here = np.maximum.accumulate(here + steps) - steps
        row[1:] = here
        if same.any():
            runs[1:] = np.where(same, runs[:-1] + 1, 0)
            longest = max(longest, int(runs.max()))
            at = int(here.argmax())
            if here[at] > best[0]:
                best = int(here[at]), at, k
        else:
            runs[:] = 0
    return *best, longest


def density(doc: np.ndarray, item: np.ndarray, best: tuple[int, int, int, int]) -> float:
    """The score of the best alignment (as from ``sweep``) as a part of what the longer of its two stretches would score if all its words were equal."""
    score, at, k, _ = best
    if not score:
        return 0.0
    # read backwards from its end, the best alignment ends at its beginning
    _, back, up, _ = sweep(doc[at::-1], item[k::-1])
    return score / (MATCH * (max(back, up) + 1))


def _coded_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = [coded(t) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(codes, pa.list_(pa.int32())), pa.array([grams(c) for c in codes], pa.list_(pa.int64()))], names=["item_id", "item", "gram"])


def _search(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = len(bits) * 8

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = coded(text)
                g = grams(codes)
                a, c = _bits(g, size)
                at = np.flatnonzero((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1)
                if len(at):
                    out.append((i, codes, at.astype(np.int32), g[at]))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["doc_id", "doc", "at", "gram"])

    return search


def _filter(items: DataFrame) -> np.ndarray:
    """The bits of the items' n-grams; the driver gets at most a number for every 64 bits."""
    hashes = items.select(F.explode("gram").alias("gram"))
    low, high = FILTER_BOUNDS
    size = low
    while size < min(high, FILTER_BITS * hashes.count()):
        size *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_bits(b.column(0).to_numpy(zero_copy_only=False), size))
            yield pa.record_batch([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["place", "bit"])

    filled = hashes.mapInArrow(mark, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[filled.place.to_numpy(np.int64)] = filled.bits.to_numpy(np.int64)
    return out.view(np.uint8)


def choose_seeds(frequency: np.ndarray) -> np.ndarray:
    """Which n-grams of an item are seeds, from the number of documents that hold each.

    Of every window those that occur, and are among the rare ones or not far from the window's rarest. An n-gram that occurs in no document finds
    nothing and chooses nothing.
    """
    n, width = len(frequency), WINDOW - SEED + 1
    if n < width:
        return np.zeros(n, bool)
    there = np.where(frequency > 0, frequency, np.iinfo(np.int64).max // (2 * RARE_TIMES))
    least = np.lib.stride_tricks.sliding_window_view(there, width).min(axis=1)
    around = np.full(n, 0, np.int64)
    for k in range(width):
        around[k : n - width + 1 + k] = np.maximum(around[k : n - width + 1 + k], least)
    return (frequency > 0) & ((frequency <= RARE_DOCS) | (there <= RARE_TIMES * around))


def _seeds(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at")
    return pdf[choose_seeds(pdf.n.to_numpy(np.int64))][["item_id", "at", "gram"]]


def _stretch(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int] | None:
    """(start, end) in the document and in the item of what their common n-grams about one diagonal span, or None if they cover too little."""
    g, h = grams(doc), grams(item)
    order = np.argsort(h, kind="stable")
    left, right = np.searchsorted(h[order], g, "left"), np.searchsorted(h[order], g, "right")
    times = right - left
    p = np.repeat(np.arange(len(g)), times)
    if len(p) < LEAST_GRAMS:
        return None
    q = order[np.repeat(left, times) + np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times)]
    slack = SEED + len(item) // 4
    shift = p - q
    sort = np.argsort(shift, kind="stable")
    p, q, shift = p[sort], q[sort], shift[sort]
    ends = np.searchsorted(shift, shift + slack, "right")
    top = int((ends - np.arange(len(shift))).argmax())
    p, q = p[top : ends[top]], q[top : ends[top]]
    covered = np.zeros(len(item), bool)
    for k in range(SEED):
        covered[q + k] = True
    if covered.sum() < LEAST_COVERED:
        return None
    return max(0, int(p.min()) - slack), int(p.max()) + SEED + slack, max(0, int(q.min()) - slack), int(q.max()) + SEED + slack


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, item_id, region, item in zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), b.column("region"), b.column("item")):
            region, item = region.values.to_numpy(), item.values.to_numpy()
            if (at := _stretch(region, item)) is None:
                continue
            near, part = region[at[0] : at[1]], item[at[2] : at[3]]
            best = sweep(near, part)
            if best[0] >= LEAST_SCORE and (best[3] >= WINDOW or density(near, part, best) >= LEAST_DENSITY):
                out.append((doc_id, item_id, best[0], best[0] / (MATCH * len(item)), best[3]))
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out)], names=["doc_id", "item_id", "score", "share", "run"])


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, score, share, run): every document that holds an item, a part or an edited copy of it.

    ``score`` is the local alignment score (2 for an equal word, -1 for another or a missing one), ``share`` the part of the item's own
    score that it is, ``run`` the longest run of consecutive equal words. Pairs that score less than ``WINDOW`` equal words in a row, or that have
    neither such a run nor the density ``LEAST_DENSITY``, are left out. Items of fewer than ``WINDOW`` words have no window and match nothing; null texts and ids neither. A repeated id is one document or
    item with the best of its texts.
    """
    spark = docs.sparkSession
    ship_code(spark)
    read = lambda df, i, t: df.where(F.col(t).isNotNull() & F.col(i).isNotNull()).select(F.col(i).cast("long"), F.col(t))
    known = materialize(read(items, item_id, item_text).distinct().mapInArrow(_coded_items, "item_id long, item array<int>, gram array<long>").where(F.size("item") >= WINDOW).withColumn("uid", F.xxhash64("item_id", "item")), "items")
    bits = _filter(known)
    found = materialize(read(docs, doc_id, text).mapInArrow(_search(bits), "doc_id long, doc array<int>, at array<int>, gram array<long>").withColumn("did", F.xxhash64("doc_id", "doc")), "hits")

    counts = found.select(F.explode(F.array_distinct("gram")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    places = known.select(F.col("uid").alias("item_id"), F.posexplode("gram").alias("at", "gram"))
    seeds = places.join(counts, "gram", "left").select("item_id", "at", "gram", F.coalesce("n", F.lit(0)).alias("n")).groupBy("item_id").applyInPandas(_seeds, "item_id long, at int, gram long")
    seeds = materialize(seeds.select(F.col("item_id").alias("uid"), F.col("at").alias("item_at"), "gram"), "seeds")

    # a region for every stretch of neighbouring diagonals on which an item's seeds lie
    hits = found.select("did", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("did", "x.at", "x.gram").join(seeds, "gram").join(known.select("uid", F.size("item").alias("size")), "uid")
    slack = F.lit(SEED) + F.col("size").cast("int").bitwiseAND(F.lit(-4)) / 4
    shift = F.col("at") - F.col("item_at")
    spans = hits.withColumn("slack", slack.cast("int")).withColumn("shift", shift).groupBy("did", "uid", "size", "slack", F.floor(shift / F.col("slack")).alias("band")).agg(F.min("shift").alias("low"), F.max("shift").alias("high"))
    spans = spans.select("did", "uid", F.greatest(F.lit(0), F.col("low") - F.col("slack")).alias("start"), (F.col("high") + F.col("size") + F.col("slack")).alias("end"))
    common = F.size(F.array_intersect("doc_gram", "gram")) >= LEAST_GRAMS
    near = spans.join(found.select("did", "doc_id", "doc", F.col("gram").alias("doc_gram")), "did").join(known.select("uid", "item_id", "item", "gram"), "uid").where(common)
    pairs = near.select("doc_id", "item_id", F.slice("doc", F.col("start") + 1, F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("region"), "item").repartition(parallelism(spark))
    scored = pairs.mapInArrow(_aligned, "doc_id long, item_id long, score long, share double, run long")
    best = scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("run").alias("run"))
    return best.select("doc_id", "item_id", "score", F.round("share", 4).alias("share"), "run")
