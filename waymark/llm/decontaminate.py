"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are reduced to lower-case letters and digits with single spaces between. Items are cut into windows
of WINDOW characters, one every STRIDE and one at the end (a shorter item is one window), so an excerpt of WINDOW + STRIDE - 1 characters
holds a whole window wherever it starts. A window that lies in a text with at most k edits
(k = a share EDITS of its length) shares at least length + 1 - Q - k Q of its q-grams with a stretch of the text, and those
lie on diagonals (place in text less place in window) that differ by k at most. Hits are counted in bands of
2 (k + 1) diagonals that overlap by half, bands that reach the bound are candidate regions, and each is verified by a
banded alignment. Windows of fewer than Q characters, whose bound says nothing, must be met whole, between word borders.

The windows are written to the shared folder in blocks of about BLOCK; every task reads the blocks there one after the other and
takes the texts that it holds (HELD bytes) past each, so neither the driver nor a task ever has the whole benchmark. The best
window of an item (the most characters met, then the first place) is chosen over all blocks: their number changes nothing.

Nulls: a null or empty text or item never matches; rows without an id keep their null. Repeated rows of either table each count: a repeated
document is found again, a repeated item_id is one item. Long texts are searched in overlapping stretches. Extra columns are
ignored (keep_clean keeps them). Empty tables give an empty result, or all documents where there is no benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held, materialize, read_part, slices, table_path

Q, WINDOW, STRIDE, EDITS = 12, 96, 16, 0.06
#: Windows in one block; with 96 q-grams of 16 bytes each, some 60 MB. Bytes of texts that a task takes past all blocks at once.
BLOCK, HELD = 40_000, 64 << 20
#: Long texts are searched in stretches of so many characters.
STRETCH = 1 << 20
_FILTER_BITS = 22


@lru_cache(1)
def _folding() -> np.ndarray:
    """For each code point the code of its lower-case letter or digit, 0 for anything else."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the reduced text (1 is a space) and each one's place in the text."""
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    word = codes > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    places = np.flatnonzero(keep)
    codes = np.where(word, codes, 1)[keep]
    if len(codes) and codes[-1] == 1:
        codes, places = codes[:-1], places[:-1]
    return codes, places


def qgrams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q codes at each place."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    n, out, have = len(codes) - Q + 1, None, 0
    power, width = codes.astype(np.uint64), 1
    left = Q
    while left:  # Q in binary: stretches of 1, 2, 4, ... codes are hashed and joined
        if left & 1:
            piece = power[have : have + n]
            out = piece.copy() if out is None else out * np.uint64(pow(0x100000001B3, width, 2**64)) + piece
            have += width
        left >>= 1
        if left:
            power = power[:-width] * np.uint64(pow(0x100000001B3, width, 2**64)) + power[width:]
            width *= 2
    return (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def windows_of(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    """item id, codes of every window."""
    out = []
    for item, text in items:
        codes, _ = fold(text or "")
        last = max(0, len(codes) - WINDOW)
        out += [(item, codes[at : at + WINDOW]) for at in sorted({*range(0, last, STRIDE), last}) if len(codes)]
    return out


class Block:
    """An index of the q-grams of some windows."""

    def __init__(self, windows: list[tuple[int, np.ndarray]]):
        self.items = [w[0] for w in windows]
        self.windows = [w[1] for w in windows]
        self.budget = np.array([int(EDITS * len(w)) if len(w) >= Q else 0 for w in self.windows], np.int64)
        size = np.array([len(w) for w in self.windows], np.int64)
        self.least = np.maximum(size + 1 - Q - self.budget * Q, 1)
        grams = [qgrams(w) for w in self.windows]
        code = np.concatenate([np.empty(0, np.uint64), *grams])
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])[order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.code >> np.uint64(64 - _FILTER_BITS)] = True
        self.short = [i for i, w in enumerate(self.windows) if len(w) < Q]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """window, diagonal (lowest of its band) of the bands that reach the bound."""
        grams = qgrams(codes)
        at = np.flatnonzero(self.seen[grams >> np.uint64(64 - _FILTER_BITS)])
        if not len(at) or not len(self.code):
            return []
        lo, hi = np.searchsorted(self.code, grams[at], "left"), np.searchsorted(self.code, grams[at], "right")
        keys, times = [], []
        counts = np.cumsum(hi - lo)
        start = 0
        while start < len(at):  # some million hits at a time
            end = max(start + 1, int(np.searchsorted(counts, (counts[start - 1] if start else 0) + (1 << 21))))
            n = (hi - lo)[start:end]
            if n.sum():
                hit = np.repeat(lo[start:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = self.window[hit]
                band = (np.repeat(at[start:end], n) - self.offset[hit]) // (self.budget[w] + 1)
                found, count = np.unique((w << 40) + band + (1 << 39), return_counts=True)
                keys += [found - 1, found]  # a band starts at each multiple of step and is two steps wide
                times += [count, count]
            start = end
        if not keys:
            return []
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(times)).astype(np.int64)
        w = found >> 40
        enough = total >= self.least[w]
        w, band = w[enough], (found[enough] & ((1 << 40) - 1)) - (1 << 39)
        return list(zip(w.tolist(), (band * (self.budget[w] + 1)).tolist()))


def align(window: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """edits, start, end of the stretch of region nearest to window, or None if it takes more than budget edits.

    Free ends in the region; rows are cut to the diagonals that a region of window + 3 (budget + 1) characters has.
    """
    n, m = len(window), len(region)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i in range(1, n + 1):
        lo, hi = max(0, i - budget - 1), min(m, i + (m - n) + budget + 1)
        step = np.full(m + 1, budget + 1, np.int64)
        origin = start.copy()
        j = np.arange(max(lo, 1), hi + 1)
        swap = cost[j - 1] + (region[j - 1] != window[i - 1])
        skip = cost[j] + 1
        step[j] = np.minimum(swap, skip)
        origin[j] = np.where(swap <= skip, start[j - 1], start[j])
        if lo == 0:
            step[0], origin[0] = min(i, budget + 1), 0
        # insertions: running minimum of step - place
        back = np.minimum.accumulate(step - np.arange(m + 1))
        far = back + np.arange(m + 1)
        moved = far < step
        source = np.maximum.accumulate(np.where(step - np.arange(m + 1) == back, np.arange(m + 1), 0))
        origin = np.where(moved, origin[source], origin)
        cost, start = np.minimum(far, budget + 1), origin
        if cost.min() > budget:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= budget else None


def whole(window: np.ndarray, region: np.ndarray) -> int | None:
    """The first place in region where the window stands without an edit."""
    if len(region) < len(window):
        return None
    at = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(region, len(window)) == window).all(1))
    return int(at[0]) if len(at) else None


def best_windows(block: Block, text: str, best: dict) -> dict:
    """best with, for every item found in the text: edits less characters of the window, start, end (places in the text), edits."""
    codes, places = fold(text)

    def note(w, start, end, edits):
        item = block.items[w]
        row = (edits - len(block.windows[w]), int(places[start]), int(places[end - 1]) + 1, edits)
        if item not in best or row < best[item]:
            best[item] = row

    for base in range(0, max(len(codes), 1), STRETCH):
        part = codes[base : base + STRETCH + 2 * WINDOW]
        tried, rest = set(), []
        for w, diagonal in sorted(block.regions(part)):
            k, window = int(block.budget[w]), block.windows[w]
            lo, hi = max(0, diagonal - k), min(len(part), diagonal + len(window) + 3 * (k + 1))
            first = whole(window, part[lo:hi])
            if first is None:
                rest.append((w, diagonal, k, lo, hi))
            else:
                tried.add((w, diagonal))
                note(w, base + lo + first, base + lo + first + len(window), 0)
        for w, diagonal, k, lo, hi in rest:
            window, have = block.windows[w], best.get(block.items[w])
            # nothing to gain from a match the half-overlapping band before had, nor from one edit or more where less is met already
            if (w, diagonal - k - 1) in tried or not k or (have and have[:2] <= (1 - len(window), int(places[base + lo]))):
                continue
            got = align(window, part[lo:hi], k)
            if got:
                tried.add((w, diagonal))
                note(w, base + lo + got[1], base + lo + got[2], got[0])
    for w in block.short:
        window = block.windows[w]
        line = np.concatenate(([1], codes, [1]))
        target = np.concatenate(([1], window, [1]))
        if len(line) >= len(target):
            first = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(line, len(target)) == target).all(1))
            if len(first):
                note(w, int(first[0]), int(first[0]) + len(window), 0)
    return best


def in_order(best: dict) -> list[tuple]:
    return [(item, start, end, edits) for item, (_, start, end, edits) in sorted(best.items(), key=lambda x: str(x[0]))]


def search(block: Block, text: str) -> list[tuple[int, int, int, int]]:
    """item, start, end (places in the text), edits: the best window of every item found in the text."""
    return in_order(best_windows(block, text, {}))


HITS = "doc_id long, item_id long, start long, end long, edits long"


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        found = windows_of(list(zip(*(batch.column(c).to_pylist() for c in ("item_id", "text")))))
        yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in found], pa.int64()), pa.array([w[1].astype("<u4").tobytes() for w in found], pa.binary())], ["item_id", "codes"])


def shared_blocks(benchmark: DataFrame) -> tuple[str, int]:
    """Write the windows of benchmark (item_id, text) in blocks to the shared folder; the folder and the number of blocks."""
    spark = benchmark.sparkSession
    windows = materialize(benchmark.select("item_id", "text").mapInArrow(_window_batches, "item_id long, codes binary"), "benchmark-windows")
    n = -(-windows.count() // BLOCK)
    folder = table_path(spark, "benchmark-blocks")
    if n:
        dealt = windows.withColumn("block", F.pmod(F.xxhash64("item_id", "codes"), F.lit(n)).cast("int"))
        dealt.repartitionById(n, "block").write.partitionBy("block").parquet(folder)
    return folder, n


@lru_cache(1)
def _block(folder: str, k: int) -> Block:
    items, codes = read_part(f"{folder}/block={k}", ["item_id", "codes"])
    none = [None if x is None or x != x else int(x) for x in items]
    return Block(sorted(((i, np.frombuffer(c, "<u4")) for i, c in zip(none, codes)), key=lambda x: (str(x[0]), x[1].tobytes())))


def _found(batches: Iterator[pa.RecordBatch], folder: str, n: int) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Batches with the best windows of each of their texts; with one block no text waits."""
    for some in held(batches, "text", HELD if n > 1 else 0):
        texts = [batch.column("text").to_pylist() for batch in some]
        found: list[list[dict]] = [[{} for _ in batch] for batch in texts]
        for k in range(n):
            block = _block(folder, k)
            for batch, best in zip(texts, found):
                for text, have in zip(batch, best):
                    if text:
                        best_windows(block, text, have)
        yield from zip(some, found)


def _search_batches(batches: Iterator[pa.RecordBatch], folder: str, n: int) -> Iterator[pa.RecordBatch]:
    for batch, found in _found(batches, folder, n):
        rows = [(d, *hit) for d, best in zip(batch.column("doc_id").to_pylist(), found) for hit in in_order(best)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "edits"])


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text), edits: every item of which a window is found in a document."""
    folder, n = shared_blocks(benchmark)
    return docs.select("doc_id", "text").mapInArrow(partial(_search_batches, folder=folder, n=n), HITS) if n else docs.sparkSession.createDataFrame([], HITS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in the whole documents table."""
    return hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _clean_batches(batches: Iterator[pa.RecordBatch], folder: str, n: int) -> Iterator[pa.RecordBatch]:
    for batch, found in _found(batches, folder, n):
        yield batch.filter(pa.array([not best for best in found], pa.bool_()))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark item is found."""
    folder, n = shared_blocks(benchmark)
    return docs.mapInArrow(partial(_clean_batches, folder=folder, n=n), docs.schema) if n else docs
