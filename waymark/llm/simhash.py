"""SimHash near-duplicates: pivot distance tables inside cells, verified by Hamming distance.

Fingerprints are compared once per distinct value, so exact copies cost one row. Fingerprints meet in cells; inside a cell a table of
Hamming distances to reference fingerprints (pivots) discards every pair whose coordinates differ by more than the radius somewhere (the
triangle inequality makes that lossless), and the survivors are verified on all bits. Every cell yields a spanning
forest of its links, never all pairs.

Cells, small radius (`exact_masks`): the bits that one of several masks selects. The masks come from the pigeonhole principle (b
blocks, b - radius of them equal), so no link is lost at all.

Cells, with `similarity` (the least Jaccard index of two sets of shingles): TABLES pairs of least values that the set has under as many pairs of
hash functions. Two sets share one pair of them with the chance of the square of their index, so at 0.8 they meet nowhere with a chance of
0.36 ** TABLES, 6e-7, whatever the number of fingerprints: what is dealt grows as the input. Pairs within the radius are
candidates only. The sets of each candidate group are then brought together once, compared in the same order (pivots, bits) and
a pair links if the exact index of its sets is `similarity` or more.

Nulls: a null text counts as empty, a null id keeps its row and takes part in linking. Ties and repeated rows: equal fingerprints are one
group, named by the smallest id. Very long texts are hashed in pieces. Empty tables give empty ones. Other columns are ignored
(keep_one keeps them under any name).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop_table, id_and_bytes, materialize, slices
from .components import components

#: Rows of one cell that one task compares at most; larger cells are cut into pairs of tiles.
TILE = 32_768
#: Cells up to this size are compared by shifting the sorted rows against themselves.
SMALL = 32
PIVOTS = 12
#: Rows of cells that one task is dealt, about.
DEALT = 65_536
#: Bytes of sets of shingles in a tile of a candidate group, and after which a task compares the groups it has.
SET_TILE, HELD = 8 << 20, 32 << 20
TABLES = 14
#: Words of a text that are hashed at once.
PIECE = 1 << 22


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_of(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists from about PIECE bytes each."""
    at = 0
    while at < len(body):
        end = at + PIECE
        while end < len(body) and body[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield body[at:end].lower().split()
        at = end


def shingle_hashes(body: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of `width` words, A-Z lower-cased; fewer words: one hash of them all; none: none."""
    out, kept, digest = [], [], xxhash.xxh64_intdigest
    for more in _words_of(body):
        words = kept + more
        if len(words) < width:
            kept = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        out.append(np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64))
        kept = words[len(words) - width + 1 :]
    if out:
        return np.concatenate(out) if len(out) > 1 else out[0]
    return np.array([digest(b" ".join(kept), 42)], np.uint64) if kept else np.empty(0, np.uint64)


def fold(hashes: np.ndarray, bits: int) -> bytes:
    """The fingerprint of a text's hashes as bits / 8 bytes, most significant first: a bit is set if over half have it."""
    words = []
    for k in range(bits // 64):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 32_768):
            part = hashes[at : at + 32_768]
            part = part if k == 0 else _mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        words.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(words)


_SEEDS = np.random.default_rng(23).integers(0, 2**64, 2 * TABLES, np.uint64, endpoint=False)


def anchors(hashes: np.ndarray) -> bytes:
    """A cell for each of TABLES: the least values of a set under two hash functions, as one 64-bit number; b"" for an empty set."""
    if not len(hashes):
        return b""
    least = np.array([_mix(hashes ^ seed).min() for seed in _SEEDS], np.uint64).reshape(TABLES, 2)
    return _mix(_mix(least[:, 0] + np.arange(TABLES, dtype=np.uint64)) ^ least[:, 1]).astype("<u8").tobytes()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int, bits: int, as_set: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out, cells = [], []
        for body in batch.column("body").to_pylist():
            h = shingle_hashes(body or b"", width)
            h = np.unique(h) if as_set else h
            out.append(fold(h, bits))
            cells.append(anchors(h) if as_set else b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), pa.array(cells, pa.binary())], ["doc_id", "fp", "anchors"])


def fingerprints(docs: DataFrame, width: int = 4, bits: int = 64, as_set: bool = False) -> DataFrame:
    """doc_id, fp, anchors (binary). as_set: each different shingle counts once, and the anchors are filled."""
    return id_and_bytes(docs).mapInArrow(partial(_fingerprint_batches, width=width, bits=bits, as_set=as_set), "doc_id long, fp binary, anchors binary")


def _set_batches(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [np.unique(shingle_hashes(body or b"", width)) for body in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([fold(h, bits) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], ["fp", "shingles"])


class Sets:
    """The shingle sets of some rows, as numbers from 0 on, for exact Jaccard indexes of one row with many."""

    def __init__(self, sets: list[bytes]):
        hashes = [np.frombuffer(x, np.uint64) for x in sets]
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        values, self.ids = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def similar(self, a: int, others: np.ndarray, least: float) -> np.ndarray:
        """Which of the other rows have an index of `least` or more with row a."""
        own = self.ids[self.at[a] : self.at[a + 1]]
        self.mark[own] = True
        both = np.array([np.count_nonzero(self.mark[self.ids[self.at[b] : self.at[b + 1]]]) for b in others.tolist()], np.int64)
        self.mark[own] = False
        return both >= least * (self.size[a] + self.size[others] - both) - 1e-9


def exact_masks(n: int, radius: int, bits: int = 64) -> np.ndarray:
    """Masks (rows of 64-bit words) of which one at least selects equal bits in any pair within `radius`.

    bits are cut into b blocks; some b - radius blocks are equal in such a pair. b grows with the number n of
    fingerprints until a cell is expected to hold 64 unrelated ones at most.
    """
    for b in range(radius + 1, radius + 5):
        if bits * (b - radius) / b >= math.log2(max(n, 2)) - 6:
            break
    edges = [round(i * bits / b) for i in range(b + 1)]
    out = []
    for chosen in combinations(range(b), b - radius):
        on = np.zeros(bits, np.uint8)
        for k in chosen:
            on[edges[k] : edges[k + 1]] = 1
        out.append(np.packbits(on).view(">u8").astype(np.uint64))
    return np.array(out)


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(column), -1) if len(column) else np.empty((0, 1), np.uint64)


def _cell_batches(batches: Iterator[pa.RecordBatch], masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column("fp").slice(at, 4096)
            words = _words(fp)
            for t, mask in enumerate(masks):
                cell = np.full(len(words), _mix(np.array([t + 1], np.uint64))[0])
                for k in np.flatnonzero(mask):
                    cell = _mix(cell ^ (words[:, k] & mask[k])) + np.uint64(k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), fp], ["cell", "fp"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        up, a, b = self.up, self.root(a), self.root(b)
        if a == b:
            return False
        up[max(a, b)] = min(a, b)
        return True


def pivot_table(words: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to the reference fingerprints."""
    refs = np.random.default_rng(5).integers(0, 2**64, (PIVOTS, words.shape[1]), np.uint64, endpoint=False)
    return np.stack([np.bitwise_count(words ^ r).sum(1, dtype=np.int16) for r in refs], 1)


def _near(words: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs a, b those within radius: discarded by coordinates first, then verified."""
    for k in range(table.shape[1]):
        keep = np.abs(table[a, k] - table[b, k]) <= radius
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int16) <= radius
    return a[keep], b[keep]


def cell_links(cells: np.ndarray, words: np.ndarray, radius: int, agreed=None) -> list[tuple[int, int]]:
    """Row pairs that link equal cells (sorted) into the components which all pairs within radius make; agreed(a, array of b), if it is given, says
    which of them count."""
    if not len(cells):
        return []
    table, links = pivot_table(words), []
    _, same = np.unique(np.ascontiguousarray(words).view(f"V{8 * words.shape[1]}").ravel(), return_inverse=True)
    same, forest = same.tolist(), _Forest(len(cells))
    edges = np.concatenate(([0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]))
    size = np.repeat(np.diff(edges), np.diff(edges))
    left = np.flatnonzero((size > 1) & (size <= SMALL))
    for s in range(1, SMALL):
        left = left[left + s < len(cells)]
        left = left[cells[left] == cells[left + s]]
        if not len(left):
            break
        for a, b in zip(*(x.tolist() for x in _near(words, table, left, left + s, radius))):
            if forest.root(same[a]) != forest.root(same[b]) and (agreed is None or agreed(a, np.array([b]))[0]):
                forest.join(same[a], same[b])
                links.append((a, b))
    for k in np.flatnonzero(np.diff(edges) > SMALL):
        rest = np.arange(edges[k], edges[k + 1])
        rest = rest[np.argsort(table[rest, 0], kind="stable")]
        front: list[int] = []
        while len(rest):
            if not front:
                front, rest = [int(rest[0])], rest[1:]
            at = front.pop()
            lo, hi = np.searchsorted(table[rest, 0], [table[at, 0] - radius, table[at, 0] + radius + 1])
            _, found = _near(words, table, np.full(hi - lo, at), rest[lo:hi], radius)
            if agreed is not None and len(found):
                found = found[agreed(at, found)]
            if len(found):
                for b in found.tolist():
                    if forest.join(same[at], same[b]):
                        links.append((at, b))
                front += found.tolist()
                rest = rest[~np.isin(rest, found)]
    return links


def _linked(cells: np.ndarray, words: np.ndarray, radius: int, agreed=None) -> pa.RecordBatch:
    pairs = np.array(cell_links(cells, words, radius, agreed), np.int64).reshape(-1, 2)
    a, b = (pa.array([x.tobytes() for x in words[pairs[:, i]].astype(">u8")], pa.binary()) for i in (0, 1))
    return pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    cells, words = np.empty(0, np.int64), None
    for batch in batches:
        new = _words(batch.column("fp"))
        cells = np.concatenate((cells, batch.column("cell").to_numpy()))
        words = new if words is None else np.concatenate((words, new))
        if len(cells) >= TILE and cells[0] != cells[-1]:
            cut = int(np.searchsorted(cells, cells[-1]))
            yield _linked(cells[:cut], words[:cut], radius)
            cells, words = cells[cut:], words[cut:]
    if len(cells):
        yield _linked(cells, words, radius)


def _verified_batches(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of rows that lie in order of their groups: several groups at once while they hold HELD bytes of sets, a group at a time if it has more."""
    cells, fps, sets, size = [], [], [], 0

    def linked(n: int) -> pa.RecordBatch:
        held = Sets(sets[:n])
        words = np.frombuffer(b"".join(fps[:n]), ">u8").astype(np.uint64).reshape(n, -1)
        return _linked(np.array(cells[:n], np.int64), words, radius, lambda a, b: held.similar(a, b, similarity))

    for batch in slices(batches, "shingles"):
        for cell, fp, shingles in zip(*(batch.column(c).to_pylist() for c in ("cell", "fp", "shingles"))):
            if size >= HELD and cell != cells[-1]:
                yield linked(len(cells))
                cells, fps, sets, size = [], [], [], 0
            cells.append(cell)
            fps.append(fp)
            sets.append(shingles)
            size += len(shingles)
    if cells:
        yield linked(len(cells))


def _dealt(cells: DataFrame, n: int) -> DataFrame:
    """cells dealt by cell into tasks of about DEALT of the n rows, in order."""
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // DEALT))
    return cells.repartition(tasks, "cell").sortWithinPartitions("cell")


def _tiled(cells: DataFrame, big: DataFrame, *more: str) -> DataFrame:
    """cells (cell, fp, more); the cells of big (cell, tiles) as pairs of tiles over many tasks: every two rows still meet."""
    met = cells.join(big, "cell", "left").withColumn("own", F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("fp"), "tiles")))
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    return met.withColumn("other", other).select(F.when(F.col("tiles").isNull(), F.col("cell")).otherwise(pair).alias("cell"), "fp", *more)


def _forests(cells: DataFrame, radius: int, n: int) -> DataFrame:
    """a, b: links of cells (cell, fp; about n rows) within radius. Cells over TILE rows are dealt as pairs of tiles."""
    big = cells.groupBy("cell").count().filter(F.col("count") > TILE).select("cell", F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("tiles"))
    big = materialize(big, "large-cells")
    if big.take(1):
        cells = _tiled(cells, big)
    return _dealt(cells, n).mapInArrow(partial(_link_batches, radius=radius), "a binary, b binary")


def links(fps: DataFrame, masks: np.ndarray, radius: int, n: int = 0) -> DataFrame:
    """a, b: links between the different fingerprints of fps (column fp, no repeats; about n) that make the components of all pairs within radius."""
    return _forests(fps.mapInArrow(partial(_cell_batches, masks=masks), "cell long, fp binary"), radius, n * len(masks))


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, own = batch.column("fp").to_pylist(), batch.column("anchors").to_pylist()
        cells = np.frombuffer(b"".join(own), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array([fp for fp, a in zip(fps, own) for _ in range(len(a) // 8)], pa.binary())], ["cell", "fp"])


def similar_links(docs: DataFrame, reps: DataFrame, n: int, width: int, bits: int, radius: int, similarity: float) -> DataFrame:
    """a, b: links between the fingerprints of reps (fp, first_id, anchors; n of them) that make the components of all pairs of an index of `similarity`
    or more, but for those that share no anchor or lie beyond radius."""
    near = materialize(_forests(reps.select("fp", "anchors").mapInArrow(_anchor_batches, "cell long, fp binary"), radius, n * TABLES), "candidates")
    groups = materialize(components(near).select(F.col("node").alias("fp"), F.xxhash64("root").alias("cell")), "candidate-groups")
    sets = _sets(docs, reps, groups, width, bits)
    sizes = groups.join(sets.select("fp", F.length("shingles").cast("long").alias("size")), "fp").groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    big = sizes.filter(F.col("size") > 2 * SET_TILE).select("cell", F.ceil(F.col("size") / SET_TILE).cast("int").alias("tiles"))
    big = materialize(big, "large-groups")
    met = groups.join(sets, "fp").select("cell", "fp", "shingles")
    if big.take(1):
        met = _tiled(met, big, "shingles")
    found = _dealt(met, n).mapInArrow(partial(_verified_batches, radius=radius, similarity=similarity), "a binary, b binary")
    found = materialize(found, "verified-links")
    for table in (near, sets, big):
        drop_table(table)
    return found


def _sets(docs: DataFrame, reps: DataFrame, fps: DataFrame, width: int, bits: int) -> DataFrame:
    """fp, shingles (the sorted hashes of one text that has it) for the fingerprints in fps; a table."""
    ids = reps.join(fps, "fp").select(F.col("first_id").alias("_id")).distinct()
    some = docs.join(ids, docs.doc_id.eqNullSafe(F.col("_id")), "left_semi")  # rows that repeat an id are told apart by fp
    made = id_and_bytes(some).select("body").mapInArrow(partial(_set_batches, width=width, bits=bits), "fp binary, shingles binary")
    return materialize(made.join(fps, "fp", "left_semi").groupBy("fp").agg(F.min("shingles").alias("shingles")), "shingles")


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 64, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included; null if all ids of a component are).

    similarity: None (all shingles count, links are pairs within radius), or the least Jaccard index of the sets of shingles of a pair within radius.
    """
    marked = materialize(fingerprints(docs, width, bits, similarity is not None), "fingerprints")
    reps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("anchors").alias("anchors")), "fingerprint-reps")
    n = reps.count()
    if similarity is None:
        near = links(reps.select("fp"), exact_masks(n, radius, bits), radius, n)
    else:
        near = similar_links(docs, reps, n, width, bits, radius, similarity)
    found = components(near)
    roots = reps.join(found, reps.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = materialize(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    named = materialize(roots.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id over the whole documents table."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Near copies in the pipeline: five-word shingles, similarity 0.8. A Jaccard index of 0.8 is a cosine of 8/9, at which
#: a bit differs with chance acos(8/9) / pi = 0.1515: 39 of 256 bits, deviation 5.8; the radius adds over five deviations, as
#: candidates are verified.
STAGE = {"width": 5, "bits": 256, "radius": 70, "similarity": 0.8}


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs but those whose component holds a smaller doc_id; of rows that repeat a doc_id all or none stay."""
    drop = near_duplicates(docs, **(STAGE | how)).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
