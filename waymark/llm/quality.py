"""Quality by a modified Kneser-Ney character model of trusted text.

Model: interpolated modified Kneser-Ney over character n-grams of order ORDER (white space folded to one blank, digits to 0; case and
marks stay), counted over all trusted documents. Counts, continuation counts, discounts and probabilities are DataFrame joins. The
probabilities are dealt into shards by the character before the predicted one, which all n-grams and contexts that a place
needs have in common; shards are filled up to SHARD rows, and a character with more is cut by the predicted one, with its contexts in
each part. Shards are tables in the shared folder. Scoring joins the documents with them shard by shard: a task holds some documents
(HELD bytes), reads one shard after the other, looks every place of theirs up in the shard it belongs to and adds up the logarithms. Neither the driver nor a
task ever has more of the model than one shard.

A fifth of the trusted documents (by a hash) is kept out of the counts: a model is surer of what it was counted on. A document is
kept if its perplexity lies between two quantiles of that fifth in its language, widened by MARGIN. A language's quantile is its own drawn towards
that of all languages: their logarithms are averaged with weights n and PRIOR, n being the language's documents of that fifth, at every
size alike (the column own_weight is n / (n + PRIOR)). If the fifth is empty all trusted documents stand for it.

Nulls: a null text is empty; empty texts have no perplexity and are not kept; a null language is a language of its own; a null doc_id is never
trusted. Ties: the quantiles are of whole ranks and both bounds are inside. Repeated rows each count and each get their row. Very long texts are counted and scored in
pieces. Without trusted text there are no bounds and nothing is kept; an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_table, held, materialize, read_part, slices, table_path

ORDER = 5
#: Rows (n-grams and contexts, 12 bytes each) of one shard, about.
SHARD = 4_000_000
#: Quantiles of the trusted documents' perplexity between which a document is kept.
LOW, HIGH = 0.002, 0.995
MARGIN = 1.25
#: Documents of all languages that weigh in a language's quantiles.
PRIOR = 20
#: Bytes of documents that a task takes past all shards at once, and characters of a text that are scored together.
HELD, PIECE = 64 << 20, 1 << 20
#: Labelled documents up to this number are broadcast for the join with their texts; beyond it both sides are shuffled.
MAX_BROADCAST = 2_000_000
BOS = "\x02"
_FLUSH = 300_000


@lru_cache(1)
def _folding() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            out[i] = 32
        elif c.isdigit():
            out[i] = 48
    return out


def pieces(text: str) -> Iterator[np.ndarray]:
    """The folded code points of a text in pieces, each after the ORDER - 1 symbols before it (at the beginning: marks)."""
    before = np.full(ORDER - 1, ord(BOS), np.uint32)
    for at in range(0, max(len(text), 1), PIECE):
        c = np.concatenate((before, _folding()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), "<u4")]))
        keep = np.ones(len(c), bool)
        keep[ORDER - 1 :] = (c[ORDER - 1 :] != 32) | (c[ORDER - 2 : -1] != 32)
        c = c[keep]
        yield c
        before = c[-(ORDER - 1) :]


def symbols(text: str) -> np.ndarray:
    """The folded code points after ORDER - 1 marks of the beginning."""
    first, *rest = pieces(text)
    return np.concatenate((first, *(c[ORDER - 1 :] for c in rest)))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _finish(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def gram_codes(c: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n symbols that end at each place from n - 1 on."""
    h = np.full(len(c) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _STEP + c[k : len(c) - n + 1 + k]
    return _finish(h)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["gram", "n"])
        total.clear()
        return rows

    for batch in slices(batches, "text", 1 << 20):
        texts = [c for t in batch.column("text").to_pylist() if t for c in pieces(t)]
        wins = [np.lib.stride_tricks.sliding_window_view(c, ORDER) for c in texts if len(c) >= ORDER]
        if wins:
            codes = np.concatenate([gram_codes(c, ORDER) for c in texts if len(c) >= ORDER])
            _, first, count = np.unique(codes, return_index=True, return_counts=True)
            grams = np.concatenate(wins)[first].astype("<u4").tobytes().decode("utf-32-le", "replace")
            for i, n in enumerate(count.tolist()):
                total[grams[i * ORDER : i * ORDER + ORDER]] += n
        if len(total) > _FLUSH:
            yield flush()
    yield flush()


def counts(texts: DataFrame) -> DataFrame:
    """gram (ORDER characters), n over all texts."""
    return texts.select("text").mapInArrow(_count_batches, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> list[float]:
    """The discounts for counts of 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (x or 0 for x in grams.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first())
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def probabilities(grams: DataFrame) -> DataFrame:
    """gram (1 to ORDER characters), logp (natural) and, for a context, back (log of the weight of the next lower order; else null)."""
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):  # the lower orders count the different characters before
        levels[k] = materialize(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"kn-{k}")
    known = levels[1].count()
    out, lower, backs = [], None, []
    for k in range(1, ORDER + 1):
        d = _discounts(levels[k])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.substring("gram", 1, k - 1)
        level = levels[k].withColumn("context", context)
        sums = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("held"))
        # a context of one character may hold a large part of the rows: it is summed before the shuffle, and met by AQE's split
        met = level.join(sums, "context")
        rest = F.lit(1.0 / (known + 1)) if lower is None else F.col("low")
        if lower is not None:
            met = met.join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("low")), F.substring("gram", 2, k - 1) == F.col("tail"))
        p = (F.col("n") - off + F.col("held") * rest) / F.col("total")
        lower = materialize(met.select("gram", p.alias("p")), f"kn-p{k}")
        out.append(lower.select("gram", F.log("p").alias("logp")))
        backs.append(sums.select(F.col("context").alias("gram"), F.log(F.col("held") / F.col("total")).alias("back")))
    whole = reduce(DataFrame.unionByName, out)
    return whole.join(reduce(DataFrame.unionByName, backs), "gram", "full").select("gram", "logp", "back")


#: Turns the code of an n-gram into that of the same characters as a context.
_CONTEXT = np.uint64(0x5851F42D4C957F2D)


def _part(symbol: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    return ((symbol * np.uint32(0x9E3779B1)) >> np.uint32(8)) % parts


def _code_batches(batches: Iterator[pa.RecordBatch], places: tuple) -> Iterator[pa.RecordBatch]:
    """shard, code, value of entries and contexts; single characters have shard -1."""
    heads, firsts, parts = places
    for batch in batches:
        grams, context, value = batch.column("gram").to_pylist(), batch.column("context").to_numpy(zero_copy_only=False), batch.column("value").to_numpy()
        sizes = np.array(list(map(len, grams)), np.int64)
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            c = np.frombuffer("".join([grams[i] for i in rows.tolist()]).encode("utf-32-le"), "<u4").reshape(-1, n)
            h = np.full(len(c), n, np.uint64)
            for k in range(n):
                h = h * _STEP + c[:, k]
            other, v = context[rows], value[rows]
            code = _finish(h) ^ np.where(other, _CONTEXT, np.uint64(0))
            if n == 1:  # the code of a context of one character has a head, that of a single character has none
                yield _coded(np.full((~other).sum(), -1), code[~other], v[~other])
            at = np.searchsorted(heads, np.where(other, c[:, n - 1], c[:, max(n - 2, 0)]))
            has = other | (n > 1)
            first, m = (np.where(has, x[np.minimum(at, len(x) - 1)], 1) if len(x) else np.ones(len(at), np.int64) for x in (firsts, parts))
            entry = np.flatnonzero(has & ~other)
            yield _coded(first[entry] + _part(c[entry, n - 1], m[entry]), code[entry], v[entry])
            whole = np.repeat(np.flatnonzero(other), m[other])
            copy = np.arange(len(whole)) - np.repeat(np.cumsum(m[other]) - m[other], m[other])
            yield _coded(first[whole] + copy, code[whole], v[whole])


def _coded(shard: np.ndarray, code: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(code.view(np.int64)), pa.array(value)], ["shard", "code", "value"])


class Shard:
    """Log probabilities and back-off weights by gram code, in an open table that numpy can probe."""

    def __init__(self, code: np.ndarray, value: np.ndarray, heads: list[int], others: bool, part: int, parts: int, unseen: float):
        bits = max(4, math.ceil(math.log2(len(code) + 1)))
        order = np.argsort(code)
        self.code, self.value = code[order], np.append(value[order], 0).astype(np.float32)  # row -1 is 0
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.code >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(code) else 0
        self.heads, self.others, self.unseen = np.array(sorted(heads), np.uint32), others, unseen
        self.part, self.parts = part, parts

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row of every code, or -1."""
        slot = (codes >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(codes), -1, np.int64)
        left = np.flatnonzero(at < end)
        for _ in range(self.longest):
            if not len(left):
                break
            hit = self.code[at[left]] == codes[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def score(self, c: np.ndarray) -> float:
        """The sum of log probabilities over the places whose preceding symbol belongs to this shard."""
        if len(c) < ORDER:
            return 0.0
        left = np.arange(ORDER - 1, len(c))
        if len(self.heads) or not self.others:
            left = left[np.isin(c[left - 1], self.heads, invert=self.others)]
        if self.parts > 1:
            left = left[_part(c[left], self.parts) == self.part]
        total = np.zeros(len(left))
        rows = np.arange(len(left))
        for n in range(ORDER, 0, -1):
            row = self.find(gram_codes(c, n)[left - n + 1])
            found = row >= 0
            total[rows[found]] += self.value[row[found]]
            left, rows = left[~found], rows[~found]
            if not len(left):
                return float(total.sum())
            if n > 1:
                total[rows] += self.value[self.find(gram_codes(c, n - 1)[left - n + 1] ^ _CONTEXT)]
        total[rows] += self.unseen
        return float(total.sum())


@dataclass
class Shards:
    """A model in the shared folder: for each shard its symbols before, whether it takes all others instead, its part of them and the number of parts."""

    folder: str
    parts: list[tuple[list[int], bool, int, int]]
    unseen: float


@lru_cache(1)
def _singles(folder: str) -> tuple:
    return tuple(read_part(f"{folder}/shard=-1", ["code", "value"]))


@lru_cache(1)
def _shard(folder: str, k: int, heads: tuple, others: bool, part: int, parts: int, unseen: float) -> Shard:
    own, single = read_part(f"{folder}/shard={k}", ["code", "value"]), _singles(folder)
    code, value = (np.concatenate((a, b)) for a, b in zip(own, single))
    return Shard(code.astype(np.int64).view(np.uint64), value, heads, others, part, parts, unseen)


def shards(model: DataFrame) -> Shards:
    """Write the model in shards. n-grams of two characters or more go by the last but one, back-off weights by the last; single characters
    (at most as many as there are code points) are read with every shard. Only sizes by character come to the driver."""
    spark, size = model.sparkSession, F.length("gram")
    head = lambda at: F.when(size > at, F.substring("gram", size - at, F.lit(1))).alias("head")
    entries = model.filter("logp is not null").select("gram", F.lit(False).alias("context"), F.col("logp").alias("value"), head(1))
    weights = model.filter("back is not null").select("gram", F.lit(True).alias("context"), F.col("back").alias("value"), head(0))
    both = materialize(entries.unionByName(weights), "kn-model")
    sizes = {r["head"]: r["n"] for r in both.groupBy("head").agg(F.count("*").alias("n")).collect()}
    sizes.pop(None, 0)
    unseen = both.filter("head is null and length(gram) = 0").agg(F.max("value")).first()[0] or 0.0
    known = both.filter("not context and length(gram) = 1").count()
    groups: list[tuple[int, list[int]]] = []  # rows, heads
    parts: list[tuple[list[int], bool, int, int]] = []
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if n > SHARD:
            m = -(-n // SHARD)
            parts += [([ord(name)], False, k, m) for k in range(m)]
            continue
        for i, g in enumerate(groups):
            if g[0] + n <= SHARD:
                groups[i] = (g[0] + n, [*g[1], ord(name)])
                break
        else:
            groups.append((n, [ord(name)]))
    parts += [(names, False, 0, 1) for _, names in groups]
    first = {h: k - part for k, (names, _, part, _) in enumerate(parts) for h in names}
    many = {h: m for names, _, _, m in parts for h in names}
    # one more shard has no rows but the single characters: it takes the places after symbols that the model does not have
    parts.append((sorted(first), True, 0, 1))
    order = sorted(first)
    places = (np.array(order, np.uint32), np.array([first[h] for h in order], np.int64), np.array([many[h] for h in order], np.int64))
    coded = both.filter("length(gram) > 0").select("gram", "context", "value").mapInArrow(partial(_code_batches, places=places), "shard int, code long, value double")
    folder = table_path(spark, "kn-shards")
    coded.repartition("shard", F.pmod("code", F.lit(4))).write.partitionBy("shard").parquet(folder)
    drop_table(both)
    return Shards(folder, parts, unseen - math.log(known + 1))


def _rest(model: Shards) -> Shard:
    heads, others, part, parts = model.parts[-1]
    code, value = _singles(model.folder)
    return Shard(code.astype(np.int64).view(np.uint64), value, heads, others, part, parts, model.unseen)


def _score_batches(batches, shards):
    model, names = shards.value, None
    for some in held(batches, "text", HELD if len(model.parts) > 2 else 0):
        texts = [[t or "" for t in batch.column("text").to_pylist()] for batch in some]
        log_p, size = ([np.zeros(len(x)) for x in texts] for _ in range(2))
        for k, (heads, others, part, parts) in enumerate(model.parts):
            shard = _shard(model.folder, k, tuple(heads), others, part, parts, model.unseen) if k + 1 < len(model.parts) else _rest(model)
            for batch, lp, n in zip(texts, log_p, size):
                for i, text in enumerate(batch):
                    for c in pieces(text):
                        lp[i] += shard.score(c)
                        n[i] += (len(c) - ORDER + 1) * (k == 0)
        for batch, lp, n in zip(some, log_p, size):
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(lp), pa.array(n.astype(np.int64))], [*names, "log_p", "size"])


def perplexity(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs (with text), log_p (sum over characters), size (characters, folded) and perplexity; columns of these names are replaced."""
    docs = docs.drop("log_p", "size", "perplexity")
    shared = docs.sparkSession.sparkContext.broadcast(shards(model))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", log_p double, size long"
    out = docs.mapInArrow(partial(_score_batches, shards=shared), schema)
    return out.withColumn("perplexity", F.when(F.col("size") > 0, F.exp(-F.col("log_p") / F.col("size"))))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents labelled of good quality and not toxic."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    if labels.count() <= MAX_BROADCAST:
        good = F.broadcast(good)
    return docs.join(good, "doc_id", "left_semi")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, low, high, own_weight, keep for all docs (doc_id, text, lang)."""
    docs = docs.select("doc_id", "text", "lang")
    aside = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(5)) == 0
    grams = materialize(counts(trusted(docs, labels).filter(~aside)), "kn-counts")
    scored = materialize(perplexity(docs, probabilities(grams)).select("doc_id", "lang", "perplexity"), "perplexities")
    bounds = [F.percentile_approx("perplexity", F.lit(q), F.lit(10_000)).alias(name) for q, name in ((LOW, "low"), (HIGH, "high"))]
    sure = trusted(scored, labels).filter("perplexity is not null")
    sure = sure.filter(aside) if sure.filter(aside).take(1) else sure
    whole = sure.agg(*bounds).first()
    by_lang = sure.groupBy("lang").agg(*bounds, (F.count("*") / (F.count("*") + F.lit(float(PRIOR)))).alias("w"))
    by_lang = by_lang.select(F.col("lang").alias("_lang"), *(_drawn_in(F.col("w"), F.col(k), F.lit(whole[k]).cast("double")).alias(f"_{k}") for k in ("low", "high")), F.col("w").alias("_w"))
    by_lang = F.broadcast(by_lang) if by_lang.count() <= MAX_BROADCAST else by_lang
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    low = F.coalesce("_low", F.lit(whole.low).cast("double")) / MARGIN
    high = F.coalesce("_high", F.lit(whole.high).cast("double")) * MARGIN
    keep = F.coalesce(F.col("perplexity").between(low, high), F.lit(False))
    return out.select("doc_id", "lang", "perplexity", low.alias("low"), high.alias("high"), F.coalesce("_w", F.lit(0.0)).alias("own_weight"), keep.alias("keep"))


def _drawn_in(w: Column, own: Column, whole: Column) -> Column:
    """A quantile between the language's own and that of all, on the scale of logarithms."""
    return F.exp(w * F.log(own) + (1 - w) * F.log(whole))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, low, high, own_weight, keep over the whole documents table."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
