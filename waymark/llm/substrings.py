"""Substring deduplication by hashes of lines and of content-defined pieces of long lines.

Units: every line; a line of more than UNIT_WORDS words is cut after each word whose checksum is a multiple of CUT, once a piece has UNIT_WORDS
words. Where a piece ends depends on its last words alone, so equal passages are cut alike wherever they stand, and within the first few
words of a passage the pieces agree again. A unit is normalised to its lower-case words. Digests (128 bits) are grouped over the whole corpus
and the occurrence that ranks first (smallest doc_id, then place) stays. Every other occurrence is removed: repeated units
that follow one another make a passage, whose place in the original text is the result.

min_words: units of fewer words are left out, by default none is. Nulls: a null text has no units; rows without a doc_id rank first.
Ties: rows that repeat a doc_id stay apart and rank by their place in the table. Lines without a word are no units. Very long texts are cut
as they are read; a text may repeat itself. Empty tables give empty results. Extra columns stay (remove() replaces one named removed).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices

UNIT_WORDS, CUT = 8, 4
#: A removed passage of so many words is long.
LONG_WORDS = 25
_LINE = re.compile(r"[^\n]+")
_WORD = re.compile(r"\w+")
_KEPT = 200_000


def units(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """start, end, words of every unit."""
    ends: dict[str, bool] = {}
    for line in _LINE.finditer(text):
        at, have, last = line.start(), [], line.end()
        for m in _WORD.finditer(text, at, last):
            word = m[0].lower()
            have.append(word)
            if len(have) >= UNIT_WORDS:
                cut = ends.get(word)
                if cut is None:
                    if len(ends) >= _KEPT:
                        ends.clear()
                    cut = ends[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % CUT == 0
                if cut and m.end() < last:
                    yield at, m.end(), have
                    at, have = m.end(), []
        if have:
            yield at, last, have


UNITS = "row long, doc_id long, seq int, start int, end int, words int, h1 long, h2 long"


def _unit_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        rows = []
        for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
            seq = 0
            for start, end, words in units(text or ""):
                if len(words) >= min_words:
                    h = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
                    rows.append((row, doc_id, seq, start, end, len(words), (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
                    seq += 1
        cols = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in UNITS.split(", ")])


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def passages(docs: DataFrame, min_words: int = 0) -> DataFrame:
    """row (of docs, by place), doc_id, start, end (code points), words, units, first_doc_id: every passage to remove."""
    return _passages(_numbered(docs), min_words)


def _passages(numbered: DataFrame, min_words: int) -> DataFrame:
    """The same for documents with a row number.

    Digests are counted and ranked before they are shuffled, and the join back may be cut where a digest is hot: no step
    needs the occurrences of one digest together.
    """
    every = materialize(numbered.mapInArrow(partial(_unit_batches, min_words=min_words), UNITS), "units")
    rank = F.struct("doc_id", "row", "seq")
    groups = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(rank).alias("first")).filter("n > 1").drop("n")
    groups = materialize(groups, "repeated-units")  # a table, so that the join can split a hot digest's occurrences over tasks
    again = every.join(groups, ["h1", "h2"]).filter(~rank.eqNullSafe(F.col("first")))
    in_text = Window.partitionBy("row").orderBy("seq")
    runs = again.select("row", "doc_id", "seq", "start", "end", "words", F.col("first.doc_id").alias("first_doc_id"))
    runs = runs.withColumn("run", F.col("seq") - F.row_number().over(in_text))
    out = runs.groupBy("row", "run").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
        F.count("*").alias("units"), F.min_by("first_doc_id", "seq").alias("first_doc_id"))
    return out.drop("run")


def remove(docs: DataFrame, min_words: int = 0) -> DataFrame:
    """docs with text cut and removed (array of start, end in the original text)."""
    columns = [c for c in docs.columns if c != "removed"]
    # numbered once, in a table: a number made again could fall on another row
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("doc")), "numbered-documents")
    spans = _passages(numbered.select("row", "doc.doc_id", "doc.text"), min_words).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    met = numbered.join(spans, "row", "left")
    text, start = F.col("doc.text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        "removed", start, lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    met = met.select("doc", F.when(F.col("removed").isNull(), text).otherwise(cut).alias("cut"), F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))
    return met.select(*((F.col("cut") if c == "text" else F.col("doc").getField(c)).alias(c) for c in columns), "removed")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row of the whole documents table from which something is removed: doc_id, n_passages, n_units, n_words, n_long (passages of
    LONG_WORDS words or more), removed (start:end:first_doc_id of every passage, in order)."""
    found = passages(documents(spark, sf_dir))
    span = F.concat_ws(":", "start", "end", F.coalesce(F.col("first_doc_id").cast("string"), F.lit("")))
    out = found.groupBy("row").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n_passages"), F.sum("units").alias("n_units"), F.sum("words").alias("n_words"),
        F.count_if(F.col("words") >= LONG_WORDS).alias("n_long"), F.sort_array(F.collect_list(F.struct("start", span.alias("span")))).alias("spans"))
    return out.select("doc_id", "n_passages", "n_units", "n_words", "n_long", F.array_join(F.transform("spans", lambda s: s["span"]), ",").alias("removed"))
