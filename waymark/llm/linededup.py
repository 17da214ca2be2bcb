"""Line deduplication against levelled sorted runs of line hashes; DataFrame functions only.

A run is a bucketed table of (h1, h2, n): 96 bits of hash of a line key and the number of documents that hold it, dealt by hash
into the same number of buckets as every other run and sorted in each. A new batch is dealt the same way once and merge-anti-joins
the runs one after the other, each as it lies, without an exchange or a sort of the run: keys that a run by itself decides (found in
`min_docs` documents) are not taken in again. The batch's other keys become a run of level 0; `fanout` runs of a level are merged into one
of the next, where counts add up. The runs and their levels stand in a list beside them, so a later session can open the
folder and go on.

Nulls: a null text is one empty line. A row counts as one document even if its doc_id is null or repeated. Lines whose
key is empty are never dropped. Ties: of a key's lines all go or none. Very long texts and lines are split and hashed like any other.
Empty tables give empty results. Extra columns stay, under any name; clean() replaces columns named n_lines, n_dropped or kept.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_folder, materialize, table_path

#: Characters stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased. lower() does that for plain ASCII, and faster than translate()."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(F.btrim(line, F.lit(BLANK)))).otherwise(F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER))


def hashes_of(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")


@contextmanager
def _as_sorted(spark: SparkSession):
    """Plans made inside take the buckets of a table as sorted (a run has one file for each), and anti-join after a batch is aggregated, not before."""
    for_now = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"}
    before = {name: spark.conf.get(name, None) for name in for_now}
    for name, value in for_now.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class LineRuns:
    """The levelled runs in a folder of the shared file system (a new one, or one of an earlier session that is opened again).

    buckets: of every run; a folder's own number where it has runs. The number of runs is fanout x log(batches) at most.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 3, folder: str | None = None, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = folder or table_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        listed = [r.value for r in spark.read.text(f"{self.folder}/list").collect()] if self._exists(f"{self.folder}/list") else []
        if listed:
            state = json.loads(max(listed, key=lambda x: json.loads(x)["version"]))
            self.levels, self.buckets, self.version = state["levels"], state["buckets"], state["version"]
        else:
            self.version = 0

    def _exists(self, folder: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _note(self) -> None:
        """Append the list of runs as it is now; the highest version counts."""
        self.version += 1
        state = json.dumps({"version": self.version, "levels": self.levels, "buckets": self.buckets})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/list")

    def _write(self, counts: DataFrame) -> str:
        """counts (h1, h2, n), dealt into the buckets, as a run."""
        name = f"line_run_{uuid.uuid4().hex}"
        counts.select("h1", "h2", "n").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # written by another session
            self.spark.sql(f"create table {name} (h1 bigint, h2 int, n bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.folder}/{name}'")
        return self.spark.table(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        drop_folder(self.spark, f"{self.folder}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        """h1, h2, n over some runs: merge joins of sorted buckets."""
        parts = [self.run(name) for name in names]

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            met = a.alias("a").hint("merge").join(b.alias("b"), ["h1", "h2"], "full")
            return met.select("h1", "h2", (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))

        return reduce(both, parts)

    def decided(self) -> DataFrame:
        """h1, h2 of the keys found in min_docs documents or more, over all runs; a table."""
        runs = [name for level in self.levels for name in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 int")
        with _as_sorted(self.spark):
            return materialize(self._merged(runs).filter(F.col("n") >= self.min_docs).select("h1", "h2"), "decided-keys")

    def new_keys(self, docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
        """h1, h2, n of a batch's keys but those that one of the runs decides; dealt and sorted as the runs are."""
        keys = F.array_distinct(F.transform(lines_of(text), key_of))
        keys = docs.select(F.explode(keys).alias("key")).filter(F.length("key") >= min_chars)
        batch = keys.select(*hashes_of(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n"))
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):  # else the keys lie in the buckets already
            batch = batch.repartition(self.buckets, "h1", "h2")
        for level in self.levels:
            for name in level:
                batch = batch.hint("merge").join(self.run(name).filter(F.col("n") >= self.min_docs), ["h1", "h2"], "left_anti")
        return batch

    def add(self, docs: DataFrame, text: str = "text", min_chars: int = 1) -> None:
        """Take in a batch of documents."""
        with _as_sorted(self.spark):
            run, level, gone = self._write(self.new_keys(docs, text, min_chars)), 0, []
            while True:
                if len(self.levels) <= level:
                    self.levels.append([])
                self.levels[level].append(run)
                if len(self.levels[level]) < self.fanout:
                    break
                full, self.levels[level] = self.levels[level], []
                run = self._write(self._merged(full))
                gone += full
                level += 1
        self._note()
        for name in gone:
            self._drop(name)

    def clean(self, docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
        """docs with n_lines, n_dropped and kept (the text without the lines whose keys are decided)."""
        columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
        packed = docs.select(F.struct(*columns).alias("row"), F.col(text).alias("body"))
        # rows are named by 128 bits of all their columns; equal rows lose the same lines, so they may share a name
        mark = packed.withColumn("r1", F.xxhash64("row")).withColumn("r2", F.xxhash64(F.lit("line"), "row"))
        lines = mark.select("r1", "r2", F.posexplode(lines_of("body")).alias("pos", "line"))
        lines = lines.select("r1", "r2", "pos", key_of(F.col("line")).alias("key")).filter(F.length("key") >= min_chars).select("r1", "r2", "pos", *hashes_of(F.col("key")))
        hit = lines.hint("merge").join(self.decided(), ["h1", "h2"], "left_semi")  # a table, so that a hot key's lines can be split over tasks
        drop = hit.groupBy("r1", "r2").agg(F.collect_set("pos").alias("drop"))
        out = mark.join(drop, ["r1", "r2"], "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>"))).withColumn("lines", lines_of("body"))
        left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
        kept = F.when(F.size("drop") == 0, F.coalesce(F.col("body"), F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
        out = out.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"), kept.alias("kept"))
        return out.select(*(F.col("row").getField(c).alias(c) for c in columns), "n_lines", "n_dropped", "kept")


def in_batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs cut by doc_id into n ranges of equal width; rows without an id are in the first."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None or n < 2:
        return [docs]
    edges = [lo + (hi - lo + 1) * i // n for i in range(1, n)]
    first = docs.filter((F.col("doc_id") < edges[0]) | F.col("doc_id").isNull())
    return [first, *(docs.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(edges, edges[1:])), docs.filter(F.col("doc_id") >= edges[-1])]


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 over the whole documents table, taken in as four batches."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    runs = LineRuns(spark)
    for batch in in_batches(docs, 4):
        runs.add(batch)
    return runs.clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with l as (
  select doc_id, row_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from (select doc_id, text, row_number() over () as row_id from documents)),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
hot as (select key from k where length(key) >= 1 group by key having count(distinct row_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where hot.key is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where hot.key is null), '')) as kept_sha256
from k left join hot on k.key = hot.key group by row_id, doc_id
"""
