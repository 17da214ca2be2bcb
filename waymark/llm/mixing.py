"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times that its documents should appear: weight x total / (sum of weights x documents of the
source). Every document gets a number of copies by inverting the Poisson distribution of that mean at a uniform number hashed
from seed, doc_id and text; copies are exploded and the corpus is dealt and sorted by a second hash, a global shuffle. A rate over
PART is cut into equal parts of at most PART, each inverted at a hash of its own, and their counts are added: the sum of
independent Poisson numbers is one of the summed rate, and no distribution function underflows.

Nulls: a null source is a source of its own; a null doc_id or text is hashed as an empty string. Ties and repeated rows: rows that are
equal in doc_id and text get the same number of copies and differ in nothing. A source without a weight (or a weight of 0) is left
out. Long texts are hashed once, whole. An empty table gives an empty one. Extra columns are carried along under any name;
a column of the input named copy or mix_key is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Sources up to this number are broadcast with their rates; beyond it documents are salted for a join by source.
MAX_BROADCAST = 100_000
SALTS = 64
#: The largest rate that one distribution function is made for.
PART = 500.0


def uniform(*parts) -> Column:
    """48 bits of an MD5, as a number in [0, 1)."""
    return _bits(*parts) / F.lit(float(1 << 48))


def _bits(*parts) -> Column:
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, total: float | None = None) -> DataFrame:
    """source, n, rate. weights by source, or by default n ** alpha; total: the documents wanted, by default as many as there are."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        counts = counts.join(F.broadcast(given), counts.source.eqNullSafe(given.source), "left").select(counts.source, "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = counts.agg(F.sum("weight").alias("w"), F.sum("n").alias("all_n")).first()
    if not whole.w:
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    return counts.select("source", "n", (F.col("weight") / F.lit(float(whole.w)) * F.lit(float(total or whole.all_n)) / F.col("n")).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """The distribution function at 0, 1, ... up to where it is 1 for 48-bit numbers."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def parts_of(rate: Column) -> Column:
    return F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")


def _drawn(packed: DataFrame, rated: DataFrame, seed: int) -> DataFrame:
    """packed (row, a struct of the documents' columns) with copies, without the rows that get none."""
    steps = rated.filter("rate > 0").select(F.col("source").alias("mixed_source"), parts_of(F.col("rate")).alias("parts"), poisson_steps(F.col("rate") / parts_of(F.col("rate"))).alias("cdf"))
    same = F.col("row.source").eqNullSafe(F.col("mixed_source"))
    if rated.count() <= MAX_BROADCAST:
        met = packed.join(F.broadcast(steps), same)
    else:
        salted = steps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = packed.withColumn("own", F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own") == F.col("salt")))
    # a lambda's own variable holds the hash, so a text is hashed once for each row and not for each step
    text = F.array(F.md5(F.coalesce("row.text", F.lit(""))))
    each = F.flatten(F.transform(text, lambda t: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: uniform(seed, F.col("row.doc_id"), t, k))))
    drawn = F.aggregate(each, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: u >= c)))
    return met.select("row", drawn.alias("copies")).filter("copies > 0")


def replicate(docs: DataFrame, rated: DataFrame, seed: int = 17) -> DataFrame:
    """docs with copies (how often the row appears; a column of that name is replaced), without the rows that get none."""
    drawn = _drawn(docs.select(F.struct(*docs.columns).alias("row")), rated, seed)
    drawn = drawn.select("row", F.col("copies").alias("drawn_copies"))
    return drawn.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "copies"), F.col("drawn_copies").alias("copies"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, seed: int = 17) -> DataFrame:
    """The rows of docs as often as drawn, with copy (0, 1, ...) and mix_key (48 bits), dealt and sorted by mix_key."""
    columns = [c for c in docs.columns if c not in ("copy", "mix_key")]
    drawn = _drawn(docs.select(F.struct(*columns).alias("row")), rates(docs, weights, alpha), seed)
    copies = drawn.select("row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).withColumn("mix_key", _bits("shuffle", seed, F.col("row.doc_id"), F.col("copy")))
    # keys are uniform, so equal ranges of them are equal shares: no pass to sample range bounds
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.repartitionById(n, (F.col("mix_key") / F.lit(float(1 << 48)) * n).cast("int"))
    in_order = dealt.sortWithinPartitions("mix_key", "row.doc_id", "copy")
    return in_order.select(*(F.col("row").getField(c).alias(c) for c in columns), "copy", "mix_key")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: every column of documents, copy, mix_key."""
    return mix(documents(spark, sf_dir))


ORACLE = """
with recursive c as (select source, count(*) as n, pow(count(*)::double, 0.7) as weight from documents group by source),
w as (select source, n, weight / (select sum(weight) from c) * (select sum(n)::double from c) / n as whole from c),
r as (select source, greatest(ceil(whole / 500.0::double), 1)::int as parts, whole / greatest(ceil(whole / 500.0::double), 1) as rate from w),
p as (
  select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as cdf from r
  union all
  select source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from p where k < ceil(rate + 12 * sqrt(rate) + 20)),
d as (select row_number() over () as id, documents.*, r.parts from documents join r on documents.source is not distinct from r.source),
u as (
  select id, source, ('0x' || substr(md5(concat_ws(':', '17', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')), part::varchar)), 1, 12))::bigint / 281474976710656.0::double as u
  from (select *, unnest(range(parts)) as part from d)),
n as (select id, sum((select count(*) from p where p.source is not distinct from u.source and u.u >= p.cdf))::bigint as copies from u group by id),
e as (select doc_id, text, lang, source, n_chars, unnest(range(copies)) as copy from d join n using (id) where copies > 0)
select doc_id, text, lang, source, n_chars, copy::int as copy,
  ('0x' || substr(md5(concat_ws(':', 'shuffle', '17', coalesce(doc_id::varchar, ''), copy::varchar)), 1, 12))::bigint as mix_key from e
"""
