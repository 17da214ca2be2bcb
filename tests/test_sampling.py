import random
from statistics import median

from pyspark.sql import functions as F

from waymark.operators import sampling


def clusters(values):
    """The same count with the median of the whole running cluster at every step."""
    k, run = 1, values[:1]
    for x in values[1:]:
        center = median(run)
        if center > 0 and abs(x - center) / center >= sampling.ALPHA:
            k, run = k + 1, []
        run.append(x)
    return k


def test_sequential_clusters_against_the_median_of_each_step(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 1.0, 1.01, 1.015, 1.02, 0.99, 5.0, 5.05]) for _ in range(rng.randint(1, 60))]) for k in range(400)]
    rows += [(900, [0.0] * 5), (901, [1.0]), (902, []), (903, [1.0] * 300), (904, [0.0, 7.0, 9.0, 8.0])]
    got = spark.createDataFrame(rows, "id long, b array<double>").select("id", sampling.sequential_count(F.col("b")).alias("n"))
    assert {r.id: r.n for r in got.collect()} == {k: clusters(b) for k, b in rows}


def test_one_long_cluster_is_counted_at_once(spark):
    steps = F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: 1.0 + F.pmod(F.xxhash64(i), F.lit(100)) / 100_000)
    assert spark.range(1).select(sampling.sequential_count(steps).alias("n")).first().n == 1
