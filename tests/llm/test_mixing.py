import math

from tests.compare import connect, same
from waymark.llm import mixing, queries


def test_query_equals_sql(spark, sf_dir):
    same(mixing.op3_mixing(spark, sf_dir), connect(sf_dir).execute(queries.ORACLE["op3_mixing"]).df())


def test_rates_meet_the_weights(spark):
    df = spark.range(60_000).selectExpr("id as doc_id", "cast(id as string) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source")
    weights = {"hot": 1.0, "s1": 3.0, "s2": 1.0}
    got = {r.source: r["count"] for r in mixing.mix(df, weights).groupBy("source").count().collect()}
    total = sum(got.values())
    assert set(got) == set(weights) and abs(total - 60_000) < 4 * math.sqrt(60_000) * 3
    for s, w in weights.items():
        assert abs(got[s] / total - w / 5) < 0.02


def test_counts_follow_the_poisson_distribution(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "'t' as text", "'s' as source")
    drawn = mixing.replicate(df, mixing.rates(df, {"s": 1.0}, total=60_000)).groupBy("copies").count().collect()
    for k in (1, 2, 3, 4):
        want = 40_000 * math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs({r.copies: r["count"] for r in drawn}[k] - want) < 5 * math.sqrt(want)


def test_salted_join_gives_the_same(odd, monkeypatch):
    key = lambda df: sorted((str(r.doc_id), str(r.text), r.copy) for r in df.collect())
    broadcast = key(mixing.mix(odd))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert key(mixing.mix(odd)) == broadcast


def test_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert [c for c in out.columns if c not in ("copy", "mix_key")] == [c for c in odd.columns if c != "copy"]
    assert mixing.mix(none).count() == 0 and mixing.mix(odd, {"nowhere": 1.0}).count() == 0


def test_large_rates_follow_the_poisson_distribution(spark):
    n = 4000
    df = spark.range(n).selectExpr("id as doc_id", "'t' as text", "'s' as source")
    for rate in (0.1, 500.0, 800.0, 5000.0):
        rows = mixing.replicate(df, mixing.rates(df, {"s": 1.0}, total=rate * n)).groupBy("copies").count().collect()
        total = sum(r.copies * r["count"] for r in rows)
        square = sum(r.copies**2 * r["count"] for r in rows)
        mean = total / n
        variance = square / n - mean**2
        assert abs(mean - rate) < 5 * math.sqrt(rate / n)
        assert abs(variance - rate) < 6 * rate * math.sqrt((2 + 1 / rate) / n)


def test_clashing_names(spark):
    df = spark.range(50).selectExpr("id as doc_id", "'t' as text", "'s' as source", "'a' as copies", "'b' as row", "'c' as cdf", "'d' as parts", "'e' as salt", "'f' as own", "'g' as mixed_source", "'h' as copy")
    out = mixing.mix(df)
    assert out.columns == [c for c in df.columns if c != "copy"] + ["copy", "mix_key"]
    assert {(r.copies, r.row, r.cdf, r.parts, r.salt, r.own, r.mixed_source) for r in out.collect()} == {tuple("abcdefg")}


def test_sql_of_large_rates(spark, tmp_path, sf_dir):
    spark.range(30).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang", "case when id < 1 then 'rare' end as source", "1L as n_chars").write.parquet(str(tmp_path / "d"))
    con = connect(sf_dir)
    con.execute(f"create or replace view documents as select * from '{tmp_path}/d/*.parquet'")
    sql = queries.ORACLE["op3_mixing"].replace("500.0", "0.7")
    import unittest.mock

    with unittest.mock.patch.object(mixing, "PART", 0.7):
        same(mixing.mix(spark.read.parquet(str(tmp_path / "d"))), con.execute(sql).df())
