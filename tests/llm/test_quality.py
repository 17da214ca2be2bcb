import math
from collections import Counter, defaultdict

import pytest

from waymark.llm import quality as Q


def brute_model(texts):
    """Probability of the last symbol of a history, by the definition."""
    folded = [Q.symbols(t).tolist() for t in texts if t]
    grams = Counter(tuple(c[i - Q.ORDER + 1 : i + 1]) for c in folded for i in range(Q.ORDER - 1, len(c)))
    levels = {Q.ORDER: grams}
    for k in range(Q.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    tables = {}
    for k, level in levels.items():
        n = [sum(v == x for v in level.values()) for x in (1, 2, 3, 4)]
        if all(n[:3]):
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            d = [min(max(x, 0.05), k_ - 0.05) for k_, x in zip((1, 2, 3), d)]
        else:
            d = [0.5, 0.75, 0.9]
        total, held = defaultdict(int), defaultdict(float)
        for g, v in level.items():
            total[g[:-1]] += v
            held[g[:-1]] += d[min(v, 3) - 1]
        tables[k] = (level, d, total, held)

    def p(g):
        k = len(g)
        level, d, total, held = tables[k]
        lower = 1 / (len(levels[1]) + 1) if k == 1 else p(g[1:])
        if g[:-1] not in total:
            return lower
        n = level.get(g, 0)
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * lower

    return p


@pytest.mark.parametrize("shard", [4_000_000, 300])
def test_perplexity_by_the_definition(spark, docs, texts, monkeypatch, shard):
    monkeypatch.setattr(Q, "SHARD", shard)
    train = docs.filter("doc_id < 25")
    p = brute_model([texts[k] for k in range(25)])
    model = Q.probabilities(Q.counts(train))
    got = {r.doc_id: r for r in Q.perplexity(docs.filter("doc_id between 20 and 40"), model).collect()}
    for d, r in got.items():
        c = Q.symbols(texts[d]).tolist()
        want = sum(math.log(p(tuple(c[i - Q.ORDER + 1 : i + 1]))) for i in range(Q.ORDER - 1, len(c)))
        assert math.isclose(r.log_p, want, rel_tol=1e-4), d
        assert r["size"] == len(c) - Q.ORDER + 1


def test_probabilities_add_up(spark, docs):
    model = Q.probabilities(Q.counts(docs.filter("doc_id < 10"))).collect()
    ps = {r.gram: math.exp(r.logp) for r in model if r.logp is not None}
    unseen = math.exp(next(r.back for r in model if r.gram == "")) / (sum(len(g) == 1 for g in ps) + 1)
    assert math.isclose(sum(v for g, v in ps.items() if len(g) == 1) + unseen, 1, rel_tol=1e-9)


def test_junk_goes_and_prose_stays(spark):
    at = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in Q.op1_quality(spark, at).collect()}
    assert len(rows) == 1000
    good = [rows[d].keep for d, r in labels.items() if r.quality == 1]
    junk = [rows[d].keep for d, r in labels.items() if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(junk) / len(junk) < 0.2


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None), (7, None, None), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.perplexity is None and not r.keep for r in rows if r.doc_id in (2, 3))
    assert Q.classify(none, labels).count() == 0 and Q.classify(odd, labels.limit(0)).count() == odd.count()


def test_bounds_and_keep_by_the_definition(spark):
    at = "/root/testdata/sf0.01"
    rows = Q.op1_quality(spark, at).collect()
    labels = spark.read.parquet(f"{at}/labels.parquet").filter("quality = 1 and coalesce(toxic, 0) = 0")
    aside = {r.doc_id for r in labels.selectExpr("doc_id", "pmod(xxhash64(coalesce(doc_id, 0L)), 5) = 0 as a").collect() if r.a}
    held = [r for r in rows if r.doc_id in aside and r.perplexity is not None]

    def quantile(q, some):
        at = sorted(r.perplexity for r in some)
        return at[max(0, math.ceil(q * len(at)) - 1)]

    langs = {r.lang for r in rows}
    assert len(langs) > 3
    for lang in langs:
        own = [r for r in held if r.lang == lang]
        w = len(own) / (len(own) + Q.PRIOR)
        low, high = (math.exp((w * math.log(quantile(q, own)) if own else 0) + (1 - w) * math.log(quantile(q, held))) for q in (Q.LOW, Q.HIGH))
        for r in rows:
            if r.lang == lang:
                assert math.isclose(r.low, low / Q.MARGIN, rel_tol=1e-6) and math.isclose(r.high, high * Q.MARGIN, rel_tol=1e-6) and math.isclose(r.own_weight, w)
                assert r.keep == (r.perplexity is not None and r.low <= r.perplexity <= r.high)
    assert len({r.high for r in rows}) == len(langs)


def test_long_texts_are_folded_in_pieces(monkeypatch):
    text = "Some  text 12\n\n with   blanks " * 20
    whole = Q.symbols(text)
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(Q, "PIECE", size)
        assert (Q.symbols(text) == whole).all() and len(Q.symbols("")) == Q.ORDER - 1
