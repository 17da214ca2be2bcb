from collections import Counter

from tests.compare import connect, same
from waymark.llm import linededup, queries


def test_query_equals_sql(spark, sf_dir):
    same(linededup.op6_line_dedup(spark, sf_dir), connect(sf_dir).execute(queries.ORACLE["op6_line_dedup"]).df())


def brute(texts, least):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if found[key(x)] < least]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def test_odd_rows_against_brute_force(odd, none, spark):
    df = odd.unionByName(odd.selectExpr("doc_id + 100 as doc_id", *[c for c in odd.columns if c != "doc_id"]))
    runs = linededup.LineRuns(spark, min_docs=3, fanout=2)
    for batch in linededup.in_batches(df, 5):
        runs.add(batch)
    assert sum(map(len, runs.levels)) < 5  # runs were merged
    got = sorted((r.n_lines, r.n_dropped, r.kept) for r in runs.clean(df).collect())
    assert got == brute([r.text for r in df.collect()], 3)
    again = linededup.LineRuns(spark, min_docs=3, fanout=2, folder=runs.folder)
    for level in again.levels:
        for name in level:
            spark.sql(f"drop table {name}")  # as in a new session, which knows the folder alone
    assert again.levels == runs.levels and again.decided().count() == runs.decided().count() > 0
    empty = linededup.LineRuns(spark)
    empty.add(none)
    assert empty.clean(none).count() == 0 and linededup.LineRuns(spark).clean(odd).count() == odd.count()


def test_keys(spark):
    lines = ["  A b\t", "ÄB", "KK", "\x0bX\x0c", "", " A"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.k for r in df.select(linededup.key_of(df.line).alias("k")).collect()] == ["a b", "Äb", "kK", "x", "", " a"]


def test_only_data_frames(spark, sf_dir):
    plan = linededup.op6_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_runs_are_joined_as_they_lie(spark, docs, capsys):
    runs = linededup.LineRuns(spark, min_docs=2, buckets=3)
    first, second = linededup.in_batches(docs, 2)
    runs.add(first)
    runs.add(second)
    with linededup._as_sorted(spark):
        runs.new_keys(docs).explain()
        plan = capsys.readouterr().out
        runs._merged([n for level in runs.levels for n in level]).explain()
        merged = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "SortMergeJoin" in merged and "Exchange" not in merged and "Sort [" not in merged
    assert plan.count("Exchange") == 2 and plan.count("Sort [") == 1  # the batch's own: its keys are counted, then dealt into the buckets


def test_clashing_names(spark, odd):
    df = odd.selectExpr("*", "1 as n_lines", "2 as kept", "3 as r1", "4 as pos", "5 as h1", "6 as `drop`", "7 as lines", "8 as key")
    runs = linededup.LineRuns(spark, min_docs=2)
    runs.add(df)
    out = runs.clean(df)
    assert out.columns == [c for c in df.columns if c not in ("n_lines", "kept")] + ["n_lines", "n_dropped", "kept"]
    assert sorted((r.n_lines, r.n_dropped, r.kept) for r in out.collect()) == brute([r.text for r in df.collect()], 2)
    assert {(r.r1, r.pos, r.h1, r.drop, r.lines, r.key, r.row) for r in out.collect()} == {(3, 4, 5, 6, 7, 8, "z")}
