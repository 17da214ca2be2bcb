import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import decontaminate as D


def edits(window, text):
    """Least edits between the window and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_query_finds_every_planted_item(spark, sf_dir, texts):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in D.op9_decontamination(spark, sf_dir).collect()}
    want = {(d, i) for d, t in texts.items() for i, b in bench.items() if b in t}
    assert want <= set(got) and want
    for (d, i), r in got.items():
        part, _ = D.fold(texts[d][r.start : r.end])
        assert min(edits(w.tolist(), part.tolist()) for _, w in D.windows_of([(i, bench[i])])) <= r.edits


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_windows_within_budget_are_found(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(1, 8)))
    item = " ".join(word() for _ in range(60))
    text = list(item)
    for at in sorted(rng.permutation(len(text))[: rng.integers(0, 6)])[::-1]:
        kind = rng.integers(0, 3)
        if kind == 0:
            text[at] = "z"
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, "q")
    body = " ".join(word() for _ in range(80)) + " " + "".join(text).upper() + " " + " ".join(word() for _ in range(80))
    block = D.Block(D.windows_of([(1, item)]))
    codes, _ = D.fold(body)
    want = any(edits(w.tolist(), codes.tolist()) <= b for w, b in zip(block.windows, block.budget.tolist()))
    assert bool(D.search(block, body)) == want


def test_alignment_against_plain_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        w = rng.integers(0, 4, 20).astype(np.uint32)
        r = np.concatenate((rng.integers(0, 4, 4), w, rng.integers(0, 4, 5))).astype(np.uint32)
        for at in rng.permutation(len(r))[: rng.integers(0, 4)]:
            r[at] = 9
        got = D.align(w, r, 3)
        want = edits(w.tolist(), r.tolist())
        assert (got[0] if got else 99) == (want if want <= 3 else 99)
        if got:
            assert edits(w.tolist(), r[got[1] : got[2]].tolist()) <= got[0]


def test_short_items_and_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "few words"), (2, None), (3, ""), (4, "!!!"), (None, "plain TEXT, with a few words in it"), (5, "ew word")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.hits(odd, bench).collect()} == {(1, 1), (1, None)}
    assert D.hits(none, bench).count() == 0 and D.hits(odd, bench.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in D.keep_clean(odd, bench).collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id != 1)
    assert D.keep_clean(odd, bench).columns == odd.columns


def test_blocks_give_the_same(spark, docs, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, D.hits(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK", 7)
    assert sorted(map(tuple, D.hits(docs, bench).collect())) == whole


def test_blocks_give_the_same_for_repeated_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and then walks home along the river to sleep until noon on the next day of the week"
    rows = [(1, f"before it {item} after it")] * 3 + [(None, item.upper()), (2, item[3:118]), (3, "nothing of the kind"), (4, None)]
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, "few words"), (9, None)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, D.hits(docs, bench).collect()))
    assert len(one) == 2 * 5
    for size in (1, 3):
        monkeypatch.setattr(D, "BLOCK", size)
        assert sorted(map(str, D.hits(docs, bench).collect())) == one
        assert sorted(str(r.doc_id) for r in D.keep_clean(docs, bench).collect()) == ["3", "4"]


def test_every_excerpt_of_the_least_length_is_found():
    words = np.random.default_rng(8)
    item = " ".join("".join(words.choice(list("abcdefgh"), words.integers(2, 8))) for _ in range(80))
    codes, _ = D.fold(item)
    block, least = D.Block(D.windows_of([(1, item)])), D.WINDOW + D.STRIDE - 1
    for at in range(0, len(codes) - least):
        part = "zz zz " + "".join(" " if c == 1 else chr(c) for c in codes[at : at + least].tolist()).strip() + " zz zz"
        if len(D.fold(part)[0]) == least + 12:  # an excerpt that begins or ends at a blank is shorter
            assert D.search(block, part)


def test_stretches_give_the_same(monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and then walks home along the river to sleep until noon"
    text = "filler words go here " * 40 + item + " more filler words " * 40
    block = D.Block(D.windows_of([(1, item)]))
    whole = D.search(block, text)
    monkeypatch.setattr(D, "STRETCH", 300)
    assert D.search(block, text) == whole and whole
