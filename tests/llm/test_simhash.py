import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import simhash


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(ids, fps, radius):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and find(i) != find(j):
                up[max(find(i), find(j))] = min(find(i), find(j))
    roots = [find(i) for i in range(len(ids))]
    return {ids[i]: min(ids[j] for j in range(len(ids)) if roots[j] == roots[i]) for i in range(len(ids))}


def test_query_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, sf_dir).collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    want = brute_components(ids, fps, 4)
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in zip(ids, fps)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 4))
def test_exact_masks_lose_no_pair(seed, flips):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, 1, np.uint64, endpoint=False)[0]
    b = a
    for bit in rng.permutation(64)[:flips]:
        b ^= np.uint64(1 << int(bit))
    for n in (1000, 10**6, 10**9):
        masks = simhash.exact_masks(n, 4)
        assert ((masks[:, 0] & a) == (masks[:, 0] & b)).any()


@pytest.mark.parametrize("size", [5, 40, 300])
def test_cells_link_what_all_pairs_link(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**64, (max(1, size // 10), 1), np.uint64, endpoint=False)
    words = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.permutation(64)[: rng.integers(0, 5)])) for _ in range(10)]), axis=0)
    cells = np.zeros(len(words), np.int64)
    links = simhash.cell_links(cells, words, 4)
    fps, ids = [int(w) for w in words[:, 0]], list(range(len(words)))
    up = brute_components(ids, fps, 4)
    mine = list(range(len(words)))

    def find(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for a, b in links:
        assert bin(fps[a] ^ fps[b]).count("1") <= 4
        mine[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: find(i) for i in ids} == up and len(links) < len(words)


def test_large_cells_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    near = [(int(i), bytes(8 - 1) + bytes([0]) if i == 0 else (1 << int(rng.integers(0, 20)) | 1 << int(rng.integers(0, 20))).to_bytes(8, "big")) for i in range(120)]
    fps = spark.createDataFrame([(fp,) for fp in {fp for _, fp in near}], "fp binary")
    masks = np.array([[np.uint64(0xFFFFFFFF00000000)]])
    got = simhash.components(simhash.links(fps, masks, 4)).select("root").distinct().count()
    assert got == 1


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].fp == by_id[3].fp == by_id[5].fp == bytes(8) and by_id[7].component_id == by_id[6].component_id == 6
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and 7 not in {r.doc_id for r in kept.collect()} and simhash.keep_one(none).count() == 0


def test_near_copies_of_the_stage(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    copies = []
    for k in range(12):  # 8 changed words in 400: a Jaccard index of about 0.82 on five-word shingles
        own = list(words)
        for at in rng.permutation(400)[:8]:
            own[at] = f"x{k}{at}"
        copies.append((k, " ".join(own)))
    clean = [(100 + k, " ".join(f"w{j}" for j in rng.integers(0, 5000, 400))) for k in range(40)]
    df = spark.createDataFrame(copies[:2] + clean, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {0} | {c[0] for c in clean}


def test_near_copies_chain_through_their_text(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    copies = []
    for k in range(12):  # 8 changed words in 400: a Jaccard index of about 0.82 on five-word shingles with the text they come from
        own = list(words)
        for at in rng.permutation(400)[:8]:
            own[at] = f"x{k}{at}"
        copies.append((k + 1, " ".join(own)))
    clean = [(100 + k, " ".join(f"w{j}" for j in rng.integers(0, 5000, 400))) for k in range(40)]
    df = spark.createDataFrame([(0, " ".join(words)), *copies[:2], *clean], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {0} | {c[0] for c in clean}
    two = spark.createDataFrame(copies[:2], "doc_id long, text string")  # 0.69 to one another: no link without the text between
    assert {r.doc_id for r in simhash.keep_one(two).collect()} == {1, 2}


def brute_sets(rows):
    """The least id of each component of pairs with a Jaccard index of 0.8 or more, by comparing all."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


@pytest.mark.parametrize("tiles", [False, True])
def test_the_stage_against_brute_force(spark, texts, monkeypatch, tiles):
    rng = np.random.default_rng(9)
    base = [f"w{j}" for j in rng.integers(0, 5000, 120)]
    rows = list(texts.items())
    for k in range(60):  # a large group of near copies, with links and without
        own = list(base)
        for at in rng.permutation(120)[: rng.integers(0, 4)]:
            own[at] = f"x{k}"
        rows.append((10_000 + k, " ".join(own)))
    if tiles:
        monkeypatch.setattr(simhash, "SET_TILE", 4000)
        monkeypatch.setattr(simhash, "TILE", 16)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.STAGE).collect()}
    assert got == brute_sets(rows)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    body = (" ".join(f"Word{k * 37 % 101}" for k in range(3000)) + "\n").encode() * 3
    whole = simhash.shingle_hashes(body, 5)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert (simhash.shingle_hashes(body, 5) == whole).all() and len(whole) == 9000 - 4
    assert (simhash.shingle_hashes(b"a  B c", 5) == simhash.shingle_hashes(b"A b C", 5)).all() and not len(simhash.shingle_hashes(b" \n" * 90, 5))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5)]
    edges += [(5000, 4000 + k) for k in range(600)] + [(4001, 3000), (4001, 3000), (None, 7)]  # a hub that is not the least node
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(80)} | dict.fromkeys([3000, 5000, *range(4000, 4600)], 3000)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_stage_links_by_exact_similarity(spark):
    rng = np.random.default_rng(4)
    rows, want, k = [], {0.1: [], 0.9: []}, 0
    for changed in (4, 6, 8, 9, 11, 12, 13, 16, 20):  # of 400 words; Jaccard indices on both sides of 0.8
        for _ in range(8):
            words = [f"w{j}" for j in rng.integers(0, 5000, 400)]
            other = list(words)
            for at in rng.permutation(400)[:changed]:
                other[at] = f"x{k}"
            a, b = ({tuple(w[i : i + 5]) for i in range(396)} for w in (words, other))
            rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
            want[0.9 if len(a & b) >= 0.8 * len(a | b) else 0.1].append(k)
            k += 2
    rows.append((k, rows[0][1]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.STAGE).collect()}
    assert len(want[0.1]) > 15 and len(want[0.9]) > 15
    assert all(got[j + 1] == j + 1 for j in want[0.1])
    assert sum(got[j + 1] != j for j in want[0.9]) <= 2 and got[k] == 0


@pytest.mark.parametrize("size", [5, 40, 200])
def test_cells_link_what_all_agreed_pairs_link(size):
    rng = np.random.default_rng(size)
    words = np.unique(rng.integers(0, 2**10, (size, 1), np.uint64), axis=0)
    agreed = lambda a, b: (a + b) % 3 == 0  # noqa: E731  b: a number or an array
    links = simhash.cell_links(np.zeros(len(words), np.int64), words, 4, agreed)
    assert all(agreed(a, b) for a, b in links)

    def groups(pairs):
        forest = simhash._Forest(len(words))
        for a, b in pairs:
            forest.join(a, b)
        return [forest.root(a) for a in range(len(words))]

    assert groups(links) == groups((a, b) for a in range(len(words)) for b in range(a) if agreed(a, b) and bin(int(words[a, 0] ^ words[b, 0])).count("1") <= 4)
