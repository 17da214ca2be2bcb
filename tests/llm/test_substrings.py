from waymark.llm import substrings as S

PASSAGE = "The committee met on the first Monday of the month. Nobody could remember who had called the meeting at all. They spoke for an hour about the bridge and the toll. In the end the chair closed the session without a vote. Everyone went home in the rain."


def test_units_cover_the_text():
    text = "Short line.\n\nA long line with many words in it that goes on for a while. Then a second sentence follows here! No end"
    for start, end, words in S.units(text):
        assert S._WORD.findall(text[start:end].lower()) == words
    assert [text[a:b] for a, b, _ in S.units(text)][0] == "Short line."


def test_repeated_passages_are_found_wherever_they_stand(spark):
    rows = [(1, "Intro of the first document that is long enough to be cut here. " + PASSAGE + " Some more words."), (2, "Different beginning of another text altogether, indeed. Well now " + PASSAGE + " And a different end"),
            (3, "A clean text that shares nothing with the others, apart from small words. It ends here."), (4, PASSAGE + "\n" + PASSAGE)]
    got = {}
    for r in S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(dict(rows)[r.doc_id][r.start : r.end])
    assert set(got) == {2, 4} and "Nobody could remember" in got[2][0]
    out = {r.doc_id: r for r in S.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1] and "They spoke for an hour" not in out[2].text and out[2].text.startswith("Different beginning")
    for d, text in rows:
        cut = sum(r["end"] - r["start"] for r in out[d].removed)
        assert len(out[d].text) == len(text) - cut


def brute(rows, min_words=0):
    """Places of every removed unit, joined to passages, by the definition."""
    first, every = {}, []
    for row, (doc, text) in enumerate(rows):
        seq = 0
        for start, end, words in S.units(text or ""):
            if len(words) >= min_words:
                key, rank = " ".join(words), (doc is not None, doc or 0, row, seq)
                every.append((key, rank, row, doc, seq, start, end, len(words)))
                first[key] = min(first.get(key, rank), rank)
                seq += 1
    out = []
    for key, rank, row, doc, seq, start, end, n in every:
        if first[key] != rank:
            if out and out[-1][0] == row and out[-1][1] == seq - 1:
                out[-1] = (row, seq, doc, out[-1][3], end, out[-1][5] + n, out[-1][6] + 1)
            else:
                out.append((row, seq, doc, start, end, n, 1))
    return sorted((doc is not None, doc or 0, start, end, n, k) for _, _, doc, start, end, n, k in out)


def test_passages_against_brute_force(spark, docs, odd):
    for df, least in ((docs, 0), (docs, 5), (odd, 0)):
        rows = [(r.doc_id, r.text) for r in df.coalesce(1).select("doc_id", "text").collect()]
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.end, r.words, r.units) for r in S.passages(df.coalesce(1), least).collect())
        assert got == brute(rows, least) and got


def test_text_shared_inside_a_run_on_line_is_found(spark):
    inner = " ".join(f"shared{k * 7919 % 997}" for k in range(60))
    rows = [(k, " ".join(f"own{k}x{j}" for j in range(45 + 13 * k)) + " " + inner + " " + " ".join(f"end{k}y{j}" for j in range(30))) for k in range(4)]
    got = {r.doc_id: r for r in S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3}
    for d, r in got.items():
        at = rows[d][1].index(inner)
        assert r.words >= 25 and at <= r.start + len("shared000") and r.end <= at + len(inner)


def test_first_by_id_stays_in_any_order(spark):
    rows = [(9, PASSAGE), (3, PASSAGE), (5, PASSAGE), (3, PASSAGE)]
    got = sorted(r.doc_id for r in S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [3, 5, 9]


def test_query_against_shingles(spark, sf_dir, texts):
    flagged = {r.doc_id for r in S.op5_substring_dedup(spark, sf_dir).collect() if r.n_long}
    seen, want = {}, set()
    for d in sorted(texts):
        words = S._WORD.findall(texts[d].lower())
        for i in range(len(words) - 59):
            key = tuple(words[i : i + 60])
            if seen.setdefault(key, d) != d and len(set(key)) > 20:
                want.add(d)
    assert len(want - flagged) <= 0.02 * len(want) and want


def test_odd_rows(odd, none):
    assert {r.doc_id for r in S.passages(odd).collect()} == {4, 6, 7}  # 4 says the same words over and over
    out = S.remove(odd)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns)
    assert S.passages(none).count() == 0 and S.remove(none).count() == 0


def test_a_single_repeated_unit_is_removed(spark):
    line = "Everyone went home in the rain."
    rows = [(1, "The first text.\n" + line), (2, line + "\nAnother beginning of the second."), (3, line), (4, "In the rain.\nIn the rain.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.first_doc_id) for r in S.passages(df, min_words=4).collect())
    assert got == [(2, 0, len(line), 1), (3, 0, len(line), 1)]
    assert sorted((r.doc_id, r.start) for r in S.passages(df).collect()) == [(2, 0), (3, 0), (4, 13)]  # no least size unless one is asked for
    assert {r.doc_id: r.text for r in S.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[3] == ""
