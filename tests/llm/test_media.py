import hashlib
import zlib

import numpy as np

from waymark.llm import media


def payload(text):
    body = (text or "").encode()
    return body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")


def check(rows, texts):
    assert len(rows) == len(texts)
    want = sorted((len((t or "").encode()), len(payload(t)), hashlib.sha256(payload(t)).hexdigest(), zlib.crc32(payload(t)[-64:]), hashlib.sha256(media.to_wav(payload(t))).hexdigest()) for t in texts)
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in rows) == want


def test_query(spark, sf_dir, texts):
    rows = media.op7_media(spark, sf_dir).collect()
    check(rows, texts.values())
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r.doc_id], set()).add((r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_rows(odd, none):
    check(media.read(media.encode(odd)).collect(), [r.text for r in odd.collect()])
    assert media.read(media.encode(none)).count() == 0


def test_fingerprint_finds_a_tone_and_its_time():
    t = np.arange(8192)
    tone = np.where(t < 4096, 128, 128 + 100 * np.sin(2 * np.pi * 100 * t / media.FRAME)).astype(np.uint8)
    times, codes = media.fingerprint(tone)
    assert len(times) and (codes >> 12 == 100).any() and times.min() >= 5
    assert (np.diff(times) >= 0).all()
    again = media.fingerprint(tone.copy())
    assert (again[0] == times).all() and (again[1] == codes).all()


def test_blocks_do_not_change_peaks():
    x = np.random.default_rng(1).integers(0, 256, media.HOP * 2100 + media.FRAME, np.uint8)
    found = media.peaks(x)
    at = 1500
    one = media.peaks(x[at * media.HOP : at * media.HOP + media.FRAME])
    assert (found[at] == one[0]).all() and len(found) == 2101


def test_short_and_tail_different_texts_differ():
    def feature(text):
        times, codes = media.fingerprint(np.frombuffer(payload(text), np.uint8))
        return tuple(times), tuple(codes)

    words = [f"{a} {b} {c}." for a in ("The river", "An old mill", "Nobody") for b in ("stood by", "knew", "walked along") for c in ("the bank", "a village every morning", "it")]
    found = [feature(t) for t in words]
    assert all(codes for _, codes in found) and len(set(found)) >= len(words) - 1  # peaks, not a hash
    body = " ".join(words)
    for n in range(700, 1200, 37):  # the last 40 characters differ, at every place of the last frame
        assert feature(body[:n] + "q" * 40) != feature(body[:n] + words[2].ljust(40)[:40])
    assert feature("")[1] == ()
