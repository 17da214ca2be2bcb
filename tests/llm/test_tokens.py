import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waymark.llm import tokens
from waymark.llm.common import table_path

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = tokens.WordEncoder(PATH)


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids, "<u4")


def expected(rows):
    """doc_id, start, n, crc in ascending order."""
    coded = [(d, np.append(ids_of(t), 1).astype("<u4")) for d, t in rows]
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1])))
    out, start = [], 0
    for d, ids in coded:
        out.append((d, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return sorted(out, key=str)


def test_query_round_trip(spark, sf_dir, texts):
    assert sorted(map(tuple, tokens.op4_token_files(spark, sf_dir).collect()), key=str) == expected(texts.items())


def test_odd_rows(odd, none):
    assert sorted(map(tuple, tokens.round_trip(odd).collect()), key=str) == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert tokens.round_trip(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("ab'std \t\n.0129é İſ<|>́😀")), max_size=60))
def test_words_are_encoded_as_the_tokenizer_does(text):
    assert ENCODER.encode([text])[0] == ids_of(text).tobytes()


def test_special_strings_and_small_caches(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 3)
    small = tokens.WordEncoder(PATH)
    for text in ("it's a b c d e f's", "<|endoftext|> x", "don't stop-me now", "it's a"):
        assert small.encode([text, text])[1] == ids_of(text).tobytes()
    assert len(small.ids) <= 3


class Counted:
    """The tokenizer, with the number of texts that it was given in batches."""

    def __init__(self):
        self.texts = 0

    def encode(self, *a, **b):
        return TOKENIZER.encode(*a, **b)

    def encode_batch_fast(self, texts, **b):
        self.texts += len(texts)
        return TOKENIZER.encode_batch_fast(texts, **b)


def test_new_words_go_to_the_tokenizer_as_lines():
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}é, it's" for k in range(5000))
    encoder, marked = tokens.WordEncoder(PATH), Counted()
    encoder.tokenizer = marked
    assert encoder.encode([text, "", text]) == [ids_of(text).tobytes(), b"", ids_of(text).tobytes()]
    assert 0 < marked.texts < 20
    plain = tokens.WordEncoder(PATH)
    plain.ends = np.zeros_like(plain.ends)  # a tokenizer that marks no ends of words: each word alone
    assert plain.encode([text])[0] == ids_of(text).tobytes()


def test_single_documents_and_files(spark, docs, texts, monkeypatch):
    folder = table_path(spark, "tokens")
    manifest = tokens.write_corpus(docs, folder, PATH).collect()
    assert sum(r.docs for r in manifest) == len(texts)
    found = [ids for r in manifest for ids in tokens.TokenFile(folder, r.file).find(7)]
    assert len(found) == 1 and found[0].tolist() == [*ids_of(texts[7]).tolist(), 1]
    with pytest.raises(ValueError):
        with open(folder.removeprefix("file://") + "/dictionary", "ab") as f:
            f.write(b"changed")
        tokens.TokenFile(folder, manifest[0].file)
