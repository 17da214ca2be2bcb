"""Token ids as files: every document a zstandard frame under one shared dictionary, with an offset index.

File format (little-endian): magic `WMTOK001`, the SHA-256 of the dictionary (32 bytes of zeros without one), one byte for
the width of an id (2 or 4), then the frames one after the other, then the index (one record of INDEX for each document, in
file order), then a trailer: documents (u64), place of the index (u64), magic. A short document is read by its index record
and one range of bytes. The dictionary lies beside the files as `dictionary`.

Nulls: a null text is empty; rows without doc_id come first. Rows that repeat a doc_id stay, in order of their ids' crc32 (ties: rows with
equal ids, in any order). A long text is one frame; texts go to the tokenizer whole. An empty table gives no file and no row.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, open_folder, slices, table_path

MAGIC = b"WMTOK001"
TRAILER = struct.Struct("<QQ8s")
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("start", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
#: A file is closed once its frames hold so many bytes.
FILE_BYTES = 32 << 20
#: The dictionary is trained on the documents with the smallest hashes of doc_id and text, on so many characters of each from a place that
#: the hash gives. What it is trained on changes the size of the files, never the ids in them.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 4000, 8192, 112_640
#: Bytes of files that one task of read_corpus reads, about.
READ_BYTES = 128 << 20
#: Words kept with their ids in each Python worker, first come; frequent words come early.
WORDS_KEPT = 900_000
END_ID = 1
#: Bytes of text that are encoded at a time, about.
ENCODED_BYTES = 4 << 20

#: Text of these characters alone is cut into words here, as the tokenizer's own normalizer and pattern would cut it.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ſ]+|[0-9]|[^\\s0-9a-zß-öø-įı-ſ]+")


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _word_ends(path: str) -> np.ndarray:
    """For every id whether its token ends a word; all False for a tokenizer that marks no ends."""
    tokenizer = _tokenizer(path)
    suffix, vocabulary = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix"), tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
    return ends


class WordEncoder:
    """Ids of texts as little-endian u32 bytes. Chunks between blanks are numbered by Arrow and looked up once for a call, their ids dealt out by
    those numbers; words that are new in them go to the tokenizer together."""

    def __init__(self, path: str, kept: int | None = None):
        self.tokenizer, self.ends, self.ids, self.kept = _tokenizer(path), _word_ends(path), {}, WORDS_KEPT if kept is None else kept

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word. Words go to the tokenizer as lines of many, cut where its tokens end words; a line that has not as many ends is encoded word by word."""
        lines = [words[at : at + 512] for at in range(0, len(words), 512)]
        for at in range(0, len(lines), 16):
            some = lines[at : at + 16]
            for line, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                last = np.flatnonzero(self.ends[ids]) + 1
                if len(last) == len(line) and last[-1] == len(ids):
                    body, last = ids.tobytes(), (last * 4).tolist()
                    yield from (body[i:j] for i, j in zip([0, *last], last))
                else:
                    yield from (self._encoded(w).tobytes() for w in line)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of some different chunks; new words and chunks are kept as long as there is room."""
        found = list(map(self.ids.get, chunks))
        new = [k for k, x in enumerate(found) if x is None]
        parts = [_WORD.findall(chunks[k]) for k in new]
        words = list({w for p in parts for w in p}.difference(self.ids))
        fresh = dict(zip(words, self._words(words)))
        known = lambda w: fresh[w] if w in fresh else self.ids[w]
        for k, p in zip(new, parts):
            found[k] = known(p[0]) if len(p) == 1 else b"".join(map(known, p))
        room = max(0, self.kept - len(self.ids))
        self.ids.update(islice(fresh.items(), room))
        room = max(0, self.kept - len(self.ids))
        self.ids.update(islice(((chunks[k], found[k]) for k, p in zip(new, parts) if len(p) != 1), room))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if "<|" not in t and _PLAIN.fullmatch(t)]
        cut = pa.compute.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
        numbered = cut.values.dictionary_encode()
        codes = numbered.indices.to_numpy()
        found = self._chunks(numbered.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        size = sizes[codes]
        ends = np.cumsum(size)
        # place of every id among those of the different chunks: its chunk's own place, and onwards from there (32 bits do, as a call has under 2 GB of text)
        place = np.repeat(((np.cumsum(sizes) - sizes)[codes] - (ends - size)).astype("<i4"), size)
        place += np.arange(len(place), dtype="<i4")
        ids = np.frombuffer(b"".join(found), "<u4")[place]
        bounds = np.append(0, ends)[cut.offsets.to_numpy()].tolist()
        out = [b""] * len(texts)
        for i, start, end in zip(plain, bounds, bounds[1:]):
            out[i] = ids[start:end].tobytes()
        for i in set(range(len(texts))).difference(plain):
            out[i] = self._encoded(texts[i]).tobytes()
        return out


@lru_cache(1)
def _encoder(path: str, kept: int) -> WordEncoder:
    return WordEncoder(path, kept)


def _id_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, kept: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    pa.default_memory_pool().release_unused()  # a worker may have served other operators before
    end, encoder = struct.pack("<I", end_id), _encoder(tokenizer, kept)
    for batch in slices(batches, "text", ENCODED_BYTES):
        yield batch.column("doc_id"), [x + end for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]


def _raw_batches(batches, tokenizer, end_id, kept):
    for ids, bodies in _id_batches(batches, tokenizer, end_id, kept):
        yield pa.RecordBatch.from_arrays([ids, pa.array(bodies, pa.binary())], ["doc_id", "ids"])


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, ids (little-endian u32, end_id appended)."""
    return docs.select("doc_id", "text").mapInArrow(partial(_raw_batches, tokenizer=tokenizer, end_id=end_id, kept=kept), "doc_id long, ids binary")


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end_id: int = END_ID, kept: int = WORDS_KEPT) -> bytes:
    """A zstandard dictionary for serialized ids; empty for an empty corpus, plain content for one too small to train on."""
    n = docs.count()
    if not n:
        return b""
    share = min(1.0, 2 * SAMPLE_DOCS / n + 1e-6)  # a first cut, so that few rows are compared
    text = F.coalesce("text", F.lit(""))
    some = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h")).filter(F.col("h") < int(share * (1 << 40)))
    from_ = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    some = some.select("doc_id", F.substring("text", from_, F.lit(SAMPLE_CHARS)).alias("text"), "h").orderBy("h", "doc_id", "text").limit(SAMPLE_DOCS)
    parts = some.repartition(8)  # bounded: SAMPLE_DOCS x SAMPLE_CHARS
    sample = sorted(_narrow(bytes(row.ids), width) for row in token_ids(parts, tokenizer, end_id, kept).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


def _frame_batches(batches, tokenizer, end_id, kept, dictionary, width):
    pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for ids, bodies in _id_batches(batches, tokenizer, end_id, kept):
        frames = [pack.compress(_narrow(x, width)) for x in bodies]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([len(x) // 4 for x in bodies], pa.int64()), pa.array(list(map(zlib.crc32, bodies)), pa.int64()), pa.array(frames, pa.binary())],
            ["doc_id", "n_tokens", "crc", "frame"])


def _write_batches(batches, folder, digest, width):
    """Write this partition's frames, in order, as files; a row for each. Names are new for each attempt of a task."""
    system, root = open_folder(folder)
    task = TaskContext.get()
    part, seq, frames, index, at = task.partitionId(), 0, [], [], 0

    def close():
        nonlocal seq, frames, index, at
        name = f"part-{part:06d}-{seq:04d}-{task.taskAttemptId()}.wmtok"
        head = MAGIC + digest + bytes([width])
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(head)
            for x in frames:
                out.write(x)
            table = np.array(index, INDEX)
            table["start"] += len(head)
            out.write(table.tobytes())
            out.write(TRAILER.pack(len(index), len(head) + at, MAGIC))
        row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "docs": len(index), "tokens": int(table["n_tokens"].sum(dtype=np.int64)), "bytes": at}])
        seq, frames, index, at = seq + 1, [], [], 0
        return row

    for batch in batches:
        for doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
            index.append((doc_id or 0, doc_id is not None, at, len(frame), n))
            frames.append(frame)
            at += len(frame)
            if at >= FILE_BYTES:
                yield close()
    if index:
        yield close()


def write_corpus(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int = 49_408, end_id: int = END_ID, kept: int = WORDS_KEPT) -> DataFrame:
    """Write docs (doc_id, text) as token files in ascending order of doc_id; the manifest: part, seq, file, docs, tokens, bytes, start, number.

    The manifest has one row for a file, so the running total over it is made in one task.
    """
    spark, width = docs.sparkSession, 2 if vocabulary <= 65_536 else 4
    dictionary = train_dictionary(docs, tokenizer, width, end_id, kept)
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    frames = docs.select("doc_id", "text").mapInArrow(partial(_frame_batches, tokenizer=tokenizer, end_id=end_id, kept=kept, dictionary=dictionary, width=width), "doc_id long, n_tokens long, crc long, frame binary")
    frames = materialize(frames, "token-frames", "none").withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "crc", "row"]
    dealt = frames.repartitionByRange(*order).sortWithinPartitions(*order)
    files = dealt.mapInArrow(partial(_write_batches, folder=folder, digest=digest, width=width), "part long, seq long, file string, docs long, tokens long, bytes long")
    files = materialize(files, "token-manifest")
    before = F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("number", F.row_number().over(Window.orderBy("part", "seq")))


@lru_cache(1)
def _dictionary(folder: str, digest: bytes, size: int, changed: int) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of a folder's files, read once by each worker for files of the same digest while it has this size and time."""
    system, root = open_folder(folder)
    with system.open_input_stream(f"{root}/dictionary") as f:
        dictionary = f.read()
    if digest != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
        raise ValueError(f"the files of {folder} were written with another dictionary")
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class TokenFile:
    """One file, for access to single documents."""

    def __init__(self, folder: str, name: str):
        system, root = open_folder(folder)
        self.file = system.open_input_file(f"{root}/{name}")
        size = self.file.size()
        n, place, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is no token file")
        self.width = head[-1]
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, place), INDEX)
        state = system.get_file_info(f"{root}/dictionary")
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(folder, bytes(head[len(MAGIC) : -1]), state.size, state.mtime_ns))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, as u32."""
        row = self.index[k]
        return np.frombuffer(self._unpack.decompress(self.file.read_at(int(row["size"]), int(row["start"]))), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of that id."""
        return [self.ids(int(k)) for k in np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["has_id"] == 1))]


def _read_batches(batches, folder):
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            file = TokenFile(folder, name)
            for at in range(0, len(file.index), 4096):
                part = file.index[at : at + 4096]
                crc = [zlib.crc32(file.ids(at + k)) for k in range(len(part))]
                n = part["n_tokens"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], mask=part["has_id"] == 0), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                start += int(n.sum())


def read_corpus(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files."""
    size = manifest.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
    tasks = max(1, min(size.files, max(-(-(size.bytes or 0) // READ_BYTES), manifest.sparkSession.sparkContext.defaultParallelism * 4)))
    files = manifest.select("file", "start", F.pmod("number", F.lit(tasks)).cast("int").alias("task")).repartitionById(tasks, "task")
    return files.select("file", "start").mapInArrow(partial(_read_batches, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, kept: int = WORDS_KEPT) -> DataFrame:
    """Write docs as token files of the public 49k-word tokenizer in the shared folder and read them back. kept: words that each Python
    worker keeps; fewer take less memory and more time."""
    import public_tokenizers

    folder = table_path(docs.sparkSession, "tokens")
    return read_corpus(write_corpus(docs, folder, str(public_tokenizers.path("word_bpe_49k.json")), kept=kept), folder)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the whole documents table, from the files."""
    return round_trip(documents(spark, sf_dir))
