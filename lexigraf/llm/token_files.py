"""Token ids in binary shard files with a shared zstandard dictionary.

Documents are dealt by ranges of their id and sorted, so shard files in name order hold
them in ascending order.  A task encodes its range and writes one file:

    bytes 0-7     b"LXTOK001"
    bytes 8-39    SHA-256 of the dictionary (zeros if there is none)
    bytes 40-47   width of an id in bytes (2 or 4), then zeros
    frames        one zstandard frame per document: its ids, little endian, the end id last
    index         per document: id (int64), a null mark (int64), offset of its frame (int64), number of ids (int64)
    last 16       offset of the index, number of documents (int64 each)

The dictionary is a file beside the shards, trained on the serialized ids of a bounded
sample of about ``SAMPLE`` documents.  A document is read with one look at the index and
one frame.  Files are written under another name and then renamed, so a task that runs
again after an executor was lost leaves one whole file.  Paths go through Arrow's file
systems, so the folder may be any that Arrow and Spark both reach.

Encoding splits a text only where a byte-level tokenizer does, at a single space between
two other characters, and keeps the ids of each word in a bounded cache; that gives the
ids of the whole text (`tests/llm/test_token_files.py` compares them).  A new word is cut
again where such a tokenizer certainly cuts (between Latin letters, digits, marks other
than apostrophes, and single line ends), so that only new pieces are encoded, those of many
texts at once; a word with any other character is encoded as it is.  Texts with other
runs of spaces, or with one of the tokenizer's special strings, are encoded whole, and so
is every text where the tokenizer is not of that kind.

Nulls count as empty texts, which are the end id alone.  Repeated rows are written each.
A null id comes first.  An empty table gives no files and an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, pieces, prepare, store, table, texts_of, width

MAGIC, HEAD, SAMPLE, DICTIONARY, LEVEL, CACHED, PIECE, FRAMES_HELD = b"LXTOK001", 48, 1000, 65536, 3, 1_000_000, 1 << 18, 1 << 22
#: Runs that byte-level tokenizers keep apart: Latin letters, digits, ASCII marks without the apostrophe, one line end.
SURE = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|(?<=\S)\n(?=\S)")


class Encoder:
    """Texts to serialized ids, the end id last, ``width`` little-endian bytes each."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 65536 and end_id < 65536 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end_id], self.kind).tobytes()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values())) if added else None
        kind = self.tokenizer.pre_tokenizer
        self.by_words = self.tokenizer.normalizer is None and type(kind).__name__ == "ByteLevel" and kind.use_regex and not kind.add_prefix_space
        self.cache: dict[str, bytes | bool] = {}  # of words after a space; False where more white space may join one
        self.bare: dict[str, bytes] = {}  # of pieces inside words
        self.opens = np.zeros(size, bool)  # ids that begin with a space
        if self.by_words:
            space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
            for token, i in self.tokenizer.get_vocab().items():
                self.opens[i] = token.startswith(space)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _spaced(self, words: list[str]) -> None:
        """Learn words of letters, or of one other kind of character, all at once."""
        if not words:
            return
        ids = self.ids(" " + " ".join(words))
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) == len(words):
            raw, ends = ids.tobytes(), np.append(cuts[1:], len(ids)) * self.width
            self.cache.update(zip(words, map(raw.__getitem__, map(slice, (cuts * self.width).tolist(), ends.tolist())), strict=True))
        else:
            for w in words:
                self.cache[w] = self.ids(" " + w).tobytes()

    def _inside(self, part: str) -> bytes:
        got = self.bare.get(part)
        if got is None:
            if len(self.bare) >= CACHED // 4:
                self.bare.clear()
            got = self.bare[part] = self.ids(part).tobytes()
        return got

    def learn(self, words: list[str]) -> None:
        """Put the ids of each word after a space into the cache."""
        cache, plain, cut = self.cache, [], []
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif not w or w[0].isspace() or w[-1].isspace():
                cache[w] = False
            else:
                parts = SURE.findall(w)
                if sum(map(len, parts)) != len(w):
                    cache[w] = self.ids(" " + w).tobytes()
                else:
                    cut.append((w, parts))
        heads = {p[0] for _, p in cut} - set(plain)
        self._spaced(plain + [h for h in heads if h not in cache])
        inside = self._inside
        for w, parts in cut:
            cache[w] = b"".join((cache[parts[0]], *map(inside, parts[1:])))

    def many(self, texts: list[str]) -> list[bytes]:
        """The serialized ids of each text; what is new in all of them is learnt at once."""
        out: list = [None] * len(texts)
        split, new = [], {}
        if len(self.cache) > CACHED:
            self.cache = dict(itertools.islice(self.cache.items(), CACHED // 2))  # those met first are the frequent ones
        for i, text in enumerate(texts):
            words = text.split(" ")
            first = words.pop(0)
            if not self.by_words or not first or first[-1].isspace() or (self.special is not None and self.special.search(text)):
                out[i] = self.ids(text).tobytes() + self.end
                continue
            parts = list(map(self.cache.get, words))
            places = [k for k, p in enumerate(parts) if p is None]
            for k in places:
                new[words[k]] = None
            split.append((i, self.ids(first).tobytes(), words, parts, places))
        if new:
            self.learn(list(new))
        for i, first, words, parts, places in split:
            for k in places:
                parts[k] = self.cache[words[k]]
            try:
                out[i] = b"".join((first, *parts, self.end))
            except TypeError:  # white space that may join a word
                out[i] = self.ids(texts[i]).tobytes() + self.end
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def widen(ids: bytes, wide: int) -> bytes:
    return ids if wide == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def write_shard(fs: pafs.FileSystem, path: str, docs, end_id: int, tokenizer: str, dictionary: bytes) -> tuple[int, int]:
    """Write lists of ids and of their texts; gives the numbers of documents and ids."""
    enc = encoder(tokenizer, end_id)
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=False)
    index, at, total = [], HEAD, 0
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(draft) as out:
        out.write(MAGIC + (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)) + enc.width.to_bytes(8, "little"))
        for keys, texts in docs:
            for key, ids in zip(keys, enc.many(texts), strict=True):
                frame = press.compress(ids)
                out.write(frame)
                index.append((key or 0, int(key is None), at, len(ids) // enc.width))
                at += len(frame)
                total += len(ids) // enc.width
        out.write(np.array(index, "<i8").reshape(-1, 4).tobytes())
        out.write(np.array([at, len(index)], "<i8").tobytes())
    fs.move(draft, path)
    return len(index), total


def read_shard(fs: pafs.FileSystem, path: str, dictionary: bytes):
    """(id, ids as little-endian unsigned 32-bit integers) of each document, in the order written."""
    with fs.open_input_file(path) as f:
        size = f.size()
        tail, count = np.frombuffer(f.read_at(16, size - 16), "<i8")
        head = f.read_at(HEAD, 0)
        check_head(head, dictionary)
        wide = int.from_bytes(head[40:48], "little")
        index = np.frombuffer(f.read_at(32 * count, tail), "<i8").reshape(-1, 4)
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        ends = np.append(index[1:, 2], tail)
        i = 0
        while i < count:  # some frames at a time
            j = max(i + 1, int(np.searchsorted(ends, index[i, 2] + FRAMES_HELD)))
            j = min(j, int(count))
            held = f.read_at(int(ends[j - 1] - index[i, 2]), int(index[i, 2]))
            for k in range(i, j):
                frame = held[index[k, 2] - index[i, 2] : ends[k] - index[i, 2]]
                yield None if index[k, 1] else int(index[k, 0]), widen(unpress.decompress(frame), wide)
            i = j


def read_document(fs: pafs.FileSystem, path: str, dictionary: bytes, place: int) -> bytes:
    """The ids of the document at ``place`` in a shard file: two reads of the index and one frame."""
    with fs.open_input_file(path) as f:
        size = f.size()
        tail, count = np.frombuffer(f.read_at(16, size - 16), "<i8")
        head = f.read_at(HEAD, 0)
        check_head(head, dictionary)
        rows = np.frombuffer(f.read_at(64 if place + 1 < count else 32, tail + 32 * place), "<i8").reshape(-1, 4)
        end = rows[1, 2] if len(rows) > 1 else tail
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        return widen(unpress.decompress(f.read_at(int(end - rows[0, 2]), int(rows[0, 2]))), int.from_bytes(head[40:48], "little"))


def check_head(head: bytes, dictionary: bytes) -> None:
    if head[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    if head[8:40] != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
        raise ValueError("the shard was written with another dictionary")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, sample: int = SAMPLE) -> bytes:
    """A zstandard dictionary from the ids of about ``sample`` documents, by a hash of id and text."""
    count = docs.count()
    span = 1 << 30
    rows = docs.filter(F.pmod(F.xxhash64(F.lit(3), id_col, text_col), F.lit(span)) < math.ceil(span * min(1.0, sample / max(1, count)))).select(id_col, F.coalesce(text_col, F.lit(""))).collect()
    enc = encoder(tokenizer, end_id)
    ids = enc.many([r[1] for r in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))])
    try:
        return zstandard.train_dictionary(DICTIONARY, ids, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples to train on
        return b""


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shard files into ``folder``; one row per file: path, n_docs, n_ids, start."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    fs, at = place(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary.zstd") as f:
        f.write(dictionary)
    held = spark.sparkContext.broadcast(dictionary)  # DICTIONARY bytes

    def run(batches):
        from pyspark import TaskContext

        fs, at = place(folder)

        def rows():
            for batch in batches:
                texts = texts_of(batch.column(1))
                for a, b in pieces(texts, PIECE):
                    yield batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()

        docs = rows()
        first = next(docs, None)
        if first is None:
            return
        name = f"shard-{TaskContext.get().partitionId():06d}.bin"

        def again():
            yield first
            yield from docs

        n, ids = write_shard(fs, f"{at}/{name}", again(), end_id, tokenizer, held.value)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([ids], pa.int64())], ["path", "n_docs", "n_ids"])

    dealt = docs.repartitionByRange(width(spark), F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(id_col, F.xxhash64(text_col))
    files = store(dealt.mapInArrow(run, "path string, n_docs long, n_ids long"), "files")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    fs, at = place(folder)
    with fs.open_input_file(f"{at}/dictionary.zstd") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches):
        fs, at = place(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, starts, counts, sums = [], [], [], []
                for key, ids in read_shard(fs, f"{at}/{path}", held.value):
                    keys.append(key)
                    starts.append(start)
                    counts.append(len(ids) // 4)
                    sums.append(zlib.crc32(ids))
                    start += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, counts, sums)], [id_col, "start", "n_tokens", "ids_crc32"])

    return files.select("path", "start").repartition(width(spark)).mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    prepare(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = new_path(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer, folder), folder)
