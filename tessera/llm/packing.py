"""Packing by concatenate-and-cut: two-pass prefix sums over partition token totals, then fixed windows.

Pass 1 tokenises each document once, ends it with END_ID and writes the ids with the partition's number and the tokens before it in that
partition. The per-partition totals (one row a partition) become partition offsets; pass 2 adds them, so every document
knows its global offset, and cuts it at the window borders. A document over a border gives one record on either side.

The tokeniser splits at white space before it merges, so the ids of a text are those of its words in a row. Words that come
often are kept in a table of at most CACHE_WORDS words, the more often the fuller the table is; others are tokenised anew.

Null text counts as empty: one token. Repeated rows are packed each. No rows give no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table

END_ID = 1
LENGTH = 2048
CACHE_WORDS = 250_000
SEEN_BITS = 22
#: Partition offsets that are broadcast; more are joined by a shuffle.
OFFSET_ROWS = 500_000
MARK = "\x1f"
#: Characters whose words are looked up together.
CHUNK_CHARS = 500_000

_words: dict[str, tuple[dict[str, bytes], bytearray]] = {}
_tokenizers: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """ids of texts as little-endian bytes, word by word. Words seen often enough are kept; a table of counts by hash remembers how often."""

    def __init__(self, path: str):
        if path not in _tokenizers:
            from tokenizers import Tokenizer

            _tokenizers[path] = Tokenizer.from_file(path)
            _tokenizers[path].encode_special_tokens = False
        self.model = _tokenizers[path]
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.known, self.seen = _words.setdefault(path, ({"": b""}, bytearray(1 << SEEN_BITS)))
        mark = self.model.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        known, seen, mask = self.known, self.seen, (1 << SEEN_BITS) - 1
        new = list(set().union(*words).difference(known))
        full = len(known) / CACHE_WORDS
        need = 1 if full < 0.5 else 3 if full < 0.75 else 7 if full < 1 else 256  # times seen before
        known.update(zip(new, self.encoded(new), strict=True))
        out = [b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            at = hash(w) & mask
            if seen[at] < need:
                del known[w]
            seen[at] = min(255, seen[at] + 1)
        return out

    def encoded(self, words: list[str]) -> list[bytes]:
        """Each word's ids; many words are encoded as one text, with a mark between them that is a token of its own."""
        if self.mark is None or any(MARK in w for w in words):
            return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        parts = [words[i : i + 500] for i in range(0, len(words), 500)]
        out, size = [], self.dtype.itemsize
        for e in self.model.encode_batch_fast([f" {MARK} ".join(p) for p in parts], add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            raw, start = ids.tobytes(), 0
            for at in (np.nonzero(ids == self.mark)[0] * size).tolist():
                out.append(raw[start:at])
                start = at + size
            out.append(raw[start:])
        return out


def chunks(texts: list[str], most: int = CHUNK_CHARS):
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, before (tokens before it in its partition), n_tokens, ids (bytes)."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, part, before = WordIds(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], ids_of.dtype).tobytes()
        for b in batches:
            at = 0
            for texts in chunks([t or "" for t in b.column(1).to_pylist()]):
                ids = [x + end for x in ids_of(texts)]
                n = np.array([len(x) // ids_of.dtype.itemsize for x in ids], "int64")
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), pa.array(np.full(len(ids), part, "int32")), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n_tokens", "ids"])
                before, at = int(ends[-1]), at + len(ids)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids binary")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (array of int)."""
    path = path or tokenizer_path()
    ids = materialise(tokenised(docs.withColumn("doc_id", F.col("doc_id").cast("long")), path, end_id), "pack-ids")
    totals = materialise(ids.groupBy("part").agg(F.sum("n_tokens").alias("total")), "pack-totals")
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(running), F.lit(0)).alias("part_offset"))
    if totals.count() <= OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    placed = ids.join(offsets, "part").select("doc_id", (F.col("part_offset") + F.col("before")).alias("at"), "n_tokens", "ids")

    def cut(batches):
        width = WordIds(path).dtype
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, at, n, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, width).astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = ids[start : start + size]
                    for c, v in zip(out, (doc_id, start, size, zlib.crc32(piece.tobytes()), n, seq, offset, piece.astype("int32")), strict=True):
                        c.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.list_(pa.int32()))], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return placed.mapInArrow(cut, ", ".join(f"{n} long" for n in names[:7]) + ", ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
