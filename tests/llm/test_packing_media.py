import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import media, packing

DOCS = "doc_id long, text string, ids string, part int"  # names that the operators use themselves


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], DOCS).repartition(3)


def test_words_give_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", "Hello, World's\n end", " it's 3.5ml  ", "éÉ é ŒÆ x　y", "a\x1fb \x1f c", "<|endoftext|> x<|startoftext|>", "중국 日本語 🙂🙂 \t tab", "x" * 5000]
    for _ in range(3):  # new words, words seen, words kept
        got = packing.WordIds(packing.tokenizer_path())(texts)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


def test_pieces_cover_all_tokens(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["one two three", None, "", "word " * 3000, "one two three", "x y z"]
    want = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack(docs(spark, texts), length=64).orderBy("sequence_id", "offset").collect()
    at, got = 0, {}
    for r in rows:
        assert r.sequence_id * 64 + r.offset == at and 0 < r.length <= 64 - r.offset
        assert r.start == len(got.get(r.doc_id, [])) and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got.setdefault(r.doc_id, []).extend(r.ids)
        at += r.length
    assert got == want


def test_long_texts_and_offsets_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(packing, "OFFSET_ROWS", 0)
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(40_000))
    rows = packing.pack(docs(spark, ["a b", long, "c", long])).orderBy("sequence_id", "offset").collect()
    at, tokens = 0, {}
    for r in rows:
        assert r.sequence_id * 2048 + r.offset == at and r.length == len(r.ids)
        tokens.setdefault(r.doc_id, []).extend(r.ids)
        at += r.length
    assert tokens[1] == tokens[3]
    assert sum(r.length == 2048 for r in rows) > 40 and {r.doc_id: len(tokens[r.doc_id]) for r in rows} == {r.doc_id: r.doc_tokens for r in rows}


def test_packing_of_nothing_and_of_repeats(spark):
    assert packing.pack(docs(spark, []), length=8).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(twice, length=8).agg(F.sum("length")).first()[0] == 3 + 3 + 2


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_png_round_trip(n):
    payload, size = media.padded("é"[:n] + "x" * max(0, n - 2))
    assert len(payload) % 64 == 0 and len(payload) >= 64 and size <= len(payload)
    stored = media.encode(payload)
    assert media.header(stored[: media.HEADER_BYTES])[:2] == (64, len(payload) // 64)
    assert media.decode(stored) == payload


def test_media_rows(spark):
    texts = ["abc", None, "", "abc", "ü" * 1000, "long " * 50_000]
    manifest = media.store(docs(spark, texts))
    rows = {r.doc_id: r for r in media.read_media(manifest).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[0].asDict() | {"doc_id": 3} == rows[3].asDict() and rows[1].feature == rows[2].feature
    assert media.canonical(manifest).filter("n_rows > 1").count() == 2
    shard = manifest.select("shard").first().shard
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(shard)
    inside = media.members(where.open_input_file(path).read())
    assert all(hashlib.sha256(media.decode(b)).hexdigest() + ".png" == n for n, b in inside.items())
    assert media.read_media(media.store(docs(spark, []))).count() == 0
