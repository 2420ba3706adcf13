"""Media columns: content-addressed payloads in tar shards, rows that carry digest, offset and length.

Each task appends the payloads it has not stored yet, as 8-bit grey PNG images of width 64, to tar shards of its own in
the shared folder; a member's name is its payload's sha256. The rows (the manifest) are written as a table. Reading back,
a range read of 33 bytes gives the image header, which fills the metadata columns, and a range read of the member gives
the stored bytes, from which payload and features are computed. A shard's name holds a random part: an attempt that is
lost leaves a shard that no row names. Equal payloads of one task are stored once; the manifest's rows of equal payloads
carry the same digest, and `canonical` names one place for each digest.

Null text is stored as the empty text: 64 zero bytes. Equal texts, equal values. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, scratch_path, table

WIDTH = 64
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and the IHDR chunk.
HEADER_BYTES = 33


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    n = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return raw + bytes(n - len(raw)), len(raw)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, "u1").reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), "u1")  # filter 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, int]:
    """width, height, bits and colour type, from the first HEADER_BYTES of a stored form."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    return struct.unpack(">IIBB", first[16:26])


def decode(stored: bytes) -> bytes:
    width, height, bits, colour = header(stored)
    if (bits, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    at, data = 8, b""
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        if stored[at + 4 : at + 8] == b"IDAT":
            data += stored[at + 8 : at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), "u1").reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that is not used here")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the share of zero samples."""
    counts = np.bincount(np.frombuffer(payload, "u1"), minlength=256)
    p = counts / counts.sum()
    levels = np.arange(256)
    mean = float((p * levels).sum())
    seen = p[p > 0]
    return f"mean={mean:.4f};std={max(0.0, float((p * levels**2).sum()) - mean * mean) ** 0.5:.4f};entropy={float(-(seen * np.log2(seen)).sum()):.4f};zeros={p[0]:.6f}"


class Shards:
    """Tar shards that one task writes."""

    def __init__(self, base: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(base)
        self.fs.create_dir(self.root, recursive=True)
        self.base, self.out, self.at, self.name = base, None, 0, ""

    def add(self, digest: str, body: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of what is stored."""
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        place = (f"{self.base}/{self.name}", self.at + len(head), len(body))
        block = head + body + bytes(-len(body) % 512)
        self.out.write(block)
        self.at += len(block)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, base: str | None = None) -> DataFrame:
    """The manifest: doc_id, n_bytes, digest, shard, offset, length."""
    bounded_batches(docs.sparkSession)
    base = base or scratch_path(docs.sparkSession, "media")

    def run(batches):
        shards, places = Shards(base), {}
        try:
            for b in batches:
                rows: list[list] = [[] for _ in range(5)]
                for text in b.column(1):
                    payload, n = padded(text.as_py())
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in places:
                        places[digest] = shards.add(digest, encode(payload))
                    for c, v in zip(rows, (n, digest, *places[digest]), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return materialise(rows, "media-manifest")


def canonical(manifest: DataFrame) -> DataFrame:
    """One place for each digest, for compaction: digest, shard, offset, length, n_rows."""
    return manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"), F.count("*").alias("n_rows")).select("digest", "p.*", "n_rows")


class Reader:
    """Range reads from shards, one of which is kept open."""

    def __init__(self):
        self.name, self.file = "", None

    def __call__(self, shard: str, offset: int, length: int) -> bytes:
        from pyarrow import fs

        if shard != self.name:
            self.close()
            where, path = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, where.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def read_headers(manifest: DataFrame) -> DataFrame:
    """The manifest with width, height and bits from header-only range reads."""
    kept = manifest.columns

    def run(batches):
        read = Reader()
        for b in batches:
            found = [header(read(*place, HEADER_BYTES)) for place in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[i] for f in found], pa.int32()) for i in range(3))], [*kept, "width", "height", "bits"])
        read.close()

    fields = ", ".join(f"`{n}` {k}" for n, k in manifest.dtypes)
    return manifest.mapInArrow(run, f"{fields}, width int, height int, bits int")


def read_media(manifest: DataFrame) -> DataFrame:
    """Each row's stored bytes read back, checked against its digest and described."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]

    def describe(stored: bytes, digest: str) -> tuple:
        payload = decode(stored)
        sha = hashlib.sha256(payload).hexdigest()
        if sha != digest:
            raise ValueError(f"the stored form of {digest} is damaged")
        return len(payload), sha, zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)

    def run(batches):
        read, seen = Reader(), {}
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            found = []
            for digest, shard, offset, length in zip(cols["digest"], cols["shard"], cols["offset"], cols["length"], strict=True):
                if digest not in seen:
                    if len(seen) >= 50_000:
                        seen.clear()
                    seen[digest] = describe(read(shard, offset, length), digest)
                found.append(seen[digest])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)), b.column("width"), b.column("height")], names)
        read.close()

    return read_headers(manifest).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int")


def members(shard: bytes) -> dict[str, bytes]:
    """A shard's members by any tar reader, for tests."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as t:
        return {m.name: t.extractfile(m).read() for m in t}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store(table(spark, sf_dir, "documents")))
