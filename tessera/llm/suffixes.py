"""Suffix-array dedup of repeated 50-byte strings, by deep-shallow sorting of the suffixes that could repeat.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Sorting every suffix
of the corpus would write it many times over, so only those that may have an equal are sorted:

1. Each string of LENGTH bytes has an anchor, the first of its GRAM-byte grams with the smallest hash; equal strings have equal anchors at the
   same place. The strings that share an anchor lie side by side and form its segment. A record holds the hashes of gram and segment.
   Records are dealt by gram. Equal segments are repeats at once, but for the smallest doc_id's. A gram in one document only
   has no repeats. What is left are segments that share a gram but differ.
2. Those segments are cut from the texts and dealt by gram, and their suffixes are sorted to LENGTH bytes: multikey sorting on
   eight-byte words to depth SHALLOW first, then a blind trie for each group still tied. Equal strings end up together, and
   all but the smallest doc_id's are repeats.
3. The repeats of a document are united and cut out of its text.

Grams that are frequent in a bounded sample of documents (SAMPLE_DOCS rows) are dealt by each whole string instead, so no task gathers a
passage that a third of the documents share; equal records of one batch are settled before the shuffle. In step 2 a gram with over CROWD open segments
is dealt by whole strings too: their least doc_id is aggregated, and the strings of others join it.

Null text is empty. Texts under LENGTH bytes keep all. A null doc_id counts as the largest. Rows are known by doc_id and a hash of the
text: several texts under one doc_id, null included, are texts of their own, none of which has the smaller doc_id, so they aren't repeats of each other; nor
are rows that repeat wholly, and these are treated alike. Matches never cross documents. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_tables, materialise, table

LENGTH = 50
GRAM = 16
SHALLOW = 16
#: Bytes hashed together, and the bits that hold a place in them.
PLACE_BITS = 18
BUFFER = 1 << PLACE_BITS
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 4 << 20
#: Bytes of text for each bucket, and from how many buckets on they grow.
BUCKET_BYTES = 4 << 20
BUCKETS = 4096
SAMPLE_DOCS = 20_000
#: A gram expected in more documents than this is dealt by whole strings.
HOT_DOCS = 2000
#: Open segments of a gram that one task sorts.
CROWD = 4096
LAST = (1 << 63) - 1

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int) -> np.ndarray:
    p = np.full(BUFFER + 1, base, U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


_tables: list = []


def powers() -> list:
    if not _tables:
        for b in BASES:
            _tables.append((_powers(b), _powers(pow(b, -1, 1 << 64))))
    return _tables


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Buffer:
    """Hashes of the substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        x = data.astype(U) + U(1)
        self.sums = []
        for up, _ in powers():
            s = np.zeros(self.n + 1, U)
            np.cumsum(x * up[: self.n], out=s[1:])
            self.sums.append(s)

    def hashes(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mixed((s[end] - s[start]) * powers()[which][1][start] + (end - start).astype(U))

    def grams(self, size: int) -> np.ndarray:
        s = self.sums[0]
        return mixed((s[size:] - s[:-size]) * powers()[0][1][: self.n - size + 1] + U(size))


def slid_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def pieces(texts: list[bytes]):
    """Lists of (text, start, bytes), BUFFER bytes a list at most; the pieces of a long text overlap by LENGTH - 1."""
    part, held = [], 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= LENGTH:
            size = min(len(t) - at, BUFFER - 64)
            if part and held + size > BUFFER - 64:
                yield part
                part, held = [], 0
            part.append((i, at, t[at : at + size]))
            held += size
            if at + size == len(t):
                break
            at += size - LENGTH + 1
    if part:
        yield part


def records(texts: list[bytes], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram, segment, text, start, strings of each anchor; for hot grams of each string, by its two hashes."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for part in pieces(texts):
        data = np.frombuffer(b"".join(p[2] for p in part), "u1")
        sizes = np.array([len(p[2]) for p in part])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        buffer = Buffer(data)
        gram = buffer.grams(GRAM)
        low = U(BUFFER - 1)
        place = slid_min((gram & ~low) | np.arange(len(gram), dtype=U), LENGTH - GRAM + 1) & low
        starts = np.concatenate([np.arange(f, f + n - LENGTH + 1) for f, n in zip(first, sizes, strict=True)])
        anchor = place[starts]
        new = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))[0]
        s, n = starts[new], np.diff(np.concatenate([new, [len(starts)]]))
        g = mixed(gram[anchor[new].astype(np.int64)])  # the least hashes are small ones: mixed anew they fill all buckets alike
        owner = np.searchsorted(first, s, side="right") - 1
        common = np.isin(g, hot) if len(hot) else np.zeros(len(g), bool)
        rows = [(g[~common], buffer.hashes(s, s + n + LENGTH - 1, 1)[~common], owner[~common], s[~common], n[~common])]
        if common.any():
            each, many = s[common], n[common]
            ws = np.repeat(each, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            rows.append((buffer.hashes(ws, ws + LENGTH, 0), buffer.hashes(ws, ws + LENGTH, 1), np.repeat(owner[common], many), ws, np.ones(len(ws), np.int64)))
        text, offset = np.array([p[0] for p in part]), np.array([p[1] for p in part])
        for g, h, o, s, n in rows:
            for c, v in zip(out, (g, h, text[o], s - first[o] + offset[o], n), strict=True):
                c.append(v)
    kinds = (U, U, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True))


def settle(g: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by gram; in it, which records repeat an equal segment of a smaller document, and which
    others share their gram with a differing segment of another document."""
    order = np.argsort(g, kind="stable")
    gs = g[order]
    repeat, open_ = np.zeros(len(g), bool), np.zeros(len(g), bool)
    if len(g) < 2:
        return order, repeat, open_
    same = gs[1:] == gs[:-1]
    many = np.nonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))[0]
    if not len(many):
        return order, repeat, open_
    sub = order[many]
    inner = np.lexsort((doc[sub], h[sub], g[sub]))
    sub, at = sub[inner], many  # the places of `many` are taken anew in this order, gram by gram
    order[at] = sub
    gg, hh, dd = g[sub], h[sub], doc[sub]
    new_g = np.concatenate([[True], gg[1:] != gg[:-1]])
    new = new_g | np.concatenate([[True], hh[1:] != hh[:-1]])
    cls, grp = np.cumsum(new) - 1, np.cumsum(new_g) - 1
    least = dd[new][cls]
    rep = dd > least
    classes = np.bincount(grp[new])
    lowest, highest = np.minimum.reduceat(dd, np.nonzero(new_g)[0]), np.maximum.reduceat(dd, np.nonzero(new_g)[0])
    repeat[at] = rep
    open_[at] = ~rep & (classes > 1)[grp] & (lowest < highest)[grp]
    return order, repeat, open_


def runs(doc: np.ndarray, key: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges [s, s + n) of each text (doc, key) united where they touch."""
    if not len(doc):
        return doc, key, s, n
    order = np.lexsort((s, key, doc))
    doc, key, s, e = doc[order], key[order], s[order], (s + n)[order]
    other = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    # ends may not be sorted within a text, so carry the furthest one
    top = int(e.max()) + 1
    rank = np.cumsum(np.concatenate([[0], other]))
    far = np.maximum.accumulate(e + rank * top) - rank * top
    new = np.nonzero(np.concatenate([[True], other | (s[1:] > far[:-1])]))[0]
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    return doc[new], key[new], s[new], far[last] - s[new]


def flat(doc, key, s, n, g=None) -> pa.RecordBatch:
    grams = pa.nulls(len(doc), pa.int64()) if g is None else pa.array(g.view("i8"), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32()), grams], ["doc_id", "key", "s", "n", "g"])


FOUND = "doc_id long, key long, s int, n int, g long"


def encoded(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def batches_of(column: pa.Array, most: int = SLICE_BYTES):
    """Slices (start, length) of a batch of about so many bytes."""
    sizes, start, held = pc.binary_length(column).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= most:
            yield start, i + 1 - start
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes) - start


#: Columns of a blob of records, and of one of repeats that are settled.
OPEN = ("<u8", "<u8", "<i8", "<i8", "<u4", "u1")
DONE = ("<i8", "<i8", "<u4", "<u4")


def packed(columns, kinds) -> bytes:
    return b"".join(c.astype(k).tobytes() for c, k in zip(columns, kinds, strict=True))


def unpacked(blob: bytes, kinds) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    count, at, out = len(blob) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(blob, kind, count, at))
        at += count * size
    return out


def search(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Repeats settled by equal segments (g null), and segments left open (with g)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches):
        for b in batches:
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
            texts = b.column("text")
            for start, size in batches_of(texts):
                g, h, text, s, n = records(encoded(texts.slice(start, size)), shared.value)
                doc, key = ids[start + text], keys[start + text]
                order, repeat, _ = settle(g, h, doc)
                keep, done = order[~repeat], order[repeat]
                rows = []
                d, dk, rs, rn = runs(doc[done], key[done], s[done], n[done])
                if len(d):
                    rows.append((int(dk[0]) % buckets, 1, packed((d, dk, rs, rn), DONE)))
                bucket = ((g[keep] >> U(32)) * U(buckets)) >> U(32)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                for k in np.nonzero(np.diff(edges))[0]:
                    at = keep[edges[k] : edges[k + 1]]
                    at = at[np.lexsort((s[at], key[at], doc[at]))]  # documents in a row pack well
                    rows.append((int(k), 0, packed((g[at], h[at], doc[at], key[at], s[at], n[at]), OPEN)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])

    def judge(bucket: pa.Table) -> pa.Table:
        done, left = [], []
        for kind, blob in zip(bucket.column("kind").to_pylist(), bucket.column("blob").to_pylist(), strict=True):
            (done if kind else left).append(unpacked(blob, DONE if kind else OPEN))
        out = []
        if left:
            g, h, doc, key, s, n = (np.concatenate(c) for c in zip(*left, strict=True))
            s, n = s.astype("i8"), n.astype("i8")
            order, repeat, open_ = settle(g, h, doc)
            r, o = order[repeat], order[open_]
            done.append((doc[r], key[r], s[r], n[r]))
            out.append(flat(doc[o], key[o], s[o], n[o], g[o]))
        if done:
            doc, key, s, n = (np.concatenate(c) for c in zip(*done, strict=True))
            out.append(flat(*runs(doc, key, s.astype("i8"), n.astype("i8"))))
        return pa.Table.from_batches(out)

    dealt = docs.mapInArrow(deal, "bucket int, kind tinyint, blob binary")
    return dealt.groupBy("bucket").applyInArrow(judge, FOUND)


def frequent(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Grams expected in over HOT_DOCS documents, from a bounded sample by hash."""
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    least = max(20, math.ceil(HOT_DOCS * share))

    def count(batches):
        for b in batches:
            for start, size in batches_of(b.column(1)):
                g, _, text, _, _ = records(encoded(b.column(1).slice(start, size)), np.zeros(0, U))
                seen = np.unique(np.stack([g, text.astype(U)]), axis=1)[0] if len(g) else g
                g, n = np.unique(seen, return_counts=True)
                often = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(g[often].view("i8"), pa.int64()), pa.array(n[often], pa.int64())], ["g", "n"])

    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "text")
    counts = sampled.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # a sample's documents hold a bounded number of grams, so few can be frequent
    return np.sort(np.array([r.g for r in counts.select("g").collect()], "i8").view(U))


class BlindTrie:
    """A compacted trie that keeps branching depths and bytes only; strings are compared once for each insertion."""

    def __init__(self):
        self.root = None

    def add(self, key: bytes, label: int) -> int:
        """The label of the equal string that came first."""
        if self.root is None:
            self.root = (key, label)
            return label
        node = self.root
        while isinstance(node, list):
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == key:
            return node[1]
        depth = next(i for i, (a, b) in enumerate(zip(other, key, strict=True)) if a != b)
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][key[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][key[depth]] = (key, label)
            return label
        branch = [depth, {other[depth]: node, key[depth]: (key, label)}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key[parent[0]]] = branch
        return label


def multikey(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by group and words, and where in it a group of equal rows begins. Each pass sorts by one word, and only rows still tied."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    for word in keys.T:
        alone = new & np.concatenate([new[1:], [True]])
        at = np.nonzero(~alone)[0]
        if not len(at):
            break
        tie = np.cumsum(new)[at]
        sub = order[at]
        inner = np.lexsort((word[sub], tie))
        order[at] = sub[inner]
        w = word[order[at]]
        new[at[1:]] |= (tie[1:] == tie[:-1]) & (w[1:] != w[:-1])
    return order, np.nonzero(new)[0]


def equal_strings(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A class for each row of LENGTH bytes, the same for equal rows of a group: multikey sorting to depth SHALLOW, then blind tries."""
    words = -(-LENGTH // 8)
    wide = np.zeros((len(rows), words * 8), "u1")
    wide[:, :LENGTH] = rows
    keys = wide.view(">u8")
    shallow = SHALLOW // 8
    order, starts = multikey(group, keys[:, :shallow])
    k = keys[order, shallow:]
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    tied = np.repeat(np.arange(len(starts)), sizes)
    # a tied group whose rows are all like its first is one class
    unlike = (k != k[starts][tied]).any(axis=1)
    classes = starts[tied].astype(np.int64)
    for t in np.unique(tied[unlike]):
        at, trie = int(starts[t]), BlindTrie()
        block = wide[order[at : at + sizes[t]], SHALLOW:LENGTH]
        for i in range(len(block)):
            classes[at + i] = trie.add(block[i].tobytes(), at + i)
    out = np.empty(len(rows), np.int64)
    out[order] = classes
    return out


def resolve(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """The repeats among open segments, with g null."""
    crowd = materialise(open_.groupBy("g").count().filter(F.col("count") > CROWD).select("g", F.lit(True).alias("crowded")), "suffix-crowds")
    marked = open_.join(crowd, "g", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    wanted = marked.groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "n", "g", "crowded")).alias("segments"))
    cut = docs.join(wanted, ["doc_id", "key"]).select("doc_id", "key", F.encode("text", "UTF-8").alias("raw"), F.explode("segments").alias("x"))
    cut = cut.select("doc_id", "key", "x.*", F.substring("raw", F.col("x.s") + 1, F.col("x.n") + (LENGTH - 1)).alias("bytes"))
    grouped = cut.filter("NOT crowded").drop("crowded").repartition("g").sortWithinPartitions("g")

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 5_000:
                g = held.column("g").to_numpy()
                other = np.nonzero(g != g[-1])[0]
                if len(other):
                    yield sort_strings(held.slice(0, int(other[-1]) + 1))
                    held = held.slice(int(other[-1]) + 1)
        if held is not None and held.num_rows:
            yield sort_strings(held)

    def sort_strings(t):
        doc, key, s, n, g = (t.column(c).to_numpy().astype("i8") for c in ("doc_id", "key", "s", "n", "g"))
        raw = np.frombuffer(b"".join(t.column("bytes").to_pylist()), "u1")
        first = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first, n) + inner
        windows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[at]
        d, k, place = np.repeat(doc, n), np.repeat(key, n), np.repeat(s, n) + inner
        cls = equal_strings(np.repeat(g, n), windows)
        least = np.full(len(cls), LAST, np.int64)
        np.minimum.at(least, cls, d)
        hit = d > least[cls]
        return flat(*runs(d[hit], k[hit], place[hit], np.ones(int(hit.sum()), np.int64)))

    strings = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("s") + i).alias("s"), F.substring(F.col("bytes"), i + 1, F.lit(LENGTH)).alias("string")))
    windows = cut.filter("crowded").select("doc_id", "key", F.explode(strings).alias("w")).select("doc_id", "key", "w.*")
    least = windows.groupBy("string").agg(F.min("doc_id").alias("least"))
    more = windows.join(least, "string").filter("doc_id > least").select("doc_id", "key", "s", F.lit(1).alias("n"), F.lit(None).cast("long").alias("g"))
    return grouped.mapInArrow(run, FOUND).unionByName(more)


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left) if asked for."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    n_docs, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = max(32, min(math.ceil(total / BUCKET_BYTES), max(BUCKETS, total // (16 * BUCKET_BYTES))))
    found = materialise(search(docs, buckets, frequent(docs, n_docs)), "suffix-found")
    rest = materialise(resolve(docs, found.filter("g IS NOT NULL")), "suffix-resolved")
    repeats = found.filter("g IS NULL").drop("g").unionByName(rest.drop("g"))
    by_doc = materialise(repeats.groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "n")).alias("repeats")), "suffix-repeats")
    drop_tables(found, rest)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def cut_slice(ids, texts, listed):
        out: list[list] = [[] for _ in names[1:]]
        for at, raw in enumerate(encoded(texts)):
            gone = np.zeros(len(raw) + 1, np.int8)
            if listed[at].is_valid:
                v = listed[at].values.flatten()
                change = np.zeros(len(raw) + 1, np.int32)
                start = v[0].to_numpy(zero_copy_only=False).astype("i8")
                np.add.at(change, start, 1)
                np.add.at(change, start + v[1].to_numpy(zero_copy_only=False) + LENGTH - 1, -1)
                gone = (np.cumsum(change, dtype=np.int32) > 0).astype(np.int8)
            left = np.frombuffer(raw, "u1")[gone[: len(raw)] == 0].tobytes()
            row = (len(raw), len(raw) - len(left), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest(), left)
            for c, v in zip(out, row, strict=False):
                c.append(v)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names)

    def cut(batches):
        for b in batches:
            for start, size in batches_of(b.column("text")):
                yield cut_slice(b.column("doc_id").slice(start, size), b.column("text").slice(start, size), b.column("repeats").slice(start, size))

    joined = docs.join(by_doc, ["doc_id", "key"], "left").select("doc_id", "text", "repeats")
    done = joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
