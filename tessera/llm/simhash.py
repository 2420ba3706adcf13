"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: ASCII letters in lower case, words between ASCII white space, all runs of `shingle` words; bit i is set if
it is set in over half of the shingles' hashes (XXH64; each further 64 bits mix it anew). Fewer words: the whole sequence is the one
shingle. No words or null: 0.

Search, over distinct fingerprints only: each fingerprint is dealt once for each of several bit masks, by its bits under the mask (its
cell). For `radius` 3 of 64 bits the masks are all choices of 2 of 5 blocks, so any linked pair meets in a cell. Cells of over CELL
fingerprints are cut into parts by hash, and
a task for each pair of parts compares them, so no cell is held whole. Within a task fingerprints are stored vertically, one bit plane for each bit. For
many queries at once, each plane's differences are added into carry-save counters with a sticky overflow, and a query's row is
abandoned when all its distances exceed the radius. Each block of comparisons gives only a spanning forest, and a distributed
component search ends the job.

`similar` links documents whose sets of shingles have a Jaccard similarity of `similarity` or more. Fingerprints of 256 bits only find candidates
for it: one row for each distinct set is dealt by BANDS bands of min-hashes (a pair at 0.8 meets in none with a chance of 2e-5, whatever
the number of documents), and pairs in a cell are candidates within a radius of six standard deviations over the mean. The components of the candidates
are groups; within each group, in pairs of parts where it is large, the sets themselves are compared, and only links that hold count.

Equal texts, repeated rows and empty texts share fingerprints, hence classes. In `near_duplicates` a null doc_id is left without a class. In `similar` and
`keep_one` rows are known by doc_id and a hash of the text, so several texts under one doc_id are told apart and a null doc_id is the largest: a group
of null ids only has component_id null, and one row of it stays. Other columns are ignored (and kept by `keep_one`).
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table
from .graph import components, forest

SHINGLE = 3
RADIUS = 3
BLOCKS = 5
#: For near copies in general: words of a shingle, Jaccard similarity of the shingles, and the words of 64 bits that tell it.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
WIDE = 4
#: Bands of so many min-hashes: at similarity 0.8 a band agrees with a chance of 0.26, at 0.5 of 0.016, at 0.3 of 0.0007.
BANDS = 36
BAND = 6
CELL = 1024
#: Sets of shingles in a part of a group.
PART = 512
#: Fingerprints of neighbouring small cells compared together.
BATCH = 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
KEYS = ["way", "value", "i", "j"]
#: Odd numbers that make a hash function of each min-hash.
DRAWN = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * BAND), dtype="u8") << np.uint64(1) | np.uint64(1)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    x = h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    rows = h.view("u1").reshape(-1, 8)
    for at in range(0, len(rows), 1 << 14):
        counts += np.unpackbits(rows[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts > len(rows) / 2, bitorder="little").tobytes(), "little")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of all runs of words, with repeats."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        values = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = [0, *ends[:-shingle].tolist()]
        values = [digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return np.array(values, "<u8")


def fingerprint_of(h: np.ndarray, words: int) -> list[int]:
    if not len(h):
        return [0] * words
    return [majority(mixed(h, i) if i else h) for i in range(words)]


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> list[int]:
    return fingerprint_of(shingle_hashes(text, shingle), words)


def bands_of(distinct: np.ndarray) -> np.ndarray:
    """A key for each band: the min-hashes of a set of hashes, BAND at a time. None for an empty set."""
    if not len(distinct):
        return np.zeros(0, "u8")
    flip, times = DRAWN
    least = np.full(BANDS * BAND, ALL)
    for at in range(0, len(distinct), 256):
        np.minimum(least, ((distinct[at : at + 256, None] ^ flip) * times).min(axis=0), out=least)
    key = np.zeros(BANDS, "u8")
    for one in least.reshape(BANDS, BAND).T:
        key = mixed(key ^ one, 1)
    return key


def names(words: int) -> list[str]:
    return [f"f{i}" for i in range(words)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id with the fingerprint's words f0, f1, ... as signed longs."""

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle, words) for t in b.column(1)], "u8").reshape(-1, words).view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, i], pa.int64()) for i in range(words))], ["doc_id", *names(words)])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names(words)))


def keyed(docs: DataFrame) -> DataFrame:
    """key (of doc_id and text), doc_id, text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc_id, "text").alias("key"), doc_id.alias("doc_id"), "text")


def digest_of(distinct: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(distinct.tobytes(), seed) for seed in (1, 2)]


def sketches(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """key, doc_id, the digest s0, s1 of the set of shingles, and the set's fingerprint (repeats don't count) and bands."""

    def run(batches):
        for b in batches:
            s, f, keys = [], [], []
            for t in b.column(2):
                distinct = np.unique(shingle_hashes(t.as_py(), shingle))
                s.append(digest_of(distinct))
                f.append(fingerprint_of(distinct, words))
                keys.append(bands_of(distinct).view("i8"))
            at = np.array([*s], "u8").reshape(-1, 2).view("i8")
            fp = np.array(f, "u8").reshape(-1, words).view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(at[:, i]) for i in range(2)), *(pa.array(fp[:, i]) for i in range(words)), pa.array(keys, pa.list_(pa.int64()))], ["key", "doc_id", "s0", "s1", *names(words), "bands"])

    bounded_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "key long, doc_id long, s0 long, s1 long, " + ", ".join(f"{n} long" for n in names(words)) + ", bands array<long>")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """fp: fingerprints by words. Planes by words: bit j of word w of plane b is bit b of fingerprint 64 * w + j."""
    n = -(-len(fp) // 64) * 64
    bits = np.zeros((fp.shape[1] * 64, n), "u1")
    bits[:, : len(fp)] = np.unpackbits(np.ascontiguousarray(fp).view("u1").reshape(len(fp), -1), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def over_radius(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Where the counted distance exceeds the radius: a comparison with a constant, bit by bit from the top."""
    more, same = over, ~over
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            same = same & counters[j]
        else:
            more = more | (same & counters[j])
            same = same & ~counters[j]
    return more


def within(queries: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, fingerprint) of pairs that differ in radius bits or fewer; both are arrays of fingerprints by words."""
    planes = planes_of(fp)
    live = np.arange(len(queries))
    counters = [np.zeros((len(queries), planes.shape[1]), "u8") for _ in range(radius.bit_length())]
    over = np.zeros((len(queries), planes.shape[1]), "u8")
    last = len(planes) - 1
    for b, plane in enumerate(planes):
        asked = ((queries[live, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) * ALL
        carry = plane[None, :] ^ asked[:, None]
        for c in counters:
            up = c & carry
            c ^= carry
            carry = up
        over |= carry
        if b % 16 == 15 and radius < b < last:
            going = ~(over_radius(counters, over, radius) == ALL).all(axis=1)
            if not going.all():
                live, over = live[going], over[going]
                counters = [c[going] for c in counters]
                if not len(live):
                    return live, live
    near = np.unpackbits((~over_radius(counters, over, radius)).view("u1"), axis=1, bitorder="little")[:, : len(fp)]
    q, f = np.nonzero(near)
    return live[q], f


def links_of(left: np.ndarray, left_id: np.ndarray, right: np.ndarray, right_id: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two lists of fingerprints."""
    a, b = [], []
    for at in range(0, len(left), BATCH):
        q, f = within(left[at : at + BATCH], right, radius)
        x, y = forest(left_id[at : at + BATCH][q], right_id[f])
        a.append(x)
        b.append(y)
    return np.concatenate(a or [np.zeros(0, "i8")]), np.concatenate(b or [np.zeros(0, "i8")])


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(word, mask) for each choice of blocks - radius blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(0, sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)) for kept in combinations(range(blocks), blocks - radius)]


def radius_of(similarity: float, words: int) -> int:
    """The differing bits of two documents whose shingles have this Jaccard similarity: the mean and six standard deviations (sets of
    a few shingles, where ties are common, differ by up to 48 bits on average where the formula says 39)."""
    bits, p = 64 * words, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def in_parts(dealt: DataFrame, cell: int) -> DataFrame:
    """dealt: way, value (the cell), id and others. Cells of over `cell` rows as pairs (i, j) of parts; a cell's or pair's rows are in one partition, in order."""
    rest = [c for c in dealt.columns if c not in ("way", "value")]
    large = materialise(dealt.groupBy("way", "value").count().filter(F.col("count") > cell).select("way", "value", F.ceil(F.col("count") / cell).cast("int").alias("parts")), "simhash-large")
    # a part meets itself and each other part once: the pair's name is its two numbers in order
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    placed = dealt.join(large, ["way", "value"], "left").select("way", "value", *rest, F.when(F.col("parts").isNull(), 0).otherwise(mine).alias("mine"), F.explode(F.when(F.col("parts").isNull(), whole).otherwise(pairs)).alias("p"))
    return placed.select("way", "value", "p.i", "p.j", "mine", *rest).repartition(*KEYS).sortWithinPartitions(*KEYS)


def starts_of(t: pa.Table) -> np.ndarray:
    cols = [t.column(k).to_numpy() for k in KEYS]
    return np.nonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))[0]


def whole_groups(compared, rows: int):
    """A function for mapInArrow that hands `compared` tables of whole groups, of about so many rows."""

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= rows:
                begun = starts_of(held)
                if len(begun) > 1:
                    yield from compared(held.slice(0, int(begun[-1])))
                    held = held.slice(int(begun[-1]))
        if held is not None and held.num_rows:
            yield from compared(held)

    return run


def masked(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """fps: id, f0, ... Each row once for each mask, with its cell."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    ways = F.array(*(F.struct(F.lit(i).cast("short").alias("way"), F.col(f"f{w}").bitwiseAND(F.lit(signed(m))).alias("value")) for i, (w, m) in enumerate(masks)))
    return fps.select("*", F.explode(ways).alias("k")).select(*fps.columns, "k.way", "k.value")


def links(dealt: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """dealt: id, f0, ... and way, value (the cell). A spanning forest (a, b), by id, of the graph of fingerprints that meet in a cell and are within radius."""
    words = len(dealt.columns) - 3

    def compared(t):
        starts = starts_of(t)
        sizes = np.diff(np.concatenate([starts, [t.num_rows]]))
        i, j, mine, ids = (t.column(c).to_numpy() for c in ("i", "j", "mine", "id"))
        fp = np.stack([t.column(n).to_numpy() for n in names(words)], axis=1).view("u8")
        a, b = [], []
        few = np.nonzero((sizes > 1) & (sizes <= BATCH))[0]
        rows = np.nonzero(np.repeat((sizes > 1) & (sizes <= BATCH), sizes))[0]
        ends = np.cumsum(sizes[few])
        at = 0
        while at < len(few):  # whole small cells, up to BATCH fingerprints; links across cells are as true
            begun = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, begun + BATCH, side="right")))
            part = rows[begun : int(ends[end - 1])]
            x, y = links_of(fp[part], ids[part], fp[part], ids[part], radius)
            a.append(x)
            b.append(y)
            at = end
        for k in np.nonzero(sizes > BATCH)[0]:
            part = np.arange(starts[k], starts[k] + sizes[k])
            left, right = (part, part) if i[part[0]] == j[part[0]] else (part[mine[part] == i[part[0]]], part[mine[part] == j[part[0]]])
            x, y = links_of(fp[left], ids[left], fp[right], ids[right], radius)
            a.append(x)
            b.append(y)
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return in_parts(dealt, cell).mapInArrow(whole_groups(compared, 100_000), "a long, b long")


def classes(prints: DataFrame, masks: list[tuple[int, int]], radius: int, cell: int = CELL) -> DataFrame:
    """prints: doc_id, f0, ... Returns f0, ... and component_id (smallest doc_id of all documents reachable), one row a fingerprint."""
    words = names(len(prints.columns) - 1)
    known = materialise(prints.filter("doc_id IS NOT NULL").groupBy(*words).agg(F.min("doc_id").alias("id")), "simhash-distinct")
    found = links(masked(known.select("id", *words), masks), radius, cell)
    up = components(found).select(F.col("node").alias("id"), F.col("root").alias("component_id"))
    return materialise(known.join(up, "id", "left").select(*words, F.coalesce("component_id", "id").alias("component_id")), "simhash-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: 64 bits of runs of three words, linked at RADIUS bits or fewer."""
    prints = materialise(fingerprints(docs), "simhash-prints")
    digits = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return prints.join(classes(prints, block_masks(), RADIUS), "f0", "left").select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def true_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs, of one in left and one in right, whose sets have this Jaccard similarity. Pairs that are joined already aren't compared."""
    sizes = np.array([len(x) for x in sets])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    root, mark = np.arange(len(sets)), np.zeros(len(known), bool)
    a, b = [], []
    for q in left:
        asked = right[(root[right] != root[q]) & (np.minimum(sizes[right], sizes[q]) >= similarity * np.maximum(sizes[right], sizes[q]) - 1e-6)]
        if not len(asked):
            continue
        mine = flat[begin[q] : begin[q] + sizes[q]]
        mark[mine] = True
        n = sizes[asked]
        at = np.cumsum(n) - n
        both = np.add.reduceat(mark[flat[np.repeat(begin[asked] - at, n) + np.arange(n.sum())]], at, dtype=np.int64)
        mark[mine] = False
        hit = asked[both / (n + sizes[q] - both) >= similarity]
        for r in np.unique(root[hit]):
            a.append(q)
            b.append(r)
            root[root == r] = root[q]
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(docs: DataFrame, known: DataFrame, candidates: DataFrame, similarity: float, shingle: int, part: int) -> DataFrame:
    """known: id, key (of one row that has the set) and the digest; candidates: (node, root), the components of candidate links. A spanning
    forest (a, b), by id, of the links that hold within each of them."""
    members = candidates.select(F.col("node").alias("id"), F.col("root").alias("value")).unionByName(candidates.select(F.col("root").alias("id"), F.col("root").alias("value")).distinct())
    asked = members.join(known.select("id", "key", "s0", "s1"), "id")
    texts = keyed(docs).drop("doc_id").join(asked, "key").dropDuplicates(["key", "id"]).select("id", "value", "s0", "s1", "text")

    def sets(batches):
        for b in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column(4)]
            want = np.stack([b.column(i).to_numpy() for i in (2, 3)], axis=1).view("u8").tolist()
            some = [i for i, x in enumerate(found) if len(x) and digest_of(x) == want[i]]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(some), pa.int16()), b.column(1).take(some), b.column(0).take(some), pa.array([found[i].view("i8") for i in some], pa.list_(pa.int64()))], ["way", "value", "id", "shingles"])

    def compared(t):
        starts = starts_of(t)
        ends = [*starts[1:], t.num_rows]
        i, j, mine, ids = (t.column(c).to_numpy() for c in ("i", "j", "mine", "id"))
        shingles = t.column("shingles").combine_chunks()
        flat, offsets = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        a, b = [], []
        for start, end in zip(starts, ends, strict=True):
            rows = np.arange(end - start)
            here = mine[start:end]
            left, right = (rows, rows) if i[start] == j[start] else (rows[here == i[start]], rows[here == j[start]])
            x, y = true_links([flat[offsets[k] : offsets[k + 1]] for k in range(start, end)], left, right, similarity)
            a.append(ids[start + x])
            b.append(ids[start + y])
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    held = materialise(texts.mapInArrow(sets, "way short, value long, id long, shingles array<long>"), "simhash-sets")
    return in_parts(held, part).mapInArrow(whole_groups(compared, 2 * part), "a long, b long")


def grouped(docs: DataFrame, similarity: float, shingle: int, words: int, cell: int, part: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of docs, and for each distinct set (s0, s1) of them its group."""
    prints = materialise(sketches(docs, shingle, words), "simhash-prints")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    sets = prints.groupBy("s0", "s1").agg(F.min(row).alias("row"), *(F.first(n).alias(n) for n in [*names(words), "bands"]))
    known = materialise(sets.select(F.monotonically_increasing_id().alias("id"), "s0", "s1", F.col("row.key").alias("key"), *names(words), "bands"), "simhash-distinct")
    dealt = known.select("id", *names(words), F.posexplode("bands").alias("way", "value")).withColumn("way", F.col("way").cast("short"))
    candidates = components(links(dealt, radius_of(similarity, words), cell))
    up = components(verified(docs, known, candidates, similarity, shingle, part)).select(F.col("node").alias("id"), F.col("root").alias("group"))
    return prints, materialise(known.join(up, "id", "left").select("s0", "s1", F.coalesce("group", "id").alias("group")), "simhash-groups")


def firsts(prints: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their group, and each group's first row: the least doc_id, null last."""
    rows = prints.select("key", "doc_id", "s0", "s1").join(groups, ["s0", "s1"])
    return rows, rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")).select("group", "first.doc_id", "first.key")


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, words: int = WIDE, cell: int = CELL, part: int = PART) -> DataFrame:
    """doc_id, component_id: linked where the sets of shingles have a Jaccard similarity of so much or more."""
    rows, first = firsts(*grouped(docs, similarity, shingle, words, cell, part))
    return rows.select("doc_id", "group").join(first.select("group", F.col("doc_id").alias("component_id")), "group").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, words: int = WIDE, cell: int = CELL, part: int = PART) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id."""
    kept = materialise(firsts(*grouped(docs, similarity, shingle, words, cell, part))[1].select("key", "doc_id"), "simhash-kept")
    names = [F.col(f"`{n}`") for n in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    return rows.join(kept.select("key"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
