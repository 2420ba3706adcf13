"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Only vectors of one label and length are compared. Equal vectors are first made one row with a count. Spherical k-means, fitted for each label on
a bounded sample (about SAMPLE vectors by hash), assigns every vector to the cell of its nearest centroid; a cell that is still large is split in the same way,
level by level, so the number of cells grows with the data while each fit and each set of centroids stays small (FAN at most). So that no link is lost, a
vector also visits each cell in which a vector within the threshold's angle could lie: those whose bisecting plane with its own cell is nearer than the
sine of that angle. Each vector's links are counted in its own cell, among owners and visitors, so once each. Of several numbers of
cells a fit takes the one that leaves the sample the fewest products, two at least for a whole label; a cell whose vectors would visit nearly all
new ones, as in a large group of near copies, stays as it is. Cells of over PART rows are cut into parts, and each
pair of parts is a block of its own: no cell is held whole, and no pair is written, only counts and a
spanning forest. Cosines are in double precision.

Neither vectors nor centroids pass the driver: samples and rows meet their centroids by cell, large cells dealt over salts of SALT_ROWS rows.

A null label, a null vector, null or non-finite components or norm zero: no links, a group of its own. Vectors of other lengths don't
compare. Repeated rows and null vec_ids count as other vectors (a null vec_id is the largest). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_tables, materialise, table
from .graph import components, forest

THRESHOLD = 0.98
SAMPLE = 4096
#: Vectors of a cell that is small enough, new cells of a fit at most, and levels of splits.
PER_CELL = 500
FAN = 64
LEVELS = 6
#: A cell is split if that leaves under this share of its products.
WORTH = 0.7
SALT_ROWS = 20_000
LAST = (1 << 63) - 1
CELL = ["label", "dim", "cell"]
ITERATIONS = 8
PART = 8192
BLOCK = 512


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ITERATIONS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and by vector and cell whether it goes there (as owner or visitor)."""
    near = x @ c.T
    own = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[own]
    margin = near[np.arange(len(x)), own][:, None] - near
    return own, margin <= np.sqrt(max(0.0, 1 - threshold * threshold)) * apart + 1e-9


def best_centroids(x: np.ndarray, k: int, least: int, threshold: float) -> np.ndarray | None:
    """Centroids, of k or fewer cells, that leave the sample x the fewest products; with least = 1 none if splitting isn't worth it."""
    found, lowest = None, WORTH * len(x) ** 2
    while k >= 2:
        c = spherical_kmeans(x, k)
        own, goes = cells_of(x, c, threshold)
        # owners times members, against all times all; a row that goes to a cell costs about as much as 100 products
        cost = (np.bincount(own, minlength=k) * goes.sum(axis=0)).sum() + 100 * (goes.sum() - len(x))
        if cost < lowest or (found is None and least > 1 and k <= 3):
            found, lowest = c, cost
        k //= 2
    return found


def fit(rows: DataFrame, sizes: DataFrame, threshold: float, per_cell: int, level: int) -> DataFrame:
    """sizes: cells to split, with their owners. Returns label, dim, cell, k and centroids (k * dim numbers) of each that is split."""
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("owners"))
    drawn = F.pmod(F.xxhash64("first", F.lit(level)), F.lit(1 << 40)) < share * (1 << 40)
    sample = rows.filter("owner").join(sizes, CELL).filter(drawn).select(*CELL, "owners", "first", "embedding")
    least = 2 if level == 0 else 1

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("first")
        dim, n = t.column("dim")[0].as_py(), t.column("owners")[0].as_py()
        x = np.array(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, dim)
        k = min(FAN, max(2, -(-n // per_cell)), len(x))
        c = best_centroids(unit(x), k, least, threshold)
        one = [] if c is None else [c]
        cells = {name: t.column(name).slice(0, len(one)) for name in CELL}
        return pa.table({**cells, "k": pa.array([len(c) for c in one], pa.int32()), "centroids": pa.array([c.ravel() for c in one], pa.list_(pa.float64()))})

    return sample.groupBy(*CELL).applyInArrow(run, "label long, dim int, cell long, k int, centroids array<double>")


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    fine &= F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.filter(fine)


def split(rows: DataFrame, fitted: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Each row once for each new cell that it goes to; rows of cells that aren't split stay. A cell and its centroids meet in salts of the cell."""
    salts = sizes.join(fitted.select(*CELL), CELL).select(*CELL, F.ceil(F.col("members") / SALT_ROWS).cast("int").alias("salts"))
    marked = rows.join(salts, CELL, "left")
    stay = marked.filter("salts IS NULL").select(*rows.columns)
    go = marked.filter("salts IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("first"), F.col("salts")).cast("int")).drop("salts")
    centroids = fitted.join(salts, CELL).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    names, schema = rows.columns, rows.schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        out = [left.column(n) for n in names]
        if not left.num_rows or not right.num_rows:
            return pa.table(out, names=names).slice(0, 0)
        dim, cell = left.column("dim")[0].as_py(), left.column("cell")[0].as_py()
        c = np.array(right.column("centroids")[0].values.to_numpy(zero_copy_only=False), "f8").reshape(-1, dim)
        x = np.array(left.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, dim)
        own, goes = cells_of(unit(x), c, threshold)
        r, k = np.nonzero(goes)
        taken = left.select(names).take(pa.array(r))
        owner = taken.column("owner").to_numpy() & (own[r] == k)
        at = names.index
        taken = taken.set_column(at("cell"), "cell", pa.array(cell * (FAN + 1) + k + 1, pa.int64()))
        return taken.set_column(at("owner"), "owner", pa.array(owner, pa.bool_()))

    key = [*CELL, "salt"]
    parted = go.groupBy(*key).cogroup(centroids.groupBy(*key)).applyInArrow(run, schema)
    return stay.unionByName(parted)


def placed(distinct: DataFrame, threshold: float, per_cell: int) -> DataFrame:
    """A row for each cell that a vector goes to: label, dim, cell, owner, first, n, embedding."""
    rows = distinct.select("label", "dim", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("owner"), "first", "n", "embedding")
    tried = None
    for level in range(LEVELS):
        sizes = rows.groupBy(*CELL).agg(F.count(F.when(F.col("owner"), 1)).alias("owners"), F.count("*").alias("members"))
        sizes = sizes.filter("owners > 1" if level == 0 else F.col("owners") > 2 * per_cell)
        sizes = materialise(sizes if tried is None else sizes.join(tried, CELL, "left_anti"), "embed-sizes")
        fitted = materialise(fit(rows, sizes, threshold, per_cell, level), "embed-centroids")
        if not fitted.limit(1).count():
            break
        unsplit = sizes.join(fitted, CELL, "left_anti").select(*CELL)
        tried = unsplit if tried is None else tried.unionByName(unsplit)
        before, rows = rows, materialise(split(rows, fitted, sizes, threshold), "embed-cells")
        if level:
            drop_tables(before)
    return rows


def compare(rows: DataFrame, threshold: float, part: int = PART) -> DataFrame:
    """Counts (a, null, n) of what each owner links with, itself included, and links (a, b, null) that span its group."""
    sizes = rows.groupBy(*CELL).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")
    asks = F.when(F.col("owner"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(True).alias("asks"), (j == F.col("mine")).alias("answers"))))
    answers = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers")))
    # an owner's own block asks and answers in one row
    answers = F.when(F.col("owner"), F.filter(answers, lambda s: s["i"] != F.col("mine"))).otherwise(answers)
    none = F.array().cast("array<struct<i:int,j:int,asks:boolean,answers:boolean>>")
    blocks = rows.join(sizes.filter("parts > 1"), CELL, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", mine)
    blocks = blocks.select("label", "dim", "cell", "first", "n", "embedding", F.explode(F.concat(F.coalesce(asks, none), answers)).alias("s")).select("label", "dim", "cell", "s.*", "first", "n", "embedding")
    keys = ["label", "dim", "cell", "i", "j"]
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 4 * part:
                begun = starts_of(held)
                if len(begun) > 1:
                    yield from groups(held.slice(0, int(begun[-1])))
                    held = held.slice(int(begun[-1]))
        if held is not None:
            yield from groups(held)

    def starts_of(t):
        cols = [t.column(k).to_numpy() for k in keys]
        return np.nonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))[0] if t.num_rows else np.zeros(0, int)

    def groups(t):
        begun = starts_of(t)
        for s, e in zip(begun, [*begun[1:], t.num_rows], strict=True):
            yield from block(t.slice(int(s), int(e - s)).combine_chunks())

    def block(t):
        dim = t.column("dim")[0].as_py()
        first, n = t.column("first").to_numpy(), t.column("n").to_numpy()
        asks, answers = t.column("asks").to_numpy(), t.column("answers").to_numpy()
        flat = pa.concat_arrays([c.flatten() for c in t.column("embedding").chunks])
        x = unit(np.array(flat.to_numpy(zero_copy_only=False), "f8").reshape(-1, dim))
        left, right, right_id = x[asks], x[answers], first[answers]
        left_id, weight = first[asks], n[answers]
        total, a, b = np.zeros(len(left), "i8"), [], []
        for at in range(0, len(left), BLOCK):
            hit = left[at : at + BLOCK] @ right.T >= threshold
            hit |= left_id[at : at + BLOCK][:, None] == right_id[None, :]
            total[at : at + BLOCK] = hit @ weight
            l, r = np.nonzero(hit)
            p, q = forest(left_id[at : at + BLOCK][l], right_id[r])
            a.append(p)
            b.append(q)
        p, q = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, "i8"), np.zeros(0, "i8"))
        ids = np.concatenate([left_id, p])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.concatenate([np.zeros(len(left), "i8"), q]), pa.int64(), mask=np.arange(len(ids)) < len(left)), pa.array(np.concatenate([total, np.zeros(len(p), "i8")]), pa.int64(), mask=np.arange(len(ids)) >= len(left))], ["a", "b", "n"]
        )

    return dealt.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, per_cell: int = PER_CELL, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    bounded_batches(vectors.sparkSession)
    fine = usable(vectors).select("vec_id", "label", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("code"))
    key = ["label", "dim", "code", "embedding"]
    whole = fine.groupBy(*key).agg(F.min(F.coalesce("vec_id", F.lit(LAST))).alias("least"), F.count("*").alias("n"))
    distinct = materialise(whole.withColumn("first", F.monotonically_increasing_id()), "embed-distinct")
    slim = distinct.select("label", "dim", "first", "n", "embedding")
    found = materialise(compare(placed(slim, threshold, per_cell), threshold, part), "embed-found")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("first")).agg((F.sum("n") - 1).alias("n_links"))
    up = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("first"), F.col("root"))
    rooted = materialise(distinct.join(counts, "first").join(up, "first", "left").select(*key, "n_links", "least", F.coalesce("root", "first").alias("root")), "embed-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.drop("least").join(least, "root").drop("root")
    joined = vectors.withColumn("dim", F.size("embedding")).withColumn("code", F.xxhash64("embedding")).join(known, key, "left")
    component = F.coalesce("component_id", "vec_id")
    component = F.when(component != LAST, component)
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
