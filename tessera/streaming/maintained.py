"""A view kept up to date by a change feed, equal to its recomputation whatever the micro-batches, the order of changes and restarts.

A change says where a key (a card) belongs from then on: to a group (a category), with a weight, or nowhere. The view has the keys, each with its last place and
whether it still holds, and the groups with the number and weight of the keys that they hold now. Of a micro-batch only what changed is written: a
layer of keys and one of group differences. A difference needs the former place of the keys in the batch alone, which is looked up in the live layers.

Layers merge by maxima (keys) and sums and minima (groups), so late and repeated changes do no harm. FAN layers of a level become one of the next, so a row is written anew
about log(batches) / log(FAN) times. Both tables of a batch become valid by one ledger entry, under the batch's id: a batch that has its entry is skipped when it
is delivered again, and what a failed attempt left is written over. Layers that the last two entries don't name are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4
KEYS, GROUPS = "keys", "groups"
LEDGER = "kind string, level int, path string"


class Ledger:
    """Which layers hold after which batch. An entry is valid once its folder has the marker of a finished write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/ledger/*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(p) or [])

    def entry(self, batch: int) -> list[tuple[str, int, str]]:
        """The layers of a batch: at most FAN for each kind and level."""
        return [tuple(r) for r in self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{batch:08d}").collect()]

    def commit(self, batch: int, layers: list[tuple[str, int, str]]) -> None:
        self.spark.createDataFrame(layers, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/{batch:08d}")

    def sweep(self, batch: int) -> None:
        """Layers and entries that neither this batch nor the one before it needs go, those of failed attempts too: Spark delivers no older batch again."""
        done = [b for b in self.batches() if b <= batch]
        needed = {(layer[0], layer[2].rsplit("/", 1)[1]) for b in done[-2:] for layer in self.entry(b)} | {("ledger", f"{b:08d}") for b in done[-2:]}
        for kind in (KEYS, GROUPS, "ledger"):
            fs, p = self._fs(f"{self.path}/{kind}/*")
            for found in [s.getPath() for s in fs.globStatus(p) or []]:
                if (kind, found.getName()) not in needed and int(found.getName().split("-")[0]) <= batch:
                    fs.delete(found, True)


def merged(kind: str, layers: DataFrame) -> DataFrame:
    if kind == KEYS:
        return layers.groupBy("key").agg(F.max("last").alias("last"), F.max("placed").alias("placed"))
    return layers.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("first").alias("first"))


def place(at: str, sign: int) -> Column:
    """What a key adds to its group's totals; null where it is in none."""
    placed, last = F.col(f"{at}placed"), F.col(f"{at}last")
    return F.when(placed["at"] == last, F.struct(placed["grp"].alias("grp"), F.lit(sign).cast("long").alias("n"), (placed["weight"] * sign).alias("weight")))


class View:
    """changes: key, at (an orderable column; one change for each key and at), grp (null: nowhere) and weight (long)."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan, self.ledger = spark, path, fan, Ledger(spark, path)

    def read(self, kind: str, layers: list[tuple[str, int, str]]) -> DataFrame:
        return self.spark.read.parquet(*(p for k, _, p in layers if k == kind))

    def write(self, df: DataFrame, kind: str, level: int, batch: int) -> tuple[str, int, str]:
        path = f"{self.path}/{kind}/{batch:08d}-{level}"
        df.write.mode("overwrite").parquet(path)
        return kind, level, path

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One micro-batch; called again with the same id it changes nothing."""
        done = self.ledger.batches()
        if done and done[-1] >= batch:
            return
        live = self.ledger.entry(done[-1]) if done else []
        placed = F.when(F.col("grp").isNotNull(), F.struct("at", "grp", "weight"))
        layer = self.write(merged(KEYS, changes.select("key", F.col("at").alias("last"), placed.alias("placed"))), KEYS, 0, batch)
        new = self.read(KEYS, [layer])
        old = merged(KEYS, self.read(KEYS, live).join(new.select("key"), "key", "left_semi")) if live else new.limit(0)
        both = new.join(old.select("key", F.col("last").alias("old_last"), F.col("placed").alias("old_placed")), "key", "left")
        both = both.select("old_last", "old_placed", F.greatest("last", "old_last").alias("now_last"), F.greatest("placed", "old_placed").alias("now_placed"))
        moves = both.select(F.explode(F.array_compact(F.array(place("old_", -1), place("now_", 1)))).alias("m")).select("m.*", F.lit(None).cast(changes.schema["at"].dataType).alias("first"))
        seen = changes.filter("grp IS NOT NULL").select("grp", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("weight"), F.col("at").alias("first"))
        live = [*live, layer, self.write(merged(GROUPS, moves.unionByName(seen)), GROUPS, 0, batch)]
        self.ledger.commit(batch, self.compacted(live, batch))
        self.ledger.sweep(batch)

    def compacted(self, live: list[tuple[str, int, str]], batch: int) -> list[tuple[str, int, str]]:
        for kind in (KEYS, GROUPS):
            level = 0
            while len(full := [x for x in live if x[:2] == (kind, level)]) >= self.fan:
                live = [x for x in live if x not in full] + [self.write(merged(kind, self.read(kind, full)), kind, level + 1, batch)]
                level += 1
        return live

    def keys(self) -> DataFrame:
        """key, grp, weight and at of the last place of each key that ever had one, and whether it holds."""
        now = merged(KEYS, self.read(KEYS, self.ledger.entry(self.ledger.batches()[-1]))).filter("placed IS NOT NULL")
        return now.select("key", "placed.grp", "placed.weight", "placed.at", (F.col("placed.at") == F.col("last")).alias("holds"))

    def groups(self) -> DataFrame:
        """grp, n and weight of the keys it holds, and its first change; groups that hold none any more stay, with 0."""
        return merged(GROUPS, self.read(GROUPS, self.ledger.entry(self.ledger.batches()[-1])))


def maintain(changes: DataFrame, path: str, fan: int = FAN) -> View:
    """Runs a stream of changes to the end of what is there. With the same path again, it goes on where it was."""
    view = View(changes.sparkSession, path, fan)
    q = changes.writeStream.foreachBatch(view.apply).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return view
