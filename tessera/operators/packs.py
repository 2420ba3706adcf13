"""Order-dependent grouping that a window can't express: limits that start anew with each group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import with_checkpoints

LIMITS = {"rows": 8, "chars": 12_000}


def cut(sizes, held: int, chars: int, limits: dict[str, int]) -> tuple[list[int], int]:
    """How many bundles have begun after the open one at each row, and how many rows the last one holds. The open one has `held` rows of `chars` together; no row: none is open."""
    begun, out = 0, []
    for s in sizes:
        if held and (held >= limits["rows"] or chars + s > limits["chars"]):
            begun, held, chars = begun + 1, 0, 0
        held, chars = held + 1, chars + s
        out.append(begun)
    return out, held


def bundles(rows: DataFrame, key: str, order: str, size: str, limits: dict[str, int] = LIMITS, cell_rows: int = 100_000) -> DataFrame:
    """key, order, size and `bundle`: consecutive rows of a key, cut where the next row would pass a limit. Rows of one order value go by size; null sizes are 0.

    A key's rows are split by range into cells, so a hot key is many tasks. An open bundle holds at most limits["rows"] rows, which are the last ones before
    a cell: for each number of them a cell says how many are open at its end (rows + 1 states), those steps are followed over the small table of
    cells, and each cell is cut once more from the state that it is really entered with."""
    rows = with_checkpoints(rows).select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s"))
    parts = max(1, -(-rows.count() // cell_rows))
    rows = rows.repartitionByRange(parts, "k", "o").withColumn("cell", F.spark_partition_id()).checkpoint()
    most, kinds = limits["rows"], dict(rows.dtypes)

    late = F.row_number().over(Window.partitionBy("k", "cell").orderBy(F.desc("o"), F.desc("s")))
    last = F.array_sort(F.collect_list(F.struct((-F.col("late")).alias("at"), "s")))
    ends = rows.withColumn("late", late).filter(F.col("late") <= most).groupBy("k", "cell").agg(F.transform(last, lambda x: x["s"]).alias("end"))
    near = F.flatten(F.collect_list("end").over(Window.partitionBy("k").orderBy("cell").rowsBetween(-most, -1)))
    before = ends.select("k", "cell", F.reverse(F.slice(F.reverse(near), 1, most)).alias("before"))

    def sizes(g: pd.DataFrame) -> list[int]:
        return g.sort_values(["o", "s"], kind="stable")["s"].tolist()

    def steps(name: tuple, g: pd.DataFrame) -> pd.DataFrame:
        s, tail = sizes(g), list(g["before"].iloc[0])
        found = [cut(s, r, sum(tail[len(tail) - r :]), limits) for r in range(len(tail) + 1)]
        return pd.DataFrame({"k": [name[0]], "cell": [name[1]], "to": [[f[1] for f in found]], "begun": [[f[0][-1] for f in found]]})

    same = lambda other: rows.join(other.withColumnsRenamed({"k": "k2", "cell": "cell2"}), F.col("k").eqNullSafe(F.col("k2")) & (F.col("cell") == F.col("cell2"))).drop("k2", "cell2")
    moves = same(before).groupBy("k", "cell").applyInPandas(steps, f"k {kinds['k']}, cell int, to array<int>, begun array<int>")
    path = F.aggregate(
        F.array_sort(F.collect_list(F.struct("cell", "to", "begun"))),
        F.struct(F.array().cast("array<struct<cell int, held int, first bigint>>").alias("seen"), F.lit(0).alias("held"), F.lit(0).cast("long").alias("first")),
        lambda a, x: F.struct(
            F.concat(a["seen"], F.array(F.struct(x["cell"].alias("cell"), a["held"].alias("held"), a["first"].alias("first")))).alias("seen"), F.get(x["to"], a["held"]).alias("held"), (a["first"] + F.get(x["begun"], a["held"])).alias("first")
        ),
        lambda a: a["seen"],
    )
    entered = moves.groupBy("k").agg(path.alias("seen")).select("k", F.inline("seen"))
    entered = entered.withColumnsRenamed({"k": "k3", "cell": "cell3"}).join(before, F.col("k3").eqNullSafe(F.col("k")) & (F.col("cell3") == F.col("cell"))).drop("k3", "cell3").checkpoint()

    def label(name: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["o", "s"], kind="stable")
        tail, held, first = list(g["before"].iloc[0]), int(g["held"].iloc[0]), int(g["first"].iloc[0])
        begun, _ = cut(g["s"].tolist(), held, sum(tail[len(tail) - held :]), limits)
        return pd.DataFrame({key: [name[0]] * len(g), order: g["o"], size: g["s"], "bundle": [first + n for n in begun]})

    return same(entered).groupBy("k", "cell").applyInPandas(label, f"{key} {kinds['k']}, {order} {kinds['o']}, {size} long, bundle long")
