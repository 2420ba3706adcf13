"""Exact quantiles against sorting."""

import math
import random

import pytest

from tessera.operators.quantiles import quantiles

ASKED = {"least": ("nearest", 0.0), "p50": ("nearest", 0.5), "p95": ("nearest", 0.95), "most": ("nearest", 1.0), "median": ("between", 0.5), "q": ("between", 0.37)}


def brute(values):
    s = sorted(values)
    out = []
    for kind, p in ASKED.values():
        if kind == "nearest":
            out.append(s[max(1, math.ceil(round(p * 10**9) * len(s) / 10**9)) - 1])
        else:
            at = p * (len(s) - 1)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            out.append(a if a == b else a + (b - a) * (at - math.floor(at)))
    return out


def test_quantiles_of_groups(spark):
    rng = random.Random(3)
    groups = {
        "one": [5.0], "two": [1.0, 2.0], "same": [7.25] * 500, "few": [rng.choice([0.1, 0.2, 0.3]) for _ in range(400)], "hot": [rng.gauss(0, 1e6) for _ in range(6000)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(900)],
        "close": [1.0 + i * 2**-52 for i in range(300)], None: [rng.random() for _ in range(77)], "skewed": [float(i) for i in range(999)] + [1e300], "ends": [-math.inf, 1.0, 2.0, 3.0, math.inf], "huge": [-1.7e308, 1.0, 2.0, 1.7e308],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("none", math.nan), ("one", None), ("two", math.nan)]
    rng.shuffle(rows)
    got = {r.g: list(r)[1:] for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", ASKED).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(brute(values), rel=1e-12, nan_ok=True), g


def test_quantiles_of_a_whole_table(spark):
    df = spark.range(2000).selectExpr("(id * 7919) % 2003 AS v", "id % 3 AS a", "'x' AS part")
    assert quantiles(df, [], "v", {"m": ("between", 0.5)}).columns == ["m"]
    values = sorted(i * 7919 % 2003 for i in range(2000))
    assert quantiles(df, [], "v", {"m": ("between", 0.5)}).first().m == (values[999] + values[1000]) / 2
    assert quantiles(df, ["a", "part"], "v", {"p": ("nearest", 0.5)}).count() == 3
    assert quantiles(df.limit(0), ["a"], "v", ASKED).count() == 0
