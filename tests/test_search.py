import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.boxes import box_pairs
from tessera.operators.search import lexical


def brute(queries, docs, k):
    for q, asked in queries.items():
        scores = [(len(set(asked or ()) & set(held or ())), d) for d, held in docs.items()]
        for rank, (s, d) in enumerate(sorted(((s, d) for s, d in scores if s), key=lambda x: (-x[0], x[1]))[:k], 1):
            yield q, d, s, rank


@pytest.mark.parametrize("unmet, met_at_once", [(0.0, 10**6), (0.8, 10**6), (1.0, 10**6), (1.0, 0)])
def test_lexical_is_exact(spark, monkeypatch, unmet, met_at_once):
    """Words of every frequency, one in each document; ties, repeats, documents and questions with no words, words that no document has."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: ["all"] + rng.choices(words, [1 / (i + 1) for i in range(60)], k=n)
    docs = {d: draw(rng.randrange(25)) for d in range(300)} | {300: [], 301: None}
    queries = {q: draw(rng.randrange(15)) + ["nowhere"] for q in range(20)} | {20: ["all"], 21: [], 22: ["nowhere"], 23: None, 24: ["w59", "w59", "w58"]}
    monkeypatch.setattr(search, "UNMET", unmet)
    monkeypatch.setattr(search, "MET_AT_ONCE", met_at_once)
    a = spark.createDataFrame(list(queries.items()), "query_id long, terms array<string>")
    b = spark.createDataFrame(list(docs.items()), "doc_id long, words array<string>")
    got = {tuple(r) for r in lexical(a, b, F.col("words"), 5).select("query_id", "doc_id", "score", "rank").collect()}
    assert got == set(brute(queries, docs, 5))


def test_lexical_of_empty_tables(spark):
    a, b = spark.createDataFrame([], "query_id long, terms array<string>"), spark.createDataFrame([(1, ["x"])], "doc_id long, words array<string>")
    assert lexical(a, b, F.col("words"), 3).count() == 0
    assert lexical(spark.createDataFrame([(1, ["x"])], a.schema), b.limit(0), F.col("words"), 3).count() == 0


def test_box_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        x, y = rng.randrange(-40, 200), rng.randrange(-40, 200)
        # small ones, long ones over many cells, repeats, and boxes without area
        w, h = rng.choice([(5, 5), (90, 3), (3, 140), (20, 20), (0, 9), (60, 60)])
        rows.append((i % 2, i, x, y, x + w, y + h))
    rows += [(0, 200, *rows[0][2:]), (0, 201, None, 0, 5, 5), (None, 202, 0, 0, 9, 9)]
    want = {}
    for p, i, *a in rows:
        for q, j, *b in rows:
            if p is not None and p == q and i < j and None not in a + b:
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                s, t = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
                if w > 0 and h > 0 and s and t:
                    want[i, j] = (round(w * h / (s + t - w * h), 9), round(w * h / min(s, t), 9))
    boxes = spark.createDataFrame(rows, "page long, id long, x0 long, y0 long, x1 long, y1 long")
    found = box_pairs(boxes, boxes, 16, 16, same=True).collect()
    assert {(r.left_id, r.right_id): (round(r.iou, 9), round(r.inside, 9)) for r in found} == want and len(found) == len(want) > 100
