"""The maintained view against its recomputation, with failures at each point of a batch; the rules of delivery."""

import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.streaming.delivery import FAILED, JOINED, NONE, OFF, REQUESTED, START, deliver, folded
from tessera.streaming.maintained import GROUPS, KEYS, Ledger, View, maintain
from tessera.streaming.ordered import OrderedFold

SCHEMA = "key long, at long, grp string, weight long"


def some_changes(n, seed):
    rng = random.Random(seed)
    at = rng.sample(range(10 * n), n)
    # a third of all changes are of one key
    return [(0 if rng.random() < 0.33 else rng.randrange(40), a, rng.choice([None, "a", "b", "c", f"once {a}"]), rng.randrange(100)) for a in at]


def recomputed(rows):
    keys, groups = {}, {}
    for key, at, grp, weight in sorted(rows, key=lambda r: r[1]):
        if grp is not None:
            keys[key] = (grp, weight, at, True)
            groups.setdefault(grp, [0, 0, at])
        elif key in keys:
            keys[key] = (*keys[key][:3], False)
    for grp, weight, _, holds in keys.values():
        if holds:
            groups[grp][0] += 1
            groups[grp][1] += weight
    return keys, {g: tuple(x) for g, x in groups.items()}


def held(view):
    return {r.key: (r.grp, r.weight, r.at, r.holds) for r in view.keys().collect()}, {r.grp: (r.n, r.weight, r["first"]) for r in view.groups().collect()}


def test_view_follows_its_changes(spark, tmp_path):
    """After each batch the view is the recomputation; batches come in no order of time, one is empty, and each is delivered twice."""
    rows = some_changes(240, 1)
    view, seen = View(spark, f"file://{tmp_path}/v", fan=2), []
    for n, part in enumerate([rows[:1], rows[1:60], [], rows[60:61], rows[61:200], rows[200:]]):
        seen += part
        batch = spark.createDataFrame(part, SCHEMA)
        view.apply(batch, n)
        assert held(view) == recomputed(seen)
        view.apply(batch, n)
        assert held(view) == recomputed(seen)
    live = view.ledger.entry(5)
    assert all(sum(x[:2] == (kind, level) for x in live) < 2 for kind in (KEYS, GROUPS) for level in range(5)) and {x[1] for x in live} > {1}
    assert view.ledger.batches() == [4, 5]
    kept = {p.name for p in (tmp_path / "v" / KEYS).iterdir()}
    assert kept == {x[2].rsplit("/", 1)[1] for b in (4, 5) for x in view.ledger.entry(b) if x[0] == KEYS}


@pytest.mark.parametrize("point", ["before layers", "before entry", "after entry", "after sweep"])
def test_view_survives_a_failure(spark, tmp_path, monkeypatch, point):
    """The driver fails once within the third batch; the stream starts again from its state."""
    rows = some_changes(120, 2)
    for i in range(0, 120, 12):
        spark.createDataFrame(rows[i : i + 12], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    failed = []

    def fails_once(kind, name, where, when):
        before = getattr(kind, name)

        def run(self, *args):
            hit = not failed and when(args)
            if hit:
                failed.append(1)
            if hit and where == "before":
                raise RuntimeError("lost")
            out = before(self, *args)
            if hit:
                raise RuntimeError("lost")
            return out

        monkeypatch.setattr(kind, name, run)

    third = lambda args: 2 in args
    if point == "before layers":
        fails_once(View, "write", "before", lambda args: args[-1] == 2 and args[1] == GROUPS)
    else:
        fails_once(Ledger, "sweep" if point == "after sweep" else "commit", point.split()[0], third)
    with pytest.raises(StreamingQueryException):
        maintain(changes, f"file://{tmp_path}/v", fan=2)
    assert failed
    assert held(maintain(changes, f"file://{tmp_path}/v", fan=2)) == recomputed(rows)
    spark.createDataFrame([(0, 5000, None, 1), (77, 5001, "new", 3)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    assert held(maintain(changes, f"file://{tmp_path}/v", fan=2)) == recomputed([*rows, (0, 5000, None, 1), (77, 5001, "new", 3)])


def said(*rows):
    state, out = START, []
    for i, (notification, answer) in enumerate(rows):
        state, (_, _, what, sent) = deliver(state, (i, i, notification, answer))
        out.append((what, sent))
    return out


def test_rules_of_delivery():
    assert said((1, 201), (1, 500), (2, 500), (2, 200)) == [(REQUESTED, True), (REQUESTED, False), (FAILED, True), (REQUESTED, True)]
    assert said((1, 404), (1, 201), (NONE, 0), (1, 201)) == [(FAILED, True), (OFF, False), (JOINED, False), (REQUESTED, True)]
    assert said((1, 201), (2, 410), (1, 201), (NONE, 0), (1, 410), (2, 201)) == [(REQUESTED, True), (FAILED, True), (OFF, False), (JOINED, False), (REQUESTED, False), (REQUESTED, True)]


def test_status_of_a_notification(spark):
    rows = [(1, 1, 1, FAILED, True), (1, 1, 1, REQUESTED, True), (1, 2, 2, OFF, False), (2, 3, 3, FAILED, True), (2, 3, 3, OFF, False), (3, 4, 4, OFF, False), (4, 5, 5, REQUESTED, True), (4, 6, 6, FAILED, True), (NONE, 7, 7, JOINED, False)]
    d = spark.createDataFrame(rows, "notification long, event_id long, at long, said string, sent boolean")
    assert {tuple(r) for r in folded(d).collect()} == {(1, "REQUESTED", 2, 2, 2), (2, "FAILED", 1, 1, 1), (3, "PENDING", 1, 0, 0), (4, "FAILED", 2, 2, 2)}
    assert folded(d.limit(0)).count() == 0 and folded(d.filter(F.lit(False))).count() == 0


def test_rows_with_nulls_are_an_error():
    p = OrderedFold(["at", "event_id"], "", "", (), [], None, None)
    with pytest.raises(ValueError, match="null"):
        list(p.handleInputRows((1,), iter([pd.DataFrame({"at": [1, 2], "event_id": [1, None]})]), None))
