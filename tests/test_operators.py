import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.graph import closure, merge_roots
from tessera.operators.ledger import edit_one_pairs, open_conflicts
from tessera.operators.leaders import leader_clusters
from tessera.operators.packs import bundles
from tessera.operators.search import fuse, gate
from tessera.operators.vectors import nearest
from tessera.sources import chat, files


def test_closure_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    got = {(r.src, r.dst): r.hops for r in closure(e).collect()}
    assert got[(4, 3)] == 3 and got[(1, 1)] == 3 and (1, 4) not in got
    with pytest.raises(ValueError):
        closure(spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long"), depth=4)


def test_merge_roots(spark):
    m = spark.createDataFrame([(i, i - 1) for i in range(1, 12)], "node long, into long")
    assert {(r.node, r.root, r.hops) for r in merge_roots(m).collect()} == {(i, 0, i) for i in range(1, 12)}
    with pytest.raises(ValueError):
        merge_roots(spark.createDataFrame([(1, 2), (2, 1)], "node long, into long"), depth=5)


def test_edit_one_pairs(spark):
    names = ["latte", "late", "lattes", "mocha", "mocho", "xy", "xz", "아메리카노", "아메리키노"]
    got = edit_one_pairs(spark.createDataFrame(list(enumerate(names)), "id long, name string")).collect()
    assert {(r.left_name, r.right_name) for r in got} == {("latte", "late"), ("latte", "lattes"), ("mocha", "mocho"), ("아메리카노", "아메리키노")}


def test_conflicts_chain_a_slot(spark):
    f = spark.createDataFrame([(1, "a", 10), (1, "b", 5), (1, "b", 7), (1, "c", 20), (2, "a", 1), (2, "a", 2)], "slot long, identity string, fact_id long")
    assert {tuple(r) for r in open_conflicts(f).collect()} == {(1, 5, 10), (1, 10, 20)}


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 2, 1)], "query_id long, id long, rank int")
    got = fuse([a, b], 10).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1] and got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_gate_reasons(spark):
    q = spark.createDataFrame([(1, "cup where"), (2, "cup"), (3, "?"), (4, "cup"), (5, None)], "query_id long, question string")
    c = spark.createDataFrame([(1, 1, 0.9, "a cup"), (2, 1, 0.9, "a plate"), (4, 1, 0.1, "cup")], "query_id long, id long, score double, text string")
    assert {(r.query_id, r.outcome, r.reason) for r in gate(q, c).collect()} == {(1, "hit", None), (2, "miss", "intent_mismatch"), (3, "miss", "no_anchor"), (4, "miss", "no_match"), (5, "miss", "no_anchor")}


def test_nearest_matches_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(60, 5)).round(1)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 5)], "vec_id long, embedding array<double>").repartition(3)
    got = nearest(v.filter("vec_id < 5"), v, 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(5):
        s = np.round(u @ u[i], 9)
        want = [j for j in sorted(range(60), key=lambda j: (-s[j], j)) if j != i][:4]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == want


def test_bundles_start_anew(spark):
    r = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 5, 20, 1, 1, 1, None])], "k string, i long, n long")
    got = [x.bundle for x in bundles(r, "k", "i", "n", {"rows": 3, "chars": 12}).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 4]


def test_bundles_over_many_cells(spark):
    """A hot key in cells of few rows, small keys, a null key and null sizes: the same as one pass over each key."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else None if i % 4 else f"k{i % 5}", i // 2, None if i % 17 == 0 else int(rng.integers(0, 9))) for i in range(240)]
    r = spark.createDataFrame(rows, "k string, i long, n long")
    limits = {"rows": 4, "chars": 15}
    got = bundles(r, "k", "i", "n", limits, cell_rows=12).collect()
    want = []
    for key in {k for k, _, _ in rows}:
        bundle, held, chars = 0, 0, 0
        for i, n in sorted((i, n or 0) for k, i, n in rows if k == key):
            if held and (held >= 4 or chars + n > 15):
                bundle, held, chars = bundle + 1, 0, 0
            held, chars = held + 1, chars + n
            want.append((key, i, n, bundle))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bundles_of_no_rows(spark):
    assert bundles(spark.createDataFrame([], "k string, i long, n long"), "k", "i", "n").collect() == []


def test_leader_clusters(spark):
    rows = [("k", -1, ["a", "b"]), ("k", -2, ["a", "b", "c"]), ("k", -3, ["x"]), ("k", -4, [])]
    got = {-r.place: -r.leader for r in leader_clusters(spark.createDataFrame([(*r, None) for r in rows], "scope string, place long, terms array<string>, key string"), 0.75).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4}


CHAT = """대화
2026년 8월 18일 오전 8:52, 박사장 : 오픈조
둘째 줄
2026년 8월 18일 오후 12:05, 김 : 사진
2026. 8. 19. 오후 1:07, 이 : 안녕: 하세요
--------------- 2026년 8월 20일 목요일 ---------------
[박사장] [오전 12:01] 밤
이님이 들어왔습니다."""


def test_chat_formats(spark):
    lines = spark.createDataFrame([("f", i, s) for i, s in enumerate(CHAT.split("\n"))], "file string, pos long, line string")
    got = [(r.who, str(r.sent), r.text) for r in chat.parse(lines).orderBy("pos").collect()]
    assert got == [("박사장", "2026-08-18 08:52:00", "오픈조\n둘째 줄"), ("이", "2026-08-19 13:07:00", "안녕: 하세요"), ("박사장", "2026-08-20 00:01:00", "밤")]
    s = chat.summary(chat.parse(lines)).first()
    assert (s.participants, s.message_count) == (["박사장", "이"], 3)
    assert chat.parse(lines.filter("pos = 0")).count() == 0


def test_files(spark):
    got = spark.createDataFrame([("a/B.PDF?x=1",), ("c.html#t",), ("none",), (None,)], "p string").select(files.reader_of(F.col("p")).alias("r")).collect()
    assert [r.r for r in got] == ["pages", "blocks", None, None]
    lines = spark.createDataFrame([('{"a": 1}',), ("no",), (None,)], "line string")
    assert [tuple(r) for r in files.checked_json(lines, "a bigint").collect()] == [(1, None), (None, "no"), (None, None)]
