"""What the findings of round 3 named, each query beside its SQL on small tables made for it."""

import verify
from tessera.operators import scoring
from tessera.plans import QUERIES
from tessera.sources import shared
from tessera.streaming.ordered import OrderedFold


def beside_sql(spark, path, name, **tables) -> str:
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return verify.differs(spark, verify.views(str(path)), name, str(path))


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    """As in SQL, í and é are no part of a word."""
    said = ["ja", "noítaga", "éno", "Ñnever!", "none", "no_", "no", None, "not 7"]
    assert beside_sql(spark, tmp_path, "obvious_conflict", conversations=([(1, i, s) for i, s in enumerate(said)], "conv_id long, turn int, text string")) == ""


def test_addresses_end_at_letters_beyond_ascii(spark, tmp_path):
    said = ["í10.0.0.1", "10.0.0.1é", "x10.0.0.1", "10.0.0.1_", "(10.0.0.1)", "1.2.3.4.5.6.7.8", "1234.1.1.1", None]
    assert beside_sql(spark, tmp_path, "redaction", documents=(list(enumerate(said)), "doc_id long, text string")) == ""


def test_siblings_are_rows(spark, tmp_path):
    """Each other block of a card that the top three name is a row; one of two hits of a card isn't its sibling."""
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 1, [1.0, 0.2]), (3, 2, [1.0, 0.3]), (4, 2, [-1.0, 0.0]), (5, 2, [-1.0, 0.1]), (6, 3, [-1.0, 0.2])]
    assert beside_sql(spark, tmp_path, "sibling_completion", embeddings=(rows, "vec_id long, label int, embedding array<float>")) == ""
    got = QUERIES["sibling_completion"](spark, str(tmp_path)).select("query_id", "vec_id", "sibling").collect()
    assert sorted(map(tuple, got)) == [(0, 0, True), (0, 1, False), (0, 2, False), (0, 3, False), (0, 4, True), (0, 5, True)]


def test_a_card_is_split_once_for_all_its_facts(monkeypatch):
    """Facts that a better card has settled, or whose values a card can't hold, cost no clauses; in the order of cards and against it."""
    split, begin = [], scoring.Card.__init__
    monkeypatch.setattr(scoring.Card, "__init__", lambda self, *a: (split.append(a), begin(self, *a))[1])
    rows = [(i, "milk", f"cold w{i} box", None) for i in range(50)]
    for order in (1, -1):
        facts = scoring.Facts(rows)
        for card_id in list(range(9))[::order]:
            facts.meet(card_id, "", "milk " + " ".join(f"cold w{i} box" for i in range(50)) if card_id < 3 else "milk is white")
        assert sorted(facts.found()) == [(i, -3, False, 0) for i in range(50)]
        assert len(split) == (1 if order == 1 else 3)
        split.clear()


def test_a_timer_asks_the_store_once_for_a_state():
    """Each call to the state store is a message between processes."""
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or ([(5, 1), (3, 2)] if name == "get" and calls.count("get") == 1 else None)

    fold = OrderedFold(["at", "id"], "", "", (0,), ["key", "sum"], lambda state, row: ((state[0] + row[1],), (state[0] + row[1],)), lambda state: None)
    fold.handle, fold.waiting, fold.state = Store(), Store(), Store()
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 1})()
    (out,) = fold.handleExpiredTimer(("a",), clock, None)
    assert out.values.tolist() == [["a", 2], ["a", 3]] and sorted(calls) == ["clear", "get", "get", "update"]


def test_tasks_grow_with_the_rows(spark, monkeypatch, sf):
    """What a task sorts or groups is bounded: rows of orders are dealt to tasks by their number (F8, F10), votes too (F11)."""
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    for name in ("answer_suitability", "appended_layout", "consensus_vote"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
        assert n > 4 and f", {n})" in plan.replace(", REPARTITION", "), REPARTITION") and "REPARTITION_BY_NUM" in plan
