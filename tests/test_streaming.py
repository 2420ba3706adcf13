"""State in the order of event time: the processor by hand, and the rules of contexts."""

import random
from types import SimpleNamespace

import pandas as pd

from tessera.streaming.contexts import FAILED_MOST, HOUR, RETAIN, TTL, forget_context, turn
from tessera.streaming.ordered import OrderedFold


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return iter(self.now) if isinstance(self.now, list) else self.now

    def update(self, x):
        self.now = x

    put = update

    def clear(self):
        self.now = None

    def appendList(self, rows):  # noqa: N802
        self.now = [*(self.now or []), *rows]


class Handle:
    def __init__(self):
        self.timers, self.held = set(), {}

    def getListState(self, name, schema):  # noqa: N802
        return self.held.setdefault(name, Value())

    def getValueState(self, name, schema):  # noqa: N802
        return self.held.setdefault(name, Value())

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def run(rows, batches, delay):
    """The rows in some micro-batches; the watermark trails the newest row by delay (microseconds), and in the end passes all."""
    handle, out, seen = Handle(), [], 0
    columns = ["at", "event_id", "event_type", "known"]
    p = OrderedFold(columns, "", "", (0, 0, 0, 0, 0, []), ["user_id", "event_id", "said", "turns", "revision", "failed"], turn, forget_context)
    p.init(handle)

    def fire(watermark):
        while due := [t for t in sorted(handle.timers) if t <= watermark]:
            handle.timers.discard(due[0])
            for part in p.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None):
                out.extend(part.itertuples(index=False, name=None))

    for b in batches:
        list(p.handleInputRows((7,), iter([pd.DataFrame([rows[i] for i in b], columns=columns)]), None))
        seen = max(seen, *(rows[i][0] for i in b))
        fire((seen - delay) // 1000)
    fire(10**15)
    return out, handle


def stepped(rows):
    state, out = (0, 0, 0, 0, 0, []), []
    for r in sorted(rows):
        state, values = turn(state, r)
        out.append((7, *values))
    return out


def test_order_does_not_depend_on_batches():
    rng = random.Random(4)
    rows = [(rng.randrange(1, 60 * 24) * HOUR // 2 + i, i, rng.choice(["signup", *["view", "click", "click", "purchase", "error"] * 3]), rng.randrange(2)) for i in range(300)]
    want = stepped(rows)
    assert {"ASKED", "OFFERED", "ACCEPTED", "NOT_FOUND", "EXPIRED", "FOUND", "CHANGED", "FAILED", "UNBOUND"} <= {w[2] for w in want}
    ids = list(range(300))
    assert run(rows, [ids], 0)[0] == want
    rng.shuffle(ids)
    assert run(rows, [ids[i : i + 20] for i in range(0, 300, 20)], 10**13)[0] == want
    ids.sort(key=lambda i: rows[i][0])
    out, handle = run(rows, [ids[i : i + 7] for i in range(0, 300, 7)], 3 * HOUR)
    assert out == want
    assert handle.held["state"].now is None and handle.held["waiting"].now is None and not handle.timers  # swept


def said(*rows):
    return [x[2] for x in stepped([(at, i, kind, known) for i, (at, kind, known) in enumerate(rows)])]


def test_rules_of_a_context():
    h = HOUR
    assert said((h, "click", 0), (2 * h, "purchase", 0)) == ["NOT_FOUND"] * 2
    assert said((h, "signup", 0), (h + TTL - 1, "purchase", 0), (h + TTL, "purchase", 0), (h + TTL + RETAIN, "purchase", 0)) == ["ASKED", "FOUND", "EXPIRED", "NOT_FOUND"]
    # rows 0, 3, 6 carry revision 1
    assert said((h, "signup", 1), (2 * h, "view", 1), (3 * h, "view", 1), (4 * h, "click", 0), (5 * h, "click", 1)) == ["ASKED", "OPEN_OFFER", "OPEN_OFFER", "STALE_KNOWLEDGE", "CHANGED"]
    got = said((h, "signup", 0), (2 * h, "purchase", 0), (3 * h, "purchase", 0), (4 * h, "click", 0), (5 * h, "view", 0), (6 * h, "view", 0), (7 * h, "error", 0), (8 * h, "purchase", 0), (9 * h, "click", 0), (10 * h, "click", 0))
    assert got == ["ASKED", "FOUND", "FOUND", "ACCEPTED", "OFFERED", "OPEN_OFFER", "FAILED", "FOUND", "UNBOUND", "CHANGED"]


def test_offers_and_failed_turns_are_bounded():
    state = (0, 0, 0, 0, 0, [])
    state, _ = turn(state, (HOUR, 0, "signup", 0))
    state, (_, outcome, *_) = turn(state, (2 * HOUR, 3, "click", 0))
    assert outcome == "ACCEPTED" and state[2] == 0
    state, (_, outcome, turns, revision, _) = turn(state, (3 * HOUR, 4, "view", 0))
    assert (outcome, turns, revision) == ("OFFERED", 2, 3)
    state, (_, outcome, *_) = turn(state, (4 * HOUR, 5, "click", 0))
    assert outcome == "ACCEPTED"
    assert turn(state, (5 * HOUR, 6, "view", 0))[1][1] == "LIMIT"
    for i in range(30):
        state, values = turn(state, (6 * HOUR + i, 10 + i, "error", 0))
    assert values[-1] == FAILED_MOST and len(state[5]) == FAILED_MOST
    assert forget_context(state) == max(state[4], *state[5]) + RETAIN
    assert forget_context((0, 0, 0, 0, 0, [])) == 0
