"""Clarification contexts of a session: what each turn does to one."""

from __future__ import annotations

HOUR = 3_600_000_000
#: Life of a context after its question or last selection, and how long an ended one and failed turns are known after that (microseconds).
TTL, RETAIN = 24 * HOUR, 48 * HOUR
TURNS_MOST, FAILED_MOST = 2, 10


def turn(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """state: turns (0: no context), revision, time of the open offer (0: none), knowledge, end, times of failed turns. row: time, event_id, event_type, known."""
    turns, revision, offered, knowledge, expires, failed = state
    now, event_id, event_type, known = row
    failed = [x for x in failed if x > now - RETAIN]
    if turns and now >= expires + RETAIN:
        turns = revision = offered = knowledge = expires = 0
    if event_type == "signup":
        said, turns, revision, offered, knowledge, expires = "ASKED", 1, 1, now, known, now + TTL
    elif event_type == "error":
        said, failed = "FAILED", [*failed, now][-FAILED_MOST:]
    elif not turns:
        said = "NOT_FOUND"
    elif expires <= now:
        said = "EXPIRED"
    elif event_type == "purchase":
        said = "FOUND"
    elif event_type == "view":
        if offered:
            said = "OPEN_OFFER"
        elif turns >= TURNS_MOST:
            said = "LIMIT"
        else:
            said, turns, revision, offered = "OFFERED", turns + 1, revision + 1, now
    elif known < knowledge:
        said = "STALE_KNOWLEDGE"
    elif revision != 1 + event_id % 3:
        said = "CHANGED"
    elif not offered:
        said = "NO_OFFER"
    elif any(x > offered for x in failed):
        said = "UNBOUND"
    else:
        said, revision, offered, knowledge, expires = "ACCEPTED", revision + 1, 0, known, now + TTL
    return (turns, revision, offered, knowledge, expires, failed), (event_id, said, turns, revision, len(failed))


def forget_context(state: tuple) -> int | None:
    """When neither the context nor a failed turn is known any more."""
    turns, _, _, _, expires, failed = state
    return max([expires if turns else -RETAIN, *failed]) + RETAIN
