"""Delivery of notifications to the devices of their recipients: what each request does at one device, and the fold over devices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers of a push service that end a subscription; those below 300 are success.
GONE, SENT_BELOW = (404, 410), 300
REQUESTED, FAILED, PENDING, OFF, JOINED = "REQUESTED", "FAILED", "PENDING", "OFF", "JOINED"
#: In place of a notification: the device subscribes again.
NONE = -1
#: A device's state: whether it takes messages, and the notifications that it has got. They are known as long as the device, so that none comes twice.
STATE, START = "enabled boolean, got array<long>", (True, [])


def deliver(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """row: time, event_id, notification, answer (the service's, should it be asked)."""
    (enabled, got), (_, event_id, notification, answer) = state, row
    if notification == NONE:
        return (True, got), (event_id, NONE, JOINED, False)
    if not enabled:
        return state, (event_id, notification, OFF, False)
    if notification in got:
        return state, (event_id, notification, REQUESTED, False)
    if answer < SENT_BELOW:
        return (enabled, [*got, notification]), (event_id, notification, REQUESTED, True)
    return (answer not in GONE, got), (event_id, notification, FAILED, True)


def folded(outcomes: DataFrame) -> DataFrame:
    """outcomes: notification, event_id, at, said, sent. For each notification: status (after the last request that met an enabled device: requested if one device has it, failed if
    all failed; pending without any), requests, attempts (device by device) and sends. Counts and maxima combine before the shuffle."""
    run = outcomes.filter(F.col("notification") != NONE).groupBy("notification", "event_id").agg(
        F.max("at").alias("at"), F.count(F.when(F.col("said") != OFF, 1)).alias("tried"), F.count(F.when(F.col("said") == REQUESTED, 1)).alias("got"), F.count(F.when(F.col("sent"), 1)).alias("sends")
    )
    last = F.max(F.when(F.col("tried") > 0, F.struct("at", "event_id", "got")))
    return run.groupBy("notification").agg(
        F.when(last.isNull(), PENDING).when(last["got"] > 0, REQUESTED).otherwise(FAILED).alias("status"), F.count("*").alias("requests"), F.sum("tried").alias("attempts"), F.sum("sends").alias("sends")
    )
