"""Chat exports: one line of text a row, in the three layouts that phones and desktops write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the formats: a date in words or with dots, a clock of two halves, a speaker before a colon.
DAY_WORDS = r"(\d+)년 *(\d+)월 *(\d+)일"
DAY_DOTS = r"(\d+)\. *(\d+)\. *(\d+)\."
MORNING, AFTERNOON = "오전", "오후"
CLOCK = rf"({MORNING}|{AFTERNOON}) *(\d+):(\d\d)"
SPEAKER = r"([^:]*[^:\s])\s*:\s*(.*)"
#: Phones write it all on one line; groups: year, month, day, half, hour, minute, who, message.
PHONES = [f"^{day} *{CLOCK}, *{SPEAKER}$" for day in (DAY_WORDS, DAY_DOTS)]
#: On desktops the date stands on a line of its own; groups of a message: who, half, hour, minute, message.
RULE = f"^---+ *{DAY_WORDS}.*---+ *$"
DESK = rf"^\[([^\]]+)\] *\[{CLOCK}\]\s*(.*)$"
#: Lines that only note media or a deleted message, and endings of those that note who came or went; a full stop may follow.
NOTES = ["사진", "동영상", "이모티콘", "삭제된 메시지입니다"]
MOVES = ["님이 들어왔습니다", "님이 나갔습니다"]


def is_note(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\.$", "")
    found = bare.isin(NOTES)
    for ending in MOVES:
        found |= F.endswith(bare, F.lit(ending))
    return found


def parse(lines: DataFrame) -> DataFrame:
    """lines: file, pos, line. Messages: file, pos (of the first line), who, sent (timestamp_ntz), text; lines without a head go on with
    the message before, lines that only note media or members are dropped, and lines before the first message are left out."""
    line = F.col("line")

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(line, pattern, i)

    def full(pattern: str) -> Column:
        return F.struct(*(group(pattern, i).alias(n) for i, n in enumerate(("y", "mo", "d", "half", "h", "mi", "who", "text"), 1)))

    day = F.when(line.rlike(RULE), F.struct(*(group(RULE, i).alias(n) for i, n in enumerate(("y", "mo", "d"), 1))))
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dated = lines.withColumn("day", F.last(day, ignorenulls=True).over(order))
    desk = F.struct(F.col("day.y").alias("y"), F.col("day.mo").alias("mo"), F.col("day.d").alias("d"), group(DESK, 2).alias("half"), group(DESK, 3).alias("h"), group(DESK, 4).alias("mi"), group(DESK, 1).alias("who"), group(DESK, 5).alias("text"))
    head = F.when(line.rlike(DESK) & F.col("day").isNotNull(), desk)
    for pattern in PHONES:
        head = head.when(line.rlike(pattern), full(pattern))
    marked = dated.filter(~line.rlike(RULE)).withColumn("head", head).withColumn("message", F.last(F.when(F.col("head").isNotNull(), F.col("pos")), ignorenulls=True).over(order))
    said = marked.filter("message IS NOT NULL").withColumn("said", F.coalesce(F.col("head.text"), line)).filter(~is_note(F.col("said")))
    whole = said.groupBy("file", "message").agg(F.max("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda s: s["said"]), "\n").alias("text"))
    h = F.col("head")
    hour = F.col("head.h").cast("int") % 12 + F.when(h["half"] == AFTERNOON, 12).otherwise(0)
    sent = F.make_timestamp_ntz(h["y"].cast("int"), h["mo"].cast("int"), h["d"].cast("int"), hour, h["mi"].cast("int"), F.lit(0))
    return whole.filter("head IS NOT NULL").select("file", F.col("message").alias("pos"), h["who"].alias("who"), sent.alias("sent"), "text")


def summary(messages: DataFrame) -> DataFrame:
    """One row a file: who took part, how many messages, and from when to when."""
    return messages.groupBy("file").agg(F.array_sort(F.collect_set("who")).alias("participants"), F.count("*").alias("message_count"), F.min("sent").alias("period_start"), F.max("sent").alias("period_end"))
