"""Problem 2: whole, ordered conversations from message rows.

Rows are ordered by (session, time, message id) in ranges over the cluster, so that a
session of any length is spread over tasks: a range holds a stretch of a session,
and only the last message of each stretch is handed to the next one.

Soundness is decided by a finite-state automaton over the messages that are left::

    start --asker--> asked --answerer--> answered --asker--> asked ...

Any other step, and a message without real text, leads to ``broken``; a session is
sound if it ends in ``answered``. The state after a message that doesn't break follows
from its speaker alone, so each stretch runs the automaton from the message before
it, and the session's verdict is the conjunction of its stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.storage import stage

ASKER, ANSWERER, HELPER, UNKNOWN = "user", "assistant", "helper", "unknown"
#: Spellings by speaker, without case and anything but letters.
SPELLINGS = {
    ASKER: ("user", "human", "customer", "client", "enduser", "person", "asker", "usr", "enquirer", "questioner"),
    ANSWERER: ("assistant", "ai", "bot", "model", "chatbot", "asst", "agent", "aiassistant", "llm"),
    HELPER: ("system", "tool", "function", "developer", "toolcall", "toolresult", "sys"),
}
#: Stand-ins for a missing value, in lower case.
STAND_INS = ("none", "null", "nil", "nan", "nat", "n/a", "na", "#n/a", "<na>", "undefined", "missing", "-", "--", "—", "–", "...", "…", "[]", "{}", '""', "''")
#: Not visible, or white space: Unicode's separators, controls and formats.
_BLANK = r"[\p{Z}\p{Cc}\p{Cf}ᅟᅠㅤﾠ⠀]"


def speaker(role: Column) -> Column:
    """Who spoke: ``user``, ``assistant``, ``helper`` (known, but nobody) or ``unknown``; a null is unknown."""
    plain = F.regexp_replace(F.lower(F.coalesce(role, F.lit(""))), "[^a-z]", "")
    out = F.lit(UNKNOWN)
    for who, names in SPELLINGS.items():
        out = F.when(plain.isin(*names), who).otherwise(out)
    return out


def trimmed(text: Column) -> Column:
    """The text without outer white space and invisible characters; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_BLANK}+|{_BLANK}+$", "")


def real_text(text: Column) -> Column:
    """Whether something visible is left that doesn't merely stand in for a missing value."""
    plain = F.lower(F.regexp_replace(trimmed(text), _BLANK, ""))
    return (plain != "") & ~plain.isin(*STAND_INS)


def conversations(df: DataFrame, session: str = "session_id", role: str = "role", content: str = "content", time: str = "timestamp", sequence: str = "message_id") -> DataFrame:
    """Messages of the sound sessions, in order.

    ``session_id, turn_no INT, message_id, speaker, content``. Rows repeated as a whole
    count once; rows without a session, or with a blank one, belong to none. Helper
    rows are set aside; then a message with the speaker and, but for outer white
    space, the text of the one directly before it is dropped. Null times come first.
    A null role, or one of no known spelling, breaks its session, as does a null,
    invisible or stand-in text. Empty tables give an empty result; other columns
    aren't read.
    """
    rows = df.select(*(F.col(c).alias(a) for c, a in ((session, "session_id"), (role, "role"), (content, "content"), (time, "time"), (sequence, "message_id"))))
    rows = rows.filter("session_id is not null").filter(trimmed(F.col("session_id").cast("string")) != "").distinct()
    rows = rows.select("session_id", "time", "message_id", "content", speaker(F.col("role")).alias("speaker")).filter(F.col("speaker") != HELPER)
    order = ["time", "message_id", "speaker", "content"]
    ranged = stage(rows.repartitionByRange("session_id", *order).withColumn("stretch", F.spark_partition_id()), "messages")
    own = Window.partitionBy("session_id", "stretch").orderBy(*order)
    state = F.struct("speaker", trimmed(F.col("content")).alias("said"))
    rows = ranged.withColumn("state", state).withColumn("before", F.lag("state").over(own)).withColumn("at", F.row_number().over(own))
    # Hand the last message of each stretch to the session's next stretch.
    ends = ranged.withColumn("state", state).groupBy("session_id", "stretch").agg(F.max_by("state", F.struct(*order)).alias("state"))
    by_session = Window.partitionBy("session_id").orderBy("stretch")
    ends = ends.select("session_id", "stretch", F.lag("state").over(by_session).alias("carried"))
    rows = rows.join(ends, ["session_id", "stretch"]).withColumn("before", F.when(F.col("at") == 1, F.col("carried")).otherwise(F.col("before")))
    repeats = F.col("before").isNotNull() & (F.col("before.speaker") == F.col("speaker")) & (F.col("before.said") == F.col("state.said"))
    rows = rows.filter(~repeats)
    last = F.coalesce(F.col("before.speaker"), F.lit("start"))
    step = F.when(last.isin("start", ANSWERER), F.col("speaker") == ASKER).when(last == ASKER, F.col("speaker") == ANSWERER).otherwise(F.lit(False))
    rows = rows.withColumn("sound", step & real_text(F.col("content")))
    stretches = rows.groupBy("session_id", "stretch").agg(F.count("*").alias("n"), F.bool_and("sound").alias("sound"), F.max_by("speaker", F.struct(*order)).alias("last"))
    whole = Window.partitionBy("session_id")
    stretches = (
        stretches.withColumn("all_sound", F.bool_and("sound").over(whole))
        .withColumn("end", F.last("last").over(by_session.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("past", F.coalesce(F.sum("n").over(by_session.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter(F.col("all_sound") & (F.col("end") == ANSWERER))
        .select("session_id", "stretch", "past")
    )
    kept = rows.join(stretches, ["session_id", "stretch"])
    number = F.row_number().over(own) + F.col("past")
    return kept.select("session_id", number.cast("int").alias("turn_no"), "message_id", "speaker", "content")
