import datetime as dt

import numpy as np

from veldra.llm.conversations import conversations

SCHEMA = "session_id string, role string, content string, timestamp timestamp, message_id bigint, speaker string"
T = dt.datetime(2024, 1, 1)


def rows(session, *messages):
    return [(session, r, c, T + dt.timedelta(seconds=s), i, "clash") for i, (r, c, s) in enumerate(messages, 1)]


def run(spark, data):
    got = {}
    for r in conversations(spark.createDataFrame(data, SCHEMA)).orderBy("session_id", "turn_no").collect():
        got.setdefault(r.session_id, []).append((r.turn_no, r.message_id))
    return got


def test_rules(spark):
    data = [
        *rows("fine", ("User", "a", 1), ("bot", "b", 2), (" HUMAN ", "c", 3), ("AI", "d", 4)),
        *rows("late", ("assistant", "b", 2), ("user", "a", 1)),
        *rows("ties", ("user", "a", 1), ("assistant", "b", 1)),
        *rows("again", ("user", "a", 1), ("tool", "x", 2), ("user", " a\n", 3), ("assistant", "b", 4), ("assistant", "b", 5)),
        *rows("twice", ("user", "a", 1), ("user", "other", 2), ("assistant", "b", 3)),
        *rows("open", ("user", "a", 1)),
        *rows("answer first", ("assistant", "b", 1), ("user", "a", 2), ("assistant", "b", 3)),
        *rows("who", ("user", "a", 1), ("?", "b", 2)),
        *rows("null role", ("user", "a", 1), (None, "b", 2)),
        *rows("empty", ("user", "a", 1), ("assistant", " ​﻿", 2)),
        *rows("null text", ("user", None, 1), ("assistant", "b", 2)),
        *rows("stand-in", ("user", " N/A ", 1), ("assistant", "b", 2)),
        *rows("no", ("user", "no", 1), ("assistant", "ok", 2)),
        *rows("helpers", ("system", "x", 1)),
        *rows(None, ("user", "a", 1), ("assistant", "b", 2)),
        *rows(" ", ("user", "a", 1), ("assistant", "b", 2)),
    ]
    got = run(spark, data + data[:2])
    assert got == {"fine": [(1, 1), (2, 2), (3, 3), (4, 4)], "late": [(1, 2), (2, 1)], "ties": [(1, 1), (2, 2)], "again": [(1, 1), (2, 4)], "no": [(1, 1), (2, 2)]}


def test_a_session_over_many_ranges(spark):
    """One session holds most rows; its stretches have to number and judge as one."""
    big = [("big", "user" if i % 2 == 0 else "assistant", f"m{i}", T + dt.timedelta(seconds=i // 3), i, "") for i in range(4000)]
    broken = [("broken", *m[1:]) for m in big if m[4] != 2001]
    small = [m for k in range(50) for m in rows(f"s{k}", ("user", "a", 1), ("assistant", "b", 2))]
    data = big + broken + small
    order = np.random.default_rng(0).permutation(len(data))
    got = run(spark, [data[i] for i in order])
    assert got["big"] == [(i + 1, i) for i in range(4000)]
    assert "broken" not in got and len(got) == 51


def test_long_text_and_empty_table(spark):
    long = "x" * 300_000
    assert run(spark, rows("s", ("user", long, 1), ("assistant", long, 2))) == {"s": [(1, 1), (2, 2)]}
    assert run(spark, []) == {}
