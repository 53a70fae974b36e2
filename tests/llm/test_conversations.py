import json

from quernel.llm import conversations as c

SESSIONS = "id bigint, session_id string, number int, block int"
MESSAGES = "id bigint, session_id bigint, type string, text_content string, content string, sequence int, number int"
LINES = "line_id bigint, rollout_id string, line_no int, line_ts string, type string, payload string, kind string"


def talk(spark, sessions, messages):
    s = spark.createDataFrame([(i, n, 1, 1) for i, n in sessions], SESSIONS)
    m = spark.createDataFrame([(*r, 1) for r in messages], MESSAGES)
    return s, m


def test_sessions(spark):
    sessions = [(1, "ok"), (2, "gap"), (3, "unanswered"), (4, "empty"), (5, "twice"), (6, "assistant first"), (7, "zeros"), (8, "copies"), (9, None), (10, "blank")]
    messages = [
        (10, 1, " User", "hi", None, 5), (11, 1, "assistant", "yo", None, 6), (12, 1, "tool", None, "{}", 7),
        (20, 2, "user", "hi", None, 1), (21, 2, "assistant", "yo", None, 3),
        (30, 3, "user", "hi", None, 1), (31, 3, "assistant", " ", None, 2),
        (50, 5, "user", "hi", None, 1), (51, 5, "user", "again", None, 2), (52, 5, "assistant", "yo", None, 3),
        (60, 6, "assistant", "yo", None, 1), (61, 6, "user", "hi", None, 2), (62, 6, "assistant", "yo", None, 3),
        (71, 7, "assistant", "yo", None, None), (70, 7, "user", "hi", None, 0),
        (80, 8, "user", "hi", None, 1), (81, 8, "assistant", "yo", None, 2), (82, 8, "assistant", "yo", None, 2),
        (90, 9, "user", "hi", None, 1), (99, 77, "user", "lost", None, 1), (98, None, "user", "lost", None, 1),
        (100, 10, None, "hi", None, 1), (101, 10, "user", " \n", None, 2),
    ]
    s, m = talk(spark, sessions, messages)
    assert {r.conv_id for r in c.dropped_sessions(s, m).collect()} == {"gap", "unanswered", "empty", "twice", "assistant first", "blank"}
    turns = c.kept_turns(c.session_lines(s, m), c.dropped_sessions(s, m)).orderBy("conv_id", "turn_no").collect()
    assert [(t.conv_id, t.turn_no, t.role, t.text) for t in turns if t.conv_id == "ok"] == [("ok", 1, "user", "hi"), ("ok", 2, "assistant", "yo")]


def test_long_sessions_span_blocks(spark):
    rows = [(k, 1, "user" if k % 2 == 0 else "assistant", f"t{k}", None, k) for k in range(5000)] + [(10_000 + k, 2, "user" if k in (0, 999, 1000) else "assistant", f"t{k}", None, k) for k in range(3000)]
    s, m = talk(spark, [(1, "a"), (2, "b")], rows)
    assert [r.conv_id for r in c.dropped_sessions(s, m).collect()] == ["b"]
    turns = c.kept_turns(c.session_lines(s, m), c.dropped_sessions(s, m)).orderBy("turn_no").collect()
    assert [t.text for t in turns] == [f"t{k}" for k in range(5000)] and [t.turn_no for t in turns] == list(range(1, 5001))


def message(role, *texts):
    return json.dumps({"type": "message", "role": role, "content": [{"type": "output_text" if role == "assistant" else "input_text", "text": t} for t in texts]})


def rollout(spark, **lines):
    rows, k = [], 0
    for name, own in lines.items():
        for no, kind, payload in own:
            rows.append((k, name, no, None, kind, payload, "x"))
            k += 1
    return {r.conv_id for r in c.dropped_rollouts(spark.createDataFrame(rows, LINES)).collect()}


def test_rollouts(spark):
    meta = (0, "session_meta", "{}")
    talk_ = [(1, "response_item", message("user", "<environment_context>x</environment_context>", "hi")), (2, "response_item", message("Assistant ", "yo"))]
    start, end = json.dumps({"type": "task_started", "turn_id": "t"}), json.dumps({"type": "task_complete", "turn_id": "t"})
    dropped = rollout(
        spark,
        ok=[meta, *talk_, (2, *talk_[1][1:]), (3, "event_msg", start), (4, "event_msg", end)],
        open=[meta, *talk_, (3, "event_msg", start)],
        gap=[meta, *talk_, (4, "event_msg", "{}")],
        late=talk_,
        cut=[(0, "session_meta", '{"id":"x'), *talk_],
        env=[meta, (1, "response_item", message("user", "<environment_context>x</environment_context>")), (2, "response_item", message("assistant", "yo"))],
        broken=[meta, talk_[0], (2, "response_item", talk_[1][2][:-9])],
        nulls=[meta, *talk_, (None, None, None)],
        odd=[meta, *talk_, (3, "response_item", "[1, 2]"), (4, "event_msg", '"text"'), (5, "response_item", json.dumps({"type": "message", "role": 3, "content": "x"}))],
    )
    assert dropped == {"open", "gap", "late", "cut", "env", "broken", "nulls"}


def test_empty_tables(spark):
    s, m = talk(spark, [], [])
    assert c.dropped_sessions(s, m).count() == 0
    assert c.dropped_rollouts(spark.createDataFrame([], LINES)).count() == 0


def test_split_at_gaps(spark):
    at = [0, 60, 120, 9000, 9060, 40_000]
    rows = spark.createDataFrame([("a", k, t) for k, t in enumerate(at)] + [("b", 9, None)], "who string, k int, t bigint").selectExpr("who", "k", "timestamp_seconds(t) as at")
    got = {(r.who, r.k): r.part for r in c.split_at_gaps(rows, ["who"], "at", 3600).collect()}
    assert [got["a", k] for k in range(6)] == [0, 0, 0, 1, 1, 2] and got["b", 9] == 0
    assert c.split_at_gaps(rows, ["who"], "at").count() == 7


def test_payloads_read_both_ways_alike(spark):
    """What the variant reader takes comes out as the Python reader has it; what it refuses falls to the latter."""
    odd = [
        message("user", "hi"), message("Assistant", " ", "a", "<environment_context>x</environment_context>b"), '{"type":"message","role":3,"content":"x"}', '{"type":"message","content":[1,"a",{"type":"input_text","text":5}]}',
        '{"a":1,"a":2,"type":"event"}', '{"type":"task_started","turn_id":"t"}', '{"type":"x","turn_id":7}', "[1]", '"text"', "{", "", None, "null", '{"type":"message","content":[{"type":"output_text","text":"<environment_context>open"}]}',
    ]
    rows = spark.createDataFrame([(k, "c", k + 1, None, "response_item", p, "x") for k, p in enumerate(odd)], LINES)
    got = {r.tie: (r.valid, r.kind, r.turn_id, r.text) for r in c.rollout_lines(rows).collect()}
    for k, p in enumerate(odd):
        valid, kind, _, turn, text = c._payload(p)
        assert got[k] == (valid, kind, turn, text), p


def gapped(spark, rows):
    return spark.createDataFrame(rows, "channel string, t bigint, tie bigint, role string, hint string, text string, part int").selectExpr("channel", "timestamp_seconds(t) as at", "tie", "role", "hint", "text", "part as extra")


def test_rebuilt_at_gaps(spark):
    rows = [
        ("a", 0, 1, "User", None, "q1"), ("a", 10, 2, None, "assistant", "r1"), ("a", 20, 3, None, None, "q2"), ("a", 30, 4, "", None, "r2"), ("a", 30, 9, "", None, "r2"),
        ("a", 90_000, 5, "user", None, "no reply"), ("a", 90_010, 6, "developer", None, "rules"), ("a", 200_000, 7, None, None, "guess"), ("a", 200_001, 8, None, None, "guess back"),
        ("b", 86_390, 10, "user", None, "over"), ("b", 86_410, 11, "assistant", None, "midnight"), ("b", None, 12, "user", None, "lost"), ("c", 5, 13, "user", None, " "), (None, 0, 14, "user", None, "x"), (None, 1, 15, "assistant", None, "y"),
    ]
    got = c.rebuilt_at_gaps(gapped(spark, [(*r, 1) for r in rows]).drop("extra"), ["channel"], "at", 3600).collect()
    turns = {(r.channel, r.part, r.turn_no): (r.speaker, r.text) for r in got}
    assert turns == {
        ("a", 0, 1): ("user", "q1"), ("a", 0, 2): ("assistant", "r1"), ("a", 0, 3): ("user", "q2"), ("a", 0, 4): ("assistant", "r2"), ("a", 2, 1): ("user", "guess"), ("a", 2, 2): ("assistant", "guess back"),
        ("b", 0, 1): ("user", "over"), ("b", 0, 2): ("assistant", "midnight"),
    }
    assert c.rebuilt_at_gaps(gapped(spark, []), ["channel"], "at").count() == 0
