import datetime as dt

from pyspark.sql import functions as F

from pitlake.llm.conversations import conversations, folded

S = "message_id string, run_id string, seq int, sender string, created_at timestamp, payload string, in_reply_to array<string>, version int, gone boolean, turn string"
ROLES = [("planner", "requester"), ("news_analyst", "analyst"), ("calculator_tool", "tool"), ("planner", "requester"), (None, "tool")]
T = dt.datetime(2024, 1, 1)


def row(m, run, seq, sender, content='{"content": "x"}', to=(), version=0, gone=False):
    return (m, run, seq, sender, T, content, None if to is None else list(to), version, gone, "clash")


def run(spark, rows, **k):
    r = spark.createDataFrame(ROLES, "sender string, speaker_role string")
    got = conversations(spark.createDataFrame(rows, S), r, **k).collect()
    return sorted((x.run_id, x.turn, x.message_id, x.speaker_role) for x in got)


def pair(run_id, **k):
    """A sound run of two."""
    return [row(f"{run_id}1", run_id, 1, k.get("asker", "planner"), k.get("ask", '{"content": "q"}')), row(f"{run_id}2", run_id, 2, k.get("answerer", "news_analyst"), k.get("answer", '{"v": 2, "content": "a"}'), k.get("to", [f"{run_id}1"]))]


def test_sound_and_damaged(spark):
    rows = pair("ok") + pair("case", asker="  Planner", answerer="News Analyst ") + pair("unknown", answerer="nobody")
    rows += pair("blank", answer='{"content": " \\n\\t "}') + pair("bare", answer="{}") + pair("null", answer=None) + pair("broken", answer="{oops") + pair("nullc", answer='{"content": null}')
    rows += pair("norole", asker="news_analyst") + pair("self", answerer="planner") + pair("noreply", to=[]) + pair("nullreply", to=None)
    rows += pair("dangling", to=["dangling1", "ghost"]) + pair("foreign", to=["foreign1", "ok1"]) + pair("nullid", to=["nullid1", None]) + pair("forward", to=["forward1", "forward2"])
    rows += [row("g1", "gap", 1, "planner"), row("g3", "gap", 3, "news_analyst", to=["g1"])]
    rows += pair("clash") + [row("clash3", "clash", 2, "news_analyst", to=["clash1"])]
    rows += pair("zero")[1:] + pair("nullseq") + [row("nullseq3", "nullseq", None, "news_analyst")] + [row("n1", None, 1, "planner"), row(None, "nomsg", 1, "planner")]
    rows += rows[:3]  # repeated
    sound = ["ok", "case", "unknown"]
    role2 = {"ok": "analyst", "case": "analyst", "unknown": None}
    want = sorted((s, i, f"{s}{i}", "requester" if i == 1 else role2[s]) for s in sound for i in (1, 2))
    assert sorted(run(spark, rows), key=str) == sorted(want, key=str)


def test_long_and_hot_runs(spark):
    n = 3000
    rows = [row("h1", "hot", 1, "planner")] + [row(f"h{i}", "hot", i, "news_analyst", '{"content": "' + "x" * 10 + '"}', ["h1"]) for i in range(2, n + 1)]
    big = pair("big", answer='{"content": "' + "y" * 300_000 + '"}')
    got = run(spark, rows + big)
    assert len(got) == n + 2 and {x[0] for x in got} == {"hot", "big"}


def test_edits_deletes_and_retries(spark):
    rows = pair("e") + [row("e2", "e", 2, "news_analyst", "{}", ["e1"], version=-1), row("e2", "e", 2, "news_analyst", '{"content": "new"}', ["e1"], version=3)]
    rows += [row("e3", "e", 3, "news_analyst", to=["e1"]), row("e3", "e", 3, "news_analyst", to=["e1"], version=2, gone=True)]
    assert [x[:3] for x in run(spark, rows, version=F.col("version"), deleted=F.col("gone"))] == [("e", 1, "e1"), ("e", 2, "e2")]
    df = folded(spark.createDataFrame(rows, S), "message_id", F.col("version"), {"payload": F.col("payload")}, F.col("gone"))
    assert {r.message: r.payload for r in df.collect()} == {"e1": '{"content": "q"}', "e2": '{"content": "new"}'}


def test_empty(spark):
    assert run(spark, []) == []
