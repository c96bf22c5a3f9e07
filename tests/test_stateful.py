"""State that ends: time to live, idle clients, samples at fixed times, in streams of files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import rate_limit, stateful

STORE = next(iter(stateful.STORE))


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, stateful.STORE[STORE])
    yield spark
    spark.conf.set(STORE, old)


def files(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def step(frame, out, checkpoint):
    """One run over what is there, gathered in ``out``; the state stays in the checkpoint."""
    q = frame.writeStream.foreachBatch(lambda rows, _: out.extend(rows.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    done = q.awaitTermination(30)
    q.stop()
    assert done
    return q


def state_rows(query):
    return sum(x["numRowsTotal"] for x in query.lastProgress["stateOperators"])


def test_answers_are_gone_after_their_time(rocks, tmp_path):
    quiet = "spark.sql.streaming.noDataMicroBatches.enabled"  # else a stream in processing time runs empty batches for ever
    rocks.conf.set(quiet, "false")
    try:
        answers_are_gone(rocks, tmp_path)
    finally:
        rocks.conf.unset(quiet)


def answers_are_gone(rocks, tmp_path):
    schema = "key string, call_id long, ts timestamp, reply string, cost_usd double"
    at = lambda i, key, reply: {"key": key, "call_id": i, "ts": f"2024-01-01T00:00:{i:02d}", "reply": reply, "cost_usd": i / 10}
    files(tmp_path / "in", "1.json", [at(1, "k", "first"), at(2, "k", "second"), at(3, "q", "other"), at(4, None, "no key")])
    calls = stateful.cached_stream(rocks.readStream.schema(schema).json(str(tmp_path / "in")), ttl_seconds=6)
    out = []
    step(calls, out, tmp_path / "c")
    read = lambda: {r["call_id"]: (r["reply"], r["cost_usd"], r["hit"]) for r in out}
    assert read() == {1: ("first", 0.1, False), 2: ("first", 0.1, True), 3: ("other", 0.3, False)}
    time.sleep(7)
    files(tmp_path / "in", "2.json", [at(5, "k", "new"), at(6, "k", "newer")])
    step(calls, out, tmp_path / "c")
    assert read()[5] == ("new", 0.5, False) and read()[6] == ("new", 0.5, True) and len(out) == 5


def test_idle_clients_leave_no_state(rocks, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    at = lambda i, user, second: {"user_id": user, "event_id": i, "ts": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}"}
    first = [at(1, 7, 0), at(2, 7, 1), at(3, 7, 2), at(4, 8, 2), at(5, 7, 59)]
    files(tmp_path / "in", "1.json", first)
    events = stateful.limited_stream(rocks.readStream.schema(schema).json(str(tmp_path / "in")), 2)
    out = []
    assert state_rows(step(events, out, tmp_path / "c")) > 0
    second = [at(6, 9, 62), at(7, 7, 62), at(8, 7, 63)]
    files(tmp_path / "in", "2.json", second)
    step(events, out, tmp_path / "c")
    rows = rocks.createDataFrame([json.dumps(x) for x in first + second], "string").select(F.from_json("value", schema).alias("x")).select("x.*")
    assert {r["event_id"]: r["allowed"] for r in out} == {r["event_id"]: r["allowed"] for r in rate_limit.limit_batch(rows, 2).collect()}
    files(tmp_path / "in", "3.json", [at(9, 10, 600)])
    step(events, out, tmp_path / "c")
    files(tmp_path / "in", "4.json", [at(10, 10, 601)])
    assert state_rows(step(events, out, tmp_path / "c")) <= 4  # the one client that isn't idle: its times, its timer and the timer's place in time


def test_samples_come_at_the_timers(rocks, tmp_path):
    schema = "source string, event_id long, ts timestamp, value double"
    at = lambda i, source, second, value: {"source": source, "event_id": i, "ts": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}", "value": value}
    files(tmp_path / "in", "1.json", [at(1, "a", 3, 5.0), at(2, "a", 8, 2.0), at(3, "b", 12, 1.0)])
    events = stateful.sampled_stream(rocks.readStream.schema(schema).json(str(tmp_path / "in")), 10, idle=2)
    out = []
    step(events, out, tmp_path / "c")
    files(tmp_path / "in", "2.json", [at(4, "a", 15, 9.0), at(5, "b", 16, 4.0)])
    step(events, out, tmp_path / "c")
    files(tmp_path / "in", "3.json", [at(6, "c", 99, 0.0)])
    step(events, out, tmp_path / "c")
    zero = 1704067200000
    got = sorted((r["source"], (r["at_ms"] - zero) // 1000, r["n"], r["last"], r["peak"]) for r in out)
    a = [x for x in got if x[0] == "a"]
    assert a[0] == ("a", 10, 2, 2.0, 5.0) and ("a", 20, 3, 9.0, 9.0) in a and all(s % 10 == 0 for _, s, *_ in got)
    assert ("b", 20, 2, 4.0, 4.0) in got and len({x[:2] for x in got}) == len(got)
