"""Windows of calls: how many are open, what a restart asks again, failures."""

import json
import os
import threading
import time

import pytest

from pairloom.streaming import calls


def prompts(spark, n):
    return spark.createDataFrame([(f"k{i:03d}", f"p {i}") for i in range(n)], "key string, prompt string")


def test_a_window_keeps_calls_in_flight():
    open_, most, lock = 0, 0, threading.Lock()

    def slow(p):
        nonlocal open_, most
        with lock:
            open_ += 1
            most = max(most, open_)
        time.sleep(0.02)
        with lock:
            open_ -= 1
        return p.upper()

    taken = []

    def items():
        for i in range(60):
            taken.append(i)
            yield str(i), f"a{i}"

    start, got = time.monotonic(), {}
    for k, v in calls.window(items(), slow, 12, calls.Pace(None)):
        got[k] = v
        assert len(taken) - len(got) <= 12  # items are taken as answers come
    assert got == {str(i): f"A{i}" for i in range(60)}
    assert most == 12 and time.monotonic() - start < 60 * 0.02 / 3


def test_a_pace_limits_calls():
    start = time.monotonic()
    list(calls.window(((str(i), "x") for i in range(11)), lambda p: p, 8, calls.Pace(50)))
    assert time.monotonic() - start >= 10 / 50


def test_slow_calls_of_a_table(spark, tmp_path):
    def service(prompt):
        time.sleep(0.2)
        return '```json\n{"n": %d}\n```' % len(prompt)

    start = time.monotonic()
    got = {r.key: json.loads(r.response) for r in calls.ask_into(prompts(spark, 200), "key", "prompt", str(tmp_path / "log"), service, in_flight=10, tasks=4).collect()}
    assert got == {f"k{i:03d}": {"n": len(f"p {i}")} for i in range(200)}
    assert time.monotonic() - start < 200 * 0.2  # one at a time would take as long


def test_a_lost_task_asks_only_what_is_open(spark, tmp_path):
    """The first attempt dies half-way; what it had kept is not asked again, by the next run."""
    seen = str(tmp_path / "seen")
    os.makedirs(seen)

    def service(prompt, fail=True):
        with open(f"{seen}/{prompt.replace(' ', '-')}", "a") as f:
            f.write("x")
        if fail and prompt == "p 57":
            os._exit(1)  # the worker is gone
        return "{}"

    log, df = str(tmp_path / "log"), prompts(spark, 100)
    with pytest.raises(Exception, match="."):
        calls.ask_into(df, "key", "prompt", log, service, in_flight=2, flush=5, tasks=1).collect()
    kept = {r.key for r in calls.answers(spark, log).collect()}
    assert 20 <= len(kept) < 100
    out = calls.ask_into(df, "key", "prompt", log, lambda p: service(p, False), in_flight=2, flush=5, tasks=1)
    assert out.count() == 100
    twice = {f.replace("p-", "k").zfill(3) for f in os.listdir(seen) if os.path.getsize(f"{seen}/{f}") > 1}
    assert len(twice) <= 5 + 2 + 2  # a flush's worth and the window


def test_an_attempt_reads_the_log_of_the_one_before(tmp_path):
    log = calls.Log(str(tmp_path / "t"), 3)
    assert log.keys() == set()
    for i in range(7):
        log.add(f"k{i}", None if i == 2 else "{}")
    assert log.keys() == {f"k{i}" for i in range(6)}  # the seventh is held
    log.close()
    assert calls.Log(str(tmp_path / "t"), 3).keys() == {f"k{i}" for i in range(7)}


def test_failures_are_asked_again(spark, tmp_path):
    log = str(tmp_path / "log")
    df = prompts(spark, 9).union(spark.createDataFrame([("none", None)], "key string, prompt string"))
    first = calls.ask_into(df, "key", "prompt", log, lambda p: "no json" if p == "p 4" else "{}", retries=2, pause=0.0)
    assert {r.key for r in first.collect() if not r.ok} == {"k004"} and first.count() == 9
    again = calls.ask_into(df, "key", "prompt", log, lambda p: '{"again": 1}', pause=0.0)
    assert {r.key: r.response for r in again.collect()} == {f"k{i:03d}": '{"again": 1}' if i == 4 else "{}" for i in range(9)}
    assert calls.answers(spark, str(tmp_path / "none")).count() == 0
