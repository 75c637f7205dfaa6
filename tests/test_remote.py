"""Calls of a service: order, how many at once, pauses and what they are for, refusals."""

from __future__ import annotations

import threading
import time

import pyarrow as pa
import pytest

from corpusloom.operators import remote as C


def test_pauses_grow_and_end():
    again = C.Again(times=9, first=1, factor=2, longest=5, jitter=0.5)
    for failed, least in ((1, 1), (2, 2), (3, 4), (4, 5), (8, 5)):
        assert all(least <= again.pause(failed) <= 1.5 * least for _ in range(50))


def test_only_passing_errors_are_tried_again():
    calls = []

    def service(errors):
        left = list(errors)

        def call(texts):
            calls.append(texts)
            if left:
                raise left.pop(0)
            return [len(t) for t in texts]

        return call

    ask = lambda errors, **more: C.answered(service(errors), ["a", "bb"], threading.Semaphore(1), C.Again(times=3, **more), lambda s: None)
    assert ask([C.RemoteError(503), TimeoutError()]) == [1, 2] and len(calls) == 3
    for errors, error in (([C.RemoteError(404)], C.RemoteError), ([ValueError()], ValueError), ([ConnectionError()] * 3, ConnectionError)):
        calls.clear()
        with pytest.raises(error):
            ask(errors)
        assert len(calls) == len(errors)
    assert ask([RuntimeError("Too Many requests")], when=C.saying("too many|429")) == [1, 2]
    with pytest.raises(ValueError, match="1 answers to 2 texts"):
        C.answered(lambda texts: [0], ["a", "b"], threading.Semaphore(1), C.Again())


def test_a_pause_holds_no_permit():
    """While one request waits to be made again, another is made."""
    permits, made = threading.Semaphore(1), []

    def busy(texts):
        made.append("busy")
        if made.count("busy") == 1:
            raise TimeoutError
        return texts

    def sleep(_):
        assert C.answered(lambda texts: texts, ["other"], permits, C.Again()) == ["other"]
        made.append("other")

    assert C.answered(busy, ["x"], permits, C.Again(), sleep) == ["x"] and made == ["busy", "other", "busy"]


def test_answers_keep_their_rows(spark):
    """Late answers to early texts, nulls among them, requests of several texts, and columns with clashing names."""

    def connect():
        now, lock, most = [0], threading.Lock(), [0]

        def service(texts):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.02 if texts[0].endswith("0") else 0.001)
            with lock:
                now[0] -= 1
            return [f"{t}!{most[0] <= 3}" for t in texts]

        return service

    rows = [(i, None if i % 7 == 0 else f"t{i}", "own") for i in range(100)]
    df = spark.createDataFrame(rows, "i int, text string, Answer string").coalesce(1)
    got = C.called(df, "text", connect, pa.string(), size=4, at_once=3).collect()
    assert [(r.i, r.answer, r.error) for r in got] == [(i, None if t is None else f"{t}!True", None) for i, t, _ in rows]
    assert C.called(df.limit(0), "text", connect, pa.string()).count() == 0


def test_refusals_fail_or_leave_rows_empty(spark):
    def connect():
        def service(texts):
            if "bad" in texts:
                raise C.RemoteError(400, "no")
            return [1.0] * len(texts)

        return service

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "bad"), (4, "c"), (5, "d")], "i int, text string").coalesce(1)
    got = {r.i: (r.answer, r.error) for r in C.called(df, "text", connect, pa.float64(), size=2, empty=True).collect()}
    assert got == {1: (1.0, None), 2: (1.0, None), 3: (None, "400 no"), 4: (None, "400 no"), 5: (1.0, None)}
    with pytest.raises(Exception, match="400 no"):
        C.called(df, "text", connect, pa.float64(), size=2).collect()
