"""Calls of a remote service from tasks: some at once, in order, again after a pause where that may help.

What a service is comes from a factory that runs in each task, so clients are never shipped. A task that is lost is run
again by Spark like any other; a service should take the same request twice.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Semaphore

import pyarrow as pa
from pyspark.sql import DataFrame

#: A service takes some texts and gives as many answers, in their order.
Service = Callable[[list[str]], list]


class RemoteError(Exception):
    """A service's refusal, with the status of its answer."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status


def passing(error: Exception) -> bool:
    """Errors that may be gone later: of the network, time-outs, and the service's own (5xx)."""
    return isinstance(error, (ConnectionError, TimeoutError)) or (isinstance(error, RemoteError) and error.status >= 500)


def saying(pattern: str) -> Callable[[Exception], bool]:
    """Errors whose message matches, such as of a limit of requests."""
    return lambda error: bool(re.search(pattern, str(error), re.IGNORECASE))


@dataclass(frozen=True)
class Again:
    """How often a call is made at most, and the pauses between: `first` seconds, each `factor` times the one before up to `longest`, and up to `jitter` of itself more."""

    times: int = 4
    first: float = 0.25
    factor: float = 2.0
    longest: float = 8.0
    jitter: float = 0.2
    when: Callable[[Exception], bool] = passing

    def pause(self, failed: int) -> float:
        return min(self.longest, self.first * self.factor ** (failed - 1)) * (1 + random.random() * self.jitter)


def answered(service: Service, texts: list[str], permits: Semaphore, again: Again, sleep: Callable[[float], None] = time.sleep) -> list:
    """A request's answers. A permit is held while the service is called, not while a pause lasts."""
    failed = 0
    while True:
        try:
            with permits:
                answers = service(texts)
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
            return answers
        except Exception as error:
            failed += 1
            if failed >= again.times or not again.when(error):
                raise
            sleep(again.pause(failed))


def called(rows: DataFrame, text: str, connect: Callable[[], Service], kind: pa.DataType, size: int = 32, at_once: int = 4, again: Again = Again(), empty: bool = False) -> DataFrame:  # noqa: B008
    """rows with answer and error: a service's answer to each row's text, of an Arrow type, asked for `size` texts at a time and `at_once` requests a task.

    Rows keep their order in a partition. A null text isn't asked about. A request that fails for good fails its task, or,
    with `empty`, leaves its rows without an answer, with the error's message. Columns named answer or error give way.
    """
    kept = [c for c in rows.columns if c.lower() not in {"answer", "error"}]
    plain = rows.select(*[f"`{c}`" for c in kept])
    arrow = {pa.float64(): "double", pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.float64()): "array<double>", pa.list_(pa.string()): "array<string>"}
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), f"answer {arrow[kind]}", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service, permits = connect(), Semaphore(at_once)

        def ask(texts: list[str]) -> tuple[list, str | None]:
            try:
                return answered(service, texts, permits, again), None
            except Exception as error:
                if not empty:
                    raise
                return [None] * len(texts), str(error)

        with ThreadPoolExecutor(4 * at_once) as pool:  # more than may call, since some are in a pause
            for batch in batches:
                texts = batch.column(text).to_pylist()
                asked = [i for i, t in enumerate(texts) if t is not None]
                requests = [asked[a : a + size] for a in range(0, len(asked), size)]
                answers, errors = [None] * len(texts), [None] * len(texts)
                for places, (found, error) in zip(requests, pool.map(ask, [[texts[i] for i in places] for places in requests]), strict=True):
                    for i, x in zip(places, found, strict=True):
                        answers[i], errors[i] = x, error
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, kind), pa.array(errors, pa.string())], [*kept, "answer", "error"])

    return plain.mapInArrow(run, shape)
