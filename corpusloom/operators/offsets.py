"""Folds over a sentence's spans in their order: offsets found by a cursor, bounds extended to neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, trim

SPAN = "struct<label:string,start:bigint,end:bigint,text:string>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: lambdas are interpreted, and a column that stands in one twice is worked out twice."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _found(text: Column, own: Column, cursor: Column) -> Column:
    """Place of a string from a cursor on, in the text as it is or else but for case; null if it is in neither."""
    at = F.call_function("locate", own, text, (cursor + 1).cast("int"))
    low = F.call_function("locate", F.lower(own), F.lower(text), (cursor + 1).cast("int"))
    return _let(at, lambda at: F.when(at > 0, at - 1).otherwise(_let(low, lambda low: F.when(low > 0, low - 1)))).cast("long")


def repaired_spans(text: Column, spans: Column) -> Column:
    """Spans (label, start, end, text) with offsets from 0 whose text stands there, searched for in order; those that stand nowhere go.

    If no start is below 1, offsets count from 1. Bounds that hold the span's text (but for white space) or come without
    a text stay and move the cursor to their end; others are looked for from the cursor on, as they are, then but for
    case, and stay as stated, cursor unmoved, if they aren't found, or have an empty text. Spans without both bounds, or
    with an end that isn't behind the start, are looked for from the cursor on (bounds missing), then in the whole text.
    A text without spans, or a null, gives none.
    """
    least = F.array_min(F.transform(spans, lambda s: s["start"]))
    shift = F.when(least >= 1, F.lit(1)).otherwise(F.lit(0)).cast("long")
    plain = lambda c: trim(squeeze(c))

    def step(a: Column, s: Column) -> Column:
        stated = s["start"].isNotNull() & s["end"].isNotNull()
        start, end = s["start"] - shift, s["end"] - shift
        good = stated & (end > start)
        there = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
        fits = s["text"].isNull() | (plain(s["text"]) == plain(there))
        has_text = F.coalesce(F.length(s["text"]) > 0, F.lit(False))
        size = F.length(s["text"])

        def stood(fits: Column, near: Column) -> Column:
            """What the span gets, and whether the cursor moves behind it."""
            first = F.when(good & fits, start).when(good, F.coalesce(near, start)).when(~stated, near)
            last = F.when(good & fits, end).when(good, F.when(near.isNotNull(), near + size).otherwise(end)).when(~stated, near + size)
            moves = F.when(good, fits | near.isNotNull()).when(~stated, near.isNotNull()).otherwise(F.lit(False))
            return F.struct(first.alias("first"), last.alias("last"), moves.alias("moves"))

        def put(p: Column, begin: Column) -> Column:
            stop = F.coalesce(p["last"], begin + size)
            fixed = F.struct(s["label"].alias("label"), begin.alias("start"), stop.alias("end"), F.substring(text, (begin + 1).cast("int"), (stop - begin).cast("int")).alias("text"))
            out = F.when(begin.isNotNull(), F.concat(a["out"], F.array(fixed))).otherwise(a["out"])
            return F.struct(F.when(p["moves"], p["last"]).otherwise(a["cursor"]).alias("cursor"), out.alias("out"))

        near = lambda fits: F.when(has_text & ~F.coalesce(good & fits, F.lit(False)), _found(text, s["text"], a["cursor"]))
        place = _let(fits, lambda fits: _let(near(fits), lambda near: stood(fits, near)))
        whole = F.when(has_text, _found(text, s["text"], F.lit(0)))
        return _let(place, lambda p: _let(F.coalesce(p["first"], whole), lambda begin: put(p, begin)))

    start = F.struct(F.lit(0).cast("long").alias("cursor"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.coalesce(F.aggregate(spans, start, step)["out"], F.array().cast(f"array<{SPAN}>"))


#: Steps of extension a sentence, and signs of white space that may stand between.
PASSES, BETWEEN = 10, 2
Span = tuple[int, int, str]


def _first_step(text: str, spans: list[Span], extensible: frozenset[str], neighbour: str, between: int) -> tuple[int, int, int] | None:
    """(place, start, end) of the first span that can reach out, over the first neighbour it can."""
    near: dict[int, list[int]] = {}  # neighbours by both of their bounds
    for j, (start, end, label) in enumerate(spans):
        if label == neighbour:
            for bound in {start, end}:
                near.setdefault(bound, []).append(j)
    for i, (start, end, label) in enumerate(spans):
        if label not in extensible:
            continue
        close = {j for k in range(between + 1) for bound in (end + k, start - k) for j in near.get(bound, ())}
        for j in sorted(close - {i}):
            a, b, _ = spans[j]
            if (start <= a and end >= b) or not (end <= a or b <= start):
                continue
            gap = text[end:a] if end <= a else text[b:start]
            low, high = min(start, a), max(end, b)
            if len(gap) <= between and not gap.strip() and not any(s < high and e > low for k, (s, e, _) in enumerate(spans) if k not in (i, j)):
                return i, low, high
    return None


def extended_spans(rows: DataFrame, text: str, spans: str, extensible: tuple[str, ...], neighbour: str, apart: tuple[str, ...], passes: int = PASSES, between: int = BETWEEN) -> DataFrame:
    """rows with spans (start, end, label) of which some reach out over a neighbour beside them, step by step until none does.

    Of spans with an extensible label, in their order, the first takes in the first span labelled `neighbour` that lies
    beside it, with nothing but `between` signs of white space between, unless what it would cover meets a third span.
    Spans labelled as `apart` neither extend nor are taken in, but stand in the way. Each step changes one span, and
    there are at most `passes` a row. Order and number of spans stay; rows without text or spans stay as they are.
    """
    able = frozenset(extensible) - {*apart}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line, listed in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                now = None if listed is None else [(s["start"], s["end"], s["label"]) for s in listed]
                for _ in range(passes if now and line is not None and neighbour not in apart else 0):
                    step = _first_step(line, now, able, neighbour, between)
                    if step is None:
                        break
                    now[step[0]] = (step[1], step[2], now[step[0]][2])
                out.append(None if now is None else [{"start": s, "end": e, "label": x} for s, e, x in now])
            at = batch.schema.get_field_index(spans)
            yield pa.RecordBatch.from_arrays([pa.array(out, f.type) if i == at else batch.column(i) for i, f in enumerate(batch.schema)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
