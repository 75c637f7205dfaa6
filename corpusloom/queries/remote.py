"""A service called from tasks: here a stand-in that is out of order now and then."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import derived as D
from ..operators import remote as C
from ..registry import query


def stand_in() -> C.Service:
    """A client of a service that measures texts: the first call for a text of a length divisible by 5 finds it busy, one of a length divisible by 97 is refused."""
    seen: set[str] = set()

    def service(texts: list[str]) -> list:
        for t in texts:
            if len(t) % 97 == 0:
                raise C.RemoteError(400, "not a text")
            if len(t) % 5 == 0 and t not in seen:
                seen.add(t)
                raise C.RemoteError(503, "busy")
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    return service


@query(f"WITH {D.SENTENCES_SQL} SELECT doc_id, sent_id, CASE WHEN length(text) % 97 <> 0 THEN length(text)::DOUBLE END AS size, CASE WHEN length(text) % 97 <> 0 THEN (length(text) - length(replace(text, ' ', '')))::DOUBLE END AS blanks, CASE WHEN length(text) % 97 = 0 THEN '400 not a text' END AS error FROM sentences")
def remote_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service to every sentence, asked again while it is busy, without one where it refuses."""
    found = C.called(D.sentences(spark, sf_dir), "text", stand_in, pa.list_(pa.float64()), size=1, at_once=4, again=C.Again(first=0.001, longest=0.002), empty=True)
    return found.selectExpr("doc_id", "sent_id", "answer[0] AS size", "answer[1] AS blanks", "error")
