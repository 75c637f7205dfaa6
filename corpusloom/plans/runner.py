"""Lowers a checked plan to one lazy DataFrame, and the registry of named parts it binds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval as R
from .spec import SEED, Plan, PlanError, validate

CHUNKERS: dict[str, Callable[[DataFrame], DataFrame]] = {"default": R.chunk}
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hash": V.hash_embedding}
SCORERS: dict[str, Callable[[Column], Column]] = {"length": lambda text: F.length(text).cast("double")}
FILTERS: dict[str, Callable[[], Column]] = {"length>=3": lambda: F.length("text") >= 3, "language": lambda: F.length("text") >= 3, "cleanup": lambda: F.length("text") >= 3}


def tokens_chunker(tokens: int) -> Callable[[DataFrame], DataFrame]:
    """Pieces of at most so many white-space tokens."""

    def chunk(docs: DataFrame) -> DataFrame:
        w = T.words(F.col("text"))
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(tokens))
        rows = docs.select("doc_id", w.alias("w")).select("doc_id", "w", F.posexplode(starts).alias("pos", "at"))
        return rows.select("doc_id", "pos", F.concat_ws("_", "doc_id", F.lit("sent"), "pos").alias("id"), F.array_join(F.slice("w", F.col("at") + 1, F.lit(tokens)), " ").alias("text")).where("text <> ''")

    return chunk


def bind(parts: dict[str, Callable], name: str) -> Callable:
    """A named part; the plan's error if none supports the name."""
    if name not in parts:
        raise PlanError(f"no part named {name}")
    return parts[name]


def nearest_to_first(embedded: DataFrame, k: int) -> DataFrame:
    """The k chunks nearest to the first chunk's vector, ranked from 1: (id, score, rank, text).

    The query vector is one row; a task keeps its k best before they meet.
    """
    query = embedded.agg(F.min_by("vector", F.struct("doc_id", "pos")).alias("q"))
    scored = embedded.join(F.broadcast(query)).select("id", "doc_id", "pos", "text", V.cosine(F.col("vector"), F.col("q")).alias("score"))
    best = scored.orderBy(F.round("score", 9).desc(), "doc_id", "pos").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "doc_id", "pos")))  # k rows


def search(documents: DataFrame, k: int) -> DataFrame:
    """Chunk, embed and search, in the default way."""
    return nearest_to_first(R.chunk(documents).withColumn("vector", V.hash_embedding(F.col("text"))), k)


def run(plan: Plan, documents: DataFrame) -> DataFrame:
    """The last step's DataFrame. documents: (doc_id, text)."""
    outputs: dict[str, DataFrame] = {SEED: documents}
    order = validate(plan)
    for step in order:
        inputs = [outputs[e.source] for e in sorted((e for e in plan.edges if e.target == step.id), key=lambda e: e.port)]
        if step.kind == "chunk":
            out = bind(CHUNKERS, str(step.param("chunker")))(inputs[0])
        elif step.kind in ("filter", "filter_chunks"):
            out = R.filter_refs(inputs[0], [bind(FILTERS, r)() for r in step.param("refs")])  # type: ignore[attr-defined]
        elif step.kind == "embed":
            out = inputs[0].withColumn("vector", bind(EMBEDDERS, str(step.param("embedder")))(F.col("text")))
        elif step.kind == "retrieve":
            out = nearest_to_first(inputs[0], int(step.param("k")))  # type: ignore[call-overload]
        elif step.kind == "hydrate":
            out = inputs[0].select("id", F.col("rank").alias("pos"), "text")
        elif step.kind == "merge":
            if step.param("policy") != "union":
                raise PlanError("only union merges")
            out = R.merge(inputs[0], inputs[1], "id").withColumn("pos", F.col("side") * 1_000_000 + F.col("pos")).drop("side")
        elif step.kind == "rerank":
            out = R.rerank(inputs[0], bind(SCORERS, str(step.param("scorer")))(F.col("text")), int(step.param("k")))  # type: ignore[call-overload]
        else:
            out = R.answer(inputs[0], str(step.param("question")))
        outputs[step.id] = out
    return outputs[order[-1].id]
