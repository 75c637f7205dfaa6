"""A plan: steps with typed ports, joined by edges, and the checks it must pass before it is lowered to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

RAW, CHUNKS, EMBEDDINGS, IDS, DOCS, SCORED, ANSWER = "RawDoc", "Chunks", "Embeddings", "ScoredIds", "Docs", "ScoredDocs", "Answer"
#: What each kind of step takes and gives.
PORTS: dict[str, tuple[tuple[str, ...], str]] = {
    "chunk": ((RAW,), CHUNKS),
    "filter_chunks": ((CHUNKS,), CHUNKS),
    "embed": ((CHUNKS,), EMBEDDINGS),
    "retrieve": ((EMBEDDINGS,), IDS),
    "hydrate": ((IDS,), DOCS),
    "filter": ((DOCS,), DOCS),
    "merge": ((DOCS, DOCS), DOCS),
    "rerank": ((DOCS,), SCORED),
    "generate": ((SCORED,), ANSWER),
}
SEED = "raw"


@dataclass(frozen=True)
class Step:
    """One operation with its parameters."""

    id: str
    kind: str
    params: tuple[tuple[str, object], ...] = ()

    def param(self, name: str, default: object = None) -> object:
        return dict(self.params).get(name, default)


@dataclass(frozen=True)
class Edge:
    """From a step's output to an input port of another; the seed stands for the raw documents."""

    source: str
    target: str
    port: int = 0


@dataclass
class Plan:
    """Steps and edges."""

    steps: list[Step] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)


class PlanError(ValueError):
    """A plan that can't be run."""


def validate(plan: Plan) -> list[Step]:
    """The steps in an order in which they can run; raises PlanError for empty plans, unknown steps or ports, type mismatches and cycles."""
    if not plan.steps:
        raise PlanError("empty plan")
    steps = {s.id: s for s in plan.steps}
    for s in plan.steps:
        if s.kind not in PORTS:
            raise PlanError(f"unknown kind: {s.kind}")
    before: dict[str, set[str]] = {s: set() for s in steps}
    for e in plan.edges:
        if e.target not in steps or (e.source != SEED and e.source not in steps):
            raise PlanError(f"unknown step: {e.source} -> {e.target}")
        takes = PORTS[steps[e.target].kind][0]
        if not 0 <= e.port < len(takes):
            raise PlanError(f"unknown port: {e.target}[{e.port}]")
        gives = RAW if e.source == SEED else PORTS[steps[e.source].kind][1]
        if gives != takes[e.port]:
            raise PlanError(f"type mismatch: {gives} -> {takes[e.port]} at {e.target}")
        if e.source != SEED:
            before[e.target].add(e.source)
    try:
        return [steps[s] for s in TopologicalSorter(before).static_order()]
    except CycleError as error:
        raise PlanError("cycle") from error
