"""A fluent builder of plans: each stage offers only what may follow it."""

from __future__ import annotations

from .spec import SEED, Edge, Plan, Step, validate

# Defaults of the stages.
CHUNK_TOKENS, TOP, HYBRID_TOPS, RERANK_TOP = 128, 40, (80, 40), 10


class _Stage:
    def __init__(self, plan: Plan, last: str):
        self.plan, self.last = plan, last

    def _add(self, kind: str, sources: list[str] | None = None, **params: object) -> str:
        step = Step(f"{kind}{len(self.plan.steps)}", kind, tuple(sorted(params.items())))
        self.plan.steps.append(step)
        for port, source in enumerate(sources or [self.last]):
            self.plan.edges.append(Edge(source, step.id, port))
        return step.id


class Finished(_Stage):
    def compile(self) -> Plan:
        validate(self.plan)
        return self.plan


class Scored(_Stage):
    def generate(self, question: str) -> Finished:
        return Finished(self.plan, self._add("generate", question=question))


class Docs(_Stage):
    def filter(self, *refs: str) -> Docs:
        return Docs(self.plan, self._add("filter", refs=refs))

    def rerank(self, k: int = RERANK_TOP, scorer: str = "length") -> Scored:
        return Scored(self.plan, self._add("rerank", k=k, scorer=scorer))


class Ids(_Stage):
    def hydrate(self) -> Docs:
        return Docs(self.plan, self._add("hydrate"))


class Embeddings(_Stage):
    def retrieve(self, k: int = TOP) -> Ids:
        return Ids(self.plan, self._add("retrieve", k=k))

    def hybrid(self, tops: tuple[int, int] = HYBRID_TOPS) -> Docs:
        """Two retrievals of different size, hydrated and merged by id."""
        branches = [Ids(self.plan, Embeddings(self.plan, self.last)._add("retrieve", k=k)).hydrate().last for k in tops]
        return Docs(self.plan, self._add("merge", branches, policy="union"))


class Chunks(_Stage):
    def filter(self, *refs: str) -> Chunks:
        return Chunks(self.plan, self._add("filter_chunks", refs=refs))

    def embed(self, embedder: str = "hash") -> Embeddings:
        return Embeddings(self.plan, self._add("embed", embedder=embedder))


class Raw(_Stage):
    def chunk(self, tokens: int = CHUNK_TOKENS, chunker: str = "default") -> Chunks:
        return Chunks(self.plan, self._add("chunk", tokens=tokens, chunker=chunker))


class Rag:
    def from_raw(self) -> Raw:
        return Raw(Plan(), SEED)


def rag() -> Rag:
    return Rag()
