"""A pipeline told by a nested configuration with defaults, for those who don't want to build a plan by stages."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from .builder import rag
from .spec import Plan, PlanError


# The defaults of the configuration.
@dataclass(frozen=True)
class ChunkConfig:
    using: str = "default"
    unit: str = "SENTENCE"
    max_tokens: int = 256


@dataclass(frozen=True)
class EmbedConfig:
    model: str = "hash"
    normalize: bool = True
    store: str = "chroma"


@dataclass(frozen=True)
class RetrieveConfig:
    generic_top_k: int = 30
    thematic_top_k: int = 10
    strategy: str = "hybrid"
    store: str = "chroma"
    filters: tuple[str, ...] = ()


@dataclass(frozen=True)
class RerankConfig:
    strategy: str = "single"
    using: str = "length"
    top_k: int = 10


@dataclass(frozen=True)
class GenerationConfig:
    theme_based_prompt: bool = False
    max_tokens: int = 512


@dataclass(frozen=True)
class RagConfig:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    embed: EmbedConfig = field(default_factory=EmbedConfig)
    retrieve: RetrieveConfig = field(default_factory=RetrieveConfig)
    rerank: RerankConfig = field(default_factory=RerankConfig)
    generate: GenerationConfig = field(default_factory=GenerationConfig)

    def to_plan(self, question: str) -> Plan:
        """The plan that the configuration stands for: one retrieval of generic_top_k, or two that are merged."""
        embedded = rag().from_raw().chunk(self.chunk.max_tokens, self.chunk.using).embed(self.embed.model)
        if self.retrieve.strategy == "hybrid":
            docs = embedded.hybrid((self.retrieve.generic_top_k, self.retrieve.thematic_top_k))
        elif self.retrieve.strategy == "single":
            docs = embedded.retrieve(self.retrieve.generic_top_k).hydrate()
        else:
            raise PlanError(f"no strategy named {self.retrieve.strategy}")
        if self.retrieve.filters:
            docs = docs.filter(*self.retrieve.filters)
        return docs.rerank(self.rerank.top_k, self.rerank.using).generate(question).compile()


def exported(config) -> dict:
    """A configuration as plain nested values."""
    return asdict(config)


def updated(config, changes: dict):
    """A configuration with some values changed, nested as they are; raises ValueError for unknown names and values of another kind."""
    known = {f.name: getattr(config, f.name) for f in fields(config)}
    new = {}
    for name, value in changes.items():
        if name not in known:
            raise ValueError(f"no setting named {name}")
        old = known[name]
        if is_dataclass(old):
            if not isinstance(value, dict):
                raise ValueError(f"{name} holds several settings")
            new[name] = updated(old, value)
        elif isinstance(old, tuple) and isinstance(value, (list, tuple)):
            new[name] = tuple(value)
        elif type(value) is type(old) or (isinstance(old, float) and type(value) is int):
            new[name] = type(old)(value)
        else:
            raise ValueError(f"{name} is a {type(old).__name__}")
    return replace(config, **new)


def imported(kind, values: dict):
    """A configuration from exported values; what is left out has its default."""
    return updated(kind(), values)
