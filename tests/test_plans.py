"""Plans: order, defaults and every error; sources and stores on odd rows."""

from __future__ import annotations

import pytest

from corpusloom.plans.builder import CHUNK_TOKENS, HYBRID_TOPS, RERANK_TOP, TOP, rag
from corpusloom.plans.runner import bind, run, tokens_chunker
from corpusloom.plans.spec import SEED, Edge, Plan, PlanError, Step, validate


def chain(*kinds: str) -> Plan:
    steps = [Step(f"s{i}", k) for i, k in enumerate(kinds)]
    return Plan(steps, [Edge(SEED if i == 0 else f"s{i - 1}", f"s{i}") for i in range(len(steps))])


def test_order_is_that_of_the_edges():
    plan = chain("chunk", "embed", "retrieve", "hydrate")
    plan.steps.reverse()
    assert [s.kind for s in validate(plan)] == ["chunk", "embed", "retrieve", "hydrate"]


@pytest.mark.parametrize(
    ("plan", "said"),
    [
        (Plan(), "empty"), (chain("chunk", "nonsense"), "unknown kind"), (Plan([Step("a", "chunk")], [Edge("gone", "a")]), "unknown step"), (Plan([Step("a", "chunk")], [Edge(SEED, "a", 3)]), "unknown port"),
        (chain("embed"), "type mismatch"), (chain("chunk", "retrieve"), "type mismatch"), (Plan([Step("a", "filter_chunks"), Step("b", "filter_chunks")], [Edge("a", "b"), Edge("b", "a")]), "cycle"),
    ],
)
def test_errors(plan, said):
    with pytest.raises(PlanError, match=said):
        validate(plan)


def test_defaults_of_the_builder():
    plan = rag().from_raw().chunk().embed().hybrid().filter("length>=3").rerank().generate("q").compile()
    found = {s.kind: s for s in plan.steps}
    assert (found["chunk"].param("tokens"), found["rerank"].param("k")) == (CHUNK_TOKENS, RERANK_TOP) == (128, 10)
    assert [s.param("k") for s in plan.steps if s.kind == "retrieve"] == list(HYBRID_TOPS) == [80, 40] and TOP == 40


def test_unknown_parts_and_policies(spark):
    with pytest.raises(PlanError, match="no part named"):
        bind({}, "x")
    docs = spark.createDataFrame([(1, "One sentence. Another one here. And a third.")], "doc_id long, text string")
    plan = rag().from_raw().chunk().embed().retrieve(2).hydrate().filter("length>=3").rerank(2).generate("what?").compile()
    assert run(plan, docs).count() == 1
    plan.steps[0] = Step(plan.steps[0].id, "chunk", (("chunker", "other"),))
    with pytest.raises(PlanError, match="no part named other"):
        run(plan, docs)


def test_chunks_of_so_many_tokens(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in tokens_chunker(2)(docs).collect()) == [(1, "a b"), (1, "c d"), (1, "e")]


def test_quota_fill_against_one_pass(spark):
    import random

    from corpusloom.operators.corpus import quota_fill

    rng = random.Random(3)
    rows = [(i * 3, [rng.choice("aaabcd") for _ in range(rng.randrange(4))]) for i in range(400)]
    seen: dict = {}
    wanted = []
    for k, labels in rows:
        if any(seen.get(x, 0) < 20 for x in set(labels)):
            wanted.append(k)
            for x in set(labels):
                seen[x] = seen.get(x, 0) + 1
    got = quota_fill(spark.createDataFrame(rows, "k long, labels array<string>"), "labels", "k", 20)
    assert sorted(r.k for r in got.collect()) == wanted


def test_upsert_takes_the_new_row_of_equals(spark):
    from corpusloom.sources.stores import delete, upsert

    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, v string, at int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, None, 1)], "id long, v string, at int")
    assert {(r.id, r.v) for r in upsert(old, new, ["id"], "at").collect()} == {(1, "c"), (2, "b"), (3, None)}
    assert [r.id for r in delete(old, new.where("id = 1").select("id")).collect()] == [2]


def test_configuration_defaults_updates_and_plans(spark):
    from corpusloom.plans.config import RagConfig, exported, imported, updated

    config = RagConfig()
    assert (config.chunk.max_tokens, config.retrieve.generic_top_k, config.retrieve.thematic_top_k, config.embed.normalize, config.retrieve.strategy, config.rerank.top_k, config.generate.max_tokens) == (256, 30, 10, True, "hybrid", 10, 512)
    plan = config.to_plan("what?")
    assert [s.param("k") for s in plan.steps if s.kind == "retrieve"] == [30, 10] and next(s for s in plan.steps if s.kind == "chunk").param("tokens") == 256
    new = updated(config, {"retrieve": {"strategy": "single", "generic_top_k": 2, "filters": ["length>=3"]}, "rerank": {"top_k": 1}})
    assert (new.retrieve.strategy, new.retrieve.filters, new.chunk.max_tokens) == ("single", ("length>=3",), 256) and config.retrieve.strategy == "hybrid"
    assert imported(RagConfig, exported(new)) == new and imported(RagConfig, {}) == config
    docs = spark.createDataFrame([(1, "One sentence. Another longer one here. A third.")], "doc_id long, text string")
    assert run(new.to_plan("what?"), docs).first().answer.startswith("Q: what? A: ")
    for changes, said in (({"nothing": 1}, "no setting named nothing"), ({"chunk": 3}, "holds several"), ({"chunk": {"max_tokens": "many"}}, "max_tokens is a int"), ({"embed": {"normalize": 1}}, "normalize is a bool")):
        with pytest.raises(ValueError, match=said):
            updated(config, changes)
    with pytest.raises(PlanError, match="no strategy named best"):
        updated(config, {"retrieve": {"strategy": "best"}}).to_plan("?")
