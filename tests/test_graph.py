"""Dependency graphs deeper and wider than the made trees of the queries."""

from __future__ import annotations

from corpusloom.operators import graph as G

SCHEMA = "doc_id long, sent_id long, tok_id long, head long, upos string, deprel string"


def test_closure_of_long_chains(spark):
    chain = [(1, 0, i, i - 1, "NOUN", "compound" if i > 1 else "root") for i in range(1, 11)]
    street = [(2, 0, 1, 0, "NOUN", "root"), (2, 0, 2, 4, "ADP", "case"), (2, 0, 3, 4, "DET", "det"), (2, 0, 4, 1, "NOUN", "nmod"), (2, 0, 5, 1, "PROPN", "appos"), (2, 0, 6, 1, "VERB", "nmod"), (2, 0, 7, 1, "NOUN", "appos")]
    circle = [(3, 0, 1, 2, "NOUN", "flat"), (3, 0, 2, 1, "NOUN", "flat")]
    tokens = spark.createDataFrame(chain + street + circle, SCHEMA)
    got = {(r.doc_id, r.root): (r.first, r.last, r["size"]) for r in G.closure(tokens, tokens.tok_id == 1).collect()}
    assert got == {(1, 1): (1, 10, 10), (2, 1): (1, 5, 5), (3, 1): (1, 2, 2)}


def test_hops_of_far_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, i, i - 1, "NOUN", "compound") for i in range(1, 9)], SCHEMA)
    got = {r.tok_id: r.hops for r in G.all_hops(tokens, tokens.tok_id == 1).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 99, 8: 99}


def plain_below(rows, follow):
    """Pairs (root, token) by depth-first search."""
    kids: dict = {}
    for i, (tok, head) in enumerate(rows):
        if follow[i] and head and head != tok:
            kids.setdefault(head, []).append(tok)
    ids = {tok for tok, _ in rows}
    out = set()
    for root in ids:
        todo, seen = [root], {root}
        while todo:
            for k in kids.get(todo.pop(), []):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out |= {(root, t) for t in seen}
    return out


def test_walks_of_any_graph(spark):
    """Trees, chains, cycles with tails, heads that aren't there and tokens that head themselves, against searches."""
    import random

    from pyspark.sql import functions as F

    from corpusloom.operators import walks as W

    rng = random.Random(1)
    sentences = [[(i, rng.choice([0, i, rng.randrange(0, n + 3), max(0, i - 1)])) for i in range(1, n + 1)] for n in (1, 2, 3, 5, 8, 13, 21) for _ in range(12)]
    sentences += [[(i, i - 1) for i in range(1, 400)], [(i, i % 50 + 1) for i in range(1, 51)], [(5, 0), (9, 5), (7, 9)]]
    rows = [(k, k % 3, tok, head, rng.random() < 0.7, 3 * tok, 3 * tok + 2) for k, s in enumerate(sentences) for tok, head in s]
    df = spark.createDataFrame(rows, "doc_id long, sent_id long, tok_id long, head long, f boolean, start long, end long").repartition(3)
    sizes = {(r.doc_id, r.root): (r.first, r.last, r["size"]) for r in W.reached(df, F.col("f")).collect()}
    reach = {(r.doc_id, r.tok_id): (r.own_low, r.own_high, r.f, r.head) for r in W.with_reach(df, {"own": F.col("f")}).collect()}
    far = {(r.doc_id, r.source, r.tok_id): r.hops for r in W.distances(df, F.lit(True), 4, 99).collect()}
    near = {(r.doc_id, r.source, r.tok_id): r.hops for r in W.distances(df, F.lit(True), 4, None).collect()}
    assert near == {k: v for k, v in far.items() if v != 99} and len(reach) == len(rows)
    for k, s in enumerate(sentences):
        flags = [r[4] for r in rows if r[0] == k]
        below: dict = {}
        for root, tok in plain_below(s, flags):
            below.setdefault(root, set()).add(tok)
        ids = {t for t, _ in s}
        for root, found in below.items():
            assert sizes[k, root] == (min(found), max(found), len(found)), (k, s, root)
            assert reach[k, root][:2] == (3 * min(found), 3 * max(found) + 2)
        links: dict = {}
        for tok, head in s:
            if head in ids and head != tok:
                links.setdefault(tok, set()).add(head)
                links.setdefault(head, set()).add(tok)
        for a in ids:
            hops, front = {a: 0}, [a]
            for step in range(1, 5):
                front = [y for x in front for y in links.get(x, ()) if hops.setdefault(y, step) == step]
            assert all(far[k, a, t] == hops.get(t, 99) for t in ids)
    assert W.reached(df.limit(0), F.col("f")).count() == 0 == W.distances(df, F.lit(None).cast("boolean"), 2, 99).count()
