"""Partial ancestral graphs against true graphs with hidden variables."""

import itertools
import random

import numpy as np
import pytest

from causaloom.operators import ancestral
from causaloom.operators.ancestral import ARROW, CIRCLE, TAIL, fci


def ancestors(parents, of):
    found, todo = set(of), list(of)
    while todo:
        for p in parents[todo.pop()]:
            if p not in found:
                found.add(p)
                todo.append(p)
    return found


def separated(parents, i, j, given):
    """d-separation in the moral graph of the ancestors."""
    keep = ancestors(parents, {i, j, *given})
    near = {v: set() for v in keep}
    for v in keep:
        for p in parents[v]:
            near[v].add(p)
            near[p].add(v)
        for p, q in itertools.combinations(parents[v], 2):
            near[p].add(q)
            near[q].add(p)
    seen, todo = {i, *given}, [i]
    while todo:
        for v in near[todo.pop()]:
            if v == j:
                return False
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return True


def truth(n, hidden, edges, selected=()):
    parents = {v: [a for a, b in edges if b == v] for v in range(n)}
    seen = [v for v in range(n) if v not in hidden and v not in selected]
    return parents, seen, lambda i, j, given: separated(parents, seen[i], seen[j], {seen[g] for g in given} | set(selected))


def test_latent_confounder_is_bidirected():
    # a -> x <- L -> y <- b, L hidden
    _, _, test = truth(5, {4}, [(0, 1), (4, 1), (4, 2), (3, 2)])
    m = fci(4, test)
    want = np.zeros((4, 4), int)
    want[0, 1], want[1, 0] = ARROW, CIRCLE
    want[1, 2] = want[2, 1] = ARROW
    want[3, 2], want[2, 3] = ARROW, CIRCLE
    assert (m == want).all()


def test_definite_parent_and_discriminating_path():
    # two causes meet in c, which causes d: c -> d is certain
    _, _, test = truth(4, (), [(0, 2), (1, 2), (2, 3)])
    m = fci(4, test)
    assert m[2, 3] == ARROW and m[3, 2] == TAIL and m[0, 2] == ARROW and m[2, 0] == CIRCLE
    # d -> a <- L1 -> b, a -> c, b <- L2 -> c: only the discriminating path d, a, b, c tells that b and c are confounded
    _, _, test = truth(6, {4, 5}, [(0, 1), (4, 1), (4, 2), (1, 3), (5, 2), (5, 3)])
    m = fci(4, test)
    assert m[2, 3] == ARROW and m[3, 2] == ARROW and m[1, 3] == ARROW and m[3, 1] == TAIL


def test_selection_leaves_tails():
    # a cycle of four is undirected only if the sample is selected on common effects
    edges = [(0, 4), (1, 4), (1, 5), (2, 5), (2, 6), (3, 6), (3, 7), (0, 7)]
    _, _, test = truth(8, (), edges, selected=(4, 5, 6, 7))
    m = fci(4, test)
    assert all(m[a, b] == TAIL and m[b, a] == TAIL for a, b in ((0, 1), (1, 2), (2, 3), (0, 3))) and not m[0, 2] and not m[1, 3]


@pytest.mark.parametrize("seed", range(60))
def test_marks_hold_in_the_true_graph(seed):
    """Adjacent if nothing separates; an arrow is at no ancestor, a tail at an ancestor of the other end."""
    r = random.Random(seed)
    n = r.randint(5, 8)
    hidden = set(r.sample(range(n), r.randint(0, 2)))
    edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.35]
    parents, seen, test = truth(n, hidden, edges)
    m = fci(len(seen), test)
    for i, j in itertools.permutations(range(len(seen)), 2):
        others = [v for v in range(len(seen)) if v not in (i, j)]
        apart = any(test(i, j, g) for k in range(len(others) + 1) for g in itertools.combinations(others, k))
        assert bool(m[i, j]) == (not apart)
        if m[i, j] == ARROW:
            assert seen[j] not in ancestors(parents, {seen[i]})
        if m[i, j] == TAIL:
            assert seen[j] in ancestors(parents, {seen[i]})


def sampled(draw, n=40_000):
    """Pattern counts of records drawn with hidden causes."""
    rng = np.random.default_rng(3)
    u = lambda: rng.random(n)
    return draw(u)


def test_graph_from_counts_by_category(spark):
    def confounded(u):
        hidden, a, b = u() < 0.5, u() < 0.5, u() < 0.5
        x = u() < 0.1 + 0.4 * hidden + 0.4 * a
        y = u() < 0.1 + 0.4 * hidden + 0.4 * b
        return {"A": a, "B": b, "X": x, "Y": y}

    def caused(u):
        a, b = u() < 0.5, u() < 0.5
        x = u() < 0.1 + 0.4 * a + 0.4 * b
        return {"A": a, "B": b, "X": x, "Y": u() < 0.1 + 0.7 * x}

    rows = []
    for category, draw in (("hidden", confounded), ("open", caused)):
        columns = sampled(draw)
        names = list(columns)
        codes, counts = np.unique(np.stack([columns[c] for c in names], 1), axis=0, return_counts=True)
        rows += [(category, ",".join(c for c, on in zip(names, code, strict=True) if on), int(n)) for code, n in zip(codes, counts, strict=True)]
    rows.append(("small", "A,B", 10))
    pag = ancestral.fci_by_category(spark.createDataFrame(rows, "category string, pattern string, n long"), alpha=0.001)
    got = {(r.category, r.a, r.b): (r.mark_a, r.mark_b) for r in pag.collect()}
    assert got == {
        ("hidden", "A", "X"): ("circle", "arrow"), ("hidden", "X", "Y"): ("arrow", "arrow"), ("hidden", "B", "Y"): ("circle", "arrow"),
        ("open", "A", "X"): ("circle", "arrow"), ("open", "B", "X"): ("circle", "arrow"), ("open", "X", "Y"): ("tail", "arrow"),
    }
    kinds = {(r.category, r.kind): r.n for r in ancestral.edge_kinds(pag).collect()}
    assert kinds == {("hidden", "partially directed"): 2, ("hidden", "bidirected"): 1, ("open", "partially directed"): 2, ("open", "directed"): 1}
    said = {(r.category, r.factor, r.other): r.relation for r in ancestral.relations(pag).collect()}
    assert said["hidden", "Y", "X"] == said["hidden", "X", "Y"] == "confounded" and said["open", "Y", "X"] == "parent" and said["open", "X", "Y"] == "child" and said["open", "X", "A"] == "possible parent"
