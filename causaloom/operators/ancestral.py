"""Partial ancestral graphs per category: constraint-based search that allows latent confounders and selection.

The input is the distinct presence patterns of a category with their counts, which are
sufficient for all tests and whose number does not follow that of the records; a
category is one task.  Marks at the ends of an edge are circles (undetermined), arrows
and tails.
"""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .networks import ChiSquare, _matrix, dealt, first_apart, skeleton

NONE, CIRCLE, ARROW, TAIL = range(4)
MARKS = ("none", "circle", "arrow", "tail")


def possible_d_sep(marks: np.ndarray, x: int) -> set[int]:
    """Variables at the end of a path from x on which every inner one is a collider or lies in a triangle with its neighbours."""
    found, todo = set(), deque((x, y) for y in np.flatnonzero(marks[x]))
    seen = set(todo)
    while todo:
        a, b = todo.popleft()
        found.add(int(b))
        for c in np.flatnonzero(marks[b]):
            if c not in (a, x) and (b, c) not in seen and (marks[a, c] or marks[a, b] == ARROW and marks[c, b] == ARROW):
                seen.add((b, c))
                todo.append((b, c))
    return found - {x}


class _Graph:
    """``m[a, b]`` is the mark at b of the edge between a and b."""

    def __init__(self, near: dict[int, set[int]], apart: dict[frozenset, tuple[int, ...]]):
        self.k, self.apart = len(near), apart
        self.m = np.zeros((self.k, self.k), np.int8)
        for a in near:
            for b in near[a]:
                self.m[a, b] = CIRCLE

    def near(self, a: int) -> list[int]:
        return [int(b) for b in np.flatnonzero(self.m[a])]

    def set(self, a: int, b: int, mark: int) -> bool:
        """The mark at b, if it was undetermined."""
        if self.m[a, b] != CIRCLE:
            return False
        self.m[a, b] = mark
        return True

    def parent(self, a: int, b: int) -> bool:
        return self.m[a, b] == ARROW and self.m[b, a] == TAIL

    def colliders(self) -> None:
        for c in range(self.k):
            for a, b in itertools.combinations(self.near(c), 2):
                if not self.m[a, b] and c not in self.apart.get(frozenset((a, b)), ()):
                    self.m[a, c] = self.m[b, c] = ARROW

    def uncovered(self, path: list[int], end: int, step) -> list[int] | None:
        """An extension of ``path`` to ``end`` by edges that ``step(u, v)`` allows, whose triples have unconnected ends."""
        for v in self.near(path[-1]):
            if v in path or not step(path[-1], v) or len(path) > 1 and self.m[path[-2], v]:
                continue
            if v == end:
                return [*path, v]
            if (found := self.uncovered([*path, v], end, step)) is not None:
                return found
        return None

    def maybe_directed(self, u: int, v: int) -> bool:
        return self.m[v, u] != ARROW and self.m[u, v] != TAIL

    def arrows(self) -> bool:
        """Rules 1 to 4, once over the graph; whether a mark was set."""
        m, new = self.m, False
        for b in range(self.k):
            for a, c in itertools.permutations(self.near(b), 2):
                if m[a, b] == ARROW and m[c, b] == CIRCLE and not m[a, c]:  # 1
                    new |= self.set(c, b, TAIL)
                    m[b, c] = ARROW
                if m[a, c] == CIRCLE and m[a, b] == ARROW and m[b, c] == ARROW and (m[b, a] == TAIL or m[c, b] == TAIL):  # 2
                    new |= self.set(a, c, ARROW)
                if a < c and m[a, b] == ARROW and m[c, b] == ARROW and not m[a, c]:  # 3
                    for d in self.near(b):
                        if m[a, d] == CIRCLE and m[c, d] == CIRCLE and m[d, b] == CIRCLE:
                            new |= self.set(d, b, ARROW)
        for b in range(self.k):
            for c in self.near(b):
                if m[c, b] == CIRCLE:
                    new |= self.discriminated(b, c)
        return new

    def discriminated(self, b: int, c: int) -> bool:
        """Rule 4: a path d, ..., a, b, c whose inner ones before b are colliders and parents of c, d and c apart."""
        m = self.m
        for a in self.near(b):
            if not (self.parent(a, c) and m[b, a] == ARROW):
                continue
            todo, seen = deque([a]), {a, b, c}
            while todo:
                u = todo.popleft()
                for v in self.near(u):
                    if v in seen or m[v, u] != ARROW:
                        continue
                    if not m[v, c]:
                        if b in self.apart.get(frozenset((v, c)), ()):
                            m[c, b], m[b, c] = TAIL, ARROW
                        else:
                            m[a, b] = m[c, b] = m[b, c] = ARROW
                        return True
                    seen.add(v)
                    if self.parent(v, c) and m[u, v] == ARROW:
                        todo.append(v)
        return False

    def undirected(self) -> bool:
        """Rules 5 to 7, for selection."""
        m, new = self.m, False
        circles = lambda u, v: m[u, v] == CIRCLE and m[v, u] == CIRCLE
        for a in range(self.k):
            for b in self.near(a):
                if a < b and circles(a, b):
                    for g in self.near(a):
                        if g != b and circles(a, g) and not m[g, b] and (path := self.uncovered([a, g], b, circles)) is not None and not m[a, path[-2]]:
                            for u, v in [(a, b), *itertools.pairwise(path)]:
                                m[u, v] = m[v, u] = TAIL
                            new = True
                            break
        for b in range(self.k):
            for a, c in itertools.permutations(self.near(b), 2):
                if m[c, b] == CIRCLE and m[b, a] == TAIL and (m[a, b] == TAIL or m[a, b] == CIRCLE and not m[a, c]):
                    new |= self.set(c, b, TAIL)
        return new

    def tails(self) -> bool:
        """Rules 8 to 10."""
        m, new = self.m, False
        for a in range(self.k):
            for c in self.near(a):
                if not (m[a, c] == ARROW and m[c, a] == CIRCLE):
                    continue
                found = any(m[b, a] == TAIL and m[a, b] != TAIL and m[b, c] and self.parent(b, c) for b in self.near(a))
                found = found or any(b != c and not m[b, c] and self.maybe_directed(a, b) and self.uncovered([a, b], c, self.maybe_directed) is not None for b in self.near(a))
                if not found:
                    into = [b for b in self.near(c) if b != a and self.parent(b, c)]
                    starts = [u for u in self.near(a) if u != c and self.maybe_directed(a, u)]
                    reach = {u: {b for b in into if b == u or self.uncovered([a, u], b, self.maybe_directed) is not None} for u in starts}
                    found = any(not m[u, w] and any(b != d for b in reach[u] for d in reach[w]) for u, w in itertools.combinations(starts, 2))
                if found:
                    m[c, a] = TAIL
                    new = True
        return new


def fci(k: int, test, depth: int = -1) -> np.ndarray:
    """Marks of the partial ancestral graph of k variables: ``m[a, b]`` is the mark at b of the edge between a and b.

    Skeleton, colliders, tests given subsets of Possible-D-Sep, colliders anew, and then
    the ten orientation rules until none applies.  ``test(i, j, given)`` says whether i and j are
    independent; ``depth`` bounds the size of ``given`` (-1: no bound).
    """
    near, apart = skeleton(k, test, depth)
    first = _Graph(near, apart)
    first.colliders()
    reach = {x: sorted(possible_d_sep(first.m, x)) for x in range(k)}
    for x in range(k):
        for y in sorted(near[x]):
            others = [v for v in reach[x] if v != y]
            sizes = range(1, (len(others) if depth < 0 else min(depth, len(others))) + 1)
            found = (first_apart(test, x, y, (g for g in itertools.combinations(others, n) if not set(g) <= near[x])) for n in sizes)
            given = next((g for g in found if g is not None), None)
            if given is not None:
                near[x].discard(y)
                near[y].discard(x)
                apart[frozenset((x, y))] = given
    graph = _Graph(near, apart)
    graph.colliders()
    while graph.arrows():
        pass
    while graph.undirected() or graph.tails() or graph.arrows():
        pass
    return graph.m


def relation(z: int, x: int, m: np.ndarray) -> str:
    """What the graph says of z as a cause of x."""
    at_z, at_x = m[x, z], m[z, x]
    return {
        (NONE, NONE): "absent", (TAIL, ARROW): "parent", (CIRCLE, ARROW): "possible parent", (ARROW, ARROW): "confounded",
        (CIRCLE, CIRCLE): "undetermined", (ARROW, TAIL): "child", (ARROW, CIRCLE): "possible child",
    }.get((at_z, at_x), "other")


def fci_by_category(patterns: DataFrame, alpha: float = 0.05, depth: int = -1, least: int = 5) -> DataFrame:
    """(category, pattern, n) -> (category, a, b, mark_a, mark_b) with a < b; marks are circle, arrow or tail.

    Factors with at least ``least`` records with and without them take part; categories
    with fewer than four of them or fewer than fifty records have no graph.
    """

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if (found := _matrix(pdf, least)) is not None:
            names, x, n = found
            m = fci(len(names), ChiSquare(x, n, alpha), depth)
            rows = [(pdf.category.iloc[0], names[i], names[j], MARKS[m[j, i]], MARKS[m[i, j]]) for i, j in itertools.combinations(range(len(names)), 2) if m[i, j]]
        return pd.DataFrame(rows, columns=["category", "a", "b", "mark_a", "mark_b"])

    return dealt(patterns.select("category", "pattern", "n"), "category").groupBy("category").applyInPandas(learn, "category string, a string, b string, mark_a string, mark_b string")


def edge_kinds(pag: DataFrame) -> DataFrame:
    """(category, kind, n): how many edges of each kind a category's graph has."""
    a, b = F.col("mark_a"), F.col("mark_b")
    ends = F.concat_ws(" ", F.least(a, b), F.greatest(a, b))
    named = {"arrow tail": "directed", "arrow circle": "partially directed", "arrow arrow": "bidirected", "circle circle": "undetermined", "tail tail": "undirected"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), ends), F.lit("other"))
    return pag.groupBy("category", kind.alias("kind")).agg(F.count("*").alias("n"))


def relations(pag: DataFrame) -> DataFrame:
    """(category, factor, other, relation): what the graph says of ``other`` as a cause of ``factor``, both ways for each edge."""
    both = pag.select("category", F.col("b").alias("factor"), F.col("a").alias("other"), F.col("mark_a").alias("at_z"), F.col("mark_b").alias("at_x")).union(
        pag.select("category", F.col("a"), F.col("b"), F.col("mark_b"), F.col("mark_a"))
    )
    kinds = {"tail arrow": "parent", "circle arrow": "possible parent", "arrow arrow": "confounded", "circle circle": "undetermined", "arrow tail": "child", "arrow circle": "possible child"}
    found = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.concat_ws(" ", "at_z", "at_x"))
    return both.select("category", "factor", "other", F.coalesce(found, F.lit("other")).alias("relation"))
