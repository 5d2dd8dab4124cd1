"""Causal discovery on distinct presence patterns and their counts, one group per category."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees > x), by the series or the continued fraction of the incomplete gamma."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-14:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return scale * h


@functools.cache
def chi2_limit(df: int, alpha: float) -> float:
    """The statistic with ``df`` degrees whose tail is ``alpha``, by Newton's steps between bounds."""
    low, high = 0.0, float(df)
    while chi2_tail(high, df) > alpha and high < 2.0**60:
        low, high = high, high * 2
    x = (low + high) / 2
    for _ in range(200):
        beyond = chi2_tail(x, df) - alpha
        low, high = (x, high) if beyond > 0 else (low, x)
        slope = math.exp((df / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(df / 2)) / 2
        step = x + beyond / slope if slope else low
        if not low < step < high:
            step = (low + high) / 2
        if abs(step - x) <= 1e-14 * x:
            break
        x = step
    return x


def _strata(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statistic, whether it counts) of each stratum; ``cells`` are the counts of 00, 01, 10 and 11."""
    a, b, c, d = cells
    first, second = a + b, c + d
    margins = first * second
    part = a + c
    margins *= part
    margins *= np.add(b, d, out=part)
    full = margins > 0
    margins += ~full  # there the numerator is zero
    stat = a * d
    stat -= np.multiply(b, c, out=part)
    stat *= stat
    stat *= np.add(first, second, out=first)
    stat /= margins
    return stat, full


def _below_limit(stat: np.ndarray, df: np.ndarray, alpha: float) -> np.ndarray:
    """Which statistics say independent; close to the limit the tail itself decides."""
    limits = np.full(int(df.max(initial=0)) + 1, np.inf)
    for n in np.flatnonzero(np.bincount(df)):
        if n:
            limits[n] = chi2_limit(int(n), alpha)
    limit = limits[df]
    sure = stat < limit
    for i in np.flatnonzero(np.abs(stat - limit) < 1e-9 * limit):
        sure[i] = chi2_tail(float(stat[i]), int(df[i])) > alpha
    return sure


def _accepted(cells: np.ndarray, alpha: float) -> np.ndarray:
    """Which tests say independent; ``cells`` are the counts of 00, 01, 10 and 11 as (4, tests, strata)."""
    stat, full = _strata(cells)
    return _below_limit(stat.sum(axis=-1), full.sum(axis=-1), alpha)


def independent(patterns: np.ndarray, counts: np.ndarray, i: int, j: int, given: tuple[int, ...], alpha: float) -> bool:
    """Chi-square test of columns i and j within the strata of ``given``, on weighted patterns."""
    stratum = np.zeros(len(patterns), int)
    for g in given:  # numbered anew each time, so that there are no more strata than patterns
        _, stratum = np.unique(stratum * 2 + patterns[:, g], return_inverse=True)
    code = stratum * 4 + patterns[:, i].astype(int) * 2 + patterns[:, j]
    table = np.bincount(code, weights=counts, minlength=4 * (int(stratum.max(initial=0)) + 1))
    return bool(_accepted(np.moveaxis(table.reshape(1, -1, 4), 2, 0), alpha)[0])


class ChiSquare:
    """``test(i, j, given)`` on weighted patterns; :meth:`first` runs through many ``given`` of one size at a time.

    Where they fit (``CELLS``), the counts of all partial assignments are summed once: every
    variable is absent, present or left open.  The statistics of a pair under all sets of the other
    variables are then sums over that table, made when the pair is first tested given ``WHOLE`` variables or
    more; smaller tests look up their cells.  Either way many tests are one numpy expression.
    """

    #: Partial assignments (three to the power of the variables) that are held at most: 13 variables, 13 MB.
    CELLS = 3**13
    #: Strata that are looked up at a time.
    STRATA = 1 << 15
    #: Size of the sets from which on a pair is tested given all sets at once.
    WHOLE = 1

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, alpha: float):
        self.patterns, self.counts, self.alpha = patterns, counts, alpha
        self.k = k = patterns.shape[1]
        self.strides = 3 ** np.arange(k - 1, -1, -1)
        self.sums = None
        self.by_pair: dict[tuple[int, int], np.ndarray] = {}
        self.by_size: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        if 3**k <= self.CELLS:
            code = patterns.astype(int) @ (1 << np.arange(k - 1, -1, -1))
            cube = np.bincount(code, weights=counts, minlength=2**k).reshape((2,) * k)
            for axis in reversed(range(k)):  # so that long stretches are copied last
                cube = np.concatenate([cube, cube.sum(axis=axis, keepdims=True)], axis=axis)
            self.sums = cube.ravel()

    def __call__(self, i: int, j: int, given: tuple[int, ...]) -> bool:
        return independent(self.patterns, self.counts, i, j, given, self.alpha)

    def _all_sets(self, i: int, j: int) -> np.ndarray:
        """Whether i and j are independent given each set of the others; the first of these is the highest binary digit of a set's place."""
        i, j = min(i, j), max(i, j)
        if (i, j) not in self.by_pair:
            rest = self.k - 2
            cells = np.moveaxis(self.sums.reshape((3,) * self.k), (i, j), (0, 1))[:2, :2].reshape(4, 3**rest)
            now = np.stack(_strata(cells))
            for done in range(rest):  # each variable is left open or given, which sums over its absence and presence
                was = now.reshape(2 << done, 3, -1)
                now = np.empty((2 << done, 2, was.shape[2]))
                now[:, 0] = was[:, 2]
                np.add(was[:, 0], was[:, 1], out=now[:, 1])
            stat, df = now.reshape(2, -1)
            self.by_pair[i, j] = _below_limit(stat, df.astype(int), self.alpha)
        return self.by_pair[i, j]

    def within(self, i: int, j: int, others: list[int], size: int) -> tuple[int, ...] | None:
        """The first set of ``size`` of the ascending ``others`` given which i and j are independent; larger sets are not gone through, for all are known."""
        if self.sums is None or size < self.WHOLE:
            return self.first(i, j, itertools.combinations(others, size))
        i, j = min(i, j), max(i, j)
        if (i, j) not in self.by_size:
            places = np.flatnonzero(self._all_sets(i, j))[::-1]  # of one size, the first set has the highest place
            sizes = np.bitwise_count(places)
            self.by_size[i, j] = {int(n): places[sizes == n] for n in np.unique(sizes)}
        places = self.by_size[i, j].get(size)
        if places is None:
            return None
        rest = [v for v in range(self.k) if v not in (i, j)]
        bit = {v: 1 << (self.k - 3 - at) for at, v in enumerate(rest)}
        inside = places & ~sum(bit[v] for v in others) == 0
        if not inside.any():
            return None
        place = int(places[int(inside.argmax())])
        return tuple(v for v in rest if place & bit[v])

    def first(self, i: int, j: int, sets) -> tuple[int, ...] | None:
        """The first of ``sets``, all of one size, given which i and j are independent."""
        sets = iter(sets)
        if self.sums is None:
            return next((g for g in sets if self(i, j, g)), None)
        many = 4
        if (head := next(sets, None)) is None:
            return None
        sets = itertools.chain([head], sets)
        if len(head) >= self.WHOLE:
            table = self._all_sets(i, j)
            bit = np.zeros(self.k, int)
            bit[[v for v in range(self.k) if v not in (i, j)]] = 1 << np.arange(self.k - 3, -1, -1)
            while found := list(itertools.islice(sets, many)):
                accepted = table[bit[np.array(found, int)].sum(axis=1)]
                if accepted.any():
                    return found[int(accepted.argmax())]
                many = min(many * 8, self.STRATA)
            return None
        ends = [(x - 2) * self.strides[i] + (y - 2) * self.strides[j] - 1 for x in (0, 1) for y in (0, 1)]
        while found := list(itertools.islice(sets, many)):
            size = len(found[0])
            values = (np.arange(2**size)[:, None] >> np.arange(size) & 1) - 2
            places = self.strides[np.array(found, int).reshape(len(found), size)] @ values.T
            accepted = _accepted(np.stack([self.sums[places + end] for end in ends]), self.alpha)
            if accepted.any():
                return found[int(accepted.argmax())]
            many = max(4, min(many * 4, self.STRATA >> size))
        return None


def first_apart(test, i: int, j: int, sets) -> tuple[int, ...] | None:
    """The first of ``sets`` (of one size) given which ``test`` says independent."""
    if hasattr(test, "first"):
        return test.first(i, j, sets)
    return next((g for g in sets if test(i, j, g)), None)


def skeleton(k: int, test, depth: int = -1) -> tuple[dict[int, set[int]], dict[frozenset, tuple[int, ...]]]:
    """(neighbours, separating sets) of k variables by the order-free search; ``test(i, j, given)``, the same for j and i, says independent."""
    near = {i: set(range(k)) - {i} for i in range(k)}
    apart: dict[frozenset, tuple[int, ...]] = {}
    for size in itertools.count():
        frozen = {i: sorted(near[i]) for i in near}
        if all(len(others) <= size for others in frozen.values()) or 0 <= depth < size:
            return near, apart
        for i in range(k):
            for j in frozen[i]:
                others = [x for x in frozen[i] if x != j]
                if j not in near[i] or j < i and others == [x for x in frozen[j] if x != i]:  # met from the other end
                    continue
                given = test.within(i, j, others, size) if hasattr(test, "within") else first_apart(test, i, j, itertools.combinations(others, size))
                if given is not None:
                    near[i].discard(j)
                    near[j].discard(i)
                    apart[frozenset((i, j))] = given


def pc(patterns: np.ndarray, counts: np.ndarray, alpha: float = 0.05) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """(directed, undirected) edges: stable skeleton, colliders (first found wins a conflict), Meek's rules 1 to 3."""
    k = patterns.shape[1]
    near, apart = skeleton(k, ChiSquare(patterns, counts, alpha))
    arrows: set[tuple[int, int]] = set()
    for z in range(k):
        for x, y in itertools.combinations(sorted(near[z]), 2):
            if y not in near[x] and z not in apart.get(frozenset((x, y)), ()):
                for s in (x, y):
                    if (z, s) not in arrows:
                        arrows.add((s, z))
    changed = True
    while changed:
        changed = False
        for a in range(k):
            for b in sorted(near[a]):
                if (a, b) in arrows or (b, a) in arrows:
                    continue
                rule1 = any((c, a) in arrows and b not in near[c] for c in near[a] if c != b)
                rule2 = any((a, c) in arrows and (c, b) in arrows for c in near[a] & near[b])
                rule3 = any((c, b) in arrows and (d, b) in arrows and d not in near[c] for c, d in itertools.combinations(sorted(near[a] & near[b]), 2) if (c, a) not in arrows and (a, c) not in arrows and (d, a) not in arrows and (a, d) not in arrows)
                if rule1 or rule2 or rule3:
                    arrows.add((a, b))
                    changed = True
    plain = {(i, j) for i in range(k) for j in near[i] if i < j and (i, j) not in arrows and (j, i) not in arrows}
    return arrows, plain


def _matrix(pdf: pd.DataFrame, least: int = 5, least_active: int = 4, least_rows: int = 50):
    factors = sorted({f for p in pdf.pattern for f in p.split(",") if f})
    x = np.array([[f in p for f in factors] for p in (set(q.split(",")) for q in pdf.pattern)], bool).reshape(len(pdf), len(factors))
    n = pdf.n.to_numpy(float)
    present = x.T @ n
    active = (present >= least) & (present <= n.sum() - least)
    if active.sum() < least_active or n.sum() < least_rows:
        return None
    return [f for f, a in zip(factors, active, strict=True) if a], x[:, active], n


def dealt(patterns: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """``patterns`` by ``keys`` in as many tasks as there are cores (``least`` at least): a group is little data and much work, so tasks are not put together for their size."""
    return patterns.repartition(max(least, patterns.sparkSession.sparkContext.defaultParallelism), *keys)


def pc_by_category(patterns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(category, pattern, n) -> (category, src, dst, directed): PC on each category's pattern counts."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if (m := _matrix(pdf)) is not None:
            names, x, n = m
            arrows, plain = pc(x, n, alpha)
            rows = [(pdf.category.iloc[0], names[i], names[j], True) for i, j in sorted(arrows)] + [(pdf.category.iloc[0], names[i], names[j], False) for i, j in sorted(plain)]
        return pd.DataFrame(rows, columns=["category", "src", "dst", "directed"])

    return dealt(patterns, "category").groupBy("category").applyInPandas(learn, "category string, src string, dst string, directed boolean")


def searches(patterns: DataFrame, rounds: int = 30, share: float = 0.8, alpha: float = 0.05, whole: bool = True) -> DataFrame:
    """(category, b, src, dst, directed): networks of ``rounds`` redraws, a redraw being a multinomial over the pattern counts, and with
    ``whole`` those of :func:`pc_by_category` as redraw -1; redraws give undirected edges both ways.

    They are dealt to ``rounds`` tasks at least.
    """
    spread = dealt(patterns.select("*", F.explode(F.sequence(F.lit(-1 if whole else 0), F.lit(rounds - 1))).alias("b")), "category", "b", least=rounds)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pdf = pdf.sort_values("pattern")
        if (m := _matrix(pdf)) is not None:
            names, x, n = m
            b = int(pdf.b.iloc[0])
            if b >= 0:
                rng = np.random.default_rng([b, len(names), int(n.sum())])
                n = rng.multinomial(int(share * n.sum()), n / n.sum()).astype(float)
            arrows, plain = pc(x, n, alpha)
            both = plain if b < 0 else plain | {(j, i) for i, j in plain}
            rows = [(pdf.category.iloc[0], b, names[i], names[j], way) for found, way in ((arrows, True), (both, False)) for i, j in sorted(found)]
        return pd.DataFrame(rows, columns=["category", "b", "src", "dst", "directed"])

    return spread.groupBy("category", "b").applyInPandas(learn, "category string, b int, src string, dst string, directed boolean")


def stability(found: DataFrame, rounds: int = 30) -> DataFrame:
    """(category, src, dst, stability) of :func:`searches`: the share of redraws in which each direction is found."""
    return found.filter("b >= 0").groupBy("category", "src", "dst").agg((F.count("*") / rounds).alias("stability"))


def bootstrap_stability(patterns: DataFrame, rounds: int = 30, share: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """Share of redraws in which each direction is found."""
    return stability(searches(patterns, rounds, share, alpha, whole=False), rounds)


def break_cycles(edges: DataFrame) -> DataFrame:
    """(category, src, dst, score, support) without cycles: of each cycle the weakest edge goes, by score, then confidence of the judgment (``judged``, if there is such a column), then support."""

    def acyclic(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = {(r.src, r.dst): (r.score, 0.0 if pd.isna(sure := getattr(r, "judged", None)) else sure, r.support) for r in pdf.itertuples()}

        def cycle():
            after: dict[str, list[str]] = {}
            for s, t in sorted(weight):
                after.setdefault(s, []).append(t)
            done: set[str] = set()
            for start in sorted(after):
                path, seen, todo = [], set(), [(start, iter(after.get(start, ())))]
                if start in done:
                    continue
                path.append(start)
                seen.add(start)
                while todo:
                    step = next(todo[-1][1], None)
                    if step is None:
                        node = todo.pop()[0]
                        done.add(node)
                        seen.discard(node)
                        path.pop()
                    elif step in seen:
                        ring = path[path.index(step) :] + [step]
                        return list(zip(ring, ring[1:], strict=False))
                    elif step not in done:
                        path.append(step)
                        seen.add(step)
                        todo.append((step, iter(after.get(step, ()))))
            return None

        while (found := cycle()) is not None:
            del weight[min(found, key=lambda e: (*weight[e], e))]
        return pdf[[(r.src, r.dst) in weight for r in pdf.itertuples()]]

    return edges.groupBy("category").applyInPandas(acyclic, edges.schema)


def laplacian_prior(similarity: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """(category, i, j, similarity) -> (category, i, j, prior): kernel of the squared distances in the Laplacian's eigenvectors 2 to 9.

    The scale is the median of the positive distances.  ``vocabulary`` adds factors without a pair.
    """

    def embed(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.i) | set(pdf.j) | set(vocabulary or ()))
        at = {f: k for k, f in enumerate(names)}
        s = np.zeros((len(names), len(names)))
        for r in pdf.itertuples():
            s[at[r.i], at[r.j]] = s[at[r.j], at[r.i]] = r.similarity
        _, vectors = np.linalg.eigh(np.diag(s.sum(1)) - s)
        v = vectors[:, 1:9]
        d2 = ((v[:, None] - v[None]) ** 2).sum(-1)
        apart = d2[d2 > 0]
        kernel = np.exp(-d2 / max(1e-9, np.median(apart) if len(apart) else 1.0))
        return pd.DataFrame([(pdf.category.iloc[0], a, b, float(kernel[at[a], at[b]])) for a in names for b in names if a < b], columns=["category", "i", "j", "prior"])

    return similarity.groupBy("category").applyInPandas(embed, "category string, i string, j string, prior double")


def _evidence(pairs: DataFrame, cooccurrence: DataFrame, precedence: DataFrame, judgments: DataFrame | None, priors: DataFrame | None) -> DataFrame:
    """(category, i, j) with support, score (smoothed share of i before j), relation, confidence and prior.

    ``judgments`` and ``priors`` give a pair in either order; of several judgments the surest counts, ties by relation.
    """
    key = ["category", "i", "j"]
    ahead = precedence.select(*key, F.col("n").alias("_ij"))
    behind = precedence.select("category", F.col("j").alias("i"), F.col("i").alias("j"), F.col("n").alias("_ji"))
    rows = pairs.join(cooccurrence.select(*key, F.col("cooccur").alias("support")), key, "left").join(ahead, key, "left").join(behind, key, "left")
    before, after = F.coalesce("_ij", F.lit(0)), F.coalesce("_ji", F.lit(0))
    rows = rows.withColumn("support", F.coalesce("support", F.lit(0))).withColumn("score", (before + 1) / (before + after + 2)).drop("_ij", "_ji")

    def both(table, there, back):
        """Rows in both orders, from one reading."""
        way = lambda a, b, values: F.struct(F.col(a).alias("i"), F.col(b).alias("j"), *values)
        return table.select("category", F.explode(F.array(way("i", "j", there), way("j", "i", back))).alias("w")).select("category", "w.*")

    if judgments is None:
        rows = rows.select("*", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("confidence"))
    else:
        turned = F.when(F.col("relation") == "a_before_b", "b_before_a").when(F.col("relation") == "b_before_a", "a_before_b").otherwise(F.col("relation"))
        confidence = F.coalesce("confidence", F.lit(0.0)).alias("confidence")
        seen = both(judgments.filter("relation IS NOT NULL"), [F.col("relation"), confidence], [turned.alias("relation"), confidence])
        best = seen.groupBy(*key).agg(F.max(F.struct("confidence", "relation")).alias("b")).select(*key, "b.relation", "b.confidence")
        rows = rows.join(best, key, "left")
    if priors is None:
        return rows.withColumn("prior", F.lit(None).cast("double"))
    return rows.join(both(priors, [F.col("prior")], [F.col("prior")]).groupBy(*key).agg(F.max("prior").alias("prior")), key, "left")


def finished_network(found: DataFrame, cooccurrence: DataFrame, precedence: DataFrame, judgments: DataFrame | None = None, priors: DataFrame | None = None, least: int = 10, least_prior: float = 0.4) -> DataFrame:
    """The edges that a constraint-based search found (category, src, dst, directed) with what else is known, as (category, src, dst, direction_score, support, judged, prior, searched, oriented, open).

    Pairs that occur together in fewer than ``least`` records or whose prior is below ``least_prior``
    go; a pair without a prior stays.  A directed edge (``searched``) keeps its direction and
    scores the share of records in which the source comes first.  An undirected one takes the direction
    that a judgment (category, i, j, relation, confidence) gives it (``oriented``), and the confidence as its score;
    without one (also if judged concurrent or unrelated) it becomes two edges of score 0.5.
    """
    edges = found.select("category", F.col("src").alias("i"), F.col("dst").alias("j"), "directed").distinct()
    rows = _evidence(edges, cooccurrence, precedence, judgments, priors).filter(F.col("support") >= least).filter(F.col("prior").isNull() | (F.col("prior") >= least_prior))
    told = ~F.col("directed") & F.coalesce(F.col("relation").isin("a_before_b", "b_before_a"), F.lit(False))
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    ways = F.when(F.col("directed") | (told & (F.col("relation") == "a_before_b")), F.array(way("i", "j"))).when(told, F.array(way("j", "i"))).otherwise(F.array(way("i", "j"), way("j", "i")))
    score = F.when(F.col("directed"), F.col("score")).when(told, F.col("confidence")).otherwise(0.5)
    rows = rows.select("category", F.explode(ways).alias("w"), score.alias("direction_score"), "support", F.when(told, F.col("confidence")).alias("judged"), "prior", F.col("directed").alias("searched"), told.alias("oriented"), (~F.col("directed")).alias("open"))
    return rows.select("category", "w.src", "w.dst", "direction_score", "support", "judged", "prior", "searched", "oriented", "open")


def dense_network(cooccurrence: DataFrame, precedence: DataFrame, judgments: DataFrame | None = None, priors: DataFrame | None = None, least: int = 5, least_prior: float = 0.2, sure: float = 0.5, ahead: float = 0.65) -> DataFrame:
    """Every pair in the direction that a sure judgment gives it or, where it is silent or unsure, the records: (category, src, dst, score, support, judged, prior, evidence), before cycles are broken.

    Pairs of fewer than ``least`` records or with a prior below ``least_prior`` make no edge, nor do pairs
    judged concurrent or unrelated.  The records give a direction from a share of ``ahead`` on.
    """
    rows = _evidence(cooccurrence.select("category", "i", "j").filter("i <> j").distinct(), cooccurrence, precedence, judgments, priors)
    rows = rows.filter(F.col("support") >= least).filter(F.col("prior").isNull() | (F.col("prior") >= least_prior))
    relation, surely = F.coalesce("relation", F.lit("")), F.coalesce("confidence", F.lit(0.0)) >= sure
    evidence = F.when((relation == "a_before_b") & surely, "judgment").when((relation == "b_before_a") & surely, None).when(relation.isin("concurrent", "unrelated"), None).when(F.col("score") >= ahead, "precedence")
    rows = rows.withColumn("evidence", evidence).filter("evidence IS NOT NULL")
    return rows.select("category", F.col("i").alias("src"), F.col("j").alias("dst"), "score", "support", F.when(F.col("evidence") == "judgment", F.col("confidence")).alias("judged"), "prior", "evidence")
