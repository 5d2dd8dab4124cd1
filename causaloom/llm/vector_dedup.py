"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors of a label form a class that is indexed once.
2. Pivots cut each large label into cells.  A vector belongs to its nearest cell and,
   as a replica, to the second nearest; a cell that holds more than ``BLOCK`` vectors is
   cut into blocks by a hash.
3. In each block a flat graph is built over members and replicas: robust pruning of the
   nearest candidates, some far ones, and the reverse edges.  The lists that a vector
   gets in its blocks are united.
4. Queries (all vectors) go to every block of their own cell and, of their nearest cells and cells
   about as near as the best, to those that the pair of cells sends them to: of two cells one
   asks the other, and a link that it finds counts for both vectors.  How much farther a cell may be is set for each label by an audit:
   sampled queries are compared with all vectors of the label, and the margin is widened
   until the cells that it reaches hold ``ROUTED_RECALL`` of their links.  From the block's medoid, and from the query's own node if it is there, a greedy
   search finds the neighbourhood and expands it as long as it finds vectors within the
   range (less some slack).  Cosines are verified in double precision.
5. Every block audits its recall on some of its queries by brute force; a block below
   ``AUDIT_RECALL`` is searched exhaustively instead.

Only members in their own cell count, so that no link counts twice; links are counted
and joined into components inside the blocks, and never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_group, pieces, stored
from .components import components

THRESHOLD = 0.93
CELL, BLOCK = 400, 2048
MOST_PIVOTS = 16_384
#: A query searches its nearest cells, and those that are as near as the best but for a margin (the least one).
PROBES, MARGIN = 3, 0.22
#: Share of sampled queries' links that routing must reach, queries sampled for each pivot, most of a label, step of the margin.
ROUTED_RECALL, AUDIT_PER_PIVOT, MOST_AUDITED, MARGIN_STEP = 0.99, 8, 256, 0.01
NEAR, FAR, POOL, ALPHA = 20, 8, 40, 1.2
BEAM, SLACK = 24, 0.08
AUDIT_RECALL = 0.97


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, unit, class) of every row; unit is null where the vector links with nothing."""

    def scan(batches):
        for whole in batches:
            for part in pieces(whole, 4096):
                ids, labels, vectors = part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist()
                units, keys = [], []
                for label, v in zip(labels, vectors, strict=True):
                    x = np.array(v if v is not None else [], dtype=np.float64) if v is not None and None not in v else np.zeros(0)
                    with np.errstate(over="ignore", invalid="ignore"):
                        norm = np.linalg.norm(x / top) * top if len(x) and np.isfinite(x).all() and (top := np.abs(x).max()) > 0 else 0.0
                    if label is None or not norm or not np.isfinite(norm):
                        units.append(None)
                        keys.append(None)
                    else:
                        units.append((x / norm).tobytes())
                        keys.append(xxhash.xxh3_128_hexdigest(units[-1]))
                yield pa.RecordBatch.from_arrays([ids, part.column(1), pa.array(units, pa.binary()), pa.array(keys, pa.string())], ["vec_id", "label", "unit", "class"])

    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return e.mapInArrow(scan, "vec_id long, label string, unit binary, class string")


def _space(unit: bytes, label: str) -> str:
    """Vectors are compared within a label and a dimension."""
    return f"{len(unit) // 8}:{label}"


def choose_pivots(nodes: DataFrame, cell: int = CELL, most: int = MOST_PIVOTS) -> dict[str, np.ndarray]:
    """Pivots of the spaces (label and dimension) with more than ``cell`` vectors, at most ``most`` in all.

    They are the space's vectors of smallest hash.  The bound keeps the pivots that are
    sent to the executors small; it makes cells larger, not results fewer.
    """
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
    total = sizes.agg(F.sum("n").alias("n")).first().n or 0
    per = max(cell, -(-total // most))
    share = sizes.select("space", F.ceil(F.col("n") / per).alias("k"), "n")
    lots = nodes.join(F.broadcast(share) if total < 1_000_000_000 else share, "space")
    rank = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = lots.filter(rank < (F.col("k") * 1.5 + 4) / F.col("n")).select("space", "k", "node", "unit").collect()
    out: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r.space, xxhash.xxh3_64_intdigest(str(r.node)))):
        have = out.setdefault(r.space, [])
        if len(have) < r.k:
            have.append(np.frombuffer(bytes(r.unit)))
    return {s: np.stack(v) for s, v in out.items() if len(v) > 1}


def probed_cells(p: np.ndarray, v: np.ndarray, margin: float, threshold: float = THRESHOLD) -> np.ndarray:
    """Cells that a query searches, nearest first.

    Cells within the margin that cannot hold a link are left out: for a link u-v with
    the pivots b of u and c of v, (b - c) u <= (b - c) (u - v) <= |b - c| |u - v|.
    """
    sim = p @ v
    few = min(PROBES, len(p))
    at = np.union1d(np.flatnonzero(sim >= sim.max() - margin), np.argpartition(-sim, few - 1)[:few])
    at = at[np.argsort(-sim[at], kind="stable")]
    apart = np.sqrt(np.maximum(0, 2 - 2 * (p[at] @ p[at[0]])))
    able = sim[at[0]] - sim[at] <= apart * np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    able[:few] = True
    return at[able]


def asks(own: int, others: np.ndarray) -> np.ndarray:
    """Whether vectors of the cell ``own`` ask the cells ``others``: of two cells one asks the other; a cell asks itself."""
    return (others == own) | ((own < others) == ((own + others) % 2 == 0))


def audited_margins(nodes: DataFrame, pivots: dict[str, np.ndarray], threshold: float = THRESHOLD) -> dict[str, float]:
    """Margin of each space: the least, from ``MARGIN`` on, that leads sampled queries to ``ROUTED_RECALL`` of their links.

    The queries are compared with all vectors of their space, themselves left out.
    """
    if not pivots:
        return {}
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(s, min(MOST_AUDITED, AUDIT_PER_PIVOT * len(p))) for s, p in pivots.items()], "space string, k long")
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n")).join(F.broadcast(wanted), "space")
    rank = F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    asked: dict[str, list] = {}
    for r in nodes.join(F.broadcast(sizes), "space").filter(rank < F.col("k") / F.col("n")).select("space", "node", "unit").collect():
        asked.setdefault(r.space, []).append((r.node, np.frombuffer(bytes(r.unit))))
    queries = {s: (np.array([n for n, _ in q], np.int64), np.stack([v for _, v in q])) for s, q in asked.items()}
    shared = spark.sparkContext.broadcast((pivots, queries))

    def scan(batches):
        (pivots, queries), to_pivots, total = shared.value, {}, {}
        for whole in batches:
            for part in pieces(whole, 4096):
                spaces = np.array(part.column(0).to_pylist(), object)
                for s in set(spaces.tolist()) & queries.keys():
                    rows = np.flatnonzero(spaces == s)
                    mine = part.take(pa.array(rows))
                    x = np.stack([np.frombuffer(u) for u in mine.column(3).to_pylist()])
                    ids, q = queries[s]
                    i, j = np.nonzero((x @ q.T >= threshold) & (np.asarray(mine.column(1))[:, None] != ids))
                    if not len(i):
                        continue
                    if s not in to_pivots:
                        to_pivots[s] = np.sort(pq := pivots[s] @ q.T, axis=0)[::-1][: PROBES], pq
                    top, pq = to_pivots[s]
                    hit, back = np.unique(i, return_inverse=True)
                    cell = np.concatenate([np.argmax(pivots[s] @ x[hit[lo : lo + 256]].T, axis=0) for lo in range(0, len(hit), 256)])[back]
                    need = np.where(pq[cell, j] >= top[-1, j], 0, np.ceil((top[0, j] - pq[cell, j]) / MARGIN_STEP)).astype(np.int64)
                    steps = np.bincount(need, weights=np.asarray(mine.column(2))[i].astype(float), minlength=int(2 / MARGIN_STEP) + 2)
                    total[s] = total[s] + steps if s in total else steps
        for s, steps in total.items():
            at = np.flatnonzero(steps)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(steps[at], pa.float64())], ["space", "step", "links"])

    found = nodes.select("space", "node", "copies", "unit").mapInArrow(scan, "space string, step long, links double").groupBy("space", "step").agg(F.sum("links").alias("links")).collect()
    needs: dict[str, list] = {}
    for r in found:
        needs.setdefault(r.space, []).append((r.step, r.links))
    out = {}
    for s, steps in needs.items():
        reached, links = 0.0, sum(n for _, n in steps)
        for step, n in sorted(steps):
            reached += n
            if reached >= ROUTED_RECALL * links:
                out[s] = max(MARGIN, step * MARGIN_STEP)
                break
    return out


def robust_prune(x: np.ndarray, p: int, pool: np.ndarray, limit: int, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of node ``p`` from ``pool``: nearest first, each ruling out those much nearer to it than to ``p``."""
    pool = pool[pool != p]
    sim = x[pool] @ x[p]
    pool = pool[order := np.argsort(-sim, kind="stable")]
    own = np.sqrt(np.maximum(0, 2 - 2 * sim[order]))
    between = np.sqrt(np.maximum(0, 2 - 2 * (x[pool] @ x[pool].T)))
    alive, chosen = np.ones(len(pool), bool), []
    for i in range(len(pool)):
        if alive[i]:
            chosen.append(pool[i])
            if len(chosen) >= limit:
                break
            alive &= alpha * between[i] > own
    return np.array(chosen, np.int64)


def build_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency lists of a block: pruned near and far neighbours, and reverse edges."""
    n = len(x)
    if n <= NEAR + FAR:
        return [np.array([j for j in range(n) if j != i], np.int64) for i in range(n)]
    rng = np.random.default_rng(seed)
    lists: list[set] = [set() for _ in range(n)]
    k = min(POOL, n - 1)
    x32 = x.astype(np.float32)
    for lo in range(0, n, 512):
        sim = x32[lo : lo + 512] @ x32.T
        sim[np.arange(len(sim)), lo + np.arange(len(sim))] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        for i in range(len(near)):
            p = lo + i
            for limit, pool in ((NEAR, near[i]), (FAR, rng.integers(0, n, 2 * FAR))):
                for q in robust_prune(x, p, np.unique(pool), limit).tolist():
                    lists[p].add(q)
                    lists[q].add(p)
    out = []
    for p, found in enumerate(lists):
        found = np.array(sorted(found), np.int64)
        out.append(robust_prune(x, p, found, 2 * (NEAR + FAR)) if len(found) > 3 * (NEAR + FAR) else found)
    return out


def range_search(x: np.ndarray, graph: list[np.ndarray], query: np.ndarray, starts: list[int], threshold: float, slack: float = SLACK, beam: int = BEAM) -> np.ndarray:
    """Nodes within the threshold of the query that the graph leads to from ``starts``."""
    n = len(x)
    seen, opened = np.zeros(n, bool), np.zeros(n, bool)
    sims = np.full(n, -2.0)
    new = np.array(starts, np.int64)
    seen[new] = True
    sims[new] = x[new] @ query
    best = new
    while True:  # greedy: open the most similar nodes of the beam until all are open
        best = best[np.argsort(-sims[best], kind="stable")[:beam]]
        todo = best[~opened[best]][:4]
        if not len(todo):
            break
        opened[todo] = True
        new = np.unique(np.concatenate([graph[i] for i in todo]))
        new = new[~seen[new]]
        seen[new] = True
        sims[new] = x[new] @ query
        best = np.concatenate([best, new])
    while True:  # range: open everything near enough
        todo = np.flatnonzero((sims >= threshold - slack) & ~opened)
        if not len(todo):
            break
        opened[todo] = True
        new = np.unique(np.concatenate([graph[i] for i in todo]))
        new = new[~seen[new]]
        seen[new] = True
        sims[new] = x[new] @ query
    return np.flatnonzero(sims >= threshold)


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        self.up.setdefault(a, a)
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def search_block(own: list, x: np.ndarray, copies: np.ndarray, graph: list[np.ndarray], primary: np.ndarray, queries: list, q: np.ndarray, threshold: float, visits: np.ndarray):
    """(links of each query to the block's own members, links of each member to queries, union of the linked nodes, audited and found links).

    ``visits`` are the copies of a query from another cell, whose links count for the
    members too; 0 for one of the own cell, which the members ask themselves.
    """
    place = {node: i for i, node in enumerate(own)}
    medoid = int(np.argmax(x @ x.mean(0)))
    union, links, back = _Union(), np.zeros(len(queries), np.int64), np.zeros(len(own), np.int64)

    def scan(i: int) -> np.ndarray:
        return np.flatnonzero(x @ q[i] >= threshold)

    def look(i: int) -> np.ndarray:
        starts = [medoid] if (at := place.get(queries[i])) is None or at == medoid else [medoid, at]
        return range_search(x, graph, q[i], starts, threshold)

    def note(i: int, found: np.ndarray) -> int:
        found = found[primary[found]]
        total = 0
        for j in found.tolist():
            if own[j] != queries[i]:
                total += int(copies[j])
                back[j] += visits[i]
                union.join(queries[i], own[j])
        links[i] = total
        return total

    audit = [i for i in range(len(queries)) if xxhash.xxh3_64_intdigest(str(queries[i])) % 16 == 0]
    true = found = 0
    exact = len(own) <= 2 * BEAM
    if not exact:
        for i in audit:
            full = np.setdiff1d(scan(i), [place.get(queries[i], -1)])
            got = np.intersect1d(look(i), full)
            true += len(full)
            found += len(got)
        exact = found < AUDIT_RECALL * true
    for i in range(len(queries)):
        note(i, scan(i) if exact else look(i))
    return links, back, union, true, found


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding, label).

    Vectors that are null, zero or hold a null or non-finite component, and vectors with
    a null label, link with nothing.  Vectors of different dimension never link.  Equal
    vectors are linked with each other.  Rows with a null vec_id keep null ids; repeated
    ids count as further copies.  An empty table gives no rows.
    """
    rows = stored(unit_vectors(embeddings), "units")
    valid = rows.filter("unit is not null and vec_id is not null")
    nodes = valid.groupBy("label", "class").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    nodes = nodes.withColumn("space", F.concat_ws(":", (F.length("unit") / 8).cast("int").cast("string"), "label"))
    nodes = stored(nodes, "nodes")
    spark = embeddings.sparkSession
    chosen = choose_pivots(nodes, CELL)
    pivots = spark.sparkContext.broadcast((chosen, audited_margins(nodes, chosen, threshold)))

    def route(batches):
        """A row for each cell of a node: role 0 its own, 1 replica and query, 2 query only, 3 replica only."""
        for whole in batches:
            for part in pieces(whole, 4096):
                spaces = part.column(0).to_pylist()
                units = part.column(3).to_pylist()
                at, cells, roles = [], [], []
                for i, s in enumerate(spaces):
                    p = pivots.value[0].get(s)
                    if p is None:
                        at.append(i)
                        cells.append(s + "/0")
                        roles.append(0)
                        continue
                    near = probed_cells(p, np.frombuffer(units[i]), pivots.value[1].get(s, MARGIN), threshold)
                    for rank, (c, asked) in enumerate(zip(near.tolist(), asks(near[0], near).tolist(), strict=True)):
                        if rank < 2 or asked:
                            at.append(i)
                            cells.append(f"{s}/{c}")
                            roles.append(min(2, rank) if asked else 3)
                took = part.select([1, 2, 3]).take(pa.array(at, pa.int64())) if at else part.select([1, 2, 3]).slice(0, 0)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(roles, pa.int32()), *took.columns], ["cell", "role", "node", "copies", "unit"])

    routed = stored(nodes.select("space", "node", "copies", "unit").mapInArrow(route, "cell string, role int, node long, copies long, unit binary"), "routed")
    large = routed.filter("role <> 2").groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    large = stored(large.select("cell", "blocks"), "large_cells")
    spread = routed.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    held = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    # a node is a member of one block of its cell and, unless it is a replica only, a query in all of them
    spread = spread.select("cell", "role", "node", "copies", "unit", held.alias("home"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("part"))
    spread = spread.withColumn("block", F.concat_ws("#", "cell", "part")).withColumn("member", (F.col("role") != 2) & (F.col("home") == F.col("part"))).select("block", "role", "node", "copies", "unit", "member").filter("member or role <> 3")

    def build(key, batches):
        ids, x = [], []
        for batch in batches:
            ids += batch.column(1).to_pylist()
            x += [np.frombuffer(u) for u in batch.column(2).to_pylist()]
        order = np.argsort(np.array(ids), kind="stable")
        ids, x = [ids[i] for i in order], np.stack([x[i] for i in order])
        graph = build_graph(x, xxhash.xxh3_64_intdigest(key[0].as_py()) % 2**32)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([[ids[j] for j in g] for g in graph], pa.list_(pa.int64()))], ["node", "near"])

    graphs = spread.filter("member").select("block", "node", "unit").groupBy("block").applyInArrow(by_group(build), "node long, near array<long>")
    united = stored(graphs.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")), "graph")

    def search(key, batches):
        own, copies, x, near, primary, queries, q, visits = [], [], [], [], [], [], [], []
        for batch in batches:
            for role, node, n, unit, member, list_ in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                v = np.frombuffer(unit)
                if role != 3:
                    queries.append(node)
                    q.append(v)
                    visits.append(n if role else 0)
                if member:
                    own.append(node)
                    copies.append(n)
                    x.append(v)
                    near.append(list_ or [])
                    primary.append(role == 0)
        nodes_out, links_out, root_out, true, found = [], [], [], 0, 0
        if own and queries:
            place = {node: i for i, node in enumerate(own)}
            graph = [np.array([place[j] for j in g if j in place], np.int64) for g in near]
            links, back, union, true, found = search_block(own, np.stack(x), np.array(copies), graph, np.array(primary), queries, np.stack(q), threshold, np.array(visits, np.int64))
            total = dict.fromkeys([*queries, *union.up], 0)
            for n, more in (*zip(queries, links.tolist(), strict=True), *zip(own, back.tolist(), strict=True)):
                if more:
                    total[n] += more
            nodes_out, links_out = list(total), list(total.values())
            root_out = [union.find(n) if n in union.up else n for n in total]
        nodes_out.append(None)
        links_out.append(true)
        root_out.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(nodes_out, pa.int64()), pa.array(links_out, pa.int64()), pa.array(root_out, pa.int64())], ["node", "links", "root"])

    asked = spread.join(united, "node", "left").select("block", "role", "node", "copies", "unit", "member", F.when(F.col("member"), F.col("near")).alias("near"))
    found = stored(asked.groupBy("block").applyInArrow(by_group(search), "node long, links long, root long"), "found").filter("node is not null")
    edges = stored(found.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")), "vector_edges")
    roots = components(edges) if edges.limit(1).count() else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    per_node = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = nodes.select("label", "class", "node", "copies").join(per_node, "node", "left").join(roots, "node", "left")
    result = result.select("label", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    out = rows.select("vec_id", "label", "class").join(result, ["label", "class"], "left")
    none = F.col("vec_id").isNull()
    component = F.when(none, F.col("vec_id")).otherwise(F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.when(none, F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
