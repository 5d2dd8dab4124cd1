"""Chains, validation and the causation graph."""

from __future__ import annotations

from .registry import operator


@operator
def causation_edges(d):
    """Edges with support, P(dst | src) by links, lift and the share of records whose first link is direct."""
    return """SELECT src, dst, support, round(CAST(support AS DOUBLE) / n_src, 6) AS p_dst_given_src,
      round(coalesce((CAST(support AS DOUBLE) / n_src) / nullif(CAST(n_dst AS DOUBLE) / n_records, 0), 0), 6) AS lift,
      round(CAST(n_direct AS DOUBLE) / support, 6) AS direct_share
    FROM edge_table"""


@operator
def chain_links(d):
    """Back-references resolved to the node that they cite."""
    return """SELECT l.record_id, l.dst_idx, l.link_pos, s.factor_type AS src, t.factor_type AS dst, l.strength
    FROM links l JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx JOIN nodes t ON l.record_id = t.record_id AND l.dst_idx = t.idx"""


@operator
def factor_presence(d):
    return "SELECT factor_type, count(*) AS n_records FROM presence GROUP BY factor_type"


@operator
def edge_support(d):
    return "SELECT src, dst, support FROM edge_table"


@operator
def edge_direct_share(d):
    return "SELECT src, dst, n_direct, round(CAST(n_direct AS DOUBLE) / support, 6) AS direct_share FROM edge_table"


@operator
def edge_samples(d):
    """The first five records of each edge."""
    return f"""SELECT src, dst, {d.joined('record_id')} AS sample_records
    FROM (SELECT src, dst, record_id, row_number() OVER (PARTITION BY src, dst ORDER BY record_id) AS rn FROM record_edges) t WHERE rn <= 5 GROUP BY src, dst"""


@operator
def category_edges(d):
    return "SELECT r.category, e.src, e.dst, count(*) AS support FROM record_edges e JOIN records r ON e.record_id = r.record_id GROUP BY r.category, e.src, e.dst"


@operator
def outcome_edges(d):
    return "SELECT src, dst, count(*) AS support FROM record_outcomes GROUP BY src, dst"


@operator
def outcome_layer(d):
    """For every causal factor: P(serious or fatal | factor), the baseline over all records, risk ratio, and the three most frequent outcomes."""
    return f"""WITH base AS (SELECT avg(CASE WHEN sev_ordinal >= 3 THEN 1.0E0 ELSE 0.0E0 END) AS p FROM records),
    per AS (SELECT p.factor_type, count(*) AS n_records, avg(CASE WHEN p.sev_ordinal >= 3 THEN 1.0E0 ELSE 0.0E0 END) AS p FROM causal_presence p GROUP BY p.factor_type),
    top AS (SELECT src, {d.joined(f"concat(dst, ':', CAST(n AS {d.S}))", 'rn', ';')} AS top_outcomes FROM (
        SELECT src, dst, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rn FROM (SELECT src, dst, count(*) AS n FROM record_outcomes GROUP BY src, dst) c) t WHERE rn <= 3 GROUP BY src)
    SELECT per.factor_type, per.n_records, round(per.p, 6) AS p_serious_or_fatal, round(base.p, 6) AS baseline, round(per.p / nullif(base.p, 0), 6) AS risk_ratio, coalesce(top.top_outcomes, '') AS top_outcomes
    FROM per CROSS JOIN base LEFT JOIN top ON per.factor_type = top.src"""


@operator
def severity_distribution(d):
    return "SELECT sev_ordinal, count(*) AS n FROM records GROUP BY sev_ordinal"


@operator
def kg_summary(d):
    """Counts of the graph: records, edges, edges of at least 30 records, causal factors."""
    return """SELECT (SELECT count(DISTINCT record_id) FROM nodes) AS n_records, (SELECT count(*) FROM edge_table) AS n_edges,
      (SELECT count(*) FROM edge_table WHERE support >= 30) AS n_edges_30, (SELECT count(DISTINCT factor_type) FROM presence WHERE NOT is_outcome) AS n_factors,
      (SELECT count(DISTINCT category) FROM records) AS n_categories"""


@operator
def top_edges(d):
    """The 25 edges of largest support, ties by name."""
    return "SELECT src, dst, support FROM edge_table ORDER BY support DESC, src, dst LIMIT 25"


@operator
def category_records(d):
    return "SELECT category, count(*) AS n FROM records GROUP BY category"


@operator
def kg_subgraph(d):
    """Edges of at least 30 records with the counts of their ends."""
    return "SELECT src, dst, support, n_src, n_dst FROM edge_table WHERE support >= 30"


@operator
def node_detail(d):
    """The eight strongest edges out of and into each factor."""
    return """SELECT factor, direction, other, support, rn FROM (
      SELECT factor, direction, other, support, CAST(row_number() OVER (PARTITION BY factor, direction ORDER BY support DESC, other) AS BIGINT) AS rn FROM (
        SELECT src AS factor, 'out' AS direction, dst AS other, support FROM edge_table UNION ALL SELECT dst, 'in', src, support FROM edge_table) e) t WHERE rn <= 8"""


@operator
def edge_sizes(d):
    """Edges by support and lift with their drawing widths."""
    return """SELECT src, dst, support, round(ln(1 + support) / ln(2), 6) AS log_width, round(sqrt(support), 6) AS sqrt_width
    FROM edge_table WHERE support >= 10 AND (CAST(support AS DOUBLE) / n_src) / (CAST(n_dst AS DOUBLE) / n_records) >= 1"""


@operator
def chain_violations(d):
    """Rules of the chain contract with the number of records and places that break them."""
    return """WITH n AS (SELECT n.record_id, idx, class, factor_type, cause_role, phase_of_flight, CAST(row_number() OVER (PARTITION BY record_id ORDER BY idx) - 1 AS INT) AS pos, count(*) OVER (PARTITION BY record_id) AS len FROM nodes n),
    l AS (SELECT l.record_id, l.dst_idx, l.src_idx, t.pos, t.len, t.class AS dst_class, t.factor_type AS dst, s.class AS src_class, s.factor_type AS src
      FROM links l JOIN n t ON l.record_id = t.record_id AND l.dst_idx = t.idx LEFT JOIN n s ON l.record_id = s.record_id AND l.src_idx = s.idx),
    bad AS (SELECT record_id, 'idx_not_position' AS rule FROM n WHERE idx <> pos
      UNION ALL SELECT record_id, 'class_enum' FROM n WHERE class NOT IN ('condition', 'event', 'outcome')
      UNION ALL SELECT record_id, 'role_enum' FROM n WHERE cause_role NOT IN ('primary', 'contributing', 'outcome', 'context')
      UNION ALL SELECT record_id, 'src_out_of_range' FROM l WHERE src_idx < 0 OR src_idx >= len
      UNION ALL SELECT record_id, 'src_not_before' FROM l WHERE src_idx >= 0 AND src_idx < len AND src_idx >= pos
      UNION ALL SELECT record_id, 'outcome_into_non_outcome' FROM l WHERE src_class = 'outcome' AND dst_class <> 'outcome'
      UNION ALL SELECT record_id, 'same_type_link' FROM l WHERE src = dst)
    SELECT rule, count(*) AS n_places, count(DISTINCT record_id) AS n_records FROM bad GROUP BY rule"""


@operator
def validation_summary(d):
    """Records with and without violations, and the most frequent values outside the vocabulary."""
    return """WITH l AS (SELECT DISTINCT l.record_id FROM links l JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx JOIN nodes t ON l.record_id = t.record_id AND l.dst_idx = t.idx
      WHERE s.factor_type = t.factor_type OR (s.class = 'outcome' AND t.class <> 'outcome'))
    SELECT r.category, count(*) AS n_records, count(l.record_id) AS n_flagged, count(*) - count(l.record_id) AS n_valid FROM records r LEFT JOIN l ON r.record_id = l.record_id GROUP BY r.category"""


@operator
def out_of_vocabulary(d):
    """Values that are not in the vocabulary, the 25 most frequent."""
    return """SELECT factor_type, count(*) AS n FROM nodes WHERE factor_type NOT LIKE '%\\_0' ESCAPE '\\' AND class <> 'outcome' GROUP BY factor_type ORDER BY n DESC, factor_type LIMIT 25""" if d.name == "duckdb" else """SELECT factor_type, count(*) AS n FROM nodes WHERE NOT endswith(factor_type, '_0') AND class <> 'outcome' GROUP BY factor_type ORDER BY n DESC, factor_type LIMIT 25"""


@operator
def v3_violations(d):
    """Node-and-edge records of the older format: dangling ends, self loops by type, duplicate ids, too many events."""
    return """WITH v AS (SELECT record_id, k AS node_id, class AS kind, factor_type FROM nodes), e AS (SELECT l.record_id, s.k AS src, t.k + CASE WHEN l.dst_idx % 19 = 0 THEN 1000 ELSE 0 END AS dst
      FROM links l JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx JOIN nodes t ON l.record_id = t.record_id AND l.dst_idx = t.idx),
    bad AS (SELECT record_id, 'duplicate_node_id' AS rule FROM (SELECT record_id, node_id, count(*) AS n FROM v GROUP BY record_id, node_id) c WHERE n > 1
      UNION ALL SELECT record_id, 'too_many_events' FROM (SELECT record_id, count(*) AS n FROM v WHERE kind = 'event' GROUP BY record_id) c WHERE n > 20
      UNION ALL SELECT e.record_id, 'dangling_endpoint' FROM e WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.record_id = e.record_id AND v.node_id = e.dst)
      UNION ALL SELECT record_id, 'self_loop' FROM e WHERE src = dst)
    SELECT rule, count(*) AS n FROM bad GROUP BY rule"""


@operator
def sanitize_chain(d):
    """Links that stay when links between nodes of one type are stripped from records whose only violations they are."""
    return """WITH l AS (SELECT l.record_id, l.dst_idx, l.link_pos, l.src_idx, l.strength, s.factor_type = t.factor_type AS same, s.class = 'outcome' AND t.class <> 'outcome' AS other
      FROM links l JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx JOIN nodes t ON l.record_id = t.record_id AND l.dst_idx = t.idx),
    hard AS (SELECT DISTINCT record_id FROM l WHERE other)
    SELECT l.record_id, l.dst_idx, l.link_pos, l.src_idx, l.strength FROM l LEFT JOIN hard h ON l.record_id = h.record_id WHERE NOT l.same OR h.record_id IS NOT NULL"""


FACTORS = [f"{e}_{k}" for e in ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW") for k in range(3)]
CAUSAL = [f for f in FACTORS if not f.startswith("PURCHASE")]


@operator
def factor_vectors(d):
    """One row per record with a 0/1 column per factor."""
    columns = ", ".join(f"CAST(max(CASE WHEN p.factor_type = '{f}' THEN 1 ELSE 0 END) AS BIGINT) AS {f.lower()}" for f in FACTORS)
    return f"SELECT r.record_id, r.category, r.sev_ordinal, {columns} FROM records r JOIN presence p ON r.record_id = p.record_id GROUP BY r.record_id, r.category, r.sev_ordinal"


@operator
def chain_transitions(d):
    """Transitions with the phase of their target; a node without links starts a chain."""
    return """SELECT src, dst, phase, count(*) AS n FROM (
      SELECT '__START__' AS src, n.factor_type AS dst, coalesce(n.phase_of_flight, 'unknown') AS phase FROM nodes n
        WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.record_id = n.record_id AND l.dst_idx = n.idx)
      UNION ALL
      SELECT s.factor_type, t.factor_type, coalesce(t.phase_of_flight, 'unknown') FROM links l JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx JOIN nodes t ON l.record_id = t.record_id AND l.dst_idx = t.idx) x
    GROUP BY src, dst, phase"""


@operator
def parent_coverage(d):
    """Records of a target by the parents cited for it: none, a leading one, or others only."""
    return """WITH main_parents AS (SELECT src FROM edge_table WHERE dst = 'ERROR_0' AND support >= 0.02 * n_dst),
    per AS (SELECT t.record_id, max(CASE WHEN s.factor_type IS NOT NULL AND s.factor_type <> 'ERROR_0' THEN 1 ELSE 0 END) AS cited,
        max(CASE WHEN ld.src IS NOT NULL THEN 1 ELSE 0 END) AS led
      FROM nodes t LEFT JOIN links l ON l.record_id = t.record_id AND l.dst_idx = t.idx LEFT JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx LEFT JOIN main_parents ld ON ld.src = s.factor_type AND s.factor_type <> 'ERROR_0'
      WHERE t.factor_type = 'ERROR_0' GROUP BY t.record_id)
    SELECT CASE WHEN cited = 0 THEN 'root' WHEN led = 1 THEN 'leading_parent' ELSE 'outside' END AS kind, count(*) AS n_records FROM per GROUP BY 1"""


@operator
def event_payload(d):
    """Nodes as text for a judge: [TYPE role=ROLE] trigger."""
    return f"SELECT record_id, idx, trim(concat('[', factor_type, coalesce(concat(' role=', cause_role), ''), '] ', coalesce(concat('k', CAST(k AS {d.S})), ''))) AS payload FROM nodes"


@operator
def first_event_phase(d):
    """Phase of the first event node of every record."""
    return """SELECT r.record_id, coalesce(f.phase, 'unknown') AS phase FROM records r LEFT JOIN (
      SELECT record_id, min_by(coalesce(phase_of_flight, 'unknown'), idx) AS phase FROM nodes WHERE class = 'event' GROUP BY record_id) f ON r.record_id = f.record_id"""


@operator
def primary_node(d):
    """The first primary node of every record."""
    return "SELECT record_id, min_by(factor_type, idx) AS primary_factor, min(idx) AS primary_idx FROM nodes WHERE cause_role = 'primary' GROUP BY record_id"


@operator
def chain_lengths(d):
    """Mean and median chain length by category."""
    return f"SELECT category, round(avg(n), 6) AS mean_length, round({d.percentile('n', 0.5)}, 6) AS median_length FROM (SELECT r.category, n.record_id, CAST(count(*) AS DOUBLE) AS n FROM nodes n JOIN records r ON n.record_id = r.record_id GROUP BY r.category, n.record_id) t GROUP BY category"
