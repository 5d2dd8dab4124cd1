"""Evaluation statistics."""

from __future__ import annotations

from .registry import fixture, operator


@fixture
def matches(d):
    """Judge matches: per record, finding index and matched node index (null: none)."""
    h = d.md5_number(f"concat(record_id, '/', CAST(idx AS {d.S}))")
    return f"SELECT record_id, idx AS finding, cause_role, class, CASE WHEN {h} % 10 < 3 THEN NULL ELSE CAST({h} % 12 AS INT) END AS node, count(*) OVER (PARTITION BY record_id) AS n_nodes, {h} AS h FROM nodes"


@operator
def semantic_recall(d):
    """Micro and macro recall of findings, and precision of the nodes that some finding matched."""
    return """SELECT count(*) AS n_findings, count(node) AS n_matched, round(CAST(count(node) AS DOUBLE) / count(*), 6) AS recall_micro,
      (SELECT round(avg(r), 6) FROM (SELECT record_id, CAST(count(node) AS DOUBLE) / count(*) AS r FROM matches GROUP BY record_id) t) AS recall_macro,
      (SELECT round(CAST(count(DISTINCT CASE WHEN node < n_nodes THEN record_id || '/' || CAST(node AS {S}) END) AS DOUBLE) / count(*), 6) FROM matches) AS precision_micro
    FROM matches""".replace("{S}", d.S)


@operator
def precision_by_role(d):
    return """SELECT n.cause_role, n.class, count(*) AS n_nodes, count(m.record_id) AS n_matched, round(CAST(count(m.record_id) AS DOUBLE) / count(*), 6) AS prec
    FROM nodes n LEFT JOIN (SELECT DISTINCT record_id, node FROM matches WHERE node < n_nodes) m ON m.record_id = n.record_id AND m.node = n.idx GROUP BY n.cause_role, n.class"""


@operator
def recall_by_group(d):
    return "SELECT class, count(*) AS n, round(CAST(count(node) AS DOUBLE) / count(*), 6) AS recall FROM matches GROUP BY class"


@operator
def judge_agreement(d):
    """Two judges on the same findings: agreement, and precision of their union."""
    return """SELECT count(*) AS n, count(*) FILTER (WHERE (h % 10 < 3) = (h % 100 < 35)) AS n_agree, round(avg(CASE WHEN (h % 10 < 3) = (h % 100 < 35) THEN 1E0 ELSE 0E0 END), 6) AS agreement, round(avg(CASE WHEN h % 10 >= 3 OR h % 100 >= 35 THEN 1E0 ELSE 0E0 END), 6) AS union_share FROM matches"""


@fixture
def runs(d):
    """Factors of two runs over the same records."""
    h = d.md5_number("concat(record_id, factor_type)")
    return f"SELECT record_id, factor_type, 'a' AS run FROM presence WHERE {h} % 10 < 8 UNION ALL SELECT record_id, factor_type, 'b' FROM presence WHERE {h} % 10 > 1"


@fixture
def jaccards(d):
    return """SELECT record_id, CAST(count(*) FILTER (WHERE n = 2) AS DOUBLE) / count(*) AS j FROM (SELECT record_id, factor_type, count(*) AS n FROM runs GROUP BY record_id, factor_type) t GROUP BY record_id"""


@operator
def run_jaccard(d):
    return "SELECT record_id, round(j, 6) AS jaccard FROM jaccards"


@operator
def self_consistency(d):
    return f"SELECT count(*) AS n, round(avg(j), 6) AS mean_jaccard, round({d.percentile('j', 0.5)}, 6) AS median_jaccard, round(avg(CASE WHEN j = 1 THEN 1E0 ELSE 0E0 END), 6) AS identical FROM jaccards"


@operator
def gold_scores(d):
    """Per record recall averaged, with severity agreement."""
    return """SELECT r.category, count(*) AS n, round(avg(m.r), 6) AS macro_recall, round(avg(CASE WHEN r.sev_ordinal = CAST(m.h % 5 AS INT) THEN 1E0 ELSE 0E0 END), 6) AS severity_agreement
    FROM records r JOIN (SELECT record_id, CAST(count(node) AS DOUBLE) / count(*) AS r, min(h) AS h FROM matches GROUP BY record_id) m ON m.record_id = r.record_id GROUP BY r.category"""


@operator
def adjudication_pairs(d):
    """Finding by node sheet: every finding of a record with every node of it."""
    return "SELECT a.record_id, a.finding, b.idx AS node_idx, b.factor_type, CASE WHEN a.node = b.idx THEN 1 ELSE 0 END AS judge_match FROM matches a JOIN nodes b ON a.record_id = b.record_id"


@operator
def auc(d):
    """Rank statistic with ties at one half, from counts by score."""
    return """WITH s AS (SELECT score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scored GROUP BY score),
    c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(CAST(sum(p * (below + n * 0.5E0)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) AS auc FROM c"""


@fixture
def placements(d):
    """Structural components of two scores: per case the share of the other class below it, ties half."""
    return """SELECT doc_id, y, CASE WHEN y = 1 THEN (b1 - p1 + 0.5E0 * (e1 - q1)) / n0 ELSE (n1 - p1 - q1 + 0.5E0 * q1) / n1 END AS v, CASE WHEN y = 1 THEN (b2 - p2 + 0.5E0 * (e2 - q2)) / n0 ELSE (n1 - p2 - q2 + 0.5E0 * q2) / n1 END AS v2 FROM (
      SELECT doc_id, y, CAST(sum(1) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING) - sum(1) OVER (PARTITION BY score) AS DOUBLE) AS b1, CAST(sum(1) OVER (PARTITION BY score) AS DOUBLE) AS e1,
        CAST(sum(y) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING) - sum(y) OVER (PARTITION BY score) AS DOUBLE) AS p1, CAST(sum(y) OVER (PARTITION BY score) AS DOUBLE) AS q1,
        CAST(sum(1) OVER (ORDER BY score2 RANGE UNBOUNDED PRECEDING) - sum(1) OVER (PARTITION BY score2) AS DOUBLE) AS b2, CAST(sum(1) OVER (PARTITION BY score2) AS DOUBLE) AS e2,
        CAST(sum(y) OVER (ORDER BY score2 RANGE UNBOUNDED PRECEDING) - sum(y) OVER (PARTITION BY score2) AS DOUBLE) AS p2, CAST(sum(y) OVER (PARTITION BY score2) AS DOUBLE) AS q2,
        CAST(sum(y) OVER () AS DOUBLE) AS n1, CAST(sum(1 - y) OVER () AS DOUBLE) AS n0 FROM scored) t"""


@operator
def delong_ci(d):
    return """SELECT round(a, 6) AS auc, round(sqrt(s1 / n1 + s0 / n0), 6) AS se, round(a - 1.959964E0 * sqrt(s1 / n1 + s0 / n0), 6) AS low, round(a + 1.959964E0 * sqrt(s1 / n1 + s0 / n0), 6) AS high FROM (
      SELECT avg(v) FILTER (WHERE y = 1) AS a, var_samp(v) FILTER (WHERE y = 1) AS s1, var_samp(v) FILTER (WHERE y = 0) AS s0, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n0 FROM placements) t"""


@operator
def delong_paired(d):
    return """SELECT round(a1 - a2, 6) AS difference, round(sqrt(s1 / n1 + s0 / n0), 6) AS se FROM (SELECT avg(v) FILTER (WHERE y = 1) AS a1, avg(v2) FILTER (WHERE y = 1) AS a2,
      var_samp(v - v2) FILTER (WHERE y = 1) AS s1, var_samp(v - v2) FILTER (WHERE y = 0) AS s0, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n0 FROM placements) t"""


@operator
def brier(d):
    return "SELECT count(*) AS n, round(avg((score - y) * (score - y)), 6) AS brier, round(avg(y), 6) AS prevalence FROM scored"


@operator
def average_precision(d):
    return """WITH s AS (SELECT score, sum(y) AS p, count(*) AS n FROM scored GROUP BY score), c AS (SELECT score, p, sum(p) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT round(sum(p * CAST(tp AS DOUBLE) / CAST(k AS DOUBLE)) / CAST(sum(p) AS DOUBLE), 6) AS average_precision FROM c"""


@operator
def reliability_deciles(d):
    """Mean score and rate by rank-first deciles."""
    return """SELECT decile, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS rate FROM (SELECT score, y, CAST(floor((row_number() OVER (ORDER BY score, doc_id) - 1) * 10E0 / count(*) OVER ()) AS BIGINT) AS decile FROM scored) t GROUP BY decile"""


@operator
def average_ranks(d):
    return "SELECT doc_id, round(rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2E0, 6) AS avg_rank FROM scored"


@operator
def cohen_kappa(d):
    return """SELECT n, round(po, 6) AS agreement, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM (SELECT count(*) AS n, avg(CASE WHEN y = y2 THEN 1E0 ELSE 0E0 END) AS po, avg(y) * avg(y2) + (1 - avg(y)) * (1 - avg(y2)) AS pe FROM scored) t"""


@operator
def spotcheck(d):
    """Agreement on pairs, and on findings with any match."""
    return """SELECT count(*) AS n_findings, round(avg(CASE WHEN judge = person THEN 1E0 ELSE 0E0 END), 6) AS finding_agreement, round(CAST(sum(same) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS pair_agreement FROM (
      SELECT record_id, class, max(CASE WHEN node IS NULL THEN 0 ELSE 1 END) AS judge, max(CASE WHEN h % 7 < 5 THEN 1 ELSE 0 END) AS person, sum(CASE WHEN (node IS NULL) = (h % 7 >= 5) THEN 1 ELSE 0 END) AS same, count(*) AS n FROM matches GROUP BY record_id, class) t"""


@operator
def kendall_tau(d):
    """Concordant and discordant pairs of turns by matched position, all and across occurrences."""
    return """SELECT count(*) FILTER (WHERE b.matched > a.matched) AS concordant, count(*) FILTER (WHERE b.matched < a.matched) AS discordant,
      round(CAST(count(*) FILTER (WHERE b.matched > a.matched) - count(*) FILTER (WHERE b.matched < a.matched) AS DOUBLE) / nullif(count(*), 0), 6) AS tau,
      count(*) FILTER (WHERE a.occurrence <> b.occurrence) AS n_cross FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.turn < b.turn"""


@operator
def kendall_by_record(d):
    return """SELECT a.conv_id, count(*) AS n_pairs, round(CAST(sum(CASE WHEN b.matched > a.matched THEN 1 WHEN b.matched < a.matched THEN -1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS tau FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id"""


@operator
def percentile_intervals(d):
    return f"SELECT event_type, round({d.percentile('value', 0.025)}, 6) AS low, round({d.percentile('value', 0.975)}, 6) AS high, round({d.percentile('value', 0.5)}, 6) AS median FROM events GROUP BY event_type"


@operator
def value_shares(d):
    return "SELECT event_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type"


@operator
def key_equality(d):
    """Keys that only one of two annotated tables has."""
    return "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' ELSE 'left' END AS only_in FROM (SELECT doc_id FROM labels) a FULL OUTER JOIN (SELECT doc_id FROM documents) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL"


@operator
def ceiling_ratio(d):
    """Share of the attainable discrimination: (auc - 0.5) / (best - 0.5)."""
    return "SELECT round((a - 0.5E0) / nullif(b - 0.5E0, 0), 6) AS ratio FROM (SELECT avg(v) FILTER (WHERE y = 1) AS a, avg(v2) FILTER (WHERE y = 1) AS b FROM placements) t"
