"""Networks per category and effect estimation."""

from __future__ import annotations

from .registry import fixture, operator

TARGET = "ERROR_0"


@operator
def cooccurrence(d):
    return "SELECT category, i, j, cooccur FROM pair_counts"


@operator
def precedence(d):
    return "SELECT category, i, j, n FROM precede_counts"


@operator
def active_factors(d):
    """Factors with enough records with and without them, in categories that have enough of both."""
    return """WITH n AS (SELECT category, count(DISTINCT record_id) AS n FROM causal_presence GROUP BY category),
    f AS (SELECT p.category, p.factor_type, count(*) AS k, max(n.n) AS n FROM causal_presence p JOIN n ON p.category = n.category GROUP BY p.category, p.factor_type),
    a AS (SELECT category, factor_type, k, n, count(*) OVER (PARTITION BY category) AS n_active FROM f WHERE k >= 5 AND k <= n - 5)
    SELECT category, factor_type, k AS n_present, n AS n_rows, n_active FROM a WHERE n_active >= 4 AND n >= 50"""


@operator
def candidate_pairs(d):
    """Pairs by co-occurrence, at most 300 a category."""
    return """SELECT category, i, j, cooccur FROM (SELECT category, i, j, cooccur, row_number() OVER (PARTITION BY category ORDER BY cooccur DESC, i, j) AS rn
      FROM pair_counts WHERE i < j AND cooccur >= 5) t WHERE rn <= 300"""


@fixture
def direction(d):
    return """SELECT c.category, c.i, c.j, c.cooccur, (coalesce(f.n, 0) + 1.0E0) / (coalesce(f.n, 0) + coalesce(b.n, 0) + 2.0E0) AS score
    FROM pair_counts c LEFT JOIN precede_counts f ON c.category = f.category AND c.i = f.i AND c.j = f.j LEFT JOIN precede_counts b ON c.category = b.category AND c.i = b.j AND c.j = b.i"""


@operator
def direction_score(d):
    return "SELECT category, i AS src, j AS dst, cooccur, round(score, 6) AS direction_score FROM direction"


@fixture
def both_judgments(d):
    """Judgments for both key orders, relation flipped."""
    return """SELECT category, a AS i, b AS j, relation, confidence FROM judgments UNION ALL
    SELECT category, b, a, CASE relation WHEN 'a_before_b' THEN 'b_before_a' WHEN 'b_before_a' THEN 'a_before_b' ELSE relation END, confidence FROM judgments"""


@operator
def judgment_lookup(d):
    return "SELECT category, i, j, coalesce(relation, 'none') AS relation, round(confidence, 6) AS confidence FROM both_judgments"


@fixture
def dense(d):
    """Association network: confident judgments first, the direction score where they are silent or weak."""
    return """SELECT e.category, e.i AS src, e.j AS dst, e.cooccur AS support, e.score, q.relation, q.confidence
    FROM direction e LEFT JOIN both_judgments q ON e.category = q.category AND e.i = q.i AND e.j = q.j
    WHERE e.cooccur >= 5 AND CASE
      WHEN q.relation = 'a_before_b' AND q.confidence >= 0.5 THEN true
      WHEN q.relation = 'b_before_a' AND q.confidence >= 0.5 THEN false
      WHEN q.relation IN ('concurrent', 'unrelated') THEN false
      ELSE e.score >= 0.65 END"""


@operator
def dense_edges(d):
    return "SELECT category, src, dst, support, round(score, 6) AS direction_score FROM dense"


@operator
def reorient(d):
    """Edges turned round where a judgment or a low direction score says so; a turned edge overwrites its reverse."""
    return """WITH e AS (SELECT w.category, w.i, w.j, w.score, w.cooccur, CASE WHEN q.relation = 'b_before_a' AND w.score < 0.5 THEN true WHEN q.relation IS NULL AND w.score < 0.3 THEN true ELSE false END AS flip
      FROM direction w LEFT JOIN both_judgments q ON w.category = q.category AND w.i = q.i AND w.j = q.j WHERE w.cooccur >= 5 AND (w.i < w.j OR w.score < 0.4)),
    turned AS (SELECT category, CASE WHEN flip THEN j ELSE i END AS src, CASE WHEN flip THEN i ELSE j END AS dst, CASE WHEN flip THEN 1 - score ELSE score END AS score, flip, cooccur FROM e)
    SELECT category, src, dst, round(score, 6) AS direction_score, cooccur AS support, flip AS reoriented FROM (
      SELECT t.*, row_number() OVER (PARTITION BY category, src, dst ORDER BY CASE WHEN flip THEN 0 ELSE 1 END, score DESC) AS rn FROM turned t) x WHERE rn = 1"""


@operator
def pmi_similarity(d):
    """Similarity of factors i < j: the judged relation by confidence, plus a twentieth of the positive mutual information of their co-occurrence.

    Shares are those of the category's co-occurrences, both orders counted.
    """
    return """WITH t AS (SELECT category, CAST(sum(cooccur) AS DOUBLE) AS total FROM pair_counts GROUP BY category),
    m AS (SELECT category, i AS factor, CAST(sum(cooccur) AS DOUBLE) AS k FROM pair_counts GROUP BY category, i),
    p AS (SELECT c.category, c.i, c.j, 0.05 * greatest(0E0, ln((c.cooccur / t.total) / ((a.k / t.total) * (b.k / t.total) + 1E-12) + 1E-9)) AS mutual
      FROM pair_counts c JOIN t ON c.category = t.category JOIN m a ON c.category = a.category AND c.i = a.factor JOIN m b ON c.category = b.category AND c.j = b.factor WHERE c.i < c.j),
    q AS (SELECT category, least(a, b) AS i, greatest(a, b) AS j, sum(CASE relation WHEN 'concurrent' THEN confidence WHEN 'a_before_b' THEN 0.6E0 * confidence WHEN 'b_before_a' THEN 0.6E0 * confidence ELSE 0E0 END) AS judged
      FROM judgments GROUP BY category, least(a, b), greatest(a, b))
    SELECT coalesce(p.category, q.category) AS category, coalesce(p.i, q.i) AS i, coalesce(p.j, q.j) AS j, round(coalesce(q.judged, 0E0) + coalesce(p.mutual, 0E0), 6) AS similarity
    FROM p FULL OUTER JOIN q ON p.category = q.category AND p.i = q.i AND p.j = q.j"""


@operator
def presence_patterns(d):
    """Distinct sets of causal factors with their counts: the sufficient statistic of the network learners."""
    return f"SELECT category, pattern, count(*) AS n FROM (SELECT category, record_id, {d.joined('factor_type')} AS pattern FROM causal_presence GROUP BY category, record_id) t GROUP BY category, pattern"


@operator
def outcome_patterns(d):
    """Distinct sets of causal factors of all records, the empty one too, with their counts and how many are serious or fatal."""
    return f"""SELECT category, pattern, count(*) AS n, CAST(sum(y) AS BIGINT) AS y FROM (
      SELECT r.category, r.record_id, CASE WHEN r.sev_ordinal >= 3 THEN 1 ELSE 0 END AS y, coalesce(p.pattern, '') AS pattern
      FROM records r LEFT JOIN (SELECT record_id, {d.joined('factor_type')} AS pattern FROM causal_presence GROUP BY record_id) p ON p.record_id = r.record_id) t GROUP BY category, pattern"""


@operator
def category_parents(d):
    """Factors that lead to a factor in at least thirty records of a category."""
    return "SELECT category, dst AS factor, src AS parent, support FROM (SELECT r.category, e.src, e.dst, count(*) AS support FROM record_edges e JOIN records r ON e.record_id = r.record_id GROUP BY r.category, e.src, e.dst) t WHERE support >= 30"


@operator
def chisq_pairs(d):
    """Chi-square statistic of every pair of factors within a category."""
    return """WITH n AS (SELECT category, count(DISTINCT record_id) AS n FROM causal_presence GROUP BY category),
    f AS (SELECT category, factor_type, count(*) AS k FROM causal_presence GROUP BY category, factor_type),
    t AS (SELECT a.category, a.factor_type AS i, b.factor_type AS j, CAST(coalesce(c.cooccur, 0) AS DOUBLE) AS n11, CAST(a.k AS DOUBLE) AS ka, CAST(b.k AS DOUBLE) AS kb, CAST(n.n AS DOUBLE) AS n
      FROM f a JOIN f b ON a.category = b.category AND a.factor_type < b.factor_type JOIN n ON a.category = n.category
      LEFT JOIN pair_counts c ON c.category = a.category AND c.i = a.factor_type AND c.j = b.factor_type)
    SELECT category, i, j, round(n * pow(n11 * (n - ka - kb + n11) - (ka - n11) * (kb - n11), 2) / nullif(ka * kb * (n - ka) * (n - kb), 0), 6) AS chi2 FROM t"""


@operator
def leading_factors(d):
    """Parents of the target with at least two percent of its records."""
    return f"SELECT src, support, n_dst FROM edge_table WHERE dst = '{TARGET}' AND support >= 0.02 * n_dst"


@operator
def skeleton_compare(d):
    """Two edge sets of a category as skeletons: shared, only in one, Jaccard, reversals."""
    return """WITH a AS (SELECT DISTINCT category, src, dst FROM dense), b AS (SELECT DISTINCT category, i AS src, j AS dst FROM direction WHERE cooccur >= 5 AND score >= 0.5),
    sa AS (SELECT DISTINCT category, least(src, dst) AS x, greatest(src, dst) AS y FROM a), sb AS (SELECT DISTINCT category, least(src, dst) AS x, greatest(src, dst) AS y FROM b),
    m AS (SELECT coalesce(sa.category, sb.category) AS category, CASE WHEN sa.x IS NOT NULL AND sb.x IS NOT NULL THEN 1 ELSE 0 END AS both_in, CASE WHEN sb.x IS NULL THEN 1 ELSE 0 END AS only_a, CASE WHEN sa.x IS NULL THEN 1 ELSE 0 END AS only_b
      FROM sa FULL OUTER JOIN sb ON sa.category = sb.category AND sa.x = sb.x AND sa.y = sb.y),
    r AS (SELECT a.category, count(*) AS reversals FROM a JOIN b ON a.category = b.category AND a.src = b.dst AND a.dst = b.src WHERE NOT EXISTS (SELECT 1 FROM b b2 WHERE b2.category = a.category AND b2.src = a.src AND b2.dst = a.dst) GROUP BY a.category)
    SELECT m.category, CAST(sum(both_in) AS BIGINT) AS shared, CAST(sum(only_a) AS BIGINT) AS only_a, CAST(sum(only_b) AS BIGINT) AS only_b, round(CAST(sum(both_in) AS DOUBLE) / count(*), 6) AS jaccard,
      coalesce(max(r.reversals), 0) AS reversals, CAST(sum(only_a) + sum(only_b) AS BIGINT) + coalesce(max(r.reversals), 0) AS shd
    FROM m LEFT JOIN r ON m.category = r.category GROUP BY m.category"""


@fixture
def touched(d):
    """(record, factor) where the factor or one of its parents is present: treatment, stratum of parents, and whether the outcome is severe."""
    return """SELECT t.factor, t.z, t.x, CASE WHEN r.sev_ordinal >= 3 THEN 1 ELSE 0 END AS y FROM (
      SELECT coalesce(p.record_id, s.record_id) AS record_id, coalesce(p.factor_type, s.factor) AS factor, CASE WHEN p.record_id IS NOT NULL THEN 1 ELSE 0 END AS x, coalesce(s.z, '') AS z
      FROM causal_presence p FULL OUTER JOIN strata s ON p.record_id = s.record_id AND p.factor_type = s.factor) t
    JOIN records r ON r.record_id = t.record_id"""


@fixture
def cells(d):
    """Counts of a factor's strata; records without the factor and its parents are counted as the rest of all."""
    return """SELECT factor, z, sum(nz) AS nz, sum(n1) AS n1, sum(n0) AS n0, sum(y1) AS y1, sum(y0) AS y0 FROM (
      SELECT g.factor, coalesce(g.z, '') AS z, CASE WHEN g.whole = 1 THEN a.n - g.nz ELSE g.nz END AS nz, CASE WHEN g.whole = 1 THEN 0 ELSE g.n1 END AS n1, CASE WHEN g.whole = 1 THEN a.n - g.nz ELSE g.nz - g.n1 END AS n0,
        CASE WHEN g.whole = 1 THEN 0 ELSE g.y1 END AS y1, CASE WHEN g.whole = 1 THEN a.y - g.y1 - g.y0 ELSE g.y0 END AS y0
      FROM (SELECT factor, z, grouping(z) AS whole, count(*) AS nz, sum(x) AS n1, sum(x * y) AS y1, sum((1 - x) * y) AS y0 FROM touched GROUP BY GROUPING SETS ((factor, z), (factor))) g
      CROSS JOIN (SELECT count(*) AS n, count(*) FILTER (WHERE sev_ordinal >= 3) AS y FROM records) a) c
    GROUP BY factor, z HAVING sum(nz) > 0"""


@fixture
def parents(d):
    """At most three parents of each factor, by support."""
    return """SELECT factor, parent FROM (SELECT dst AS factor, src AS parent, row_number() OVER (PARTITION BY dst ORDER BY support DESC, src) AS rn FROM edge_table WHERE support >= 5) t WHERE rn <= 3"""


@fixture
def strata(d):
    return f"SELECT c.record_id, p.factor, {d.joined('p.parent', None, '|')} AS z FROM causal_presence c JOIN parents p ON c.factor_type = p.parent GROUP BY c.record_id, p.factor"


@fixture
def effects(d):
    """Crude and back-door-adjusted risks with smoothing; an empty arm of a stratum falls back to the stratum's pooled risk."""
    return """SELECT factor, n, n1, crude1, crude0, adj1, adj0 FROM (
      SELECT g.factor, sum(g.nz) AS n, sum(g.n1) AS n1, (sum(g.y1) + 1.0E0) / (sum(g.n1) + 2.0E0) AS crude1, (sum(g.y0) + 1.0E0) / (sum(g.n0) + 2.0E0) AS crude0,
        sum(g.nz * CASE WHEN g.n1 > 0 THEN (g.y1 + 1.0E0) / (g.n1 + 2.0E0) ELSE (g.y1 + g.y0 + 1.0E0) / (g.nz + 2.0E0) END) / sum(g.nz) AS adj1,
        sum(g.nz * CASE WHEN g.n0 > 0 THEN (g.y0 + 1.0E0) / (g.n0 + 2.0E0) ELSE (g.y1 + g.y0 + 1.0E0) / (g.nz + 2.0E0) END) / sum(g.nz) AS adj0
      FROM cells g
      GROUP BY g.factor) e"""


@operator
def crude_effect(d):
    return "SELECT factor, CAST(n AS BIGINT) AS n, CAST(n1 AS BIGINT) AS n_exposed, round(crude1, 6) AS p1, round(crude0, 6) AS p0, round(crude1 - crude0, 6) AS crude FROM effects"


@operator
def backdoor_effect(d):
    return "SELECT factor, round(adj1, 6) AS p_do_1, round(adj0, 6) AS p_do_0, round(adj1 - adj0, 6) AS effect FROM effects"


@operator
def do_ranking(d):
    """Interventions by adjusted effect, for factors with at least 30 records."""
    return """SELECT factor, round(adj1 - adj0, 6) AS effect, round((adj1 - adj0) * n1 / n, 6) AS risk_reduction, CAST(rank() OVER (ORDER BY round(adj1 - adj0, 6) DESC) AS BIGINT) AS place
    FROM effects WHERE n1 >= 30 AND n >= 100"""


@operator
def confounding_shift(d):
    """Adjusted against crude effects and their shift."""
    return "SELECT factor, round(crude1 - crude0, 6) AS crude, round(adj1 - adj0, 6) AS adjusted, round(abs((adj1 - adj0) - (crude1 - crude0)), 6) AS shift FROM effects WHERE n1 >= 30"


@operator
def e_value(d):
    """E-value of the adjusted risk ratio, inverted below 1."""
    return """SELECT factor, round(rr, 6) AS risk_ratio, round(r + sqrt(r * (r - 1)), 6) AS e_value FROM (
      SELECT factor, adj1 / adj0 AS rr, CASE WHEN adj1 >= adj0 THEN adj1 / adj0 ELSE adj0 / adj1 END AS r FROM effects) t"""


@operator
def prior_ablation(d):
    """Effect differences between adjustment and none: mean, largest, and how many exceed 0.02."""
    return "SELECT count(*) AS n, round(avg(abs(adj1 - adj0 - crude1 + crude0)), 6) AS mean_delta, round(max(abs(adj1 - adj0 - crude1 + crude0)), 6) AS max_delta, count(*) FILTER (WHERE abs(adj1 - adj0 - crude1 + crude0) > 0.02) AS n_large FROM effects"


@operator
def topk_overlap(d):
    """How many of the ten strongest crude and adjusted effects are the same."""
    return """SELECT count(*) AS n_shared FROM (SELECT factor FROM (SELECT factor, row_number() OVER (ORDER BY crude1 - crude0 DESC, factor) AS rn FROM effects) a WHERE rn <= 10) a
    JOIN (SELECT factor FROM (SELECT factor, row_number() OVER (ORDER BY adj1 - adj0 DESC, factor) AS rn FROM effects) b WHERE rn <= 10) b ON a.factor = b.factor"""


@fixture
def strengths(d):
    """Leak and link strengths of a leaky noisy-OR for the target: link probability by edges, base rate by presence."""
    return f"SELECT src AS factor, CAST(support AS DOUBLE) / n_src * 0.5 AS p, CAST(n_src AS DOUBLE) / n_records AS base_rate FROM edge_table WHERE dst = '{TARGET}' AND support >= 0.02 * n_dst"


@operator
def noisy_or_nll(d):
    """Negative log likelihood of the target under the leaky noisy-OR at the given strengths and a leak of 0.05."""
    return f"""WITH x AS (SELECT r.record_id, max(CASE WHEN t.record_id IS NOT NULL THEN 1 ELSE 0 END) AS y, sum(coalesce(ln(1 - s.p), 0)) AS lx
      FROM records r LEFT JOIN causal_presence c ON c.record_id = r.record_id LEFT JOIN strengths s ON s.factor = c.factor_type
      LEFT JOIN (SELECT DISTINCT record_id FROM causal_presence WHERE factor_type = '{TARGET}') t ON t.record_id = r.record_id GROUP BY r.record_id)
    SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_target, round(-sum(CASE WHEN y = 1 THEN ln(greatest(1e-12, 1 - 0.95 * exp(lx))) ELSE ln(greatest(1e-12, 0.95 * exp(lx))) END), 4) AS nll,
      round(avg(1 - 0.95 * exp(lx)), 6) AS mean_fit FROM x"""


@operator
def noisy_or_combine(d):
    """Probability of the target from base rates and strengths."""
    return "SELECT count(*) AS n_factors, round(1 - 0.95 * exp(sum(ln(1 - base_rate * p))), 6) AS p FROM strengths"


@operator
def factor_contributions(d):
    """What removing each factor takes off the probability."""
    return "SELECT s.factor, round((1 - 0.95 * exp(t.l)) - (1 - 0.95 * exp(t.l - ln(1 - s.base_rate * s.p))), 6) AS contribution FROM strengths s CROSS JOIN (SELECT sum(ln(1 - base_rate * p)) AS l FROM strengths) t"


@operator
def scenario_counterfactuals(d):
    """Probability with one factor certain, and with it removed, against the baseline."""
    return """SELECT s.factor, round(1 - 0.95 * exp(t.l - ln(1 - s.base_rate * s.p) + ln(1 - s.p)), 6) AS p_present, round(1 - 0.95 * exp(t.l - ln(1 - s.base_rate * s.p)), 6) AS p_absent,
      round((1 - 0.95 * exp(t.l - ln(1 - s.base_rate * s.p) + ln(1 - s.p))) / (1 - 0.95 * exp(t.l)), 6) AS ratio_to_baseline
    FROM strengths s CROSS JOIN (SELECT sum(ln(1 - base_rate * p)) AS l FROM strengths) t"""
