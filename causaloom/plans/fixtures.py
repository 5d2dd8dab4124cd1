"""Views over the driver's tables that stand for the inputs of the operators.

``nodes``/``links``/``records`` are causal chains (one per user and day), ``weather``
has the drivers of the physics models, ``corpus`` is a narrative corpus, and the coded
tables are orders with their line items.
"""

from __future__ import annotations

from .registry import fixture


def node_fields(d):
    """An event's record and, from its type and ``k``, its factor; and ``k``."""
    return f"concat(CAST(user_id AS {d.S}), '_', {d.day('ts')})", f"concat(upper(event_type), '_', CAST(k % 3 AS {d.S}))", f"CAST({d.json_field('props', 'k')} AS INT)"


@fixture
def nodes(d):
    record, factor, k = node_fields(d)
    return f"""SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY ts, event_id) - 1 AS INT) AS idx,
      CASE event_type WHEN 'purchase' THEN 'outcome' WHEN 'signup' THEN 'condition' ELSE 'event' END AS class,
      {factor} AS factor_type,
      CASE WHEN event_type = 'purchase' THEN 'outcome' WHEN value >= 60 THEN 'primary' ELSE 'contributing' END AS cause_role,
      CASE k % 5 WHEN 0 THEN 'takeoff' WHEN 1 THEN 'cruise' WHEN 2 THEN 'approach' WHEN 3 THEN 'landing' ELSE NULL END AS phase_of_flight,
      value, event_id, user_id, k
    FROM (SELECT e.*, {record} AS record_id, {k} AS k FROM events e) t"""


@fixture
def links(d):
    return """SELECT record_id, idx AS dst_idx, 0 AS link_pos, idx - 1 AS src_idx,
      CASE WHEN value >= 50 THEN 'direct' ELSE 'contributing' END AS strength FROM nodes WHERE idx >= 1
    UNION ALL
    SELECT record_id, idx, 1, idx - 2, 'contributing' FROM nodes WHERE idx >= 2 AND event_id % 3 = 0"""


def record_fields(d):
    """A record's category and severity, from its nodes."""
    return f"concat('CAT', CAST(min(user_id) % 6 AS {d.S}))", "CASE WHEN min(user_id) % 17 = 0 THEN -1 ELSE CAST(least(4, floor(max(value) / 40)) AS INT) END"


@fixture
def records(d):
    category, severity = record_fields(d)
    return f"""SELECT record_id, {category} AS category,
      {severity} AS sev_ordinal
    FROM nodes GROUP BY record_id"""


@fixture
def weather(d):
    return f"""SELECT event_id, concat(CAST(user_id AS {d.S}), '_', {d.day('ts')}) AS record_id,
      CAST(CAST({d.json_field('props', 'k')} AS INT) AS DOUBLE) + 10 AS temp_f,
      CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST({d.json_field('props', 'k')} AS INT) + 10 - CAST(event_id % 30 AS DOUBLE) END AS dew_f,
      CAST(event_id % 45 AS DOUBLE) AS wind_kts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 360 END AS wind_dir,
      CAST(event_id % 9000 AS DOUBLE) - 1000 AS dens_alt_ft
    FROM events"""


@fixture
def clean_weather(d):
    """One row per record: usable temperature and dew point in Celsius, wind and density altitude."""
    return """SELECT record_id, min_by(t_c, event_id) AS t_c, min_by(td_c, event_id) AS td_c,
      nullif(min_by(coalesce(wind, -1), event_id), -1) AS wind_kts, nullif(min_by(coalesce(da, -9999), event_id), -9999) AS dens_alt_ft
    FROM (SELECT event_id, record_id, (temp_f - 32) * 5 / 9 AS t_c, least((dew_f - 32) * 5 / 9, (temp_f - 32) * 5 / 9) AS td_c,
        CASE WHEN wind_kts = 0 AND wind_dir IS NULL THEN NULL WHEN wind_kts >= 0 AND wind_kts < 200 THEN wind_kts END AS wind,
        CASE WHEN dens_alt_ft > -2000 AND dens_alt_ft < 30000 THEN dens_alt_ft END AS da
      FROM weather
      WHERE temp_f IS NOT NULL AND dew_f IS NOT NULL AND NOT (temp_f = 0 AND dew_f = 0)
        AND temp_f > -60 AND temp_f < 130 AND dew_f > -60 AND dew_f < 130 AND dew_f <= temp_f + 2) w
    GROUP BY record_id"""


@fixture
def corpus(d):
    return f"""SELECT doc_id AS record_id, source, text, CAST(20240101 + doc_id % 5 AS {d.S}) AS date,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('N', CAST(doc_id % 40 AS {d.S})) END AS tail,
      CAST(CASE WHEN length(trim(text)) = 0 THEN 0 ELSE {d.size(d.words('text'))} END AS BIGINT) AS wc,
      CAST({d.extract('source', '([0-9]+)$')} AS INT) AS source_rank FROM documents"""


@fixture
def findings(d):
    """Coded findings: line items with a cause flag; the children are ordered by all columns."""
    return f"""SELECT l_orderkey AS ev_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS pos,
      CASE l_returnflag WHEN 'R' THEN 'C' WHEN 'A' THEN 'F' ELSE '' END AS cause_factor, p_type AS description,
      concat('0', CAST(l_linenumber % 6 AS {d.S})) AS category_no, CAST(l_quantity AS BIGINT) AS persons, concat('SUBJECT ', CAST(l_suppkey % 7 AS {d.S})) AS subject,
      l_returnflag, l_linestatus, l_partkey
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


@fixture
def coded_sequence(d):
    """Coded sequence entries of an event, with a modifier where the line is open."""
    return "SELECT ev_id, pos, pos % 3 + 1 AS occurrence, cause_factor, subject, CASE WHEN l_linestatus = 'O' THEN description ELSE '' END AS modifier FROM findings"


@fixture
def structured(d):
    """Orders as events with their coded outcome."""
    return """SELECT o_orderkey AS ev_id, o_orderstatus, o_orderpriority, o_custkey, o_totalprice,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 23 END AS fatal, o_orderkey % 7 AS serious, o_orderkey % 3 AS minor,
      CASE o_orderkey % 6 WHEN 0 THEN 'DEST' WHEN 1 THEN 'SUBS' WHEN 2 THEN 'MINR' WHEN 3 THEN 'NONE' ELSE NULL END AS damage,
      o_orderkey % 4 AS unhurt, CASE WHEN o_orderkey % 3 = 0 THEN concat(' ', o_orderpriority, ' ') WHEN o_orderkey % 3 = 1 THEN '' END AS primary_cause_text,
      CASE WHEN o_orderkey % 9 = 0 THEN o_orderstatus END AS secondary_cause_text FROM orders"""


@fixture
def occurrences(d):
    """Coded occurrences of an event, in order."""
    return "SELECT ev_id, pos, description AS code_text, CASE WHEN pos = 1 THEN ' CRUISE' ELSE '' END AS phase_text FROM findings WHERE pos <= 2"


@fixture
def vocabulary(d):
    """Factors that count, and which of them are outcomes; users bind their own."""
    return "SELECT factor_type, is_outcome FROM (VALUES " + ", ".join(f"('{e}_{k}', {'TRUE' if e == 'PURCHASE' else 'FALSE'})" for e in ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW") for k in range(3)) + ") AS v(factor_type, is_outcome)"


@fixture
def presence(d):
    """Distinct (record, factor) of the vocabulary."""
    return "SELECT DISTINCT n.record_id, n.factor_type, v.is_outcome FROM nodes n JOIN vocabulary v ON n.factor_type = v.factor_type"


@fixture
def causal_presence(d):
    return "SELECT p.record_id, r.category, r.sev_ordinal, p.factor_type FROM presence p JOIN records r ON p.record_id = r.record_id WHERE NOT p.is_outcome"


@fixture
def record_edges(d):
    """Distinct (record, src, dst) of links between factors that are no outcomes, with the strength of the first link of the pair."""
    return """SELECT l.record_id, s.factor_type AS src, t.factor_type AS dst,
      min_by(l.strength, (l.dst_idx, l.link_pos)) AS strength
    FROM links l JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx JOIN nodes t ON l.record_id = t.record_id AND l.dst_idx = t.idx
    JOIN vocabulary vs ON vs.factor_type = s.factor_type JOIN vocabulary vt ON vt.factor_type = t.factor_type
    WHERE s.factor_type <> t.factor_type AND NOT vs.is_outcome AND NOT vt.is_outcome
    GROUP BY l.record_id, s.factor_type, t.factor_type"""


@fixture
def record_outcomes(d):
    """Distinct (record, src, dst) of links into outcomes."""
    return """SELECT DISTINCT l.record_id, s.factor_type AS src, t.factor_type AS dst
    FROM links l JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx JOIN nodes t ON l.record_id = t.record_id AND l.dst_idx = t.idx
    JOIN vocabulary vs ON vs.factor_type = s.factor_type JOIN vocabulary vt ON vt.factor_type = t.factor_type
    WHERE s.factor_type <> t.factor_type AND NOT vs.is_outcome AND vt.is_outcome"""


@fixture
def edge_table(d):
    return """SELECT e.src, e.dst, e.support, e.n_direct, ps.n AS n_src, pd.n AS n_dst, tot.n AS n_records
    FROM (SELECT src, dst, count(*) AS support, count(*) FILTER (WHERE strength = 'direct') AS n_direct FROM record_edges GROUP BY src, dst) e
    JOIN (SELECT factor_type, count(*) AS n FROM presence GROUP BY factor_type) ps ON e.src = ps.factor_type
    JOIN (SELECT factor_type, count(*) AS n FROM presence GROUP BY factor_type) pd ON e.dst = pd.factor_type
    CROSS JOIN (SELECT count(DISTINCT record_id) AS n FROM nodes) tot"""


@fixture
def pair_counts(d):
    """Co-occurrence of causal factors by category, both orders."""
    return """SELECT a.category, a.factor_type AS i, b.factor_type AS j, count(*) AS cooccur
    FROM causal_presence a JOIN causal_presence b ON a.record_id = b.record_id AND a.factor_type <> b.factor_type GROUP BY a.category, a.factor_type, b.factor_type"""


@fixture
def precede_counts(d):
    return """SELECT r.category, e.src AS i, e.dst AS j, count(*) AS n FROM record_edges e JOIN records r ON e.record_id = r.record_id
    GROUP BY r.category, e.src, e.dst"""


@fixture
def judgments(d):
    """Pairwise order judgments for pairs a < b, derived from a stable hash."""
    h = d.md5_number("concat(category, i, j)")
    return f"""SELECT category, i AS a, j AS b, CASE {h} % 5 WHEN 0 THEN 'a_before_b' WHEN 1 THEN 'b_before_a' WHEN 2 THEN 'concurrent' WHEN 3 THEN 'unrelated' ELSE NULL END AS relation,
      CAST({h} % 101 AS DOUBLE) / 100 AS confidence FROM pair_counts WHERE i < j"""


@fixture
def scored(d):
    """Score and binary label of labelled documents."""
    return "SELECT l.doc_id, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS score, CAST(length(d.source) * 13 + d.n_chars % 97 AS DOUBLE) / 200 AS score2, l.quality AS y, l.toxic AS y2 FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


@fixture
def stations(d):
    return f"""SELECT s_suppkey AS station, CAST(25 + (s_suppkey * 7) % 25 AS DOUBLE) + s_suppkey % 10 * 0.1 AS lat, CAST(-120 + (s_suppkey * 11) % 50 AS DOUBLE) AS lon,
      1970 + s_suppkey % 30 AS begin_year, 2000 + s_suppkey % 25 AS end_year, s_suppkey % 3 <> 0 AS wban FROM supplier"""


@fixture
def sites(d):
    return """SELECT c_custkey AS site, CAST(25 + (c_custkey * 3) % 25 AS DOUBLE) + c_custkey % 7 * 0.1 AS lat, CAST(-120 + (c_custkey * 5) % 50 AS DOUBLE) + 0.2 AS lon, 1990 + c_custkey % 30 AS yr FROM customer"""


@fixture
def turns(d):
    """Conversations as ordered sequences; the matched position of a turn is its rank by text length."""
    return """SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS INT) AS matched, CAST(turn % 3 AS INT) AS occurrence FROM conversations"""
