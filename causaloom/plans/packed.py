"""Queries over packed records: nested enrichment, prompts, edges of the older format, sensitivity of the icing model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, links, prompts, sensitivity, typed_edges
from ..operators.shared import once, once_by_column
from .custom import ORACLES, _derived, _fixture
from .registry import custom, fixture, operator

PATHS = enrich.Paths(keyed={"coded:pre": ("pre", "coded_pre"), "coded:new": ("new", "coded_new")}, databases=("pre", "new"), reports="report", by_number="report_by_number", manifest_only="manifest_only", coded="own:", coded_name="own")


def _key(d, key="ev_id"):
    return f"CASE WHEN {key} % 3 = 0 THEN 'new' ELSE 'pre' END AS db, concat('E', CAST({key} AS {d.S})) AS ev_id"


@fixture
def coded_events(d):
    return f"SELECT {_key(d, 'o_orderkey')}, lower(o_orderstatus) AS ev_type, o_orderkey AS pos FROM orders"


@fixture
def coded_aircraft(d):
    """Every event's aircraft, some with a second one; accident numbers repeat in both databases."""
    craft = f"o_orderpriority AS make, o_orderstatus AS model, CASE WHEN o_orderkey % 6 = 0 THEN 'DEST' END AS damage, CAST(o_orderkey % 3 AS {d.S}) AS num_eng, 'AIR' AS category, concat('G', CAST(o_custkey AS {d.S})) AS regis_no"
    return f"""SELECT {_key(d, 'o_orderkey')}, 1 AS aircraft_key, {craft}, concat(' N', CAST(o_orderkey % 700 AS {d.S})) AS ntsb_no, o_orderkey AS pos FROM orders
    UNION ALL SELECT {_key(d, 'o_orderkey')}, 2, {craft}, NULL, o_orderkey FROM orders WHERE o_orderkey % 4 = 0"""


@fixture
def coded_findings(d):
    return f"SELECT {_key(d)}, 1 + pos % 2 AS aircraft_key, category_no AS code, description, category_no AS category, cause_factor, pos FROM findings WHERE l_partkey % 5 > 1"


@fixture
def coded_occurrences(d):
    return f"SELECT {_key(d)}, 1 + pos % 2 AS aircraft_key, l_partkey % 40 AS occurrence_code, pos % 4 AS phase_code, pos FROM findings WHERE pos <= 4"


@fixture
def coded_entries(d):
    return f"SELECT {_key(d)}, 1 + pos % 2 AS aircraft_key, pos % 3 AS occurrence_no, 20 - pos AS seq_event_no, l_partkey % 40 AS subj_code, l_partkey % 31 AS modifier_code, cause_factor, pos AS person_code, pos FROM findings"


@fixture
def coded_injuries(d):
    return f"SELECT {_key(d)}, 1 + pos % 2 AS aircraft_key, CASE WHEN pos % 5 = 0 THEN 'LOST' WHEN l_returnflag = 'R' THEN 'FATL' WHEN l_returnflag = 'A' THEN 'sers' ELSE 'MINR' END AS injury_level, persons, pos FROM findings WHERE pos > 1"


@fixture
def code_list(d):
    """Codes of two tables; the later one is blank once."""
    return "SELECT CAST(n_nationkey AS BIGINT) AS code, n_name AS meaning, CAST(n_nationkey AS BIGINT) AS pos FROM nation UNION ALL SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN '' ELSE r_name END, 100 + r_regionkey FROM region"


@fixture
def report_list(d):
    return f"SELECT concat('R', CAST(c_custkey AS {d.S})) AS report_number, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE concat('N', CAST(c_custkey % 900 AS {d.S}), ' ') END AS ntsb_accident_id, c_mktsegment AS report_type, c_name AS txt_path, c_custkey AS pos FROM customer WHERE c_custkey % 5 <> 0"


@fixture
def own_coded(d):
    return f"""SELECT concat('P', CAST(p_partkey AS {d.S})) AS record_id, p_name AS cause_primary_text, CASE WHEN p_size % 2 = 0 THEN p_brand END AS cause_secondary_text, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS cause_additional_text,
      p_brand AS cause_2nd_additional_text, p_type AS cause_general_category_text, p_brand AS phase_of_flight_text, p_type AS flying_condition_primary, p_brand AS light_condition_text, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'I' ELSE '' END AS event_type,
      p_name AS aircraft_make, p_type AS aircraft_model, p_brand AS engine_make, p_type AS engine_model, CASE WHEN p_size % 7 = 0 THEN ' y ' ELSE 'N' END AS pilot_killed_flag, p_partkey AS pos FROM part WHERE p_partkey % 9 <> 0"""


@fixture
def all_records(d):
    """Records of every source; some keys are no keys."""
    return f"""SELECT concat('E', CAST(o_orderkey AS {d.S}), CASE o_orderkey % 7 WHEN 0 THEN '_x' WHEN 1 THEN '' WHEN 2 THEN '_2' ELSE '_1' END) AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN 'coded:new' ELSE 'coded:pre' END AS source FROM orders
    UNION ALL SELECT concat('R', CAST(c_custkey AS {d.S})), 'report' FROM customer UNION ALL SELECT concat('P', CAST(p_partkey AS {d.S})), 'own:parts' FROM part UNION ALL SELECT concat('S', CAST(s_suppkey AS {d.S})), 'other' FROM supplier"""


def _enriched(spark, sf_dir, fields=enrich.PAYLOAD):
    """The four child tables come from one frame of findings, which is made once."""
    findings = once_by_column(_fixture(spark, sf_dir, "findings"))
    tables = {k: _derived(spark, v, findings=findings) for k, v in {"findings": "coded_findings", "occurrences": "coded_occurrences", "sequence": "coded_entries", "injuries": "coded_injuries"}.items()}
    tables |= {k: _fixture(spark, sf_dir, v) for k, v in {"events": "coded_events", "aircraft": "coded_aircraft", "codes": "code_list"}.items()}
    return enrich.enriched(_fixture(spark, sf_dir, "all_records"), tables, _fixture(spark, sf_dir, "report_list"), _fixture(spark, sf_dir, "own_coded"), PATHS, fields)


@custom
def enriched_records(spark, sf_dir):
    """Every record with its coded supervision by key, accident number, manifest or own row; children spelled out."""
    s = F.col("structured")
    each = lambda c, *f: F.array_join(F.transform(s[c], lambda x: F.concat_ws(":", *[F.coalesce(x[n].cast("string"), F.lit("?")) for n in f])), "|")
    return _enriched(spark, sf_dir).select(
        "record_id", "source", "supervision_source", s["event_type"].alias("event_type"), s["primary_cause_text"].alias("primary_cause"), s["phase_of_flight"].alias("phase"), s["severity"].alias("severity"), s["aircraft"]["make"].alias("make"), s["report_type"].alias("report_type"),
        each("findings", "code", "description", "cause_factor").alias("findings"), each("occurrences", "code_text", "phase_text").alias("occurrences"), each("seq_of_events", "occurrence_no", "order", "subj_text", "modifier_text").alias("entries"),
        F.when(s["injury"].isNotNull(), F.concat_ws(",", *[s["injury"][k].cast("string") for k in ("fatal", "serious", "minor", "none")])).alias("injury"), F.array_join(s["additional_causes"], "|").alias("more_causes"),
    )


@custom
def enrichment_coverage(spark, sf_dir):
    """Records of a source, those with supervision and those with a primary cause."""
    return enrich.coverage(_enriched(spark, sf_dir, ["primary_cause_text"]))


@custom
def packed_prompts(spark, sf_dir):
    """The question of every record for a model: what it tells, here its name, and its coded findings."""
    content = prompts.question(F.col("record_id"), prompts.supervision_text(F.col("structured")))
    messages = prompts.conversation("Extract the causal chain.", [{"narrative": "Fuel ran out.", "extraction": {"chain": []}}], content)
    return _enriched(spark, sf_dir, prompts.FIELDS).select("record_id", messages.alias("m")).select("record_id", F.size("m").alias("n_messages"), F.element_at("m", -1)["content"].alias("content"))


def _packed_sql():
    """Children as lists by a lookup of codes in SQL, the last meaning that is not blank."""
    return """code AS (SELECT code, coalesce(arg_max(meaning, pos) FILTER (meaning <> ''), '') AS t FROM code_list GROUP BY code),
    f AS (SELECT db, ev_id, aircraft_key, list({'c': code, 'd': description, 'f': cause_factor} ORDER BY pos) AS fs FROM coded_findings GROUP BY ALL),
    o AS (SELECT db, ev_id, aircraft_key, list({'t': a.t, 'p': b.t} ORDER BY pos) AS os, arg_min(b.t, pos) FILTER (phase_code <> 0 AND b.t <> '') AS phase FROM coded_occurrences c LEFT JOIN code a ON a.code = occurrence_code LEFT JOIN code b ON b.code = phase_code GROUP BY db, ev_id, aircraft_key),
    e AS (SELECT db, ev_id, aircraft_key, list({'n': occurrence_no, 'o': seq_event_no, 's': a.t, 'm': b.t, 'f': cause_factor} ORDER BY occurrence_no, seq_event_no, pos) AS es FROM coded_entries c LEFT JOIN code a ON a.code = subj_code LEFT JOIN code b ON b.code = modifier_code GROUP BY db, ev_id, aircraft_key),
    """


def _enriched_sql():
    """All paths as one union of (record, key), then the lists."""
    hurt = ", ".join(f"CAST(coalesce(sum(persons) FILTER (upper(injury_level) = '{c}'), 0) AS BIGINT)" for c in enrich.INJURY_LEVELS)
    return f"""{_packed_sql()} i AS (SELECT db, ev_id, aircraft_key, [{hurt}] AS hurt FROM coded_injuries GROUP BY ALL),
    num AS (SELECT trim(ntsb_no) AS number, arg_min({{'db': db, 'ev': ev_id, 'ak': aircraft_key}}, (CASE db WHEN 'pre' THEN 0 ELSE 1 END, -pos)) AS hit FROM coded_aircraft WHERE trim(ntsb_no) <> '' GROUP BY 1),
    keyed AS (SELECT record_id, source, substr(source, 7) AS db, regexp_extract(record_id, '^(.*)_([0-9]+)$', 1) AS ev_id, CAST(regexp_extract(record_id, '^(.*)_([0-9]+)$', 2) AS INT) AS aircraft_key, 'coded_' || substr(source, 7) AS called FROM all_records WHERE source LIKE 'coded:%' AND regexp_matches(record_id, '_[0-9]+$')
      UNION ALL SELECT r.record_id, r.source, hit.db, hit.ev, hit.ak, 'report_by_number' FROM all_records r JOIN report_list m ON r.source = 'report' AND m.report_number = r.record_id JOIN num ON num.number = trim(m.ntsb_accident_id)),
    packed AS (SELECT k.record_id, k.called, coalesce(fs, []) AS fs, coalesce(os, []) AS os, coalesce(es, []) AS es, hurt, o.phase, a.make, a.damage, upper(v.ev_type) AS event_type FROM keyed k LEFT JOIN f USING (db, ev_id, aircraft_key) LEFT JOIN o USING (db, ev_id, aircraft_key)
      LEFT JOIN e USING (db, ev_id, aircraft_key) LEFT JOIN i USING (db, ev_id, aircraft_key) LEFT JOIN coded_aircraft a USING (db, ev_id, aircraft_key) LEFT JOIN coded_events v USING (db, ev_id)),
    caused AS (SELECT *, list_filter(fs, lambda x: upper(x.f) IN ('C', 'F')) AS cf, list_filter(es, lambda x: upper(x.f) = 'C') AS ce FROM packed),
    full_rows AS (SELECT r.record_id, r.source, CASE WHEN p.record_id IS NOT NULL THEN p.called WHEN m.report_number IS NOT NULL THEN 'manifest_only' WHEN w.record_id IS NOT NULL THEN 'own' END AS supervision_source,
      CASE WHEN p.record_id IS NOT NULL THEN p.event_type ELSE nullif(upper(w.event_type), '') END AS event_type, CASE WHEN p.record_id IS NULL THEN w.cause_primary_text WHEN len(cf) > 0 THEN cf[1].d ELSE nullif(ce[1].s, '') END AS primary_cause,
      CASE WHEN p.record_id IS NULL THEN w.phase_of_flight_text ELSE p.phase END AS phase, CASE WHEN w.record_id IS NULL THEN NULL WHEN trim(upper(w.pilot_killed_flag)) = 'Y' THEN 'fatal' WHEN upper(w.event_type) = 'A' THEN 'accident' WHEN w.event_type = 'I' THEN 'incident' END AS severity,
      coalesce(p.make, w.aircraft_make) AS make, CASE WHEN p.record_id IS NULL THEN m.report_type END AS report_type, p.fs, p.os, p.es, p.hurt, p.damage, w.cause_secondary_text AS second, CASE WHEN w.record_id IS NOT NULL THEN list_filter([w.cause_additional_text, w.cause_2nd_additional_text], lambda x: x <> '') END AS more
      FROM all_records r LEFT JOIN caused p ON p.record_id = r.record_id LEFT JOIN report_list m ON r.source = 'report' AND m.report_number = r.record_id LEFT JOIN own_coded w ON r.source LIKE 'own:%' AND w.record_id = r.record_id)"""


def enriched_records_oracle(d):
    spelled = lambda c, *f: f"array_to_string(list_transform({c}, lambda x: concat_ws(':', {', '.join(f"coalesce(CAST(x.{n} AS VARCHAR), '?')" for n in f)})), '|')"
    return f"""WITH {_enriched_sql()} SELECT record_id, source, supervision_source, event_type, primary_cause, phase, severity, make, report_type, {spelled('fs', 'c', 'd', 'f')} AS findings, {spelled('os', 't', 'p')} AS occurrences,
      {spelled('es', 'n', 'o', 's', 'm')} AS entries, array_to_string(hurt, ',') AS injury, array_to_string(more, '|') AS more_causes FROM full_rows"""


def enrichment_coverage_oracle(d):
    return f"WITH {_enriched_sql()} SELECT source, count(*) AS n, count(supervision_source) AS with_structured, count(*) FILTER (primary_cause <> '') AS with_primary_cause FROM full_rows GROUP BY source"


def packed_prompts_oracle(d):
    """The block's lines as one list without gaps."""
    flag = "coalesce(nullif(trim(x.f), ''), '-')"
    listed = lambda c, line, most=10**6: f"list_filter(list_transform({c}[1:{most}], lambda x{', i' if 'CAST(i ' in line else ''}: {line}), lambda y: y IS NOT NULL)"
    titled = lambda t, c, lines: f"CASE WHEN len({c}) > 0 THEN list_concat(['{t}:'], {lines}) ELSE [] END"
    place = "concat('  ', CAST(i AS VARCHAR), '. ', coalesce(nullif(x.t, ''), '?'), CASE WHEN coalesce(x.p, '') = '' THEN '' ELSE concat(' (phase: ', x.p, ')') END)"
    entry = f"CASE WHEN coalesce(x.s, '') <> '' THEN concat('  [occ ', CAST(x.n AS VARCHAR), '] [', {flag}, '] ', x.s, CASE WHEN coalesce(x.m, '') = '' THEN '' ELSE concat(' - ', x.m) END) END"
    finding = f"concat('  [', {flag}, '] ', x.d)"
    last = "array_to_string(list_filter([CASE WHEN hurt IS NOT NULL THEN concat('Injury: ', hurt[1], ' fatal, ', hurt[2], ' serious, ', hurt[3], ' minor, ', hurt[4], ' none') END, 'Aircraft damage: ' || damage], lambda y: y IS NOT NULL), '. ')"
    lines = f"""list_concat(['STRUCTURED FINDINGS (official investigation):'], list_filter(['Primary cause: ' || primary_cause, 'Secondary cause: ' || second], lambda y: y IS NOT NULL), {titled('Occurrences', 'os', listed('os', place))},
      {titled('Sequence of events', 'es', listed('es', entry, 30))}, {titled('Findings', 'fs', listed('fs', finding, 15))}, list_filter([nullif({last}, '') || '.'], lambda y: y IS NOT NULL))"""
    return f"""WITH {_enriched_sql()} SELECT record_id, CAST(4 AS INT) AS n_messages, concat('NARRATIVE:', chr(10), record_id, CASE WHEN primary_cause IS NULL AND coalesce(len(es), 0) = 0 AND coalesce(len(fs), 0) = 0 THEN '' ELSE concat(chr(10), chr(10), array_to_string({lines}, chr(10))) END) AS content FROM full_rows"""


@fixture
def edge_lines(d):
    """Links as typed edges between the nodes of a record; some nodes are missing or no events."""
    return f"""SELECT l.record_id, l.dst_idx, l.link_pos, concat('n', CAST(l.src_idx AS {d.S})) AS src, concat('n', CAST(l.dst_idx AS {d.S})) AS dst, CASE WHEN l.strength = 'direct' THEN 'CAUSES' WHEN l.link_pos = 1 THEN 'INVOLVES' ELSE 'PRECEDES' END AS type FROM links l"""


@fixture
def graph_node_rows(d):
    return f"SELECT record_id, idx, concat('n', CAST(idx AS {d.S})) AS id, CASE WHEN event_id % 13 = 0 THEN 'condition' ELSE 'event' END AS kind, factor_type AS event_type FROM nodes WHERE event_id % 29 <> 0"


def _graph_texts(spark, sf_dir):
    """Answers of a model in the older format, some in fences or with words around them."""
    nodes, edges = _fixture(spark, sf_dir, "graph_node_rows"), _fixture(spark, sf_dir, "edge_lines")
    own = nodes.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "id", "kind", "event_type"))), lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["event_type"].alias("event_type"))).alias("nodes"))
    led = edges.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dst_idx", "link_pos", "src", "dst", "type"))), lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"), x["type"].alias("type"))).alias("edges"))
    text = F.to_json(F.struct("nodes", "edges"))
    fenced = F.when(F.length(text) % 3 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(F.length(text) % 3 == 1, F.concat(F.lit("Here: "), text)).otherwise(text)
    return own.join(led, "record_id", "full").select("record_id", fenced.alias("raw"))


@custom
def strict_graphs(spark, sf_dir):
    """Answers of the older format by what is wrong with them; one bad edge rejects its record."""
    parsed = typed_edges.parsed(_graph_texts(spark, sf_dir))
    return parsed.groupBy(F.coalesce(F.regexp_extract("error", "^[a-z ]+", 0), F.lit("fine")).alias("state")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("nodes"), F.lit(0))).alias("n_nodes"), F.sum(F.coalesce(F.size("edges"), F.lit(0))).alias("n_edges"))


@custom
def typed_precedence(spark, sf_dir):
    """Records of a category in which one factor leads to another by a typed edge."""
    parsed = typed_edges.parsed(_graph_texts(spark, sf_dir))  # rejected ones have no edges
    return typed_edges.precedence(typed_edges.typed_pairs(parsed, _fixture(spark, sf_dir, "vocabulary")).join(_fixture(spark, sf_dir, "records"), "record_id"))


def _rejected():
    return """ends AS (SELECT record_id, src AS id FROM edge_lines UNION ALL SELECT record_id, dst FROM edge_lines), rejected AS (SELECT DISTINCT e.record_id FROM ends e LEFT JOIN graph_node_rows n ON n.record_id = e.record_id AND n.id = e.id WHERE n.id IS NULL),
    told AS (SELECT record_id FROM graph_node_rows UNION SELECT record_id FROM edge_lines)"""


def strict_graphs_oracle(d):
    return f"""WITH {_rejected()}, good AS (SELECT record_id FROM told WHERE record_id NOT IN (SELECT record_id FROM rejected))
    SELECT 'edge end not in nodes' AS state, count(*) AS n, CAST(0 AS BIGINT) AS n_nodes, CAST(0 AS BIGINT) AS n_edges FROM rejected HAVING count(*) > 0
    UNION ALL SELECT 'fine', count(*), (SELECT count(*) FROM graph_node_rows SEMI JOIN good USING (record_id)), (SELECT count(*) FROM edge_lines SEMI JOIN good USING (record_id)) FROM good HAVING count(*) > 0"""


def typed_precedence_oracle(d):
    return f"""WITH {_rejected()} SELECT r.category, s.event_type AS src, t.event_type AS dst, count(DISTINCT e.record_id) AS n FROM edge_lines e ANTI JOIN rejected x ON x.record_id = e.record_id JOIN graph_node_rows s ON s.record_id = e.record_id AND s.id = e.src JOIN graph_node_rows t ON t.record_id = e.record_id AND t.id = e.dst
      JOIN records r ON r.record_id = e.record_id JOIN vocabulary a ON a.factor_type = s.event_type JOIN vocabulary b ON b.factor_type = t.event_type WHERE e.type IN ('CAUSES', 'PRECEDES') AND s.kind = 'event' AND t.kind = 'event' AND s.event_type <> t.event_type GROUP BY ALL"""


@custom
def icing_sensitivity(spark, sf_dir):
    """Discrimination of the icing model and its worked interventions with both constants scaled, every pair of scales."""
    grid = [(a, b) for a in sensitivity.SCALES for b in sensitivity.SCALES]
    found = sensitivity.icing_grid(_fixture(spark, sf_dir, "occurrence_rows"), "t_c", "td_c", "y", grid)
    return found.select("cooling_scale", "exposure_scale", "n", "n_pos", *[F.round(c, 6).alias(c) for c in ("cooling", "exposure", "auc", "p_ice", "risk", "risk_heat", "risk_dry")], "ranking_preserved")


@custom
def icing_sensitivity_summary(spark, sf_dir):
    """Ranges of discrimination along each constant, and whether the interventions keep their order everywhere."""
    grid = [(a, 1.0) for a in sensitivity.SCALES] + [(1.0, b) for b in sensitivity.SCALES if b != 1.0]
    found = once(sensitivity.icing_grid(_fixture(spark, sf_dir, "occurrence_rows"), "t_c", "td_c", "y", grid))
    return sensitivity.summary(found).select(*[F.round(c, 6).alias(c) if c.startswith("auc_m") else F.col(c) for c in ("auc_min_cooling", "auc_max_cooling", "auc_min_exposure", "auc_max_exposure", "auc_invariant_to_exposure", "ranking_preserved_everywhere")])


def _grid_sql(cells):
    es = lambda t: f"(6.112 * exp(17.62 * ({t}) / (243.12 + ({t}))))"
    risk = lambda t, td: f"(CASE WHEN {t} - dt >= 0 THEN 0.0 ELSE 1 - exp(-k * greatest(0.0, {es(f'least(least({td}, {t}), 0.0)')} - {es(f'({t} - dt)')})) END)"
    values = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in cells)
    return f"""scaled AS (SELECT a, b, 32.0 * a AS dt, 0.6 * b AS k FROM (VALUES {values}) v(a, b)),
    points AS (SELECT a, b, y, {risk('t_c', 'td_c')} AS p FROM scaled, occurrence_rows WHERE t_c IS NOT NULL AND td_c IS NOT NULL AND y IS NOT NULL),
    ranked AS (SELECT a, b, y, rank() OVER (PARTITION BY a, b ORDER BY p) + (count(*) OVER (PARTITION BY a, b, p) - 1) / 2 AS r FROM points),
    aucs AS (SELECT a, b, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, (sum(r) FILTER (y = 1) - n_pos * (n_pos + 1) / 2) / (n_pos * (n - n_pos)) AS auc FROM ranked GROUP BY a, b),
    worked AS (SELECT a, b, dt, k, {risk('13.0', '12.0')} AS base, {risk('43.0', '12.0')} AS heat, {risk('13.0', '(-5.0)')} AS dry FROM scaled),
    whole_grid AS (SELECT a, b, dt, k, n, n_pos, auc, base, heat, dry, heat < dry AND dry < base AS kept FROM worked JOIN aucs USING (a, b))"""


def icing_sensitivity_oracle(d):
    """Ranks of all records in every cell."""
    cells = [(a, b) for a in sensitivity.SCALES for b in sensitivity.SCALES]
    return f"WITH {_grid_sql(cells)} SELECT a AS cooling_scale, b AS exposure_scale, n, n_pos, round(dt, 6) AS cooling, round(k, 6) AS exposure, round(auc, 6) AS auc, round(base, 6) AS p_ice, round(base * 0.667, 6) AS risk, round(heat * 0.667, 6) AS risk_heat, round(dry * 0.667, 6) AS risk_dry, kept AS ranking_preserved FROM whole_grid"


def icing_sensitivity_summary_oracle(d):
    cells = [(a, 1.0) for a in sensitivity.SCALES] + [(1.0, b) for b in sensitivity.SCALES if b != 1.0]
    return f"""WITH {_grid_sql(cells)} SELECT round(min(auc) FILTER (b = 1), 6) AS auc_min_cooling, round(max(auc) FILTER (b = 1), 6) AS auc_max_cooling, round(min(auc) FILTER (a = 1), 6) AS auc_min_exposure, round(max(auc) FILTER (a = 1), 6) AS auc_max_exposure,
      max(auc) FILTER (a = 1) - min(auc) FILTER (a = 1) < 1e-9 AS auc_invariant_to_exposure, bool_and(kept) AS ranking_preserved_everywhere FROM whole_grid"""


@fixture
def wind_rows(d):
    """All records with their wind, if they have one, and whether they have the factors of both links."""
    return """SELECT r.record_id, w.wind_kts, CASE WHEN g.record_id IS NULL THEN 0 ELSE 1 END AS gust, CASE WHEN s.record_id IS NULL THEN 0 ELSE 1 END AS shear FROM records r LEFT JOIN clean_weather w ON w.record_id = r.record_id
    LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'VIEW_0') g ON g.record_id = r.record_id LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'ERROR_0') s ON s.record_id = r.record_id"""


@custom
def wind_scenarios(spark, sf_dir):
    """Shares of records with a factor by the wind, through rising links on gust exceedance and shear margin, as flown and ten knots faster."""
    rows = _fixture(spark, sf_dir, "wind_rows")
    return links.wind_scenarios(rows.filter("wind_kts IS NOT NULL"), rows).select("link", F.col("wind_kts").cast("long").alias("wind_kts"), *[F.round(c, 6).alias(c) for c in ("score", "calibrated", "score_faster", "calibrated_faster", "rescaled")])


def wind_scenarios_oracle(d):
    """Links by the greatest of least means over all stretches of scores."""
    gust = lambda w, v: links.px.p_exceed_dryden(links.px.stall_gust(f"{v!r}::DOUBLE"), w, f"({v * links.px.KT_TO_FPS!r}::DOUBLE)")
    shear = lambda w, v: f"({w} - ({v!r}::DOUBLE - {links.px.VS_KT}))"
    slow, fast = links.px.APPROACH_KT, links.FASTER * links.px.VS_KT
    winds = ", ".join(f"({w}.0::DOUBLE)" for w in links.WINDS)
    given = " UNION ALL ".join(f"SELECT '{k}' AS link, wind, {f('wind', slow)} AS score, {f('wind', fast)} AS faster FROM (VALUES {winds}) v(wind)" for k, f in (("gust", gust), ("shear", shear)))
    seen = " UNION ALL ".join(f"SELECT '{k}' AS link, {f('wind_kts', slow)} AS x, {k} AS y FROM wind_rows WHERE wind_kts IS NOT NULL" for k, f in (("gust", gust), ("shear", shear)))
    at = lambda s: f"""(SELECT CASE WHEN lo.x IS NULL THEN hi.p WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.p ELSE lo.p + (hi.p - lo.p) * (g.{s} - lo.x) / (hi.x - lo.x) END FROM (SELECT max(x) AS x, arg_max(p, x) AS p FROM fit WHERE fit.link = g.link AND x <= g.{s}) lo, (SELECT min(x) AS x, arg_min(p, x) AS p FROM fit WHERE fit.link = g.link AND x >= g.{s}) hi)"""
    return f"""WITH seen AS ({seen}), pts AS (SELECT link, x, sum(y) AS s, count(*) AS n FROM seen GROUP BY link, x), means AS (SELECT a.link, a.x AS a, b.x AS b, sum(c.s) / sum(c.n) AS m FROM pts a JOIN pts b ON a.link = b.link AND a.x <= b.x JOIN pts c ON c.link = a.link AND c.x BETWEEN a.x AND b.x GROUP BY ALL),
    fit AS (SELECT link, x, max(m) AS p FROM (SELECT p.link, p.x, m.a, min(m.m) AS m FROM pts p JOIN means m ON m.link = p.link AND m.a <= p.x AND m.b >= p.x GROUP BY ALL) t GROUP BY link, x),
    g AS ({given}), level AS (SELECT avg(x) AS mean, (SELECT avg(gust) FROM wind_rows) AS share FROM seen WHERE link = 'gust')
    SELECT link, CAST(wind AS BIGINT) AS wind_kts, round(score, 6) AS score, round({at('score')}, 6) AS calibrated, round(faster, 6) AS score_faster, round({at('faster')}, 6) AS calibrated_faster, CASE WHEN link = 'gust' THEN round(least(1.0, share * score / mean), 6) END AS rescaled FROM g, level"""


@fixture
def tier_table(d):
    """Factors with a model of their own; users bind theirs (``vocab.TIERS``)."""
    return "SELECT factor_type, tier, model FROM (VALUES ('VIEW_0', 'physics', 'gust'), ('ERROR_0', 'physics', 'icing'), ('CLICK_1', 'surrogate', 'hazard')) AS v(factor_type, tier, model)"


@operator
def factor_tiers(d):
    """Records of every causal factor and how its occurrence is modelled; without an entry by the corpus rate."""
    return """SELECT c.factor_type, coalesce(t.tier, 'data') AS tier, t.model, c.n FROM (SELECT factor_type, count(*) AS n FROM causal_presence GROUP BY factor_type) c LEFT JOIN tier_table t ON t.factor_type = c.factor_type"""


@fixture
def gold_records(d):
    """Reports with what a reader would find in them; some could not be read."""
    return f"""SELECT r.report_number AS record_id, r.report_type, CASE WHEN c.c_custkey % 3 = 0 THEN '' WHEN c.c_custkey % 3 = 1 THEN c.c_name END AS probable_cause_text, coalesce(o.n, 0) AS n_findings, coalesce(o.n_open, 0) AS n_occurrences, c.c_custkey % 11 = 0 AS failed
    FROM report_list r JOIN customer c ON concat('R', CAST(c.c_custkey AS {d.S})) = r.report_number LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey"""


@operator
def gold_report(d):
    """What a gold set holds, in all (no type) and by type of report; failures are candidates without a record."""
    return """SELECT report_type, grouping(report_type) = 1 AS total, count(*) AS n_candidates, count(*) FILTER (WHERE NOT failed) AS n_records, count(*) FILTER (WHERE failed) AS n_failures, count(*) FILTER (WHERE NOT failed AND probable_cause_text <> '') AS with_probable_cause,
      count(*) FILTER (WHERE NOT failed AND n_findings > 0) AS with_findings, count(*) FILTER (WHERE NOT failed AND n_occurrences > 0) AS with_occurrences FROM gold_records GROUP BY GROUPING SETS ((report_type), ())"""


ORACLES |= {f.__name__.removesuffix("_oracle"): f for f in (enriched_records_oracle, enrichment_coverage_oracle, packed_prompts_oracle, strict_graphs_oracle, typed_precedence_oracle, icing_sensitivity_oracle, icing_sensitivity_summary_oracle, wind_scenarios_oracle)}
