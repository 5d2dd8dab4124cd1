"""Physics occurrence models, guards and the admissibility monitor."""

from __future__ import annotations

from ..functions import physics_sql as px
from ..operators import arms
from .registry import fixture, operator

# Aircraft key, wing area (m2), gross mass (kg), largest clean lift coefficient.
AIRCRAFT = (
    ("CESSNA 152", "152", 15.0, 757, 1.50), ("CESSNA 172", "172", 16.2, 1111, 1.55), ("CESSNA 182", "182", 16.3, 1406, 1.55), ("CESSNA 210", "210", 16.2, 1723, 1.50),
    ("PIPER PA-28", "PA-28", 15.8, 1055, 1.50), ("PIPER PA-28-235", "PA-28-235", 15.8, 1360, 1.50), ("PIPER PA-18", "PA-18", 16.6, 794, 1.55), ("PIPER PA-32", "PA-32", 16.6, 1633, 1.50),
    ("BEECH A36", "A36", 16.8, 1656, 1.50), ("BEECH 35", "35", 16.5, 1315, 1.50), ("MOONEY M20", "M20", 15.5, 1157, 1.45), ("CIRRUS SR22", "SR22", 13.5, 1542, 1.45), ("CHAMPION 7AC", "7AC", 16.6, 544, 1.55),
)
LOW_PHASES = "('takeoff', 'initial_climb', 'go_around', 'approach', 'final_approach', 'landing')"
T, TD = "t_c", "td_c"


@operator
def weather_hygiene(d):
    return "SELECT record_id, round(t_c, 6) AS t_c, round(td_c, 6) AS td_c, wind_kts, dens_alt_ft FROM clean_weather"


@operator
def relative_humidity(d):
    return f"SELECT record_id, round(least(1E0, {px.vapor_pressure(TD)} / {px.vapor_pressure(T)}), 6) AS rh FROM clean_weather"


@operator
def carb_icing(d):
    """Condensable water, probability and zone at every power setting."""
    return " UNION ALL ".join(f"SELECT record_id, '{p}' AS power, round({px.condensable(T, TD, p)}, 6) AS w_hpa, round({px.p_ice(T, TD, p)}, 6) AS p_ice FROM clean_weather" for p in px.COOLING)


@operator
def icing_zones(d):
    return f"SELECT zone, count(*) AS n FROM (SELECT {px.zone(px.p_ice(T, TD))} AS zone FROM clean_weather) t GROUP BY zone"


@operator
def guard_margins(d):
    return f"SELECT record_id, round({px.icing_margin(T, TD)}, 6) AS icing_margin, round(wind_kts - {px.f(px.APPROACH_KT - px.VS_KT)}, 6) AS shear_margin FROM clean_weather"


@operator
def hybrid_icing_risk(d):
    """Icing probability times the graph's conditional probabilities."""
    p = px.p_ice(T, TD)
    return f"SELECT record_id, round({p} * {px.P_ENGINE_GIVEN_ICE}E0, 6) AS p_engine, round({p} * {px.P_SERIOUS_GIVEN_ICE}E0, 6) AS p_serious, round({p} * {px.P_SERIOUS_GIVEN_ICE}E0 / {px.BASELINE_SERIOUS}E0, 6) AS ratio FROM clean_weather"


@operator
def icing_surface(d):
    """Icing probability over a grid of temperature and dew point."""
    grid = f"SELECT CAST(t AS DOUBLE) AS t, CAST(td AS DOUBLE) AS td FROM (SELECT {d.explode}({d.sequence('-20', '40')}) AS t) a CROSS JOIN (SELECT {d.explode}({d.sequence('-20', '40')}) AS td) b WHERE td <= t"
    return f"SELECT t, td, round({px.p_ice('t', 'td', 'cruise')}, 6) AS p_ice FROM ({grid}) g"


@operator
def sensitivity_grid(d):
    """Mean icing probability for cooling and exposure scaled by 0.75 to 1.25."""
    throat = "(t_c - 32E0 * s.ct)"
    w = f"(CASE WHEN {throat} < 0 THEN greatest(0E0, {px.vapor_pressure('least(td_c, 0E0)')} - {px.vapor_pressure(throat)}) ELSE 0E0 END)"
    scale = "(SELECT CAST(0.75 AS DOUBLE) AS v UNION ALL SELECT CAST(0.9 AS DOUBLE) UNION ALL SELECT CAST(1.0 AS DOUBLE) UNION ALL SELECT CAST(1.1 AS DOUBLE) UNION ALL SELECT CAST(1.25 AS DOUBLE))"
    return f"SELECT ct, ck, round(avg(1E0 - exp(-0.6E0 * ck * {w})), 6) AS mean_p FROM clean_weather CROSS JOIN (SELECT a.v AS ct, b.v AS ck FROM {scale} a CROSS JOIN {scale} b) s GROUP BY ct, ck"


@fixture
def speeds(d):
    return f"SELECT DISTINCT p_partkey % 120 + 40 AS kt, CAST(p_partkey % 120 + 40 AS DOUBLE) AS v FROM part"


@operator
def gust_load(d):
    return f"SELECT kt, round({px.pratt('v')}, 6) AS dn_per_fps, round(1E0 + {px.pratt('v')} * 30E0, 6) AS n_at_30 FROM speeds"


@operator
def overload_probability(d):
    return f"SELECT kt, round({px.p_overload('v')}, 6) AS p_ultimate, round({px.p_overload('v', ultimate=False)}, 6) AS p_limit FROM speeds"


@operator
def gust_stall(d):
    return "SELECT kt, " + ", ".join(f"round({px.p_gust_stall('v', c)}, 6) AS p_{c}" for c in ("light", "moderate", "severe")) + " FROM speeds"


@operator
def shear_stall(d):
    return f"SELECT kt, round({px.p_shear_stall('v')}, 6) AS p_shear FROM speeds"


@operator
def dryden_gust_stall(d):
    wind = f"SELECT {d.explode}({d.sequence('0', '45')}) AS wind"
    return f"SELECT kt, CAST(wind AS BIGINT) AS wind, round(CASE WHEN v <= {px.VS_KT}E0 THEN 1E0 ELSE {px.p_exceed_dryden(px.stall_gust('v'), 'wind', f'v * {px.KT_TO_FPS}E0')} END, 6) AS p FROM speeds CROSS JOIN ({wind}) w"


@operator
def engine_hazard(d):
    """Base hazard, icing path and fuel margin as a noisy-OR."""
    fuel = px.normal_tail("2E0 / 0.75E0")
    return f"SELECT record_id, round(1E0 - exp(-1E-4 * 1.5E0) * (1E0 - {px.p_ice(T, TD)} * {px.P_ENGINE_GIVEN_ICE}E0) * (1E0 - {fuel}), 6) AS p FROM clean_weather"


@operator
def fuel_exhaustion(d):
    r = f"SELECT {d.explode}({d.sequence('1', '16')}) AS q"
    return f"SELECT CAST(q AS BIGINT) AS quarter_hours, round({px.normal_tail('(q * 0.25E0) / 0.75E0')}, 6) AS p FROM ({r}) t"


@operator
def density_altitude(d):
    a = f"SELECT {d.explode}({d.sequence('0', '12')}) AS kft"
    rho = px.isa_density("kft * 304.8E0", "15E0")
    return f"SELECT CAST(kft AS BIGINT) AS kft, round({rho}, 6) AS rho, round({px.density_altitude(rho)}, 4) AS density_altitude_m, round({px.stall_speed('1111E0 * 9.80665E0', rho, '16.2E0', '1.55E0')}, 6) AS v_stall FROM ({a}) t"


@operator
def aircraft_lookup(d):
    """Longest key first; the key or its type part in the text, else the generic type."""
    text = "upper(concat(p_brand, ' ', p_name, ' ', CAST(p_size AS " + d.S + "), CASE WHEN p_partkey % 3 = 0 THEN ' PA-28' WHEN p_partkey % 3 = 1 THEN ' 172' ELSE '' END))"
    whens = " ".join(f"WHEN strpos(t, '{key}') > 0 OR strpos(t, '{part}') > 0 THEN '{key}'" for key, part, *_ in sorted(AIRCRAFT, key=lambda a: -len(a[0]))) if d.name == "duckdb" else " ".join(
        f"WHEN instr(t, '{key}') > 0 OR instr(t, '{part}') > 0 THEN '{key}'" for key, part, *_ in sorted(AIRCRAFT, key=lambda a: -len(a[0])))
    return f"SELECT p_partkey, CASE {whens} ELSE 'GENERIC SEP' END AS aircraft FROM (SELECT p_partkey, {text} AS t FROM part) x"


def _mapped(column: str) -> str:
    """Factors of the fixture as factors that guards know."""
    names = {"ERROR_0": "CARBURETOR_OR_INDUCTION_ICING", "ERROR_1": "STALL", "ERROR_2": "STRUCTURAL_OVERLOAD", "CLICK_0": "WIND_SHEAR_OR_GUST", "CLICK_1": "TURBULENCE_ENCOUNTER", "CLICK_2": "FUEL_EXHAUSTION_OR_STARVATION", "VIEW_0": "AIRFRAME_STRUCTURAL_FAILURE", "VIEW_1": "ADVERSE_WIND_CONDITION"}
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


GUARD = """CASE WHEN dst = 'CARBURETOR_OR_INDUCTION_ICING' THEN 'carb_icing'
  WHEN dst = 'STALL' AND src = 'WIND_SHEAR_OR_GUST' THEN 'shear_stall'
  WHEN dst = 'STALL' AND src IN ('TURBULENCE_ENCOUNTER', 'ADVERSE_WIND_CONDITION') THEN 'gust_stall'
  WHEN dst = 'STALL' THEN 'stall_prior'
  WHEN dst IN ('STRUCTURAL_OVERLOAD', 'AIRFRAME_STRUCTURAL_FAILURE') AND src IN ('TURBULENCE_ENCOUNTER', 'WIND_SHEAR_OR_GUST', 'ADVERSE_WIND_CONDITION') THEN 'gust_overload'
  WHEN dst = 'FUEL_EXHAUSTION_OR_STARVATION' THEN 'fuel_exhaustion' END"""


@fixture
def guarded(d):
    """Chain transitions with their guard and the recorded drivers."""
    return f"""SELECT t.record_id, t.src, t.dst, t.phase, {GUARD} AS guard, w.t_c, w.td_c, w.wind_kts, w.dens_alt_ft FROM (
      SELECT n.record_id, '__START__' AS src, {_mapped('n.factor_type')} AS dst, n.phase_of_flight AS phase FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.record_id = n.record_id AND l.dst_idx = n.idx)
      UNION ALL SELECT l.record_id, {_mapped('s.factor_type')}, {_mapped('t.factor_type')}, t.phase_of_flight FROM links l JOIN nodes s ON l.record_id = s.record_id AND l.src_idx = s.idx JOIN nodes t ON l.record_id = t.record_id AND l.dst_idx = t.idx) t
    LEFT JOIN clean_weather w ON t.record_id = w.record_id"""


@operator
def guard_dispatch(d):
    return "SELECT src, dst, coalesce(guard, 'none') AS guard, count(*) AS n FROM guarded GROUP BY src, dst, coalesce(guard, 'none')"


@operator
def violation_rate(d):
    """Violations by guard among checkable transitions: with the true margins and with their signs turned."""
    return f"""WITH a AS (SELECT guard, {arms.checkable()} AS checkable, {arms.availability()} AS avail, {arms.availability(turned=True)} AS negated FROM guarded WHERE guard IS NOT NULL)
    SELECT guard, count(*) AS n, count(*) FILTER (WHERE checkable) AS n_checkable, count(*) FILTER (WHERE checkable AND avail < 1E-9) AS violations, count(*) FILTER (WHERE checkable AND negated < 1E-9) AS violations_negated FROM a GROUP BY guard"""


@operator
def monitor_coverage(d):
    return f"SELECT CASE WHEN guard IS NULL THEN 'unguarded' WHEN guard = 'carb_icing' AND t_c IS NULL THEN 'unrecorded' WHEN guard IN ('gust_stall', 'shear_stall', 'gust_overload') AND (wind_kts IS NULL OR coalesce(phase, '') NOT IN {LOW_PHASES}) THEN 'unrecorded' WHEN guard IN ('stall_prior', 'fuel_exhaustion') THEN 'not_coded' ELSE 'checkable' END AS coverage, count(*) AS n FROM guarded GROUP BY 1"


@operator
def icing_summary(d):
    """Icing scores of records with the target, of others, and of those with both factors."""
    return f"""SELECT grp, count(*) AS n, round(avg(p), 6) AS mean_p, round({d.percentile('p', 0.5)}, 6) AS median_p, round(avg(CASE WHEN p >= 0.4 THEN 1E0 ELSE 0E0 END), 6) AS share_40, round(avg(CASE WHEN p >= 0.8 THEN 1E0 ELSE 0E0 END), 6) AS share_80
    FROM (SELECT CASE WHEN e.record_id IS NULL THEN 'other' WHEN s.record_id IS NULL THEN 'icing' ELSE 'icing_and_failure' END AS grp, {px.p_ice(T, TD)} AS p FROM clean_weather w
      LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'ERROR_0') e ON e.record_id = w.record_id LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'CLICK_0') s ON s.record_id = w.record_id) t GROUP BY grp"""


@operator
def weather_bins(d):
    """Severity by right-closed temperature bins."""
    return """SELECT bin, count(*) AS n, round(avg(CASE WHEN sev_ordinal >= 3 THEN 1E0 ELSE 0E0 END), 6) AS p_serious FROM (
      SELECT CASE WHEN t_c <= -10 THEN 'a' WHEN t_c <= 0 THEN 'b' WHEN t_c <= 10 THEN 'c' WHEN t_c <= 20 THEN 'd' ELSE 'e' END AS bin, r.sev_ordinal FROM clean_weather w JOIN records r ON w.record_id = r.record_id) t GROUP BY bin"""


@operator
def pairwise_bin_order(d):
    """Pairs of weather bins whose mean score and rate are ordered alike, near ties ignored."""
    return f"""WITH b AS (SELECT CAST(floor(t_c / 5) AS BIGINT) AS bin, count(*) AS n, avg({px.p_ice(T, TD)}) AS score, avg(CASE WHEN sev_ordinal >= 3 THEN 1E0 ELSE 0E0 END) AS rate FROM clean_weather w JOIN records r ON w.record_id = r.record_id GROUP BY 1)
    SELECT count(*) AS n_pairs, count(*) FILTER (WHERE (x.score - y.score) * (x.rate - y.rate) > 0) AS n_agree FROM b x JOIN b y ON x.bin < y.bin WHERE x.n >= 5 AND y.n >= 5 AND abs(x.score - y.score) >= 0.02 AND abs(x.rate - y.rate) >= 0.002"""


@operator
def zone_relative_risk(d):
    """Share of target records against share of all hours by icing zone."""
    return f"""WITH z AS (SELECT {px.zone(px.p_ice(T, TD))} AS zone, CASE WHEN e.record_id IS NULL THEN 0 ELSE 1 END AS y FROM clean_weather w LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'ERROR_0') e ON e.record_id = w.record_id)
    SELECT zone, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_target, round((CAST(sum(y) AS DOUBLE) / nullif(sum(sum(y)) OVER (), 0)) / (CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()), 6) AS relative_risk FROM z GROUP BY zone"""


@fixture
def risk_cases(d):
    """Records with weather as cases: a user's months stand for a station's, the target is a factor."""
    return f"""SELECT w.record_id AS case_id, n.user_id AS station, n.month, n.hour, CASE WHEN e.record_id IS NULL THEN 0 ELSE 1 END AS target, {px.zone(px.p_ice(T, TD))} AS zone
    FROM clean_weather w JOIN (SELECT record_id, min(user_id) AS user_id, CAST(min(extract(month FROM ts)) AS INT) AS month, CAST(min(extract(hour FROM ts)) AS INT) AS hour FROM (SELECT concat(CAST(user_id AS {d.S}), '_', {d.day('ts')}) AS record_id, user_id, ts FROM events) x GROUP BY record_id) n ON n.record_id = w.record_id
    LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'ERROR_0') e ON e.record_id = w.record_id"""


@fixture
def routine_hours(d):
    """Hours of a station with their icing zone."""
    return f"""SELECT station, month, hour, {px.zone(px.p_ice(T, TD))} AS zone FROM (
      SELECT user_id AS station, CAST(extract(month FROM ts) AS INT) AS month, CAST(extract(hour FROM ts) AS INT) AS hour, (w.temp_f - 32) * 5 / 9 AS t_c, least((w.dew_f - 32) * 5 / 9, (w.temp_f - 32) * 5 / 9) AS td_c
      FROM events e JOIN weather w ON w.event_id = e.event_id WHERE w.temp_f IS NOT NULL AND w.dew_f IS NOT NULL) h"""


@fixture
def occurrence_rows(d):
    """Records with weather as rows of an occurrence model: year, covariates, chart probability, margin and target."""
    return f"""SELECT w.record_id, 1990 + CAST({d.md5_number('w.record_id')} % 30 AS INT) AS year, CASE WHEN e.record_id IS NULL THEN 0 ELSE 1 END AS y, r.category, f.phase, w.t_c, w.td_c,
      {px.p_ice(T, TD)} AS chart, {px.condensable(T, TD)} AS margin
    FROM clean_weather w JOIN records r ON r.record_id = w.record_id LEFT JOIN (SELECT record_id, min_by(coalesce(phase_of_flight, 'unknown'), idx) AS phase FROM nodes WHERE class = 'event' GROUP BY record_id) f ON f.record_id = w.record_id
    LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'ERROR_0') e ON e.record_id = w.record_id"""


@operator
def weather_join(d):
    """Records with factors and weather, one weather row each."""
    return "SELECT r.record_id, r.category, r.sev_ordinal, round(w.t_c, 6) AS t_c, w.wind_kts FROM records r JOIN clean_weather w ON r.record_id = w.record_id"


@operator
def phase_rates(d):
    """Rate of the target by phase of the first event node."""
    return """SELECT phase, count(*) AS n, round(avg(y), 6) AS rate FROM (SELECT f.record_id, f.phase, CASE WHEN p.record_id IS NULL THEN 0E0 ELSE 1E0 END AS y
      FROM (SELECT record_id, min_by(coalesce(phase_of_flight, 'unknown'), idx) AS phase FROM nodes WHERE class = 'event' GROUP BY record_id) f LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'ERROR_1') p ON p.record_id = f.record_id) t GROUP BY phase"""


@operator
def scalar_rescale(d):
    """Chart probabilities brought to the observed level, at most 1."""
    return f"""WITH w AS (SELECT w.record_id, {px.p_ice(T, TD)} AS p, CASE WHEN e.record_id IS NULL THEN 0E0 ELSE 1E0 END AS y FROM clean_weather w LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'ERROR_0') e ON e.record_id = w.record_id)
    SELECT w.record_id, round(least(1E0, w.p * m.y / m.p), 6) AS p FROM w CROSS JOIN (SELECT avg(y) AS y, avg(p) AS p FROM w) m"""


@operator
def stratified_rescale(d):
    """Rate by phase scaled by load factor: P(F | phase) * L(phase, n) / L(phase), at most 1."""
    return """WITH r AS (SELECT phase, avg(y) AS rate, count(*) AS n FROM (SELECT f.phase, CASE WHEN p.record_id IS NULL THEN 0E0 ELSE 1E0 END AS y
      FROM (SELECT record_id, min_by(coalesce(phase_of_flight, 'unknown'), idx) AS phase FROM nodes WHERE class = 'event' GROUP BY record_id) f LEFT JOIN (SELECT record_id FROM presence WHERE factor_type = 'ERROR_1') p ON p.record_id = f.record_id) t GROUP BY phase),
    lam AS (SELECT 'takeoff' AS phase, 0.12E0 AS l1, 0.2E0 AS l2 UNION ALL SELECT 'cruise', 0.03E0, 0.05E0 UNION ALL SELECT 'approach', 0.15E0, 0.31E0 UNION ALL SELECT 'landing', 0.1E0, 0.16E0)
    SELECT r.phase, r.n, round(r.rate, 6) AS rate, round(least(1E0, r.rate * lam.l2 / lam.l1), 6) AS rescaled FROM r JOIN lam ON r.phase = lam.phase"""


@operator
def probability_of_necessity(d):
    """Necessity of omitted carburetor heat (+30 C) for icing and for the power loss, with bounds."""
    g, g1, pe, po = px.p_ice(T, TD), px.p_ice("(t_c + 30E0)", TD), px.P_ENGINE_GIVEN_ICE, 0.8
    return f"""WITH p AS (SELECT record_id, {g} AS g, {g1} AS g1 FROM clean_weather), q AS (SELECT *, 1E0 - (1E0 - g * {pe}E0) * {po}E0 AS p0, 1E0 - (1E0 - g1 * {pe}E0) * {po}E0 AS p1 FROM p WHERE g > 0)
    SELECT record_id, round(1E0 - g1 / g, 6) AS pn_icing, round({po}E0 * {pe}E0 * (g - g1) / p0, 6) AS pn_power_loss, round({po}E0 * {pe}E0 * (g - g1) / (g * (1E0 - (1E0 - {pe}E0) * {po}E0)), 6) AS pn_power_loss_given_icing,
      round(greatest(0E0, 1E0 - p1 / p0), 6) AS lower_bound, round(least(1E0, (1E0 - p1) / p0), 6) AS upper_bound FROM q"""


@operator
def haversine(d):
    """Distance of every site to the stations of its own one-degree band."""
    return f"SELECT site, station, round({px.haversine_km('c.lat', 'c.lon', 's.lat', 's.lon')}, 3) AS km FROM sites c JOIN stations s ON floor(c.lat) = floor(s.lat) AND floor(c.lon / 5) = floor(s.lon / 5)"


@operator
def nearest_station(d):
    """The three nearest stations within 60 km that were open in the year; known stations first, then distance.

    Half-degree latitude cells (a station is listed in three) turn the range join into an equi-join.
    """
    km = px.haversine_km("c.lat", "c.lon", "s.lat", "s.lon")
    cells = f"SELECT station, lat, lon, begin_year, end_year, wban, floor(lat / 0.6) + o AS cell FROM stations CROSS JOIN (SELECT {d.explode}({d.sequence('-1', '1')}) AS o) t"
    return f"""SELECT site, station, km, rn FROM (SELECT site, station, round(km, 3) AS km, CAST(row_number() OVER (PARTITION BY site ORDER BY CASE WHEN wban THEN 0 ELSE 1 END, km, station) AS BIGINT) AS rn FROM (
      SELECT c.site, s.station, s.wban, {km} AS km FROM sites c JOIN ({cells}) s ON s.cell = floor(c.lat / 0.6) AND c.yr BETWEEN s.begin_year AND s.end_year AND abs(c.lon - s.lon) <= 3) j WHERE km <= 60) r WHERE rn <= 3"""


@fixture
def named_sites(d):
    """Sites with the facility that observed and a month."""
    return f"SELECT site AS case_id, lat, lon, yr AS year, CAST(site % 12 + 1 AS INT) AS month, CASE WHEN site % 4 = 0 THEN concat('f', CAST(site % 60 AS {d.S})) WHEN site % 4 = 1 THEN '' END AS facility FROM sites"


@fixture
def coded_stations(d):
    return f"SELECT station, concat('KF', CAST(station % 60 AS {d.S})) AS code, lat, lon, begin_year, end_year, wban AS known FROM stations"


@fixture
def station_months(d):
    """Hours that a station has in a month; some have few."""
    return f"SELECT station, year, month, (station * 37 + year * 11 + month * 5) % 160 AS n_hours FROM (SELECT station, CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM coded_stations CROSS JOIN (SELECT {d.explode}({d.sequence('1990', '2020')}) AS y) a CROSS JOIN (SELECT {d.explode}({d.sequence('1', '12')}) AS m) b) t"


@operator
def hour_matched_controls(d):
    """Routine hours of the same user and month within three hours of the clock."""
    return """WITH h AS (SELECT event_id, user_id, event_type, extract(month FROM ts) AS m, CAST(extract(hour FROM ts) AS INT) AS h FROM events)
    SELECT a.event_id, count(*) AS n_controls FROM h a JOIN h b ON a.user_id = b.user_id AND a.m = b.m AND b.event_type = 'view' AND a.event_type = 'error'
      AND abs(((b.h - a.h + 12 + 24) % 24) - 12) <= 3 GROUP BY a.event_id"""


@operator
def damage_injury_crosstab(d):
    return "SELECT l_returnflag AS damage, l_linestatus AS injury, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"


@operator
def binomial_tail(d):
    """Lower tail of the binomial by a sum of logarithms."""
    t = f"SELECT {d.explode}({d.sequence('0', '10')}) AS k"
    s = f"SELECT {d.explode}({d.sequence('1', '10')}) AS i"
    return f"""WITH c AS (SELECT k, sum(CASE WHEN i <= k THEN ln((40E0 - i + 1) / i) ELSE 0 END) AS lc FROM ({t}) a CROSS JOIN ({s}) b GROUP BY k)
    SELECT CAST(x.k AS BIGINT) AS k, round(sum(exp(y.lc + y.k * ln(0.1E0) + (40 - y.k) * ln(0.9E0))), 6) AS tail FROM c x JOIN c y ON y.k <= x.k GROUP BY x.k"""
