"""Physics of the occurrence models as SQL expressions (the same in Spark and DuckDB).

Fixed values: aircraft constants, venturi cooling by power setting, the exposure
constant, icing zones, gust scales and the standard atmosphere.
"""

from __future__ import annotations

# Fixed values.
COOLING = {"takeoff": 12.0, "climb": 18.0, "cruise": 25.0, "descent": 32.0, "idle": 35.0}
K_EXPOSURE = 0.60
ZONES = (("serious", 0.80), ("moderate", 0.40), ("light", 0.10))
GRAVITY_FPS2, RHO_SLUG = 32.174, 0.0023769
WEIGHT_LBF, WING_FT2, CL_ALPHA, CHORD_FT, N_LIMIT, VS_KT, VA_KT, VC_KT = 2300.0, 174.0, 4.6, 4.9, 3.8, 52.0, 99.0, 120.0
GUST_SCALE = {"light": 5.0, "moderate": 10.0, "severe": 20.0, "thunderstorm": 20.0}
KT_TO_FPS = 1.68781
APPROACH_KT, ENCOUNTER_S = 1.25 * VS_KT, 120.0
P_ENGINE_GIVEN_ICE, P_SERIOUS_GIVEN_ICE, BASELINE_SERIOUS = 0.667, 0.227, 0.262
ISA_T0, ISA_P0, ISA_LAPSE, R_AIR, GRAVITY = 288.15, 101325.0, 0.0065, 287.05287, 9.80665


def f(x: float) -> str:
    """A double literal."""
    return f"CAST({x!r} AS DOUBLE)"


def vapor_pressure(t: str) -> str:
    """Saturation vapor pressure over water, hPa."""
    return f"(6.112E0 * exp(17.62E0 * ({t}) / (243.12E0 + ({t}))))"


def condensable(t: str, td: str, power: str = "descent") -> str:
    """Condensable subfreezing vapor w at the throttle plate, hPa."""
    throat = f"(({t}) - {COOLING[power]}E0)"
    return f"(CASE WHEN {throat} < 0 THEN greatest(0E0, {vapor_pressure(f'least(least({td}, {t}), 0E0)')} - {vapor_pressure(throat)}) ELSE 0E0 END)"


def p_ice(t: str, td: str, power: str = "descent") -> str:
    return f"(1E0 - exp(-{K_EXPOSURE}E0 * {condensable(t, td, power)}))"


def icing_margin(t: str, td: str, power: str = "descent") -> str:
    """Icing guard: w less its light-zone onset, as absolute humidity in g per cubic metre."""
    return f"(216.68E0 * ({condensable(t, td, power)} + ln(0.9E0) / {K_EXPOSURE}E0) / (({t}) - {COOLING[power]}E0 + 273.15E0))"


def zone(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} >= {cut} THEN '{name}'" for name, cut in ZONES) + " ELSE 'nil' END"


def pratt(v: str) -> str:
    """Load factor per ft/s of derived gust velocity."""
    ws = WEIGHT_LBF / WING_FT2
    mu = 2.0 * ws / (RHO_SLUG * CHORD_FT * CL_ALPHA * GRAVITY_FPS2)
    return f"({f(0.88 * mu / (5.3 + mu) * CL_ALPHA / (498.0 * ws))} * ({v}))"


def p_overload(v: str, climate: str = "thunderstorm", ultimate: bool = True) -> str:
    inc = (1.5 if ultimate else 1.0) * N_LIMIT - 1.0
    return f"exp(-({f(inc)} / {pratt(v)}) / {GUST_SCALE[climate]}E0)"


def stall_gust(v: str) -> str:
    """Gust velocity (ft/s) at which the accelerated stall speed meets the flown speed."""
    return f"((pow(({v}) / {VS_KT}E0, 2) - 1E0) / {pratt(v)})"


def p_gust_stall(v: str, climate: str = "moderate") -> str:
    return f"(CASE WHEN ({v}) <= {VS_KT}E0 THEN 1E0 ELSE exp(-{stall_gust(v)} / {GUST_SCALE[climate]}E0) END)"


def p_shear_stall(v: str, scale: float = 10.0) -> str:
    return f"(CASE WHEN ({v}) <= {VS_KT}E0 THEN 1E0 ELSE exp(-(({v}) - {VS_KT}E0) / {scale}E0) END)"


def p_exceed_dryden(u: str, wind: str, v_fps: str) -> str:
    """Chance that the vertical gust exceeds ``u`` within an encounter (level crossings of a Gaussian process)."""
    sigma = f"(0.1E0 * ({wind}) * {KT_TO_FPS}E0)"
    return f"(CASE WHEN {sigma} <= 0 THEN 0E0 ELSE 1E0 - exp(-(({v_fps}) / 400E0 * exp(-pow({u}, 2) / (2E0 * pow({sigma}, 2)))) * {ENCOUNTER_S}E0) END)"


def erf(x: str) -> str:
    """Abramowitz and Stegun 7.1.26."""
    t = f"(1E0 / (1E0 + 0.3275911E0 * abs({x})))"
    poly = f"(((((1.061405429E0 * {t} - 1.453152027E0) * {t}) + 1.421413741E0) * {t} - 0.284496736E0) * {t} + 0.254829592E0) * {t}"
    return f"(sign({x}) * (1E0 - {poly} * exp(-({x}) * ({x}))))"


def normal_tail(z: str) -> str:
    """P(Z > z)."""
    return f"(0.5E0 * (1E0 - {erf(f'(({z}) / sqrt(2E0))')}))"


def isa_density(alt_m: str, delta: str = "0E0") -> str:
    t = f"({ISA_T0}E0 - {ISA_LAPSE}E0 * ({alt_m}))"
    return f"({ISA_P0}E0 * pow({t} / {ISA_T0}E0, {f(GRAVITY / (R_AIR * ISA_LAPSE))}) / ({R_AIR}E0 * ({t} + {delta})))"


def density_altitude(rho: str) -> str:
    rho0 = ISA_P0 / (R_AIR * ISA_T0)
    return f"({f(ISA_T0 / ISA_LAPSE)} * (1E0 - pow(({rho}) / {f(rho0)}, {f(1.0 / (GRAVITY / (R_AIR * ISA_LAPSE) - 1.0))})))"


def stall_speed(weight_n: str, rho: str, area: str, cl: str, load: str = "1E0") -> str:
    return f"sqrt(2E0 * {load} * ({weight_n}) / (({rho}) * ({area}) * ({cl})))"


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2E0 * 6371E0 * asin(least(1E0, sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2E0), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2E0), 2)))))"
