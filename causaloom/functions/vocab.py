"""Fixed values of the corpus layer: patterns, code maps and word lists."""

# Terms of a causal link, matched as whole words without case.
CAUSAL_TERMS = [
    "because", "due to", "caused by", "causing", "resulted in", "resulting in",
    "led to", "leading to", "as a result", "attributed to", "contributed to",
    "contributing (factor|cause)", "probable cause", "root cause", "factor(?:s)? in",
    "failed to", "failure to", "did not", "was unable to", "attempted to",
    "after (?:the|a|an)?", "when the", "while (?:the|taxi|climb|cruis|landing|approach|descend)",
    "during (?:the|takeoff|taxi|climb|cruis|landing|approach|descent|rollout|rotation)",
    "prior to", "subsequently", "thereafter", "consequently", "therefore",
    "in order to", "so that", "such that", "triggered", "induced",
    "loss of control", "lost control", "encountered", "experienced",
]
CAUSAL_PATTERN = r"(?i)\b(?:" + "|".join(CAUSAL_TERMS) + r")\b"

# Registration marks, in the order in which they are tried.
TAIL_PATTERNS = [
    r"\bN\d{1,5}[A-Z]{0,2}\b",
    r"\b(?:C-[FG][A-Z]{3}|CF-[A-Z]{3,4})\b",
    r"\b[FDGI]-[A-Z]{4}\b",
    r"\b(?:EC|EI|VH|VT)-[A-Z]{3}\b",
    r"\bJA\d{3,4}[A-Z]?\b",
]
ACCIDENT_ID = r"\b([A-Z]{3}\d{2}[A-Z]{2}\d{3})\b"

# Occurrence code -> category.
OCCURRENCE_CATEGORY = {
    100: "LOC-I", 110: "LOC-I", 120: "OTHM", 130: "SCF-PP", 131: "SCF-PP",
    140: "SCF-PP", 160: "FUEL", 180: "USOS", 200: "ICE", 210: "F-NI",
    220: "WSTRW", 230: "CFIT", 240: "WX", 250: "LOC-I", 260: "LOC-G",
    270: "CTOL", 280: "GCOL", 290: "ARC", 300: "MAC", 310: "MAC",
    320: "GCOL", 330: "ARC", 340: "RE", 350: "ARC", 370: "ARC",
    380: "LOC-I", 390: "BIRD", 400: "ADRM", 410: "EVAC", 420: "ATM",
    430: "RI", 440: "FUEL", 540: "OTHM", 560: "EXTL", 580: "MED", 600: "SEC",
}

# Groups of findings by code, and by the first group with a keyword.
FINDING_CODES = {"01": "aircraft", "02": "personnel", "03": "environment", "04": "organizational", "05": "not determined"}
FINDING_KEYWORDS = [
    ("organizational", ["MAINTENANCE", "INSPECTION", "COMPANY", "MANAGEMENT", "FAA", "ATC", "SUPERVISION", "MANUFACTURER", "PROCEDURE INADEQUATE", "TRAINING"]),
    ("environment", ["WEATHER", "WIND", "TERRAIN", "VISIBILITY", "LIGHT CONDITION", "ICING", "TURBULENCE", "OBJECT", "RUNWAY", "ANIMAL", "BIRD", "DENSITY ALTITUDE", "CLOUDS", "FOG", "RAIN", "SNOW", "CROSSWIND", "TAILWIND", "GUSTS", "CARBURETOR ICING CONDITIONS"]),
    ("aircraft", ["ENGINE", "FUEL SYSTEM", "LANDING GEAR", "FLIGHT CONTROL", "PROPELLER", "AIRFRAME", "SYSTEM", "COMPONENT", "CARBURETOR", "MAGNETO", "CYLINDER", "WING", "BRAKE", "TIRE", "ELECTRICAL", "HYDRAULIC", "FUEL TANK", "FUEL LINE", "EXHAUST", "OIL"]),
    ("personnel", ["PILOT", "CREW", "INSTRUCTOR", "PASSENGER", "JUDGMENT", "DECISION", "PROCEDURE", "INADEQUATE", "IMPROPER", "FAILURE TO", "NOT MAINTAINED", "MISJUDGED", "DELAYED", "EXCEEDED", "SELECTED", "PLANNING", "PREFLIGHT", "FUEL EXHAUSTION", "FUEL STARVATION", "ALTITUDE", "AIRSPEED", "STALL", "COMPENSATION", "ATTENTION", "REMEDIAL ACTION"]),
]
HEADER_FRAGMENTS = r"(?i)National Transportation Safety Board|E\s*PLURIBUS\s*U\s*NUM|SAFETYBO\s*AR\s*D"
PAGE_ARTIFACTS = r"(?i)NTSB/[A-Z]+-\d{2}/\d{2}|\bPage\s+\d+(\s+of\s+\d+)?\b|\bWashington,?\s+D\.?C\.?\s+20594\b"

#: How a factor's occurrence is modelled, and by what; factors that are not listed have the corpus rate ("data").
TIERS = {
    "STALL": ("physics", "6-DOF"),
    "AIRFRAME_STRUCTURAL_FAILURE": ("physics", "V--n"),
    "TURBULENCE_ENCOUNTER": ("physics", "gust"),
    "WIND_SHEAR_OR_GUST": ("physics", "gust"),
    "CARBURETOR_OR_INDUCTION_ICING": ("physics", "icing"),
    "FUEL_EXHAUSTION_OR_STARVATION": ("physics", "endurance"),
    "ENGINE_FAILURE": ("surrogate", "hazard"),
    "CONTROL_SURFACE_ANOMALY": ("surrogate", "reliability"),
    "FUEL_SYSTEM_ANOMALY": ("surrogate", "reliability"),
    "FUEL_CONTAMINATION": ("surrogate", "reliability"),
}
