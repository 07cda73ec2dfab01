"""Vocabulary of the funnel domain.

FIXED VALUES — these must equal the reference configuration so that parsing,
labelling and selection give identical results. They are stated here as plain
data, in their natural order, and turned into Spark expressions or tiny lookup
DataFrames by :mod:`funnelcast.functions.columns`.
"""

from __future__ import annotations

# --- fixed values: funnel ---------------------------------------------------
FUNNEL_STAGES = ("APP", "ACH", "ACC", "APD", "RE", "FI", "CO")

STAGE_LABELS = {
    "APP": "Applied",
    "ACH": "Achieved / Matched",
    "ACC": "Accepted",
    "APD": "Approved",
    "RE": "Realized",
    "FI": "Finished",
    "CO": "Completed",
}

# API status key -> canonical stage code
STATUS_TO_STAGE = {
    "applied": "APP",
    "matched": "ACH",
    "achieved": "ACH",
    "an_accepted": "ACC",
    "accepted": "ACC",
    "approved": "APD",
    "realized": "RE",
    "finished": "FI",
    "completed": "CO",
}

# statuses that are not stages but travel with the panel as diagnostics
NON_STAGE_STATUSES = {
    "approval_broken": "APPROVAL_BROKEN",
    "realization_broken": "REALIZATION_BROKEN",
    "remote_realized": "REMOTE_RE",
}

DIAGNOSTIC_COLUMNS = ("APPROVAL_BROKEN", "REALIZATION_BROKEN", "REMOTE_RE")

# --- fixed values: nested-bucket dimension names ----------------------------
ENTITY_DIMENSIONS = ("offices", "office", "entities", "entity", "committees", "committee", "lc", "lcs")
DIRECTION_DIMENSIONS = ("directions", "direction", "types", "type", "flow", "opportunity_type")
PRODUCT_DIMENSIONS = ("programmes", "programme", "products", "product", "programs", "program")
STATUS_DIMENSIONS = ("statuses", "status", "stages", "stage", "application_status")

# --- fixed values: direction spellings --------------------------------------
DIRECTION_ALIASES = {
    "outgoing": "outgoing",
    "og": "outgoing",
    "o": "outgoing",
    "out": "outgoing",
    "sending": "outgoing",
    "export": "outgoing",
    "incoming": "incoming",
    "ic": "incoming",
    "i": "incoming",
    "in": "incoming",
    "hosting": "incoming",
    "import": "incoming",
}

DIRECTION_PREFIX = {"outgoing": "o", "incoming": "i"}

# --- fixed values: programme ids --------------------------------------------
PROGRAMME_NAMES = {
    1: "GV-legacy",
    2: "GT-legacy",
    3: "TMP",
    4: "TLP",
    5: "GE",
    6: "LV",
    7: "GV",
    8: "GTa",
    9: "GTe",
}

# --- fixed values: flat ("v3") payload shape --------------------------------
FLAT_ENTITY_MARKER = "applied_total"
FLAT_CELL_PATTERN = r"^([io])_([a-z_]+)_([0-9]+)$"
FLAT_OPEN_PATTERN = r"^open_([io])_programme_([0-9]+)$"

REDACTION_MARK = "***REDACTED***"

# --- fixed values: calendar features -----------------------------------------
SEASON_BY_MONTH = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Spring", 4: "Spring",
    5: "Summer", 6: "Summer",
    7: "Monsoon", 8: "Monsoon", 9: "Monsoon",
    10: "Autumn", 11: "Autumn",
}
SEASON_CODES = {"Winter": 0, "Spring": 1, "Summer": 2, "Monsoon": 3, "Autumn": 4}
BREAK_MONTHS = (5, 6, 12, 1)
EXAM_MONTHS = (3, 4, 11)
SEMESTER_START_MONTHS = (1, 7, 8)
LAG_MONTHS = (1, 2, 3, 6, 12)
ROLLING_WINDOWS = (3, 6, 12)

OPERATIONAL_FEATURES = (
    "op_app_to_re_pct",
    "op_app_to_ach_pct",
    "op_realizations",
    "op_outgoing_share",
    "op_gv_share",
    "op_entity_hhi",
    "op_active_entities",
)

# --- fixed values: model selection ------------------------------------------
EXPLAINABILITY_RANK = {
    "seasonal_naive_drift": 1,
    "seasonal_naive": 1,
    "moving_average_3": 1,
    "moving_average_6": 1,
    "naive_last": 1,
    "linear_regression": 2,
    "ridge": 2,
    "holt_winters": 3,
    "sarima": 3,
    "prophet": 3,
    "random_forest": 4,
    "gradient_boosting": 4,
    "xgboost": 4,
}

MODEL_FAMILY = {
    "naive_last": "baseline",
    "moving_average_3": "baseline",
    "moving_average_6": "baseline",
    "seasonal_naive": "baseline",
    "seasonal_naive_drift": "baseline",
    "linear_regression": "linear",
    "ridge": "linear",
    "holt_winters": "timeseries",
    "random_forest": "ensemble",
    "gradient_boosting": "ensemble",
    "xgboost": "ensemble",
}

SELECTION_WEIGHTS = {"accuracy": 0.5, "stability": 0.3, "explainability": 0.2}
TOLERANCE_PCT = 5.0
DRIFT_DAMPING = 0.85
ACTIVITY_LABELS = {"low": "Low", "medium": "Medium", "high": "High"}

MONTH_ABBR = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
