"""Business constants shared by every job."""

from __future__ import annotations

from datetime import datetime

# --- Fixed values: physical limits --------------------------------------------
ALTITUDE_RANGE = (0, 60000)  # feet
SPEED_RANGE = (0, 1200)  # km/h
LATITUDE_RANGE = (-90, 90)
LONGITUDE_RANGE = (-180, 180)
MIN_DELAY = 0

# --- Fixed values: flight status ----------------------------------------------
VALID_STATUSES = ["active", "scheduled", "landed", "cancelled", "diverted", "unknown"]
STATUS_SYNONYMS = {
    "en-route": "active",
    "en_route": "active",
    "in_air": "active",
    "airborne": "active",
    "in-flight": "active",
    "arrived": "landed",
    "arrival": "landed",
    "on_ground": "landed",
    "canceled": "cancelled",
    "cncl": "cancelled",
    "divrt": "diverted",
    "divert": "diverted",
}

# --- Fixed values: airports treated as domestic --------------------------------
DOMESTIC_AIRPORTS_10 = ["DEL", "BOM", "BLR", "MAA", "CCU", "HYD", "AMD", "COK", "GOI", "JAI"]
DOMESTIC_AIRPORTS_18 = [
    "DEL", "BOM", "BLR", "MAA", "CCU", "HYD",
    "AMD", "COK", "GOI", "JAI", "PNQ", "NAG",
    "IXC", "ATQ", "SXR", "IXB", "GAU", "IMF",
]

# --- Fixed values: airline code -> canonical name -------------------------------
AIRLINE_NAMES = {
    "AI": "Air India",
    "6E": "IndiGo",
    "SG": "SpiceJet",
    "UK": "Vistara",
    "G8": "GoFirst",
    "EK": "Emirates",
    "SQ": "Singapore Airlines",
    "BA": "British Airways",
    "QR": "Qatar Airways",
    "G9": "Air Arabia",
    "IX": "Air India Express",
    "I5": "AIX Connect",
}

# --- Fixed values: placeholder spellings that mean "no value" -------------------
AIRPORT_BLANKS = ["NAN", "NONE", "???", "", "N/A"]
AIRLINE_CODE_BLANKS = ["NAN", "NONE", "??", ""]
CITY_BLANKS = ["nan", "none", ""]  # compared in lower case
UNKNOWN_AIRPORTS = ["???", "UNK", ""]
UNKNOWN_AIRCRAFT = ["UNKN", "UNKNOWN", ""]

# --- Fixed values: thresholds ---------------------------------------------------
ERROR_THRESHOLD = 0.05
WARNING_THRESHOLD = 0.10
FUZZY_WINDOW_SECONDS = 5
QUALITY_GATE_MAX_FAIL_RATE = 0.05
QUALITY_GATE_MIN_RECORDS = 1
FRESHNESS_SLO_MINUTES = {"RAW": 15, "CLEAN": 30, "ANALYTICS": 60}
QUALITY_FLAG_THRESHOLD_PCT = 5.0
CONSUMER_LAG_THRESHOLD = 1000
DLQ_ALERT_THRESHOLD = 50
MIN_RECORDS_PER_HOUR = 10
MAX_DATA_AGE_MINUTES = 30
MIN_COMPLETENESS = 0.90
MAX_LAYER_DRIFT = 0.10
MAX_AVG_DELAY_MINUTES = 300
MAX_ERROR_MESSAGE_CHARS = 2000
TRANSFORMER_VERSION = "1.0.0"

# --- Fixed values: incremental processes and their first watermark --------------
WATERMARK_PROCESSES = ["raw_to_clean", "clean_to_analytics", "route_aggregation", "hourly_aggregation"]
WATERMARK_EPOCH = datetime(2024, 1, 1)

ROUTE_ARROW = "→"

# End of the test data. Every "now" in the library is an explicit parameter; this
# is only the default used by the registered queries.
AS_OF = datetime(2024, 1, 30, 23, 59, 59)
