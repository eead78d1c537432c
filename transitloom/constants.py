"""Fixed values that define results. They are part of the data contract, not of the method."""

# Vehicle and density defaults.
BUS_CAPACITY = 80
DENSITY_FALLBACK = 0.5
LOAD_CAP = 1.0

# Time bands (name, start second, end second, weight); the last one wraps midnight.
TIME_BANDS = [
    ("early", 18000, 21600, 0.70),
    ("morning_peak", 21600, 32400, 1.40),
    ("midday_offpeak", 32400, 57600, 0.85),
    ("evening_peak", 57600, 72000, 1.35),
    ("night", 72000, 79200, 0.55),
    ("late_night", 79200, 18000, 0.20),
]

# Audit sample times (label, second of day).
SAMPLE_TIMES = [
    ("05_00", 18000),
    ("06_00", 21600),
    ("10_00", 36000),
    ("12_00", 43200),
    ("17_00", 61200),
    ("22_00", 79200),
]

# Corridor scope, date sample, overlap grouping.
DEFAULT_SCOPE = [str(n) for n in range(1, 14)]
RIDERSHIP_SAMPLE = 30
OVERLAP_THRESHOLD = 0.80

# Route search and ranking.
CANDIDATES_K = 5
TRANSFER_PENALTY_SECS = 900
MAX_TRANSFERS = 12
MAX_BLOCK_RERUNS = 8
STOP_ALIAS_RADIUS_M = 200.0
NUMBERED_DUPLICATE_RADIUS_M = 120.0
RANK_WEIGHTS = {"time": 0.30, "distance": 0.20, "transfer": 0.30, "density": 0.20}
RERANK_EXTRA_MINUTES = 15
RERANK_EXTRA_METERS = 3000.0

# Vehicle choice.
MAX_ETA_MINUTES = 60
MAX_EXTRA_WAIT_MINUTES = 50
DENSITY_WEIGHT = 0.95
WAIT_WEIGHT = 0.05
SAFE_NEXT_DENSITY = 0.0

# Resampling.
POISSON_SCALE = 25
SEGMENT_LAMBDA = 1.0
TOLERANCE = 0.0

# Scenario typing.
DELTA_MILD = 0.10
DELTA_SEVERE = 0.30
BUS_CROWDED = 0.80
BUS_EMPTY = 0.35
BUS_SIMILAR = 0.15

# Live feeds.
LIVE_TTL_SECS = 120
RELAY_STALE_SECS = 30
BUS_MAX_AGE_SECS = 120

# Telemetry.
BOX_MIN_AREA = 0.0005
BOX_MAX_AREA = 0.70
BOX_MIN_ASPECT = 0.20
CHUNK_BYTES = 512
MAX_IMAGE_BYTES = 2 * 1024 * 1024
EPOCH_MS_MIN = 1577836800000
EPOCH_MS_MAX = 4102444800000

# Weight sets of the sensitivity plan.
WEIGHT_SETS = [
    ("w020", 0.35, 0.25, 0.20, 0.20),
    ("w040", 0.30, 0.20, 0.10, 0.40),
    ("w060", 0.25, 0.10, 0.05, 0.60),
    ("w080", 0.15, 0.05, 0.00, 0.80),
]

# Success configurations (name, extra wait minutes, ETA minutes, density weight).
SUCCESS_CONFIGS = [
    ("base", 50, 60, 0.95),
    ("wait30", 30, 60, 0.95),
    ("w095", 50, 60, 0.95),
    ("wait30_w095", 30, 60, 0.95),
    ("eta60", 50, 60, 0.95),
    ("wait40", 40, 60, 0.95),
    ("wait30_eta60_w095", 30, 60, 0.95),
]

# Class names that mean "person", in order of preference.
PERSON_NAMES = ["person", "people", "passenger", "penumpang", "orang", "human"]
