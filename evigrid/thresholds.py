"""Default thresholds. Every operator takes them as parameters; these are the fixed values to match."""

# Symbol self-check
MIN_PINS = 2
ONE_SIDE_MIN_PINS = 8
MAX_NAME_LENGTH = 24
EQUAL_NAME_RATIO = 0.6
EQUAL_NAME_MIN_PINS = 4
DETAIL_ITEMS = 20
ERROR_WEIGHT = 25
WARN_WEIGHT = 5

# Page selection
PAGE_MARGIN = 2
PAGE_CAP = 190
SECTION_CAP = 24
EDGE_RATIO = 0.15
HEAD_SEARCH_RATIO = 0.6
TAIL_SEARCH_RATIO = 0.5

# Symbol layout grid (10 mil units)
PITCH = 20
PIN_LENGTH = 10
MIN_BODY_WIDTH = 100

# Evidence gates
OCR_CONFIDENCE = 0.80
SEMANTIC_CONFIDENCE = 0.85
TABLE_CONFIDENCE = 0.80
RANGE_CONFIDENCE = 0.75
ROUTE_PROBABILITY = 0.70
ROUTE_CONFIDENCE = 0.60
ROUTE_MARGIN = 0.20
IOU = 0.45
TOKEN_CONFIDENCE = 0.55

# Footprints and run logs
CLEARANCE = 0.15
ASSERTION_TOLERANCE = 1e-3

# Chunking, retrieval, limits
CHUNK_SIZE = 512
CHUNK_OVERLAP = 100
HIT_CONFIDENCE = 0.75
LOG_ITEMS = 600
WINDOW_ROUNDS = 10
