"""Names and default parameters.

Every operator takes these as arguments; the values here are only the defaults.
"""

SERIES = "series_id"
DATE = "date"

# Forecast horizons, lags, rolling windows and change steps, in days.
HORIZONS = (1, 7, 15, 30, 60)
LAG_DAYS = (1, 7, 14, 21, 30, 60, 90)
ROLLING_DAYS = (7, 14, 30, 60, 90)
CHANGE_DAYS = (1, 7, 30)

# Walk-forward validation and gap filling.
MIN_TRAIN_DAYS = 730
N_FOLDS = 5
MAX_GAP_DAYS = 7
BASELINE_DAYS = 7

# Canonical column names of the integrated daily table.
PRICE_COLUMNS = ("price_a", "price_b", "price_c")
TARGET_PRICE = "price_a"
INDEX_COLUMN = "price_index"
LAGGED_COLUMNS = (
    "price_index",
    "rain_mm",
    "trade_value",
    "trade_qty",
    "head_count",
    "weight",
)
FEATURE_COLUMNS = (
    "price_a",
    "price_b",
    "price_c",
    "weight",
    "trade_value",
    "rain_mm",
    "fx",
)
PUBLICATION_LAG_MONTHS = 1

# Physical limits of the non-price variables.
DOMAIN_BOUNDS = {
    "head_count": (1e3, 1e7),
    "weight": (1e2, 1e9),
    "trade_value": (0.0, 1e11),
    "trade_qty": (0.0, 1e10),
    "rain_mm": (0.0, 3000.0),
    "price_index": (1.0, 500.0),
}

# Study calendar, holdout cutoff and deflation base month.
CALENDAR_START = "2010-01-01"
CALENDAR_END = "2025-12-31"
HOLDOUT_CUTOFF = "2025-12-31"
DEFLATION_BASE = "2025-12-01"

# Edges of the price bands (left-closed, right-open).
PRICE_BANDS = (0.0, 240.0, 255.0, 270.0, 285.0, 300.0, 315.0, 330.0, 400.0)
CALIBRATION_BINS = 12
RESIDUAL_BINS = 30
VALUE_BINS = 40
DENSITY_CELLS = 40

# Units per head, and the unit factors of rain and carcass weight.
UNITS_PER_HEAD = 18
METRES_TO_MM = 1000.0
KG_TO_THOUSAND_TONNES = 1e6

# Allowed rise of MAPE after recalibration, in percentage points.
SHORT_HORIZONS = (1, 7)
SHORT_TOLERANCE = 2.0
LONG_TOLERANCE = 5.0

# Month labels.
MONTH_LABELS = (
    "Jan", "Fev", "Mar", "Abr", "Mai", "Jun",
    "Jul", "Ago", "Set", "Out", "Nov", "Dez",
)

# Words in variable labels and the column each stands for.
LABEL_KEYWORDS = {
    "head_count": ("cabeças", "abatidos"),
    "weight": ("peso", "carcaça"),
}
DEFAULT_ORDINAL = "No 1º mês"

# Fixed value: guard against division by zero in the monthly percent error.
PERCENT_EPSILON = 1e-8
SIGNIFICANCE = 0.05
