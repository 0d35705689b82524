"""Column names, types and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Every table is keyed by campaign first; one campaign is one uploaded file.
KEYS = ("campaign_id",)

MEASURES = ("Spend", "Impressions", "Clicks", "Conversions", "Revenue")

# Column names an input file must have (any case, any padding).
REQUIRED_COLUMNS = ("Date", "Channel", "Spend", "Impressions", "Clicks", "Conversions", "Revenue")

# Date formats an input file may have, the preferred one first where several read as many rows.
DATE_FORMATS = ("yyyy-M-d", "yyyy-M-d H:m:s", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d")

# Holidays as month * 100 + day, the same dates every year.
HOLIDAYS = (704, 1125, 1129, 1225)

# Texts a CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Window length and lag in rows, preview size, history window in dates with data.
ROLLING_ROWS = 7
LAG_ROWS = 7
PREVIEW_ROWS = 15
HISTORY_DATES = 30

# Forecast defaults.
HORIZON_DAYS = 30
CONFIDENCE = 0.95
MIN_FOREST_ROWS = 5
FLAT_LOWER, FLAT_UPPER = 0.9, 1.1
FOREST_TREES, FOREST_DEPTH, FOREST_SEED = 50, 8, 42

# Z by confidence level; every other level counts as 99 %.
Z_BY_LEVEL = {0.95: 1.96, 0.90: 1.645}
Z_OTHERWISE = 2.576

# Efficiency tiers by ROAS, highest first, as (lower bound, label).
TIERS = ((3.0, "Highly Efficient"), (2.0, "Efficient"), (1.5, "Moderate"), (None, "Underperforming"))
BASIC_TIERS = ((2.5, "Highly Efficient"), (1.5, "Moderately Efficient"), (None, "Underperforming"))

# Thresholds of the diagnostics.
HEALTHY_ROAS = 1.5
STEADY_GROWTH_PCT = 10.0
STABLE_BAND = 0.1
SATURATION_SPEND = 5000.0
SATURATION_ROAS = 2.5
CONCENTRATION_SHARE = 0.4

# Message keywords by intent, in order of precedence.
INTENTS = (
    ("allocation", ("optimize", "budget", "allocation")),
    ("forecast", ("forecast", "future", "next month")),
    ("return", ("roas", "return")),
)
DEFAULT_INTENT = "default"
DEFAULT_CHANNEL = "Google Ads"
DEFAULT_HISTORICAL_ROAS = 2.1

# Budget slider range.
GRID_MIN_LIMIT, GRID_SPEND_FACTOR, GRID_DEFAULT_SPEND, GRID_STEP = 5000, 3, 100, 10

# Column order of the forecast table after the keys.
FORECAST_COLUMNS = (
    "Date", "Channel", "Spend", "Impressions", "Clicks", "Conversions", "Revenue", "ROAS",
    "Revenue_Lower", "Revenue_Upper", "Conversions_Lower", "Conversions_Upper", "IsForecast",
)

FACT_SCHEMA = T.StructType(
    [
        T.StructField("campaign_id", T.StringType()),
        T.StructField("Date", T.DateType()),
        T.StructField("Channel", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in MEASURES],
    ]
)

FEATURED_SCHEMA = T.StructType(
    [
        *FACT_SCHEMA.fields,
        *[T.StructField(n, T.DoubleType()) for n in ("CTR", "CPC", "CPA", "ROAS", "ConvRate")],
        *[T.StructField(n, T.IntegerType()) for n in ("Month", "Quarter", "HolidayFlag")],
        *[
            T.StructField(n, T.DoubleType())
            for n in ("Spend_MA7", "ROAS_MA7", "Spend_Lag7", "Revenue_Lag7")
        ],
    ]
)

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("campaign_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("storage_path", T.StringType()),
        T.StructField("total_spend", T.DoubleType()),
        T.StructField("total_revenue", T.DoubleType()),
        T.StructField("total_conversions", T.DoubleType()),
        T.StructField("overall_roas", T.DoubleType()),
        T.StructField("channels_count", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
