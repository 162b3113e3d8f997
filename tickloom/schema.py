"""Canonical table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.functions.numeric import nan_to_null


_TYPES = {"date": T.DateType(), "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def _struct(spec: str) -> T.StructType:
    """``name type, ...`` without needing a running session at import."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in spec.split(","))])


PRICES = _struct("date date, symbol string, company_name string, price double, change double, pct_change double")
BARS = _struct("symbol string, date date, open double, high double, low double, close double, volume double")
SENTIMENT = _struct("date date, symbol string, sentiment_score double, sentiment_label string, "
                    "headlines_used int, top_headline string")
MACRO = _struct("series_alias string, date date, value double, series_id string")
SIGNALS = _struct("symbol string, date date, signal_type string, direction string, strength double, score double, "
                  "reason string")
ANOMALIES = _struct("date date, symbol string, anomaly_type string, severity string, z_score double, value double, "
                    "reason string")
FORECASTS = _struct("date date, metric string, forecast double, lower_bound double, upper_bound double, method string")
TECHNICAL = _struct("date date, avg_pct double, volatility double, breadth_pct double, sma_avg_7d double, "
                    "sma_avg_30d double, ema_avg_7d double, ema_avg_30d double, mom_avg_7d double, "
                    "vol_zscore_7d double, breadth_sma_7d double, breadth_ema_7d double, breadth_mom_7d double, "
                    "signal_strength double, trend_7_30 string")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Cast to ``schema``: unparsable numbers become NULL, NaN becomes NULL, absent columns are added as NULL."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name).try_cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        cols.append(c.alias(f.name))
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in set(schema.fieldNames())]
    return df.select(*cols)
