"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from tallyhouse.functions.vocab import RAW_COLUMNS

RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

INTENT = T.StructType([
    T.StructField("intent", T.StringType()),
    T.StructField("locations", T.ArrayType(T.StringType())),
    T.StructField("exclude_locations", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("filters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("product_keywords", T.ArrayType(T.StringType())),
])

TRANSFERS = T.StructType([
    T.StructField("is_transfer", T.BooleanType()),
    T.StructField("transfers", T.ArrayType(T.StructType([
        T.StructField("from_city", T.StringType()),
        T.StructField("to_city", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("quantity", T.LongType()),
    ]))),
])

RUN_METRICS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("error", T.StringType()),
])
