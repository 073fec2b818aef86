"""Row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType([
    T.StructField("company", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("filing_type", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("accession_number", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
])

COMPANIES = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("name", T.StringType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", METADATA),
])

# One collection on disk: chunks, an optional embedding, and the partition column.
COLLECTION = T.StructType([
    *CHUNKS.fields,
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("ticker", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("companies", T.ArrayType(T.StringType())),
    T.StructField("conv_id", T.LongType()),
])

MESSAGES = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

STEPS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("step_no", T.IntegerType()),
    T.StructField("tool", T.StringType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("content", T.StringType()),
        T.StructField("metadata", METADATA),
    ]))),
])

FACTS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("data_point", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("value", T.DecimalType(18, 2)),
])
