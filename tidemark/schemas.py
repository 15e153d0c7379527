"""Declared schemas of the inputs; nothing is inferred unless a caller asks for it."""

from __future__ import annotations

from pyspark.sql import types as T

DATASET = T.StructType(
    [
        T.StructField("feature_1", T.DoubleType()),
        T.StructField("feature_2", T.DoubleType()),
        T.StructField("feature_3", T.DoubleType()),
        T.StructField("target", T.IntegerType()),
    ]
)

FEATURES = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("feature_1", T.DoubleType()),
        T.StructField("feature_2", T.DoubleType()),
        T.StructField("feature_3", T.DoubleType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("VulnerabilityID", "PkgName", "InstalledVersion", "FixedVersion", "Severity", "Title")
    ]
)

REPORT = T.StructType(
    [
        T.StructField("ArtifactName", T.StringType()),
        T.StructField("CreatedAt", T.StringType()),
        T.StructField(
            "Results",
            T.ArrayType(T.StructType([T.StructField("Vulnerabilities", T.ArrayType(FINDING))])),
        ),
    ]
)

DOCKER_LINE = T.StructType(
    [
        T.StructField("log", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("time", T.StringType()),
    ]
)

EVALUATION = T.StructType(
    [
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("passed_gates", T.BooleanType()),
        T.StructField("min_accuracy", T.DoubleType()),
        T.StructField("min_f1", T.DoubleType()),
    ]
)
