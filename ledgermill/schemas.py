"""Column layouts of the fact store and of the scanner's output."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(28, 6)

PERIOD = T.StructType([T.StructField("ptype", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.DateType()), T.StructField("end", T.DateType())])

FACTS = T.StructType([
    T.StructField("org_id", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("document_id", T.LongType()),
    T.StructField("period_type", T.StringType()),
    T.StructField("period_label", T.StringType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("period_end", T.DateType()),
    T.StructField("value", MONEY),
    T.StructField("unit", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("needs_review", T.BooleanType()),
    T.StructField("is_private", T.BooleanType()),
    T.StructField("superseded", T.BooleanType()),
    T.StructField("uploaded_by", T.LongType()),
])

GRID = "doc_id string, sheet string, row int, col int, raw string, cell_type string"
SCANNED = "doc_id string, sheet string, metric string, period_type string, period_label string, period_start date, period_end date, value decimal(28,6), unit string, currency string, variant string, section string, parent_hint string, is_total boolean, cell_ref string, layout string, warning string"
LEDGER = "doc_id string, sheet string, when date, value decimal(28,6), description string, category string, cell_ref string"
