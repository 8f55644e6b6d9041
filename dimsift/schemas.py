"""Table layouts shared by sources, operators and sinks."""

from pyspark.sql import types as T

STR, INT, DBL = T.StringType(), T.IntegerType(), T.DoubleType()

TEXT = T.StructType([T.StructField("doc_id", STR), T.StructField("text", STR)])
QUERY_TEXT = T.StructType([T.StructField("query_id", STR), T.StructField("text", STR)])
QRELS = T.StructType([
    T.StructField("query_id", STR),
    T.StructField("doc_id", STR),
    T.StructField("relevance", INT),
])
RUN = T.StructType([
    T.StructField("query_id", STR),
    T.StructField("Q0", STR),
    T.StructField("doc_id", STR),
    T.StructField("rank", INT),
    T.StructField("score", DBL),
    T.StructField("run", STR),
])
SWEEP_RUN = T.StructType(RUN.fields + [T.StructField("alpha", STR)])
RESULTS = T.StructType([
    T.StructField("query_id", STR),
    T.StructField("measure", STR),
    T.StructField("value", DBL),
])
SWEEP_RESULTS = T.StructType(
    RESULTS.fields + [T.StructField("alpha", STR), T.StructField("retained_frac", DBL)]
)
REPORT_INPUT = T.StructType(
    [T.StructField(name, STR) for name in ("collection", "model", "filter", "selector", "alpha")]
    + RESULTS.fields
    + [T.StructField("retained_frac", DBL)]
)
CE_SCORES = T.StructType([
    T.StructField("query_id", STR),
    T.StructField("na", STR),
    T.StructField("doc_id", STR),
    T.StructField("ce_score", DBL),
])
VECTOR = T.ArrayType(T.FloatType())

# Column lists used to select by name, whatever order a file had.
RUN_COLUMNS = RUN.names
SWEEP_RUN_COLUMNS = SWEEP_RUN.names
RESULT_COLUMNS = RESULTS.names
