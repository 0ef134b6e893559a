"""Fixed record layouts. Nothing is inferred from data."""

from pyspark.sql import types as T

SEGMENT = "array<struct<type:string,name:string,code:string,start_line:int,end_line:int>>"
CHUNK = "array<struct<text:string,type:string,name:string,start:int,end:int>>"

SPLIT_COLUMNS = ("input_ids", "attention_mask")

COMPLETION_REQUEST = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("cursor_position", T.IntegerType()),
        T.StructField("max_suggestions", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("code_context", T.StringType()),
    ]
)

RUN_RESULT = T.StructType(
    [
        T.StructField("model_type", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("train_metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("eval_metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("error", T.StringType()),
        T.StructField("success", T.BooleanType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
