"""Types of a parsed revision and the values of absent fields."""

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("is_redirect", T.BooleanType()),
    ]
)
CONTRIBUTOR = T.StructType([T.StructField("username", T.StringType()), T.StructField("id", T.LongType())])
REVISION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("page", PAGE),
        T.StructField("contributor", CONTRIBUTOR),
        T.StructField("comment", T.StringType()),
        T.StructField("is_minor", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
)

# What a field holds when the dump lacks the element.
NO_REVISION_ID = 0
NO_TIMESTAMP = 0
NO_PAGE_ID = -1
NO_CONTRIBUTOR_ID = -1
NO_USERNAME = ""
