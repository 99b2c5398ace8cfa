"""Row shapes of the log model and the fixed values that go with them."""

from pyspark.sql import types as T

# Wire shape of one log event. The first five value fields are mandatory.
LOG_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("threadName", T.StringType()),
        T.StructField("throwable", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("application", T.StringType()),
        T.StructField("hostname", T.StringType()),
    ]
)
REQUIRED_EVENT_FIELDS = ["category", "timestamp", "level", "message", "threadName"]

JSON_MAP = T.MapType(T.StringType(), T.StringType())

METRIC_EVENT = T.StructType(
    [
        T.StructField("ts", T.LongType()),  # microseconds since the epoch
        T.StructField("key", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
METRIC_REQUEST = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("payload", T.ArrayType(METRIC_EVENT)),
    ]
)
# A reading is named by its table as well, where it has one.
METRIC_KEY = ["ts", "key", "tag"]
DEFAULT_METRIC_TABLE = "metrics"

RULES = T.StructType(
    [
        T.StructField("application", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("retry_interval", T.IntegerType()),
        T.StructField("result_threshold", T.IntegerType()),
        T.StructField("alert_profiles", T.ArrayType(T.StringType())),
        T.StructField("alert_type", T.StringType()),
    ]
)
PROFILES = T.StructType(
    [
        T.StructField("application", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("targets", T.ArrayType(T.StringType())),
    ]
)
POLICIES = T.StructType(
    [
        T.StructField("application", T.StringType()),
        T.StructField("num_collections", T.IntegerType()),
        T.StructField("roll_period_days", T.IntegerType()),
    ]
)
COLLECTIONS = T.StructType(
    [
        T.StructField("application", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("created_epoch", T.LongType()),
    ]
)

# Severity order, alert types, retention defaults.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
ALERT_TYPES = ["solr", "sql"]
DEFAULT_ALERT_TYPE = "solr"
DEFAULT_NUM_COLLECTIONS = 7
DEFAULT_ROLL_PERIOD_DAYS = 1
MAX_DOCUMENTS = 10
