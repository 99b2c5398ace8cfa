"""loglake: log and metric analytics as plain Spark DataFrame operators."""
