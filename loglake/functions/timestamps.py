"""Time conversions. The log model is UTC: run them in a session whose time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# C strftime directives and the Spark pattern letters that read the same text.
STRFTIME_TO_SPARK = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%z": "xx",
}
DEFAULT_STRFTIME = "%Y-%m-%dT%H:%M:%S.%f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_millis_to_iso(c: Column | str) -> Column:
    """Milliseconds since the epoch as ``yyyy-MM-ddTHH:mm:ssZ``, cut to whole seconds."""
    return F.date_format(F.timestamp_millis(_col(c)), ISO_SECONDS)


def timestamp_to_iso(c: Column | str) -> Column:
    """A timestamp as ``yyyy-MM-ddTHH:mm:ssZ``."""
    return F.date_format(_col(c), ISO_SECONDS)


def parse_iso(c: Column | str) -> Column:
    """ISO-8601 text as a timestamp, NULL when it is not one."""
    return F.try_to_timestamp(_col(c))


def spark_pattern(strftime: str) -> str:
    """The Spark datetime pattern for a strftime format; literal letters are quoted."""
    out, i = [], 0
    while i < len(strftime):
        if strftime[i] == "%":
            directive = strftime[i : i + 2]
            if directive not in STRFTIME_TO_SPARK:
                raise ValueError(f"unsupported strftime directive {directive!r}")
            out.append(STRFTIME_TO_SPARK[directive])
            i += 2
        else:
            out.append(f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i])
            i += 1
    return "".join(out)


def unix_time_micros(c: Column | str, fmt: str | None = None) -> Column:
    """Microseconds since the epoch of a timestamp column, or of text in strftime format ``fmt``.

    Text without a zone is UTC; text with one (``%z``) is converted. Text that does not match raises.
    """
    value = _col(c)
    if fmt is not None:
        value = F.to_timestamp(value, spark_pattern(fmt))
    return F.unix_micros(value.cast("timestamp"))
