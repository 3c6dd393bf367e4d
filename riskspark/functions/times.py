"""Timestamp parsing and event-time expressions, all in UTC."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.risk import finite, finite_or_null

EVENT_TIMES = ["event_time_utc", "transaction_time_utc"]
STORE_TIMES = ["processing_timestamp", "scored_at_utc", "stored_at_utc"]

# A full date, then optionally a time of hours, minutes and seconds, then optionally an offset.
_COMMON = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2}|Z)?$"
_ANY = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(?:(Z)|([+-]\d{2}):?(\d{2})?)?)?$"
)


def _utc_cast(text: Column) -> Column:
    """Cast a common date-time; one without an offset is UTC whatever the session zone is."""
    # An offset has its sign or Z at a fixed place from the end.
    has_offset = F.substring(text, -1, 1).isin("Z") | F.substring(text, -6, 1).isin("+", "-")
    return F.when(has_offset, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def _spelled_out(text: Column) -> Column:
    """Rewrite shortened ISO forms (no dashes, hours only, ...) to the common form.

    The parts are first laid out with empty places, which the next steps fill.
    """
    parts = F.regexp_replace(text, _ANY, "$1-$3-$4T$5:$6:$7|$8|$9$10:$11")
    parts = F.replace(parts, F.lit("T:"), F.lit("T00:"))
    parts = F.regexp_replace(parts, r":(?=[:|])", ":00")
    parts = F.replace(parts, F.lit("||"), F.lit("|0|"))
    parts = F.regexp_replace(parts, r"\|(\d{1,6})\d*\|", ".$1")
    parts = F.regexp_replace(parts, r"(\.\d+):$", "$1Z")
    return F.regexp_replace(parts, r":$", "")


def parse_timestamp(value: Column) -> Column:
    """ISO text to a timestamp, null when it is not a full ISO date or date-time."""
    text = F.trim(value)
    return (
        F.when(text.rlike(_COMMON), _utc_cast(text))
        .when(text.rlike(_ANY), _spelled_out(text).try_cast("timestamp"))
        .otherwise(F.lit(None).cast("timestamp"))
    )


def time_column(df: DataFrame, name: str) -> Column:
    """A time field of a sparse frame as a timestamp; text is parsed, typed times pass through."""
    if name not in df.columns:
        return F.lit(None).cast("timestamp")
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampType):
        return F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())
    return parse_timestamp(F.col(name).cast("string"))


def with_parsed_times(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Time fields as timestamps; several text fields share one parsing expression.

    Parsing written out once per field makes a generated method that is too large for the JVM to
    compile (8,000 bytes), which costs far more than the parsing itself.
    """
    names = [name for name in names if name in df.columns]
    texts = [name for name in names if isinstance(df.schema[name].dataType, T.StringType)]
    if texts:
        df = df.withColumn("_times", F.transform(F.array(*texts), parse_timestamp))
    parsed = {name: F.col("_times")[i] for i, name in enumerate(texts)}
    parsed |= {name: time_column(df, name) for name in names if name not in parsed}
    return df.withColumns(parsed).drop("_times") if parsed else df


def utc_hour(moment: Column) -> Column:
    """Hour 0-23 in UTC, independent of the session time zone."""
    return F.floor(F.pmod(F.unix_seconds(moment), F.lit(86400)) / 3600).cast("int")


def hour_of_seconds(seconds: Column) -> Column:
    """Hour 0-23 of a second count; negative counts wrap to the previous day."""
    return F.floor(F.pmod(seconds, F.lit(86400.0)) / 3600.0).cast("int")


def is_night(hour: Column) -> Column:
    return (hour >= 22) | (hour < 6)


def document_hour(df: DataFrame) -> Column:
    """Hour of an alert: event times, then a valid explicit hour, then ``Time``, then store times.

    Null means that the frame carries none of the fields for that row; the caller picks a default.
    """
    candidates = [utc_hour(time_column(df, name)) for name in EVENT_TIMES]
    if "hour_of_day" in df.columns:
        hour = finite_or_null(F.col("hour_of_day"))
        whole = F.when(hour < 0, F.ceil(hour)).otherwise(F.floor(hour))
        candidates.append(F.when((whole >= 0) & (whole <= 23), whole.cast("int")))
    if "Time" in df.columns:
        seconds = hour_of_seconds(finite(F.col("Time")))
        candidates.append(F.when(F.col("Time").isNotNull(), seconds))
    candidates += [utc_hour(time_column(df, name)) for name in STORE_TIMES]
    return F.coalesce(*candidates)


def event_time(df: DataFrame, include_stored_at: bool = True) -> Column:
    """Row event time: event, else transaction, else (optionally) stored time."""
    names: Iterable[str] = EVENT_TIMES + (["stored_at_utc"] if include_stored_at else [])
    return F.coalesce(*[time_column(df, name) for name in names])


def night_by_hour(hour: Column) -> Column:
    """Night flag from the hour alone; a missing hour counts as day."""
    return F.coalesce(is_night(hour), F.lit(False))


def display_time(df: DataFrame, name: str) -> Column:
    """``yyyy-MM-dd HH:mm:ss UTC``, ``N/A`` when empty, the original text when unreadable."""
    original = F.col(name).cast("string")
    shown = F.date_format(
        F.to_utc_timestamp(time_column(df, name), F.current_timezone()), "yyyy-MM-dd HH:mm:ss 'UTC'"
    )
    return F.when(original.isNull() | (original == ""), "N/A").otherwise(F.coalesce(shown, original))


def format_time_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({name: display_time(df, name) for name in names if name in df.columns})
