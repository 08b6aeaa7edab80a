"""Declared schemas of the CSV inputs."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


# Global catalog, and sequence files of the same layout. Times stay text until
# they are parsed with their zone, so no session setting can shift them.
ISO_EVENTS = T.StructType(
    [
        *_strings("time"),
        *_doubles("latitude", "longitude", "depth", "mag"),
        *_strings("magType", "place"),
    ]
)

# Sequence files with separate date and time. Magnitude is text: files hold
# entries that are not numbers.
DATE_TIME_EVENTS = T.StructType(
    [*_strings("Date", "Time"), *_doubles("Lon", "Lat", "Depth"), *_strings("Mag", "MagType")]
)

# Column names of the inputs. Files need the first group, in any
# order, and may lack the second.
NEEDED = {
    "iso": ("time", "latitude", "longitude", "mag"),
    "date_time": ("Date", "Time", "Lon", "Lat", "Mag"),
    "mainshocks": ("Year", "Month", "Day", "Hour", "Minute", "Second", "Mag", "Lat", "Lon"),
}
OPTIONAL = {
    "iso": ("depth", "magType", "place"),
    "date_time": ("Depth", "MagType"),
    "mainshocks": ("Depth", "Source"),
}
