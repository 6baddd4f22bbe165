"""Times with a zone in text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: a date and time with Z or an offset.
ZONED = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)? ?(Z|[+-]\d{2}:\d{2})$"


def in_utc(instant: Column) -> Column:
    """A point in time as its UTC clock, whatever the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
