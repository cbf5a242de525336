"""Time as whole microseconds, and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age(birth: Column, on: Column) -> Column:
    """Full years from one date to another; someone born on 29 February is a year older on 1 March of other years. Null gives null."""
    years = F.year(on) - F.year(birth)
    return years - (F.month(on) * 100 + F.day(on) < F.month(birth) * 100 + F.day(birth)).cast("int")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of the wall-clock reading: the same for timestamps with and without a zone, whatever the session's zone."""
    second = F.date_part(F.lit("SECOND"), c)
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + (second * 1_000_000).cast("long")
