"""Dates that arrive in several text layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts accepted for sale and listing dates. The two-digit year
# layout stands before the four-digit one because it accepts exactly two digits.
LAYOUTS = ("M/d/yy", "M/d/yyyy", "yyyy-M-d", "MMMM d, yyyy")


def parse_date(c: Column) -> Column:
    text = F.trim(c)
    shapes = {
        "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
        "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
        "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
        "MMMM d, yyyy": r"^[A-Za-z]+ \d{1,2}, \d{4}$",
    }
    return F.coalesce(
        *[
            F.when(text.rlike(shapes[layout]), F.try_to_timestamp(text, F.lit(layout))).cast("date")
            for layout in LAYOUTS
        ]
    )


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
