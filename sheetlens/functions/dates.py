"""Dates as users write them: layouts by rule, and the layouts that a column's values can have by their shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.names import quoted

# fixed values: ways to write a day (or a month), with the shape of each; of layouts that fit as many values the first counts
DAYS = (
    ("yyyy-MM-dd", r"\d{4}-\d{2}-\d{2}"), ("yyyy/MM/dd", r"\d{4}/\d{2}/\d{2}"), ("yyyy.MM.dd", r"\d{4}\.\d{2}\.\d{2}"),
    ("yyyyMMdd", r"(?:19|20)\d{2}(?:0[1-9]|1[0-2])[0-3]\d"), ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("d-M-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"), ("M-d-yyyy", r"\d{1,2}-\d{1,2}-\d{4}"), ("d.M.yyyy", r"\d{1,2}\.\d{1,2}\.\d{4}"),
    ("d MMM yyyy", r"\d{1,2} [A-Za-z]{3} \d{4}"), ("d-MMM-yyyy", r"\d{1,2}-[A-Za-z]{3}-\d{4}"), ("d MMMM yyyy", r"\d{1,2} [A-Za-z]{3,9} \d{4}"),
    ("MMM d, yyyy", r"[A-Za-z]{3} \d{1,2}, \d{4}"), ("MMMM d, yyyy", r"[A-Za-z]{3,9} \d{1,2}, \d{4}"),
)
MONTHS = (("yyyy-MM", r"\d{4}-\d{2}"), ("MMM yyyy", r"[A-Za-z]{3} \d{4}"), ("MMMM yyyy", r"[A-Za-z]{3,9} \d{4}"))
# fixed values: ways to write a time of day and a zone after it
TIMES = (
    ("H:mm:ss", r"\d{1,2}:\d{2}:\d{2}"), ("H:mm", r"\d{1,2}:\d{2}"), ("H:mm:ss[.SSSSSSSSS]", r"\d{1,2}:\d{2}:\d{2}(?:\.\d{1,9})?"),
    ("h:mm a", r"\d{1,2}:\d{2} [AaPp][Mm]"), ("h:mm:ss a", r"\d{1,2}:\d{2}:\d{2} [AaPp][Mm]"),
)
ZONES = (("", ""), ("XXX", r"(?:Z|[+-]\d{2}:\d{2})"), ("XX", r"[+-]\d{4}"), (" XXX", r" (?:Z|[+-]\d{2}:\d{2})"), (" XX", r" [+-]\d{4}"))
BEFORE_TIME = ((" ", " "), ("'T'", "T"))


def _layouts() -> dict[str, str]:
    out = dict(DAYS) | dict(MONTHS)
    for day, shape in DAYS:
        for gap, gap_shape in BEFORE_TIME if day.startswith("yyyy") else BEFORE_TIME[:1]:
            for time, time_shape in TIMES:
                # years that come first go with hours of two digits
                hours = time.replace("H:", "HH:") if day.startswith("yyyy") else time
                digits = time_shape.replace(r"\d{1,2}:", r"\d{2}:", 1) if hours != time else time_shape
                for zone, zone_shape in ZONES:
                    out[day + gap + hours + zone] = shape + gap_shape + digits + zone_shape
    return out


#: layout -> shape that a value must have before it is worth parsing
LAYOUTS = _layouts()
_ANY_TIME = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: [AaPp][Mm])?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?"
_ANY_DAY = "|".join(dict.fromkeys(shape for _, shape in DAYS))
ANY_SHAPE = f"^(?:(?:{_ANY_DAY})(?:[ T]{_ANY_TIME})?|{'|'.join(shape for _, shape in MONTHS)})$"
SHORTEST, LONGEST = 7, 48


def parsed_date(c: Column, layout: str) -> Column:
    """Timestamp of ``c`` in one layout, NULL unless its shape fits; a zone is turned into the session's."""
    return F.when(c.rlike(f"^{LAYOUTS[layout]}$"), F.try_to_timestamp(c, F.lit(layout))).cast("timestamp_ntz")


def date_shaped(c: Column) -> Column:
    """Could the value be a date in any layout? One cheap test instead of a parse per layout."""
    return F.length(c).between(SHORTEST, LONGEST) & c.rlike(ANY_SHAPE)


def _shape(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "012345678", "999999999"), "[A-Za-z]", "a")


def candidate_layouts(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Layouts that values of each text column can have, in order of preference.

    One pass turns date-shaped values into their shapes (digits and letters masked) and counts these by column; the layouts
    allow few shapes, whatever the number of values, so a few rows come to the driver: each shape's first and last value.
    """
    if not columns:
        return {}
    values = [F.struct(F.lit(i).alias("i"), F.col(quoted(c)).alias("v")) for i, c in enumerate(columns)]
    long = df.select(F.inline(F.array(*values))).where(date_shaped(F.col("v")))
    shapes = long.groupBy("i", _shape(F.col("v")).alias("shape")).agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for i, c in enumerate(columns):
        samples = [v for r in shapes if r["i"] == i for v in (r["low"], r["high"])]
        out[c] = [layout for layout, shape in LAYOUTS.items() if any(re.fullmatch(shape, v) for v in samples)]
    return out
