"""Text-to-number cleaning of raw listing columns.

Everything is ``try_cast``: a value that is not a number becomes NULL instead
of failing the job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_price(c: Column) -> Column:
    bare = F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    return bare.try_cast("double")


def clean_rating(c: Column) -> Column:
    run = F.regexp_extract(c, "([0-9.]+)", 1)
    return F.nullif(run, F.lit("")).try_cast("double")


def clean_reviews(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
