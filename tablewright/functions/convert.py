"""Cell conversions between the logical types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tablewright.functions.dates import free_date

# Cells that stand for a missing date.
NO_DATE = ("nan", "NaT", "NaN", "")


def to_date_column(col: Column, strict: bool = True, default: Column | None = None) -> Column:
    """Parse text as a timestamp; a bad cell raises when ``strict``.

    After the fixed layouts, texts are read as free-form dates (``dates.free_date``), where
    ``default`` fills in what a text leaves out.
    """
    text = F.trim(col.cast("string"))
    present = F.when(~text.isin(*NO_DATE), text)

    def layout(shape: str, text: Column, pattern: str) -> Column:
        return F.try_to_timestamp(F.when(present.rlike(shape), text), F.lit(pattern)).cast("timestamp_ntz")

    day, clock = r"\d{4}-\d{2}-\d{2}", r"\d{1,2}:\d{1,2}:\d{1,2}"
    value = F.coalesce(
        layout(rf"^{day} {clock}$", present, "yyyy-MM-dd H:m:s"),
        # A bare time of day belongs to the first day of 1900.
        layout(f"^{clock}$", F.concat(F.lit("1900-01-01 "), present), "yyyy-MM-dd H:m:s"),
        layout(f"^{day}$", present, "yyyy-MM-dd"),
        F.when(~present.rlike(f"^{clock}$"), free_date(present, default)),
    )
    if not strict:
        return value
    bad = F.raise_error(F.concat(F.lit("not a date: "), present)).cast("timestamp_ntz")
    return F.when(present.isNull(), F.lit(None).cast("timestamp_ntz")).otherwise(
        F.coalesce(value, bad))


def to_number_column(col: Column, is_date: bool, strict: bool = True) -> Column:
    """Numbers from text, epoch seconds from dates."""
    if is_date:
        seconds = F.unix_timestamp(col.cast("timestamp"))
        return seconds.cast("double")
    return col.cast("double") if strict else col.try_cast("double")


def to_text_column(col: Column, is_float: bool) -> Column:
    """Text form; NaN becomes null. Floats are written out from 0.0001 up to 1e16, as scripts write them."""
    text = col.cast("string")
    if not is_float:
        return text
    size = F.abs(text.cast("double"))
    plain = F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.substring_index(text, "E", -1).try_cast("int")
    far = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"),
                   F.when(F.abs(power) < 10, F.lpad(F.abs(power).cast("string"), 2, "0")).otherwise(F.abs(power).cast("string")))
    written = (F.when(F.isnan(col), F.lit(None)).when(size == float("inf"), F.when(col > 0, "inf").otherwise("-inf"))
               .when(~text.contains("E") & ((size >= 1e-4) | (size == 0)), text).when((size >= 1e-4) & (size < 1e16), plain))
    return written.otherwise(F.when(text.contains("E"), far).otherwise(text))
