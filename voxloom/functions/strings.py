"""String helpers: natural order, parameterised file names, trimming and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """A string that sorts as the name with its numbers compared as numbers: digits are padded to 12."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")


def file_name(key: Column, group: Column, multiplier: Column, height: int, width: int, depth: int, suffix: str = ".h5") -> Column:
    """key_group_multiplier_HxWxD with an extension that always has its dot."""
    dotted = suffix if suffix.startswith(".") else f".{suffix}"
    return F.concat(F.concat_ws("_", key, group, multiplier.cast("string"), F.lit(f"{height}x{width}x{depth}")), F.lit(dotted))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def chop(text: Column) -> Column:
    """Without line ends and blanks at the end."""
    return F.regexp_replace(text, r"[\r\n\t ]+$", "")


def normalised(text: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def zero_filled(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def dotted(number: Column) -> Column:
    """A whole number with dots between thousands."""
    return F.translate(F.format_number(number, 0), ",", ".")
