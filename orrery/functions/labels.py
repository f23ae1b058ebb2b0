"""Speaker labels: the code behind a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_code(label: Column) -> Column:
    """The code of a label: remarks in () or [] dropped, trimmed to its outer ASCII letters or digits, upper case.

    A null label, or one without letters or digits, gives null.
    """
    bare = F.regexp_replace(label, r"\([^()]*\)|\[[^\[\]]*\]", "")
    trimmed = F.regexp_replace(F.regexp_replace(bare, r"^[^A-Za-z0-9]+", ""), r"[^A-Za-z0-9]+$", "")
    return F.nullif(F.upper(trimmed), F.lit(""))


def outer_blanks_off(value: Column) -> Column:
    """``value`` without white space around it."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")
