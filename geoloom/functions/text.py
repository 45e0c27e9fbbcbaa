"""Names, labels, natural order and short text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

NAME_LENGTH = 48
SHORT_TEXT = 100
SHORT_ITEMS = 8


def clean_name(text: Column, fallback: str = "dataset") -> Column:
    """Relation name of a free text: lower case, extension dropped, other characters to ``_``."""
    given = F.lower(F.when(text.isNull() | (text == ""), F.lit(fallback)).otherwise(text))
    stem = F.regexp_replace(given, r"\.[^.]+\z", "")
    body = F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9_]+", "_"), r"\A_+|_+\z", "")
    named = F.when(body.rlike(r"\A[a-z_]"), body).otherwise(F.concat(F.lit("data_"), body))
    return F.substring(named, 1, NAME_LENGTH)


def relation_name(text: str | None, fallback: str = "dataset") -> str:
    """Driver-side form of :func:`clean_name` for the few names in a specification."""
    stem = re.sub(r"\.[^.]+\Z", "", (text or fallback).lower())
    body = re.sub(r"[^a-z0-9_]+", "_", stem).strip("_")
    name = (body if body[:1].isalpha() else f"data_{body}")[:NAME_LENGTH]
    if name == "data_":
        raise ValueError(f"{text!r} holds no letter or digit to build a name from.")
    return name


def natural_key(text: Column) -> Column:
    """Sort key under which runs of digits compare as numbers (``a9`` before ``a10``).

    Each run is written as its length in four digits, then the run without leading zeros.
    """
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def keyed(part: Column) -> Column:
        digits = F.regexp_replace(part, r"\A0+(?=[0-9])", "")
        sized = F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        return F.when(part.rlike(r"\A[0-9]"), sized).otherwise(part)

    return F.array_join(F.transform(parts, keyed), "")


def row_label(label: Column | None, group: Column | None) -> Column:
    """Text of the label role, else of the group role, else a constant; never null."""
    chosen = label if label is not None else group
    if chosen is None:
        return F.lit("Result")
    return F.coalesce(chosen.cast("string"), F.lit("Result"))


def short_text(text: Column) -> Column:
    """Text of more than 100 characters cut to 97 and an ellipsis."""
    cut = F.concat(F.substring(text, 1, SHORT_TEXT - 3), F.lit("…"))
    return F.when(F.length(text) > SHORT_TEXT, cut).otherwise(text)


def float_key_text(value: Column) -> Column:
    """Plain decimal text of a floating-point key with all its digits and no exponent (``300234062328360.0``)."""
    text = value.cast("double").cast("string")
    form = r"\A(-?)(\d)\.(\d+)E(-?\d+)\z"
    sign, lead, rest = (F.regexp_extract(text, form, i) for i in (1, 2, 3))
    rest = F.when(rest == "0", "").otherwise(rest)
    power = F.try_to_number(F.regexp_extract(text, form, 4), F.lit("S999")).cast("int")
    digits = F.concat(lead, rest)
    whole = F.concat(F.rpad(digits, power + 1, "0"), F.lit("."), F.coalesce(
        F.nullif(F.substr(rest, power + 1), F.lit("")), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.when(text.rlike(form), F.concat(sign, F.when(power >= 0, whole).otherwise(small))).otherwise(text)
