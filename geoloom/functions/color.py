"""Deterministic colours of groups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
PALETTE = ["#62cce1", "#a9cc63", "#ee8869", "#b394e8", "#63d2aa", "#ee7287"]
DEFAULT_TEXT = "default"


def text_hash(text: Column) -> Column:
    """Signed 32-bit polynomial hash (factor 31) over the UTF-16 code units of a text.

    One pass over the characters; a character above U+FFFF counts as its two surrogates.
    """

    def step(state: Column, char: Column) -> Column:
        point = F.ascii(char).cast("bigint")
        rest = point - F.lit(0x10000)
        high, low = F.lit(0xD800) + F.shiftright(rest, 10), F.lit(0xDC00) + rest.bitwiseAND(F.lit(0x3FF))
        pair = (state * 31 + high) * 31 + low
        return F.when(point < 0x10000, state * 31 + point).otherwise(pair) % F.lit(2**32)

    characters = F.filter(F.split(text, ""), lambda c: c != "")
    unsigned = F.aggregate(characters, F.lit(0).cast("bigint"), step)
    return (unsigned + F.lit(2**31)) % F.lit(2**32) - F.lit(2**31)


def palette_color(value: Column) -> Column:
    """Palette entry of a group value; null counts as the text ``default``."""
    text = F.coalesce(value.cast("string"), F.lit(DEFAULT_TEXT))
    palette = F.array(*[F.lit(color) for color in PALETTE])
    return F.element_at(palette, (F.abs(text_hash(text)) % len(PALETTE) + 1).cast("int"))
