"""Column expressions for what pipelines compute; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that Python's str.split() splits at, in ASCII and beyond.
ASCII_SPACE = r"[\t-\r\x1c-\x20]+"
WIDE_SPACE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPLIT_SPACE = rf"[\t-\r\x1c-\x20{WIDE_SPACE}]+"


def tokens(text: Column, lowercase: bool = True) -> Column:
    """The words of a text as Python's `str.split()` cuts them; null gives null.

    Most texts hold no white space beyond ASCII: looking for it once and splitting
    at a plain class is twice as fast as splitting all of them at the full one.
    """
    text = F.lower(text) if lowercase else text
    plain = (F.length(text) == F.octet_length(text)) | ~F.rlike(text, F.lit(f"[{WIDE_SPACE}]"))
    words = F.when(plain, F.split(text, ASCII_SPACE)).otherwise(F.split(text, SPLIT_SPACE))
    return F.filter(words, lambda word: word != "")


def ieee_div(a: Column, b: Column) -> Column:
    """Division by the floating-point rules: x/0 is infinite, 0/0 is NaN; null stays null."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a == 0, F.lit(float("nan"))).when(F.isnan(a), a).when((a > 0) == (F.signum(b) >= 0), F.lit(float("inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero.otherwise(F.lit(float("-inf")))).otherwise(a / b)


def ndvi(nir: Column, red: Column) -> Column:
    """(nir - red) / (nir + red)."""
    return ieee_div(nir - red, nir + red)


def squared_error(a: Column, b: Column) -> Column:
    gap = a.cast("double") - b.cast("double")
    return gap * gap


def in_box(lat: Column, lon: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a point lies in (lat_min, lat_max, lon_min, lon_max), bounds included."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def channel_means(flat: Column, pixels: int, channels: int) -> Column:
    """Means over the pixels of a row-major [..., channels] tensor stored flat, one per channel."""
    per = lambda c: F.aggregate(
        F.sequence(F.lit(0), F.lit(pixels - 1)), F.lit(0.0), lambda s, i: s + F.element_at(flat, i * channels + c + 1).cast("double")
    )
    return F.array(*[(per(c) / pixels).cast("float") for c in range(channels)])


def slice_means(vector: Column, width: int, parts: int) -> Column:
    """The mean of what isn't null in each consecutive `width` elements; null where there is none."""
    held = F.array(*[F.array_compact(F.slice(vector, i * width + 1, width)) for i in range(parts)])
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(held, lambda part: F.when(F.size(part) > 0, total(part) / F.size(part)))


def rounded(x: Column, digits: int) -> Column:
    """A double at `digits` places as DuckDB's ROUND makes it: scaled, to the nearest whole number with ties away from zero, scaled back.

    Spark's own goes by the shortest decimal of the double, and loses the sign of a negative that becomes zero.
    """
    scaled = x * F.lit(10.0**digits)
    whole = F.when(F.abs(scaled - F.rint(scaled)) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(F.rint(scaled))
    return F.when(F.abs(scaled) == float("inf"), x).otherwise(whole / F.lit(10.0**digits))


def row_hash(columns: Iterable[str]) -> Column:
    """A 64-bit hash of a row, for order-insensitive digests."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])
