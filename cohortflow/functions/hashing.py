"""Deterministic pseudo-random order and order-free content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int | str | Column, *parts: Column) -> Column:
    """md5 of ``seed:part:part``; sorting by it is a seeded shuffle any engine can repeat."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", head, *parts))


def digest_int(digest: Column, start: int = 1, digits: int = 8) -> Column:
    """Unsigned integer held in hex digits ``[start, start + digits)`` of a digest."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


#: Lifts a value off an exact tie at the tenth digit, which engines round differently. It is a double, and far below half a digit.
NUDGE = 1 + 2.0**-40


#: A double and its neighbours differ by less than this share of it; powers of ten up to this one are exact doubles.
NEAR, EXACT = 2.0**-51, 22


def _parts(x: Column) -> tuple[Column, Column]:
    high = x * 134217729.0 - (x * 134217729.0 - x)
    return high, x - high


def _product(a: Column, b: Column) -> tuple[Column, Column]:
    """The rounded product and what rounding has taken from it; both together are exact."""
    (ah, al), (bh, bl) = _parts(a), _parts(b)
    return a * b, al * bl - (a * b - ah * bh - al * bh - ah * bl)


def _beyond(x: Column) -> Column:
    """``x`` moved away from the tie it is next to, to its own side; from the tie itself towards the even digit."""
    size, power = F.abs(x), 9 - F.floor(F.log10(F.abs(x)))
    up, down = F.pow(F.lit(10.0), F.greatest(power, F.lit(0))), F.pow(F.lit(10.0), F.greatest(-power, F.lit(0)))
    scaled = F.struct(size.alias("size"), up.alias("up"), down.alias("down"), F.floor(size * up / down).alias("whole"))

    def side(s: Column) -> Column:
        (p, p_rest), (q, q_rest) = _product(s["size"], s["up"]), _product(s["whole"] + 0.5, s["down"])
        return (p - q) + (p_rest - q_rest)

    away = F.transform(F.array(scaled), lambda s: F.struct(side(s).alias("side"), (s["whole"] % 2 == 1).alias("odd")))
    return x * F.when((away[0]["side"] > 0) | ((away[0]["side"] == 0) & away[0]["odd"]), 1 + NEAR).otherwise(1 - NEAR)


def off_the_tie(x: Column) -> Column:
    """``x``, or next to a tie of ten significant digits a value beyond it on the side where ``x`` is.

    The formatter rounds the shortest digits of a double. They can be the tie itself while the double is below
    it, which engines that round the double decide the other way. The side comes from error-free products;
    a double that is the tie goes to the even digit. Magnitudes beyond 1e-13 and 1e31 are left alone.
    """
    power = 9 - F.floor(F.log10(F.abs(x)))
    near = (F.abs(F.abs(x) * F.pow(F.lit(10.0), power) % 1.0 - 0.5) < 2.0**-15) & (F.abs(power) <= EXACT)
    return F.when(near, _beyond(x)).otherwise(x)


def canonical_value(col: Column, dtype: str) -> Column:
    """Text form of a value, the same in any engine.

    Doubles keep ten significant digits with their power of ten; NaN, the infinities and NULL have
    marks of their own, and minus zero is zero. Times are whole microseconds. A length prefix keeps
    neighbouring values apart; NULL has none.
    """
    text = _plain(col, dtype)
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def _plain(col: Column, dtype: str) -> Column:
    if dtype in ("double", "float"):
        x = col.cast("double")
        return (
            F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
            .when(x.isNotNull(), F.format_string("%.9e", F.when(x == 0, 0.0).otherwise(off_the_tie(x * NUDGE))))
        )
    if dtype in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(col.cast("timestamp")).cast("string")
    if dtype.startswith("array<"):
        inner = dtype.removeprefix("array<").removesuffix(">")
        return F.concat(F.lit("["), F.array_join(F.transform(col, lambda v: F.coalesce(_plain(v, inner), F.lit("~"))), ","), F.lit("]"))
    return col.cast("string")


def digest_words(digest: Column) -> list[Column]:
    """Twelve 20-bit words of a sha256 hex digest. Sums of them stay in a bigint for 8e12 rows."""
    words = []
    for start in (1, 16, 31, 46):
        value = digest_int(digest, start, 15)
        words += [F.shiftright(value, 40), F.shiftright(value, 20).bitwiseAND(F.lit(0xFFFFF)), value.bitwiseAND(F.lit(0xFFFFF))]
    return words
