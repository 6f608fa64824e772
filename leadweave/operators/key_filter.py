"""Bloom filters over join keys, so that wide rows which match nothing are dropped where they
are read instead of being shuffled to a join."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys the filter is sized for, with ten bits each; more only make it let more rows through.
EXPECTED = 400_000
_MOST_BITS = 1 << 26
_HASHES = 3


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(_HASHES)]


def key_filter(keys: DataFrame, key: Column, expected: int = EXPECTED) -> Callable[[Column], Column]:
    """A test that is true for every value of ``key`` in ``keys`` and false for nearly all others;
    false for NULL. The filter has a fixed size whatever the number of keys: tasks set the bits of
    their own rows, and the query that uses it gets it as a scalar."""
    bits = 1 << 15
    while bits < min(10 * expected, _MOST_BITS):
        bits *= 2
    # a column of its own, so that what makes the key is evaluated once
    places = keys.select(key.alias("_key")).select(F.explode(F.when(F.col("_key").isNotNull(), F.array(*_places(F.col("_key"), bits)))).alias("place"))
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    # at most ``bits`` / 32768 rows of four kilobytes
    filled = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "bitmap"))).alias("bitmaps")).scalar()

    def may_be_key(value: Column) -> Column:
        found = value.isNotNull()
        for place in _places(value, bits):
            bitmap, at = F.element_at(filled, F.bitmap_bucket_number(place)), F.bitmap_bit_position(place)
            byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            bit = F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))
            found = found & F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
        return found

    return may_be_key
