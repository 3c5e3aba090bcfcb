"""Fourteen-character parcel identifiers from a centroid, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.geometry import centroid, col

# Geohash digits and identifier digits (no I, no O).
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"
DIGITS = "0123456789ABCDEFGHJKLMNPQRSTUVWXYZ"
GEOHASH_LENGTH = 11
LENGTH = 14

_LON_BITS = 28
_LAT_BITS = 27


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    """Index of the dyadic cell holding ``value``; corrected so that cell edges are exact."""
    step = span / 2**bits
    guess = F.floor((value - low) / step).cast("long")
    edge = F.lit(low) + guess * step
    exact = guess + F.when(value < edge, -1).when(value >= edge + step, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(exact, F.lit(2**bits - 1)))


def _bit_place(position: int) -> tuple[bool, int]:
    """Whether a geohash bit belongs to the longitude, and its shift inside that index."""
    on_lon = position % 2 == 0
    return on_lon, (_LON_BITS if on_lon else _LAT_BITS) - 1 - position // 2


def _geohash(x: Column, y: Column) -> Column:
    """Interleave two cell indexes, longitude bit first, into base-32 characters."""
    chars = []
    for j in range(GEOHASH_LENGTH):
        digit = F.lit(0)
        for b in range(5):
            on_lon, shift = _bit_place(5 * j + b)
            digit = digit + F.shiftright(x if on_lon else y, shift).bitwiseAND(F.lit(1)) * (16 >> b)
        chars.append(F.substring(F.lit(GEOHASH_DIGITS), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def _digit_char(index: Column) -> Column:
    return F.substring(F.lit(DIGITS), index.cast("int") + 1, F.lit(1))


def _value(text: Column, position: int, digits: str) -> Column:
    """Value of one character, 0 when it is not a digit of the alphabet."""
    return F.greatest(F.instr(F.lit(digits), F.substring(text, position, 1)) - 1, F.lit(0))


def check_char(core: Column) -> Column:
    weighted = reduce(
        lambda a, b: a + b, [_value(core, k + 1, DIGITS) * ((k + 1) * 3) for k in range(LENGTH - 1)]
    )
    return _digit_char(weighted % len(DIGITS))


def with_ulpin(df, lat, lon, name: str = "ulpin"):
    """Add the identifier of a point. Staged in three projections so each step stays one codegen expression."""
    df = df.withColumn("_lat", col(lat)).withColumn("_lon", col(lon))
    df = df.withColumn("_gx", _cell(F.col("_lon"), -180.0, 360.0, _LON_BITS)).withColumn(
        "_gy", _cell(F.col("_lat"), -90.0, 180.0, _LAT_BITS)
    )
    lat_micro = F.floor(F.abs(F.col("_lat") * 1000000)).cast("long") % 1000
    lon_micro = F.floor(F.abs(F.col("_lon") * 1000000)).cast("long") % 1000
    core = F.concat(
        F.upper(_geohash(F.col("_gx"), F.col("_gy"))),
        _digit_char((lat_micro + lon_micro) % len(DIGITS)),
        _digit_char((lat_micro * 3 + lon_micro * 7) % len(DIGITS)),
    )
    df = df.withColumn("_core", core)
    return df.withColumn(name, F.concat("_core", check_char(F.col("_core")))).drop(
        "_lat", "_lon", "_gx", "_gy", "_core"
    )


def assign_ulpin(df, geom: str = "geom"):
    """Add ``ulpin`` and ``bhu_aadhar``; null for empty geometry."""
    df = with_ulpin(df.withColumn("_c", centroid(geom)), "_c.y", "_c.x")
    return df.withColumn("bhu_aadhar", F.col("ulpin")).drop("_c")


def ulpin_valid(code) -> Column:
    clean = F.upper(F.trim(col(code)))
    return F.coalesce(
        (F.length(clean) == LENGTH)
        & clean.rlike(f"^[{DIGITS}]*$")
        & (F.substring(clean, LENGTH, 1) == check_char(F.substring(clean, 1, LENGTH - 1))),
        F.lit(False),
    )


def with_decoded(df, code: str, name: str = "decoded"):
    """Add struct(latitude, longitude, min_lat, min_lon, max_lat, max_lon, valid, error)."""
    clean = F.trim(F.col(code))
    short = clean.isNull() | (F.length(clean) < GEOHASH_LENGTH)
    digits = [_value(F.lower(clean), j + 1, GEOHASH_DIGITS) for j in range(GEOHASH_LENGTH)]
    df = df.withColumn("_v", F.array(*digits)).withColumn("_short", short).withColumn("_ok", ulpin_valid(clean))

    def index(offset: int, bits: int) -> str:
        """Every second bit of the digits, first to last."""
        return f"""aggregate(sequence(0, {bits - 1}), 0L, (a, i) -> a * 2
            + (_v[(2 * i + {offset}) div 5] div bigint(power(2, 4 - (2 * i + {offset}) % 5))) % 2)"""

    df = df.withColumn("_x", F.expr(index(0, _LON_BITS))).withColumn("_y", F.expr(index(1, _LAT_BITS)))

    def at(column: str, low: float, span: float, bits: int, offset: float) -> Column:
        return F.when(~F.col("_short"), F.round(low + (F.col(column) + offset) * (span / 2**bits), 7))

    def lat(offset: float) -> Column:
        return at("_y", -90.0, 180.0, _LAT_BITS, offset)

    def lon(offset: float) -> Column:
        return at("_x", -180.0, 360.0, _LON_BITS, offset)

    decoded = F.struct(
        lat(0.5).alias("latitude"),
        lon(0.5).alias("longitude"),
        lat(0.0).alias("min_lat"),
        lon(0.0).alias("min_lon"),
        lat(1.0).alias("max_lat"),
        lon(1.0).alias("max_lon"),
        F.col("_ok").alias("valid"),
        F.when(F.col("_short"), F.lit("Invalid ULPIN length")).alias("error"),
    )
    return df.withColumn(name, decoded).drop("_v", "_short", "_ok", "_x", "_y")
