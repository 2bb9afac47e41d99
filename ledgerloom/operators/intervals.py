"""Numbers met within intervals: tolerances, half-even cells of a precision, and numeric matches by unit, basis, period and sign.

An interval is entered at the power of two that is at least its width, under the two or three bins of that size it touches; a value is entered under one bin at each
power in use. So a match is an equi-join, with a check of the bounds after it, whatever the numbers' sizes. Powers of two are exact, and casts to doubles keep
order, so no match is lost, also between decimals. Powers in use are at most some 2,100, a value for each of them; usually a few dozen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import registry

#: Bits of a bin's number: intervals finer than this part of their size are entered as if they were as wide.
BITS = 52


def _bin(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level))


def within(left: DataFrame, right: DataFrame, low: str, high: str, value: str, on: tuple[str, ...] = (), salt: int = 1) -> DataFrame:
    """Rows of left and right alike in `on` with low <= value <= high; other names of both differ. Nulls, NaN and intervals that end before they begin match nothing;
    infinite bounds hold all values on their side. Hot keys are split by adaptive execution, or into `salt` parts of right, to each of which left's rows go."""
    lo, hi = (F.greatest(F.least(F.col(c).cast("double"), F.lit(8e307)), F.lit(-8e307)) for c in (low, high))
    width = F.ceil(F.log2(F.when(hi > lo, hi - lo)))
    size = F.floor(F.log2(F.nullif(F.greatest(F.abs(lo), F.abs(hi)), F.lit(0.0)))) - BITS
    level = F.greatest(F.coalesce(F.greatest(width, size), F.lit(-1000)), F.lit(-1000)).cast("int")
    a = left.filter((F.col(low) <= F.col(high)) & ~F.isnan(F.col(low).cast("double")) & ~F.isnan(F.col(high).cast("double"))).withColumn("_level", level)
    levels = a.select(*on, "_level").distinct()
    a = a.withColumn("_bin", F.explode(F.sequence(_bin(lo, F.col("_level")), _bin(hi, F.col("_level"))))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    v = F.greatest(F.least(F.col(value).cast("double"), F.lit(8e307)), F.lit(-8e307))
    b = right.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if on:  # only the powers in use under the value's own key
        b = b.join(levels, list(on))
    else:
        b = b.withColumn("_level", F.explode(F.lit([r[0] for r in levels.collect()]).cast("array<int>")))
    b = b.filter(F.abs(v) / F.pow(F.lit(2.0), F.col("_level")) < F.lit(2.0 ** (BITS + 3))).withColumn("_bin", _bin(v, F.col("_level")))
    b = b.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in right.columns]), F.lit(salt)).cast("int"))
    return a.join(b, [*on, "_level", "_bin", "_salt"]).filter((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("_level", "_bin", "_salt")


def cell(value: Column, quantum: Column) -> Column:
    """struct(low, high, closed): what rounds half to even to the same multiple of the quantum as the value; its ends belong to it if the multiple is even.
    Decimals in, decimals out, so ends are exact."""
    k = F.bround(value / quantum)
    return F.struct(((k - 0.5) * quantum).alias("low"), ((k + 0.5) * quantum).alias("high"), (F.pmod(k, F.lit(2)) == 0).alias("closed"))


def in_base(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """Adds _unit and _base: a registered unit's dimension and canonical label with the value in it; any other unit by its own label with the value as it is."""
    r = F.broadcast(registry(rows.sparkSession).select(F.col("label").alias("_l"), F.concat_ws(":", "dimension", "canonical").alias("_u"), F.col("factor").cast("double").alias("_f")))
    out = rows.join(r, F.col(unit) == F.col("_l"), "left")
    return out.withColumn("_unit", F.coalesce("_u", unit)).withColumn("_base", F.col(value).cast("double") * F.coalesce("_f", F.lit(1.0))).drop("_l", "_u", "_f")


def numeric_matches(targets: DataFrame, found: DataFrame, tolerance: Column, signed: bool = True) -> DataFrame:
    """targets (target_id, unit, basis, period, stated) with found (found_id, unit, basis, period, value): pairs of equal or equivalent units, and of equal basis and
    period, both missing included, whose values in the base unit differ by at most `tolerance` (of columns of targets; `_base` is the stated value in its base unit).
    Unsigned matches compare magnitudes; `same_sign` says whether signs agree."""
    size = (lambda c: F.col(c)) if signed else (lambda c: F.abs(c))
    keys = lambda d: d.withColumns({f"_{k}": F.struct(F.col(k).isNull().alias("no"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("v")) for k in ("basis", "period")})
    a = keys(in_base(targets, "unit", "stated")).select("target_id", "_unit", "_basis", "_period", F.col("_base").alias("_stated"), (size("_base") - tolerance).alias("_low"), (size("_base") + tolerance).alias("_high"))
    b = keys(in_base(found, "unit", "value")).select("found_id", "_unit", "_basis", "_period", F.col("_base").alias("_value"), size("_base").alias("_size"))
    j = within(a, b, "_low", "_high", "_size", ("_unit", "_basis", "_period"))
    return j.select("target_id", "found_id", (F.signum("_stated") == F.signum("_value")).alias("same_sign"))
