"""Counts to physical units, and other scalar conversions."""

from __future__ import annotations


from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Converter resolution, reference voltages and resistors of the two kinds of strain channel; sound and motion scales; grams to a millilitre.
BITS = 24
BEND = (2.048, 4700.0)
STRETCH = (3.3, 1500.0)
PA_PER_COUNT = 6.09e-4
ACCEL_PER_COUNT = 0.00059820565
GYRO_PER_COUNT = 0.00875
GRAMS_PER_ML = 1.03
FULL_SCALE = 32768.0


def volts(counts: Column, v_ref: float, bits: int = BITS) -> Column:
    return counts / F.lit(float(1 << (bits - 1))) * F.lit(v_ref)


def bend(counts: Column, v_ref: float = BEND[0], bits: int = BITS) -> Column:
    """A bend channel stays a voltage."""
    return volts(counts, v_ref, bits).cast("float")


def stretch(counts: Column, v_ref: float = STRETCH[0], r_ref: float = STRETCH[1], bits: int = BITS) -> Column:
    """Resistance of the divider's upper arm. Voltages closer to zero than a millionth of the reference count as that, by their sign (zero as plus)."""
    v, floor = volts(counts, v_ref, bits), v_ref * 1e-6
    safe = F.when(F.abs(v) >= floor, v).when(v < 0, F.lit(-floor)).otherwise(F.lit(floor))
    return (F.lit(r_ref) * (F.lit(v_ref) - safe) / safe).cast("float")


def pascals(counts: Column, pa_per_count: float | None = PA_PER_COUNT, sensitivity_dbfs: float | None = None) -> Column:
    """Sound pressure; without a factor, from the sensitivity (1 Pa at that level below full scale)."""
    factor = pa_per_count if pa_per_count is not None else 1.0 / (10.0 ** (float(sensitivity_dbfs) / 20.0) * FULL_SCALE)
    return (counts * F.lit(factor)).cast("float")


def acceleration(counts: Column, scale: float = ACCEL_PER_COUNT) -> Column:
    return (counts * F.lit(scale)).cast("float")


def rotation_rate(counts: Column, scale: float = GYRO_PER_COUNT) -> Column:
    return (counts * F.lit(scale)).cast("float")


@dataclass(frozen=True)
class Affine:
    """Counts between two points of a scale to the physical values there."""

    count_low: float
    count_high: float
    low: float
    high: float

    def __call__(self, counts: Column) -> Column:
        return (counts - F.lit(self.count_low)) * F.lit(self.high - self.low) / F.lit(self.count_high - self.count_low) + F.lit(self.low)


def millilitres(grams: Column) -> Column:
    """Volume of a mass difference; a loss is none."""
    return F.greatest(F.lit(0.0), grams) / F.lit(GRAMS_PER_ML)


def to_log_flow(flow: Column) -> Column:
    return F.ln(F.greatest(flow, F.lit(0.0)) + 1)


def from_log_flow(x: Column, smearing: float | Column = 1.0) -> Column:
    return F.greatest(F.exp(x) * smearing - 1, F.lit(0.0))


def smearing(residual: Column) -> Column:
    """Aggregate: mean of exp(residual), which undoes the bias of averaging logarithms."""
    return F.avg(F.exp(residual))


def safe_log(x: Column) -> Column:
    return F.ln(x + F.lit(1e-8))


def softmax(logits: Column) -> Column:
    """Of an array, shifted by its largest."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """Position of the largest, the first of equal ones, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def skill(accuracy: Column, base: Column) -> Column:
    """(accuracy - base) / (1 - base); null where the base leaves no room."""
    return F.when(base < 1, (accuracy - base) / (1 - base))


def overlap_correction(window_s: float, hop_s: float) -> float:
    """What one window's volume counts for when windows overlap."""
    return hop_s / window_s


