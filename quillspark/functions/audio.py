"""Levels, gains and kernels as Column expressions over numbers and sample arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE_DB = -120.0


def to_db(linear: Column) -> Column:
    """Decibels of a linear amplitude, ``SILENCE_DB`` from 1e-12 down."""
    return F.when(linear <= 1e-12, F.lit(SILENCE_DB)).otherwise(20.0 * F.log10(linear))


def to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda v: F.abs(v.cast("double")))), F.lit(0.0))


def smoothing(milliseconds: float, rate: int) -> float:
    """Coefficient of a one-pole filter that covers 63 % of a step in the given time."""
    return math.exp(-1.0 / (rate * milliseconds / 1000.0)) if milliseconds > 0 and rate > 0 else 0.0


def smoothing_of(milliseconds: Column, rate: Column) -> Column:
    """``smoothing`` of columns."""
    return F.when((milliseconds > 0) & (rate > 0), F.exp(-1.0 / (rate * milliseconds / 1000.0))).otherwise(F.lit(0.0))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def meter(db: Column, floor_db: float = -60.0) -> Column:
    """A level as 0 to 1 on a meter."""
    return clamped((db - floor_db) / (0.0 - floor_db), 0.0, 1.0)


def normalising_gain(peak_linear: Column, target_db: float = -1.0, most_db: float = 20.0) -> Column:
    """The gain that brings a peak to the target, at most ``most_db``; 1 for silence."""
    gain = F.least(F.lit(10.0 ** (target_db / 20.0)) / peak_linear, F.lit(10.0 ** (most_db / 20.0)))
    return F.when(peak_linear > 1e-9, gain).otherwise(F.lit(1.0))


def catmull_rom(x0: Column, x1: Column, x2: Column, x3: Column, t: Column) -> Column:
    """The cubic through x1 and x2 whose slopes come from their neighbours, at ``t`` between them."""
    a = -0.5 * x0 + 1.5 * x1 - 1.5 * x2 + 0.5 * x3
    b = x0 - 2.5 * x1 + 2.0 * x2 - 0.5 * x3
    return ((a * t + b) * t + 0.5 * (x2 - x0)) * t + x1


def quantised(samples: Column) -> Column:
    """Samples as 16-bit integers: clamped to full scale, halves to even."""
    return F.transform(samples, lambda x: F.rint(clamped(x.cast("double"), -1.0, 1.0) * 32767).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """A vector of length 1; one shorter than 1e-9 stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm < 1e-9, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def mel(hertz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hertz / 700.0)


def hertz(mels: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mels / 2595.0) - 1.0)
