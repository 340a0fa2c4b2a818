"""Functions of sound samples in columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(samples: Column) -> Column:
    return samples.cast("array<double>")


def peak_normalised(samples: Column) -> Column:
    """Samples over the largest absolute one; silence stays."""
    peak = F.array_max(F.transform(_doubles(samples), F.abs))
    return F.transform(_doubles(samples), lambda x: F.when(peak > 0, x / peak).otherwise(x))


def frame_levels(samples: Column, frame: int = 2048, hop: int = 512) -> Column:
    """Root mean square of each frame, with half a frame of zeros before and after the samples."""
    pad = F.array_repeat(F.lit(0.0), frame // 2)
    padded = F.concat(pad, _doubles(samples), pad)
    level = lambda i: F.sqrt(F.aggregate(F.slice(padded, i + 1, F.lit(frame)), F.lit(0.0), lambda t, x: t + x * x) / frame)
    return F.transform(F.sequence(F.lit(0), F.size(padded) - frame, F.lit(hop)), level)


def quantile(values: Column, q: float) -> Column:
    """Interpolated quantile of an array."""
    ordered, place = F.array_sort(values), (F.size(values) - 1) * q
    low = F.floor(place).cast("int")
    below, above = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    return below + (place - low) * (above - below)


def signal_to_noise(samples: Column, frame: int = 2048, hop: int = 512) -> Column:
    """Decibels of the frames' 90th percentile over the 10th: 0 of no samples, 100 where the latter is 0."""
    levels = frame_levels(samples, frame, hop)
    noise = quantile(levels, 0.1)
    return F.when(F.size(samples) == 0, 0.0).when(noise == 0, 100.0).otherwise(10 * F.log10(F.try_divide(quantile(levels, 0.9), noise)))


def segments(samples: Column, size: int) -> Column:
    """Pieces of size samples; the last one may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(samples) - 1, F.lit(0)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.slice(samples, i + 1, F.lit(size))), lambda s: F.size(s) > 0)
