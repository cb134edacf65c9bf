"""Generated motion patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: standard deviation of each half, as a share of the way from the peak to its end.
WIDTH = 0.4


def motion_pattern(amplitudes: DataFrame, period: float, samples: int, top: float, extra: tuple[float, float, float] | None = None) -> DataFrame:
    """Two half Gaussians around a peak at the share ``top`` of the period, for each row's amplitude.

    There are ``samples`` samples; the one at the end of the period would repeat
    the first and is left out. Widths are WIDTH of the way from the peak to
    either end. extra adds a Gaussian of (height, centre, width): height relative
    to the amplitude, the others in shares of the period.
    """
    share = F.col("k") / F.lit(float(samples))
    bell = lambda centre, width: F.exp(-0.5 * F.pow((share - centre) / width, F.lit(2.0)))
    value = bell(top, F.when(share < top, WIDTH * top).otherwise(WIDTH * (1 - top)))
    if extra is not None:
        height, centre, wide = extra
        value = value + height * bell(centre, wide)
    p = amplitudes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return p.withColumns({"t": share * period, "value": F.col("amplitude") * value}).drop("amplitude")
