"""Rounding on the binary value, the way C/JS runtimes round.

Spark's ``round`` on a DOUBLE rounds the *decimal text* of the value half
up (``4930.28375`` -> ``4930.2838``), while the dashboard's ``toFixed`` and
most native engines round the binary value, which here lies just below the
tie (-> ``4930.2837``).  ``half_up`` scales, rounds half away from zero and
scales back, all in IEEE arithmetic, so every engine computing it from the
same double gets the same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c, digits: int) -> Column:
    """``sign(x) * floor(|x| * 10^d + 0.5) / 10^d`` (valid for |x|*10^d < 9e18)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10 ** digits))
    y = c * scale
    return F.signum(y) * F.floor(F.abs(y) + F.lit(0.5)).cast("double") / scale
