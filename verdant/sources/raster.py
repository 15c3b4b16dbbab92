"""A2: raster lines (one array per band and line) to the pixel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant import constants as K

ARRAYS = [*K.BANDS, "scl", "data_mask"]


def _same_grid() -> Column:
    ok = F.col("scl").isNotNull()
    for name in ARRAYS:
        ok = ok & (F.size(name) == F.size("scl"))
    return F.coalesce(ok, F.lit(False))


def pixels(lines: DataFrame) -> DataFrame:
    """Lines (field_id, acquisition_id, row, one array per band, scl, data_mask) → one row per pixel.

    Acquisitions with a line of differing lengths are left out as a whole; see ``mismatched``.
    """
    good = lines.join(mismatched(lines), "acquisition_id", "left_anti")
    zipped = good.select("field_id", "acquisition_id", "row", F.posexplode(F.arrays_zip(*ARRAYS)).alias("col", "_p"))
    bands = [F.col("_p")[b].cast("double").alias(b) for b in K.BANDS]
    return zipped.select(
        "field_id", "acquisition_id", "row", "col", *bands, F.col("_p.scl").cast("int").alias("scl"), (F.col("_p.data_mask") > 0).alias("data_mask")
    )


def mismatched(lines: DataFrame) -> DataFrame:
    """Quarantine: acquisitions whose reflectance and mask grids differ."""
    return lines.filter(~_same_grid()).select("acquisition_id").distinct()
