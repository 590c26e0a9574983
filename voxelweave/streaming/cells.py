"""Cell counts over a growing folder of point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cells as C, points as P


def stream_points(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """A stream of Parquet point tables; each trigger takes `files` new ones at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_cell_counts(points: DataFrame, lattice, offset: tuple[float, float, float], time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by cell under a fixed offset; by window of an event time as well if there is one, with a watermark for late rows."""
    moved = points.withColumns({c: (F.col(c) - F.lit(float(o)).cast("float")).cast("float") for c, o in zip("xyz", offset)})
    cells = P.quantize(P.finite(moved), lattice)
    if time is None:
        return C.cell_counts(cells)
    return cells.withWatermark(time, late).groupBy(F.window(time, window), *C.CELL).agg(F.count("*").alias("cnt"))
