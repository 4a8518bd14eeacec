"""Plans of rasters as they arrive. Detection is per map and keeps no state, so a stream runs the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strokeloom import model
from strokeloom.plans import detect
from strokeloom.sources.rasters import RASTERS


def raster_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Rasters from a folder of Parquet files to which new ones are added."""
    return spark.readStream.schema(RASTERS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start_plans(rasters: DataFrame, out: str, checkpoint: str, settings: model.DetectSettings | None = None) -> StreamingQuery:
    """Write the plans of a stream of rasters under out, each map once, until nothing is left to read."""
    plans = detect.plans(rasters, settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return plans.outputMode("append").trigger(availableNow=True).start()
