from strokeloom.plans import detect
from strokeloom.sources import synthetic
from strokeloom.streaming import ingest


def test_a_stream_gives_the_plans_of_a_batch(spark, tmp_path):
    scenes = synthetic.scenes(spark).repartition(3)
    scenes.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest.start_plans(ingest.raster_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = detect.plans(scenes)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
