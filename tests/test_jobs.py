"""Runs that are watched and cancelled."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from chronofold.plans import importer, jobs, sinks
from chronofold.plans.store import Store

from .test_importer import HOME, item, write


def test_a_cancelled_import_publishes_nothing(spark, tmp_path):
    """Cancelled while the sweep runs; the next import works."""
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, {"a.json": {"timelineItems": [item("08:00", "10:00", True, itemId="v1", place=HOME), item("10:00", "10:30", itemId="m1")]}})
    out, heard = str(tmp_path / "out"), []
    job = jobs.Job(spark, heard.append)
    sweep = importer.timeline.sweep

    def slow(events, whole=False):
        threading.Timer(1.5, job.cancel).start()
        wait = F.udf(lambda x: time.sleep(60) or x)
        return sweep(events.withColumn("kind", wait("kind")), whole)

    importer.timeline.sweep = slow
    try:
        with pytest.raises(jobs.Cancelled):
            job.run(lambda: sinks.write_tables(importer.import_history(spark, str(folder)), out))
    finally:
        importer.timeline.sweep = sweep
    assert not Store(spark, out).versions()
    assert heard and max(p.jobs for p in heard) > 3 and any(p.tasks for p in heard)
    again = jobs.Job(spark)
    n = again.run(lambda: sinks.write_tables(importer.import_history(spark, str(folder)), out, on_table=lambda name: again.check()))
    assert n["stays"] == 1 and Store(spark, out).versions() == [1]


def test_other_work_goes_on(spark):
    job = jobs.Job(spark)
    job.cancel()
    with pytest.raises(jobs.Cancelled):
        job.run(lambda: spark.range(10).count())
    assert spark.range(10).count() == 10
    with pytest.raises(ZeroDivisionError):
        jobs.Job(spark).run(lambda: 1 // 0)


def test_batches_of_a_stream_are_told(spark, tmp_path):
    heard = []
    listener = jobs.StreamProgress(lambda query, batch, rows: heard.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if heard:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (0, 7) in heard
