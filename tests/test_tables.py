import os

import pytest
from pyspark.sql import functions as F

from terraloom.sources import tables


def processes_started(spark, action) -> list[str]:
    """The commands that Spark's JVM starts meanwhile, by its own record."""
    jvm = spark._jvm
    path = jvm.java.io.File.createTempFile("terraloom", ".jfr").toPath()
    record = jvm.jdk.jfr.Recording()
    record.enable("jdk.ProcessStart").withoutStackTrace()
    record.start()
    try:
        action()
        record.stop()
        record.dump(path)
        return [e.getString("command") for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(path) if e.getEventType().getName() == "jdk.ProcessStart"]
    finally:
        record.close()
        jvm.java.nio.file.Files.delete(path)


def test_a_scratch_file_starts_one_process_besides_its_folders(spark):
    parts, found = 16, []
    rows = spark.range(0, 1000, 1, parts).withColumn("text", F.col("id").cast("string"))
    commands = processes_started(spark, lambda: found.append(tables.written(rows, "t")))
    folder = found[0]._terraloom_path.removeprefix("file://")
    names = os.listdir(folder)
    assert sum(n.startswith("part-") for n in names) == parts and not [n for n in names if n.endswith(".crc")]
    assert len(commands) <= 2 * parts + 6, commands  # three a file before
    assert found[0].dtypes == rows.dtypes and sorted(found[0].collect()) == sorted(rows.collect())
    tables.discard(found[0])
    assert not os.path.exists(folder)


def test_a_damaged_scratch_file_is_noticed(spark):
    found = tables.written(spark.range(0, 50_000, 1, 1).select(F.xxhash64("id").alias("h")), "t")
    folder = found._terraloom_path.removeprefix("file://")
    (part,) = (f"{folder}/{n}" for n in os.listdir(folder) if n.startswith("part-"))
    with open(part, "r+b") as f:
        f.seek(os.path.getsize(part) // 2)
        byte = f.read(1)[0]
        f.seek(-1, 1)
        f.write(bytes([byte ^ 1]))
    with pytest.raises(Exception, match="(?i)checksum|CRC|integrity"):
        found.agg(F.sum(F.col("h") % 1000)).collect()
    tables.discard(found)
