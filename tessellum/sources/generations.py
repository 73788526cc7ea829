"""Tables in generations: readers see the live one, a build becomes live by one rename.

A table is a folder with a folder per generation and a file LIVE that names the one that readers take. The file is
written beside and renamed over the old one, so a reader finds either the old name or the new one. A build that is never
promoted stays unseen and can be swept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LIVE = "LIVE"


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def write_build(rows: DataFrame, root: str, generation: int) -> None:
    """The rows of a build in a folder of its own; an earlier try of the same build is replaced."""
    rows.write.mode("overwrite").parquet(f"{root}/generation={generation}")


def live(spark: SparkSession, root: str) -> int | None:
    """The generation that readers see; None before the first one."""
    jvm, fs, path = _files(spark, root)
    at = jvm.org.apache.hadoop.fs.Path(path, _LIVE)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return int(jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode())
    finally:
        stream.close()


def promote(spark: SparkSession, root: str, generation: int, expected: int | None = None) -> bool:
    """Make a finished build live if the live one is still the expected one; False if another was promoted meanwhile or the build
    did not end."""
    jvm, fs, path = _files(spark, root)
    Path = jvm.org.apache.hadoop.fs.Path
    if live(spark, root) != expected or not fs.exists(Path(path, f"generation={generation}/_SUCCESS")):
        return False
    beside = Path(path, f"{_LIVE}.{generation}")
    stream = fs.create(beside, True)
    stream.write(str(generation).encode())
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, Path(path, _LIVE), option)
    return True


def read_live(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/generation={live(spark, root)}")


def sweep(spark: SparkSession, root: str, keep: tuple[int, ...] = ()) -> list[int]:
    """Remove the generations that are neither live nor kept; the removed ones."""
    jvm, fs, path = _files(spark, root)
    now, gone = live(spark, root), []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("generation=") and int(name[11:]) not in (now, *keep):
            fs.delete(status.getPath(), True)
            gone.append(int(name[11:]))
    return sorted(gone)
