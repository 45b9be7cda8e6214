"""What jobs need of their session: the shared folder, workers that can import this package, files of any store."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the setting is absent, that of the context;
    where that is too, a temporary one on a local master and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else uses; it isn't made yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def importable(spark: SparkSession) -> None:
    """Let Python workers of this session import this package from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Takes a written table or file away again, in whatever store it lies."""
    fs, place = _place(spark, path)
    fs.delete(place, True)


def children(spark: SparkSession, path: str) -> dict[str, int]:
    """The names in a folder and the bytes of each, of all below it for a folder; none where the folder isn't there."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return {}
    return {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() if s.isDirectory() else s.getLen() for s in fs.listStatus(place)}


def put_json(spark: SparkSession, path: str, value: object) -> None:
    """Writes a small file that appears whole or not at all: beside its place, then renamed."""
    fs, place = _place(spark, path)
    _, beside = _place(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if not fs.rename(beside, place):
        fs.delete(beside, False)
        raise FileExistsError(path)


def get_json(spark: SparkSession, path: str) -> object:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()
