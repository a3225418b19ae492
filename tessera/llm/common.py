"""Small helpers that the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]

#: Bytes of an Arrow batch that goes to a Python worker; a longer row makes a batch of its own.
BATCH_BYTES = 1 << 20

#: What counts as a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes (texts and packs may be long), alike for all operators, and make this package importable on executors.

    Where the repository is neither the working folder nor on PYTHONPATH, the package is zipped and
    handed to Spark, which serves it to every executor, also to those that join later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if os.path.realpath(os.getcwd()) == str(ROOT) or str(ROOT) in known or os.path.exists("tessera/llm/common.py"):
        return
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT)))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, spark.checkpoint.dir: only what driver and executors share can hold them."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.partition("[")[0] == "local":  # one machine: its folders are shared
        folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions inside give their shuffle files back as soon as they end: for frames that no later action runs again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Intermediate tables of one computation: compressed, in the shared folder, each deleted when nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_folder(spark), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage with a table, which outlives any executor."""
        path = self.fresh(name)
        with freeing_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.keep(name, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def fresh(self, name: str) -> str:
        """A path in the shared folder that nothing has used."""
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def keep(self, name: str, path: str) -> None:
        """What was written at ``path`` goes by ``name`` from now on; an earlier holder of the name is deleted."""
        self.free(name)
        self.paths[name] = path

    def free(self, *names: str) -> None:
        """Delete tables by name; a later table of the same name has replaced the earlier one."""
        for name in names:
            if path := self.paths.pop(name, None):
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder that stays, as what is returned reads it."""
    return Scratch(df.sparkSession).write(df, name)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can neither clash nor cost anything."""
    return df.select(*[F.col(f"`{n}`") for n in names])
