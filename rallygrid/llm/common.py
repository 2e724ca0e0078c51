"""What the text operators share: word rules, tables, lineage cuts."""
from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch_dir

#: Words are maximal runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, unchanged; no text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once in the session's shared folder and read it there.

    The files outlive any executor, and a plan that reads the table twice works it out once.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(df: DataFrame, h: Column, n: int, of: int) -> DataFrame:
    """The rows of ``df`` with a hash (a long) in the part of all hashes that ``n`` of ``of`` rows are expected in.

    Taken before a sample is sorted, so that what meets in one task doesn't grow with the table.
    """
    return df if of <= n else df.where(h < -(1 << 63) + (n << 64) // of)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package where their path doesn't have it."""
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in known) or getattr(sc, "_text_operators_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "rallygrid.zip")  # the driver serves it to executors
    with zipfile.ZipFile(path, "w") as z:
        for f in (root / "rallygrid").rglob("*.py"):
            z.write(f, f.relative_to(root))
    known_path = list(sys.path)
    sc.addPyFile(path)
    sys.path[:] = known_path  # the driver itself keeps importing from the folder
    sc._text_operators_shipped = True


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
