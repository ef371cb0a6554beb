"""Shared plumbing of the operators: tables, fold columns, scratch tables."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def row_key() -> Column:
    """A hash of doc_id and text: rows that repeat both are the same document, whatever the id is."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as it takes to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where that is unset and all tasks run in this process, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="tessera-")
    return _own[context.applicationId]


class Shared:
    """A value broadcast together with its classes, so that workers need no copy of this package."""

    def __init__(self, spark: SparkSession, value: object):
        self._sent, self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"_sent": self._sent, "_held": None}

    @property
    def value(self):
        if self._held is None:
            self._held = pickle.loads(self._sent.value)
        return self._held


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by its last column ``by`` if asked, and read it again: lineage ends here and every executor sees the files."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text): one aggregate that sizes partitions."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(row[0]), int(row[1])


#: Rows of counters that one task adds up.
SUM_ROWS = 64


def summed(rows: DataFrame) -> DataFrame:
    """Counters added up in rounds of SUM_ROWS rows a group, so no group grows with the number of tasks that counted.

    rows: slice, part (a number of the task, from 0 without large gaps), counts (int64 as bytes).  Returns one row a slice.
    """
    schema = "slice int, part int, counts binary"

    def add(key, t):
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t["counts"])
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    left = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        left = -(-left // SUM_ROWS)
        rows = rows.select("slice", (F.col("part") % left).alias("part"), "counts").groupBy("slice", "part").applyInArrow(add, schema)
        if left == 1:
            return rows
