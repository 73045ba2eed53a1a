"""What the training-data operators share: tables, Arrow batches, samples, checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from asofworks.operators.storage import shared_folder

ROOT = Path(__file__).resolve().parents[2]

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
#: Text bytes that one call of a batch function gets at most (a longer text comes alone).
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Readies a session: batches that suit long texts, and this package on the Python workers' path.

    A batch of Spark's default of 10,000 rows holds 30 MB of documents, several
    times over in JVM and Python, and the Parquet reader's 4,096 rows of 100 kB
    are more than a task has; a session's own setting is left alone.
    """
    sc = spark.sparkContext
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    if spark.conf.get(ARROW_BYTES).rstrip("b") == str(64 << 20):
        spark.conf.set(ARROW_BYTES, str(8 << 20))
    if spark.conf.get(READER_ROWS) == "4096":
        spark.conf.set(READER_ROWS, "256")
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_asofworks_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="asofworks-")
    for path in (ROOT / "asofworks").rglob("*.py"):
        to = Path(folder, "tree", path.relative_to(ROOT))
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(path, to)
    sc.addPyFile(shutil.make_archive(f"{folder}/asofworks", "zip", f"{folder}/tree"))
    sc._asofworks_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared checkpoint folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table to the cluster's shared checkpoint folder and read again."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


def held(column: str, n: int, remainder: int) -> Column:
    """True for the held-out fold; an id of null is held out, as nothing may be learned from it."""
    return F.coalesce(fold(column, n) == remainder, F.lit(True))


def hash_sample(df: DataFrame, keys: list[str], limit: int, strata: str | None = None) -> DataFrame:
    """About limit distinct rows (of each stratum), those with the smallest hashes of keys; all distinct rows where there are no more.

    Deterministic, without a shuffle of the rows but for the sample: counts, then
    a filter. Rows that are equal count once in the sample, so that it is bounded
    even where one row stands for a third of the table.
    """
    steps = 1 << 40
    mark = F.pmod(F.xxhash64(*keys), F.lit(steps))
    if strata is None:
        n = df.count()
        return df.dropDuplicates(keys) if n <= limit else df.where(mark < int(steps * limit / n)).dropDuplicates(keys)
    stratum = F.struct(F.col(strata).isNull().alias("none"), F.coalesce(F.col(strata).cast("string"), F.lit("")).alias("name"))
    shares = df.groupBy(stratum.alias("_stratum")).agg(F.least(F.lit(1.0), F.lit(float(limit)) / F.count("*")).alias("_share"))
    own = looked_up(df.withColumn("_stratum", stratum), shares, "_stratum").where(mark < (F.col("_share") * steps).cast("long"))
    return own.select(*df.columns).dropDuplicates([*keys, strata])


class Texts:
    """A text column's UTF-8 bytes: data, and the start and end of each row's (empty for null)."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
        n = len(column)
        if pa.types.is_binary(column.type):
            column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        self.null = np.asarray(column.is_null())
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.start = bounds[:-1]
        self.end = np.where(self.null, bounds[:-1], bounds[1:])

    def __len__(self) -> int:
        return len(self.start)

    def __iter__(self) -> Iterator[bytes]:
        view = memoryview(self.data)
        for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True):
            yield bytes(view[a:b])

    def strings(self) -> Iterator[str]:
        for raw in self:
            yield raw.decode("utf-8", "replace")

    @property
    def size(self) -> np.ndarray:
        return self.end - self.start


def sum_by_row(texts: Texts, per_byte: np.ndarray) -> np.ndarray:
    """Sums of a value per byte over each row's bytes."""
    total = np.zeros(len(per_byte) + 1, np.int64)
    np.cumsum(per_byte, out=total[1:])
    return total[texts.end] - total[texts.start]


def pieces(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most about limit bytes of text each."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(Texts(batch.column(text)).size)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def annotate(df: DataFrame, fields: list[StructField], start: Callable[[], Callable], needs: list[str], keep: list[str], text: str = "text") -> DataFrame:
    """df's columns keep and, per row, the fields that start()(batch) returns as a list of arrays.

    start runs once a task. A kept column with the name of a field is left out: the new one counts.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *needs])])
    schema = StructType([source.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for whole in batches:
            for batch in pieces(whole, text):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *f(batch)], [*keep, *(x.name for x in fields)])

    return source.mapInArrow(run, schema)


def whole_vectors(df: DataFrame, column: str, scale: int, limit: int, out: str) -> DataFrame:
    """df's rows whose vector has no null or non-finite component, and out: floor(scale * x) of each component x as a double.

    Values beyond the limit on either side are held there, so that what is
    computed from them is exact in 64 bits.
    """
    fine = F.forall(column, lambda x: F.coalesce((x == x) & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    held_in = lambda x: F.greatest(F.lit(float(-limit)), F.least(F.lit(float(limit)), F.floor(x.cast("double") * scale).cast("double"))).cast("long")
    return df.where(F.col(column).isNotNull() & fine).withColumn(out, F.transform(column, held_in))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of longs as a matrix; shorter rows are filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    size = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def looked_up(rows: DataFrame, details: DataFrame, key: str, most: int = 100_000, salts: int = 32) -> DataFrame:
    """rows with the columns of details, which has one row a key; no key is null.

    details go to all tasks while they are at most so many rows; else they are
    repeated under each salt, so that a key with a third of all rows is met in
    as many tasks as there are salts.
    """
    if details.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(details), key, "left")
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
    every = details.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(every, [key, "_salt"], "left").drop("_salt")
