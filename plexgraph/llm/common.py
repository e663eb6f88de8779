"""Helpers that the training-data operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.shared import shared_dir, spread

#: Rows, and bytes, that a Python worker handles together; a longer text is alone.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Bytes of input (as stored, about) for each part of a shuffle of whole texts.
PART_BYTES = 64 << 20
#: The shuffle files of a step go when it has ended, not when the driver next collects its garbage.
_CLEAN = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return _written(df, shared_dir(df.sparkSession))


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with settings(spark, **_CLEAN):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder; they go as soon as what was made of them is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def path(self) -> str:
        path = shared_dir(self.spark)
        self.paths[path] = None
        return path

    def put(self, df: DataFrame) -> DataFrame:
        path = self.path()
        self.paths[path] = out = _written(df, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes the files of these tables; of all, if none is named."""
        for path in [p for p, df in self.paths.items() if not tables or any(df is t for t in tables)]:
            del self.paths[path]
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (``__`` for a dot) while what is inside runs; put back afterwards."""
    names = {k: k.replace("__", ".") for k in values}
    old = {k: spark.conf.get(n, None) for k, n in names.items()}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(names[k]) if v is None else spark.conf.set(names[k], v)


def doc_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table whose other columns may be anything."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """(own, *needed): all other columns go into one struct, so that no name of theirs can meet one that an operator adds."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in needed]
    return docs.select(F.struct(*others).alias("own") if others else F.lit(True).alias("own"), *needed)


def unpacked(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The columns that ``packed`` was given, in their order."""
    return df.select(*[F.col(c if c in needed else f"own.{quoted(c)}") for c in columns])


def sliced(run, rows: int = BATCH_ROWS, size: int = BATCH_BYTES):
    """``run``, a function over Arrow batches, given no more than ``rows`` rows and ``size`` bytes at once, whatever the session's limits."""

    def cut(b):
        n = b.num_rows
        if n > rows or (n > 1 and b.nbytes > size):
            yield from cut(b.slice(0, n // 2))
            yield from cut(b.slice(n // 2))
        else:
            yield b

    return lambda batches: run(x for b in batches for x in cut(b))


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts for a shuffle of whole rows: the session's number, or more for an input of more than ``part_bytes`` for each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if size > 1 << 60 else max(n, -(-size // part_bytes))  # a size that Spark doesn't know is about 2 ** 63


def utf8(texts) -> list:
    """The texts of an Arrow string column as bytes; null becomes empty."""
    import pyarrow as pa

    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]
