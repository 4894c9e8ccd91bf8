"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, ship_package, stored, table_dir

__all__ = ["saved", "stored", "table_dir"]

#: Most bytes of an Arrow batch on its way to a worker. Texts are long: the usual 64 MB, held by
#: the executor and the worker and then as Python strings, would be too much for every core.
BATCH_BYTES = 8 << 20

#: One ASCII white-space character, and a run of anything else (a word).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


#: A key that holds this share of all rows, or more, is hot.
HOT_SHARE = 1000


def heavy_keys(table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The keys of ``table`` (each once, with its number ``n`` of rows) that a share of all rows has:
    HOT_SHARE keys at most, whatever the data."""
    return table.where(F.col("n") * HOT_SHARE >= total).select(*keys)


def skew_join(rows: DataFrame, table: DataFrame, keys: list[str], total: int | None = None, heavy: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once. Heavy keys are broadcast, so their rows stay where
    they are. They are those of ``table``, by its column ``n`` and ``total`` rows, or a table of their own, which
    may name keys that ``table`` lacks. ``rows`` is read twice, and should be a stored table."""
    if heavy is None:
        heavy = heavy_keys(table, keys, rows.count() if total is None else total)
    heavy = F.broadcast(heavy)
    others = rows.join(heavy, keys, "left_anti").join(table.join(heavy, keys, "left_anti"), keys)
    return rows.join(F.broadcast(table.join(heavy, keys, "left_semi")), keys).unionByName(others)


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` has written and that nothing reads any more."""
    spark = table.sparkSession
    own = table_dir(spark).rpartition("/")[2]
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        if f"/{own}/" not in folder:
            raise ValueError(f"not a stored table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text only, under fixed names; the Python code of this package goes to the workers."""
    ship(docs.sparkSession)
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), text_or_empty(quoted(text_col)).alias("text"))


def ship(spark: SparkSession) -> None:
    """Code for the workers, and batches of a size that suits long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What the workers of this process hold for each operator, and how to let go of it.
_HELD: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def claim(owner: str, release: Callable[[], None]) -> None:
    """Workers serve one operator after the other: let go of what the ones before have cached."""
    if _owner[0] != owner:
        for name, let_go in _HELD.items():
            if name != owner:
                let_go()
        _owner[0] = owner
        give_back()
    _HELD[owner] = release


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows, so that few texts are Python strings at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
