"""What the operators of this subpackage share: Arrow mapping, the shared folder, deterministic splits."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one call of a row function gets at most (a longer text comes alone).
SLICE_BYTES = 1 << 20


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="corvane-shared-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where unset (tests, one machine), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_folder()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int):
    """crc32 of the column's text modulo ``modulus``; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ``limit`` text bytes at most, a longer text alone."""
    column = batch.column(batch.schema.get_field_index(text))
    start = size = 0
    sizes = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
    for i, n in enumerate(sizes.to_pylist()):
        n = n or 0
        if size + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


#: Rows that travel to Python at a time, at most, where the session has Spark's own number: texts are longer than numbers.
BATCH_ROWS, SPARKS_ROWS = 1_000, "10000"


def small_batches(spark: SparkSession) -> None:
    """Has the session send fewer rows at a time to Python; a number that somebody has chosen stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, SPARKS_ROWS) == SPARKS_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def released() -> None:
    """Gives what a task has freed back to the system: workers are reused, and their peaks would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library


#: Bytes of a group after which memory is given back.
RELEASE_BYTES = 1 << 20


def tidied(f):
    """``f`` for a group or two, with memory given back afterwards where the group was large."""

    def group(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            if table.nbytes > RELEASE_BYTES:
                released()

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            released()

    return pair if f.__code__.co_argcount == 2 else group


def with_row_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    prepare: Callable[[], Callable[[list], Sequence[Sequence | pa.Array]]],
) -> DataFrame:
    """``df`` with columns that a Python function derives from the column ``text``, in Arrow batches, without a shuffle.

    ``prepare()`` runs once in each task and returns the function, which takes a list of values (arrays where the column
    has lists, empty ones for null) and returns a list for each new column. Columns of ``df`` that have a new column's name are replaced; all others stay.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new or c == text]
    schema = T.StructType([df.schema[c] for c in keep if c.lower() not in new] + list(fields))
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = prepare()
        for batch in batches:
            for part in slices(batch, text):
                values = apply(_listed(part.column(part.schema.get_field_index(text))))
                old = [(n, c) for n, c in zip(part.schema.names, part.columns) if n.lower() not in new]
                arrays = [c for _, c in old] + [v if isinstance(v, pa.Array) else pa.array(v, type=k) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in old] + [f.name for f in fields])
        del apply
        released()

    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def _listed(column: pa.Array) -> list:
    """The values of a column; of lists, arrays (empty where null), which is faster by far than to list each element."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Cells of ids that are weighed at a time, at most; the driver gets four numbers for each, the executors two.
CELLS = 1 << 18


def ranged(rows: DataFrame, id_: str, text: str, target: int, out: str) -> tuple[DataFrame, int]:
    """``rows`` with the number ``out`` of a range of ids of about ``target`` text bytes, and how many ranges there are.

    Ranges are numbered in order of ids, from 0; ids are not null. Ids are cut into even cells, CELLS at most, and the
    cells' texts are weighed. A cell of more than twice the target is cut again, and so on down to a single id, so ids
    that crowd, or stand far off, make no larger ranges; the rows of one id stay together. Neighbouring cells are put
    together up to the target. The numbers of cells are the only thing that is broadcast: CELLS rows at most for each
    of the levels, of which one is usual.
    """
    id_column = F.col(id_).cast("long")
    least, most = rows.agg(F.min(id_column), F.max(id_column)).first()
    if least is None:
        return rows.withColumn(out, F.lit(0)), 1
    shift = 0
    while (most >> shift) - (least >> shift) >= CELLS:
        shift += 1
    levels: list[tuple[int, pa.Table]] = []
    rest = rows.select(id_column.alias("_id"), F.col(text).alias("_text"))
    weight = F.sum(F.octet_length(F.coalesce(F.col("_text"), F.lit(""))).cast("long"))
    while True:
        cells = rest.groupBy(F.shiftright("_id", shift).alias("_cell")).agg(weight.alias("size"), F.min("_id").alias("low"), F.max("_id").alias("high")).toArrow()
        heavy = pc.and_(pc.greater(cells["size"], 2 * target), pc.less(cells["low"], cells["high"]))
        levels.append((shift, cells.filter(pc.invert(heavy))))
        again = cells.filter(heavy).select(["_cell"])
        if not again.num_rows:
            break
        finer = max(0, shift - max(1, int(np.log2(CELLS / again.num_rows))))
        rest = rest.join(F.broadcast(rows.sparkSession.createDataFrame(again)), F.shiftright("_id", shift) == F.col("_cell"), "left_semi")
        shift = finer
    low = np.concatenate([t["low"].to_numpy() for _, t in levels])
    sizes = np.concatenate([t["size"].to_numpy() for _, t in levels]).astype(np.int64)
    order = np.argsort(low, kind="stable")
    number = np.empty(len(low), np.int32)
    before = np.cumsum(sizes[order]) - sizes[order]
    number[order] = np.unique(before // max(1, target), return_inverse=True)[1]
    found, at, numbers = rows, 0, []
    for k, (shift, table) in enumerate(levels):
        if table.num_rows:
            own = pa.table({f"_cell{k}": table["_cell"], f"_range{k}": pa.array(number[at : at + table.num_rows])})
            at += table.num_rows
            found = found.withColumn(f"_cell{k}", F.shiftright(id_column, shift)).join(F.broadcast(rows.sparkSession.createDataFrame(own)), f"_cell{k}", "left")
            numbers.append(f"_range{k}")
    made = [c for k in range(len(levels)) for c in (f"_cell{k}", f"_range{k}")]
    return found.withColumn(out, F.coalesce(*numbers, F.lit(0))).drop(*made), int(number.max()) + 1


#: Text bytes of the blocks whose hashes meet in one part, about: each block sends a message to each part, so parts are
#: larger than blocks, as far as the memory of one task goes.
PART_BYTES = 32 << 20


def parts_of(blocks: int, block_bytes: int, part_bytes: int = PART_BYTES) -> int:
    """Into how many parts the hashes of so many blocks are dealt."""
    return max(1, min(blocks, -(-blocks * block_bytes // max(1, part_bytes))))
