"""Helpers shared by the operators: shared-folder tables and Arrow batch loops."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text that a Python worker handles at a time.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20
#: Bytes of encoded texts and their ids that a worker keeps before it encodes more.
KNOWN_BYTES = 96 << 20
#: Seconds without a task of an operator, after which tasks of others drop what it keeps in a worker.
IDLE_S = 10
#: Functions whose last result this worker keeps for later tasks (of lru_cache), and when a task last used it.
_used: dict[Callable, float] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and all of Spark runs here (as in tests) a folder of this machine is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/hearweave/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and is computed once,
    and a lost executor loses nothing of it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored has made, once all that is read from them is stored too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let_go(but: Callable | None = None) -> None:
    """Drops what this worker keeps for operators that have had no task here for IDLE_S, and returns the memory to
    the system. but is in use: what it keeps stays."""
    now = time.monotonic()
    if but is not None:
        _used[but] = now
    idle = [f for f, at in _used.items() if f is not but and now - at >= IDLE_S]
    for f in idle:
        f.cache_clear()
        del _used[f]
    if idle:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def slices(
    batches: Iterable[pa.RecordBatch], column: str, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES, keeps: Callable | None = None
) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds most_rows rows and about most_bytes of column at most
    (one row may be larger). keeps: see let_go."""
    for batch in batches:
        let_go(keeps)
        start, size = 0, 0
        values = batch.column(column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        lengths = pc.fill_null(measure(values), 0).to_pylist()
        for k, n in enumerate(lengths):
            if k > start and (size + n > most_bytes or k - start >= most_rows):
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def appended(batch: pa.RecordBatch, drop: Iterable[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch without the columns in drop, and with new ones after it."""
    gone = set(drop)
    kept = [k for k, n in enumerate(batch.schema.names) if n not in gone]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(k) for k in kept), *new.values()], names=[*(batch.schema.names[k] for k in kept), *new]
    )


def with_columns(
    df: DataFrame, text: str, make: Callable[[], Callable], schema: str, drop: tuple[str, ...] = (), arrow: bool = False, keeps: Callable | None = None
) -> DataFrame:
    """df with columns made from text by a function over lists of values (with arrow: over Arrow arrays).

    make() runs once in each task and returns the function: values (str, bytes or None) to
    {name: list or Arrow array}, as named in schema. Columns of df with these names are replaced.
    keeps: the function whose result make() uses and later tasks of the worker go on with, if any.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    gone = {*drop, *fields.names}
    out = StructType([f for f in df.schema.fields if f.name not in gone] + fields.fields)
    types = {f.name: f.type for f in to_arrow_schema(fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches, text, keeps=keeps):
            made = function(batch.column(text) if arrow else batch.column(text).to_pylist())
            let_go(keeps)
            arrays = {n: v if isinstance(v, pa.Array) else pa.array(v, types[n]) for n, v in made.items()}
            yield appended(batch, gone, {n: arrays[n] for n in fields.names})

    return df.mapInArrow(run, out)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of flat at starts, of sizes, one after the other."""
    after = np.cumsum(sizes)
    return flat[np.arange(after[-1] if len(after) else 0) + np.repeat(starts - (after - sizes), sizes)]


class Known:
    """Texts that have been encoded, and their ids in one table; make gives ids and their numbers for new texts."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.names, self.flat, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def bounded(self, most: int) -> None:
        """Drops all, if there are more than most texts or KNOWN_BYTES of them and their ids."""
        if len(self.names) > most or self.names.nbytes + self.flat.nbytes > KNOWN_BYTES:
            self.clear()

    def rows(self, names: pa.Array) -> np.ndarray:
        """The row of each of names, which are all different."""
        found = pc.index_in(names, value_set=self.names)
        new = names.filter(found.is_null())
        if len(new):
            flat, sizes = self.make(new)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
            self.names = pa.concat_arrays([self.names, new])
        rows = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        rows[rows < 0] = np.arange(len(self.names) - len(new), len(self.names))
        return rows

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.ends[rows + 1] - self.ends[rows]
        return gathered(self.flat, self.ends[rows], sizes), sizes
