"""Shared helpers: word splitting, stable vectorised hashing, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words everywhere in this package are maximal runs of characters other than
# space and U+0009..U+000D.  ``bytes.split()`` without arguments splits on
# exactly that set, also inside UTF-8 text.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# What one worker remembers: at most so many words of at most so many bytes, some 30 MB.
_MEMO_LIMIT, _MEMO_WORD = 150_000, 64
# Arrow batches between Spark and Python, and the pieces that are worked on at a time.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 1000, 4 << 20, 1 << 20


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; a null text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


class HashMemo(dict):
    """Stable 64-bit hashes of byte strings, remembered up to a bounded count; long strings are not kept."""

    def __init__(self, seed: int = 0, limit: int = _MEMO_LIMIT):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= _MEMO_WORD:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _odd(seed: int, count: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def compose(parts: np.ndarray, count: int, stride: int, seed: int) -> np.ndarray:
    """Hashes of ``count`` consecutive parts, ``stride`` positions apart.

    With ``parts[i]`` the hash of words ``i .. i+stride-1`` the result at ``i``
    stands for words ``i .. i+count*stride-1``.
    """
    n = len(parts) - (count - 1) * stride
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = _odd(seed, count)
    out = parts[:n] * factors[0]
    for j in range(1, count):
        out += parts[j * stride : j * stride + n] * factors[j]
    return mix(out)


def ngram_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit hashes of all n-grams of a word-hash array."""
    return compose(words, n, 1, seed)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small: by default a batch is 10,000 rows, whatever their texts weigh."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Returns freed memory to the system, as a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Runs ``make()`` once per task and its result on pieces of every Arrow batch.

    Batches hold at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``, pieces about
    ``SLICE_BYTES``, so that a run of very long texts does not meet in one working
    set.  A single longer text is a piece by itself.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
        del work
        give_back()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, target: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of roughly ``target`` bytes."""
    if batch.num_rows == 0:
        return
    each = max(1, int(batch.num_rows * target / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def nested(batch: pa.RecordBatch, name: str) -> Iterator[dict[str, np.ndarray]]:
    """A column of arrays of structs of numbers as flat arrays, one dict per row; null is empty."""
    lists = batch.column(batch.schema.get_field_index(name))
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()
    fields = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    at = 0
    for n in sizes.tolist():
        yield {k: v[at : at + n] for k, v in fields.items()}
        at += n


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_NUMBER = itertools.count()
_WRITTEN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir.

    Only a local master may do without; its own temporary folder is set then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = hadoop.get() if hadoop.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it back.

    Cuts lineage and keeps Python stages from being run once per use; the
    written files survive the loss of any executor.  They are removed when the
    application ends, or by ``scratch_freed``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}-{next(_NUMBER)}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _hadoop(spark, path)
    files.deleteOnExit(where)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def scratch_freed(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables written inside, but for the last one, which is the result."""
    first = len(_WRITTEN)
    yield
    while len(_WRITTEN) > first + 1:
        where, files = _hadoop(spark, _WRITTEN.pop(first))
        files.delete(where, True)


def discard(table: DataFrame) -> None:
    """Removes the scratch table that ``materialize`` returned as ``table``."""
    folder = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else ""
    for path in [p for p in _WRITTEN if folder.endswith(p.split(":", 1)[-1])]:
        _WRITTEN.remove(path)
        where, files = _hadoop(table.sparkSession, path)
        files.delete(where, True)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def attach(docs: DataFrame, facts: DataFrame, id_col: str, text_col: str, names: list[str], how: str = "left", once: bool = False) -> DataFrame:
    """``docs`` with the columns ``names`` of ``facts``, which is keyed by id and text_key.

    ``id`` and ``text_key`` (a hash of the text) tell rows apart even where ids
    repeat; columns come under ``__qg_`` names, so they clash with none.  With
    ``once``, of rows that agree in id and text one stays.
    """
    own = facts.select(F.col("id").alias("__qg_id"), F.col("text_key").alias("__qg_text_key"), *[F.col(n).alias(f"__qg_{n}") for n in names])
    keyed = docs.withColumn("__qg_key", F.xxhash64(F.col(f"`{text_col}`")))
    joined = keyed.join(own, (keyed[f"`{id_col}`"] == own["__qg_id"]) & (keyed["__qg_key"] == own["__qg_text_key"]), how)
    if once:
        joined = joined.dropDuplicates(["__qg_id", "__qg_text_key"])
    return joined.drop("__qg_key", "__qg_id", "__qg_text_key")


def with_text(batch: pa.RecordBatch, text_col: str, texts: list, length_col: str | None) -> pa.RecordBatch:
    """The batch with new texts; an integer ``length_col`` is counted anew where it was not null."""
    at = batch.schema.get_field_index(text_col)
    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    k = batch.schema.get_field_index(length_col) if length_col else -1
    if k >= 0 and pa.types.is_integer(batch.schema.field(k).type):
        new = [o if t is None or o is None else len(t) for t, o in zip(texts, batch.column(k).to_pylist(), strict=True)]
        batch = batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))
    return batch
