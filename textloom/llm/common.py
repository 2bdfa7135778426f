"""What several of these operators share: tables, the shared scratch folder, Arrow batches, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the class [\x20\x09-\x0D]; what bytes.split() splits at.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns each ASCII character but letters and digits into a space.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one setting that is to grow with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder; a cluster session is refused, since
    executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later steps survive lost executors
    and don't compute it twice."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/textloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let at most `most` bytes of rows (one row at least) go to Python at once. The session's 10,000 rows are
    tens of MB of texts, which an executor holds several times for each task, in Python and outside its heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), null texts as empty; other columns are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def pairs(batches: Iterable[pa.RecordBatch], as_bytes: bool = True) -> Iterator[tuple[int | None, bytes | str]]:
    """(first column, second column) of each row; the text as UTF-8 bytes or as str."""
    for b in batches:
        col = b.column(1)
        if as_bytes:
            col = col.cast(pa.large_binary())
        yield from zip(b.column(0).to_pylist(), col.to_pylist(), strict=True)


def blocks(rows: Iterable[tuple], weight, most: int) -> Iterator[list[tuple]]:
    """Consecutive rows, as many as weigh at most `most` together, one at least."""
    held, load = [], 0
    for r in rows:
        w = weight(r)
        if held and load + w > most:
            yield held
            held, load = [], 0
        held.append(r)
        load += w
    if held:
        yield held


def held_out(modulus: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word. Hashing is quicker than a look-up in a large table, and holds no memory."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
