"""What the operators of this package share: written tables, words, bounded broadcasts."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words; everything else (0-9, a-z, and all of UTF-8's multi-byte letters) belongs to one.
_WORD_BYTE = [48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)]
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if _WORD_BYTE[c] else 32 for c in range(256))
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def word_bytes(text: str | None) -> list[bytes]:
    """Words of letters, digits and all non-ASCII characters, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def words(text: str | None) -> list[str]:
    found = word_bytes(text)
    return b" ".join(found).decode().split(" ") if found else []


class Held(dict):
    """Values of a function of strings or bytes, held for at most `size` short keys; when full it begins anew."""

    def __init__(self, make: Callable, size: int = 150_000, longest: int = 64):
        self.make, self.size, self.longest = make, size, longest

    def __missing__(self, key):
        out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[key] = out
        return out


def slices(batches: Iterator[pa.Array], rows: int = 256) -> Iterator[pa.Array]:
    """Small parts of Arrow batches: what Python holds of them at a time stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch[at : at + rows]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that the session's context has set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or held.isDefined():
        return named or held.get()
    if spark.sparkContext.master.startswith("local["):  # one machine, as in tests: any folder is shared
        import tempfile

        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodestone-')}")
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


@contextlib.contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (with _ for .) for the time of one job."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a batch for Python at most: texts may be long, and executors hold a batch or two of each task.
BATCH = 512


def bounded_batches(df: DataFrame) -> None:
    """From now on the session hands Python batches of BATCH rows at most; for results that are computed when they are read."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(conf.get(name))
    if held <= 0 or held > BATCH:
        conf.set(name, str(BATCH))


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    Cuts the lineage, so that a lost executor costs the tasks it ran and not what came before, and fixes what
    a later retry reads. The job's shuffle files go when it ends. Batches for Python are small, as texts may be long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    with setting(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_execution_arrow_maxRecordsPerBatch=str(BATCH)):
        df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; what was made from them must be written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % m, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out_mod: int, held_out: int, bound: int) -> DataFrame:
    """Texts of at most `bound` labelled documents outside the held-out fold, with their label as y, as a written table.

    The bound is on label rows (the smallest hashes of doc_id), so what is broadcast has a fixed size, and one text
    counts for each id. Rows with a null id or label don't count; an id that carries several labels counts with its
    smallest, and one that carries several texts with the smallest of them.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isNotNull())
        .where(crc32_mod(F.col("_id"), held_out_mod) != held_out)
        .orderBy(F.xxhash64("_id"), "_id", "y")
        .limit(bound)
        .groupBy("_id")
        .agg(F.min("y").alias("y"))
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text"))
    return keep(texts.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("y").alias("y"), F.min("text").alias("text")), "sample")
