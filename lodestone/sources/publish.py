"""Publishing: table folders, generations by content hash with a pointer, JSON lines, packages, shards, prompt files.

A generation is a folder named by the hash of what it is made of. The pointer to the active one is written last, so a
reader sees the old tables or the new, never a mixture, and a build that is lost halfway leaves the pointer alone.
"""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from ..operators.gates import Incomplete, check

POINTER = "active.json"
#: Timestamps in packages, so that equal contents make equal files.
ZIP_TIME = (1980, 1, 1, 0, 0, 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; any folder where both are one machine."""
    named, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or held.isDefined():
        return named or held.get()
    if spark.sparkContext.master.startswith("local["):
        import tempfile

        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodestone-')}")
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, name)
    return fs.exists(path)


def write_tables(tables: dict[str, DataFrame], folder: str, partitions: dict[str, list[str]] | None = None) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partitions or {}).get(name, [])).parquet(f"{folder}/{name}")


def open_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables to read; an error names those that are missing."""
    missing = [n for n in names if not exists(spark, f"{folder}/{n}")]
    if missing:
        raise FileNotFoundError(f"{folder} has no {', '.join(missing)}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_lines(df: DataFrame, folder: str) -> None:
    """One canonical JSON object a line."""
    df.select(canonical_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


def portable(value: object, dropped: tuple[str, ...] = ("path", "root", "cache_dir", "generated_at")) -> object:
    """A JSON value without what depends on the machine."""
    if isinstance(value, dict):
        return {k: portable(v, dropped) for k, v in value.items() if k not in dropped}
    return [portable(v, dropped) for v in value] if isinstance(value, list) else value


def generation(corpus_hash: str, spec: dict, selection: str) -> str:
    """The name of what is made of a corpus under a specification, wherever that happens."""
    text = json.dumps([corpus_hash, portable(spec), selection], ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def _write_text(spark: SparkSession, name: str, text: str) -> None:
    """Writes a small file beside its name and renames it."""
    path, fs = _path(spark, name)
    new, _ = _path(spark, f"{name}.next")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(path, False)
    fs.rename(new, path)


def _read_text(spark: SparkSession, name: str) -> str:
    return "\n".join(r.value for r in spark.read.text(name, wholetext=True).collect())


def publish(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], manifest: dict, required: list[str] = (), activate: bool = True) -> str:
    """Writes a generation's tables and manifest, then the pointer; a required table that is empty stops it before."""
    folder = f"{root}/{name}"
    write_tables(tables, folder)
    written = open_tables(spark, folder, list(tables))
    empty = [t for t in required if written[t].isEmpty()]
    if empty:
        raise Incomplete("publish", empty)
    _write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True, ensure_ascii=False))
    if activate:
        _write_text(spark, f"{root}/{POINTER}", json.dumps({"generation": name}))
    return folder


def active(spark: SparkSession, root: str, names: list[str], expected: dict | None = None) -> dict[str, DataFrame]:
    """Tables of the active generation; an error if it was made of another corpus or by another model than expected."""
    if not exists(spark, f"{root}/{POINTER}"):
        raise FileNotFoundError(f"{root} has no active generation")
    folder = f"{root}/{json.loads(_read_text(spark, f'{root}/{POINTER}'))['generation']}"
    manifest = json.loads(_read_text(spark, f"{folder}/manifest.json"))
    stale = [k for k, v in (expected or {}).items() if manifest.get(k) != v]
    if stale:
        raise ValueError(f"the index is of another {', '.join(stale)}")
    return open_tables(spark, folder, names)


def merged_shards(seeds: DataFrame, shards: DataFrame, key: str, draft: Column) -> DataFrame:
    """Units of seeds and shards without drafts; a shard's unit replaces the seed's; the same unit in two shards is an error."""
    own = shards.where(~F.coalesce(draft, F.lit(False)))
    check("repeated units", own.groupBy(key).count().where("count > 1"))
    return own.unionByName(seeds.join(own.select(key), key, "left_anti"), allowMissingColumns=True)


def replicas(df: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """n copies of each row with ids and groups of their own, the first as it is; for measuring growth."""
    copies = df.sparkSession.range(n).withColumnRenamed("id", "_copy")
    name = lambda c: F.when(F.col("_copy") == 0, F.col(c).cast("string")).otherwise(F.concat(F.col(c).cast("string"), F.lit("#"), F.col("_copy")))
    return df.crossJoin(F.broadcast(copies)).withColumns({key: name(key), group: name(group)}).drop("_copy")  # n numbers


def package(root: Path, names: list[str], out: Path) -> str:
    """A zip of files under root, the same bytes for the same contents; its hash."""
    root = root.resolve()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name in sorted(set(names)):
            path = (root / name).resolve()
            if not path.is_relative_to(root):
                raise ValueError(f"{name} is outside of the folder")
            info = zipfile.ZipInfo(PurePosixPath(path.relative_to(root)).as_posix(), ZIP_TIME)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, path.read_bytes())
    return hashlib.sha256(out.read_bytes()).hexdigest()


def restore(file: Path, sha256: str, root: Path) -> list[str]:
    """Unpacks a package of that hash; nothing is written outside of root or over a file that differs."""
    if hashlib.sha256(file.read_bytes()).hexdigest() != sha256:
        raise ValueError("the package has another hash")
    root, todo = root.resolve(), []
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            path = (root / info.filename).resolve()
            if not path.is_relative_to(root):
                raise ValueError(f"{info.filename} leaves the folder")
            data = z.read(info)
            if path.exists() and path.read_bytes() != data:
                raise ValueError(f"{info.filename} has been changed")
            todo.append((path, data))
    for path, data in todo:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return [p.relative_to(root).as_posix() for p, _ in todo]


def prompt_page(spark: SparkSession, root: str, name: str, hashes: dict[str, str], offset: int = 0, size: int = 40_000) -> DataFrame:
    """A page of a prompt file: text, has_more, next_offset, total. The file must be in the manifest and have its hash."""
    if name not in hashes or ".." in PurePosixPath(name).parts or not name.endswith(".md"):
        raise ValueError("no such prompt")
    df = spark.read.text(f"{root}/{name}", wholetext=True)
    if df.select(F.sha2("value", 256)).first()[0] != hashes[name]:
        raise ValueError("the prompt has been changed")
    n, end = F.char_length("value"), offset + size
    return df.select(F.substring("value", offset + 1, size).alias("text"), (n > end).alias("has_more"), F.when(n > end, F.lit(end)).alias("next_offset"), n.alias("total"))


def cleanup(root: Path, old: list[str], new: list[str]) -> list[str]:
    """Removes files that an old manifest lists and a new one doesn't; only those, and only under root."""
    root, gone = root.resolve(), []
    for name in sorted(set(old) - set(new)):
        path = (root / name).resolve()
        if path.is_relative_to(root) and path.is_file():
            path.unlink()
            gone.append(name)
    return gone


def archive(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, sha256, text of files that match, each content once (under its first path)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    own = files.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    return own.groupBy("sha256").agg(F.min("path").alias("path"), F.first("text").alias("text"))
