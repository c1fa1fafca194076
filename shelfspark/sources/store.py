"""Parquet tables of a collection, in versions: a merge writes a new folder and then the pointer to it."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, empty

#: Pointers are numbered and never replaced: the highest one holds, so no crash leaves the store without one.
_POINTER = "CURRENT-"


def _shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session within one machine may do without the setting."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shelfspark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder; lineage ends there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for rounds: a checkpoint remembers how its rows were dealt out, and with joins in every round that doubles each time."""
    path = f"{_shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm, p


def _newest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and name of the highest pointer; 0 without one."""
    fs, _, p = _fs(spark, folder)
    if not fs.exists(p):
        return 0, None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = max((n for n in names if n.startswith(_POINTER) and n[len(_POINTER) :].isdigit()), default=None)
    return (int(found[len(_POINTER) :]), found) if found else (0, None)


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version that the newest pointer names."""
    _, name = _newest(spark, folder)
    return f"{folder}/{spark.read.text(f'{folder}/{name}').first()[0]}" if name else None


class Tables(dict):
    """Tables by name with the number of the version that they were read from, which `|` keeps."""

    def __init__(self, tables=(), version: int = 0):
        super().__init__(tables)
        self.version = version

    def __or__(self, other) -> Tables:
        return Tables({**self, **other}, self.version)


#: Tables of paths are kept in so many buckets by a hash of the path.
BUCKETS = 64


def bucket_of(path="path"):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _bucketed(name: str) -> bool:
    return TABLES.get(name, "").startswith("path ") or name == "files"


def _manifest(spark: SparkSession, at: str) -> dict[str, dict[str, str]]:
    """table -> bucket (empty for a table without paths) -> folder below the store's; a version without a manifest has whole tables."""
    fs, _, p = _fs(spark, f"{at}/MANIFEST")
    if fs.exists(p):
        return json.loads("".join(r[0] for r in spark.read.text(f"{at}/MANIFEST").collect()))
    names = [n for n in TABLES if fs.exists(_fs(spark, f"{at}/{n}")[2])]
    return {n: {"": f"{at.rpartition('/')[2]}/{n}"} for n in names}


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """The tables of the newest version; the result knows its number."""
    number, name = _newest(spark, folder)
    if name is None:
        return Tables()
    at = f"{folder}/{spark.read.text(f'{folder}/{name}').first()[0]}"
    out = {}
    for table, parts in _manifest(spark, at).items():
        out[table] = spark.read.schema(TABLES[table]).parquet(*[f"{folder}/{p}" for _, p in sorted(parts.items())]) if parts else empty(spark, table)
    return Tables(out, number)


def _write_text(spark: SparkSession, path: str, text: str):
    fs, _, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return fs, p


def _claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file that must not be there yet; of any number of writers one succeeds. A file system's link or rename without overwriting decides, not a look beforehand."""
    fs, new = _write_text(spark, f"{path.rpartition('/')[0]}/_new-{uuid.uuid4().hex}", text)
    jvm, target = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        if fs.getUri().getScheme() == "file":
            files, bare = jvm.java.nio.file, lambda p: jvm.java.nio.file.Path.of(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            files.Files.createLink(bare(target), bare(new))
            fs.delete(new, False)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, target, none)
    except Py4JJavaError as e:
        fs.delete(new, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def write_tables(spark: SparkSession, folder: str, tables: dict[str, DataFrame], base: int | None = None, touched: DataFrame | None = None) -> str:
    """The tables as a new version after version `base`; readers of the old one are not disturbed.

    base is the version that the tables were read from, by default what read_tables noted, or for a plain dict the newest
    one. If another writer has made a version since, RuntimeError is raised and nothing has changed. touched (path) says
    which paths may differ from version base: only their buckets are written, the manifest names the others' folders
    as they are. A crash before the pointer is made leaves the old version in force.
    """
    number, name = _newest(spark, folder)
    base = getattr(tables, "version", number) if base is None else base
    if base != number:
        raise RuntimeError(f"version {base} of {folder} was read, {number} is the newest")
    version = f"v-{uuid.uuid4().hex}"
    old = _manifest(spark, f"{folder}/{spark.read.text(f'{folder}/{name}').first()[0]}") if name and touched is not None else {}
    hit = None if touched is None else sorted(r[0] for r in touched.select(bucket_of()).distinct().collect())  # BUCKETS at most
    manifest: dict[str, dict[str, str]] = {}
    for table, df in tables.items():
        at = f"{version}/{table}"
        if not _bucketed(table):
            df.write.parquet(f"{folder}/{at}")
            manifest[table] = {"": at}
            continue
        kept = {b: p for b, p in old.get(table, {}).items() if b and int(b) not in (hit or ())}
        rows = df.withColumn("__bucket", bucket_of())
        rows = rows if hit is None or "" in old.get(table, {}) or table not in old else rows.where(F.col("__bucket").isin(hit))
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{folder}/{at}")
        fs, _, p = _fs(spark, f"{folder}/{at}")
        made = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        manifest[table] = kept | {n.partition("=")[2]: f"{at}/{n}" for n in made}
    _write_text(spark, f"{folder}/{version}/MANIFEST", json.dumps(manifest))
    if not _claimed(spark, f"{folder}/{_POINTER}{number + 1:020d}", version):
        raise RuntimeError(f"another writer made version {number + 1} of {folder}")
    return version
