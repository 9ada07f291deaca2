"""Sources and sinks: text and body columns, compressed bodies, event lines, verdict tables, domain lists, metrics."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
import zlib

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.operators.routing import Registry, valid_domain, within_size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, block: int = 128 << 20) -> DataFrame:
    """`df` over all cores where its files are too small for that: a Parquet file is read by row group, and a small table has
    one. Inputs of a block for each core or more, by the optimizer's estimate, are left as they are: no shuffle at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * block else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local one is made, on a local
    master only: on a cluster each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back.

    Unlike localCheckpoint the files outlive any executor, and unlike an RDD checkpoint they stay columnar, so later
    stages prune columns. As frames are lazy, the files stay until the driver's JVM ends, or until `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, where = _files(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame that no later plan reads (frees the shared folder between rounds)."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, where = _files(df.sparkSession, name)
        fs.delete(where, True)


def texts(spark: SparkSession, path: str, fmt: str = "parquet", key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, column) of any columnar or text source; plain text files give a row a line, with no key."""
    df = spark.read.format(fmt).load(path)
    return df.select(key, column) if key in df.columns else df.select(F.lit(None).cast("long").alias(key), F.col(df.columns[0]).alias(column))


def bodies(df: DataFrame, body: str = "body", most: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """(bodies that are read, bodies over the size limit). Null and empty bodies have no session, and pass."""
    ok = within_size(F.col(body), most)
    return df.where(ok), df.where(~ok)


@F.pandas_udf(T.BinaryType())
def _inflate(data: pd.Series, encoding: pd.Series) -> pd.Series:
    def one(raw: bytes | None, kind: str) -> bytes | None:
        try:
            return raw if raw is None else zlib.decompress(raw, 31 if kind == "gzip" else -15)
        except zlib.error:
            return None

    return pd.Series([one(d, e) for d, e in zip(data, encoding)])


@F.pandas_udf(T.BinaryType())
def compressed(data: pd.Series, encoding: pd.Series) -> pd.Series:
    """gzip or raw deflate of each value, by its encoding; other encodings leave it as it is."""

    def one(raw: bytes | None, kind: str | None) -> bytes | None:
        if raw is None or kind not in ("gzip", "deflate"):
            return raw
        packer = zlib.compressobj(wbits=31 if kind == "gzip" else -15)
        return packer.compress(raw) + packer.flush()

    return pd.Series([one(d, e) for d, e in zip(data, encoding)])


def decompress(df: DataFrame, data: str = "body", encoding: str = "encoding") -> DataFrame:
    """gzip and raw deflate are taken off, and the encoding with them; other encodings stay as they are, and so do bodies
    that are not what their encoding says. Rows that need nothing stay in the JVM."""
    packed = F.coalesce(F.lower(F.col(encoding)).isin("gzip", "deflate"), F.lit(False))
    opened = df.where(packed).withColumn("_open", _inflate(F.col(data), F.lower(F.col(encoding))))
    opened = opened.withColumn(encoding, F.when(F.col("_open").isNull(), F.col(encoding))).withColumn(data, F.coalesce("_open", data)).drop("_open")
    return df.where(~packed).unionByName(opened)


def event_lines(df: DataFrame, body: str = "body", key: str = "stream_id") -> DataFrame:
    """(key, seq, line) of whole event streams in a text column."""
    lines = F.split(F.regexp_replace(F.col(body), "\r\n", "\n"), "\n")
    return df.select(key, F.posexplode(lines).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long"))


class VerdictTable:
    """(original, token) as Parquet parts: reads see the last write of a value, deletes are rows with a null token.

    Each write is a new part under a number of its own, so a failed job leaves the table as it was; parts count once they are
    complete. `compact` folds the parts that stand.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        """Complete parts: v and a number for writes, f for folded ones."""
        fs, folder = _files(self.spark, self.path)
        if not fs.exists(folder):
            return []
        names = [p.getPath().getName() for p in fs.listStatus(folder) if p.isDirectory()]
        return sorted(n for n in names if n[0] in "vf" and fs.exists(_files(self.spark, f"{self.path}/{n}/_SUCCESS")[1]))

    def _last(self, names: list[str]) -> DataFrame:
        parts = self.spark.read.schema("original string, token string, version long").parquet(*(f"{self.path}/{n}" for n in names))
        return parts.groupBy("original").agg(F.max_by("token", "version").alias("token"), F.max("version").alias("version"))

    def _claim(self) -> int:
        """A number that no other writer has: its claim is a file that can be created only once."""
        fs, folder = _files(self.spark, f"{self.path}/_claims")
        fs.mkdirs(folder)
        version = 1 + max((int(p.getPath().getName()) for p in fs.listStatus(folder)), default=0)
        while not self._created(f"{self.path}/_claims/{version:08d}"):
            version += 1
        return version

    def _created(self, path: str) -> bool:
        fs, file = _files(self.spark, path)
        try:
            return fs.createNewFile(file)
        except Py4JJavaError:  # some file systems raise where the file exists
            if fs.exists(file):
                return False
            raise

    def put(self, rows: DataFrame) -> None:
        version = self._claim()
        rows.select("original", F.col("token").cast("string").alias("token"), F.lit(version).cast("long").alias("version")).write.parquet(f"{self.path}/v{version:08d}")

    def delete(self, originals: DataFrame) -> None:
        self.put(originals.select("original", F.lit(None).cast("string").alias("token")))

    def read(self) -> DataFrame:
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], "original string, token string")
        return self._last(names).where("token is not null and token <> ''").select("original", "token")

    def compact(self) -> None:
        """Fold the parts that stand now into one. It keeps each value's version and deletes, so that any mix of old parts, the
        folded one and parts written meanwhile says the same, whatever is removed first."""
        names = self._names()
        if len(names) > 1:
            self._last(names).write.parquet(f"{self.path}/f{uuid.uuid4().hex}")
            for n in names:
                fs, where = _files(self.spark, f"{self.path}/{n}")
                fs.delete(where, True)


def load_domains(spark: SparkSession, path: str, default: list[str]) -> Registry:
    """The saved list, which replaces the default whole; the default where nothing is saved."""
    fs, file = _files(spark, path)
    if not fs.exists(file):
        return Registry(default)
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a list of names that an operator keeps
    return Registry(json.loads(text))


def save_domains(spark: SparkSession, path: str, registry: Registry) -> None:
    """A sorted JSON array, written aside and renamed over the old list in one step: readers see the old list or the new one."""
    jvm = spark.sparkContext._jvm
    fs, file = _files(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(registry.all(), indent=2).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    full = file.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside.makeQualified(fs.getUri(), fs.getWorkingDirectory()), full, how)


def valid_domains(domains: DataFrame) -> DataFrame:
    return domains.where(valid_domain(F.col("domain")))


def as_json(column: str, *fields: str) -> Column:
    return F.to_json(F.struct(*fields)).alias(column)


def status(registry: Registry, packs: list[str]) -> str:
    """Health and configuration as one JSON document."""
    return json.dumps({"status": "ok", "domains": registry.all(), "packs": packs})
