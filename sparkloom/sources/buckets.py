"""A table in buckets by key, merged without rewriting it: a batch rewrites the buckets in which it changes something, and is committed by one rename.

``path/versions/<n>.json`` lists the folder of each bucket's files; readers take the last one, so they see a whole version or the one before. Files are written once, under a name of their own, and never changed. Two writers of one version can't both commit: the second
rename fails, and its files are left for ``cleared``. A batch with a number that is already in is passed over, and rows that are there as they are change nothing, so a batch may be repeated either way.

Defined results. Rows without a key are left out; of several rows of one key in a batch the last by ``order`` counts. A batch may bring fewer columns (null, then) but no new ones. A new table starts with its first batch, an empty one too.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import dedup
from sparkloom.session import cut

BUCKET = "_bucket"


@dataclass
class Version:
    """What one version consists of. ``batch`` is the highest batch number that is in."""

    number: int
    key: str
    buckets: int
    schema: str
    batch: int | None = None
    files: dict[str, str] = field(default_factory=dict)


class Folder:
    """The files of a path on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.kind = jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self.files = self.kind(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str) -> list[str]:
        at = self.kind(f"{self.path}/{below}")
        return [x.getPath().getName() for x in self.files.listStatus(at)] if self.files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.kind(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file that is whole or not there; False if another has put it before."""
        to, fresh = self.kind(f"{self.path}/{name}"), self.kind(f"{self.path}/{name}.{uuid.uuid4().hex}.new")
        self.files.mkdirs(to.getParent())
        stream = self.files.create(fresh, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.files.exists(to) and self.files.rename(fresh, to):
            return True
        self.files.delete(fresh, False)
        return False

    def drop(self, name: str) -> None:
        self.files.delete(self.kind(f"{self.path}/{name}"), True)


def versions(folder: Folder) -> list[int]:
    return sorted(int(x[:-5]) for x in folder.names("versions") if x.endswith(".json"))


def latest(spark: SparkSession, path: str) -> Version | None:
    folder = Folder(spark, path)
    found = versions(folder)
    return Version(**json.loads(folder.read(f"versions/{found[-1]}.json"))) if found else None


def read(spark: SparkSession, path: str, version: Version | None = None, only: list[str] | None = None) -> DataFrame:
    """The last version, or the one given; ``only`` some of its buckets."""
    version = version or latest(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    wanted = [f"{path}/{where}" for bucket, where in version.files.items() if only is None or bucket in only]
    return spark.read.schema(version.schema).parquet(*wanted) if wanted else spark.createDataFrame([], version.schema)


def merge(new: DataFrame, path: str, key: str, order: str | None = None, batch: int | None = None, buckets: int = 64) -> Version:
    """Upsert a batch, and give the version that has it: the last one where nothing changes. ``buckets`` counts for a new table only."""
    spark = new.sparkSession
    path = path.rstrip("/")
    old = latest(spark, path)
    if old and batch is not None and old.batch is not None and batch <= old.batch:
        return old
    if old is None:
        schema = new.schema
        old = Version(-1, key, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
    empty = spark.createDataFrame([], old.schema)
    if old.key != key or set(new.columns) - set(empty.columns):
        raise ValueError(f"the table has the key {old.key} and the columns {empty.columns}")
    rows = dedup.last_by(empty.unionByName(new, allowMissingColumns=True), key, order or key)
    bucket = F.pmod(F.xxhash64(key), F.lit(old.buckets)).cast("string")
    rows = cut(rows.withColumn(BUCKET, bucket))
    # As many as the table has buckets.
    met = [r[0] for r in rows.select(BUCKET).distinct().collect()]
    held = read(spark, path, old, met).withColumn(BUCKET, bucket)
    columns = [F.col(c) for c in empty.columns]
    changed = cut(rows.withColumn("_h", F.xxhash64(*columns)).join(held.withColumn("_h", F.xxhash64(*columns)).select(key, "_h"), [key, "_h"], "left_anti").drop("_h"))
    touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())
    if not touched and (old.number >= 0 and batch is None):
        return old
    files = dict(old.files)
    if touched:
        made = dedup.upsert(held.where(F.col(BUCKET).isin(touched)), changed, key)
        where = f"data/{uuid.uuid4().hex}"
        # A bucket is one file: keys are dealt by their hash, so buckets are of a size.
        made.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{where}")
        files |= {b: f"{where}/{BUCKET}={b}" for b in touched}
    found = Version(old.number + 1, key, old.buckets, old.schema, batch if batch is not None else old.batch, files)
    if not Folder(spark, path).put(f"versions/{found.number}.json", json.dumps(found.__dict__)):
        raise RuntimeError(f"another writer has committed version {found.number} of {path}")
    return found


def cleared(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Drop all but the last ``keep`` versions, and files that none of those has; how many folders went. Only while nobody writes."""
    folder = Folder(spark, path)
    known = versions(folder)
    used = {where.rsplit("/", 1)[0] for n in known[-keep:] for where in json.loads(folder.read(f"versions/{n}.json"))["files"].values()}
    gone = [x for x in folder.names("data") if f"data/{x}" not in used]
    for n in known[:-keep]:
        folder.drop(f"versions/{n}.json")
    for x in gone:
        folder.drop(f"data/{x}")
    return len(gone)
