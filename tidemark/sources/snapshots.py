"""Published tables as immutable versions under one pointer: readers see a whole version, whatever a publish does meanwhile.

    table/versions/<name>/part-...      written once, never changed
    table/pointers/00000007.json        which version is the seventh; the highest complete one counts

A publish writes its version, then creates the pointer that follows the one it started from. Creating fails if another publish
was faster, and then nothing has changed for anyone. A publish that dies leaves files that no pointer names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import fingerprint


class Conflict(Exception):
    """Another publish came first: read again, and publish what follows from that."""


class _Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm, self.path = spark, spark._jvm, path.rstrip("/")
        self.files = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def text(self, path) -> str:
        stream = self.files.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def pointers(self) -> list[tuple[int, dict]]:
        """Complete pointers from the newest on; one that is still being written isn't there yet."""
        folder, found = self.at("pointers"), []
        if not self.files.exists(folder):
            return []
        for name in sorted((s.getPath().getName() for s in self.files.listStatus(folder)), reverse=True):
            if name.endswith(".json"):
                try:
                    found.append((int(name[:-5]), json.loads(self.text(self.at(f"pointers/{name}")))))
                except ValueError:
                    continue
        return found

    def point(self, number: int, entry: dict) -> None:
        path = self.at(f"pointers/{number:08d}.json")
        try:
            stream = self.files.create(path, False)
        except Exception as e:
            if self.files.exists(path):
                raise Conflict(f"{self.path}: version {number} has been published meanwhile") from e
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()


def current(spark: SparkSession, path: str) -> dict | None:
    """number, version, schema and fingerprint of the newest version; None where nothing has been published."""
    found = _Store(spark, path).pointers()
    return {"number": found[0][0], **found[0][1]} if found else None


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest version, or the one of a number. The frame keeps to it, though others are published later."""
    found = {n: e for n, e in _Store(spark, path).pointers()}
    if not found or (number is not None and number not in found):
        raise FileNotFoundError(f"{path}: no version {number or ''}")
    entry = found[max(found) if number is None else number]
    return spark.read.schema(entry["schema"]).parquet(f"{path.rstrip('/')}/versions/{entry['version']}")


def publish(df: DataFrame, path: str, based_on: int | None = None, before_pointing: Callable[[], None] | None = None) -> dict | None:
    """Publish `df` as the next version; None, and no change, if rows and schema are those of the newest one.

    `based_on`: the number that the content follows from (default: the newest as this call begins; 0: none yet). If there
    is a newer one, or one appears before the pointer is created, Conflict is raised. `before_pointing` runs when the version
    is written but not visible yet (a last check may raise).
    """
    spark = df.sparkSession
    store = _Store(spark, path)
    newest = store.pointers()
    number = newest[0][0] if newest else 0
    if based_on is not None and based_on != number:
        raise Conflict(f"{path}: based on version {based_on}, the newest is {number}")
    version = uuid.uuid4().hex
    place = f"{store.path}/versions/{version}"
    try:
        df.write.parquet(place)
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        told = {k: str(v) for k, v in fingerprint(spark.read.schema(schema).parquet(place)).first().asDict().items()}
        entry = {"version": version, "schema": schema, "fingerprint": told}
        if newest and all(newest[0][1][k] == entry[k] for k in ("schema", "fingerprint")):
            store.files.delete(store.at(f"versions/{version}"), True)
            return None
        if before_pointing:
            before_pointing()
        store.point(number + 1, entry)
    except BaseException:
        store.files.delete(store.at(f"versions/{version}"), True)
        raise
    return {"number": number + 1, **entry}


def prune(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Delete all but the newest `keep` versions, pointers first; says which numbers went. Readers of those fail."""
    store = _Store(spark, path)
    gone = store.pointers()[max(1, keep) :]
    for number, entry in gone:
        store.files.delete(store.at(f"pointers/{number:08d}.json"), False)
        store.files.delete(store.at(f"versions/{entry['version']}"), True)
    return sorted(n for n, _ in gone)


def publish_partitions(df: DataFrame, path: str, by: Sequence[str]) -> dict[str, list]:
    """Bring a partitioned table up to `df`, writing only partitions whose rows differ: {changed: [...], removed: [...]}.

    Fingerprints by partition tell which; they add up, so that those of a table follow from those of its partitions. Files of
    other partitions stay as they are. Each partition changes by itself: for a table that changes at once use `publish`.
    """
    spark, by = df.sparkSession, list(by)
    store = _Store(spark, path)
    new = fingerprint(df, by).withColumn("_new", F.lit(1))
    if not store.files.exists(store.at("")):
        df.write.partitionBy(*by).parquet(path)
        return {"changed": [tuple(r) for r in new.select(*by).collect()], "removed": []}
    old = fingerprint(spark.read.schema(df.schema).parquet(path), by)
    told = [c for c in old.columns if c not in by]
    keyed = lambda x, tag: x.select(F.struct(*by).alias("_k"), F.struct(*told).alias(tag))
    both = keyed(new, "n").join(keyed(old, "o"), "_k", "full_outer").where(~F.col("n").eqNullSafe(F.col("o")))
    rows = both.select("_k", F.col("n").isNull().alias("gone")).collect()  # one row for a partition
    changed, removed = ([tuple(r._k) for r in rows if r.gone is gone] for gone in (False, True))
    if changed:
        wanted = spark.createDataFrame(changed, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by))
        same = [df[c].eqNullSafe(wanted[c]) for c in by]
        df.join(F.broadcast(wanted), same, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for values in removed:
        name = "/".join(utils.getPartitionPathString(c, None if v is None else str(v)) for c, v in zip(by, values, strict=True))
        store.files.delete(store.at(name), True)
    return {"changed": changed, "removed": removed}
