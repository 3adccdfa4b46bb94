"""Upserts, cascading deletes and appends on plain Parquet, a partition at a time. There is no MERGE without a table format."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.schema import CASCADES, TABLES


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; below a new local one where that isn't
    set and all executors run in the driver (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("postmill.scratch.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("postmill.scratch.dir", where)
    return f"{where.rstrip('/')}/postmill/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read again, so that what follows sees one and the same table."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with the rows of each key side by side in one partition, in the given order.

    They are dealt by a hash that no join has: behind a join on the keys themselves Spark takes the join's partitions, of
    which it splits the large ones."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the table with the given keys (all columns of `keys`): point lookups as one join."""
    return table.join(keys.distinct(), keys.columns, "left_semi")


def folded(delta: DataFrame, keys: list[str], order: list[str], coalesced: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key, as if delta's rows had been put in one after the other in the given order: the last row,
    but in `coalesced` columns the last value that isn't null. Columns of the order go; sums in place of windows, so
    rows of one key are combined before they are shuffled."""
    rest = [c for c in delta.columns if c not in keys and c not in order and c not in coalesced]
    place = F.struct(*order)
    last = F.max_by(F.struct(*[F.col(c) for c in rest]), place).alias("__row")
    kept = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__value"))))["__value"].alias(c) for c in coalesced]
    out = delta.groupBy(*keys).agg(last, *kept)
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest], *coalesced)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], untouched: tuple[str, ...] = (), coalesced: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """base with delta's rows in place of those of the same key (nulls equal); delta must have one row a key.

    New values replace old ones, nulls too, but for `coalesced` columns, which keep the old value against a null;
    `untouched` columns keep the old value always, `first` ones wherever it isn't null.
    """
    b, d = base.alias("b"), delta.withColumn("__new", F.lit(True)).alias("d")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    new = F.col("d.__new").isNotNull()

    def pick(c: str):
        if c not in delta.columns or c in untouched:
            return F.col(f"b.{c}")
        if c in first:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"d.{c}"))
        if c in coalesced:
            return F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}"))
        return F.when(new, F.col(f"d.{c}")).otherwise(F.col(f"b.{c}"))

    return b.join(d, on, "full_outer").select(*[pick(c).alias(c) for c in base.columns])


def upsert_messages(base: DataFrame, delta: DataFrame) -> DataFrame:
    return upsert(base, delta, ["account_id", "provider_msg_id"], untouched=("embedded_at", "classified_at", "category", "classified_confidence"), coalesced=("history_id",))


def delete_messages(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """tables without the messages of `ids` (account_id, provider_msg_id) and what hangs on them."""
    keys = ["account_id", "provider_msg_id"]
    gone = ids.select(*keys).distinct()
    return {k: t.join(gone, keys, "left_anti") if k in ("messages", *CASCADES) else t for k, t in tables.items()}


def mirror_accounts(base: DataFrame, known: DataFrame, at) -> DataFrame:
    """accounts with those of `known` (account_id, provider, email): of one that is there already only the email changes."""
    return upsert(base, known.withColumn("created_at", at), ["account_id"], first=("provider", "created_at"))


def delete_account(tables: dict[str, DataFrame], account: str) -> dict[str, DataFrame]:
    """tables without any row of the account; a second time changes nothing."""
    return {k: t.filter(F.col("account_id") != account) for k, t in tables.items()}


def upsert_embeddings(messages: DataFrame, base: DataFrame, delta: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Embeddings with delta's, and messages with embedded_at set for those."""
    keys = ["account_id", "provider_msg_id"]
    delta = delta.withColumn("dim", F.size("embedding"))
    done = delta.select(*keys, F.lit(True).alias("__done"))
    stamped = messages.join(done, keys, "left").withColumn("embedded_at", F.when(F.col("__done"), at).otherwise(F.col("embedded_at"))).select(*messages.columns)
    return stamped, upsert(base, delta, keys)


def placed(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """df with each row's place in the given order (column __place, from 0), and how many rows there are.

    Row numbers are counted within ranges of the order and shifted by the ranges' sizes: no task gets all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = settled(ranged, "numbered")
    base, rows = 0, []
    for r in sorted(ranged.groupBy("__part").count().collect(), key=lambda r: r["__part"]):
        rows.append((r["__part"], base))
        base += r["count"]
    bases = df.sparkSession.createDataFrame(rows, "__part int, __base long")
    return ranged.join(F.broadcast(bases), "__part").withColumn("__place", F.col("__base") + F.col("__at")).drop("__part", "__at", "__base"), base


def numbered(new: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """new with ids that go on after log's largest, in the given order."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return placed(new, order)[0].withColumn("id", F.col("__place") + top + 1).drop("__place")


#: Parts of each account's tables that are rewritten for themselves, by a hash of the message.
BUCKETS = 32
#: Live partitions whose names are broadcast.
BROADCAST_PARTITIONS = 1_000_000


class Tables:
    """Parquet tables in partitions of (account_id, bucket, version); a batch writes new versions of the partitions that it
    touches, then one commit for all tables, which makes them the ones that are read.

    A batch that is run again writes the same versions again, so a crash before the commit leaves no trace. One writer
    at a time, as with a streaming query. Which partitions a read opens is a join with the commits (a row for each
    partition), of up to BROADCAST_PARTITIONS rows a broadcast, by which partitions are pruned before the scan.
    """

    COMMIT = "batch long, name string, account_id string, bucket int"

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> DataFrame:
        """Commits whose writing ended: their folders have Spark's mark of success."""
        p, fs = self._files(f"{self.root}/_commits/*/_SUCCESS")
        done = [str(x.getPath().getParent()) for x in fs.globStatus(p) or ()]
        return self.spark.read.schema(self.COMMIT).parquet(*done) if done else self.spark.createDataFrame([], self.COMMIT)

    def current(self, name: str) -> DataFrame:
        """(account_id, bucket, version) of the table's live partitions."""
        return self.commits().filter(F.col("name") == name).groupBy("account_id", "bucket").agg(F.max("batch").alias("version"))

    def bucketed(self, name: str, df: DataFrame) -> DataFrame:
        key = F.pmod(F.xxhash64("provider_msg_id"), F.lit(self.buckets)) if "provider_msg_id" in empty(self.spark, name).columns else F.lit(0)
        return df.withColumn("bucket", key.cast("int"))

    def read(self, name: str, touched: DataFrame | None = None) -> DataFrame:
        """The table as of the last commit; of the partitions `touched` (account_id, bucket) only, if given."""
        columns = empty(self.spark, name).columns
        p, fs = self._files(f"{self.root}/{name}")
        if not fs.exists(p):
            return empty(self.spark, name)
        live = self.current(name) if touched is None else self.current(name).join(touched, ["account_id", "bucket"])
        live = F.broadcast(live) if live.count() <= BROADCAST_PARTITIONS else live
        schema = ", ".join(c for c in TABLES[name].split(", ") if not c.startswith("account_id ")) + ", account_id string, bucket int, version long"
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").join(live, ["account_id", "bucket", "version"]).select(*columns)

    def write(self, batch: int, tables: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        """Puts, for each name, rows in place of the partitions `touched`: (rows, touched); then commits."""
        marks = None
        for name, (rows, touched) in tables.items():
            out = self.bucketed(name, rows.select(*empty(self.spark, name).columns)).withColumn("version", F.lit(batch).cast("long"))
            out.repartition("account_id", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("account_id", "bucket", "version").parquet(f"{self.root}/{name}")
            mark = touched.select(F.lit(batch).cast("long").alias("batch"), F.lit(name).alias("name"), "account_id", F.col("bucket").cast("int").alias("bucket"))
            marks = mark if marks is None else marks.unionByName(mark)
        marks.distinct().write.mode("overwrite").parquet(f"{self.root}/_commits/batch-{batch}")

    def first_version(self, run: str) -> int:
        """The version that batch 0 of a run writes: above all that were committed when the run first asked."""
        where = f"{self.root}/_runs/{run}"
        if not exists(self.spark, f"{where}/_SUCCESS"):
            last = self.commits().agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("last")).first()["last"]
            self.spark.createDataFrame([(last + 1,)], "first long").write.mode("overwrite").parquet(where)
        return self.spark.read.schema("first long").parquet(where).first()["first"]

    def vacuum(self) -> int:
        """Deletes partitions that a later version has replaced; how many. Not while others read older versions."""
        gone = 0
        for name in {r["name"] for r in self.commits().select("name").distinct().collect()}:
            old = self.commits().filter(F.col("name") == name).join(self.current(name), ["account_id", "bucket"]).filter("batch < version")
            for r in old.select("account_id", "bucket", "batch").distinct().toLocalIterator():
                for status in self._files(f"{self.root}/{name}/*/bucket={r['bucket']}/version={r['batch']}")[1].globStatus(self._files(f"{self.root}/{name}/*/bucket={r['bucket']}/version={r['batch']}")[0]) or ():
                    at = status.getPath()
                    if at.getParent().getParent().getName() == f"account_id={r['account_id']}":
                        gone += self._files(str(at))[1].delete(at, True)
        return gone
