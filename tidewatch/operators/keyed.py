"""Keyed tables: upserts, deduplication, retention, and the partitioned sink."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialize, release


def keep_latest(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str] = ()) -> DataFrame:
    """Newest row per key. Spark limits each task to one row per key before the
    shuffle, so a key with many copies costs no more than the others."""
    newest = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), *[F.col(t).desc() for t in tie])
    return df.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") == 1).drop("__rn")


def upsert_replace(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows are replaced whole, new keys inserted. ``batch`` has unique keys;
    columns missing on one side become null."""
    kept = target.join(batch.select(*keys), list(keys), "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def upsert_merge(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows take the batch's columns (nulls included) and keep the others."""
    t = target.withColumn("__in_target", F.lit(True)).alias("t")
    b = batch.withColumn("__in_batch", F.lit(True)).alias("b")
    joined = t.join(b, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    hit = F.col("b.__in_batch").isNotNull()

    def pick(name: str) -> Column:
        if name not in batch.columns:
            return F.col(f"t.{name}")
        if name not in target.columns:
            return F.col(f"b.{name}")
        return F.when(hit, F.col(f"b.{name}")).otherwise(F.col(f"t.{name}"))

    names = target.columns + [c for c in batch.columns if c not in target.columns]
    return joined.select(*[pick(n).alias(n) for n in names])


def upsert_touch(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], now: Column, created: str = "created_at", touched: str = "updated_at"
) -> DataFrame:
    """Merge that keeps the first ``created_at`` and renews ``updated_at`` of touched rows."""
    known = target.select(*keys, F.col(created).alias("__created"))
    stamped = (
        batch.join(known, list(keys), "left")
        .withColumns({created: F.coalesce("__created", now), touched: now})
        .drop("__created")
    )
    return upsert_merge(target, stamped, keys)


def content_hash(*columns: str) -> Column:
    """Hash of content columns. Length-prefixed so that shifted text differs."""
    parts = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("-")) for p in parts]), 256)


def changed_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Rows that are new or whose content differs; only these are worth embedding."""
    known = target.select(*keys, content_hash(*content).alias("__hash"))
    return batch.withColumn("__hash", content_hash(*content)).join(known, [*keys, "__hash"], "left_anti").drop("__hash")


def retain(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; rows without a time stay."""
    limit = now - F.make_dt_interval(F.lit(days))
    return df.where(F.col(time).isNull() | (F.col(time) >= limit))


# Days kept per table.
RETENTION_DAYS = {"zone_traffic": 7, "validation_dlq": 30}


def purge_numeric_time(df: DataFrame, time: str) -> DataFrame:
    """Drop rows whose raw time text is a bare number (written by an old version)."""
    return df.where(F.col(time).isNull() | F.col(time).cast("string").try_cast("double").isNull())


def purge_missing_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


#: Attempts of a batch when other writers keep changing the partitions it touches.
ATTEMPTS = 20


def remove_keys(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target without the batch's keys, as a merge for :meth:`KeyedTable.apply`."""
    return target.join(batch.select(*keys), list(keys), "left_anti")


class KeyedTable:
    """A Parquet table with a key, cut into partitions by a column derived from the key.

    ``partition`` must be a function of the key, so a key never moves between
    partitions. A batch writes the partitions it touches under a new version and
    then renames one small manifest into place, which names the files of every
    partition. Until then readers see the table before, after it the table with the
    whole batch; a driver or executor lost on the way leaves nothing to repair,
    and running the batch again gives the same table. A batch reads the
    partitions it touches only.

    Several writers may work at once. A manifest's number can be taken once only; the
    writer that comes second reads the new manifest. If that changed none of the
    partitions it read, it adds its own to it, otherwise it merges again.

    With ``time``, the manifest also holds the bounds of that column for every
    partition, so that :meth:`retain` and :meth:`drop_before` leave old partitions
    unopened.

    Rows without a key are never dropped in silence: they go to ``rejected``. Rows
    older than the stored ones go to ``outdated``.
    """

    def __init__(
        self, path: str, keys: Sequence[str], partition: str, partition_expr: Column, rejected: str | None = None, time: str | None = None
    ):
        self.path, self.keys, self.partition, self.expr, self.time = path, list(keys), partition, partition_expr, time
        self.rejected = rejected or f"{path}/rejected"
        self.outdated = f"{path}/outdated"

    # -- manifests ----------------------------------------------------------------

    def _fs(self, spark):
        make = spark._jvm.org.apache.hadoop.fs.Path
        return make, make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, spark) -> list[int]:
        make, fs = self._fs(spark)
        folder = make(f"{self.path}/manifest")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def _content(self, spark, number: int) -> dict:
        return json.loads(spark.read.text(f"{self.path}/manifest/{number:012d}", wholetext=True).first()[0])

    def _manifest(self, spark) -> tuple[int, dict]:
        """Number and content of the newest manifest; 0 and nothing without one."""
        numbers = self._numbers(spark)
        return (numbers[-1], self._content(spark, numbers[-1])) if numbers else (0, {})

    def _publish(self, spark, number: int, content: dict) -> bool:
        """Whether this manifest is now the table's; false if the number is taken."""
        make, fs = self._fs(spark)
        draft, final = (make(f"{self.path}/manifest/{n}") for n in (f"_draft-{uuid.uuid4().hex}", f"{number:012d}"))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content, sort_keys=True), "utf-8"))
        out.close()
        hadoop, gateway = spark._jvm.org.apache.hadoop, spark.sparkContext._gateway
        context = hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        try:
            # unlike FileSystem.rename this never replaces a file, on any file system
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _commit(self, spark, base: int, read: Sequence[str], versions: dict, entry: dict, again: Callable[[], None]) -> None:
        """Publish ``versions`` on top of the newest manifest, or do the work ``again`` if another writer changed a partition it read.

        ``versions`` maps a partition to its new entry, or to None where it goes.
        """
        known = (self._content(spark, base) if base else {}).get("versions", {})
        while True:
            number, m = self._manifest(spark)
            current = m.get("versions", {})
            if number != base and any(current.get(p) != known.get(p) for p in read):
                return again()
            merged = {p: v for p, v in (current | versions).items() if v is not None}
            if self._publish(spark, number + 1, {"schema": m.get("schema"), **entry, "versions": merged}):
                return None

    # -- partitions -----------------------------------------------------------------

    def _name(self) -> Column:
        """The one name of a row's partition: never empty, and null differs from every text."""
        return F.coalesce(F.concat(F.lit("="), F.col(self.partition).cast("string")), F.lit("null"))

    @staticmethod
    def _named(partitions: Sequence[str | None]) -> set[str]:
        return {"null" if p is None else f"={p}" for p in partitions}

    def _write(self, spark, rows: DataFrame) -> dict:
        """Files and bounds of the partitions that ``rows`` make up, written under a new version."""
        make, fs = self._fs(spark)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        # rows of a partition are brought together; a large one is split into several files
        rows.withColumn("__part", self._name()).hint("rebalance", "__part").write.partitionBy("__part").parquet(folder)
        found = {}
        for f in fs.listStatus(make(folder)):
            if f.isDirectory():
                found[unquote(f.getPath().getName().removeprefix("__part="))] = {"path": f.getPath().toString()}
        if self.time:
            written = spark.read.schema(T.StructType([rows.schema[self.time], T.StructField("__part", T.StringType())])).parquet(folder)
            micros = F.unix_micros(F.col(self.time).cast("timestamp"))
            bounds = written.groupBy("__part").agg(F.min(micros).alias("low"), F.max(micros).alias("high"), F.count_if(micros.isNull()).alias("timeless"))
            for r in bounds.collect():  # a row a partition that the batch touches
                found[r["__part"]] |= {"low": r["low"], "high": r["high"], "timeless": r["timeless"]}
        return found

    def exists(self, spark) -> bool:
        return self._manifest(spark)[0] > 0

    def _open(self, spark, m: dict, names: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        wanted = [v["path"] for p, v in sorted(m["versions"].items()) if names is None or p in names]
        return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)

    def read(self, spark, partitions: Sequence[str | None] | None = None) -> DataFrame:
        """The table, or the named partitions of it; only their files are opened."""
        _, m = self._manifest(spark)
        if not m:
            raise FileNotFoundError(f"{self.path} holds no table yet")
        return self._open(spark, m, None if partitions is None else self._named(partitions))

    # -- batches ----------------------------------------------------------------------

    def apply(
        self, batch: DataFrame, merge=upsert_replace, order: str | None = None, tie: Sequence[str] = (), name: str | None = None
    ) -> None:
        """Merge a batch. Of rows with one key the newest by ``order`` counts (then by ``tie``,
        then by all columns), and none older than the stored one; a row without ``order`` is
        older than any with it. ``name`` (a batch's id) makes a second run write the
        same rejected and outdated rows over the first ones."""
        spark = batch.sparkSession
        missing = F.lit(False)
        for k in self.keys:
            missing = missing | F.col(k).isNull()
        label = name or uuid.uuid4().hex
        whole = materialize(batch, "batch")
        whole.where(missing).write.mode("overwrite").parquet(f"{self.rejected}/batch={label}")
        steady = [*tie, *[c for c in batch.columns if c not in (order, *tie)]]
        by = [F.col(order).desc_nulls_last()] if order else []
        newest = Window.partitionBy(*self.keys).orderBy(*by, *[F.col(c).cast("string").desc_nulls_last() for c in steady])
        rows = whole.where(~missing).withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")
        rows = materialize(rows.withColumn(self.partition, self.expr), "newest")
        release(whole)
        self._merge(spark, rows, merge, order, label, ATTEMPTS)
        release(rows)

    def _merge(self, spark, rows: DataFrame, merge: Callable, order: str | None, label: str, attempts: int) -> None:
        if not attempts:
            raise RuntimeError(f"{self.path}: other writers changed the same partitions {ATTEMPTS} times")
        touched = [r[0] for r in rows.select(self._name()).distinct().collect()]  # a value a partition
        if not touched:
            return
        base, m = self._manifest(spark)
        fresh, merged = rows, rows if merge is not remove_keys else rows.limit(0)
        if base:
            current = self._open(spark, m, touched)
            if order:
                stored = current.select(*self.keys, F.col(order).alias("__stored"), F.lit(True).alias("__here"))
                held = rows.join(stored, self.keys, "left")
                newer = F.col("__here").isNull() | F.col("__stored").isNull() | F.coalesce(F.col(order) >= F.col("__stored"), F.lit(False))
                fresh = held.where(newer).drop("__stored", "__here")
                held.where(~newer).drop("__stored", "__here").write.mode("overwrite").parquet(f"{self.outdated}/batch={label}")
            merged = merge(current, fresh, self.keys)
        versions = dict.fromkeys(touched) | self._write(spark, merged)
        entry = {"schema": merged.schema.jsonValue(), "merge": getattr(merge, "__name__", "merge"), "touched": sorted(touched)}
        self._commit(spark, base, touched, versions, entry, lambda: self._merge(spark, rows, merge, order, label, attempts - 1))

    # -- changes --------------------------------------------------------------------------

    def changes(self, spark, since: int = 0, upto: int | None = None) -> DataFrame:
        """What the versions after ``since`` changed: version, operationType and the columns of the row.

        Each version is compared with the one before it, in the partitions whose files
        differ only: *insert*, *delete* (the row as it was), and for a row whose content
        differs *replace* after :func:`upsert_replace` and *update* after any other merge.
        Versions that :meth:`vacuum` has removed can't be compared.
        """
        numbers = [n for n in self._numbers(spark) if upto is None or n <= upto]
        parts = []
        for number in (n for n in numbers if n > since):
            after = self._content(spark, number)
            if number - 1 and number - 1 not in numbers:
                raise ValueError(f"{self.path}: version {number - 1} is gone")
            before = self._content(spark, number - 1) if number > 1 else {"schema": after["schema"], "versions": {}}
            moved = [p for p in before["versions"].keys() | after["versions"].keys() if before["versions"].get(p) != after["versions"].get(p)]
            old, new = self._open(spark, before, moved), self._open(spark, after, moved)
            old = old.select(*[F.col(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns])
            row = F.struct(*new.columns)
            both = (
                old.select(*self.keys, row.alias("__old"))
                .join(new.select(*self.keys, row.alias("__new")), self.keys, "full_outer")
                .where(~F.col("__old").eqNullSafe(F.col("__new")))
            )
            kind = "replace" if after.get("merge") == "upsert_replace" else "update"
            op = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").otherwise(kind)
            shown = F.coalesce("__new", "__old").alias("__row")
            parts.append(both.select(F.lit(number).cast("long").alias("version"), op.alias("operationType"), shown).select("version", "operationType", "__row.*"))
        if not parts:
            empty = self._open(spark, self._manifest(spark)[1], []) if numbers else spark.createDataFrame([], T.StructType([]))
            return empty.select(F.lit(0).cast("long").alias("version"), F.lit("").alias("operationType"), "*").limit(0)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    # -- age --------------------------------------------------------------------------------

    def _limit(self, spark, now: Column, days: int) -> int:
        return spark.range(1).select(F.unix_micros(now.cast("timestamp") - F.make_dt_interval(F.lit(days)))).first()[0]

    def _by_age(self, m: dict, limit: int) -> tuple[list[str], list[str], list[str]]:
        """Names of the partitions that are too old, partly too old, and young throughout, by the manifest alone."""
        old, partly, young = [], [], []
        for p, v in sorted(m["versions"].items()):
            if "timeless" not in v:
                partly.append(p)
            elif v["low"] is None or v["low"] >= limit:
                young.append(p)
            else:
                (old if v["high"] < limit and not v["timeless"] else partly).append(p)
        return old, partly, young

    def retain(self, spark, time: str, now: Column, days: int) -> DataFrame:
        """Rows not older than ``days``; rows without a time stay. Partitions that the
        manifest shows to be too old are not opened, those young throughout not filtered."""
        _, m = self._manifest(spark)
        if time != self.time:
            return retain(self.read(spark), time, now, days)
        _, partly, young = self._by_age(m, self._limit(spark, now, days))
        return self._open(spark, m, young).unionByName(retain(self._open(spark, m, partly), time, now, days))

    def drop_before(self, spark, now: Column, days: int, attempts: int = ATTEMPTS) -> None:
        """Make the table what :meth:`retain` reads: too old partitions leave the manifest
        unread, partly old ones are written anew, the others are not touched."""
        if not self.time or not attempts:
            raise RuntimeError(f"{self.path} keeps no time bounds" if attempts else f"{self.path}: too many other writers")
        base, m = self._manifest(spark)
        if not base:
            return
        old, partly, _ = self._by_age(m, self._limit(spark, now, days))
        if not old and not partly:
            return
        versions = dict.fromkeys([*old, *partly])
        if partly:
            versions |= self._write(spark, retain(self._open(spark, m, partly), self.time, now, days))
        entry = {"merge": "drop_before", "touched": sorted(versions)}
        self._commit(spark, base, list(versions), versions, entry, lambda: self.drop_before(spark, now, days, attempts - 1))

    def vacuum(self, spark, keep: int = 1, letters: bool = False) -> None:
        """Delete all but the newest ``keep`` manifests and the versions that none of them
        names, with ``letters`` also the rejected and outdated rows; for times without
        readers and writers."""
        make, fs = self._fs(spark)
        numbers = self._numbers(spark)
        used = {v["path"].rsplit("/", 2)[-2] for n in numbers[-keep:] for v in self._content(spark, n)["versions"].values()}
        for f in fs.listStatus(make(f"{self.path}/data")) if fs.exists(make(f"{self.path}/data")) else []:
            if f.getPath().getName() not in used:
                fs.delete(f.getPath(), True)
        for f in fs.listStatus(make(f"{self.path}/manifest")) if numbers else []:
            name = f.getPath().getName()
            if name.startswith("_draft") or name.isdigit() and int(name) not in numbers[-keep:]:
                fs.delete(f.getPath(), False)
        for folder in (self.rejected, self.outdated) if letters else ():
            fs.delete(make(folder), True)
