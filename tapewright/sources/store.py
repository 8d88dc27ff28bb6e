"""Stored tables: append logs written batch by batch, and versioned latest-value tables.

    <root>/<log>/<day>=D/writer=W/batch_id=N/             a batch's rows of a day, replaced when it is replayed
    <root>/<log>.packed/generation=G/<day>=D/             rows of many batches of a day in few sorted files
    <root>/<log>.manifest/version=G/                      which batches of which days are read from which generation
    <root>/<table>/files/version=N/bucket=B/              a latest-value table's rows of one hash bucket, as batch N left them
    <root>/<table>/manifest/version=N/                    for each bucket, the batch that wrote it last

Logs are the truth and hold every accepted row. Several rows may share a key (corrections); readers
keep the last arrival. Days come first, so that a reader of a few days lists only their folders.

A file that a manifest names is never changed. Writers add files, then a manifest; readers take the newest finished manifest and stay with it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tapewright import schemas
from tapewright.functions.times import date_bucket
from tapewright.operators.latest import latest_by_unique, latest_per_key

OFFSET_BITS = 40
KEEP_VERSIONS = 100
#: Hash buckets of a new latest-value table; an older one keeps its own number.
BUCKETS = 64
#: Batch folders of a day and log from which on they are worth packing.
PACK_FROM = 8
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
LATEST_MANIFEST = "bucket int, version long, buckets int"
LOG_MANIFEST = "day string, generation long, writer string, through long, replaced long"


@dataclass(frozen=True)
class Log:
    schema: StructType
    day: StructField  # partition column
    sort: tuple[str, ...]  # order inside the files, so that row groups can be skipped


_BUCKET = StructField("date_bucket", StringType(), True)
LOGS = {
    "candles": Log(schemas.CANDLES, schemas.DAY, ("symbol", "ts")),
    "metrics": Log(schemas.METRICS, schemas.DAY, ("symbol", "ts")),
    "rollup_1m": Log(schemas.ROLLUPS, schemas.DAY, ("symbol", "ts")),
    "rollup_15m": Log(schemas.ROLLUPS, schemas.DAY, ("symbol", "ts")),
    "rollup_1d": Log(schemas.ROLLUPS, schemas.DAY, ("symbol", "ts")),
    "observations": Log(schemas.OBSERVATIONS, schemas.DAY, ("series_id", "ts")),
    "news": Log(schemas.NEWS, _BUCKET, ("ts", "id")),
    "rejects": Log(schemas.REJECTS, schemas.DAY, ("source", "rejected_at")),
    "indicator_metadata": Log(schemas.INDICATOR_METADATA, schemas.DAY, ("series_id",)),
}
LATEST = {
    "stock_summaries": (schemas.STOCK_SUMMARIES, "symbol", ("last_timestamp", "arrival")),
    "indicator_summaries": (schemas.INDICATOR_SUMMARIES, "indicator", ("observation_date", "arrival")),
}


@dataclass(frozen=True)
class Packed:
    """A packed day: where its files are, up to which batch of each writer they hold it, and batches written again since."""

    generation: int
    through: dict[str, int]
    replaced: frozenset[tuple[str, int]]

    def covers(self, writer: str, batch: int) -> bool:
        return batch <= self.through.get(writer, -1) and (writer, batch) not in self.replaced


def arrival(batch_id: int, offset: Column) -> Column:
    """Orders rewrites of a key: by batch, then by the offset in the source partition. What does not fit is an error."""
    if not 0 <= batch_id < 1 << (63 - OFFSET_BITS):
        raise ValueError(f"batch {batch_id} is beyond the order of arrivals; start a new table")
    fits = offset < (1 << OFFSET_BITS)
    value = F.lit(batch_id).cast("bigint") * (1 << OFFSET_BITS) + offset
    return F.when(fits | offset.isNull(), value).otherwise(F.raise_error(F.lit("an offset is beyond the order of arrivals")))


class MarketStore:
    """Tables below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- logs ----------------------------------------------------------------------------------

    def append(self, table: str, rows: DataFrame, batch_id: int, day: Column, writer: str = "main") -> None:
        """Write one batch of a log. The same writer's batch written again replaces the first.

        The rebalance hint gathers each day's rows into few files and still splits a day that is
        larger than the rest.
        """
        log = LOGS[table]
        keys = {log.day.name: day, "writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("bigint")}
        prepared = rows.withColumns(keys).select(*log.schema.fieldNames(), *keys)
        (
            prepared.hint("rebalance", log.day.name)
            .sortWithinPartitions(*keys, *log.sort)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(f"{self.root}/{table}")
        )
        self._supersede(table, writer, batch_id)

    def log(self, table: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """All rows ever written, or those of a span of days, with their day, writer and batch."""
        log, root = LOGS[table], f"{self.root}/{table}"
        prefix = f"{log.day.name}="
        packed = self._packed(table)
        days = [n.removeprefix(prefix) for n in self._names(root) if n.startswith(prefix)]
        if not packed and first is None and last is None:
            return self._read_log(table, root, [root] if days else [])
        if first is not None:
            days = [d for d in days if d >= first.isoformat()]
            packed = {d: p for d, p in packed.items() if d >= first.isoformat()}
        if last is not None:
            days = [d for d in days if d <= last.isoformat()]
            packed = {d: p for d, p in packed.items() if d <= last.isoformat()}
        loose = [f"{root}/{prefix}{d}" for d in days if d not in packed]
        loose += [path for d in days if d in packed for path, writer, batch in self._folders(table, d) if not packed[d].covers(writer, batch)]
        return self._with_packed(table, self._read_log(table, root, loose), packed)

    def _read_log(self, table: str, base: str, paths: list[str]) -> DataFrame:
        log = LOGS[table]
        schema = StructType([*log.schema.fields, log.day, schemas.WRITER, schemas.BATCH_ID])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def _with_packed(self, table: str, rows: DataFrame, packed: dict[str, Packed]) -> DataFrame:
        """The rows, and those that packed days hold, without batches that were written again since."""
        day = LOGS[table].day
        for generation in sorted({p.generation for p in packed.values()}):
            taken = {d: p for d, p in packed.items() if p.generation == generation}
            base = f"{self.root}/{table}.packed/generation={generation}"
            old = self._read_log(table, base, [f"{base}/{day.name}={d}" for d in taken]).select(rows.columns)
            again = [(d, w, b) for d, p in taken.items() for w, b in p.replaced]
            if again:
                keys = StructType([day, schemas.WRITER, schemas.BATCH_ID]).fieldNames()
                gone = self.spark.createDataFrame(again, "d string, w string, b long")
                gone = gone.select(F.col("d").cast(day.dataType).alias(keys[0]), F.col("w").alias(keys[1]), F.col("b").alias(keys[2]))
                old = old.join(gone, keys, "left_anti").select(rows.columns)
            rows = rows.unionByName(old)
        return rows

    def batch_days(self, table: str, batch_id: int, writer: str = "main") -> list[date]:
        """The days a batch of a log has rows of; rows without a day are of none."""
        root, prefix = f"{self.root}/{table}", f"{LOGS[table].day.name}="
        packed = self._packed(table)
        days = {n.removeprefix(prefix) for n in self._names(root) if n.startswith(prefix) and NO_DAY not in n}
        days = {d for d in days if self._exists(f"{root}/{prefix}{d}/writer={writer}/batch_id={batch_id}")}
        covered = [date.fromisoformat(d) for d, p in packed.items() if p.covers(writer, batch_id) and d not in days]
        found = {date.fromisoformat(d) for d in days}
        if covered:
            own = self.log(table, min(covered), max(covered)).where((F.col("writer") == writer) & (F.col("batch_id") == batch_id))
            found |= {r.day for r in own.select(F.col(LOGS[table].day.name).alias("day")).distinct().collect()}
        return sorted(found)

    # ---- packing -------------------------------------------------------------------------------

    def pack(self, table: str, least: int = PACK_FROM) -> list[str]:
        """Rewrite the batch folders of the days that have `least` or more into few sorted files; returns those days.

        Rows keep their writer and batch number. A writer's newest batch stays as it is, for it may still be written. Readers see the
        day as before until the manifest names its new files, and the same rows afterwards; the folders stay for
        readers of older manifests until `drop_packed`.
        """
        log, root = LOGS[table], f"{self.root}/{table}"
        prefix = f"{log.day.name}="
        packed = self._packed(table)
        # Rows without a day stay where they are.
        days = [n.removeprefix(prefix) for n in self._names(root) if n.startswith(prefix) and NO_DAY not in n]
        folders = {day: self._folders(table, day) for day in days}
        newest: dict[str, int] = {}
        for _, writer, batch in (f for found in folders.values() for f in found):
            newest[writer] = max(newest.get(writer, -1), batch)
        chosen: dict[str, list[tuple[str, str, int]]] = {}
        for day, found in folders.items():
            ready = [(p, w, b) for p, w, b in found if b < newest[w] and not (day in packed and packed[day].covers(w, b))]
            if len(ready) >= least:
                chosen[day] = ready
        if not chosen:
            return []
        generation = max(self._manifests(f"{table}.manifest"), default=-1) + 1
        rows = self._read_log(table, root, [p for ready in chosen.values() for p, _, _ in ready])
        rows = self._with_packed(table, rows, {d: packed[d] for d in chosen if d in packed})
        (
            rows.hint("rebalance", log.day.name)
            .sortWithinPartitions(log.day.name, *log.sort)
            .write.mode("overwrite")
            .partitionBy(log.day.name)
            .parquet(f"{root}.packed/generation={generation}")
        )
        for day, ready in chosen.items():
            through = dict(packed[day].through) if day in packed else {}
            still = set(packed[day].replaced) if day in packed else set()
            for _, writer, batch in ready:
                through[writer] = max(through.get(writer, -1), batch)
                still.discard((writer, batch))
            packed[day] = Packed(generation, through, frozenset(still))
        self._write_packed(table, packed, generation)
        return sorted(chosen)

    def drop_packed(self, table: str, keep: int = 2) -> None:
        """Remove all but the newest `keep` manifests of a log, and the files that none of those reads.

        Readers that started on a manifest still kept can finish.
        """
        versions = sorted(self._manifests(f"{table}.manifest"), reverse=True)
        kept = [self._packed(table, v) for v in versions[: max(keep, 1)]]
        if not kept:
            return
        needed = {p.generation for manifest in kept for p in manifest.values()}
        for name in self._names(f"{self.root}/{table}.packed"):
            if int(name.removeprefix("generation=")) not in needed:
                self._delete(f"{self.root}/{table}.packed/{name}")
        for day in set.intersection(*(set(manifest) for manifest in kept)):
            found = self._folders(table, day)
            unread = [p for p, writer, batch in found if all(m[day].covers(writer, batch) for m in kept)]
            for path in unread:
                self._delete(path)
            if len(unread) == len(found):
                self._delete(f"{self.root}/{table}/{LOGS[table].day.name}={day}")
        for version in versions[max(keep, 1) :]:
            self._delete(f"{self.root}/{table}.manifest/version={version}")

    def _supersede(self, table: str, writer: str, batch_id: int) -> None:
        """A packed batch that was written again is read from its new folders."""
        packed = self._packed(table)
        days = [d for d, p in packed.items() if p.covers(writer, batch_id)]
        days = [d for d in days if any((w, b) == (writer, batch_id) for _, w, b in self._folders(table, d))]
        if days:
            for day in days:
                old = packed[day]
                packed[day] = Packed(old.generation, old.through, old.replaced | {(writer, batch_id)})
            self._write_packed(table, packed, max(self._manifests(f"{table}.manifest")) + 1)

    def _folders(self, table: str, day: str) -> list[tuple[str, str, int]]:
        """(path, writer, batch) of a day's batch folders."""
        base = f"{self.root}/{table}/{LOGS[table].day.name}={day}"
        found = []
        for writer in (n for n in self._names(base) if n.startswith("writer=")):
            for batch in (n for n in self._names(f"{base}/{writer}") if n.startswith("batch_id=")):
                found.append((f"{base}/{writer}/{batch}", writer.removeprefix("writer="), int(batch.removeprefix("batch_id="))))
        return found

    def _packed(self, table: str, version: int | None = None) -> dict[str, Packed]:
        """What the newest manifest, or a given one, says of each packed day: as many rows as days and writers."""
        if version is None:
            version = max(self._manifests(f"{table}.manifest"), default=None)
            if version is None:
                return {}
        days: dict[str, Packed] = {}
        for row in self.spark.read.schema(LOG_MANIFEST).parquet(f"{self.root}/{table}.manifest/version={version}").collect():
            old = days.get(row.day, Packed(row.generation, {}, frozenset()))
            if row.replaced is None:
                days[row.day] = Packed(row.generation, {**old.through, row.writer: row.through}, old.replaced)
            else:
                days[row.day] = Packed(row.generation, old.through, old.replaced | {(row.writer, row.replaced)})
        return days

    def _write_packed(self, table: str, packed: dict[str, Packed], version: int) -> None:
        rows = [(d, p.generation, w, n, None) for d, p in packed.items() for w, n in p.through.items()]
        rows += [(d, p.generation, w, None, b) for d, p in packed.items() for w, b in p.replaced]
        manifest = self.spark.createDataFrame(rows, LOG_MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.root}/{table}.manifest/version={version}")

    def next_batch(self, *tables: str) -> int:
        """The first batch number not in use in any of the logs (all logs when none is named)."""
        numbers = [self.log(t).agg(F.max("batch_id")).first()[0] for t in tables or LOGS]
        return max((n for n in numbers if n is not None), default=-1) + 1

    def candles(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Last write per (symbol, ts)."""
        return self._last_writes("candles", ["symbol", "ts"], first, last)

    def metrics(self, first: date | None = None, last: date | None = None) -> DataFrame:
        return self._last_writes("metrics", ["symbol", "ts"], first, last)

    def rollups(self, table: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """The states of one width, each as it was last built."""
        return self._last_writes(table, ["symbol", "ts"], first, last)

    def observations(self, first: date | None = None, last: date | None = None) -> DataFrame:
        return self._last_writes("observations", ["series_id", "ts"], first, last)

    def news(self, first: date | None = None, last: date | None = None) -> DataFrame:
        rows = self.log("news", first, last).drop("writer", "batch_id")
        # The last arrival is found on the keys alone; texts are only joined with it, never sorted by.
        keys = ["date_bucket", "ts", "id"]
        last = rows.groupBy(*keys).agg(F.max("arrival").alias("arrival"))
        return rows.join(last, [*keys, "arrival"], "left_semi")

    def _last_writes(self, table: str, key: list[str], first: date | None, last: date | None) -> DataFrame:
        """The day is part of the grouping, so filters on it still prune folders."""
        rows = self.log(table, first, last).drop("writer", "batch_id")
        return latest_by_unique(rows, [*key, LOGS[table].day.name], "arrival")

    def rejects(self) -> DataFrame:
        return self.log("rejects")

    def indicator_metadata(self, before_batch: int | None = None) -> DataFrame:
        rows = self.log("indicator_metadata")
        if before_batch is not None:
            rows = rows.where(F.col("batch_id") < before_batch)
        # One row for each series, the first that was stored: two batches may have found it missing at once.
        names = [n for n in LOGS["indicator_metadata"].schema.fieldNames() if n != "series_id"]
        first = F.min(F.struct("last_updated", "batch_id", *(n for n in names if n != "last_updated"))).alias("first")
        return rows.groupBy("series_id").agg(first).select("series_id", *(f"first.{n}" for n in names))

    # ---- latest-value tables -------------------------------------------------------------------

    def upsert_latest(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """Merge a batch into the table as a new version; a late row does not replace a newer one.

        Keys lie in hash buckets. Only the buckets that the batch has keys of are read and written; the new manifest names the old files of
        the others. So what is written follows the batch, not the table. A batch that has its manifest is complete and is not written again. Readers
        that started on an older version can finish on it for the next KEEP_VERSIONS batches.
        """
        schema, key, order = LATEST[table]
        if batch_id in self._versions(table):
            return
        files, buckets = self._manifest(table, before=batch_id)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = latest_per_key(rows.select(*schema.fieldNames()), [key], list(order)).withColumn("bucket", bucket)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        held = self._read_buckets(table, {b: v for b, v in files.items() if b in touched})
        merged = held.unionByName(rows.drop("bucket"))
        written = latest_per_key(merged, [key], list(order)).withColumn("bucket", bucket)
        written.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/files/version={batch_id}")
        files = {**files, **dict.fromkeys(touched, batch_id)}
        manifest = self.spark.createDataFrame([(b, v, buckets) for b, v in files.items()], LATEST_MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.root}/{table}/manifest/version={batch_id}")
        self.drop_old_versions(table, KEEP_VERSIONS)

    def latest(self, table: str, before_batch: int | None = None) -> DataFrame:
        """The newest complete version, or the newest before a batch while it is kept."""
        return self._version(table, before_batch)

    def stock_summaries(self) -> DataFrame:
        return self.latest("stock_summaries")

    def indicator_summaries(self) -> DataFrame:
        return self.latest("indicator_summaries")

    def _version(self, table: str, before: int | None) -> DataFrame:
        return self._read_buckets(table, self._manifest(table, before)[0])

    def _read_buckets(self, table: str, files: dict[int, int]) -> DataFrame:
        schema = LATEST[table][0]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{table}/files/version={v}/bucket={b}" for b, v in files.items()))

    def _manifest(self, table: str, before: int | None = None) -> tuple[dict[int, int], int]:
        """By bucket, the version that holds it, as of the newest version below `before`; and the number of buckets."""
        version = max((v for v in self._versions(table) if before is None or v < before), default=None)
        if version is None:
            return {}, BUCKETS
        rows = self.spark.read.schema(LATEST_MANIFEST).parquet(f"{self.root}/{table}/manifest/version={version}").collect()
        return {r.bucket: r.version for r in rows}, rows[0].buckets

    def drop_old_versions(self, table: str, keep: int) -> None:
        """Remove all but the newest `keep` versions, and the files that only they named."""
        versions = sorted(self._versions(table))
        # A bucket's files go when the version after the removed one has others.
        for version, following in zip(versions[: -max(keep, 1)], versions[1:]):
            old, new = (self._manifest(table, before=v + 1)[0] for v in (version, following))
            for bucket in (b for b, v in old.items() if new.get(b) != v):
                self._delete(f"{self.root}/{table}/files/version={old[bucket]}/bucket={bucket}")
            self._delete(f"{self.root}/{table}/manifest/version={version}")

    # ---- files ---------------------------------------------------------------------------------

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._path(name)
        return files.exists(path)

    def _names(self, folder: str) -> list[str]:
        files, path = self._path(folder)
        if not files.exists(path):
            return []
        return [status.getPath().getName() for status in files.listStatus(path)]

    def _delete(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    def _versions(self, table: str) -> list[int]:
        return self._manifests(f"{table}/manifest")

    def _manifests(self, folder: str) -> list[int]:
        """Numbers of the finished manifests: one without the marker was never finished."""
        names = [n for n in self._names(f"{self.root}/{folder}") if n.startswith("version=")]
        return [int(n.removeprefix("version=")) for n in names if self._exists(f"{self.root}/{folder}/{n}/_SUCCESS")]


def utc_day(ts: str) -> Column:
    return F.to_date(ts)


def news_day(ts: str) -> Column:
    return date_bucket(F.col(ts))
