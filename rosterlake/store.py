"""Versioned stores that rewrite only what a run touches.

Rows lie in buckets by the hash of their key. A version is a small manifest: which folder holds each bucket. An upsert reads, merges
and writes the buckets that its keys fall into, and the next manifest takes the others over, so files never change and every
version stays readable until `vacuum`.

Two things keep writers apart. A lock is a numbered file, held for a lease and renewed by its writer alone; who takes over one that has run
out makes the next number and never touches an older file. A commit first sees that no higher number exists, and then puts
its manifest in place under the next version's name, which only one writer can do: on file systems whose rename to an existing name
fails, of two commits on the same version the second fails whatever the clocks say.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators.merge import change_log, merge
from rosterlake.operators.reconcile import reconcile
from rosterlake.schemas import EntitySpec
from rosterlake.tables import forget, materialise

CHANGES = ("new", "updated", "returned", "departed")


class StoreBusy(RuntimeError):
    pass


class StoreFenced(StoreBusy):
    """A writer that has lost its lock tried to commit."""


class Store:
    """`buckets` is how many parts a store is made with; a later full commit may choose another number."""

    def __init__(self, spark: SparkSession, root: str, spec: EntitySpec, buckets: int = 64):
        self.spark, self.root, self.spec, self.buckets = spark, root.rstrip("/"), spec, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._hadoop)

    # files of the driver's

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _put(self, path, text: str, overwrite: bool) -> None:
        """A file that is whole from the moment it has its name."""
        tmp = self._path(f"{self.root}/tmp/{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(path.getParent())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(option, 1)
        flags[0] = option.OVERWRITE if overwrite else option.NONE
        try:
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self._hadoop).rename(tmp, path, flags)
        except Exception:
            self._fs.delete(tmp, False)
            raise

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _until(self, path) -> float:
        """When a lock runs out; never if it is there and can't be read, not even after a while (it may be being renewed)."""
        for _ in range(20):
            try:
                return float(self._text(path).split()[1])
            except Exception:
                if not self._fs.exists(path):
                    return 0.0
                time.sleep(0.05)
        return float("inf")

    # one writer

    def _epoch(self) -> int:
        """Number of the newest lock."""
        return max((int(n.removeprefix("LOCK.")) for n in self._names(self.root) if n.startswith("LOCK.")), default=0)

    @contextmanager
    def lock(self, lease: float = 120.0, renew: bool = True):
        """One writer at a time; gives its number. The lock of a killed writer runs out and is then taken over, by one of those that
        wait. What a writer does after it has lost its lock changes nothing of its successor's."""
        at = lambda n: self._path(f"{self.root}/LOCK.{n}")
        me, last = uuid.uuid4().hex, self._epoch()
        busy = StoreBusy(f"{self.root} is being written")
        single = self._path(f"{self.root}/LOCK")  # a lock without a number is honoured, then cleared away
        if self._fs.exists(single):
            if time.time() < self._until(single):
                raise busy
            self._fs.delete(single, False)
        if last and time.time() < self._until(at(last)):
            raise busy
        mine = last + 1
        try:
            self._put(at(mine), f"{me} {time.time() + lease}", False)
        except Exception as e:
            raise busy from e
        done = threading.Event()

        def keep():
            while not done.wait(lease / 3) and self._epoch() == mine:
                self._put(at(mine), f"{me} {time.time() + lease}", True)

        thread = threading.Thread(target=keep, daemon=True)
        if renew:
            thread.start()
        try:
            yield mine
        finally:
            done.set()
            if renew:
                thread.join()
            if self._epoch() == mine:
                self._put(at(mine), f"{me} 0", True)  # numbers go on from here
                for n in range(max(1, mine - 8), mine):
                    self._fs.delete(at(n), False)

    # versions

    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in self._names(f"{self.root}/versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(self._text(self._path(f"{self.root}/versions/{version:010d}.json")))

    def changes(self, version: int | None = None) -> dict[str, int]:
        """What the run that made a version changed, as counted while it wrote, and the rows the version has."""
        m = self.manifest(self.version() if version is None else version)
        return {**m["changes"], "rows": m["rows"]}

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.spec.schema).withColumn("key", F.lit(None).cast("string"))

    def _parts(self, m: dict, only: set[int] | None = None) -> DataFrame:
        """Rows of the buckets of a manifest, with _change, what the run that wrote them did."""
        paths = [f"{self.root}/data/{p}" for b, p in m["parts"].items() if only is None or int(b) in only]
        kind = T.StructType.fromJson(m["schema"])
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self._parts(self.manifest(v)).drop("_change") if v else self._empty()

    def _write(self, rows: DataFrame, before: dict | None, v: int, epoch: int, buckets: int, batch: tuple[str, int] | None) -> int:
        """rows with _change become the buckets they fall into, in place of those of `before`; None replaces all."""
        folder = uuid.uuid4().hex
        seen = Observation("store")
        counted = rows.observe(seen, F.count("*").alias("rows"), *[F.count_if(F.col("_change") == c).alias(c) for c in CHANGES])
        dealt = counted.withColumn("bucket", self._bucket(buckets)).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        made = {n.removeprefix("bucket="): f"{folder}/{n}" for n in self._names(f"{self.root}/data/{folder}") if n.startswith("bucket=")}
        got = seen.get if made else dict.fromkeys(("rows", *CHANGES), 0)
        total = got["rows"] if before is None else before["rows"] + got["new"]
        m = {
            "version": v, "epoch": epoch, "buckets": buckets, "rows": total, "changes": {c: got[c] for c in CHANGES}, "schema": json.loads(rows.schema.json()),
            "parts": ({} if before is None else before["parts"]) | made, "batches": ({} if before is None else before["batches"]) | (dict([batch]) if batch else {}),
        }
        if self._epoch() != epoch:
            raise StoreFenced(f"{self.root} has another writer by now")
        try:
            self._put(self._path(f"{self.root}/versions/{v:010d}.json"), json.dumps(m), False)
        except Exception as e:
            if self._fs.exists(self._path(f"{self.root}/versions/{v:010d}.json")):
                raise StoreFenced(f"version {v} of {self.root} is there already") from e
            raise
        return v

    @staticmethod
    def _bucket(n: int):
        return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")

    def commit(self, rows: DataFrame) -> int:
        """rows with key become the whole of the next version."""
        with self.lock() as epoch:
            return self._write(rows.withColumn("_change", F.lit("new")), None, self.version() + 1, epoch, self.buckets, None)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest `keep` versions, and the folders that none of the rest names; how many folders went."""
        with self.lock():
            names = sorted(n for n in self._names(f"{self.root}/versions") if n.endswith(".json"))
            live = {p.split("/")[0] for n in names[-keep:] for p in self.manifest(int(n.split(".")[0]))["parts"].values()}
            for n in names[:-keep]:
                self._fs.delete(self._path(f"{self.root}/versions/{n}"), False)
            gone = [d for d in self._names(f"{self.root}/data") if d not in live]
            for d in gone:
                self._fs.delete(self._path(f"{self.root}/data/{d}"), True)
            return len(gone)

    def describe(self, updated_at: str) -> DataFrame:
        """The current version as one document: when it was updated, how many rows it has."""
        return self.read().agg(F.count("*").alias("count")).select(F.lit(updated_at).alias("updated_at"), "count")

    # runs

    def upsert(
        self, incoming: DataFrame, seq: str = "seq", dry_run: bool = False, rosters: DataFrame | None = None, now: str | None = None, max_loss: float = 0.5, batch: tuple[str, int] | None = None
    ) -> DataFrame:
        """incoming with a sequence (from 1) folds onto the stored rows (sequence 0). rosters(domain, key), the whole memberships
        that the run has seen, then mark who is gone, as of `now`. Returns (key, change) of what changed: new, updated, returned or
        departed. A dry run reads one version, takes no lock, writes nothing and reconciles nothing. `batch` names a stream and the
        number of its batch; one that the store holds already changes nothing."""
        if rosters is not None and now is None:
            raise ValueError("a departure has a date")
        fresh = incoming.withColumn("key", self.spec.key) if "key" not in incoming.columns else incoming
        if dry_run:
            v = self.version()
            m = self.manifest(v) if v else None
            stored = self._parts(m, self._met(fresh, m["buckets"])) if m else self._empty()
            return materialise(change_log(stored, fresh).where("change <> 'kept'"), "log")
        with self.lock() as epoch:
            v = self.version()
            before = self.manifest(v) if v else None
            if batch and before and before["batches"].get(batch[0], -1) >= batch[1]:
                return self.spark.createDataFrame([], "key string, change string")
            new, made, buckets = self._folded(fresh, before, seq, rosters, now, max_loss)
            self._write(new, before or {"rows": 0, "parts": {}, "batches": {}}, v + 1, epoch, buckets, batch)
            forget(*made)
        after = self.manifest(v + 1)
        old = before["parts"] if before else {}
        written = {int(b) for b, p in after["parts"].items() if old.get(b) != p}
        return self._parts(after, written).where("_change is not null").select("key", F.col("_change").alias("change"))

    def _met(self, keyed: DataFrame, buckets: int) -> set[int]:
        """Buckets that keys fall into: at most as many numbers as the store has buckets."""
        return {r[0] for r in keyed.select(self._bucket(buckets)).distinct().collect()}

    def _folded(self, fresh: DataFrame, before: dict | None, seq: str, rosters: DataFrame | None, now: str | None, max_loss: float) -> tuple[DataFrame, list[DataFrame], int]:
        """The merged rows of all buckets that the run touches, with _change; tables to forget after the write; the number of buckets."""
        cols = [f.name for f in self.spec.schema]
        fresh = materialise(fresh.select("key", *cols, seq), "fresh")
        made, buckets = [fresh], before["buckets"] if before else self.buckets
        numbered = lambda df: df.withColumn(seq, F.lit(0).cast(dict(fresh.dtypes)[seq]))
        gone, touched = None, self._met(fresh, buckets)
        if rosters is not None:
            # who is missing is decided on the few columns it takes, of the domains that the rosters speak of
            slim = ["key", "school_domain", "departed", "departed_at"]
            domains = rosters.select(F.lower("domain").alias("_d")).distinct()
            held = (self._parts(before) if before else self._empty()).select(*slim).join(domains, F.lower("school_domain") == F.col("_d"), "left_semi")
            live = materialise(merge(numbered(held).unionByName(fresh.select(*slim, seq)), self.spec, seq).drop("_n"), "live")
            left = reconcile(live, rosters, now, max_loss).where("departed").join(live.where("departed").select("key"), "key", "left_anti")
            gone = materialise(left.select("key", F.col("departed_at").alias("_left")), "gone")
            made += [live, gone]
            touched |= self._met(gone, buckets)
        stored = self._parts(before, touched) if before else self._empty()
        both = numbered(stored.select("key", *cols)).unionByName(fresh)
        old, came = F.col(seq) == 0, F.col(seq) > 0
        was_gone = F.bool_or(old & F.coalesce(F.col("departed"), F.lit(False))) if "departed" in cols else F.lit(False)
        new = merge(both, self.spec, seq, marks={"_had": F.bool_or(old), "_came": F.bool_or(came), "_away": was_gone}).drop("_n")
        change = F.when(~F.col("_had"), "new").when(F.col("_came") & F.col("_away"), "returned").when(F.col("_came"), "updated")
        if gone is not None:
            new = new.join(gone, "key", "left")
            change = F.when(F.col("_left").isNotNull(), "departed").otherwise(change)
            new = new.withColumn("departed", F.coalesce("departed", F.lit(False)) | F.col("_left").isNotNull()).withColumn("departed_at", F.coalesce("_left", "departed_at"))
        return new.select("key", *cols, change.alias("_change")), made, buckets
