"""Stored stages: what an earlier stage wrote is read, not computed again.

A stage's folder lies in the shared folder under a name made from the input files' paths, sizes and
times of change and from the stage's parameters, so changed data or parameters make
another stage, and nothing stale is read. A writer works in an attempt folder of its own while it
holds the stage's lease, a file that it creates only if there is none and renews while it
works. It publishes by creating the file that names its attempt, again only if there is none, and removes the
attempts that are not named. A session that finds the lease taken waits for what is published; a
lease that has not been renewed for a while belongs to a writer that ended, and is taken over.
"""

from __future__ import annotations

import hashlib
import os
import random
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tables import table_path

#: A lease is renewed every so many seconds, and stale when it was not for several times as long.
RENEW_S, STALE_S = 5.0, 30.0
#: Some file systems (the local one) look first and create then, so two may have created it: after this while the content decides.
SETTLE_S = 0.3


def fingerprint(spark: SparkSession, sf_dir: str, *tables: str) -> str:
    """Digest of the files of some input tables: their paths, sizes and times, a row per file (none is opened)."""
    parts = []
    for t in tables:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(table_path(sf_dir, t))
                 .select("path", "length", "modificationTime"))
        row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("h")).first()
        parts.append(f"{t}:{row['n']}:{row['h']}")
    return "|".join(parts)


class Folder:
    """The few file operations that stages need, on whatever file system the shared folder is on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path, spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, name) if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def create(self, name: str, content: str, replace: bool = False) -> bool:
        """Write a small file; false if it is there already and ``replace`` is not asked for."""
        try:
            out = self._fs.create(self._at(name), replace)
        except Exception as e:      # noqa: BLE001 (the file system says so in its own ways)
            if replace or not self.exists(name):
                raise e
            return False
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        """Content of a small file; none if there is no such file (any more), empty if it cannot be read."""
        try:
            stream = self._fs.open(self._at(name))
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Exception:           # noqa: BLE001
            return "" if self.exists(name) else None

    def age(self, name: str) -> float:
        """Seconds since the file was written, by this machine's clock; infinite if it is gone."""
        if not self.exists(name):
            return float("inf")
        return time.time() - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(""))] if self.exists("") else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def stage_path(spark: SparkSession, name: str, *keys: object) -> str:
    digest = hashlib.md5(repr(keys).encode()).hexdigest()
    return os.path.join(ensure_checkpoint_dir(spark), "stages", f"{name}-{digest}")


def stored(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """The folder of the stage at ``path``, written first by ``write(folder)`` when none is published."""
    folder, me = Folder(spark, path), f"attempt-{uuid.uuid4().hex}"
    while True:
        named = folder.read("PUBLISHED")
        if named:
            return os.path.join(path, named)
        if not folder.create("LEASE", me):
            if folder.age("LEASE") > STALE_S:
                folder.delete("LEASE")
            else:
                time.sleep(min(1.0, RENEW_S))
            continue
        time.sleep(SETTLE_S)
        holder = folder.read("LEASE")
        if holder != me:
            if holder == "":                     # two wrote it at once: both step back for a moment
                folder.delete("LEASE")
                time.sleep(random.random())
            continue
        ended = threading.Event()

        def renew() -> None:
            while not ended.wait(RENEW_S):
                folder.create("LEASE", me, replace=True)

        keeper = threading.Thread(target=renew, daemon=True)
        keeper.start()
        try:
            if not folder.exists("PUBLISHED"):
                write(os.path.join(path, me))
                folder.create("PUBLISHED", me)       # the first to publish counts, if a lease was taken over in between
                named = folder.read("PUBLISHED")
                for other in folder.names():
                    if other.startswith("attempt-") and other != named:
                        folder.delete(other)
        finally:
            ended.set()
            keeper.join()
            if folder.read("LEASE") == me:
                folder.delete("LEASE")


def table(spark: SparkSession, path: str, write: Callable[[str], None]) -> DataFrame:
    """The Parquet table of the stage at ``path``, written first when none is published."""
    return spark.read.parquet(stored(spark, path, write))
