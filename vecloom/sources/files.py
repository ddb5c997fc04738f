"""Small files through Spark's own file systems, so that any store it knows will do."""

from __future__ import annotations

import json
import os
import random
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

#: How Spark says that files are missing or damaged.
UNREADABLE = (PySparkException, Py4JJavaError)


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors
    share. Only a session on one machine may do without the setting."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vecloom-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/vecloom-{uuid.uuid4().hex}"


class Store:
    """Paths below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.root = root.rstrip("/")
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def path(self, name: str) -> str:
        parts = name.split("/")
        if not name or ".." in parts or name.startswith("/"):
            raise ValueError(f"not a key below {self.root}: {name!r}")
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def get(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Written aside and renamed, so that a reader sees all of it. Where stores don't
        rename over a file that is there, this fails: see ``Versioned`` for what changes."""
        aside, target = self._path(self.path(f"{name}.{uuid.uuid4().hex}")), self._path(self.path(name))
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise OSError(f"can't rename {aside} to {target}")

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, whole and at once; False where it is.
        Stores whose renames overwrite or aren't atomic need another way; local files
        have one in hard links."""
        target = self._path(self.path(name))
        self._fs.mkdirs(target.getParent())
        if self._fs.getUri().getScheme() == "file":
            there = target.toUri().getPath()
            aside = f"{there}.{uuid.uuid4().hex}"
            with open(aside, "w", encoding="utf-8") as file:
                file.write(text)
            try:
                os.link(aside, there)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
        if self._fs.exists(target):
            return False
        aside = self._path(self.path(f"{name}.{uuid.uuid4().hex}"))
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.rename(aside, target):
            return True
        self._fs.delete(aside, False)
        return False

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(self.path(name)), True)

    def list(self, name: str = "") -> list[str]:
        at = self._path(self.path(name) if name else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def size(self, name: str) -> int:
        at = self._path(self.path(name))
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self._fs.getFileStatus(self._path(self.path(name))).getModificationTime() / 1000


#: Versions of a document that stay at least, and for how long others do: a writer that
#: sleeps longer between reading a version and writing the next one may be lost.
KEPT, KEPT_SECONDS = 20, 3_600


class Versioned:
    """A JSON document of which every change is a new numbered file that must not be
    there yet, so that of two writers one is told to look again."""

    def __init__(self, store: Store, folder: str, first: dict):
        self.store, self.folder, self.first = store, folder, first

    def _versions(self) -> list[str]:
        return [n for n in self.store.list(self.folder) if n.endswith(".json") and len(n) == 17]

    def read(self) -> tuple[int, dict]:
        """The latest version and its number, 0 for a document that was never written."""
        for _ in range(5):
            names = self._versions()
            if not names:
                return 0, json.loads(json.dumps(self.first))
            try:
                return int(names[-1][:12]), json.loads(self.store.get(f"{self.folder}/{names[-1]}"))
            except Exception:  # removed meanwhile: there is a later one
                if self._versions()[-1:] == names[-1:]:
                    raise
        raise OSError(f"{self.folder} changes too fast to be read")

    def change(self, how: Callable[[dict], dict]) -> tuple[int, dict]:
        """Write ``how(latest)``; where another writer was faster, once more from its
        version. What ``how`` raises ends it, and nothing is written."""
        for attempt in range(1_000):
            number, state = self.read()
            new = how(state)
            if new is state:
                return number, state
            if self.store.create(f"{self.folder}/{number + 1:012d}.json", json.dumps(new)):
                self._forget()
                return number + 1, new
            time.sleep(random.random() * min(0.5, 0.01 * (attempt + 1)))
        raise OSError(f"{self.folder}: other writers are always faster")

    def _forget(self) -> None:
        names = self._versions()
        if len(names) > 2 * KEPT:
            for n in names[:-KEPT]:
                if self.store.age(f"{self.folder}/{n}") > KEPT_SECONDS:
                    self.store.delete(f"{self.folder}/{n}")
