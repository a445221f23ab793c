"""Small operations on the file system that holds the store, through Spark's own clients (local, HDFS, object stores)."""

from __future__ import annotations

import atexit
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidewell.operators import lanes


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_dir: bool
    n_bytes: int
    changed: int


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.delete(p, True)

    def rename(self, a: str, b: str) -> None:
        p, fs = self._at(a)
        q, _ = self._at(b)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"cannot rename {a} to {b}")

    def entries(self, path: str) -> list[Entry]:
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        return sorted((Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)), key=lambda e: e.name)

    def walk(self, path: str) -> list[Entry]:
        """All files below a path."""
        out = []
        for e in self.entries(path):
            out.extend(self.walk(e.path) if e.is_dir else [e])
        return out

    def copy(self, a: str, b: str) -> None:
        p, fs = self._at(a)
        q, _ = self._at(b)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs, q, False, self._conf)

    def read_text(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Makes a new file, whole or not at all; an error if it is there already."""
        p, fs = self._at(path)
        tmp, _ = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        fs.mkdirs(p.getParent())
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise OSError(f"cannot write {path}")


class Manifest:
    """What a table consists of, as JSON in numbered versions: a reader sees one version whole, and a writer makes the
    next one in one step. Two writers cannot make the same version."""

    KEPT = 5

    def __init__(self, files: Files, path: str):
        self.files, self.path = files, f"{path}/_manifest"
        self.version = 0

    def _versions(self) -> list[int]:
        return sorted(int(e.name[2:-5]) for e in self.files.entries(self.path) if e.name.startswith("v-") and e.name.endswith(".json"))

    def _file(self, version: int) -> str:
        return f"{self.path}/v-{version:012d}.json"

    def read(self) -> dict | None:
        """The latest version; None if there is none."""
        versions = self._versions()
        if not versions:
            return None
        self.version = versions[-1]
        return json.loads(self.files.read_text(self._file(self.version)))

    def write(self, content: dict) -> None:
        """The next version after the one that was read or written last."""
        self.files.write_text(self._file(self.version + 1), json.dumps(content))
        self.version += 1
        for old in self._versions()[: -self.KEPT]:
            self.files.delete(self._file(old))


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared folder of the cluster, deleted at the end of the program."""
    path = f"{lanes.shared_folder(spark)}/tidewell-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            Files(spark).delete(path)
        except Exception:  # the session has ended
            pass

    atexit.register(clean)
    return path
