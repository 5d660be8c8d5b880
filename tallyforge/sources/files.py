"""Files through Hadoop's FileSystem, so that the same code works on local disks and on shared stores."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes that a file may have to be hashed: a task holds it whole.
LONGEST = (1 << 31) - 1


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        fs.mkdirs(self._at(new)[1].getParent())
        if not fs.rename(p, self._at(new)[1]):
            raise OSError(f"can't rename {old} to {new}")

    def remove_under(self, path: str, root: str) -> None:
        """Deletes path only if it lies strictly under root."""
        fs, p = self._at(path)
        whole, top = (fs.makeQualified(x).toUri().normalize().getPath().rstrip("/") for x in (p, self._at(root)[1]))
        if ".." in path.split("/") or not whole.startswith(top + "/"):
            raise ValueError(f"Unsafe removal: {path}")
        fs.delete(p, True)

    def sha256(self, path: str) -> str:
        return self.hashes([path])[path]

    def hashes(self, paths: list[str]) -> dict[str, str]:
        """SHA-256 of each file, by path. Executors do it, a task for each file, which holds the file whole.

        Curated files have at most FILE_ROWS rows; a source of two GiB or more is refused, its year has to be split.
        """
        if not paths:
            return {}
        wanted: dict[str, list[str]] = {}
        found = {}
        for path in paths:
            fs, p = self._at(path)
            n = fs.getFileStatus(p).getLen()
            if n > LONGEST:
                raise ValueError(f"{path} has more than {LONGEST} bytes: split it")
            if n == 0:  # which the reader leaves out
                found[path] = hashlib.sha256().hexdigest()
                continue
            wanted.setdefault(fs.makeQualified(p).toString(), []).append(path)
        rows = self.spark.read.format("binaryFile").load(list(wanted)).select("path", F.sha2("content", 256).alias("sha256")).collect() if wanted else []  # one short row for each file
        for row in rows:
            fs, p = self._at(row["path"])
            found |= dict.fromkeys(wanted[fs.makeQualified(p).toString()], row["sha256"])
        return found

    def listing(self, path: str) -> dict[str, int]:
        """Sizes of all files under path, by path relative to it; names that begin with _ or . are left out."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return {}
        found, base = {}, fs.makeQualified(p).toString().rstrip("/") + "/"
        each = fs.listFiles(p, True)
        while each.hasNext():
            f = each.next()
            name = f.getPath().toString()[len(base) :]
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                found[name] = f.getLen()
        return found

    def stamps(self, path: str) -> list[tuple[str, int, int]]:
        """(path, size, time of change) of every data file under path, or of the one file that it is."""
        fs, p = self._at(path)
        found, each = [], fs.listFiles(p, True)
        while each.hasNext():
            f = each.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return found

    def write_json(self, path: str, value: dict) -> None:
        """Written beside and renamed over, so that readers see the old or the new whole."""
        fs, p = self._at(path)
        beside = self._at(path + ".tmp")[1]
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode()))
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(beside), fs.makeQualified(p), over)

    def _create(self, path: str, value: dict) -> bool:
        """Whether the file was created: only one process can."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        try:
            out = fs.create(p, False)
        except Exception as error:
            if "already exists" not in str(error).lower():
                raise
            return False
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return True

    @contextmanager
    def locked(self, path: str, stale_after: float = 6 * 3600) -> Iterator[None]:
        """Holds a lock file, which only one process can create. It names its owner and when it was taken.

        A lock that is older than stale_after seconds was left by a driver that died: it is moved aside by a rename, which
        again only one process can win, and taken over. Work under a lock has to be shorter than that.
        """
        owner = {"owner": uuid.uuid4().hex, "application": self.spark.sparkContext.applicationId, "at": time.time()}
        if not self._create(path, owner):
            fs, p = self._at(path)
            try:
                age = time.time() - fs.getFileStatus(p).getModificationTime() / 1000
            except Exception:  # it was released meanwhile
                age = 0.0
            if age <= stale_after or not fs.rename(p, self._at(f"{path}.stale-{owner['owner']}")[1]) or not self._create(path, owner):
                raise RuntimeError(f"IMPORT_LOCKED: {path}")
            fs.delete(self._at(f"{path}.stale-{owner['owner']}")[1], False)
        try:
            yield
        finally:
            if (self.read_json(path) or {}).get("owner") == owner["owner"]:
                fs, p = self._at(path)
                fs.delete(p, False)

    def read_json(self, path: str) -> dict | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
