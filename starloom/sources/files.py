"""Folders and small text files on whatever file system a path names (local, HDFS or an object store)."""

from __future__ import annotations

import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        store, p = self._at(path)
        return store.exists(p)

    def delete(self, path: str) -> None:
        store, p = self._at(path)
        store.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        store, p = self._at(old)
        if not store.rename(p, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def names(self, folder: str) -> list[str]:
        """The names in a folder, in order; none of an absent one."""
        store, p = self._at(folder)
        return sorted(f.getPath().getName() for f in store.listStatus(p)) if store.exists(p) else []

    def read(self, path: str) -> str:
        store, p = self._at(path)
        stream = store.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def claim(self, path: str, text: str) -> bool:
        """Write a file if and only if there is none; of several writers at once one succeeds.

        On the local file system a finished file is linked to its name; others create it exclusively,
        as distributed file systems and stores with conditional writes do.
        """
        store, p = self._at(path)
        if store.getScheme() == "file":
            plain = p.toUri().getPath()
            os.makedirs(os.path.dirname(plain), exist_ok=True)
            whole = f"{plain}.{uuid.uuid4().hex}.new"
            with open(whole, "x", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(whole, plain)
            except FileExistsError:
                return False
            finally:
                os.remove(whole)
            return True
        try:
            out = store.create(p, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or store.exists(p):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def write(self, path: str, text: str) -> None:
        store, p = self._at(path)
        out = store.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def whole_path(path: str) -> str:
    """A URI or an absolute path as it is; a relative path from the working folder."""
    return path.rstrip("/") if path.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else os.path.abspath(path)
