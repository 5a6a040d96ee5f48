"""Small files in a folder of any file system Spark can reach, through Hadoop's interface."""

from __future__ import annotations

import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """``path`` is the folder's full address, ``file:/…`` or ``hdfs://…``; names are within it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        given = self._jvm.org.apache.hadoop.fs.Path(str(path))
        self._fs: Any = given.getFileSystem(self._conf)
        self.path = str(self._fs.makeQualified(given).toString()).rstrip("/")

    def _at(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def text(self, name: str) -> str | None:
        """The text of a file, None if there is none of that name."""
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """Files of a folder below this one, sorted."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at(folder)) if f.isFile())

    def publish(self, name: str, text: str) -> bool:
        """Make a file visible with all of its text, or change nothing and say no where the name is taken.

        It is written aside and then given its name: by a hard link on a local disk, whose renames would replace a file, and by a rename that
        replaces nothing elsewhere.
        """
        parent = name.rpartition("/")[0]
        draft, target = self._at(f"{parent}/.{uuid.uuid4().hex}"), self._at(name)
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
            out.hsync()
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                link, existing = (self._jvm.java.nio.file.Paths.get(p.toUri()) for p in (target, draft))
                self._jvm.java.nio.file.Files.createLink(link, existing)
            else:
                options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, target, options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True
