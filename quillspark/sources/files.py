"""Small files in a folder of any file system that Spark reads."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import SparkSession


class Files:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self._hadoop = spark, spark._jvm.org.apache.hadoop.fs
        self.fs = self._hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self._hadoop.Path(root)).toString().rstrip("/")

    def path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def stamp(self) -> str:
        """Changes when the files of the folder (or the file) change."""
        held = self.fs.listStatus(self._hadoop.Path(self.root))
        return " ".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in held))

    def read(self, name: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self.path(name)), "UTF-8")

    def create(self, name: str, text: str) -> bool:
        """Whether the file is new: written aside, then put in place in one step that fails
        where the name is taken (a rename, which local folders replace by a hard link)."""
        aside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside)
        out.write(text.encode())
        out.close()
        try:
            if self.root.startswith("file:"):
                local = lambda p: self.spark._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0))
                self.spark._jvm.java.nio.file.Files.createLink(local(self.path(name)), local(aside))
            else:
                how = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop.Options, "Rename"), 0)
                self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, self.path(name), how)
        except (Py4JJavaError, PySparkException) as error:
            if "AlreadyExists" not in str(error):
                raise
            return False
        finally:
            self.fs.delete(aside, False)
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
