"""Small files on any file system that Spark reads, and the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode only."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if root:
        return f"{root.rstrip('/')}/logstrata-kv-{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="logstrata-kv-")
    return _OWN[app]


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write beside and rename over, in one step, so that a reader or a crash sees the old text or the new."""
        beside = self._path(f"{name}.new")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        over = self.gateway.new_array(getattr(fs, "Options$Rename"), 1)
        over[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(beside, self._path(name), over)

    def used(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def copy(self, to: Files) -> None:
        conf = self.fs.getConf()
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(""), to.fs, to._path(""), False, True, conf)
