"""A materialise-once cache that several applications may fill at the same time.

A writer puts its copy into a folder of its own, lists that folder's files in a manifest beside it, and publishes by renaming the
manifest to the table's one name, which fails if it is taken.  So a table appears whole or not at all; who comes second drops its own copy
and reads the first one's, and a writer that dies leaves a folder that nobody reads.  Paths are Hadoop paths throughout."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


class _Folder:
    """The Hadoop folder of one cached table."""

    def __init__(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        self.jvm, self.gateway, self.conf = sc._jvm, sc._gateway, sc._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def files(self, name: str) -> dict[str, int]:
        """Data files of a copy and their lengths."""
        if not self.fs.exists(self.at(name)):
            return {}
        found = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.at(name)) if s.isFile()}
        return {n: size for n, size in found.items() if not n.startswith(("_", "."))}

    def manifest(self) -> dict | None:
        if not self.fs.exists(self.at(MANIFEST)):
            return None
        stream = self.fs.open(self.at(MANIFEST))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> bool:
        """Give the manifest its name; False if another one has it."""
        draft = f"{MANIFEST}.{manifest['copy']}"
        out = self.fs.create(self.at(draft), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(MANIFEST).toUri(), self.conf)
        try:
            context.rename(self.at(draft), self.at(MANIFEST), options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self.fs.delete(self.at(draft), False)
            return False

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def cached_copy(spark: SparkSession, path: str) -> str | None:
    """The folder of the published copy, None if there is none; a copy that lacks files of its manifest is an error."""
    folder = _Folder(spark, path)
    manifest = folder.manifest()
    if manifest is None:
        return None
    if folder.files(manifest["copy"]) != manifest["files"]:
        raise RuntimeError(f"{path}: the stored copy is not what its manifest lists")
    return f"{folder.path}/{manifest['copy']}"


def materialise_once(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, computed and stored if no application has published it yet."""
    copy = cached_copy(spark, path)
    if copy is None:
        folder, own = _Folder(spark, path), f"copy-{uuid.uuid4().hex}"
        compute().write.mode("errorifexists").parquet(f"{folder.path}/{own}")
        if not folder.publish({"copy": own, "files": folder.files(own)}):
            folder.drop(own)
        copy = cached_copy(spark, path)
    return spark.read.parquet(copy)
