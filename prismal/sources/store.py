"""Objects and files by uri: paths, local files, and stores that pyarrow knows (s3, gs, hdfs)."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config


def parse(uri: str) -> tuple[str, str, str]:
    """(scheme, bucket or host, key). A path without a scheme is a file, whose key is the path."""
    if "://" not in uri and not uri.startswith("file:"):
        if not uri.strip():
            raise ValueError("an empty uri")
        return "file", "", uri
    parts = urlsplit(uri)
    if parts.scheme == "file":
        return "file", "", unquote(parts.path)
    if not parts.netloc or not parts.path.strip("/"):
        raise ValueError(f"no object in {uri}")
    return parts.scheme, parts.netloc, unquote(parts.path.lstrip("/"))


def _open(uri: str):
    """A readable file of pyarrow."""
    from pyarrow import fs

    scheme, _, key = parse(uri)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file(key)
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))
    return store.open_input_file(path)


def stream(uri: str, chunk: int = 4096) -> Iterator[bytes]:
    """An object's bytes in chunks."""
    with _open(uri) as f:
        while data := f.read(chunk):
            yield data


def write(uri: str, data: bytes) -> None:
    """One object; folders are made."""
    from pyarrow import fs

    scheme, _, key = parse(uri)
    store, path = (fs.LocalFileSystem(), key) if scheme == "file" else fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def local_copy(uri: str, folder: str = "") -> str:
    """A path that libraries for files can open: a file's own; a uri of http stays one; of another store, a copy made once.

    Copies are written under another name and then renamed, so tasks that copy the same object do no harm.
    """
    scheme, bucket, key = parse(uri)
    if scheme == "file":
        return key
    if scheme in ("http", "https"):
        return uri
    path = os.path.join(folder or os.path.join(tempfile.gettempdir(), "prismal-files"), bucket, key)
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for data in stream(uri, 1 << 20):
                f.write(data)
        os.replace(part, path)
    return path


def connect(spark: SparkSession, endpoint: str = "", region: str = "") -> None:
    """Endpoint and region of an object store for Spark's own readers, by the session's settings unless given."""
    conf = spark._jsc.hadoopConfiguration()
    endpoint, region = endpoint or config.get(spark, "store.endpoint"), region or config.get(spark, "store.region")
    if endpoint:
        conf.set("fs.s3a.endpoint", endpoint)
        conf.set("fs.s3a.path.style.access", "true")
    if region:
        conf.set("fs.s3a.endpoint.region", region)


def listing(spark: SparkSession, uri: str) -> DataFrame:
    """path, length and modificationTime of all objects below a uri, relative to it in `key`; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri).select("path", "length", "modificationTime")
    base = uri.rstrip("/").removeprefix("file://").removeprefix("file:")
    return files.withColumn("key", F.element_at(F.split("path", base + "/", 2), -1))
