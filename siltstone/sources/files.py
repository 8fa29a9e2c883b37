"""Small files that decide: commits, pointers and ledgers, each written once and whole."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not be there yet; False, and nothing changed, if it is.

    Of several writers one wins: the text is written aside and then renamed (a local file: linked)
    to its name, which these file systems refuse if the name is taken.
    """
    jvm = spark.sparkContext._jvm
    files, target = _path(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}.new"
    _, new = _path(spark, aside)
    files.mkdirs(target.getParent())
    out = files.create(new, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if files.getUri().getScheme() == "file":
            local = lambda p: unquote(urlsplit(p).path)
            os.link(local(aside), local(path))
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            flags = spark.sparkContext._gateway.new_array(kind, 1)
            flags[0] = kind.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(new, target, flags)
        return True
    except Exception:
        if not files.exists(target):
            raise
        return False
    finally:
        files.delete(new, False)


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None."""
    files, p = _path(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; those still being written are left out."""
    files, p = _path(spark, folder)
    if not files.exists(p):
        return []
    return sorted(n for s in files.listStatus(p) if not (n := s.getPath().getName()).endswith((".new", ".crc")))


def remove(spark: SparkSession, path: str) -> bool:
    files, p = _path(spark, path)
    return files.delete(p, True)
