"""Gets this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession

from .model import InvalidSetting

#: Settings of a session that give defaults to controls and options: see setting().
PREFIX = "spark.echograin."
_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless workers find it by PYTHONPATH."""
    context = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    # Made on the driver, from where Spark serves it to the executors.
    path = Path(tempfile.mkdtemp(prefix="echograin-")) / "echograin.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((_ROOT / "echograin").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors reach, spark.checkpoint.dir; where a local session names none, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise InvalidSetting("set spark.checkpoint.dir to a folder that all executors reach")
        folder = "file://" + tempfile.mkdtemp(prefix="echograin-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/echograin/{name}-{uuid.uuid4().hex}"


def setting(spark: SparkSession, name: str, kind: type, default):
    """A default that the session's settings may replace, such as spark.echograin.window."""
    value = spark.conf.get(PREFIX + name, None)
    if value is None:
        return default
    try:
        return kind(value)
    except ValueError:
        raise InvalidSetting(f"{PREFIX}{name} can't be {value}") from None


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, or of a URI with Hadoop's names for object stores too, and the path in it."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    for known in ("s3a://", "s3n://"):
        if uri.startswith(known):
            uri = "s3://" + uri[len(known) :]
    return fs.FileSystem.from_uri(uri)
