"""Audio discovery and loading: files by suffix, one status per file, content read only on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx


class InputNotFound(ValueError):
    pass


class NoInputs(ValueError):
    pass


class DuplicateOutput(ValueError):
    pass


def normalise_extensions(values) -> list[str]:
    out = list(dict.fromkeys(str(v).strip().lower() for v in values))
    if not out or any(not v.startswith(".") or len(v) < 2 for v in out):
        raise ValueError("extensions start with a dot")
    return out


def scan_audio(spark: SparkSession, path: str, extensions=tuple(lx.AUDIO_FORMATS), content: bool = False) -> DataFrame:
    """Supported files of a folder (not below it), or one file, by name: path, name, stem, format, length, status."""
    names = normalise_extensions(extensions)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    except Exception as e:
        raise InputNotFound(path) from e
    # the reader skips empty files; a folder's listing names them
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    empty = [(str(x.getPath().toString()), 0) for x in listed if x.isFile() and x.getLen() == 0]
    files = files.unionByName(spark.createDataFrame(empty, "path string, length long"), allowMissingColumns=True)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in lx.AUDIO_FORMATS.items() for x in kv]), suffix)
    out = files.withColumn("name", name).where(suffix.isin(*names)).withColumns({"stem": F.regexp_replace("name", r"\.[^.]+$", ""), "format": kind})
    status = F.when(F.col("format").isNull(), "unsupported").when(F.col("length") == 0, "empty").otherwise("ok")
    return out.withColumn("status", status).select("path", "name", "stem", "format", "length", "status", *(["content"] if content else []))


def discover(spark: SparkSession, path: str, extensions=tuple(lx.AUDIO_FORMATS)) -> DataFrame:
    """As scan_audio, in order of name; raises where there is nothing, or where two files share an output name."""
    files = scan_audio(spark, path, extensions)
    if files.isEmpty():
        raise NoInputs(path)
    twice = files.groupBy("stem").count().where("count > 1").select("stem").head(1)
    if twice:
        raise DuplicateOutput(twice[0]["stem"])
    return files.orderBy("name")
