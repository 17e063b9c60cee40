"""Numbered versions of a folder, each published by one rename that cannot happen twice."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Somebody else published the version first."""


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Whether a folder got a new name; False if that name is taken. The file system decides, not a look beforehand."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop = jvm.org.apache.hadoop.fs
    names = [hadoop.Path(p).getFileSystem(conf).makeQualified(hadoop.Path(p)) for p in (source, target)]
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(names[1].toUri(), conf).rename(*names, options)
    except Py4JJavaError as err:
        if err.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The manifest rows of all versions, with their number as ``version``."""
    try:
        return spark.read.schema(f"{schema}, version bigint").parquet(f"{path}/manifest")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, version bigint")


def last_version(spark: SparkSession, path: str, schema: str) -> int:
    """0 before the first."""
    return published(spark, path, schema).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def publish(rows: DataFrame, path: str, version: int) -> None:
    """Make ``rows`` the manifest of a version, whole or not at all; raises Conflict if the number is taken."""
    spark, waiting = rows.sparkSession, f"{path}/manifest/_next-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(waiting)
    if not _renamed(spark, waiting, f"{path}/manifest/version={version}"):
        raise Conflict(f"version {version} of {path}")
