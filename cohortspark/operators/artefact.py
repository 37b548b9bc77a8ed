"""Stored models: complete versions in a folder of any Hadoop file system, and a pointer to the one in use."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.boosting import Boosted

FORMAT = 1
META, POINTER = "meta.json", "CURRENT"


class Refused(ValueError):
    """A stored model that this code must not use."""


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, name: str, text: str) -> None:
    out = _fs(spark, name).create(_path(spark, name), False)  # never over another file
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _text(spark: SparkSession, name: str) -> str:
    return spark.read.text(name, wholetext=True).first()[0]


def _sums(spark: SparkSession, folder: str) -> dict[str, str]:
    """The checksum of every file of a model, by its place in the folder; files are read where Spark runs."""
    files: DataFrame = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    place = F.substring_index("path", f"/{folder.rstrip('/').rsplit('/', 1)[1]}/", -1)
    return {r["place"]: r["sum"] for r in files.select(place.alias("place"), F.sha2("content", 256).alias("sum")).collect()}


def use(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the one in use: the pointer is written beside and renamed over the old one, in one step where the file system can."""
    beside = f"{root}/{POINTER}.{uuid4().hex}"
    _put(spark, beside, version + "\n")
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    whole = _fs(spark, root).makeQualified(_path(spark, root))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(_path(spark, f"{whole}/{beside.rsplit('/', 1)[1]}"), _path(spark, f"{whole}/{POINTER}"), over)


def publish(spark: SparkSession, root: str, models: dict[str, Boosted], contract: dict, version: str | None = None, current: bool = True) -> str:
    """Store ``models`` by name as a new version and, unless told otherwise, make it the one in use; returns its name.

    ``contract`` says what the models take and tell, in JSON values; ``load`` holds it against what its caller expects.
    A version counts once its ``meta.json`` is there, which is written last and never overwritten, so of two writers of
    one version one fails and a job that dies leaves nothing that ``load`` would take.
    """
    version = version or uuid4().hex
    at = f"{root}/{version}"
    if _fs(spark, at).exists(_path(spark, f"{at}/{META}")):
        raise FileExistsError(f"version {version} is there already")
    for name, m in models.items():
        m.trees.write().save(f"{at}/models/{name}")
    about = {name: {"features": m.features, "dropped": m.dropped, "fills": m.fills, "base": m.base, "marked": m.marked} for name, m in models.items()}
    _put(spark, f"{at}/{META}", json.dumps({"format": FORMAT, "version": version, "contract": contract, "models": about, "checksums": _sums(spark, f"{at}/models")}, indent=2))
    if current:
        use(spark, root, version)
    return version


def load(spark: SparkSession, root: str, expected: dict, version: str | None = None) -> tuple[dict[str, Boosted], dict]:
    """The models of the version in use, or of ``version``, and what is stored about them.

    ``Refused`` without a pointer, without what it points to, with another format, where the contract says anything else
    than ``expected``, and where a file is missing, new or changed.
    """
    fs = _fs(spark, root)
    if version is None:
        if not fs.exists(_path(spark, f"{root}/{POINTER}")):
            raise Refused(f"no model is in use in {root}")
        version = _text(spark, f"{root}/{POINTER}").strip()
    at = f"{root}/{version}"
    if not fs.exists(_path(spark, f"{at}/{META}")):
        raise Refused(f"version {version} has no {META}")
    meta = json.loads(_text(spark, f"{at}/{META}"))
    if meta.get("format") != FORMAT:
        raise Refused(f"format {meta.get('format')}, this code reads {FORMAT}")
    for key in sorted({*expected, *meta["contract"]}):
        if expected.get(key) != meta["contract"].get(key):
            raise Refused(f"{key} is {meta['contract'].get(key)!r}, not {expected.get(key)!r}")
    if _sums(spark, f"{at}/models") != meta["checksums"]:
        raise Refused(f"files of version {version} are not those that were stored")
    read = lambda n, m: Boosted(tuple(m["features"]), tuple(m["dropped"]), tuple(m["fills"]), m["base"], GBTRegressionModel.load(f"{at}/models/{n}"), None if m.get("marked") is None else tuple(m["marked"]))
    return {n: read(n, m) for n, m in meta["models"].items()}, meta
