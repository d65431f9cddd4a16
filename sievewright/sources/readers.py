"""Readers by kind: manifests, JSON lines, delimited plot data, images, feature arrays, archives."""

from __future__ import annotations

import fnmatch
import io
import re
import struct
import warnings
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.scalars import file_stem, test_name
from ..operators.relational import guard_unique, mode_policy

MANIFEST = "filepath string, class string, plane string, source string"
#: The enums of the manifest.
CLASSES, PLANES, SOURCES = ("glioma", "meningioma", "no_tumor", "pituitary"), ("ax", "co", "sa"), ("real", "synthetic")
_IMAGE = r"(?i)\.(jpg|jpeg|png)$"
_READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(kind: str):
    def keep(f):
        _READERS[kind] = f
        return f

    return keep


def read(spark: SparkSession, kind: str, path, **options) -> DataFrame:
    """Dispatches to the reader of a kind."""
    if kind not in _READERS:
        raise ValueError(f"unknown kind {kind}; known: {', '.join(sorted(_READERS))}")
    return _READERS[kind](spark, path, **options)


@reader("manifest")
def manifest(spark: SparkSession, path, root: str = "", mode: str = "permissive") -> DataFrame:
    """A CSV manifest with resolved path and base name; rows outside the enums by ``mode``."""
    rows = spark.read.csv(path, header=True, schema=MANIFEST)
    full = F.when(F.startswith("filepath", F.lit("/")), F.col("filepath")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "filepath"))
    rows = rows.withColumn("path", full).withColumn("basename", F.element_at(F.split("filepath", "/"), -1))
    return mode_policy(rows, F.col("class").isin(*CLASSES) & F.col("plane").isin(*PLANES) & F.col("source").isin(*SOURCES), mode)


@reader("jsonl")
def jsonl(spark: SparkSession, path, schema: str | None = None, required: tuple[str, ...] = (), malformed: str = "PERMISSIVE") -> DataFrame:
    """JSON lines of one or many files; blank lines are skipped, a missing required key is an error that names the file."""
    rows = spark.read.json(path, schema=schema, mode=malformed)
    for key in required:
        if key not in rows.columns:
            raise ValueError(f"no record has the key {key}")
        bad = F.raise_error(F.concat(F.lit(f"{key} is missing in "), F.input_file_name())).cast("boolean")
        rows = rows.filter(F.when(F.col(key).isNotNull(), True).otherwise(bad))
    return rows


@reader("dat")
def dat(spark: SparkSession, path, sep: str = " ") -> DataFrame:
    """Plot data with a header line, all columns numeric where they can be."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=True)


@reader("results")
def results(spark: SparkSession, path, seeds: int | None = None) -> DataFrame:
    """Nested result documents; with ``seeds``, conditions with fewer runs are left out."""
    rows = spark.read.json(path, multiLine=True)
    return rows if seeds is None else complete(rows, seeds)


def complete(rows: DataFrame, seeds: int) -> DataFrame:
    """The conditions that have ``seeds`` different seeds or more."""
    full = rows.groupBy("condition").agg(F.count_distinct("seed").alias("n")).filter(F.col("n") >= seeds).select("condition")
    return rows.join(full, "condition", "left_semi")


@reader("index")
def index(spark: SparkSession, path, key: str = "image_id") -> DataFrame:
    """A CSV keyed by ``key``; null or repeated keys are an error."""
    return guard_unique(spark.read.csv(path, header=True), key)


@reader("ids")
def ids(spark: SparkSession, path, key: str = "image_id") -> DataFrame:
    """Distinct keys of several CSV files."""
    return spark.read.csv(path, header=True).select(key).distinct()


@reader("images")
def images(spark: SparkSession, path, content: bool = False) -> DataFrame:
    """Files with an image suffix below a directory, in lexical order; class and plane come from the directory."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.filter(F.rlike("path", F.lit(r"(?i)\.(jpg|jpeg|png)$")))
    folder = F.element_at(F.split("path", "/"), -2)
    kept = ["path", folder.alias("combo"), F.regexp_extract(folder, "^(.*)_([^_]+)$", 1).alias("class"), F.regexp_extract(folder, "^(.*)_([^_]+)$", 2).alias("plane"), "length"]
    return rows.select(*kept, *(["content"] if content else [])).orderBy("path")


@reader("image_folder")
def image_folder(spark: SparkSession, path, max_images: int | None = None) -> DataFrame:
    """Images below a folder with the labels of its dataset.json, by path relative to the folder; at most ``max_images`` in lexical order."""
    top = path.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = F.regexp_replace("path", "^[a-z]+:/+", "/")
    root = "/" + re.sub("^[a-z]+:/+", "", top).lstrip("/") + "/"
    images = rows.filter(F.rlike("path", F.lit(r"(?i)\.(jpg|jpeg|png)$"))).select(F.substring(place, F.lit(len(root) + 1), F.length(place)).alias("name"), "content")
    if max_images is not None:
        images = images.orderBy("name").limit(max_images)
    meta = rows.filter(F.endswith("path", F.lit("/dataset.json")) & (F.length(place) == len(root) + len("dataset.json")))
    pairs = F.explode(F.from_json(F.col("content").cast("string"), "labels array<array<string>>")["labels"])
    labels = meta.select(pairs.alias("p")).select(F.col("p")[0].alias("name"), F.col("p")[1].cast("int").alias("label"))
    return images.join(labels, "name", "left").select("name", "content", "label")


@reader("metric_lines")
def metric_lines(spark: SparkSession, path, schema: str, after_first: str | None = None) -> DataFrame:
    """JSON objects among other lines of logs; lines that are none are ignored.

    With ``after_first`` the records of least value of that column are left out: the first tick of a run is no measurement.
    """
    rows = spark.read.text(path).filter(F.rlike("value", F.lit(r"^\s*\{.*\}\s*$")))
    rows = rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r is not null").select("r.*")
    if after_first is None:
        return rows
    first = rows.agg(F.min(after_first)).first()[0]
    return rows.filter(F.col(after_first) > F.lit(first)) if first is not None else rows.limit(0)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@reader("partitions")
def partitions(spark: SparkSession, path, classes: tuple[str, ...] = CLASSES, planes: tuple[str, ...] = PLANES, below: str = "") -> DataFrame:
    """Images of one folder for each class and plane (``class_plane``, or ``class_plane/below``), in lexical order; a folder that is missing warns and is empty."""
    found = {}
    for c in classes:
        for p in planes:
            place = "/".join(x for x in (path.rstrip("/"), f"{c}_{p}", below) if x)
            if _exists(spark, place):
                found[place] = (c, p)
            else:
                warnings.warn(f"{place} is missing", stacklevel=2)
    out = spark.createDataFrame([], "path string, class string, plane string, length long")
    for place, (c, p) in found.items():
        rows = spark.read.format("binaryFile").load(place).filter(F.rlike("path", F.lit(_IMAGE)))
        out = out.unionAll(rows.select("path", F.lit(c).alias("class"), F.lit(p).alias("plane"), "length"))
    return out.orderBy("path")


@reader("class_folders")
def class_folders(spark: SparkSession, path) -> DataFrame:
    """Test images with class and plane from their names, in lexical order: without a class a row goes, an unknown plane is ``?``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.rlike("path", F.lit(_IMAGE)))
    name = test_name(file_stem(F.col("path")))
    return rows.select("path", name["class"].alias("class"), F.coalesce(name["plane"], F.lit("?")).alias("plane"), "length").filter(F.col("class").isNotNull()).orderBy("path")


@reader("listing")
def listing(spark: SparkSession, path, ignores: tuple[str, ...] = ()) -> DataFrame:
    """All files below a folder by relative path, without those of which the name or a folder on the way matches a glob of ``ignores``; names that begin with _ or . are hidden from every reader."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = F.regexp_replace("path", "^[a-z]+:/+", "/")
    top = "/" + re.sub("^[a-z]+:/+", "", path.rstrip("/")).lstrip("/") + "/"
    parts = F.split(F.substring(place, F.lit(len(top) + 1), F.length(place)), "/")
    rows = rows.select(F.array_join(parts, "/").alias("name"), parts.alias("parts"), "length")
    for glob in ignores:
        pattern = fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")
        rows = rows.filter(~F.array_contains(F.transform("parts", lambda x: F.rlike(x, F.lit(pattern))), True))  # noqa: B023
    return rows.select("name", "length").orderBy("name")


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArrayReader(DataSourceReader):
    """Rows of a two-dimensional .npy file of a float type, cut by row ranges."""

    def __init__(self, options):
        self.path, self.rows = options["path"].removeprefix("file://"), int(options.get("rowsperpartition", 100_000))

    def _header(self):
        import numpy as np

        with open(self.path, "rb") as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if fortran or len(shape) != 2:
                raise ValueError("a two-dimensional array in row order is expected")
            return shape, kind, f.tell()

    def partitions(self):
        n = self._header()[0][0]
        return [_Part(self.path, s, min(n, s + self.rows)) for s in range(0, n, self.rows)] or [_Part(self.path, 0, 0)]

    def read(self, part):
        import numpy as np

        shape, kind, offset = self._header()
        x = np.memmap(self.path, kind, "r", offset, shape) if shape[0] else np.zeros(shape)
        for i in range(part.start, part.end):
            yield i, [float(v) for v in x[i]]


class ArraySource(DataSource):
    """``spark.read.format("feature_array")``: row_id and embedding of an .npy file."""

    @classmethod
    def name(cls):
        return "feature_array"

    def schema(self):
        return "row_id long, embedding array<float>"

    def reader(self, schema: StructType):
        return ArrayReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"].removeprefix("file://"), int(options.get("filesperpartition", 1000))

    def partitions(self):
        with zipfile.ZipFile(self.path) as z:
            n = len(self._names(z))
        return [_Part(self.path, s, min(n, s + self.size)) for s in range(0, n, self.size)] or [_Part(self.path, 0, 0)]

    @staticmethod
    def _names(z: zipfile.ZipFile) -> list[str]:
        return sorted(x for x in z.namelist() if x.lower().endswith((".png", ".jpg", ".jpeg")))

    def read(self, part):
        import json

        with zipfile.ZipFile(part.path) as z:
            names = self._names(z)[part.start : part.end]
            labels = {}
            if "dataset.json" in z.namelist():
                labels = dict((json.loads(z.read("dataset.json")).get("labels") or []))
            for name in names:
                data = z.read(name)
                yield name, data, labels.get(name), *png_size(data)


class ArchiveSource(DataSource):
    """``spark.read.format("image_archive")``: members of a zip with the labels of its dataset.json."""

    @classmethod
    def name(cls):
        return "image_archive"

    def schema(self):
        return "name string, content binary, label int, width int, height int"

    def reader(self, schema: StructType):
        return ArchiveReader(self.options)


def png_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height from a PNG header; nulls for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    return None, None


@reader("features")
def features(spark: SparkSession, path, rows_per_partition: int = 100_000) -> DataFrame:
    spark.dataSource.register(ArraySource)
    return spark.read.format("feature_array").option("rowsPerPartition", rows_per_partition).load(path)


@reader("archive")
def archive(spark: SparkSession, path, files_per_partition: int = 1000) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("image_archive").option("filesPerPartition", files_per_partition).load(path)


def zipped(members: dict[str, bytes]) -> bytes:
    """A stored zip of the members, for tests and small exports."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()
