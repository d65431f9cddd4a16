"""Conversion of image datasets and the sink that writes them as a folder or as one zip archive.

Tasks write into a staging place beside the destination; the destination appears by one rename,
after the driver has seen that what is staged is what the tasks reported. A lost task leaves at most
a staged file of its own attempt, which no message names, so no half archive is ever visible.

Members of a folder go to their final names at once, in parallel. Those of a zip are first written as
stored zips, one for each task; the commit copies them member by member in order into the archive, since
the format is one file: its memory is one member, its time that of a copy. Labels travel as lines
beside the members and are copied in the same way; if any member has none, the list is null.
"""

from __future__ import annotations

import json
import zipfile
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import png
from ..shared import kept, ordinals

MEMBERS = "ordinal long, name string, content binary, label int, width int, height int, channels int"
#: What an archive of one class and plane calls its members, and what a converted dataset does.
FLAT, NESTED = "%05d.png", "%s/img%08d.png"


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: its first ordinal, members, bytes, and the attributes it met (two at most)."""

    path: str
    first: int
    members: int
    size: int
    labelled: bool
    attributes: list = field(default_factory=list)


class DatasetWriter(DataSourceArrowWriter):
    """Rows as ``MEMBERS`` says, in order of ordinal within a task."""

    def __init__(self, options, overwrite: bool):
        import uuid

        self.dest = options["path"].removeprefix("file://").rstrip("/")
        self.zip, self.overwrite = self.dest.lower().endswith(".zip"), overwrite
        self.square = options.get("square", "true") == "true"
        top, _, base = self.dest.rpartition("/")
        self.staging = f"{top}/.{base}-{uuid.uuid4().hex[:12]}"

    def write(self, iterator):
        import os

        c = TaskContext.get()
        own = f"{self.staging}/{c.partitionId()}-{c.taskAttemptId()}"
        os.makedirs(self.staging, exist_ok=True)
        first, members, size, labelled, seen = -1, 0, 0, True, []
        archive = zipfile.ZipFile(f"{own}.zip", "w", zipfile.ZIP_STORED) if self.zip else None
        with open(f"{own}.labels", "w", encoding="utf-8") as labels:
            for batch in iterator:
                for r in batch.to_pylist():
                    if archive:
                        archive.writestr(zipfile.ZipInfo(r["name"]), r["content"])
                    else:
                        at = f"{self.staging}/files/{r['name']}"
                        os.makedirs(os.path.dirname(at), exist_ok=True)
                        with open(f"{at}.{c.taskAttemptId()}", "wb") as f:
                            f.write(r["content"])
                        os.replace(f"{at}.{c.taskAttemptId()}", at)
                    if first < 0:
                        first = r["ordinal"]
                    members, size = members + 1, size + len(r["content"])
                    labelled &= r["label"] is not None
                    labels.write(json.dumps([r["name"], r["label"]]) + "\n")
                    shape = (r["width"], r["height"], r["channels"])
                    if shape not in seen and len(seen) < 2:
                        seen.append(shape)
        if archive:
            archive.close()
        return Staged(own, first, members, size, labelled, seen)

    def _check(self, parts: list[Staged]) -> None:
        shapes = {s for p in parts for s in p.attributes}
        if len(shapes) > 1:
            raise ValueError(f"images must have equal attributes, found {sorted(shapes)[:2]}")
        for width, height, channels in shapes:
            if self.square and (width != height or width & (width - 1) or channels not in (1, 3)):
                raise ValueError(f"square gray or RGB images with a side that is a power of two are expected, found {width}x{height}x{channels}")

    def commit(self, messages) -> None:
        import os
        import shutil

        parts = sorted((m for m in messages if m is not None and m.members), key=lambda m: m.first)
        try:
            self._check(parts)
            if os.path.exists(self.dest) and not self.overwrite and not (os.path.isdir(self.dest) and not os.listdir(self.dest)):
                raise ValueError(f"{self.dest} is there already")
            labelled = all(p.labelled for p in parts)
            made = f"{self.staging}/done"
            self._into_zip(parts, made, labelled) if self.zip else self._into_folder(parts, made, labelled)
            if os.path.isdir(self.dest):
                shutil.rmtree(self.dest)
            os.replace(made, self.dest)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    @staticmethod
    def _labels(parts: list[Staged], out, labelled: bool) -> None:
        """dataset.json, copied line by line."""
        if not labelled:
            out.write(b'{"labels": null}')
            return
        out.write(b'{"labels": [')
        mark = b""
        for p in parts:
            with open(f"{p.path}.labels", "rb") as lines:
                for line in lines:
                    out.write(mark + line.rstrip(b"\n"))
                    mark = b", "
        out.write(b"]}")

    def _into_zip(self, parts: list[Staged], made: str, labelled: bool) -> None:
        with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as out:
            for p in parts:
                with zipfile.ZipFile(f"{p.path}.zip") as part:
                    infos = part.infolist()
                    if len(infos) != p.members or sum(i.file_size for i in infos) != p.size:
                        raise ValueError(f"{p.path} does not hold what its task wrote")
                    for info in infos:
                        out.writestr(zipfile.ZipInfo(info.filename), part.read(info))
            with out.open(zipfile.ZipInfo("dataset.json"), "w", force_zip64=True) as meta:
                self._labels(parts, meta, labelled)

    def _into_folder(self, parts: list[Staged], made: str, labelled: bool) -> None:
        import os

        files = f"{self.staging}/files"
        os.makedirs(files, exist_ok=True)
        found, size = 0, 0
        for top, _, names in os.walk(files):
            for n in names:
                if n.endswith(".png"):
                    found, size = found + 1, size + os.path.getsize(f"{top}/{n}")
                else:  # of an attempt that was lost
                    os.remove(f"{top}/{n}")
        if found != sum(p.members for p in parts) or size != sum(p.size for p in parts):
            raise ValueError("the folder does not hold what the tasks wrote")
        with open(f"{files}/dataset.json", "wb") as meta:
            self._labels(parts, meta, labelled)
        os.replace(files, made)

    def abort(self, messages) -> None:
        import shutil

        shutil.rmtree(self.staging, ignore_errors=True)


class DatasetSink(DataSource):
    """``df.write.format("image_dataset")``: a path that ends in .zip is an archive, any other a folder."""

    @classmethod
    def name(cls):
        return "image_dataset"

    def schema(self):
        return MEMBERS

    def writer(self, schema, overwrite):
        return DatasetWriter(self.options, overwrite)


def transformed(images: DataFrame, transform: str | None, resolution: tuple[int, int] | None, skip_bad: bool = False, rgb: bool = False) -> DataFrame:
    """Rows (ordinal, content, label) decoded, transformed and encoded anew; what a transform rejects is left out.

    A file that is no PNG is an error, or left out with ``skip_bad``.
    """
    if transform and not resolution:
        raise ValueError(f"{transform} needs a resolution")
    if transform and transform not in png.TRANSFORMS:
        raise ValueError(f"unknown transform {transform}; known: {', '.join(png.TRANSFORMS)}")

    def one(data: bytes) -> np.ndarray | None:
        image = png.decode(data)
        if rgb and image.ndim == 2:
            image = np.repeat(image[..., None], 3, axis=2)
        if transform:
            return png.TRANSFORMS[transform](image, *resolution)
        return png.resize(image, *resolution) if resolution else image

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    image = one(r["content"])
                except (ValueError, TypeError):
                    if not skip_bad:
                        raise
                    continue
                if image is not None:
                    out.append((r["ordinal"], png.encode(image), r["label"], image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3))
            c = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], ["ordinal", "content", "label", "width", "height", "channels"])

    return images.select("ordinal", "content", F.col("label").cast("int").alias("label")).mapInArrow(run, "ordinal long, content binary, label int, width int, height int, channels int")


def write(members: DataFrame, dest: str, overwrite: bool = False, square: bool = True) -> None:
    """Members in order of ordinal to ``dest``."""
    members.sparkSession.dataSource.register(DatasetSink)
    rows = members.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select(*[c.split()[0] for c in MEMBERS.split(", ")])
    rows.write.format("image_dataset").mode("overwrite" if overwrite else "append").option("square", str(square).lower()).save(dest)


def convert(images: DataFrame, dest: str, transform: str | None = None, resolution: tuple[int, int] | None = None, max_images: int | None = None, overwrite: bool = False) -> None:
    """A dataset from (name, content, label): numbered by name before the transform, which may leave gaps, and checked for equal square sizes."""
    rows = ordinals(images.select("name", "content", "label"), ["name"])
    if max_images is not None:
        rows = rows.filter(F.col("ordinal") < max_images)
    name = F.format_string("%s/img%08d.png", F.substring(F.format_string("%08d", "ordinal"), 1, 5), "ordinal")
    write(transformed(rows, transform, resolution).withColumn("name", name), dest, overwrite)


def archive(images: DataFrame, dest: str, resolution: int, overwrite: bool = True) -> None:
    """An archive of RGB images 00000.png and on, all of one size; files that cannot be read are left out and leave no gap."""
    rows = ordinals(images.select("name", "content", "label"), ["name"])
    done = kept(transformed(rows, None, (resolution, resolution), skip_bad=True, rgb=True).withColumnRenamed("ordinal", "source"), "images")
    write(ordinals(done, ["source"]).withColumn("name", F.format_string(FLAT, "ordinal")), dest, overwrite, square=False)


def encoded(spark: SparkSession, df: DataFrame, pixels: str, width: int, height: int, channels: int = 1) -> DataFrame:
    """Column ``content``: PNG files of arrays of pixel values from 0 to 255, row by row."""
    shape = (height, width) if channels == 1 else (height, width, channels)

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index(pixels)).to_pylist()
            made = [png.encode(np.array(v, np.uint8).reshape(shape)) for v in x]
            yield batch.append_column("content", pa.array(made, pa.binary()))

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, content binary")


def pixel_sums(members: DataFrame) -> DataFrame:
    """Rows (name, label, width, height, pixel_sum, first_pixel) of PNG members, decoded."""

    def run(batches):
        for batch in batches:
            images = [png.decode(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([i.shape[1] for i in images], pa.int32()), pa.array([i.shape[0] for i in images], pa.int32()), pa.array([int(i.sum()) for i in images], pa.int64()), pa.array([int(i.flat[0]) for i in images], pa.int32())],
                ["name", "label", "width", "height", "pixel_sum", "first_pixel"],
            )

    return members.select("name", "content", "label").mapInArrow(run, "name string, label int, width int, height int, pixel_sum long, first_pixel int")

