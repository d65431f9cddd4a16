"""The sink of feature matrices: one .npy file and its lineage, committed whole."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Rows(WriterCommitMessage):
    """What one task wrote: its first row, rows and width."""

    path: str
    first: int
    rows: int
    width: int


class FeatureWriter(DataSourceArrowWriter):
    """Rows (row_id, vector) in order; vectors of unequal width are an error."""

    def __init__(self, options, overwrite: bool):
        self.dest, self.overwrite = options["path"].removeprefix("file://"), overwrite
        top, _, base = self.dest.rpartition("/")
        self.staging = f"{top}/.{base}-{uuid.uuid4().hex[:12]}"

    def write(self, iterator):
        c = TaskContext.get()
        own = f"{self.staging}/{c.partitionId()}-{c.taskAttemptId()}"
        os.makedirs(self.staging, exist_ok=True)
        first, rows, width = -1, 0, 0
        with open(own, "wb") as out:
            for batch in iterator:
                if not len(batch):
                    continue
                first = batch.column(0)[0].as_py() if first < 0 else first
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4")
                here = len(flat) // len(batch)
                if len(flat) != here * len(batch) or width not in (0, here):
                    raise ValueError("vectors must be of one width")
                width, rows = here, rows + len(batch)
                out.write(flat.tobytes())
        return Rows(own, first, rows, width)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        try:
            if len({p.width for p in parts}) > 1:
                raise ValueError("vectors must be of one width")
            if os.path.exists(self.dest) and not self.overwrite:
                raise ValueError(f"{self.dest} is there already")
            n, width = sum(p.rows for p in parts), parts[0].width if parts else 0
            digest, made = hashlib.sha256(), f"{self.staging}/done"
            os.makedirs(self.staging, exist_ok=True)
            with open(made, "wb") as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (n, width)})
                for p in parts:
                    if os.path.getsize(p.path) != 4 * p.rows * width:
                        raise ValueError(f"{p.path} does not hold what its task wrote")
                    with open(p.path, "rb") as f:
                        while piece := f.read(1 << 22):
                            out.write(piece)
                            digest.update(piece)
            with open(f"{self.staging}/lineage", "w", encoding="utf-8") as f:
                json.dump({"rows": n, "sha256": digest.hexdigest(), "width": width}, f, sort_keys=True)
            os.replace(f"{self.staging}/lineage", f"{self.dest}.lineage.json")
            os.replace(made, self.dest)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FeatureSink(DataSource):
    """``df.write.format("feature_file")``."""

    @classmethod
    def name(cls):
        return "feature_file"

    def schema(self):
        return "row_id long, vector array<float>"

    def writer(self, schema, overwrite):
        return FeatureWriter(self.options, overwrite)
