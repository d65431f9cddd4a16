"""A file of the shared folder that is missing or short is an error, never an empty table."""

import glob
import os

import numpy as np
import pytest

from sievewright.llm import common, kneser_ney, line_templates, recompression
from sievewright.llm.common import read
from sievewright.llm.wordhash import local_path

MAKES = {
    "lines": lambda spark, docs: line_templates.line_dedup(spark, docs),
    "ngrams": lambda spark, docs: kneser_ney.lm_scores(spark, docs),
    "windows": lambda spark, docs: recompression.substring_dedup(spark, docs),
}


@pytest.mark.parametrize("label", MAKES)
def test_lost_files_raise(spark, sf, label):
    before = len(common._made)
    out = MAKES[label](spark, read(spark, sf, "documents"))
    assert out.count()
    folders = [local_path(f) for f in common._made[before:] if f"/{label}" in f]
    name = max((n for f in folders for n in glob.glob(f"{f}/*-*")), key=os.path.getsize)
    with open(name, "rb") as f:
        whole = f.read()
    np.save(f"{name}.npy", np.zeros(1, np.uint64))
    os.replace(f"{name}.npy", name)
    with pytest.raises(Exception, match="entries, not"):
        out.collect()
    os.remove(name)
    with pytest.raises(Exception, match="No such file"):
        out.collect()
    with open(name, "wb") as f:
        f.write(whole)
    assert out.collect()


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "master", "spark://somewhere:7077", raising=False)
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(spark, "x")
