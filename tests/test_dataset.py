import io
import json
import os
import zipfile
import zlib

import duckdb
import numpy as np
import pytest

from sievewright.functions import png
from sievewright.plans import archives
from sievewright.sources import dataset, readers

SCHEMA = "name string, content binary, label int"


def filtered(image, kinds):
    """A PNG whose lines use the given filters, by the formulas of the format, pixel by pixel."""
    h, w, step = image.shape
    raw, flat = bytearray(), image.reshape(h, w * step).astype(int)
    for y in range(h):
        raw.append(kinds[y % len(kinds)])
        for i in range(w * step):
            left, up = flat[y, i - step] if i >= step else 0, flat[y - 1, i] if y else 0
            corner = flat[y - 1, i - step] if y and i >= step else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            raw.append((flat[y, i] - [0, left, up, (left + up) // 2, paeth][kinds[y % len(kinds)]]) & 255)
    head = png._chunk(b"IHDR", np.array([w, h], ">u4").tobytes() + bytes([8, {1: 0, 2: 4, 3: 2, 4: 6}[step], 0, 0, 0]))
    return png.SIGNATURE + head + png._chunk(b"IDAT", zlib.compress(bytes(raw))) + png._chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_every_filter_is_undone(step):
    image = np.random.default_rng(step).integers(0, 256, (10, 7, step)).astype(np.uint8)
    got = png.decode(filtered(image, [0, 1, 2, 3, 4]))
    assert (got == (image[..., 0] if step < 3 else image[..., :3])).all()


def test_encode_and_decode_are_inverse():
    for shape in ((5, 3), (4, 4, 3)):
        image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
        assert (png.decode(png.encode(image)) == image).all()
    for bad in (b"", b"text", png.encode(image)[:30]):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_resampling_keeps_flat_images_and_means():
    flat = np.full((9, 14), 77, np.uint8)
    assert (png.resize(flat, 5, 20) == 77).all()
    ramp = np.tile(np.arange(0, 240, 5, dtype=np.uint8), (48, 1))
    small = png.resize(ramp, 12, 12)
    assert abs(small.mean() - ramp.mean()) < 1 and (np.diff(small[0].astype(int)) > 0).all()


def test_crops():
    image = np.zeros((8, 16, 3), np.uint8)
    image[:, 4:12] = 200
    assert (png.center_crop(image, 8, 8) == 200).all()
    assert png.center_crop_wide(image, 32, 16) is None
    wide = png.center_crop_wide(image, 16, 8)
    assert wide.shape == (16, 16, 3) and (wide[:4] == 0).all() and (wide[12:] == 0).all() and (wide[4:12] == image).all()


def pictures(spark, n, side=4, label=lambda i: i % 3, parts=5):
    rng = np.random.default_rng(0)
    images = {f"d{i % 4}/{i:03d}.png": rng.integers(0, 256, (side, side)).astype(np.uint8) for i in range(n)}
    rows = [(k, bytearray(png.encode(v)), label(i)) for i, (k, v) in enumerate(images.items())]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts), images


@pytest.mark.parametrize("kind", ["zip", "folder"])
def test_round_trip_with_labels(spark, tmp_path, kind):
    df, images = pictures(spark, 50)
    dest = f"{tmp_path}/out" + (".zip" if kind == "zip" else "")
    dataset.convert(df, dest)
    got = (readers.archive(spark, dest, files_per_partition=7) if kind == "zip" else readers.image_folder(spark, dest)).collect()
    names = sorted(images)
    assert {r.name: (png.decode(bytes(r.content)).tobytes(), r.label) for r in got} == {f"00000/img{i:08d}.png": (images[n].tobytes(), int(n[3:6]) % 3) for i, n in enumerate(names)}
    assert [f for f in os.listdir(tmp_path) if f.startswith(".")] == []
    if kind == "zip":
        with zipfile.ZipFile(dest) as z:
            assert z.namelist() == [f"00000/img{i:08d}.png" for i in range(50)] + ["dataset.json"] and z.testzip() is None
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_one_missing_label_makes_the_list_null(spark, tmp_path):
    df, _ = pictures(spark, 9, label=lambda i: None if i == 4 else i)
    dataset.convert(df, f"{tmp_path}/a.zip", max_images=8)
    with zipfile.ZipFile(f"{tmp_path}/a.zip") as z:
        assert json.loads(z.read("dataset.json")) == {"labels": None} and len(z.namelist()) == 9


def test_transform_leaves_gaps_and_the_flat_archive_none(spark, tmp_path):
    big, small = png.encode(np.full((8, 16, 3), 9, np.uint8)), png.encode(np.full((2, 2, 3), 9, np.uint8))
    df = spark.createDataFrame([("a.png", bytearray(big), 1), ("b.png", bytearray(small), 1), ("c.png", bytearray(big), 1)], SCHEMA)
    dataset.convert(df, f"{tmp_path}/w.zip", "center-crop-wide", (8, 4))
    assert [r.name for r in readers.archive(spark, f"{tmp_path}/w.zip").collect()] == ["00000/img00000000.png", "00000/img00000002.png"]
    bad = df.union(spark.createDataFrame([("b0.png", bytearray(b"no image"), 1), ("b1.png", None, 1)], SCHEMA))
    dataset.archive(bad, f"{tmp_path}/f.zip", 4)
    got = readers.archive(spark, f"{tmp_path}/f.zip").collect()
    assert [(r.name, r.width, r.height) for r in got] == [(f"{i:05d}.png", 4, 4) for i in range(3)]
    with pytest.raises(Exception):
        dataset.convert(bad, f"{tmp_path}/g.zip")


def test_unequal_or_odd_sizes_leave_nothing_behind(spark, tmp_path):
    for sizes in ((4, 8), (6, 6)):
        df = spark.createDataFrame([(f"{i}.png", bytearray(png.encode(np.zeros((s, s), np.uint8))), 0) for i, s in enumerate(sizes)], SCHEMA)
        for dest in (f"{tmp_path}/x.zip", f"{tmp_path}/x"):
            with pytest.raises(Exception, match="equal attributes|power of two"):
                dataset.convert(df, dest)
    assert os.listdir(tmp_path) == []


def test_a_failing_task_leaves_no_half_archive(spark, tmp_path):
    df, _ = pictures(spark, 30)
    broken = df.union(spark.createDataFrame([("zz.png", bytearray(b"broken"), 0)], SCHEMA))
    for dest in (f"{tmp_path}/x.zip", f"{tmp_path}/x"):
        with pytest.raises(Exception):
            dataset.convert(broken, dest)
    assert os.listdir(tmp_path) == []


def test_what_is_staged_is_checked_before_it_is_committed(tmp_path):
    w = dataset.DatasetWriter({"path": f"{tmp_path}/y.zip"}, False)
    os.makedirs(w.staging)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.png", b"123")
    (tmp_path / w.staging.split("/")[-1] / "0-0.zip").write_bytes(data.getvalue())
    (tmp_path / w.staging.split("/")[-1] / "0-0.labels").write_text('["a.png", 1]\n')
    with pytest.raises(ValueError, match="does not hold"):
        w.commit([dataset.Staged(f"{w.staging}/0-0", 0, 1, 4, True, [(4, 4, 1)])])
    assert os.listdir(tmp_path) == []


def test_a_destination_in_use_is_kept(spark, tmp_path):
    df, _ = pictures(spark, 5)
    dataset.convert(df, f"{tmp_path}/a.zip")
    before = (tmp_path / "a.zip").read_bytes()
    with pytest.raises(Exception, match="there already"):
        dataset.convert(df.limit(2), f"{tmp_path}/a.zip")
    assert (tmp_path / "a.zip").read_bytes() == before
    dataset.convert(df.limit(2), f"{tmp_path}/a.zip", overwrite=True)
    assert readers.archive(spark, f"{tmp_path}/a.zip").count() == 2


def test_an_empty_dataset(spark, tmp_path):
    dataset.convert(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e.zip")
    with zipfile.ZipFile(f"{tmp_path}/e.zip") as z:
        assert z.namelist() == ["dataset.json"]


def test_folder_labels_limit_and_order(spark, tmp_path):
    for n in ("b/2.png", "a/1.PNG", "c.jpg", "note.txt"):
        os.makedirs(os.path.dirname(tmp_path / n), exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "dataset.json").write_text(json.dumps({"labels": [["a/1.PNG", 4], ["c.jpg", 2]]}))
    assert sorted((r.name, r.label) for r in readers.image_folder(spark, str(tmp_path)).collect()) == [("a/1.PNG", 4), ("b/2.png", None), ("c.jpg", 2)]
    assert sorted(r.name for r in readers.image_folder(spark, str(tmp_path), max_images=2).collect()) == ["a/1.PNG", "b/2.png"]


def test_flat_archive_names_of_six_digits_follow_the_sql(spark, sf, monkeypatch):
    """The SQL's lpad keeps five characters; the members keep the whole number and so stay distinct."""
    made = {}
    monkeypatch.setattr(dataset, "FLAT", "1%05d.png")
    monkeypatch.setattr(archives.readers, "archive", lambda s, dest, f=readers.archive: made.setdefault("members", f(s, dest)))
    got = [r.name for r in archives.flat_archive(spark, sf).collect()]
    assert len({r.name for r in made["members"].select("name").collect()}) == len(got) == 454
    want = duckdb.sql(f"SELECT lpad((100000 + i)::VARCHAR, 5, '0') || '.png' FROM range({len(got)}) t(i)").fetchall()
    assert sorted(got) == sorted(n for (n,) in want)
