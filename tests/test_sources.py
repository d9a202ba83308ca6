import base64
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from gridloom import __main__ as cli
from gridloom.sources import manifest, zarr
from tests.test_store import TIMES, cube, levels, rows


def frame(a, kind, shuffle, split, block):
    """A frame built by the format's description."""
    pack = {1: lambda x: pa.compress(x, codec="lz4_raw", asbytes=True), 3: zlib.compress, 4: zstandard.ZstdCompressor().compress}[kind]
    raw, size = a.tobytes(), a.itemsize
    bodies = []
    for i in range(0, len(raw), block):
        part = np.frombuffer(raw[i : i + block], np.uint8)
        part = part.reshape(-1, size).T.ravel() if shuffle else part
        n = size if split and len(part) == block else 1
        bodies.append(b"".join(struct.pack("<i", len(c)) + c for c in map(pack, (x.tobytes() for x in np.split(part, n)))))
    starts = np.cumsum([16 + 4 * len(bodies), *map(len, bodies)])
    flags = shuffle | (0 if split else 0x10) | kind << 5
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(raw), block, starts[-1]) + struct.pack(f"<{len(bodies)}I", *starts[:-1]) + b"".join(bodies)


@pytest.mark.parametrize("kind", [1, 3, 4])
@pytest.mark.parametrize(("shuffle", "split"), [(0, 0), (1, 0), (1, 1)])
def test_blosc(kind, shuffle, split):
    a = (np.arange(1500) % 700).astype("<u2")
    assert zarr.decode(frame(a, kind, shuffle, split, 1024), [{"name": "bytes"}, {"name": "blosc"}]) == a.tobytes()


def test_blosc_refuses():
    a = np.arange(100, dtype="<u2")
    good = frame(a, 4, 0, 0, 1024)
    for bad in (good[:-3], bytes([9]) + good[1:], good[:2] + bytes([good[2] | 4]) + good[3:]):
        with pytest.raises(ValueError, match=r".+"):
            zarr.blosc_decode(bad)
    assert zarr.blosc_decode(struct.pack("<BBBBIII", 2, 1, 2, 2, 200, 200, 216) + a.tobytes()) == a.tobytes()


def test_commands(spark, tmp_path, capsys):
    df, store = cube(spark), str(tmp_path / "staged")
    df.write.parquet(str(tmp_path / "px"))
    size = ["--height", "11", "--width", "9", "--cell", "4", "--bands", "B04", "B08"]
    assert cli.main(["encode", str(tmp_path / "px"), store, "--times", *map(str, TIMES), *size]) == 0
    final = str(tmp_path / "final")
    assert cli.main(["publish", store, final]) == 0
    with pytest.raises(FileExistsError):
        zarr.publish_local(final, final)
    cube(spark, steps=1).write.parquet(str(tmp_path / "new"))
    assert cli.main(["append", str(tmp_path / "new"), final, "--times", str(TIMES[-1] + 5), "--cell", "4"]) == 0
    assert cli.main(["bands", final, "B04=red"]) == 0 and zarr.describe(final)["roles"] == {"B04": "red"}
    assert cli.main(["consolidate", final]) == 0 and zarr.stale_metadata(final) == []
    assert cli.main(["doctor", final]) == 0 and cli.main(["info", final]) == 0 and cli.main(["stac", final]) == 0
    assert "1970-01-01T00:00:00Z" in capsys.readouterr().out
    assert rows(zarr.open_store(spark, final).where("t < 3")) == rows(df)
    meta = zarr.node_metadata(final)["0/data"]
    zarr.put_json(final, "0/data/zarr.json", meta | {"attributes": {"a": 1}})
    assert zarr.stale_metadata(final) == [("0/data", "stale")] and cli.main(["validate", final]) == 1


def test_labelled(spark, tmp_path):
    path = str(tmp_path / "s")
    df = cube(spark).where("NOT (t = 1 AND b = 0 AND y = 2 AND x = 3)")
    zarr.write_levels(levels(df, n=0).where("level = 0"), path, TIMES, ["B04", "B08"], 11, 9, 0, cell=4)
    got = zarr.labelled(zarr.open_store(spark, path), zarr.describe(path), {"B04": (0.5, 1.0)})
    assert got.where("NOT valid").select(F.date_format("time", "yyyy-MM-dd"), "band", "y", "x", "value").collect() == [("1970-01-02", "B04", 2, 3, None)]
    v = df.where("t = 0 AND b = 0 AND y = 0 AND x = 1").first().v
    assert got.where("time = '1970-01-01' AND band = 'B04' AND y = 0 AND x = 1").first().value == v * 0.5 + 1


def test_foreign():
    listed = {"multiscales": [{"datasets": [{"path": "0"}, {"path": "1"}]}]}
    assert [p for p, _ in zarr.foreign_levels(listed, {"0": 20.0, "1": 10.0})] == ["1", "0"]
    assert "levels are not listed finest first" in zarr.foreign_levels(listed, {"0": 20.0, "1": 10.0})[0][1]
    assert [p for p, _ in zarr.foreign_levels({"multiscales": {"layout": [{"asset": "0"}, {"asset": "1"}]}}, {"0": 10.0, "1": 20.0})] == ["0", "1"]
    for bad, sizes in (({}, {}), (listed, {"0": 1.0, "1": 1.0})):
        with pytest.raises(ValueError, match="levels"):
            zarr.foreign_levels(bad, sizes)
    assert zarr.fill_value(base64.b64encode(struct.pack("<f", -9999)).decode(), 0, "float32") == -9999
    assert zarr.fill_value("nan", 0, "float32") is None and zarr.fill_value(None, 0, "uint16") is None and zarr.fill_value(None, 7, "uint16") == 7


def test_manifests(spark, tmp_path):
    for name in ("a_20240102.tif", "b_20240101.TIF", "c.png", "d_20240103.txt"):
        (tmp_path / name).write_bytes(b"x")
    files = manifest.list_rasters(spark, str(tmp_path))
    assert sorted((r.name, r.state) for r in files.collect()) == [("a_20240102.tif", "dated"), ("b_20240101.TIF", "dated"), ("c.png", "undated")]
    by = manifest.list_rasters(spark, str(tmp_path), "a_%Y%m%d")
    assert [r.name for r in by.where("state = 'dated'").collect()] == ["a_20240102.tif"]
    manifest.write_manifest(files.where("state = 'dated'"), str(tmp_path / "m.csv"), ["B04", "B08"])
    entries, bands, _ = manifest.read_manifest(spark, str(tmp_path / "m.csv"))
    assert [r.uri.rpartition("/")[2] for r in entries.collect()] == ["b_20240101.TIF", "a_20240102.tif"] and bands == ["B04", "B08"]
    manifest.write_manifest(files, str(tmp_path / "n.csv"))
    with pytest.raises(ValueError, match="datetime"):
        manifest.read_manifest(spark, str(tmp_path / "n.csv"))
    (tmp_path / "o.json").write_text('{"bands": ["a"], "bounds": [0, 0, 1, 1], "items": [{"uri": "x.tif", "datetime": "2024-03-01T10:30:00+02:00"}]}')
    entries, bands, bounds = manifest.read_manifest(spark, str(tmp_path / "o.json"))
    assert [(r.uri, str(r.time)) for r in entries.collect()] == [(f"{tmp_path}/x.tif", "2024-03-01 08:30:00")] and (bands, bounds) == (["a"], [0, 0, 1, 1])
    (tmp_path / "p.json").write_text('[{"uri": "x", "datetime": "2024-03-01"}, {"uri": "y", "datetime": "2024-03-01"}]')
    with pytest.raises(ValueError, match="same datetime"):
        manifest.read_manifest(spark, str(tmp_path / "p.json"))
