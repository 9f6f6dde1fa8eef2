"""TIFF files made here byte by byte, read as tables of cells."""

import struct
import zlib

import numpy as np
import pytest

from siteweave.sources import rasters


def tiff(path, tags, blocks, order="<"):
    """Writes a file of the blocks' bytes, with tags {number: (kind, values)}; 273 or 324 and 279 or 325 are filled in."""
    codes = {2: "s", 3: "H", 4: "I", 12: "d"}
    at, where = 8, []
    for b in blocks:
        where.append(at)
        at += len(b)
    tiled = 322 in tags
    tags = dict(sorted({**tags, (324 if tiled else 273): (4, where), (325 if tiled else 279): (4, [len(b) for b in blocks])}.items()))
    extra, entries, end = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in tags.items():
        data = values if kind == 2 else struct.pack(f"{order}{len(values)}{codes[kind]}", *values)
        held = data.ljust(4, b"\0")
        if len(data) > 4:
            held = struct.pack(f"{order}I", end + len(extra))
            extra += data
        entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + held
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at)
    path.write_bytes(head + b"".join(blocks) + struct.pack(f"{order}H", len(tags)) + entries + b"\0" * 4 + extra)


def shape(height, width, count, bits, kind, compression, predictor=1):
    return {256: (4, [width]), 257: (4, [height]), 258: (3, [bits] * count), 259: (3, [compression]), 277: (3, [count]), 317: (3, [predictor]), 339: (3, [kind] * count)}


def cells(df):
    return {(r["band"], r["row"], r["col"]): r["value"] for r in df.collect()}


def test_strips_of_floats(spark, tmp_path):
    values = np.arange(35, dtype="<f4").reshape(7, 5)
    values[2, 3], values[0, 0] = -9999, np.nan
    blocks = [values[r : r + 3].tobytes() for r in (0, 3, 6)]
    tiff(tmp_path / "a.tif", {**shape(7, 5, 1, 32, 3, 1), 278: (4, [3]), 33550: (12, [90.0, 90.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 1000.0, 5000.0, 0.0]), 42113: (2, b"-9999\0"), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 5070])}, blocks)
    got = cells(rasters.read_geotiff(spark, str(tmp_path / "*.tif")))
    assert got == {(1, r, c): None if (r, c) in ((2, 3), (0, 0)) else float(values[r, c]) for r in range(7) for c in range(5)}
    p = rasters.geotiff_profiles(spark, str(tmp_path / "a.tif")).first().asDict()
    assert p.pop("path").endswith("a.tif")
    assert p == {"height": 7, "width": 5, "count": 1, "dtype": "f4", "nodata": -9999.0, "x0": 1000.0, "dx": 90.0, "y0": 5000.0, "dy": -90.0, "epsg": 5070}


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("planar", [1, 2])
def test_deflated_tiles_of_two_bands(spark, tmp_path, order, planar):
    """Tiles past the edge are cut, differences along rows are summed up, in both byte orders and layouts of bands."""
    rng = np.random.default_rng(2)
    values = rng.integers(0, 60000, (2, 21, 37)).astype("u2")
    wide = np.zeros((2, 32, 48), "u2")
    wide[:, :21, :37] = values
    blocks = []
    for bands in ([[0, 1]] if planar == 1 else [[0], [1]]):
        for y in (0, 16):
            for x in (0, 16, 32):
                tile = np.stack([wide[b, y : y + 16, x : x + 16] for b in bands], 2)
                steps = np.diff(tile, axis=1, prepend=np.zeros((16, 1, len(bands)), "u2"))
                blocks.append(zlib.compress(steps.astype(f"{order}u2").tobytes()))
    tiff(tmp_path / "b.tif", {**shape(21, 37, 2, 16, 1, 8, 2), 284: (3, [planar]), 322: (3, [16]), 323: (3, [16])}, blocks, order)
    got = cells(rasters.read_geotiff(spark, str(tmp_path / "b.tif")))
    assert got == {(b + 1, r, c): float(values[b, r, c]) for b in range(2) for r in range(21) for c in range(37)}
    p = rasters.geotiff_profiles(spark, str(tmp_path / "b.tif")).first()
    assert (p["count"], p["dtype"], p["nodata"], p["x0"], p["epsg"]) == (2, "u2", None, None, None)


def test_what_is_not_read(tmp_path):
    with pytest.raises(ValueError, match="not a TIFF"):
        rasters.tags_of(b"PK\3\4 and so on")
    tiff(tmp_path / "c.tif", {**shape(1, 1, 1, 8, 1, 5), 278: (4, [1])}, [b"\0"])
    data = (tmp_path / "c.tif").read_bytes()
    with pytest.raises(ValueError, match="compression 5"):
        rasters.blocks_of(rasters.tags_of(data))


def test_blocks_are_dealt_out_and_left_out(spark, tmp_path):
    """Partitions hold a few tiles each; conditions read only the tiles they need, and cells are right either way."""
    values = np.arange(64 * 80, dtype="<i4").reshape(64, 80)
    tiles = [values[y : y + 16, x : x + 16].tobytes() for y in range(0, 64, 16) for x in range(0, 80, 16)]
    # A tile that isn't asked for may be damaged.
    tiles[0] = zlib.compress(b"no")
    tiff(tmp_path / "d.tif", {**shape(64, 80, 1, 32, 2, 8), 322: (3, [16]), 323: (3, [16])}, [t if k == 0 else zlib.compress(t) for k, t in enumerate(tiles)])
    df = rasters.read_geotiff(spark, str(tmp_path / "d.tif"), partition=2 * 16 * 16 * 8)
    assert df.rdd.getNumPartitions() == 10
    window = df.filter("row >= 20 AND row < 50 AND col BETWEEN 17 AND 40 AND band = 1")
    assert cells(window) == {(1, r, c): float(values[r, c]) for r in range(20, 50) for c in range(17, 41)}
    assert cells(df.filter("row = 63 AND col IN (0, 79)")) == {(1, 63, 0): float(values[63, 0]), (1, 63, 79): float(values[63, 79])}
    assert df.filter("row > 100").count() == 0 and df.filter("col > 15 AND value < 17").count() == 1
    reader = rasters.CellReader([f"file:{tmp_path}/d.tif"], 16 * 16 * 8)
    assert len(reader.partitions()) == 20
    reader.low, reader.high = {"row": 16, "col": 70}, {"row": 31}
    assert [(p.blocks[0].row, p.blocks[0].col) for p in reader.partitions()] == [(16, 64)]


def test_many_files_and_none(spark, tmp_path):
    for k in range(3):
        tiff(tmp_path / f"{k}.tif", {**shape(2, 2, 1, 8, 1, 1), 278: (4, [2])}, [bytes([k, 1, 2, 3])])
    out = rasters.read_geotiff(spark, str(tmp_path))
    assert out.groupBy("path").count().count() == 3 and out.filter("row = 0 AND col = 0").count() == 3
    assert rasters.geotiff_profiles(spark, str(tmp_path)).count() == 3
