"""Georeferenced TIFF files as tables of cells, a few strips or tiles in each partition.

The driver reads the tags of each file and deals its blocks out; a task reads
the byte ranges of its own blocks only. Conditions on band, row and col leave
out blocks before anything of them is read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

#: Field types of the format: code of struct, or s for bytes. Fixed values.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: Tags of the format by the name used here. Fixed values.
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "count", 278: "strip", 279: "sizes", 284: "planar", 317: "predictor",
    322: "tile_width", 323: "tile_height", 324: "offsets", 325: "sizes", 339: "format", 33550: "scale", 33922: "tiepoint", 34735: "keys", 42113: "nodata",
}
KINDS = {1: "u", 2: "i", 3: "f"}
DEFLATE = (8, 32946)
#: Keys that hold the code of a projected or a geographic coordinate system. Fixed values.
PROJECTED, GEOGRAPHIC = 3072, 2048


#: Bytes of values of a partition, and of a file's beginning that is read at once.
PARTITION, HEAD = 16 << 20, 1 << 16
SCHEMA = "path string, band int, row int, col int, value double"


def opened(path: str):
    """A file of any file system that pyarrow knows, for reading at any place."""
    if "://" not in path and not path.startswith("file:"):
        return LocalFileSystem().open_input_file(path)
    files, at = FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return files.open_input_file(at)


def ranged(file) -> Callable[[int, int], bytes]:
    """read(at, size) of an open file; its beginning is read once."""
    head = file.read_at(HEAD, 0)
    return lambda at, size: head[at : at + size] if at + size <= len(head) else file.read_at(size, at)


def tags_of(source: bytes | Callable[[int, int], bytes]) -> dict:
    """The known tags of a file's first image, each a tuple of values (text as bytes), and its byte order under "order". source: the file's bytes, or read(at, size)."""
    read = source if callable(source) else lambda at, size: source[at : at + size]
    unpack = lambda code, at: struct.unpack(code, read(at, struct.calcsize(code)))
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    version = unpack(f"{order}H", 2)[0] if order else None
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = unpack(order + ("Q" if big else "I"), 8 if big else 4)[0]
    n = unpack(order + ("Q" if big else "H"), at)[0]
    first, size, word = (at + 8, 20, "Q") if big else (at + 2, 12, "I")
    out: dict = {"order": order}
    for entry in range(first, first + n * size, size):
        tag, kind, count = unpack(f"{order}HH{word}", entry)
        if tag not in TAGS or kind not in FIELDS:
            continue
        code = f"{count}s" if FIELDS[kind] == "s" else f"{count * len(FIELDS[kind])}{FIELDS[kind][0]}"
        where = entry + size - struct.calcsize(word)
        if struct.calcsize(f"={code}") > struct.calcsize(word):
            where = unpack(order + word, where)[0]
        out[TAGS[tag]] = unpack(order + code, where)
    return out


def profile_of(tags: dict) -> dict:
    """Shape, type, nodata value, affine (x0, dx, y0, dy: edges of the first cell and steps, null without georeference) and EPSG code."""
    one = lambda name, default: tags.get(name, (default,))[0]
    nodata = tags["nodata"][0].split(b"\0")[0].strip() if "nodata" in tags else b""
    affine = dict.fromkeys(("x0", "dx", "y0", "dy"))
    if "scale" in tags and "tiepoint" in tags:
        col, row, _, x, y, _ = tags["tiepoint"][:6]
        dx, dy = tags["scale"][0], -tags["scale"][1]
        affine = {"x0": x - col * dx, "dx": dx, "y0": y - row * dy, "dy": dy}
    keys = tags.get("keys", ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    return {
        "height": one("height", 0), "width": one("width", 0), "count": one("count", 1), "dtype": f"{KINDS[one('format', 1)]}{one('bits', 1) // 8}",
        "nodata": float(nodata) if nodata else None, **affine, "epsg": codes.get(PROJECTED, codes.get(GEOGRAPHIC)),
    }


@dataclass(frozen=True)
class Block:
    """A strip or tile: its bytes in the file, first band, and first row and column."""

    at: int
    size: int
    band: int
    row: int
    col: int


def block_size(tags: dict) -> tuple[int, int, int]:
    """(rows, columns, bands) of a block; compressions and types that aren't read are errors."""
    profile = profile_of(tags)
    compression, predictor, planar = (tags.get(n, (1,))[0] for n in ("compression", "predictor", "planar"))
    if compression not in (1, *DEFLATE) or predictor not in (1, 2) or len(set(tags.get("bits", (1,)))) > 1 or tags.get("bits", (1,))[0] % 8:
        raise ValueError(f"cannot read compression {compression} with predictor {predictor} and bits {tags.get('bits')}")
    tall, wide = (tags["tile_height"][0], tags["tile_width"][0]) if "tile_width" in tags else (min(tags.get("strip", (profile["height"],))[0], profile["height"]), profile["width"])
    return tall, wide, profile["count"] if planar == 1 else 1


def blocks_of(tags: dict) -> list[Block]:
    """The blocks of a file, in the file's order."""
    profile, (tall, wide, _) = profile_of(tags), block_size(tags)
    across = -(-profile["width"] // wide)
    each = across * -(-profile["height"] // tall)
    return [Block(at, size, k // each, k % each // across * tall, k % each % across * wide) for k, (at, size) in enumerate(zip(tags["offsets"], tags["sizes"]))]


def values_of(raw: bytes, block: Block, tags: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(band, values [rows, cols]) of a block's bytes, without what lies outside of the raster."""
    profile, (_, wide, bands) = profile_of(tags), block_size(tags)
    raw = raw if tags.get("compression", (1,))[0] == 1 else zlib.decompress(raw)
    values = np.frombuffer(raw, tags["order"] + profile["dtype"])
    values = values[: len(values) // (wide * bands) * (wide * bands)].reshape(-1, wide, bands)
    if tags.get("predictor", (1,))[0] == 2:
        values = np.cumsum(values, 1, dtype=values.dtype)
    inside = values[: profile["height"] - block.row, : profile["width"] - block.col]
    for b in range(bands):
        yield block.band + b, inside[:, :, b]


@dataclass
class BlockPartition(ds.InputPartition):
    path: str
    blocks: list[Block]
    tags: dict


class CellReader(ds.DataSourceReader):
    """Cells of the blocks that conditions on band, row and col don't rule out."""

    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Whole blocks are left out; Spark asks all conditions again of the cells."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in ("band", "row", "col"):
                continue
            low, high = -np.inf, np.inf
            if isinstance(f, ds.In) and f.value:
                low, high = min(f.value), max(f.value)
            elif isinstance(f, ds.EqualTo):
                low = high = f.value
            elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                low = f.value + isinstance(f, ds.GreaterThan)
            elif isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                high = f.value - isinstance(f, ds.LessThan)
            self.low[name], self.high[name] = max(self.low.get(name, -np.inf), low), min(self.high.get(name, np.inf), high)
        return filters

    def wanted(self, block: Block, tall: int, wide: int, bands: int) -> bool:
        ends = {"band": (block.band + 1, block.band + bands), "row": (block.row, block.row + tall - 1), "col": (block.col, block.col + wide - 1)}
        return all(last >= self.low.get(n, -np.inf) and first <= self.high.get(n, np.inf) for n, (first, last) in ends.items())

    def partitions(self) -> list[BlockPartition]:
        out = []
        for path in self.paths:
            with opened(path) as file:
                tags = tags_of(ranged(file))
            tall, wide, bands = block_size(tags)
            found = [b for b in blocks_of(tags) if self.wanted(b, tall, wide, bands)]
            each = max(1, self.size // (tall * wide * bands * 8))
            told = {k: v for k, v in tags.items() if k not in ("offsets", "sizes")}
            out += [BlockPartition(path, found[i : i + each], told) for i in range(0, len(found), each)]
        return out or [BlockPartition("", [], {})]

    def read(self, partition: BlockPartition) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        nodata = profile_of(partition.tags)["nodata"]
        with opened(partition.path) as file:
            for block in partition.blocks:
                for band, values in values_of(file.read_at(block.size, block.at), block, partition.tags):
                    row, col = np.indices(values.shape, np.int32)
                    flat = values.astype(np.float64).ravel()
                    missing = np.isnan(flat) | (flat == nodata if nodata is not None else False)
                    n = len(flat)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(partition.path), n), pa.repeat(pa.scalar(band + 1, pa.int32()), n), pa.array(row.ravel() + np.int32(block.row)), pa.array(col.ravel() + np.int32(block.col)), pa.array(flat, mask=missing)], names=["path", "band", "row", "col", "value"])


class GeotiffCells(ds.DataSource):
    """Format "geotiff_cells"; options: paths (a JSON list) and partition (bytes of values)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CellReader:
        return CellReader(json.loads(self.options["paths"]), int(self.options.get("partition", PARTITION)))


def read_geotiff(spark: SparkSession, path: str, partition: int = PARTITION) -> DataFrame:
    """(path, band, row, col, value) of all cells of the files at a path or pattern; bands count from 1, nodata is null.

    A file's strips or tiles are dealt out, as many to a task as hold about
    ``partition`` bytes of values; filters on band, row and col leave out whole
    blocks, for which the session is set to push filters to Python sources.
    Strips and tiles, plain or deflated, of numbers of whole bytes are read;
    anything else is an error. Files without cells give no rows.
    """
    spark.dataSource.register(GeotiffCells)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = spark.read.format("binaryFile").load(path).select("path")  # names only: contents aren't read
    paths = sorted(r["path"] for r in files.collect())
    return spark.read.format("geotiff_cells").option("paths", json.dumps(paths)).option("partition", str(partition)).load()


def geotiff_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, count, dtype, nodata, x0, dx, y0, dy, epsg) of the files; ``functions.spatial`` takes the affine."""
    kinds = {"height": pa.int32(), "width": pa.int32(), "count": pa.int32(), "dtype": pa.string(), **dict.fromkeys(("nodata", "x0", "dx", "y0", "dy"), pa.float64()), "epsg": pa.int32()}

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with opened(path) as file:
                    found.append(profile_of(tags_of(ranged(file))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([p[n] for p in found], t) for n, t in kinds.items()]], names=["path", *kinds])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(profiles, "path string, height int, width int, count int, dtype string, nodata double, x0 double, dx double, y0 double, dy double, epsg int")
