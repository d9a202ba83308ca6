"""Raster stores on disk: Zarr version 3 groups of levels, written by Spark tasks and read by a Python data source.

Level k has an array data[time, band, y, x] and optionally mask[time, y, x]. A chunk holds all bands of one
step of one cell. Chunks may be grouped by time into shards with an index of offsets at the end. Metadata is
read on the driver only; each task opens the chunks of its own partition, at most one object for each.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.operators.pyramid import half
from gridloom.sources.checksum import crc32c

EMPTY = (1 << 64) - 1
# Data types by name, little-endian.
DTYPES = {"uint8": "<u1", "uint16": "<u2", "int16": "<i2", "float32": "<f4"}
KNOWN = {"zarr_format", "node_type", "shape", "data_type", "chunk_grid", "chunk_key_encoding", "fill_value", "codecs", "attributes", "dimension_names", "consolidated_metadata", "storage_transformers"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def read_object(store: fs.FileSystem, key: str, start: int | None = None, size: int | None = None) -> bytes | None:
    """An object or a range of it (a negative start counts from its end); None if there is none."""
    info = store.get_file_info(key)
    if info.type == fs.FileType.NotFound:
        return None
    with store.open_input_file(key) as f:
        if start is None:
            return f.read()
        f.seek(start if start >= 0 else info.size + start)
        return f.read(size)


def read_json(store: fs.FileSystem, key: str) -> dict | None:
    raw = read_object(store, key)
    return None if raw is None else json.loads(raw)


def check_extensions(meta: dict) -> None:
    """Unknown members must not be needed to read a node."""
    for name, value in meta.items():
        if name not in KNOWN and not (isinstance(value, dict) and value.get("must_understand") is False):
            raise ValueError(f"metadata member {name!r} is not understood")


def encode(a: np.ndarray, codec: str) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=5).compress(raw)
    return gzip.compress(raw, 5, mtime=0) if codec == "gzip" else raw


def decode(raw: bytes, codecs: list[dict]) -> bytes:
    """Undo a chain of codecs; bytes comes first in the chain."""
    for c in reversed(codecs):
        if c["name"] == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif c["name"] == "gzip":
            raw = gzip.decompress(raw)
        elif c["name"] == "blosc":
            raw = blosc_decode(raw)
        elif c["name"] == "crc32c":
            if crc32c(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
                raise ValueError("checksum of a chunk doesn't hold")
            raw = raw[:-4]
        elif c["name"] != "bytes":
            raise ValueError(f"codec {c['name']!r} is not known")
    return raw


def blosc_decode(raw: bytes) -> bytes:
    """A blosc frame of format 1 or 2: LZ4, zstd, zlib or copied blocks, with byte shuffle.

    Header: version, codec version, flags, type size, then the sizes of data, a block and the frame. Blocks
    have offsets of their own; each holds streams (one for each byte of the type if split) after their sizes.
    """
    flags, size = raw[2], raw[3]
    total, block, framed = struct.unpack_from("<III", raw, 4)
    if raw[0] not in (1, 2) or framed > len(raw):
        raise ValueError("a frame's header doesn't hold")
    if flags & 0x02:
        return raw[16 : 16 + total]
    if flags & 0x04:
        raise ValueError("bit shuffle is not known")
    kind, out = flags >> 5, []
    inner = {1: lambda x, n: pa.decompress(x, n, codec="lz4_raw", asbytes=True), 3: lambda x, _: zlib.decompress(x), 4: lambda x, _: decode(x, [{"name": "zstd"}])}
    if kind not in inner:
        raise ValueError(f"inner codec {kind} of a frame is not known")
    for i, at in enumerate(struct.unpack_from(f"<{-(-total // block)}I", raw, 16) if total else ()):
        want = min(block, total - i * block)
        whole = want == block
        streams = size if not flags & 0x10 and whole and size <= 16 and want // size >= 128 else 1
        parts = []
        for _ in range(streams):
            n = struct.unpack_from("<i", raw, at)[0]
            body, at = raw[at + 4 : at + 4 + n], at + 4 + n
            parts.append(body if n == want // streams else inner[kind](body, want // streams))
        a = np.frombuffer(b"".join(parts), np.uint8)
        if len(a) != want:
            raise ValueError("a block of a frame is cut short")
        if flags & 0x01 and size > 1:
            n = want // size * size
            a = np.concatenate([a[:n].reshape(size, -1).T.ravel(), a[n:]])
        out.append(a.tobytes())
    return b"".join(out)


def shard_of(chunks: list[bytes | None]) -> bytes:
    """Chunks one after another with an index of (offset, size) and its checksum behind them."""
    at, index, body = 0, b"", b""
    for c in chunks:
        index += struct.pack("<QQ", *((EMPTY, EMPTY) if c is None else (at, len(c))))
        body, at = body + (c or b""), at + len(c or b"")
    return body + index + struct.pack("<I", crc32c(index))


def shard_index(raw: bytes, n: int) -> list[tuple[int, int] | None]:
    """(offset, size) of each of n chunks from the last 16 n + 4 bytes of a shard; None for an absent one."""
    index, sum_ = raw[: 16 * n], raw[16 * n : 16 * n + 4]
    if len(sum_) < 4 or crc32c(index) != int.from_bytes(sum_, "little"):
        raise ValueError("checksum of a shard index doesn't hold")
    pairs = [struct.unpack_from("<QQ", index, 16 * i) for i in range(n)]
    return [None if p == (EMPTY, EMPTY) else p for p in pairs]


def array_meta(shape: list[int], chunk: list[int], dtype: str, fill: float, codec: str, names: list[str], shard: int = 0) -> dict:
    inner = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([] if codec == "none" else [{"name": codec, "configuration": {"level": 5}}])
    codecs = inner
    if shard:
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": chunk, "codecs": inner, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}}]
    return {
        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [shard or 1, *chunk[1:]]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": codecs, "dimension_names": names, "attributes": {},
    }


def grid_keys(spark: SparkSession, shapes: list[tuple[int, int]], n_time: int, per: int, cell: int) -> DataFrame:
    """level, s, row, col of every chunk of the given levels, from ranges: nothing of it is on the driver."""
    out = None
    for k, (h, w) in enumerate(shapes):
        rows, cols, slots = -(-h // cell), -(-w // cell), -(-n_time // per)
        part = lambda e: F.expr(e).cast("int")
        level = spark.range(slots * rows * cols).select(F.lit(k).alias("level"), part(f"id div {rows * cols}").alias("s"), part(f"id div {cols} % {rows}").alias("row"), part(f"id % {cols}").alias("col"))
        out = level if out is None else out.unionByName(level)
    return out


_OBJECTS = "level int, key string, size long, md5 string"


def write_levels(pixels: DataFrame, path: str, times: list[int], bands: list[str], height: int, width: int, levels: int, cell: int = 8, dtype: str = "uint16", codec: str = "zstd", shard: int = 0, nodata: int | None = 0, append: bool = False) -> DataFrame:
    """Write pixels (level, t, b, y, x, v) as a store and return its objects: level, key, size, md5.

    Every chunk of the grid is written, also those without a pixel. Tasks write whole objects under their
    final names after a rename; the root's metadata comes last, so a reader sees the store as a whole or not.
    """
    spark = pixels.sparkSession
    if append and shard:
        raise ValueError("appending to shards rewrites the last one; write without shards")
    per = max(1, shard)
    shapes = [(height, width)]
    for _ in range(levels):
        shapes.append((half(shapes[-1][0]), half(shapes[-1][1])))
    n_time, kind = len(times), np.dtype(DTYPES[dtype])
    steps = [r.t for r in pixels.select("t").distinct().collect()] if append else None  # a bounded number of new steps
    keys = grid_keys(spark, shapes, n_time, per, cell)
    keys = keys if steps is None else keys.where(F.col("s").isin(steps))
    cells = pixels.select("level", F.expr(f"t div {per}").cast("int").alias("s"), F.expr(f"y div {cell}").cast("int").alias("row"), F.expr(f"x div {cell}").cast("int").alias("col"), F.struct("t", "b", "y", "x", "v").alias("p"))
    at = ["level", "s", "row", "col"]

    def write(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        level, s, row, col = (k.as_py() for k in key)
        a = np.full((per, len(bands), cell, cell), nodata or 0, kind)
        p = right.column("p").combine_chunks() if right.num_rows else None
        if p is not None:
            f = {n: p.field(n).to_numpy(zero_copy_only=False) for n in ("t", "b", "y", "x", "v")}
            a[f["t"] % per, f["b"], f["y"] % cell, f["x"] % cell] = f["v"]
        parts = [encode(a[i : i + 1], codec) for i in range(per)]
        raw = shard_of([x if s * per + i < n_time else None for i, x in enumerate(parts)]) if shard else parts[0]
        name = f"{level}/data/c/{s}/0/{row}/{col}"
        store, root = opened(path)
        store.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
        from pyspark import TaskContext

        temp = f"{root}/{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        with store.open_output_stream(temp) as out:
            out.write(raw)
        store.move(temp, f"{root}/{name}")
        return pa.table({"level": pa.array([level], pa.int32()), "key": [name], "size": pa.array([len(raw)], pa.int64()), "md5": [hashlib.md5(raw).hexdigest()]})  # noqa: S324

    objects = keys.groupBy(*at).cogroup(cells.groupBy(*at)).applyInArrow(write, _OBJECTS)
    listing = f"{path if '://' in path else f'file://{path}'}.objects"
    objects.write.mode("overwrite").parquet(listing)  # names and digests of the objects just written, beside the store
    store, root = opened(path)

    def put(key: str, meta: dict) -> None:
        store.create_dir(f"{root}/{key}".rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{root}/{key}") as out:
            out.write(json.dumps(meta, indent=1).encode())

    for k, (h, w) in enumerate(shapes):
        put(f"{k}/data/zarr.json", array_meta([n_time, len(bands), h, w], [1, len(bands), cell, cell], dtype, nodata or 0, codec, ["time", "band", "y", "x"], shard))
        put(f"{k}/zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"level": k}})
    put("zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {"raster": {"times": times, "bands": bands, "nodata": nodata, "levels": [{"path": str(k), "height": h, "width": w} for k, (h, w) in enumerate(shapes)]}}})
    return spark.read.schema(_OBJECTS).parquet(listing)


class Cells(InputPartition):
    """A run of the chunks of a grid of rows x columns x steps, as numbers; each axis has a list of its own."""

    def __init__(self, start: int, stop: int) -> None:
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class Reader(DataSourceReader):
    """Pixels of one level; predicates on t, y and x, and the options level and cells_per_task, choose the chunks."""

    def __init__(self, options: dict) -> None:
        self.path, self.level = options["path"], int(options.get("level", 0))
        self.per_task = int(options.get("cells_per_task", 64))
        store, root = opened(self.path)
        meta = read_json(store, f"{root}/zarr.json")
        if meta is None:
            raise FileNotFoundError(f"{self.path} holds no store")
        self.array = read_json(store, f"{root}/{self.level}/data/zarr.json")
        if self.array is None:
            raise ValueError(f"the store has no level {self.level}")
        for m in (meta, self.array):
            check_extensions(m)
        self.root_attributes = meta["attributes"].get("raster", {})
        self.bounds = {"t": [0, self.array["shape"][0] - 1], "y": [0, self.array["shape"][2] - 1], "x": [0, self.array["shape"][3] - 1]}
        self.sets: dict[str, set[int]] = {}

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Bounds and lists on axes choose chunks; all filters are applied again by Spark."""
        for f in filters:
            axis = f.attribute[0] if len(f.attribute) == 1 else None
            if axis in self.bounds:
                b = self.bounds[axis]
                if isinstance(f, EqualTo):
                    self.bounds[axis] = [max(b[0], f.value), min(b[1], f.value)]
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    b[0] = max(b[0], f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    b[1] = min(b[1], f.value - isinstance(f, LessThan))
                elif isinstance(f, In):
                    self.sets[axis] = set(f.value) & self.sets.get(axis, set(f.value))
            yield f

    def axes(self) -> tuple[list[int], list[int], list[int]]:
        """Rows, columns and steps of chunks that predicates leave."""
        cell_h, cell_w = self._inner()[2:]
        some = lambda axis, size: sorted({i // size for i in range(self.bounds[axis][0], self.bounds[axis][1] + 1) if axis not in self.sets or i in self.sets[axis]})
        return some("y", cell_h), some("x", cell_w), some("t", 1)

    def chunks(self, part: Cells | None = None) -> list[tuple[int, int, int]]:
        """Step, row and column of each chunk of a partition (of all)."""
        rows, cols, steps = self.axes()
        numbers = range(part.start, part.stop) if part else range(len(rows) * len(cols) * len(steps))
        return [(steps[i % len(steps)], rows[i // len(steps) // len(cols)], cols[i // len(steps) % len(cols)]) for i in numbers]

    def partitions(self) -> list[Cells]:
        n = math.prod(map(len, self.axes()))
        return [Cells(i, min(i + self.per_task, n)) for i in range(0, n, self.per_task)] or [Cells(0, 0)]

    def _sharding(self) -> dict | None:
        c = self.array["codecs"][0]
        return c["configuration"] if c["name"] == "sharding_indexed" else None

    def _inner(self) -> list[int]:
        sharding = self._sharding()
        return sharding["chunk_shape"] if sharding else self.array["chunk_grid"]["configuration"]["chunk_shape"]

    def _raw(self, store: fs.FileSystem, root: str, t: int, row: int, col: int, indexes: dict) -> bytes | None:
        base, sharding = f"{root}/{self.level}/data/c", self._sharding()
        if not sharding:
            raw = read_object(store, f"{base}/{t}/0/{row}/{col}")
            return None if raw is None else decode(raw, self.array["codecs"])
        n = self.array["chunk_grid"]["configuration"]["chunk_shape"][0]
        key = f"{base}/{t // n}/0/{row}/{col}"
        if key not in indexes:
            tail = read_object(store, key, -(16 * n + 4), 16 * n + 4)
            indexes[key] = None if tail is None else shard_index(tail, n)
        place = indexes[key] and indexes[key][t % n]
        return decode(read_object(store, key, *place), sharding["codecs"]) if place else None

    def read(self, partition: Cells) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        _, n_band, h, w = self.array["shape"]
        _, _, ch, cw = self._inner()
        kind, indexes = np.dtype(DTYPES[self.array["data_type"]]), {}
        for t, row, col in self.chunks(partition):
            raw = self._raw(store, root, t, row, col, indexes)
            a = np.full((n_band, ch, cw), self.array["fill_value"], kind) if raw is None else np.frombuffer(raw, kind).reshape(n_band, ch, cw)
            a = a[:, : h - row * ch, : w - col * cw]  # cut to the extent
            b, y, x = (i.ravel().astype(np.int32) for i in np.indices(a.shape))
            value = a.ravel().astype(np.float64 if kind.kind == "f" else np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t, np.int32)), pa.array(b), pa.array(y + row * ch), pa.array(x + col * cw), pa.array(value.astype(np.float32) if kind.kind == "f" else value)], ["t", "b", "y", "x", "v"])


class RasterSource(DataSource):
    """spark.read.format("gridloom").option("path", ...).option("level", 0).load(): t, b, y, x, v."""

    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def _reader(self) -> Reader:
        return Reader(dict(self.options))

    def schema(self) -> str:
        return f"t int, b int, y int, x int, v {'float' if self._reader().array['data_type'] == 'float32' else 'int'}"

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return self._reader()


def open_store(spark: SparkSession, path: str, level: int = 0, **options: object) -> DataFrame:
    """Pixels of a level of a store; predicates on t, y and x choose the chunks that are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("gridloom").option("path", path).option("level", level)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def describe(path: str) -> dict:
    """The root's description of a store: times, bands, nodata, levels."""
    store, root = opened(path)
    meta = read_json(store, f"{root}/zarr.json")
    if meta is None:
        raise FileNotFoundError(f"{path} holds no store")
    check_extensions(meta)
    return meta["attributes"]["raster"]


def validate(path: str) -> list[tuple[str, str, str]]:
    """Findings (severity, place, message) on a store's metadata."""
    store, root = opened(path)
    out, about = [], describe(path)
    times, levels = about["times"], about["levels"]
    if any(b <= a for a, b in zip(times, times[1:], strict=False)):
        out.append(("problem", "times", "times don't rise strictly"))
    for k, level in enumerate(levels):
        a = read_json(store, f"{root}/{level['path']}/data/zarr.json")
        if a is None:
            out.append(("problem", level["path"], "the level has no data"))
            continue
        if a["shape"][0] != len(times) or a["shape"][1] != len(about["bands"]):
            out.append(("problem", level["path"], "shape doesn't match times and bands"))
        if a["shape"][2:] != [level["height"], level["width"]]:
            out.append(("problem", level["path"], "shape doesn't match the level's size"))
        if k and [level["height"], level["width"]] != [half(levels[k - 1]["height"]), half(levels[k - 1]["width"])]:
            out.append(("problem", level["path"], "size is not half of the level before"))
        if a["data_type"] not in DTYPES:
            out.append(("problem", level["path"], "type is not one of the profile's"))
    return out


def append_steps(pixels: DataFrame, path: str, times: list[int], cell: int = 8, codec: str = "zstd") -> DataFrame:
    """Add later steps to a store: pixels (level, t, b, y, x, v) with t counted from the store's own steps on.

    Nothing is written unless every new time is later than the last one. Chunks come first, metadata last.
    """
    about = describe(path)
    if not times or times[0] <= about["times"][-1] or any(b <= a for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("new times must be later than those of the store, and rise")
    base = about["levels"][0]
    return write_levels(pixels, path, about["times"] + times, about["bands"], base["height"], base["width"], len(about["levels"]) - 1, cell=cell, codec=codec, nodata=about["nodata"], append=True)


def node_metadata(path: str) -> dict[str, dict]:
    """zarr.json of every node of a store by its path, the root's as ""; each is read once."""
    store, root = opened(path)
    found = {"": read_json(store, f"{root}/zarr.json")}
    if found[""] is None:
        raise FileNotFoundError(f"{path} holds no store")
    for level in found[""]["attributes"]["raster"]["levels"]:
        for name in (level["path"], f"{level['path']}/data", f"{level['path']}/mask"):
            if (meta := read_json(store, f"{root}/{name}/zarr.json")) is not None:
                found[name] = meta
    return found


def put_json(path: str, key: str, meta: dict) -> None:
    """Write a JSON object under another name, then move it into place."""
    store, root = opened(path)
    with store.open_output_stream(f"{root}/{key}.new") as out:
        out.write(json.dumps(meta, indent=1).encode())
    store.move(f"{root}/{key}.new", f"{root}/{key}")


def consolidate(path: str) -> int:
    """Fold the metadata of all nodes into the root's; returns their number."""
    nodes = node_metadata(path)
    root = nodes.pop("")
    put_json(path, "zarr.json", root | {"consolidated_metadata": {"kind": "inline", "must_understand": False, "metadata": dict(sorted(nodes.items()))}})
    return len(nodes)


def stale_metadata(path: str) -> list[tuple[str, str]]:
    """Nodes whose consolidated metadata is missing on disk or not what is there: (path, problem)."""
    nodes = node_metadata(path)
    listed = (nodes[""].get("consolidated_metadata") or {}).get("metadata", {})
    return [(k, "missing" if k not in nodes else "stale") for k, v in sorted(listed.items()) if nodes.get(k) != v]


def set_bands(path: str, roles: dict[str, str]) -> list[str]:
    """Set roles of bands by name in the root's metadata, chunks stay as they are; returns the bands' names."""
    store, root = opened(path)
    meta = read_json(store, f"{root}/zarr.json")
    about = meta["attributes"]["raster"]
    if unknown := set(roles) - set(about["bands"]):
        raise ValueError(f"no bands {sorted(unknown)}")
    about["roles"] = {**about.get("roles", {}), **roles}
    put_json(path, "zarr.json", meta)
    return about["bands"]


def publish_local(staged: str, final: str) -> None:
    """Move a complete store into place in one step; what stands there already is refused."""
    store, root = opened(final)
    _, source = opened(staged)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{final} is there already")
    describe(staged)
    store.move(source, root)


def foreign_levels(attributes: dict, pixel_sizes: dict[str, float]) -> list[tuple[str, list[str]]]:
    """Paths of another profile's levels, finest first by the given sizes of their pixels, with a note on each assumption.

    `multiscales` (an object, or a list of one) has `layout` of assets or `datasets` of paths.
    """
    m = attributes.get("multiscales")
    m = m[0] if isinstance(m, list) and m else m
    name, entries = ("asset", m.get("layout")) if isinstance(m, dict) and "layout" in m else ("path", m.get("datasets") if isinstance(m, dict) else None)
    if not entries or any(not isinstance(e, dict) or not isinstance(e.get(name), str) for e in entries):
        raise ValueError("no multiscales whose levels have paths")
    paths = [e[name] for e in entries]
    if len({pixel_sizes[p] for p in paths}) < len(paths):
        raise ValueError("two levels have pixels of the same size")
    ordered = sorted(paths, key=pixel_sizes.__getitem__)
    notes = ["overviews are the writer's own resampling"] if len(paths) > 1 else []
    notes += [] if ordered == paths else ["levels are not listed finest first"]
    return [(p, notes if i == 0 else []) for i, p in enumerate(ordered)]


def fill_value(declared: object, fill: float, dtype: str) -> float | None:
    """What marks a missing pixel: a declared number, "nan" or base64 of little-endian bytes, else a fill that is not zero; None for none."""
    value: float | None = None
    if isinstance(declared, int | float) and not isinstance(declared, bool):
        value = float(declared)
    elif isinstance(declared, str):
        if declared.lower() == "nan":
            return None
        kind = np.dtype(DTYPES.get(dtype, dtype)).kind
        try:
            raw = base64.b64decode(declared, validate=True)
        except ValueError:
            raw = b""
        if len(raw) in (4, 8):
            value = float(np.frombuffer(raw, f"<{kind}{len(raw)}")[0])
    value = value if value is not None else float(fill) if fill != 0 else None
    return None if value is None or math.isnan(value) else value


def labelled(pixels: DataFrame, about: dict, physical: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Pixels with time, band, value and valid in place of numbers; `physical` has scale and offset of bands."""
    times, bands = about["times"], about["bands"]
    scale = [(physical or {}).get(b, (1.0, 0.0)) for b in bands]
    at = lambda values, i: F.array(*[F.lit(v) for v in values])[i]
    stored = F.col("v").cast("double")
    missing = F.isnan(stored) if about["nodata"] is None else (stored == about["nodata"]) | F.isnan(stored)
    value = stored * at([float(s) for s, _ in scale], F.col("b")) + at([float(o) for _, o in scale], F.col("b"))
    when = F.timestamp_millis(at([int(t) for t in times], F.col("t")).cast("long"))
    return pixels.select(when.alias("time"), at(bands, F.col("b")).alias("band"), "y", "x", F.when(~missing, value).alias("value"), (~missing).alias("valid"))
