"""Raster pairs from binary files, run lengths, JSON fixtures and table columns; and sinks for orders."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom import model, runtime

MAGIC = b"PRRGBA1\n"
RASTERS = "map_id string, width int, height int, base binary, composed binary"


def parse_pair(content: bytes) -> tuple[int, int, bytes, bytes]:
    """Width, height and two RGBA planes of a file: the layout with a magic and little-endian sizes, else the bare one with big-endian sizes."""
    at, order = (len(MAGIC), "<") if content.startswith(MAGIC) else (0, ">")
    if len(content) < at + 8:
        raise ValueError("a raster pair is cut off")
    width, height = struct.unpack_from(f"{order}II", content, at)
    plane, at = width * height * 4, at + 8
    if width <= 0 or height <= 0 or len(content) != at + 2 * plane:
        raise ValueError(f"a raster pair of {width} x {height} can't have {len(content)} bytes")
    return width, height, content[at : at + plane], content[at + plane :]


def pack_pair(width: int, height: int, base: bytes, composed: bytes, magic: bool = True) -> bytes:
    return (MAGIC if magic else b"") + struct.pack("<II" if magic else ">II", width, height) + base + composed


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """rasters of all files under path; map_id is the file's name without its ending."""
    runtime.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w, h, base, composed = parse_pair(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([base]), pa.array([composed])], names=["map_id", "width", "height", "base", "composed"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("map_id"), "content").mapInArrow(run, RASTERS)


def complete_pairs(keys: DataFrame) -> DataFrame:
    """map_id of every name (column key) that has both a ``_base`` and a ``_composed`` file."""
    parts = keys.select(F.regexp_extract("key", r"^(.*)_(base|composed)$", 1).alias("map_id"), F.regexp_extract("key", r"^(.*)_(base|composed)$", 2).alias("part"))
    return parts.filter("part <> ''").groupBy("map_id").agg(F.count_distinct("part").alias("parts")).filter("parts = 2").select("map_id")


def validated(rasters: DataFrame) -> DataFrame:
    """rasters, failing where a plane has not width * height * 4 bytes."""
    right = (F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("base") == F.col("width") * F.col("height") * 4) & (F.octet_length("composed") == F.col("width") * F.col("height") * 4)
    return rasters.withColumn("width", F.when(F.coalesce(right, F.lit(False)), F.col("width")).otherwise(F.raise_error(F.lit("a plane has the wrong size")).cast("int")))


def explode_pixels(rasters: DataFrame) -> DataFrame:
    """pixels: map_id, i, x, y, br, bg, bb, ba, cr, cg, cb, ca. Planes are decoded batch-wise, not byte by byte."""
    runtime.ship(rasters.sparkSession)
    names = ["br", "bg", "bb", "ba", "cr", "cg", "cb", "ca"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for map_id, w, _, base, composed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                planes = np.concatenate([np.frombuffer(p, np.uint8).reshape(-1, 4) for p in (base, composed)], axis=1).astype(np.int16)
                i = np.arange(len(planes), dtype=np.int32)
                columns = [pa.array([map_id] * len(i)), pa.array(i), pa.array(i % w), pa.array(i // w), *(pa.array(np.ascontiguousarray(planes[:, k])) for k in range(8))]
                yield pa.RecordBatch.from_arrays(columns, names=["map_id", "i", "x", "y", *names])

    schema = "map_id string, i int, x int, y int, " + ", ".join(f"{n} smallint" for n in names)
    return validated(rasters).select("map_id", "width", "height", "base", "composed").mapInArrow(run, schema)


def run_length_pixels(fixtures: DataFrame, runs: str = "runs") -> DataFrame:
    """name, i of the set pixels of masks written as alternating runs, the first of zeros. Every row is a mask of its own, whatever its name."""
    nothing = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<struct<start:bigint,n:bigint>>").alias("set"))

    def step(done: Column, run: Column, k: Column) -> Column:
        own = F.struct(done["upto"].alias("start"), run.cast("long").alias("n"))
        return F.struct((done["upto"] + run).cast("long").alias("upto"), F.when(k % 2 == 1, F.concat(done["set"], F.array(own))).otherwise(done["set"]).alias("set"))

    numbered = F.transform(F.col(runs), lambda n, k: F.struct(n.cast("long").alias("n"), k.alias("k")))
    found = F.aggregate(numbered, nothing, lambda done, run: step(done, run["n"], run["k"]), lambda done: done["set"])
    starts = fixtures.select("name", F.explode(found).alias("r")).filter("r.n > 0")
    return starts.select("name", F.explode(F.sequence(F.col("r.start"), F.col("r.start") + F.col("r.n") - 1)).alias("i"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of ``fixtures`` of a JSON file."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("fixtures").alias("f")).select("f.*")


def tiles(embeddings: DataFrame) -> DataFrame:
    """map_id, i, x, y, v: each vector of 64 numbers as an 8 x 8 raster. An adapter: the tables hold no images."""
    cells = embeddings.select(F.col("vec_id").alias("map_id"), F.posexplode("embedding").alias("i", "v"))
    return cells.select("map_id", "i", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def ink(tile: DataFrame) -> DataFrame:
    """The mask of tiles: cells above zero."""
    return tile.filter("v > 0").select("map_id", "i", "x", "y")


def orders(tile: DataFrame) -> DataFrame:
    """map_id, i, x, y, ord: cells above zero with an order code of 0..254 from their value."""
    code = F.least(F.floor(F.col("v") * 512), F.lit(254)).cast("int")
    return tile.filter("v > 0").select("map_id", "i", "x", "y", code.alias("ord"))


def gray(order: Column) -> Column:
    """The RGBA of an order code."""
    return F.struct(order.alias("r"), order.alias("g"), order.alias("b"), F.lit(255).alias("a"))


def pack_orders(order_pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """map_id, rgba: gray RGBA planes from order pixels (map_id, i, ord) and sizes (map_id, width, height); absent pixels are hidden."""
    runtime.ship(order_pixels.sparkSession)

    def pack(table: pa.Table) -> pa.Table:
        n = table["width"][0].as_py() * table["height"][0].as_py()
        plane = np.full(n, model.HIDDEN, dtype=np.uint8)
        i, code = table["i"].to_numpy(), table["ord"].to_numpy()
        present = ~np.isnan(i.astype(float))
        plane[i[present].astype(int)] = code[present]
        rgba = np.stack([plane] * 3 + [np.full(n, 255, np.uint8)], axis=1)
        return pa.table({"map_id": table["map_id"][:1], "rgba": pa.array([rgba.tobytes()], pa.binary())})

    kind = dict(sizes.dtypes)["map_id"]
    joined = sizes.select("map_id", "width", "height").join(order_pixels.select("map_id", "i", "ord"), "map_id", "left")
    return joined.groupBy("map_id").applyInArrow(pack, f"map_id {kind}, rgba binary")


def png(width: int, height: int, gray_plane: bytes) -> bytes:
    """An 8-bit gray PNG file."""
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    rows = b"".join(b"\0" + gray_plane[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
