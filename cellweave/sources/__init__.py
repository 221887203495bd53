"""Sources and sinks: arrays, sphere packings, VTK polyhedra, CSV reports, embedded seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_arrays(spark: SparkSession, positions: np.ndarray, **columns: np.ndarray) -> DataFrame:
    """``cell_id, x, y, z`` and further columns from an (n, 3) array and arrays of n."""
    positions = np.asarray(positions, float)
    if positions.ndim != 2 or positions.shape[1] != 3:
        raise ValueError(f"positions must have shape (n, 3), not {positions.shape}")
    data = {"cell_id": np.arange(len(positions), dtype=np.int64), **{c: positions[:, i] for i, c in enumerate("xyz")}}
    for name, values in columns.items():
        values = np.asarray(values)
        if values.shape != (len(positions),):
            raise ValueError(f"{name} must have shape ({len(positions)},), not {values.shape}")
        data[name] = values
    return spark.createDataFrame(pa.table({k: np.ascontiguousarray(v) for k, v in data.items()}))


def to_array(df: DataFrame, *columns: str) -> np.ndarray:
    """Columns by ascending ``cell_id``, for results that fit the driver."""
    t = df.select("cell_id", *columns).toArrow().sort_by("cell_id")
    out = np.stack([t[c].to_numpy() for c in columns], 1)
    return out[:, 0] if len(columns) == 1 else out


def read_packing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, float, float]:
    """(spheres ``cx, cy, cz, r``, seeds ``cell_id, x, y, z``, low, high) of a packing file: a line of the
    numbers of spheres and of seeds, low and high edge, then spheres, then seeds."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("m"), "value").where(F.trim("value") != "")
    # a line's number: lines of the parts of the file before its own (a row for each part), and its place in the part
    parts = lines.groupBy("part").agg(F.count("*").alias("n"))
    ahead = parts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("m")) - 1
    numbered = lines.withColumn("place", place).join(ahead, F.col("part") == F.col("of")).select((F.col("ahead") + F.col("place")).alias("n"), F.split(F.trim("value"), r"\s+").alias("p"))
    head = numbered.where("n = 0").first()["p"]
    n_spheres = int(head[0])
    value = lambda i: F.col("p")[i].cast("double")
    spheres = numbered.where((F.col("n") >= 1) & (F.col("n") <= n_spheres)).select(*[value(i).alias(c) for i, c in enumerate(("cx", "cy", "cz", "r"))])
    seeds = numbered.where(F.col("n") > n_spheres).select((F.col("n") - n_spheres - 1).alias("cell_id"), *[value(i).alias(c) for i, c in enumerate("xyz")])
    return spheres, seeds, float(head[2]), float(head[3])


def write_packing(path: str, spheres: np.ndarray, seeds: np.ndarray, low: float, high: float) -> None:
    with open(path, "w") as f:
        f.write(f"{len(spheres)} {len(seeds)} {low!r} {high!r}\n")
        for row in [*spheres, *seeds]:
            f.write(" ".join(repr(float(v)) for v in row) + "\n")


def write_vtu(path: str, solids: DataFrame, **cell_data: str) -> int:
    """An unstructured grid of polyhedra (VTK cell type 42) from ``shapes.polyhedra``; how many.

    Rows are streamed to the one file of this format; the table itself is best kept as Parquet."""
    points, connectivity, offsets, faces, face_offsets, ids, volumes = [], [], [], [], [], [], []
    for r in solids.orderBy("cell_id").toLocalIterator():
        base = len(points)
        points += [(p["x"], p["y"], p["z"]) for p in r["points"]]
        connectivity += range(base, len(points))
        offsets.append(len(points))
        faces.append(len(r["faces"]))
        for ring in r["faces"]:
            faces += [len(ring), *[base + k for k in ring]]
        face_offsets.append(len(faces))
        ids.append(r["cell_id"])
        volumes.append(r["volume"])
    text = lambda values: " ".join(map(str, values))
    array = lambda name, kind, values, n="": f'<DataArray type="{kind}" Name="{name}"{n} format="ascii">{text(values)}</DataArray>'
    with open(path, "w") as f:
        f.write('<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian"><UnstructuredGrid>\n')
        f.write(f'<Piece NumberOfPoints="{len(points)}" NumberOfCells="{len(ids)}">\n')
        f.write("<Points>" + array("points", "Float64", [v for p in points for v in p], ' NumberOfComponents="3"') + "</Points>\n<Cells>")
        f.write(array("connectivity", "Int64", connectivity) + array("offsets", "Int64", offsets) + array("types", "UInt8", [42] * len(ids)))
        f.write(array("faces", "Int64", faces) + array("faceoffsets", "Int64", face_offsets) + "</Cells>\n<CellData>")
        f.write(array("cell_id", "Int64", ids) + array("volume", "Float64", volumes) + "</CellData>\n</Piece></UnstructuredGrid></VTKFile>\n")
    return len(ids)


def write_report(df: DataFrame, path: str) -> None:
    """A benchmark table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def seeds_from_embeddings(spark: SparkSession, sf_dir: str, triples: int = 1) -> DataFrame:
    """``cell_id, x, y, z`` in the unit box from the fractional parts of 8 times components; with more
    ``triples``, as many seeds for each vector."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frac = lambda c: c.cast("double") * 8 - F.floor(c.cast("double") * 8)
    if triples == 1:
        return e.select(F.col("vec_id").alias("cell_id"), *[frac(F.col("embedding")[i]).alias(c) for i, c in enumerate("xyz")])
    t = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(triples - 1))).alias("t"))
    return t.select((F.col("vec_id") * triples + F.col("t")).alias("cell_id"), *[frac(F.element_at("embedding", F.col("t") * 3 + i + 1)).alias(c) for i, c in enumerate("xyz")])
