"""Reading and writing the formats as DataFrames.

load() takes whole files through Spark's own binaryFile source, so any store that Spark reads will do; files are dealt to
tasks. register() adds the formats to spark.read.format(...) and df.write.format(...); bxyz files are then read in byte ranges.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import formats as fm

CLOUD = "idx long, x double, y double, z double, nx double, ny double, nz double, r short, g short, b short, std_dev double"
SCAN = "frame long, idx long, x double, y double, z double, color short"
RASTER = "row long, col long, u int, v double, px_size double, min_z double, max_z double"
CORNERS = "fid long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"
PART = "part string, id long, x double, y double, z double, a long, b long, c long"


def _cloud(data: bytes, options: dict) -> pd.DataFrame:
    return pd.DataFrame({k: pd.array(v, dtype="Int16" if k in "rgb" else None) if v is not None else pd.array([None] * _n(data), dtype="Int16" if k in "rgb" else "Float64") for k, v in fm.read_bxyz(data).items()})


def _n(data: bytes) -> int:
    return fm.bxyz_head(data)[1]


def _frame(r: dict) -> pd.DataFrame:
    color = pd.array(r["color"], dtype="Int16") if r["color"] is not None else pd.array([None] * len(r["x"]), dtype="Int16")
    return pd.DataFrame({"frame": r["frame"], "idx": r["idx"], "x": r["x"], "y": r["y"], "z": r["z"], "color": color})


def _scan(data: bytes, options: dict) -> pd.DataFrame:
    every = int(options["take_every"]) if options.get("take_every") else None
    parts = [_frame(r) for r in fm.Lptf3(data).rows(every)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["frame", "idx", "x", "y", "z", "color"])


def _raster(data: bytes, options: dict) -> pd.DataFrame:
    px, low, high, values, mask = fm.read_raster(data)
    r, c = np.nonzero(mask)
    u = values[r, c].astype(np.int32)
    return pd.DataFrame({"row": r, "col": c, "u": u, "v": u / 65535.0 * (high - low) + low, "px_size": px, "min_z": low, "max_z": high})


def _mask(data: bytes, options: dict) -> pd.DataFrame:
    r, c = np.nonzero(fm.read_grey(data))
    return pd.DataFrame({"row": r, "col": c})


def _stl(data: bytes, options: dict) -> pd.DataFrame:
    t = fm.read_stl(data).reshape(-1, 9)
    out = pd.DataFrame(t, columns=[f"{c}{k}" for k in range(3) for c in "xyz"])
    out.insert(0, "fid", range(len(out)))
    return out


def _mesh(read: Callable) -> Callable:
    def run(data: bytes, options: dict) -> pd.DataFrame:
        v, f = read(data)
        rows = pd.DataFrame({"part": "vertex", "id": range(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})
        faces = pd.DataFrame({"part": "face", "id": range(len(f)), "a": f[:, 0], "b": f[:, 1], "c": f[:, 2]})
        out = pd.concat([rows, faces], ignore_index=True)
        return out.assign(**{n: out[n].astype("Int64") if n in out else pd.array([None] * len(out), dtype="Int64") for n in "abc"})

    return run


#: Format -> (schema, bytes and options -> rows).
READERS: dict[str, tuple[str, Callable[[bytes, dict], pd.DataFrame]]] = {
    "bxyz": (CLOUD, _cloud),
    "lptf3": (SCAN, _scan),
    "raster": (RASTER, _raster),
    "mask": ("row long, col long", _mask),
    "stl": (CORNERS, _stl),
    "ply": (PART, _mesh(fm.read_ply)),
    "umesh": (PART, _mesh(fm.read_umesh)),
}


#: Rows that are handed on at once.
PIECE = 65_536


def _pieces(kind: str, data: bytes, options: dict) -> Iterator[pd.DataFrame]:
    """A file's rows, frame by frame of a scan, in tables of at most PIECE rows."""
    schema, read = READERS[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    every = int(options["take_every"]) if options.get("take_every") else None
    if kind == "lptf3":
        for r in fm.Lptf3(data).rows(every):
            for s in range(0, len(r["x"]), PIECE):
                yield _frame({k: v if v is None else v[s : s + PIECE] for k, v in r.items()})[names]
        return
    out = read(data, options)
    for s in range(0, len(out), PIECE):
        yield out[names].iloc[s : s + PIECE]


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """The rows of all files at path, with path; see READERS for the columns."""
    schema, _ = READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"], strict=True):
                for out in _pieces(kind, data, options):
                    out.insert(0, "path", where)
                    yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, {schema}")


def load_mesh(spark: SparkSession, kind: str, path: str):
    """A mesh of one file; corners of an stl file at the same place become one vertex."""
    from ..operators.mesh import Mesh, from_corners

    rows = load(spark, kind, path)
    if kind == "stl":
        return from_corners(rows.withColumn("k", F.lit(0)).drop("path"))
    return Mesh(rows.filter("part = 'vertex'").select(F.col("id").alias("vid"), "x", "y", "z"), rows.filter("part = 'face'").select(F.col("id").alias("fid"), "a", "b", "c"))


def point_distribution(points: DataFrame, bin_size: float) -> DataFrame:
    """bin, n: points by y, all bins from 0 to the last one; points below 0 don't count."""
    counts = points.filter("y >= 0").groupBy(F.floor(F.col("y") / bin_size).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = counts.agg(F.max("bin").alias("m")).filter("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def smooth_sample(scan: DataFrame, take_every: int, y_step: float, look_scale: float = 1.0, weight_sigma: float = 0.35, max_move: float = 1.0) -> DataFrame:
    """frame, idx, x, y, z of the taken points, each moved in z by the Gaussian-weighted mean of the points around it.

    scan: every point with frame, idx, x, y, z, taken. Neighbours come from an equi-join on cells of frames and x as wide
    as the reach, so rows meet only what is near. Fewer than three neighbours leave a point where it is.
    """
    rows_reach = int(np.ceil(take_every * abs(look_scale)))
    reach = rows_reach * y_step * 1.25
    sigma = weight_sigma * reach
    cellf, cellx = F.floor(F.col("frame") / rows_reach).cast("long"), F.floor(F.col("x") / reach).cast("long")
    around = F.array(*(F.struct((cellf + i).alias("f"), (cellx + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    taken = scan.filter("taken").select("frame", "idx", "x", "y", "z", F.explode(around).alias("k"))
    every = scan.select(F.struct(cellf.alias("f"), cellx.alias("c")).alias("k"), F.col("frame").alias("f2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("z") - F.col("z2"), 2))
    near = taken.join(every, "k").filter((F.abs(F.col("frame") - F.col("f2")) <= rows_reach) & (d <= reach)).withColumn("w", F.exp(F.pow(d / sigma, 2) * -0.5))
    move = near.groupBy("frame", "idx").agg(F.count("*").alias("n"), (F.sum(F.col("w") * (F.col("z2") - F.col("z"))) / F.sum("w")).alias("m"))
    own = scan.filter("taken").join(move, ["frame", "idx"], "left")
    moved = F.when(F.col("n") >= 3, F.least(F.greatest(F.col("m"), F.lit(-max_move)), F.lit(max_move))).otherwise(0.0)
    return own.select("frame", "idx", "x", "y", (F.col("z") + F.coalesce(moved, F.lit(0.0))).alias("z"))


def load_scan_all(spark: SparkSession, path: str, take_every: int) -> DataFrame:
    """All points of a scan with taken, for smooth_sample; y_step is a column."""

    def run(batches):
        for batch in batches:
            for data in batch["content"]:
                scan = fm.Lptf3(data)
                for r in scan.rows(take_every, True):
                    yield pd.DataFrame({k: r[k] for k in ("frame", "idx", "x", "y", "z", "taken")}).assign(y_step=scan.y_step)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "frame long, idx long, x double, y double, z double, taken boolean, y_step double")


def strip(x0: np.ndarray, y0: float, x1: np.ndarray, y1: float, limit: float = 2.0) -> list[tuple[int, int, int, int, int, int]]:
    """Triangles (row, place) x 3 between two rows of ascending x: the side with the shorter new edge goes on."""
    out, i, j = [], 0, 0
    dy = abs(y1 - y0)
    while i + 1 < len(x0) or j + 1 < len(x1):
        a = np.hypot(x0[i + 1] - x1[j], dy) if i + 1 < len(x0) else np.inf
        b = np.hypot(x1[j + 1] - x0[i], dy) if j + 1 < len(x1) else np.inf
        tri, corners = ((0, i, 1, j, 0, i + 1), (x0[i], x1[j], x0[i + 1] if i + 1 < len(x0) else 0)) if a <= b else ((0, i, 1, j, 1, j + 1), (x0[i], x1[j], x1[j + 1] if j + 1 < len(x1) else 0))
        if max(corners) - min(corners) <= limit * max(dy, 1e-300):
            out.append(tri)
        i, j = (i + 1, j) if a <= b else (i, j + 1)
    return out


def scan_mesh(points: DataFrame, step: float):
    """A mesh of triangle strips between neighbouring frames (frame, idx, x, y, z); frames more than two steps apart aren't joined."""
    from ..operators.checkpoints import cut
    from ..operators.mesh import Mesh, numbered

    frames = points.select("frame").distinct()
    from pyspark.sql import Window

    nxt = frames.select("frame", F.lead("frame").over(Window.orderBy("frame")).alias("next"))  # a row for each frame
    pts = cut(numbered(points.withColumn("_k", F.struct("frame", "idx")), "_k").drop("_k").withColumnRenamed("n", "vid"), "scan")
    upper = pts.join(nxt.filter("next is not null"), "frame").select("frame", "next", F.lit(0).alias("side"), "idx", "x", "y", "z", "vid")
    lower = pts.join(nxt.filter("next is not null").select(F.col("frame").alias("_f"), F.col("next").alias("frame")), "frame").select(F.col("_f").alias("frame"), F.col("frame").alias("next"), F.lit(1).alias("side"), "idx", "x", "y", "z", "vid")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [pdf[pdf["side"] == s].sort_values("x", kind="stable") for s in (0, 1)]
        out = []
        if all(len(r) for r in rows):
            ys = [float(r["y"].iloc[0]) for r in rows]
            if abs(ys[1] - ys[0]) <= 2 * step:
                p = [r[["x", "y", "z"]].to_numpy(float) for r in rows]
                v = [r["vid"].to_numpy() for r in rows]
                for s0, i0, s1, i1, s2, i2 in strip(p[0][:, 0], ys[0], p[1][:, 0], ys[1]):
                    c = np.array([p[s0][i0], p[s1][i1], p[s2][i2]])
                    if np.linalg.norm(c - np.roll(c, 1, axis=0), axis=1).max() < 5 * 2 * step:
                        out.append((v[s1][i1], v[s0][i0], v[s2][i2]))
        return pd.DataFrame(out, columns=["a", "b", "c"], dtype="int64")

    faces = upper.unionByName(lower).groupBy("frame", "next").applyInPandas(run, "a long, b long, c long")
    return Mesh(pts.select("vid", "x", "y", "z"), faces.withColumn("fid", F.monotonically_increasing_id()).select("fid", "a", "b", "c"))


# ---- spark.read.format(...) -----------------------------------------------------------------------------------------------
def _list(path: str) -> list[tuple[str, int]]:
    fs, root = pafs.FileSystem.from_uri(path if "://" in path else "file://" + posixpath.abspath(path))
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    return sorted((scheme + f.path if scheme == "file://" else f.path, f.size) for f in found if f.type == pafs.FileType.File and not posixpath.basename(f.path).startswith(("_", ".")))


def _open(path: str):
    fs, root = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(root)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    RECORDS = 1 << 20

    def __init__(self, kind: str, options: dict, schema: StructType):
        self.kind, self.options, self.schema = kind, {k.lower(): v for k, v in options.items()}, schema

    def partitions(self):
        files = _list(self.options["path"])
        if self.kind != "bxyz":
            return [_Range(p, 0, -1) for p, _ in files]
        out = []
        for p, _ in files:
            with _open(p) as f:
                _, n = fm.bxyz_head(f.read(fm.BXYZ_HEAD))
            out += [_Range(p, a, min(self.RECORDS, n - a)) for a in range(0, n, self.RECORDS)]
        return out

    def read(self, part: _Range):
        with _open(part.path) as f:
            if part.count >= 0:
                dtype, _ = fm.bxyz_head(f.read(fm.BXYZ_HEAD))
                f.seek(fm.BXYZ_HEAD + part.first * dtype.itemsize)
                kinds = to_arrow_schema(self.schema)
                for s in range(0, part.count, PIECE):
                    n = min(PIECE, part.count - s)
                    cols = fm.bxyz_columns(np.frombuffer(f.read(n * dtype.itemsize), dtype), part.first + s)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[k.name], k.type) if cols[k.name] is not None else pa.nulls(n, k.type) for k in kinds], schema=kinds)
                return
            schema, read = READERS[self.kind]
            out = read(f.read(), self.options)[[c.split()[0] for c in schema.split(", ")]]
        for row in out.astype(object).where(out.notna(), None).itertuples(index=False, name=None):
            yield tuple(x.item() if hasattr(x, "item") else x for x in row)


class _Done(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceArrowWriter):
    """Files written under a hidden name and renamed when the job commits: one for each task, of bxyz one for each RECORDS
    points of a task, so that no task holds more."""

    RECORDS = 1 << 20

    def __init__(self, kind: str, options: dict, columns: list[str]):
        self.kind, self.path, self.columns = kind, options["path"], columns

    def write(self, batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        stem, names, held, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", [], [], 0
        fs, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + posixpath.abspath(self.path))

        def flush():
            name = f"{stem}-{len(names)}.{self.kind}" if names else f"{stem}.{self.kind}"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/.{name}") as out:
                out.write(self.data(pa.Table.from_batches(held)))
            names.append(name)

        for batch in batches:
            while self.kind == "bxyz" and n + batch.num_rows > self.RECORDS:
                held.append(batch.slice(0, self.RECORDS - n))
                batch = batch.slice(self.RECORDS - n)
                flush()
                held, n = [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            flush()
        return _Done(names)

    def data(self, table: pa.Table) -> bytes:
        have = {c: table.column(c) for c in self.columns if c in table.column_names and not table.column(c).null_count}
        full = lambda names: np.column_stack([have[n].to_numpy().astype(float) for n in names]) if all(n in have for n in names) else None
        if self.kind == "bxyz":
            std = full(["std_dev"])
            return fm.write_bxyz(np.column_stack([table.column(n).to_numpy().astype(float) for n in "xyz"]), full(["nx", "ny", "nz"]), full(["r", "g", "b"]), std[:, 0] if std is not None else None)
        return fm.write_stl(np.column_stack([table.column(f"{c}{k}").to_numpy().astype(float) for k in range(3) for c in "xyz"]).reshape(-1, 3, 3))

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + posixpath.abspath(self.path))
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + posixpath.abspath(self.path))
        for m in messages:
            for name in m.names if m else []:
                fs.delete_file(f"{root}/.{name}")


def _source(kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return READERS[kind][0]

        def reader(self, schema):
            return _Reader(kind, dict(self.options), schema)

        def writer(self, schema, overwrite):
            if kind not in ("bxyz", "stl"):
                raise ValueError(f"{kind} files are written with save_mesh, save_raster or save_scan")
            return _Writer(kind, dict(self.options), [f.name for f in schema.fields])

    Source.__name__ = f"{kind.capitalize()}Source"
    return Source


def register(spark: SparkSession) -> None:
    for kind in READERS:
        spark.dataSource.register(_source(kind))


# ---- sinks ------------------------------------------------------------------------------------------------------------------
def save_xyz(points: DataFrame, path: str, normals: bool = False) -> None:
    """Text lines x y z [nx ny nz]."""
    names = ["x", "y", "z", *(["nx", "ny", "nz"] if normals else [])]
    points.select(F.concat_ws(" ", *names).alias("value")).write.text(path)


def save_content(files: DataFrame, path: str, name: str) -> None:
    """The content of each row of files as a file in path: name, with a number before its ending from the second row on.

    Written by the tasks under a hidden name and renamed, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path if "://" in path else "file://" + posixpath.abspath(path))
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for number, data in zip(batch["number"], batch["content"], strict=True):
                stem, dot, ending = name.partition(".")
                own = f"{stem}-{number}{dot}{ending}" if number else name
                with fs.open_output_stream(f"{root}/.{own}", compression=None) as out:
                    out.write(data)
                fs.move(f"{root}/.{own}", f"{root}/{own}")
                yield pd.DataFrame({"name": [own]})

    files.select(F.monotonically_increasing_id().alias("number"), "content").mapInPandas(run, "name string").count()


def mesh_bytes(mesh, kind: str = "umesh", compress: bool = False) -> DataFrame:
    """One row, content: the mesh as a file. umesh holds 65535 vertices; ply has no such limit but a mesh is one task's work."""
    both = mesh.vertices.select(F.lit(0).alias("k"), F.col("vid").alias("id"), F.array("x", "y", "z").alias("p")).unionByName(mesh.faces.select(F.lit(1).alias("k"), F.col("fid").alias("id"), F.array(*(F.col(n).cast("double") for n in "abc")).alias("p")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, f = (pdf[pdf["k"] == k].sort_values("id") for k in (0, 1))
        at = pd.Series(range(len(v)), index=v["id"])
        vertices = np.stack(v["p"].to_numpy()).astype(float)
        faces = np.stack(f["p"].to_numpy()).astype(np.int64)
        faces = np.stack([at[faces[:, k]].to_numpy() for k in range(3)], axis=1)
        data = fm.write_umesh(vertices, faces, compress) if kind == "umesh" else fm.write_ply(vertices, faces)
        return pd.DataFrame({"content": [data]})

    return both.groupBy(F.lit(0).alias("_g")).applyInPandas(run, "content binary")


def raster_bytes(raster: DataFrame, px_size: float, min_z: float, max_z: float) -> DataFrame:
    """One row, content: the raster container of rows (row, col, v)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        values, mask = np.zeros((r.max() + 1, c.max() + 1), np.uint16), np.zeros((r.max() + 1, c.max() + 1), bool)
        t = np.clip((pdf["v"].to_numpy(float) - min_z) / (max_z - min_z), 0, 1)
        values[r, c], mask[r, c] = (t * 65535).astype(np.uint16), True
        return pd.DataFrame({"content": [fm.write_raster(px_size, min_z, max_z, values, mask)]})

    return raster.select("row", "col", "v").groupBy(F.lit(0).alias("_g")).applyInPandas(run, "content binary")


def mask_bytes(mask: DataFrame, kind: str = "png", shape: tuple[int, int] | None = None) -> DataFrame:
    """One row, content: a mask (row, col) as a grey image (png, pgm or bmp), set pixels white. shape: rows and columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = shape or (int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1)
        image = np.zeros(size, np.uint8)
        image[pdf["row"], pdf["col"]] = 255
        return pd.DataFrame({"content": [fm.GREY_WRITERS[kind](image)]})

    return mask.select("row", "col").groupBy(F.lit(0).alias("_g")).applyInPandas(run, "content binary")


def sample_mesh(spark: SparkSession, path: str, vertices: int | None = None, faces: int | None = None):
    """A sample mesh (ply, stl or umesh, gzipped or not) from a folder of the user's own; none come with this library.

    Fails where the file's numbers of vertices or faces aren't those given.
    """
    kind = posixpath.basename(path).removesuffix(".gz").rpartition(".")[2].lower()
    found = load_mesh(spark, kind, path)
    for what, wanted, table in (("vertices", vertices, found.vertices), ("faces", faces, found.faces)):
        if wanted is not None and (n := table.count()) != wanted:
            raise ValueError(f"{path}: {n} {what}, not {wanted}")
    return found


def rendered(raster: DataFrame, stops: list[list[float]], limits: tuple[float, float] | None = None) -> DataFrame:
    """One row, content: a colour-mapped png of rows (row, col, v); missing pixels are transparent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.full((pdf["row"].max() + 1, pdf["col"].max() + 1), np.nan)
        image[pdf["row"], pdf["col"]] = pdf["v"]
        return pd.DataFrame({"content": [fm.write_png(fm.color_map(image, np.array(stops, float), limits))]})

    return raster.select("row", "col", "v").groupBy(F.lit(0).alias("_g")).applyInPandas(run, "content binary")


def save_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.text(path, lineSep="\n")


def json_of(df: DataFrame, most: int = 100_000) -> list[dict]:
    """Rows as plain objects; a table of more than most rows is an error (save_json writes those)."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"json_of: over {most} rows")
    return [json.loads(r) for r in rows]


def clean_scan(points: DataFrame, y_step: float, gap_steps: float = 100.0, bad_edge_count: int = 3) -> DataFrame:
    """points (frame, idx, x, y, z) without those next to an end of their profile or to a gap in x of over gap_steps steps."""
    from pyspark.sql import Window

    w = Window.partitionBy("frame").orderBy("x", "idx")
    wide = F.coalesce(F.col("x") - F.lag("x").over(w) > gap_steps * y_step, F.lit(True))
    run = points.withColumn("_start", wide.cast("int")).withColumn("_run", F.sum("_start").over(w))
    r = Window.partitionBy("frame", "_run").orderBy("x", "idx")
    n = F.count("*").over(Window.partitionBy("frame", "_run"))
    place = F.row_number().over(r)
    kept = run.withColumn("_i", place).withColumn("_n", n).filter((F.col("_i") > bad_edge_count) & (F.col("_i") <= F.col("_n") - bad_edge_count))
    return kept.select(*points.columns)


def comprehensive_scan(points: DataFrame, y_step: float, detector_y: float, detector_z: float, uncertainty_scale: float, bad_edge_count: int = 3, check_occlusion: bool = False) -> DataFrame:
    """A cleaned scan with normals from its own triangle strips and std_dev from the detector's angle.

    check_occlusion: points that the surface hides from the detector are left out.
    """
    from ..functions.angles import scan_uncertainty
    from ..operators.checkpoints import cut
    from ..operators.mesh import closest, ray_hits

    rows = cut(clean_scan(points, y_step, bad_edge_count=bad_edge_count).withColumn("id", F.monotonically_increasing_id()), "scan")
    surface = scan_mesh(rows, y_step)
    met = closest(rows, surface, "id").select("id", "nx", "ny", "nz")
    up = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    out = rows.join(met, "id").withColumns({n: F.col(n) * up for n in ("nx", "ny", "nz")}).withColumn("std_dev", scan_uncertainty(F.col("z"), detector_z, detector_y, uncertainty_scale))
    if check_occlusion:
        to = {"dx": F.lit(0.0), "dy": F.lit(float(detector_y)), "dz": F.lit(float(detector_z)) - F.col("z")}
        eps = 1e-4
        rays = rows.select("id", (F.col("x") + to["dx"] * eps).alias("ox"), (F.col("y") + to["dy"] * eps).alias("oy"), (F.col("z") + to["dz"] * eps).alias("oz"), *(v.alias(k) for k, v in to.items()))
        out = out.join(ray_hits(rays, surface, "id").filter("t < 1").select("id"), "id", "left_anti")
    return out.drop("id")


def to_umesh(spark: SparkSession, kind: str, path: str, compress: bool = True) -> tuple[bytes, float, float]:
    """An stl or ply file as umesh bytes, with the largest and the mean distance that rounding moved a vertex."""
    mesh = load_mesh(spark, kind, path)
    data = mesh_bytes(mesh, "umesh", compress).first()["content"]
    again, _ = fm.read_umesh(data)
    own = np.array([tuple(r) for r in mesh.vertices.orderBy("vid").select("x", "y", "z").collect()])
    d = np.linalg.norm(own - again, axis=1)
    return data, float(d.max()), float(d.mean())
