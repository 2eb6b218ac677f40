"""Readers of binary meshes: preprocessed geometry (versions 1 to 4) and NPZ archives."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE, TRIANGLE
from ..storage import new_folder, written

#: Fixed values of the layout: magic, newest version, header, grid cell.
MAGIC, VERSION = 0x52334442, 4
HEADER = struct.Struct("<IIQQQQQBB6x")
CELL = np.dtype([("i", "<i4", 3), ("center_count", "<u4"), ("touch_count", "<u4"), ("avg_size_mean", "<f4"), ("vol_ratio", "<f4")])


@dataclass(frozen=True)
class Preprocessed:
    """Tables of a preprocessed file: triangles, edges (from version 4), grid cells."""

    triangles: DataFrame
    edges: DataFrame
    grid: DataFrame


def unpack(raw: bytes) -> dict[str, np.ndarray | float | None]:
    """Arrays of a file's bytes; empty ones where the magic or version is not known."""
    empty = {"vertices": np.zeros((0, 3)), "faces": np.zeros((0, 3), dtype=np.int64), "objects": np.zeros(0, dtype=np.int64), "starts": np.zeros((0, 3)), "ends": np.zeros((0, 3)), "edge_objects": np.zeros(0, dtype=np.int64), "cell_size": None, "cells": np.zeros(0, dtype=CELL)}
    if len(raw) < HEADER.size:
        return empty
    magic, version, nv, ni, nm, ne, _, has_grid, has_edges = HEADER.unpack_from(raw)
    if magic != MAGIC or not 1 <= version <= VERSION:
        return empty
    at = HEADER.size

    def take(kind: str, n: int, width: int = 1) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, dtype=kind, count=n * width, offset=at)
        at += found.nbytes
        return found.reshape(n, width) if width > 1 else found

    out = dict(empty, vertices=take("<f4", nv, 3).astype(float), faces=take("<u4", ni, 3).astype(np.int64), objects=take("<i4", nm).astype(np.int64))
    if version == VERSION and has_edges:
        out |= {"starts": take("<f4", ne, 3).astype(float), "ends": take("<f4", ne, 3).astype(float), "edge_objects": take("<i4", ne).astype(np.int64)}
    if version == VERSION and has_grid:
        size, n = struct.unpack_from("<fI", raw, at)
        at += 8
        out |= {"cell_size": size, "cells": np.frombuffer(raw, dtype=CELL, count=n, offset=at)}
    return out


def pack(vertices: np.ndarray, faces: np.ndarray, objects: np.ndarray, starts: np.ndarray, ends: np.ndarray, edge_objects: np.ndarray, cell_size: float | None = None, cells: np.ndarray | None = None) -> bytes:
    """The bytes of a version-4 file."""
    head = HEADER.pack(MAGIC, VERSION, len(vertices), len(faces), len(objects), len(starts), len(faces), cell_size is not None, len(starts) > 0)
    body = [np.asarray(vertices, "<f4").tobytes(), np.asarray(faces, "<u4").tobytes(), np.asarray(objects, "<i4").tobytes()]
    if len(starts):
        body += [np.asarray(starts, "<f4").tobytes(), np.asarray(ends, "<f4").tobytes(), np.asarray(edge_objects, "<i4").tobytes()]
    if cell_size is not None:
        body += [struct.pack("<fI", cell_size, len(cells)), np.asarray(cells, CELL).tobytes()]
    return head + b"".join(body)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Rows of a table that are handed over at once.
BATCH_ROWS = 50_000
#: Rows of a file that one task reads.
RANGE_ROWS = 500_000


def _opened(path: str):
    """A file, by a reader that can seek."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, where = pafs.FileSystem.from_uri(path)
    return store.open_input_file(where)


def _seekable(path: str) -> bool:
    import pyarrow.fs as pafs

    try:
        pafs.FileSystem.from_uri(path if "://" in path else "file:///")
    except (OSError, ValueError):
        return False
    return True


class _Sections:
    """Rows of the sections of a file's bytes, each read where it is asked for. Empty where the magic or version is not known, as in ``unpack``."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.faces = self.edges = 0
        head = file.read(HEADER.size)
        if len(head) < HEADER.size:
            return
        magic, version, nv, ni, nm, ne, _, _, has_edges = HEADER.unpack(head)
        if magic != MAGIC or not 1 <= version <= VERSION:
            return
        ends = np.cumsum([HEADER.size, 12 * nv, 12 * ni, 4 * nm, 12 * ne, 12 * ne, 4 * ne])
        self.starts, self.faces = [int(x) for x in ends], ni
        self.edges = ne if version == VERSION and has_edges else 0
        if size < ends[6 if self.edges else 3]:
            raise ValueError("the file is shorter than its header tells")

    def rows(self, section: int, kind: str, width: int, first: int, n: int) -> np.ndarray:
        self.file.seek(self.starts[section] + 4 * width * first)
        found = np.frombuffer(self.file.read(4 * width * n), dtype=kind)
        return found.reshape(n, width) if width > 1 else found

    def before(self, section: int, ids: np.ndarray, first: int) -> np.ndarray:
        """How many of the rows ahead of ``first`` have each of the ids, which are sorted."""
        told = np.zeros(len(ids), dtype=np.int64)
        for at in range(0, first, RANGE_ROWS):
            rows = self.rows(section, "<i4", 1, at, min(RANGE_ROWS, first - at))
            place = np.minimum(np.searchsorted(ids, rows), len(ids) - 1)
            told += np.bincount(place[ids[place] == rows], minlength=len(ids))
        return told


def _numbers(objects: np.ndarray) -> np.ndarray:
    """The number of each row among those of its object."""
    order = np.argsort(objects, kind="stable")
    sorted_ = objects[order]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
    return number


def _ranges(files: DataFrame, what: str) -> DataFrame:
    """(path, first, n): ranges of the rows of each file's faces or edges, dealt to all tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf.path:
                with _opened(path) as file:
                    n = getattr(_Sections(file), what)
                yield pd.DataFrame([(path, at, min(RANGE_ROWS, n - at)) for at in range(0, n, RANGE_ROWS)], columns=["path", "first", "n"])

    return files.select("path").mapInPandas(run, "path string, first long, n long").repartition(files.sparkSession.sparkContext.defaultParallelism)


def _range_triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, first, n in zip(pdf.path, pdf["first"], pdf.n, strict=True):
            with _opened(path) as file:
                x = _Sections(file)
                objects = x.rows(2, "<i4", 1, first, n)
                ids, at = np.unique(objects, return_inverse=True)
                number = _numbers(objects) + x.before(2, ids, first)[at]
                for k in range(0, n, BATCH_ROWS):
                    faces = x.rows(1, "<u4", 3, first + k, min(BATCH_ROWS, n - k)).astype(np.int64)
                    low = int(faces.min())
                    flat = x.rows(0, "<f4", 3, low, int(faces.max()) - low + 1)[faces - low].astype(float).reshape(-1, 9)
                    yield pd.DataFrame({"object_id": objects[k : k + len(faces)].astype(np.int64), "tri_id": number[k : k + len(faces)]} | {c: flat[:, i] for i, c in enumerate(TRIANGLE)})


def _range_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, first, n in zip(pdf.path, pdf["first"], pdf.n, strict=True):
            with _opened(path) as file:
                x = _Sections(file)
                for k in range(first, first + n, BATCH_ROWS):
                    m = min(BATCH_ROWS, first + n - k)
                    both = np.concatenate([x.rows(section, "<f4", 3, k, m) for section in (3, 4)], axis=1).astype(float)
                    yield pd.DataFrame({"object_id": x.rows(5, "<i4", 1, k, m).astype(np.int64), "edge_id": np.arange(k, k + m)} | {c: both[:, i] for i, c in enumerate(EDGE)})


def read_pre(spark: SparkSession, path: str) -> Preprocessed:
    """Tables of preprocessed files, read in ranges of rows by many tasks; in a store that only Spark reads, each file whole by one task."""

    def triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf.content:
                x = unpack(raw)
                number = _numbers(x["objects"])
                for at in range(0, len(number), BATCH_ROWS):
                    part = slice(at, at + BATCH_ROWS)
                    flat = x["vertices"][x["faces"][part]].astype(float).reshape(-1, 9)
                    yield pd.DataFrame({"object_id": x["objects"][part].astype(np.int64), "tri_id": number[part]} | {c: flat[:, i] for i, c in enumerate(TRIANGLE)})

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf.content:
                x = unpack(raw)
                for at in range(0, len(x["edge_objects"]), BATCH_ROWS):
                    part = slice(at, at + BATCH_ROWS)
                    both = np.concatenate([x["starts"][part], x["ends"][part]], axis=1).astype(float)
                    yield pd.DataFrame({"object_id": x["edge_objects"][part].astype(np.int64), "edge_id": np.arange(at, at + len(both))} | {c: both[:, i] for i, c in enumerate(EDGE)})

    def grid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf.content:
                x = unpack(raw)
                c = x["cells"]
                yield pd.DataFrame({"ix": c["i"][:, 0] if len(c) else [], "iy": c["i"][:, 1] if len(c) else [], "iz": c["i"][:, 2] if len(c) else [], "center_count": c["center_count"].astype(np.int64), "touch_count": c["touch_count"].astype(np.int64), "avg_size_mean": c["avg_size_mean"].astype(float), "vol_ratio": c["vol_ratio"].astype(float)})

    files = _files(spark, path)
    doubles = lambda names: ", ".join(f"{n} double" for n in names)
    tables = (f"object_id long, tri_id long, {doubles(TRIANGLE)}", f"object_id long, edge_id long, {doubles(EDGE)}")
    if _seekable(path):
        first, second = _ranges(files, "faces").mapInPandas(_range_triangles, tables[0]), _ranges(files, "edges").mapInPandas(_range_edges, tables[1])
    else:
        first, second = files.mapInPandas(triangles, tables[0]), files.mapInPandas(edges, tables[1])
    return Preprocessed(first, second, files.mapInPandas(grid, "ix long, iy long, iz long, center_count long, touch_count long, avg_size_mean double, vol_ratio double"))


def require_edges(read: Preprocessed) -> Preprocessed:
    """The same tables, or an error if there are no edges."""
    if read.edges.isEmpty():
        raise ValueError("the geometry has no precomputed edges: preprocess it again")
    return read


#: Rows of a piece of a file, about: pieces are cut between objects.
PIECE_ROWS = 50_000


def _in_pieces(rows: DataFrame, keys: list[str], made: Callable[[pd.DataFrame], list[tuple[int, int, bytes]]], folder: str) -> DataFrame:
    """(section, piece, n, name): the sections that each range of the rows, in order of ``keys``, makes, in files of these names; ranges are cut between values of the first key."""
    rows = written(rows, "rows")  # counted, sampled and read: made once
    parts = max(1, -(-rows.count() // PIECE_ROWS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        found = [pdf for pdf in batches if len(pdf)]
        if found:
            store, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            store.create_dir(root, recursive=True)
            told = []
            for section, n, content in made(pd.concat(found, ignore_index=True)):
                name = f"{root}/{section}-{uuid.uuid4().hex}"
                with store.open_output_stream(name) as out:
                    out.write(content)
                told.append((section, TaskContext.get().partitionId(), n, name))
            yield pd.DataFrame(told, columns=["section", "piece", "n", "name"])

    return rows.repartitionByRange(parts, keys[0]).sortWithinPartitions(*keys).mapInPandas(run, "section int, piece int, n long, name string")


def _faces_of(pdf: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """Vertices, faces (numbers of the piece's vertices) and objects of triangles in order."""
    corners = pdf[list(TRIANGLE)].to_numpy().reshape(-1, 3)
    points, index = np.unique(np.column_stack([np.repeat(pdf.object_id.to_numpy(), 3), corners]), axis=0, return_inverse=True)
    return [(0, len(points), np.asarray(points[:, 1:], "<f4").tobytes()), (1, len(pdf), np.asarray(index.reshape(-1), "<u4").tobytes()), (2, len(pdf), np.asarray(pdf.object_id, "<i4").tobytes())]


def _edges_of(pdf: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    return [(3, len(pdf), np.asarray(pdf[list(EDGE[:3])], "<f4").tobytes()), (4, len(pdf), np.asarray(pdf[list(EDGE[3:])], "<f4").tobytes()), (5, len(pdf), np.asarray(pdf.object_id, "<i4").tobytes())]


def _cells_of(pdf: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    cells = np.zeros(len(pdf), dtype=CELL)
    cells["i"] = pdf[["ix", "iy", "iz"]].to_numpy()
    for c in ("center_count", "touch_count", "avg_size_mean", "vol_ratio"):
        cells[c] = pdf[c]
    return [(6, len(pdf), cells.tobytes())]


def write_pre(triangles: DataFrame, edges: DataFrame, grid: DataFrame | None, cell_size: float | None, path: str) -> None:
    """Write one preprocessed file, which the format needs: tasks make its pieces, and one task puts them one behind the other.

    The driver is told how many rows each piece has, and nothing else; pieces are
    files of their own, of which the last task holds one at a time.
    """
    folder = new_folder(triangles.sparkSession, "sections")
    pieces = _in_pieces(triangles, ["object_id", "tri_id"], _faces_of, folder).unionByName(_in_pieces(edges, ["object_id", "edge_id"], _edges_of, folder))
    if grid is not None:
        pieces = pieces.unionByName(_in_pieces(grid, ["ix", "iy", "iz"], _cells_of, folder))
    # a union numbers its partitions through: the order stays
    pieces = written(pieces, "pieces")
    total = {r["section"]: r["n"] for r in pieces.groupBy("section").agg(F.sum("n").alias("n")).collect()}
    n = [total.get(k, 0) for k in range(7)]
    head = HEADER.pack(MAGIC, VERSION, n[0], n[1], n[2], n[3], n[1], grid is not None, n[3] > 0)
    cells = struct.pack("<fI", cell_size, n[6]) if grid is not None else b""
    ahead = [(-1, 0, 0, ""), (6, -1, 0, "")]
    pieces = pieces.unionByName(pieces.sparkSession.createDataFrame(ahead, pieces.schema))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        store, where = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        source, _ = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        own = f"{where}.{TaskContext.get().taskAttemptId()}"
        first, at = [], 0  # the number of vertices before each piece
        with store.open_output_stream(own) as out:
            for pdf in batches:
                for section, count, name in zip(pdf.section, pdf.n, pdf.name, strict=True):
                    if not name:
                        out.write(head if section < 0 else cells)
                        continue
                    with source.open_input_stream(name) as piece:
                        content = piece.read()
                    if section == 0:
                        first.append(sum(first[-1:]) + at)
                        at = count
                    elif section == 1:
                        content = (np.frombuffer(content, "<u4") + np.uint32(first.pop(0))).astype("<u4").tobytes()
                    out.write(content)
        store.move(own, where)
        yield pd.DataFrame({"done": [True]})

    pieces.repartition(1).sortWithinPartitions("section", "piece").mapInPandas(put, "done boolean").collect()


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of NPZ archives (``vertices``, ``faces``), numbered by path; what cannot be read is left out."""
    from pyspark.sql import Window

    files = _files(spark, path)
    ids = files.select("path").withColumn("object_id", F.row_number().over(Window.orderBy("path")).cast("long") - 1)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for of, raw in zip(pdf.object_id, pdf.content, strict=True):
                try:
                    with np.load(io.BytesIO(raw)) as x:
                        flat = np.asarray(x["vertices"], dtype=float)[np.asarray(x["faces"], dtype=np.int64)].reshape(-1, 9)
                except (ValueError, KeyError, OSError, IndexError):
                    continue
                yield pd.DataFrame({"object_id": of, "tri_id": np.arange(len(flat))} | {c: flat[:, i] for i, c in enumerate(TRIANGLE)})

    return files.join(ids, "path").select("object_id", "content").mapInPandas(parse, "object_id long, tri_id long, " + ", ".join(f"{n} double" for n in TRIANGLE))
