"""Readers of mesh formats and lists."""

from . import text
from .binary import read_npz, read_pre, require_edges, write_pre
from .lists import read_bucket_ids, read_ids, read_manifest, read_nuclei, read_pairs
from .text import read_obj, read_off, read_off_lines, read_wkt_polygons

#: Loaders by extension.
LOADERS = {"obj": read_obj, "off": read_off, "pre": lambda spark, path: read_pre(spark, path).triangles}


def load(spark, path: str):
    """Triangles of a dataset, by the path's extension; the extension decides alone."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in LOADERS:
        raise ValueError(f"unsupported dataset format: {path}")
    return LOADERS[kind](spark, path)


__all__ = ["LOADERS", "load", "read_bucket_ids", "read_ids", "read_manifest", "read_npz", "read_nuclei", "read_obj", "read_off", "read_off_lines", "read_pairs", "read_pre", "read_wkt_polygons", "require_edges", "text", "write_pre"]
