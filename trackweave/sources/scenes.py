"""Scene files as triangle tables: binary glTF, static scenes in JSON, and the placement that names them.

A scene file is opened by one task, since its format can't be split; many files are many tasks, and what
comes out is one row for each triangle.
"""

from __future__ import annotations

import json
import math
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import enu_to_ecef

#: Numbers of the binary format: magic, version, and kinds of components (fixed values).
MAGIC, VERSION, TRIANGLES = b"glTF", 2, 4
COMPONENTS = {5121: "<u1", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC3": 3}
#: From the files' axes (y up) to east, north, up.
TO_ENU = np.array([[1.0, 0, 0], [0, 0, -1], [0, 1, 0]])
ROWS_AT_ONCE = 50_000
#: Documents that the driver reads in full are no larger.
MOST_JSON = 4 * 1024 * 1024
TRIANGLE = "name string, entity_id string, source_name string, triangle_id long, a array<double>, b array<double>, c array<double>"


class SceneError(ValueError):
    """A scene that is broken or holds what isn't supported."""


def _need(ok, message: str) -> None:
    if not ok:
        raise SceneError(message)


# --- binary glTF -------------------------------------------------------------------------------------


def node_matrix(node: dict) -> np.ndarray:
    """4 x 4 matrix of a node: given in full (affine), or from translation, rotation and scale."""
    if "matrix" in node:
        m = np.array(node["matrix"], float)
        _need(m.shape == (16,) and np.isfinite(m).all() and (m[3::4] == [0, 0, 0, 1]).all(), "a node needs a finite affine matrix")
        return m.reshape(4, 4).T
    q, s, t = (np.array(node.get(k, d), float) for k, d in (("rotation", [0, 0, 0, 1]), ("scale", [1, 1, 1]), ("translation", [0, 0, 0])))
    _need(q.shape == (4,) and s.shape == t.shape == (3,) and all(np.isfinite(v).all() for v in (q, s, t)), "a node's transform must be finite")
    _need(abs(q @ q - 1) <= 1e-5, "a node's rotation must be a unit quaternion")
    x, y, z, w = q
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = (np.eye(3) + 2 * w * k + 2 * k @ k) * s, t
    return m


class Glb:
    """One binary glTF 2.0 file: static, uncompressed triangles in a single embedded buffer."""

    def __init__(self, blob: bytes):
        _need(len(blob) >= 12 and blob[:4] == MAGIC, "not a binary glTF file")
        version, length = np.frombuffer(blob, "<u4", 2, 4).tolist()
        _need(version == VERSION and length == len(blob), "wrong version or length")
        chunks, at = {}, 12
        while at < len(blob):
            _need(at + 8 <= len(blob), "truncated chunk")
            size, kind = int.from_bytes(blob[at : at + 4], "little"), blob[at + 4 : at + 8]
            _need(size % 4 == 0 and at + 8 + size <= len(blob) and kind not in chunks, "invalid chunk")
            chunks[kind] = blob[at + 8 : at + 8 + size]
            at += 8 + size
        _need(set(chunks) >= {b"JSON", b"BIN\0"}, "JSON or binary chunk missing")
        self.doc, self.data = json.loads(chunks[b"JSON"]), chunks[b"BIN\0"]
        _need(not any(self.doc.get(k) for k in ("extensionsRequired", "skins", "animations")), "compressed, skinned and animated files aren't supported")
        buffers = self.doc.get("buffers", [])
        _need(len(buffers) == 1 and "uri" not in buffers[0], "a single embedded buffer is needed")

    def accessor(self, index: int) -> np.ndarray:
        spec = self.doc["accessors"][index]
        _need(not spec.get("sparse") and not spec.get("normalized"), "sparse and normalised accessors aren't supported")
        _need(spec["type"] in WIDTHS and spec["componentType"] in COMPONENTS, "unsupported accessor type")
        kind, width, count = np.dtype(COMPONENTS[spec["componentType"]]), WIDTHS[spec["type"]], spec["count"]
        view = self.doc["bufferViews"][spec["bufferView"]]
        first, inner, size = view.get("byteOffset", 0), spec.get("byteOffset", 0), kind.itemsize * width
        stride, end = view.get("byteStride", size), first + view["byteLength"]
        fits = count >= 1 and first >= 0 and inner >= 0 and view.get("buffer", 0) == 0 and stride >= size and end <= len(self.data) and first + inner + (count - 1) * stride + size <= end
        _need(fits, "an accessor exceeds its view")
        return np.ndarray((count, width), kind, self.data, first + inner, (stride, kind.itemsize))

    def entities(self) -> Iterator[tuple[int, str, np.ndarray]]:
        """(node, name, corners (n, 3, 3) in ENU) of each node with a mesh, parents before children."""
        todo = [(i, np.eye(4), frozenset()) for i in reversed(self.doc["scenes"][self.doc.get("scene", 0)]["nodes"])]
        while todo:
            index, parent, above = todo.pop()
            _need(index not in above, "nodes form a cycle")
            node = self.doc["nodes"][index]
            _need(not node.get("extensions") and not node.get("weights"), "node extensions and morph targets aren't supported")
            world = parent @ node_matrix(node)
            if "mesh" in node:
                parts = [self._corners(p, world) for p in self.doc["meshes"][node["mesh"]]["primitives"]]
                yield index, node.get("name", f"node-{index}"), np.concatenate([np.zeros((0, 3, 3)), *parts])
            todo += [(i, world, above | {index}) for i in reversed(node.get("children", []))]

    def _corners(self, primitive: dict, world: np.ndarray) -> np.ndarray:
        _need(primitive.get("mode", TRIANGLES) == TRIANGLES and not primitive.get("extensions") and not primitive.get("targets"), "only plain static triangles are supported")
        points = self.accessor(primitive["attributes"]["POSITION"])
        _need(points.shape[1] == 3, "positions need three coordinates")
        placed = (points.astype(float) @ world[:3, :3].T + world[:3, 3]) @ TO_ENU.T
        _need(np.isfinite(placed).all(), "coordinates must be finite")
        order = np.arange(len(placed))
        if "indices" in primitive:
            order = self.accessor(primitive["indices"])
            _need(order.shape[1] == 1 and order.dtype.kind == "u", "indices must be unsigned numbers")
            order = order[:, 0].astype(np.int64)
        _need(len(order) % 3 == 0 and order.max(initial=-1) < len(placed), "invalid triangle indices")
        return placed[order].reshape(-1, 3, 3)


def glb_triangles(files: DataFrame) -> DataFrame:
    """Triangles of binary glTF files (name, content): name, entity_id (node-<n>), source_name, triangle_id and corners a, b, c in ENU metres.

    triangle_id counts within the entity. A broken or unsupported file fails the job with the reason. Null
    contents and nodes without triangles give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for node, label, corners in Glb(blob.as_py()).entities() if blob.is_valid else ():
                    for at in range(0, len(corners), ROWS_AT_ONCE):
                        some = corners[at : at + ROWS_AT_ONCE]
                        n = len(some)
                        points = [pa.FixedSizeListArray.from_arrays(some[:, k].ravel(), 3).cast(pa.list_(pa.float64())) for k in range(3)]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([f"node-{node}"] * n), pa.array([label] * n), pa.array(np.arange(at, at + n)), *points], ["name", "entity_id", "source_name", "triangle_id", "a", "b", "c"])

    return files.select("name", "content").mapInArrow(run, TRIANGLE)


def labelled(triangles: DataFrame, semantics: dict[str, str]) -> DataFrame:
    """Adds `semantic`: the label of exactly this source name, else unknown. The labels are a configured list and are broadcast."""
    table = triangles.sparkSession.createDataFrame(list(semantics.items()), "source_name string, _label string")
    return triangles.join(F.broadcast(table), "source_name", "left").withColumn("semantic", F.coalesce("_label", F.lit("unknown"))).drop("_label")


# --- static scenes -----------------------------------------------------------------------------------

ENTITY = "struct<id:string,name:string,semantic:string,triangles:array<array<array<double>>>>"
STATIC = f"coordinate_frame string, units string, transform_to_map_enu array<double>, alignment_status string, alignment_confidence string, scene_version string, entities array<{ENTITY}>"


def static_scene(files: DataFrame) -> tuple[DataFrame, dict]:
    """Triangles of one static scene (a row name, content of JSON), moved to the map by its affine transform, and its head.

    The scene must be in local ENU metres with a verified alignment and a transform of 16 numbers. Entities without triangles are left out;
    a triangle without three finite points fails the job.
    """
    scene = files.select("name", F.from_json(F.col("content").cast("string"), STATIC).alias("s")).select("name", "s.*")
    head = scene.drop("entities", "name").withColumn("has_entities", F.lit(True)).first()
    _need(head is not None and head["coordinate_frame"] == "local_ENU" and head["units"] == "metres", "a static scene must be in local_ENU metres")
    m = head["transform_to_map_enu"]
    _need(m is not None and len(m) == 16 and all(v is not None and math.isfinite(v) for v in m), "a static scene needs a transform to the map")
    _need(head["alignment_status"] not in (None, "", "unaligned"), "the scene's alignment is unverified")
    flat = scene.select("name", F.explode("entities").alias("e")).select("name", F.col("e.id").alias("entity_id"), F.col("e.name").alias("source_name"), F.col("e.semantic").alias("semantic"), F.posexplode("e.triangles").alias("triangle_id", "t"))
    sound = F.coalesce((F.size("t") == 3) & F.forall("t", lambda p: (F.size(p) == 3) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))), F.lit(False)) & F.col("entity_id").isNotNull()
    moved = lambda p: F.array(*[sum((p[k] * float(m[4 * k + r]) for k in (1, 2)), p[0] * float(m[r])) + float(m[12 + r]) for r in range(3)])
    points = F.when(sound, F.col("t")).otherwise(F.raise_error(F.lit("a triangle needs three finite points")).cast("array<array<double>>"))
    rows = flat.withColumn("t", points).select("name", "entity_id", "source_name", "semantic", F.col("triangle_id").cast("long").alias("triangle_id"), *[moved(F.col("t")[i]).alias(c) for i, c in enumerate("abc")])
    return rows, {k: head[k] for k in ("alignment_status", "alignment_confidence", "scene_version")}


# --- sources -----------------------------------------------------------------------------------------


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, sha, content) of all files below a folder; names are relative, with slashes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "%20", " ")
    return rows.select(F.substring(path, F.length(base) + 2, F.lit(1_000_000)).alias("name"), F.sha2("content", 256).alias("sha"), "content")


def inside(*parts: str) -> str:
    """A path relative to the source folder; an error if it leaves the folder."""
    path = posixpath.normpath(posixpath.join(*parts))
    _need(not path.startswith(("/", "..")) and path != ".", f"{path} leaves the source folder")
    return path


def _document(files: DataFrame, name: str) -> dict:
    found = files.where((F.col("name") == name) & (F.length("content") <= MOST_JSON)).select("content").first()
    _need(found is not None, f"{name} is missing or too large")
    return json.loads(bytes(found["content"]))


def layers(files: DataFrame) -> tuple[dict, dict[str, tuple[str, str]]]:
    """The placement, and (tileset, scene file) of its two layers, checked.

    The anchor must be a place on Earth, and each tileset a single tile whose transform is that from the anchor's ENU frame.
    """
    placement = _document(files, "placement.json")
    anchor = placement.get("anchor") or {}
    lon, lat, height = (anchor.get(k) for k in ("longitude_deg", "latitude_deg", "ellipsoid_height_m"))
    _need(all(isinstance(v, int | float) and math.isfinite(v) for v in (lon, lat, height)) and -180 <= lon <= 180 and -90 <= lat <= 90, "invalid anchor")
    expected = files.sparkSession.range(1).select(enu_to_ecef(F.lit(float(lon)), F.lit(float(lat)), F.lit(float(height))).alias("m")).first()["m"]
    found = {}
    for layer in ("building_tileset", "terrain_tileset"):
        _need(isinstance(placement.get("files", {}).get(layer), str), f"the placement has no {layer}")
        tileset = inside(placement["files"][layer])
        root = _document(files, tileset).get("root", {})
        m = root.get("transform") or []
        _need(not root.get("children"), "only a single tile is supported")
        _need(len(m) == 16 and all(isinstance(v, int | float) and abs(v - e) <= 1e-5 for v, e in zip(m, expected, strict=True)), "the tile's transform isn't that of the anchor")
        found[layer] = (tileset, inside(posixpath.dirname(tileset), root["content"]["uri"]))
    return placement, found
