"""Scene files, map packages and terrain tiles."""

import gzip
import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import geodesy
from trackweave.operators import mappackage, meshmap, terrain
from trackweave.sources import scenes


def glb(doc, data):
    data += b"\0" * (-len(data) % 4)
    text = json.dumps({"asset": {"version": "2.0"}, "buffers": [{"byteLength": len(data)}], **doc}).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(data)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(data), b"BIN\0") + data


def floor(points=((0, 0, 0), (1, 0, 0), (0, 0, -1)), **node):
    """A triangle with a fourth number beside each point, below a moved parent."""
    data = b"".join(struct.pack("<4f", *p, 123) for p in points)
    return {
        "bufferViews": [{"buffer": 0, "byteLength": len(data), "byteStride": 16}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3"}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}],
        "nodes": [{"translation": [10, 3, -20], "children": [1]}, {"mesh": 0, "name": "floor", "scale": [2, 1, 4]} | node],
        "scenes": [{"nodes": [0]}],
    }, data


def read(spark, *blobs):
    return scenes.glb_triangles(spark.createDataFrame([(f"f{i}", bytearray(b)) for i, b in enumerate(blobs)], "name string, content binary"))


def test_hierarchy_and_axes(spark):
    rows = scenes.labelled(read(spark, glb(*floor())), {"floor": "terrain"}).collect()
    assert [(r["entity_id"], r["source_name"], r["semantic"], r["a"], r["b"], r["c"]) for r in rows] == [("node-1", "floor", "terrain", [10, 20, 3], [12, 20, 3], [10, 24, 3])]
    assert scenes.labelled(read(spark, glb(*floor())), {}).first()["semantic"] == "unknown"


def test_indices_and_matrices(spark):
    doc, data = floor(points=((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)), matrix=[0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1])
    doc["nodes"][1].pop("scale")
    doc["bufferViews"].append({"buffer": 0, "byteLength": 12, "byteOffset": len(data)})
    doc["accessors"].append({"bufferView": 1, "componentType": 5123, "count": 6, "type": "SCALAR"})
    doc["meshes"][0]["primitives"][0]["indices"] = 1
    got = read(spark, glb(doc, data + struct.pack("<6H", 0, 1, 2, 0, 2, 3))).orderBy("triangle_id").collect()
    base = np.array([15.0, 13.0, 9.0])  # (5, 6, 7) + (10, 3, -20), turned to ENU; x goes up, y to the west
    assert [r["a"] for r in got] == [base.tolist()] * 2 and got[0]["b"] == (base + [0, 0, 1]).tolist() and got[0]["c"] == (base - [1, 0, 0]).tolist() and got[1]["c"] == (base - [0, 1, 0]).tolist()


def test_rotation_is_that_of_the_quaternion():
    q = np.array([0.1, -0.5, 0.3, 0.8])
    q /= np.linalg.norm(q)
    m = scenes.node_matrix({"rotation": q.tolist(), "scale": [2, 3, 4], "translation": [1, 2, 3]})
    v = np.array([0.3, -1.2, 2.0])
    s = v * [2, 3, 4]
    expected = s + 2 * np.cross(q[:3], np.cross(q[:3], s) + q[3] * s) + [1, 2, 3]
    assert np.allclose(m[:3, :3] @ v + m[:3, 3], expected)


def _with(change):
    doc, data = floor()
    change(doc)
    return glb(doc, data)


@pytest.mark.parametrize(
    "blob",
    [
        b"", b"glTF", glb(*floor())[:-4], b"x" + glb(*floor())[1:],
        _with(lambda d: d["nodes"][1].update(children=[0])),
        _with(lambda d: d["nodes"][1].update(rotation=[0, 0, 0, 2])),
        _with(lambda d: d["nodes"][1].update(weights=[1])),
        _with(lambda d: d["meshes"][0]["primitives"][0].update(mode=1)),
        _with(lambda d: d["meshes"][0]["primitives"][0].update(targets=[{}])),
        _with(lambda d: d["accessors"][0].update(count=4)),
        _with(lambda d: d["accessors"][0].update(sparse={"count": 1})),
        _with(lambda d: d["bufferViews"][0].update(byteStride=8)),
        _with(lambda d: d.update(skins=[{}])),
        _with(lambda d: d.update(extensionsRequired=["x"])),
        _with(lambda d: d["buffers"][0].update(uri="x") if "buffers" in d else d.update(buffers=[{"uri": "x"}])),
        glb(*floor(points=((0, 0, 0), (1, 0, 0)))),
        glb(*floor(points=((0, 0, float("nan")), (1, 0, 0), (0, 1, 0)))),
    ],
)
def test_broken_files(blob):
    with pytest.raises(scenes.SceneError):
        list(scenes.Glb(blob).entities())


ANCHOR = {"longitude_deg": 116.0, "latitude_deg": 40.0, "ellipsoid_height_m": 50.0}


def source(spark, root, contains=False, semantics=True):
    m = spark.range(1).select(geodesy.enu_to_ecef(F.lit(116.0), F.lit(40.0), F.lit(50.0)).alias("m")).first()["m"]
    for name, scene in (("buildings", floor()), ("ground", floor(points=((0, 0, 0), (5, 0, 0), (0, 5, 0)), name="soil"))):
        (root / name).mkdir(parents=True)
        (root / name / "tileset.json").write_text(json.dumps({"root": {"transform": m, "content": {"uri": "scene.glb"}}}))
        (root / name / "scene.glb").write_bytes(glb(*scene))
    (root / "placement.json").write_text(json.dumps({"anchor": ANCHOR, "files": {"building_tileset": "buildings/tileset.json", "terrain_tileset": "ground/tileset.json"}, "scene_contains_terrain": contains}))
    return str(root)


CONFIG = {"map_id": "park", "quality": {"confidence": 0.5, "surface_sigma_m": 2}, "semantics": {"floor": "road"}, "runtime": {"port": 1}}


def test_import_load_and_repair(spark, tmp_path):
    at, root = source(spark, tmp_path / "in"), str(tmp_path / "maps")
    revision = mappackage.import_map(spark, at, root, CONFIG)
    triangles, manifest = mappackage.load_map(spark, root, revision)
    assert {(r["entity_id"], r["semantic"]) for r in triangles.collect()} == {("building_tileset:node-1", "road"), ("terrain_tileset:node-1", "unknown")}
    assert (manifest["entity_count"], manifest["triangle_count"], manifest["bounds"][0]) == (2, 2, [10.0, 20.0]) and manifest["map_revision"] == revision
    assert sorted(manifest["sources"]) == ["buildings/scene.glb", "buildings/tileset.json", "ground/scene.glb", "ground/tileset.json"]
    assert mappackage.import_map(spark, at, root, CONFIG | {"runtime": {"port": 2}}) == revision, "the runtime part is no input"
    files = mappackage.assets(spark, root, revision)
    assert files.count() == 5 and all(hashlib.sha256(bytes(r["content"])).hexdigest() == r["sha"] for r in files.collect())
    assert mappackage.tileset_conflicts(spark.createDataFrame(list(manifest["sources"].items()), "name string, sha string"), files).isEmpty()
    # A damaged package is found, and written anew by the next import.
    triangles.limit(1).withColumn("a", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).write.mode("append").parquet(f"{root}/triangles/revision={revision}")
    with pytest.raises(mappackage.PackageError):
        mappackage.load_map(spark, root, revision)
    assert mappackage.import_map(spark, at, root, CONFIG) == revision and mappackage.load_map(spark, root, revision)[0].count() == 2
    with pytest.raises(mappackage.PackageError):
        mappackage.load_map(spark, root, "0" * 64)


def test_terrain_within_the_scene_and_bad_sources(spark, tmp_path):
    at = source(spark, tmp_path / "in", contains=True)
    triangles, told = mappackage.imported(scenes.source_files(spark, at), CONFIG)
    assert triangles.count() == 1 and told["anchor"] == ANCHOR and len(told["sources"]) == 4
    for change in ({"files": {"building_tileset": "../x.json", "terrain_tileset": "ground/tileset.json"}}, {"anchor": ANCHOR | {"latitude_deg": 41.0}}, {"anchor": ANCHOR | {"longitude_deg": 181}}, {"files": {"building_tileset": "buildings/tileset.json"}}):
        (tmp_path / "in" / "placement.json").write_text(json.dumps({"anchor": ANCHOR, "files": {"building_tileset": "buildings/tileset.json", "terrain_tileset": "ground/tileset.json"}} | change))
        with pytest.raises(scenes.SceneError):
            scenes.layers(scenes.source_files(spark, at))


STATIC = {"coordinate_frame": "local_ENU", "units": "metres", "transform_to_map_enu": [0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1], "alignment_status": "surveyed", "alignment_confidence": "0.9", "scene_version": "v3"}
DECK = {"id": "e1", "name": "deck", "semantic": "road", "triangles": [[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 0, 1], [1, 0, 1], [0, 1, 1]]]}


def test_static_scene(spark, tmp_path):
    at = source(spark, tmp_path / "in")
    (tmp_path / "in" / "static_scene.json").write_text(json.dumps(STATIC | {"entities": [DECK, DECK | {"id": "e2", "triangles": []}]}))
    triangles, manifest = mappackage.load_map(spark, str(tmp_path / "m"), mappackage.import_map(spark, at, str(tmp_path / "m"), CONFIG))
    got = triangles.orderBy("triangle_id").collect()
    assert [(r["entity_id"], r["triangle_id"], r["a"], r["b"], r["c"]) for r in got] == [("e1", 0, [5, 6, 7], [5, 7, 7], [4, 6, 7]), ("e1", 1, [5, 6, 8], [5, 7, 8], [4, 6, 8])]
    assert (manifest["scene_version"], manifest["alignment_status"]) == ("v3", "surveyed")


@pytest.mark.parametrize("change", [{"units": "feet"}, {"transform_to_map_enu": [1, 2]}, {"alignment_status": "unaligned"}, {"alignment_status": None}, {"entities": [DECK | {"triangles": [[[0, 0, 0]]]}]}])
def test_bad_static_scenes(spark, change):
    files = spark.createDataFrame([("s", bytearray(json.dumps(STATIC | {"entities": [DECK]} | change).encode()))], "name string, content binary")
    with pytest.raises(Exception, match="scene|alignment|triangle"):
        scenes.static_scene(files)[0].collect()


@pytest.mark.parametrize("by_source", [False, True])
def test_packages_that_are_folders(spark, tmp_path, by_source):
    geometry = gzip.compress(json.dumps({"entities": [DECK]}).encode(), mtime=0)
    manifest = {"schema_version": 1, "coordinate_frame": "local_ENU", "geometry_sha256": hashlib.sha256(geometry).hexdigest(), "quality": {"confidence": 0.5, "surface_sigma_m": 2}}
    if by_source:
        manifest |= {"revision_algorithm": mappackage.BY_SOURCE, "source_digest": "a", "placement_sha256": "b"}
    manifest["map_revision"] = hashlib.sha256(("a" + manifest["geometry_sha256"] + "b" if by_source else mappackage.canonical(manifest)).encode()).hexdigest()
    text = mappackage.canonical(manifest).encode() + b"\n"
    for name, data in (("manifest.json", text), ("manifest.sha256", hashlib.sha256(text).hexdigest().encode() + b"\n"), ("geometry.json.gz", geometry)):
        (tmp_path / name).write_bytes(data)
    triangles, got = mappackage.load_folder(spark, str(tmp_path))
    assert got == manifest and triangles.count() == 2
    hit = meshmap.raycast(triangles, spark.createDataFrame([(1, [0.2, 0.2, 9.0], [0.0, 0.0, -1.0])], "query_id long, origin array<double>, direction array<double>")).first()
    assert hit["point"][2] == 1.0
    (tmp_path / "geometry.json.gz").write_bytes(geometry[:-1] + b"x")
    with pytest.raises(mappackage.PackageError):
        mappackage.load_folder(spark, str(tmp_path))


def test_the_active_map(spark, tmp_path):
    at, root = source(spark, tmp_path / "in"), str(tmp_path / "maps")
    assert mappackage.changed(spark, root, "") == {"map_revision": "", "changed": False}
    first, swapped = mappackage.activate(spark, root, at, CONFIG)
    assert swapped and mappackage.activate(spark, root, at, CONFIG) == (first, False) and mappackage.changed(spark, root, "")["changed"]
    (tmp_path / "in" / "buildings" / "scene.glb").write_bytes(b"broken")
    spark.range(1).write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "ticks"))
    mappackage.reload_on(ticks, root, at, CONFIG, str(tmp_path / "ckpt"), {"availableNow": True}).awaitTermination()
    assert mappackage.active(spark, root) == (first, 0), "a broken source leaves the active map"
    (tmp_path / "in" / "buildings" / "scene.glb").write_bytes(glb(*floor(name="other")))
    second, swapped = mappackage.activate(spark, root, at, CONFIG)
    assert swapped and second != first and mappackage.changed(spark, root, first) == {"map_revision": second, "changed": True}
    mappackage.watch(spark, root).writeStream.format("memory").queryName("swaps").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "w")).start().awaitTermination()
    assert sorted(r["swap"] for r in spark.table("swaps").collect()) == [0, 1]


def decoded(data, side=9):
    head, n = struct.unpack_from("<3d2f4d3d", data), struct.unpack_from("<I", data, 88)[0]
    back = lambda v: np.cumsum((v >> 1) ^ -(v & 1))
    u, v, h = (back(np.frombuffer(data, "<u2", n, 92 + 2 * n * k).astype(np.int64)) for k in range(3))
    at = 92 + 6 * n
    count = struct.unpack_from("<I", data, at)[0]
    indices, high = [], 0
    for code in np.frombuffer(data, "<u2", 3 * count, at + 4).tolist():
        indices.append(high - code)
        high += code == 0
    at += 4 + 6 * count
    edges = []
    for _ in range(4):
        assert struct.unpack_from("<I", data, at)[0] == side
        edges.append(np.frombuffer(data, "<u2", side, at + 4).tolist())
        at += 4 + 2 * side
    assert at == len(data)
    return head, u, v, h, np.array(indices).reshape(-1, 3), edges


def test_terrain_tiles(spark):
    head, u, v, h, triangles, edges = decoded(terrain.tile_bytes(3, 5, 2))
    grid = {(round(i * 32767 / 8), round(j * 32767 / 8)) for i in range(9) for j in range(9)}
    assert set(zip(u.tolist(), v.tolist(), strict=True)) == grid and not h.any() and len(triangles) == 128
    p = np.stack([u, v], 1)[triangles].astype(float)
    area = ((p[:, 1] - p[:, 0])[:, 0] * (p[:, 2] - p[:, 0])[:, 1] - (p[:, 1] - p[:, 0])[:, 1] * (p[:, 2] - p[:, 0])[:, 0]) / 2
    assert (area > 0).all() and area.sum() == 32767**2, "triangles turn one way and cover the tile once"
    assert (u[edges[0]] == 0).all() and (v[edges[1]] == 0).all() and (u[edges[2]] == 32767).all() and (v[edges[3]] == 32767).all()
    assert np.linalg.norm(np.array(head[:3]) / [geodesy.A, geodesy.A, geodesy.B]) == pytest.approx(1)
    box = (116.39, 39.9, 116.4, 39.92)
    places = terrain.cover(spark, box, 6)
    made = terrain.tiles(places).collect()
    assert len(made) >= 8 and {(r["level"], r["x"]) for r in made} >= {(0, 0), (0, 1)} and all(gzip.decompress(bytes(r["terrain"])) == terrain.tile_bytes(r["level"], r["x"], r["y"]) for r in made)
    told = terrain.layer(places, box)
    assert told["maxzoom"] == 6 and len(told["available"]) == 7 and told["available"][0] == [{"startX": 0, "endX": 1, "startY": 0, "endY": 0}]
