"""Map packages: a scene imported once, hashed by content, published as tables and checked when loaded.

A package is a folder of tables under its revision: triangles, assets, and last of all the manifest. Readers see a
package by its manifest alone, so one that was written in part is nobody's, and the next import replaces it.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import scenes
from . import meshmap, records

#: Fixed values of the manifest.
SCHEMA, FRAME, UNITS = 1, "local_ENU", "metres"
CAPABILITIES = {"surface": True, "raycast": True, "visibility": "occluded_or_unknown", "occupancy": False, "esdf": False, "road_topology": False, "reachability": False}
#: The second way to make a revision, of packages whose manifest names it.
BY_SOURCE = "sha256-source-geometry-placement-v1"
IMPORTER = "trackweave-importer-1"
COLUMNS = ["entity_id", "source_name", "semantic", "triangle_id", "a", "b", "c"]
MANIFEST = "manifest string, sha string"


class PackageError(ValueError):
    """A package that isn't what its manifest says."""


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; numbers must be finite."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table_digest(rows: DataFrame, columns: Iterable[str]) -> str:
    """SHA-256 of a table whatever the order of its rows: the sums of four 60-bit parts of the rows' own hashes, and their number."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    got = rows.agg(F.count("*"), *[F.coalesce(x, F.lit(0)) for x in lanes]).first()
    return _sha(":".join(str(v) for v in got))


def source_digest(files: DataFrame, config: dict) -> str:
    """Of all source files, by name, and the configuration without its `runtime` part: equal inputs need no new import."""
    listed = files.select("name", "sha").groupBy().agg(F.sort_array(F.collect_list(F.struct("name", "sha"))).alias("all")).select(F.sha2(F.to_json("all"), 256).alias("d")).first()["d"]
    return _sha("\0".join([IMPORTER, listed, canonical({k: v for k, v in config.items() if k != "runtime"})]))


def imported(files: DataFrame, config: dict) -> tuple[DataFrame, dict]:
    """Triangles of a source's layers, and what the manifest says of them.

    Both layers' entities keep their layer's name in front of their id; the terrain is left out where the scene says that it holds it. A
    static scene, if there is one, stands for the layers' files.
    """
    placement, found = scenes.layers(files)
    told: dict = {"scene_version": "render_mesh_import"}
    used = {layer: scene for layer, (_, scene) in found.items() if not (layer == "terrain_tileset" and placement.get("scene_contains_terrain"))}
    static = files.where("name = 'static_scene.json'")
    if not static.isEmpty():
        triangles, told = scenes.static_scene(static)
    else:
        parts = []
        for layer, scene in used.items():
            rows = scenes.glb_triangles(files.where(F.col("name") == scene))
            parts.append(rows.withColumn("entity_id", F.concat(F.lit(layer + ":"), "entity_id")))
        triangles = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        triangles = scenes.labelled(triangles, config.get("semantics", {}))
    wanted = {name for pair in found.values() for name in pair} | {"placement.json"}
    hashes = {r["name"]: r["sha"] for r in files.where(F.col("name").isin(*wanted)).select("name", "sha").collect()}
    if missing := wanted - hashes.keys():
        raise scenes.SceneError(f"missing: {sorted(missing)}")
    return triangles.select(*COLUMNS), {**told, "anchor": placement["anchor"], "placement_sha256": hashes.pop("placement.json"), "sources": hashes}


def _manifest_table(root: str, revision: str) -> str:
    return f"{root}/manifests/revision={revision}"


def _read_manifest(spark: SparkSession, root: str, revision: str) -> dict | None:
    try:
        row = spark.read.schema(MANIFEST).parquet(_manifest_table(root, revision)).first()
    except AnalysisException:  # not there
        return None
    if row is None:
        return None
    if _sha(row["manifest"]) != row["sha"]:
        raise PackageError("the manifest's checksum doesn't match")
    return json.loads(row["manifest"])


def revision_of(manifest: dict) -> str:
    """The revision that a manifest must have, by either of two rules."""
    if manifest.get("revision_algorithm") == BY_SOURCE:
        return _sha(manifest["source_digest"] + manifest["geometry_sha256"] + manifest["placement_sha256"])
    return _sha(canonical({k: v for k, v in manifest.items() if k != "map_revision"}))


def checked(manifest: dict) -> dict:
    """The manifest if it can be used: schema, frame, quality and revision."""
    quality = manifest.get("quality") or {}
    confidence, sigma = quality.get("confidence"), quality.get("surface_sigma_m")
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)
    if manifest.get("schema_version") != SCHEMA or manifest.get("coordinate_frame") != FRAME:
        raise PackageError("unsupported map package")
    if not (number(confidence) and 0 <= confidence <= 1 and number(sigma) and sigma > 0):
        raise PackageError("invalid map quality")
    if manifest.get("map_revision") != revision_of(manifest):
        raise PackageError("the revision doesn't match the manifest")
    return manifest


def import_map(spark: SparkSession, source: str, root: str, config: dict) -> str:
    """Imports the scene files below `source` into the packages at `root`; the revision.

    A source and configuration that were imported before give the package at hand, if it still holds what its manifest says; a
    damaged one is written anew. Display assets (all files) are kept in the package by name and hash.
    """
    files = scenes.source_files(spark, source)
    digest = source_digest(files, config)
    try:
        known = spark.read.schema("revision string").parquet(f"{root}/inputs/digest={digest}").first()
    except AnalysisException:
        known = None
    if known is not None and sound(spark, root, known["revision"]):
        return known["revision"]
    triangles, told = imported(files, config)
    stage = f"{root}/staging/digest={digest}"
    triangles.write.mode("overwrite").parquet(stage)
    triangles = spark.read.parquet(stage)
    if triangles.isEmpty():
        raise scenes.SceneError("no triangles imported")
    seen = meshmap.bounds(triangles).first()
    manifest = {
        **told, "schema_version": SCHEMA, "map_id": config.get("map_id", "map"), "coordinate_frame": FRAME, "units": UNITS, "quality": config["quality"], "source_digest": digest,
        "importer_version": IMPORTER, "geometry_sha256": table_digest(triangles, COLUMNS), "bounds": [[seen[f"min_{k}"], seen[f"max_{k}"]] for k in "xyz"], "entity_count": seen["entities"],
        "triangle_count": seen["triangles"] + seen["degenerate"], "capabilities": CAPABILITIES, "assets_sha256": table_digest(files, ["name", "sha"]),
    }
    revision = manifest["map_revision"] = revision_of(manifest)
    checked(manifest)
    if source_digest(scenes.source_files(spark, source), config) != digest:
        raise scenes.SceneError("the source changed during the import")
    triangles.write.mode("overwrite").parquet(f"{root}/triangles/revision={revision}")
    files.write.mode("overwrite").parquet(f"{root}/assets/revision={revision}")
    text = canonical(manifest)
    spark.createDataFrame([(text, _sha(text))], MANIFEST).coalesce(1).write.mode("overwrite").parquet(_manifest_table(root, revision))
    spark.createDataFrame([(revision,)], "revision string").coalesce(1).write.mode("overwrite").parquet(f"{root}/inputs/digest={digest}")
    return revision


def load_map(spark: SparkSession, root: str, revision: str) -> tuple[DataFrame, dict]:
    """Triangles and manifest of a published package; an error if either isn't what the other says."""
    manifest = _read_manifest(spark, root, revision)
    if manifest is None or manifest.get("map_revision") != revision:
        raise PackageError(f"no package {revision}")
    triangles = spark.read.parquet(f"{root}/triangles/revision={revision}")
    if table_digest(triangles, COLUMNS) != checked(manifest)["geometry_sha256"]:
        raise PackageError("the triangles' checksum doesn't match")
    return triangles, manifest


def sound(spark: SparkSession, root: str, revision: str) -> bool:
    """Whether a package's triangles, manifest and assets are all there and what they say of one another."""
    try:
        _, manifest = load_map(spark, root, revision)
        held = spark.read.parquet(f"{root}/assets/revision={revision}")
        return table_digest(held, ["name", "sha"]) == manifest["assets_sha256"] and held.where("sha2(content, 256) IS DISTINCT FROM sha").isEmpty()
    except (PackageError, AnalysisException):
        return False


def assets(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """(name, sha, content) of a package's display files; a file whose contents or name aren't sound fails the job, a list that isn't the manifest's is an error.

    The files are those of the revision, whatever has happened to their source since.
    """
    _, manifest = load_map(spark, root, revision)
    rows = spark.read.parquet(f"{root}/assets/revision={revision}")
    if table_digest(rows, ["name", "sha"]) != manifest["assets_sha256"]:
        raise PackageError("the assets aren't those of the manifest")
    placement = json.loads(bytes(rows.where("name = 'placement.json'").first()["content"]))
    if placement["anchor"] != manifest["anchor"]:
        raise PackageError("the assets' anchor isn't the map's")
    named = [placement["files"][k] for k in ("building_tileset", "terrain_provider") if k in placement["files"]]
    if rows.where(F.col("name").isin(*named)).count() < len(set(named)):
        raise PackageError("the placement names files that aren't there")
    good = (F.sha2("content", 256) == F.col("sha")) & ~F.col("name").rlike(r"^/|(^|/)\.\.?(/|$)|//")
    return rows.withColumn("content", F.when(good, F.col("content")).otherwise(F.raise_error(F.lit("an asset's checksum or name isn't sound")).cast("binary")))


def load_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Triangles and manifest of a package that is a folder of files: manifest.json, manifest.sha256 (if there) and geometry.json.gz."""
    files = spark.read.format("binaryFile").load(f"{folder}/manifest.json").unionByName(spark.read.format("binaryFile").option("pathGlobFilter", "manifest.sha256").load(folder))
    contents = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in files.select("path", "content").collect()}
    text = contents["manifest.json"]
    if "manifest.sha256" in contents and contents["manifest.sha256"].decode("ascii").strip() != hashlib.sha256(text).hexdigest():
        raise PackageError("the manifest's checksum doesn't match")
    manifest = checked(json.loads(text))
    blob = spark.read.format("binaryFile").load(f"{folder}/geometry.json.gz").select(F.sha2("content", 256).alias("d")).first()
    if blob["d"] != manifest["geometry_sha256"]:
        raise PackageError("the geometry's checksum doesn't match")
    entities = spark.read.schema(f"entities array<{scenes.ENTITY}>").option("multiLine", "true").json(f"{folder}/geometry.json.gz").select(F.explode("entities").alias("e"))
    flat = entities.select(F.col("e.id").alias("entity_id"), F.col("e.name").alias("source_name"), F.coalesce("e.semantic", F.lit("unknown")).alias("semantic"), F.posexplode("e.triangles").alias("triangle_id", "t"))
    return flat.select("entity_id", "source_name", "semantic", F.col("triangle_id").cast("long").alias("triangle_id"), *[F.col("t")[i].alias(c) for i, c in enumerate("abc")]), manifest


def tileset_conflicts(sources: DataFrame, held: DataFrame) -> DataFrame:
    """Sources (name, sha) that a package's assets (name, sha) don't hold with the same contents."""
    return sources.join(held.select("name", "sha"), ["name", "sha"], "left_anti")


# --- the active map ----------------------------------------------------------------------------------

ACTIVE = "map_revision string, swap long"


def activate(spark: SparkSession, root: str, source: str, config: dict) -> tuple[str, bool]:
    """Imports the source and makes it the active map if it isn't; (revision, changed). A failed import leaves the active map as it is and raises."""
    revision = import_map(spark, source, root, config)
    while True:
        now = active(spark, root)
        if now is not None and now[0] == revision:
            return revision, False
        swap = 0 if now is None else now[1] + 1
        if records.publish(spark, f"{root}/active", swap, {"map_revision": revision, "swap": swap}):
            return revision, True  # else another swap got the number: look again


def active(spark: SparkSession, root: str) -> tuple[str, int] | None:
    """(revision, number of the swap) of the active map, None before the first."""
    row = records.newest(spark, f"{root}/active", ACTIVE, "swap")
    return None if row is None else (row["map_revision"], row["swap"])


def changed(spark: SparkSession, root: str, since: str) -> dict:
    """What a watcher that knows revision `since` (or none: empty) is told."""
    if len(since) not in (0, 64):
        raise ValueError("since must be a revision or empty")
    now = active(spark, root)
    revision = now[0] if now else ""
    return {"map_revision": revision, "changed": revision != since}


def watch(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the active map's swaps (map_revision, swap), for those who wait for changes."""
    return spark.readStream.schema(ACTIVE).json(f"{root}/active")


def reload_on(ticks: DataFrame, root: str, source: str, config: dict, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Looks at the source after each trigger of a stream of ticks, every two seconds by default, and swaps the map when it changed.

    A source that can't be imported leaves the active map in place; the next trigger looks again.
    """

    def again(batch: DataFrame, epoch: int) -> None:
        try:
            activate(batch.sparkSession, root, source, config)
        except (scenes.SceneError, PackageError, PySparkException) as e:  # tasks' errors come as Spark's
            print(f"the active map stays: {e}")

    return ticks.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()
