"""The registered queries of the tracking and map operators, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, triangles
from ..functions import vectors as V
from ..operators import associate, checkpoints, fusion, graph, identity, ingest, meshmap, tracklets, window_ls
from ..sources import adapters as A
from ..sources import scenes
from ..streaming import inbox, world

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- ingest ------------------------------------------------------------------------------------------

MISSING = "missing AS (SELECT r.* FROM blob_refs r ANTI JOIN blobs b USING (sha, size))"
CURSOR = """ok AS (SELECT DISTINCT node_id, seq FROM received_events ANTI JOIN missing USING (node_id, seq)),
  cursors AS (SELECT n.node_id, coalesce(max(k.seq), 0)::BIGINT AS contiguous FROM (SELECT DISTINCT node_id FROM received_events) n
    LEFT JOIN (SELECT node_id, seq, row_number() OVER (PARTITION BY node_id ORDER BY seq) AS rn FROM ok) k ON k.node_id = n.node_id AND k.seq = k.rn GROUP BY n.node_id)"""
GAPS = """gaps AS (SELECT node_id, prev + 1 AS lo, seq - 1 AS hi FROM (
    SELECT e.node_id, e.seq, lag(e.seq, 1, c.contiguous) OVER (PARTITION BY e.node_id ORDER BY e.seq) AS prev
    FROM (SELECT DISTINCT node_id, seq FROM received_events) e JOIN cursors c USING (node_id) WHERE e.seq > c.contiguous) WHERE seq > prev + 1)"""
INBOX = A.duckdb("track_events", "received_events", "blob_refs", "blobs") + ", " + MISSING + ", " + CURSOR


def _inbox(spark, sf_dir):
    """Received events, and what their ledger holds."""
    events = A.received_events(spark, sf_dir)
    return events, ingest.ledger(events, ingest.missing_blobs(A.blob_refs(spark, sf_dir), A.blobs(spark, sf_dir)))


@query(f"""{INBOX}, {GAPS} SELECT c.node_id, c.contiguous, (SELECT max(seq) FROM received_events e WHERE e.node_id = c.node_id) AS highest,
  (SELECT count(*) FROM gaps g WHERE g.node_id = c.node_id)::BIGINT AS gap_count FROM cursors c""")
def source_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, known = _inbox(spark, sf_dir)
    counts = ingest.gaps_of(known).groupBy("node_id").agg(F.count("*").alias("n"))
    return ingest.cursors_of(known).join(counts, "node_id", "left").select("node_id", "contiguous", "highest", F.coalesce("n", F.lit(0)).alias("gap_count"))


@query(f"{INBOX}, {GAPS} SELECT node_id, lo, hi FROM gaps QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY lo) <= 128")
def source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.gaps_of(_inbox(spark, sf_dir)[1], ingest.MAX_LISTED)


@query(f"""{INBOX}, wanted AS (SELECT DISTINCT m.node_id, m.sha FROM missing m JOIN cursors c USING (node_id) WHERE m.seq > c.contiguous)
  SELECT node_id, sha FROM wanted QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY sha) <= 128""")
def missing_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    acks = ingest.acknowledgements(A.received_events(spark, sf_dir), A.blob_refs(spark, sf_dir), A.blobs(spark, sf_dir))
    return acks.select("node_id", F.explode("missing_blobs").alias("sha"))


@query("""WITH raw AS (SELECT event_id, user_id, event_type, 'node_' || (user_id % 4) AS node, event_id % 97 AS k FROM events)
  SELECT event_id, CASE WHEN k = 3 THEN 'event_id' WHEN k = 5 THEN 'node_id' WHEN k = 7 THEN 'session_id' WHEN k = 11 THEN 'local_id' WHEN k = 13 THEN 'seq' WHEN k = 17 THEN 'type'
    WHEN k = 19 THEN 'event_time_ns' WHEN k IN (23, 29) THEN 'blobs' END AS error FROM raw""")
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, some of them broken in one way each."""
    blob = "named_struct('sha256', sha2(cast(event_id as string), 256), 'size', 10L, 'mime', 'image/png')"
    rows = A.table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 97).selectExpr(
        "event_id AS id",
        "CASE WHEN k = 3 THEN '' ELSE concat('e-', event_id) END AS event_id",
        "CASE WHEN k = 5 THEN concat('node', char(9)) ELSE concat('node_', user_id % 4) END AS node_id",
        "'cam_0' AS camera_id",
        "cast(CASE WHEN k = 7 THEN -1 ELSE 1 END AS decimal(20,0)) AS session_id",
        "CASE WHEN k = 11 THEN NULL ELSE user_id END AS local_id",
        "CASE WHEN k = 13 THEN 0L ELSE event_id + 1 END AS seq",
        "CASE WHEN k = 17 THEN 'stop' ELSE 'update' END AS type",
        "CASE WHEN k = 19 THEN -5L ELSE event_id END AS event_time_ns",
        f"CASE WHEN k = 23 THEN array({blob}, {blob}) WHEN k = 29 THEN array(named_struct('sha256', 'xyz', 'size', 10L, 'mime', 'a')) WHEN k = 31 THEN array({blob}) ELSE slice(array({blob}), 1, 0) END AS blobs",
    )
    return rows.withColumn("error", ingest.event_error()).select(F.col("id").alias("event_id"), "error")


def _one_by_one(stored: str) -> str:
    """Batches of d (batch_id, node_id, seq, eid, digest) taken one after another: `done` has the list `ok` of those accepted, `stored` being there before."""
    return f"""claims AS (SELECT DISTINCT batch_id, node_id, 'seq' AS kind, seq::VARCHAR AS key, eid || '/' || digest AS value FROM d UNION SELECT DISTINCT batch_id, node_id, 'id', eid::VARCHAR, seq::VARCHAR FROM d),
  held AS (SELECT node_id, 'seq' AS kind, seq::VARCHAR AS key, eid || '/' || digest AS value FROM {stored} UNION SELECT node_id, 'id', eid::VARCHAR, seq::VARCHAR FROM {stored}),
  faulty AS (SELECT batch_id FROM claims GROUP BY batch_id, node_id, kind, key HAVING count(*) > 1 UNION SELECT c.batch_id FROM claims c JOIN held h USING (node_id, kind, key) WHERE c.value <> h.value),
  rivals AS (SELECT b.batch_id, list(DISTINCT a.batch_id) AS earlier FROM claims b JOIN claims a USING (node_id, kind, key) WHERE a.batch_id < b.batch_id AND a.value <> b.value GROUP BY b.batch_id),
  queue AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS k, batch_id IN (SELECT batch_id FROM faulty) AS bad, coalesce(earlier, []) AS earlier FROM (SELECT DISTINCT batch_id FROM d) LEFT JOIN rivals USING (batch_id)),
  walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ok UNION ALL SELECT q.k, CASE WHEN q.bad OR list_has_any(w.ok, q.earlier) THEN w.ok ELSE list_append(w.ok, q.batch_id) END FROM walk w JOIN queue q ON q.k = w.k + 1),
  done AS (SELECT ok FROM walk ORDER BY k DESC LIMIT 1)"""


@query(f"""WITH RECURSIVE all_d AS (SELECT event_id, event_id // 100 AS batch_id, 'node_' || (event_id // 100 % 4) AS node_id, event_id % 9000 AS seq,
    CASE WHEN event_id >= 9000 THEN event_id - 9000 ELSE event_id END AS eid, CASE WHEN event_id % 1013 = 1000 THEN 'x' ELSE 'same' END AS digest FROM events),
  s AS (SELECT * FROM all_d WHERE event_id < 9000 AND event_id % 2 = 0), d AS (SELECT * FROM all_d WHERE event_id >= 9000 OR event_id % 2 = 0), {_one_by_one("s")}
  SELECT d.batch_id, d.node_id, d.seq, CASE WHEN NOT list_contains(ok, d.batch_id) THEN 'conflict' WHEN s.eid IS NOT NULL THEN 'replay' ELSE 'new' END AS status FROM d CROSS JOIN done LEFT JOIN s ON s.node_id = d.node_id AND s.seq = d.seq""")
def replay_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of events, part of them stored before and some changed."""
    rows = A.table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "floor(event_id / 100) AS batch_id", "concat('node_', floor(event_id / 100) % 4) AS node_id", "event_id % 9000 AS seq",
        "CASE WHEN event_id >= 9000 THEN event_id - 9000 ELSE event_id END AS event_id", "CASE WHEN event_id % 1013 = 1000 THEN 'x' ELSE 'same' END AS digest",
    )
    stored = rows.where("id < 9000 AND id % 2 = 0")
    return ingest.classify(rows.where("id >= 9000 OR id % 2 = 0"), stored).select("batch_id", "node_id", "seq", "status")


@query("""WITH f AS (SELECT event_id, 'blob-' || (event_id // 3) AS c, event_id % 7 = 3 AS wrong FROM events) SELECT DISTINCT sha256(c) AS sha, octet_length(encode(c))::BIGINT AS size, 'image/png' AS mime FROM f WHERE NOT wrong""")
def stored_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs put under the hash of their contents, repeats and wrong hashes among them."""
    files = A.table(spark, sf_dir, "events").selectExpr("concat('blob-', floor(event_id / 3)) AS c", "event_id % 7 = 3 AS wrong")
    files = files.selectExpr("CASE WHEN wrong THEN sha2('other', 256) ELSE sha2(c, 256) END AS sha", "'image/png' AS mime", "encode(c, 'UTF-8') AS contents")
    return ingest.valid_blobs(files).select("sha", "size", "mime")


@query(f"{A.duckdb('track_events', 'received_events')} SELECT event_id, seq FROM received_events WHERE node_id = 'node_1' AND seq > 20 ORDER BY seq LIMIT 100")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.page(A.received_events(spark, sf_dir).where("node_id = 'node_1'"), 20, 100).select("event_id", "seq")


BATCHED = A.duckdb("track_events", "batched", "observed")


@query(f"""{BATCHED}, told AS (SELECT batch_id, seq, CASE batch_id % 23 WHEN 1 THEN 'version' WHEN 2 THEN 'event' WHEN 3 THEN 'json' WHEN 5 THEN 'json' WHEN 6 THEN 'nodes' WHEN 7 THEN 'count' END AS error FROM batched)
  SELECT DISTINCT batch_id, error, CASE WHEN error IS NULL THEN seq END AS seq FROM told""")
def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON batches of events: the events of sound ones, the fault of others."""
    return ingest.decode_batches(A.event_batches(spark, sf_dir)).select("batch_id", "error", F.col("event.seq").alias("seq"))


def _observed(spark, sf_dir):
    return ingest.observed(ingest.decode_batches(A.event_batches(spark, sf_dir)))


@query(f"""{BATCHED} SELECT 'e' || event_id AS event_id, node_id, seq, class_id, round(x, 6) AS x, CASE WHEN sound THEN cx END AS cov_x, vx AS velocity_x, quality, frame, map_revision FROM observed""")
def observed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a JSON payload says of place, covariance, velocity and quality, with wrongly typed and unsound values left out."""
    return _observed(spark, sf_dir).select("event_id", "node_id", "seq", "class_id", F.round(F.col("position")[0], 6).alias("x"), F.col("covariance")[0].alias("cov_x"), F.col("velocity")[0].alias("velocity_x"), "quality", "frame", "map_revision")


# --- tracklets ---------------------------------------------------------------------------------------

COMMITTED = f"{INBOX}, committed AS (SELECT e.* FROM received_events e JOIN cursors c ON c.node_id = e.node_id AND e.seq <= c.contiguous)"


def _segments(of: str) -> str:
    return f"""marked AS (SELECT *, lag(type) OVER w IS NULL OR type = 'start' OR lag(type) OVER w = 'end' AS opens FROM {of}
    WINDOW w AS (PARTITION BY node_id, camera_id, session_id, local_id ORDER BY event_time_ns, seq)),
  runs AS (SELECT *, sum(opens::INT) OVER (PARTITION BY node_id, camera_id, session_id, local_id ORDER BY event_time_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM marked),
  segments AS (SELECT *, '["' || node_id || '","' || camera_id || '",' || session_id || ',' || local_id || ',' ||
    first_value(seq) OVER (PARTITION BY node_id, camera_id, session_id, local_id, run ORDER BY event_time_ns, seq) || ']' AS uid FROM runs)"""


TRACKLETS = """tracks AS (SELECT uid, any_value(node_id) AS node_id, min(event_time_ns) AS start_ns, max(event_time_ns) AS end_ns, count(*)::BIGINT AS n_events,
    arg_max(type, (event_time_ns, seq)) = 'end' AS closed, arg_max(class_id, (event_time_ns, seq)) FILTER (WHERE class_id >= 0) AS class_id,
    arg_max({'t': event_time_ns, 'seq': seq, 'x': x, 'y': y, 'z': z, 'cx': cx, 'cy': cy, 'cz': cz, 'q': quality}, (event_time_ns, seq)) FILTER (WHERE x IS NOT NULL) AS l FROM segments GROUP BY uid),
  latest AS (SELECT * REPLACE (CASE WHEN end_ns - l.t <= 250000000 THEN l END AS l) FROM tracks)"""
ALL = A.duckdb("track_events") + ", " + _segments("track_events") + ", " + TRACKLETS


def all_tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracklets.tracklets(tracklets.segmented(A.track_events(spark, sf_dir)))


@query(f"{COMMITTED} SELECT node_id, seq, event_id FROM committed")
def committed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, known = _inbox(spark, sf_dir)
    return tracklets.committed(events, ingest.cursors_of(known)).select("node_id", "seq", "event_id")


@query(f"{COMMITTED}, {_segments('committed')} SELECT uid, min(event_time_ns) AS start_ns, max(event_time_ns) AS end_ns, count(*)::BIGINT AS n_events, arg_max(type, (event_time_ns, seq)) = 'end' AS closed FROM segments GROUP BY uid")
def committed_tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, known = _inbox(spark, sf_dir)
    found = tracklets.tracklets(tracklets.segmented(tracklets.committed(events, ingest.cursors_of(known))))
    return found.select("uid", "start_ns", "end_ns", "n_events", "closed")


@query(f"{ALL} SELECT uid, start_ns, end_ns, n_events, closed, class_id, l.t AS latest_ns, l.seq AS latest_seq, round(l.x, 6) AS latest_x FROM latest")
def tracklet_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_tracklets(spark, sf_dir)
    return found.select("uid", "start_ns", "end_ns", "n_events", "closed", "class_id", F.col("latest.event_time_ns").alias("latest_ns"), F.col("latest.seq").alias("latest_seq"), F.round(F.col("latest.position")[0], 6).alias("latest_x"))


@query(f"{ALL} SELECT uid, json_extract_string(uid, '$[0]') AS node_id, json_extract_string(uid, '$[4]') AS first_seq FROM latest")
def uid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklet uids read back: the sensor and the first number."""
    u = F.col("uid")
    return all_tracklets(spark, sf_dir).select("uid", tracklets.uid_part(u, 0).alias("node_id"), tracklets.uid_part(u, 4).alias("first_seq"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 201 - 100 >= 0 THEN 2 * (p_partkey % 201 - 100) ELSE -2 * (p_partkey % 201 - 100) - 1 END AS zigzag, round_even((p_partkey % 9) / 8.0::DOUBLE * 32767, 0)::INT AS quantised FROM part""")
def tile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as terrain tiles write them: zigzag steps, and places along a side rounded half to even."""
    rows = A.table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_partkey % 201 - 100 AS int) AS z", "cast(p_partkey % 9 AS double) AS x")
    return rows.select("p_partkey", geodesy.zigzag(F.col("z")).cast("long").alias("zigzag"), geodesy.quantised(F.col("x"), F.lit(0.0), F.lit(8.0)).alias("quantised"))


@query(f"{A.duckdb('track_events')}, {_segments('track_events')} SELECT uid, count(*)::BIGINT AS n, min(seq) AS least, string_agg(seq::VARCHAR, ',' ORDER BY event_time_ns, seq) AS seqs FROM segments GROUP BY uid")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracklets.observations(tracklets.segmented(A.track_events(spark, sf_dir)))
    seqs = F.transform("observations", lambda o: o["seq"])
    return found.select("uid", F.size("observations").cast("long").alias("n"), F.array_min(seqs).alias("least"), F.array_join(seqs.cast("array<string>"), ",").alias("seqs"))


@query(f"{ALL} SELECT class_id, arg_min(uid, (-l.q, l.cx + l.cy + l.cz, -l.t, uid)) AS representative FROM latest WHERE l IS NOT NULL AND class_id IS NOT NULL GROUP BY class_id")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracklets.representatives(all_tracklets(spark, sf_dir).where("class_id IS NOT NULL"), "class_id")


# --- association -------------------------------------------------------------------------------------

PAIRS = """ready AS (SELECT * FROM latest WHERE l IS NOT NULL AND class_id IS NOT NULL),
  met AS (SELECT a.uid AS left_uid, b.uid AS right_uid, abs(b.l.t - a.l.t) / 1e9 AS elapsed_s, abs(b.l.t - a.l.t) / 1e9 + 0.01::DOUBLE AS dt,
    a.l.x - b.l.x AS dx, a.l.y - b.l.y AS dy, a.l.z - b.l.z AS dz, a.l.cx + b.l.cx AS cx, a.l.cy + b.l.cy AS cy, a.l.cz + b.l.cz AS cz,
    greatest(a.l.cx, a.l.cy, a.l.cz, b.l.cx, b.l.cy, b.l.cz) AS top
    FROM ready a JOIN ready b ON a.class_id = b.class_id AND a.node_id <> b.node_id AND (a.start_ns, a.uid) < (b.start_ns, b.uid) AND abs(b.l.t - a.l.t) <= 250000000),
  scored AS (SELECT *, dx*dx / (cx + (15*dt)*(15*dt)) + dy*dy / (cy + (15*dt)*(15*dt)) + dz*dz / (cz + (15*dt)*(15*dt)) AS d2 FROM met),
  pairs AS (SELECT left_uid, right_uid, d2 + 0.25::DOUBLE * elapsed_s / 0.25::DOUBLE AS cost, d2, elapsed_s FROM scored WHERE d2 <= 11.344866730144373 AND sqrt(dx*dx + dy*dy + dz*dz) <= 30*dt + 3.5*sqrt(top))"""


def pairs_of(spark: SparkSession, found: DataFrame) -> DataFrame:
    return associate.candidate_pairs(found, A.sources(spark), A.labels(spark))


@query(f"{ALL}, {PAIRS} SELECT left_uid, right_uid, round(cost, 6) AS cost, round(d2, 6) AS d2, round(elapsed_s, 6) AS elapsed_s, 'position-only' AS evidence FROM pairs")
def pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs_of(spark, all_tracklets(spark, sf_dir))
    return found.select("left_uid", "right_uid", F.round("cost", 6).alias("cost"), F.round("d2", 6).alias("d2"), F.round("elapsed_s", 6).alias("elapsed_s"), "evidence")


#: Edges one after another: `taken` has those whose ends were free.
GREEDY = """ordered AS (SELECT *, row_number() OVER (ORDER BY cost, left_uid, right_uid) AS k FROM pairs),
  walk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS used, []::BIGINT[] AS took UNION ALL
    SELECT o.k, CASE WHEN list_has_any(used, [left_uid, right_uid]) THEN used ELSE list_concat(used, [left_uid, right_uid]) END, CASE WHEN list_has_any(used, [left_uid, right_uid]) THEN took ELSE list_append(took, o.k) END FROM walk w JOIN ordered o ON o.k = w.k + 1),
  taken AS (SELECT o.* FROM ordered o CROSS JOIN (SELECT took FROM walk ORDER BY k DESC LIMIT 1) WHERE list_contains(took, o.k)),
  mates AS (SELECT left_uid AS uid, least(left_uid, right_uid) AS g FROM taken UNION ALL SELECT right_uid, least(left_uid, right_uid) FROM taken),
  grouped AS (SELECT latest.*, coalesce(g, latest.uid) AS g FROM latest LEFT JOIN mates ON mates.uid = latest.uid)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_recursive(ALL)}, {PAIRS}, {GREEDY} SELECT left_uid, right_uid, round(cost, 6) AS cost FROM taken")
def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.greedy_pairs(pairs_of(spark, all_tracklets(spark, sf_dir))).withColumn("cost", F.round("cost", 6))


@query()
def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.exact_pairs(pairs_of(spark, all_tracklets(spark, sf_dir)))


#: Each node's component, as the least node that its edges reach.
REACHED = """links AS (SELECT left_uid AS a, right_uid AS b FROM pairs UNION SELECT right_uid, left_uid FROM pairs),
  parts AS (SELECT uid, min(other) AS component FROM (
    WITH RECURSIVE walk(uid, other) AS (SELECT a, a FROM links UNION SELECT w.uid, l.b FROM walk w JOIN links l ON l.a = w.other) SELECT * FROM walk) GROUP BY uid)"""


@query(f"""{_recursive(ALL)}, {PAIRS}, {REACHED},
  weighted AS (SELECT component, left_uid, right_uid, ((SELECT count(*) FROM parts) // 2 + 1) * 100001 - least(100000, trunc(1000 * cost))::BIGINT AS w, row_number() OVER (PARTITION BY component ORDER BY left_uid, right_uid) AS k FROM pairs JOIN parts ON uid = left_uid),
  tried AS (SELECT DISTINCT component, 0::BIGINT AS k, []::VARCHAR[] AS used, 0::BIGINT AS w FROM weighted UNION ALL
    SELECT component, k, used, max(w) FROM (SELECT t.component, e.k, CASE WHEN take THEN list_sort(list_concat(used, [left_uid, right_uid])) ELSE used END AS used, CASE WHEN take THEN t.w + e.w ELSE t.w END AS w
      FROM tried t JOIN weighted e ON e.component = t.component AND e.k = t.k + 1 CROSS JOIN (VALUES (FALSE), (TRUE)) c(take) WHERE NOT take OR NOT list_has_any(used, [left_uid, right_uid])) GROUP BY component, k, used)
  SELECT component, (arg_max(len(used), w) // 2)::BIGINT AS n_pairs, max(w)::BIGINT AS weight FROM tried GROUP BY component""")
def exact_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best matching of each component comes to: its pairs and its integer weight. The matching may not be the only one; this is."""
    edges = checkpoints.checkpoint(pairs_of(spark, all_tracklets(spark, sf_dir)))
    parts = graph.components(edges)
    most = parts.count() // 2
    weight = F.lit((most + 1) * 100_001) - F.least(F.lit(100_000), (1000 * F.col("cost")).cast("long"))
    return graph.exact_pairs(edges).join(parts, F.col("left_uid") == F.col("uid")).groupBy("component").agg(F.count("*").alias("n_pairs"), F.sum(weight).alias("weight"))


@query(f"""{ALL}, {PAIRS}, links AS (SELECT left_uid AS a, right_uid AS b FROM pairs UNION SELECT right_uid, left_uid FROM pairs),
  reach AS (SELECT a AS uid, a AS other FROM links)
  SELECT uid, min(other) AS component FROM (
    WITH RECURSIVE walk(uid, other) AS (SELECT uid, other FROM reach UNION SELECT w.uid, l.b FROM walk w JOIN links l ON l.a = w.other) SELECT * FROM walk) GROUP BY uid""")
def edge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(pairs_of(spark, all_tracklets(spark, sf_dir)))


#: Edges one after another: two groups become one if all their pairs are edges, no sensor comes twice and at most four are in it.
CLIQUES = """ordered AS (SELECT *, row_number() OVER (ORDER BY cost, left_uid, right_uid) AS k FROM pairs),
  known AS (SELECT list(left_uid || '|' || right_uid) || list(right_uid || '|' || left_uid) AS keys FROM pairs),
  merged AS (SELECT 0::BIGINT AS k, []::VARCHAR[][] AS groups UNION ALL
    SELECT k, CASE WHEN a <> b AND len(a) + len(b) <= 4 AND len(list_distinct(list_transform(a || b, lambda x: json_extract_string(x, '$[0]')))) = len(a) + len(b)
        AND list_has_all(keys, flatten(list_transform(a, lambda x: list_transform(b, lambda y: x || '|' || y)))) THEN list_append(list_filter(groups, lambda g: g <> a AND g <> b), list_sort(a || b)) ELSE groups END
    FROM (SELECT o.k, m.groups, keys, coalesce(list_filter(m.groups, lambda g: list_contains(g, o.left_uid))[1], [o.left_uid]) AS a, coalesce(list_filter(m.groups, lambda g: list_contains(g, o.right_uid))[1], [o.right_uid]) AS b
      FROM merged m JOIN ordered o ON o.k = m.k + 1 CROSS JOIN known)),
  cliques AS (SELECT unnest(g) AS uid, g[1] AS group_id FROM (SELECT unnest(groups) AS g FROM (SELECT groups FROM merged ORDER BY k DESC LIMIT 1)))"""


@query(f"{_recursive(ALL)}, {PAIRS}, {CLIQUES} SELECT l.uid, coalesce(group_id, l.uid) AS group_id FROM latest l LEFT JOIN cliques c ON c.uid = l.uid")
def clique_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_tracklets(spark, sf_dir)
    return graph.clique_groups(pairs_of(spark, found), found)


MOVING = BATCHED + ", " + _segments("observed") + ", " + TRACKLETS.replace("'q': quality}", "'q': quality, 'vx': vx}").replace("WHERE x IS NOT NULL", "WHERE sound")


@query(f"""{MOVING} SELECT uid, start_ns, end_ns, n_events, closed, class_id, l.t AS latest_ns, round(l.x, 6) AS latest_x, l.vx AS latest_vx FROM latest""")
def ingested_tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From JSON batches to tracklets: where the newest covariance is unsound, the latest observation is an older one."""
    found = tracklets.tracklets(tracklets.segmented(_observed(spark, sf_dir)))
    return found.select("uid", "start_ns", "end_ns", "n_events", "closed", "class_id", F.col("latest.event_time_ns").alias("latest_ns"), F.round(F.col("latest.position")[0], 6).alias("latest_x"), F.col("latest.velocity")[0].alias("latest_vx"))


#: The earlier of two observations is moved on by its velocity, (1.5, -0.5, 0) where it has one.
MOVED_PAIRS = (
    PAIRS.replace("a.l.x - b.l.x AS dx", "a.l.x + coalesce(a.l.vx, 0) * greatest(b.l.t - a.l.t, 0) / 1e9 - b.l.x - coalesce(b.l.vx, 0) * greatest(a.l.t - b.l.t, 0) / 1e9 AS dx")
    .replace("a.l.y - b.l.y AS dy", "a.l.y - coalesce(a.l.vx, 0) / 3 * greatest(b.l.t - a.l.t, 0) / 1e9 - b.l.y + coalesce(b.l.vx, 0) / 3 * greatest(a.l.t - b.l.t, 0) / 1e9 AS dy")
)


@query(f"{MOVING}, {MOVED_PAIRS} SELECT left_uid, right_uid, round(cost, 6) AS cost, round(d2, 6) AS d2, round(elapsed_s, 6) AS elapsed_s FROM pairs")
def moving_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of ingested tracklets, the earlier observation moved on by its velocity."""
    found = pairs_of(spark, tracklets.tracklets(tracklets.segmented(_observed(spark, sf_dir))))
    return found.select("left_uid", "right_uid", F.round("cost", 6).alias("cost"), F.round("d2", 6).alias("d2"), F.round("elapsed_s", 6).alias("elapsed_s"))


# --- identity ----------------------------------------------------------------------------------------


def grouped(spark: SparkSession, sf_dir: str, part: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Groups (uid, group_id) and tracklets of the first part of the events."""
    events = A.track_events(spark, sf_dir)
    if part < 1:
        cut = int(A.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] * part)
        events = events.where(F.col("event_id") < cut)
    found = tracklets.tracklets(tracklets.segmented(events))
    return graph.SOLVERS["greedy"](pairs_of(spark, found), found), found


def snapshot(spark: SparkSession, sf_dir: str, part: float = 1.0, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (uid, group_id, global_id) and tracklets of the first part of the events."""
    groups, found = grouped(spark, sf_dir, part)
    none = spark.createDataFrame([], "uid string, global_id string")
    return identity.assign_ids(groups, none if old is None else old), found


@query(f"""{_recursive(ALL)}, {PAIRS}, {GREEDY} SELECT 'g-' || left(sha256(g), 20) AS global_id, CASE WHEN count(*) >= 3 THEN 'associated_group' WHEN count(*) = 2 THEN 'associated_pair' WHEN count(l) > 0 THEN 'provisional' ELSE 'unlocalized' END AS status,
  min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(DISTINCT node_id)::BIGINT AS source_count, count(*)::BIGINT AS member_count, arg_min(uid, (-l.q, l.cx + l.cy + l.cz, -l.t, uid)) FILTER (WHERE l IS NOT NULL) AS representative,
  CASE WHEN count(DISTINCT class_id) = 1 THEN max(class_id)::VARCHAR ELSE '' END AS class_name FROM grouped GROUP BY g""")
def global_track_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, found = snapshot(spark, sf_dir)
    rows = identity.global_tracks(members.select("uid", "global_id"), found, A.labels(spark))
    return rows.select("global_id", "status", "start_ns", "end_ns", "source_count", "member_count", "representative", "class_name")


def _members_of(events: str) -> str:
    """(uid, g) of the groups of one set of events."""
    return f"(WITH RECURSIVE {_segments(events)}, {TRACKLETS}, {PAIRS}, {GREEDY} SELECT uid, g FROM grouped)"


#: Two snapshots: groups of the second take, in their order, the best id of the first that is still free.
STICKY = f"""{_recursive(A.duckdb('track_events'))}, early AS (SELECT * FROM track_events WHERE event_id < (SELECT max(event_id) // 2 FROM events)),
  before AS (SELECT uid, 'g-' || left(sha256(g), 20) AS gid FROM {_members_of('early')}), now AS (SELECT * FROM {_members_of('track_events')}),
  shared AS (SELECT g, gid, count(*) AS n FROM now JOIN before USING (uid) GROUP BY ALL),
  wishes AS (SELECT g, list(gid ORDER BY n DESC, gid) AS wanted, max(n) AS most FROM shared GROUP BY g),
  sizes AS (SELECT g, count(*) AS size, list(uid ORDER BY uid) AS uids FROM now GROUP BY g),
  queue AS (SELECT w.*, row_number() OVER (ORDER BY most DESC, size DESC, uids) AS k FROM wishes w JOIN sizes USING (g)),
  choose AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS g, NULL::VARCHAR AS gid, []::VARCHAR[] AS used UNION ALL
    SELECT q.k, q.g, list_filter(q.wanted, lambda x: NOT list_contains(c.used, x))[1], list_append(c.used, list_filter(q.wanted, lambda x: NOT list_contains(c.used, x))[1]) FROM choose c JOIN queue q ON q.k = c.k + 1),
  fresh AS (SELECT s.g, arg_min(id, salt) AS gid FROM (SELECT g, salt, 'g-' || left(sha256(uids[1] || CASE WHEN salt = 0 THEN '' ELSE '#' || salt END), 20) AS id FROM sizes, range(8) r(salt)) s WHERE id NOT IN (SELECT gid FROM before) GROUP BY s.g),
  after AS (SELECT n.uid, coalesce(c.gid, f.gid) AS gid FROM now n LEFT JOIN choose c ON c.g = n.g LEFT JOIN fresh f ON f.g = n.g)"""
FIRST = "SELECT row_number() OVER (ORDER BY uid)::BIGINT AS revision, uid, NULL::VARCHAR AS old_global_id, gid AS new_global_id, 'new' AS reason, 1 AS world_revision FROM before"
SECOND = """SELECT row_number() OVER (ORDER BY coalesce(b.uid, a.uid))::BIGINT AS revision, coalesce(b.uid, a.uid) AS uid, b.gid AS old_global_id, a.gid AS new_global_id,
  CASE WHEN b.gid IS NULL THEN 'new' WHEN a.gid IS NULL THEN 'retired' ELSE 'identity_revised' END AS reason FROM before b FULL JOIN after a ON a.uid = b.uid WHERE b.gid IS DISTINCT FROM a.gid"""


@query(f"{STICKY} {SECOND}")
def identity_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = snapshot(spark, sf_dir, 0.5)
    new, _ = snapshot(spark, sf_dir, 1.0, old.select("uid", "global_id"))
    return identity.revisions(old, new)


@query(f"{ALL} SELECT uid, 'g-' || left(sha256(uid), 20) AS global_id FROM latest")
def new_global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.new_ids(all_tracklets(spark, sf_dir))


@query(f"""{A.duckdb('track_events')}, h AS (SELECT * FROM track_events WHERE event_id < (SELECT max(event_id) // 2 FROM events)), {_segments('h')},
  old AS (SELECT DISTINCT uid FROM segments), {_segments('track_events').replace('marked', 'marked2').replace('runs', 'runs2').replace('segments', 'segments2')}, new AS (SELECT DISTINCT uid FROM segments2)
  SELECT row_number() OVER (ORDER BY coalesce(old.uid, new.uid))::BIGINT AS revision, coalesce(old.uid, new.uid) AS uid, old.uid IS NOT NULL AS retired FROM old FULL JOIN new ON old.uid = new.uid WHERE old.uid IS NULL OR new.uid IS NULL""")
def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklets that come or go between two snapshots, as numbered revisions."""
    events = A.track_events(spark, sf_dir)
    cut = int(A.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 2)
    ids = lambda e: tracklets.segmented(e).select("uid").distinct().withColumn("global_id", F.col("uid"))
    rows = identity.revisions(ids(events.where(F.col("event_id") < cut)), ids(events))
    return rows.select("revision", "uid", F.col("old_global_id").isNotNull().alias("retired"))


# --- estimates ---------------------------------------------------------------------------------------


@query(f"""{A.duckdb('bearings')}, met AS (SELECT a.vec_id, a.ox AS p1, a.oy AS p2, a.oz AS p3, b.ox AS q1, b.oy AS q2, b.oz AS q3, a.cx AS a1, a.cy AS a2, a.cz AS a3, b.cx AS b1, b.cy AS b2, b.cz AS b3
    FROM bearings a JOIN bearings b ON b.vec_id = a.vec_id + 1),
  m AS (SELECT *, b1/a1 - 1 AS m1, b2/a2 - 1 AS m2, b3/a3 - 1 AS m3 FROM met),
  e AS (SELECT *, m1+m2+m3 AS e1, m1*m2+m1*m3+m2*m3 AS e2, m1*m2*m3 AS e3 FROM m),
  r AS (SELECT *, sqrt(greatest(4*e2*e2 - 12*e3*e1, 0)) AS root, CASE WHEN e2 >= 0 THEN 1 ELSE -1 END AS sign FROM e),
  s AS (SELECT *, -(2*e2 + sign*root)/2 AS s0 FROM r),
  w AS (SELECT *, CASE WHEN e1 <= 1e-12 THEN 0.0::DOUBLE WHEN e1 + 2*e2 + 3*e3 >= 0 THEN 1.0::DOUBLE WHEN e3 <> 0 AND s0/(3*e3) > 0 AND s0/(3*e3) < 1 THEN s0/(3*e3) ELSE e1/s0 END AS w FROM s),
  c AS (SELECT *, 1/(w/a1 + (1-w)/b1) AS c1, 1/(w/a2 + (1-w)/b2) AS c2, 1/(w/a3 + (1-w)/b3) AS c3 FROM w)
  SELECT vec_id, round(c1, 5) AS cov_x, round(c2, 5) AS cov_y, round(c3, 5) AS cov_z, round(c1*(w*p1/a1 + (1-w)*q1/b1), 5) AS mean_x, round(c2*(w*p2/a2 + (1-w)*q2/b2), 5) AS mean_y FROM c""")
def ci_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bearings(spark, sf_dir)
    nxt = b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("position").alias("q"), F.col("covariance").alias("cov_q"))
    rows = b.select("vec_id", F.col("position").alias("p"), F.col("covariance").alias("cov_p")).join(nxt, "vec_id")
    c, m = F.col("covariance"), F.col("mean")
    show = lambda x, name: F.round(x, 5).alias(name)
    return fusion.intersect_pairs(rows).select("vec_id", show(c[0], "cov_x"), show(c[4], "cov_y"), show(c[8], "cov_z"), show(m[0], "mean_x"), show(m[1], "mean_y"))


@query(f"""{A.duckdb('bearings')}, met AS (SELECT a.vec_id, a.dx AS ux, a.dy AS uy, a.dz AS uz, b.dx AS vx, b.dy AS vy, b.dz AS vz, a.ox - b.ox AS wx, a.oy - b.oy AS wy, a.oz - b.oz AS wz
    FROM bearings a JOIN bearings b ON b.vec_id = a.vec_id + 1),
  k AS (SELECT *, greatest(-1.0, least(1.0, ux*vx+uy*vy+uz*vz)) AS c, ux*wx+uy*wy+uz*wz AS du, vx*wx+vy*wy+vz*wz AS dv FROM met),
  p AS (SELECT *, (c*dv - du)/(1 - c*c) AS s, (dv - c*du)/(1 - c*c) AS t, degrees(acos(least(1.0, abs(c)))) AS angle FROM k),
  g AS (SELECT *, sqrt((wx+s*ux-t*vx)**2 + (wy+s*uy-t*vy)**2 + (wz+s*uz-t*vz)**2) AS gap FROM p),
  n AS (SELECT *, gap / greatest(1e-3, sqrt(0.25 + (0.01*s)**2 + (0.01*t)**2)) AS norm FROM g)
  SELECT vec_id, round(angle, 6) AS angle_deg, round(gap, 6) AS separation_m, s > 0 AND t > 0 AS forward,
    CASE WHEN angle < 3 THEN 'weak-parallax-not-used' WHEN s > 0 AND t > 0 AND norm <= 4 THEN 'ray-consistent' ELSE 'ray-geometry-contradiction' END AS evidence FROM n""")
def ray_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bearings(spark, sf_dir)
    rows = b.select("vec_id", F.col("ray").alias("a")).join(b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("ray").alias("b")), "vec_id")
    return V.compared_rays(rows, "a", "b", F.lit(0.5), 3.0, 4.0, "r").select("vec_id", F.round("r.angle_deg", 6).alias("angle_deg"), F.round("r.separation_m", 6).alias("separation_m"), "r.forward", F.col("r.label").alias("evidence"))


def _window_rows(spark, sf_dir):
    return A.track_events(spark, sf_dir).withColumn("group_id", F.concat("class_id", F.lit(":"), "local_id")).withColumns({"t": F.col("event_time_ns"), "uid": F.concat("node_id", F.lit("/"), "local_id")})


@query(f"{A.duckdb('track_events')}, g AS (SELECT *, class_id || ':' || local_id AS group_id, max(event_time_ns) OVER (PARTITION BY class_id, local_id) AS newest FROM track_events) SELECT group_id, event_id FROM g WHERE event_time_ns >= newest - 1500000000")
def fixed_lag_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_ls.fixed_lag(_window_rows(spark, sf_dir), "group_id", "t", 1.5).select("group_id", "event_id")


@query(f"{A.duckdb('track_events')} SELECT class_id || ':' || local_id AS group_id, node_id, arg_max(event_id, (event_time_ns, node_id || '/' || local_id, seq)) AS event_id FROM track_events GROUP BY ALL")
def latest_ray_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _window_rows(spark, sf_dir).select("group_id", "node_id", "t", "uid", "seq", "event_id")
    return window_ls.latest_per_node(rows, "group_id").select("group_id", "node_id", "event_id")


@query(f"{A.duckdb('track_events')} SELECT class_id || ':' || local_id AS group_id, arg_min(event_id, (cx + cy + cz, -event_time_ns, node_id || '/' || local_id)) AS event_id FROM track_events WHERE x IS NOT NULL GROUP BY ALL")
def position_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _window_rows(spark, sf_dir).where("covariance IS NOT NULL").select("group_id", "t", "uid", "covariance", "event_id")
    return window_ls.anchors(rows, "group_id").select("group_id", "event_id")


#: One covariance intersection of (m, c), a mean and diagonal covariance, with a member's (p, v), by stages.
INTERSECT = [
    [(f"r{k}", f"v{k} / c{k} - 1") for k in "xyz"],
    [("e1", "rx + ry + rz"), ("e2", "rx * ry + rx * rz + ry * rz"), ("e3", "rx * ry * rz")],
    [("s0", "-(2 * e2 + CASE WHEN e2 >= 0 THEN 1 ELSE -1 END * sqrt(greatest(4 * e2 * e2 - 12 * e3 * e1, 0))) / 2")],
    [("w", "CASE WHEN e1 <= 1e-12 THEN 0.0::DOUBLE WHEN e1 + 2 * e2 + 3 * e3 >= 0 THEN 1.0::DOUBLE WHEN e3 <> 0 AND s0 / (3 * e3) > 0 AND s0 / (3 * e3) < 1 THEN s0 / (3 * e3) ELSE e1 / s0 END")],
    [(f"d{k}", f"1 / (w / c{k} + (1 - w) / v{k})") for k in "xyz"],
]


def _intersected(source: str) -> str:
    for stage in INTERSECT:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage)} FROM {source})"
    return source


CI_GROUPS = f"""{_recursive(A.duckdb('track_events'))}, {_segments('track_events')}, {TRACKLETS.replace("'q': quality}", "'q': quality, 'eid': event_id}")}, {PAIRS}, {CLIQUES},
  members AS (SELECT coalesce(c.group_id, l.uid) AS g, l.uid, l.l FROM latest l LEFT JOIN cliques c ON c.uid = l.uid),
  timed AS (SELECT g, count(*) AS n, list_sort(list(l.t)) AS ts FROM members GROUP BY g),
  epochs AS (SELECT g, n, (ts[(n - 1) // 2 + 1] + ts[n // 2 + 1]) // 2 AS epoch FROM timed WHERE n >= 2),
  sized AS (SELECT m.g, e.epoch, row_number() OVER (PARTITION BY m.g ORDER BY uid) AS i, e.n, l.x AS px, l.y AS py, l.z AS pz, l.cx AS kx, l.cy AS ky, l.cz AS kz, l.eid AS eid, abs(e.epoch - l.t) / 1e9 AS dt FROM members m JOIN epochs e USING (g)),
  inputs AS (SELECT *, kx + (30 * (dt + 0.005)) ** 2 AS vx, ky + (30 * (dt + 0.005)) ** 2 AS vy, kz + (30 * (dt + 0.005)) ** 2 AS vz FROM sized),
  fused AS (SELECT g, i, px AS mx, py AS my, pz AS mz, vx AS cx, vy AS cy, vz AS cz FROM inputs WHERE i = 1 UNION ALL
    SELECT g, i, dx * (w * mx / cx + (1 - w) * px / vx), dy * (w * my / cy + (1 - w) * py / vy), dz * (w * mz / cz + (1 - w) * pz / vz), dx, dy, dz
    FROM {_intersected("(SELECT f.g, q.i, f.mx, f.my, f.mz, f.cx, f.cy, f.cz, q.px, q.py, q.pz, q.vx, q.vy, q.vz FROM fused f JOIN inputs q ON q.g = f.g AND q.i = f.i + 1)")}),
  results AS (SELECT f.* FROM fused f JOIN epochs e ON e.g = f.g AND e.n = f.i),
  looked AS (SELECT q.*, r.mx, r.my, r.mz, r.cx, r.cy, r.cz, (r.mx - px) ** 2 / vx + (r.my - py) ** 2 / vy + (r.mz - pz) ** 2 / vz AS d2, CASE WHEN eid % 3 = 0 AND eid % 4 <> 1 THEN (r.mx - px + 20) * CASE WHEN eid % 2 = 0 THEN -1 ELSE 1 END END AS reach FROM inputs q JOIN results r USING (g)),
  judged AS (SELECT *, CASE WHEN reach > 0.05 THEN sqrt((my - py) ** 2 + (mz - pz) ** 2) / sqrt(greatest(cx, cy, cz) + (reach * 0.01) ** 2 + (30 * (dt + 0.005)) ** 2) END AS miss FROM looked),
  told AS (SELECT g, any_value(epoch) AS epoch, any_value(mx) AS mx, any_value(my) AS my, any_value(cx) AS cx, max(dt) AS late, max(d2) AS worst, count(miss) AS bearings, coalesce(bool_or(reach <= 0.05 OR miss > 4), FALSE) AS against FROM judged GROUP BY g),
  said AS (SELECT DISTINCT m.g, t.* EXCLUDE (g), CASE WHEN t.g IS NULL THEN 'not_enough_verified_position_sources' WHEN late > 0.25 THEN 'time_extrapolation_limit' WHEN worst > 25 THEN 'position_residual_exceeds_gate' WHEN against THEN 'bearing_geometry_contradiction' ELSE 'ci_position_only' END AS reason FROM members m LEFT JOIN told t ON t.g = m.g)
  SELECT g AS group_id, reason = 'ci_position_only' AS accepted, reason, epoch AS epoch_ns, CASE WHEN reason = 'ci_position_only' THEN round(mx, 5) END AS x, CASE WHEN reason = 'ci_position_only' THEN round(my, 5) END AS y,
    CASE WHEN reason = 'ci_position_only' THEN round(cx, 5) END AS cov_x, CASE WHEN reason IN ('ci_position_only', 'bearing_geometry_contradiction') THEN bearings END AS bearing_count FROM said"""


@query(CI_GROUPS)
def ci_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of cliques whose sensors look along their bearings, some of which contradict."""
    found = tracklets.tracklets(tracklets.segmented(A.bearing_events(spark, sf_dir)))
    members = graph.clique_groups(pairs_of(spark, found), found)
    fused = fusion.fuse_groups(fusion.group_inputs(members, found, A.sources(spark), A.labels(spark)))
    mean, cov = F.col("mean"), F.col("covariance")
    return fused.select("group_id", "accepted", "reason", "epoch_ns", F.round(mean[0], 5).alias("x"), F.round(mean[1], 5).alias("y"), F.round(cov[0], 5).alias("cov_x"), F.col("bearing_count").cast("long").alias("bearing_count"))


@query(f"""{A.duckdb('bearings')}, seen AS (SELECT vec_id, i, ox + 20*dx AS x, oy + 20*dy AS y, oz + 20*dz AS z, 20*dx - 7.0::DOUBLE*i AS gx, 20*dy + 5.0::DOUBLE*i*i AS gy, 20*dz - 3.0::DOUBLE*i AS gz FROM bearings, range(3) r(i)),
  u AS (SELECT vec_id, i, x, y, z, gx/n AS ux, gy/n AS uy, gz/n AS uz FROM (SELECT *, sqrt(gx*gx + gy*gy + gz*gz) AS n FROM seen) WHERE n > 0.01),
  met AS (SELECT a.vec_id, degrees(acos(least(1.0, abs(a.ux*b.ux + a.uy*b.uy + a.uz*b.uz)))) AS angle FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i < b.i),
  g AS (SELECT vec_id, max(angle) AS widest FROM met GROUP BY vec_id)
  SELECT vec_id::VARCHAR AS group_id, widest >= 4 AS accepted, CASE WHEN widest >= 4 THEN 'conditional_fixed_lag_solution_requires_validation' ELSE 'insufficient_cross_node_parallax' END AS reason,
    CASE WHEN widest >= 4 THEN round(x, 3) + 0.0::DOUBLE END AS x, CASE WHEN widest >= 4 THEN round(y, 3) + 0.0::DOUBLE END AS y, CASE WHEN widest >= 4 THEN round(z, 3) + 0.0::DOUBLE END AS z FROM g JOIN seen USING (vec_id) WHERE i = 0""")
def window_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three sensors that watch the point in front of a vector's ray."""
    return _shown(window_ls.window_estimates(_watchers(spark, sf_dir).drop("vec_id", "i", "o", "u"), STATIC))


STATIC = window_ls.WindowPolicy(model="static_position", independent_source_errors_verified=True, bearing_world_pose_frame_verified=True, stationary_target_verified=True)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("group_id", "accepted", "reason", *[(F.round(F.col("position")[i], 3) + 0.0).alias(c) for i, c in enumerate("xyz")])


def _looking(rows: DataFrame) -> DataFrame:
    """Adds to rows with an origin o and a unit vector u the bearing from one along the other, taken at `ns`."""
    rows = rows.withColumn("h", F.expr("CASE WHEN abs(u[2]) < 0.9D THEN array(u[1], -u[0], 0.0D) ELSE array(0.0D, u[2], -u[1]) END")).withColumn("e1", V.scale(F.col("h"), 1 / V.norm(F.col("h")))).withColumn("e2", V.cross(F.col("u"), F.col("e1")))
    bearing = "named_struct('valid', true, 'camera_position_world_m', o, 'direction_world', u, 'tangent_basis_world', concat(e1, e2), 'has_tangent_covariance', true, 'tangent_covariance_rad2', array(1e-4D, 0.0D, 0.0D, 1e-4D), 'timestamp_ns', ns)"
    return rows.selectExpr(
        "vec_id", "i", "o", "u", "cast(vec_id as string) AS group_id", "concat('t', i) AS uid", "concat('node_', i) AS node_id", "1L AS seq", "ns AS event_time_ns", "cast(NULL AS array<double>) AS position", "cast(NULL AS array<double>) AS covariance", "0.9D AS quality",
        f"'{A.FRAME}' AS frame", f"'{A.MAP}' AS map_revision", f"{bearing} AS bearing", "'0' AS label", "'shared_utc' AS domain", "'align-1' AS alignment_id", f"'{A.FRAME}' AS s_frame", f"'{A.MAP}' AS s_map", "0L AS offset_ns", "5000000L AS clock_uncertainty_ns",
    )


def _watchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bearings(spark, sf_dir)
    x = "transform(sequence(0, 2), k -> position[k] + 20.0D * ray.direction[k])"
    rows = b.withColumn("x", F.expr(x)).withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    rows = rows.withColumn("o", F.expr("array(position[0] + 7.0D * i, position[1] - 5.0D * i * i, position[2] + 3.0D * i)")).withColumn("d", F.expr("transform(sequence(0, 2), k -> x[k] - o[k])"))
    rows = rows.withColumn("n", V.norm(F.col("d"))).where("n > 0.01").withColumn("u", F.expr("transform(d, v -> v / n)")).withColumn("ns", F.lit(1_000_000_000).cast("long"))
    return _looking(rows)


#: What is wrong with the groups of a remainder k of their number, as columns of their members, and the reason that they get. An anchor stands behind the first ray, or where it begins.
WINDOW_FAULTS = {
    2: ("domain", "CASE WHEN i = 1 THEN NULL ELSE domain END", "unverified_source"),
    3: ("label", "CASE WHEN i = 2 THEN '' ELSE label END", "unverified_class_clock_or_map"),
    4: ("s_map", "CASE WHEN i = 1 THEN 'other' ELSE s_map END", "unverified_class_clock_or_map"),
    5: ("node_id", "CASE WHEN i = 1 THEN 'node_0' ELSE node_id END", "duplicate_physical_node"),
    6: ("clock_uncertainty_ns", "CASE WHEN i = 2 THEN 40000000L ELSE clock_uncertainty_ns END", "clock_uncertainty_exceeds_limit"),
    7: ("bearing", "CASE WHEN i < 0 THEN bearing END", "no_valid_observations"),
    8: ("bearing", "CASE WHEN i = 0 THEN bearing END", "insufficient_cross_node_bearing_factors"),
    9: ("offset_ns", "CASE WHEN i = 0 THEN 0L ELSE -2000000000L END", "insufficient_cross_node_bearing_factors"),
    10: ("event_time_ns", "event_time_ns + 300000000L", "no_valid_observations"),
    11: ("position", "CASE WHEN i = 2 THEN transform(sequence(0, 2), j -> o0[j] - 10.0D * u0[j]) END", "anchor_behind_bearing_ray"),
    12: ("position", "CASE WHEN i = 2 THEN o0 END", "anchor_at_ray_origin"),
    13: ("offset_ns", "-5000000000L", "invalid_common_time_epoch"),
}
_reasons = " ".join(f"WHEN {k} THEN '{reason}'" for k, (*_, reason) in WINDOW_FAULTS.items() if k < 13)
ACCEPTED = "conditional_fixed_lag_solution_requires_validation"


@query(ORACLES["window_estimates"].split("  SELECT vec_id::VARCHAR AS group_id")[0] + f""", seen0 AS (SELECT DISTINCT vec_id FROM u WHERE i = 0), counted AS (SELECT vec_id, count(*) AS n FROM u GROUP BY vec_id)
  SELECT vec_id::VARCHAR AS group_id, reason, count(*) OVER (PARTITION BY reason) AS as_many FROM (SELECT vec_id, CASE vec_id % 15 WHEN 1 THEN 'requires_preassociated_multi_node_group' {_reasons} WHEN 13 THEN CASE WHEN widest >= 4 THEN 'invalid_common_time_epoch' ELSE 'insufficient_cross_node_parallax' END
    ELSE CASE WHEN widest >= 4 THEN '{ACCEPTED}' ELSE 'insufficient_cross_node_parallax' END END AS reason FROM g JOIN counted USING (vec_id) WHERE n = 3)""")
def window_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups, most of them broken in one way each: why they are refused, and how many for the same reason."""
    rows = _watchers(spark, sf_dir).withColumn("k", F.col("vec_id") % 15)
    first = rows.where("i = 0").select("vec_id", F.col("o").alias("o0"), F.col("u").alias("u0"))
    whole = rows.groupBy("vec_id").count().where("count = 3").select("vec_id")
    rows = rows.join(first, "vec_id").join(whole, "vec_id").where("k <> 1 OR i = 0")
    for k, (column, value, _) in WINDOW_FAULTS.items():
        rows = rows.withColumn(column, F.expr(f"CASE WHEN k = {k} THEN {value} ELSE {column} END"))
    anchor = "k IN (11, 12) AND i = 2"
    rows = rows.withColumns({"covariance": F.expr(f"CASE WHEN {anchor} THEN array(1.0D, 0.0D, 0.0D, 0.0D, 1.0D, 0.0D, 0.0D, 0.0D, 1.0D) END"), "bearing": F.expr(f"CASE WHEN {anchor} THEN NULL ELSE bearing END")})
    found = window_ls.window_estimates(rows.drop("vec_id", "i", "k", "o", "u", "o0", "u0"), STATIC)
    return found.join(found.groupBy("reason").agg(F.count("*").alias("as_many")), "reason").select("group_id", "reason", "as_many")


@query(f"""{A.duckdb('bearings')}, v AS (SELECT vec_id, dx * 4 AS vx, dy * 4 AS vy, dz * 4 AS vz FROM bearings)
  SELECT vec_id::VARCHAR AS group_id, TRUE AS accepted, round(ox + 0.6::DOUBLE * vx, 3) + 0.0::DOUBLE AS x, round(oy + 0.6::DOUBLE * vy, 3) + 0.0::DOUBLE AS y, round(oz + 0.6::DOUBLE * vz, 3) + 0.0::DOUBLE AS z,
    round(vx, 3) + 0.0::DOUBLE AS vx, round(vy, 3) + 0.0::DOUBLE AS vy, round(vz, 3) + 0.0::DOUBLE AS vz, CASE WHEN vec_id % 2 = 0 THEN 't4' END AS anchor_uid, 4 AS n_bearings, 0.6::DOUBLE AS span_s FROM bearings JOIN v USING (vec_id)""")
def moving_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that move along a vector's ray, seen by four sensors one after another, and every second one located by a fifth."""
    sides = "array(array(1.0D, 0.0D, 0.0D), array(0.0D, 1.0D, 0.0D), array(0.0D, 0.0D, 1.0D), array(0.6D, 0.0D, 0.8D))"
    rows = A.bearings(spark, sf_dir).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("s < 4 OR vec_id % 2 = 0")
    rows = rows.withColumn("x", F.expr("transform(sequence(0, 2), k -> position[k] + 4.0D * ray.direction[k] * 0.2D * least(s, 3))"))
    rows = rows.withColumn("u", F.expr(f"{sides}[least(s, 3)]")).withColumn("o", F.expr("transform(sequence(0, 2), k -> x[k] - 20.0D * u[k])"))
    placed = _looking(rows.select("vec_id", F.col("s").alias("i"), "x", "o", "u", (F.lit(1_000_000_000) + F.least("s", F.lit(3)) * 200_000_000).cast("long").alias("ns")))
    spot = F.expr("transform(sequence(0, 2), k -> o[k] + 20.0D * u[k])")
    eye = F.array(*[F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)])
    placed = placed.withColumns({"position": F.when(F.col("i") == 4, spot), "covariance": F.when(F.col("i") == 4, eye), "bearing": F.when(F.col("i") < 4, F.col("bearing"))}).drop("vec_id", "i", "o", "u")
    policy = window_ls.WindowPolicy(independent_source_errors_verified=True, bearing_world_pose_frame_verified=True)
    found = window_ls.window_estimates(placed, policy)
    at = lambda c, names: [(F.round(F.col(c)[i], 3) + 0.0).alias(n) for i, n in enumerate(names)]
    return found.select("group_id", "accepted", *at("position", "xyz"), *at("velocity", ("vx", "vy", "vz")), "anchor_uid", "n_bearings", F.round("span_s", 6).alias("span_s"))


# --- map ---------------------------------------------------------------------------------------------

def _near(radius: float) -> str:
    return f"(SELECT t.*, p.* FROM points p JOIN area t ON greatest(least(ax, bx, cx) - px, 0, px - greatest(ax, bx, cx)) <= {radius} AND greatest(least(ay, b_y, cy) - py, 0, py - greatest(ay, b_y, cy)) <= {radius})"


def _duck(stages: list[tuple[str, str]], source: str) -> str:
    """`by` is a keyword there."""
    return triangles.staged_sql(source, [(n, re.sub(r"\bby\b", "b_y", e)) for n, e in stages])


TRI = A.duckdb("triangles", "points") + f", area AS (SELECT * FROM {_duck(triangles.NORMAL, 'triangles')} WHERE nl > 1e-10)"


@query(f"""{TRI}, hits AS (SELECT query_id, entity_id, triangle_id, semantic, distance FROM {_duck(triangles.CLOSEST, _near(20.0))} WHERE distance <= 20.0),
  best AS (SELECT query_id, entity_id, min((distance, triangle_id)) AS m, arg_min(semantic, (distance, triangle_id)) AS semantic FROM hits GROUP BY ALL)
  SELECT query_id, row_number() OVER w AS rank, entity_id, semantic, round(m[1], 6) AS distance FROM (SELECT query_id, entity_id, semantic, [m[1], m[2]] AS m FROM best) WINDOW w AS (PARTITION BY query_id ORDER BY m[1], entity_id) QUALIFY row_number() OVER w <= 4""")
def surface_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = meshmap.surface(A.triangles(spark, sf_dir), A.points(spark, sf_dir), 20.0, 4)
    return found.select("query_id", "rank", "entity_id", "semantic", F.round("distance", 6).alias("distance"))


RAYS = "(SELECT t.*, query_id, px AS ox, py AS oy, 50.0::DOUBLE AS oz, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, -1.0::DOUBLE AS dz FROM points p JOIN area t ON px BETWEEN least(ax, bx, cx) - 1 AND greatest(ax, bx, cx) + 1 AND py BETWEEN least(ay, b_y, cy) - 1 AND greatest(ay, b_y, cy) + 1)"


@query(f"""{TRI}, hits AS (SELECT query_id, entity_id, triangle_id, u FROM {_duck(triangles.RAY, RAYS)} WHERE u > 1e-6 AND u <= 500)
  SELECT query_id, arg_min(entity_id, (u, entity_id, triangle_id)) AS entity_id, arg_min(triangle_id, (u, entity_id, triangle_id)) AS triangle_id, round(min(u), 6) AS distance FROM hits GROUP BY query_id""")
def raycast_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = meshmap.raycast(A.triangles(spark, sf_dir), A.rays_down(spark, sf_dir), 500.0)
    return found.select("query_id", "entity_id", "triangle_id", F.round("distance", 6).alias("distance"))


LINES = "(SELECT t.*, query_id, px AS ox, py AS oy, 30.0::DOUBLE AS oz, 8/sqrt(64.0+16+729) AS dx, 4/sqrt(64.0+16+729) AS dy, -27/sqrt(64.0+16+729) AS dz, sqrt(64.0+16+729) - 0.05 - 1e-6 AS reach FROM points p JOIN area t ON greatest(ax, bx, cx) >= px - 1 AND least(ax, bx, cx) <= px + 9 AND greatest(ay, b_y, cy) >= py - 1 AND least(ay, b_y, cy) <= py + 5)"


@query(f"""{TRI}, hits AS (SELECT query_id, u FROM {_duck(triangles.RAY, LINES)} WHERE u > 1e-6 AND u <= reach)
  SELECT p.query_id, CASE WHEN min(u) IS NULL THEN 'unknown' ELSE 'occluded' END AS status, round(min(u), 6) AS distance FROM points p LEFT JOIN hits USING (query_id) GROUP BY p.query_id""")
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.points(spark, sf_dir).selectExpr("query_id", "array(point[0], point[1], 30.0D) AS origin", "array(point[0] + 8.0D, point[1] + 4.0D, 3.0D) AS target")
    return meshmap.visibility(A.triangles(spark, sf_dir), lines).select("query_id", "status", F.round("distance", 6).alias("distance"))


@query(f"""{TRI}, hits AS (SELECT query_id, u FROM {_duck(triangles.RAY, LINES)} WHERE u > 1e-6 AND u <= reach),
  told AS (SELECT p.query_id, CASE WHEN min(u) IS NULL THEN 'unknown' ELSE 'occluded' END AS status FROM points p LEFT JOIN hits USING (query_id) GROUP BY p.query_id)
  SELECT query_id, status, 'map-1' AS map_revision, 'local_ENU' AS coordinate_frame, 7.5::DOUBLE AS query_time, CASE WHEN status = 'unknown' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM told""")
def answer_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibility answers as they are sent: with the map's revision, frame and confidence, 0 where nothing is known."""
    lines = A.points(spark, sf_dir).selectExpr("query_id", "array(point[0], point[1], 30.0D) AS origin", "array(point[0] + 8.0D, point[1] + 4.0D, 3.0D) AS target")
    manifest = spark.createDataFrame([(A.MAP, "local_ENU", 0.5)], "map_revision string, coordinate_frame string, confidence double")
    told = meshmap.envelope(meshmap.visibility(A.triangles(spark, sf_dir), lines), manifest, 7.5)
    return told.select("query_id", "status", "map_revision", "coordinate_frame", "query_time", "confidence")


@query(f"""{A.duckdb('triangles')} SELECT min(least(ax, bx, cx)) AS min_x, max(greatest(ax, bx, cx)) AS max_x, min(least(ay, b_y, cy)) AS min_y, max(greatest(ay, b_y, cy)) AS max_y, min(least(az, bz, cz)) AS min_z,
  max(greatest(az, bz, cz)) AS max_z, count(DISTINCT entity_id) AS entities, count(*) FILTER (WHERE nl > 1e-10) AS triangles, count(*) FILTER (WHERE NOT nl > 1e-10) AS degenerate FROM {_duck(triangles.NORMAL, 'triangles')}""")
def mesh_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshmap.bounds(A.triangles(spark, sf_dir))


@query(f"""{A.duckdb('triangles')}, numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY triangle_id) - 1 AS k FROM triangles)
  SELECT entity_id AS source_name, CASE entity_id WHEN 'ent_1' THEN 'terrain' WHEN 'ent_3' THEN 'road' ELSE 'unknown' END AS semantic, k AS triangle_id, round(2 * ax + 1, 3) + 0.0::DOUBLE AS ax, round(-(2 * az + 3), 3) + 0.0::DOUBLE AS ay, round(2 * ay + 2, 3) + 0.0::DOUBLE AS az,
    round(2 * bx + 1, 3) + 0.0::DOUBLE AS bx, round(2 * cy + 2, 3) + 0.0::DOUBLE AS cz FROM numbered""")
def imported_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary scene files, one for each entity, read back as triangles in the map's axes with labels by name."""
    rows = scenes.labelled(scenes.glb_triangles(A.scene_files(spark, sf_dir)), {"ent_1": "terrain", "ent_3": "road"})
    at = lambda c, i, name: (F.round(F.col(c)[i], 3) + 0.0).alias(name)
    return rows.select("source_name", "semantic", "triangle_id", at("a", 0, "ax"), at("a", 1, "ay"), at("a", 2, "az"), at("b", 0, "bx"), at("c", 2, "cz"))


@query("""WITH p AS (SELECT p_partkey, radians((p_partkey*37) % 360 - 180.0::DOUBLE) AS lo, radians((p_partkey*53) % 180 - 90.0::DOUBLE) AS la, p_size::DOUBLE AS h FROM part),
  n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - (1 - 6356752.314245179::DOUBLE**2 / 6378137.0::DOUBLE**2) * sin(la)**2) AS n, 6356752.314245179::DOUBLE**2 / 6378137.0::DOUBLE**2 AS r FROM p)
  SELECT p_partkey, round((n + h)*cos(la)*cos(lo), 3) + 0.0::DOUBLE AS x, round((n + h)*cos(la)*sin(lo), 3) + 0.0::DOUBLE AS y, round((n*r + h)*sin(la), 3) + 0.0::DOUBLE AS z, round(-sin(la)*cos(lo), 6) + 0.0::DOUBLE AS north_x FROM n""")
def enu_to_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part").selectExpr("p_partkey", "(p_partkey*37) % 360 - 180.0D AS lon", "(p_partkey*53) % 180 - 90.0D AS lat", "cast(p_size as double) AS h")
    m = p.select("p_partkey", geodesy.enu_to_ecef(F.col("lon"), F.col("lat"), F.col("h")).alias("m"))
    return m.select("p_partkey", *[F.round(F.col("m")[i], 3).alias(n) for i, n in ((12, "x"), (13, "y"), (14, "z"))], F.round(F.col("m")[4], 6).alias("north_x"))


@query("""WITH b AS (SELECT p_partkey, (p_partkey*37) % 350 - 180.0::DOUBLE AS w, (p_partkey*53) % 170 - 90.0::DOUBLE AS s, 2 + p_partkey % 5 AS level FROM part),
  t AS (SELECT p_partkey, level, floor((w + 180)/360*(2 << level))::INT AS x0, floor((w + 7 + 180)/360*(2 << level))::INT AS x1, floor((s + 90)/180*(1 << level))::INT AS y0, floor((s + 5 + 90)/180*(1 << level))::INT AS y1 FROM b)
  SELECT p_partkey, level::INT AS level, x::INT AS x, y::INT AS y FROM t, range(least(x0, (2 << level) - 1), least(x1, (2 << level) - 1) + 1) rx(x), range(least(y0, (1 << level) - 1), least(y1, (1 << level) - 1) + 1) ry(y)""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.table(spark, sf_dir, "part").selectExpr("p_partkey", "(p_partkey*37) % 350 - 180.0D AS w", "(p_partkey*53) % 170 - 90.0D AS s", "cast(2 + p_partkey % 5 AS int) AS level")
    tiles = geodesy.tile_cover(F.col("w"), F.col("s"), F.col("w") + 7, F.col("s") + 5, F.col("level"))
    return b.select("p_partkey", "level", F.explode(tiles).alias("t")).select("p_partkey", "level", "t.x", "t.y")


@query("""SELECT p_partkey AS query_id, CASE WHEN p_partkey % 13 = 3 THEN 'revision_conflict' WHEN p_partkey % 17 = 4 THEN 'coordinate_frame' WHEN p_partkey % 3 = 0 AND p_partkey % 7 = 2 THEN 'point' WHEN p_partkey % 3 = 0 AND p_partkey % 11 = 5 THEN 'radius_m'
    WHEN p_partkey % 3 = 0 AND p_partkey % 19 = 6 THEN 'max_candidates' WHEN p_partkey % 3 = 1 AND p_partkey % 11 = 5 THEN 'max_distance_m' WHEN p_partkey % 3 = 1 AND p_partkey % 7 = 2 THEN 'direction' WHEN p_partkey % 3 = 2 AND p_partkey % 7 = 2 THEN 'target' END AS error FROM part""")
def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query rows of three operations, some of them wrong in one way each."""
    k = "p_partkey"
    rows = A.table(spark, sf_dir, "part").selectExpr(
        f"{k} AS query_id", f"element_at(array('surface', 'raycast', 'visibility'), cast({k} % 3 AS int) + 1) AS op", f"CASE WHEN {k} % 13 = 3 THEN 'old' ELSE 'now' END AS map_revision", f"CASE WHEN {k} % 17 = 4 THEN 'ecef' ELSE 'local_ENU' END AS coordinate_frame",
        f"CASE WHEN {k} % 7 = 2 THEN array(1.0D, double('NaN'), 2.0D) ELSE array(1.0D, 2.0D, 3.0D) END AS point", f"CASE WHEN {k} % 11 = 5 THEN 1000.5D END AS radius_m", f"CASE WHEN {k} % 19 = 6 THEN 33 ELSE 4 END AS max_candidates", "cast(NULL AS double) AS min_normal_up",
        "array(0.0D, 0.0D, 9.0D) AS origin", f"CASE WHEN {k} % 7 = 2 THEN array(0.0D, 0.0D, 0.0D) ELSE array(0.0D, 0.0D, -1.0D) END AS direction", f"CASE WHEN {k} % 11 = 5 THEN 0.0D END AS max_distance_m",
        f"CASE WHEN {k} % 7 = 2 THEN array(0.0D, 0.0D, 90000.0D) ELSE array(0.0D, 0.0D, 1.0D) END AS target", "cast(NULL AS double) AS target_margin_m",
    )
    return meshmap.query_errors(rows, "now").select("query_id", "error")


@query("SELECT p_partkey AS query_id, (['occupancy', 'esdf', 'reachability', 'road_topology'])[(p_partkey % 5 + 1)::INT] AS op, 'unknown' AS status, 0.0::DOUBLE AS confidence, 'source_data_unavailable' AS reason FROM part WHERE p_partkey % 5 < 4")
def unsupported_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = A.table(spark, sf_dir, "part").selectExpr("p_partkey AS query_id", "element_at(array('occupancy', 'esdf', 'reachability', 'road_topology', 'surface'), cast(p_partkey % 5 AS int) + 1) AS op")
    return meshmap.unsupported(ops)



# --- streams -----------------------------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, read to its end. A stream takes a single file by a pattern alone."""
    rows = A.table(spark, sf_dir, "events")
    return spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parque[t]")


@query("""WITH e AS (SELECT 'node_' || (event_id % 4) AS node_id, event_id // 4 + 1 AS seq FROM events WHERE event_id % 997 <> 500)
  SELECT node_id, coalesce(max(seq) FILTER (WHERE seq = rn), 0)::BIGINT AS contiguous FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq) AS rn FROM (SELECT DISTINCT * FROM e)) GROUP BY node_id""")
def stream_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir).where("event_id % 997 <> 500").selectExpr("concat('node_', event_id % 4) AS node_id", "cast(floor(event_id / 4) + 1 AS long) AS seq")
    at = checkpoints.new_folder(spark, "watermarks")
    inbox.follow_watermarks(events, f"{at}/bitmaps", f"{at}/checkpoint").awaitTermination()
    return inbox.watermarks(spark, f"{at}/bitmaps")


@query(f"""WITH RECURSIVE d AS (SELECT event_id // 100 AS batch_id, 'node_' || (event_id // 100 % 4) AS node_id, event_id % 9000 AS seq, 'e' || event_id AS eid, CASE WHEN event_id % 1013 = 1000 THEN 'x' ELSE 'same' END AS digest FROM events),
  {_one_by_one("(SELECT * FROM d LIMIT 0)")} SELECT DISTINCT node_id, seq, eid AS event_id FROM d CROSS JOIN done WHERE list_contains(ok, batch_id)""")
def stream_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a stream of deliveries stores; batches with a conflict are left out."""
    rows = _event_stream(spark, sf_dir).selectExpr(
        "cast(floor(event_id / 100) AS long) AS batch_id", "concat('node_', floor(event_id / 100) % 4) AS node_id", "event_id % 9000 AS seq", "concat('e', event_id) AS event_id", "CASE WHEN event_id % 1013 = 1000 THEN 'x' ELSE 'same' END AS digest",
    )
    at = checkpoints.new_folder(spark, "inbox")
    inbox.keep_deliveries(rows, f"{at}/events", f"{at}/checkpoint").awaitTermination()
    return inbox.epochs(spark, f"{at}/events", rows.schema).select("node_id", "seq", "event_id")


@query(f"{STICKY}, first AS ({FIRST}), second AS ({SECOND}) SELECT * FROM first UNION ALL SELECT revision + (SELECT count(*) FROM first), uid, old_global_id, new_global_id, reason, 2 FROM second")
def world_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of two published snapshots: of the first half of the events, then of all."""
    at = checkpoints.new_folder(spark, "world")
    for part in (0.5, 1.0):
        groups, found = grouped(spark, sf_dir, part)
        world.publish(groups, found, A.labels(spark), at)
    return world.revisions_after(spark, at, 0).withColumn("world_revision", F.col("world_revision").cast("int"))
