"""Sticky global identities, the append-only revision log, and global track rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpoint, numbered


def minted(uid: str, salt: int = 0) -> str:
    return "g-" + hashlib.sha256(f"{uid}#{salt}".encode() if salt else uid.encode()).hexdigest()[:20]


def new_ids(uids: DataFrame) -> DataFrame:
    """(uid, global_id) as minted without salt."""
    return uids.select("uid", F.concat(F.lit("g-"), F.substring(F.sha2("uid", 256), 1, 20)).alias("global_id"))


#: Salts that are tried at a time for ids that are taken.
SALTS = 4


def _free_ids(groups: DataFrame, taken: DataFrame) -> DataFrame:
    """(group_id, global_id) minted from `first` with the least salt whose id isn't among `taken` (global_id)."""
    left, start, done = groups.select("group_id", "first"), 0, None
    while True:
        salted = lambda k: F.concat(F.lit("g-"), F.substring(F.sha2(F.when(k == 0, F.col("first")).otherwise(F.concat("first", F.lit("#"), k.cast("string"))), 256), 1, 20))
        tries = left.withColumn("salt", F.explode(F.sequence(F.lit(start), F.lit(start + SALTS - 1)))).withColumn("global_id", salted(F.col("salt")))
        free = tries.join(taken, "global_id", "left_anti").groupBy("group_id").agg(F.min_by("global_id", "salt").alias("global_id"))
        found = checkpoint(left.join(free, "group_id", "left"))
        done = found.where("global_id IS NOT NULL").select("group_id", "global_id") if done is None else done.union(found.where("global_id IS NOT NULL").select("group_id", "global_id"))
        left, start = found.where("global_id IS NULL").select("group_id", "first"), start + SALTS
        if left.isEmpty():
            return done


def assign_ids(groups: DataFrame, old: DataFrame) -> DataFrame:
    """(uid, group_id, global_id): groups keep the old id that most of their members had, if it is free.

    groups: uid, group_id. old: uid, global_id of the previous snapshot. Groups with the largest overlap
    come first, then larger ones, then by member uids; ties between old ids go to the smaller. A group
    without a free old id gets one minted from its first uid, salted while the previous snapshot has it.

    In each round every open group asks for the first of the old ids on its list that is still free. An id goes to the first of those that ask
    for it if no group that comes before, and is open, has it on its list at all; so what a round decides is what going through the groups one
    after another decides, and all of it is in parallel. Up to LOCAL_CLAIMS claims are one task's work.
    """
    groups = checkpoint(groups.select("uid", "group_id"))
    taken = checkpoint(old.select("global_id").distinct())
    if taken.isEmpty():
        ids = _free_ids(groups.groupBy("group_id").agg(F.min("uid").alias("first")), taken)
        return groups.join(ids, "group_id").select("uid", "group_id", "global_id")
    counts = groups.join(old.select("uid", "global_id"), "uid").groupBy("group_id", "global_id").agg(F.count("*").alias("n"))
    ranked = groups.groupBy("group_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("uid")).alias("uids"))  # groups are small: at most 8
    most = counts.groupBy("group_id").agg(F.max("n").alias("most")).join(ranked, "group_id")
    claims = counts.join(most, "group_id").select("group_id", "global_id", "n", F.struct((-F.col("most")).alias("a"), (-F.col("size")).alias("b"), F.col("uids").alias("c"), "group_id").alias("turn"))
    left, kept = checkpoint(claims), None
    while left.limit(LOCAL_CLAIMS + 1).count() > LOCAL_CLAIMS:
        wish = left.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "global_id")).alias("w")).select("group_id", F.col("w.global_id").alias("global_id"))
        first = left.groupBy("global_id").agg(F.min("turn").alias("turn")).select("global_id", F.col("turn.group_id").alias("group_id"))
        wins = checkpoint(wish.join(first, ["group_id", "global_id"]))
        kept = wins if kept is None else kept.unionByName(wins)
        left = checkpoint(left.join(wins.select("group_id"), "group_id", "left_anti").join(wins.select("global_id"), "global_id", "left_anti").select("group_id", "global_id", "n", "turn"))
    flat = left.select("group_id", "global_id", "n", F.col("turn.a").alias("a"), F.col("turn.b").alias("b"), F.array_join("turn.c", "\x00").alias("c"))
    rest = checkpoint(flat.coalesce(1).mapInPandas(_claimed, "group_id string, global_id string"))
    kept = rest if kept is None else kept.unionByName(rest)
    without = groups.join(kept, "group_id", "left_anti").groupBy("group_id").agg(F.min("uid").alias("first"))
    return groups.join(kept.unionByName(_free_ids(without, taken)), "group_id").select("uid", "group_id", "global_id")


#: Claims of groups to old ids up to this number are settled by one task, more in rounds over all tasks; the results are the same.
LOCAL_CLAIMS = 100_000


def _claimed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups in their turn, each with the first old id on its list that none before it took."""
    rows = pd.concat([*batches, pd.DataFrame({c: [] for c in ("group_id", "global_id", "n", "a", "b", "c")})])
    plans: dict[str, tuple] = {}
    for r in rows.itertuples():
        plans.setdefault(r.group_id, ((r.a, r.b, r.c.split("\x00"), r.group_id), []))[1].append((-r.n, r.global_id))
    used: set[str] = set()
    out = []
    for (*_, group), wanted in sorted(plans.values()):
        if gid := next((g for _, g in sorted(wanted) if g not in used), None):
            used.add(gid)
            out.append((group, gid))
    yield pd.DataFrame(out, columns=["group_id", "global_id"], dtype="object")


def revisions(old: DataFrame, new: DataFrame, last: int = 0) -> DataFrame:
    """(revision, uid, old_global_id, new_global_id, reason) of members that changed, numbered from last + 1 by uid.

    The reason is new, retired or identity_revised.
    """
    met = old.select("uid", F.col("global_id").alias("old_global_id")).join(new.select("uid", F.col("global_id").alias("new_global_id")), "uid", "full_outer")
    changed = met.where(~F.col("old_global_id").eqNullSafe(F.col("new_global_id")))
    reason = F.when(F.col("old_global_id").isNull(), "new").when(F.col("new_global_id").isNull(), "retired").otherwise("identity_revised")
    return numbered(changed, ["uid"], "revision", last + 1).select("revision", "uid", "old_global_id", "new_global_id", reason.alias("reason"))


def identity_revisions(tracks: DataFrame, before: DataFrame) -> DataFrame:
    """Adds identity_revision to tracks (global_id, members): kept where the id had the same members before, one more where others, 1 for a new id.

    before: global_id, members and identity_revision of the previous snapshot; members are sorted arrays.
    """
    was = before.select("global_id", F.col("members").alias("_members"), F.col("identity_revision").alias("_revision"))
    met = tracks.join(was, "global_id", "left")
    revision = F.when(F.col("_revision").isNull(), 1).when(F.col("members") == F.col("_members"), F.col("_revision")).otherwise(F.col("_revision") + 1)
    return met.withColumn("identity_revision", revision.cast("long")).drop("_members", "_revision")


def global_tracks(members: DataFrame, tracklets: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each global id: status, class_name, start_ns, end_ns, source_count, members, representative.

    members: uid, global_id. Three or more members are an associated_group, two an associated_pair, one is
    provisional with a located observation and unlocalized without. The class is named if its members agree.
    """
    c = F.col("latest.covariance")
    rank = F.struct(-F.col("latest.quality"), c[0] + c[4] + c[8], -F.col("latest.event_time_ns"), F.col("uid"))
    rows = members.join(tracklets, "uid").join(labels, ["node_id", "class_id"], "left")
    found = rows.groupBy("global_id").agg(
        F.min("start_ns").alias("start_ns"),
        F.max("end_ns").alias("end_ns"),
        F.count_distinct("node_id").alias("source_count"),
        F.count("*").alias("member_count"),
        F.sort_array(F.collect_set("uid")).alias("members"),  # groups are small: at most 8
        F.min_by("uid", F.when(F.col("latest").isNotNull(), rank)).alias("representative"),
        F.when(F.count_distinct("label") == 1, F.max("label")).otherwise("").alias("class_name"),
    )
    status = F.when(F.col("member_count") >= 3, "associated_group").when(F.col("member_count") == 2, "associated_pair").when(F.col("representative").isNotNull(), "provisional").otherwise("unlocalized")
    return found.withColumn("status", status)


def signature(rows: DataFrame) -> str:
    """An order-free digest of rows: equal tables give equal signatures, so an unchanged snapshot can be skipped."""
    h = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(F.xxhash64(F.lit(7), *rows.columns)), F.lit(0)).alias("x")).first()
    return hashlib.sha256(f"{got['n']}:{got['s']}:{got['x']}".encode()).hexdigest()
