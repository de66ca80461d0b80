"""Matching and grouping on candidate edges (left_uid, right_uid, cost)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .checkpoints import checkpoint


#: Edge tables up to this size are solved by one task, larger ones in rounds over all tasks; the results are the same.
LOCAL_EDGES = 100_000


def _at_most(edges: DataFrame, most: int) -> bool:
    return edges.limit(most + 1).count() <= most


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of all edges of a task: trees that point to lesser names."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for x, y in zip(b["left_uid"], b["right_uid"], strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    yield pd.DataFrame({"uid": list(root), "component": [find(x) for x in root]}, dtype="object")


def components(edges: DataFrame) -> DataFrame:
    """(uid, component): each node with the least uid that its edges reach.

    A table of up to LOCAL_EDGES edges is one task's work. Larger ones go by hooking and pointer jumping, in rounds; how many labels moved
    is counted while a round is written.
    """
    edges = checkpoint(edges.select("left_uid", "right_uid"))
    if _at_most(edges, LOCAL_EDGES):
        return checkpoint(edges.coalesce(1).mapInPandas(_labels, "uid string, component string"))
    both = checkpoint(edges.select(F.col("left_uid").alias("a"), F.col("right_uid").alias("b")).union(edges.select("right_uid", "left_uid")).distinct())
    now = both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    while True:
        seen = both.join(now.select(F.col("uid").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("uid")).agg(F.min("other").alias("other"))
        hooked = now.join(seen, "uid").select("uid", F.least("component", "other").alias("new"), "component")
        jumps = hooked.select(F.col("uid").alias("new"), F.col("new").alias("next"))
        after = hooked.join(jumps, "new").select("uid", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("moved"))
        told = Observation()
        now = checkpoint(after.observe(told, F.count_if("moved").alias("moved"))).select("uid", "component")
        if told.get["moved"] == 0:
            return now


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    used: set[str] = set()
    rows = pd.concat([*batches, pd.DataFrame({"left_uid": [], "right_uid": [], "cost": []})]).sort_values(["cost", "left_uid", "right_uid"])
    taken = []
    for left, right, cost in zip(rows["left_uid"], rows["right_uid"], rows["cost"], strict=True):
        if left not in used and right not in used:
            used |= {left, right}
            taken.append((left, right, cost))
    yield pd.DataFrame(taken, columns=["left_uid", "right_uid", "cost"])


def greedy_pairs(edges: DataFrame) -> DataFrame:
    """One-to-one pairs: what taking edges in order of (cost, left_uid, right_uid) selects.

    A table of up to LOCAL_EDGES edges is one task's work. For larger ones, in each round the edges that come first at both of their
    ends are taken and their ends leave; under
    a total order that is the sequential result. All edges of a round are handled in parallel.
    """
    rank = F.struct("cost", "left_uid", "right_uid")
    left, taken = checkpoint(edges.select("left_uid", "right_uid", "cost")), None
    while not _at_most(left, LOCAL_EDGES):
        ends = left.select(F.col("left_uid").alias("uid"), rank.alias("r")).union(left.select("right_uid", rank))
        best = ends.groupBy("uid").agg(F.min("r").alias("r"))
        wins = checkpoint(best.groupBy("r").agg(F.count("*").alias("n")).where("n = 2").select("r.left_uid", "r.right_uid", "r.cost"))
        taken = wins if taken is None else taken.union(wins)
        gone = wins.select(F.col("left_uid").alias("uid")).union(wins.select("right_uid"))
        left = left.join(gone.withColumnRenamed("uid", "left_uid"), "left_uid", "left_anti").join(gone.withColumnRenamed("uid", "right_uid"), "right_uid", "left_anti")
        left = checkpoint(left.select("left_uid", "right_uid", "cost"))
    rest = checkpoint(left.coalesce(1).mapInPandas(_greedy, "left_uid string, right_uid string, cost double"))
    return rest if taken is None else taken.union(rest)


def matching_weight(cost: float, pairs: int) -> int:
    """Integer weight of an edge: more pairs come before less cost."""
    return (pairs + 1) * 100_001 - min(100_000, int(1000 * cost))


def _best_matching(edges: list[tuple[int, int, int]], n: int) -> list[int]:
    """Indices of a matching of greatest weight: exact branch and bound over the first open node."""
    order = sorted(range(len(edges)), key=lambda i: -edges[i][2])
    at: list[list[int]] = [[] for _ in range(n)]
    for i in order:
        at[edges[i][0]].append(i)
        at[edges[i][1]].append(i)
    seen: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}

    def solve(open_: int) -> tuple[int, tuple[int, ...]]:
        if open_ in seen:
            return seen[open_]
        low = open_ & -open_
        node = low.bit_length() - 1
        best = solve(open_ ^ low)
        for i in at[node]:
            a, b, w = edges[i]
            pair = 1 << a | 1 << b
            if open_ & pair == pair:
                rest = solve(open_ ^ pair)
                if rest[0] + w > best[0]:
                    best = (rest[0] + w, (*rest[1], i))
        seen[open_] = best
        return best

    return list(solve((1 << n) - 1)[1])


class Blossoms:
    """A matching of greatest weight in any graph, by the primal-dual blossom method: polynomial in its size.

    Nodes are 0 .. n - 1, weights positive integers, edges between two nodes at most one; blossoms have numbers from n on.
    All duals stay integers, since the slack of an edge counts its weight twice.
    """

    def __init__(self, edges: list[tuple[int, int, int]], n: int):
        self.n = n
        #: For each node or blossom its neighbours, with the edge (own end, other end, weight) of least slack.
        self.near: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(n)]
        for a, b, w in edges:
            self.near[a][b], self.near[b][a] = (a, b, w), (b, a, w)
        self.dual = [max((w for *_, w in edges), default=0)] * n
        self.top = list(range(n))  # the outermost blossom; -1: not in use
        self.mate, self.slack, self.parent = [-1] * n, [-1] * n, [-1] * n
        self.side = [-1] * n  # 0 outer, 1 inner, -1 free
        self.ring: list[list[int]] = [[] for _ in range(n)]
        self.part: list[dict[int, int]] = [{i: i} for i in range(n)]  # which member of the ring holds a node
        self.queue: list[int] = []

    def left(self, e: tuple[int, int, int]) -> int:
        return self.dual[e[0]] + self.dual[e[1]] - 2 * e[2]

    def nodes(self, x: int) -> list[int]:
        return [x] if x < self.n else list(self.part[x])

    def set_top(self, x: int, b: int) -> None:
        todo = [x]
        while todo:
            y = todo.pop()
            self.top[y] = b
            todo += self.ring[y]

    def offer(self, u: int, x: int) -> None:
        if self.slack[x] < 0 or self.left(self.near[u][x]) < self.left(self.near[self.slack[x]][x]):
            self.slack[x] = u

    def set_slack(self, x: int) -> None:
        self.slack[x] = -1
        for u in self.near[x]:
            if u < self.n and self.top[u] != x and self.side[self.top[u]] == 0:
                self.offer(u, x)

    def entry(self, b: int, x: int) -> int:
        """The place of x in b's ring, which is turned round if need be so that the place is even."""
        ring = self.ring[b]
        at = ring.index(x)
        if at % 2:
            ring[1:] = ring[:0:-1]
            at = len(ring) - at
        return at

    def set_mate(self, u: int, v: int) -> None:
        todo = [(u, v)]
        while todo:
            u, v = todo.pop()
            a, b, _ = self.near[u][v]
            self.mate[u] = b
            if u >= self.n:
                x = self.part[u][a]
                at, ring = self.entry(u, x), self.ring[u]
                todo += [(ring[i], ring[i ^ 1]) for i in range(at)]
                todo.append((x, v))
                self.ring[u] = ring[at:] + ring[:at]

    def augment(self, u: int, v: int) -> None:
        while True:
            after = self.top[self.mate[u]] if self.mate[u] >= 0 else -1
            self.set_mate(u, v)
            if after < 0:
                return
            u, v = self.top[self.parent[after]], after
            self.set_mate(v, u)

    def common(self, u: int, v: int) -> int:
        seen = set()
        while u >= 0 or v >= 0:
            if u >= 0:
                if u in seen:
                    return u
                seen.add(u)
                u = self.top[self.mate[u]] if self.mate[u] >= 0 else -1
                if u >= 0:
                    u = self.top[self.parent[u]]
            u, v = v, u
        return -1

    def shrink(self, u: int, base: int, v: int) -> None:
        b = next((k for k in range(self.n, len(self.top)) if self.top[k] < 0), len(self.top))
        if b == len(self.top):
            for column, value in ((self.dual, 0), (self.top, -1), (self.mate, -1), (self.slack, -1), (self.parent, -1), (self.side, -1)):
                column.append(value)
            self.ring.append([])
            self.near.append({})
            self.part.append({})
        self.dual[b], self.side[b], self.mate[b] = 0, 0, self.mate[base]
        arms = []
        for x in (u, v):
            arm = []
            while x != base:
                y = self.top[self.mate[x]]
                arm += [x, y]
                self.queue += self.nodes(y)
                x = self.top[self.parent[y]]
            arms.append(arm)
        self.ring[b] = [base, *reversed(arms[0]), *arms[1]]
        self.set_top(b, b)
        for x in self.near[b]:
            self.near[x].pop(b, None)
        near: dict[int, tuple[int, int, int]] = {}
        self.part[b] = {}
        for y in self.ring[b]:
            for x, e in self.near[y].items():
                if x != b and (x not in near or self.left(e) < self.left(near[x])):
                    near[x] = e
            self.part[b].update(dict.fromkeys(self.nodes(y), y))
        self.near[b] = near
        for x, (a, c, w) in near.items():
            self.near[x][b] = (c, a, w)
        self.set_slack(b)

    def expand(self, b: int) -> None:
        for x in self.ring[b]:
            self.set_top(x, x)
        x = self.part[b][self.near[b][self.parent[b]][0]]
        at = self.entry(b, x)
        ring = self.ring[b]
        for i in range(0, at, 2):
            inner, outer = ring[i], ring[i + 1]
            self.parent[inner] = self.near[outer][inner][0]
            self.side[inner], self.side[outer], self.slack[inner] = 1, 0, -1
            self.set_slack(outer)
            self.queue += self.nodes(outer)
        self.side[x], self.parent[x] = 1, self.parent[b]
        for y in ring[at + 1 :]:
            self.side[y] = -1
            self.set_slack(y)
        self.top[b], self.ring[b] = -1, []

    def tight(self, e: tuple[int, int, int]) -> bool:
        """Takes in an edge without slack from an outer blossom; whether the matching grew."""
        u, v = self.top[e[0]], self.top[e[1]]
        if self.side[v] == -1:
            self.parent[v], self.side[v] = e[0], 1
            after = self.top[self.mate[v]]
            self.slack[v] = self.slack[after] = -1
            self.side[after] = 0
            self.queue += self.nodes(after)
        elif self.side[v] == 0:
            base = self.common(u, v)
            if base < 0:
                self.augment(u, v)
                self.augment(v, u)
                return True
            self.shrink(u, base, v)
        return False

    def outer_tops(self) -> list[int]:
        return [x for x in range(len(self.top)) if self.top[x] == x]

    def grow(self) -> bool:
        """One more pair, if it gains weight."""
        self.side, self.slack, self.queue = [-1] * len(self.top), [-1] * len(self.top), []
        for x in self.outer_tops():
            if self.mate[x] < 0:
                self.parent[x], self.side[x] = -1, 0
                self.queue += self.nodes(x)
        if not self.queue:
            return False
        while True:
            while self.queue:
                u = self.queue.pop()
                if self.side[self.top[u]] == 1:
                    continue
                for v, e in list(self.near[u].items()):
                    if v < self.n and self.top[u] != self.top[v]:
                        if self.left(e) == 0:
                            if self.tight(e):
                                return True
                        else:
                            self.offer(u, self.top[v])
            tops = self.outer_tops()
            # By how much the outer nodes' duals can fall before an edge gets tight, an inner blossom opens or a dual is gone.
            steps = [self.dual[u] for u in range(self.n) if self.side[self.top[u]] == 0]
            gone = min(steps)
            steps += [self.dual[b] // 2 for b in tops if b >= self.n and self.side[b] == 1]
            for x in tops:
                if self.slack[x] >= 0 and self.side[x] != 1:
                    left = self.left(self.near[self.slack[x]][x])
                    steps.append(left if self.side[x] == -1 else left // 2)
            d = min(steps)
            if d == gone:
                return False
            for u in range(self.n):
                side = self.side[self.top[u]]
                self.dual[u] += -d if side == 0 else d if side == 1 else 0
            for b in tops:
                if b >= self.n and self.side[b] >= 0:
                    self.dual[b] += 2 * d if self.side[b] == 0 else -2 * d
            for x in tops:
                if self.top[x] == x and self.slack[x] >= 0 and self.top[self.slack[x]] != x:
                    e = self.near[self.slack[x]][x]
                    if self.left(e) == 0 and self.tight(e):
                        return True
            for b in range(self.n, len(self.top)):
                if self.top[b] == b and self.side[b] == 1 and self.dual[b] == 0:
                    self.expand(b)

    def pairs(self) -> set[tuple[int, int]]:
        while self.grow():
            pass
        return {(u, v) for u, v in enumerate(self.mate[: self.n]) if u < v}


def exact_pairs(edges: DataFrame, most_nodes: int = 26) -> DataFrame:
    """Pairs with the most edges, and among those the least cost in thousandths, component by component.

    Components of up to `most_nodes` nodes are solved by a search over subsets, which grows with 2 ** nodes, larger
    ones by the blossom method. Both are exact. A component is one task.
    """
    edges = checkpoint(edges.select("left_uid", "right_uid", "cost"))
    label = components(edges)
    total = int(label.count() // 2)
    placed = edges.join(label.withColumnRenamed("uid", "left_uid"), "left_uid")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["left_uid"], *pdf["right_uid"]})
        pdf = pdf.sort_values(["cost", "left_uid", "right_uid"]).reset_index(drop=True)
        at = {x: i for i, x in enumerate(names)}
        weighted = [(at[r.left_uid], at[r.right_uid], matching_weight(r.cost, total)) for r in pdf.itertuples()]
        if len(names) <= most_nodes:
            chosen = _best_matching(weighted, len(names))
        else:
            best: dict[tuple[int, int], int] = {}
            for i, (a, b, w) in enumerate(weighted):
                k = (min(a, b), max(a, b))
                if a != b and (k not in best or w > weighted[best[k]][2]):
                    best[k] = i
            made = Blossoms([(*k, weighted[i][2]) for k, i in best.items()], len(names))
            chosen = [best[k] for k in made.pairs()]
        return pdf.loc[sorted(chosen), ["left_uid", "right_uid", "cost"]]

    return placed.groupBy("component").applyInPandas(solve, "left_uid string, right_uid string, cost double")


#: Two groups with edges between them: the least of these, how many there are, and the groups' sensors.
BETWEEN = "x string, y string, cost double, left_uid string, right_uid string, m long, sx array<string>, sy array<string>"


def _merged(most: int):
    """What going through all of a task's group pairs in order joins: (x, y), y becoming part of x."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[str, dict[str, int]] = {}
        sensors: dict[str, set] = {}
        of: dict[str, str] = {}
        rows = pd.concat([*batches, pd.DataFrame({c.split()[0]: [] for c in BETWEEN.split(", ")})]).sort_values(["cost", "left_uid", "right_uid"])
        for r in rows.itertuples():
            near.setdefault(r.x, {})[r.y] = near.setdefault(r.y, {})[r.x] = r.m
            sensors[r.x], sensors[r.y] = set(r.sx), set(r.sy)

        def find(u: str) -> str:
            while (up := of.setdefault(u, u)) != u:
                of[u] = u = of[up]
            return u

        joined = []
        for x, y in zip(rows["x"], rows["y"], strict=True):
            x, y = sorted((find(x), find(y)))
            a, b = sensors[x], sensors[y]
            if x == y or len(a) + len(b) > most or a & b or near[x].get(y) != len(a) * len(b):
                continue
            joined.append((x, y))
            of[y], sensors[x] = x, a | b
            for z, m in near.pop(y).items():
                del near[z][y]
                if z != x:
                    near[x][z] = near[z][x] = near[x].get(z, 0) + m
        yield pd.DataFrame(joined, columns=["x", "y"], dtype="object")

    return run


def clique_groups(edges: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """(uid, group_id): groups of nodes all pairs of which are edges, at most `most`, no sensor twice.

    The result is that of going through the edges by (cost, left_uid, right_uid) and making the two groups at the ends of each one if that
    gives such a group. Nodes (uid, node_id) without edges are groups of one. group_id is the group's least uid.

    Pairs of groups are rows with their least edge, the number of edges and the sensors of both. Two groups may become one if the edges are as many as
    their members' products, and once they may not, they never may: such rows go at once. Of the rest, in each round the pairs whose edge comes first at both groups
    become one, all in parallel: nothing that comes before can reach them any more. Up to LOCAL_EDGES
    rows are one task's work. A chain whose costs rise from end to end takes a round for each second link beyond that number.
    """
    if not 2 <= most <= 8:
        raise ValueError("most must be 2 to 8")
    sensor = nodes.select("uid", "node_id")
    end = lambda c, x: sensor.select(F.col("uid").alias(c), F.array("node_id").alias(x))
    first = edges.select("left_uid", "right_uid", "cost").join(end("left_uid", "sl"), "left_uid").join(end("right_uid", "sr"), "right_uid").where("left_uid <> right_uid")
    swap = F.col("left_uid") > F.col("right_uid")
    first = first.select(F.least("left_uid", "right_uid").alias("x"), F.greatest("left_uid", "right_uid").alias("y"), "cost", "left_uid", "right_uid", F.when(swap, F.col("sr")).otherwise(F.col("sl")).alias("sx"), F.when(swap, F.col("sl")).otherwise(F.col("sr")).alias("sy"))
    least = F.min(F.struct("cost", "left_uid", "right_uid")).alias("r")
    unpack = lambda df: df.select("x", "y", "r.cost", "r.left_uid", "r.right_uid", "m", "sx", "sy")
    able = (F.size("sx") + F.size("sy") <= most) & (F.col("m") == F.size("sx") * F.size("sy")) & ~F.arrays_overlap("sx", "sy")
    left = checkpoint(unpack(first.groupBy("x", "y").agg(least, F.lit(1).cast("long").alias("m"), F.first("sx").alias("sx"), F.first("sy").alias("sy"))).where(able))
    joined = None
    while not _at_most(left, LOCAL_EDGES):
        rank = F.struct("cost", "left_uid", "right_uid", "x", "y", "sx", "sy")
        best = left.select(F.col("x").alias("uid"), rank.alias("r")).union(left.select("y", rank)).groupBy("uid").agg(F.min("r").alias("r"))
        wins = checkpoint(best.groupBy("r").agg(F.count("*").alias("n")).where("n = 2").select("r.x", "r.y", F.concat("r.sx", "r.sy").alias("s")))
        joined = wins.select("x", "y") if joined is None else joined.union(wins.select("x", "y"))
        moved = wins.select(F.col("x").alias("was"), F.col("x").alias("now"), "s").union(wins.select("y", "x", "s"))
        side = lambda c: moved.select(F.col("was").alias(c), F.col("now").alias(f"n{c}"), F.col("s").alias(f"n_s{c}"))  # noqa: E731, B023
        met = left.join(side("x"), "x", "left").join(side("y"), "y", "left")
        met = met.withColumns({c: F.coalesce(f"n{c}", c) for c in ("x", "y")} | {f"s{c}": F.coalesce(f"n_s{c}", f"s{c}") for c in ("x", "y")}).where("x <> y")
        turned = F.col("x") > F.col("y")
        met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "cost", "left_uid", "right_uid", "m", F.when(turned, F.col("sy")).otherwise(F.col("sx")).alias("sx"), F.when(turned, F.col("sx")).otherwise(F.col("sy")).alias("sy"))
        left = checkpoint(unpack(met.groupBy("x", "y").agg(least, F.sum("m").alias("m"), F.first("sx").alias("sx"), F.first("sy").alias("sy"))).where(able))
    rest = checkpoint(left.coalesce(1).mapInPandas(_merged(most), "x string, y string"))
    joined = rest if joined is None else joined.union(rest)
    grouped = components(joined.select(F.col("x").alias("left_uid"), F.col("y").alias("right_uid")))
    return sensor.join(grouped, "uid", "left").select("uid", F.coalesce("component", "uid").alias("group_id"))


def pair_groups(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, group_id) of selected pairs and of the nodes left over, each alone."""
    name = F.least("left_uid", "right_uid").alias("group_id")
    both = pairs.select(F.col("left_uid").alias("uid"), name).union(pairs.select(F.col("right_uid"), name))
    return both.unionByName(nodes.select("uid").join(both, "uid", "left_anti").select("uid", F.col("uid").alias("group_id")))


#: Solvers by name: (edges, nodes) to (uid, group_id).
SOLVERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "greedy": lambda edges, nodes: pair_groups(greedy_pairs(edges), nodes),
    "exact": lambda edges, nodes: pair_groups(exact_pairs(edges), nodes),
    "clique": clique_groups,
}
