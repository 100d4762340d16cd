"""Exact cosine links between embeddings by cover trees and their dual traversal.

Cosine >= c means a chord of at most sqrt(2 - 2c) between the unit vectors, a
metric. Upper levels of the trees are cells around pivots; a cell's vectors and
the visitors that a bound cannot rule out go to one task, which builds cover
trees over both and walks them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import components, discard, materialize, min_labels, table

#: Vectors of a cell, and visitors in one task.
CELL, VISITORS = 8192, 8192
#: Pivots that split one cell in expectation, and rows of a large cell that go to one task.
FANOUT, DEALT = 32, 16384
#: Chords are exact to this, also those of nearly equal vectors.
_SLACK = 1e-7
#: Centres, or nodes of one side, whose distances are computed together.
_BLOCK = 256
#: Pairs whose cosines are computed together.
_CHECKED = 1 << 15


class CoverTree:
    """Nested levels whose radii halve: a node's children cover it, each within half of its level's radius.

    ``radius`` of a node is the largest distance from its centre to what is
    below it. Nodes of ``leaf`` members or fewer are not split.
    """

    def __init__(self, x: np.ndarray, leaf: int = 16):
        self.x, self.leaf = x, leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray | None] = []
        if len(x):
            self._grow()
        self.centres = self.x[self.centre] if len(x) else x
        self.radii = np.array(self.radius)

    def _grow(self) -> None:
        every = np.arange(len(self.x))
        stack = [(self._node(every, float(chord(self.x, self.x[:1]).max())), 2.0)]
        while stack:
            node, level = stack.pop()
            if len(self.members[node]) <= self.leaf or self.radius[node] < 1e-6:
                continue
            while self.radius[node] <= level / 2:
                level /= 2
            ids = [self._node(m, r) for m, r in self._net(self.members[node], level / 2)]
            self.children[node] = np.array(ids)
            stack += [(i, level / 2) for i in ids]

    def _net(self, members: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, float]]:
        """Members by centres: the first that is left takes all within ``reach``, and so on; with the largest distance."""
        while len(members):
            d = chord(self.x[members], self.x[members[:_BLOCK]])
            near, free = d <= reach, np.ones(len(members), bool)
            for k in range(d.shape[1]):
                if free[k]:
                    mine = np.flatnonzero(near[:, k] & free)
                    mine = mine if near[k, k] else np.append(mine, k)
                    free[mine] = False
                    yield members[np.r_[k, mine[mine != k]]], float(d[mine, k].max()) if len(mine) > 1 else 0.0
            members = members[free]

    def lone(self) -> np.ndarray:
        """By node, its one member; -1 if it has more or is split."""
        return np.array([int(m[0]) if len(m) == 1 and c is None else -1 for m, c in zip(self.members, self.children, strict=True)], np.int64)

    def _node(self, members: np.ndarray, radius: float) -> int:
        self.centre.append(int(members[0]))
        self.radius.append(radius)
        self.members.append(members)
        self.children.append(None)
        return len(self.centre) - 1


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of ``a`` and ``b``, all of length 1."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def dual_links(one: CoverTree, two: CoverTree, tau: float):
    """(i, j, sure) arrays of members: if sure, all pairs of i and j are within tau by the radii; if not, all are to be checked; with None, i and j are aligned pairs to be checked.

    A pair of nodes goes no further if its centres are over tau plus both radii
    apart. With ``one is two`` each pair of members comes once.
    """
    same = one is two
    if not one.centre or not two.centre:
        return
    lone_p, lone_q = one.lone(), two.lone()
    stack = [(np.array([0]), np.array([0]))]
    while stack:
        a, b = stack.pop()
        for at in range(0, len(a), _BLOCK):
            part, rest = a[at : at + _BLOCK], b[at:] if same and a is b else b
            d = chord(one.centres[part], two.centres[rest])
            spread = one.radii[part][:, None] + two.radii[rest][None, :]
            alive = d <= spread + (tau + _SLACK)
            if same and a is b:
                alive = np.triu(alive)
            i, j = np.nonzero(alive)
            p_, q_ = part[i], rest[j]
            # nodes of one member each need no walk: all such pairs of the block are given together
            ends = (lone_p[p_] >= 0) & (lone_q[q_] >= 0)
            if same:
                ends &= p_ != q_
            if ends.any():
                yield lone_p[p_[ends]], lone_q[q_[ends]], None
            for i, j in zip(i[~ends], j[~ends], strict=True):
                p, q = int(part[i]), int(rest[j])
                kids_p, kids_q = one.children[p], two.children[q]
                if same and p == q:
                    if kids_p is not None:
                        stack.append((kids_p, kids_p))
                    elif lone_p[p] < 0:
                        yield one.members[p], one.members[p], False
                elif d[i, j] + spread[i, j] <= tau - _SLACK:
                    yield one.members[p], two.members[q], True
                elif kids_p is None and kids_q is None:
                    yield one.members[p], two.members[q], False
                elif kids_q is None or (kids_p is not None and one.radii[p] >= two.radii[q]):
                    stack.append((kids_p, np.array([q])))
                else:
                    stack.append((np.array([p]), kids_q))


def links_in_cell(own: np.ndarray, weight: np.ndarray, visitors: np.ndarray, visitor_weight: np.ndarray, least: float, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """(n, root) over own then visitors: weight linked to each, and the first row of its component here.

    ``inner``: own rows are also compared with each other. Visitors are never.
    """
    tau = float(np.sqrt(2.0 - 2.0 * least))
    raw = np.concatenate([own, visitors]) if len(visitors) else own
    raw = _scaled(raw)
    norm = np.linalg.norm(raw, axis=1)
    unit = raw / norm[:, None]
    w = np.concatenate([weight, visitor_weight])
    n, label = np.zeros(len(raw), np.int64), np.arange(len(raw))
    size = len(own)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        label = min_labels(len(label), np.concatenate([np.arange(len(label)), a]), np.concatenate([label, b]))

    def handle(found, shift: int) -> None:
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def settle() -> None:
            nonlocal held
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                for at in range(0, len(a), _CHECKED):
                    i, j = a[at : at + _CHECKED], b[at : at + _CHECKED]
                    near = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= least
                    i, j = i[near], j[near]
                    np.add.at(n, i, w[j])
                    np.add.at(n, j, w[i])
                    edges.append((i, j))
            if edges:
                join(*(np.concatenate(x) for x in zip(*edges, strict=True)))
            edges.clear()
            pairs.clear()
            held = 0

        for i, j, sure in found:
            j = j + shift
            if sure:
                n[i] += w[j].sum()
                n[j] += w[i].sum()
                edges += [(i, np.full(len(i), j[0])), (np.full(len(j), i[0]), j)]
                held += len(i) + len(j)
            elif sure is None:
                pairs.append((i, j))
                held += len(i)
            else:
                a, b = np.repeat(i, len(j)), np.tile(j, len(i))
                if not shift and i[0] == j[0]:
                    a, b = a[a < b], b[a < b]
                pairs.append((a, b))
                held += len(a)
            if held > 4 * _CHECKED:
                settle()
        settle()

    tree = CoverTree(unit[:size])
    if inner:
        handle(dual_links(tree, tree, tau), 0)
    if len(visitors):
        handle(dual_links(tree, CoverTree(unit[size:]), tau), size)
    return n, label


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, the largest component between 1/2 and 1: the same directions, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) if len(x) else x


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _cell_rows(least: float):
    def run(t: pa.Table) -> pa.Table:
        salt = t.column("salt")[0].as_py()
        own = np.asarray(t.column("own").to_numpy(), dtype=bool)
        order = np.r_[np.flatnonzero(own), np.flatnonzero(~own)]
        x, cid, w = _matrix(t.column("vec"))[order], t.column("cid").to_numpy()[order], t.column("weight").to_numpy()[order]
        k = int(own.sum())
        n, label = links_in_cell(x[:k], w[:k], x[k:], w[k:], least, salt == 0)
        some = n > 0
        return pa.table({"cid": cid[some], "n": n[some], "root": cid[label[some]]})

    return run


def _split(rows: DataFrame, least: float, cell: int = CELL) -> DataFrame:
    """(cell, own, cid, weight, vec): cells of about ``cell`` own vectors at most, with the visitors that may link to them.

    A cell that is too large is split around pivots taken from it by hash.
    Each own vector goes to its nearest pivot, and as a visitor to later cells
    that the triangle inequality does not rule out: two vectors within tau are
    at distances from any two pivots that differ by 2 tau at most. Visitors go
    to all such cells. Each pair of own vectors so meets exactly once. A large
    cell is dealt out to as many tasks as its rows need, and its pivots are
    sent to each of these; nothing is gathered on the driver.
    """
    tau, done = float(np.sqrt(2.0 - 2.0 * least)), None
    for depth in range(16):
        sizes = materialize(rows.groupBy("cell").agg(F.sum(F.col("own").cast("long")).alias("n"), F.count("*").alias("n_rows")).where(F.col("n") > cell), "cells-large")
        if depth == 15 or not sizes.head(1):
            return rows if done is None else done.unionByName(rows)
        ended = rows.join(sizes.select("cell"), "cell", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        plan = sizes.withColumn("want", F.least(F.lit(FANOUT), F.ceil(F.col("n") / (0.5 * cell)))).withColumn("salts", F.ceil(F.col("n_rows") / DEALT).cast("int"))
        rest = materialize(rows.join(plan, "cell").withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(~depth)), "salts").cast("int")), "cells-rest")
        rank = F.xxhash64("cid", F.lit(depth))
        own = rest.where("own")
        # the least hashes of a cell: FANOUT in expectation, and one at least
        picked = own.where(F.pmod(rank, F.lit(1 << 30)) <= F.lit(float(1 << 30)) * F.col("want") / F.col("n")).select("cell", "salts", "cid", "vec")
        one = own.groupBy("cell", "salts").agg(F.min(F.struct(rank.alias("h"), "cid", "vec")).alias("p")).select("cell", "salts", "p.cid", "p.vec")
        pivots = materialize(picked.union(one).dropDuplicates(["cell", "cid"]), "cells-pivots")
        dealt = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "cid", "vec")
        parts = rest.groupBy("cell", "salt").cogroup(dealt.groupBy("cell", "salt"))
        rows = materialize(parts.applyInArrow(_assign(tau), "cell long, own boolean, cid long, weight long, vec array<double>"), "cells-split")
        discard(rest, pivots)
    return rows


def _assign(tau: float):
    def run(t: pa.Table, pivots: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.select(["cell", "own", "cid", "weight", "vec"])
        order = np.argsort(pivots.column("cid").to_numpy(), kind="stable")
        points, x = _scaled(_matrix(pivots.column("vec"))[order]), _scaled(_matrix(t.column("vec")))
        points /= np.linalg.norm(points, axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        d = chord(x, points)
        home = d.argmin(axis=1)
        open_ = d <= d.min(axis=1)[:, None] + 2 * tau + _SLACK
        mine = t.column("own").to_numpy()
        # own rows: later cells as visitors, their own as own
        open_ &= ~mine[:, None] | (np.arange(d.shape[1])[None, :] >= home[:, None])
        i, j = np.nonzero(open_)
        cell = int(t.column("cell")[0].as_py())
        ids, src = np.array([hash((cell, q)) for q in range(d.shape[1])], dtype=np.int64), pa.array(i)
        return pa.table({"cell": ids[j], "own": mine[i] & (j == home[i]), **{k: t.column(k).take(src) for k in ("cid", "weight", "vec")}})

    return run


def linked(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding, label).

    Rows with one label, not null, and one dimension are linked where the
    cosine, in double precision, is ``least`` or more. Null and zero vectors
    and those with a null or non-finite component link with nothing. Equal
    vectors of a label are one class, compared once; n_links counts other rows
    of the class too; vectors may have components of any size, as they are
    scaled by powers of two first. component_id is the smallest vec_id reachable, itself
    included; kept: it is the row's own. No vector gives no row; other columns
    are ignored. In data without clusters the bounds rule out little, and the
    visits of a label grow with its rows times its cells; results stay exact.
    """
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"), F.coalesce(fine, F.lit(False)).alias("fine"))
    good = rows.where("fine")
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors-classes")
    start = classes.select(F.xxhash64("label", F.size("vec")).alias("cell"), F.lit(True).alias("own"), "cid", "weight", "vec")
    cells = _split(start, least)
    sizes = cells.groupBy("cell").agg(F.sum((~F.col("own")).cast("long")).alias("visitors"))
    sizes = sizes.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("visitors") / VISITORS)).cast("int"))
    cells = cells.join(materialize(sizes, "cells-sizes"), "cell")
    salt = F.when(F.col("own"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int")))
    tasks = cells.select("cell", F.explode(salt).alias("salt"), "own", "cid", "weight", "vec")
    found = materialize(tasks.groupBy("cell", "salt").applyInArrow(_cell_rows(least), "cid long, n long, root long"), "vectors-found")
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")), "vectors-components")
    roots = roots.select(F.col("u").alias("cid"), F.col("v").alias("root"))
    roots = roots.union(roots.select("root", "root").distinct())
    reps = materialize(roots.join(classes.select("cid", "rep"), "cid"), "vectors-reps")
    least_rep = materialize(reps.groupBy("root").agg(F.min("rep").alias("least")), "vectors-least")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    moved = reps.join(least_rep, "root").select("cid", "least").join(counts, "cid", "left")
    labels = classes.join(moved, "cid", "left").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    labels = materialize(labels, "vectors-labels")
    out = good.join(labels, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
