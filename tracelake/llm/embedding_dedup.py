"""Embedding near-dedup by NN-descent in blocks of bounded size.

Vectors are compared within their label by cosine.  Equal vectors of a label
are combined to one class first.  Classes are laid out in blocks of bounded
size: a label that fits is one block; a larger one is cut into parts, and each
two parts, and each part by itself, are a block.  In a block

1. a graph of nearest neighbours is set out from random trees and refined by
   joining the neighbours of each vertex with each other (NN-descent);
2. a vertex whose list is full of links is saturated; its list is enlarged to the
   whole block, in tiles;
3. an audit measures vertices drawn at random against the whole block, until
   ``AUDIT_LINKS`` links are met or all vertices are drawn, and what it meets is
   kept.  If the lists lacked any of these links, all vertices of the block are
   measured;
4. pairs near the threshold are measured again in double precision;
5. each linked class gives one row, its number of links and the least vertex of
   its component in the block, however dense a group is; links are not returned.

Counts are summed over blocks, and components are joined over all of them.
Where links are few the audit draws all vertices, so no rare pair is lost; where
they are many, a loss of one in fifty passes the audit once in 170 blocks.
Each two vectors of a label share a block, so the
number of blocks grows as the square of the vectors of a label over
``block_rows``.

Defined results: vectors that are null, zero or hold null or non-finite
components, and vectors with a null label, link with nothing; vectors of
different lengths link with nothing; rows that repeat an id are one vector
each, and share its component; a null id keeps its row and is never a
component's id; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import connected_components, materialize
from tracelake.llm.vectors import matrix, packed, usable

THRESHOLD = 0.93
NEIGHBOURS = 12
BLOCK_ROWS = 16384
TILE_ROWS = 256
AUDIT_LINKS = 256
_NEAR = 1e-4


def _leaves(x: np.ndarray, rng: np.random.Generator, size: int) -> list[np.ndarray]:
    """Leaves of one random tree: cuts at the median along the difference of two
    random members."""
    out, work = [], [np.arange(len(x))]
    while work:
        own = work.pop()
        if len(own) <= size:
            out.append(own)
            continue
        a, b = rng.choice(len(own), 2, replace=False)
        side = x[own] @ (x[own[a]] - x[own[b]])
        order = np.argsort(side, kind="stable")
        half = len(own) // 2
        work += [own[order[:half]], own[order[half:]]]
    return out


class Graph:
    """The k nearest found so far of each of n vectors, best first."""

    def __init__(self, x: np.ndarray, k: int) -> None:
        self.x, self.k = x, min(k, len(x) - 1)
        self.ids = np.full((len(x), self.k), -1, np.int64)
        self.sims = np.full((len(x), self.k), -2.0, np.float32)
        self.new = np.zeros((len(x), self.k), bool)

    def offer(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> int:
        """Directed candidates b of a; returns how many entered a list."""
        use = (a != b) & (s > self.sims[a, -1])
        a, b, s = a[use], b[use], s[use]
        if not len(a):
            return 0
        touched = np.unique(a)
        old = np.repeat(touched, self.k)
        src = np.concatenate([old, a])
        dst = np.concatenate([self.ids[touched].ravel(), b])
        sim = np.concatenate([self.sims[touched].ravel(), s])
        flag = np.concatenate([self.new[touched].ravel(), np.ones(len(a), bool)])
        fresh = np.concatenate([np.zeros(len(old), bool), np.ones(len(a), bool)])
        order = np.lexsort((fresh, dst, src))
        src, dst, sim, flag, fresh = src[order], dst[order], sim[order], flag[order], fresh[order]
        first = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])] | (dst < 0)
        src, dst, sim, flag, fresh = src[first], dst[first], sim[first], flag[first], fresh[first]
        order = np.lexsort((dst, -sim, src))
        src, dst, sim, flag, fresh = src[order], dst[order], sim[order], flag[order], fresh[order]
        starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        rank = np.arange(len(src)) - np.repeat(starts, np.diff(np.r_[starts, len(src)]))
        keep = rank < self.k
        self.ids[src[keep], rank[keep]] = dst[keep]
        self.sims[src[keep], rank[keep]] = sim[keep]
        self.new[src[keep], rank[keep]] = flag[keep]
        return int(fresh[keep].sum())

    def join(self, rng: np.random.Generator) -> int:
        """One turn: the neighbours of each vertex are joined with each other."""
        n, k = self.ids.shape
        src, dst = np.repeat(np.arange(n), k), self.ids.ravel()
        flag = self.new.ravel()
        real = dst >= 0
        src, dst, flag = src[real], dst[real], flag[real]
        self.new[:] = False
        # A hub is a neighbour of many; of those that name it, k at random are
        # joined in this turn, as the method has it.
        mix = rng.permutation(len(src))
        order = mix[np.argsort(dst[mix], kind="stable")]
        starts = np.flatnonzero(np.r_[True, dst[order][1:] != dst[order][:-1]])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        take = order[rank < k]
        around = np.full((n, 2 * k), -1, np.int64)
        fresh = np.zeros((n, 2 * k), bool)
        around[:, :k], place = self.ids, np.tile(np.arange(k), n)[real]
        fresh[src, place] = flag
        around[dst[take], k + rank[rank < k]] = src[take]
        fresh[dst[take], k + rank[rank < k]] = flag[take]
        changed = 0
        for lo in range(0, n, 1024):
            own, f = around[lo : lo + 1024], fresh[lo : lo + 1024]
            busy = f.any(axis=1)
            own, f = own[busy], f[busy]
            if not len(own):
                continue
            v = self.x[own]
            sims = v @ v.transpose(0, 2, 1)
            ok = (own >= 0)[:, :, None] & (own >= 0)[:, None, :] & (f[:, :, None] | f[:, None, :])
            a = np.broadcast_to(own[:, :, None], sims.shape)[ok]
            b = np.broadcast_to(own[:, None, :], sims.shape)[ok]
            changed += self.offer(a, b, sims[ok])
        return changed


def descend(x: np.ndarray, k: int = NEIGHBOURS, trees: int = 3, turns: int = 12, seed: int = 0) -> Graph:
    """NN-descent over the unit vectors ``x``."""
    rng = np.random.default_rng(seed)
    graph = Graph(x, k)
    if graph.k < 1:
        return graph
    for _ in range(trees):
        for leaf in _leaves(x, rng, 4 * k):
            sims = x[leaf] @ x[leaf].T
            a, b = np.meshgrid(leaf, leaf, indexing="ij")
            graph.offer(a.ravel(), b.ravel(), sims.ravel())
    for _ in range(turns):
        if graph.join(rng) <= 0.001 * graph.ids.size:
            break
    return graph


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


class _Links:
    """Links of one block: how many each vertex has, and its group."""

    def __init__(self, exact: np.ndarray, weight: np.ndarray, side: np.ndarray, within: bool, threshold: float) -> None:
        n = len(exact)
        self.exact, self.weight, self.side, self.within, self.threshold = exact, weight, side, within, threshold
        self.length = np.sqrt((exact * exact).sum(axis=1))
        self.x = (exact / self.length[:, None]).astype(np.float32)
        self.count, self.group = np.zeros(n), np.arange(n)

    def pass_(self, i: np.ndarray, j: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Which candidate pairs are links."""
        keep = (i != j) if self.within else self.side[i] != self.side[j]
        close = np.flatnonzero(keep & (sims < self.threshold + _NEAR))
        for lo in range(0, len(close), 1 << 16):
            c = close[lo : lo + (1 << 16)]
            cosine = np.einsum("nd,nd->n", self.exact[i[c]], self.exact[j[c]]) / (self.length[i[c]] * self.length[j[c]])
            keep[c] = cosine >= self.threshold
        return keep

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links of some vertices, measured against the whole block."""
        sims = self.x[rows] @ self.x.T
        i, j = np.nonzero(sims >= self.threshold - _NEAR)
        near = sims[i, j]
        i = rows[i]
        keep = self.pass_(i, j, near)
        return i[keep], j[keep]

    def add(self, i: np.ndarray, j: np.ndarray, both: np.ndarray) -> None:
        """Counts links for i, and for j where ``both``, and joins their groups."""
        n = len(self.count)
        self.count += np.bincount(i, self.weight[j], n) + np.bincount(j[both], self.weight[i[both]], n)
        apart = self.group[i] != self.group[j]
        if apart.any():
            self.group = _groups(n, np.r_[np.arange(n), i[apart]], np.r_[self.group, j[apart]])


def _search(links: _Links, seed: int = 0) -> None:
    """NN-descent over a block, saturated lists enlarged, and the audit."""
    n = len(links.x)
    graph = descend(links.x, NEIGHBOURS, seed=seed)
    if graph.k < 1:
        return
    least = links.threshold - _NEAR
    measured = graph.sims[:, -1] >= least
    if graph.k == n - 1:
        measured[:] = False  # the lists are whole
    a, b = np.repeat(np.arange(n), graph.k), graph.ids.ravel()
    near = (b >= 0) & (graph.sims.ravel() >= least)
    a, b, sims = a[near], b[near], graph.sims.ravel()[near]
    pairs, first = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)
    keep = links.pass_(pairs // n, pairs % n, sims[first])
    pairs = pairs[keep]

    rng = np.random.default_rng(seed + 1)
    order = rng.permutation(np.flatnonzero(~measured))
    seen, lost = 0, False
    for lo in range(0, len(order) if graph.k < n - 1 else 0, TILE_ROWS):
        drawn = order[lo : lo + TILE_ROWS]
        i, j = links.of(drawn)
        known = np.isin(np.minimum(i, j) * n + np.maximum(i, j), pairs)
        measured[drawn] = True
        lost |= not known.all()
        seen += len(i)
        if lost or seen >= AUDIT_LINKS:
            break
    if lost:
        measured[:] = True

    rows = np.flatnonzero(measured)
    for lo in range(0, len(rows), TILE_ROWS):
        i, j = links.of(rows[lo : lo + TILE_ROWS])
        links.add(i, j, ~measured[j])
    i, j = pairs // n, pairs % n
    rest = ~measured[i] & ~measured[j]
    links.add(i[rest], j[rest], np.ones(rest.sum(), bool))


def _block(threshold: float):
    """Links of a block of two parts p < q, those across, or of one part p = q,
    those within: each linked class gives one row, its number of links (n, copies
    counted), its vertex (a) and the least vertex of its component here (b)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vectors, copies = pdf["vec_id"].to_numpy(), pdf["vector"].tolist(), pdf["copies"].to_numpy()
        cls, part, within = pdf["cls"].to_numpy(), pdf["part"].to_numpy(), pdf["p"].iloc[0] == pdf["q"].iloc[0]
        out: list[tuple[np.ndarray, ...]] = []
        width = np.array([len(v) for v in vectors])
        for own in (np.flatnonzero(width == w) for w in np.unique(width)):
            own = own[np.argsort(ids[own], kind="stable")]
            links = _Links(matrix([vectors[i] for i in own]), copies[own].astype(float), part[own], within, threshold)
            _search(links)
            linked = np.flatnonzero(links.count)
            # Vertices are in the order of their ids, so the least place is the least id.
            out.append((cls[own[linked]], ids[own[linked]], ids[own[links.group[linked]]], links.count[linked].astype(np.int64)))
        return pd.DataFrame(dict(zip(("cls", "a", "b", "n"), map(np.concatenate, zip(*out)))))

    return run


def _placed(classes: DataFrame, block_rows: int) -> DataFrame:
    """Rows with the blocks they belong to (label, two parts).  A label of at most
    ``block_rows`` is one part; of a larger one each two parts make a block, and
    each part one more, so each pair of rows is measured in exactly one block."""
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    parts = F.when(F.col("m") <= block_rows, 1).otherwise(F.ceil(2 * F.col("m") / block_rows)).cast("int")
    return (
        classes.join(sizes.select("label", parts.alias("parts")), "label")
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("cls", "vec_id", "vector", "copies", "label", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    )


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): n_links,
    component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    fine = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    members = packed(fine, "label")
    # A class is a distinct vector of a label; its least id stands for it.
    classes = members.groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    blocks = _placed(classes, block_rows).groupBy("label", "p", "q")
    found = materialize(blocks.applyInPandas(_block(threshold), "cls long, a long, b long, n long"))
    linked = found.groupBy("cls").agg(F.sum("n").alias("others"))
    roots = connected_components(found.select("a", "b"))
    named = (
        classes.join(linked, "cls", "left")
        .join(roots.withColumnRenamed("v", "vec_id"), "vec_id", "left")
        .withColumn("root", F.coalesce("root", "vec_id"))
    )
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "root").select(
        "label", "vector", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    good = members.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
