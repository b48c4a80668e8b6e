"""Operator 3, n-gram Jaccard join with count-vector R-trees.

A document is its set of word shingles. Documents with equal sets are one
class. Two classes link when ``100 * intersection >= percent * union``.

* Count vectors: shingles are hashed into ``GROUPS`` groups; the numbers of a
  set's shingles by group are its point. The intersection of two sets is at
  most the sum of the coordinate minima of their points.
* R-tree: points are packed into pages and nodes with their largest
  coordinates and their range of set sizes. Two nodes are compared only if the
  sum of minima of their bounds, and their sizes, allow a link; inside pages
  the same bound picks the pairs.
* Verification: surviving pairs are decided on the sets themselves.

Where the trees stand: one tree over all classes would end in one task, and
random texts look alike to it. So points are first dealt into cells. A set of
n shingles that links with another shares with it ``SHARED`` of its
``n - ceil(percent * n / 100) + SHARED`` first shingles, in any order common to
all sets; each of those shingles is a cell, cells with the same members are
one, and what is in a cell by chance leaves it (``_cells``). The order puts shingles that many documents share last, so that common
passages make no large cells; it only steers cost, not the result. Cells over
``CELL_ROWS`` are split into chunks, and each pair of chunks is a task of its
own, so no group of copies, however large, meets in one task.

Only components are asked for, so pairs are not listed in full: in each round
every point proposes its best partner outside its own component, proposals
are verified, and verified links merge components. When rounds stop merging,
all remaining pairs between different components are verified. A pair inside
one component needs no check, and no other pair is left out.

Defined results: null or blank text has no shingle and links with nothing;
rows that share an id are each classed (their id takes part once for each of
its texts); a null id has component null unless its class or links hold other
ids; an empty table gives an empty result. Whole texts are shingled. Other
columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import landed, map_arrow, pick
from .components import components
from .textblocks import mix64, shingle_sets

GROUPS = 256
CELL_ROWS = 4096
LEAF, FANOUT = 64, 16
ROUNDS = 6
#: First shingles that linked sets are sure to share (or their intersection, if smaller).
SHARED = 8
#: Tables of at most so many ids (8 to 24 bytes each; counted first) are broadcast.
BROADCAST_ROWS = 500_000
#: Shingles that a task meets so often in ``COUNT_ROWS`` are reported, and so
#: many of the most frequent ones overall come last in the order of cells.
COUNT_ROWS, LOCAL_HOT, HOT_SHINGLES = 1 << 20, 4, 200_000
_U = np.uint64
_SALT = [_U(0x243F6A8885A308D3), _U(0xA4093822299F31D0)]


# ---- sets, points and trees (numpy) ----

def class_id(s: np.ndarray) -> int:
    """64-bit hash of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix64(np.atleast_1d(mix64(s ^ _SALT[0]).sum() + _U(len(s)))).view(np.int64)[0])


def point(s: np.ndarray) -> bytes:
    """The count vector, as group numbers of the shingles (short sets) or as
    counts."""
    groups = (mix64(s ^ _SALT[1]) >> _U(56)).astype(np.uint8)
    if len(s) <= 2 * GROUPS:
        return groups.tobytes()
    counts = np.bincount(groups, minlength=GROUPS)
    return counts.astype("<u4").tobytes()


def counts_of(data: bytes, n: int) -> np.ndarray:
    if n <= 2 * GROUPS:
        return np.bincount(np.frombuffer(data, np.uint8), minlength=GROUPS)
    return np.frombuffer(data, "<u4").astype(np.int64)


def needed(na, nb, percent: int):
    """Least intersection of linked sets of these sizes (or larger)."""
    return -(-percent * (na + nb) // (100 + percent))


class RTree:
    """Points packed in the order of their sizes, then of their widest
    coordinate, LEAF to a page and FANOUT pages to a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, int(points.var(axis=0).argmax())] if len(points) else sizes, sizes))
        top = int(points.max()) if points.size else 0
        self.points = points[self.order].astype(np.uint8 if top < 256 else np.uint32)
        self.sizes = sizes[self.order].astype(np.int64)
        self.levels = []
        start = np.arange(0, len(sizes), LEAF)
        high = np.maximum.reduceat(self.points, start, axis=0)
        low_n, high_n = np.minimum.reduceat(self.sizes, start), np.maximum.reduceat(self.sizes, start)
        self.levels.append((high, low_n, high_n))
        while len(high) > FANOUT:
            start = np.arange(0, len(high), FANOUT)
            high = np.maximum.reduceat(high, start, axis=0)
            low_n, high_n = np.minimum.reduceat(low_n, start), np.maximum.reduceat(high_n, start)
            self.levels.append((high, low_n, high_n))


def _minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of all rows of a with all rows of b."""
    wide = np.uint32 if a.dtype == np.uint8 == b.dtype else np.int64
    return np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2, dtype=wide).astype(np.int64)


def page_pairs(t: RTree, u: RTree, percent: int):
    """Pages of two trees that may hold linked points, from the top down."""
    same = t is u
    at, bt = len(t.levels) - 1, len(u.levels) - 1
    front = [(i, j) for i in range(len(t.levels[at][0])) for j in range(len(u.levels[bt][0])) if not same or j >= i]
    while True:
        kept = []
        (ha, la, xa), (hb, lb, xb) = t.levels[at], u.levels[bt]
        for i, j in front:
            if 100 * xa[i] < percent * lb[j] or 100 * xb[j] < percent * la[i]:
                continue
            bound = int(np.minimum(ha[i], hb[j]).sum(dtype=np.int64))
            if bound >= needed(la[i], lb[j], percent):
                kept.append((i, j))
        if at == 0 and bt == 0:
            return kept
        na, nb = max(at - 1, 0), max(bt - 1, 0)
        spread = lambda i, level, new, tree: range(i * FANOUT, min((i + 1) * FANOUT, len(tree.levels[new][0]))) if new < level else [i]
        front = [(x, y) for i, j in kept for x in spread(i, at, na, t) for y in spread(j, bt, nb, u) if not same or y >= x]
        at, bt = na, nb


def _page_bounds(t: RTree, u: RTree, label_t: np.ndarray, label_u: np.ndarray, percent: int):
    """For pages that may hold linked points: their slices, the bounds on the
    intersections, and which pairs (each once) a link is possible for, in
    different components."""
    lt, lu = label_t[t.order], label_u[u.order]
    for i, j in page_pairs(t, u, percent):
        a, b = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        na, nb = t.sizes[a][:, None], u.sizes[b][None, :]
        bound = np.minimum(_minima(t.points[a], u.points[b]), np.minimum(na, nb))
        ok = (bound >= needed(na, nb, percent)) & (lt[a][:, None] != lu[b][None, :])
        if t is u and i == j:
            ok &= np.tri(len(lt[a]), k=-1, dtype=bool).T
        if ok.any():
            yield a, b, bound / (na + nb - bound), ok


def tree_join(t: RTree, u: RTree, label_t: np.ndarray, label_u: np.ndarray, percent: int):
    """(row of t, row of u) of all pairs in different components whose bound
    allows a link."""
    out = [np.zeros((0, 2), np.int64)]
    for a, b, _, ok in _page_bounds(t, u, label_t, label_u, percent):
        x, y = np.nonzero(ok)
        out.append(np.stack((x + a.start, y + b.start), 1))
    pairs = np.concatenate(out)
    return t.order[pairs[:, 0]], u.order[pairs[:, 1]]


def tree_best(t: RTree, u: RTree, label_t: np.ndarray, label_u: np.ndarray, percent: int):
    """For the rows of t, then for those of u: the best-bounded partner in
    another component (-1: none) and the bound on the similarity."""
    best = [np.full(len(x.sizes), -1.0) for x in (t, u)]
    partner = [np.full(len(x.sizes), -1, np.int64) for x in (t, u)]
    for a, b, score, ok in _page_bounds(t, u, label_t, label_u, percent):
        score = np.where(ok, score, -1.0)
        for side, (own, other, axis) in enumerate(((a, b, 1), (b, a, 0))):
            top = score.max(axis=axis)
            better = top > best[side][own]
            best[side][own] = np.where(better, top, best[side][own])
            partner[side][own] = np.where(better, score.argmax(axis=axis) + other.start, partner[side][own])
    if t is u:  # one table of both roles
        use = best[1] > best[0]
        best = [np.where(use, best[1], best[0])]
        partner = [np.where(use, partner[1], partner[0])]
    out = []
    for side, (own, other) in enumerate(((t, u), (u, t))[:len(best)]):
        score, with_ = np.full(len(own.sizes), -1.0), np.full(len(own.sizes), -1, np.int64)
        score[own.order] = best[side]
        with_[own.order] = np.where(partner[side] >= 0, other.order[partner[side]], -1)
        out.append((with_, score))
    return out


# ---- passes over the texts ----

def _profile(rows: DataFrame, size: int) -> DataFrame:
    """kind 0: id, class, check hash (from word hashes of another seed) and size
    of each row's set; kind 1: shingles (in ``cid``) that are frequent in this
    task, with their counts."""
    def run(batches):
        held, n = [], 0

        def frequent():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c >= LOCAL_HOT], c[c >= LOCAL_HOT]
            none = np.zeros(len(u), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(none.astype(np.int32) + 1), pa.array(none), pa.array(u.view(np.int64)), pa.array(none),
                 pa.array(c.astype(np.int64))], names=["kind", "id", "cid", "check", "n"])

        for b in batches:
            cid, check, sizes = [], [], []
            for s, other in shingle_sets(b.column(1), size, seeds=(0, 1)):
                cid.append(class_id(s))
                check.append(class_id(other))
                sizes.append(len(s))
                held.append(s)
                n += len(s)
                if n >= COUNT_ROWS:
                    yield frequent()
                    held, n = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(cid), np.int32)), b.column(0), pa.array(cid, pa.int64()),
                 pa.array(check, pa.int64()), pa.array(sizes, pa.int64())], names=["kind", "id", "cid", "check", "n"])
        if held:
            yield frequent()
    return rows.transform(map_arrow, run, "kind int, id long, cid long, check long, n long")


def _cells(rows: DataFrame, size: int, percent: int, hot) -> DataFrame:
    """cell, cid: classes that share first shingles with another class.

    Linked sets share SHARED of their first shingles, not only one. Where all of
    these stand in cells of just the two, those cells are one with SHARED keys;
    where one stands in a larger cell, that cell holds both. So cells of two with
    fewer keys, most of what chance brings together, hold no link."""
    def run(batches):
        late, rank = hot.value
        seen: set[int] = set()
        for b in batches:
            keys, cids, sizes = [], [], []
            for s in shingle_sets(b.column(0), size):
                if not len(s):
                    continue
                cid = class_id(s)
                if cid in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(cid)
                n = len(s)
                first = min(n, n - -(-percent * n // 100) + SHARED)
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    weight = np.where(late[at] == s, rank[at], 0)
                    if weight.any():
                        s = s[np.argsort(weight, kind="stable")]
                keys.append(s[:first].view(np.int64))
                cids.append(np.full(first, cid))
                sizes.append(np.full(first, n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(cids)), pa.array(np.concatenate(sizes))],
                    names=["key", "cid", "n"])
    first = rows.select("text").transform(map_arrow, run, "key long, cid long, n int")
    by_key = Window.partitionBy("key")
    by_size = by_key.orderBy("n", "cid")
    enough = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))

    def with_partners(entries: DataFrame) -> DataFrame:
        """Entries of keys that another class of fitting size has, too: a class
        that may link by size has such a class next to it in order of size."""
        near = ((100 * F.lag("n").over(by_size) >= percent * F.col("n"))
                | (100 * F.col("n") >= percent * F.lead("n").over(by_size)))
        return (entries.withColumn("near", near).withColumn("lo", F.min("cid").over(by_key))
                .withColumn("hi", F.max("cid").over(by_key))
                .where("lo <> hi AND near").select("key", "cid", "n").distinct())
    shared = landed(with_partners(first), "shared_keys")
    # a class with a link has SHARED such keys
    often = shared.groupBy("cid", "n").agg(F.count("*").alias("keys")).where(F.col("keys") >= enough).select("cid")
    shared = with_partners(shared.join(often, "cid", "left_semi"))
    # cells with the same members are one; a cell of two needs SHARED keys (sets
    # too small for that: their whole intersection), any larger cell stays
    named = (shared.withColumn("members", F.bit_xor(F.xxhash64("cid")).over(by_key))
             .withColumn("m", F.count("*").over(by_key)))
    return (named.groupBy(F.xxhash64("members", "m").alias("cell"), "m", "cid", "n").agg(F.count("*").alias("keys"))
            .where((F.col("m") > 2) | (F.col("keys") >= enough)).select("cell", "cid"))


def _member_sets(rows: DataFrame, members: DataFrame, n_members: int, size: int) -> DataFrame:
    """cid, n, point, shingles of the classes that stand in cells."""
    def run(batches):
        for b in batches:
            want = b.column(1).to_pylist()
            cid, n, points, sets = [], [], [], []
            for w, s in zip(want, shingle_sets(b.column(0), size)):
                if class_id(s) == w:
                    cid.append(w)
                    n.append(len(s))
                    points.append(point(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(points, pa.binary()),
                 pa.array(sets, pa.binary())], names=["cid", "n", "point", "shingles"])
    here = rows.join(_few(members, n_members), rows["id"].eqNullSafe(members["rep"])).select("text", "cid")
    return here.transform(map_arrow, run, "cid long, n long, point binary, shingles binary")


# ---- candidates and verification ----

def _proposals(cells: DataFrame, points: DataFrame, percent: int, best_only: bool, cell_rows: int) -> DataFrame:
    """cell, a, b, score, mutual: pairs of classes of one cell, in different components."""
    by_cell = Window.partitionBy("cell")
    open_ = (cells.withColumn("lo", F.min("component").over(by_cell)).withColumn("hi", F.max("component").over(by_cell))
             .withColumn("m", F.count("*").over(by_cell)).where("lo <> hi"))
    chunks = F.ceil(F.col("m") / cell_rows)
    dealt = (open_.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("cid", "cell"), F.col("chunks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .select("cell", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"),
                     (F.col("own") > F.col("other")).alias("second"), "cid", "component")
             .join(points, "cid")
             .select("cell", "ci", "cj", "second", "cid", "component", "n", "point")
             .repartition("cell", "ci", "cj").sortWithinPartitions("cell", "ci", "cj", "second"))

    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)

    def pairs_of(cid, comp, n, data, second, alone):
        """proposer, partner, bound on their similarity, whether the partner
        proposes the same (such a pair comes once)."""
        rows = np.stack([counts_of(d, k) for d, k in zip(data, n.tolist())])
        x, y = (np.arange(len(n)),) * 2 if alone else (np.flatnonzero(~second), np.flatnonzero(second))
        if not len(x) or not len(y):
            return none
        t = RTree(rows[x], n[x])
        u = t if alone else RTree(rows[y], n[y])
        if not best_only:
            i, j = tree_join(t, u, comp[x], comp[y], percent)
            return cid[x[i]], cid[y[j]], np.zeros(len(i)), np.zeros(len(i), bool)
        out = []
        best = tree_best(t, u, comp[x], comp[y], percent)
        for side, ((partner, score), own, other) in enumerate(zip(best, (x, y), (y, x))):
            at = np.flatnonzero(partner >= 0)
            back = best[-1 - side][0][partner[at]]  # a single table: its own partners
            mutual = back == at
            once = ~mutual | ((at < partner[at]) if alone else (side == 0))
            at, mutual = at[once], mutual[once]
            out.append((cid[own[at]], cid[other[partner[at]]], score[at], mutual))
        return tuple(np.concatenate(parts) for parts in zip(*out))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
                table = pa.Table.from_batches(held)
                key = np.stack([np.asarray(table.column(c)) for c in range(3)])
                edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
                if len(edge):
                    yield _emit(table.slice(0, edge[-1]), edge[:-1])
                    held = table.slice(edge[-1]).to_batches()
        if held:
            yield _emit(pa.Table.from_batches(held), np.zeros(0, np.int64))

    def _emit(table, edges):
        key_i, key_j = np.asarray(table.column(1)), np.asarray(table.column(2))
        second, cid = np.asarray(table.column(3)), np.asarray(table.column(4))
        comp, n = np.asarray(table.column(5)), np.asarray(table.column(6))
        data = table.column(7).to_pylist()
        bounds = [0, *edges.tolist(), table.num_rows]
        cells_ = np.asarray(table.column(0))
        found, where = [none], [np.zeros(0, np.int64)]
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s > 1:
                found.append(pairs_of(cid[s:e], comp[s:e], n[s:e], data[s:e], second[s:e], key_i[s] == key_j[s]))
                where.append(np.full(len(found[-1][0]), cells_[s]))
        a, b, score, mutual = (np.concatenate(parts) for parts in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(where)), pa.array(a), pa.array(b), pa.array(score), pa.array(mutual)],
            names=["cell", "a", "b", "score", "mutual"])

    return dealt.transform(map_arrow, run, "cell long, a long, b long, score double, mutual boolean").where("a <> b")


def _both_ways(found: DataFrame) -> DataFrame:
    """Proposals with the mutual ones from either side."""
    back = found.where("mutual").select("cell", F.col("b").alias("a"), F.col("a").alias("b"), "score", "mutual")
    return found.unionByName(back)


def _pairs(found: DataFrame, best_only: bool) -> DataFrame:
    if best_only:  # of all its cells, a point keeps its best partner
        found = _both_ways(found).groupBy("a").agg(F.max(F.struct("score", "b")).alias("best")).select("a", "best.b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _few(rows: DataFrame, n: int) -> DataFrame:
    """Rows of ids that were counted: sent to the texts or sets while they are
    few, joined by shuffling both sides beyond that."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs that link."""
    def run(batches):
        for b in batches:
            out = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append(i)
            at = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])
    # only sets that pairs ask for travel: late rounds ask for few
    x = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    y = y.join(_few(pairs.select("b").distinct(), n_pairs), "b", "left_semi")
    return x.join(_few(pairs, n_pairs), "a").join(y, "b").select("a", "b", "x", "y").transform(map_arrow, run, "a long, b long")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4,
                      percent: int = 85, cell_rows: int = CELL_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: id_col, n_shingles, class_id, component_id (the
    smallest id reachable by links, its own included)."""
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).selectExpr("cast(id as long) as id", "cast(text as string) as text")
    profile = landed(_profile(rows, size), "profile")
    mine = profile.where("kind = 0")
    classes = (mine.where("n > 0").groupBy("cid").agg(F.min("id").alias("rep"), F.min("check").alias("c0"),
                                                      F.max("check").alias("c1"))
               .select("cid", F.when(F.col("c0") == F.col("c1"), F.col("rep")).otherwise(
                   F.raise_error(F.lit("two sets of shingles have one class hash")).cast("long")).alias("rep")))
    classes = landed(classes, "classes")
    frequent = (profile.where("kind = 1").groupBy("cid").agg(F.sum("n").alias("n"))
                .orderBy(F.desc("n"), "cid").limit(HOT_SHINGLES).collect())
    late = np.array([r["cid"] for r in frequent], np.int64).view(_U)
    order = np.argsort(late)
    hot = spark.sparkContext.broadcast((late[order], np.array([r["n"] for r in frequent], np.int64)[order]))
    cells = landed(_cells(rows, size, percent, hot), "cells")
    members = landed(cells.select("cid").distinct().join(classes, "cid"), "members")
    n_members = members.count()
    sets = landed(_member_sets(rows, members, n_members, size), "member_sets")
    if sets.count() > n_members:  # rows that share id and text come more than once
        sets = landed(sets.dropDuplicates(["cid"]), "member_sets_once")
    points = sets.select("cid", "n", "point")
    labels, links = None, None
    for k in range(rounds + 1):
        last = k == rounds
        at = (cells.withColumn("component", F.col("cid")) if labels is None else
              cells.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
              .withColumn("component", F.coalesce("component", "cid")))
        found = landed(_proposals(at, points, percent, not last, cell_rows), f"proposals_{k}")
        pairs = landed(_pairs(found, not last), f"pairs_{k}")
        tried = pairs.count()
        if not k and not last:  # a point without any possible partner in a cell leaves it for good
            here = _both_ways(found).select("cell", F.col("a").alias("cid")).distinct()
            cells = landed(cells.join(here, ["cell", "cid"], "left_semi"),
                           "cells_left")
        if not tried:
            break
        good = landed(_verified(pairs, tried, sets, percent), f"good_{k}")
        n_good = good.count()
        if n_good:
            links = good if links is None else links.unionByName(good)
            labels = components(links)
        if last:
            break
        if n_good * 10 < tried:  # merging has slowed down: decide all that is left
            full = landed(_pairs(_proposals(cells.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
                                     .withColumn("component", F.coalesce("component", "cid")) if labels is not None
                                     else at, points, percent, False, cell_rows), False), f"pairs_{k}_all")
            good = landed(_verified(full, full.count(), sets, percent), f"good_{k}_all")
            if good.take(1):
                labels = components(good if links is None else links.unionByName(good))
            break
    named = classes if labels is None else classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid")) if labels is not None else \
        named.withColumn("component", F.col("cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("cid", "component_id")
    return (mine.join(named, "cid", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def oracle_sql(relation: str = "documents", size: int = 4, percent: int = 85) -> str:
    """DuckDB: common table expressions that end in ``joined``."""
    from .common import LOWER, UPPER
    return f"""
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {relation}
), sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {size} + 1, 1) + 1),
         lambda i: array_to_string(w[i:i + {size} - 1], ' '))) AS s
  FROM texts WHERE len(w) > 0
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
       AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY ALL
), links AS (SELECT x, y FROM shared WHERE 100 * k >= {percent} * (nx + ny - k)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT x AS doc_id, y AS other FROM both_ways
  UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
), joined AS (
  SELECT t.doc_id, coalesce(len(s.s), 0) AS n_shingles,
         least(t.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = t.doc_id), t.doc_id)) AS component_id
  FROM texts t LEFT JOIN sets s USING (doc_id)
)"""
