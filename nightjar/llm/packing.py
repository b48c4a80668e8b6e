"""Operator 5, best-fit packing by bin completion (branch and bound).

Documents become token pieces of at most ``capacity`` ids. What is packed is
not the pieces one by one but their histogram of lengths: at most ``capacity``
numbers, whatever the size of the corpus. The plan is a list of fillings with
multiplicities. Pieces get their place in it by their rank among pieces of
the same length, so all per-piece work is distributed, and hot lengths are
ranked in hash buckets.

The search: best-fit decreasing gives the incumbent; if it meets the lower
bound it is optimal. Otherwise bin completion takes the largest remaining
length, enumerates undominated fillings of the rest of its sequence, least
waste first, uses each filling as often as the counts allow, and cuts
branches whose waste could no longer beat the incumbent. ``max_nodes`` bounds
the search; what is returned is then the best solution found.

Defined results: null or empty text is one piece with the end id alone; rows
that share an id are packed each; a null id is carried along; an empty table
gives an empty result. Other columns are ignored.
"""
from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import landed, map_arrow, pick
from .tokens import encoder

CAPACITY = 4096
MAX_NODES, MAX_FILLINGS, DOMINANCE_ITEMS = 400, 6, 6
#: Pieces of one length are ranked in at least so many hash buckets, and one
#: more for every so many pieces of the corpus.
RANK_BUCKETS, RANK_ROWS = 64, 200_000

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


# ---- the plan over the histogram (driver; at most `capacity` lengths) ----

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest sequences that could do: by volume, and by lengths that cannot
    share a sequence (those over ``capacity - k``, with what fits beside them)."""
    if not counts:
        return 0
    size = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        size[n] = c
    volume = size * np.arange(capacity + 1)
    best = -(-int(volume.sum()) // capacity)
    n_up, v_up = np.cumsum(size[::-1])[::-1], np.cumsum(volume[::-1])[::-1]  # of lengths >= i
    half = capacity // 2
    for k in range(1, half + 1):
        alone = int(n_up[capacity - k + 1]) if capacity - k + 1 <= capacity else 0
        big_n = int(n_up[half + 1]) - alone
        big_v = int(v_up[half + 1]) - (int(v_up[capacity - k + 1]) if capacity - k + 1 <= capacity else 0)
        small_v = int(v_up[k] - v_up[half + 1])
        spare = big_n * capacity - big_v
        best = max(best, alone + big_n + max(0, -(-(small_v - spare) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, equal sequences handled together."""
    rooms: list[int] = []                       # sorted distinct free room
    open_by: dict[int, list[list]] = {}         # room -> [[filling, how many]]

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in open_by:
            bisect.insort(rooms, room)
            open_by[room] = []
        open_by[room].append([filling, n])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * length, ((length, each),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            room = rooms[i]
            filling, have = open_by[room][-1]
            each = min(room // length, n)
            use = min(have, n // each)
            if use == have:
                open_by[room].pop()
                if not open_by[room]:
                    del open_by[room], rooms[i]
            else:
                open_by[room][-1][1] -= use
            put(room - each * length, filling + ((length, each),), use)
            n -= use * each
    return [(f, n) for groups in open_by.values() for f, n in groups]


def fillings(counts: dict[int, int], lengths: list[int], room: int, max_waste: int,
             limit: int = MAX_FILLINGS, max_steps: int = 2000) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with at most ``max_waste`` left over,
    least waste first. ``lengths``: those with counts, descending."""
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def grow(at: int, left: int, chosen: list[int]) -> None:
        nonlocal steps
        steps += 1
        if steps > max_steps or len(found) >= 8 * limit:
            return
        i = bisect.bisect_left(lengths, -left, lo=at, key=lambda x: -x)
        fitted = False
        while i < len(lengths) and steps <= max_steps and len(found) < 8 * limit:
            length = lengths[i]
            if chosen.count(length) < counts[length]:
                fitted = True
                chosen.append(length)
                grow(i, left - length, chosen)
                chosen.pop()
                if left == length:  # nothing shorter dominates an exact fit by one document
                    return
            i += 1
        if not fitted and left <= max_waste and not _fits_any(counts, lengths, left, chosen):
            found.append((left, tuple(chosen)))

    grow(0, room, [])
    kept: list[tuple[int, ...]] = []
    for _, f in sorted(found, key=lambda x: (x[0], len(x[1]), [-y for y in x[1]])):
        if not any(_dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == limit:
            break
    return kept


def _fits_any(counts, lengths, left, chosen) -> bool:
    """Whether a document that is left over would still fit."""
    i = bisect.bisect_left(lengths, -left, key=lambda x: -x)
    return any(chosen.count(x) < counts[x] for x in lengths[i:i + len(chosen) + 1])


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the documents of b can be packed into rooms the size of a's
    (asked only of short fillings; longer ones count as undominated)."""
    if len(a) > DOMINANCE_ITEMS or len(b) > DOMINANCE_ITEMS:
        return False

    def place(i: int, rooms: list[int]) -> bool:
        if i == len(b):
            return True
        for j in range(len(rooms)):
            if rooms[j] >= b[i]:
                rooms[j] -= b[i]
                if place(i + 1, rooms):
                    return True
                rooms[j] += b[i]
        return False
    return place(0, list(a))


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[Filling, int]]:
    """Fillings with multiplicities that use up all of ``counts``."""
    best = best_fit(counts, capacity)
    least = sum(n for _, n in best)
    floor = lower_bound(counts, capacity)
    nodes = 0
    left = dict(counts)
    volume = sum(n * c for n, c in counts.items())
    taken: list[tuple[Filling, int]] = []

    def search(used: int, volume: int) -> None:
        nonlocal best, least, nodes
        nodes += 1
        if not volume:
            if used < least:
                best, least = list(taken), used
            return
        if used + -(-volume // capacity) >= least:
            return
        rest = best_fit({n: c for n, c in left.items() if c}, capacity)  # best-fit incumbent of this branch
        n_rest = used + sum(n for _, n in rest)
        if n_rest < least:
            best, least = taken + rest, n_rest
            if least <= floor:
                return
        del rest  # a whole solution: not one for every level of the search
        lengths = sorted((n for n, c in left.items() if c), reverse=True)
        top = lengths[0]
        left[top] -= 1
        lengths = [n for n in lengths if left[n]]
        spare = (least - 1 - used) * capacity - volume  # waste that would still beat the incumbent
        options = fillings(left, lengths, capacity - top, spare)
        left[top] += 1
        for f in options:
            if nodes >= max_nodes or least <= floor:
                return
            need = Counter((top, *f))
            often = min(left[n] // k for n, k in need.items())
            waste = capacity - top - sum(f)
            if waste:
                often = max(1, min(often, spare // waste))
            for n, k in need.items():
                left[n] -= k * often
            taken.append((tuple(sorted(need.items(), reverse=True)), often))
            search(used + often, volume - often * (capacity - waste))
            taken.pop()
            for n, k in need.items():
                left[n] += k * often

    if least > floor:
        import sys
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 4 * max_nodes + 1000))
        try:
            search(0, volume)
        finally:
            sys.setrecursionlimit(limit)
    return best


def slots(fillings_: list[tuple[Filling, int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan by length: runs of ranks that fall into one place of one
    filling. key = length << 40 | first rank, ascending."""
    rank: Counter = Counter()
    rows, base = [], 0
    for filling, n in fillings_:
        offset = 0
        for length, k in filling:
            for _ in range(k):
                rows.append((length << 40 | rank[length], base, offset, rank[length]))
                rank[length] += n
                offset += length
        if offset > capacity:
            raise ValueError("a filling is over capacity")
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": table[:, 0], "base": table[:, 1], "offset": table[:, 2], "first": table[:, 3]}


# ---- pieces (executors) ----

def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, *,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    def cut(batches):
        for batch in batches:
            keys = batch.column(0)
            rows, piece, start, length, crc = [], [], [], [], []
            for first, ids, lens in encoder(tokenizer).column(batch.column(1)):
                data = memoryview(np.insert(ids, np.cumsum(lens), np.uint32(end_id)).astype("<u4").tobytes())
                at = 0
                for r, n in enumerate((lens + 1).tolist(), first):
                    for p, s in enumerate(range(0, n, capacity)):
                        m = min(capacity, n - s)
                        rows.append(r)
                        piece.append(p)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(data[4 * (at + s):4 * (at + s + m)]))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = pick(docs, id=id_col, text=text_col).selectExpr("cast(id as long) as doc_id", "cast(text as string) as text")
    return rows.transform(map_arrow, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, *,
                   id_col: str = "doc_id", text_col: str = "text", max_nodes: int = MAX_NODES,
                   rank_rows: int = RANK_ROWS) -> DataFrame:
    """Every piece with sequence_id and offset (gapless from 0 in a sequence)."""
    spark = docs.sparkSession
    pieces = landed(token_pieces(docs, tokenizer, end_id, capacity, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    share = spark.sparkContext.broadcast(slots(plan(counts, capacity, max_nodes), capacity))
    buckets = RANK_BUCKETS + sum(counts.values()) // rank_rows
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    rows = pieces.withColumn("bucket", bucket)
    before = (rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")
                                                    .rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (rows.withColumn("rank", F.row_number().over(within) - 1)
              .join(before, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")))

    def place(batches):
        t = share.value
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            i = np.searchsorted(t["key"], length << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(t["base"][i] + rank - t["first"][i]), pa.array(t["offset"][i])],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.transform(map_arrow, place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
