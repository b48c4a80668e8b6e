"""Operator 12, ranked lexical search by a hybrid of TAAT and DAAT.

Documents are indexed in segments of bounded size, each one row of a table in
the shared folder; every task of the search reads whole segments, and every
segment answers all queries of a block.

A query on a segment:

* term at a time: its short posting lists (shortest first, together at most
  ``SHORT_SHARE`` of the segment's documents) are summed into accumulators;
* the accumulators become one more iterator beside the long lists. It is
  bounded like they are: every iterator knows its largest score in each window
  of ``WINDOW`` documents;
* document at a time, window by window: windows whose bounds together stay
  under the threshold are skipped; elsewhere iterators whose bounds together
  stay under it only answer look-ups for documents that the others bring up,
  and documents that can no longer reach it are left.

The threshold is the score of the worst document that the query still keeps,
here or in segments searched before. Segments are searched in rounds, each
about four times as large as all before it, so that what segments return
stays near ``k`` rows per query and round. Only what is strictly under the
threshold is skipped: results are exact.

Scores are integers. A term's weight is ``floor(1000 ln((2N + 2) / (2df + 1)))``,
a document's norm ``m = 50 + (50 n N) div L``, and the score sums
``weight * ((10^9 tf) div (1000 tf + 20 m))`` over a query's distinct terms.

Queries are taken in blocks of about ``BLOCK_TERMS`` distinct terms, so what a
task holds does not grow with the number of queries.

Defined results: null and empty texts hold no term; documents without a term
count in no statistic and are never returned; a query without a term, or one
whose terms no document holds, returns nothing. Rows that share an id are
documents (or queries) of their own. Equal scores rank by ascending id, null
last. An empty table on either side gives an empty result. Other columns are
ignored.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_lower, landed, map_arrow, pick, scratch_dir
from .textparts import parts

K = 50
SEGMENT_BYTES = 16 << 20
BLOCK_TERMS = 200_000
SHORT_SHARE, WINDOW = 0.25, 1024
#: Folders that segments are dealt into; a round searches some of them.
SLOTS = 64
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")

INDEX = ("term array<int>, n_docs array<int>, doc array<int>, tf array<int>, n array<int>, "
         "docs long, terms long, slot int")


def terms(text: bytes) -> Iterable[list[bytes]]:
    """Lists of a text's terms, part by part (bytes: only A-Z are lowered)."""
    return (_TERM.findall(part) for part in parts(text.lower(), _BETWEEN))


# ---- index ----

class _Segment:
    """Postings of the wanted terms of some documents."""

    def __init__(self):
        self.ids, self.n, self.key, self.tf, self.bytes = [], [], [], [], 0

    def add(self, doc_id, text: bytes, number: dict[bytes, int]) -> None:
        n, found = 0, []
        for some in terms(text):
            n += len(some)
            found += [t for t in map(number.get, some) if t is not None]
        if found:
            term, tf = np.unique(np.array(found, np.int64), return_counts=True)
            self.key.append(term << 32 | len(self.ids))
            self.tf.append(tf)
        self.ids.append(doc_id)
        self.n.append(n)
        self.bytes += len(text) + 64

    def row(self) -> list:
        """The index row; documents are numbered by ascending id, null last."""
        by_id = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        key = np.concatenate([*self.key, np.zeros(0, np.int64)])
        key = key >> 32 << 32 | place[key & 0xFFFFFFFF]
        order = np.argsort(key)
        term, count = np.unique(key >> 32, return_counts=True)
        tf = np.concatenate([*self.tf, np.zeros(0, np.int64)])
        n = np.array(self.n, np.int64)[by_id]
        return [[self.ids[i] for i in by_id], term, count, key[order] & 0xFFFFFFFF, tf[order], n,
                int((n > 0).sum()), int(n.sum())]


def build_index(docs: DataFrame, number: dict[bytes, int], *, id_col: str = "doc_id", text_col: str = "text",
                segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row for each segment: by wanted term the documents that hold it
    (``term``, ``n_docs``, ``doc``, ``tf``), the documents' ids and lengths,
    how many hold a term, and all their terms."""
    rows = pick(docs, ids=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["ids"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL(INDEX).fields])
    id_list = to_arrow_type(T.ArrayType(kind))
    share = docs.sparkSession.sparkContext.broadcast(number)  # at most BLOCK_TERMS terms and one query's

    def index(batches):
        from pyspark import TaskContext
        part, made, segment = TaskContext.get().partitionId(), 0, _Segment()

        def out():
            ids, term, count, doc, tf, n, n_docs, n_terms = segment.row()
            flat = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (term, count, doc, tf, n)]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], id_list), *flat, pa.array([n_docs]), pa.array([n_terms]),
                 pa.array([(part * 37 + made * 11) % SLOTS], pa.int32())],
                names=["ids", "term", "n_docs", "doc", "tf", "n", "docs", "terms", "slot"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"", share.value)
                if segment.bytes >= segment_bytes:
                    yield out()
                    made, segment = made + 1, _Segment()
        if segment.ids:
            yield out()

    return map_arrow(rows, index, schema)


# ---- search in a segment ----

class Lists:
    """A segment's posting lists with contributions and bounds by window."""

    def __init__(self, term, n_docs, doc, tf, n, total_docs: int, total_terms: int, window: int = WINDOW):
        self.size = len(n)
        self.window = window
        self.windows = -(-self.size // window)
        self.doc = np.asarray(doc, np.int64)
        tf = np.asarray(tf, np.int64)
        norm = 50 + 50 * np.asarray(n, np.int64) * total_docs // max(total_terms, 1)
        self.part = 10**9 * tf // (1000 * tf + 20 * norm[self.doc])
        ends = np.cumsum(np.asarray(n_docs, np.int64))
        self.span = {int(t): (int(e - c), int(e)) for t, c, e in zip(term, n_docs, ends)}

    def bounds(self, docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one iterator: where each window starts, and its largest score there."""
        cut = np.searchsorted(docs, np.arange(self.windows + 1) * self.window)
        top = np.zeros(self.windows, np.int64)
        full = np.flatnonzero(cut[1:] > cut[:-1])
        if len(full):
            top[full] = np.maximum.reduceat(scores, cut[full])
        return cut, top

    def search(self, query: list[tuple[int, int]], k: int, floor: int = 0,
               short_share: float = SHORT_SHARE) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best ``k`` (ties: smaller documents) of
        score at least ``floor`` and over 0. query: (term, weight)."""
        lists = sorted((self.span[t][1] - self.span[t][0], t, w) for t, w in query if w and t in self.span)
        # term at a time
        sums, room, at = np.zeros(self.size, np.int64), short_share * self.size, 0
        while at < len(lists) and lists[at][0] <= room:
            n, t, w = lists[at]
            i, j = self.span[t]
            sums[self.doc[i:j]] += w * self.part[i:j]
            room -= n
            at += 1
        held = np.flatnonzero(sums)
        its = [(held, sums[held])] if len(held) else []
        for _, t, w in lists[at:]:
            i, j = self.span[t]
            its.append((self.doc[i:j], w * self.part[i:j]))
        if not its:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges, tops = zip(*(self.bounds(*it) for it in its))
        tops = np.array(tops)
        total = tops.sum(axis=0)
        best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = max(floor, 1)
        # document at a time; windows of high bounds first, which raises the threshold early
        for b in np.argsort(-total, kind="stable"):
            if total[b] < least:
                break
            order = np.argsort(tops[:, b], kind="stable")
            below = np.cumsum(tops[order, b])
            passive = int(np.searchsorted(below, least))  # their bounds together stay under the threshold
            base = b * self.window
            score = np.zeros(self.window, np.int64)
            for x in order[passive:]:
                i, j = edges[x][b], edges[x][b + 1]
                score[its[x][0][i:j] - base] += its[x][1][i:j]
            cand = np.flatnonzero(score)
            for p in range(passive - 1, -1, -1):
                cand = cand[score[cand] + below[p] >= least]
                if not len(cand):
                    break
                docs, scores = its[order[p]]
                i, j = edges[order[p]][b], edges[order[p]][b + 1]
                if i == j:
                    continue
                spot = np.minimum(np.searchsorted(docs[i:j], cand + base), j - i - 1) + i
                hit = docs[spot] == cand + base
                score[cand[hit]] += scores[spot[hit]]
            cand = cand[score[cand] >= least]
            if len(cand):
                best_doc, best = np.append(best_doc, cand + base), np.append(best, score[cand])
                if len(best) >= k:
                    stay = np.lexsort((best_doc, -best))[:k]
                    best_doc, best = best_doc[stay], best[stay]
                    least = max(least, int(best[-1]))
        return best_doc, best


# ---- search over all segments ----

#: The same terms as ``_TERM``, for Spark and for SQL.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def weight(total_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def _rounds(slots: dict[int, int], first: int) -> list[list[int]]:
    """Slots by round: ``first`` segments or more, then three times as many as
    all before."""
    out: list[list[int]] = []
    seen = aim = 0
    for slot, n in sorted(slots.items()):
        if seen >= aim:
            out.append([])
            aim = max(first, 4 * seen)
        out[-1].append(slot)
        seen += n
    return out


def _best(rows: DataFrame, k: int) -> DataFrame:
    """What is left to rank is about 4k rows a query, and less beforehand in each task."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.select("query", "doc_id", "score", F.row_number().over(by).alias("rank")).where(F.col("rank") <= k)


def _searched(segments: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], floor: dict[int, int], k: int,
              total_docs: int, total_terms: int, window: int) -> DataFrame:
    """query, doc_id, score: what each of the segments brings up."""
    share = segments.sparkSession.sparkContext.broadcast((queries, floor))  # a block of queries

    def search(batches):
        queries, floor = share.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids, *flat = (batch.column(i)[r].values for i in range(6))
                lists = Lists(*(np.asarray(x) for x in flat), total_docs, total_terms, window)
                number, docs, scores = [], [], []
                for q, query in queries:
                    doc, score = lists.search(query, k, floor.get(q, 0))
                    number.append(np.full(len(doc), q, np.int64))
                    docs.append(doc)
                    scores.append(score)
                if queries:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(number)), ids.take(pa.array(np.concatenate(docs))),
                         pa.array(np.concatenate(scores))], names=["query", "doc_id", "score"])
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    return map_arrow(segments.select("ids", "term", "n_docs", "doc", "tf", "n"), search,
                     f"query long, doc_id {kind}, score long")


def _search_block(docs: DataFrame, block: list[tuple[int, list[str]]], k: int, id_col: str, text_col: str,
                  segment_bytes: int, window: int) -> DataFrame:
    """query, doc_id, score, rank of a block of queries."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
    made = build_index(docs, {t.encode(): i for t, i in number.items()}, id_col=id_col, text_col=text_col,
                       segment_bytes=segment_bytes)
    path = scratch_dir(spark, "segments")
    made.write.partitionBy("slot").parquet(path)
    index = spark.read.schema(made.schema).parquet(path)
    total = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    total_docs, total_terms = total["docs"] or 0, total["terms"] or 0
    held = index.select(F.inline(F.arrays_zip("term", "n_docs"))).groupBy("term").agg(F.sum("n_docs").alias("n"))
    df = {r["term"]: r["n"] for r in held.collect()}
    queries = [(q, [(number[t], weight(total_docs, df[number[t]])) for t in ts if number[t] in df]) for q, ts in block]
    slots = {r["slot"]: r["count"] for r in index.groupBy("slot").count().collect()}
    best = spark.createDataFrame([], f"query long, doc_id {made.schema['ids'].dataType.elementType.simpleString()}, "
                                     "score long, rank int")
    floor: dict[int, int] = {}
    for chosen in _rounds(slots, spark.sparkContext.defaultParallelism):
        found = _searched(index.where(F.col("slot").isin(chosen)), queries, floor, k, total_docs, total_terms, window)
        best = landed(_best(best.select("query", "doc_id", "score").unionByName(found), k), "ranked")
        floor = {r["query"]: r["score"] for r in best.where(F.col("rank") == k).select("query", "score").collect()}
    return best


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "doc_id", text_col: str = "text",
                   query_id_col: str = "item_id", query_text_col: str = "text", block_terms: int = BLOCK_TERMS,
                   segment_bytes: int = SEGMENT_BYTES, window: int = WINDOW) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every query."""
    asked = pick(queries, item_id=query_id_col, text=query_text_col)
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit(TERM_PATTERN), F.lit(0)))
    asked = landed(asked.select(F.monotonically_increasing_id().alias("query"), "item_id", found.alias("terms"))
                   .where(F.size("terms") > 0), "queries")
    blocks = -(-(asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0) // block_terms)
    out = None
    for b in range(max(blocks, 1)):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1))) == b).select("query", "terms").collect()
        best = _search_block(docs, [(r["query"], r["terms"]) for r in block], k, id_col, text_col, segment_bytes, window)
        out = best if out is None else out.unionByName(best)
    return out.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}') AS ts
  FROM documents),
s AS (SELECT count(*) AS N, sum(len(ts))::BIGINT AS L FROM d WHERE len(ts) > 0),
m AS (SELECT r, doc_id, 50 + (50 * len(ts)::BIGINT * N) // L AS m FROM d, s WHERE len(ts) > 0),
q AS (SELECT DISTINCT r, item_id, unnest(ts) AS t FROM (SELECT row_number() OVER () AS r, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}') AS ts
  FROM benchmark)),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
scored AS (SELECT q.r AS q, q.item_id, m.doc_id, p.r,
    sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)))::BIGINT AS score
  FROM q JOIN p ON p.t = q.t JOIN w ON w.t = q.t JOIN m ON m.r = p.r GROUP BY q.r, q.item_id, m.doc_id, p.r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank,
    doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}"""
