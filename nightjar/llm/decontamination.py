"""Operator 4, benchmark decontamination by Wu-Manber search over words.

Texts are sequences of words (runs of a-z, 0-9 and non-ASCII characters after
A-Z lower-casing). A test item gives its windows of ``window`` consecutive
words; an item with fewer words, but not none, is one window. All windows of
one length form one Wu-Manber searcher:

* a shift table over hashed blocks of two words tells how far the search may
  jump without missing a window (blocks of no window allow the longest jump);
* where the shift is zero, the block's bucket holds the windows that end in
  it, and of these the first word's hash selects;
* the words themselves are then compared, byte for byte.

Documents are searched many at a time, all in step, in segments that overlap,
so a very long text costs no more steps than many short ones. Nothing is
shuffled: the searcher goes to the documents. It is built from blocks of at
most ``max_windows`` windows; a larger benchmark takes several passes, each
with one block in memory, and hits of all passes are united.

Defined results: null or empty text has no words and no hit; a null item id
reads as ``null``; rows that share an id are searched each; an empty benchmark
hits nothing; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, fresh, landed, map_arrow, pick
from .textblocks import ALNUM, blocks, column_bytes, mix64, word_hashes, word_spans

WINDOW = 10
#: Windows of one searcher: at most about 150 MB in a task.
MAX_WINDOWS = 500_000
SEGMENT = 256
_U = np.uint64


class WuManber:
    """Windows of one length: ``texts`` are their words, joined by one space."""

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.m, self.b = texts, length, min(2, length)
        n = len(texts)
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        edges = np.array([0, len(raw)])
        s, e, _ = word_spans(raw, edges, ALNUM)
        self.words = word_hashes(raw, s, e).reshape(n, length)
        size = 1 << max(10, (8 * n * (length - self.b + 1)).bit_length())
        self.mask = _U(size - 1)
        self.shift = np.full(size, length - self.b + 1, np.int32)
        for q in range(length - 1, self.b - 2, -1):  # the block that ends at word q
            at = self._block(self.words[:, q - 1] if self.b == 2 else None, self.words[:, q])
            np.minimum.at(self.shift, at, length - 1 - q)
        last = self._block(self.words[:, -2] if self.b == 2 else None, self.words[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange(size + 1))

    def _block(self, first, second) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = second if first is None else first * _U(0x9E3779B97F4A7C15) + second
            return (mix64(x) & self.mask).astype(np.int64)

    def search(self, words: np.ndarray, first: np.ndarray, end: np.ndarray):
        """(position of the first word, window number) of every occurrence in
        the rows of words [first, end), by word hashes."""
        m = self.m
        counts = np.maximum(end - first - m + 1, 0)
        pieces = -(-counts // SEGMENT)
        row = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = first[row] + (m - 1) + nth * SEGMENT     # position of the window's last word
        stop = np.minimum(at + SEGMENT, end[row])
        ends, keys = [], []
        while len(at):
            block = self._block(words[at - 1] if self.b == 2 else None, words[at])
            jump = self.shift[block]
            zero = jump == 0
            if zero.any():
                ends.append(at[zero])
                keys.append(block[zero])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not ends:
            none = np.zeros(0, np.int64)
            return none, none
        ends, keys = np.concatenate(ends), np.concatenate(keys)
        lo, n = self.bucket[keys], self.bucket[keys + 1] - self.bucket[keys]
        start = np.repeat(ends, n) - m + 1
        which = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        same = self.words[which, 0] == words[start]
        start, which = start[same], which[same]
        for i in range(1, m):
            same = self.words[which, i] == words[start + i]
            start, which = start[same], which[same]
        return start, which


class Searcher:
    def __init__(self, windows: list[tuple[str, list[str]]]):
        by_length: dict[int, list[tuple[bytes, list[str]]]] = {}
        for text, items in windows:
            data = text.encode()
            by_length.setdefault(data.count(b" ") + 1, []).append((data, items))
        self.parts = [(WuManber([t for t, _ in own], n), [items for _, items in own])
                      for n, own in sorted(by_length.items())]

    def column(self, col):
        """For each row: number of words, [(first, end) of occurrences], items."""
        raw, off = column_bytes(col)
        for i, j in blocks(off):
            s, e, rows = word_spans(raw, off[i:j + 1], ALNUM)
            words = word_hashes(raw, s, e)
            cut = np.searchsorted(rows, np.arange(j - i + 1))
            spans: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
            items: list[set[str]] = [set() for _ in range(j - i)]
            for search, own in self.parts:
                start, which = search.search(words, cut[:-1], cut[1:])
                for p, k in zip(start.tolist(), which.tolist()):
                    there = b" ".join(raw[a:b].tobytes().lower() for a, b in zip(s[p:p + search.m], e[p:p + search.m]))
                    if there == search.texts[k]:
                        r = int(rows[p])
                        spans[r].append((p - int(cut[r]), p - int(cut[r]) + search.m))
                        items[r].update(own[k])
            for r in range(j - i):
                yield int(cut[r + 1] - cut[r]), spans[r], items[r]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, *, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """window (words joined by a space), items (distinct ids as strings)."""
    def cut(batches):
        for b in batches:
            raw, off = column_bytes(b.column(1))
            keys = ["null" if k is None else k for k in b.column(0).to_pylist()]
            out_text, out_item = [], []
            for i in range(len(keys)):
                s, e, _ = word_spans(raw, off[i:i + 2], ALNUM)
                words = [raw[x:y].tobytes().lower().decode() for x, y in zip(s.tolist(), e.tolist())]
                for p in range(max(1, len(words) - window + 1) if words else 0):
                    out_text.append(" ".join(words[p:p + window]))
                    out_item.append(keys[i])
            yield pa.RecordBatch.from_pydict({"window": pa.array(out_text, pa.string()),
                                              "item": pa.array(out_item, pa.string())})

    rows = pick(benchmark, item=item_col, text=text_col).selectExpr("cast(item as string) as item",
                                                                    "cast(text as string) as text")
    return (rows.transform(map_arrow, cut, "window string, item string")
            .groupBy("window").agg(F.collect_set("item").alias("items")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text_col: str = "text",
                       out_col: str = "contamination", window: int = WINDOW, item_col: str = "item_id",
                       item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The columns ``keep`` of every document and a struct ``out_col``:
    n_words, n_hit (words inside any occurrence), n_items, items_sha256 (of
    the item ids, sorted as strings, comma-joined), item_ids, contaminated."""
    spark = docs.sparkSession
    keep = [c for c in keep if c != out_col]
    inside = fresh([*keep, out_col], "_text", "_spans", "_items")
    windows = landed(benchmark_windows(benchmark, window, item_col=item_col, text_col=item_text_col), "windows")
    parts = max(1, -(-windows.count() // max_windows))
    part = F.pmod(F.xxhash64("window"), F.lit(parts))
    rows = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].cast("string").alias(inside[0]))
    kept_fields = rows.select(*[rows[f"`{c}`"] for c in keep]).schema.fields
    state = [T.StructField(n, t) for n, t in zip(inside, (
        T.StringType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())))]
    result = T.StructField(out_col, T.StructType.fromDDL(
        "n_words long, n_hit long, n_items long, items_sha256 string, item_ids array<string>, contaminated boolean"))
    for k in range(parts):
        block = [(r["window"], r["items"]) for r in windows.where(part == k).collect()]
        share = spark.sparkContext.broadcast(Searcher(block))
        last = k == parts - 1
        rows = rows.transform(map_arrow, _pass(share, len(kept_fields), k == 0, last, out_col, inside),
                               T.StructType(kept_fields + ([result] if last else state)))
        if not last:
            rows = landed(rows, f"pass_{k}")
    return rows


def _pass(share, n_keep: int, first: bool, last: bool, out_col: str, inside: list[str]):
    def run(batches):
        searcher = share.value
        for b in batches:
            found = list(searcher.column(b.column(n_keep)))
            if not first:
                old = zip(b.column(n_keep + 1).to_pylist(), b.column(n_keep + 2).to_pylist())
                found = [(n, spans + list(zip(s[::2], s[1::2])), items | set(i))
                         for (n, spans, items), (s, i) in zip(found, old)]
            columns = list(b.columns[:n_keep])
            if last:
                columns.append(pa.array([_verdict(*f) for f in found], pa.struct([
                    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                    ("items_sha256", pa.string()), ("item_ids", pa.list_(pa.string())), ("contaminated", pa.bool_())])))
                names = [*b.schema.names[:n_keep], out_col]
            else:
                columns += [b.column(n_keep),
                            pa.array([[x for s in spans for x in s] for _, spans, _ in found], pa.list_(pa.int64())),
                            pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string()))]
                names = [*b.schema.names[:n_keep], *inside]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def _verdict(n_words: int, spans, items) -> dict:
    hit = reach = 0
    for a, b in sorted(spans):
        hit += max(0, b - max(a, reach))
        reach = max(reach, b)
    ids = sorted(items)
    return {"n_words": n_words, "n_hit": hit, "n_items": len(ids), "item_ids": ids, "contaminated": hit > 0,
            "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest()}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (UPPER, LOWER)


def oracle_ctes(relation: str = "documents", window: int = WINDOW) -> str:
    """DuckDB: common table expressions that end in ``verdicts``."""
    return f"""
bench AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item, w, least(len(w), {window}) AS k,
               unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM bench WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM {relation}),
seen AS (
  SELECT rid, k, unnest(list_transform(range(1, len(w) - k + 2),
         lambda i: struct_pack(i := i, s := array_to_string(w[i:i + k - 1], ' ')))) AS x
  FROM docs, (SELECT DISTINCT k FROM win) WHERE len(w) >= k
),
hits AS (SELECT seen.rid, x.i AS i, seen.k, win.item FROM seen JOIN win ON seen.k = win.k AND x.s = win.s),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid),
verdicts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
)"""
