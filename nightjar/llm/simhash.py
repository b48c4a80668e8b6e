"""Operator 11, near duplicates by SimHash with a segment-popcount embedding.

A text's fingerprint has 64 bits: of the XXH64 values (seed 42) of its word
shingles, repeats included, a bit is 1 if it is 1 in over half of them. Texts
link when their fingerprints differ in at most ``distance`` bits (0 to 2).

* Embedding: a fingerprint is cut into ``SEGMENTS`` segments; the numbers of 1
  bits by segment are its point. One differing bit moves one coordinate by one,
  so the Manhattan distance of two points is at most the Hamming distance of
  the fingerprints: a lower bound.
* Grid range join: cells are the lattice points. Two points within a distance
  of 2 have a lattice point between them that is within 1 of both, so every
  point goes into its own cell and the cells one step away, and partners meet
  in a cell. Cells with one member (nearly all) end in the count.
* Verification: in cells of up to ``CELL_MEMBERS`` members the pairs are
  compared bit by bit. Members of larger cells are embedded again in segments
  of one bit. There a cell's members lie within one bit of the cell itself, so
  any two are within 2: the cell is verified as such, has at most 65 members,
  and needs one link to its smallest member instead of all pairs.
* Only distinct fingerprints take part; copies, however many, are one point.

Defined results: null and empty texts, and texts without a word, have the
fingerprint zero, which links like any other. Fewer words than a shingle needs
are one shingle. Rows that share an id are fingerprinted each. A null id is
carried along; a component of null ids alone has a null id. An empty table
gives an empty result. Other columns are ignored.
"""
from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed, map_arrow, pick
from .components import components
from .textparts import parts

SHINGLE_WORDS, DISTANCE, SEED = 3, 2, 42
#: 32 segments of 2 bits: 65 cells a fingerprint, and two random ones are within
#: a Manhattan distance of 2 with a chance of 2e-11.
SEGMENTS = 32
CELL_MEMBERS = 16
BITS = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---- fingerprints ----

def shingles(text: bytes, size: int = SHINGLE_WORDS):
    """Lists of the shingles of a text (A-Z lower-cased), part by part."""
    carry: list[bytes] = []
    whole = False
    for part in parts(text.lower(), _SPACE):  # bytes: only A-Z change
        words = carry + part.split()          # bytes: splits at \x20 and \x09-\x0D
        if len(words) < size:
            carry = words
            continue
        whole = True
        yield list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
        carry = words[len(words) - size + 1:]
    if carry and not whole:
        yield [b" ".join(carry)]


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for some in shingles(text, size):
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), "<u8", len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, mark (the fingerprint as a signed long) of every row."""
    def mark(batches):
        for batch in batches:
            marks = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))],
                                             names=["doc_id", "mark"])
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    return map_arrow(rows, mark, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long")


# ---- embedding and grid ----

def cells(marks: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of its mark): the cells of every mark's point and of the
    lattice points one step away. Steps that leave the range of a coordinate
    lie between no two points."""
    width = BITS // segments
    bits = np.unpackbits(marks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    point = bits.reshape(len(marks), segments, width).sum(axis=2, dtype=np.int64)
    with np.errstate(over="ignore"):
        place = np.uint64(width + 1) ** np.arange(segments, dtype=np.uint64)
        own = (point.astype(np.uint64) * place).sum(axis=1, dtype=np.uint64)
        index = np.arange(len(marks))
        out, of = [own], [index]
        for i in range(segments):
            up, down = point[:, i] < width, point[:, i] > 0
            out += [own[up] + place[i], own[down] - place[i]]
            of += [index[up], index[down]]
    return np.concatenate(out), np.concatenate(of)


def _dealt(marks: DataFrame, segments: int) -> DataFrame:
    """cell, mark: 65 rows at most for each mark."""
    def deal(batches):
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(own), 4096):
                some = own[at:at + 4096]
                cell, of = cells(some, segments)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(some[of].view(np.int64))],
                                                 names=["cell", "mark"])
    return map_arrow(marks.select("mark"), deal, "cell long, mark long")


def _near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(marks: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS,
          cell_members: int = CELL_MEMBERS) -> DataFrame:
    """a, b: links between distinct marks that join all that are within
    ``distance`` bits of each other, directly or by other links."""
    if not 0 <= distance <= 2:
        raise ValueError("cells one step away hold partners up to a distance of 2")
    if distance == 0:
        return marks.select(F.col("mark").alias("a"), F.col("mark").alias("b")).limit(0)
    counted = landed(_dealt(marks, segments).groupBy("cell")
                     .agg(F.count("*").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b"))
                     .where("n > 1"), "simhash_cells")
    # two members are the pair itself
    found = counted.where("n = 2").where(_near("a", "b", distance)).select("a", "b")
    members = landed(_dealt(marks, segments).join(counted.where("n > 2").select("cell", "n"), "cell"), "simhash_members")
    few = members.where(F.col("n") <= cell_members).select("cell", "mark")
    found = found.unionByName(
        few.withColumnRenamed("mark", "a").join(few.withColumnRenamed("mark", "b"), "cell")
        .where((F.col("a") < F.col("b")) & _near("a", "b", distance)).select("a", "b"))
    many = members.where(F.col("n") > cell_members).select("mark").distinct()
    if distance == 2:
        # cells of single bits: all members within 2 of each other, at most 65
        fine = _dealt(many, BITS)
        hub = fine.groupBy("cell").agg(F.min("mark").alias("a"), F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(fine.join(hub, "cell").where("mark <> a").select("a", F.col("mark").alias("b")))
    else:
        # one differing bit: a mark and the marks one flip away
        flips = many.select("mark", F.explode(F.expr(f"transform(sequence(0, {BITS - 1}), i -> mark ^ shiftleft(1L, i))")).alias("b"))
        found = found.unionByName(flips.join(many.withColumnRenamed("mark", "b"), "b").where("mark < b")
                                  .select(F.col("mark").alias("a"), "b"))
    return found.distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                    distance: int = DISTANCE, segments: int = SEGMENTS, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = landed(fingerprints(docs, id_col=id_col, text_col=text_col, size=size), "simhash_rows")
    points = landed(rows.groupBy("mark").agg(F.min("doc_id").alias("least")), "simhash_points")
    placed = components(links(points, distance, segments, cell_members)).withColumnRenamed("node", "mark")
    placed = landed(placed.join(points, "mark"), "simhash_placed")
    by = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = placed.join(by, "component").select("mark", "component_id")
    of = points.join(linked, "mark", "left").select("mark", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(of, "mark").select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")
