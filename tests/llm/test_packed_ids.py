"""Operator 9: packing round trips, files, random access."""
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nightjar.llm import packed_ids as P
from nightjar.llm.queries import tokenizer_path

BYTES = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("vocabulary,bits", [(1, 1), (2, 1), (3, 2), (50_257, 16), (65_536, 16), (65_537, 17), (2**32, 32)])
def test_fewest_bits(vocabulary, bits):
    assert P.id_bits(vocabulary) == bits


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_round_trip(bits, values):
    ids = np.array(values, "<u4") & np.uint32((1 << bits) - 1)
    data = P.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (P.unpack(data, bits, len(ids)) == ids).all()


class Bytes:
    def __init__(self, data):
        self.data, self.read = data, []

    def read_at(self, n, at):
        self.read.append((at, n))
        return self.data[at:at + n]


def test_file_and_random_access():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 1000, n).astype("<u4") for n in (0, 5, 64, 1, 300, 64, 0, 17, 0)]
    out = io.BytesIO()
    w = P.IdWriter(out, 10, block_ids=64)
    for lo, hi in ((0, 3), (3, 9)):
        own = docs[lo:hi]
        w.add(np.arange(lo, hi), np.zeros(hi - lo, bool), np.concatenate(own), np.array([len(d) for d in own]))
    assert w.close() == (9, 451)
    file = Bytes(out.getvalue())
    reader = P.IdReader(file, len(file.data))
    assert [reader.document(i).tolist() for i in range(9)] == [d.tolist() for d in docs]
    assert list(reader.crcs()) == [zlib.crc32(d.tobytes()) for d in docs]
    file.read.clear()
    reader.document(3)  # one id: one block
    assert file.read == [(int(reader.offsets[1]), 80)]
    with pytest.raises(ValueError):
        P.IdReader(Bytes(file.data[:-1]), len(file.data) - 1)


ROWS = [(i * 7 % 101, f"text {i} " * (i % 40)) for i in range(101)] + [(500, None), (501, ""), (None, "null id"), (None, "another"),
                                                                       (502, "b"), (502, "a"), (503, "many words " * 40_000)]


def test_documents_come_back_in_order(spark, tmp_path):
    t = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, part int, path string").repartition(7)
    manifest = P.write_ids(docs, f"file://{tmp_path}/ids", BYTES, end_id=0, vocabulary=50_257, partitions=5, block_ids=100)
    got = P.read_ids(spark, manifest).orderBy("start").collect()
    at, want = 0, []
    for key, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    files = sorted(manifest.collect(), key=lambda f: f.part)
    assert not list(tmp_path.glob("ids/_writing*")) and len(list(tmp_path.glob("ids/ids-*"))) == len(files)
    last = files[-1]
    ids = P.read_document(last.path, last.n_docs - 1)
    assert zlib.crc32(ids.astype("<u4").tobytes()) == want[-1][3]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = P.write_ids(docs, f"{tmp_path}/none", BYTES, end_id=0, vocabulary=50_257)
    df = P.read_ids(spark, manifest)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and df.count() == 0
