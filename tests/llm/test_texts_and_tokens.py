"""Word blocks and cached tokenizing against plain Python and the library."""
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nightjar.llm import textblocks as tb
from nightjar.llm.queries import tokenizer_path
from nightjar.llm.tokens import UnitEncoder, UnitTable

TEXT = st.text(alphabet=st.sampled_from(list("abAZ09 \n\t.,'!|<>é́  \u0000中İ\x1f")), max_size=60)
PATTERNS = [(tb.SPACED, r"[^\x20\x09-\x0D]+"), (tb.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_the_patterns_words(texts):
    col = pa.array(texts, pa.string())
    for table, pattern in PATTERNS:
        raw, off = tb.column_bytes(col)
        s, e, rows = tb.word_spans(raw, off, table)
        got = [[] for _ in texts]
        for a, b, r in zip(s, e, rows):
            got[r].append(raw[a:b].tobytes().decode().translate({i: i + 32 for i in range(65, 91)}))
        assert got == [re.findall(pattern, lowered(t or "")) for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    raw, off = tb.column_bytes(pa.array(["Alpha beta", "x beta ALPHA", "betaalpha"]))
    s, e, _ = tb.word_spans(raw, off, tb.SPACED)
    h = tb.word_hashes(raw, s, e)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_sliced_and_long_columns():
    long = "w" * 3 + " " + "ab " * 800_000  # longer than a block
    col = pa.array(["skip", "one two", long, None])[1:]
    sets = list(tb.shingle_sets(col, 2))
    assert [len(s) for s in sets] == [1, 2, 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_librarys_ids(name):
    encoder = UnitEncoder(tokenizer_path(name), slots=256)  # emptied again and again

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.none(), TEXT, st.just("a <|endoftext|> b"), st.just("don't 's  x\n\ny")), max_size=5))
    def same(texts):
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        got = []
        for _, ids, lens in encoder.column(pa.array(texts, pa.string())):
            got += [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] if len(lens) else []
        assert got == want
    same()


def test_unit_table_keeps_what_it_was_given():
    t = UnitTable(64)
    h = np.arange(1, 31, dtype=np.uint64) * np.uint64(64)  # all want one slot
    raw = np.frombuffer("".join(f"unit number {i:02d}" for i in range(30)).encode(), np.uint8)
    starts, lens = np.arange(30) * 14, np.full(30, 14)
    t.add(h, tb.lanes(raw), starts, lens, np.arange(60, dtype=np.uint32), np.full(30, 2))
    entry = t.find(h)
    assert (t.ids.data[t.id_at.data[entry]] == np.arange(30) * 2).all() and (t.n_ids.data[entry] == 2).all()
    assert t.is_unit(entry, tb.lanes(raw), starts, lens).all()
    assert not t.is_unit(entry, tb.lanes(raw), starts, lens - 1).any()
    assert not t.is_unit(entry, tb.lanes(raw), np.roll(starts, 1), lens).any()
    assert (t.find(np.array([7], np.uint64)) == -1).all() and t.room() == 2


def thue_morse(n):
    """Two texts that meet under every polynomial hash modulo 2^64."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=2, max_size=12))
def test_hashes_tell_slices_apart_wherever_they_stand(slices):
    raw = np.frombuffer(b"".join(slices) + b"".join(reversed(slices)), np.uint8)
    n = np.array([len(x) for x in slices] + [len(x) for x in reversed(slices)])
    ends = np.cumsum(n)
    for seed in (0, 1):
        h = tb.slice_hashes(raw, ends - n, ends, seed=seed).tolist()
        assert len(set(h)) == len(set(slices)) and h[:len(slices)] == h[len(slices):][::-1]


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_thue_morse_words_are_two_words(n):
    a, b = thue_morse(n)
    sets = list(tb.shingle_sets(pa.array([a, b]), 4, seeds=(0, 1)))
    assert sets[0][0][0] != sets[1][0][0] and sets[0][1][0] != sets[1][1][0] and sets[0][0][0] != sets[0][1][0]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = UnitEncoder(tokenizer_path(name))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b)]
        (_, ids, lens), = encoder.column(pa.array([a, b]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want


@pytest.mark.parametrize("bits", [0, 3])
def test_units_that_share_a_hash_keep_their_own_ids(monkeypatch, bits):
    from nightjar.llm import tokens
    monkeypatch.setattr(tokens, "slice_hashes", lambda r, s, e, f=tokens.slice_hashes: f(r, s, e) >> np.uint64(64 - bits) if bits else np.zeros(len(s), np.uint64))
    encoder = UnitEncoder(tokenizer_path("byte_bpe_50k.json"), slots=64)
    texts = ["alpha beta gamma alpha", "beta delta", "x" * 100 + " " + "y" * 100, "y" * 100, None, "gamma alpha"]
    for _ in range(3):
        (_, ids, lens), = encoder.column(pa.array(texts))
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want


def test_memory_of_an_encoder_stays_small(monkeypatch):
    encoder = UnitEncoder(tokenizer_path("byte_bpe_50k.json"), slots=1 << 14)
    sizes = []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return library.encode_batch_fast(texts, **options)
    library, encoder.tokenizer = encoder.tokenizer, Spy()
    words = [f"unit{i}q" for i in range(12_000)]
    texts = [" ".join(words[i:i + 6000]) for i in (0, 6000, 0)]
    for _, ids, lens in encoder.column(pa.array(texts, pa.string())):
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert max(sizes) <= 2048 < sum(sizes)
    for t in texts:  # one generation is full, its table keeps no spare room
        list(encoder.column(pa.array([t], pa.string())))
    encoder.column(pa.array(["x"]))
    old = encoder.old
    pools = [old.ids, old.lanes, old.id_at, old.lane_at, old.n_ids, old.n_bytes]
    assert old.id_at.n and all(len(p.data) == p.n for p in pools)
    assert sum(p.data.nbytes for p in pools[2:]) <= 10 * old.id_at.n


def test_a_worker_that_reads_holds_no_encoder():
    from nightjar.llm import tokens
    assert tokens.encoder(tokenizer_path("byte_bpe_50k.json")) is tokens.encoder(tokenizer_path("byte_bpe_50k.json"))
    tokens.forget_encoders()
    assert not tokens._ENCODERS
