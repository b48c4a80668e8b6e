"""Operator 13, spelling variants by finite-state composition.

Words that differ by exactly one inserted, deleted or replaced code point are
near. They are found by composing three machines: the minimised acceptor of the
vocabulary, a one-edit transducer, and the acceptor again. A state of the
composition is (state of the first acceptor, edits so far, state of the
second). Before the edit both acceptors read the same letters and, being
deterministic, stand in the same state; after it both must read the same rest,
so what remains is the common language of two states.

Where the machines stand: the edit lies at some place of the word, and all
around it both words agree. A partition is a class of lengths, a gap [s, e),
and the letters before and after the gap; it holds the words with these outer
letters. Its initial state is the one behind the letters before the gap, from
where the pairs are enumerated whose edit lies in the gap. A word of n code points is in the classes n
(as the shorter or equal word) and n - 1 (as the longer one). Partitions start
as whole classes; those of over ``MAX_WORDS`` words are dealt anew by the two
halves of their gap, so that more letters must agree, down to gaps of one
letter, whose words are bounded by the alphabet. Every pair is found in one
partition: that of its class and of the gap that holds the length of its
longest common prefix. No two words of a hot partition are compared one by one.

A word's form is its near word of largest count (ties: the smallest in
code-point order) if that is at least ``RATIO`` times its own; the root follows
forms to the last. Counts grow tenfold each step, so chains are short.

Defined results: null and empty texts hold no word; a null id counts as an
empty one; rows that share an id are counted each; an empty table gives an
empty result; other columns are ignored.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, landed, map_arrow, pick

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
MAX_WORDS = 4096
RUN = r"[A-Za-zÀ-ÿ]+"
#: One run in so many loses a code point.
DROP_EVERY = 31


# ---- vocabulary ----

def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, drop_every: int | None = DROP_EVERY) -> DataFrame:
    """word, n of every word: runs of letters, A-Z lower-cased; where
    ``drop_every`` divides the crc32 of ``<doc_id>:<run>``, without the code
    point that it names."""
    rows = pick(docs, id=id_col, text=text_col).select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    rows = rows.where(F.length("run") >= min_length).select("id", ascii_lower(F.col("run")).alias("run"))
    if drop_every:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        rows = rows.selectExpr("id", "run", f"h % {int(drop_every)} = 0 as cut", "cast(h % length(run) as int) as at")
        rows = rows.selectExpr("if(cut, concat(substring(run, 1, at), substring(run, at + 2)), run) as word")
    else:
        rows = rows.withColumnRenamed("run", "word")
    return (rows.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


# ---- machines ----

class Acceptor:
    """Minimal deterministic acyclic acceptor of some words, built from their
    sorted order. ``arcs[q]``: letter -> state; ``final[q]``: the word that ends
    there may be any that leads to q."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        open_: list[tuple[dict[str, int], bool]] = [({}, False)]  # states of the last word, not yet fixed
        last = ""
        for word in sorted(words):
            common = 0
            while common < len(last) and common < len(word) and last[common] == word[common]:
                common += 1
            self._fix(open_, last, common)
            open_ += [({}, False) for _ in range(len(word) - common)]
            open_[-1] = (open_[-1][0], True)
            last = word
        self._fix(open_, last, 0)
        self.start = self._state(*open_[0])

    def _fix(self, open_, last: str, keep: int) -> None:
        for i in range(len(last), keep, -1):
            state = self._state(*open_.pop())
            open_[i - 1][0][last[i - 1]] = state

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self._known[key]


class Composition:
    """acceptor o one edit o acceptor. Walks keep one path of letters and a
    stack, so words may be of any length."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self._meet: dict[tuple[int, int], bool] = {}

    def _meets(self, p: int, q: int) -> bool:
        """Whether both states accept some word."""
        arcs, final, known = self.a.arcs, self.a.final, self._meet
        stack = [(p, q)]
        while stack:
            x, y = key = stack[-1]
            if key not in known:
                if x == y or final[x] and final[y]:
                    known[key] = True
                else:
                    small, large = sorted((arcs[x], arcs[y]), key=len)
                    after = [(to, large[c]) for c, to in small.items() if c in large]
                    if any(known.get(k) for k in after):
                        known[key] = True
                    elif open_ := next((k for k in after if k not in known), None):
                        stack.append(open_)
                        continue
                    else:
                        known[key] = False
            stack.pop()
        return known[p, q]

    def rests(self, p: int, q: int, but: str = ""):
        """What both states accept (after the edit both read the same), without
        what begins with the letter ``but``."""
        if not self._meets(p, q):
            return
        path: list[str] = []
        stack = [(p, q, 0, "")]
        while stack:
            x, y, depth, letter = stack.pop()
            del path[max(depth - 1, 0):]
            path.append(letter)
            if self.a.final[x] and self.a.final[y]:
                yield "".join(path)
            small, large = sorted((self.a.arcs[x], self.a.arcs[y]), key=len)
            for c, to in small.items():
                if c in large and (depth or c != but) and self._meets(to, large[c]):
                    stack.append((to, large[c], max(depth, 1) + 1, c))

    def pairs(self, places: int, after: str = ""):
        """(word, word) with exactly one edit whose place, the length of their
        longest common prefix, is under ``places``. ``after``: what follows in
        every word. Of unequal lengths the longer word comes first, else the
        smaller one."""
        path: list[str] = []
        stack = [(self.a.start, 0, "")]
        while stack:
            q, depth, letter = stack.pop()
            del path[max(depth - 1, 0):]
            path.append(letter)
            arcs = sorted(self.a.arcs[q].items())
            for i, (c, to) in enumerate(arcs):
                for d, other in arcs[i + 1:]:                       # c replaced by d
                    for rest in self.rests(to, other):
                        read = "".join(path)
                        yield read + c + rest, read + d + rest
                for rest in self.rests(to, q, but=c):               # c deleted; its place is the last of a run of c
                    if rest or after[:1] != c:
                        read = "".join(path)
                        yield read + c + rest, read + rest
            if depth + 1 < places:
                stack += [(to, depth + 1, c) for c, to in arcs]


# ---- partitions ----

def _halves(rows: DataFrame) -> DataFrame:
    """Rows (class, s, e, word) by both halves of their gap."""
    mid = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
    return rows.select("class", "word", F.explode(F.array(F.struct("s", mid.alias("e")), F.struct(mid.alias("s"), "e")))
                       .alias("g")).select("class", "g.s", "g.e", "word")


def _key():
    """Class, gap, and the letters around it."""
    return F.concat_ws(":", "class", "s", "e", F.expr("substring(word, 1, s)"),
                       F.expr("substring(word, length(word) - (class - e) + 1)"))


def near_pairs(words: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """a, b: every unordered pair of near words, once. words: distinct ``word``."""
    n = F.length("word")
    # the edit of a longer word may lie behind the shorter one's last letter: e = class + 1
    rows = words.select("word", F.explode(F.array(n, n - 1)).alias("class")).where("class > 0").select(
        "class", F.lit(0).alias("s"), (F.col("class") + 1).alias("e"), "word")
    done = []
    while True:
        keyed = landed(rows.withColumn("key", _key()), "spelling_rows")
        size = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("s").alias("s_"), F.max("e").alias("e_"))
        size = landed(size.where("n > 1"), "spelling_sizes")
        hot = (F.col("n") > max_words) & (F.col("e_") - F.col("s_") > 1)
        done.append(keyed.join(size.where(~hot).select("key"), "key"))
        if not size.where(hot).take(1):
            break
        rows = _halves(keyed.join(size.where(hot).select("key"), "key").select("class", "s", "e", "word"))
    ready = done[0]
    for more in done[1:]:
        ready = ready.unionByName(more)
    # by number: small rows that cost much, so that they are not gathered by their size
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = ready.select("key", "class", "s", "e", "word").repartition(tasks, "key").sortWithinPartitions("key")

    def compose(batches):
        key, own, gap, first, second = None, [], None, [], []

        def close():
            size, s, e = gap
            tail = max(size - e, 0)
            before, after = own[0][:s], own[0][len(own[0]) - tail:]
            inner = Acceptor([w[s:len(w) - tail] for w in own])
            for a, b in Composition(inner).pairs(e - s, after):
                # a class holds its own words, and longer ones only for what they become
                if s + len(b) + tail == size:
                    first.append(before + a + after)
                    second.append(before + b + after)

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string())], names=["a", "b"])
            first.clear()
            second.clear()
            return made
        for batch in batches:
            for k, size, s, e, word in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        close()
                    key, own, gap = k, [], (size, s, e)
                own.append(word)
                if len(first) >= 20_000:
                    yield out()
            yield out()
        if key is not None:
            close()
            yield out()
    return map_arrow(ready, compose, "a string, b string")


# ---- forms and roots ----

def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, drop_every: int | None = DROP_EVERY,
                      max_words: int = MAX_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = landed(vocabulary(docs, id_col=id_col, text_col=text_col, min_length=min_length, min_count=min_count,
                              drop_every=drop_every), "spelling_words")
    pairs = landed(near_pairs(words, max_words), "spelling_pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p"))
    near = both.select("p.*").join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the largest count first, then the smallest word: the least of these pairs
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    rows = landed(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")),
        "spelling_forms")
    # roots: every step follows as many forms as the step before, twice
    hop = rows.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        hop = landed(hop, "spelling_roots")
        further = hop.select(F.col("word").alias("to"), F.col("to").alias("next"))
        joined = hop.join(further, "to", "left")
        if not joined.where("next IS NOT NULL").take(1):
            break
        hop = joined.select("word", F.coalesce("next", "to").alias("to"))
    return rows.join(hop, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
