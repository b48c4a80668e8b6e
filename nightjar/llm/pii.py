"""Operator 1, PII surrogate generation.

Entities (e-mail addresses, telephone numbers, IPv4 addresses, account and
card numbers, secret tokens, names after a form of address) are replaced by
keyed surrogates of the same kind: the same script, letter case, number and
layout of digits, the same Luhn validity, the same gender of a given name.

Coreference: an entity is known by its canonical form (lower case, digits
without layout, single parts of a name), and one canonical form has one
surrogate in the whole corpus, a name also where it is given name here and
family name there. A given name has the gender that its forms of address tell
over the corpus (x if none or both do). Names that a text introduces after a
form of address are replaced wherever else that text has them, too, if with a
capital letter. Distinctness, over all kinds: candidates come from an HMAC of
the canonical form; a candidate that another entity already has, or that is
itself an entity of the corpus, is refused and the next one tried, in rounds
over the refused entities only, until no two entities share a surrogate.

Texts stay where they are unless they may hold an entity: only those are
joined with the surrogates of their own entities.

Defined results: null text stays null and has no entity; a null id is carried
along; rows that share an id are each replaced; an empty table gives an empty
result. Texts of any length are read whole. Other columns are kept as they are
(but for one named n_entities, which is replaced).
"""
from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, landed, map_arrow

MAX_ROUNDS = 60
#: From this attempt on a surrogate may be longer than the entity, for formats
#: that have fewer forms than the corpus has entities.
LONGER_FROM = 8

#: Forms of address and the gender they tell (f, m, or x for none).
ADDRESSES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "x", "Prof": "x", "Herr": "m", "Frau": "f",
             "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sra": "f",
             "Господин": "m", "Госпожа": "f"}
_WORD = r"[^\W\d_]+(?:[-'][^\W\d_]+)*"
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]++@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,})"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<!\w)\d{3}[-.]\d{3}[-.]\d{4}(?!\w))"
    r"|(?P<account>(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<secret>(?<!\w)(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w))"
    r"|(?P<name>(?<!\w)(?P<address>" + "|".join(ADDRESSES) + r")\.? (?P<first>" + _WORD + r")(?: (?P<last>" + _WORD + r"))?)")
#: Wider than the pattern, and cheap: a text without it has no entity. Python's
#: \d is any decimal digit, Spark's only ASCII, so Spark also asks for ANY_DIGIT.
ANY_DIGIT = r"\p{Nd}"
MAY_HOLD = r"[\d@]|[MDPHFSГ](?:rs?|s|iss|onsieur|adame|me|lle|rof|err|rau|eñora?|ra|осп)"

_TOKEN, _LETTERS = re.compile(rf"(?<!\w){_WORD}(?!\w)"), re.compile(r"[^\W\d_]+")
_ADDRESS_FORMS = {a.lower() for a in ADDRESSES}
_VOWELS, _CONSONANTS = "aeiou", "bcdfghklmnprstvz"
_CYRILLIC_V, _CYRILLIC_C = "аеиоу", "бвгдзклмнпрст"
_GREEK_V, _GREEK_C = "αεηιου", "βγδζκλμνπρστ"
_GIVEN_END = {"f": "a", "m": "o", "x": "i"}


def _script(c: str) -> tuple[str, str]:
    name = unicodedata.name(c, "")
    if name.startswith("CYRILLIC"):
        return _CYRILLIC_V, _CYRILLIC_C
    if name.startswith("GREEK"):
        return _GREEK_V, _GREEK_C
    return _VOWELS, _CONSONANTS


def _parts(m: re.Match) -> list[tuple[str, str, int, int]]:
    """(kind, canonical form, start, end) of the entities of one match."""
    kind = next(k for k in ("email", "ip", "phone", "account", "secret", "name") if m.group(k) is not None)
    text = m.group(kind)
    if kind in ("phone", "account"):
        digits = re.sub(r"\D", "", text)
        return [(kind, ("+" if text[0] == "+" else "") + digits, *m.span(kind))]
    if kind == "email":
        bare = text.lstrip("._+-")
        return [(kind, bare.lower(), m.end(kind) - len(bare), m.end(kind))] if bare[0] != "@" else []
    if kind != "name":
        return [(kind, text.lower(), *m.span(kind))]
    gender = ADDRESSES[m.group("address")]
    first, last = m.group("first"), m.group("last")
    if not first[0].isupper():
        return []
    if last is None or not last[0].isupper():
        return [("family", first.lower(), *m.span("first"))]
    return [("given_" + gender, first.lower(), *m.span("first")), ("family", last.lower(), *m.span("last"))]


def _is_name(kind: str) -> bool:
    return kind == "family" or kind.startswith("given_")


def entities(text: str) -> list[tuple[str, str, int, int]]:
    found = [p for m in _PATTERN.finditer(text) for p in _parts(m)]
    names = {c: k for k, c, _, _ in found if _is_name(k) and c not in _ADDRESS_FORMS}
    return sorted(found + _later_mentions(text, names, found), key=lambda p: p[2]) if names else found


def _later_mentions(text: str, names: dict[str, str], found: list) -> list[tuple[str, str, int, int]]:
    """Mentions of names outside the entities found."""
    out, spans, at = [], [(i, j) for _, _, i, j in found], 0
    for m in _TOKEN.finditer(text):
        # the whole word, or else its parts between hyphens and apostrophes
        words = [m] if m.group().lower() in names else _LETTERS.finditer(text, *m.span())
        for word in words:
            canonical, (i, j) = word.group().lower(), word.span()
            while at < len(spans) and spans[at][1] <= i:
                at += 1
            if canonical in names and word.group()[0].isupper() and (at == len(spans) or j <= spans[at][0]):
                out.append((names[canonical], canonical, i, j))
    return out


class _Stream:
    """Numbers below n from the HMAC of one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.key, self.label = key, f"{kind}\x1f{canonical}\x1f{attempt}".encode()
        self.block, self.n = b"", 0

    def below(self, n: int) -> int:
        while len(self.block) < 4:
            self.block += hmac.new(self.key, self.label + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.block = int.from_bytes(self.block[:4], "big"), self.block[4:]
        return value % n

    def of(self, choices: str) -> str:
        return choices[self.below(len(choices))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The candidate (canonical form) of one entity at one attempt."""
    r = _Stream(key, kind, canonical, attempt)
    more = max(0, attempt - LONGER_FROM + 1)
    if kind == "phone":
        plus, digits = canonical[0] == "+", canonical.lstrip("+")
        keep = 1 if plus else 0  # the country code's first digit
        return "+" * plus + digits[:keep] + "".join(r.of("0123456789") for _ in digits[keep:])
    if kind == "account":
        body = canonical[0] + "".join(r.of("0123456789") for _ in canonical[1:])
        valid = luhn(canonical)
        for last in sorted("0123456789", key=lambda _: r.below(1 << 30)):
            if luhn(body[:-1] + last) == valid:
                return body[:-1] + last
    if kind == "ip":
        out = []
        for octet in canonical.split("."):
            low, high = {1: (1, 9), 2: (10, 99)}.get(len(octet), (100, 254)) if not more else (1, 254)
            out.append(str(low + r.below(high - low + 1)))
        return ".".join(out)
    if kind == "secret":
        return "".join(r.of("0123456789abcdef") for _ in canonical)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        shaped = ".".join([*(_shaped(r, x) for x in labels[:-1]), labels[-1]])
        return _shaped(r, local) + "".join(r.of(_CONSONANTS) for _ in range(more)) + "@" + shaped
    out = _shaped(r, canonical)
    vowels, consonants = _script(canonical[0])
    out += "".join(r.of(consonants) + r.of(vowels) for _ in range(more))
    if kind.startswith("given_") and vowels is _VOWELS:
        out = (out if len(out) > 2 else out + r.of(_CONSONANTS)).rstrip("aeiou") + _GIVEN_END[kind[-1]]
    return out


def _shaped(r: _Stream, text: str) -> str:
    """Letters by letters of the same script, in turn consonant and vowel;
    digits by digits; other signs stay."""
    out, turn = [], r.below(2)
    for c in text:
        if c.isdigit():
            out.append(r.of("0123456789"))
        elif c.isalpha():
            out.append(r.of(_script(c)[turn]))
            turn = 1 - turn
        else:
            out.append(c)
    return "".join(out)


def lay_out(kind: str, mention: str, replacement: str) -> str:
    """The surrogate in the layout and letter case of one mention."""
    if kind in ("phone", "account"):
        digits = iter(replacement.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if mention.isupper():
        return replacement.upper()
    if mention[:1].isupper():
        return replacement[:1].upper() + replacement[1:]
    return replacement


# ---- Spark ----

def _mentions(rows: DataFrame) -> DataFrame:
    """kind, canonical, row_key of every distinct entity of each text."""
    def run(batches):
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, canonical in {(k, c) for k, c, _, _ in entities(text)}:
                    out[0].append(kind)
                    out[1].append(canonical)
                    out[2].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()),
                                              pa.array(out[2], pa.int64())], names=["kind", "canonical", "row_key"])
    return rows.transform(map_arrow, run, "kind string, canonical string, row_key long")


def _space(kind):
    """Parts of names are of one kind, whatever their part and gender."""
    return F.when((kind == "family") | kind.startswith("given_"), "name").otherwise(kind)


def assign_surrogates(found: DataFrame, key: bytes, make=surrogate) -> DataFrame:
    """kind, canonical, surrogate for every distinct entity: one to one, and no
    surrogate that is itself an entity of the corpus. Parts of names come back
    as of kind name."""
    def candidates(rows: DataFrame, attempt: int) -> DataFrame:
        def run(batches):
            for b in batches:
                made = [make(key, k, c, attempt) for c, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())],
                                                 names=["kind", "canonical", "surrogate"])
        return rows.transform(map_arrow, run, "kind string, canonical string, surrogate string")

    has = {g: F.max((F.col("kind") == f"given_{g}").cast("int")) for g in "fmx"}
    form = (F.when((has["f"] == 1) & (has["m"] == 0), "given_f").when((has["m"] == 1) & (has["f"] == 0), "given_m")
            .when(F.greatest(*has.values()) == 1, "given_x").otherwise(F.max("kind")))
    space = _space(F.col("kind"))
    every = landed(found.select("kind", "canonical").distinct().groupBy(space.alias("space"), "canonical")
                   .agg(form.alias("form")).withColumnRenamed("space", "kind"), "entities")
    pending, taken = every, None
    real = every.select(F.col("canonical").alias("surrogate"))
    for attempt in range(MAX_ROUNDS):
        new = candidates(pending, attempt).join(real, "surrogate", "left_anti")
        if taken is not None:
            new = new.join(taken.select("surrogate"), "surrogate", "left_anti")
        won = new.groupBy("surrogate").agg(F.min(F.struct("kind", "canonical")).alias("won"))
        won = landed(won.select("won.kind", "won.canonical", "surrogate"), f"surrogates_{attempt}")
        pending = pending.join(won, ["kind", "canonical"], "left_anti")
        taken = won if taken is None else taken.unionByName(won)
        if attempt:  # later rounds hold few rows
            taken = landed(taken, f"taken_{attempt}")
        pending = landed(pending, f"refused_{attempt}")
        if not pending.take(1):
            return taken
    raise RuntimeError(f"entities without a surrogate of their own after {MAX_ROUNDS} attempts: {pending.take(3)}")


def replace_pii(docs: DataFrame, key: bytes, *, text_col: str = "text", make=surrogate) -> DataFrame:
    """The rows of docs with surrogates in the text column, and ``n_entities``."""
    docs = docs.drop("n_entities")
    map_, row_key = fresh(docs.columns, "_map", "_row_key")
    text = docs[f"`{text_col}`"]
    may = F.coalesce(text.rlike(f"{MAY_HOLD}|{ANY_DIGIT}"), F.lit(False))
    some = docs.where(may)
    mentions = landed(_mentions(some.select(text, F.xxhash64(text))), "mentions")
    mapping = assign_surrogates(mentions, key, make)
    own = (mentions.withColumn("kind", _space(F.col("kind"))).distinct().join(mapping, ["kind", "canonical"])
           .groupBy("row_key").agg(F.collect_set(F.struct("kind", "canonical", "surrogate")).alias(map_))
           .withColumnRenamed("row_key", row_key))
    fields = docs.schema.fields
    at = [f.name for f in fields].index(text_col)
    out = T.StructType(fields + [T.StructField("n_entities", T.LongType())])

    def run(batches):
        for b in batches:
            texts, counts = [], []
            for t, found in zip(b.column(at).to_pylist(), b.column(len(fields)).to_pylist()):
                table = {(f["kind"], f["canonical"]): f["surrogate"] for f in found or []}
                parts, end, n = [], 0, 0
                for kind, canonical, i, j in entities(t):
                    parts += [t[end:i], lay_out(kind, t[i:j], table["name" if _is_name(kind) else kind, canonical])]
                    end, n = j, n + 1
                texts.append("".join([*parts, t[end:]]))
                counts.append(n)
            columns = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1:len(fields)],
                       pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    joined = some.join(own, F.xxhash64(some[f"`{text_col}`"]) == own[row_key], "left")
    done = joined.select(*[some[f"`{f.name}`"] for f in fields], own[map_]).transform(map_arrow, run, out)
    return done.unionByName(docs.where(~may).withColumn("n_entities", F.lit(0).cast("long")))
