"""Operator 1: kinds, formats, coreference, distinctness, collisions."""
import re

import pytest

from nightjar.llm import pii as P

KEY = b"test key"
TEXTS = [
    (1, "Write to Anna.Lee7@Mail.example.com, or ANNA.LEE7@MAIL.EXAMPLE.COM; call +1 (743) 555-3824 or +1-743-555-3824."),
    (2, "Card 4111 1111 1111 1111, 4111111111111111 and 4111111111111112 from 10.1.22.250, 10.1.22.250!"),
    (3, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" and "B44E15E09FD311C3CF3163B66D5A9875B883D8CE"'),
    (4, "Mrs. Maria Schmidt met Mr Schmidt and Frau Weiß; Señora García, Госпожа Анна Иванова."),
    (5, "Version 1.2.3.4.5, 3.14, 999.1.1.1, year 2024-10-11, 123456 items, a@b, mrs Maria."),
    (6, None), (7, ""), (8, "nothing here"), (9, "x" * 500_000 + " bob@mail.example.org " + "y " * 300_000),
    (10, "bob@mail.example.org"), (10, "bob@mail.example.org"), (None, "bob@mail.example.org +49 30 123456 78"),
    (11, "Dr. Maria Schmidt")]
SCHEMA = "doc_id long, text string, kind string, n_entities string, row_key int"


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "clash", "c", 3) for r in rows], SCHEMA).repartition(3)


def run(spark, **k):
    got = P.replace_pii(frame(spark), KEY, **k).collect()
    return {r.doc_id: r for r in got}, got


def test_replacements(spark):
    by, rows = run(spark)
    assert len(rows) == len(TEXTS) and by[6].text is None and by[7].text == "" and by[8].text == "nothing here"
    assert by[5].text == TEXTS[4][1] and by[5].n_entities == 0 and by[5].kind == "clash"
    first, second, phone, phone2 = re.fullmatch(
        r"Write to (\S+), or (\S+); call (\+\d \(\d{3}\) \d{3}-\d{4}) or (\+\d-\d{3}-\d{3}-\d{4})\.", by[1].text).groups()
    assert first.lower() == second.lower() and second.isupper() and first.endswith(".com") and re.match(r"[A-Z]", first)
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.com", first.lower()) and "anna" not in first.lower()
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(phone) == digits(phone2) != "17435553824" and phone.startswith("+1")
    a, b, c, ip, ip2 = re.fullmatch(r"Card ([\d ]{19}), (\d{16}) and (\d{16}) from (\S+), (\S+)!", by[2].text).groups()
    assert digits(a) == b != c and P.luhn(b) and not P.luhn(c) and b[0] == c[0] == "4"
    assert ip == ip2 != "10.1.22.250" and [len(x) for x in ip.split(".")] == [2, 1, 2, 3]
    s, t = re.findall(r'"(\w{40})"', by[3].text)
    assert s.upper() == t and s.islower() and s != TEXTS[2][1][9:49]
    assert by[9].text.split()[1] == by[10].text == by[None].text.split()[0] != "bob@mail.example.org"


def test_names_keep_gender_script_and_coreference(spark):
    by, _ = run(spark)
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) and Frau (\w+); Señora (\w+), Госпожа (\w+) (\w+)\.", by[4].text)
    given, family, again, weiss, garcia, anna, ivanova = m.groups()
    assert family == again and family != "Schmidt" and given.endswith("a") and given[0].isupper() and weiss != garcia
    assert re.fullmatch("[А-Я][а-я]+", anna) and re.fullmatch("[А-Я][а-я]+", ivanova)
    assert by[11].text.split()[2] == family


def test_keyed_and_repeatable(spark):
    one, two = run(spark)[0], run(spark)[0]
    other = {r.doc_id: r for r in P.replace_pii(frame(spark), b"other").collect()}
    assert all(one[i].text == two[i].text for i in one) and one[1].text != other[1].text


def test_collisions_are_resolved(spark):
    rows = [(i, f"user{i}@mail.example.com") for i in range(60)] + [(100, "user3@mail.example.com")]

    def poor(key, kind, canonical, attempt):  # few candidates, among them real entities
        return f"user{(hash_of(canonical) + attempt * 41) % (20 + attempt * 60)}@mail.example.com"

    def hash_of(text):
        return sum(text.encode()) * 31 % 97
    found = P._mentions(frame(spark, rows).selectExpr("text", "xxhash64(text)"))
    table = P.assign_surrogates(found, KEY, poor).collect()
    real = {t for _, t in rows}
    assert {r.canonical for r in table} == real and len(table) == 60
    assert len({r.surrogate for r in table}) == 60 and not real & {r.surrogate for r in table}
    got = {r.doc_id: r.text for r in P.replace_pii(frame(spark, rows), KEY, make=poor).collect()}
    assert len(set(got.values())) == 60 and got[3] == got[100]


def test_no_way_out_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_ROUNDS", 3)
    found = P._mentions(frame(spark).where("text is not null").selectExpr("text", "xxhash64(text)"))
    with pytest.raises(RuntimeError, match="without a surrogate"):
        P.assign_surrogates(found, KEY, lambda *a: "same")


def test_prefilter_is_wider_than_the_pattern():
    for _, t in TEXTS:
        if t and P.entities(t):
            assert re.search(P.MAY_HOLD, t)


def test_empty_table(spark):
    df = P.replace_pii(frame(spark, []), KEY)
    assert df.count() == 0 and df.columns == ["doc_id", "text", "kind", "row_key", "n_entities"]


def test_one_name_has_one_surrogate_with_and_without_title(spark):
    rows = [(1, "Mrs. Maria Schmidt came. Later Maria said that SCHMIDT-Weber and Schmidt's dog left; schmidt stays, Mariax too."),
            (2, "Dr. Maria Schmidt"), (3, "Maria alone, and Schmidt, in a text without a form of address"),
            (4, "Dr. Kim Lee, Mr Maria, maria@mail.example.com")]
    got = {r.doc_id: r for r in P.replace_pii(frame(spark, rows), KEY).collect()}
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) came\. Later (\w+) said that (\w+)-Weber and (\w+)'s dog left; schmidt stays, Mariax too\.", got[1].text)
    maria, schmidt, maria2, upper, schmidt2 = m.groups()
    assert maria == maria2 != "Maria" and maria.endswith("a") and schmidt == schmidt2 != "Schmidt" and upper == schmidt.upper()
    assert got[2].text == f"Dr. {maria} {schmidt}" and got[3].text == rows[2][1] and got[1].n_entities == 5
    assert re.fullmatch(rf"Dr\. (\w+) (\w+), Mr {maria}, (\S+)@\S+\.com", got[4].text) and "maria@" not in got[4].text


def test_surrogates_are_distinct_over_kinds(spark):
    found = spark.createDataFrame([("given_f", "anna"), ("given_x", "anna"), ("family", "lee"), ("email", "a@b.com")], "kind string, canonical string")
    same = lambda key, kind, canonical, attempt: ["lee", "same", "other", "third"][min(attempt, 3)] + "x" * max(0, attempt - 3)
    table = P.assign_surrogates(found, KEY, same).collect()
    assert len(table) == 3 and len({r.surrogate for r in table}) == 3 and "lee" not in {r.surrogate for r in table}


def test_digits_of_any_script_are_found(spark):
    rows = [(1, "٤١١١ ١١١١ ١١١١ ١١١١"), (2, "（４１１１１１１１１１１１１１１１）"), (3, "𝟕𝟒𝟑-𝟓𝟓𝟓-𝟑𝟖𝟐𝟒"), (4, "٣ شمس")]
    got = {r.doc_id: r for r in P.replace_pii(frame(spark, rows), KEY).collect()}
    for i, t in rows[:3]:
        assert re.search(P.MAY_HOLD, t) and got[i].text != t and got[i].n_entities == len(P.entities(t)) == 1
    assert got[4].text == rows[3][1] and got[4].n_entities == 0
