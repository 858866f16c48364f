import random
import re

import pytest

from concord.llm import pii
from concord.llm.pii import ALPHABETS, GENDER, Surrogates, collisions, entities, find, is_real, luhn, surrogates

KEY = b"k"
FOUND = [
    ("email", "und.34@mail7.example.com"), ("ip", "97.51.17.173"), ("card", "4845168114407329"), ("card", "4111 1111 1111 1111"),
    ("phone", "+1 (017) 555-7713"), ("phone", "555-123-4567"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"),
]
CLEAN = ["9807915762804490", "version 4.0.", "1.2.3", "300.1.1.1", "2024-05-06", "a@b", "12345", "token = none", "1.2.3.4.5", "Mr. ", "DE00 3704 0044 0532 0130 00", "0000000000000000"]


@pytest.mark.parametrize("kind, value", FOUND)
@pytest.mark.parametrize("frame", ["say {} now", "{}", "({})!!", "x {}.\n", "| {} |", "{}###"])
def test_found_in_any_frame(kind, value, frame):
    text = frame.format(value)
    assert [(k, text[a:b]) for a, b, k, _ in find(text)] == [(kind, value)]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert find(text) == [] and Surrogates(KEY).apply(text, {}) == (text, [])


def test_secrets_and_names():
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and Mrs. Mary Ann Roe, Herr Müller; господин Иван Петров'
    assert [(k, text[a:b], d) for a, b, k, d in find(text)] == [
        ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962", ""), ("name", "Mary Ann Roe", "f"), ("name", "Müller", "m"), ("name", "Иван Петров", "m"),
    ]


@pytest.mark.parametrize("kind, value", FOUND + [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")])
def test_surrogates_keep_kind_and_format(kind, value):
    new = Surrogates(KEY).value(kind, value)
    shape = lambda s: [next((n for n, a in enumerate(ALPHABETS) if c in a), c) for c in s]
    assert new != value and is_real(kind, new) and (kind == "secret" or shape(new) == shape(value)) and len(new) == len(value)
    assert new == Surrogates(KEY).value(kind, value) != Surrogates(b"other").value(kind, value)
    assert [k for *_, k, _ in find(f" {new} ")] == [kind] or kind == "secret"


def plain_mentions(text):
    """The mentions of a text by trying every form at every place."""
    names = [(text[m.start(1) : m.end(1)]) for m in pii.PATTERNS["name"].finditer(text)]
    names = [re.split(r"['’]s(?: |$)", n)[0] for n in names]
    spans, at = [], 0
    every = {" ".join(n.split(" ")[i:j]) for n in names for i in range(3) for j in range(i + 1, 4) if i < len(n.split(" "))}
    every = {f for f in every if any(f == n or f == n.split(" ")[-1] or f in [" ".join(n.split(" ")[i:j]) for i in range(3) for j in range(i + 1, len(n.split(" ")))] for n in names)}
    while at < len(text):
        here = [f for f in every if text.startswith(f, at) and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and not text[at + len(f) :][:1].isalpha()]
        if here:
            spans.append((at, at + len(max(here, key=len))))
        at += len(max(here, key=len)) if here else 1
    return spans


def test_every_mention_of_an_introduced_name():
    text = "Mr John Roe called. Roe said he is John Roe. Signed, John Roe. John's hat, Roe-led, Monroe, Roes, Johnson, roe"
    new, spans = Surrogates(KEY).apply(text, {})
    full = Surrogates(KEY).value("name", "John Roe", "m")
    given, family = full.split()
    assert new == f"Mr {full} called. {family} said he is {full}. Signed, {full}. {given}'s hat, {family}-led, Monroe, Roes, Johnson, roe"
    assert [text[a:b] for a, b, _ in spans] == ["John Roe", "Roe", "John Roe", "John Roe", "John", "Roe"] and {k for *_, k in spans} == {"name"}
    assert find("Roe said he is John Roe") == []


def test_mentions_match_a_plain_search():
    draw = random.Random(9)
    bits = ["Mr", "Dr.", "Frau", "Ann", "Bo", "Roe", "Lee", "Müller", "Иван", "said", "the", "Roe's", "Lee-led", "x", "Ann,", "Roe.", "(Lee)", "Smith's House"]
    for _ in range(2000):
        text = " ".join(draw.choice(bits) for _ in range(draw.randint(1, 25)))
        assert [(a, b) for a, b, *_ in find(text)] == plain_mentions(text), text


def test_given_names_alone_stay_apart():
    pool = pii.GIVEN["latin", "m"]
    made = Surrogates(KEY)
    by_new = {}
    for name in (n for n in pool if "-" not in n):
        by_new.setdefault(made.value("name", f"{name} Lee", "m").split()[0], []).append(name)
    one, two = next(x for x in by_new.values() if len(x) > 1)[:2]
    new, _ = made.apply(f"Mr {one} Roe, Mr {two} Lee: {one} is not {two}", {})
    left, right = new.split(": ")[1].split(" is not ")
    assert left != right and [left.split()[0], len(left.split())] == [right.split()[0], 2]
    many = "Mr " + " and Mr ".join(f"Ab{chr(97 + i // 26)}{chr(97 + i % 26)} Roe" for i in range(600)) + ". " + "Roe met Abaa. " * 20000
    assert len(find(many)) == 600 + 40000


def test_mentions_keep_their_surrogate_in_all_texts(spark, docs):
    rows = [(1, "Mr John Roe. Roe is John."), (2, "Dr. Roe alone"), (3, "Roe and John, whoever"), (4, "Mrs John Roe, John"), (5, None)]
    new = {r.doc_id: r.text for r in surrogates(docs(rows), KEY).collect()}
    full = new[1].removeprefix("Mr ").split(".")[0]
    given, family = full.split()
    assert new[1] == f"Mr {full}. {family} is {given}." and new[2] == f"Dr. {family} alone" and new[4] == f"Mrs {full}, {given}"
    assert new[3] == rows[2][1] and new[5] is None
    joined = {r.doc_id: r.text for r in surrogates(docs(rows), KEY, broadcast_most=-1).collect()}
    assert joined == new


def test_names_keep_gender_script_and_person():
    made = Surrogates(KEY)
    full, short = made.value("name", "Mary Roe", "f"), made.value("name", "Roe", "f")
    assert full.split()[-1] == short and GENDER[full.split()[0]] == "f"
    russian = made.value("name", "Анна Петрова", "f")
    assert GENDER[russian.split()[0]] == "f" and all("Ѐ" <= c <= "ӿ" or c == " " for c in russian)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 90, 1000])
def test_permutations(size):
    made = Surrogates(KEY)
    assert sorted(made.permuted(i, size, "t") for i in range(size)) == list(range(size))


def test_long_values():
    made = Surrogates(KEY)
    one, two = made.reshaped("a" * 400, "t"), made.reshaped("a" * 399 + "b", "t")
    assert len(one) == 400 and one != two


def corpus():
    draw = random.Random(4)
    rows = [(i, f"call {draw.choice(['Mr. John', 'Mr. Paul', 'Mr. Karl', 'Sir Carlos'])} Roe or {i % 10}.{i % 7}.0.1 and {FOUND[i % 8][1]}") for i in range(120)]
    return rows + [(200, "no one here"), (201, "only 1.2.3.4")]


def test_distinct_coreferent_and_nothing_else_changes(spark, docs):
    rows = corpus()
    made = {r.doc_id: r for r in surrogates(docs(rows), KEY).collect()}
    seen = {}
    for i, text in rows:
        new, at = made[i].text, 0
        rest = []
        for s in made[i].spans:
            rest.append(text[at : s.begin])
            at = s.end
        rest.append(text[at:])
        for before in rest[:1]:
            assert new.startswith(before)
        assert new.endswith(rest[-1]) and made[i].n_entities == len(made[i].spans)
        inside = new
        for n, part in enumerate(rest[:-1]):
            inside = inside[inside.index(part) + len(part) :]
            value = text[made[i].spans[n].begin : made[i].spans[n].end]
            surrogate = inside[: inside.index(rest[n + 1])] if rest[n + 1] else inside
            assert seen.setdefault((made[i].spans[n].kind, value), surrogate) == surrogate
            inside = inside[len(surrogate) :]
    assert len(set((k, s) for (k, _), s in seen.items())) == len(seen)
    assert all(v != s for (_, v), s in seen.items())
    assert made[200].text == "no one here" and made[200].n_entities == 0


def test_collisions_draw_again_and_both_ways_agree(spark, docs):
    names = [f"Mr. {g} Roe" for g in "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven".split()]
    rows = [(i, n) for i, n in enumerate(names)]
    again = collisions(entities(docs(rows)), KEY).collect()
    assert again
    one = {r.doc_id: r.text for r in surrogates(docs(rows), KEY).collect()}
    two = {r.doc_id: r.text for r in surrogates(docs(rows), KEY, broadcast_most=-1).collect()}
    assert one == two and len(set(one.values())) == len(names)


def test_hard_rows(docs, hard):
    rows = surrogates(docs(hard), KEY).collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text is not None) == sorted((i, t) for i, t in hard if i is not None and t is not None)
    assert [r.text for r in rows if r.doc_id == 1] == [None] and all(r.n_entities == 0 for r in rows)
    assert surrogates(docs([]), KEY).collect() == []
    kept = surrogates(docs(hard), KEY, keep=True)
    assert kept.columns == docs(hard).columns and kept.count() == len(hard)
    twice = surrogates(docs(hard + [(5, "x 1.2.3.4")]), KEY, broadcast_most=-1, keep=True)
    assert twice.count() == len(hard) + 1 and twice.where("text like '%1.2.3.4%'").count() == 0


def test_luhn():
    assert luhn([int(c) for c in "7992739871"]) == 3


def test_every_name_gets_another_however_many_there_are(spark, docs):
    lone = ["Dr. 王伟", "Dr. 김철수", "Dr. محمد", "Dr. דוד", "Dr. 王伟 李明", "Dr. Żaneta"]
    rows = [(i, t) for i, t in enumerate(lone)] + [(100 + i, f"Mr. {chr(65 + i % 26)}{'abc'[i // 26]}o Smith") for i in range(60)]
    made = {r.doc_id: r.text for r in surrogates(docs(rows), KEY).collect()}
    assert all(made[i] != t for i, t in enumerate(lone)) and len(set(made.values())) == len(rows)
    assert all("一" <= c <= "\u9fff" for c in made[0][4:]) and all("가" <= c <= "힣" for c in made[1][4:])


@pytest.mark.parametrize("size", [2, 3, 10, 90, 1000])
def test_permutations_leave_nothing_in_place(size):
    made = Surrogates(KEY)
    out = [made.moved(i, size, "t") for i in range(size)]
    assert sorted(out) == list(range(size)) and all(i != x for i, x in enumerate(out))


PHONES = ["415.555.0123", "415-555-0123", "415.555-0123", "(415) 555-0123", "(415)555-0123", "+14155550123", "+1 415 555 0123", "+44.20.7946.0958"]


@pytest.mark.parametrize("text", PHONES + [v for _, v in FOUND] + ["4111111111111111", "4111-1111-1111-1111", "api_key: abcdefgh1234", "Dr. 王伟"])
def test_quick_look_misses_nothing(monkeypatch, text):
    quick = find(f"x {text} y")
    monkeypatch.setattr(pii, "hopeful", lambda text: list(pii.PATTERNS))
    assert quick and quick == find(f"x {text} y")


@pytest.mark.parametrize("most", [100_000, -1])
def test_one_surrogate_whatever_the_title(docs, most):
    people = [f"{a}{b}" for a in "BCDFGHJKLM" for b in ("alex", "erin")]
    rows = [(100 * n + i, f"{title} {x} Roe") for n, x in enumerate(people) for i, title in enumerate(("Dr", "Mr", "Mrs"))]
    made = {r.doc_id: r.text.split(" ", 1)[1] for r in surrogates(docs(rows), KEY, broadcast_most=most).collect()}
    each = [{made[100 * n + i] for i in range(3)} for n in range(len(people))]
    assert all(len(x) == 1 for x in each) and len(set.union(*each)) == len(people)
