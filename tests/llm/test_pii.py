"""Base detectors against the plain expressions, and disguises against their sources."""

import hashlib
import random
import re
import time

import pytest

from orderweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_expressions():
    rng = random.Random(11)
    pools = ["ab.@-1", "0123456789. -", "+12345678 ().-", "a@b.c d@e.f", "4539148803436467 "]
    for i in range(6000):
        text = "".join(rng.choice(pools[i % 5]) for _ in range(rng.randrange(60)))
        assert pii.plain_spans(text) == brute(text), text


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
    ("jane dot roe (at) mail dot example.org", "email", "jane dot roe (at) mail dot example.org"),
    ("see аdmin@exаmple．com!", "email", "аdmin@exаmple．com"),
    ("see user@ex​ample.com", "email", "user@ex​ample.com"),
    ("call plus four nine one five one two three four five six seven eight now", "phone",
     "plus four nine one five one two three four five six seven eight"),
    ("é four.five.three.nine.one.four.eight.eight.zero.three.four.three.six.four.six.seven", "card",
     "four.five.three.nine.one.four.eight.eight.zero.three.four.three.six.four.six.seven"),
    ("host １０.0.0.٧ up", "ip", "１０.0.0.٧"),
    ("phone +1 (five five five) 123-4567", "phone", "+1 (five five five) 123-4567"),
])
def test_disguised(text, kind, found):
    base, spans = pii.all_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in spans] == [(kind, found)]
    assert base == []
    assert found not in pii.redacted(text, spans)


@pytest.mark.parametrize("text", [
    "meet me at noon", "one two three four", "at the dot", "come at once. Then go", "@ home. Now", "un deux trois", "1 2 3 4", ""])
def test_clean_texts_stay(text):
    assert pii.all_spans(text) == ([], [])


def test_base_spans_stay_beside_disguised_ones():
    text = "a@b.co and a [at] b [dot] co and 10.0.0.1"
    base, spans = pii.all_spans(text)
    assert base == brute(text) and set(base) < set(spans) and len(spans) == 3


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a@", "+1", "one ", "a at ", "a dot ", "1 ", "x at y dot ", "[ ", "(at)", " "])
def test_time_is_linear(unit):
    start = time.time()
    pii.all_spans(unit * (200_000 // len(unit)))
    assert time.time() - start < 10


def test_query_rows(spark, awkward, docs_of):
    text = "é a@b.co 10.0.0.1 x [at] y [dot] z"
    docs = docs_of([text, None])
    rows = {r.doc_id: r for r in pii.digest(pii.find(docs, "doc_id")).collect()}
    base = "email:2:8,ip:9:17"
    assert rows[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert rows[0].spans == base + ",email:18:34" and (rows[0].n_email, rows[0].n_ip, rows[0].n_card) == (1, 1, 0)
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].spans == ""
    assert pii.find(awkward, "doc_id").count() == awkward.count()
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["é [EMAIL] [IP] [EMAIL]", None]
    assert pii.redact(awkward.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("escribe a juan arroba ejemplo punto com ya", "email", "juan arroba ejemplo punto com"),
    ("mail name at host punkt de bitte", "email", "name at host punkt de"),
    ("à marie arobase exemple point fr merci", "email", "marie arobase exemple point fr"),
    ("to name at host.com now", "email", "name at host.com"),
    ("see john [at] example punto com", "email", "john [at] example punto com"),
    ("call +49 151 two 345 6789 now", "phone", "+49 151 two 345 6789"),
    ("card 4539 one 488 0343 6467 ok", "card", "4539 one 488 0343 6467"),
    ("card 4539 1488 0343 646 seven ok", "card", "4539 1488 0343 646 seven"),
])
def test_disguised_in_all_languages_and_in_part(text, kind, found):
    base, spans = pii.all_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in spans] == [(kind, found)]
    assert base == []


def test_a_disguise_around_a_base_span_goes_whole():
    text = "ask john dot doe@mail.example dot com now"
    base, spans = pii.all_spans(text)
    assert [text[s:e] for s, _, e in base] == ["doe@mail.example"] and base[0] in spans
    assert pii.redacted(text, spans) == "ask [EMAIL] now"


@pytest.mark.parametrize("text", [
    "arrived at this point it was", "look at some point in time", "chez lui point de doute", "meet at 10.30 or at home.Then",
    "the six of 2024 and one 3", "a@b.co . The next", "at this point a@b.com wrote", "call +49 151 2345 6789 one of us"])
def test_prose_is_not_taken_for_a_disguise(text):
    base, spans = pii.all_spans(text)
    assert spans == base


@pytest.mark.parametrize("unit", ["one 1 ", "1 one 22 ", "x at y.z ", "a@b.c dot ", "+1 two ", "a arroba b punto "])
def test_time_is_linear_with_more_words(unit):
    start = time.time()
    pii.all_spans(unit * (200_000 // len(unit)))
    assert time.time() - start < 10
