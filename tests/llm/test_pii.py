import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL, odd_docs
from tessera.llm import pii
from tessera.llm.queries import QUERIES

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    """The base rules, word for word."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a_@.+-0 125(9é\n", max_size=60))
def test_base_rules(text):
    assert pii.detect(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["one ", "plus ", "nine-", "at", " dot ", "(at)", "[dot]", "x", "@", ".", "１", "а", "\u200b", "+", "4111 1111 1111 1111", " "]), max_size=20))
def test_base_spans_stay_and_spans_lie_in_the_text(parts):
    text = "".join(parts)
    spans = pii.spans_of(text, NORMALISE)
    assert [s[:3] for s in spans if s[3]] == plain(text)
    assert all(0 <= a < b <= len(text) for _, a, b, _ in spans) and spans == sorted(spans)


NORMALISE = pii.Normaliser()


@pytest.mark.parametrize("text, kind, found", [
    ("mail jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
    ("write jane at example dot com.", "email", "jane at example dot com"),
    ("jane[at]example.com", "email", "jane[at]example.com"),
    ("x jаne＠exаmple.com y", "email", "jаne＠exаmple.com"),
    ("192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
    ("192[.]168[.]1[.]20", "ip", "192[.]168[.]1[.]20"),
    ("call plus one five five five two three four five six seven eight now", "phone", "plus one five five five two three four five six seven eight"),
    ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("tel +４４ 20 7946 0958", "phone", "+４４ 20 7946 0958"),
])
def test_disguises_map_back(text, kind, found):
    spans = pii.spans_of(text, NORMALISE)
    assert [(pii.KINDS[k], text[a:b], own) for k, a, b, own in spans] == [(kind, found, False)]


@pytest.mark.parametrize("text", ["look at example.com today", "It is at the. Then @ all. Go", "one two three", "the end. At home", "1.2.3.400", ""])
def test_clean_text_stays_clean(text):
    assert pii.spans_of(text, NORMALISE) == []


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "@a" * 100_000, "+1 " * 70_000, "one " * 50_000, "x at " * 40_000 + " dot", "a dot " * 40_000])
def test_very_long_texts(text):
    pii.spans_of(text, NORMALISE)


def test_query_against_the_plain_rules(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op5_pii_spans"](spark, SF_SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and any(r.n_email for r in got.values())
    for doc_id, text in rows:
        base = plain(text or "")
        own = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert set(filter(None, own.split(","))) <= set(r.spans.split(","))


def test_odd_rows(spark, docs):
    rows = pii.find(odd_docs(spark, [(9, "a@b.c d@e.f", None, None, 0)])).collect()
    assert sorted(len(r.spans) for r in rows) == [0] * 7 + [2]
    found = next(r for r in rows if r.doc_id == 9)
    assert pii.masked("a@b.c d@e.f", found.spans) == "[EMAIL] [EMAIL]"
    assert pii.find(docs.where(F.lit(False))).count() == 0


def test_words_and_figures_mixed():
    normalise = pii.Normaliser()
    whole = lambda t, kind: [t[a:b] for k, a, b, _ in pii.spans_of(t, normalise) if pii.KINDS[k] == kind]
    for number in ("+1 555 two three four 567 eight", "plus one five five five 2 three four 5 six seven eight", "+1 (555) two three four 56 78",
                   "plus 44 two zero 7946 zero 958"):
        assert number in whole(f"Call {number} or write.", "phone"), number
    for number in ("4 " + " 1 ".join(["one"] * 8), "4111 one one one one 1111 1111", "four 111-1111-1111-1111", "4111-1111-one 111-1111"):
        assert number in whole(f"Card: {number}, thanks.", "card"), number
    assert whole("It has room 12, 4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one.", "card")
    for clean in ("one of 12 and 3 of four", "In 1999 two 20 three men", "page 5, one 7", "7 one-time codes", "1 2 3 four 5 6"):
        assert not pii.spans_of(clean, normalise), clean
    t = "Call +44 20 7946 0958 one day."
    assert [t[a:b] for _, a, b, _ in pii.spans_of(t, normalise)] == ["+44 20 7946 0958"]
