"""Personal data against the plain regular expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        double = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
        return 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(double)) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text)
        if holds(kind, m[0])
    ]


def base(text):
    return [s[:3] for s in pii.find(text) if s.kind in pii.BASE]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1.2@-+ ()0455%_é\n٣")), max_size=60))
def test_base_kinds_like_the_patterns(text):
    assert base(text) == plain(text)


CARD = "4539 1488 0343 6467"


@pytest.mark.parametrize(
    "text",
    ["", CARD, f"é {CARD}-", "1.2.3.4.5.6.7.8", "256.1.1.1 1..2.3.4.5", "a@b.c@d.e", "x" * 50_000 + "@a.b",
     "9" * 20_000, "+1 (845) 555-3372 ", "+1" + " " * 9000, "1." * 9000, "-".join("4" * 3000)],
)
def test_chosen_texts(text):
    assert base(text) == plain(text)


def test_added_kinds():
    iban = "GB82 WEST 1234 5698 7654 32"
    assert [s[:3] for s in pii.find(f"iban {iban}.") if s.kind == "iban"] == [("iban", 5, 5 + len(iban))]
    assert not [s for s in pii.find("iban GB83 WEST 1234 5698 7654 32") if s.kind == "iban"]
    assert [s.kind for s in pii.find("SSN 078-05-1120")] == ["national"]
    assert pii.find("part 078-05-1120") == []
    assert [s.kind for s in pii.find("call (212) 555-0187 now")] == ["local_phone"]
    assert pii.find("see (212) 555-0187 now") == []


def test_context_adjusts_the_score():
    near, far = pii.find(f"card {CARD}")[0].score, pii.find(f"here {CARD}")[0].score
    against = pii.find(f"order {CARD}")[0].score
    assert near > far > against


def test_redact():
    text = f"mail a@b.cc card {CARD}!"
    assert pii.redact(text, pii.find(text)) == "mail <email> card <card>!"


def test_detect(documents, clashing):
    rows = [(1, "a@b.cc"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "a@b.cc")]
    found = sorted((r.doc_id or 0, [s.kind for s in r.spans]) for r in pii.detect(clashing(rows)).collect())
    assert found == [(0, ["ip"]), (1, ["email"]), (1, ["email"]), (2, []), (3, [])]
    assert pii.detect(documents([])).collect() == []
