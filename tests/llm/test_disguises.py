"""Disguises that the transducers undo are found whatever else the document holds."""

import time

import pytest

from veritab.llm import pii

CASES = [
    ("host 10 . 20 . 30 . 40 up", "ip", "10 . 20 . 30 . 40"),
    ("mail john@mail . example . com now", "email", "john@mail . example . com"),
    ("card 4111 1111 1111 111l and", "card", "4111 1111 1111 111l"),
    ("card 41111111 1111111I and", "card", "41111111 1111111I"),
    ("host one.two.three.four up", "ip", "one.two.three.four"),
    ("host onetwo.threefour.five.six up", "ip", "onetwo.threefour.five.six"),
    ("mail john at\tsite dot\tcom now", "email", "john at\tsite dot\tcom"),
    ("mail john_at-site_dot-com now", "email", "john_at-site_dot-com"),
    ("mail john--at--site--dot--com now", "email", "john--at--site--dot--com"),
]


@pytest.mark.parametrize(("text", "kind", "part"), CASES)
def test_found_alone(text, kind, part):
    start = text.index(part)
    assert (kind, start, start + len(part)) in pii.added_spans(text, pii.base_spans(text))


@pytest.mark.parametrize(("text", "kind", "part"), CASES)
def test_unrelated_text_changes_nothing(text, kind, part):
    """A sentence with an obvious disguise at the end leaves the spans before it as they are."""
    longer = f"{text}.\n\nwrite to mary (at) place (dot) org"
    before = [s for s in pii.added_spans(longer, pii.base_spans(longer)) if s[2] <= len(text)]
    assert sorted(before) == sorted(pii.added_spans(text, pii.base_spans(text)))


@pytest.mark.parametrize("make", [lambda n: "a dot " * n, lambda n: "bob@x.com " * n + "mary at site dot org", lambda n: "a dot at dot " * n, lambda n: "a@b dot " * n])
def test_time_grows_with_the_text(make):
    """Four times the text takes no more than about four times the time."""
    seconds = []
    for n in (3000, 12000):
        text = make(n)
        start = time.process_time()
        pii.added_spans(text, pii.base_spans(text))
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 * seconds[0] + 0.3
    assert seconds[1] < 10


def test_chains_of_words():
    """The local part is the whole chain of words and dots, and no address begins inside another."""
    find = lambda text: {text[a:b] for k, a, b in pii.added_spans(text, pii.base_spans(text)) if k == "email"}
    assert find("so mary dot jane dot doe at site dot org it is") == {"mary dot jane dot doe at site dot org"}
    assert find("a dot  b   dot c at site dot org") == {"c at site dot org"}
    assert find("x.y dot z at site dot org dot") == {"x.y dot z at site dot org"}
    assert find("meet me at noon. a at b") == set()
