"""Expressions of pages and hosts have all nodes, however many."""

import random

from textlab.llm import wrappers
from tests.llm.test_pages import extracted


def nodes_of(page):
    return wrappers.page_nodes(*wrappers.parse(page))


def test_texts_far_down_a_page_are_told_by_place(spark):
    long = "".join(f"<h{k % 5 + 1}>Head {{i}} {k}</h{k % 5 + 1}><p>Text {{i}} {k}</p>" for k in range(400))

    def page(i):
        answer = ["<p>Yes</p>" if i % 3 == n else "" for n in range(3)]
        return (
            f"<body>{long.format(i=i)}<h2>Question {i}</h2>{answer[0]}<hr><h3>Poll {i}</h3>{answer[1]}"
            f"<table><tr><td>Votes {i}</td></tr></table>{answer[2]}<h4>Good bye</h4></body>"
        )

    assert len(nodes_of(page(0))) > 2000
    found = extracted(spark, [(i, "http://h.example/", page(i)) for i in range(9)])
    for i in range(9):
        words = [f"Question {i}", f"Poll {i}", f"Votes {i}"]
        words.insert(i % 3 + 1, "Yes")
        assert found[i] == " ".join([f"Head {i} {k} Text {i} {k}" for k in range(400)] + words)


def test_an_expression_covers_both_pages_whole():
    one = [f"<a{k}/>" for k in range(3000)]
    two = [f"<a{k}/>" if k % 7 else f"<b{k}/>" for k in range(3000)]
    tokens = wrappers.flat(wrappers.align(one, two))[0]
    assert set(tokens) == {*one, *two} and len(tokens) == 3000 + len(range(0, 3000, 7))


def test_long_stretches_without_a_single_token_are_aligned():
    draw = random.Random(2)
    a = [draw.choice("abcd") for _ in range(1500)]
    b = ["x", *a[:700], *"yy", *a[700:], "z"]
    found = wrappers.matching(["s", *a, "t"], b)
    assert all(["s", *a, "t"][i : i + n] == b[k : k + n] for i, k, n in found)
    assert sum(n for *_, n in found) == len(a)


def test_groups_are_found_at_every_place():
    nodes = list("abcabcabxabc")
    assert wrappers._absorb(nodes, nodes, [["?", list("abc")]])[1] == ["(a b c)?", "(a b c)?", *"abx", "(a b c)?"]
    assert wrappers._absorb(list("aaaaa"), list("aaaaa"), [["+", ["a", "a"]]])[1] == ["(a a)+", "(a a)+", "a"]


def test_few_tokens_are_held(spark, monkeypatch):
    """A worker hands its expressions on when they have so many tokens; the result is the same."""
    page = lambda i: f"<body><p>Hello</p><h{i % 5 + 1}>Text {i}</h{i % 5 + 1}><h6>Bye</h6></body>"
    rows = [(i, "http://h.example/", page(i)) for i in range(20)]
    wanted = extracted(spark, rows)
    monkeypatch.setattr(wrappers, "HELD_TOKENS", 10)
    assert extracted(spark, rows) == wanted == {i: f"Text {i}" for i in range(20)}
