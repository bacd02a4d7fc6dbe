"""Template texts are told by their place in the aligned expression of a host."""

import random

from textlab.llm import wrappers
from tests.llm.test_pages import extracted


def test_a_text_at_one_path_but_different_places_is_no_template(spark):
    def page(i):
        answer = ["<p>Yes</p>" if i % 3 == n else "" for n in range(3)]
        return (
            f"<body><h1>Our site</h1><h2>Question {i}</h2>{answer[0]}<hr><h3>Poll {i}</h3>{answer[1]}"
            f"<table><tr><td>Votes {i}</td></tr></table>{answer[2]}<h4>Good bye</h4></body>"
        )

    found = extracted(spark, [(i, "http://h.example/", page(i)) for i in range(12)])
    for i in range(12):
        words = [f"Question {i}", f"Poll {i}", f"Votes {i}"]
        words.insert(i % 3 + 1, "Yes")
        assert found[i] == " ".join(words)


def test_an_inserted_part_does_not_move_the_template(spark):
    advert = "<section><h5>Offer {i}</h5><p>Buy {i}</p></section>"
    rows = [
        (i, "http://h.example/", f"<body><p>Hello</p>{advert.format(i=i) if i % 2 else ''}<h2>Text {i}</h2><h4>Bye</h4></body>")
        for i in range(10)
    ]
    found = extracted(spark, rows)
    assert found == {i: f"Offer {i} Buy {i} Text {i}" if i % 2 else f"Text {i}" for i in range(10)}


def test_matching_finds_common_stretches_with_and_without_anchors(monkeypatch):
    draw = random.Random(5)
    for most in (wrappers.MAX_COMPARED, 20):
        monkeypatch.setattr(wrappers, "MAX_COMPARED", most)
        for _ in range(200):
            a = [draw.choice("abcdefgh") for _ in range(draw.randrange(30))]
            b = [t for t in a if draw.random() < 0.7] + [draw.choice("abcdefgh") for _ in range(draw.randrange(4))]
            x = y = 0
            for i, k, n in wrappers.matching(a, b):
                assert i >= x and k >= y and a[i : i + n] == b[k : k + n]
                x, y = i + n, k + n
    letters = [str(i) for i in range(3000)]
    kept = [t for t in letters if int(t) % 3]
    assert sum(n for *_, n in wrappers.matching(letters, kept)) == len(kept)
