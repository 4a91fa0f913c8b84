"""What the features of a text are, and what they cost."""

from __future__ import annotations

import random
import sys
from collections import Counter

import numpy as np
import pytest

from countstats.llm import quality

SPACE = " \t\n\r\x0b\x0c"
ODD = [None, "", " ", "\n", ".", "a", "a.", "a. b", ". .", "A a A a.", "a\n\na\n", "..  .\n", "\x1c.\x1d b.\x85", "é.  ß !", "\ud800. x", "\x0b.\x0c", ".\x00 .", "a. " * 700_000]


def style(text):
    """The features beside the content, by definition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, lines = data.lower().split(), [x for x in data.split(b"\n") if x.strip()]
    w, n, counts = max(1, len(words)), max(1, len(data)), Counter(words)
    ranges = [(65, 91), (97, 123), (48, 58)]
    classes = [bytes(range(*r)) for r in ranges] + [bytes(x for x in range(33, 127) if not chr(x).isalnum()), SPACE.encode(), bytes(range(128, 256)), b".,;:", b"!?", b"|#$%&*"]
    shares = [sum(data.count(bytes([x])) for x in c) / n for c in classes]
    ended = sum(x[-1:] in b".,!?#$%&*|" for x in words) / w
    twice = sum(x == y for x, y in zip(words, words[1:])) / w
    return [*shares, np.log1p(len(words)), len(data) / w / 10, len(counts) / w, len(counts) / np.sqrt(w) / 10, max(counts.values(), default=0) / w, twice, ended, len(set(lines)) / max(1, len(lines)), np.log1p(w / max(1, len(lines)))]


def test_style_by_definition():
    rng = random.Random(5)
    made = ["".join(rng.choices("aAbB9.,!?|#;:é\ud800\x00\x1c" + SPACE, k=rng.randrange(60))) for _ in range(2000)]
    for text in ODD + made:
        assert np.array_equal(quality.text_features(text)[: quality._STYLE], style(text)), repr(text)[:80]


@pytest.mark.parametrize("words", [["ab.", "cd", "cd"], [f"w{i}" for i in range(20_000)]])
def test_no_python_code_runs_for_each_word(words):
    """In 30,000 words, few or many of them different."""
    text, calls = " ".join((words * 10_000)[:30_000]), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        quality.text_features(text)
    finally:
        sys.setprofile(before)
    assert calls < 1000
