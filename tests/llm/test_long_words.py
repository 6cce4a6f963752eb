"""Training takes words of every length."""

import numpy as np
import pytest

from terraloom.llm import langid

VOCAB = {p: k for k, p in enumerate(["a", "b", "c", "ab", "abc", " ", " a", "ca"])}


def test_long_words_are_counted_whole():
    words, probs = sorted([" " + "abc" * 3, " " + "abca" * 100, " " + "xab" * 700], key=len), np.full((len(VOCAB) + 1, 2), 1e-3)
    probs[:, 1] = np.linspace(1e-6, 1e-2, len(VOCAB) + 1)
    expected, n = np.zeros((len(VOCAB) + 1, 2)), np.array([[1.0, 2.0], [3.0, 1.0], [1.0, 5.0]])
    langid._expect(words, n, VOCAB, probs, expected)
    letters = np.array([*map(len, VOCAB), 1]) @ expected  # every segmentation covers all characters
    assert letters == pytest.approx(np.array([*map(len, words)]) @ n, rel=1e-9)


def test_scripts_without_spaces_are_learnt():
    languages, probs = langid.fit({("x", "ab" * 60): 3, ("y", "bc" * 60): 3}, VOCAB)
    assert languages == ["x", "y"] and probs[VOCAB["ab"], 0] > 5 * probs[VOCAB["ab"], 1] and probs[VOCAB["c"], 1] > 5 * probs[VOCAB["c"], 0]
