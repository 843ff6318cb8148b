"""Keyed word hashes: no structure of words survives, and a key is all that they depend on."""

import numpy as np
import pyarrow as pa
import pytest

from glossmill.llm.words import NOT_SPACE, WordKey, words_of


def hashes(words, key):
    (part,) = words_of(pa.array([" ".join(words)]), NOT_SPACE, False)
    return part.hashes(key)


@pytest.mark.parametrize("seed", [0, 1, (1 << 128) - 1])
def test_words_of_like_form_differ(seed):
    letters = "abcdefghijklmnop"
    words = [a + "xxxxxxx" + b + "yyyyyyy" for a in letters for b in letters]  # one letter in each eight bytes
    words += [f"{a}{b}{c}{d}" * n for a in letters for b in letters for c in "ab" for d in "01" for n in (1, 2, 3, 4, 5)]
    words += ["a" * n for n in range(1, 600)] + ["rs18bf38k17b4gxy", "8cmzhkvd9b1dwzlg"]
    found = hashes(words, WordKey(seed))
    assert len(np.unique(found)) == len(set(words))
    assert (found == hashes(words, WordKey(seed))).all()
    assert not (found == hashes(words, WordKey(seed ^ 5))).any()


def test_sums_of_hashes_keep_nothing_of_the_words():
    """Words whose pieces have equal sums do not have hashes of equal sums."""
    a, b, c, d = hashes(["aaaa", "cccc", "bbbb", "bbbb"], WordKey.drawn())
    assert int(a) + int(b) != int(c) + int(d)


def test_keys_are_drawn_anew():
    assert WordKey.drawn() != WordKey.drawn()
