import random

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.functions import fuzzy as fz


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


words = st.text(alphabet="abcd ", max_size=14)


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_ratio_is_indel(a, b):
    want = 100.0 if not a and not b else 200.0 * slow_lcs(a, b) / (len(a) + len(b))
    assert abs(fz.ratio(a, b) - want) < 1e-9
    assert fz.ratio(a, b) == fz.ratio(b, a)


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_partial_is_best_window(a, b):
    s, t = sorted((a, b), key=len)
    if not s:
        assert fz.partial(a, b) == (100.0 if not t else 0.0)
        return
    m = len(s)
    windows = {t[max(0, e - m):min(e, len(t))] for e in range(1, len(t) + m)}
    best = max(200.0 * slow_lcs(s, w) / (m + len(w)) for w in windows)
    if len(s) == len(t):
        best = max(best, *(200.0 * slow_lcs(t, s[max(0, e - m):min(e, m)]) / (m + min(e, m) - max(0, e - m)) for e in range(1, 2 * m)))
    assert abs(fz.partial(a, b) - best) < 1e-9
    cut = fz.partial(a, b, 80.0)
    assert cut == (best if best >= 80.0 else 0.0) or abs(cut - best) < 1e-9


def test_token_scores():
    assert fz.partial("Edelweiss Club", "Victoria Edelweiss Club") == 100.0
    assert fz.token_sort("club edelweiss", "edelweiss club") == 100.0
    assert fz.token_set("edelweiss club", "victoria edelweiss club") == 100.0
    assert fz.token_set("", "x") == 0.0
    assert 0 < fz.token_set("blue hall", "red hall") < 100


def test_batches_equal_the_row_forms():
    rng = random.Random(5)
    signs = "abcde  éß日😀"
    texts = ["", " ", "a", "b" * 64, "ab" * 33, "c" * 200] + ["".join(rng.choice(signs) for _ in range(rng.choice([3, 10, 20, 63, 64, 65, 130, 300]))) for _ in range(120)]
    a, b = (rng.choices(texts, k=900) for _ in range(2))
    for many, one in ((fz.ratios, fz.ratio), (fz.token_sorts, fz.token_sort), (fz.token_sets, fz.token_set)):
        assert np.allclose(many(a, b), [one(x, y) for x, y in zip(a, b)], atol=1e-9)
    short = [(x, y) for x, y in zip(a, b) if len(x) < 70 and len(y) < 70]
    a, b = (list(side) for side in zip(*short))
    for cutoff in (0.0, 80.0):
        assert np.allclose(fz.partials(a, b, cutoff), [fz.partial(x, y, cutoff) for x, y in short], atol=1e-9)
    assert fz.ratios([], []).tolist() == []
