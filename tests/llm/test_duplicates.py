import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from curatrix.llm import exact, minhash, repeats


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize(("block", "mask"), [(8192, -1), (7, -1), (7, 3)])
def test_exact_groups(docs, corpus, block, mask):
    """``mask`` leaves two bits of the hash, so that most blocks clash."""
    groups = defaultdict(list)
    for i, t in corpus:
        if i != 60:
            groups[norm(t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = exact.exact_duplicates(docs.filter("doc_id <> 60"), block_chars=block, hash_mask=mask).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_exact_odd_rows(odd, none):
    rows = exact.exact_duplicates(odd).collect()
    assert exact.exact_duplicates(none).collect() == []
    assert sum(r.doc_id == 7 for r in rows) == 1
    lost = [r for r in rows if r.doc_id is None]
    assert lost and all(r.keep_id is not None and not r.kept for r in lost)


def components(corpus, width):
    sets = {i: minhash.shingle_set(minhash.shingle_words(t), width) for i, t in corpus}
    low = {i: i for i in sets}
    ids = sorted(sets)
    while True:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and low[b] > low[a]:
                    low[b], changed = low[a], True
        if not changed:
            return {i: (len(sets[i]), low[i], low[i] == i) for i in ids}


@pytest.mark.parametrize(("width", "long_list"), [(2, 32), (5, 32), (2, 2)])
def test_near_components(docs, corpus, width, long_list, monkeypatch):
    """With 2, nearly all lists are long."""
    monkeypatch.setattr(minhash, "LONG_LIST", long_list)
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(docs, width=width).collect()}
    assert got == components(corpus, width)


def test_near_many_small_lists(spark):
    """Chains: each text is near to the next one, not to the ones after."""
    rows = [(k, " ".join(f"w{j}" for j in range(2 * k, 2 * k + 30))) for k in range(60)] + [(100 + k, " ".join(f"v{(j * k) % 31}" for j in range(40))) for k in range(1, 30)]
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == components(rows, 2) and got[59][1] == 0


def test_near_family_makes_no_row_per_pair(spark, monkeypatch):
    """Copies of one text that lie about the threshold from one another; many have no link."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(w if rng.random() > 0.1 else f"v{rng.integers(60)}" for w in base)) for k in range(260)]
    made, write = [], minhash.stored

    def counted(df, name):
        out = write(df, name)
        made.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    want = components(rows, 2)
    for part in (256, 40):
        made.clear()
        monkeypatch.setattr(minhash, "PART", part)
        got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
        assert got == want and len({c for _, c, _ in want.values()}) > 20
        assert sum(made) < 12 * len(rows)  # all pairs: 129 each


def test_near_confirms_without_all_texts(spark, monkeypatch):
    """Pairs are confirmed from the texts of their own classes; the table of all texts is not joined each time."""
    rng = random.Random(8)
    common = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.sample(common, 40)) for _ in range(60)]
    texts += [texts[0] + " tail", texts[1] + " end"]
    files, joined, stored = [], [], minhash.stored

    def watched(df, name):
        if name == "links":
            joined.append(set(df.inputFiles()))
        out = stored(df, name)
        if name == "texts" and not files:
            files.extend(out.inputFiles())
        return out

    monkeypatch.setattr(minhash, "stored", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, width=2).collect()}
    assert got == {k: {60: 0, 61: 1}.get(k, k) for k in range(62)}
    assert files and joined and not any(j & set(files) for j in joined)


def test_near_frequent_shingles_make_no_candidates(spark, monkeypatch):
    """Unrelated texts of a small vocabulary, as in large tables: other texts have each of their shingles too, yet few texts are looked at again."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(60)) for _ in range(400)]
    texts += [texts[k] + " tail" for k in range(8)]
    rows, made, stored = list(enumerate(texts)), {}, minhash.stored

    def watched(df, name):
        out = stored(df, name)
        made.setdefault(name, out.count() if name in ("texts", "lists") else 0)
        return out

    monkeypatch.setattr(minhash, "stored", watched)
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == components(rows, 2) and sum(low != i for i, (_, low, _) in got.items()) == 8
    assert made["texts"] < 60 and made["lists"] < 2 * 8 * minhash.KEYS + 60  # before: 408 texts


def test_least_values_agree_as_often_as_sets_are_similar():
    functions = minhash.hash_functions(minhash.KEYS * minhash.KEY_VALUES)
    rng = np.random.default_rng(2)
    for n in (5, 10, 700):
        agreed = []
        for _ in range(200):
            values = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            values[0] >>= np.uint64(32)  # no value is least under all functions, whatever its upper half
            a, b = values[: n * 9 // 10], np.concatenate([values[: n * 8 // 10], values[n * 9 // 10 :]])
            agreed.append(minhash.least_values(a, functions) == minhash.least_values(b, functions))
        keys = np.array(agreed).reshape(200, minhash.KEYS, minhash.KEY_VALUES).all(2).sum(1)
        assert abs(np.mean(agreed) - 0.8) < 0.02 and keys.min() > 3


def test_near_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert minhash.near_duplicates(none).collect() == []
    assert len(rows) == odd.count()
    assert {(r.component_id, r.kept) for r in rows if r.doc_id is None and r.n_shingles > 40} == {(7, False)}


def removed(corpus, width=13):
    first = {}
    for i, t in sorted(corpus, key=lambda r: r[0]):
        w = repeats.words_of(t)
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), i)
    out = {}
    for i, t in corpus:
        w = repeats.words_of(t)
        gone = {q for p in range(len(w) - width + 1) if first[tuple(w[p : p + width])] < i for q in range(p, p + width)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for q, x in enumerate(w) if q not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("size", [repeats.FILTER_BYTES, 4096])
def test_repeats(docs, corpus, size):
    got = repeats.repeats(docs, filter_bytes=size).collect()
    assert {r.doc_id: tuple(r)[1:4] for r in got} == removed(corpus)
    for r in got:
        assert r.n_removed == sum(x["last"] - x["first"] + 1 for x in r.removed)
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_repeats_odd_rows(odd, corpus, none):
    rows = repeats.repeats(odd).collect()
    want = removed(corpus)
    assert repeats.repeats(none).collect() == [] and len(rows) == odd.count()
    assert all(tuple(r)[1:4] == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)


def test_window_keys_are_consistent():
    """Equal windows have equal keys wherever they stand."""
    rng = np.random.default_rng(0)
    for trial in range(150):
        texts = [rng.choice(rng.integers(1, 6), rng.integers(1, 60)) for _ in range(5)]
        if trial % 3 == 0:
            texts = [np.repeat(t, rng.integers(1, 6, len(t))) for t in texts]
        sizes = np.array([len(t) for t in texts])
        h = rng.choice(1 << 62, 6).astype(np.uint64)[np.concatenate(texts)]
        first = np.zeros(len(h), bool)
        first[np.cumsum(sizes) - sizes] = True
        ends = np.repeat(np.cumsum(sizes), sizes)
        for rounds in (0, 1, 3, 5):
            keys, seen = repeats.window_keys(h, first, 13, rounds), {}
            for p in np.flatnonzero(np.arange(len(h)) + 13 <= ends):
                assert seen.setdefault(h[p : p + 13].tobytes(), keys[p]) == keys[p]


def test_windows_take_one_python_step(docs, monkeypatch):
    """Texts are split from their copies and cut into windows by one Python worker of a task."""
    steps, write = {}, repeats.stored

    def seen(df, name):
        steps[name] = df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        return write(df, name)

    monkeypatch.setattr(repeats, "stored", seen)
    repeats.repeats(docs)
    assert steps["windows"] == 2
