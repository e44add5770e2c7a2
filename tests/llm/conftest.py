import random

import pytest

WORDS = ["alpha", "Beta", "gamma,", "delta", "the", "of", "ñandú", "Éa", "x", "re.", "zeta", "eta"]


def document(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, shared passages, a long text, runs of one word."""
    rng = random.Random(5)
    passage = document(rng, 40)
    base = document(rng, 60)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (6, "word word word"), (7, base), (8, base.replace(" ", "  ", 3)), (9, base)]
    for k in range(10, 30):
        words = base.split()
        words[rng.randrange(60)] = f"changed{k}"
        rows.append((k, " ".join(words)))
    for k in range(30, 45):
        rows.append((k, document(rng, 20) + "\n" + passage + "\n" + document(rng, rng.randrange(30))))
    rows += [(50, " ".join(["be"] * 40)), (51, " ".join(["be"] * 25 + ["no"] * 25)), (52, " ".join(["be"] * 7 + ["no"] * 30)), (53, document(rng, 12)), (54, document(rng, 13))]
    rows += [(60, document(rng, 30_000)), (61, "日本語 テキスト \u00a0 x\u0000y 😀"), (-3, passage), (2**53 + 1, base + " tail"), (2**53 + 3, "<|endoftext|> Don't ▁stop")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src", 1, "a", 2.0, [3], True) for i, t in corpus]
    names = "doc_id long, text string, lang string, source string, n int, hash string, score double, sketch array<int>, kept boolean"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def odd(spark, docs):
    """The corpus with repeated rows and rows without id."""
    return docs.unionByName(docs.filter("doc_id in (4, 7, 30)")).unionByName(docs.filter("doc_id in (2, 7, 50)").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
