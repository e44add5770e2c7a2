"""Average linkage and address clusters against a matrix version."""

import random
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pytest

from curatrix.functions import fuzzy as fz
from curatrix.operators import entity as ent
from curatrix.operators.linkage import average_linkage


def average_link(names: Sequence[str], weights: Sequence[int], cut: float) -> list[int]:
    """Labels by merging the nearest pair one at a time on a full matrix."""
    n = len(names)
    dist = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            dist[i, j] = dist[j, i] = 100.0 - fz.ratio(names[i], names[j])
    np.fill_diagonal(dist, np.inf)
    size, label, alive = np.array(weights, dtype="float64"), list(range(n)), set(range(n))
    while len(alive) > 1:
        i, j = divmod(int(np.argmin(dist)), n)
        if dist[i, j] > cut:
            break
        merged = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
        dist[i], dist[:, i] = merged, merged
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive.discard(j)
        label = [i if x == j else x for x in label]
    return label


def names_near(rng, bases, n):
    out = set()
    while len(out) < n:
        name = list(rng.choice(bases))
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(name))
            name[at : at + rng.randrange(2)] = rng.choice("abcdefghijklmnopqrstuvwxyz ")
        out.add("".join(name))
    return sorted(out, key=lambda _: rng.random())


@pytest.mark.parametrize("seed", [1])
def test_rounds_equal_the_matrix_version(spark, seed):
    rng = random.Random(seed)
    bases = ["grand victoria ballroom and lounge", "the old harbour dance studio", "royal oak community hall west", "north shore salsa social club"]
    names = names_near(rng, bases, 26)
    weights = [rng.randrange(1, 9) for _ in names]
    want = average_link(names, weights, 30)
    items = spark.createDataFrame(list(zip(range(len(names)), names, weights)), "id long, name string, w long")
    pairs = [(i, j, fz.ratio(names[i], names[j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    links = spark.createDataFrame([p for p in pairs if p[2] >= 70], "id_a long, id_b long, score double")
    got = {r.id: r.cluster for r in average_linkage(items, links, 30).collect()}
    assert got == dict(enumerate(want)) and 1 < len(set(want)) < len(names)


def test_average_link_joins_weighted_names(spark):
    names = ["hall one", "hall ones", "hall two"]
    assert average_link(names, [3, 1, 1], 30) == [0, 0, 0]
    items = spark.createDataFrame([(k, n, w) for k, (n, w) in enumerate(zip(names, [3, 1, 1]))], "id long, name string, w long")
    links = spark.createDataFrame([(i, j, fz.ratio(names[i], names[j])) for i in range(3) for j in range(i + 1, 3)], "id_a long, id_b long, score double")
    assert {r.cluster for r in average_linkage(items, links, 30).collect()} == {0}
    assert {r.cluster for r in average_linkage(items, links.filter("false"), 30).collect()} == {0, 1, 2}
    assert average_linkage(items.filter("false"), links, 30).collect() == []


def test_subclusters_and_rules(spark):
    rng = random.Random(7)
    rows, key = [], 0
    for cluster in range(2):
        for name in names_near(rng, ["victoria event centre", "vic event center hall", "harbour lights"], 7):
            for _ in range(rng.randrange(1, 4)):
                rows.append((key, cluster, name, str(key % 5), "Main", "Victoria", ""))
                key += 1
    rows += [(key, 0, None, "1", "Main", "Victoria", ""), (key + 1, 0, " ", "1", "Main", "Victoria", "")]
    df = spark.createDataFrame(rows, "address_id long, component long, building_name string, street_number string, street_name string, city string, postal_code string")
    got = {r.address_id: r.subcluster for r in ent.name_subclusters(df, "component", "building_name", "address_id").collect()}
    want = {}
    for cluster in range(2):
        ids = defaultdict(list)
        for r in rows:
            if r[1] == cluster and (r[2] or "").strip():
                ids[r[2]].append(r[0])
        names = sorted(ids, key=lambda n: min(ids[n]))
        first = average_link(names, [len(ids[n]) for n in names], 30)
        for label in set(first):
            at = [i for i, x in enumerate(first) if x == label]
            part = [names[i] for i in at]
            sub = average_link(part, [len(ids[n]) for n in part], 15) if sum(len(ids[n]) for n in part) >= 5 else [0] * len(part)
            for n, s in zip(part, sub):
                want |= {i: min(ids[part[s]]) for i in ids[n]}
    want |= {key: key, key + 1: key + 1}
    assert got == want
    sub = spark.createDataFrame(list(got.items()), "address_id long, subcluster long")
    decided = {r.subcluster: (r.size, r.decision) for r in ent.address_cluster_rules(df.join(sub, "address_id")).collect()}
    sizes = defaultdict(int)
    for s in got.values():
        sizes[s] += 1
    assert {s: n for s, (n, _) in decided.items()} == {s: n for s, n in sizes.items() if n > 1}
    assert all((n > 4) == (d == "skip_large_group") for n, d in decided.values())
