import datetime as dtm
import random

from pyspark.sql import functions as F

from curatrix.functions import fuzzy as fz
from curatrix.functions import text as tx
from curatrix.operators import address as ad
from curatrix.operators import entity as ent
from curatrix.operators import joins
from curatrix.operators import keyed
from curatrix.operators import maintain as mt
from curatrix.operators import metrics
from curatrix.operators import rules as rl
from curatrix.operators import windows as win
from curatrix.operators.graph import connected_components

D = dtm.date(2026, 1, 1)


def hot_rows(n, seed):
    """Half of the rows share one place and date, many times repeat."""
    rnd = random.Random(seed)
    return [(i, 1 if rnd.random() < 0.5 else rnd.randrange(5), D, rnd.choice([0, 450, 900, 901, 1800, rnd.randrange(7200)]), rnd.choice([0, 899, 900, 901, rnd.randrange(7200)])) for i in range(n)]


def test_time_window_losers_match_brute_force(spark):
    for seed in range(3):
        rows = hot_rows(300, seed)
        df = spark.createDataFrame(rows, "event_id long, place long, start_date date, start_sec int, end_sec int")
        got = {r[0] for r in joins.time_window_losers(df, ["place", "start_date"]).collect()}
        want = {a[0] for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[3] - b[3]) <= 900 and abs(a[4] - b[4]) <= 900}
        assert got == want


def test_conflicts_match_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(3), rnd.choice("abcc")) for i in range(60)] + [(100, 0, None)]
    df = spark.createDataFrame(rows, "event_id long, slot long, name string")
    pairs = {(r.event_id_1, r.event_id_2) for r in joins.venue_conflict_pairs(df, ["slot"], "name").collect()}
    live = [r for r in rows if r[2]]
    assert pairs == {(a[0], b[0]) for a in live for b in live if a[0] < b[0] and a[1] == b[1] and a[2] != b[2]}
    per_row = {r.event_id: (r.conflicts, r.first_conflict_id) for r in joins.venue_conflict_rows(df, ["slot"], "name").collect()}
    for a in live:
        other = [b[0] for b in live if b[1] == a[1] and b[2] != a[2]]
        assert per_row[a[0]] == (len(other), min(other))


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == components(edges)


def test_fuzzy_dedup_is_order_free_and_transitive(spark):
    names = ["Salsa Night", "Salsa Nights", "Salsa  Nightss", "Tango Ball", "Tango Ball", "Quiet"]
    rows = [(i, n, D, 100, "src", "" if i else "https://src.org", None if i == 0 else "Hall", dtm.datetime(2026, 1, 1)) for i, n in enumerate(names)]
    schema = "event_id long, event_name string, start_date date, start_sec int, source string, url string, location string, time_stamp timestamp_ntz"
    results = []
    for order in (rows, rows[::-1]):
        kept, merged = ent.fuzzy_dedup(spark.createDataFrame(order, schema), ["start_date", "start_sec"])
        results.append((sorted(map(tuple, kept.select("event_id", "location", "url").collect())), sorted(map(tuple, merged.collect()))))
    assert results[0] == results[1]
    kept, merged = results[0]
    assert (0, "Hall", "https://src.org") in kept
    assert {m[0] for m in merged} == {0, 1, 2, 3, 4}
    # brute force pairs above the threshold give the same groups
    edges = [(i, j) for i in range(6) for j in range(i + 1, 6) if fz.ratio(names[i], names[j]) > 80]
    assert {m[0]: m[1] for m in merged} == components(edges)


def test_similar_vectors_in_cells(spark):
    import numpy as np

    from curatrix.operators import vectors

    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 12))
    # a large block of clusters, one hot vector many times, a small block, null vectors
    rows = [(i, 0, (centres[i % 40] + rnd.normal(size=12) * 0.08).tolist()) for i in range(1200)]
    rows += [(2000 + i, 0, centres[0].tolist()) for i in range(150)] + [(3000 + i, 1, rnd.normal(size=12).tolist()) for i in range(40)]
    rows += [(4000, 0, [0.0] * 12), (4001, 0, None), (4002, None, [1.0] * 12)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, label int, vec array<double>, rn int, _x string")
    known = [(i, b, np.array(v) / (np.linalg.norm(v) or 1)) for i, b, v in rows if b is not None and v is not None]
    for limit in (0.95, 0.6):
        want = set()
        for b in (0, 1):
            ids, mat = zip(*[(i, v) for i, x, v in known if x == b])
            a, c = np.nonzero(np.triu(np.stack(mat) @ np.stack(mat).T >= limit, 1))
            want |= {tuple(sorted((ids[i], ids[j]))) for i, j in zip(a, c)}
        got = [(r.id_a, r.id_b) for r in ent.similar_vectors(df, ["label"], "id", "vec", limit, tile_rows=100).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    sized = df.filter("label = 0 and vec is not null").selectExpr("xxhash64(label) _h", "label", "id _id", "vec _v", "1351L _n")
    placed, paying = vectors.cells(sized, 0.95, 100)
    # tiles would ship each row 14 times
    assert paying.count() == 1 and placed.count() < 3 * 1351 and placed.filter("_home").count() == 1351
    noise = spark.createDataFrame([(1, 0, i, rnd.normal(size=12).tolist(), 1500) for i in range(1500)], "_h long, label int, _id long, _v array<double>, _n long")
    assert vectors.cells(noise, 0.3, 500) is None


def test_similar_vectors_in_tiles(spark):
    rnd = random.Random(9)
    rows = [(i, 1 if i % 3 else 2, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) >= 0.6}
    for tile in (1000, 7):
        got = [(r.id_a, r.id_b) for r in ent.similar_vectors(df, ["label"], "id", "vec", 0.6, tile_rows=tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_density_clusters_with_min_points(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (8, 9)], "id_a long, id_b long")
    got = {r.id: r.component for r in ent.density_clusters(pairs, 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}


def test_survivor_prefers_row_whose_source_fits_its_url(spark):
    rows = [(1, "red hot swing", "https://redhotswing.com/x", None, dtm.datetime(2026, 1, 1)), (2, "other", "https://redhotswing.com/x", "full", dtm.datetime(2026, 2, 1))]
    df = spark.createDataFrame(rows, "event_id long, source string, url string, location string, time_stamp timestamp_ntz")
    assert df.orderBy(ent.survivor_rank(df, ["location"])).first().event_id == 1


def test_penalty_makes_score_negative(spark):
    row = [(1, "Hall A", "d", "n", "Noisy", "s", "t", 5, "u", 7)]
    df = spark.createDataFrame(row, "event_id long, location string, description string, event_name string, source string, dance_style string, event_type string, start_sec int, url string, address_id long")
    a = spark.createDataFrame([(7, "V8N 1S3")], "address_id long, postal_code string")
    p = spark.createDataFrame([("noisy", None, 100.0)], "source_equals string, source_contains string, penalty double")
    assert ent.canonical_score(df, a, p).first().score < 0


def test_contained_in_text_matches_brute_force(spark):
    texts = ["meet at the loft pub tonight", "loft.", "aloft now", "the  loft", "(coda) club", "wicket hall2", "xx-yy", "", "éclair café bar"]
    needles = ["the loft", "loft", "coda", "wicket hall", "x-y", "loft pub tonight", "café b", "-", "t the loft p"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    n = spark.createDataFrame(list(enumerate(needles)), "nid long, needle string")
    got = sorted((r.id, r.nid) for r in rl.contained_in_text(d, "id", "body", n, "nid", "needle").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, x in enumerate(needles) if x in t)


def test_resolve_address_finds_existing_building(spark):
    a = spark.createDataFrame([(5, "Method Studio", "12", "Oak", "Victoria", "V8N 1S3"), (9, "Wicket Hall", "99", "Elm", "Victoria", "V8W 2B2")],
                              "address_id long, building_name string, street_number string, street_name string, city string, postal_code string")
    p = spark.createDataFrame([(1, "Method Studios", "12", "Oak", "Victoria", ""), (2, "Wicket Hall", "", "", "Victoria", ""), (3, "Brand New Place", "1", "Fir", "Victoria", "")],
                              "k long, building_name string, street_number string, street_name string, city string, postal_code string")
    matched, inserts = ad.resolve_address(p, a, "k")
    assert {(r.k, r.address_id, r.tier) for r in matched.collect()} == {(1, 5, 3), (2, 9, 4)}
    assert [(r.address_id, r.full_address) for r in inserts.collect()] == [(10, "Brand New Place, 1 Fir, Victoria")]


def test_fuzzy_names_equal_all_pairs(spark):
    """Misspelt single words share no token; every pair that reaches the threshold must be scored."""
    rnd = random.Random(5)

    def bend(t):
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(len(t))
            t = t[:i] + rnd.choice(["", "x", t[i] + "q"]) + t[i + 1 :]
        return t

    names = ["Edelweiss", "Fernwoods Inn", "Sunset Ballroom", "Hermann", "Dance Victoria", "Quartz", "The Hall", "Studio 4", "\u30c0\u30f3\u30b9\u30db\u30fc\u30eb"]
    said = ["Edelwiess", "Fernwood", "Fernwood Inns", "The Edelwiess Haus"] + [bend(rnd.choice(names)) for _ in range(60)]
    said += ["late " + bend(rnd.choice(names)) + " tonight" for _ in range(30)]
    a = spark.createDataFrame([(i, n, "1 Main, Victoria") for i, n in enumerate(names)], "address_id long, building_name string, full_address string")
    rows = list(enumerate(said))
    df = spark.createDataFrame(rows, "k long, t string")
    poor = {r.k for r in df.filter(tx.low_quality_location("t")).collect()}
    good = {r.address_id for r in a.filter(~tx.low_quality_name("building_name")).collect()}

    def best(t, limit, ids, ok):
        hits = [(fz.partial(n.lower(), t.lower()), -i) for i, n in enumerate(names) if i in ids]
        hits = [h for h in hits if ok(h[0], limit)]
        return -max(hits)[1] if hits else None

    want = {k: best(t, 85, good, lambda s, x: s >= x) for k, t in rows if k not in poor}
    got = {r.k: r.address_id for r in ad.best_building(df, a, "k", "t").collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and 0 in got and 1 in got
    six = {i for i, n in enumerate(names) if len(n) >= 6}
    inside = {k: min(i for i, n in enumerate(names) if n.lower() in t.lower()) for k, t in rows if any(n.lower() in t.lower() for n in names)}
    want = {k: inside[k] if k in inside else best(t, 80, six, lambda s, x: s > x) for k, t in rows}
    got = {r.k: r.address_id for r in ad.name_in_text(df, a, "k", "t").collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_names_without_tokens_meet_all_names(spark):
    """The gate of shared tokens holds only where both names have tokens."""
    names = ["Edelweiss", "The Hall 9", "Ab Cd Ef", "Fernwood Hall", "\u30c0\u30f3\u30b9\u30db\u30fc\u30eb", "Hal"]
    said = ["Edelwiess", "The Hal", "Ab Cd Eg", "Xab Cdef", "\u30c0\u30f3\u30b9\u30db\u30eb", "Fernwod", "Hall", "Ef Ab Cd", "Ed"]
    l, r = (spark.createDataFrame([(x,) for x in v], "name string") for v in (said, names))

    def token(v):
        return {x.name: set(x.t) for x in v.select("name", tx.venue_tokens("name").alias("t")).collect()}

    tl, tr = token(l), token(r)
    want = {(x, y) for x in said for y in names if not tl[x] or not tr[y] or tl[x] & tr[y]}
    scored = {(x, y): (fz.ratio(x, y), fz.partial(x, y), fz.token_set(x, y)) for x, y in want}
    want = {p for p, (x, y, z) in scored.items() if x >= 75 or y >= 80 or z >= 85}
    got = {(x.left_name, x.right_name) for x in ad.scored_names(l, r).filter("s.ratio >= 75 or s.partial >= 80 or s.token_set >= 85").collect()}
    assert got == want and ("Edelwiess", "Edelweiss") not in got and ("Ed", "Edelweiss") in got


def test_near_equal_text_without_tokens(spark):
    a = spark.createDataFrame([(3, "", "", "", "12 Ballroom Rd, Victoria"), (4, "Edelweiss", "", "", "108 Niagara, Victoria")],
                              "address_id long, building_name string, street_number string, street_name string, full_address string")
    df = spark.createDataFrame([(1, "12 Balroom Rd, Victoria"), (2, "108 Niagra, Victoria")], "k long, t string")
    assert {(r.k, r.address_id, r.step) for r in ad.quick_lookup(df, a, "k", "t").collect()} == {(1, 3, 5)}


def test_alias_rules(spark):
    rules = spark.createDataFrame([(0, "loft", "The Loft Pub", "", "", 7, "229", "")], "rule_order int, rule_name string, alias string, source_equals string, url_contains string, address_id long, street_number string, postal_code string")
    rows = spark.createDataFrame([(1, "the loft pub", ""), (2, "Upstairs at The Loft Pub!", "229"), (3, "The Loft Pub", "100"), (4, "Loft", "")], "k long, location string, street_number string")
    got = {(r.k, r.match_type, r.decision) for r in rl.alias_match(rows, rules, "k", ["location"]).collect()}
    assert got == {(1, "exact", "applied"), (2, "substring", "applied"), (3, "exact", "skipped_conflict")}


def test_trailing_count_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("aaab"), rnd.randrange(5000)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, s long")
    got = {r.id: r.recent for r in win.trailing_count(df, "k", "s", 600).collect()}
    assert got == {a[0]: sum(1 for b in rows if b[1] == a[1] and a[2] - 600 <= b[2] <= a[2]) for a in rows}


def test_global_rank_with_one_hot_value(spark):
    # nine tenths of the rows have one date; the ranges are cut within it
    rows = [("2024-01-01" if i % 10 else f"2024-02-{i // 10 % 28 + 1:02d}", f"k{i:05d}") for i in range(4000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows + [(None, "none")], "d string, k string")
    ranked = keyed.global_rank(df, ["d", "k"], "n")
    assert [(r.d, r.k) for r in ranked.orderBy("n").collect()] == [(None, "none")] + sorted(rows)
    assert sorted(r.n for r in ranked.collect()) == list(range(1, 4002))
    plan = keyed.global_rank(df, ["d", "k"], "n")._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert keyed.global_rank(df.filter("false"), ["d", "k"], "n").collect() == []


def test_exact_percentiles(spark):
    import numpy as np

    rnd = random.Random(4)
    rows = [("a", rnd.expovariate(1)) for _ in range(501)] + [("b", 3.0)] * 7 + [("c", float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in metrics.exact_percentiles(df, "g", "v", {"p50": 0.5, "p95": 0.95}, bins=16).collect()}
    for g in "abc":
        vals = [v for k, v in rows if k == g]
        assert np.allclose(got[g], np.percentile(vals, [50, 95]))
    # one far value puts all others into one part of the first pass, again and again
    far = [("d", 1e12 * 10.0**k) for k in range(1, 5)] + [("d", 1 + i * 1e-7) for i in range(300)] + [(None, -0.5), (None, 7.5)] + [("e", 2.0), ("e", None)]
    got = {r.g: (r.p50, r.p95) for r in metrics.exact_percentiles(spark.createDataFrame(far, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}, bins=64).collect()}
    for g in ("d", None, "e"):
        vals = [v for k, v in far if k == g and v is not None]
        assert np.allclose(got[g], np.percentile(vals, [50, 95]), rtol=1e-12)
    assert metrics.exact_percentiles(df.filter("false"), "g", "v", {"p50": 0.5}).collect() == []


def test_crawl_decision_order(spark):
    ts = dtm.datetime(2026, 1, 1)
    fbid = "https://www.facebook.com/events/5"
    log = spark.createDataFrame([(fbid, False, 5, ts, "rejected_old_facebook_event_detail"), ("https://a.org/faq", False, 9, ts, None), ("https://a.org/x", True, 9, ts, None), ("https://a.org/y", False, 9, ts, None)],
                                "link string, relevant boolean, crawl_try int, time_stamp timestamp, decision_reason string")
    urls = spark.createDataFrame([(x,) for x in (fbid, "https://a.org/faq", "https://a.org/x", "https://a.org/y", "https://new.org", "https://w.org/in/deep")], "link string")
    hist = spark.createDataFrame([], "url string, start_date date")
    blocked = spark.createDataFrame([], "url string")
    white = spark.createDataFrame([("https://w.org/in",)], "root string")
    got = {r.link: r.decision_reason for r in joins.crawl_decisions(urls, log, hist, blocked, white, F.lit("2026-02-01").cast("date")).collect()}
    assert got == {
        fbid: "skip_rejected_old_facebook_event_detail", "https://a.org/faq": "skip_low_value_path_after_irrelevant",
        "https://a.org/x": "process_last_relevant_and_stale_date", "https://a.org/y": "skip_default_rules",
        "https://new.org": "process_never_seen", "https://w.org/in/deep": "process_whitelisted",
    }


def test_more_rules_than_rows(spark):
    """Lists of any size meet the texts by key; patterns without words too."""
    rows = spark.createDataFrame([(1, "http://a.org/x--y", "Salsa!! night"), (2, None, "plain"), (3, "http://b.net/", "(salsa")], "k long, url string, text string")
    many = spark.range(3000).selectExpr("concat('zz', id) as domain")
    listed = many.unionByName(spark.createDataFrame([(" --y",), ("B.NET ",)], "domain string"))
    assert [r.k for r in rl.anti_contains(rows, listed).orderBy("k").collect()] == [2]
    words = many.selectExpr("domain as keyword").unionByName(spark.createDataFrame([("salsa",), ("!!",), ("(",)], "keyword string"))
    tagged = rl.tag_by_keywords(rows.withColumn("tags", F.lit("old")), words, ["text"], "tags")
    assert {r.k: (r.tags, r.changed) for r in tagged.collect()} == {1: ("!!, salsa", True), 2: ("old", False), 3: ("(, salsa", True)}
    pen = spark.createDataFrame([("salsa", None, 1.0), (None, "als", 2.0), ("salsa", "als", 4.0), (None, None, 9.0)], "source_equals string, source_contains string, penalty double")
    got = rl.source_penalties(spark.createDataFrame([("salsa",), ("salsas",), ("",)], "_t string"), pen)
    assert {r._t: r._penalty for r in got.collect()} == {"salsa": 7.0, "salsas": 6.0}


def test_repeated_delta_rows_and_chains(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    delta = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (3, "z")], "k long, v string")
    assert sorted(tuple(r) for r in mt.upsert(base, delta, ["k"]).collect()) == [(1, "y"), (2, "b"), (3, "z")]
    assert sorted(tuple(r) for r in mt.overlay(base, delta, ["k"]).collect()) == [(1, "y"), (2, "b")]
    labels = spark.createDataFrame([(1, "1"), (1, "0"), (2, "1"), (2, "1")], "k long, label string")
    assert sorted((r.k, r.decision) for r in joins.apply_labels(base, labels, "k", "label").collect()) == [(1, "invalid"), (2, "delete")]
    dim = spark.createDataFrame([(k,) for k in range(1, 9)], "address_id long")
    facts = spark.createDataFrame([(k, k) for k in range(1, 9)], "event_id long, address_id long")
    mapping = spark.createDataFrame([(3, 2), (2, 1), (4, 3), (4, 8), (5, 6), (6, 7), (7, 5)], "duplicate_id long, canonical_id long")
    kept, moved = ent.apply_merge(dim, facts, mapping, "address_id")
    assert sorted(r.address_id for r in kept.collect()) == [1, 5, 6, 7, 8]
    assert {r.event_id: r.address_id for r in moved.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8}


def test_percentiles_of_the_null_group(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 7.0), ("a", 1.0)], "g string, v double")
    got = {r.g: r.p50 for r in metrics.latency_summary(df, "g", "v", F.lit(False), 6).collect()}
    assert got == {None: 6.0, "a": 1.0}
