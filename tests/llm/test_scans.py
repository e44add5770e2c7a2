import random

import pytest

from curatrix.llm import decontam, hosts, licenses

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Solo"), (3, None), (4, "..."), (10, "TWO, three; four five six seven eight nine ten eleven"), (5, "café au lait")]


def brute(text, items, width=10):
    words = decontam.normal_words(text)
    hit, ids = set(), set()
    for item, t in items:
        w = decontam.normal_words(t)
        n = min(width, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in wins:
                hit.update(range(p, p + n))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("size", [decontam.AUTOMATON_BYTES, 20])
def test_decontamination(spark, docs, corpus, size):
    """With 20 bytes each item is a part of its own."""
    rng = random.Random(2)
    words = (ITEMS[0][1] + " Solo café, au lait x").split()
    texts = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(100, 130)]
    texts += [(200, "x " + ITEMS[0][1].upper() + "! solo"), (201, "«" + ITEMS[0][1]), (202, "soloist"), (203, "Café\nau--lait")]
    rows = corpus + texts
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(table, bench, automaton_bytes=size).collect()}
    for i, t in rows:
        n, hit, ids = brute(t, ITEMS)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) == (n, hit, len(ids), ids, hit > 0)
    assert [decontam.normal_words(texts[-4][1][s["start"] : s["end"]]) for s in got[200].spans if s["item_id"] == "2"] == [[b"solo"]]


def test_decontamination_edges(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not any(r.contaminated for r in decontam.decontaminate(odd, empty).collect())
    assert decontam.decontaminate(none, bench).collect() == []
    assert decontam.decontaminate(odd, bench).count() == odd.count()


def test_license_wordings():
    scanner = licenses.LicenseScanner()
    for name, text in licenses.TEMPLATES:
        k = licenses.TEMPLATES.index((name, text))
        assert sum(any(s in w for s in licenses.STEMS) for w in scanner.words[k]) > scanner.allowed[k]
        (found,) = scanner.scan(f"Some words before.\n{text.upper()}\nand after")
        assert (found["license"], found["differences"]) == (name, 0)
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    (found,) = scanner.scan(mit.replace("free of charge", "gratis").replace("any person", "every person"))
    assert found["license"] == "MIT" and sorted(found["wording"]) == ["any > every", "free of charge > gratis"]
    assert scanner.scan("Licensed under CC BY-XX 4.0. This software has a license, copyright and warranty.") == []
    two = scanner.scan("Released under the MIT License. Released under the MIT License. Licensed under CC BY 4.0.")
    assert [m["license"] for m in two] == ["MIT", "MIT", "CC-BY-4.0"]


def test_license_table(spark, odd, none):
    assert licenses.scan_licenses(none).collect() == []
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == odd.count() and all((r.n_matches, r.licenses, r.matches) == (0, "", []) for r in rows)


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Net", "http://a.net/", "https://x.example.NET/en/1?q#f", "http://notexample.com/de/1", "http://example.com/de/1", "ftp://a?b://c/d", "http://h/p#x?y", "a://b://c/d", "http://\nx/y\nz"]
    pages = spark.createDataFrame([(k, u, "x", 1.0) for k, u in enumerate(urls)], "page_id long, url string, host string, mean double")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge_urls(pages, none, RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "", None, "allow"), 4: ("a.net", "/", "net/", "block"),
        5: ("x.example.net", "/en/1", "example.net/en/", "allow"), 6: ("notexample.com", "/de/1", None, "allow"), 7: ("example.com", "/de/1", "example.com/de/", "block"),
        8: ("a", "", None, "allow"), 9: ("h", "/p", None, "allow"), 10: ("b:", "//c/d", None, "allow"), 11: ("\nx", "/y\nz", None, "allow"),
    }
    assert hosts.judge_urls(pages.filter("false"), none, RULES).collect() == []


def test_reputation_shrinks(spark):
    """A host with few bad pages is judged by its domain; one with many by itself."""
    pages, bad = [], []
    for host, n, share in (("good.site.org", 60, 0.02), ("few.site.org", 1, 1.0), ("bad.spam.com", 80, 0.95), ("new.spam.com", 2, 1.0), ("fresh.spam.com", 1, None), ("ok.fine.com", 80, 0.05)):
        for k in range(n):
            pages.append((len(pages), f"http://{host}/{k}"))
            if share is not None:
                bad.append((len(pages) - 1, int(k < share * n)))
    got = hosts.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad + [bad[0], (10**6, 1), (3, 7)], "page_id long, bad int"), ())
    verdict = {r.host: r.verdict for r in got.collect()}
    assert verdict["bad.spam.com"] == "block" and verdict["good.site.org"] == verdict["ok.fine.com"] == verdict["few.site.org"] == "allow"
    share = {r.host: r.bad_share for r in got.collect()}
    assert share["few.site.org"] < share["new.spam.com"] and share["fresh.spam.com"] > share["few.site.org"]
