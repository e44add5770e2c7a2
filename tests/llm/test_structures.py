"""Record bundles, prefix tries and phrase streams against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs
import pytest
import zstandard

from curatrix.llm import phrases, prefixes, warc
from curatrix.llm.common import shared_folder

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/ü\r\nEvil: 1", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "u5", "é" * 3000), (6, "u6", "<p>one</p>"),
    (6, "u6", "<p>one</p>"), (7, "u7", "x" * 200_000), (None, "u8", "<p>one</p>"), (None, "u9", "alone"), (8, "u10", "WARC/1.1\r\n\r\nWARC-Type: response"), (8, "u11", "other"),
    (9, "u12", "<p>low</p>"), (-5, "u13", "<p>low</p>"),
]


def pages_of(spark, rows):
    wide = [(*r, "x", 1, [b"y"], {"a": 1}) for r in rows]
    return spark.createDataFrame(wide, "page_id long, url string, html string, digest string, n int, payload array<binary>, m map<string,int>")


def plain_archive(rows):
    tops = {}
    for i, _, h in rows:
        if i is not None:
            tops[h or ""] = max(i, tops.get(h or "", i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = tops.get(h or "")
        refers = top if top is not None and top != i else None
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_archive(spark):
    rows = PAGES + [(k, f"v{k}", "copy") for k in range(100, 160)]
    got = warc.archive(pages_of(spark, rows), payload=True, frame_bytes=500, bundle_bytes=4000).collect()
    told = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(told, key=str) == plain_archive(rows)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit") and "\n" not in r.target_uri
    small = warc.archive(pages_of(spark, rows), revisit_bytes=5).collect()
    assert {r.record_type for r in small if r.payload_bytes < 5} == {"response"} and any(r.record_type == "revisit" for r in small)
    assert warc.archive(pages_of(spark, [])).collect() == []


def test_bundle_format_and_fetch(spark):
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(warc.with_responses(pages_of(spark, PAGES)), folder, frame_bytes=1000)
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    files = {r.file for r in index.collect()}
    for name in files:
        with store.open_input_file(f"{path}/{name}") as f:
            table, data = warc.seek_table(f), f.readall() if f.seek(0) == 0 else b""
        whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + p]) for a, p, _ in table)
        # a plain decoder reads the frames one after the other and skips the footer
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == whole
        assert sum(s for *_, s in table) == len(whole) and [f["warc-type"] for _, f, _ in warc.records_in(whole)][0] == "warcinfo"
    wanted = index.filter("record_type = 'revisit' or record_id like '%:5:%'").select("record_id")
    got = {r.record_id: r for r in warc.fetch(index, wanted, folder).collect()}
    assert len(got) == wanted.distinct().count()
    for r in got.values():
        assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_bytes


def test_damage_is_seen():
    _, data = warc.page_record(1, "u", b"abc", None, "1970-01-01T00:00:00Z")
    (_, fields, block), = warc.records_in(data)
    assert warc.described(fields, block)[0]["payload_bytes"] == 3
    with pytest.raises(ValueError):
        warc.described(fields, block.replace(b"abc", b"abd"))


def plain_trie(rows):
    """Nodes by brute force: {path: (conv, depth, parent conv, convs, children, leaves, saved, ends)}."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts, key=lambda x: x[:2])] for c, ts in turns.items()}
    built = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + path[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids, below = Counter(p[:-1] for p in members if p), defaultdict(lambda: [0, 0])
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += not kids[p]
            below[p[:d]][1] += (len(members[p]) - 1) * words
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], *below[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == p).encode()).hexdigest(),
    ) for p, m in members.items())


def conversations(rng):
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi there", "a b  c", "d", ""])) for c in range(0, 400) for t in range(rng.randrange(1, 5))]
    rows += [(c, t, "user", "the same start") for c in range(400, 700) for t in range(2)]
    rows += [(c, 2, "bot", f"answer {c % 7}") for c in range(400, 700)]
    rows += [(1000, t, "user", f"long {t % 3}") for t in range(300)] + [(1020, t, "user", f"long {t % 3}") for t in range(299)]
    rows += [(2000, None, None, None), (2000, 1, "user", None), (2001, 5, None, "x"), (None, 0, "user", "lost"), (-7, 1, "user", "below zero"), (3005, 0, "a", "b")]
    return rows


@pytest.mark.parametrize("shard", [prefixes.SHARD_TURNS, 20])
def test_trie(spark, shard):
    rows = conversations(random.Random(3))
    table = spark.createDataFrame([(*r, 1, b"k", 2.0) for r in rows], "conv_id long, turn int, role string, text string, depth int, key binary, words double")
    got = prefixes.trie_nodes(prefixes.graft(prefixes.turn_paths(table)), shard).collect()
    told = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)
    assert told == plain_trie(rows)


def test_trie_edges(spark):
    table = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefixes.trie_nodes(prefixes.turn_paths(table)).collect() == []
    one = spark.createDataFrame([(7, 1, "u", "a"), (7, 1, "u", "a")], table.schema)
    assert sorted(r.depth for r in prefixes.trie_nodes(prefixes.turn_paths(one)).collect()) == [0, 1, 2]


def test_double_array():
    rng = random.Random(1)
    paths = sorted({tuple(rng.randrange(40) for _ in range(rng.randrange(6))) for _ in range(3000)})
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
    trie = prefixes.DoubleArray(*prefixes.sorted_nodes(offsets, np.array([t for p in paths for t in p], np.int64)))
    prefixes_of = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert (trie.check >= 0).sum() == len(prefixes_of) - 1
    cell = {(): 0}
    for p in sorted(prefixes_of, key=len):
        for t in range(40):
            at = int(trie.step(np.array([cell[p]]), np.array([t]))[0])
            assert (at >= 0) == ((*p, t) in prefixes_of)
            if at >= 0:
                cell[(*p, t)] = at
    assert len(set(cell.values())) == len(prefixes_of)


def plain_collocations(rows, least=10, cover=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inner = Counter()
        for g, a in cand.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    inner[part] = max(inner[part], a)
        listed = []
        for g, a in cand.items():
            if 100 * inner[g] >= cover * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            listed.append((-score, -a, b" ".join(g), left, right))
        for rank, (s, a, g, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def phrase_rows(rng):
    words = ["New", "york", "city", "of", "the", "é", "日本", "x-y", "a"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice([". ", ",", "\n", "\t"]) + "New York City", rng.choice(["en", "de", None])) for _ in range(300)]
    rows += [("hot pair " * 3000, "en"), ("word", "en"), ("", "en"), (None, None), ("!?\x0b.", "fr"), ("same same same same", "fr")] + [("Twice TWICE. twice twice", "de")] * 12
    return rows


def test_collocations(spark):
    rows = phrase_rows(random.Random(9))
    table = spark.createDataFrame([(t, x, 1, "w", 0.5) for t, x in rows], "text string, lang string, f int, name string, score double")
    for top in (2000, 3):
        got = phrases.collocations(table, top=top).collect()
        assert sorted(map(tuple, got)) == plain_collocations(rows, top=top)


def test_collocation_edges(spark, monkeypatch):
    schema = "text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], schema)).collect() == []
    a = spark.range(1).select((phrases.exact_score(*(phrases.F.lit(x).cast("long") for x in (10**12, 10**12 + 7, 3 * 10**12)))).alias("s")).first().s
    assert a == 1000000 * 10**24 // ((10**12 + 7) * 3 * 10**12)
