"""Queries over whole tables, one per operator; ``QUERIES`` and ``ORACLES`` join the other queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, hosts, langid, licenses, minhash, phrases, pieces, prefixes, repeats, tokens, toxicity, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
 doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t
"""


@query("op4_exact_dedup", OP4_SQL)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS8 = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS8.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {WORDS8.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p:p+least(10, len(w))-1], ' ') AS win
 FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w)-9)+1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, p, array_to_string(w[p:p+size-1], ' ') AS win
 FROM (SELECT doc_id, w, size, unnest(range(1, len(w)-size+2)) AS p FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, dw.size, p FROM dw JOIN win ON dw.size = win.size AND dw.win = win.win),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p+size)) AS pos FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


@query("op8_benchmark_decontamination", OP8_SQL)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
 SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE [w[x] || ' ' || w[x+1] for x in range(1, len(w))] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS rep, n FROM (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS key FROM s GROUP BY doc_id)),
r AS (SELECT s.doc_id, sh, n FROM s JOIN cls USING (doc_id) WHERE rep = doc_id),
ranked AS (SELECT r.doc_id, r.sh, n, row_number() OVER (PARTITION BY r.doc_id ORDER BY df, r.sh) AS k FROM r JOIN (SELECT sh, count(*) AS df FROM r GROUP BY sh) USING (sh)),
pre AS (SELECT * FROM ranked WHERE k <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.sh = b.sh AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT a, b FROM (SELECT a, b, na, nb, count(*) AS both_ FROM cand JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b AND y.sh = x.sh GROUP BY ALL) WHERE 100 * both_ >= 80 * (na + nb - both_)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link UNION SELECT rep, doc_id FROM cls UNION SELECT doc_id, rep FROM cls),
c(id, lo) AS (SELECT doc_id, doc_id FROM cls UNION SELECT e.b, c.lo FROM c JOIN e ON e.a = c.id WHERE c.lo < e.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(lo, w.doc_id) AS component_id, coalesce(lo, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(lo) AS lo FROM c GROUP BY id) m ON m.id = w.doc_id
"""


@query("op9_minhash_near_dedup", OP9_SQL)
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


WORDS3 = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS3} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w)-11)) AS p FROM d WHERE len(w) >= 13)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p+13)) AS pos FROM hit),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w)+1)) AS pos FROM d),
kept AS (SELECT word.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY word.pos) FILTER (gone.pos IS NULL) AS kept
 FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.pos = gone.pos GROUP BY word.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op3_substring_dedup", OP3_SQL)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query("op7_url_filters")
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return hosts.judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    differences = F.aggregate("matches", F.lit(0), lambda n, m: n + m["differences"])
    return found.select("doc_id", "n_matches", "licenses", differences.alias("differences"))


OP11_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
x AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM p),
y AS (SELECT *, list_transform(range(0, 8), lambda g: list_reduce(list_transform(string_split(substr(hex, CAST(1 + 5 * g AS BIGINT), 5), ''), lambda ch: strpos('0123456789abcdef', ch) - 1), lambda a, b: a * 16 + b)) AS v FROM x)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[CAST(i // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM y
"""


@query("op11_warc_bundles", OP11_SQL)
def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)),
 lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""
OP12_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, {CRC32.format('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT h.conv_id, p AS pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND p <= h UNION ALL SELECT h.conv_id, p + 4, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND p > h),
l AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY pos) AS l, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) AS w FROM r GROUP BY conv_id),
c AS (SELECT h.conv_id, coalesce(l, []) AS l, coalesce(w, []) AS w FROM h LEFT JOIN l USING (conv_id)),
m AS (SELECT conv_id, d, array_to_string(l[1:d], '') AS k, CASE WHEN d > 0 THEN array_to_string(l[1:d-1], '') END AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(l) AS stops, l
 FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM c)),
n AS (SELECT k, d AS depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, any_value(l[1:d]) AS l, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM m GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT array_to_string(l[1:a], '') AS k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM n) x LEFT JOIN kids ON kids.k = x.k GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n p ON p.k = n.up LEFT JOIN kids ON kids.k = n.k JOIN s ON s.k = n.k
"""


@query("op12_conversation_trie", OP12_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie_nodes(prefixes.graft(prefixes.turn_paths(table(spark, sf_dir, "conversations"))))


OP13_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
x AS (SELECT lang, pid, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM w),
y AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY pid ORDER BY pos)),
tot AS (SELECT lang, count(*) AS n FROM y GROUP BY 1),
f1 AS (SELECT lang, w1, count(*) AS f FROM y GROUP BY ALL HAVING f >= 10),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM y WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM y WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
part AS (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3),
gone AS (SELECT DISTINCT f2.lang, f2.w1, f2.w2 FROM f2 JOIN part USING (lang, w1, w2) WHERE 100 * part.f >= 50 * f2.f),
cut AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 ANTI JOIN gone USING (lang, w1, w2) JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
 UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
 UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
sc AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cut),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low JOIN tot ON tot.lang = low.lang QUALIFY rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
