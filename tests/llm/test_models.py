import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curatrix.llm import langid, pieces, tokens, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
IDS = public_tokenizers.path("word_bpe_49k.json")
MACHINE = pieces.PieceTransducer(PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
ENCODER, PLAIN = tokens.WordIds(IDS), Tokenizer.from_file(IDS)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab the in ion▁ .\n\t\0é😀日<>s/'12"), max_size=60) | st.text(max_size=30))
def test_pieces_equal_the_library(text):
    ids = np.frombuffer(MACHINE.encode(text), "<i4").tolist()
    assert ids == LIBRARY.encode(text)
    assert MACHINE.decode(np.array(ids, int)) == text.replace("▁", " ")


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abAB thein.,!?'stm \n\x0b\x0c\x1c\x85\xa0éİΣ日1²\u0301<|endoftext|>"), max_size=60) | st.text(max_size=30))
def test_ids_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["H\u0331ayim", "W\u030A", "T\u0308o", "Y\u030A", "J\u030Ca", "ab H\u0331ayim Cd, J\u030Ca <|x", "A\u0301 E\u0301. W\u030A\nH\u0331"])
def test_ids_of_marks_after_capitals(text):
    """Only the small letter composes with the mark, and the tokenizer composes before it lower-cases."""
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_piece_table(odd, none):
    rows = pieces.encode_decode(odd, PIECES).collect()
    assert len(rows) == odd.count() and pieces.encode_decode(none, PIECES).collect() == []
    texts = {r.doc_id: r.text for r in odd.select("doc_id", "text").collect()}
    for r in rows:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert r.ids == LIBRARY.encode(text) and r.n_ids == len(r.ids) and r.round_trip == ("▁" not in text)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("file_ids", [tokens.FILE_IDS, 500])
def test_token_files(docs, corpus, tmp_path, unit, file_ids):
    folder = f"file://{tmp_path}/ids"
    manifest = tokens.write_ids(docs, folder, IDS, 2, unit=unit, block_ids=64, file_ids=file_ids, shards=3)
    got = {r.doc_id: tuple(r)[1:] for r in tokens.read_ids(manifest, folder).collect()}
    start, want = 0, {}
    for i, t in sorted(corpus, key=lambda r: r[0]):
        ids = np.array(PLAIN.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_token_files_odd_rows(odd, none):
    assert tokens.encode_to_files(none, IDS, 2).collect() == []
    rows = sorted(tokens.encode_to_files(odd, IDS, 2).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows[:-1])]
    assert len(rows) == odd.count() and [r.doc_id for r in rows[:3]] == [None] * 3


def test_plane_file_refuses_part_of_a_file():
    f = tokens.PlaneFile("byte", 64)
    f.add(1, np.arange(100, dtype="<u4").tobytes())
    with pytest.raises(ValueError, match="whole"):
        list(tokens.read_plane_file(f.finish()[:-3]))


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.array(sorted(rng.integers(0, 6, 4), reverse=True))
        scores, switch, at = rng.integers(-6, 1, (sizes.sum(), 3)).astype(np.float32), float(rng.integers(0, 5)), 0
        got = langid.viterbi(scores, sizes, switch)
        for n in sizes:
            cost = lambda p: sum(scores[at + i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            if n:
                assert abs(cost(got[at : at + n]) - max(map(cost, itertools.product(range(3), repeat=int(n))))) < 1e-4
            at += n


def test_texts_of_one_language_need_no_search():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = np.array(sorted(rng.integers(0, 6, 4), reverse=True))
        scores = rng.integers(-3, 1, (sizes.sum(), 3)).astype(np.float32)
        scores -= scores.max(axis=1, keepdims=True) if len(scores) else 0
        switch = float(rng.integers(0, 5))
        got, at = langid.best_labels(scores, sizes, switch), 0
        for n in sizes:
            cost = lambda p: sum(scores[at + i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            if n:
                assert abs(cost(got[at : at + n]) - max(map(cost, itertools.product(range(3), repeat=int(n))))) < 1e-4
            at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcéßд日", min_size=1, max_size=9), min_size=1, max_size=8, unique=True))
def test_word_buckets_do_not_hang_on_neighbours(words):
    """All words together give each word the pieces that it has alone, three a sign but for the ends."""
    grams, begin, whole = langid.word_buckets(words)
    ends = [*begin[1:], len(grams)]
    for k, w in enumerate(words):
        alone, _, name = langid.word_buckets([w])
        assert np.array_equal(grams[begin[k] : ends[k]], alone) and name[0] == whole[k]
        assert (alone < langid.BUCKETS).sum() == 3 * (len(w) + 2) - 3
    times = {w: 1 + k for k, w in enumerate(words)}
    counted = langid.counted_buckets(times)
    assert counted[: langid.BUCKETS].sum() == sum(n * (3 * len(w) + 4) for w, n in times.items())
    assert counted[langid.BUCKETS :].sum() == sum(times.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAB'st.,%1²éİΣ\u0301 \n", max_size=30) | st.none(), max_size=8))
def test_ids_of_many_texts_equal_the_library(texts):
    encoder = tokens.WordIds.__new__(tokens.WordIds)
    encoder.__dict__.update(ENCODER.__dict__, known={}, limit=3)
    for _ in range(2):  # the second time the store is emptied first
        got = [np.frombuffer(r, "<u4").tolist() for r in encoder.encode_many(texts)]
        assert got == [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_store_of_words_is_small():
    """Words cost the store less than 100 bytes each, and words with signs around them make no new ones."""
    encoder, words = tokens.WordIds(IDS), [np.base_repr(k, 26).translate(str.maketrans("0123456789", "qrstuvwxyz")).lower() for k in range(30_000, 60_000)]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    encoder.encode_many([" ".join(f"{w} {w}, ({w})" for w in words)])
    assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before < 100 * len(words)
    tracemalloc.stop()


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 1500 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    by = {lang: docs.filter(f"lang = '{lang}' and length(text) > 600").first().text[:600] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, by["en"] + " " + by["de"]), (2, None), (3, "12 !"), (4, ""), (None, by["de"])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    assert [s["lang"] for s in got[1].spans] == ["en", "de"] and abs(got[1].spans[1]["start"] - 601) < 40
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, []) for k in (2, 3, 4)) and got[None].lang_pred == "de"


def test_only_letters_are_letters(docs, none, spark):
    for text in ("² ½ ①", "Ⅷ", "१२", "_", "x² Ⅷy", "日本 é ß", "ʰ ª"):
        assert "".join(langid.LETTERS.findall(text)) == "".join(c for c in text if c.isalpha())
    model = langid.fit(docs)
    got = langid.identify(spark.createDataFrame([(1, "² ½ ①"), (2, "Ⅷ")], "doc_id long, text string"), model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_languages_without_labels(docs, none):
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(none, langid.fit(docs)).collect() == []


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    truth, said = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    assert said[truth == 1].mean() > 0.75 and said[truth == 0].mean() < 0.01


def test_toxicity_edges(spark, odd, none):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, nothing).collect()
    assert len(rows) == odd.count() and {(r.score, r.predicted) for r in rows} == {(0.5, 1)}
    assert toxicity.toxicity(none, nothing).collect() == []
    strange = spark.createDataFrame([(7, None), (None, 1), (9, 5), (10, 1), (10, 0), (999, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(odd, strange).collect())
