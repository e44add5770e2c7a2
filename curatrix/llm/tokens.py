"""Token ids in a bit-plane file format: encode, write, read back."""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import id_and_text, shared_folder, stored

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
#: A shard file is closed at the first document end after so many ids.
FILE_IDS = 1 << 24
SUFFIX = ".idplane"
WORD_END = "</w>"
#: Kinds of bytes: white space, letters, digits, other printable ASCII signs, and those whose chunk is not cut here.
SPACE, LETTER, DIGIT, SIGN, UNCUT = range(5)
KINDS = np.full(256, UNCUT, np.uint8)
KINDS[[*b" \t\n\x0b\x0c\r"]], KINDS[0x21:0x7F] = SPACE, SIGN
KINDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]], KINDS[[*b"0123456789"]] = LETTER, DIGIT
ENDING_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts of a batch are encoded together up to so many bytes.
TOGETHER = 1 << 22


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit ids, lowest first."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if unit == "byte":
        return [p.tobytes() for p in by_byte]
    return [np.packbits((p >> k) & 1).tobytes() for p in by_byte for k in range(8)]


def from_planes(planes: list[bytes], count: int, unit: str) -> np.ndarray:
    if unit == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    out = np.zeros(count, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=count).astype(np.uint32) << np.uint32(k)
    return out


class PlaneFile:
    """One shard in memory: compressed planes block by block, then an index of blocks and documents.

    Layout: magic, planes, compressed index, length of the index (8 bytes), magic. The
    index is JSON with, per block, its offset, its number of ids and the sizes of its
    planes, followed by the ids, null flags and lengths of the documents.
    """

    def __init__(self, unit: str, block_ids: int):
        self.unit, self.block_ids = unit, block_ids
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.parts, self.size = [MAGIC], len(MAGIC)
        self.blocks: list[list] = []
        self.waiting: list[bytes] = []
        self.held = 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        full = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for start in range(0, full, self.block_ids):
            block = ids[start : min(full, start + self.block_ids)]
            packed = [self.packer.compress(p) for p in to_planes(block, self.unit)]
            self.blocks.append([self.size, len(block), [len(p) for p in packed]])
            self.parts += packed
            self.size += sum(map(len, packed))
        rest = ids[full:].tobytes()
        self.waiting, self.held = [rest], len(rest)

    def finish(self) -> bytes:
        if self.held:
            self._flush(last=True)
        head = json.dumps({"unit": self.unit, "blocks": self.blocks, "docs": len(self.docs)}).encode()
        null = np.array([d is None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        index = self.packer.compress(struct.pack("<q", len(head)) + head + ids.tobytes() + null.tobytes() + np.array(self.lengths, "<i8").tobytes())
        return b"".join([*self.parts, index, struct.pack("<q", len(index)), MAGIC])


def read_plane_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document, in order; blocks are unpacked as they are needed."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a whole plane file")
    unpacker = zstandard.ZstdDecompressor()
    end = len(data) - len(MAGIC) - 8
    (size,) = struct.unpack("<q", data[end : end + 8])
    index = unpacker.decompress(data[end - size : end])
    (head_size,) = struct.unpack("<q", index[:8])
    head = json.loads(index[8 : 8 + head_size])
    at, n = 8 + head_size, head["docs"]
    ids = np.frombuffer(index, "<i8", n, at)
    null = np.frombuffer(index, np.uint8, n, at + 8 * n)
    lengths = np.frombuffer(index, "<i8", n, at + 9 * n)
    blocks = iter(head["blocks"])
    ready = np.empty(0, np.uint32)
    for k in range(n):
        need = [ready]
        have = len(ready)
        while have < lengths[k]:
            offset, count, sizes = next(blocks)
            planes = []
            for s in sizes:
                planes.append(unpacker.decompress(data[offset : offset + s]))
                offset += s
            need.append(from_planes(planes, count, head["unit"]))
            have += count
        ready = np.concatenate(need) if len(need) > 1 else ready
        yield (None if null[k] else int(ids[k])), ready[: lengths[k]]
        ready = ready[lengths[k] :]


def uncut_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte is one whose chunk is not cut: no printable ASCII sign, or ``<`` before ``|``."""
    uncut = KINDS[data] == UNCUT
    uncut[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    return uncut


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after the other, and the number of words before each text and after the last.

    Chunks between ASCII white space that hold printable ASCII signs only are lower-cased and
    cut as the tokenizer does (``'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+``). Others, and
    those with ``<|``, as special tokens have it, are one word each, as written.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n   ", np.uint8)
    kind = KINDS[data]
    solid = kind != SPACE
    begin = np.append(False, solid[1:] & (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    uncut = uncut_bytes(data)
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    first, last = edges[::2], edges[1::2]
    whole = np.unique(np.searchsorted(first, np.flatnonzero(uncut), side="right") - 1)
    step = np.zeros(len(data), np.int8)
    step[first[whole]], step[last[whole]] = 1, -1
    inside = np.cumsum(step, dtype=np.int8).view(bool)
    begin &= ~inside
    begin[first[whole]] = True
    small = np.where((kind == LETTER) & ~inside, data | 0x20, data)
    # an apostrophe that begins a word, with the letters it takes along
    at = np.flatnonzero(begin & ~inside & (small == ord("'")))
    one, two = small[at + 1], small[at + 2]
    taken = np.isin(one, [*b"stmd"]) + 2 * ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    at, after = at[taken > 0], (at + 1 + taken)[taken > 0]
    begin[at + 1] = False
    begin[after] |= kind[after] == LETTER
    upto = np.searchsorted(np.flatnonzero(begin), np.cumsum([1, *(len(t) + 1 for t in texts)]))
    offsets = np.append(np.flatnonzero(begin[solid]), np.count_nonzero(solid)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(small[solid])]), upto


class WordIds:
    """Ids of one white-space separated chunk of a text, from the tokenizers library.

    The tokenizer composes (NFC), lower-cases and drops white space before it looks for
    tokens, so a text's ids are those of its chunks one after the other. Chunks of ASCII signs,
    which composing leaves alone, are lower-cased and cut at the tokenizer's own word borders;
    in others only the small letter may compose with a mark, so they stay as written and whole.
    Many texts are encoded together, as arrays: each distinct word is looked up once, and new
    ones are encoded. The store (the words, and where in ``pool`` the ids of each stand) is
    arrays too, so it takes some 40 bytes a word; it is emptied when it has grown large.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for words of small ASCII signs only: they are normal already, and a space is between any two
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit = limit
        self._forget()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _forget(self) -> None:
        self.words, self.begin, self.pool = pa.array([], pa.binary()), np.zeros(1, np.int64), np.empty(0, "<u4")

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        words, upto = cut_words([(text or "").encode("utf-8", "surrogatepass") for text in texts])
        coded = words.dictionary_encode()
        if len(self.words) > self.limit:
            self._forget()
        ids, n = self._gathered(self._places(coded.dictionary)[coded.indices.to_numpy()])
        cuts = (4 * np.append(0, np.cumsum(n))[upto]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``places`` of the store one after the other, and the number of each."""
        at, n = self.begin[places], self.begin[places + 1] - self.begin[places]
        ends = np.cumsum(n)
        where = np.repeat((at - (ends - n)).astype(np.int32), n)
        where += np.arange(len(where), dtype=np.int32)
        return self.pool[where], n

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the store has each of some distinct words; new ones are put into it."""
        places = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._learn(words.take(pa.array(new)))
        return places

    def _put(self, words: pa.Array, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        start = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(n))
        self.pool = np.append(self.pool, ids)
        return np.arange(start, len(self.words))

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Puts new words and uncut chunks, none of which depends on its neighbours, into the store.

        A chunk is encoded by its letters and the signs after them, or alone where that is not sure.
        """
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        uncut = np.add.reduceat(uncut_bytes(data), offsets[:-1] - offsets[0], dtype=np.int64) > 0
        # two words side by side may look like the sign of a special token, and are then encoded alone
        groups: dict[str, list[int]] = {"full": [], "alone": [], "compound": []}
        stems, tails = [], []
        rest = np.flatnonzero(uncut)
        for k, c in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist(), strict=True):
            stem = c.rstrip(ENDING_SIGNS)
            text = stem.decode("utf-8", "surrogatepass")
            if b"<|" in c or c.isascii() or not text.isalpha():
                groups["alone"].append(k)
            elif len(stem) == len(c):
                groups["full"].append(k)
            elif unicodedata.is_normalized("NFC", text) and text.lower().isalpha():
                groups["compound"].append(k)
                stems.append(stem)
                tails.append(c[len(stem) :])
            else:  # a letter that becomes letter and mark would put the mark into the next word
                groups["alone"].append(k)
        places = np.empty(len(words), np.int64)
        for tokenizer, chosen in ((self.plain, np.flatnonzero(~uncut)), (self.tokenizer, groups["full"])):
            groups["alone"] += self._in_rows(tokenizer, words, np.array(chosen, np.int64), places)
        alone = words.take(pa.array(groups["alone"], pa.int64()))
        found = self._ids(self.tokenizer, [c.decode("utf-8", "surrogatepass") for c in alone.to_pylist()])
        places[groups["alone"]] = self._put(alone, np.concatenate([self.pool[:0], *found]), np.array([len(f) for f in found], np.int64))
        if stems:
            parts = pa.array(stems + tails, pa.binary()).dictionary_encode()
            both = self._places(parts.dictionary)[parts.indices.to_numpy().reshape(2, -1).T.reshape(-1)]
            ids, n = self._gathered(both)
            places[groups["compound"]] = self._put(words.take(pa.array(groups["compound"])), ids, n.reshape(-1, 2).sum(axis=1))
        return places

    def _in_rows(self, tokenizer, words: pa.Array, chosen: np.ndarray, places: np.ndarray) -> list[int]:
        """Encodes the chosen words, many in a row, told apart by the tokens that end a word, and notes their places; returns those of rows in doubt."""
        if not len(chosen):
            return []
        cuts = np.append(np.arange(0, len(chosen), 256), len(chosen)).astype(np.int32)
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(chosen))), b" ")
        found = self._ids(tokenizer, [row.decode("utf-8", "surrogatepass") for row in rows.to_pylist()])
        sure = np.ones(len(chosen), bool)
        for k, e in enumerate(found):
            if np.count_nonzero(self.last[e]) != cuts[k + 1] - cuts[k] or not self.last[e[-1]]:
                sure[cuts[k] : cuts[k + 1]], found[k] = False, e[:0]
        ids = np.concatenate(found)
        places[chosen[sure]] = self._put(words.take(pa.array(chosen[sure])), ids, np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0))
        return chosen[~sure].tolist()

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        some = [texts[k : k + 32] for k in range(0, len(texts), 32)]  # an encoding holds far more than its ids
        return [np.array(e.ids, "<u4") for part in some for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch with at most ``TOGETHER`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + TOGETHER, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: Encoders of this Python worker: what one task has encoded serves the next.
ENCODERS: dict[str, WordIds] = {}


def write_ids(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", unit: str = "byte", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, shards: int | None = None) -> DataFrame:
    """Encodes each whole text, appends ``end_id``, and writes the ids in ascending id order.

    Texts are range-partitioned by id; each partition writes files of bounded size to
    ``folder`` (a URI of a shared store), under a temporary name first. A task that runs
    again writes the same bytes to the same names. Only files named in the returned
    manifest (``shard``, ``part``, ``file``, ``n_docs``, ``n_ids``, one row per file) count.

    * A null or empty text has the end id alone. Null ids come first.
    * Rows with equal ids are ordered by a hash of their text.
    * An empty table writes no file.
    """
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    manifest = StructType.fromDDL("shard int, part int, file string, n_docs long, n_ids long")
    arrow = to_arrow_schema(manifest)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ENCODERS.setdefault(tokenizer_file, None) or WordIds(tokenizer_file)
        ENCODERS[tokenizer_file] = encoder
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        shard, rows = TaskContext.get().partitionId(), []
        current = PlaneFile(unit, block_ids)

        def close() -> None:
            name = f"shard-{shard:06d}-{len(rows):04d}{SUFFIX}"
            hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(current.finish())
            store.move(hidden, f"{path}/{name}")
            rows.append((shard, len(rows), name, len(current.docs), current.n_ids))

        for batch in batches:
            for part in slices(batch):
                pa.default_memory_pool().release_unused()
                encoded = encoder.encode_many(part.column("text").to_pylist())
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    current.add(doc_id, ids + end)
                    if current.n_ids >= file_ids:
                        close()
                        current = PlaneFile(unit, block_ids)
        if current.docs:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(5)], schema=arrow)

    texts = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return stored(ordered.select("doc_id", "text").mapInArrow(write, manifest), "manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files in ``manifest``: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``."""
    spark = manifest.sparkSession
    # one row per file, so this single window is short
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")), "places")
    if places.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    schema = StructType.fromDDL("file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                rows, at = [], 0
                for doc_id, ids in read_plane_file(content.as_py()):
                    rows.append((file.as_py(), doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(5)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(read, schema)
    return rows.join(places, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, tokenizer_file: str, end_id: int, **options) -> DataFrame:
    """Writes the ids of ``docs`` to a new shared folder and returns what its files hold."""
    folder = shared_folder(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, tokenizer_file, end_id, **options), folder)
