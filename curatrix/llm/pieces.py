"""SentencePiece encoding and decoding by a weighted finite-state transducer."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_and_text, map_texts

SPACE = "▁"
#: Separates segments while a text is cut; texts that hold it take the slower way.
CUT = "\x00"
#: Compiled models of this Python worker: what one task has found serves the next.
COMPILED: dict[str, "PieceTransducer"] = {}


def read_fields(data: bytes):
    """(field number, value) of a protocol-buffer message; only what a model file uses."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            shift += 7
            at += 1
            if data[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({5: 4, 1: 8}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceTransducer:
    """Normaliser, pieces and byte fallback of a BPE model, composed with one input at a time.

    States are (position, last piece). An arc reads a piece and writes its id; its weight
    in the tropical semiring is 0 if the model keeps the two neighbouring pieces apart, and
    infinite if it would have merged over their border. A sequence is the model's encoding
    exactly if no border is broken, so one path has a finite weight: the shortest path.
    The same holds of each beginning of the input, so one state a position is finite.
    Piece scores enter through the border weights; adding them up, as for a unigram model,
    would not give a BPE model's result. Characters without piece are read by byte arcs,
    which no merge crosses.
    """

    def __init__(self, model_file: str, remembered: int = 400_000):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        count = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(count)]
        special = {i for i in range(count) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and not model.is_byte(i)}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.unknown = model.unk_id()
        spec = dict(read_fields(dict(read_fields(model.serialized_model_proto()))[3]))
        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
            raise ValueError("only models with the identity normaliser and escaped spaces can be compiled")
        self.prefix = bool(spec.get(3, 1))
        written = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.output = [written.get(i, " ⁇ ".encode() if i == self.unknown else b"") for i in range(count)]
        #: The states of the piece acceptor: by the next sign, the id where a piece ends (else -1) and the arcs from there.
        self.trie: dict[str, list] = {}
        for piece, i in self.ids.items():
            arcs, state = self.trie, [-1, {}]
            for sign in piece:
                state = arcs.setdefault(sign, [-1, {}])
                arcs = state[1]
            state[0] = i
        self.pieces = pieces
        self.whole = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        #: Neighbouring characters of some piece. No merge crosses any other pair of characters.
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.parts: dict[str, bytes] = {}
        self.borders: dict[int, dict[int, bool]] = {}
        self.known_borders = 0
        self.remembered = remembered
        self.segments: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def border(self, left: int, right: int) -> bool:
        """The arc that reads ``right`` after ``left`` has weight 0, else infinity."""
        if self.known_borders > 4 * self.remembered:
            self.borders.clear()
            self.known_borders = 0
        x, y = self.pieces[left], self.pieces[right]
        free = self.borders.setdefault(left, {})[right] = self.merged(x + y) == [x, y]
        self.known_borders += 1
        return free

    def shortest_path(self, segment: str) -> list[int]:
        """Ids on the path of weight 0 through the composition with ``segment``.

        All weights are 0 or infinite, so a position is settled by the first arc that
        reaches it with weight 0; infinite arcs are never followed.
        """
        size = len(segment)
        signs = list(segment)
        reached: list[int | None] = [None] * (size + 1)
        reached[0] = -1
        start = [0] * (size + 1)
        nothing: dict[int, bool] = {}
        for begin in range(size):
            before = reached[begin]
            if before is None:
                continue
            free_after = self.borders.get(before, nothing)
            arcs, end = self.trie, begin
            for sign in signs[begin:]:
                state = arcs.get(sign)
                end += 1
                if state is None:
                    if end == begin + 1:
                        reached[end], start[end] = -1, begin
                    break
                piece, arcs = state
                if piece >= 0 and reached[end] is None:
                    if before >= 0:
                        free = free_after.get(piece)
                        if not (self.border(before, piece) if free is None else free):
                            continue
                    reached[end], start[end] = piece, begin
        path: list[int] = []
        end = size
        while end:
            begin = start[end]
            if reached[end] < 0:
                raw = [self.byte_ids.get(b, self.unknown) for b in segment[begin:end].encode("utf-8", "surrogatepass")]
                path.extend(reversed(raw if self.byte_ids else [self.unknown]))
            else:
                path.append(reached[end])
            end = begin
        return path[::-1]

    def path_bytes(self, segment: str) -> bytes:
        path = self.shortest_path(segment)
        return struct.pack(f"<{len(path)}i", *path)

    def segment_ids(self, segment: str) -> bytes:
        """Ids of a segment, from those of its parts: no path has an arc across a pair of characters that no piece holds."""
        if len(self.segments) > self.remembered:
            self.segments.clear()
        if len(self.parts) > self.remembered:
            self.parts.clear()
        inside, known = self.inside, self.parts
        if segment[1:].isascii() and segment[1:].isalpha():  # hardly ever has a cut
            value = self.segments[segment] = self.path_bytes(segment)
            return value
        cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in inside]
        found = []
        for begin, end in zip([0, *cuts], [*cuts, len(segment)], strict=True):
            part = segment[begin:end]
            ids = known.get(part)
            if ids is None:
                ids = known[part] = self.path_bytes(part)
            found.append(ids)
        value = self.segments[segment] = b"".join(found)
        return value

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers.

        Where no piece has a space after another character, and none a line end, no merge
        crosses those places. Texts are cut there, and the path of each segment is found
        once and remembered.
        """
        if not text:
            return b""
        if self.whole:
            return np.array(self.shortest_path((SPACE if self.prefix else "") + text.replace(" ", SPACE)), "<i4").tobytes()
        if CUT in text or SPACE in text or "  " in text or text[0] == " ":
            cut = re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", (SPACE if self.prefix else "") + text.replace(" ", SPACE))
        else:
            marked = text.replace("\n", "\x00\n\x00").replace(" ", CUT + SPACE)
            cut = ((SPACE if self.prefix else "") + marked).split(CUT)
        known = self.segments
        found = list(map(known.get, cut))
        if None in found:
            found = [self.segment_ids(s) if f is None else f for f, s in zip(found, cut, strict=True)]
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, the leading space taken away."""
        text = b"".join(map(self.output.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    Returns ``doc_id``, ``ids``, ``n_ids``, ``ids_crc32`` (of the ids as little-endian
    32-bit integers), ``decoded_sha256`` (of the decoded text) and ``round_trip`` (the
    decoded text is the text; a text that holds the model's own space sign cannot be).
    ``model_file`` must be readable where the tasks run.

    * A null or empty text has no ids and decodes to the empty text.
    * Repeated rows and null ids pass through, one row per input row.
    """

    def prepare():
        machine = COMPILED.setdefault(model_file, None) or PieceTransducer(model_file)
        COMPILED[model_file] = machine

        def work(texts: list) -> dict:
            raw = [machine.encode(t or "") for t in texts]
            back = [machine.decode(np.frombuffer(r, "<i4")) for r in raw]
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            return {
                "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))),
                "n_ids": [len(r) // 4 for r in raw],
                "ids_crc32": [zlib.crc32(r) for r in raw],
                "decoded_sha256": [hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back],
                "round_trip": [b == (t or "") for b, t in zip(back, texts, strict=True)],
            }

        return work

    return map_texts(id_and_text(docs, id_col, text_col), prepare, "ids array<int>, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
