"""SentencePiece encoding with source offsets, and decoding.

The model file is read here: pieces with scores, and the normaliser with its compiled
character map. Normalisation takes the longest prefix of the rest of the text that the map
knows (else one character), and records for every byte it writes the byte of the source it
comes from. The normalised text is cut where a space mark follows another character, and
between ASCII characters that are neighbours in no piece of the model, since nothing is
merged there; each distinct part is coded once by merging the adjacent pair of best score
until none is left. Every piece is then projected onto the source bytes.

Defined results: null counts as empty, empty texts have no ids; equal texts have equal
results; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunk_coder import ChunkCoder, binary_array
from .common import lean, pieces_of, text_bytes

MARK = "▁".encode()
# fixed values: kinds of pieces in the model file
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message, values as they are on the wire."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return value, i

    i = 0
    while i < len(b):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            n, i = number(i) if key & 7 == 2 else ((8 if key & 7 == 1 else 4), i)
            value = b[i : i + n]
            i += n
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double array of byte transitions and the texts they lead to."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if blob else []
        self.texts = blob[4 + n :]
        #: bytes with which some known text begins; elsewhere there is nothing to look up
        self.begins = np.zeros(256, bool)
        if self.units:
            root = self._base(self.units[0])
            for b in range(1, 256):
                self.begins[b] = root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest_prefix(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of text[at:] and what replaces it."""
        if not self.units:
            return None
        found, node = None, self._base(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._base(unit)
            if unit & 256:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            blob = f.read()
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.byte_ids = [0] * 256
        self.unknown, spec, trainer, n = 0, b"", b"", 0
        for field, value in _fields(blob):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.score.append(score)
                if kind in (USER_DEFINED, UNUSED):
                    raise ValueError("models with user-defined or unused pieces are not supported")
                if kind == NORMAL:
                    self.ids[piece] = n
                elif kind == BYTE:
                    self.byte_ids[int(piece[3:5], 16)] = n
                elif kind == UNKNOWN:
                    self.unknown = n
                n += 1
            elif field == 2:
                trainer = value
            elif field == 3:
                spec = value
        self.byte_fallback = dict(_fields(trainer)).get(35, 0) == 1
        norm = {"prefix": 1, "squeeze": 1, "escape": 1, "map": b""}
        for f, v in _fields(spec):
            name = {2: "map", 3: "prefix", 4: "squeeze", 5: "escape"}.get(f)
            if name:
                norm[name] = v
        self.prefix, self.squeeze = bool(norm["prefix"]), bool(norm["squeeze"])
        if not norm["escape"]:
            raise ValueError("models without a space mark are not supported")
        self.map = CharacterMap(norm["map"])
        if any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError("a piece of this model spans a space")
        #: ASCII neighbours that some piece has; between others nothing is ever merged
        self.joins = np.zeros((128, 128), bool)
        for p in self.ids:
            for a, b in zip(p[:-1], p[1:], strict=True):
                if a < "\x80" and b < "\x80":
                    self.joins[ord(a), ord(b)] = True

    def _replaced(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The text with the longest known prefixes replaced, and for each byte the source byte it comes from."""
        raw, source = np.frombuffer(text, np.uint8), np.arange(len(text))
        out, origin, at = [], [], 0
        for i in np.flatnonzero(self.map.begins[raw]).tolist():
            known = self.map.longest_prefix(text, i) if i >= at else None
            if known:
                size, new = known
                out += [raw[at:i], np.frombuffer(new, np.uint8)]
                origin += [source[at:i], source[i : i + size] if len(new) == size else np.full(len(new), i)]
                at = i + size
        return np.concatenate([*out, raw[at:]]), np.concatenate([*origin, source[at:]])

    def normalized(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the normalised text, and for each the source byte it comes from (one more entry: the end).

        Known prefixes are replaced, spaces squeezed if the model says so, and what spaces
        are left become marks.
        """
        out, source = self._replaced(text)
        space = out == 32
        if self.squeeze:
            kept = ~(space & np.append(True, space[:-1])) if len(space) else space
            out, source, space = out[kept], source[kept], space[kept]
        size = np.where(space, len(MARK), 1)
        data, source = out.tobytes().replace(b" ", MARK), np.repeat(source, size)
        if self.prefix and data:
            data, source = MARK + data, np.concatenate([np.repeat(source[:1], len(MARK)), source])
        if self.squeeze:
            while data.endswith(MARK):
                data, source = data[: -len(MARK)], source[: -len(MARK)]
        return np.frombuffer(data, np.uint8), np.append(source, len(text))

    def merged(self, part: str) -> list[tuple[str, int]]:
        """Pieces of a part of the text: best score first, then leftmost, until no pair is a piece."""
        ids, score = self.ids, self.score
        symbols: list[str] = list(part)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (pair := symbols[a] + symbols[b]) in ids:
                heapq.heappush(queue, (-score[ids[pair]], a, b, pair))

        for a in range(n - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, pair = heapq.heappop(queue)
            if not symbols[a] or not symbols[b] or right[a] != b or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [(s, ids.get(s, -1)) for s in symbols if s]

    def coded(self, parts: list[bytes]) -> list[list[int]]:
        """For each part: ids and the lengths of their pieces in bytes, in turn."""
        out = []
        for part in parts:
            row: list[int] = []
            for s, i in self.merged(part.decode()):
                raw = s.encode()
                if i >= 0:
                    row += (i, len(raw))
                elif self.byte_fallback:
                    for b in raw:
                        row += (self.byte_ids[b], 1)
                else:
                    row += (self.unknown, len(raw))
            out.append(row)
        return out


@lru_cache(4)
def loaded(path: str) -> tuple[Model, ChunkCoder]:
    model = Model(path)
    return model, ChunkCoder(model.coded)


@lru_cache(4)
def _decoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode_batch(texts: list[bytes], path: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of every text, and for each id the source bytes it covers as pairs (begin, end)."""
    model, coder = loaded(path)
    ids_out: list[np.ndarray] = []
    spans_out: list[np.ndarray] = []
    for a, b in pieces_of(texts, 1 << 20):
        norm = [model.normalized(t) for t in texts[a:b]]
        data = np.concatenate([x for x, _ in norm])
        length = np.fromiter((len(x) for x, _ in norm), np.int64, b - a)
        doc_end = np.cumsum(length)
        mark = np.zeros(len(data) + 1, bool)
        mark[: max(len(data) - 2, 0)] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
        after = np.zeros(len(data) + 1, bool)
        after[3:] = mark[:-3]
        begin = mark & ~after
        begin[(doc_end - length)[length > 0]] = True
        ascii_pair = (data[:-1] < 128) & (data[1:] < 128)
        begin[1 : len(data)] |= ascii_pair & ~model.joins[data[:-1] & 127, data[1:] & 127]
        start = np.flatnonzero(begin[: len(data)])
        end = np.append(start[1:], len(data)) if len(start) else start
        flat, n = coder.ids(binary_array(data, start, end))
        ids, size = flat[0::2], flat[1::2].astype(np.int64)
        place = np.cumsum(size)
        first = np.searchsorted(place, doc_end - length, "right")
        for k, (_, source) in enumerate(norm):
            i = first[k]
            j = first[k + 1] if k + 1 < len(norm) else len(ids)
            if not length[k]:
                i = j = 0
            base = doc_end[k] - length[k]
            ids_out.append(ids[i:j])
            stop = place[i:j] - base
            spans_out.append(np.stack([source[stop - size[i:j]], source[stop]], axis=1) if j > i else np.zeros((0, 2), np.int64))
    return ids_out, spans_out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids, begins, ends: ids of the whole text and the source bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = encode_batch(list(text_bytes(batch["text"])), path)
            columns = [ids, [s[:, 0] for s in spans], [s[:, 1] for s in spans]]
            kinds = [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "ids", "begins", "ends"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def round_trip(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``columns`` of docs, n_tokens, ids_sha256, decoded_sha256, n_covered and spans_sha256 (with_text: also ``decoded``), in one pass.

    ``n_covered`` is the number of source bytes under the spans of the pieces, ``spans_sha256``
    of their begins and ends, in turn, as little-endian 64-bit integers.
    """
    added = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_covered": pa.int64(), "spans_sha256": pa.string()}
    schema = docs.select(*columns).schema
    for name, kind in added.items():
        schema = schema.add(name, "long" if kind == pa.int64() else "string")
    if with_text:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            texts = list(text_bytes(batch["text"]))
            for a, b in pieces_of(texts, 1 << 20):
                rows: list[tuple] = []
                for x, spans in zip(*encode_batch(texts[a:b], path), strict=True):
                    ids = x.tolist()
                    text = decoder.decode(ids) if ids else ""
                    rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), int((spans[:, 1] - spans[:, 0]).sum()), hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest(), text))
                cols = list(zip(*rows, strict=True))
                out = [pa.array(c, k) for c, k in zip(cols[: 5 + with_text], [*added.values(), pa.string()], strict=False)]
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in columns), *out], schema.fieldNames())

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(lean(run), schema)
