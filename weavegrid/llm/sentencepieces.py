"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A model file gives pieces and log scores. Text is prefixed with one space,
spaces become the white-space marker, and the segmentation with the highest
sum of scores wins (ties: the longer last piece). A character that no piece
covers costs ten less than the lowest score and becomes byte pieces.

No piece of such a vocabulary has the marker behind another character, so the
best segmentation of a text is that of its words, each with the markers before
it. Distinct words of a batch are segmented together, column by column over
the trie's arrays; a word seen before comes from a cache bounded by bytes. A vocabulary
without that property, and words of many bytes, take a scalar Viterbi over
the same arrays.

Decoding joins pieces and bytes, turns markers into spaces and drops the
prefixed one. A marker in the source text therefore comes back as a space.

Defined cases: a null text counts as empty and has no ids; rows may repeat or
lack a doc_id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weavegrid.llm.common import ship, slices, text_or_empty

MARK = "▁"
UNKNOWN_PENALTY = 10.0
LONG_WORD = 48
#: Words of up to so many bytes are kept, while those kept take about so many bytes.
CACHED_WORD, CACHED_BYTES = 96, 48 << 20
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints, or bytes as they stand."""

    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else (8 if key & 7 == 1 else 4, i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    out = []
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                piece = dict(_fields(value))
                out.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie of byte strings: the child of s by byte c is t = base[s] + c + 1 if check[t] == s; value[s] is the string's number or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, number in keys:
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends[node] = number
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        slot, free_from = {0: 0}, 1
        for node, own in enumerate(children):  # parents have smaller numbers
            s = slot[node]
            self.value[s] = ends.get(node, -1)
            if not own:
                continue
            labels = sorted(own)
            while taken[free_from]:
                free_from += 1
            first = free_from
            while True:
                base = first - labels[0] - 1
                if base + 257 >= size:
                    more = size
                    self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                    self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
                    self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])
                    taken += bytearray(more)
                    size += more
                if base >= 0 and not any(taken[base + c + 1] for c in labels):
                    break
                first = taken.find(0, first + 1)
                if first < 0:
                    first = size - 1
            self.base[s] = base
            for c in labels:
                t = base + c + 1
                taken[t], self.check[t], slot[own[c]] = 1, s, t


class Unigram:
    """Encodes and decodes with one vocabulary; pickled to the executors, of fixed size."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        usable = [(p.encode(), i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and p]
        self.trie = DoubleArray(usable)
        self.scores = np.array([s for _, s, _ in pieces] + [0.0])
        self.lengths = np.array([len(p.encode()) for p, _, _ in pieces] + [0])
        self.unknown_score = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.longest = max((len(k) for k, _ in usable), default=0)
        self.output = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in pieces)
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.by_word else "(?s).+")
        self.cache: dict[str, bytes] = {}
        self.cached_bytes = 0
        self._lists = None

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "_lists": None}

    # -- encoding

    def _ids(self, spans: list[tuple[int, int, int]], word: bytes) -> bytes:
        """Ids of (id or -1, start, end) pieces, unknown characters in bytes."""
        ids: list[int] = []
        for i, a, b in spans:
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[c] for c in word[a:b]]
            else:
                ids.append(self.unknown_id)
        return np.array(ids, "<i4").tobytes()

    def _scalar(self, word: bytes) -> bytes:
        if self._lists is None:
            self._lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores)]
        base, check, value, scores = self._lists
        n = len(word)
        best, back = [None] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if best[s] is None or word[s] & 0xC0 == 0x80:
                continue
            width = _width(word[s])
            node, single = 0, False
            for e in range(s, n):
                t = base[node] + word[e] + 1
                if check[t] != node:
                    break
                node = t
                if (i := value[node]) >= 0:
                    single |= e + 1 - s == width
                    if best[e + 1] is None or best[s] + scores[i] > best[e + 1]:
                        best[e + 1], back[e + 1] = best[s] + scores[i], (s, i)
            if not single and (best[s + width] is None or best[s] + self.unknown_score > best[s + width]):
                best[s + width], back[s + width] = best[s] + self.unknown_score, (s, -1)
        spans, e = [], n
        while e:
            spans.append((back[e][1], back[e][0], e))
            e = back[e][0]
        return self._ids(spans[::-1], word)

    def _columns(self, words: list[bytes]) -> list[bytes]:
        """Viterbi over many short words at once."""
        n, width = len(words), max(map(len, words))
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        text = np.zeros((n, width), np.int32)
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        text[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat + np.int32(1)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for s in range(width):
            rows = np.flatnonzero((s < size) & (best[:, s] > -np.inf) & ((text[:, s] - 1) & 0xC0 != 0x80))
            if not rows.size:
                continue
            lead = text[rows, s] - 1
            chars = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for e in range(s, min(width, s + self.longest)):
                c = text[rows[live], e]
                t = base[node] + c
                good = (check[t] == node) & (c > 0)
                live, node = live[good], t[good]
                if not live.size:
                    break
                found = value[node]
                at = found >= 0
                if at.any():
                    r, i = rows[live[at]], found[at]
                    score = best[r, s] + self.scores[i]
                    better = score > best[r, e + 1]
                    r, i = r[better], i[better]
                    best[r, e + 1], back[r, e + 1], piece[r, e + 1] = score[better], s, i
                    single[live[at]] |= chars[live[at]] == e + 1 - s
            lone = np.flatnonzero(~single)
            if lone.size:
                r, end = rows[lone], s + chars[lone]
                score = best[r, s] + self.unknown_score
                better = score > best[r, end]
                r, end = r[better], end[better]
                best[r, end], back[r, end], piece[r, end] = score[better], s, -1
        # from the ends back, all words a piece at a time; then each word's pieces in order
        rows, e = np.arange(n), size.copy()
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while rows.size:
            steps.append((rows, piece[rows, e]))
            e = back[rows, e]
            rows, e = rows[e > 0], e[e > 0]
        of = np.concatenate([r for r, _ in steps])
        ids = np.concatenate([i for _, i in steps])
        order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps]), of))
        data = ids[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(of, minlength=n))).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends)]
        for r in np.unique(of[ids < 0]).tolist():  # unknown characters become bytes
            out[r] = self._scalar(words[r])
        return out

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        words = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list({w for own in words for w in own if w not in self.cache})
        held = {}
        by_size: dict[int, list[str]] = {}
        for w in new:
            by_size.setdefault(len(w.encode()) // 4, []).append(w)
        for group in by_size.values():
            coded = [w.encode() for w in group]
            long = len(coded[0]) >= LONG_WORD
            held.update(zip(group, map(self._scalar, coded) if long else self._columns(coded)))
        out = [b"".join([self.cache[w] if w in self.cache else held[w] for w in own]) for own in words]
        short = {w: ids for w, ids in held.items() if len(w) + len(ids) <= CACHED_WORD}
        size = sum(200 + len(w) + len(ids) for w, ids in short.items())
        if self.cached_bytes + size > CACHED_BYTES:
            self.cache, self.cached_bytes = {}, 0
        self.cache.update(short)
        self.cached_bytes += size
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0], "<i4").tolist()

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _width(lead: int) -> int:
    return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


def encoded(docs: DataFrame, model: Unigram) -> DataFrame:
    """doc_id and ids of every text."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches):
        for part in slices(batches):
            ids = [np.frombuffer(x, "<i4") for x in held.value.encode_bytes(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: Unigram) -> DataFrame:
    """doc_id and text of every row of ids."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [held.value.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: Unigram) -> DataFrame:
    """Digests of each text's ids and of what they decode to, in one pass."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        first, last = (min(m.byte_ids.values()), max(m.byte_ids.values())) if m.byte_ids else (0, -1)
        for part in slices(batches):
            texts, rows = part.column("text").to_pylist(), []
            for t, coded in zip(texts, m.encode_bytes(texts)):
                ids = np.frombuffer(coded, "<i4")
                back = m.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(coded), int(((ids >= first) & (ids <= last)).sum()), hashlib.sha256(back.encode()).hexdigest(), back == t.replace(MARK, " ")))
            names, kinds = ["n_ids", "ids_crc32", "n_byte_ids", "decoded_sha256", "round_trip"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, decoded_sha256 string, round_trip boolean"
    )
