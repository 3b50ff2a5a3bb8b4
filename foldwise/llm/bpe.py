"""Byte-level BPE encoding and decoding.

A pre-token's bytes are a list of symbols, next to it the merge ranks of neighbouring
pairs; the smallest rank merges first, leftmost among equals. Beyond ``SHORT`` bytes a
doubly linked list and a priority queue of (merge rank, position) do the same; entries
whose pair has changed since are skipped as stale. Decoding concatenates the
vocabulary's byte strings. Texts stream through Arrow batches; each worker keeps a
bounded cache of encoded pre-tokens.

Defined results: null and empty texts have no tokens (ids digest of the empty
string); special tokens of the vocabulary file found in a text become their id,
as the file says; repeated rows repeat; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_bytes, documents_like, map_batches, worker_state

#: Fixed value: the split pattern of the byte-level pre-tokeniser.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The characters of its three classes below U+0250, for texts that have no others.
LOW_LETTERS, LOW_NUMBERS, LOW_SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
LOW_PATTERN = (PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{LOW_SPACES}{LOW_LETTERS}{LOW_NUMBERS}]")
               .replace(r"(?!\S)", f"(?![^{LOW_SPACES}])").replace(r"\p{L}", f"[{LOW_LETTERS}]")
               .replace(r"\p{N}", f"[{LOW_NUMBERS}]").replace(r"\s", f"[{LOW_SPACES}]"))


#: Bytes of a pre-token up to which a scan of all pairs is faster than a priority queue.
SHORT = 64
NO_MERGE = 1 << 60


class _Memo(dict):
    """A function's results by argument; when it holds ``limit`` of them they become the older ones, of which those asked for come back."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.older = fn, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= 96:
            if len(self) >= self.limit:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder of one tokenizer file (JSON with vocabulary and merges)."""

    def __init__(self, path: str, cache: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocab
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = [ids[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.byte_id = [ids[c] for c in symbols]
        byte_of = {c: i for i, c in enumerate(symbols)}
        self.token_bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes.update({i: t.encode() for t, i in self.special.items()})
        self.split, self.low_split = regex.compile(PATTERN).findall, re.compile(LOW_PATTERN).findall
        self.beyond_low = re.compile("[^\x00-\u024f]").search
        self.special_split = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.piece_ids = _Memo(lambda piece: ",".join(map(str, self.merge(piece.encode("utf-8")))), cache)
        self.id_bytes = {str(i): token for i, token in self.token_bytes.items()}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        sym = list(map(self.byte_id.__getitem__, data))
        return self.merge_short(sym) if len(sym) <= SHORT else self.merge_long(sym)

    def merge_short(self, sym: list[int]) -> list[int]:
        """``sym`` with all merges made, by scans of the pairs' ranks."""
        get, made = self.ranks.get, self.made
        ranks = [get(pair, NO_MERGE) for pair in zip(sym, sym[1:], strict=False)]
        while ranks and (least := min(ranks)) < NO_MERGE:
            i = ranks.index(least)
            sym[i] = made[least]
            del sym[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((sym[i - 1], sym[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = get((sym[i], sym[i + 1]), NO_MERGE)
        return sym

    def merge_long(self, sym: list[int]) -> list[int]:
        """As :meth:`merge_short`, by a priority queue."""
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []
        for i in range(n - 1):
            m = merges.get((sym[i], sym[i + 1]))
            if m:
                heap.append((m[0], i, m[1], sym[i], sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = nxt[i] if sym[i] == left else n
            if j >= n or sym[j] != right:
                continue  # stale: a neighbour has merged since
            sym[i], sym[j] = merged, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                m = merges.get((merged, sym[k]))
                if m:
                    heapq.heappush(heap, (m[0], i, m[1], merged, sym[k]))
            p = prev[i]
            if p >= 0:
                m = merges.get((sym[p], merged))
                if m:
                    heapq.heappush(heap, (m[0], p, m[1], sym[p], merged))
        return [s for s in sym if s >= 0]

    def parts(self, text: str) -> list[str]:
        """The ids of each pre-token of a text, joined by commas."""
        if not text:
            return []
        split = self.split if self.beyond_low(text) else self.low_split
        if not any(t in text for t in self.special):
            return list(map(self.piece_ids.__getitem__, split(text)))
        out = []
        for piece in self.special_split(text):
            if piece in self.special:
                out.append(str(self.special[piece]))
            else:
                out += map(self.piece_ids.__getitem__, split(piece))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.parts(text) for i in ids.split(",")]

    def decode_joined(self, ids: str) -> str:
        """The text of decimal ids joined by commas."""
        return b"".join(map(self.id_bytes.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec(path: str) -> BpeCodec:
    return worker_state(f"bpe:{path}", lambda: BpeCodec(path))


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, shape, kind: str) -> DataFrame:
    """doc_id, n_tokens, then ``shape`` of the joined ids and of the decoded text."""

    def run(batches):
        c = codec(path)
        for b in batches:
            counts, ids, texts = [], [], []
            for raw in b.column("text").to_pylist():
                parts = c.parts(raw.decode("utf-8", "replace"))
                joined = ",".join(parts)
                counts.append(joined.count(",") + 1 if parts else 0)
                ids.append(shape(joined))
                texts.append(shape(c.decode_joined(joined)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()),
                                              pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                                             ["doc_id", "n_tokens", "ids" + kind, "decoded" + kind])

    return map_batches(as_bytes(documents_like(docs, id_col, text_col)), run,
                       f"doc_id long, n_tokens long, ids{kind} string, decoded{kind} string")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas), decoded: one row per document."""
    return _encoded(docs, path, id_col, text_col, str, "")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with SHA-256 (hex) of the joined ids and of the decoded text."""
    return _encoded(docs, path, id_col, text_col, lambda s: hashlib.sha256(s.encode()).hexdigest(), "_sha256")
