"""Fill-in-middle transformation over a sparse exception index.

A text is held as UTF-8 bytes. Only its multibyte characters are indexed: the
code-point position of each, its first byte, and the excess bytes up to and
with it. ``searchsorted`` on these turns a code-point cut into a byte cut and back;
inside the ASCII spans between exceptions both move in step, so a cut costs the
logarithm of the number of exceptions and a pure ASCII text has an empty index.

A text of n units (code points, or bytes, whose cuts move back to the start of a
character) is cut after the smaller and the larger of two values that the
id's digest gives. ``plain`` documents stay as they are: empty texts, texts that hold
a marker, and a share of the others chosen by the digest. The others become
``<P>``prefix``<S>``suffix``<M>``middle (psm) or ``<S>``suffix``<P>``prefix``<M>``middle
(spm). No marker can straddle a cut and no kept text holds one, so
:func:`restored` finds the text again from output and form alone.

Defined results: a null text counts as empty and stays plain; a null id counts as
the empty id; repeated ids are cut at the same places, each row by its own text; an
empty table gives no rows; further columns are not read. Bytes that are not valid
UTF-8 count as in Spark's own strings: every byte that is not a continuation byte
begins a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, documents_like, map_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many are transformed, and of 100 transformed ones so many are spm.
FIM_PERCENT = 90
SPM_PERCENT = 20


class ExceptionIndex:
    """Positions and excess bytes of a text's multibyte characters."""

    def __init__(self, raw: bytes):
        self.n_bytes = len(raw)
        if raw.isascii():
            self.char_at = self.byte_at = self.excess = np.empty(0, dtype=np.int64)
            self.n_chars = len(raw)
            return
        octets = np.frombuffer(raw, dtype=np.uint8)
        tail = np.flatnonzero((octets & 0xC0) == 0x80)
        # a character's continuation bytes follow its first byte without a gap
        first = np.flatnonzero(np.diff(tail, prepend=-2) != 1)
        size = np.diff(first, append=len(tail))
        self.byte_at = tail[first] - 1
        self.excess = np.cumsum(size)
        self.char_at = self.byte_at - (self.excess - size)
        self.n_chars = len(raw) - len(tail)

    def to_byte(self, chars: np.ndarray) -> np.ndarray:
        """Byte offsets of the starts of code points."""
        before = np.searchsorted(self.char_at, chars, side="left")
        return chars + np.append(0, self.excess)[before]

    def to_char(self, octets: np.ndarray) -> np.ndarray:
        """Code points that hold the bytes at these offsets."""
        upto = np.searchsorted(self.byte_at, octets, side="right")
        # inside the last exception the difference is at most that character's own position
        return np.maximum(np.append(0, self.char_at)[upto], octets - np.append(0, self.excess)[upto])


def id_draws(doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit values of the sha256 of ``1:`` and the decimal id."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else b"%d" % doc_id)).digest()
    return np.frombuffer(digest[:16], dtype=">u4").tolist()


def transform(raw: bytes, draws: list[int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
              unit: str = "chars") -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix and middle in code points, output) of one text."""
    index = ExceptionIndex(raw)
    n = index.n_chars if unit == "chars" else index.n_bytes
    h1, h2, h3, h4 = draws
    if not raw or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, raw
    cuts = np.array(sorted((h1 % (n + 1), h2 % (n + 1))), dtype=np.int64)
    chars = cuts if unit == "chars" else index.to_char(cuts)
    a, b = index.to_byte(chars).tolist()
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    spm = h4 % 100 < spm_percent
    out = SUFFIX + suffix + PREFIX + prefix if spm else PREFIX + prefix + SUFFIX + suffix
    return n, "spm" if spm else "psm", int(chars[0]), int(chars[1] - chars[0]), out + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text behind an output."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX):].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX):].partition(PREFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, unit: str = "chars",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output (binary, UTF-8)."""
    if unit not in ("chars", "bytes"):
        raise ValueError("unit is chars or bytes")

    def run(batches):
        for b in batches:
            rows = [transform(raw, id_draws(i), fim_percent, spm_percent, unit)
                    for i, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols, kinds)],
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(as_bytes(documents_like(docs, id_col, text_col)), run,
                       "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(outputs: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle` with the text (binary, UTF-8) that ``output`` and ``form`` give back."""
    columns = outputs.columns

    def run(batches):
        for b in batches:
            text = [restore(o, f) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.binary())], [*columns, "restored"])

    return map_batches(outputs, run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in outputs.schema)}, restored binary")


def fill_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    return restored(fill_in_middle(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))
