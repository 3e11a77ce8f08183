"""Packing: sum-of-squares online packing of tokenised documents into windows of fixed length.

Documents are placed one by one. With N[h] windows filled up to level h, a document of s tokens goes to the level whose
change makes the sum of N[h]**2 over the partly filled levels smallest, opening a window counting as level 0; of equals
it takes the fullest. A level array holds the counts. Documents of a window or more fill whole windows first, and
their rest is placed like any other document. At the end of a task (or once OPEN_MOST windows are open) the open
windows are closed: the emptiest give their pieces, cut where needed, to the gaps of the fullest, and the one that
remains is cut at powers of two, which need no padding. So no token is lost and none is padding, and at most one
window per closing is split up.

A task tokenises and packs what it reads: nothing is shuffled, a lost task is run again from its input, and the size of
a group of copies or of a source makes no difference. A task holds its open windows and one Arrow batch.

Token ids come from the `tokenizers` library. Words recur, so the ids of white-space separated chunks are kept in a
bounded cache that a task empties when it ends; chunks of plain Latin letters, with or without punctuation after them, go
straight to the library's BPE model, everything else through its whole pipeline. Chunks of more than CHUNK_KEPT characters are not kept.
Both short cuts hold for byte-level BPE that lower-cases and splits at white space; where the tokenizer's file says otherwise, every
text goes through the whole pipeline at once.

Defined cases: a null text counts as empty, and an empty document is its closing id alone; repeated rows are packed
each on its own; a null doc_id is kept as null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brookmill.llm._common import cache_of_task, map_arrow

WINDOW = 4096
CLOSING_ID = 2
OPEN_MOST = 2048
CACHE_MOST = 300_000
CHUNK_KEPT = 64
BYTES_OUT, ROWS_OUT = 4 << 20, 500

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

#: Letters whose lower-case form is one letter and that are their own NFC form; what may follow them is one token.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Python splits at these, the tokenizer's patterns do not.
SEPARATORS = re.compile(r"[\x1c-\x1f]")
# The steps before the model for which chunks between white space can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class ChunkTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, chunk by chunk through a bounded cache."""

    def __init__(self, path: str, cache_most: int = CACHE_MOST) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.by_chunk = stated["normalizer"] == NORMALIZER and stated["pre_tokenizer"] == PRE_TOKENIZER and stated["post_processor"] is None and stated["model"]["dropout"] is None
        self.model = self.whole.model
        self.cache_most = cache_most
        self.bytes_as_chars = _byte_alphabet()
        self.empty()

    def empty(self) -> None:
        # Two generations: a full young one becomes the old one, and what is still in use moves back.
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        chars = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes_as_chars)
        return np.array([t.id for t in self.model.tokenize(chars)], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        m = PLAIN.fullmatch(chunk)
        if m is None:
            return self._encode(chunk)
        word, mark = m.groups()
        return self._word(word.lower()) + (self._word(mark) if mark else b"")

    def ids(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._encode(text)
        if SEPARATORS.search(text):
            chunks = re.split(r"[ \t\n\r\x0b\x0c]+", text)
        else:
            chunks = text.split()
        if len(self.cache) > self.cache_most:
            self.cache, self.old = {"": b""}, self.cache
        cache, old, long = self.cache, self.old, []
        for chunk in set(chunks).difference(cache):
            got = old.get(chunk)
            cache[chunk] = self._chunk(chunk) if got is None else got
            if len(chunk) > CHUNK_KEPT:
                long.append(chunk)
        found = b"".join(map(cache.__getitem__, chunks))
        for chunk in long:
            del cache[chunk]
        return found


def _byte_alphabet() -> dict[int, int]:
    """Byte-level BPE writes each byte as a character: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {b: 0x100 + i for i, b in enumerate(other)}


class SumOfSquares:
    """The windows of one task. A piece is [doc_id, start, doc_tokens, ids]; emit(window) gets each finished window."""

    def __init__(self, window: int, emit, open_most: int = OPEN_MOST) -> None:
        self.window, self.emit, self.open_most = window, emit, open_most
        self.level = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list]] = {}
        self.open = 0

    def place(self, piece: list) -> None:
        s = len(piece[3]) // 4
        if s == self.window:
            self.emit([piece])
            return
        n = self.level
        h = np.flatnonzero(n[: self.window - s + 1])
        best, gain = 0, 2 * n[s] + 1
        if h.size:
            after = h + s
            change = np.where(after < self.window, 2 * n[after] + 1, 0) - 2 * n[h] + 1
            k = h.size - 1 - int(np.argmin(change[::-1]))
            if change[k] <= gain:
                best = int(h[k])
        if best:
            box = self.at[best].pop()
            n[best] -= 1
            self.open -= 1
        else:
            box = []
        box.append(piece)
        if best + s == self.window:
            self.emit(box)
            return
        self.at.setdefault(best + s, []).append(box)
        n[best + s] += 1
        self.open += 1
        if self.open > self.open_most:
            self.close()

    def close(self) -> None:
        boxes = [(h, b) for h in sorted(self.at, reverse=True) for b in self.at[h]]
        self.at, self.open = {}, 0
        self.level[:] = 0
        i, j = 0, len(boxes) - 1
        while i < j:
            fill, box = boxes[i]
            have, giver = boxes[j]
            piece = giver.pop()
            s, gap = len(piece[3]) // 4, self.window - fill
            if s > gap:
                giver.append([piece[0], piece[1], piece[2], piece[3][: 4 * (s - gap)]])
                piece = [piece[0], piece[1] + s - gap, piece[2], piece[3][4 * (s - gap) :]]
                s = gap
            box.append(piece)
            boxes[i], boxes[j] = (fill + s, box), (have - s, giver)
            if fill + s == self.window:
                self.emit(box)
                i += 1
            if not giver:
                j -= 1
        if i == j:
            self._halve(*boxes[i])

    def _halve(self, fill: int, box: list) -> None:
        """A last window that is not full becomes windows of descending powers of two."""
        box = box[::-1]
        while fill:
            size = 1 << (fill.bit_length() - 1)
            fill -= size
            out = []
            while size:
                piece = box.pop()
                s = len(piece[3]) // 4
                if s > size:
                    box.append([piece[0], piece[1] + size, piece[2], piece[3][4 * size :]])
                    piece = [piece[0], piece[1], piece[2], piece[3][: 4 * size]]
                    s = size
                out.append(piece)
                size -= s
            self.emit(out)


_loaded: dict[str, ChunkTokenizer] = {}


@cache_of_task
def _empty_loaded() -> None:
    for tok in _loaded.values():
        tok.empty()


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian
    unsigned 32-bit ids). A sequence is its pieces in the order of offset.

    ``docs`` needs doc_id and text; ``tokenizer_file`` is a path that every executor has.
    """
    end = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = _loaded.get(tokenizer_file) or _loaded.setdefault(tokenizer_file, ChunkTokenizer(tokenizer_file))
        rows: list[tuple] = []
        number, size = TaskContext.get().partitionId() << 32, 0

        def emit(box: list) -> None:
            nonlocal number, size
            offset = 0
            for doc, start, total, ids in box:
                n = len(ids) // 4
                rows.append((doc, start, n, total, number, offset, ids))
                offset += n
            number, size = number + 1, size + 4 * offset

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for at in range(0, len(rows), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + ROWS_OUT], strict=True), ARROW, strict=True)], schema=ARROW)
            rows.clear()
            size = 0

        windows = SumOfSquares(window, emit)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tok.ids(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    windows.place([doc, start, total, ids[4 * start : 4 * (start + window)]])
                if size >= BYTES_OUT:
                    yield from out()
        windows.close()
        yield from out()

    return map_arrow(docs.select(docs["doc_id"].cast("bigint"), "text"), run, SCHEMA)
