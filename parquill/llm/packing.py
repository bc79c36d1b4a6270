"""Packing token sequences by vector bin packing.

Every example is a vector of demands: tokens, segments (one a piece) and loss-bearing tokens. Sequences
are filled one at a time: of the examples that fit, the one whose demands have the largest weighted dot
product with the sequence's remaining room goes in (Panigrahy, Talwar, Uyeda, Wieder: Heuristics for
vector bin packing, 2011). Each task packs the rows of its own partition in bounded windows, so no text
is shuffled. A window's sequences are numbered by the rows' order, so the input's order, such as that of a
mixture, is kept but for the places within a window.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.llm.arrow import Cache, raw, shared, tidy

#: Id after each document.
END = 2
#: A task packs so many tokens at once; what does not fill a sequence waits for the next window.
WINDOW_TOKENS = 1_000_000
#: A room of fewer tokens is padded rather than filled with a cut piece.
LEAST_CUT = 8


#: Byte-level vocabularies write bytes that are no printable Latin-1 sign as the characters from U+0100 on, in order.
_ODD = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTES = {byte: 0x100 + i for i, byte in enumerate(_ODD)}


class Packer:
    """Packs vectors of (tokens, loss-bearing tokens) into sequences under three limits.

    With ``cut`` an item may be cut where it fills a sequence, and what is left at the very end goes into
    sequences with lengths of powers of two; without, items stay whole and one beyond
    the limits gets sequence -1. Loss-bearing tokens of a cut item are taken as its last ones.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool) -> None:
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be at least 1")
        self.limits, self.cut = np.array([max_tokens, max_segments, max_loss], np.int64), cut
        self.sequences = 0

    def pack(self, items: list[list], last: bool) -> tuple[list[tuple], list[list]]:
        """items: [key, start, tokens, loss]. Pieces (key, start, tokens, loss, sequence, offset), and the items that wait."""
        pieces: list[tuple] = []
        whole, limit = [], int(self.limits[0])
        for key, start, n, loss in items:
            if not self.cut and (n > limit or loss > self.limits[2]):
                pieces.append((key, start, n, loss, -1, 0))
                continue
            while self.cut and n >= limit and self._loss(n, loss, limit) <= self.limits[2]:
                pieces.append((key, start, limit, part := self._loss(n, loss, limit), self.sequences, 0))
                self.sequences += 1
                start, n, loss = start + limit, n - limit, loss - part
            if n:
                whole.append([key, start, n, loss])
        if not whole:
            return pieces, []
        demand = np.array([[n, 1, loss] for _, _, n, loss in whole], np.int64)
        free = np.ones(len(whole), bool)
        weight = demand.sum(0) / self.limits / self.limits.astype(float) ** 2  # a scarce limit weighs more
        while free.any():
            room, placed = self.limits.copy(), []
            at = 0
            while True:
                fits = free & (demand <= room).all(1)
                if fits.any():
                    i = int(np.argmax(np.where(fits, demand @ (weight * room), -1.0)))
                    n, loss = int(demand[i, 0]), int(demand[i, 2])
                elif self.cut and free.any() and room[0] >= LEAST_CUT and room[1] and (best := self._cut(demand, free, room)):
                    i, n, loss = best
                else:
                    break
                placed.append((i, whole[i][1], n, loss, at))
                at += n
                room -= [n, 1, loss]
                whole[i][1] += n
                demand[i] -= [n, 0, loss]
                free[i] = demand[i, 0] > 0
            if not placed:  # a limit on loss so tight that nothing fits: one token at a time would not either
                i = int(np.flatnonzero(free)[0])
                placed, at = [(i, whole[i][1], int(demand[i, 0]), int(demand[i, 2]), 0)], limit
                free[i] = False
            if not free.any() and at < limit - LEAST_CUT and not last and room[1]:
                return pieces, [[whole[i][0], start, n, loss] for i, start, n, loss, _ in placed]
            if self.cut and not free.any() and at < limit - LEAST_CUT:
                pieces += self._powers([(whole[i][0], start, n, loss) for i, start, n, loss, _ in placed], at)
                continue
            pieces += [(whole[i][0], start, n, loss, self.sequences, offset) for i, start, n, loss, offset in placed]
            self.sequences += 1
        return pieces, []

    def _powers(self, placed: list[tuple], total: int) -> list[tuple]:
        """What does not fill a sequence, in sequences whose lengths are powers of two, so nothing is padded."""
        out, left = [], list(placed[::-1])
        for bit in range(total.bit_length() - 1, -1, -1):
            room, offset = total & (1 << bit), 0
            while room:
                key, start, n, loss = left.pop()
                head = min(n, room)
                part = self._loss(n, loss, head)
                out.append((key, start, head, part, self.sequences, offset))
                if head < n:
                    left.append((key, start + head, n - head, loss - part))
                room, offset = room - head, offset + head
            self.sequences += bool(offset)
        return out

    @staticmethod
    def _loss(n: int, loss: int, head: int) -> int:
        """Loss-bearing tokens among the first ``head`` of n, if the last ``loss`` bear loss."""
        return max(0, head - (n - loss))

    def _cut(self, demand: np.ndarray, free: np.ndarray, room: np.ndarray) -> tuple[int, int, int] | None:
        """The longest item's head that fills the room."""
        i = int(np.argmax(np.where(free, demand[:, 0], 0)))
        n, loss = int(demand[i, 0]), int(demand[i, 2])
        head = min(int(room[0]), n - loss + int(room[2]), n - 1)
        return (i, head, self._loss(n, loss, head)) if head >= LEAST_CUT else None


def encoder(path: str) -> Cache:
    """A-Z lower-cased word to its ids as little-endian unsigned 32-bit bytes.

    Only for tokenizers that lower-case, whose tokens never span ASCII white space and that drop it, and
    that part letters from signs, so a text's ids are its words' ids in order, and a word's are those
    of its letters and of a full stop or comma at its end.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer_model = tokenizer.model

    def encode(word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0100":  # one pre-token, in normal form C: straight to the model
            ids = [t.id for t in tokenizer_model.tokenize(text.lower().encode().decode("latin-1").translate(_BYTES))]
        elif text[-1] in ".," and text[-2:-1].isalpha() and text[-2] < "\u0100":
            return words[word[:-1]] + words[word[-1:]]
        else:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    words = Cache(encode, 300_000)
    return words


def in_row_order(pieces: list[tuple], first: int) -> list[tuple]:
    """The pieces with sequences from ``first`` on renumbered by the mean of their pieces' keys, which follow the rows."""
    sums: dict[int, list[int]] = {}
    for key, _, n, _, sequence, _ in pieces:
        if sequence >= first:
            own = sums.setdefault(sequence, [0, 0])
            own[0] += key * n
            own[1] += n
    order = sorted(sums, key=lambda x: (sums[x][0] / sums[x][1], x))
    number = {x: first + i for i, x in enumerate(order)}
    return [(*p[:4], number.get(p[4], p[4]), p[5]) for p in pieces]


def pack_documents(
    docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, order: Column | None = None,
    max_tokens: int = 4096, max_segments: int = 1024, max_loss: int | None = None, end: int = END, whole: bool = False,
) -> DataFrame:
    """Packs whole texts into sequences: one row a piece, with its ids.

    ``tokenizer`` is the path of a vocabulary file whose tokens never span white space (default: the
    public file word_bpe_49k.json). A document is its text's ids and then ``end``; every id lies in
    exactly one piece. Returns ``doc_id``, ``start`` (its document's ids before the piece), ``length``,
    ``ids`` (binary: little-endian unsigned 32-bit), ``loss`` (how many of them bear loss),
    ``doc_tokens``, ``sequence_id`` and ``offset`` (where in the sequence, gapless from 0).

    For instruction data, ``prompt_col`` holds a text whose ids come first and bear no loss; all others
    do, and sequences have at most ``max_loss`` of them (default: ``max_tokens``). With ``whole``
    no document is cut; one beyond a limit is returned with a null sequence. ``order`` (a whole number of
    the row, the same for all of a partition) is returned as ``order``: by it and the sequence, sequences
    follow the rows' order also where partitions do not.

    Null or empty text: only ``end``; a null prompt is empty. Null ids and repeated rows are packed like
    any other. An empty table gives no piece. Other columns are not looked at. A sequence's id is its
    partition's number and a number in it, so a task that runs again gives the same ids.
    """
    names = ("doc_id", "start", "length", "ids", "loss", "doc_tokens", "sequence_id", "offset", "order")
    schema = T.StructType([T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in names])
    loss_limit = max_loss or max_tokens

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words = shared(f"encoder {path}", lambda: encoder(path))
        packer = Packer(max_tokens, max_segments, loss_limit, cut=not whole)
        base = TaskContext.get().partitionId() << 32
        close = np.array([end], "<u4").tobytes()
        held: dict[int, tuple[int | None, bytes, int | None]] = {}
        items: list[list] = []
        tokens = number = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal items, tokens
            first = packer.sequences
            pieces, items = packer.pack(items, last)
            pieces = in_row_order(pieces, first)
            for k in range(0, len(pieces), 2000):
                some = pieces[k : k + 2000]
                columns = [
                    [held[p[0]][0] for p in some],
                    [p[1] for p in some],
                    [p[2] for p in some],
                    [held[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p in some],
                    [p[3] for p in some],
                    [len(held[p[0]][1]) // 4 for p in some],
                    [base + p[4] if p[4] >= 0 else None for p in some],
                    [p[5] for p in some],
                    [held[p[0]][2] for p in some],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(names, columns, strict=True)], names=names)
            waits = {x[0] for x in items}
            for key in [x for x in held if x not in waits]:
                del held[key]
            tokens = sum(x[2] for x in items)

        for part in parts:
            for doc, text, prompt, place in zip(part.column(0).to_pylist(), raw(part.column(1)), raw(part.column(2)), part.column(3).to_pylist(), strict=True):
                free = b"".join(map(words.__getitem__, prompt.lower().split()))
                ids = free + b"".join(map(words.__getitem__, text.lower().split())) + close
                held[number] = (doc, ids, place)
                items.append([number, 0, len(ids) // 4, (len(ids) - len(free)) // 4])
                number += 1
                tokens += len(ids) // 4
                if tokens >= WINDOW_TOKENS:
                    yield from flush(False)
        yield from flush(True)

    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    place = F.lit(None).cast("long") if order is None else order.cast("long")
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), prompt.alias("prompt"), place.alias("order")).mapInArrow(tidy(run), schema)
    return pieces.drop("order") if order is None else pieces
