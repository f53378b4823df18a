"""Packing of documents into training sequences, balanced by the cost of attention.

A task turns its texts into token ids and packs them block by block. A block has exactly as many places as ids, in
sequences of a whole window; only the end of a partition fills sequences of powers of two besides. Documents go from
the dearest to the cheapest, each to the sequence of least cost among those with room for it, the cost being
linear in its tokens plus quadratic, as attention stays inside a document. Where no sequence has room for all of it, it
is cut at the roomiest one's end and the rest is placed in its turn.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm.token_counts import loaded, mapped, stretches, unsettled

WINDOW = 2048
#: The id that ends each document.
END = 1
#: Tokens of a block, about; what a task holds.
BLOCK_TOKENS = 1 << 20
#: Tokens of a document at which its quadratic cost reaches the linear one.
EVEN = 6144
#: Distinct pre-tokens that a worker remembers, and code points of the longest one.
WORDS, WORD_LENGTH = 400_000, 64
#: Code points from which on a text's pre-tokens are streamed rather than listed.
LONG_TEXT = 1 << 20
#: Bits of a sequence's number within its partition.
COUNTER_BITS = 33

#: Fixed: code points up to U+017F and some marks whose classes need no tables: letters, ASCII digits and space, others.
LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ſ"
SPACE = r" \t-\r"
MARKS = r"\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7‐-‧‰-‾"
#: The pre-token pattern over these code points alone, and any other code point.
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACE}{LETTERS}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
OTHER = re.compile(rf"[^\x00-\x7f{LETTERS}{MARKS}]")


class WordIds(dict):
    """Numbers of pre-tokens: below the vocabulary's size the id of a proven whole token, beyond it a run of ids in flat."""

    def __init__(self, path: str) -> None:
        self.tok, whole, self.split, self.specials = loaded(path)
        self.path, size = path, self.tok.get_vocab_size(with_added_tokens=True)
        super().__init__((w, self.tok.token_to_id(mapped(w))) for w in whole)
        self.first, self.flat, self.begin, self.length = size, array("i", range(size)), array("q", range(size)), array("q", [1]) * size
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.foreign = re.compile(f"[{unsettled()}]")

    def __missing__(self, word: str) -> int:
        number = self.append([t.id for t in self.tok.model.tokenize(mapped(word))])
        if len(word) <= WORD_LENGTH:
            self[word] = number
        return number

    def append(self, ids: list[int]) -> int:
        self.begin.append(len(self.flat))
        self.length.append(len(ids))
        self.flat.extend(ids)
        return len(self.begin) - 1

    def numbers(self, text: str) -> list[np.ndarray]:
        """The numbers of the pre-tokens of a text, as the library cuts them."""
        if self.cut and any(s in text for s in self.specials):
            parts = self.cut.split(text)
            return [x for i, p in enumerate(parts) for x in ([np.array([self.tok.token_to_id(p)])] if i % 2 else self.numbers(p))]
        if text.isascii() or not OTHER.search(text):
            return [self.looked_up(PLAIN, text)]
        if not self.foreign.search(text):
            return [self.looked_up(self.split, text)]
        return [np.array([self.append(self.tok.encode(x, add_special_tokens=False).ids)]) if left else self.looked_up(self.split, x) for left, x in stretches(text, self.foreign) if x]

    def looked_up(self, pattern, text: str) -> np.ndarray:
        words = pattern.findall(text) if len(text) < LONG_TEXT else (m[0] for m in pattern.finditer(text))
        return np.fromiter(map(self.__getitem__, words), np.int64)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        begin, length, flat = (np.frombuffer(x, kind) for x, kind in ((self.begin, np.int64), (self.length, np.int64), (self.flat, np.int32)))
        n = length[numbers]
        after = np.cumsum(n)
        return flat[np.repeat(begin[numbers] - after + n, n) + np.arange(after[-1] if len(after) else 0)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_ids(texts: list[str | None], path: str, end: int = END) -> list[np.ndarray]:
    """The ids of each text and `end`; a null text is empty."""
    out = []
    for text in texts:
        table = word_ids(path)
        parts = [table.ids(x) for x in table.numbers(text or "")]
        out.append(np.concatenate([*parts, [end]]).astype(np.uint32))
        if len(table.begin) - table.first > WORDS:
            word_ids.cache_clear()
    return out


class Rooms:
    """Open sequences by their room, and for every range of rooms the least cost in it."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.none = (1 << 62, -1)
        self.least = [self.none] * (2 * self.size)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def mend(self, room: int) -> None:
        i = room + self.size
        self.least[i] = self.at[room][0] if self.at[room] else self.none
        while i > 1:
            i >>= 1
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def put(self, room: int, cost: int, sequence: int) -> None:
        heapq.heappush(self.at[room], (cost, sequence))
        self.mend(room)

    def cheapest(self, room: int) -> tuple[int, int, int] | None:
        """Takes out (room, cost, sequence) of the cheapest sequence with at least that room, if there is one."""
        best, i, j = 1, room + self.size, 2 * self.size
        while i < j:
            if i & 1:
                best, i = (i if self.least[i] < self.least[best] or best == 1 else best), i + 1
            if j & 1:
                j -= 1
                best = j if self.least[j] < self.least[best] or best == 1 else best
            i, j = i >> 1, j >> 1
        if best == 1 or self.least[best] == self.none:
            return None
        while best < self.size:
            best = 2 * best + (self.least[2 * best + 1] < self.least[2 * best])
        return self.taken(best - self.size)

    def roomiest(self) -> tuple[int, int, int]:
        i = 1
        while i < self.size:
            i = 2 * i + (self.least[2 * i + 1] != self.none)
        return self.taken(i - self.size)

    def taken(self, room: int) -> tuple[int, int, int]:
        cost, sequence = heapq.heappop(self.at[room])
        self.mend(room)
        return room, cost, sequence


def balanced(lengths: list[int], window: int = WINDOW, even: int = EVEN) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths, of one token or more.

    Sequences are filled to the window; what is left over fills one sequence for each power of two in it.
    """
    total = sum(lengths)
    sizes = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if total % window >> b & 1]
    out, waiting, used = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % window, window):
            out.append((doc, start, window, used, 0))
            used += 1
        if n % window:
            waiting.append((-(n % window), doc, n - n % window))
    rooms = Rooms(window)
    for sequence in range(used, len(sizes)):
        rooms.put(sizes[sequence], 0, sequence)
    heapq.heapify(waiting)  # cost rises with length, so the longest is the dearest
    while waiting:
        n, doc, start = heapq.heappop(waiting)
        n = -n
        room, cost, sequence = rooms.cheapest(n) or rooms.roomiest()
        some = min(n, room)
        out.append((doc, start, some, sequence, sizes[sequence] - room))
        if some < room:
            rooms.put(room - some, cost + some * even + some * some, sequence)
        if some < n:
            heapq.heappush(waiting, (some - n, doc, start + some))
    return out


def packed(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int, block: int) -> Iterator[pa.RecordBatch]:
    """(key, start, length, ids, doc_tokens, sequence_id, offset) of the pieces of the rows (key, text) of a partition."""
    number = TaskContext.get().partitionId() << COUNTER_BITS
    block = max(window, block - block % window)
    keys: list[pa.Array] = []
    ids: list[np.ndarray] = []
    before: list[int] = []
    whole: list[int] = []
    held = 0

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal keys, ids, before, whole, held, number
        most, take, done = (held if last else held - held % window), [], 0
        for x in ids:
            take.append(min(len(x), most - done))
            done += take[-1]
        pieces = sorted((seq, off, doc, start, n) for doc, start, n, seq, off in balanced(take, window))
        names = pa.concat_arrays(keys)
        for i in range(0, len(pieces), 4096):
            seq, off, doc, start, n = (np.array(x, np.int64) for x in zip(*pieces[i : i + 4096], strict=True))
            said = [ids[d][s : s + k].astype("<u4").tobytes() for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(doc)), pa.array(start + np.array(before)[doc]), pa.array(n), pa.array(said, pa.binary()), pa.array(np.array(whole)[doc]), pa.array(seq + number), pa.array(off)], names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        number += pieces[-1][0] + 1 if pieces else 0
        # what a block leaves is the end of its last documents
        rest = [i for i in range(len(ids)) if take[i] < len(ids[i])]
        keys = [names.take(pa.array(rest, pa.int64()))] if rest else []
        before, whole = [before[i] + take[i] for i in rest], [whole[i] for i in rest]
        ids = [ids[i][take[i] :] for i in rest]
        held -= most

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            some = batch.slice(i, 64)
            for j, found in enumerate(token_ids(some.column(1).to_pylist(), path, end)):
                keys.append(some.column(0).slice(j, 1))
                ids.append(found)
                before.append(0)
                whole.append(len(found))
                held += len(found)
                if held >= block:
                    yield from out(False)
    if held:
        yield from out(True)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, block: int = BLOCK_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all rows of docs, in sequences.

    ids are the tokens of a piece as little-endian unsigned 32-bit numbers; start counts its document's tokens before
    it, offset the sequence's. Sequences hold `window` tokens; the last ones of each partition of docs hold powers of two
    below that instead, one for each in what is left over, so that none needs padding.
    Each row is a document, whatever other rows have its key or text; a null or empty text is the end token alone.
    Texts hold no hot group, as rows are packed where they are read: no shuffle. A task run again gives the same
    sequences, as long as it reads its rows in the same order; sequences never cross tasks. No rows give no rows; other
    columns are ignored, whatever their names.
    """
    of = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    longs = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in longs]])
    return of.mapInArrow(partial(packed, path=path, window=window, end=end, block=block), kind).withColumnRenamed("key", key)
