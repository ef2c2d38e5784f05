"""Packing of documents into token sequences of one length, by best-fit decreasing.

Every partition of the scan packs its own pieces, so nothing is shuffled and no task sees more than its split.
An overlong document is first cut into full windows, which are sequences of their own; of the rest, best-fit
decreasing puts each piece into the open window that it fills most tightly. Open windows are found with a segment
tree over remaining capacities: leaf c counts the open windows with c tokens left, and the smallest non-empty leaf
at or above a piece's length is its window.

Defined cases: a null or empty text has only the end id; a null doc_id stays null; repeated rows are packed as often
as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weirlight.llm.common import table, tidy, utf8

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree whose leaf c holds the open windows with c ids left; inner nodes count them."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = defaultdict(list)

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity that is at least need, with that capacity."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For each piece its window, numbered from 0, and its offset there. Ties go in the order given."""
    tree, bins, where, offset = CapacityTree(window), 0, [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.pop_tightest(lengths[i])
        if found is None:
            found = window, bins
            bins += 1
        capacity, where[i] = found
        offset[i] = window - capacity
        if capacity > lengths[i]:
            tree.push(capacity - lengths[i], where[i])
    return where, offset


def filled(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int, int]]]:
    """Best-fit decreasing, then the emptiest windows are cut up to fill the gaps of the others.

    Returns (piece, start in the piece, length, window) rows by window; pieces may be cut freely.
    """
    where, _ = best_fit_decreasing(lengths, window)
    bins: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i, b in enumerate(where):
        bins[b].append((i, 0, lengths[i]))
    left = {b: window - sum(x[2] for x in rows) for b, rows in bins.items()}
    order = sorted(bins, key=lambda b: (left[b], b))  # fullest first
    gaps = [b for b in order if left[b]]
    while len(gaps) > 1:
        source = gaps[-1]
        if sum(left[b] for b in gaps[:-1]) < window - left[source]:
            break
        gaps.pop()
        for i, start, length in bins.pop(source):
            while length:
                to = gaps[0]
                n = min(length, left[to])
                bins[to].append((i, start, n))
                left[to] -= n
                start, length = start + n, length - n
                if not left[to]:
                    gaps.pop(0)
    return [[(i, s, n, k) for i, s, n in bins[b]] for k, b in enumerate(sorted(bins))]


def _byte_letters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


class WordIds(dict):
    """Ids of words between ASCII white space, by word; a missing one is worked out and kept.

    The tokenizer drops white space and its rules never reach over it, so a text's ids are those of its words one
    after the other. Of a word of ASCII and Latin-1 letters, with or without marks at its end, the letters go
    straight to the vocabulary's merges; any other word, and any text that holds a special token's string (which may
    span words), goes through the whole tokenizer. At most `most` words are kept at a time.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.runs, self.marks = Tokenizer.from_file(path), most, {}, {}
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.special = [utf8(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        body, mark = word.rstrip(b".,!?|%*&#$;:()=<>"), b""
        if len(body) < len(word):
            mark = self.marks.get(end := word[len(body) :])
            if mark is None:
                mark = self.marks[end] = self._whole(end)
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError:
            text = ""
        if text.isalpha() and (len(text) == len(body) or max(text) < "\u0100"):
            low = text.lower()
            ids = self.runs.get(low)
            if ids is None:
                mapped = low if len(text) == len(body) else low.encode().decode("latin-1").translate(self.letters)
                ids = self.runs[low] = b"".join([t.id.to_bytes(4, "little") for t in self.merge(mapped)])
            ids += mark
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def packed(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if b"<|" in text and any(s in text for s in self.special):
            return self._whole(text)
        if len(self) > self.most:
            self.clear()
            self.runs.clear()
            self.marks.clear()
        return b"".join(map(self.__getitem__, text.split()))


def _packer(path: str, window: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        words, end = WordIds(path), np.array([end_id], "<u4").tobytes()
        sequence, full = first, window * 4
        rest: list[tuple[int | None, int, bytes, int]] = []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.packed(utf8(text.as_py())) + end
                total = len(ids) // 4
                cut = total - total % window
                for start in range(0, cut, window):
                    out.append((doc, start, window, zlib.crc32(ids[start * 4 : start * 4 + full]), total, sequence, 0))
                    sequence += 1
                if cut < total:
                    rest.append((doc, cut, ids[cut * 4 :], total))
            if out:
                yield rows(out)
        out = []
        for members in filled([len(x[2]) // 4 for x in rest], window):
            at = 0
            for i, start, length, _ in members:
                doc, begin, ids, total = rest[i]
                out.append((doc, begin + start, length, zlib.crc32(ids[start * 4 : (start + length) * 4]), total, sequence, at))
                at += length
            sequence += 1
            if len(out) > 50_000:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidy(_packer(tokenizer, window, end_id)), SCHEMA)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
