"""Benchmark passages inside documents, by the q-gram lemma and banded alignment.

Texts are lower-cased; every run of other ASCII characters than letters and digits becomes one space. An item of m
characters is found where a stretch of a document has at most EDITS * m edits from it. By the q-gram lemma such a
stretch shares at least m - Q + 1 - Q * budget of the item's Q-grams, within a band of diagonals as wide as the budget.
First the Q-grams of any item are counted over windows of the text, per length class of items; where the least bound of
the class is met, shared Q-grams are counted per item in overlapping diagonal bands; what meets the item's own bound is
aligned in that band, and the alignment decides.

The benchmark is worked through in blocks of at most BLOCK_CHARS characters, each against all documents, so what a task
holds is bounded whatever its size; nothing is shuffled.

Defined cases: items without a Q-gram (null, empty or under Q characters) are never found; a document that quotes a part
of an item holds it only if what is missing is within the edits; null and empty texts hold nothing; a null doc_id stays
null; repeated rows are searched alike; equal items are all reported; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weirlight.llm.common import INVERSE, mixed, pieces, powers, table, tidy

Q, EDITS = 8, 0.08
BLOCK_CHARS = 8_000_000
TABLE_BITS = 22
CHUNK = 1 << 19
SCHEMA = "doc_id long, item_id long, edits long, start long, end long"
_PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def normal(text: str | None) -> str:
    return "" if text is None else b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("utf-8", "replace")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(x: np.ndarray) -> np.ndarray:
    """A hash of each Q-gram of the code points."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(len(x)), out=h[1:])
    return mixed((h[Q:] - h[:-Q]) * powers(len(x) + 1, INVERSE)[: len(x) - Q + 1])


def budget(m: int, edits: float = EDITS) -> int:
    """Edits allowed for m characters: no more than leave the bound above zero, which for 8 to 15 characters are none."""
    return min(int(m * edits), max(0, m // Q - 1))


def bound(m: int, edits: float = EDITS) -> int:
    return m - Q + 1 - Q * budget(m, edits)


def aligned(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Least edits of the whole item against any stretch of text, where it starts and ends; None above `most`.

    Columns are places of the text; the row's insertions come from a running minimum. The start travels along.
    """
    n = len(text)
    ramp = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), ramp.copy()
    big = np.int64(1) << 32
    for i, c in enumerate(item):
        key = np.empty(n + 1, np.int64)
        key[0] = (i + 1) * big
        replaced = (cost[:-1] + (text != c)) * big + start[:-1]
        dropped = (cost[1:] + 1) * big + start[1:]
        key[1:] = np.minimum(replaced, dropped)
        key = np.minimum.accumulate(key - ramp * big) + ramp * big  # a character of the text more costs one
        cost, start = key // big, key % big
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


@dataclass
class Index:
    """Items of one block: id, normalised text, code points; their Q-grams sorted; the classes of their lengths."""

    items: list[tuple[int | None, str]]
    edits: float = EDITS

    def __post_init__(self) -> None:
        self.items = [x for x in self.items if bound(len(x[1]), self.edits) > 0]
        self.codes = [codes(t) for _, t in self.items]
        grams = [qgrams(x) for x in self.codes]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram, self.owner, self.place = flat[order], owner[order], place[order]
        lengths = np.array([len(x) for x in self.codes], np.int64)
        kind = np.floor(np.log2(np.maximum(lengths, 1)) * 2).astype(int) if len(lengths) else lengths
        self.classes = []
        self.table = np.zeros(1 << TABLE_BITS, np.uint8)
        for k in np.unique(kind):
            own = lengths[kind == k]
            bit = 1 << (len(self.classes) % 8)
            window = int(own.max()) + budget(int(own.max()), self.edits)
            self.classes.append((bit, window, min(bound(int(m), self.edits) for m in own)))
            mine = np.isin(self.owner, np.flatnonzero(kind == k))
            self.table[(self.gram[mine] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] |= bit

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, end) of the best alignment of each item found in one normalised text."""
        x = codes(text)
        g = qgrams(x)
        lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
        n = hi - lo
        pos = np.repeat(np.arange(len(g)), n)
        at = np.repeat(lo, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
        owner, diagonal = self.owner[at], pos - self.place[at]
        found: dict[int, tuple[int, int, int]] = {}
        order = np.argsort(owner, kind="stable")
        owner, diagonal, pos = owner[order], diagonal[order], pos[order]
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
        for b, e in zip(edges, [*edges[1:], len(owner)]):
            i = int(owner[b])
            item = self.codes[i]
            most, need = budget(len(item), self.edits), bound(len(item), self.edits)
            if e - b < need:
                continue
            width = most + 1
            best = None
            exact = text.find(self.items[i][1])
            if exact >= 0:
                found[i] = (0, exact, exact + len(item))
                continue
            # bands of 2 * width diagonals, one every width: any width of them lies in one band
            band = np.floor_divide(diagonal[b:e], width)
            count = defaultdict(set)
            for k, p in zip(band.tolist(), pos[b:e].tolist()):
                count[k].add(p)
                count[k - 1].add(p)
            for k, places in count.items():
                if len(places) < need:
                    continue
                begin, end = max(0, k * width - most), min(len(x), (k + 2) * width + len(item) + most)
                got = aligned(item, x[begin:end], most)
                if got and (best is None or (got[0], got[1] + begin) < best[:2]):
                    best = (got[0], got[1] + begin, got[2] + begin)
            if best:
                found[i] = best
        return [(i, *v) for i, v in sorted(found.items())]

    def suspects(self, texts: list[str]) -> list[int]:
        """Numbers of the texts where some window holds the least bound of a length class."""
        x = np.concatenate([codes(t + "￿") for t in texts]) if texts else np.zeros(0, np.uint32)
        g = qgrams(x)
        if not len(g) or not self.items:
            return []
        mask = self.table[(g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        out: set[int] = set()
        for bit, window, least in self.classes:
            total = np.zeros(len(mask) + 1, np.int32)
            np.cumsum((mask & bit) != 0, out=total[1:])
            w = min(window, len(mask))
            hit = np.flatnonzero(total[w:] - total[:-w] >= least)
            for at in (hit, hit + w - 1):  # a window may begin in one text and reach into the next
                out.update(np.unique(np.searchsorted(ends, at, "right")).tolist())
            inner = np.flatnonzero(np.diff(ends) < w) + 1
            if len(inner) and len(hit):
                out.update(inner.tolist())
        return sorted(i for i in out if i < len(texts))


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most `most` characters (one item at least); the driver holds one at a time."""
    own: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select(benchmark["item_id"].cast("long"), "text").toLocalIterator():
        text = normal(row[1])
        if own and size + len(text) > most:
            yield own
            own, size = [], 0
        own.append((row[0], text))
        size += len(text)
    if own:
        yield own


def found_in(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    plain = [normal(t) for t in texts]
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for b, e in pieces(plain, CHUNK):
        for i in index.suspects(plain[b:e]):
            out[b + i] = index.matches(plain[b + i])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, and the stretch of the normalised text, for each document and item found in it."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])

    def searching(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[k], index.items[i][0], *rest) for k, x in enumerate(found_in(index, batch.column(1).to_pylist())) for i, *rest in x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return run

    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in blocks(benchmark):
        out = out.unionByName(docs.mapInArrow(searching(Index(block, edits)), SCHEMA))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""

    def keeping(index: Index, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in found_in(index, batch.column(at).to_pylist())], pa.bool_()))

        return run

    for block in blocks(benchmark):
        docs = docs.mapInArrow(tidy(keeping(Index(block, edits), docs.columns.index("text"))), docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
