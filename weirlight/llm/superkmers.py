"""Repeated windows of a fixed number of units (words or bytes) over all documents, by super-k-mers.

Every window takes the least hashed of its k-grams, leftmost on ties, as its minimiser; a run of consecutive windows
with the same minimiser is a segment, and the place of the minimiser in it is its anchor. Equal windows have equal
minimisers at equal places, so they meet in the bucket of that minimiser, at the same distance from the anchor, and
nowhere else. The plan:

1. One pass over the texts cuts segments. Those of one batch whose bytes are equal are one row with a list of twins, so
   that of a group of copies, however large, each batch sends one row for each segment.
2. Rows travel, without their strings, to the partition of their bucket and are read there in its order. A bucket with
   one row and no twin is dropped; the rest is written to the shared folder.
3. The strings of what is left are fetched from the texts and travel packed to their bucket, where a partition is read
   in order, a few whole buckets at a time, and the windows are compared exactly.
4. A bucket of more than HOT rows is gathered nowhere: each of its windows goes by a digest of its content through an
   aggregation that combines before the shuffle.
5. Spans, those of the twins too, are gathered by document and joined with the texts, whose exchange both joins share.

Hashes only bring rows together or keep them apart; that windows are equal is decided on their bytes (or, in hot
buckets, on a 128-bit digest of them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlight.llm.common import INVERSE, KEY, mixed, pieces, powers, sliding_min, stored, utf8, word_hashes, word_spans

CHUNK = 1 << 20
HOT, BROADCAST_BUCKETS = 100_000, 100_000
ROW, MARK = 0, 1
TWINS = "array<struct<owner: long, text_key: long, start: int>>"
CUT_SCHEMA = f"bucket long, owner long, text_key long, start int, windows int, spot int, twins {TWINS}"
FOUND_SCHEMA = f"kind int, {CUT_SCHEMA}"
PACKED_SCHEMA = f"bucket long, owner long, text_key long, start int, windows int, spot int, twins {TWINS}, packed binary"
SPAN_SCHEMA = "owner long, text_key long, start int, windows int"
_TWIN = pa.struct([("owner", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32())])


@dataclass(frozen=True)
class Rule:
    """words: units are words, else bytes. window: units in a window. gram: units in a k-gram. smaller: a window is removed only where a smaller doc_id has it, else where any other place has it."""

    words: bool
    window: int
    gram: int
    smaller: bool

    def plain(self, text: str | None) -> bytes:
        """The bytes that are compared: of words, those joined by one space."""
        return b" ".join(utf8(text).split()) if self.words else utf8(text)


@dataclass
class Segments:
    """Of some texts: text number, first window and number of windows, place of the anchor from there, minimiser and content hashes, and where the bytes lie in data."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    spot: np.ndarray
    bucket: np.ndarray
    content: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: bytes


def segments(texts: list[bytes], rule: Rule) -> Segments:
    data = (b" " if rule.words else b"").join(texts)
    buf = np.frombuffer(data, np.uint8)
    if rule.words:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        b, e = word_spans(buf)
        u, at = word_hashes(buf, b, e), np.searchsorted(b, np.r_[np.cumsum(size + 1) - size - 1, len(buf) + 1])
    else:
        b = e = np.zeros(0, np.int64)
        u, at = buf.astype(np.uint64) + np.uint64(1), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    n, w = len(u), rule.window - rule.gram + 1
    if n < rule.window:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none.view(np.uint64), none.view(np.uint64), none, none, data)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(u * powers(n), out=h[1:])
    inverse = powers(n + 1, INVERSE)
    gram = mixed((h[rule.gram :] - h[: -rule.gram]) * inverse[: n - rule.gram + 1])
    order = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    place = (sliding_min(order, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))[: len(place)]
    valid = np.arange(len(place)) + rule.window <= at[doc + 1]
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]] & valid
    first = np.flatnonzero(new)
    ends = np.flatnonzero(np.r_[(place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~valid[1:], True] & valid) + 1
    stop = ends + rule.window - 1
    content = mixed((h[stop] - h[first]) * inverse[first] ^ (stop - first).astype(np.uint64))
    begin, end = (b[first], e[stop - 1]) if rule.words else (first, stop)
    return Segments(doc[first], first - at[doc[first]], ends - first, place[first] - first, gram[place[first]], content, begin, end, data)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place within it, for rows that are repeated so many times."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _cutter(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rule.plain(t) for t in batch.column(2).to_pylist()]
            ids, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            parts = [(b, segments(texts[b:e], rule)) for b, e in pieces(texts, CHUNK)]
            if not parts:
                continue
            doc = np.concatenate([b + p.doc for b, p in parts])
            if not len(doc):
                continue
            part = np.repeat(np.arange(len(parts)), [len(p.doc) for _, p in parts])
            start, windows, spot, bucket, content, begin, end = (np.concatenate([getattr(p, c) for _, p in parts]) for c in ("start", "windows", "spot", "bucket", "content", "begin", "end"))
            # segments that seem equal together, smaller owners first, then rows of one document
            order = np.lexsort((start, keys[doc], ids[doc], content, bucket))
            fresh = np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (content[order][1:] != content[order][:-1])]
            head = np.repeat(np.flatnonzero(fresh), np.diff(np.r_[np.flatnonzero(fresh), len(order)]))
            data, p, b, e = [x.data for _, x in parts], part[order].tolist(), begin[order].tolist(), end[order].tolist()
            at, own = -1, b""
            for i in np.flatnonzero(~fresh).tolist():  # bytes decide
                h = int(head[i])
                if h != at:
                    at, own = h, data[p[h]][b[h] : e[h]]
                if data[p[i]][b[i] : e[i]] != own:
                    fresh[i], head[i] = True, i
            behind = np.argsort(head, kind="stable")  # heads with their twins behind them
            order, head = order[behind], head[behind]
            heads = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            counts = np.diff(np.r_[heads, len(order)]) - 1
            first = np.zeros(len(order), bool)
            first[heads] = True
            twin, lead = order[~first], order[heads]
            twins = pa.StructArray.from_arrays([pa.array(ids[doc[twin]]), pa.array(keys[doc[twin]]), pa.array(start[twin].astype(np.int32))], fields=list(_TWIN))
            for k in range(0, len(lead), 200_000):
                x = lead[k : k + 200_000]
                c = counts[k : k + 200_000]
                lo = int(counts[:k].sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[x].view(np.int64)), pa.array(ids[doc[x]]), pa.array(keys[doc[x]]), *[pa.array(y[x].astype(np.int32)) for y in (start, windows, spot)], _lists(twins.slice(lo, int(c.sum())), c)],
                    names=["bucket", "owner", "text_key", "start", "windows", "spot", "twins"],
                )

    return run


def _meeting(hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of their buckets, without those that are alone there; a mark for each bucket of more than `hot` rows. Holds one bucket at most, and of a hot one just a part."""

    def told(rows: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
        for b in rows.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), *b.columns], names=["kind", *b.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        going: int | None = None  # a hot bucket whose rows go on
        for batch in _with_end(batches):
            if batch is not None and not len(batch):
                continue
            rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rows is None:
                return
            bucket = rows.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            stop = len(bucket) if batch is None else int(edges[-1])
            counts = np.diff(np.r_[edges, len(bucket)])
            twins = np.concatenate([np.diff(np.asarray(c.offsets)) for c in rows.column(6).chunks]) > 0
            meets = np.repeat((counts > 1) | (bucket[edges] == going if going is not None else np.zeros(len(edges), bool)), counts) | np.repeat(np.logical_or.reduceat(twins, edges), counts)
            keep = meets & (np.arange(len(bucket)) < stop)
            if keep.any():
                yield from told(rows.filter(pa.array(keep)), ROW)
            for k in np.flatnonzero((counts > hot) & (edges + counts <= stop)):
                if bucket[edges[k]] != going:
                    yield from told(rows.slice(int(edges[k]), 1), MARK)
            rest = rows.slice(stop) if stop < len(bucket) else None
            if going is not None and (rest is None or bucket[-1] != going):
                going = None
            if rest is not None and (len(rest) > hot or bucket[-1] == going):
                if going is None:
                    going = int(bucket[-1])
                    yield from told(rest.slice(0, 1), MARK)
                yield from told(rest, ROW)
                rest = None

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


Exact = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def removed_spans(keyed: DataFrame, rule: Rule, exact: Exact, hot: int = HOT) -> DataFrame:
    """owner, text_key and the list of (start, windows) to be removed. keyed: these two, doc_id and text, in any partitions.

    exact gets rows of PACKED_SCHEMA in the order of their buckets and returns rows of SPAN_SCHEMA, twins included.
    """
    cut = keyed.select(*KEY, "text").mapInArrow(_cutter(rule), CUT_SCHEMA)
    found = stored(cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meeting(hot), FOUND_SCHEMA))
    marks, rows = found.where(F.col("kind") == MARK).select("bucket"), found.where(F.col("kind") == ROW)
    wanted = rows.groupBy(*KEY).agg(F.collect_list(F.struct("bucket", "start", "windows", "spot", "twins")).alias("wanted"))
    packed = keyed.repartition(*KEY).join(wanted, KEY).select(*KEY, "text", "wanted", "doc_id")  # with doc_id, the exchange is the same as the last join's
    packed = packed.mapInArrow(_packing(rule), PACKED_SCHEMA)
    n = marks.count()
    if not n:
        spans = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(exact, SPAN_SCHEMA)
    else:
        packed = stored(packed)
        marks = F.broadcast(marks) if n <= BROADCAST_BUCKETS else marks
        spans = packed.join(marks, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(exact, SPAN_SCHEMA)
        spans = spans.unionByName(_counted(packed.join(marks, "bucket", "left_semi"), rule))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def _counted(packed: DataFrame, rule: Rule) -> DataFrame:
    """Windows of hot buckets to be removed: by a digest of each, whose places are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, key, start, windows, twins, text in zip(*(batch.column(c).to_pylist() for c in ("owner", "text_key", "start", "windows", "twins", "packed"))):
                if rule.words:
                    parts = text.split(b" ")
                    own = [b" ".join(parts[k : k + rule.window]) for k in range(windows)]
                else:
                    own = [text[k : k + rule.window] for k in range(windows)]
                places = [(owner, key, start), *((t["owner"], t["text_key"], t["start"]) for t in twins)]
                digests = [hashlib.blake2b(w, digest_size=16).digest() for w in own]
                for k in range(0, len(places), 1000):
                    part = places[k : k + 1000]
                    o, y, s = zip(*part)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digests * len(part), pa.binary()), pa.array(np.repeat(np.array(o, np.int64), n)), pa.array(np.repeat(np.array(y, np.int64), n)), pa.array((np.repeat(np.array(s, np.int64), n) + np.tile(np.arange(n), len(part))).astype(np.int32))],
                        names=["digest", "owner", "text_key", "start"],
                    )

    places = stored(packed.mapInArrow(run, "digest binary, owner long, text_key long, start int"))
    if rule.smaller:
        heads = places.groupBy("digest").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select("digest", "least")
        gone = places.join(heads, "digest").where("owner > least")
    else:
        gone = places.join(places.groupBy("digest").count().where("count > 1").select("digest"), "digest")
    return gone.select(*KEY, "start", F.lit(1).alias("windows"))


def _packing(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 64):
                batch = whole.slice(k, 64)
                lists = batch.column(3)
                counts = np.diff(np.asarray(lists.offsets))
                wanted = lists.flatten()
                bucket, start, windows, spot, twins = wanted.flatten()
                row = np.repeat(np.arange(len(batch)), counts)
                begin, stop = start.to_numpy(), start.to_numpy() + windows.to_numpy() + rule.window - 1
                packed: list[bytes] = []
                at = 0
                for text, n in zip(batch.column(2).to_pylist(), counts.tolist()):
                    text = utf8(text)
                    if rule.words:
                        words = text.split()
                        packed += [b" ".join(words[x:y]) for x, y in zip(begin[at : at + n].tolist(), stop[at : at + n].tolist())]
                    else:
                        packed += [text[x:y] for x, y in zip(begin[at : at + n].tolist(), stop[at : at + n].tolist())]
                    at += n
                yield pa.RecordBatch.from_arrays([bucket, batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), start, windows, spot, twins, pa.array(packed, pa.binary())], names=["bucket", "owner", "text_key", "start", "windows", "spot", "twins", "packed"])

    return run


def whole_buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in the order of their buckets, as tables of whole buckets with about `most` bytes of packed strings."""
    rest: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        rest.append(batch)
        size += batch.column("packed").nbytes
        if size < most:
            continue
        whole = pa.Table.from_batches(rest)
        bucket = whole.column("bucket").to_numpy()
        edges = np.flatnonzero(bucket[1:] != bucket[:-1])
        if len(edges):
            stop = int(edges[-1]) + 1
            yield whole.slice(0, stop).combine_chunks()
            rest = whole.slice(stop).combine_chunks().to_batches()
            size = sum(b.column("packed").nbytes for b in rest)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def with_twins(rows: pa.Table, row: np.ndarray, at: np.ndarray, n: np.ndarray, least: np.ndarray | None = None) -> pa.RecordBatch:
    """Spans of n windows from window `at` of these rows, and the same spans of their twins; with least, only those of larger owners."""
    twins = rows.column("twins").chunk(0)
    offsets = np.asarray(twins.offsets)
    again, k = repeated((offsets[1:] - offsets[:-1])[row])
    places = offsets[row[again]] + k
    owner, key, start = (np.r_[rows.column(c).to_numpy()[row], np.asarray(x)[places]] for c, x in zip(("owner", "text_key", "start"), twins.values.flatten()))
    start, n = start + np.r_[at, at[again]], np.r_[n, n[again]]
    if least is not None:
        larger = owner > np.r_[least, least[again]]
        owner, key, start, n = owner[larger], key[larger], start[larger], n[larger]
    return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(key), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["owner", "text_key", "start", "windows"])
