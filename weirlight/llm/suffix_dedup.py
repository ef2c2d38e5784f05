"""Bytes covered by a 200-byte string that also starts anywhere else are removed.

Segments of bytes that share a minimiser, the anchor, meet in a bucket (see superkmers); equal 200-byte strings lie at
the same distance from it. So symbols are tagged by their distance from the anchor, and the Burrows-Wheeler transform
of a collection of segments over tagged symbols is built column by column: each round puts one more symbol of every
segment in front of its suffix. Because of the tags all suffixes of a round stand together in the transform, so a round
is a block appended to three sequential files, which hold the symbol before each suffix, the suffix's segment, and its
common prefix with the suffix above. The order of a block follows from the symbols and the order of the block before it,
its common prefixes from those of that block. When all columns are in, the files are read from first to last: a common
prefix of 200 symbols with either neighbour marks a window. A row that stands for equal segments goes in twice.

The files lie in the shared folder where that is a file system that pyarrow opens, else in memory; a task works on a few
whole buckets at a time, so that they are some 100 MB at most, and removes them.

Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input, not on what is left.

Defined cases: a null or empty text has no bytes; a null doc_id stays null; a repeated row is another document, so its
strings start elsewhere too; each input row gives a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from weirlight.llm.common import KEY, row_key, shared_dir, table, utf8
from weirlight.llm.superkmers import Rule, removed_spans, whole_buckets, with_twins

LENGTH, GRAM = 200, 40
RULE = Rule(words=False, window=LENGTH, gram=GRAM, smaller=False)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
CHUNK, PRUNE = 8 << 20, 8
COLUMNS = {"bwt": np.uint8, "row": np.int32, "common": np.uint8}


class Blocks:
    """The transform's rows: a block for each column, appended and then read from first to last, in a file for each of COLUMNS or in memory."""

    def __init__(self, folder: str | None):
        self.sizes: list[int] = []
        self.kept: dict[str, list[np.ndarray]] = {c: [] for c in COLUMNS}
        self.files: fs.FileSystem | None = None
        if folder is not None:
            self.files, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            self.at = f"{at}/rows-{uuid.uuid4().hex}"
            self.files.create_dir(self.at, recursive=True)
            self.open = {c: self.files.open_output_stream(f"{self.at}/{c}", compression=None, buffer_size=1 << 20) for c in COLUMNS}

    def append(self, **parts: np.ndarray) -> None:
        self.sizes.append(len(parts["row"]))
        for c, kind in COLUMNS.items():
            part = np.ascontiguousarray(parts[c], kind)
            if self.files is None:
                self.kept[c].append(part)
            else:
                self.open[c].write(part)

    def read(self) -> Iterator[dict[str, np.ndarray]]:
        if self.files is None:
            for i in range(len(self.sizes)):
                yield {c: self.kept[c][i] for c in COLUMNS}
            return
        for f in self.open.values():
            f.close()
        self.open = {c: self.files.open_input_stream(f"{self.at}/{c}", compression=None, buffer_size=1 << 20) for c in COLUMNS}
        for n in self.sizes:
            yield {c: np.frombuffer(self.open[c].read(n * np.dtype(kind).itemsize), kind) for c, kind in COLUMNS.items()}

    def close(self) -> None:
        if self.files is not None:
            for f in self.open.values():
                f.close()
            self.files.delete_dir(self.at)


def openable(folder: str) -> str | None:
    """The folder, if pyarrow opens its file system."""
    if "://" not in folder:
        return folder.removeprefix("file:") if folder.startswith(("/", "file:/")) else None
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError, ValueError):
        return None
    return folder


def repeated_windows(strings: list[bytes], anchors: np.ndarray, bucket: np.ndarray, length: int = LENGTH, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """String number and place of every window of `length` bytes that another string of its bucket, or a copy of it in the list, has at the same distance from the anchor. Buckets stand together."""
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    if not m or sizes.max() < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a byte of UTF-8 is never 0xFF, so byte + 1 leaves 0 for what stands before a string
    text = np.frombuffer(bytes(PRUNE) + b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
    text[:PRUNE] = 0
    base = np.cumsum(sizes + 1) - sizes - 1 + PRUNE
    anchor = (base + anchors).astype(np.int64)
    before, behind = anchors.astype(np.int64), sizes - anchors
    group = np.cumsum(np.r_[0, bucket[1:] != bucket[:-1]]).astype(np.int64)
    entry = np.argsort(-behind, kind="stable")
    enters = behind[entry]
    blocks = Blocks(folder)
    try:
        row, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, columns = 0, []
        for c in range(int(behind.max()) - 1, -int(before.max()) - 1, -1):
            stop = int(np.searchsorted(-enters, -(c + 1), "right"))
            if stop > at:  # strings that end here: empty suffixes, first of their buckets
                new = entry[at:stop]
                new = new[np.argsort(group[new], kind="stable")]
                place = np.searchsorted(group[row], group[new], "left")
                row, common = np.insert(row, place, new), np.insert(common, place, 0)
                at = stop
            if not len(row):
                continue
            symbol = text[anchor[row] + c]
            own = group[row]
            key = own << 8 | symbol
            fall = np.flatnonzero((key[1:] < key[:-1]) & (own[1:] == own[:-1]))
            same = np.r_[False, key[1:] == key[:-1]]
            if len(fall):
                # only buckets whose symbols are out of order are sorted anew
                loose = np.zeros(int(own[-1]) + 1, bool)
                loose[own[fall]] = True
                part = np.flatnonzero(loose[own])
                moved = part[np.argsort(key[part], kind="stable")]
                order = np.arange(len(row))
                order[part] = moved
                key = key[order]
                same = np.r_[False, key[1:] == key[:-1]]
                above = np.r_[0, order[:-1]]
                joined = common[order]
                far = np.flatnonzero(same & (order != above + 1))
                if len(far):  # rows that were apart: the least common prefix between them
                    edges = np.stack([above[far] + 1, order[far] + 1], 1).ravel()
                    joined[far] = np.minimum.reduceat(np.r_[common, 0], edges)[::2]
                row, common, symbol = row[order], joined, symbol[order]
            common = np.where(same, np.minimum(common + 1, 255), 0)
            blocks.append(bwt=symbol, row=row, common=common)
            columns.append(c)
            if c <= 0 and c % PRUNE == 0:
                # what has no symbols left goes, and what can't reach `length` by those it has
                kept = c > -before[row]
                if c < length - int(before.max()):
                    kept &= np.maximum(common, np.r_[common[1:], 0]) + c + before[row] >= length
                kept = np.flatnonzero(kept)
                if len(kept) < len(row):
                    common = np.minimum.reduceat(common[: kept[-1] + 1], np.r_[0, kept[:-1] + 1]) if len(kept) else common[:0]
                    row = row[kept]
        strings_, places = [], []
        for c, block in zip(columns, blocks.read()):
            hit = block["common"] >= length
            hit = hit | np.r_[hit[1:], False]
            own = block["row"][hit].astype(np.int64)
            own = own[c >= -before[own]]
            strings_.append(own)
            places.append(before[own] + c)
    finally:
        blocks.close()
    string, place = np.concatenate(strings_), np.concatenate(places)
    order = np.lexsort((place, string))
    return string[order], place[order]


def _exact(folder: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, CHUNK):
            copies = 1 + (rows.column("twins").chunk(0).value_lengths().to_numpy() > 0)
            row = np.repeat(np.arange(len(rows)), copies)
            packed = rows.column("packed").to_pylist()
            string, at = repeated_windows([packed[i] for i in row.tolist()], rows.column("spot").to_numpy()[row], rows.column("bucket").to_numpy()[row], LENGTH, folder)
            first = np.r_[True, row[1:] != row[:-1]][string]  # of the two of a row with twins one tells enough
            string, at = row[string[first]], at[first]
            if len(string):
                head = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (at[1:] != at[:-1] + 1)])
                yield with_twins(rows, string[head], at[head], np.diff(np.r_[head, len(at)]))

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, runs, digest = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            data = utf8(text.as_py())
            kept, at, n = [], 0, 0
            for start, end in sorted((s["start"], s["start"] + s["windows"] + LENGTH - 1) for s in spans or ()):
                if start > at or not n:
                    kept.append(data[at:start])
                    n += 1
                at = max(at, end)
            kept.append(data[at:])
            data_kept = b"".join(kept)
            total.append(len(data))
            removed.append(len(data) - len(data_kept))
            runs.append(n)
            digest.append(hashlib.sha256(data_kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    keyed = docs.select(*row_key(), "doc_id", "text")
    spans = removed_spans(keyed, RULE, _exact(openable(shared_dir(docs.sparkSession))))
    return keyed.repartition(*KEY).join(spans, KEY, "left").select("doc_id", "text", "spans").mapInArrow(_kept, SCHEMA)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT rid, c, substr(h, 2 * c + 1, 2 * 1223) AS p FROM (SELECT rid, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 1024)) AS c FROM texts)),
windows AS MATERIALIZED (SELECT rid, c + j AS k, md5_number(substr(p, 2 * j + 1, 400)) AS w FROM (SELECT rid, c, p, unnest(range(0, least(1024, len(p) // 2 - 199))) AS j FROM parts)),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT rid, k, CASE WHEN k - lag(k) OVER (PARTITION BY rid ORDER BY k) <= 200 THEN 0 ELSE 1 END AS fresh FROM windows SEMI JOIN often USING (w)),
runs AS (SELECT rid, min(k) AS b, max(k) + 200 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM hits) GROUP BY rid, run),
pieces AS (SELECT rid, b, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY b) AS before FROM runs),
cut AS (SELECT rid, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS kept FROM pieces JOIN texts USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM texts LEFT JOIN cut USING (rid)
"""
