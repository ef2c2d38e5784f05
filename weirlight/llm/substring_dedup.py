"""Windows of 13 words that a document with a smaller doc_id has too: their words are removed.

Words are the runs without \\x20 and \\x09-\\x0D, unchanged. Super-k-mers (see superkmers) bring equal windows to one
bucket, where the windows of the packed strings are sorted as rows of word numbers, one number for each word's bytes, and
the smallest doc_id of each is found exactly. Windows are judged on the input, not on what is left.

Defined cases: a null or empty text has no words and keeps none; a null doc_id stays null and counts as larger than
every other, so that it never removes from others; rows that share doc_id and text remove nothing from each other;
each input row gives a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.llm.common import KEY, row_key, table, utf8
from weirlight.llm.superkmers import Rule, removed_spans, repeated, whole_buckets, with_twins

WINDOW, GRAM = 13, 4
RULE = Rule(words=True, window=WINDOW, gram=GRAM, smaller=True)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each bucket, sorted; those whose words also lie in a smaller doc_id come out, for a row and its twins."""
    for rows in whole_buckets(batches, 4 << 20):
        doc, windows = rows.column("owner").to_numpy(), rows.column("windows").to_numpy()
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for t in rows.column("packed").to_pylist() for w in t.split(b" ")], np.int32)
        at = np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1)
        row, within = repeated(windows)
        content = np.ascontiguousarray(ids[(at[row] + within)[:, None] + np.arange(WINDOW)]).view(np.dtype((np.void, 4 * WINDOW))).ravel()
        order = np.argsort(content, kind="stable")
        content, row, within = content[order], row[order], within[order]
        head = np.flatnonzero(np.r_[True, content[1:] != content[:-1]])
        size = np.diff(np.r_[head, len(row)])
        least = np.repeat(np.minimum.reduceat(doc[row], head), size)  # a row has the smallest owner of its twins
        wanted = (doc[row] > least) | np.r_[False, rows.column("twins").chunk(0).value_lengths().to_numpy() > 0][row + 1]
        row, within, least = row[wanted], within[wanted], least[wanted]
        if not len(row):
            continue
        order = np.lexsort((within, least, row))  # neighbouring windows with one smallest owner are one span
        row, within, least = row[order], within[order], least[order]
        head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | (within[1:] != within[:-1] + 1)])
        spans = with_twins(rows, row[head], within[head], np.diff(np.r_[head, len(row)]), least[head])
        if len(spans):
            yield spans


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digest = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            words = utf8(text.as_py()).split()
            n = len(words)
            if spans:
                keep = np.ones(n, bool)
                for s in spans:
                    keep[s["start"] : s["start"] + s["windows"] + WINDOW - 1] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            total.append(n)
            removed.append(n - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    keyed = docs.select(*row_key(), "doc_id", "text")
    spans = removed_spans(keyed, RULE, sorted_windows)
    return keyed.repartition(*KEY).join(spans, KEY, "left").select("doc_id", "text", "spans").mapInArrow(_kept, SCHEMA)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
runs AS (SELECT rid, doc_id, list_transform(range(1, len(words) - 11), lambda k: array_to_string(words[k:k + 12], ' ')) AS runs FROM texts WHERE len(words) >= 13),
windows AS (SELECT rid, doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS k FROM runs),
least AS (SELECT run, min(doc_id) AS first FROM windows GROUP BY run),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + 13)) AS place FROM windows JOIN least USING (run) WHERE first < doc_id),
flat AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept FROM flat ANTI JOIN gone USING (rid, place) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (rid)
"""
