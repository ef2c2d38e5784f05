"""Near duplicates by MinHash bands, odd sketches and full shingle sets.

A document's set is that of its distinct 2-word shingles (A-Z lower-cased, words without \\x20 and \\x09-\\x0D); with
fewer words the whole sequence is the only shingle. Equal sets (by a 128-bit digest) are one node, whose number is their smallest doc_id.
PERMUTATIONS minima of the set make BANDS bands of ROWS_IN_BAND; nodes that share a band are candidates. At the
threshold of 0.75 a pair shares no band with a chance of 1e-7. An odd sketch folds the minima into ODD_BITS parity
bits; the population count of two sketches' XOR estimates how many minima differ, and pairs above ODD_MOST (six
standard deviations beyond the threshold's mean) are dropped. All others are confirmed on their full sets, word for word.

Not all pairs of a band are made. First every node is held against the smallest node of each of its bands, which links
most groups. Then only pairs of one band in different components are left to be held against each other, as often as
that gives new links; pairs inside a component can't change it. So no link that joins two components is lost, and a
group of copies of any size costs a number of comparisons in proportion to it.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with nothing and kept; a row
without doc_id is linked with nothing, has no component and is kept; rows that share a doc_id are one document whose
links are those of all its texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.llm.common import KEY, joined, mixed, pieces, row_key, stored, table, tidy, utf8, word_hashes, word_spans
from weirlight.llm.graph import components

THRESHOLD = 75
BANDS, ROWS_IN_BAND = 44, 4
PERMUTATIONS = BANDS * ROWS_IN_BAND
ODD_BITS, ODD_MOST = 512, 140
WORDS_OF_SKETCH = ODD_BITS // 64
CHUNK = 1 << 19
SKETCH = [f"s{i}" for i in range(WORDS_OF_SKETCH)]
SCHEMA = "owner long, text_key long, doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, one text after the other; and their numbers."""
    buf, starts = joined([t.lower() for t in texts])
    b, e = word_spans(buf)
    h = word_hashes(buf, b, e)
    at = np.searchsorted(b, starts)
    n_words = np.diff(at)
    pair = mixed(h[:-1] * np.uint64(3) + mixed(h[1:])) if len(h) else h
    counts = np.where(n_words >= 2, n_words - 1, n_words)
    out = np.zeros(int(counts.sum()), np.uint64)
    sizes = np.zeros(len(texts), np.int64)
    fill = 0
    for i in range(len(texts)):
        k = int(n_words[i])
        if not k:
            continue
        own = pair[at[i] : at[i] + k - 1].copy() if k > 1 else mixed(h[at[i] : at[i] + 1] + np.uint64(1))
        own.sort()
        if k > 2:
            own = own[np.r_[True, own[1:] != own[:-1]]]
        sizes[i] = len(own)
        out[fill : fill + len(own)] = own
        fill += len(own)
    return out[:fill], sizes


def signatures(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minima of each non-empty set, (sets, PERMUTATIONS); its band hashes, (sets, BANDS); its odd sketch as bits packed into words."""
    rng = np.random.default_rng(20240229)
    a, b = rng.integers(0, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    minima = np.empty((PERMUTATIONS, len(sizes)), np.uint64)
    work = np.empty_like(x)
    for i in range(PERMUTATIONS):
        np.multiply(x, a[i], out=work)
        work += b[i]
        minima[i] = np.minimum.reduceat(work, starts)
    minima = mixed(minima)
    bands = np.zeros((BANDS, len(sizes)), np.uint64)
    for r in range(ROWS_IN_BAND):
        bands = mixed(bands * np.uint64(31) + minima[r::ROWS_IN_BAND][:BANDS])
    bands = mixed(bands + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])
    place = mixed(minima + np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(ODD_BITS)
    bit = np.bincount((place.astype(np.int64) + np.arange(len(sizes)) * ODD_BITS).ravel(), minlength=len(sizes) * ODD_BITS) & 1
    sketch = np.packbits(bit.astype(np.uint8).reshape(len(sizes), ODD_BITS), axis=1, bitorder="little").view("<i8")
    return minima.T, bands.T, sketch


def _signing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        texts = [utf8(t) for t in batch.column(3).to_pylist()]
        for b, e in pieces(texts, CHUNK):
            x, sizes = shingle_sets(texts[b:e])
            n, full = e - b, np.flatnonzero(sizes)
            h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, WORDS_OF_SKETCH), np.int64)
            if len(full):
                at = np.cumsum(sizes[full]) - sizes[full]
                h1[full], h2[full] = np.add.reduceat(mixed(x + np.uint64(17)), at), np.add.reduceat(mixed(x ^ np.uint64(0xABCDEF0123456789)), at)
                _, got, sketch[full] = signatures(x, sizes[full])
                bands[full] = got.view(np.int64)
            lists = pa.ListArray.from_arrays(np.cumsum(np.r_[0, np.where(sizes > 0, BANDS, 0)]).astype(np.int32), pa.array(bands[full].ravel()))
            columns = [batch.column(i).slice(b, n) for i in range(3)] + [pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(WORDS_OF_SKETCH)], names=names)


def shingles(text: str | None) -> frozenset[tuple[bytes, ...]]:
    """The set itself, as tuples of words."""
    words = utf8(text).lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)]) - {()}


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, x, y) with two texts those whose full sets reach the threshold; rows of one b mostly come together."""
    last, own = None, frozenset()
    for batch in batches:
        keep = []
        for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if b != last:
                last, own = b, shingles(y.as_py())
            other = shingles(x.as_py())
            both = len(own & other)
            keep.append(both * 100 >= (len(own) + len(other) - both) * THRESHOLD)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _near(a: str, b: str) -> Column:
    """Sizes and odd sketches of the two don't rule the threshold out."""
    differing = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (small * 100 >= large * THRESHOLD) & (differing <= ODD_MOST)


def _confirmed(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_key"), "node").select(F.col("node").alias("owner"), "text_key")
    texts = keyed.select(*KEY, "text").join(wanted, KEY).groupBy(*KEY).agg(F.first("text").alias("text"))
    texts = texts.select(F.col("owner").alias("node"), "text").repartition("node")
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(_reaching), "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: owner, text_key, doc_id, n_shingles, component_id, kept."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    keyed = docs.select(*row_key(), "doc_id", "text")
    signed = stored(keyed.mapInArrow(tidy(_signing), SCHEMA))
    linked = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # equal sets become one node; their smallest document stands for them
    nodes = stored(linked.groupBy("h1", "h2").agg(F.min(F.struct("owner", "text_key", "n_shingles", *SKETCH, "bands")).alias("x")).select("h1", "h2", F.col("x.owner").alias("node"), *[f"x.{c}" for c in ("text_key", "n_shingles", *SKETCH, "bands")]))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    stars = stored(banded.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").select("band", "center"))
    sketches = nodes.select("node", "n_shingles", *SKETCH)
    pairs = banded.join(stars, "band").where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    x, y = sketches.alias("x"), sketches.alias("y")
    pairs = stored(pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_near("x", "y")).select("a", "b"))
    # a doc_id that has several sets links their nodes; where doc_ids are unique there is none
    several = linked.groupBy("owner").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo < hi").select("owner")
    own = linked.select("owner", "h1", "h2").join(several, "owner", "left_semi").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).where("node != owner").select(F.col("owner").alias("a"), F.col("node").alias("b")).distinct()
    edges, checked = stored(_confirmed(pairs, nodes, keyed).unionByName(own)), pairs
    while True:
        labels = components(edges)
        # members of bands that still reach over more than one component
        members = banded.join(stars, "band").join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        open_ = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
        members = stored(members.join(open_, "band").join(sketches, "node"))
        x, y = members.alias("x"), members.alias("y")
        pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.component") < F.col("y.component")) & _near("x", "y")).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
        pairs = stored(pairs.join(checked, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        checked = checked.unionByName(pairs)
        more = stored(_confirmed(pairs, nodes, keyed))
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
    out = signed.select(*KEY, "doc_id", "n_shingles", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"], "left").join(labels, "node", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "node")))
    return out.select(*KEY, "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without those that a near duplicate stands for. Of rows that share a doc_id one stays; rows without doc_id stay."""
    chosen = near_groups(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("owner").agg(F.min("text_key").alias("text_key"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(), F.col("doc_id").isNull().alias("_unnamed"))
    kept = own.where(~F.col("_unnamed")).join(chosen, KEY, "left_semi").dropDuplicates(KEY)
    return kept.unionByName(own.where("_unnamed")).select("_row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) END AS shingles FROM texts),
flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = a
"""
