"""Stages of the corpus pipeline, each against brute force on its own input, and the whole run."""

import itertools
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from weirlight.llm import decontaminate, toxicity
from weirlight.llm.common import BATCH, BATCH_UNSET, utf8

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, n_lines_removed long, owner string, score double, component_id long, _places int, length long, bucket long"


def extra(i, text, source):
    return (i, text, "xx", source, None if text is None else len(text), 3, 4, "clash", 0.5, 99, 7, 8, 9)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    words = ["".join(r.choice("aeioustnrlmdbp") for _ in range(r.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, prose(25)) for k in range(12)] + [(12, None), (13, "")]
    header = "subscribe to our newsletter now"
    rows, labels = [], []
    for i in range(420):
        text = prose(r.randint(20, 90))
        toxic = int(i % 7 == 0)
        if toxic:
            parts = text.split(" ")
            for _ in range(3):
                parts.insert(r.randrange(len(parts)), r.choice(["vileword", "nastything", "rottenish"]))
            text = " ".join(parts)
        labels.append((i, toxic))
        if i % 5 == 0:
            text = f"{header}\n{text}"
        if i % 11 == 3:
            text += " " + items[i % 12][1]
        rows.append(extra(i, text, f"site{i % 14}"))
    for k, i in enumerate(range(1000, 1040)):  # near copies of clean texts
        text = rows[(k % 10) * 7 + 1][1].split(" ")
        text[k % len(text)] = f"changed{k}"
        rows.append(extra(i, " ".join(text), f"site{k % 14}"))
    rows += [extra(2000, None, "site1"), extra(2001, "", None), extra(None, "no id at all here", "site2"), extra(None, "no id at all here", "site2"), extra(2002, header, "site3"), extra(2003, "word " * 30_000, "site4"), rows[5]]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), header, [t for _, t in items if t]


def bag(df):
    return Counter(map(tuple, df.collect()))


def checked(spark, tables):
    """Each stage's input and result, rows as a bag; read back as Parquet in between, as the driver does."""
    at, *_ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        out.write.mode("overwrite").parquet(f"{at}/stage{k}")
        out = spark.read.parquet(f"{at}/stage{k}")
        yield name, docs, out
        docs = out


def test_stages(spark, tables):
    at, header, items = tables
    seen = []
    for name, before, after in checked(spark, tables):
        seen.append(name)
        if name != "packing":
            assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
        rows, left = bag(before), bag(after)
        text = before.columns.index("text")
        if name == "toxicity":
            model = toxicity.trained(before, spark.read.parquet(f"{at}/labels.parquet"))
            assert left == Counter({r: n for r, n in rows.items() if model.scores([utf8(r[text])])[0] < toxicity.THRESHOLD})
            gone = [r for r in rows if r not in left]
            assert sum("vileword" in r[text] or "nastything" in r[text] or "rottenish" in r[text] for r in gone) >= 0.9 * len(gone) > 30
        elif name == "line_dedup":
            sites = {}
            for r in rows:
                for x in (r[text] or "").split("\n"):
                    if x.strip() and r[3]:
                        sites.setdefault(x.strip(), set()).add(r[3])
            want = Counter()
            for r, n in rows.items():
                own = list(r)
                lines = (r[text] or "").split("\n")
                kept = [x for x in lines if not (x.strip() and len(sites.get(x.strip(), ())) >= 10)]
                if r[text] is not None and kept != lines and any(x.strip() for x in kept):
                    own[text], own[4] = "\n".join(kept), len("\n".join(kept))
                want[tuple(own)] += n
            assert left == want and not any(header in (r[text] or "") and r[text] != header for r in left)
        elif name == "near_dedup":
            named = sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0])
            sets = {r[0]: set(zip((w := (r[text] or "").lower().split()), w[1:])) if len((r[text] or "").split()) > 1 else {tuple((r[text] or "").split())} - {()} for r in named}
            up = {i: i for i in sets}

            def root(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in itertools.combinations(sorted(sets), 2):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
            want = Counter(r for r in named if not sets[r[0]] or root(r[0]) == r[0]) + Counter({r: n for r, n in rows.items() if r[0] is None})
            assert left == want and len(left) < len(rows)
        elif name == "decontamination":
            plain = [decontaminate.normal(t) for t in items]
            want = Counter({r: n for r, n in rows.items() if not any(p in decontaminate.normal(r[text]) for p in plain)})
            assert left == want and len(want) < len(rows)  # the planted passages are exact ones
        else:
            from public_tokenizers import path
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
            pieces = after.toPandas()
            want = Counter()
            for r, n in rows.items():
                ids = np.array(tokenizer.encode(r[text] or "", add_special_tokens=False).ids + [1], "<u4")
                want[(-1 if r[0] is None else r[0], len(ids))] += n * len(ids)
                for p in pieces[(pieces.doc_id == r[0]) & (pieces.doc_tokens == len(ids))].itertuples():
                    assert zlib.crc32(ids[int(p.start) : int(p.start + p.length)].tobytes()) == p.ids_crc32
            got = pieces.assign(doc_id=pieces.doc_id.fillna(-1).astype(int)).groupby(["doc_id", "doc_tokens"]).length.sum()
            assert Counter({(int(k[0]), int(k[1])): int(v) for k, v in got.items()}) == want
            for _, s in pieces.groupby("sequence_id"):
                s = s.sort_values("offset")
                assert s.length.sum() <= 2048 and list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
            filled = pieces.groupby("sequence_id").length.sum()
            assert filled.sum() / (2048 * len(filled)) > 0.8
    assert seen == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_run_is_the_stages_in_turn(spark, tables):
    at, *_ = tables
    whole = corpus_pipeline.run(spark, at)
    *_, (_, _, last) = checked(spark, tables)
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    docs = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert set(own) <= set(whole.columns) and docs(whole) == docs(last)


def test_stages_of_an_empty_table(spark, tables, tmp_path):
    at, *_ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_send_texts_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    had = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, BATCH_UNSET)
        docs = spark.range(1, numPartitions=1).selectExpr("id as doc_id", "'x' as text", "'s' as source")
        long = spark.range(30, numPartitions=1).selectExpr("repeat(cast(id as string), 500000) as text")
        for _, stage in corpus_pipeline.STAGES[1:3]:
            stage(spark, docs, "")
        most = max(r[0] for r in long.mapInArrow(sizes, "n long").collect())
        assert most < 8 << 20
        spark.conf.set(BATCH, "1m")  # what the session has already stays
        corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.set(BATCH, had)


def test_workers_give_free_memory_back():
    """Buffers freed below one that is still in use stay with the process, unless they are given back."""
    code = """
import psutil, sys
import pyarrow as pa
from weirlight.llm.common import tidy

kept = []
def run(batches):
    for b in batches:
        held = [bytes(700) for _ in range(200_000)]
        kept.append(bytes(900))
        del held
        yield b

list(tidy(run)(iter([pa.record_batch([pa.array([1])], names=["x"])])))
print(psutil.Process().memory_info().rss >> 20)
list(run(iter([pa.record_batch([pa.array([1])], names=["x"])])))
print(psutil.Process().memory_info().rss >> 20)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(corpus_pipeline.__file__).parent)
    tidied, as_it_was = map(int, said.stdout.split())
    assert tidied < as_it_was - 60
