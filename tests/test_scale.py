"""Steps whose memory or time has to stay bounded on large tables, and their results against brute force."""

import math
import random
import re

from pyspark.sql import functions as F

from weirlight.functions import detect
from weirlight.operators import facts as fx
from weirlight.operators import lineage, rules
from weirlight.sources import repository

FACT = "fact_type string, dataset_urn string, source_file string, line_number int, confidence double, extraction_method string, evidence string, has_placeholders boolean"


def test_repeats_are_combined_before_anything_is_sorted(spark):
    """The aggregate next to the input keeps one row for each content, not all rows that a task reads."""
    facts = spark.range(1000).select(F.lit("READ").alias("fact_type"), (F.col("id") % 3).cast("string").alias("dataset_urn"), F.lit("f").alias("source_file"), F.lit(1).alias("line_number"), F.rand(1).alias("confidence"), F.lit("AST").alias("extraction_method"), F.lit("").alias("evidence"))
    steps = re.findall(r"(SortAggregate|HashAggregate)\(", fx.without_repeats(facts)._jdf.queryExecution().sparkPlan().toString())
    assert steps[-1] == "HashAggregate"
    once = facts.groupBy("dataset_urn").agg(F.max("confidence"))
    assert sorted(map(tuple, fx.without_repeats(facts).select("dataset_urn", "confidence").collect())) == sorted(map(tuple, once.collect()))


def test_repeats_against_brute_force(spark):
    """An unknown confidence comes first and NaN last; ties go to method, evidence and what is left."""
    r = random.Random(7)
    pick = lambda *x: r.choice(x)
    rows = [(pick("READ", "WRITE"), pick("a", "b", None), pick("f", "g"), pick(1, None), pick(0.0, -0.0, 0.5, 0.9, None, math.nan), pick("AST", "REGEX", None), pick("", "e", None), pick(True, False, None)) for _ in range(400)]
    low = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731  # null is least
    minus = lambda c: (c is not None, math.inf if c is not None and math.isnan(c) else 0 if c is None else -c)
    best: dict = {}
    for x in rows:
        rank = (minus(x[4]), low(x[5]) if x[5] else (False, ""), low(x[6]) if x[6] is not None else (False, ""), low(x[7]))
        if x[:4] not in best or rank < best[x[:4]][0]:
            best[x[:4]] = (rank, x)
    got = fx.without_repeats(spark.createDataFrame(rows, FACT)).collect()
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(repr((*k, x[4] + 0.0 if x[4] is not None else None, *x[5:])) for k, (_, x) in best.items())


def test_names_are_judged_once_each(spark):
    """The filter over canonical names stays above the aggregates, where it sees each name once and not every fact."""
    rows = [("READ", "/data//a", "f", 1, 0.5, "AST", "", True), ("READ", "/data/a/", "g", 1, 0.5, "AST", "", True), ("WRITE", "/tmp/x", "f", 2, 0.5, "AST", "", True), ("WRITE", "/data/a", "f", 2, 0.5, "AST", "", True), ("READ", "inputFrame", "f", 3, 0.5, "AST", "", True), ("READ", None, "f", 4, 0.5, "AST", "", True)]
    facts = spark.createDataFrame([(*r, k) for r, k in zip(rows, ("s3", "hdfs", "x", None, "x", "x"))], FACT + ", dataset_type string")
    nodes = lineage.dataset_nodes(fx.without_repeats(facts))
    assert list(map(tuple, nodes.collect())) == [("DATASET", "hdfs:///data/a", "a", "hdfs", 3)]
    steps = nodes._jdf.queryExecution().optimizedPlan().toString().split("\n")
    last = max(i for i, x in enumerate(steps) if "/staging/" in x)
    assert sum("Aggregate" in x for x in steps[last:]) == 3  # by name, and two of without_repeats


def test_reach_of_single_file_makes_no_pairs(spark, monkeypatch):
    """Chains and trees that lead to one end are counted by distance."""
    monkeypatch.setattr(lineage, "SMALL_LINKS", 0)
    monkeypatch.setattr(lineage, "closure", None)
    links = [(i, i + 1) for i in range(77)] + [(200, 40), (201, 200), (300, 301), (301, 301), (300, 301)]
    want = {**{i: 77 - i for i in range(77)}, 200: 38, 201: 39, 300: 1}
    assert dict(map(tuple, lineage.reach(spark.createDataFrame(links, "src long, dst long")).collect())) == want


def test_reach_of_forks_rounds_and_chains_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SMALL_LINKS", 0)
    for seed in range(4):
        r = random.Random(seed)
        links = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range((25, 40, 60, 45)[seed])]
        links += [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("t0", "t1"), ("t1", "c0"), ("f", "p0"), ("f", "q0"), ("p0", "p1"), ("p1", "z"), ("q0", "q1"), ("q1", "p1"), ("w", "v"), ("v", "f"), ("z", "z")]
        after: dict = {}
        for a, b in links:
            after.setdefault(a, set()).add(b)
        want = {}
        for a in after:
            seen, todo = set(), [a]
            while todo:
                new = after.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            if seen - {a}:
                want[a] = len(seen - {a})
        got = lineage.reach(spark.createDataFrame(links, "src string, dst string")).collect()
        assert dict(map(tuple, got)) == want and len(got) == len(want)


def test_files_are_looked_through_only_where_that_decides(spark, monkeypatch):
    monkeypatch.setattr(detect, "type_by_content", lambda c: F.raise_error(F.concat(F.lit("looked through "), c)).cast("string"))
    files = spark.createDataFrame([("a.py", "x"), ("b", "#!/bin/sh\nls"), ("c.hql", "#!/usr/bin/scala")], "path string, content string").repartition(1)
    assert [r[0] for r in files.select(detect.file_type(F.col("path"), F.col("content"))).collect()] == ["pyspark", "shell", "hive"]


def test_listed_files_are_typed_before_the_sort(spark):
    """The sort's sample reads written rows, not contents."""
    files = spark.createDataFrame([("b.sh", "ls"), ("a", "select 1 from t"), ("a.sh", "ls")], "relative_path string, content string").repartition(2)
    got = repository.listed(files.withColumn("file_type", detect.file_type(F.col("relative_path"), F.col("content"))))
    assert [tuple(r) for r in got.collect()] == [("hive", "a"), ("shell", "a.sh"), ("shell", "b.sh")]
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_handed_on_in_small_frames(spark):
    """A file of many matches; the plan's function gives them bit by bit, in order and with their lines."""
    n = 3 * 4_000
    text = "\n".join(f"hdfs dfs -get /a{i} /b${{c}}\n" for i in range(n // 2))
    files = spark.createDataFrame([("p.sh", "shell", text), ("q.sh", "shell", None), ("r.sh", "shell", "ls")], "path string, file_type string, content string")
    seen = []

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            seen.extend(run(iter([files.toPandas()])))

    rules.matches(Files(), rules.default_rules(spark))
    assert max(map(len, seen)) <= 4_000 and sum(map(len, seen)) == n
    got = rules.matches(files, rules.default_rules(spark)).collect()
    assert [(r["line"], r["rule_id"]) for r in got] == [(2 * i + 1, k) for i in range(n // 2) for k in ("sh_get", "property")]
    assert all(text[r["start"] : r["end"]] == r["match_text"] for r in got)
