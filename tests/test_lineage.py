"""The whole way from files to metrics, on small repositories."""

import pytest
from pyspark.sql import functions as F

from weirlight.functions import detect, paths, resolve
from weirlight.operators import facts as fx
from weirlight.operators import lineage, reports, scoring
from weirlight.plans.scan import scan
from weirlight.sources import repository, sinks


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "jobs").mkdir()
    (root / ".git").mkdir()
    (root / ".git" / "x.py").write_text("spark.read.parquet('/hidden')\n")
    (root / "jobs" / "etl.py").write_text('spark.read.parquet("/data/raw/inbox").write.parquet("/data/clean/outbox")\n')
    (root / "run.sh").write_text("#!/bin/bash\nOUT=/data/final\nspark-submit jobs/etl.py\nhdfs dfs -cp /data/clean/outbox $OUT\n")
    (root / "bad.py").write_text("def (:\n")
    (root / "blob.py").write_bytes(b"\x00\x01")
    (root / "job").write_text("INSERT OVERWRITE TABLE m.t SELECT * FROM r.s")
    return root


@pytest.fixture(scope="module")
def scanned(spark, project):
    return scan(spark, str(project))


def test_crawl(spark, project):
    got = {r["relative_path"]: r["file_type"] for r in repository.crawl(spark, str(project)).collect()}
    assert got == {"jobs/etl.py": "pyspark", "run.sh": "shell", "bad.py": "pyspark", "job": "hive"}
    with pytest.raises(Exception):
        repository.crawl(spark, str(project / "missing")).count()


def test_graph(scanned):
    facts = {(r["fact_type"], r["resolved_path"] or r["dependency_job"]) for r in scanned.facts.where("fact_type in ('READ', 'WRITE', 'JOB_DEPENDENCY')").collect()}
    assert {("READ", "/data/raw/inbox"), ("WRITE", "/data/clean/outbox"), ("READ", "/data/clean/outbox"), ("WRITE", "/data/final"), ("READ", "hive://r.s"), ("WRITE", "hive://m.t")} <= facts
    assert scanned.facts.where("fact_type = 'ERROR'").count() == 1
    edges = {(r["src"], r["dst"], r["edge_type"]) for r in scanned.edges.collect()}
    assert ("hdfs:///data/raw/inbox", "job://jobs/etl.py", "READ") in edges
    assert ("hdfs:///data/raw/inbox", "hdfs:///data/clean/outbox", "PRODUCES") in edges
    assert ("job://run.sh", "job://jobs/etl.py", "DEPENDS_ON") in edges
    down = {r["urn"] for r in lineage.reachable(scanned.edges, "hdfs:///data/raw/inbox").collect()}
    assert down == {"job://jobs/etl.py", "hdfs:///data/clean/outbox", "job://run.sh", "hdfs:///data/final"}
    metric = {r["urn"]: r for r in scanned.metrics.collect()}
    assert metric["hdfs:///data/raw/inbox"]["downstream_reach"] == 4 and not metric["hdfs:///data/raw/inbox"]["is_shell_only"]


def test_one_job_by_hand(spark):
    """One read and one write at 0.75: three edges; the output has one writer and scores 0.75."""
    rows = [("READ", "/data/raw/inbox", "j.py", 1, 0.75), ("WRITE", "/data/clean/outbox", "j.py", 1, 0.75), ("READ", "/data/raw/inbox", "j.py", 1, 0.7)]
    facts = spark.createDataFrame([(*r, "hdfs", "AST", "", None) for r in rows], "fact_type string, dataset_urn string, source_file string, line_number int, confidence double, dataset_type string, extraction_method string, evidence string, dependency_job string")
    facts = fx.without_repeats(facts)
    nodes = lineage.nodes_of(facts)
    edges = lineage.edges_of(facts, nodes)
    assert (facts.count(), nodes.count(), edges.count()) == (2, 4, 3)
    got = {r["urn"]: (r["fan_in"], r["fan_out"], r["downstream_reach"], r["write_job_count"], r["avg_confidence"], r["priority_score"], r["migration_wave"]) for r in scoring.metrics(nodes, edges, vacuous_shell=True).collect()}
    assert got == {"hdfs:///data/raw/inbox": (0, 2, 2, 0, 0.5, 4.0, 3), "hdfs:///data/clean/outbox": (2, 0, 0, 1, 0.75, 0.75, 2)}


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y")], "src string, dst string")
    got = {(r[0], r[1]) for r in lineage.closure(edges).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "a"), ("b", "d"), ("c", "a"), ("c", "b"), ("c", "d"), ("x", "y")}


def test_reach_goes_on_beyond_its_rounds(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n20", "n3"), ("n9", "n0"), ("n4", "side"), ("x", "n5")], "src string, dst string")
    down = [r["urn"] for r in lineage.reachable(edges, "n0", most_rounds=2).collect()]
    assert sorted(down) == sorted([f"n{i}" for i in range(1, 21)] + ["side"])


def test_paths(spark):
    cases = {"/data//a/./b/../c/": "hdfs:///data/a/c", "s3://b//k/../j?x=1#f": "s3://b/j?x=1#f", "jdbc:oracle:thin:@h:1/x#T": "jdbc:oracle:thin:@h:1/x#T", "../up/x": "../up/x", "kafka://#{t}": "kafka://#{t}", "user@h:/p//q": "user@h:/p//q", "/": "/", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", paths.canonical_path(F.col("u")).alias("c"))
    assert {r[0]: r[1] for r in df.collect()} == cases


def test_resolution():
    names = {"a": "${b}/x", "b": "1", "c": "${c}"}
    assert resolve.resolve_text("/${a}/{b}/$b/${n:-d}", names) == ("/1/x/1/1/d", True)
    assert resolve.resolve_text("${c}${zz}", names) == ("${c}${zz}", False)
    assert resolve.resolve_text(None, names) == (None, True)


@pytest.mark.parametrize("small", [0, 10_000])
def test_resolution_follows_long_chains_and_shadowed_names(spark, monkeypatch, small):
    monkeypatch.setattr(resolve, "SMALL", small)
    chain = [("A", "${B}/a", "f1"), ("B", "${C}/b", "f2"), ("C", "${D}/c", "f3"), ("D", "${E}/d", "f4"), ("E", "${F}/e", "f5"), ("F", "/root", "f6")]
    shadowed = [("BASE", "${ROOT}/in", "job"), ("BASE", "/tmp", "z"), ("ROOT", "/data", "y")]
    symbols = spark.createDataFrame(chain + shadowed, "name string, value string, source_file string")
    facts = spark.createDataFrame([("${A}/x", "g"), ("${BASE}/x", "job"), ("${BASE}/x", "other"), ("${B}${LOST}", "g")], "dataset_urn string, source_file string")
    got = {(r["dataset_urn"], r["source_file"]): (r["resolved_path"], r["is_resolved"]) for r in resolve.resolved(facts, symbols).collect()}
    assert got == {("${A}/x", "g"): ("/root/e/d/c/b/a/x", True), ("${BASE}/x", "job"): ("/data/in/x", True), ("${BASE}/x", "other"): ("/tmp/x", True), ("${B}${LOST}", "g"): ("/root/e/d/c/b${LOST}", False)}


def test_sinks(spark, scanned, tmp_path):
    sinks.write_csv(scanned.nodes, scanned.edges, scanned.metrics, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv" / "nodes"), header=True).count() == scanned.nodes.count()
    sinks.write_json_document(scanned.nodes, scanned.edges, scanned.metrics, str(tmp_path / "g.json"))
    with pytest.raises(FileExistsError):
        sinks.write_json_document(scanned.nodes, scanned.edges, scanned.metrics, str(tmp_path / "g.json"))
    page = sinks.html_page(lineage.statistics(scanned.nodes, scanned.edges), scanned.metrics.withColumn("urn", F.concat(F.lit("<b>"), "urn")))
    assert "&lt;b&gt;" in page and "<b>" not in page
    sinks.write_sheets({"top": reports.top_priorities(scanned.metrics)}, str(tmp_path / "sheets"))
    fx.save_json(scanned.facts, str(tmp_path / "facts"))
    assert fx.load_json(spark, str(tmp_path / "facts")).count() == scanned.facts.count()


def test_settings(tmp_path):
    from weirlight.sources.settings import Settings, load_settings

    assert load_settings(base=str(tmp_path)) == Settings()
    (tmp_path / "weirlight.yaml").write_text("min_confidence: 0.5\nignore_globs: ['**/x/**']\n")
    assert load_settings(base=str(tmp_path)) == Settings(min_confidence=0.5, ignore_globs=("**/x/**",))
    (tmp_path / "bad.yaml").write_text("nope: 1\n")
    with pytest.raises(ValueError):
        load_settings(str(tmp_path / "bad.yaml"))


def test_code_of_file_types_compiles(spark):
    """The expression of a file's type is small enough for generated code; with fallback off a failure to compile raises."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = spark.createDataFrame([("a.py", "x"), ("b", "#!/bin/sh\nls"), ("c.json", '{"flowContents": 1}')], "path string, content string")
        assert [r[0] for r in rows.select(detect.file_type(F.col("path"), F.col("content"))).collect()] == ["pyspark", "shell", "nifi"]
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")


def test_reach_is_the_same_in_one_task_and_by_closure(spark, monkeypatch):
    import random

    r = random.Random(3)
    rows = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)] + [("a", "b"), ("b", "a"), ("self", "self")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    small = sorted(map(tuple, lineage.reach(edges).collect()))
    monkeypatch.setattr(lineage, "SMALL_LINKS", 0)
    assert small == sorted(map(tuple, lineage.reach(edges).collect())) and ("a", 1) in small and "self" not in dict(small)
    assert lineage.reach(edges.limit(0)).count() == 0
