"""The lineage graph: nodes and edges from facts, degrees, neighbours and transitive reach.

Edges are a multigraph, one for each fact; degrees and reach use the simple graph of distinct (src, dst).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlight.functions.paths import canonical_path, dataset_name, is_temporary, looks_like_variable
from weirlight.schema import identity
from weirlight.sources.storage import stored


def job_urn(source_file: Column) -> Column:
    return F.concat(F.lit("job://"), source_file)


def resolved_urn(facts: DataFrame) -> Column:
    """The canonical name of a fact's dataset, from its resolved path where there is one."""
    return canonical_path(F.coalesce("resolved_path", "dataset_urn") if "resolved_path" in facts.columns else F.col("dataset_urn"))


def dataset_nodes(facts: DataFrame) -> DataFrame:
    """One node for each resolved URN that is neither temporary nor a bare variable.

    Facts are counted by their own names first, so that names are made canonical and judged once each; the judgement
    asks for that count, as the optimizer would move it below the aggregates, to all facts, otherwise.
    """
    named = [c for c in ("dataset_urn", "resolved_path", "dataset_type") if c in facts.columns]
    used = facts.where(F.col("fact_type").isin("READ", "WRITE") & F.col("dataset_urn").isNotNull() & (F.col("dataset_urn") != "")).groupBy(*named).agg(F.count("*").alias("_n"))
    used = used.withColumn("urn", F.when(F.col("_n") > 0, resolved_urn(facts)))
    used = used.where(~is_temporary(F.col("urn")) & ~looks_like_variable(F.col("urn")))
    nodes = used.groupBy("urn").agg(F.min("dataset_type").alias("kind"), F.sum("_n").alias("fact_count"))
    return nodes.select(F.lit("DATASET").alias("node_type"), "urn", dataset_name(F.col("urn")).alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind"), "fact_count")


def job_nodes(facts: DataFrame) -> DataFrame:
    files = facts.groupBy("source_file").agg(F.count("*").alias("fact_count"))
    return files.select(F.lit("JOB").alias("node_type"), job_urn(F.col("source_file")).alias("urn"), F.element_at(F.split("source_file", "/"), -1).alias("name"), F.lit("job").alias("kind"), "fact_count")


def package_of(source_file: Column) -> Column:
    """Folders of a file, joined by points; main for a file at the top."""
    folder = F.regexp_extract(source_file, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.lit("main")).otherwise(F.regexp_replace(F.regexp_replace(folder, "^/+", ""), "/+", "."))


def module_nodes(facts: DataFrame) -> DataFrame:
    modules = facts.groupBy(package_of(F.col("source_file")).alias("name")).agg(F.count("*").alias("fact_count"))
    return modules.select(F.lit("MODULE").alias("node_type"), F.concat(F.lit("module://"), "name").alias("urn"), "name", F.lit("module").alias("kind"), "fact_count")


def nodes_of(facts: DataFrame) -> DataFrame:
    return dataset_nodes(facts).unionByName(job_nodes(facts)).unionByName(module_nodes(facts)).withColumn("node_id", identity("urn"))


def read_write_edges(facts: DataFrame, datasets: DataFrame) -> DataFrame:
    """dataset -> job for a READ, job -> dataset for a WRITE; one edge for each fact."""
    known = datasets.select("urn")
    used = facts.where(F.col("fact_type").isin("READ", "WRITE")).withColumn("urn", resolved_urn(facts)).join(known, "urn")
    job, read = job_urn(F.col("source_file")), F.col("fact_type") == "READ"
    return used.select(F.when(read, F.col("urn")).otherwise(job).alias("src"), F.when(read, job).otherwise(F.col("urn")).alias("dst"), F.col("fact_type").alias("edge_type"), "confidence", "evidence")


def produces_edges(edges: DataFrame) -> DataFrame:
    """Each dataset that a job reads -> each that it writes, with the lesser confidence.

    Reads and writes are made distinct first, so a job gives as many rows as it has such pairs and no more.
    """
    reads = edges.where("edge_type = 'READ'").groupBy(F.col("dst").alias("job"), "src").agg(F.max("confidence").alias("cr"))
    writes = edges.where("edge_type = 'WRITE'").groupBy(F.col("src").alias("job"), "dst").agg(F.max("confidence").alias("cw"))
    pairs = reads.join(writes, "job")
    return pairs.select("src", "dst", F.lit("PRODUCES").alias("edge_type"), F.least("cr", "cw").alias("confidence"), F.concat(F.lit("via "), "job").alias("evidence"))


def depends_edges(facts: DataFrame, exact: bool = False) -> DataFrame:
    """job -> the job it invokes, found by its full path or, unless exact, by file name; evidence says where a name is ambiguous."""
    calls = facts.where((F.col("fact_type") == "JOB_DEPENDENCY") & F.col("dependency_job").isNotNull())
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    jobs = facts.select(F.col("source_file").alias("target")).distinct()
    same = F.col("dependency_job") == F.col("target")
    if exact:
        found = calls.join(jobs, same).withColumn("hits", F.lit(1))
    else:
        found = calls.withColumn("_n", last(F.col("dependency_job"))).join(jobs.withColumn("_n", last(F.col("target"))), "_n")
        found = found.where(same | F.concat(F.lit("/"), F.col("target")).endswith(F.concat(F.lit("/"), F.regexp_replace("dependency_job", r"^(\./|/|\$\{?\w+\}?/)+", ""))) | ~F.col("dependency_job").contains("/"))
        hits = found.groupBy("dependency_job").agg(F.countDistinct("target").alias("hits"))
        found = found.join(hits, "dependency_job")
    return found.select(job_urn(F.col("source_file")).alias("src"), job_urn(F.col("target")).alias("dst"), F.lit("DEPENDS_ON").alias("edge_type"), "confidence", F.when(F.col("hits") > 1, F.lit("ambiguous")).otherwise(F.col("evidence")).alias("evidence"))


def edges_of(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    direct = stored(read_write_edges(facts, nodes.where("node_type = 'DATASET'")))
    return direct.unionByName(produces_edges(direct)).unionByName(depends_edges(facts)).withColumn("edge_id", identity("src", "dst", "edge_type", "evidence"))


def simple(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def by_urn(nodes: DataFrame, urn: str) -> DataFrame:
    return nodes.where(F.col("urn") == urn)


def downstream(edges: DataFrame, urn: str) -> DataFrame:
    return edges.where(F.col("src") == urn).select(F.col("dst").alias("urn")).distinct()


def upstream(edges: DataFrame, urn: str) -> DataFrame:
    return edges.where(F.col("dst") == urn).select(F.col("src").alias("urn")).distinct()


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """All (src, dst) with a path from src to dst, without (x, x).

    Paths double in each round, so the rounds are the logarithm of the longest one; only pairs found in the last round
    are joined, each against all pairs. Every round is a written table.
    """
    known = stored(simple(edges).where("src != dst"))
    fresh = known
    for _ in range(most_rounds):
        ahead = fresh.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        behind = known.select("src", F.col("dst").alias("mid")).join(fresh.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        fresh = stored(ahead.unionByName(behind).where("src != dst").distinct().join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            break
        known = stored(known.unionByName(fresh))
    return known


def reachable(edges: DataFrame, urn: str, forward: bool = True, most_rounds: int = 32) -> DataFrame:
    """Nodes downstream (or upstream) of one node, without itself: a breadth-first search, so that only its own part of the graph is worked through.

    What lies deeper than most_rounds is found by doubling paths: those of 2**k links lead from all that is nearer than
    that to all that is nearer than twice that, until nothing is new.
    """
    links = simple(edges)
    links = links if forward else links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    links = stored(links)
    front = stored(links.where(F.col("src") == urn).select(F.col("dst").alias("urn")).where(F.col("urn") != urn).distinct())
    seen = front
    for _ in range(most_rounds):
        if front.isEmpty():
            break
        step = front.join(links, front["urn"] == links["src"]).select(F.col("dst").alias("urn")).where(F.col("urn") != urn).distinct()
        front = stored(step.join(seen, "urn", "left_anti"))
        seen = seen.unionByName(front)
    if front.isEmpty():
        return seen
    before = seen.join(front, "urn", "left_anti")
    jumps = stored(links.where(F.col("dst") != urn).join(before.select(F.col("urn").alias("dst")), "dst", "left_anti").select("src", "dst"))
    ahead = front
    while not front.isEmpty():
        step = ahead.join(jumps, ahead["urn"] == jumps["src"]).select(F.col("dst").alias("urn")).distinct()
        front = stored(step.join(ahead, "urn", "left_anti"))
        ahead = stored(ahead.unionByName(front))
        jumps = stored(jumps.withColumnRenamed("dst", "mid").join(jumps.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct())
    return before.unionByName(ahead)


def degrees(edges: DataFrame) -> DataFrame:
    """urn, fan_in, fan_out in the simple graph; nodes without edges have no row."""
    links = simple(edges)
    ends = links.select(F.col("src").alias("urn"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(links.select(F.col("dst").alias("urn"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("urn").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


#: Up to so many links, among so many nodes, reach is worked out in one task, whose sets take SMALL_NODES ** 2 / 8 bytes at most.
SMALL_LINKS, SMALL_NODES = 200_000, 20_000


def reach(edges: DataFrame) -> DataFrame:
    """urn, downstream_reach: the number of nodes that a path leads to from each node that has any.

    The same figures in one task for a small graph. In others nodes from which there is one way only are counted by their
    distance from its end, a row for each node; closure() makes the pairs of those that are left.
    """
    links = stored(simple(edges).where("src != dst"))
    number = links.count()
    if number <= SMALL_LINKS and links.select(F.explode(F.array("src", "dst"))).distinct().count() <= SMALL_NODES:
        kind = edges.schema["src"].dataType.simpleString()
        return links.coalesce(1).mapInPandas(_reached, f"urn {kind}, downstream_reach long")
    ended, others = _single_file(links)
    settled = ended.select(F.col("node").alias("urn"), F.col("far").alias("downstream_reach"))
    if others.isEmpty():
        return settled
    own = stored(links.join(others.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"))
    ends = own.join(ended, own["dst"] == ended["node"]).select("end").distinct()
    tails = links.join(ended.join(ends, "end", "left_semi").select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    pairs = closure(own.unionByName(tails)).join(others.select(F.col("node").alias("src")), "src", "left_semi")
    return settled.unionByName(pairs.groupBy(F.col("src").alias("urn")).agg(F.count("*").alias("downstream_reach")))


def _single_file(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the nodes that distinct links lead from, those with one way only: node, end, far (links to the end); and the others, whose ways lead to forks or go round: node.

    Each round doubles how far a node looks ahead. As long as an end lies beyond that, some node on the way to it is just
    as near as the round looks, and is settled there: what is left when a round settles none has no end.
    """
    ways = stored(links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("ahead"), (F.count("*") == 1).alias("single")))
    after = ways.select(F.col("node").alias("ahead"), F.col("single").alias("goes_on"))
    state = F.when(F.col("goes_on").isNull(), "end").when(F.col("goes_on"), "on").otherwise("fork").alias("state")
    rounds = [stored(ways.where("single").join(after, "ahead", "left").select("node", "ahead", F.lit(1).cast("long").alias("far"), state))]
    one = lambda parts: reduce(DataFrame.unionByName, parts)
    while not (on := rounds[-1].where("state = 'on'")).isEmpty() and not rounds[-1].where("state = 'end'").isEmpty():
        known = one([r.where("state != 'on'") for r in rounds[:-1]] + rounds[-1:])
        then = known.select(F.col("node").alias("ahead"), F.col("ahead").alias("then"), F.col("far").alias("more"), F.col("state").alias("then_state"))
        rounds.append(stored(on.join(then, "ahead").select("node", F.col("then").alias("ahead"), (F.col("far") + F.col("more")).alias("far"), F.col("then_state").alias("state"))))
    ended = one([r.where("state = 'end'") for r in rounds]).select("node", F.col("ahead").alias("end"), "far")
    return ended, one([ways.where("not single").select("node"), on.select("node"), *[r.where("state = 'fork'").select("node") for r in rounds]])


def _reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets of nodes as bits of an integer, grown until nothing is new; a node's set is taken up by those that lead to it."""
    links = [b for b in batches if len(b)]
    if not links:
        return
    rows = pd.concat(links)
    names = pd.unique(pd.concat([rows["src"], rows["dst"]]))
    number = {n: i for i, n in enumerate(names)}
    before: list[list[int]] = [[] for _ in names]
    sets = [0] * len(names)
    for a, b in zip(rows["src"].map(number), rows["dst"].map(number)):
        before[b].append(a)
        sets[a] |= 1 << b
    todo = set(range(len(names)))
    while todo:
        changed = set()
        for b in todo:
            for a in before[b]:
                if sets[a] | sets[b] != sets[a]:
                    sets[a] |= sets[b]
                    changed.add(a)
        todo = changed
    own = [(n, (s & ~(1 << i)).bit_count()) for i, (n, s) in enumerate(zip(names, sets))]
    yield pd.DataFrame([x for x in own if x[1]], columns=["urn", "downstream_reach"])


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type (null for all of a kind) and number."""
    n = nodes.rollup(F.col("node_type").alias("type")).count().select(F.lit("node").alias("kind"), "type", F.col("count").alias("number"))
    return n.unionByName(edges.rollup(F.col("edge_type").alias("type")).count().select(F.lit("edge").alias("kind"), "type", F.col("count").alias("number")))
