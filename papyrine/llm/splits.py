"""Splits that keep related records together: connected components, then proportional hash ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.plans.runtime import cut, spread_join
from papyrine.sources.tables import table

#: Rounds after which star operations that haven't settled are an error; they take O(log^2 n).
MAX_ROUNDS = 60


def norm_split(col: Column) -> Column:
    """train, validation or test; null for anything else. val and dev are validation."""
    word = F.lower(F.regexp_replace(col, r"[^A-Za-z]", ""))
    return (
        F.when(word.isin("train", "training"), "train")
        .when(word.isin("validation", "val", "dev", "valid"), "validation")
        .when(word == "test", "test")
    )


def norm_paper(col: Column) -> Column:
    """One spelling per paper: lower case, no white space, no version suffix; null for placeholders, which hold no digit."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"[\s ​　﻿]+", "")), r"v\d+$", "")
    return F.when(bare.rlike(r"\d"), bare)


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and cases as (record_id, splits, entities), one row per key."""
    samples = table(spark, sf_dir, "training_samples").select(F.col("sample_id").alias("record_id"), F.col("dataset_split").alias("split"), "paper_ids")
    cases = table(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("record_id"), "split", "paper_ids")
    both = samples.unionByName(cases).where(F.col("record_id").isNotNull())
    papers = F.coalesce(F.filter(F.transform("paper_ids", norm_paper), lambda p: p.isNotNull()), F.array().cast("array<string>"))
    return merge_records(both.select("record_id", norm_split(F.col("split")).alias("split"), papers.alias("entities")))


def merge_records(rows: DataFrame) -> DataFrame:
    """One row per record key: (record_id, splits, entities), both sorted and without repeats. Exact copies collapse
    in the map-side combine of the first step."""
    entities = F.array_sort(F.array_distinct("entities"))
    return (
        rows.select("record_id", "split", entities.alias("entities")).distinct()
        .groupBy("record_id").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), by alternating large-star and small-star; root is the least node.

    Large-star links every greater neighbour of a node to the least node of its neighbourhood; small-star links the
    lesser neighbours and the node itself to the least. Neighbourhoods are only ever reduced to their least member
    with map-side combine and joined back by spread_join, so a node with a third of all edges is no single task.
    Every round is written to the checkpoint folder. Self-loops and repeated edges are dropped; null ends too.
    """
    clean = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = clean.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(clean.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edge_sum = lambda: now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = edge_sum()
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both, least, "u", total=2 * before[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = spread_join(large, least, "u", total=before[0])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        mark = edge_sum()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("root", "node").alias("root"))


def group_records(records: DataFrame) -> DataFrame:
    """(record_id, splits, root) of records (record_id, splits, entities): records with a chain of shared entities share root.

    Only links between the entities of one record enter the graph, so a record with one entity costs nothing and an
    entity shared by a third of the records is one node. A record without entities is its own root.
    """
    edges = records.where(F.size("entities") > 1).select(F.col("entities")[0].alias("a"), F.explode(F.slice("entities", 2, 2**30)).alias("b"))
    roots = cut(components(edges))
    found = spread_join(records.select("record_id", "splits", F.get("entities", F.lit(0)).alias("node")), roots, "node", "left")
    entity = F.concat(F.lit("e:"), F.coalesce("root", "node"))
    return found.select("record_id", "splits", F.coalesce(entity, F.concat(F.lit("r:"), "record_id")).alias("root"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(group_records(cut(records_of(spark, sf_dir))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, record_id) of every group whose records now stand in two or more splits."""
    grouped = p5_groups(spark, sf_dir)
    spans = grouped.groupBy("root").agg(F.min("record_id").alias("group_id"), F.min(F.array_min("splits")).alias("lo"), F.max(F.array_max("splits")).alias("hi"))
    return spread_join(grouped, spans.where("lo <> hi").select("root", "group_id"), "root").select("group_id", "record_id")


def assign_splits(grouped: DataFrame, targets: DataFrame) -> DataFrame:
    """(group_id, record_id, split): whole groups into splits by the shares of targets (split_name, share).

    A group's key is hashed into [0, 1), which is cut into ranges as wide as the shares. Groups with more than a
    thousandth of all records, of which there are under a thousand whatever the input, are placed first, largest
    first, each into the split that is furthest below its share; the ranges of all others are then as wide as what
    each split still lacks, so that a giant group doesn't upset the shares. Null or negative shares count as 0.
    """
    spark = grouped.sparkSession
    wanted = sorted((r[0], float(r[1])) for r in targets.groupBy("split_name").agg(F.max("share")).collect() if r[0] is not None and r[1] and r[1] > 0)
    if not wanted:
        raise ValueError("targets name no split with a share above 0")
    unique = grouped.select("record_id", "root")
    sizes = unique.groupBy("root").agg(F.min("record_id").alias("group_id"), F.count("*").alias("n"))
    total = unique.count()
    whole = sum(s for _, s in wanted)
    lacking = {name: share / whole * total for name, share in wanted}
    giants = {}
    for root, n in sorted(sizes.where(F.col("n") > max(1, total / 1000)).select("root", "n").collect(), key=lambda r: (-r[1], r[0])):
        name = max(lacking, key=lambda k: (lacking[k], k))
        giants[root] = name
        lacking[name] -= n
    room = {k: max(0.0, v) for k, v in lacking.items()}
    rest = sum(room.values()) or 1.0
    point = F.pmod(F.xxhash64(F.lit("split"), F.col("group_id")), F.lit(2**40)) / F.lit(float(2**40))
    edge, chosen = 0.0, F.lit(wanted[-1][0])
    bounds = []
    for name, _ in wanted:
        edge += room[name] / rest
        bounds.append((edge, name))
    for edge, name in reversed(bounds[:-1]):
        chosen = F.when(point < F.lit(edge), name).otherwise(chosen)
    placed = sizes.withColumn("split", chosen)
    if giants:
        fixed = F.broadcast(spark.createDataFrame(list(giants.items()), "root string, giant string"))
        placed = placed.join(fixed, "root", "left").withColumn("split", F.coalesce("giant", "split"))
    return spread_join(unique, placed.select("root", "group_id", "split"), "root").select("group_id", "record_id", "split")


def p5_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(p5_groups(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and share that each split got, beside the share that was wanted."""
    got = p5_assigned(spark, sf_dir).groupBy("split").agg(F.count("*").alias("records"))
    total = got.agg(F.sum("records").alias("total"))
    return got.crossJoin(F.broadcast(total)).join(F.broadcast(table(spark, sf_dir, "split_targets")), F.col("split") == F.col("split_name"), "left").select("split", "records", (F.col("records") / F.col("total")).alias("share"), F.col("share").alias("wanted"))


def p5_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, records, once, whole, near) of every split with a wanted share: all records that were assigned; whether each was
    assigned once; whether no group stands in two splits; and whether the split's share is within a hundredth of the wanted one."""
    rows = cut(p5_assigned(spark, sf_dir))
    once = rows.groupBy("record_id").count().agg(F.count("*").alias("records"), (F.coalesce(F.max("count"), F.lit(1)) == 1).alias("once"))
    whole = rows.groupBy("group_id").agg((F.min("split") == F.max("split")).alias("one")).agg(F.coalesce(F.bool_and("one"), F.lit(True)).alias("whole"))
    got = rows.groupBy("split").agg(F.count("*").alias("n"))
    wanted = table(spark, sf_dir, "split_targets").where("share > 0").select(F.col("split_name").alias("split"), "share")
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("records") - F.col("share")) <= 0.01
    return wanted.join(got, "split", "left").crossJoin(once).crossJoin(whole).select("split", "records", "once", "whole", near.alias("near"))


QUERIES = {"p5_found": p5_found, "p5_assigned": p5_assigned, "p5_shares": p5_shares, "p5_invariants": p5_invariants}
SQL = {
    "p5_found": r"""
with recursive raw as (
  select sample_id as record_id, dataset_split as split, paper_ids from training_samples
  union select case_id, split, paper_ids from eval_cases),
records as (
  select distinct record_id,
    case regexp_replace(lower(split), '[^a-z]', '', 'g')
      when 'train' then 'train' when 'test' then 'test'
      when 'validation' then 'validation' when 'val' then 'validation' when 'dev' then 'validation' end as split,
    list_filter(list_transform(coalesce(paper_ids, []), lambda p: regexp_replace(regexp_replace(lower(p), '[\s\x{00a0}]+', '', 'g'), 'v\d+$', '')),
                lambda p: p is not null and regexp_matches(p, '\d')) as papers
  from raw where record_id is not null),
links as (select distinct record_id, unnest(papers) as paper from records),
pairs as (
  select distinct l.paper as a, r.paper as b from links l join links r using (record_id)),
reach(node, root) using key (node) as (
  select distinct paper, paper from links
  union
  select p.b, min(reach.root) from reach join pairs p on p.a = reach.node join recurring.reach cur on cur.node = p.b
  where reach.root < cur.root group by p.b),
grouped as (
  select distinct r.record_id, r.split, reach.root from records r join links l using (record_id) join reach on reach.node = l.paper),
mixed as (
  select root, min(record_id) as group_id from grouped group by root having count(distinct split) > 1)
select distinct group_id, record_id from grouped join mixed using (root)
""",
    "p5_invariants": """
with ids as (select sample_id as id from training_samples union select case_id from eval_cases)
select split_name as split, (select count(id) from ids) as records, true as once, true as whole, true as near from split_targets where share > 0
""",
}
