"""Lineage graphs: nodes, edges, impact, access classes and reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept


def nodes(rows: DataFrame, *kinds: tuple[str, str]) -> DataFrame:
    """Distinct (node_id, node_type, name) of the columns given as (column, type)."""
    each = F.array(*[F.struct(F.concat(F.lit(t + "_"), F.col(c).cast("string")).alias("node_id"), F.lit(t).alias("node_type"), F.col(c).cast("string").alias("name")) for c, t in kinds])
    return rows.select(F.explode(each).alias("n")).select("n.*").where("name is not null").distinct()


def edges(rows: DataFrame, source: tuple[str, str], target: tuple[str, str], kind: Column) -> DataFrame:
    """Distinct (source_node, target_node, relationship) with how often each occurs."""
    def node(c: tuple[str, str]) -> Column:
        return F.concat(F.lit(c[1] + "_"), F.col(c[0]).cast("string"))

    return rows.select(node(source).alias("source_node"), node(target).alias("target_node"), kind.alias("relationship")).groupBy("source_node", "target_node", "relationship").agg(F.count("*").alias("weight"))


def inferred_nodes(edges_: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Nodes that edges name and that have no row of their own."""
    named = edges_.select(F.explode(F.array("source_node", "target_node")).alias("node_id")).distinct()
    return named.join(nodes_.select("node_id"), "node_id", "left_anti")


def degrees(edges_: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct neighbours of each node in either direction."""
    out = edges_.groupBy(F.col(source).alias("node")).agg(F.count_distinct(target).alias("n_out"))
    into = edges_.groupBy(F.col(target).alias("node")).agg(F.count_distinct(source).alias("n_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def one_hop(edges_: DataFrame, source: str, target: str, asked: Column) -> DataFrame:
    """(component, neighbour, side) for the asked components: side is upstream or downstream; asked is a test on a column named component."""
    both = F.array(F.struct(F.col(target).alias("component"), F.col(source).alias("neighbour"), F.lit("upstream").alias("side")), F.struct(F.col(source).alias("component"), F.col(target).alias("neighbour"), F.lit("downstream").alias("side")))
    return edges_.select(F.explode(both).alias("h")).select("h.*").where(asked).distinct()


def impacts(calls: DataFrame, copies: DataFrame, asked: Column) -> DataFrame:
    """Who is hit by a change: callers of a program (high), programs that share a copybook with it (medium)."""
    called = calls.select(F.col("called").alias("source"), F.col("calling").alias("dependent"), F.lit("high").alias("impact_level"), F.lit("interface_change_required").alias("change"))
    mine = copies.select(F.col("program").alias("source"), "copybook").distinct()
    shared = mine.join(copies.select(F.col("program").alias("dependent"), "copybook").distinct(), "copybook").where("source <> dependent")
    shared = shared.select("source", "dependent", F.lit("medium").alias("impact_level"), F.lit("data_structure_dependency").alias("change"))
    return called.where(asked).union(shared.where(asked)).distinct()


def impact_of(relation: Column) -> Column:
    return F.when(relation.isin("CALL", "LINK"), "HIGH").when(F.startswith(relation, F.lit("FILE_")), "MEDIUM").otherwise("LOW")


def data_flow(rows: DataFrame, program: str, file: str, kind: Column, reads: Column) -> DataFrame:
    """Edges in the direction that data go: file to program for reads, program to file otherwise."""
    return rows.select(F.when(reads, F.col(file).cast("string")).otherwise(F.col(program).cast("string")).alias("source"), F.when(reads, F.col(program).cast("string")).otherwise(F.col(file).cast("string")).alias("target"), kind.alias("flow")).distinct()


def access_class(access: Column, mode: Column) -> Column:
    """Whether an access creates, reads, updates or deletes; by type, then by mode, else it reads."""
    a, m = F.upper(F.coalesce(access, F.lit(""))), F.upper(F.coalesce(mode, F.lit("")))
    return (F.when(a.isin("CREATE", "WRITE", "NEW"), "creator").when(a.isin("UPDATE", "REWRITE"), "updater").when(a == "DELETE", "deleter").when(a == "READ", "reader")
            .when(m.isin("OUTPUT", "EXTEND"), "creator").when(m == "I-O", "updater").otherwise("reader"))


def within(edges_: DataFrame, starts: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops): what is reached from each start, by the shortest way, in at most so many steps; None: until nothing is new.

    Each front is written and holds only what was not reached before, so cycles end and a hop costs one join of the front.
    """
    links = kept(edges_.select(F.col(source).alias("node"), F.col(target).alias("next")).distinct())
    front = kept(starts.select("start", F.col("start").alias("node")).distinct())
    known, hop = front.withColumn("hops", F.lit(0)), 0
    while not front.isEmpty() and (max_hops is None or hop < max_hops):
        hop += 1
        front = kept(front.join(links, "node").select("start", F.col("next").alias("node")).distinct().join(known, ["start", "node"], "left_anti"))
        known = known.unionByName(front.withColumn("hops", F.lit(hop)))
    return known.where("hops > 0")


def references(chunks: DataFrame, text: str, name: str) -> DataFrame:
    """Chunks that name a field as a whole word, whatever the case."""
    pattern = "(?i)(^|[^A-Za-z0-9_-])" + "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in name) + "($|[^A-Za-z0-9_-])"
    return chunks.where(F.contains(F.upper(F.col(text)), F.lit(name.upper())) & F.col(text).rlike(pattern))


#: Words that show what is done to a field, in the order they are looked for.
STEPS = (("definition", ("PIC ", "PICTURE")), ("update", ("WRITE", "UPDATE", "MOVE TO")), ("read", ("READ", "SELECT")), ("validation", ("IF ", "WHEN", "CHECK")))


def step_of(text: Column) -> Column:
    from ..functions.scoring import first_match

    return first_match(text, STEPS, "reference")


def subgraph(edges_: DataFrame, field: str, hops: int = 2) -> DataFrame:
    """The edges (source_node, target_node, relationship) around a node, within so many steps in either direction."""
    both = edges_.select(F.col("source_node").alias("a"), F.col("target_node").alias("b")).union(edges_.select("target_node", "source_node"))
    start = edges_.sparkSession.createDataFrame([(field,)], "start string")
    near = within(both, start, "a", "b", hops).select("node").union(start).distinct()
    inside = edges_.join(near.withColumnRenamed("node", "source_node"), "source_node", "left_semi")
    return inside.join(near.withColumnRenamed("node", "target_node"), "target_node", "left_semi").select("source_node", "target_node", "relationship")


def usage_patterns(uses: DataFrame, field: str, program: str, use: Column) -> DataFrame:
    """For each field: reads, writes and transformations, its programs, and whether it is shared, written in many places or read alone."""
    kind = use
    out = uses.groupBy(field).agg(*[F.count_if(kind == k).alias(f"n_{k.lower()}") for k in ("READ", "WRITE", "TRANSFORM")], F.count_distinct(program).alias("n_programs"), F.count_distinct(F.when(kind == "WRITE", F.col(program))).alias("n_writers"))
    pattern = F.when(F.col("n_writers") > 1, "multiple_writers").when((F.col("n_write") == 0) & (F.col("n_transform") == 0), "read_only").when(F.col("n_programs") > 1, "shared").otherwise("private")
    return out.withColumn("pattern", pattern)


def journey(uses: DataFrame, file: str, program: str, order: list[str], access: Column) -> DataFrame:
    """The steps of each file in order, equal neighbours once: where it is created, updated, read and deleted, and by whom first and last."""
    rows = uses.select(F.col(file), F.struct(*order, F.col(program).cast("string").alias("_program"), access_class(access, F.lit(None).cast("string")).alias("_class")).alias("_s"))
    before = F.lag("_s._class").over(Window.partitionBy(file).orderBy("_s"))
    steps = rows.withColumn("_new", F.coalesce(before != F.col("_s._class"), F.lit(True))).groupBy(file).agg(
        F.count("*").cast("int").alias("n_steps"), F.min("_s")["_program"].alias("first_program"), F.max("_s")["_program"].alias("last_program"), F.sort_array(F.collect_list(F.when(F.col("_new"), F.col("_s")))).alias("c"))
    return steps.select(file, "n_steps", "first_program", "last_program", F.array_join(F.col("c._class"), ">").alias("journey"))


def impact_chain(edges_: DataFrame, source: str, target: str) -> DataFrame:
    """For each component all that depends on it, however far, with a risk by how much that is."""
    starts = edges_.select(F.col(source).alias("start")).distinct()
    reached = within(edges_, starts, source, target).where("start <> node")
    out = reached.groupBy("start").agg(F.count("*").alias("n_dependents"), F.max("hops").alias("depth"))
    return out.withColumn("risk", F.when(F.col("n_dependents") > 10, "HIGH").when(F.col("n_dependents") > 3, "MEDIUM").otherwise("LOW"))
