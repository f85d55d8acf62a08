"""Joins that answer who shares, lacks or contains what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sharers(uses: DataFrame, component: str, target: str, asked: Column) -> DataFrame:
    """(a, b): b uses a target that a uses, for the asked components a."""
    uses = uses.select(component, target).distinct()
    left = uses.where(asked).select(F.col(component).alias("a"), target)
    return left.join(uses.select(F.col(component).alias("b"), target), target).where("a <> b").select("a", "b").distinct()


def flows(ops: DataFrame, component: str, target: str, reads: Column) -> DataFrame:
    """What a component reads (source) against what it writes (sink)."""
    ops = ops.select(component, target, reads.alias("_reads")).distinct()
    source = ops.where("_reads").select(component, F.col(target).alias("source"))
    return source.join(ops.where("not _reads").select(component, F.col(target).alias("sink")), component).where("source <> sink").distinct()


def having(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return rows.join(keys.select(*on), list(on), "left_semi")


def lacking(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key does not occur; unlike NOT IN, a null among the keys changes nothing."""
    return rows.join(keys.select(*on), list(on), "left_anti")


def completeness(needs: DataFrame, known: DataFrame, component: str, target: str) -> DataFrame:
    """For each component its targets, how many are not known, and 1 - missing / max(1, required)."""
    marked = needs.select(component, target).distinct().join(known.select(target).distinct().withColumn("_known", F.lit(True)), target, "left")
    out = marked.groupBy(component).agg(F.count("*").alias("n_required"), F.count_if(F.col("_known").isNull()).alias("n_missing"))
    return out.withColumn("confidence", F.round(1 - F.col("n_missing") / F.greatest(F.lit(1), F.col("n_required")), 4))


def missing(needs: DataFrame, known: DataFrame, component: str, target: str) -> DataFrame:
    """The targets behind ``completeness``: (component, target) that nothing defines."""
    return lacking(needs.select(component, target).distinct(), known, target)


def mapped_name(name: Column) -> Column:
    """A file's name as a table's: no ending, upper case, underscores."""
    return F.upper(F.replace(F.regexp_replace(name, "[.](DAT|TXT|CSV)$", ""), F.lit("-"), F.lit("_")))


def both_sides(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Every name with the sides that have it."""
    a, b = left.select(name, F.lit(True).alias("_a")), right.select(name, F.lit(True).alias("_b"))
    return a.join(b, name, "full").select(name, F.col("_a").isNotNull().alias("on_left"), F.col("_b").isNotNull().alias("on_right"))


def _grams(column: str) -> Column:
    """The distinct substrings of one to three characters."""
    n = F.length(column)

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(column), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def contained(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Pairs of names, one of which contains the other whatever the case.

    A name of three characters or more can only lie in one that has its first
    trigram, so both directions are joins by a trigram.  Shorter names are
    looked up among all substrings of one and two characters.
    """
    def inside(df: DataFrame) -> DataFrame:
        return df.select("x", "u", F.explode(_grams("u")).alias("g"))

    def lookup(inner: DataFrame, outer: DataFrame) -> DataFrame:
        probe = inner.select(F.col("x").alias("y"), F.col("u").alias("v"), F.substring("u", 1, 3).alias("g"))
        return inside(outer).join(probe, "g").where(F.contains(F.col("u"), F.col("v"))).select("x", "y")

    one = left.select(F.col(a).alias("x"), F.upper(a).alias("u")).distinct()
    two = right.select(F.col(b).alias("x"), F.upper(b).alias("u")).distinct()
    found = lookup(two, one).union(lookup(one, two).select("y", "x"))
    return found.distinct().select(F.col("x").alias(a), F.col("y").alias(b))


def sharing(uses: DataFrame, component: str, target: str) -> DataFrame:
    """Who shares a target with whom: (a, b, kind).

    Components with equal sets of targets are one class, named by the least of them: kind same_targets has each further
    member b of a class a.  Kind shares has the pairs a < b of classes that have a target in common.  So a target that
    everybody uses costs one row for each component, and pairs only between classes that differ.
    """
    uses = uses.select(F.col(component).alias("c"), F.col(target).alias("t")).where("c is not null and t is not null").distinct()
    of = lambda seed: F.sum(F.xxhash64("t", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}")
    sets = uses.groupBy("c").agg(F.count("*").alias("n"), of(1), of(2))
    classes = sets.groupBy("n", "h1", "h2").agg(F.min("c").alias("a"))
    members = sets.join(classes, ["n", "h1", "h2"]).select("a", F.col("c").alias("b"))
    # pairs are many times as large as uses, so uses are dealt to four times as many tasks as a shuffle has, which Spark does not join by their small size
    own = uses.join(classes.select(F.col("a").alias("c")), "c", "left_semi").repartition(4 * int(uses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t")
    pairs = own.select(F.col("c").alias("a"), "t").join(own.select(F.col("c").alias("b"), "t"), "t").where("a < b").select("a", "b").distinct()
    return members.where("a <> b").withColumn("kind", F.lit("same_targets")).unionByName(pairs.withColumn("kind", F.lit("shares")))


def equal_or_containing(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose value is the name or contains it, whatever the case; the exact ones have rank 0, the others 1."""
    u, n = F.upper(F.col(column)), F.upper(F.trim(F.lit(name)))
    return rows.where(F.contains(u, n)).withColumn("rank", F.when(u == n, 0).otherwise(1))


def probe(names: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """For each asked name the best match among the known ones: exact, starts with, ends with or contains, the least name on ties; null if none.

    Joined by the first three characters of the asked name among all trigrams of the known ones; shorter names are matched by their whole.
    """
    known = names.select(F.col(name).alias("known"), F.upper(name).alias("k")).distinct().select("known", "k", F.explode(_grams("k")).alias("g"))
    wanted = asked.select(F.col(name).alias("asked"), F.upper(F.trim(name)).alias("q")).distinct().withColumn("g", F.substring("q", 1, 3))
    k, q = F.col("k"), F.col("q")
    rank = F.when(k == q, 1).when(F.startswith(k, q), 2).when(F.endswith(k, q), 3).when(F.contains(k, q), 4)
    best = known.join(wanted, "g").withColumn("rank", rank).where("rank is not null").groupBy("asked").agg(F.min(F.struct("rank", "known")).alias("m"))
    how = F.when(F.col("m.rank") == 1, "exact match").when(F.col("m.rank") == 2, "starts with").when(F.col("m.rank") == 3, "ends with").when(F.col("m.rank") == 4, "contains")
    return wanted.select("asked").join(best, "asked", "left").select("asked", F.col("m.known").alias("match"), how.alias("how"))


def present(rows: DataFrame, *columns: str) -> DataFrame:
    """Those of the columns that the table has, in this order; the others are left out (a table written by an older version)."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*[c for c in columns if c.lower() in have])


def filled(rows: DataFrame, columns: dict[str, object]) -> DataFrame:
    """The columns in this order; what a table written by an older version lacks has its default (None: a null)."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*[F.col(c).alias(c) if c.lower() in have else F.lit(default).alias(c) for c, default in columns.items()])


def related(uses: DataFrame, component: str, target: str, calls: DataFrame, caller: str, called: str) -> DataFrame:
    """sharing() with a row of kind calls for each component that calls another one of those that use anything."""
    known = uses.select(F.col(component).alias("b")).distinct()
    direct = calls.select(F.col(caller).alias("a"), F.col(called).alias("b")).where("a <> b").distinct().join(known, "b", "left_semi")
    return sharing(uses, component, target).unionByName(direct.withColumn("kind", F.lit("calls")))
