"""Training batches without false negatives, by greedy colouring in rounds.

Two examples are in conflict if the positive of one is among those that the other must not count as negative. Positives are
nodes between them, so a positive that many examples have, or ban, makes no pairs: of each positive, the first open
example that has it and the first that bans it tell all others whether to wait. Examples go by the hash of their id; a round
colours those that no open conflict precedes with the least colour free. Colours are those of greedy colouring in this order,
whatever the partitions, and rounds grow with the longest chain of conflicts in hash order, about the logarithm.

Examples of one query ban each other's positives, so each has another colour, and the longest chain is all of them. A family is
the examples whose positive and bans are the same set together. Where no other family names any of its positives,
the greedy colour of an example is the place of its positive among the family's in hash order: these families are coloured by
numbering them, and only the rest takes rounds. ``Families`` state the set once, not with each example.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.partition import _saved


def families(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples (example_id, positive_id, family) and members (family, item) of examples that name what they ban.

    An example whose own positive is among its bans is in a family of its own.
    """
    bans = F.array_distinct(F.coalesce("excluded_positive_ids", F.array().cast(dict(examples.dtypes)["excluded_positive_ids"])))
    own = F.array_compact(F.array("positive_id"))
    whole = F.array_sort(F.array_union(own, bans))
    alone = F.coalesce(F.array_contains(bans, F.col("positive_id")), F.lit(True))
    name = F.when(alone, F.concat(F.lit("e"), F.sha2(F.col("example_id").cast("string"), 256))).otherwise(F.concat(F.lit("s"), F.sha2(F.to_json(whole), 256)))
    x = _saved(examples.select("example_id", "positive_id", name.alias("family"), alone.alias("alone"), whole.alias("items")))
    members = x.groupBy("family").agg(F.first("items").alias("items")).select("family", F.explode("items").alias("item"))
    return x.select("example_id", "positive_id", "family", "alone"), _saved(members)


def _numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with ``at``, their place within ``by`` from zero: ranges are numbered apart and shifted by what lies before."""
    ranged = _saved(rows.repartitionByRange(by, order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part", by).agg(F.count("*").alias("n"))  # a row for each partition and group in it
    before = sizes.select("part", by, (F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", by).orderBy(order)) - 1
    return ranged.withColumn("own", own).join(before, ["part", by]).withColumn("at", F.col("own") + F.col("before")).drop("part", "own", "before")


def colours(examples: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """example_id, rank, colour of examples (each id once), with the positives that they ban, or a family with ``members``.

    Either examples have example_id, positive_id, excluded_positive_ids; or example_id, positive_id, family, and members (family, item)
    tell what a family's examples ban besides their own positive, which is one of them.
    """
    if members is None:
        examples, members = families(examples)
    else:
        examples, members = examples.withColumn("alone", F.lit(False)), members.distinct()
    # families that share no item with another
    shared = members.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    open_ = _saved(members.join(shared, "item", "left_semi").select("family").union(examples.where("alone").select("family")).distinct())
    rank = F.struct(F.xxhash64("example_id").alias("h"), F.col("example_id").alias("id")).alias("rank")
    x = _saved(examples.select("example_id", "positive_id", "family", "alone", rank).join(open_.withColumn("open", F.lit(True)), "family", "left"))
    closed = x.where("open is null")
    first = closed.groupBy("family", "positive_id").agg(F.min("rank").alias("first"))
    place = _numbered(first, "family", "first").select("family", "positive_id", F.col("at").cast("int").alias("colour"))
    out = closed.join(place, ["family", "positive_id"]).select("example_id", "rank", "colour")
    rest = x.where("open")
    if not rest.limit(1).count():
        return _saved(out)
    bans = rest.join(members, "family").where("alone or positive_id is null or item != positive_id").select("example_id", "item", F.lit(False).alias("has"))
    own = rest.where("positive_id is not null").select("example_id", F.col("positive_id").alias("item"), F.lit(True).alias("has"))
    return _saved(out.unionByName(_rounds(rest.select("example_id", "rank"), own.unionByName(bans))))


def _rounds(examples: DataFrame, ties: DataFrame) -> DataFrame:
    """example_id, rank, colour of examples (example_id, rank) by their ties (example_id, item, has: it has the item, or bans it)."""
    ties = _saved(ties)
    state = _saved(examples.select("example_id", "rank", F.lit(None).cast("int").alias("colour")))
    while True:
        told = ties.join(state, "example_id")
        # what the other side of each positive says: who is first among the open, which colours are taken
        other = told.groupBy("item", (~F.col("has")).alias("has")).agg(F.min(F.when(F.col("colour").isNull(), F.col("rank"))).alias("first"), F.collect_set("colour").alias("taken"))
        seen = told.where("colour is null").join(other, ["item", "has"], "left")
        waits = F.coalesce(F.col("first") < F.col("rank"), F.lit(False))
        by = seen.groupBy("example_id").agg(F.bool_or(waits).alias("waits"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("taken", F.array().cast("array<int>"))))).alias("taken"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
        new = F.when(F.col("colour").isNotNull(), F.col("colour")).when(F.col("waits").isNull(), 0).when(~F.col("waits"), free)
        state = _saved(state.join(by, "example_id", "left").select("example_id", "rank", new.alias("colour")))
        if not state.where("colour is null").limit(1).count():
            return state


def conflict_free_batches(examples: DataFrame, size: int, members: DataFrame | None = None) -> DataFrame:
    """example_id, batch, place: batches of at most ``size`` examples of one colour, numbered from zero.

    Colours are cut in the order of ranks. Ranges of them are numbered apart and shifted by what lies before, so that a colour of
    most examples isn't one task's. ``members`` as in ``colours``.
    """
    if size < 1:
        raise ValueError("a batch has an example at least")
    dealt = _saved(_numbered(colours(examples, members), "colour", "rank"))
    whole = dealt.groupBy("colour").agg(F.ceil(F.count("*") / size).alias("batches"))
    first = _saved(_before(whole))
    at = dealt.join(first, "colour")
    return at.select("example_id", (F.col("first") + F.floor(F.col("at") / size)).cast("long").alias("batch"), (F.col("at") % size).cast("long").alias("place"))


def _before(whole: DataFrame) -> DataFrame:
    """colour, first: the batches of all lesser colours (colour, batches), by ranges of colours."""
    ranged = _saved(whole.repartitionByRange("colour").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum("batches").alias("n"))  # a row for each partition
    shift = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("shift"))
    own = F.sum("batches").over(Window.partitionBy("part").orderBy("colour")) - F.col("batches")
    return ranged.withColumn("own", own).join(F.broadcast(shift), "part").select("colour", (F.col("own") + F.col("shift")).alias("first"))


def conflicts(batches: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples (a, b) of one batch that are in conflict; none, if the batches are right."""
    x = batches.select("example_id", "batch").join(examples, "example_id")
    bans = x.select(F.col("example_id").alias("b"), "batch", F.explode("excluded_positive_ids").alias("positive_id"))
    return x.select(F.col("example_id").alias("a"), "batch", "positive_id").join(bans, ["batch", "positive_id"]).where("a != b").select("a", "b")
