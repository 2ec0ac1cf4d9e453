"""Operator 5, mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

The sources form a tree of domain, language and source. A token budget goes down the tree by the weights of its nodes. A node can
take what its documents hold times the epochs allowed; what a node cannot take goes to its siblings by their weights, and only what
no sibling can take was withheld higher up: as every node's room is summed from below before budgets go down, a budget never exceeds
a subtree's room. Each leaf then takes whole epochs of its documents and, from the next epoch's order, the longest prefix that fits the rest.
An epoch's order is by a hash of seed, epoch and id.

Dividing a budget among siblings is a closed form over windows: siblings in order of room / weight fill up one after the other, and
the first that does not fill sets the level of all behind it. A leaf's prefix is found without gathering the leaf: tokens are summed
by the first hex digits of the hash, and only the bucket in which the budget ends is ordered.

Cases: null domains, languages and sources are nodes named ''; null ids order by an empty name; rows that repeat an id go together;
null and empty texts hold no tokens and ride along where their place in the order is within the prefix; weights that are not given are 1, leaves of weight 0 get
nothing; an empty table gives no rows; extra columns stay in select_documents and are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import cut, unused

TREE = ["domain", "language", "source"]
#: Leaves up to which their cuts are broadcast, at some 200 bytes each; beyond, the join is shuffled.
BROADCAST_LEAVES = 100_000
#: Documents of the largest leaf that a bucket of the order should hold.
BUCKET_ROWS = 1000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def domain_of(source: Column, sources_per_domain: int = 5) -> Column:
    """The domain of a numbered source: five sources to each."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("domain"), F.floor(number.try_cast("long") / sources_per_domain).cast("string")))


def in_tree(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """documents with their place in the tree, and the names of those columns, which clash with none of theirs."""
    names = unused(docs, "domain_", "language_", "source_")
    return docs.withColumns(dict(zip(names, (domain_of(F.col("source")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), strict=True))), names


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"))


def weight_of(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    given = [x for name, w in weights.get(level, {}).items() for x in (F.lit(name), F.lit(float(w)))]
    return F.coalesce(F.element_at(F.create_map(*given), F.col(level)), F.lit(1.0)) if given else F.lit(1.0)


def divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """budget of each node from its parent's: nodes have room, weight and parent_budget. Siblings take over what others have no room for."""
    nodes = nodes.where("weight > 0 and room > 0").withColumn("fills_at", F.col("room") / F.col("weight"))
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = siblings.orderBy("fills_at", name)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.withColumns({
        "place": F.row_number().over(order),
        "level": (F.col("parent_budget") - F.sum("room").over(so_far) + F.col("room")) / (F.sum("weight").over(siblings) - F.sum("weight").over(so_far) + F.col("weight")),
    })
    nodes = nodes.withColumn("full", F.col("fills_at") <= F.col("level"))
    shared = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("place"))).over(siblings)
    return nodes.withColumn("shared", shared).withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * F.col("shared")))).select(*parent, name, "budget")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], share: float, epochs: int) -> DataFrame:
    """(domain, language, source, tokens, budget) from (domain, language, source, tokens)."""
    sized = leaves.withColumn("room", F.col("tokens").cast("double") * epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * share).cast("double").alias("parent_budget"))
    above, parent = total, []
    for depth, name in enumerate(TREE):
        nodes = sized.groupBy(*TREE[: depth + 1]).agg(F.sum("room").alias("room")).withColumn("weight", weight_of(name, weights))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # the root's budget is one row
        above = divide(nodes, parent, name).withColumnRenamed("budget", "parent_budget")
        parent = TREE[: depth + 1]
    return sized.join(above.withColumnRenamed("parent_budget", "budget"), TREE).select(*TREE, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def leaf_cuts(rows: DataFrame, weights, share: float, epochs: int, seed: int) -> DataFrame:
    """(domain, language, source, whole, last): whole epochs of each leaf, and the last order key of the next one. rows: id, tokens and the tree."""
    leaves = rows.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    budgets = leaf_budgets(leaves, weights, share, epochs).where("tokens > 0")
    budgets = cut(budgets.withColumns({"whole": F.floor(F.col("budget") / F.col("tokens")), "rest": F.col("budget") % F.col("tokens")}), "budgets")
    most = leaves.agg(F.max("docs")).first()[0] or 0
    digits = 2
    while 16**digits * BUCKET_ROWS < most and digits < 8:
        digits += 1
    keyed = rows.join(budgets.select(*TREE, "whole", "rest").hint("broadcast" if budgets.count() <= BROADCAST_LEAVES else "merge"), TREE)
    keyed = keyed.withColumn("key", order_key(seed, F.col("whole"), F.col("id"))).withColumn("bucket", F.substring("key", 1, digits))
    leaf = Window.partitionBy(*TREE)
    buckets = keyed.groupBy(*TREE, "bucket", "rest").agg(F.sum("tokens").alias("held"))
    buckets = buckets.withColumn("until", F.sum("held").over(leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the bucket in which the rest ends
    ends = buckets.where("until > rest").groupBy(*TREE).agg(F.min("bucket").alias("bucket"), F.min_by(F.col("rest") - F.col("until") + F.col("held"), "bucket").alias("left"))
    ends = cut(ends, "ends")
    inside = keyed.select(*TREE, "bucket", "key", "tokens").join(ends.hint("broadcast" if ends.count() <= BROADCAST_LEAVES else "merge"), [*TREE, "bucket"])
    inside = inside.groupBy(*TREE, "left", "key").agg(F.sum("tokens").alias("tokens"))
    inside = inside.withColumn("sum", F.sum("tokens").over(leaf.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("sum") <= F.col("left"))
    last = inside.groupBy(*TREE).agg(F.max("key").alias("last"))
    return budgets.join(ends, TREE, "left").join(last, TREE, "left").select(*TREE, "whole", F.coalesce("last", "bucket", F.lit("")).alias("last"))


def select_documents(docs: DataFrame, weights: Mapping[str, Mapping[str, float]], share: float, epochs: int, seed: int) -> DataFrame:
    """The documents taken, with all their columns, followed by their domain and how often they are taken: once for each whole epoch and once in the last
    one's prefix. These two are domain_ and times_, or have more underscores where documents have such columns."""
    placed, names = in_tree(docs)
    rows = placed.select(F.col("doc_id").alias("id"), *[F.col(name).alias(level) for name, level in zip(names, TREE, strict=True)], words_of(F.col("text")).alias("tokens"))
    whole, last, times = unused(placed, "whole_", "last_", "times_")
    cuts = cut(leaf_cuts(cut(rows, "sizes"), weights, share, epochs, seed), "cuts").toDF(*names, whole, last)
    joined = placed.join(cuts.hint("broadcast" if cuts.count() <= BROADCAST_LEAVES else "merge"), names)
    taken = F.col(whole) + F.when(order_key(seed, F.col(whole), F.col("doc_id")) <= F.col(last), 1).otherwise(0)
    return joined.withColumn(times, taken).where(F.col(times) > 0).select(*docs.columns, names[0], times)
