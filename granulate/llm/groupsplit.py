"""Problem 3: splits that keep related records together.

Sources and the works they stand for form a graph; hash-to-min finds its
components, heavy components are placed first and weighted rendezvous hashing
assigns the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulate.functions import normalise
from granulate.session import cut

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
HEAVY = 0.002  # share of all rows from which a component is placed by hand: at most 1 / HEAVY of them


def links(sources: DataFrame) -> DataFrame:
    """Distinct edges a - b between a source and a work it bears the DOI of."""
    return (
        sources.select(normalise.ident(F.col("source_id")).alias("s"), normalise.doi(F.col("doi")).alias("d"))
        .where("s is not null and d is not null").distinct()
        .select(F.concat(F.lit("s:"), "s").alias("a"), F.concat(F.lit("w:"), "d").alias("b"))
    )


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (smallest node of the component) by hash-to-min.

    A node's cluster is kept as rows (v, u), never as a list, so a component of
    any size spreads over tasks. Each round sends a cluster to its minimum and
    the minimum to every member, until nothing changes.
    """
    state = cut(
        edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
        .unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        .unionByName(edges.select(F.col("a").alias("v"), F.col("a").alias("u")))
        .unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("u")))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        least = state.groupBy("v").agg(F.min("u").alias("m"))
        sent = state.join(least, "v")
        state = cut(
            sent.select(F.col("m").alias("v"), "u").unionByName(sent.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        )
        now = state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return state.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def roots(sources: DataFrame) -> DataFrame:
    """source_id, root for every source that bears a DOI."""
    return components(links(sources)).where("node like 's:%'").select(F.substr("node", F.lit(3)).alias("source_id"), "root")


def tallies(images: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows per component, source and split; counted per source before the join.

    A source without a DOI, or without a row in sources, is a group of its own.
    Rows without a source_id are each a group of their own and are not here.
    """
    per = images.select(
        normalise.ident(F.col("source_id")).alias("source_id"), normalise.split_name(F.col("split")).alias("split")
    ).where("source_id is not null").groupBy("source_id", "split").agg(F.count("*").alias("n"))
    return per.join(roots(sources), "source_id", "left").withColumn(
        "root", F.coalesce("root", F.concat(F.lit("s:"), "source_id"))
    )


def found(images: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id of every group whose images lie in more than one of train, val and test."""
    t = tallies(images, sources)
    torn = t.groupBy("root").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a != b").select("root")
    return t.join(torn, "root", "left_semi").select("source_id").distinct()


def assign(images: DataFrame, sources: DataFrame, shares: dict[str, float] = SHARES, seed: str = "42") -> DataFrame:
    """row_no, group, new_split for every row of images, one split per group.

    Components of at least HEAVY of all rows (at most 1 / HEAVY, so their list is
    bounded) are placed largest first where most is missing. The others follow
    weighted rendezvous hashing, the weights being what the heavy ones left of
    each split's rows. Rows without a source_id are groups of one row.
    """
    t = tallies(images, sources).select("source_id", "root", "n")
    sizes = t.groupBy("root").agg(F.sum("n").alias("n"))
    total = images.count()
    heavy = sizes.where(F.col("n") >= HEAVY * max(total, 1)).orderBy(F.desc("n"), "root").collect()
    left = {s: w * total for s, w in shares.items()}
    placed = {}
    for r in heavy:
        placed[r["root"]] = s = max(left, key=lambda k: (left[k], k))
        left[s] -= r["n"]
    whole = sum(max(x, 0.0) for x in left.values()) or 1.0
    weight = {s: max(x, 0.0) / whole for s, x in left.items()}

    def draw(key):
        """The split with the least -ln(u) / weight, u from a hash of seed, split and key."""
        score = lambda s: F.struct(
            (-F.log((F.pmod(F.xxhash64(F.lit(seed), F.lit(s), key), F.lit(2**52)) + 0.5) / float(2**52)) / weight[s]).alias("x"),
            F.lit(s).alias("s"),
        )
        scores = [score(s) for s in shares if weight[s] > 0] or [F.struct(F.lit(0.0).alias("x"), F.lit(next(iter(shares))).alias("s"))]
        return (F.least(*scores) if len(scores) > 1 else scores[0])["s"]

    split = draw(F.col("group"))
    for root, s in placed.items():
        split = F.when(F.col("group") == root, F.lit(s)).otherwise(split) if len(placed) <= 20 else split
    rows = images.select("row_no", normalise.ident(F.col("source_id")).alias("source_id")).join(
        t.select("source_id", "root").distinct(), "source_id", "left"
    ).select("row_no", F.coalesce("root", F.concat(F.lit("row:"), F.col("row_no").cast("string"))).alias("group"))
    if len(placed) > 20:
        spark = images.sparkSession
        by = spark.createDataFrame([(k, v) for k, v in placed.items()], "group string, put string")
        return rows.join(F.broadcast(by), "group", "left").select("row_no", "group", F.coalesce("put", split).alias("new_split"))
    return rows.select("row_no", "group", split.alias("new_split"))
