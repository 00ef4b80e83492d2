"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

The documents of a source, in the order of a seeded hash, form one stream of words; the mix takes the first ``target``
words of it, going round again where the target exceeds the source (at most three rounds). The stream is cut into blocks
of ``block_words``; the numbers of blocks are the exact quotas. The tree starts with the vector of quotas over all output
shards and halves the shards again and again: the left half draws its blocks without replacement (one hypergeometric
draw for each source, given the draws before it), the right half keeps the rest. At the leaves every shard has an exact
number of blocks of each source; an affine permutation of the block numbers, dealt out in consecutive ranges, makes the
draws of the shards disjoint. Inside a shard rows are ordered by a seeded hash.

Nothing is grouped by source alone but sums: running sums over a source go by (source, slot of the hash), so a hot source
is spread over ``16 ** slot_digits`` keys. Only the vector of quotas (one number for each source) is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.tables import written

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: Multiplier of the affine permutation: a prime above every quota.
PRIME = (1 << 31) - 1


@dataclass
class Mix:
    """``rows``: one row per document with its size and place in its source; ``sources``: sizes and targets;
    ``pieces``: what each shard takes (row, doc_id, shard, block, round, start and number of words, shuffle_key)."""

    rows: DataFrame
    sources: DataFrame
    pieces: DataFrame


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets of sources (columns ``absent, name, source_size``): shares of all words by weight, weights dealt in turn by
    name (null last), no target above three times its source, the excess reshared by weight until none is above.

    Sources are filled in the order of size by weight, so the level of the rest follows from running sums.
    """
    by_name = Window.orderBy("absent", "name")
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.lit(MAX_REPEATS) * F.col("source_size")).cast("double")
    dealt = sizes.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", deal).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "absent", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        dealt.withColumn("level", level)
        .withColumn("level", F.max("level").over(whole))
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.greatest(F.col("level"), F.lit(0.0))))
        .drop("level", "cap")
    )


def _uniform(*parts: Column) -> Column:
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / F.lit(float(1 << 53))


def hypergeometric(population: Column, good: Column, draws: Column, u: Column) -> Column:
    """Draw from the hypergeometric distribution by inversion of its distribution function.

    The support is cut twelve standard deviations around the mode, where less than 1e-30 is left.
    """
    r, k, n = (x.cast("double") for x in (population, good, draws))
    lo, hi = F.greatest(F.lit(0.0), n - (r - k)), F.least(k, n)
    mode = F.floor((n + 1) * (k + 1) / (r + 2)).cast("double")
    sd = F.sqrt(F.greatest(F.lit(0.0), n * (k / F.greatest(r, F.lit(1.0))) * (1 - k / F.greatest(r, F.lit(1.0))) * (r - n) / F.greatest(r - 1, F.lit(1.0))))
    a, c = F.greatest(lo, mode - F.ceil(12 * sd) - 8).cast("long"), F.least(hi, mode + F.ceil(12 * sd) + 8).cast("long")
    support = F.sequence(a, c)

    def ratio(x: Column) -> Column:
        return (k - x) * (n - x) / ((x + 1) * F.greatest(F.lit(1.0), r - k - n + x + 1))

    mass = F.aggregate(
        support,
        F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("z")),
        lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["z"] + s["w"]).alias("z")),
        lambda s: s["z"],
    )
    return F.aggregate(
        support,
        F.struct(F.lit(1.0).alias("w"), (u * mass).alias("left"), F.lit(-1).cast("long").alias("pick")),
        lambda s, x: F.struct(
            (s["w"] * ratio(x)).alias("w"),
            (s["left"] - s["w"]).alias("left"),
            F.when((s["pick"] < 0) & (s["left"] <= s["w"]), x).otherwise(s["pick"]).alias("pick"),
        ),
        lambda s: F.when(s["pick"] < 0, c).otherwise(s["pick"]),
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal the block quotas of sources (``number, quota``) out to shards: rows ``shard, number, blocks``."""
    whole = quotas.agg(F.sort_array(F.collect_list(F.struct("number", "quota"))).alias("q"), F.coalesce(F.sum("quota"), F.lit(0)).alias("n"))
    nodes = whole.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "n", F.transform("q", lambda x: x["quota"]).alias("have"), F.transform("q", lambda x: x["number"]).alias("ids"))

    def upto(shard: Column) -> Column:
        return F.floor(shard * F.col("n") / F.lit(shards)).cast("long")

    level = 1
    while level < shards:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        drawn = F.aggregate(
            F.arrays_zip("have", "ids"),
            F.struct(F.aggregate("have", F.lit(0).cast("long"), lambda s, x: s + x).alias("pop"), (upto(mid) - upto(F.col("lo"))).alias("left"), F.array().cast("array<long>").alias("out")),
            lambda s, x: F.transform(
                F.array(hypergeometric(s["pop"], x["have"], s["left"], _uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["ids"]))),
                lambda got: F.struct((s["pop"] - x["have"]).alias("pop"), (s["left"] - got).alias("left"), F.concat(s["out"], F.array(got)).alias("out")),
            )[0],
            lambda s: s["out"],
        )
        split = nodes.withColumn("mid", mid).withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, drawn))
        child = lambda lo, hi, have: F.struct(lo.alias("lo"), hi.alias("hi"), have.alias("have"))
        children = F.when(F.col("left").isNull(), F.array(child(F.col("lo"), F.col("hi"), F.col("have")))).otherwise(
            F.array(child(F.col("lo"), F.col("mid"), F.col("left")), child(F.col("mid"), F.col("hi"), F.zip_with("have", "left", lambda x, y: x - y)))
        )
        nodes = split.select("n", "ids", F.explode(children).alias("c")).select("c.lo", "c.hi", "n", "c.have", "ids")
        level *= 2
    return nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("ids", "have")).alias("c")).select("shard", F.col("c.ids").alias("number"), F.col("c.have").alias("blocks"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    block_words: int = 16384,
    shard_words: int = 1 << 22,
    seed: int = 17,
    slot_digits: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    row_column: str | None = None,
) -> Mix:
    """Mix the sources of ``docs`` to target weights.

    A null source is a source of its own, the last one. Null and empty texts have size 0 and are never taken. Rows that
    repeat an id are separate documents; ``row_column`` may hold a number that tells rows apart, which ``row`` then is. An empty
    table gives empty results. Other columns are ignored.
    """
    name = F.col(source_column).cast("string")
    rows = written(
        docs.select(
            F.col(id_column).alias("doc_id"),
            name.isNull().alias("absent"),
            F.coalesce(name, F.lit("")).alias("name"),
            word_count(F.col(text_column)).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).cast("binary")).alias("h"),
            *([] if row_column is None else [F.col(row_column).alias("own_row")]),
        )
        .withColumn("slot", F.substring("h", 1, slot_digits))
        .withColumn("row", F.monotonically_increasing_id() if row_column is None else F.col("own_row"))
        .drop("own_row"),
        "mix",
    )
    slots = rows.groupBy("absent", "name", "slot").agg(F.sum("size").alias("slot_size"))
    sources = written(targets(slots.groupBy("absent", "name").agg(F.sum("slot_size").alias("source_size")), weights), "targets")
    taken = F.least(F.round("target").cast("long"), F.lit(MAX_REPEATS) * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, round(total / shard_words))

    by_slot = Window.partitionBy("absent", "name").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slots.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(by_slot), F.lit(0)))
        .join(sources.withColumn("take", taken), ["absent", "name"])
        .drop("slot_size", "weight")
    )
    inside = Window.partitionBy("absent", "name", "slot").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["absent", "name", "slot"])
    placed = placed.withColumn("begin", F.col("slot_start") + F.col("before")).drop("before", "slot_start", "slot", "h")

    b = F.lit(block_words).cast("long")
    rounds = placed.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    rounds = rounds.withColumn("lo", F.col("round") * F.col("source_size") + F.col("begin")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take"))).where("hi > lo")
    cut = rounds.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block_words}"), F.expr(f"(hi - 1) div {block_words}"))))
    from_, to = F.greatest(F.col("lo"), F.col("block") * b), F.least(F.col("hi"), (F.col("block") + 1) * b)
    cut = cut.select("row", "doc_id", "number", "size", "block", "round", (from_ - F.col("lo")).alias("start"), (to - from_).alias("words"))

    quotas = sources.withColumn("take", taken).select("number", F.ceil(F.col("take") / b).cast("long").alias("quota"))
    leaves = split_quotas(quotas, shards, seed).where("blocks > 0")
    by_shard = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = leaves.withColumn("first", F.coalesce(F.sum("blocks").over(by_shard), F.lit(0))).join(quotas, "number")
    drawn = ranges.withColumn("draw", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)))
    block = F.pmod(F.pmod(F.col("draw") * F.lit(PRIME), F.col("quota")) + F.pmod(F.xxhash64(F.lit(seed), F.col("number")), F.col("quota")), F.col("quota"))
    drawn = drawn.select("shard", "number", block.alias("block"))
    pieces = cut.join(drawn, ["number", "block"]).withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col("shard"), F.col("row"), F.col("round"), F.col("start")))
    return Mix(placed, sources, pieces)


def taken_words(mix: Mix) -> DataFrame:
    """For each document what the mix takes: doc_id, size, source_size, target, taken (words, repeats counted)."""
    per_row = mix.pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return mix.rows.join(per_row, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
