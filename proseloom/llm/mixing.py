"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.session import cut_lineage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words the mix holds, as a share of all words; and the most copies of a source.
SHARE, MOST = 1.5, 2.0
#: Fractions met in one fold of the reduction tree.
FAN_IN = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A key that never is null, so that null sources join like any other."""
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source.cast("string")))


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(key, source_size, target) of every source in (key, source, size, n).

    Targets are ``share`` of all words by weight.  A source stops at ``most``
    times its size and the rest is shared anew, which is the level at which the
    water of ``min(level * weight, most * size)`` adds up.  The windows run over
    one row per source.
    """
    sums = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sums = sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sums = sums.withColumn("level", level)
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)
    target = F.coalesce(F.least(water["level"] * F.col("weight"), F.col("most")), F.col("most"))
    return sums.select("key", "source_size", target.alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _fold(items: Column, seed: int) -> Column:
    """Pair the fraction carried along with each next one until one of the two is integral.

    Words move, not probabilities: what one item gains in expected words the
    other loses, so a source's expected words never change, while either
    direction is drawn so that each item keeps its probability on average.
    """

    def item(of: Column, p: Column) -> Column:
        return F.struct(of["turn"].alias("turn"), of["row"].alias("row"), of["words"].alias("words"), p.alias("p"))

    def step(state: Column, other: Column) -> Column:
        one = state["carried"]
        have_one, have_other = one["p"] * one["words"], other["p"] * other["words"]
        lack_one, lack_other = one["words"] - have_one, other["words"] - have_other
        gain, loss = F.least(lack_one, have_other), F.least(have_one, lack_other)
        rises = _unit(F.lit(seed), one["turn"], other["turn"]) * (gain + loss) < loss
        # The item that reaches 0 or 1 is decided; the other is carried on.
        one_full, other_empty = lack_one <= have_other, have_other < lack_one
        one_empty, other_full = have_one <= lack_other, lack_other < have_one
        clip = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))
        decided = (
            F.when(rises & one_full, item(one, F.lit(1.0)))
            .when(rises & other_empty, item(other, F.lit(0.0)))
            .when(~rises & one_empty, item(one, F.lit(0.0)))
            .when(~rises & other_full, item(other, F.lit(1.0)))
        )
        carried = (
            F.when(rises & one_full, item(other, clip((have_other - gain) / other["words"])))
            .when(rises & other_empty, item(one, clip((have_one + gain) / one["words"])))
            .when(~rises & one_empty, item(other, clip((have_other + loss) / other["words"])))
            .when(~rises & other_full, item(one, clip((have_one - loss) / one["words"])))
        )
        return F.struct(carried.alias("carried"), F.concat(state["done"], F.array(decided)).alias("done"))

    start = F.struct(items[0].alias("carried"), F.filter(items, lambda x: F.lit(False)).alias("done"))
    return F.reduce(F.slice(items, 2, F.size(items)), start, step)


def round_fractions(items: DataFrame, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """(key, row, extra) with extra 0 or 1 for items (key, row, words, p) with 0 < p < 1 and words > 0.

    Items fold in random blocks of about ``fan_in`` per key; what each block
    carries at its end goes on to the next level with so many times fewer
    blocks.  The last item of a key is drawn by its probability, so the words
    taken differ from those expected by less than one item.
    """
    counts = cut_lineage(items.groupBy("key").agg(F.count("*").alias("n")))
    largest = counts.agg(F.max("n")).first()[0] or 0
    level = items.select("key", F.xxhash64(F.lit(seed), "key", "row").alias("turn"), "row", "words", "p").join(counts, "key")
    decided, number, blocks = [], 0, largest
    while blocks > 1 or not decided:
        number, blocks = number + 1, ceil(blocks / fan_in)
        share = F.greatest(F.ceil(F.col("n") / F.lit(float(fan_in) ** number)), F.lit(1))
        grouped = level.withColumn("block", F.pmod(F.xxhash64(F.lit(number), "turn"), share)).groupBy("key", "n", "block")
        gathered = grouped.agg(F.array_sort(F.collect_list(F.struct("turn", "row", "words", "p"))).alias("items"))
        folded = cut_lineage(gathered.select("key", "n", _fold(F.col("items"), seed).alias("state")))
        decided.append(folded.select("key", F.explode("state.done").alias("x")).select("key", "x.row", F.col("x.p").cast("int").alias("extra")))
        level = folded.select("key", "n", "state.carried.*")
    last = _unit(F.lit(seed + 1), F.col("turn")) < F.col("p")
    out = level.select("key", "row", last.cast("int").alias("extra"))
    for part in decided:
        out = out.unionByName(part)
    return out


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0
) -> DataFrame:
    """One row per input row: (id, source, size, nth, rows, source_size, target, copies).

    ``copies`` is how often the mix takes the row: the whole part of
    target / source size, and its fraction rounded so that every source meets
    its target within one document.  Rows equal in id, source and size are
    numbered by ``nth`` up to ``rows``; a null text has size 0, a null source is
    a source of its own.  Results depend on the rows and the seed alone.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        _source_key(F.col(source_col)).alias("key"),
    )
    kinds = cut_lineage(rows.groupBy("key", "id", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    targets = cut_lineage(source_targets(kinds))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = kinds.join(targets, "key").withColumn("rate", rate).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    each = each.withColumn("p", F.col("rate") - F.floor("rate")).withColumn("row", F.struct("id", "size", "nth"))
    drawn = each.where("p > 0 and size > 0").select("key", "row", F.col("size").cast("double").alias("words"), "p")
    extra = round_fractions(drawn, seed).withColumnRenamed("row", "at")
    extra = cut_lineage(extra.select("key", F.to_json("at").alias("at"), "extra"))
    each = each.withColumn("at", F.to_json("row")).join(extra, ["key", "at"], "left")
    chance = (_unit(F.lit(seed), F.col("key"), F.col("at")) < F.col("p")).cast("int")
    total = F.floor("rate").cast("int") + F.coalesce("extra", F.when(F.col("p") > 0, chance), F.lit(0))
    return each.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "nth", F.col("n").alias("rows"),
        "source_size", "target", total.alias("copies"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`copies` takes it, with the columns unchanged."""
    names = {"i": id_col, "s": source_col}
    taken = cut_lineage(copies(docs, id_col, text_col, source_col, seed)).select(
        F.to_json(F.struct(F.col(names["i"]).alias("i"), F.col(names["s"]).alias("s"), F.col("size").alias("z"))).alias("_at"),
        F.col("nth").alias("_nth"), F.col("rows").alias("_rows"), F.col("copies").alias("_copies"),
    )
    at = F.to_json(F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s"), word_count(F.col(text_col)).alias("z")))
    keyed = docs.withColumn("_at", at)
    # The decisions grow with the input, so they are never broadcast: one plan at every size.
    once = taken.where("_rows = 1 and _copies > 0").select("_at", "_copies")
    both = keyed.join(once.hint("merge"), "_at")
    repeated = taken.where("_rows > 1")
    if not repeated.isEmpty():
        turn = Window.partitionBy("_at").orderBy(F.col(text_col))
        alike = keyed.join(repeated.select("_at").distinct(), "_at", "left_semi").withColumn("_nth", F.row_number().over(turn).cast("long"))
        both = both.unionByName(alike.join(repeated.select("_at", "_nth", "_copies"), ["_at", "_nth"]).drop("_nth"))
    both = both.where("_copies > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*[F.col(c) for c in docs.columns])
