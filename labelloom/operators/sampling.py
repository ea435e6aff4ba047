"""Stratified splits, class weights, oversampling and label indices.

All of them start from class counts, which are small and staged. The frame
itself is never shuffled by its label: one class may hold most of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.operators.ranking import bucket_counts, bucket_digits, bucket_of, order_key, ranked
from labelloom.plans.staging import stage

# Copies of one row made by one task step.
COPIES_PER_STEP = 10_000
# Bits that a digest gives, fair draws that are counted bit by bit (more follow the normal curve,
# less than 0.0001 off by then), binary places of a share, and halvings of a class.
WORD_BITS = 60
COUNTED_DRAWS = 960
SHARE_BITS = 128
HALVINGS = 62


def _fail_when(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Staged ``(label, n)``; refuses null labels."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return stage(counts.withColumn("n", _fail_when(F.col(label).isNull(), "null label; drop such rows first", F.col("n"))))


def train_sizes(counts: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """``(label, n, n_train)``: exact train rows per class.

    The test part has ``ceil(test_size * n)`` rows in total. Each class gets its
    proportional share of the train rows rounded down; the rows left over go to
    the largest remainders, ties to the smaller label. Integer arithmetic in
    decimals, so sizes stay exact beyond what doubles or longs can hold.
    """
    everything, largest_first = Window.partitionBy(), Window.orderBy(F.desc("_rest"), F.col(label))
    exact = "decimal(38,0)"
    sized = counts.withColumn("_total", F.sum("n").over(everything)).withColumn("_k", F.count("*").over(everything))
    sized = sized.withColumn("_test", F.ceil(F.lit(float(test_size)) * F.col("_total"))).withColumn(
        "_train", F.col("_total") - F.col("_test")
    )
    product = F.col("n").cast("decimal(19,0)") * F.col("_train").cast("decimal(18,0)")
    shared = sized.withColumn("_rest", (product % F.col("_total")).cast(exact)).withColumn(
        "_floor", ((product - F.col("_rest")) / F.col("_total")).cast("long")
    )
    left_over = F.col("_train") - F.sum("_floor").over(everything)
    given = shared.withColumn("_extra", (F.row_number().over(largest_first) <= left_over).cast("long"))
    size = F.col("_floor") + F.col("_extra")
    size = _fail_when(F.col("n") < 2, "a class has fewer than 2 rows", size)
    size = _fail_when(F.least("_train", "_test") < F.col("_k"), "a part has fewer rows than there are classes", size)
    return given.select(label, "n", size.alias("n_train"))


def stratified_split(
    df: DataFrame, id_col: str, label: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``split`` (``train`` / ``test``), exact in size per class.

    Needs a unique ``id_col`` and labels without nulls. The rows of each class
    are ordered by a hash of the id and the first ``n_train`` train. Only the one
    bucket per class where train ends is sorted; it yields a cut-off key, and
    every row is then compared with the cut-off of its class. So the text of
    the corpus is not shuffled at all, and a class of any size is spread over
    many tasks.
    """
    narrow = df.select(id_col, label)
    digits = bucket_digits(narrow)
    buckets = bucket_counts(narrow, id_col, label, seed, digits)
    counts = buckets.groupBy(label).agg(F.sum("n").alias("n"))
    counts = counts.withColumn("n", _fail_when(F.col(label).isNull(), "null label; drop such rows first", F.col("n")))
    sizes = train_sizes(counts, label, test_size)

    # One row per class; staged, so that its true size decides how it is joined.
    last_bucket = stage(
        buckets.join(sizes.select(label, "n_train"), label)
        .filter((F.col("before") < F.col("n_train")) & (F.col("n_train") <= F.col("before") + F.col("n")))
        .select(label, F.col("bucket").alias("_bucket"), (F.col("n_train") - F.col("before")).alias("_take"))
    )
    inside = Window.partitionBy(label).orderBy("_key", id_col)
    in_last_bucket = (
        narrow.withColumn("_key", order_key(id_col, seed))
        .withColumn("_bucket", bucket_of("_key", digits))
        .join(last_bucket, [label, "_bucket"])
    )
    cut_offs = stage(
        in_last_bucket.withColumn("_place", F.row_number().over(inside))
        .withColumn("_next", F.lead(id_col).over(inside))
        .filter(F.col("_place") == F.col("_take"))
        .select(
            label,
            F.col("_key").alias("_cut_key"),
            _fail_when(F.col("_next") == F.col(id_col), "row ids are not unique", F.col(id_col)).alias("_cut_id"),
        )
    )
    key = order_key(id_col, seed)
    trains = (key < F.col("_cut_key")) | ((key == F.col("_cut_key")) & (F.col(id_col) <= F.col("_cut_id")))
    return (
        df.join(cut_offs, label, "left")
        .withColumn("split", F.when(trains, "train").otherwise("test"))
        .select(*df.columns, "split")
    )


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with weight ``rows / (classes * rows of the class)``."""
    everything = Window.partitionBy()
    total, classes = F.sum("n").over(everything), F.count("*").over(everything)
    return class_counts(train, label).withColumn("weight", total / (classes * F.col("n")))


def inverse_frequency_weights(train: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)``: inverse counts scaled to sum to the class count.

    Labels must be 0..k-1 without gaps; a gap would mean an infinite weight and
    is an error.
    """
    everything = Window.partitionBy()
    classes = F.count("*").over(everything)
    gap = (F.max(label).over(everything) + 1 != classes) | (F.min(label).over(everything) < 0)
    inverse = F.lit(1.0) / F.col("n")
    weight = inverse / F.sum(inverse).over(everything) * classes
    return class_counts(train, label).withColumn("weight", _fail_when(gap, "labels are not 0..k-1", weight))


def with_weights(df: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """Adds each row's class ``weight``."""
    return df.join(weights.select(label, "weight"), label).select(*df.columns, "weight")


def dense_label_index(df: DataFrame, label: str, index: str = "label_idx") -> tuple[DataFrame, DataFrame]:
    """``df`` with labels numbered 0..k-1 in sorted order, and the label table."""
    labels = class_counts(df, label).select(label)
    classes = stage(labels.withColumn(index, F.row_number().over(Window.orderBy(label)) - 1))
    return df.join(classes, label).select(*df.columns, index), classes


def _digest(*key: Column) -> Column:
    """``WORD_BITS`` random bits, fixed by the key."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, WORD_BITS // 4), 16, 10).cast("long")


def _shifted(name: str, value: Column, places: Column) -> Column:
    return F.call_function(name, value.cast("long"), places.cast("int"))


def fair_draws(m: Column, *key: Column) -> Column:
    """How many of ``m`` draws fall on the first of two equal sides, fixed by the key.

    Up to ``COUNTED_DRAWS`` draws are one random bit each, and the set bits are
    counted. Beyond, the number is taken from the normal curve.
    """

    def ones(word: Column) -> Column:
        mask = _shifted("shiftleft", F.lit(1), F.least(F.lit(WORD_BITS), m - word * WORD_BITS)) - 1
        return F.bit_count(_digest(*key, word).bitwiseAND(mask)).cast("long")

    words = F.sequence(F.lit(0).cast("long"), F.floor((m - 1) / WORD_BITS))
    counted = F.aggregate(words, F.lit(0).cast("long"), lambda total, word: total + ones(word))
    unit = F.lit(2.0**WORD_BITS)
    radius = F.sqrt(F.lit(-2.0) * F.log((_digest(*key, F.lit("radius")) + 1) / unit))
    normal = radius * F.cos(F.lit(2 * math.pi) * (_digest(*key, F.lit("angle")) / unit))
    drawn = F.floor(m / 2.0 + F.sqrt(m.cast("double")) / 2.0 * normal + 0.5).cast("long")
    many = F.greatest(F.lit(0).cast("long"), F.least(m, drawn))
    return F.when(m <= 0, F.lit(0).cast("long")).when(m <= COUNTED_DRAWS, counted).otherwise(many)


def share_draws(m: Column, part: Column, whole: Column, *key: Column) -> Column:
    """How many of ``m`` draws fall into ``part`` of ``whole``, by fair draws alone.

    A draw is a number below 1, compared with ``part / whole`` binary place by
    place. At each place fair draws say how many of the open draws have a 0
    there. Where the share has a 1 these are inside; where it has a 0 the others
    are outside. The rest stay open, about half of them each time.
    """

    def place(state: Column, step: Column) -> Column:
        zeros, double = fair_draws(state["open"], *key, step), state["x"] * 2
        inside = double >= whole
        return F.struct(
            F.when(inside, state["open"] - zeros).otherwise(zeros).alias("open"),
            F.when(inside, state["taken"] + zeros).otherwise(state["taken"]).alias("taken"),
            F.when(inside, double - whole).otherwise(double).alias("x"),
        )

    def step(state: Column, i: Column) -> Column:
        return F.when(state["open"] == 0, state).otherwise(place(state, i))

    start = F.struct(m.alias("open"), F.lit(0).cast("long").alias("taken"), part.alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SHARE_BITS)), start, step)["taken"]


def draw_blocks(counts: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """``(label, power, draws)``: the draws that a class still needs, over blocks of its ranks.

    The ranks of a class are cut into blocks of falling powers of two, the ones
    in its size's binary form. The first block takes its share of all
    draws, the next its share of the others, and the last what is left. At
    most 62 rows for each class that is smaller than the largest one.
    """
    missing = F.max("n").over(Window.partitionBy()) - F.col("n")
    short = counts.withColumn("missing", missing).filter("missing > 0")
    n, zero = F.col("n"), F.lit(0).cast("long")
    key = F.lit(str(seed)), F.col(label), F.lit("block")

    def block(state: Column, power: Column) -> Column:
        size = _shifted("shiftleft", F.lit(1), power)
        rest = n.bitwiseAND(_shifted("shiftleft", F.lit(1), power + 1) - 1)
        share = share_draws(state["rest"], size, rest, *key, power)
        draws = F.when(n.bitwiseAND(size) == 0, zero).when(rest == size, state["rest"]).otherwise(share)
        return F.struct((state["rest"] - draws).alias("rest"), F.concat(state["draws"], F.array(draws)).alias("draws"))

    powers = F.sequence(F.lit(HALVINGS - 1), F.lit(0), F.lit(-1))
    start = F.struct(F.col("missing").alias("rest"), F.array().cast("array<bigint>").alias("draws"))
    walked = F.aggregate(powers, start, block)["draws"]
    blocks = short.select(label, F.posexplode(walked).alias("at", "draws")).filter("draws > 0")
    return blocks.select(label, (F.lit(HALVINGS - 1) - F.col("at")).alias("power"), "draws")


def copies_drawn(rank: Column, power: Column, draws: Column, *key: Column) -> Column:
    """How many of its block's draws fall on the row of this rank.

    The block is halved until the row stands alone; fair draws divide the draws
    of every part between its halves. All rows of a part compute the same
    numbers, so no draw is ever written down or joined.
    """

    def halve(m: Column, level: Column) -> Column:
        first = fair_draws(m, *key, level, _shifted("shiftright", rank, level))
        is_first = _shifted("shiftright", rank, level - 1).bitwiseAND(F.lit(1).cast("long")) == 0
        return F.when(m == 0, m).when(is_first, first).otherwise(m - first)

    levels = F.sequence(power, F.lit(1), F.lit(-1))
    return F.when(power == 0, draws).otherwise(F.aggregate(levels, draws, halve))


def random_oversample(train: DataFrame, id_col: str, label: str, seed: int = 42) -> DataFrame:
    """``train`` plus drawn copies, so that every class is as large as the largest.

    A class short of the largest one draws the difference, with replacement.
    Draws are divided by halving the class's ranks, down to the single row
    (``copies_drawn``), so the work grows with rows, not draws. Column ``copy``
    is 0 on the kept rows and numbers the copies of a row from 1. Only the
    classes that need copies are ranked and shuffled; the originals of all
    classes pass straight through. Many copies of one row are made by many tasks.
    """
    columns = train.columns
    digits = bucket_digits(train)
    buckets = bucket_counts(train.select(id_col, label), id_col, label, seed, digits)
    counts = stage(buckets.groupBy(label).agg(F.sum("n").alias("n")))
    blocks = stage(draw_blocks(counts, label, seed))
    blocks = blocks.select(label, F.col("power").alias("_power"), F.col("draws").alias("_draws"))
    short = counts.join(blocks.select(label).distinct(), label, "left_semi").select(label, F.col("n").alias("_n"))

    rows = ranked(train.join(short, label), buckets, id_col, label, seed, digits)
    # The rank's block is that of the highest place where it falls below the class's size.
    rows = rows.withColumn("_power", F.length(F.bin(F.col("_n").bitwiseXOR(F.col("rank")))) - 1).join(blocks, [label, "_power"])
    times = copies_drawn(F.col("rank"), F.col("_power"), F.col("_draws"), F.lit(str(seed)), F.col(label))
    drawn = rows.withColumn("_times", times).filter("_times > 0")
    steps = F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(COPIES_PER_STEP).cast("long"))
    steps = drawn.withColumn("_from", F.explode(steps)).repartition(id_col, "_from")
    upto = F.least(F.col("_times"), F.col("_from") + COPIES_PER_STEP)
    copies = steps.select(*columns, F.explode(F.sequence(F.col("_from") + 1, upto)).alias("copy"))
    return train.withColumn("copy", F.lit(0).cast("long")).unionByName(copies)
