"""Mixing sources to target weights: fixed-length blocks drawn by permuted index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsift.llm.common import WORD, written

#: Documents in one unit of the distributed running sum.
CHUNK_ROWS = 2_000
#: Slots that one task spreads out, and output shards in one group of the running sum.
SLOT_RUN, SHARD_RUN = 10_000, 1_024
ROUNDS = 12


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float = 1.5, cap: float = 2.0, least: float = 0.0
) -> DataFrame:
    """`target` for each row of (`_source`, `source`, `source_size`), weights repeating by source order.

    The target is level * weight, held between `least` and `cap` times the source's size, with the
    one level at which the targets add up to `share` of all sizes. Resharing an excess by weight
    until none is left ends at the same level. One row for each source goes through two windows.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_weight", weight).withColumn("_want", F.lit(share) * F.sum("source_size").over(everything))
    low, high = F.col("source_size") * least, F.col("source_size") * cap
    steps = ranked.withColumn(
        "_step",
        F.explode(
            F.array(
                F.struct((low / F.col("_weight")).alias("level"), F.col("_weight").alias("slope"), (-low).alias("fixed"), low.alias("start")),
                F.struct((high / F.col("_weight")).alias("level"), (-F.col("_weight")).alias("slope"), high.alias("fixed"), F.lit(0.0).alias("start")),
            )
        ),
    )
    by_level = Window.orderBy("_step.level", F.col("_step.slope").desc(), "_source")
    so_far = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = steps.select(
        "_source", "source", "source_size", "_weight", "_want",
        F.sum("_step.slope").over(so_far).alias("_slope"),
        (F.sum("_step.fixed").over(so_far) + F.sum("_step.start").over(everything)).alias("_fixed"),
        F.lead("_step.level").over(by_level).alias("_until"),
        F.row_number().over(by_level).alias("_nth"),
    )
    reaches = (F.col("_slope") > 0) & (F.col("_fixed") + F.col("_slope") * F.col("_until") >= F.col("_want"))
    found = F.min(F.when(reaches, F.struct("_nth", ((F.col("_want") - F.col("_fixed")) / F.col("_slope")).alias("level"))))
    bound = F.greatest(F.lit(0.0), F.coalesce(F.col("_level"), F.lit(float("inf")))) * F.col("_weight")
    return (
        running.withColumn("_level", found.over(everything)["level"])
        .groupBy("_source")
        .agg(F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first(F.greatest(low, F.least(high, bound))).alias("target"))
        .withColumn("target", F.when(F.col("source_size") > 0, F.col("target")).otherwise(0.0))
    )


def _permuted(x: Column, n: Column, key: Sequence[Column], seed: int) -> Column:
    """Image of x (in 0..n-1) under a keyed permutation: swap-or-not rounds.

    Each round pairs x with (k - x) mod n and swaps the two if a keyed hash bit of the pair says
    so; a round is its own inverse, so every round is a permutation of 0..n-1 for any n.
    """
    keys = F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *key), n) for i in range(ROUNDS)])

    def swap_or_not(at: Column, k: Column) -> Column:
        partner = F.pmod(k - at, n)
        return F.when(F.xxhash64(F.greatest(at, partner), k, *key).bitwiseAND(1) == 1, partner).otherwise(at)

    return F.coalesce(F.aggregate(keys, x.cast("long"), swap_or_not), F.lit(0))


class Mix:
    """One mix: `documents()` says what it takes of each row, `pieces()` holds its texts."""

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[float] = (3, 1, 2),
        share: float = 1.5,
        cap: float = 2.0,
        least: float = 0.0,
        block_words: int = 128,
        shard_slots: int = 8192,
        seed: int = 29,
        key: str = "doc_id",
        text: str = "text",
        source: str = "source",
    ):
        """Pack the documents of each source into blocks of `block_words` words and draw blocks.

        Every source gets round(target / size * blocks) slots. The output shards draw how many
        slots of each source they have (`draws`), and a source's slots are numbered in the order of
        the shards. A slot's pass and rank in its source go through a keyed permutation of the block
        numbers: a pass over a source uses each of its blocks once, so no row is taken more than
        ceil(cap) times. Slots and blocks meet in a join on (source, block number).

        Sizes are counts of words. Null sources form one source, ranked last; null and empty texts
        have size 0 and are never taken; repeated rows are packed one after the other; an empty
        table gives no rows. Columns named like results are replaced.
        """
        self.docs, self.block_words, self.text, self.key = docs, block_words, text, key
        self.seed, self.shard_slots = seed, shard_slots
        # The row number is fixed by writing it: later reads agree on it even after lost executors.
        self.rows = written(
            docs.select(
                F.monotonically_increasing_id().alias("_row"),
                F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source"),
                F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_record"),
                F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
                F.xxhash64(key, text).alias("_hash"),
            ),
            "mix-rows",
        )
        sizes = self.rows.groupBy("_source").agg(
            F.min(F.col(f"_record.{source}").cast("string")).alias("source"), F.sum("_size").alias("source_size")
        )
        self.targets = written(source_targets(sizes, weights, share, cap, least), "mix-targets")

    def _spans(self) -> DataFrame:
        """Where each row lies in its source's word stream: `_from` (long), by a two-level running sum."""
        chunks = max(1, -(-self.rows.count() // CHUNK_ROWS))
        rows = self.rows.select("_row", "_source", "_size", "_hash").withColumn("_chunk", F.pmod("_hash", F.lit(chunks)))
        before = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            rows.groupBy("_source", "_chunk").agg(F.sum("_size").alias("_in_chunk"))
            .select("_source", "_chunk", F.coalesce(F.sum("_in_chunk").over(before), F.lit(0)).alias("_start"))
        )
        within = Window.partitionBy("_source", "_chunk").orderBy("_hash", "_row").rowsBetween(Window.unboundedPreceding, -1)
        inside = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        return inside.join(starts, ["_source", "_chunk"]).select(
            "_row", "_source", "_size", (F.col("_start") + F.col("_inside")).alias("_from")
        )

    def _blocks(self) -> DataFrame:
        """One row for each part of a document in a block: words `_low` to `_high` (exclusive) of it."""
        length = self.block_words
        first, last = F.floor(F.col("_from") / length), F.floor((F.col("_from") + F.col("_size") - 1) / length)
        parts = self._spans().where("_size > 0").select("*", F.explode(F.sequence(first, last)).alias("_block"))
        low = F.greatest(F.col("_block") * length - F.col("_from"), F.lit(0))
        high = F.least((F.col("_block") + 1) * length - F.col("_from"), F.col("_size"))
        return parts.select("_row", "_source", "_block", low.alias("_low"), high.alias("_high"))

    def draws(self) -> DataFrame:
        """(`_source`, `mix_shard`, `_count`, `_start`): how many slots of a source each output shard has.

        A shard's counts are multinomial, conditioned on the sources' quotas: every slot of a source
        draws its shard, and the draws are counted. `_start` numbers a source's slots shard by
        shard, by a running sum over groups of shards and one within each group. Written once: the
        slots are made from the counts.
        """
        blocks = F.ceil(F.col("source_size") / self.block_words)
        quotas = self.targets.where("source_size > 0").select(
            "_source", F.round(F.col("target") * blocks / F.col("source_size")).cast("long").alias("_quota")
        )
        slots = quotas.agg(F.sum("_quota")).first()[0] or 0
        shards = max(1, -(-slots // self.shard_slots))
        runs = quotas.where("_quota > 0").withColumn(
            "_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_quota") - 1) / SLOT_RUN)))
        )
        begin = F.col("_run") * SLOT_RUN
        drawn = self._spread(runs, "_source", "_run").withColumn(
            "_k", F.explode(F.sequence(begin, F.least(begin + SLOT_RUN, F.col("_quota")) - 1))
        )
        shard = F.pmod(F.xxhash64(F.lit(self.seed), F.lit("shard"), "_source", "_k"), F.lit(shards)).cast("int")
        counts = written(drawn.groupBy("_source", shard.alias("mix_shard")).agg(F.count("*").alias("_count")), "mix-draws")
        grouped = counts.withColumn("_group", F.floor(F.col("mix_shard") / SHARD_RUN))
        earlier = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
        groups = (
            grouped.groupBy("_source", "_group").agg(F.sum("_count").alias("_in_group"))
            .select("_source", "_group", F.coalesce(F.sum("_in_group").over(earlier), F.lit(0)).alias("_before"))
        )
        within = Window.partitionBy("_source", "_group").orderBy("mix_shard").rowsBetween(Window.unboundedPreceding, -1)
        inside = grouped.withColumn("_inside", F.coalesce(F.sum("_count").over(within), F.lit(0)))
        return inside.join(groups, ["_source", "_group"]).select(
            "_source", "mix_shard", "_count", (F.col("_before") + F.col("_inside")).alias("_start")
        )

    @staticmethod
    def _spread(rows: DataFrame, *keys: str) -> DataFrame:
        """A fixed number of partitions, which adaptive execution does not fold into one small task."""
        return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def _slots(self) -> DataFrame:
        """(`_source`, `_block`, `mix_shard`, `mix_pass`) for each slot that a shard has drawn."""
        sizes = self.targets.select("_source", F.ceil(F.col("source_size") / self.block_words).alias("_n"))
        slots = self._spread(self.draws().join(sizes, "_source"), "_source", "mix_shard").withColumn(
            "_k", F.explode(F.sequence("_start", F.col("_start") + F.col("_count") - 1))
        )
        source_pass = F.floor(F.col("_k") / F.col("_n"))
        return slots.select(
            "_source", "mix_shard", source_pass.alias("mix_pass"),
            _permuted(F.col("_k") % F.col("_n"), F.col("_n"), [F.col("_source"), source_pass], self.seed).alias("_block"),
        )

    def _drawn(self) -> DataFrame:
        # Slots multiply after their last exchange, so their measured size says nothing: never broadcast.
        return self._blocks().join(self._slots().hint("merge"), ["_source", "_block"])

    def documents(self) -> DataFrame:
        """Every input row with `size`, `source_size`, `target`, `taken` (words, repeats counted) and
        `n_shards`, the number of output shards that have words of it."""
        words = F.sum(F.col("_high") - F.col("_low")).alias("_words")
        taken = (
            self._drawn().groupBy("_row", "mix_shard").agg(words)
            .groupBy("_row").agg(F.sum("_words").alias("_taken"), F.count("*").alias("_n_shards"))
        )
        made = ("size", "source_size", "target", "taken", "n_shards")
        kept = [c for c in self.docs.columns if c not in made]
        return (
            self.rows.join(taken, "_row", "left")
            .join(self.targets.select("_source", "source_size", "target"), "_source")
            .select(*[F.col(f"_record.`{c}`") for c in kept], F.col("_size").alias("size"), "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"), F.coalesce("_n_shards", F.lit(0)).alias("n_shards"))
        )

    def pieces(self) -> DataFrame:
        """The mix itself: a row for each drawn part of a document, its text cut between words.

        All input columns stay, the text being the part with the white space that follows its
        words; `mix_shard`, `mix_pass` and `mix_block` tell the output shard, the pass over the
        source and the block.
        """
        drawn = self._drawn().groupBy("_row").agg(
            F.collect_list(F.struct("_low", "_high", "mix_shard", "mix_pass", F.col("_block").alias("mix_block"))).alias("_parts")
        )
        made = ("mix_shard", "mix_pass", "mix_block")
        columns = [
            F.col("_piece").alias(c) if c == self.text else F.col(f"_record.`{c}`") for c in self.docs.columns if c not in made
        ]
        words = F.regexp_extract_all(f"_record.{self.text}", F.lit(rf"(^[\x20\x09-\x0D]*)?{WORD}[\x20\x09-\x0D]*"), F.lit(0))
        cut = F.array_join(F.slice("_words", (F.col("_part._low") + 1).cast("int"), (F.col("_part._high") - F.col("_part._low")).cast("int")), "")
        return (
            self.rows.join(drawn, "_row")
            .select("_record", words.alias("_words"), F.explode("_parts").alias("_part"))
            .select("_record", "_part", cut.alias("_piece"))
            .select(*columns, *[F.col(f"_part.{c}") for c in made])
        )
