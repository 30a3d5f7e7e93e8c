"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import trim_lower
from quillon.llm.byte_bpe import RANK_FILE, text_lengths
from quillon.operators.prefix import running_total
from quillon.session import cut, small_side

BLOCK_TOKENS = 1024
SEED = 8
_LIMB = 2**24
_TURN = _LIMB * _LIMB
_GOLDEN = 173961102589771
_PIECE_SLOTS = 65_536


def document_tokens(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """(doc_id, source after T, n_tokens), each doc_id once; a null source is ''.

    Rows without a doc_id are left out; of repeated doc_ids the longest text counts.
    """
    kept = documents.where("doc_id is not null").select("doc_id", F.coalesce(trim_lower(F.col("source")), F.lit("")).alias("source"), "text")
    lengths = text_lengths(kept, ["doc_id", "source"], rank_file)
    return lengths.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens")


def mixture_goals(targets: DataFrame) -> DataFrame:
    """(mix_id, source, weight, max_repeats, budget), each mix and source once.

    Sources are compared after T. Rows without mix_id or source are left out; null weights,
    budgets and repeats count as 0; of repeated rows the largest numbers count.
    """
    zero = F.lit(0)
    return (
        targets.where("mix_id is not null and source is not null")
        .groupBy("mix_id", trim_lower(F.col("source")).alias("source"))
        .agg(
            F.max(F.coalesce("target_weight", zero.cast("double"))).alias("weight"),
            F.max(F.coalesce("max_repeats", zero)).alias("max_repeats"),
            F.max(F.coalesce("budget_tokens", zero)).alias("budget"),
        )
    )


def shuffled_blocks(tokens: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, block, at, doc_id, from_token, to_token): sources as streams cut into equal blocks.

    Documents are ordered by a hash of doc_id and seed; a text that crosses a border is cut
    there, so every block but a source's last has exactly ``block_tokens`` tokens; ``at``
    is the place of a piece's first token in the stream. The running position is taken piece by piece of the hash range, so a source of any size is
    spread over many tasks.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    placed = running_total(
        tokens.where("n_tokens > 0").withColumn("h", h).withColumn("piece", F.shiftright("h", 52)),
        ["source"], "piece", ["h", "doc_id"], F.col("n_tokens"), "start",
    )
    end = F.col("start") + F.col("n_tokens")
    span = F.sequence(F.floor(F.col("start") / block_tokens), F.floor((end - 1) / block_tokens))
    low, high = F.greatest("start", F.col("block") * block_tokens), F.least(end, (F.col("block") + 1) * block_tokens)
    return placed.withColumn("block", F.explode(span)).select(
        "source", "block", low.alias("at"), "doc_id", (low - F.col("start")).alias("from_token"), (high - F.col("start")).alias("to_token")
    )


def golden_point(slot: Column) -> Column:
    """The fractional part of (slot + 1) times the golden ratio, to 48 bits.

    The product is taken modulo 2**48 in two limbs of 24 bits, so no step leaves the range
    of a bigint, whatever the slot.
    """
    s = F.pmod(slot, F.lit(_TURN)) + 1
    low, high = F.pmod(s, F.lit(_LIMB)), F.pmod(F.floor(s / _LIMB), F.lit(_LIMB))
    g_low, g_high = _GOLDEN % _LIMB, _GOLDEN // _LIMB
    cross = F.pmod(low * F.lit(g_high) + high * F.lit(g_low), F.lit(_LIMB))
    return F.pmod(low * F.lit(g_low) + cross * F.lit(_LIMB), F.lit(_TURN)) / F.lit(float(_TURN))


def slot_schedule(goals: DataFrame, totals: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_id, slot, source, rank, source_tokens, start, n_tokens): what each slot takes.

    A mix has as many slots as blocks fit its budget. Slot i falls at the golden-ratio
    point of i; the cumulative weights of the mix map the point to a source, so that every
    stretch of slots holds each source's share but for a few slots. The slots of a source
    are ranked in order and take one block after another of the source repeated without a
    gap max_repeats times, slot rank r from token r * block_tokens on; the last of them may
    be partial, and slots after it stay empty.
    """
    order = Window.partitionBy("mix_id").orderBy("source")
    total = F.sum("weight").over(Window.partitionBy("mix_id"))
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    arcs = goals.where("weight > 0").select(
        "mix_id", "source", "max_repeats",
        ((upto - F.col("weight")) / total).alias("lo"),
        F.when(F.lead("source").over(order).isNull(), F.lit(2.0)).otherwise(upto / total).alias("hi"),
    )
    arcs = cut(arcs.join(totals, "source", "left").fillna(0, ["source_tokens"]))
    slots = goals.groupBy("mix_id").agg(F.ceil(F.max("budget") / block_tokens).alias("n")).where("n > 0")
    pieces = slots.select("mix_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _PIECE_SLOTS))).alias("piece"))
    first = F.col("piece") * _PIECE_SLOTS
    each = pieces.select("mix_id", "piece", F.explode(F.sequence(first, F.least(F.col("n"), first + _PIECE_SLOTS) - 1)).alias("slot"))
    drawn = each.withColumn("u", golden_point(F.col("slot"))).join(small_side(arcs), "mix_id").where("lo <= u and u < hi")
    ranked = running_total(drawn, ["mix_id", "source"], "piece", ["slot"], F.lit(1), "rank")
    start = F.col("rank").cast("bigint") * block_tokens
    left = F.col("source_tokens") * F.col("max_repeats") - start
    size = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(block_tokens).cast("bigint"), left))
    return ranked.select("mix_id", "slot", "source", "rank", "source_tokens", start.alias("start"), size.alias("n_tokens"))


def slot_pieces(schedule: DataFrame, blocks: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_id, slot, source, repeat, doc_id, from_token, to_token): the documents of each slot.

    A slot is cut where a round of its source ends, each part meets the blocks it touches,
    and pieces of one document in a part, cut at a block border, become one again.
    """
    whole, end = F.col("source_tokens"), F.col("start") + F.col("n_tokens")
    parts = (
        schedule.where("n_tokens > 0")
        .withColumn("repeat", F.explode(F.sequence(F.floor(F.col("start") / whole), F.floor((end - 1) / whole))))
        .withColumn("lo", F.greatest(F.col("start") - F.col("repeat") * whole, F.lit(0)))
        .withColumn("hi", F.least(end - F.col("repeat") * whole, whole))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block_tokens), F.floor((F.col("hi") - 1) / block_tokens))))
    )
    before = F.greatest(F.col("lo") - F.col("at"), F.lit(0))
    after = F.greatest(F.col("at") + F.col("to_token") - F.col("from_token") - F.col("hi"), F.lit(0))
    met = parts.select("mix_id", "slot", "source", "repeat", "lo", "hi", "block").join(blocks, ["source", "block"])
    met = met.select("mix_id", "slot", "source", "repeat", "doc_id", (F.col("from_token") + before).alias("f"), (F.col("to_token") - after).alias("t")).where("f < t")
    return met.groupBy("mix_id", "slot", "source", "repeat", "doc_id").agg(F.min("f").alias("from_token"), F.max("t").alias("to_token"))


def mix_sources(documents: DataFrame, targets: DataFrame, rank_file: str = RANK_FILE, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) for every mix of ``targets``.

    ``mixture`` is (mix_id, slot, source, repeat, doc_id, from_token, to_token), ``report``
    one row a mix and source: weight, target_tokens, source_tokens, capacity (tokens times
    max_repeats), n_slots, mixed_tokens, actual_share of the mix, holding_tokens (the largest
    total at which every source of the mix can still give its weight; beyond it the short
    sources leave slots empty, and the actual shares of the others lie above their
    weights) and short: the schedule gave the source
    fewer tokens than weight times budget, and, checked exactly, its capacity is less; a
    source that only rounding to whole blocks keeps under its target is not short. Sources
    no document has get zeros; documents of sources a mix does not name are not drawn.
    Empty tables give empty results.
    """
    tokens = cut(document_tokens(documents, rank_file))
    totals = cut(tokens.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens")))
    goals = cut(mixture_goals(targets))
    schedule = cut(slot_schedule(goals, totals, block_tokens))
    mixture = slot_pieces(schedule, shuffled_blocks(tokens, block_tokens), block_tokens)
    used = schedule.groupBy("mix_id", "source").agg(F.count("*").alias("n_slots"), F.sum("n_tokens").alias("mixed_tokens"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy("mix_id"))
    want = F.col("weight") * F.col("budget")
    capacity = F.col("source_tokens") * F.col("max_repeats")
    holding = F.min(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))).over(Window.partitionBy("mix_id"))
    report = (
        goals.join(totals, "source", "left")
        .join(used, ["mix_id", "source"], "left")
        .fillna(0, ["source_tokens", "n_slots", "mixed_tokens"])
        .withColumn("capacity", capacity)
        .select(
            "mix_id", "source", "weight", want.alias("target_tokens"), "source_tokens", "capacity", "n_slots", "mixed_tokens",
            F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0).alias("actual_share"), holding.alias("holding_tokens"),
            ((F.col("mixed_tokens") < want) & (F.col("capacity") < want)).alias("short"),
        )
    )
    return mixture, report
