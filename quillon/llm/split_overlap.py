"""Records of evaluation splits that the training split also holds, exactly or nearly.

A record carries a 64-bit hash and a checksum. Both become passages: the hash is cut into
pieces, four more than are kept, and each choice of kept pieces is one passage, tagged with
the choice. Hashes that differ in at most four bits leave that many pieces untouched, so
they share a passage; this is exact, not a guess. The number of pieces follows from the
number of hashes, so that a passage is rare at every size. Evaluation passages, sharded by
their hash, fill Aho-Corasick automata; all training passages of a shard are scanned as
running text, and the matched intervals are merged into the bits of an evaluation record
that are covered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.bits import hash64
from quillon.functions.text import present, split_name, trim_lower
from quillon.llm.match_groups import matching_pairs
from quillon.session import cut, parallelism, small_side

MAX_BITS = 4
MOST_PIECES = 12
PASSAGES_A_SHARD = 100_000
HOT_OWNERS = 10_000
CANDIDATES_AT_ONCE = 1_000_000
_CHECKSUM = -1
_HITS = "kind string, train_value string, eval_value string, covered int, bits int"


def piece_widths(n: int) -> list[int]:
    """Widths of the pieces of a hash for ``n`` distinct hashes, low bits first.

    The kept pieces together hold at least log2 n + 1 bits, so that a passage of unrelated
    hashes has about one owner, and candidates grow about as n.
    """
    for m in range(MAX_BITS + 2, MOST_PIECES + 1):
        if (64 // m) * (m - MAX_BITS) >= math.log2(max(2, n)) + 1:
            break
    return [64 // m + (i < 64 % m) for i in range(m)]


def _choices(widths: list[int]) -> list[tuple[int, ...]]:
    return list(combinations(range(len(widths)), len(widths) - MAX_BITS))


def _passages(values: DataFrame, widths: list[int]) -> DataFrame:
    """(value, choice, passage) from (kind, value): value is the hash as text or the checksum."""
    h, pieces, low = F.col("value").cast("bigint"), [], 0
    for w in widths:
        part = F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << w) - 1).cast("bigint"))
        pieces.append(F.lpad(F.lower(F.hex(part)), -(-w // 4), "0"))
        low += w
    one = lambda k, *text: F.struct(F.lit(k).alias("choice"), F.concat(F.lit(f"<{k:x}:"), *text, F.lit(";")).alias("passage"))
    of_hash = F.array(*[one(k, *[pieces[i] for i in c]) for k, c in enumerate(_choices(widths))])
    of_sum = F.array(one(_CHECKSUM, F.sha2("value", 256)))
    return values.select("value", F.inline(F.when(F.col("kind") == "hash", of_hash).otherwise(of_sum)))


def _scan(widths: list[int]):
    """Rows come by shard, evaluation first; one automaton is held at a time."""
    masks = np.array([*(sum(1 << i for i in c) for c in _choices(widths)), (1 << len(widths)) - 1], dtype=np.int32)

    def verified(auto, held: list[np.ndarray], train: pd.DataFrame) -> Iterator[pd.DataFrame]:
        texts, owners, choice = train["passage"].tolist(), train["value"].to_numpy(), train["choice"].to_numpy()
        ends = np.cumsum([len(t) for t in texts]) - 1
        rows, hits = [], []
        for end, k in auto.iter("".join(texts)):
            rows.append(end)
            hits.append(k)
        if not rows:
            return
        rows = np.searchsorted(ends, np.asarray(rows))
        lengths = np.array([len(held[k]) for k in hits])
        upto = np.cumsum(lengths)
        start = 0
        while start < len(rows):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + CANDIDATES_AT_ONCE)))
            at = np.repeat(rows[start:stop], lengths[start:stop])
            mine, found = owners[at], np.concatenate([held[k] for k in hits[start:stop]])
            near = choice[at] != _CHECKSUM
            bits = np.zeros(len(at), dtype=np.int32)
            if near.any():
                bits[near] = np.bitwise_count(mine[near].astype(np.int64).view(np.uint64) ^ found[near].astype(np.int64).view(np.uint64))
            keep = bits <= MAX_BITS
            kind = np.where(near, "hash", "checksum")
            yield pd.DataFrame({"kind": kind[keep], "train_value": mine[keep], "eval_value": found[keep], "covered": masks[choice[at]][keep], "bits": bits[keep]})
            start = stop

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        shard, auto, ready, held, index = None, None, False, [], {}
        for pdf in batches:
            for key, part in pdf.groupby("shard", sort=True):
                if key != shard:
                    shard, auto, ready, held, index = key, ahocorasick.Automaton(), False, [], {}
                for text, value in part.loc[part["side"] == 0, ["passage", "value"]].itertuples(index=False):
                    k = index.get(text)
                    if k is None:
                        k = index[text] = len(held)
                        held.append([])
                        auto.add_word(text, k)
                    held[k].append(value)
                train = part[part["side"] == 1]
                if len(train) and len(held):
                    if not ready:
                        auto.make_automaton()
                        held = [np.array(v, dtype=object) for v in held]
                        ready = True
                    yield from verified(auto, held, train)

    return rows


def _split_hot(sides: DataFrame, hot_owners: int) -> DataFrame:
    """``sides`` with the passages of many evaluation records cut into a grid of parts.

    Owners and training texts of such a passage are each dealt to parts of about
    ``hot_owners``; an owner meets the texts part by part, so every pair still meets, once,
    and no task holds more owners or reads more texts of one passage than the bound.
    """
    p = F.xxhash64("passage")
    owners = cut(sides.where("side = 0").groupBy(p.alias("p")).agg(F.count("*").alias("owners")).where(F.col("owners") > hot_owners))
    if owners.isEmpty():
        return sides
    texts = sides.where("side = 1").withColumn("p", p).join(small_side(owners.select("p")), "p", "left_semi").groupBy("p").agg(F.count("*").alias("texts"))
    parts = lambda c: F.greatest(F.lit(1).cast("bigint"), F.ceil(F.coalesce(c, F.lit(0)) / hot_owners))
    grid = cut(owners.join(texts, "p", "left").select(F.col("p").alias("hot"), parts(F.col("owners")).alias("across"), parts(F.col("texts")).alias("down")))
    tagged = sides.withColumn("p", p).join(small_side(grid), F.col("p") == F.col("hot"), "left")
    own = lambda n: F.array(F.pmod(F.xxhash64("value"), n))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    dealt = (
        tagged.where("hot is not null")
        .withColumn("i", F.explode(F.when(F.col("side") == 0, own(F.col("across"))).otherwise(every(F.col("across")))))
        .withColumn("j", F.explode(F.when(F.col("side") == 1, own(F.col("down"))).otherwise(every(F.col("down")))))
        .withColumn("passage", F.concat("passage", F.col("i").cast("string"), F.lit(","), F.col("j").cast("string"), F.lit(";")))
    )
    return tagged.where("hot is null").select(*sides.columns).union(dealt.select(*sides.columns))


def overlapping_values(evaluation: DataFrame, training: DataFrame, shards: int | None = None, widths: list[int] | None = None, hot_owners: int | None = None) -> DataFrame:
    """(kind, train_value, eval_value, covered, bits) for equal checksums and hashes within four bits.

    Both inputs are (kind, value), kind ``hash`` (a bigint as text) or ``checksum``, each
    value once. ``covered`` is the mask of pieces under the merged matched intervals,
    ``bits`` the Hamming distance. The sides are counted to choose the pieces and to size
    the shards, so an automaton holds about PASSAGES_A_SHARD passages however large the
    side is; every passage meets every training passage of its own shard once, so the scan
    is linear in both sides. Null values match nothing.
    """
    spark = evaluation.sparkSession
    evaluation, training = cut(evaluation.where("value is not null")), cut(training.where("value is not null"))
    n = evaluation.count()
    widths = widths or piece_widths(max(n, training.count()))
    if shards is None:
        shards = max(parallelism(spark), -(-n * len(_choices(widths)) // PASSAGES_A_SHARD))
    sides = _passages(evaluation, widths).withColumn("side", F.lit(0)).unionByName(_passages(training, widths).withColumn("side", F.lit(1)))
    routed = _split_hot(sides, hot_owners or HOT_OWNERS).withColumn("shard", F.pmod(F.xxhash64("passage"), F.lit(shards)))
    hits = routed.repartition(shards, "shard").sortWithinPartitions("shard", "side").mapInPandas(_scan(widths), _HITS)
    return hits.groupBy("kind", "train_value", "eval_value").agg(F.bit_or("covered").alias("covered"), F.min("bits").alias("bits"))


def unique_images(images: DataFrame) -> DataFrame:
    """(image_id, split, source, checksum, hash), one row an image after T.

    Repeated rows of an image hold the same values in other spellings; a value missing in
    one of them is taken from another. Ids that are null or blank are no images.
    """
    checksum = F.when(present(F.col("sha256")), trim_lower(F.col("sha256")))
    return (
        images.where(present(F.col("image_id")))
        .select(
            trim_lower(F.col("image_id")).alias("image_id"),
            split_name(F.col("split")).alias("split"),
            trim_lower(F.col("source")).alias("source"),
            checksum.alias("checksum"),
            hash64(F.col("average_hash")).alias("hash"),
        )
        .groupBy("image_id")
        .agg(*[F.min(c).alias(c) for c in ("split", "source", "checksum", "hash")])
    )


def _held(images: DataFrame, key: str, name: str) -> DataFrame:
    """(name, kind, value): the hash and the checksum that a row with ``key`` holds."""
    kinds = F.array(
        F.struct(F.lit("hash").alias("kind"), F.col("hash").cast("string").alias("value")),
        F.struct(F.lit("checksum").alias("kind"), F.col("checksum").alias("value")),
    )
    return images.select(F.col(key).alias(name), F.inline(kinds)).where("value is not null")


def _hits(train: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """(train_key, eval_key, covered_bits, bits) of rows that share a checksum or have near hashes."""
    t, e = _held(train, key, "train_key"), _held(evaluation, key, "eval_key")
    n = max(train.count(), evaluation.count())
    widths = piece_widths(n)
    values = overlapping_values(e.select("kind", "value").distinct(), t.select("kind", "value").distinct(), widths=widths)
    width = F.lit(0)
    for i, w in enumerate(widths):
        width = width + F.when(F.col("covered").bitwiseAND(1 << i) != 0, w).otherwise(0)
    hits = cut(values).withColumn("covered_bits", width)
    both = hits.join(t.withColumnRenamed("value", "train_value"), ["kind", "train_value"]).join(e.withColumnRenamed("value", "eval_value"), ["kind", "eval_value"])
    return both.groupBy("train_key", "eval_key").agg(F.max("covered_bits").alias("covered_bits"), F.min("bits").alias("bits"))


def _listed(train: DataFrame, evaluation: DataFrame, audit: DataFrame, keep: list[str]) -> DataFrame:
    """The audit's matches between a training and an evaluation image, with ``keep`` of both."""
    m = matching_pairs(audit)
    both = m.union(m.select("right_id", "left_id")).distinct()
    side = lambda images, name: images.select(*[F.col(c).alias(f"{name}_{c}") for c in keep])
    return both.join(side(train, "train"), F.col("left_id") == F.col("train_image_id")).join(side(evaluation, "eval"), F.col("right_id") == F.col("eval_image_id")).drop("left_id", "right_id")


def cross_split_pairs(images: DataFrame, audit: DataFrame) -> DataFrame:
    """(train_id, eval_id, covered_bits, bits, listed): every overlap, one row a pair.

    A pair holds a training image and one of validation or test that share a checksum,
    have hashes within four bits, or are a match of the audit (``listed``). Values shared
    by many images are compared once and expanded to image pairs at the end. Images
    without a split, checksum or hash take part with what they have.
    """
    known = cut(unique_images(images))
    train, evaluation = known.where("split = 'train'"), known.where("split in ('validation', 'test')")
    found = _hits(train, evaluation, "image_id").select(F.col("train_key").alias("train_id"), F.col("eval_key").alias("eval_id"), "covered_bits", "bits", F.lit(False).alias("listed"))
    none = F.lit(None).cast("int")
    listed = _listed(train, evaluation, audit, ["image_id"]).select(
        F.col("train_image_id").alias("train_id"), F.col("eval_image_id").alias("eval_id"), none.alias("covered_bits"), none.alias("bits"), F.lit(True).alias("listed")
    )
    return found.unionByName(listed).groupBy("train_id", "eval_id").agg(
        F.max("covered_bits").alias("covered_bits"), F.min("bits").alias("bits"), F.max("listed").alias("listed")
    )


def overlap_report(images: DataFrame, audit: DataFrame) -> DataFrame:
    """By evaluation split and source: images, images with an overlap, pairs, exact pairs.

    Images with the same hash and checksum form one class; pairs are found between classes
    and counted from their sizes, so no pair of images is built to be counted. Matches that
    only the audit lists are added image by image. A source that is null forms a row of its
    own. Splits without overlap have zeros.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = cut(unique_images(images).withColumn("class", F.concat_ws("|", text("hash"), text("checksum"))))
    train, evaluation = known.where("split = 'train'"), known.where("split in ('validation', 'test')")
    classes = lambda side: cut(side.groupBy("class", "hash", "checksum").agg(F.count("*").alias("n")))
    of_train, of_eval = classes(train), classes(evaluation)
    pairs = cut(_hits(of_train, of_eval, "class"))
    sized = pairs.join(of_train.select(F.col("class").alias("train_key"), "n"), "train_key")
    per_class = sized.groupBy(F.col("eval_key").alias("class")).agg(
        F.sum("n").alias("pairs"), F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("exact"), F.max("covered_bits").alias("most")
    )
    only = _listed(train, evaluation, audit, ["image_id", "class"]).join(
        pairs, (F.col("train_class") == F.col("train_key")) & (F.col("eval_class") == F.col("eval_key")), "left_anti"
    )
    more = only.groupBy(F.col("eval_image_id").alias("image_id")).agg(F.count("*").alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = evaluation.join(per_class, "class", "left").join(more, "image_id", "left").withColumn("k", zero(F.col("pairs")) + zero(F.col("more")))
    return each.groupBy("split", "source").agg(
        F.count("*").alias("n_images"), F.count_if(F.col("k") > 0).alias("n_overlapping"), F.sum("k").alias("n_pairs"),
        zero(F.sum("exact")).alias("n_exact_pairs"), zero(F.max("most")).alias("most_covered_bits"),
    )
