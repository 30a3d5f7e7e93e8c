"""Subjects of documents: averaged word and subword embeddings with independent logistic outputs."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normalize_label
from quillon.session import cut, small_side

BUCKETS = 1 << 15
DIM = 16
NGRAMS = (3, 4, 5)
MAX_LABELED = 20_000
TRAIN_PARTS = 8
DOC_ROUNDS = 8
SENTENCE_ROUNDS = 14
LOCAL_STEPS = 5
RATE = 0.05
SEED = 9
SURE = 0.4
LEAST_SHARE = 0.25
CACHED_WORDS = 300_000

_UNSEEN = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")
_BREAK = re.compile(r"[\r\n]+|(?<=[.!?])[\"')\]]*,?\s+")
_WORD = re.compile(r"[^\W\d_]+")


def sentence_words(text: str | None) -> list[list[str]]:
    """The sentences of a text as lists of lower-case words; sentences without a word are none.

    Line ends and ``. ! ?`` before white space end a sentence. Soft hyphens and zero-width
    characters are dropped first. Null, empty and blank texts have no sentences.
    """
    if not isinstance(text, str):
        return []
    found = (_WORD.findall(s) for s in _BREAK.split(_UNSEEN.sub("", text).lower()))
    return [w for w in found if w]


def word_features(word: str) -> list[int]:
    """Buckets of a word: itself and its n-grams, with marks at both ends."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g.encode()) % BUCKETS for g in [f"={word}", *sorted(grams)]]


@dataclass
class SubjectModel:
    """Embeddings of the buckets, output weights and biases, and the names of the outputs."""

    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    subjects: list[str]


class _Lookup:
    """Word number and output contribution of each word met, forgotten when it grows too large."""

    def __init__(self, model: SubjectModel):
        self.model, self.number, self.parts = model, {}, np.zeros((1024, len(model.bias)), dtype=np.float32)

    def numbers(self, words: list[str]) -> list[int]:
        known, out = self.number, []
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = len(known)
                if k >= len(self.parts):
                    self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
                self.parts[k] = self.model.table[word_features(w)].mean(axis=0) @ self.model.weights
            out.append(k)
        return out

    def trim(self) -> None:
        if len(self.number) > CACHED_WORDS:
            self.number, self.parts = {}, np.zeros((1024, len(self.model.bias)), dtype=np.float32)


def _means(rows: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0) / counts[:, None].astype(rows.dtype)


def _packed(subjects: list[str]):
    """Labelled documents to one blob a partition: words, sentences and labels as arrays.

    The orders in which a step gathers what flows back to words and to buckets never
    change, so they are sorted here, once.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: dict[str, int] = {}
        tokens, s_len, d_len, labels = [], [], [], []
        for pdf in batches:
            for text, names in pdf[["text", "labels"]].itertuples(index=False):
                sentences = sentence_words(text)
                if not sentences:
                    continue
                for s in sentences:
                    tokens += [number.setdefault(w, len(number)) for w in s]
                    s_len.append(len(s))
                d_len.append(len(sentences))
                named = set(names)
                labels.append([n in named for n in subjects])
        if not d_len:
            return
        feats = [word_features(w) for w in number]
        f_len, t = np.array([len(f) for f in feats]), np.array(tokens)
        used, at = np.unique(np.concatenate([np.asarray(f, dtype=np.int32) for f in feats]), return_inverse=True)
        f_order, t_order = np.argsort(at, kind="stable"), np.argsort(t, kind="stable")
        blob = {
            "used": used, "feats": at, "f_len": f_len, "f_word": np.repeat(np.arange(len(f_len)), f_len)[f_order],
            "f_start": _starts(np.bincount(at)), "tokens": t, "s_len": np.array(s_len), "d_len": np.array(d_len),
            "t_sent": np.repeat(np.arange(len(s_len)), s_len)[t_order], "t_start": _starts(np.bincount(t)),
            "y": np.array(labels, dtype=np.float32),
        }
        yield pd.DataFrame({"blob": [pickle.dumps(blob)]})

    return rows


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]])


def sentence_targets(z: np.ndarray, doc: np.ndarray, y: np.ndarray, d_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Targets and weights of sentences, from outputs ``z`` and the labels of their documents.

    A sentence takes, of its document's subjects, the one with the largest output, if that
    is likely or among the document's best for it; so every labelled subject keeps some
    sentences. A likely output that the document's labels do not name may be a passing
    mention and has no weight.
    """
    allowed = y[doc] > 0
    inside = np.where(allowed, z, -np.inf)
    best = inside.argmax(axis=1)
    any_ = allowed.any(axis=1)
    top = np.where(any_, inside[np.arange(len(z)), best], -np.inf)
    group = doc * z.shape[1] + best
    order = np.lexsort((-top, group))
    ranked = np.empty(len(z))
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(z)), 0))
    ranked[order] = np.arange(len(z)) - first
    keep = any_ & ((top > 0) | (ranked < np.ceil(0.25 * d_len[doc] / np.maximum(1, y.sum(axis=1)[doc]))))
    t = np.zeros_like(z)
    t[np.flatnonzero(keep), best[keep]] = 1.0
    w = np.where((z > 2.0) & (t == 0), 0.0, 1.0)
    return t, w


def _gradient(b: dict, table: np.ndarray, weights: np.ndarray, bias: np.ndarray, per_sentence: bool) -> list[np.ndarray]:
    """The mean gradient of the logistic loss over a blob; ``table`` holds its buckets alone."""
    words = _means(table[b["feats"]], _starts(b["f_len"]), b["f_len"])
    sent = _means(words[b["tokens"]], _starts(b["s_len"]), b["s_len"])
    doc = np.repeat(np.arange(len(b["d_len"])), b["d_len"])
    if per_sentence:
        h = sent
        z = h @ weights + bias
        y, w = sentence_targets(z, doc, b["y"], b["d_len"])
    else:
        h = _means(sent, _starts(b["d_len"]), b["d_len"])
        z = h @ weights + bias
        y, w = b["y"], np.ones_like(z)
    g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * w / len(h)).astype(table.dtype)
    dh = g @ weights.T
    over = lambda x, n: x / n[:, None].astype(x.dtype)
    if not per_sentence:
        dh = over(dh, b["d_len"])[doc]
    d_words = np.add.reduceat(over(dh, b["s_len"])[b["t_sent"]], b["t_start"], axis=0)
    d_table = np.add.reduceat(over(d_words, b["f_len"])[b["f_word"]], b["f_start"], axis=0)
    return [d_table, h.T @ g, g.sum(axis=0)]


def _local(model, per_sentence: bool, steps: int):
    """One row a blob: how far ``steps`` gradient steps on its rows move the shared model."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: SubjectModel = model.value
        for pdf in batches:
            for raw in pdf["blob"]:
                b = pickle.loads(raw)
                was = [m.table[b["used"]], m.weights, m.bias]
                own = [x.copy() for x in was]
                adam = _Adam([x.shape for x in own])
                for _ in range(steps):
                    adam.step(own, _gradient(b, *own, per_sentence), RATE)
                moved = [x - y for x, y in zip(own, was, strict=True)]
                yield pd.DataFrame({"blob": [pickle.dumps((b["used"], *moved, len(b["d_len"])))]})

    return rows


class _Adam:
    def __init__(self, shapes):
        self.m, self.v, self.t = [np.zeros(s, dtype=np.float32) for s in shapes], [np.zeros(s, dtype=np.float32) for s in shapes], 0

    def step(self, values, grads, rate):
        self.t += 1
        for i, (x, g) in enumerate(zip(values, grads, strict=True)):
            self.m[i] = np.float32(0.9) * self.m[i] + np.float32(0.1) * g
            self.v[i] = np.float32(0.99) * self.v[i] + np.float32(0.01) * g * g
            x -= np.float32(rate / (1 - 0.9**self.t)) * self.m[i] / (np.sqrt(self.v[i] / np.float32(1 - 0.99**self.t)) + np.float32(1e-8))


def labelled_documents(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_docs: int = MAX_LABELED) -> DataFrame:
    """(doc_id, text, labels): labelled documents with the subjects that they name after N.

    Labels that no subject has, ``none`` among them, add nothing; a document that only has
    such labels has an empty list. Above ``max_docs`` documents, the sample's documented
    bound, those with the smallest hashes of doc_id are kept, about as many as the bound.
    The named documents are thus few at every size and are sent to the texts, which never
    move.
    """
    names = areas.select(normalize_label(F.col("subject")).alias("name"), F.col("subject").alias("subject")).distinct()
    tidy = labels.where("doc_id is not null").select("doc_id", normalize_label(F.col("subject")).alias("name")).distinct()
    named = tidy.join(F.broadcast(names), "name", "left").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    named = cut(named)
    n = named.count()
    if n > max_docs:
        named = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_docs)
    return documents.where("text is not null").select("doc_id", "text").join(small_side(named, 2 * max_docs), "doc_id")


def train_subjects(
    labelled: DataFrame, subjects: list[str], seed: int = SEED,
    doc_rounds: int = DOC_ROUNDS, sentence_rounds: int = SENTENCE_ROUNDS, local_steps: int = LOCAL_STEPS,
) -> SubjectModel:
    """The model from (text, labels) rows, by gradient steps synchronised over partitions.

    In each round the model is broadcast, every partition takes ``local_steps`` gradient
    steps on its rows, and the model moves by the mean of their moves, weighted by
    documents; a bucket's embedding by the mean over the partitions that hold it. Rows are
    packed to arrays once, one blob a partition, and checkpointed. A partition returns at
    most the embedding table (BUCKETS x DIM floats), and there are TRAIN_PARTS, so what
    reaches the driver in a round is bounded. The first rounds fit documents as averages of
    their sentences; the rest fit sentences, with targets that the document's labels and
    the model so far allow. Without labelled rows the model predicts nothing.
    """
    spark = labelled.sparkSession
    rng = np.random.default_rng(seed)
    model = SubjectModel(
        (rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM).astype(np.float32),
        np.zeros((DIM, len(subjects)), dtype=np.float32), np.full(len(subjects), -2.0, dtype=np.float32), subjects,
    )
    packed = cut(labelled.repartition(TRAIN_PARTS, "doc_id").sortWithinPartitions("doc_id").mapInPandas(_packed(subjects), "blob binary"))
    for turn in range(doc_rounds + sentence_rounds):
        shared = spark.sparkContext.broadcast(model)
        parts = packed.mapInPandas(_local(shared, turn >= doc_rounds, local_steps), "blob binary").collect()
        shared.destroy()
        if not parts:
            return model
        moves = [pickle.loads(row["blob"]) for row in parts]
        d_table, held, n = np.zeros(model.table.shape), np.zeros((BUCKETS, 1)), sum(m[4] for m in moves)
        for used, t, w, b, k in moves:
            d_table[used] += k * t
            held[used] += k
            model.weights += w * np.float32(k / n)
            model.bias += b * np.float32(k / n)
        model.table += (d_table / np.maximum(held, 1)).astype(np.float32)
    return model


def sentence_subjects(documents: DataFrame, model: SubjectModel, keep: list[str]) -> DataFrame:
    """``keep``, n_sentences, n_about and counts: sentences of every text by subject, whole texts.

    The outputs are independent: a sentence is about each subject whose output gives a
    chance above SURE, so about none, one or several; ``n_about`` sentences are about at
    least one. Null and empty texts have no sentences. No shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kinds = dict(documents.dtypes)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        look, s = _Lookup(m), len(m.subjects)
        for pdf in batches:
            counts = np.zeros((len(pdf), s), dtype=np.int64)
            total, about = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            tokens, s_len, owner = [], [], []
            for i, text in enumerate(pdf["text"]):
                for words in sentence_words(text):
                    tokens += look.numbers(words)
                    s_len.append(len(words))
                    owner.append(i)
            if tokens:
                lens, own = np.array(s_len), np.array(owner)
                z = _means(look.parts[np.array(tokens)], _starts(lens), lens) + m.bias
                sure = z > np.log(SURE / (1 - SURE))
                at, which = np.nonzero(sure)
                np.add.at(counts, (own[at], which), 1)
                total = np.bincount(own, minlength=len(pdf))
                about = np.bincount(own[sure.any(axis=1)], minlength=len(pdf))
            out = pdf[keep].copy()
            out["n_sentences"], out["n_about"], out["counts"] = total, about, list(counts)
            look.trim()
            yield out

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_sentences bigint, n_about bigint, counts array<bigint>"])
    return documents.select(*keep, "text").mapInPandas(rows, schema)


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, subject, share): subjects with at least ``least_share`` of the document's
    sentences that have a subject. Documents without such sentences have no row, nor has any without subjects.
    """
    subjects = sorted(r["subject"] for r in areas.where("subject is not null").select("subject").distinct().collect())
    if not subjects:
        return documents.limit(0).select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("share"))
    model = train_subjects(labelled_documents(documents, labels, areas), subjects)
    counted = sentence_subjects(documents, model, ["doc_id"])
    each = F.transform(F.col("counts"), lambda c, i: F.struct(F.get(F.array(*[F.lit(x) for x in subjects]), i).alias("subject"), (c / F.col("n_about")).alias("share")))
    return (
        counted.where("n_about > 0")
        .select("doc_id", F.inline(F.filter(each, lambda x: x["share"] >= least_share)))
    )
