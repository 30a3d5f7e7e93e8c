"""Byte-level BPE ids of whole texts, merged with a segment tree over byte positions."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHED_PIECES = 200_000
CACHED_BYTES = 64
_NONE = 1 << 60

# Fixed value: the public pattern that cuts a text before merging; white space is spelled
# out, because engines differ on the separators U+001C to U+001F.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def load_ranks(path: str = RANK_FILE) -> dict[bytes, int]:
    """Token bytes to id from a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: of all neighbours that form a token, the lowest id first, left first.

    Leaf i of the segment tree holds the id that the live token at byte i makes with the
    next live token; a node holds the least of its leaves, and the descent goes left when
    both sides are equal. A merge touches three leaves, so it costs the logarithm of the
    piece's length, and a piece of any length is merged in n log n.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1
    while size < n:
        size *= 2
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while (least := tree[1]) != _NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != least:
                i += 1
        i -= size
        gone = after[i]
        end = after[gone]
        after[i] = end
        put(gone, _NONE)
        if end < n:
            before[end] = i
            put(i, get(piece[i : after[end]], _NONE))
        else:
            put(i, _NONE)
        left = before[i]
        if left >= 0:
            put(left, get(piece[left:end], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts with a bounded memory of the short pieces met so far."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self._ranks, self._cut, self._known = ranks, regex.compile(PATTERN).findall, {}

    def __call__(self, text: str) -> list[int]:
        known, out = self._known, []
        for piece in self._cut(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = merge_piece(raw, self._ranks)
                if len(raw) <= CACHED_BYTES:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def _over_texts(documents: DataFrame, keep: list[str], result: str, kind: str, rank_file: str, finish) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(load_ranks(rank_file))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(shared.value)
        for pdf in batches:
            out = pdf[keep].copy()
            out[result] = [finish(encode(t)) if isinstance(t, str) else finish([]) for t in pdf["text"]]
            yield out

    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{result} {kind}"])
    return documents.select(*keep, "text").mapInPandas(rows, schema)


def text_ids(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """(doc_id, ids): the token ids of every text, null and empty texts an empty list.

    Texts are whole; strings that look like special tokens are ordinary text. Each row is
    encoded where it lies, without a shuffle. The vocabulary, bounded by its file, is read
    on the driver and broadcast, so executors need no copy of it. Repeated doc_ids give
    repeated rows.
    """
    return _over_texts(documents, ["doc_id"], "ids", "array<int>", rank_file, lambda ids: ids)


def text_lengths(documents: DataFrame, keep: list[str], rank_file: str = RANK_FILE) -> DataFrame:
    """``keep`` and n_tokens, the number of ids of every text, null and empty texts 0."""
    return _over_texts(documents, keep, "n_tokens", "bigint", rank_file, len)
