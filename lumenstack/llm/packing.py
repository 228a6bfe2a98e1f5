"""Best-fit packing of tokenised documents into sequences.

Documents become pieces: their ids and an end mark, cut only where they are longer than a sequence, with the remainder first. Pieces are dealt at random into
shards of some thousands, each with about the same mix of lengths, and each shard is packed by itself: the longest piece first, into the
bin that fits it best. A bin has three residual capacities, tokens, documents and attention cost (the squares of the pieces' lengths); a
piece goes only where it exceeds none of them. Of those bins it takes the one of the largest weighted dot-product of its needs and the residuals ("dot"), or of the
smallest weighted norm of what would be left ("norm"). Both count in shares of the capacities. A shard ends with a few bins that
are not full, against thousands that are.

Cases: a null text is an empty one, which is the end mark alone. Rows of one id, or without, are documents of their own. A very long text is tokenised whole. A piece that alone exceeds a capacity gets a bin of its own. Only doc_id and text are read, so other columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, tune

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces in a shard, on average.
SHARD = 6_000
#: Fixed value: how byte-level tokenisers part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A shard's sequences are numbered from a multiple of this.
STRIDE = 1 << 32


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and how much each of the three counts in the choice of a bin."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024**2
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
    rule: str = "norm"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Of a byte-level BPE whose ids follow its merges, the id of each token's bytes; else null."""
    plain = model["model"]
    level = model.get("pre_tokenizer") or {}
    if plain["type"] != "BPE" or model.get("normalizer") or (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) != ("ByteLevel", False, True):
        return None
    # Bytes that are no printable Latin-1 characters stand for those from 256 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
    vocabulary = plain["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in plain["merges"]]
    if any(vocabulary.get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)) or len(vocabulary) < 256 + len(pairs):
        return None
    return {bytes(back[c] for c in token): i for token, i in vocabulary.items() if all(c in back for c in token)}


class Encoder:
    """The ids that a tokeniser gives a text, as little-endian unsigned 32-bit integers.

    A byte-level BPE is run by tiktoken, with the ranks of the tokeniser's own file: that gives the same ids in less than half the time. Texts with one of the
    file's added tokens, and other kinds of tokenisers, go through tokenizers itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        model = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = _tokenizer(path)
        self.added = [t["content"] for t in model.get("added_tokens", [])]
        ranks = byte_ranks(model)
        self.fast = ranks and tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a process."""
    return Encoder(path)


def cuts(length: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, after a shorter first piece if need be."""
    first = length % most or most
    yield 0, min(length, first)
    for start in range(first, length, most):
        yield start, most


def pieces(docs: DataFrame, most: int = 1024, end: int = 2, path: str | None = None) -> DataFrame:
    """PIECE and deal, a random number, of all documents."""
    tune(docs.sparkSession)
    path = path or tokenizer_path()
    mark = np.array([end], "<u4")
    names = [c.split(" ")[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        random = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), mark])
                rows += [(doc_id, k, start, n, zlib.crc32(ids[start : start + n])) for k, (start, n) in enumerate(cuts(len(ids), most))]
            columns = {n: pa.array(x, pa.int32() if n == "piece" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)} if rows else {}
            if columns:
                yield pa.record_batch(columns | {"deal": pa.array(random.integers(0, 1 << 62, len(rows)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{PIECE}, deal long")


def best_fit(need: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The bin of each piece. need: rows of tokens, documents and cost, the longest piece first."""
    full = np.array([capacity.tokens, capacity.documents, capacity.cost], np.int64)
    weight = np.array(capacity.weights)
    left, number, bins, n = np.empty((1024, 3), np.int64), np.empty(1024, np.int64), 0, 0
    out = np.empty(len(need), np.int64)
    least = need.min(0) if len(need) else full
    for i, x in enumerate(need):
        at = -1
        if n:
            fits = np.flatnonzero((left[:n] >= x).all(1))
            if len(fits):
                after = left[fits] / full
                share = x / full
                score = after @ (weight * share) if capacity.rule == "dot" else -(((after - share) ** 2) @ weight)
                at = fits[score.argmax()]
        if at < 0:
            if n == len(left):
                left, number = np.concatenate([left, left]), np.concatenate([number, number])
            left[n], number[n] = full, bins
            at, n, bins = n, n + 1, bins + 1
        out[i] = number[at]
        left[at] -= x
        if (left[at] < least).any():  # nothing more fits
            n -= 1
            left[at], number[at] = left[n], number[n]
    return out


def pack(docs: DataFrame, capacity: Capacity = Capacity(), end: int = 2, path: str | None = None) -> DataFrame:
    """PIECE with sequence_id and offset of all documents' pieces."""
    spark = docs.sparkSession
    if capacity.rule not in ("norm", "dot"):
        raise ValueError(f"rule {capacity.rule!r} is neither norm nor dot")
    known = Workspace(spark, "packing").cut(pieces(docs, capacity.tokens, end, path), "pieces")
    shards = max(1, -(-known.count() // SHARD))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "deal"], ascending=[False, True], ignore_index=True)
        length = frame["length"].to_numpy()
        bins = best_fit(np.stack([length, np.ones_like(length), length**2], 1), capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        first = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1]))
        base = np.repeat((ends - length[order])[first], np.diff(np.append(first, len(order))))
        frame = frame.take(order)
        return frame.drop(columns=["deal", "shard"]).assign(sequence_id=key[0] * STRIDE + bins[order], offset=ends - length[order] - base)

    dealt = known.withColumn("shard", F.pmod("deal", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(fill, f"{PIECE}, sequence_id long, offset long")
