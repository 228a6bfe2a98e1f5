"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` consecutive words; an item of fewer words is one
window. Windows are sets of shingles of up to GRAM words, and must be contained whole: at that threshold
the necessary prefix of a window is its single rarest shingle, rarity being counted over all
documents. Documents are joined to windows on prefix shingles; the place of the shingle
within its window bounds where the window can begin (position) and that it must fit into the document
(length); what is left is compared by hash, and verified byte for byte.

Items are cut into pieces of PIECE words that overlap by a window less one word, and pieces are dealt to blocks of about BLOCK_WORDS words
and BLOCK_BYTES bytes by hash, so what is gathered and broadcast at a time is bounded however large the benchmark, an item or the rows of one id
grow. Documents are read twice for each block: once to count shingles, once to match. With several
blocks, each block's finds are written and joined to the documents once, at the end.

Null and empty texts have no words; an item without words has no window. Very long texts are taken whole, item or document. Repeated items
and rows of one item id with different texts are one item's; repeated documents, and rows of one doc_id with different texts, are each judged by
their own text. items_sha256 lists distinct item ids; a null id counts as an empty one. Columns to keep may have any name but n_words,
hit_words and item_ids. An empty benchmark finds nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace
from .words import ALNUM_LOWER, U, Words, lists, signed, words

GRAM, BLOCK_WORDS, BLOCK_BYTES, PIECE = 3, 1_000_000, 16 << 20, 4096
#: Shingle hashes are first looked up in a bit map of this many entries.
SIEVE = 1 << 22
#: Pairs of a document's place and a window that are looked at together.
CHUNK = 1 << 20


def _pieces(window: int):
    def run(batches):
        table = bytes(ALNUM_LOWER.tolist())
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = text.encode().translate(table).replace(b"\0", b" ").split()
                for a in range(0, max(1, len(own) - window + 1) if own else 0, PIECE):
                    part = own[a : a + PIECE + window - 1]
                    rows.append((name, b" ".join(part).decode(), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["id", "piece", "n"])

    return run


class Block:
    """The distinct windows of some pieces, in arrays: where each begins, its words, hash, items and prefix shingle."""

    def __init__(self, ids: list[str], pieces: list[str], window: int):
        self.names = sorted(set(ids))
        item = np.searchsorted(np.array(self.names, object), np.array(ids, object)) if ids else np.zeros(0, np.int64)
        w = words(pa.array(pieces, pa.string()), ALNUM_LOWER)
        self.data, self.start, self.end = w.data, w.start, w.end
        sizes = np.minimum(w.counts, window)
        self.grams = {k: w.grams(k)[0] for k in range(1, GRAM + 1)}
        places, lengths, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
        owner = w.owner()
        for size in np.unique(sizes[sizes > 0]).tolist():
            g, good = w.grams(size)
            at = np.flatnonzero(good & (sizes[owner[: len(g)]] == size))
            places.append(at)
            lengths.append(np.full(len(at), size))
            hashes.append(g[at])
        place, length, hashed = (np.concatenate(x) for x in (places, lengths, hashes))
        # Equal windows are one, with all the items that hold it.
        order = np.lexsort((hashed, length))
        same = (hashed[order][1:] == hashed[order][:-1]) & (length[order][1:] == length[order][:-1])
        number = np.cumsum(np.concatenate(([True], ~same)))[: len(order)] - 1
        lead = order[np.concatenate(([True], ~same))[: len(order)]]
        self.place, self.length, self.hash = place[lead], length[lead].astype(np.int64), hashed[lead]
        pairs = np.unique(np.stack((number, item[owner[place[order]]] if len(place) else number)), axis=1)
        self.items, self.items_from = pairs[1], np.searchsorted(pairs[0], np.arange(len(lead) + 1))
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def shingles(self) -> dict[int, np.ndarray]:
        """Sorted distinct hashes of the windows' shingles, by their number of words."""
        out = {}
        for k in range(1, GRAM + 1):
            own = self.length >= GRAM if k == GRAM else self.length == k
            at = [self.place[own & (self.length > j + k - 1)] + j for j in range(int(self.length.max(initial=0)) - k + 1)]
            if own.any():
                out[k] = np.unique(self.grams[k][np.unique(np.concatenate(at))])
        return out

    def choose(self, frequency: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Each window's prefix: of its shingles, that with the least (documents' count, hash)."""
        for k, (known, n) in frequency.items():
            own = np.flatnonzero(self.length >= GRAM if k == GRAM else self.length == k)
            g = self.grams[k]
            least, best, where = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), U), np.zeros(len(own), np.int64)
            for j in range(int(self.length[own].max(initial=0)) - k + 1):
                fits = np.flatnonzero(self.length[own] >= j + k)
                h = g[self.place[own[fits]] + j]
                count = n[np.searchsorted(known, h)]
                less = (count < least[fits]) | ((count == least[fits]) & (h < best[fits]))
                least[fits[less]], best[fits[less]], where[fits[less]] = count[less], h[less], j
            order = np.argsort(best, kind="stable")
            self.prefix[k] = best[order], own[order], where[order]


def _sieve(known: np.ndarray) -> np.ndarray:
    out = np.zeros(SIEVE, bool)
    out[(known & U(SIEVE - 1)).astype(np.int64)] = True
    return out


def _found(w: Words, k: int, sieve: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of shingles whose hashes are known, and their hashes."""
    g, good = w.grams(k)
    at = np.flatnonzero(sieve[(g & U(SIEVE - 1)).astype(np.int64)] & good)
    if len(at):
        at = at[known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]]
    return at, g[at]


def _count(held: Broadcast):
    def run(batches):
        shingles = held.value
        sieves, total = {k: _sieve(x) for k, x in shingles.items()}, {k: np.zeros(len(x), np.int64) for k, x in shingles.items()}
        for batch in batches:
            w = words(batch.column(0), ALNUM_LOWER)
            for k, known in shingles.items():
                _, h = _found(w, k, sieves[k], known)
                total[k] += np.bincount(np.searchsorted(known, h), minlength=len(known))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(signed(shingles[k][some])), pa.array(n[some], pa.int64())], ["k", "shingle", "n"])

    return run


def _hits(block: Block, w: Words, sieves: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all windows that occur in a batch's words."""
    out, owner, low, grams = [np.zeros((2, 0), np.int64)], w.owner(), ALNUM_LOWER[w.data], {}
    for k, (known, window_of, offset_of) in block.prefix.items():
        places, h = _found(w, k, sieves[k], known)
        left, right = np.searchsorted(known, h), np.searchsorted(known, h, "right")
        upto = np.cumsum(right - left)
        at = 0
        while at < len(places):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
            n = (right - left)[at:to]
            entry = np.repeat(left[at:to] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            place, own, window = np.repeat(places[at:to], n), owner[np.repeat(places[at:to], n)], window_of[entry]
            begin, size = place - offset_of[entry], block.length[window]
            fits = (begin >= w.first[own]) & (begin + size <= w.first[own + 1])
            begin, size, window = begin[fits], size[fits], window[fits]
            same = np.zeros(len(begin), bool)
            for s in np.unique(size).tolist():
                if s not in grams:
                    grams[s] = w.grams(s)[0]
                of = size == s
                same[of] = grams[s][begin[of]] == block.hash[window[of]]
            out.append(np.array([(a, x) for a, x in zip(begin[same].tolist(), window[same].tolist(), strict=True) if _equal(block, x, w, low, a)], np.int64).reshape(-1, 2).T)
            at = to
    return tuple(np.concatenate(out, axis=1))


def _equal(block: Block, window: int, w: Words, low: np.ndarray, at: int) -> bool:
    """Byte for byte: a piece's words stand apart by one space, a document's by anything that is not a word's."""
    a, size = block.place[window], block.length[window]
    span = low[w.start[at] : w.end[at + size - 1]].tobytes().replace(b"\0", b" ")
    return b" ".join(span.split()) == block.data[block.start[a] : block.end[a + size - 1]].tobytes()


def _match(held: Broadcast, text: int, all_rows: bool):
    """Rows are any columns and, at `text`, the text: with n_words, hit_words and item_ids instead of it, for all rows or those with finds."""

    def run(batches):
        block: Block = held.value
        sieves, names = {k: _sieve(x[0]) for k, x in block.prefix.items()}, pa.array(block.names, pa.string())
        for batch in batches:
            w = words(batch.column(text), ALNUM_LOWER)
            begin, window = _hits(block, w, sieves)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.subtract.at(edge, begin + block.length[window], 1)
            hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            per = np.diff(np.searchsorted(hit, w.first))
            n = block.items_from[window + 1] - block.items_from[window]
            row = np.repeat(w.owner()[begin], n)
            item = block.items[np.repeat(block.items_from[window] - np.concatenate(([0], np.cumsum(n)[:-1]))[: len(n)], n) + np.arange(int(n.sum()))]
            row, item = np.unique(np.stack((row, item)), axis=1)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(item, pa.int64())))
            place = hit - np.repeat(w.first[:-1], per)
            columns = [c for i, c in enumerate(batch.columns) if i != text]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(w.counts, pa.int64()), lists(place, per, pa.int32()), ids], [*(x for i, x in enumerate(batch.schema.names) if i != text), "n_words", "hit_words", "item_ids"])
            yield out if all_rows else out.filter(pa.array(per > 0))

    return run


FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("item_ids", T.ArrayType(T.StringType()))]


def _ready(docs: DataFrame, pieces: DataFrame, window: int) -> Block:
    """The block of some pieces (id, piece), with prefixes by the counts of all documents."""
    rows = pieces.select("id", "piece").toArrow()
    block = Block(rows["id"].to_pylist(), rows["piece"].to_pylist(), window)
    shingles = block.shingles()
    held = docs.sparkSession.sparkContext.broadcast(shingles)
    counted = docs.select("text").mapInArrow(_count(held), "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n")).toArrow()
    k, shingle, n = (counted[c].to_numpy() for c in ("k", "shingle", "n"))
    frequency = {}
    for size, known in shingles.items():
        total = np.zeros(len(known), np.int64)
        total[np.searchsorted(known, shingle[k == size].view(U))] = n[k == size]
        frequency[size] = known, total
    block.choose(frequency)
    held.destroy()
    return block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns keep, n_words, hit_words (places of hit words) and item_ids of each document."""
    spark = docs.sparkSession
    work = Workspace(spark, "leaks")
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    pieces = work.cut(items.mapInArrow(_pieces(window), "id string, piece string, n long").distinct(), "pieces")
    total = pieces.agg(F.sum("n").alias("n"), F.sum(F.octet_length("piece")).alias("size")).first()
    n = max(1, -(-(total["n"] or 0) // block_words), -(-(total["size"] or 0) // BLOCK_BYTES))
    dealt = lambda i: pieces.where(F.pmod(F.xxhash64("id", "piece"), F.lit(n)) == i)
    src = docs.select(*keep, "text")
    kept = src.schema.fields[:-1]
    if n == 1:
        held = spark.sparkContext.broadcast(_ready(docs, dealt(0), window))
        return src.mapInArrow(_match(held, len(kept), True), T.StructType([*kept, *FOUND]))
    key = [T.StructField("text_key", T.LongType()), T.StructField("length", T.LongType())]
    keyed = docs.select(F.xxhash64("text").alias("text_key"), F.octet_length("text").cast("long").alias("length"), "text").where("text is not null")
    finds = []
    for i in range(n):
        held = spark.sparkContext.broadcast(_ready(docs, dealt(i), window))
        finds.append(work.cut(keyed.mapInArrow(_match(held, 2, False), T.StructType([*key, *FOUND])).dropDuplicates(["text_key", "length"]), f"block-{i}"))
        held.destroy()
    every = finds[0]
    for x in finds[1:]:
        every = every.union(x)
    # At most one row a block for each text: what is gathered is bounded by the text and the number of blocks.
    joined = every.groupBy("text_key", "length").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    joined = work.cut(joined, "finds")
    none = Block([], [], window)
    counted = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept_row"), F.xxhash64("text").alias("text_key"), F.octet_length("text").cast("long").alias("length"), "text")
    plain = counted.mapInArrow(_match(spark.sparkContext.broadcast(none), 3, True), T.StructType([*counted.schema.fields[:-1], *FOUND])).drop("hit_words", "item_ids")
    out = plain.join(joined, ["text_key", "length"], "left")
    empty = {"hit_words": F.array().cast("array<int>"), "item_ids": F.array().cast("array<string>")}
    return out.select("kept_row.*", "n_words", *(F.coalesce(c, e).alias(c) for c, e in empty.items()))


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = matches(docs, benchmark, window)
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))
