"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is a block of the reference. The index of blocks holds, for each block, the
minimizers of its windows (among the SEED-word hashes in a window of `window` words, the least):
equal windows have the same minimizer at the same place, so a window that no minimizer of
another text matches cannot recur. Windows at matching minimizers are looked up in full, by two
independent 64-bit hashes: each gets its first place in the smallest document that holds it. A document is
then parsed greedily into factors (start, end, source, source_start): a factor takes the place of its first
window in an earlier document and grows for as long as the next window stands next to it there, so the words of a factor are those of
the source from source_start on. At factor boundaries, windows that reach from one factor
into the next were looked up themselves and begin factors of their own, so a word is in a duplicate span exactly if a window
over it starts in an earlier document.

Rows of equal text form a class; only one of its smallest document takes part in the
lookup, and those of other documents are single factors, copied whole.

Null texts have no words. Texts of fewer words than the window are left alone, and empty texts stay empty. Very long texts are taken whole:
memory grows with the longest text, not with the table. Rows with a null
doc_id are returned unchanged and are no source. Repeated rows of one doc_id are not each other's
source; rows of one doc_id with different texts are judged each by its own text, and all of them are sources of larger ids.
A window that stands in several smaller documents counts once, for the smallest (ties within a document: its first place). Other columns may
have any name: they are carried packed and returned unchanged (remove) or not read (digest). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace
from .words import SPACED, U, Words, lists, mix, signed, spread, words

SEED = 5


def minimizers(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, the place of each one's minimizer (the first of equals), and the seed hashes."""
    g, _ = w.grams(SEED)
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - SEED + 1):
        less = g[j : j + n] < least
        least[less] = g[j : j + n][less]
        at[less] = j
    owner = w.owner()
    good = np.flatnonzero(owner[:n] == owner[window - 1 :])
    return good, good + at[good], g


def _joined(w: Words, i: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of a value's words (those to keep) joined by one space."""
    a, b = w.first[i], w.first[i + 1]
    raw = w.data[w.offsets[i] : w.offsets[i + 1] - 1].tobytes().split()
    if keep is not None:
        raw = [x for x, k in zip(raw, keep[a:b].tolist(), strict=True) if k]
    return hashlib.sha256(b" ".join(raw)).hexdigest()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, cid, sid, text): sid tells texts apart, cid those of one doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("cid"), F.unhex(F.sha2(text, 256)).alias("sid"), "text")


def _parse(window):
    def run(batches):
        for batch in batches:
            w = words(batch.column(3), SPACED)
            _, at, g = minimizers(w, window)
            at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
            per = np.diff(np.searchsorted(at, w.first))
            place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)
            sha = [_joined(w, i) for i in range(batch.num_rows)]
            cols = [*batch.columns[:3], pa.array(w.counts, pa.int64()), pa.array(sha), lists(signed(g[at]), per, pa.int64()), lists(place[at], per, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "cid", "sid", "n_words", "sha", "seeds", "places"])

    return run


def _first_places(hashes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each window, the first place in its text where the same window starts."""
    key = hashes ^ mix(owner.astype(U) + U(1))
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(key)]
    out = np.empty_like(place)
    out[order] = place[order][np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
    return out


def _windows(window):
    def run(batches):
        for batch in batches:
            w = words(batch.column(2), SPACED, second=True)
            first, at, _ = minimizers(w, window)
            wanted = batch.column(3)
            mark = np.zeros(len(w.hash) + 1, bool)
            mark[wanted.flatten().to_numpy() + np.repeat(w.first[:-1], wanted.value_lengths().fill_null(0).to_numpy())] = True
            first = first[mark[at]]
            g1, g2 = w.grams(window)[0][first], w.grams(window, second=True)[0][first]
            per = np.diff(np.searchsorted(first, w.first))
            owner = np.repeat(np.arange(len(per)), per)
            place = first - w.first[:-1][owner]
            cols = [*batch.columns[:2], lists(signed(g1), per, pa.int64()), lists(signed(g2), per, pa.int64()), lists(place, per, pa.int32()), lists(place - _first_places(g1, owner, place), per, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "cid", "w1", "w2", "place", "back"])

    return run


def factors(places: np.ndarray, sources: np.ndarray, spots: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, source, source_start) from windows at places that start at spots of sources.

    A factor grows while the next window follows in the same source; the next begins with the window that did not.
    """
    if not len(places):
        return []
    order = np.argsort(places, kind="stable")
    places, sources, spots = places[order], sources[order], spots[order]
    cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(sources) != 0) | (np.diff(spots) != 1)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(places)])) - 1
    return [(int(places[a]), int(places[b]) + window, int(sources[a]), int(spots[a])) for a, b in zip(starts, ends, strict=True)]


def _factors(window):
    def run(batches):
        for batch in batches:
            out = []
            for found in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                out.append([dict(zip(FACTOR, f, strict=True)) for f in factors(*(x.values.to_numpy() for x in found), window)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, kind)], ["doc_id", "cid", "factors"])

    return run


FACTOR = ("start", "end", "source", "source_start")
SPAN = "array<struct<start:int,end:int,source:long,source_start:int>>"


class Parsed:
    """The parse of a table: documents (doc_id, cid, n_words, sha), copies (doc_id, cid, source)
    of whole texts, and factors (doc_id, cid, factors) of the others, where there are any. cid tells
    texts of one doc_id apart."""

    def __init__(self, docs: DataFrame, window: int = 13):
        if window <= SEED:
            raise ValueError(f"a window has over {SEED} words")
        work = Workspace(docs.sparkSession, "substring")
        texts = keyed(docs)
        parsed = work.cut(texts.mapInArrow(_parse(window), "doc_id long, cid long, sid binary, n_words long, sha string, seeds array<long>, places array<int>"), "parsed")
        small = work.cut(parsed.select("doc_id", "cid", "sid", "n_words", "sha"), "documents")
        self.documents = small.select("doc_id", "cid", "n_words", "sha")
        long = f"doc_id is not null and n_words >= {window}"
        known, texts_of = parsed.where(long), small.where(long).select("doc_id", "cid", "sid")
        classes = work.cut(texts_of.groupBy("sid").agg(F.min("doc_id").alias("source"), F.first("cid").alias("class")), "classes")
        self.copies = texts_of.join(classes, "sid").where("doc_id > source").select("doc_id", "cid", "source").distinct()
        own = classes.select(F.col("source").alias("doc_id"), F.col("class").alias("cid")).distinct()

        exploded = known.select("doc_id", "cid", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("doc_id", "cid", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
        # A seed matters if two texts hold it; the ids of one text's copies do not.
        twice = exploded.groupBy("seed").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high").select("seed")
        # Written first: a join of two plain exchanges is one whose hot seeds Spark can split.
        twice = work.cut(twice, "twice")
        places = exploded.select("seed", "doc_id", "cid", "place").join(twice, "seed").groupBy("doc_id", "cid").agg(F.collect_set("place").alias("places"))
        places = work.cut(places.join(own, ["doc_id", "cid"], "left_semi"), "places")
        work.drop("parsed", "twice")

        with_places = texts.select("doc_id", "cid", "text").join(places, ["doc_id", "cid"]).select("doc_id", "cid", "text", "places")
        found = work.cut(with_places.mapInArrow(_windows(window), "doc_id long, cid long, w1 array<long>, w2 array<long>, place array<int>, back array<int>"), "windows")
        work.drop("places")
        rows = found.select("doc_id", "cid", F.inline(F.arrays_zip("w1", "w2", "place", "back"))).withColumn("earliest", F.col("place") - F.col("back")).drop("back")
        origin = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("earliest", "doc_id").alias("spot")).where("source < last").select("w1", "w2", "source", "spot")
        origin = work.cut(origin, "origin")
        hits = rows.join(origin, ["w1", "w2"]).where("doc_id > source").groupBy("doc_id", "cid").agg(F.collect_set(F.struct("place", "source", "spot")).alias("x"))
        spans = hits.select("doc_id", "cid", F.col("x.place").alias("places"), F.col("x.source").alias("sources"), F.col("x.spot").alias("spots")).mapInArrow(_factors(window), f"doc_id long, cid long, factors {SPAN}")
        self.factors = work.cut(spans, "factors")
        work.drop("windows", "origin")
        self.texts, self.window = texts, window


def _keep(w: Words, spans: pa.ListArray) -> np.ndarray:
    """A mask of the words outside all spans."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    flat = spans.flatten()
    base = np.repeat(w.first[:-1], spans.value_lengths().fill_null(0).to_numpy())
    np.add.at(edge, flat.field("start").to_numpy() + base, 1)
    np.add.at(edge, flat.field("end").to_numpy() + base, -1)
    return np.cumsum(edge)[:-1] == 0


def _reduce(batches):
    for batch in batches:
        w = words(batch.column(2), SPACED)
        keep = _keep(w, batch.column(3))
        sha = [_joined(w, i, keep) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spread(~keep, w.first), pa.int64()), pa.array(sha)], ["doc_id", "cid", "cut", "cut_sha"])


def _rewrite(batches):
    for batch in batches:
        w = words(batch.column(1), SPACED)
        keep, out = _keep(w, batch.column(2)), []
        for i in range(batch.num_rows):
            raw = w.data[w.offsets[i] : w.offsets[i + 1] - 1].tobytes().split()
            out.append(b" ".join(x for x, k in zip(raw, keep[w.first[i] : w.first[i + 1]].tolist(), strict=True) if k).decode())
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(out, pa.string())], [*batch.schema.names[3:], "kept_text"])


def digest(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what is left of each document."""
    parsed = Parsed(docs, window)
    cut = parsed.texts.select("doc_id", "cid", "text").join(parsed.factors, ["doc_id", "cid"]).select("doc_id", "cid", "text", "factors").mapInArrow(_reduce, "doc_id long, cid long, cut long, cut_sha string").dropDuplicates(["doc_id", "cid"])
    copies = parsed.copies.select("doc_id", "cid", F.lit(True).alias("copied"))
    joined = parsed.documents.join(cut, ["doc_id", "cid"], "left").join(copies, ["doc_id", "cid"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def remove(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs with duplicate spans cut out of text: words that stay are joined by one space;
    texts without such spans are unchanged, whole copies become empty."""
    parsed = Parsed(docs, window)
    row = docs.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("cid"), F.struct("*").alias("row"))
    found = parsed.factors.withColumnRenamed("doc_id", "key")
    copies = parsed.copies.select(F.col("doc_id").alias("key"), "cid", F.lit(True).alias("copied"))
    tagged = row.join(found, ["key", "cid"], "left").join(copies, ["key", "cid"], "left")
    out = T.StructType([tagged.schema["row"], T.StructField("kept_text", T.StringType())])
    hit = tagged.where("factors is not null").select("key", F.col("row.text").alias("text"), "factors", "row").mapInArrow(_rewrite, out)
    clean = tagged.where("factors is null").select("row", F.when(F.col("copied"), F.lit("")).otherwise(F.col("row.text")).alias("kept_text"))
    whole = clean.unionByName(hit)
    return whole.select(*(F.col("kept_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
