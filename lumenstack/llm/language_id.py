"""Language identification by rank-order n-gram profiles.

Letters are lower-cased; runs of other characters are one gap. N-grams of one to three letters
and gaps are counted; a language's profile ranks its most frequent ones over all training documents. A document's
profile is compared to each language's by out-of-place distance: the sum over its n-grams of
the difference of ranks, at most PROFILE for one the language lacks. The least distance wins; ties fall
to the smaller name.

Letters other than a-z are hashed to SLOTS codes, so an n-gram is a number below 128**3 and
counting tables have a proven bound. Null and empty texts and texts without a letter are `und`, with score 0; very long ones are
read whole. Without training documents, all are `und`. Repeated rows get equal results, whatever stands beside them. N-grams that are as
frequent rank by their number. Profiles hold PROFILE rows a language, and are broadcast: the learned languages must be few enough for that.
Columns to keep may have any name but lang_pred and score. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune
from .words import flat

PROFILE, SLOTS, CODES, SALT = 300, 101, 128, 16
#: Rank of an n-gram that a profile lacks.
ABSENT = 1 << 14


@cache
def letters() -> np.ndarray:
    """Code of each code point: 0 no letter, 1-26 a-z in either case, 27-127 other letters."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 40503 >> 4) % SLOTS
    return out


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a batch's letters and gaps, and where each value's begin. Every value begins and ends with a gap."""
    big = pa.large_string()
    data, offsets = flat(pc.binary_join_element_wise(pa.scalar(" ", big), pc.fill_null(pc.cast(text, big), ""), pa.scalar("", big)))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    first = heads[offsets]
    code = letters()[points].astype(np.int32)
    gap = code == 0
    keep = ~gap | np.concatenate(([True], ~gap[:-1]))
    # The space that begins a value stands for all gaps there; the line feed that ends one, or the gap before it, for those at its end.
    keep[first[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return code[keep], kept[first]


def keys(code: np.ndarray) -> np.ndarray:
    """N-grams of one to three codes that hold a letter; the order of an n-gram shows in its leading gaps:
    a letter alone, a pair and a triple differ by an offset of 128**3."""
    one = code
    two = (code[:-1] << 7) | code[1:]
    three = (two[:-1] << 7) | code[2:]
    return np.concatenate((one[one > 0], two[two > 0] + CODES, three[three > 0] + CODES + CODES**2))


SPAN = CODES + CODES**2 + CODES**3


def _count(batches):
    """Sparse counts by language; what is held at once is bounded, and handed on beyond that."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        code, first = grams(batch.column(0))
        langs = batch.column(1).to_pylist()
        for lang in set(langs):
            k = np.concatenate([keys(code[first[i] : first[i + 1]]) for i, x in enumerate(langs) if x == lang])
            if len(k) > SPAN // 8:
                dense = np.bincount(k, minlength=SPAN)
                new = np.flatnonzero(dense)
                pairs = np.stack((new, dense[new]))
            else:
                pairs = np.stack(np.unique(k, return_counts=True)).astype(np.int64)
            held.setdefault(lang, []).append(pairs)
            size += pairs.shape[1]
        if size > 2_000_000:
            held = {lang: [_folded(np.concatenate(x, axis=1))] for lang, x in held.items()}
            size = sum(x[0].shape[1] for x in held.values())
            if size > 1_000_000:
                yield from _rows(held)
                held, size = {}, 0
    yield from _rows(held)


def _folded(pairs: np.ndarray) -> np.ndarray:
    k, back = np.unique(pairs[0], return_inverse=True)
    return np.stack((k, np.bincount(back, pairs[1], len(k)).astype(np.int64)))


def _rows(total):
    for lang, parts in total.items():
        k, n = _folded(np.concatenate(parts, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


class Profiles:
    """Ranks of the profiles' n-grams: a table of n-grams by languages."""

    def __init__(self, ranked: list[tuple[str, int, int]]):
        self.langs = sorted({x[0] for x in ranked}, key=lambda s: s.encode())
        self.known = np.unique(np.array([x[1] for x in ranked], np.int64))
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), ABSENT, np.int32)
        for lang, gram, rank in ranked:
            self.ranks[np.searchsorted(self.known, gram), self.langs.index(lang)] = rank

    def index(self) -> np.ndarray:
        at = np.full(SPAN, len(self.known), np.int32)
        at[self.known] = np.arange(len(self.known))
        return at


def train(docs: DataFrame, profile: int = PROFILE) -> Profiles:
    """Profiles of all languages of docs (text, lang), from all its texts.

    A language's best n-grams are chosen in two steps, by salt and then over the salts' best.
    """
    tune(docs.sparkSession)
    counted = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang", F.col("gram") % SALT).orderBy(F.desc("n"), "gram")
    best = counted.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= profile).select("lang", "gram", "n")
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = best.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= profile)
    return Profiles([(r["lang"], r["gram"], r["nth"] - 1) for r in ranked.collect()])  # at most `profile` rows a language


def _predict(held, profile):
    def run(batches):
        model: Profiles = held.value
        index = model.index()
        for batch in batches:
            code, first = grams(batch.column(batch.num_columns - 1))
            lang, score = [], []
            for i in range(batch.num_rows):
                k = keys(code[first[i] : first[i + 1]])
                if not len(k) or not model.langs:
                    lang.append("und")
                    score.append(0.0)
                    continue
                gram, n = np.unique(k, return_counts=True)
                if len(gram) > 2 * profile:  # those at least as frequent as the last of the profile
                    near = n >= np.partition(n, len(n) - profile)[len(n) - profile]
                    gram, n = gram[near], n[near]
                gram = gram[np.argsort(-n, kind="stable")[:profile]]
                place = np.minimum(np.abs(model.ranks[index[gram]] - np.arange(len(gram))[:, None]), profile)
                distance = place.sum(axis=0) / (profile * len(gram))
                best = int(distance.argmin())
                lang.append(model.langs[best])
                score.append(float(1 - distance[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Profiles, keep: tuple[str, ...] = ("doc_id",), profile: int = PROFILE) -> DataFrame:
    """The columns keep, lang_pred, and score: 1 less the distance, as a share of the largest possible."""
    tune(docs.sparkSession)
    src = docs.select(*keep, "text")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), profile), schema)
