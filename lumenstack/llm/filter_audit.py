"""Filter interaction audit: what each filter removes, at each place, under every order of the filters.

Each document is reduced to a mask of the filters that it fails, and documents are counted by part and mask: at most 32 cells a part, whatever
the number of documents. An order's steps follow from the cells. The orders are visited by swaps of neighbours (each differs from the one before in two
places next to each other), so each visit renews just the two steps that the swap touched; the sums for Shapley's value grow along the walk.

The filter on repeated texts needs, per text, the smallest id. It is found by sums alone, without joining the texts back: of each text the rows
of the smallest id are counted, the other rows with an id fail. Copies are summed before they are shuffled, so a text that a third of
the rows share is no hot key. Texts are compared by their SHA-256.

Cases: a null text is an empty one; a null lang is the part ''. Rows without an id fail no comparison of ids, and make none fail. Rows of one id and text
are no smaller than each other. A document is good or toxic if any of its labels says so; one without labels is neither. Very long texts are counted whole.
Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

FILTERS = "ABCDE"
#: Fixed values of the contract: words and shares in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(text: Column) -> Column:
    """Bits 0 to 3: the conditions A to D that a text meets by itself."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(text)
    capitals = chars - F.length(F.translate(text, CAPITALS, ""))
    fails = (n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals.cast("long") * 100 > chars * MOST_CAPITALS, text.rlike(SYMBOLS))
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and failed filters."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    thin = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text_key"), own_mask(text).alias("mask"))
    thin = thin.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    counted = thin.groupBy("text_key", "mask", "doc_id", "part").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    own = F.struct("part", "n", "good", "toxic")
    by_id = counted.groupBy("text_key", "mask", "doc_id").agg(F.collect_list(own).alias("rows"))
    # Rows of a text with its smallest id are not repeated; all are counted as failing E first, and these then moved.
    first = by_id.where("doc_id is not null").groupBy("text_key", "mask").agg(F.min_by("rows", "doc_id").alias("rows")).select("mask", F.inline("rows"))
    first = first.unionByName(by_id.where("doc_id is null").select("mask", F.inline("rows")))
    bit = 1 << FILTERS.index("E")
    signed = [counted.select("part", (F.col("mask") + bit).alias("mask"), "n", "good", "toxic"), first.select("part", "mask", "n", "good", "toxic")]
    signed.append(first.select("part", (F.col("mask") + bit).alias("mask"), *((-F.col(c)).alias(c) for c in ("n", "good", "toxic"))))
    sums = signed[0].unionByName(signed[1]).unionByName(signed[2]).groupBy("part", "mask")
    return sums.agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))).where("n > 0")


def swaps(n: int) -> Iterator[int]:
    """Places i of swaps (i, i + 1) that lead from one order of n things through all the others: the largest thing that can move does."""
    order, ahead = list(range(n)), [-1] * n
    while True:
        for thing in reversed(range(n)):
            at = order.index(thing)
            to = at + ahead[thing]
            if 0 <= to < n and order[to] < thing:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        for larger in range(thing + 1, n):
            ahead[larger] = -ahead[larger]
        yield min(at, to)


class Walk:
    """The steps of one order over cells indexed by mask, and the sums over all orders seen."""

    def __init__(self, counts: np.ndarray, filters: str = FILTERS):
        """counts: a row per mask, columns n, good, toxic."""
        self.counts, self.filters, self.masks = counts, filters, np.arange(len(counts))
        self.order = list(range(len(filters)))
        self.steps = [self._step(i) for i in self.order]
        self.shapley = np.zeros(len(filters), np.int64)
        self._add()

    def _step(self, at: int) -> tuple:
        f, before = self.order[at], sum(1 << x for x in self.order[:at])
        fails, gone = self.masks >> f & 1 == 1, self.masks & before != 0
        n = self.counts[:, 0]
        removed, good, toxic = self.counts[fails & ~gone].sum(0)
        return n[~fails & ~gone].sum(), removed, n[fails & gone].sum(), n[1 << f], good, toxic

    def _add(self) -> None:
        self.shapley[self.order] += [s[1] for s in self.steps]

    def swap(self, at: int) -> None:
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]
        self.steps[at], self.steps[at + 1] = self._step(at), self._step(at + 1)
        self._add()

    def run(self) -> Iterator[tuple]:
        """(order, step, filter, figures) of all orders."""
        for at in (None, *swaps(len(self.filters))):
            if at is not None:
                self.swap(at)
            name = "".join(self.filters[i] for i in self.order)
            for i, figures in enumerate(self.steps):
                yield name, i + 1, self.order[i], figures


def _audit(part: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros((1 << len(FILTERS), 3), np.int64)
    counts[part["mask"]] = part[["n", "good", "toxic"]]
    walk = Walk(counts)
    rows = list(walk.run())
    name = part["part"].iloc[0]
    return pd.DataFrame([(name, order, step, *figures, walk.shapley[f]) for order, step, f, figures in rows], columns=[c.split(" ")[0] for c in OUT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of filters and step, zeros included."""
    tune(docs.sparkSession)
    return cells(docs, labels).groupBy("part").applyInPandas(_audit, OUT)
