"""Operators 11 to 13 against brute force, on the small tables and on hostile rows."""

import datetime as dt
import random
import zlib
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.llm import filter_audit, packing, sale_enrichment
from tests.conftest import SMALL

from . import brute

NOW = dt.datetime(2024, 1, 1)


# Sale enrichment


def sales_by_hand(sales, changes, batches):
    """The contract, event by event. sales (batch, id, client, sold_at), changes (batch, id, client, valid_at, op, balance)."""
    changes, low, high = set(changes), dt.datetime.min, dt.datetime.max
    held, waiting, out = {}, [], []
    top = lambda rows, b: max((r[3] for r in rows if r[0] < b and r[3] is not None), default=low)
    cents = lambda x: None if x is None else int(np.floor(100 * x + 0.5))
    order = lambda v: (v[0], v[1] is not None, v[1] or 0, v[2] is not None, v[2] or 0, v[3] is not None, v[3] or "")
    for b in range(batches + 1):
        mark, h = top(changes, b), min(top(changes, b), top(sales, b)) if b < batches else high
        for _, i, c, v, op, balance in (x for x in changes if x[0] == b and x[3] is not None):
            if v < mark:
                out.append(("late", i, b, None, None, None, None))
            elif c is not None:
                held.setdefault(c, []).append((v, i, cents(balance), op))
        waiting += [s for s in sales if s[0] == b]
        done = [s for s in waiting if s[3] is None or s[3] < h or b == batches]
        waiting = [s for s in waiting if s not in done]
        for _, i, c, at, *_ in done:
            mine = held.get(c, []) if c is not None else []
            best = max((v for v in mine if at is not None and v[0] <= at), key=order, default=(None,) * 4)
            out.append(("sale", i, b, len(mine), *best[1:]))
        for c, mine in held.items():
            old = sorted((v for v in mine if v[0] <= h), key=order)
            held[c] = old[-1:] + [v for v in mine if v[0] > h]
    return out


def enriched(spark, sales, changes, batches, **options):
    a = spark.createDataFrame(sales, "batch int, sale_id long, client_id long, sold_at timestamp_ntz")
    b = spark.createDataFrame(changes, "batch int, change_id long, client_id long, valid_at timestamp_ntz, op string, balance double")
    return [tuple(r) for r in sale_enrichment.Enrichment(spark, **options).run(a, b, batches).collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_sales_on_hostile_rows(spark):
    """Ties, repeats, nulls in any column, late rows, far times, a client with a third of all rows, empty batches."""
    rnd = random.Random(11)
    hours = lambda b: NOW + dt.timedelta(hours=rnd.randint(10 * b - 6, 10 * b + 12), microseconds=rnd.choice((0, 0, 1)))
    client = lambda: rnd.choice((7, 7, 7, 1, 2, 3, 4, None))
    busy = (0, 1, 3, 4)  # the third batch is empty
    changes = [(b, rnd.choice((None, 1, 2, i)), client(), rnd.choice((hours(b), hours(b), hours(b), None)), rnd.choice("IUD") if i % 5 else None, rnd.choice((None, 1.005, -2.5, i / 7))) for i in range(240) for b in [rnd.choice(busy)]]
    changes += changes[:40] + [(4, 999, 7, dt.datetime(9999, 1, 1), "U", 1.0), (0, 998, 7, dt.datetime(1900, 1, 1), "U", 2.0)]
    sales = [(b, rnd.choice((None, i)), client(), rnd.choice((hours(b), hours(b), hours(b), None))) for i in range(240) for b in [rnd.choice(busy)]]
    sales += [(0, 1000, 7, dt.datetime(1800, 1, 1)), (0, 1001, 7, dt.datetime(9998, 1, 1))] + sales[:5] * 2
    unique = [(*s, k) for k, s in enumerate(sales)]
    got = enriched(spark, sales, changes, 5)
    assert ordered(got) == ordered(sales_by_hand(unique, changes, 5))


def test_sales_of_empty_tables(spark):
    one = [(0, 1, 7, NOW)]
    assert enriched(spark, [], [], 1) == []
    assert enriched(spark, one, [], 1) == [("sale", 1, 1, 0, None, None, None)]


def test_state_is_on_the_heap_and_old_files_go(spark):
    """A store of RocksDB leaves native memory with each start and partition, also when it is closed."""
    day = lambda b: NOW + dt.timedelta(days=b)
    a = spark.createDataFrame([(b, b, 7, day(b)) for b in range(8)], "batch int, sale_id long, client_id long, sold_at timestamp_ntz")
    b = spark.createDataFrame([(b, b, 7, day(b), "U", 1.0) for b in range(8)], "batch int, change_id long, client_id long, valid_at timestamp_ntz, op string, balance double")
    run = sale_enrichment.Enrichment(spark)
    assert run.run(a, b, 8).count() == 8
    files = [p for p in Path(run.work.root.removeprefix("file://"), "checkpoint/state/0").glob("[0-9]*/*") if p.suffix != ".crc" and p.is_file()]
    assert {p.suffix for p in files} == {".delta", ".snapshot"}
    assert max(Counter(p.parent for p in files).values()) <= 8  # of nine starts, each with a delta, and a snapshot each second time


def test_batches_of_days(spark):
    days = [(None,), (dt.datetime(2023, 1, 1),), (dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 14),), (dt.datetime(2030, 1, 1),)]
    df = spark.createDataFrame(days, "at timestamp_ntz").coalesce(1)
    got = [r[0] for r in df.select(sale_enrichment.batch_of(sale_enrichment._day(F.col("at")), 12, 19723, 152)).collect()]
    assert got == [11, 0, 0, 1, 11]


def test_micros_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30, 1, 5),), (dt.datetime(1900, 1, 1, 23, 59, 59, 999999),)], "at timestamp_ntz")
    want = [(r.at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for r in df.collect()]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert [r[0] for r in df.select(sale_enrichment._micros(F.col("at"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# Filter audit


def masks_by_hand(docs):
    """{row: set of failed filters}"""
    out = []
    for i, t in docs:
        t = t or ""
        w = brute.SPACED.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in t for c in "#$%&*|")}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u in docs)
        out.append({k for k, v in fails.items() if v})
    return out


def audit_by_hand(rows, marks):
    """{(part, order, step): figures} by running the filters one after the other."""
    masks, out = masks_by_hand([(r[0], r[1]) for r in rows]), {}
    for part in {r[2] or "" for r in rows}:
        own = [(m, marks.get(r[0], (0, 0)) if r[0] is not None else (0, 0)) for r, m in zip(rows, masks, strict=True) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                redundant = sum(f in m for m, _ in own) - sum(f in m for m, _ in left)
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(m == {f} for m, _ in own), sum(x[1][0] for x in gone), sum(x[1][1] for x in gone)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(total[order[step - 1]])
    return out


def test_audit(spark):
    words = " ".join(f"w{i}" for i in range(250))
    rows = [(1, None, "en"), (2, "", "en"), (3, words, None), (3, words, "en"), (3, words, ""), (4, words, "de"), (None, words, "de"), (5, f"{words} #", "de"), (6, "UP " * 300, "de"), (7, words.upper(), "de"), (8, "x" * 3_000_000, "en")]
    rows += [(9 + i, "same text", "en") for i in range(30)] + [(None, "same text", "en"), (9, "same text", "en"), (100, f"{words}\x00é é", "de")]
    labels = [(1, 1, 0), (3, 1, 0), (3, 0, 1), (9, 0, 1), (10, 1, 1), (None, 1, 1), (7, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("n", F.lit(1)).withColumn("quality", F.lit(1))
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == audit_by_hand(rows, {1: (1, 0), 3: (1, 1), 9: (0, 1), 10: (1, 1), 7: (0, 1)})
    assert filter_audit.audit(df.where("1 = 0"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("n", range(1, 6))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for at in filter_audit.swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


# Packing


def check_packing(docs, rows, capacity):
    """Every id in its place, no sequence over a capacity or with a gap."""
    tokenizer = packing._tokenizer(packing.tokenizer_path())
    want = []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert sum(n for _, n in packing.cuts(len(ids), capacity.tokens)) == len(ids)
        want += [(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cuts(len(ids), capacity.tokens))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(found) <= max(1, capacity.documents)
        assert len(found) == 1 or sum(n * n for _, n in found) <= capacity.cost
    return bins


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(256, 3, 40_000, (1, 1, 1), "dot"), packing.Capacity(512, 20, 512**2, (0.5, 1, 2), "norm")])
def test_packing(spark, capacity):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.pack(docs, capacity).collect()
    bins = check_packing(texts, rows, capacity)
    if capacity == packing.Capacity():
        assert len(bins) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_ids_are_those_of_tokenizers():
    """Spaces of all kinds, at all places, before and after all kinds of characters, and control strings; and whole documents."""
    rnd = random.Random(1)
    tokenizer, encode = packing._tokenizer(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    parts = [" ", " ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "'s", "'", "a", "word", "Z9", "42", "\u00e9", "\u4f60\u597d", "\U0001f600", ".", "--", "<|endoftext|>", "\x00", "e\u0301", "_"]
    for _ in range(4000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 12)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert encode.fast
    import pyarrow.parquet as pq

    for text in pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert encode(text or "").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_other_tokenisers_are_left_to_tokenizers():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = packing.Encoder(path)
    assert not encode.fast and encode("Some words").tolist() == packing._tokenizer(path).encode("Some words", add_special_tokens=False).ids


def test_packing_of_hostile_rows(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, "word " * 1023), (3, "word " * 1022), (4, "word " * 5000), (5, "</s> <s> \x00 é"), (6, "x" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("shard", F.lit(1))
    check_packing(rows, packing.pack(df).collect(), packing.Capacity())
    assert packing.pack(df.where("1 = 0")).count() == 0


def test_best_fit_against_plain_choice():
    """Each piece goes to the best of all bins it fits in."""
    rnd = np.random.default_rng(3)
    for rule in ("norm", "dot"):
        capacity = packing.Capacity(100, 5, 4000, (1.0, 0.5, 0.25), rule)
        length = np.sort(rnd.integers(1, 60, 300))[::-1]
        need = np.stack([length, np.ones_like(length), length**2], 1)
        got, full, bins = packing.best_fit(need, capacity), np.array([100, 5, 4000]), []
        for x, b in zip(need, got, strict=True):
            fits = [i for i, left in enumerate(bins) if (left >= x).all()]
            score = {i: (bins[i] / full) @ (np.array(capacity.weights) * x / full) if rule == "dot" else -((((bins[i] - x) / full) ** 2) @ capacity.weights) for i in fits}
            if b == len(bins):
                assert not fits
                bins.append(full.copy())
            else:
                assert score[b] == pytest.approx(max(score.values()))
            bins[b] = bins[b] - x
