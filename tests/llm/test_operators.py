"""The dealt operators against brute force, on benchmark tables and on hostile small ones."""

import hashlib
import html
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumenstack.llm import chat_format, decontamination, html_extraction, language_id, license_scan, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup
from lumenstack.llm.common import Workspace
from lumenstack.llm.components import roots
from lumenstack.llm.queries import queries
from tests.conftest import MIDDLE, SMALL

from . import brute

LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
HOSTILE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "The MIT License and the MIT license, cc BY x"), (7, LONG),
    (8, f"start here {PASSAGE} and end"), (9, f"other {PASSAGE} tail words that differ"), (10, f"other {PASSAGE} tail words that differ"),
    (11, "a b a b a b a b a b a b a b a b"), (12, "line\nline\n\n  \nline \n"), (13, "x y  z \x00 q\x1fr"), (14, "ÀÉ ñandú Straße " * 20),
    (15, "### $$ *** " * 30), (16, LONG), (17, "apache license " * 3), (18, "cc-by"), (19, "x" * 3_000_000), (20, "gnu general public license"),
]


@pytest.fixture(scope="module")
def hostile(spark):
    """With repeated rows and columns whose names clash with an operator's own."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "x", 1) for i, t in [*HOSTILE, HOSTILE[7]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def _texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").distinct().collect()]


def _empty(df):
    return df.where("1 = 0")


@pytest.mark.parametrize("name", ["docs", "hostile"])
def test_near(request, name):
    df = request.getfixturevalue(name)
    want = brute.near(_texts(df))
    got = near_dedup.near_duplicates(df, 2, 80).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_finds_chains_and_edited_copies(spark):
    """Copies of one text, each edited elsewhere, and a chain whose ends are not alike."""
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: 5 * i], "new%d" % i, *base[5 * i + 1 :]])) for i in range(1, 18)]
    rows += [(100 + i, " ".join(f"c{j}" for j in range(8 * i, 8 * i + 100))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 2, 80).collect()} == want


def test_near_of_ids_with_several_texts(spark):
    """Rows of one id with different texts, null ids, and words that only a good hash tells apart."""
    one, other = _thue_morse()
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (5, a), (7, f"{a} end"), (3, f"{b} end"), (8, f"{one} " * 3), (9, f"{other} " * 3), (10, f"{other} " * 2), (None, b), (None, "alone here"), (None, "alone here"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = spark.createDataFrame([(t,) for _, t in rows], "text string").distinct().withColumn("text_key", near_dedup.text_key())
    got = near_dedup.near_duplicates(df).join(key, "text_key").collect()
    assert len(got) == len(rows)
    want = {a: 5, f"{a} end": 5, b: 3, f"{b} end": 3, f"{one} " * 3: 8, f"{other} " * 3: 9, f"{other} " * 2: 10, "alone here": None}
    for r in got:
        assert r.component_id == want.get(r.text, r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert sorted((str(r.doc_id), r.text[:3]) for r in got if r.chosen) == sorted([("5", "a0 "), ("5", "a0 "), ("3", "b0 "), ("8", one[:3]), ("9", other[:3]), ("10", other[:3]), ("None", "alo"), ("None", "alo"), ("4", "")])


@pytest.mark.parametrize("seed", range(3))
def test_near_within_a_template(spark, seed):
    """Texts of one template around the threshold: edits of their own and shared ones, parts of it, and more than it."""
    import random

    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rnd.sample(range(100), rnd.choice((3, 6, 9, 12))):
            w[j] = rnd.choice((f"e{i}_{j}", f"shared{j}", f"few{j}_{i % 4}"))
        if i % 5 == 0:
            w = w[: rnd.randrange(70, 100)]
        if i % 7 == 0:
            w += [f"more{j}" for j in range(rnd.randrange(30))]
        rows.append((i, " ".join(w)))
    want = brute.near(rows)
    assert 1 < len({c for _, c in want.values()}) < 150
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_roots_of_chains_and_stars(spark):
    chain = [(i, i - 1) for i in range(2, 40)]
    star = [(i, 100) for i in range(101, 140)] + [(200, 120)]
    got = {r.node: r.component for r in roots(spark.createDataFrame(chain + star, "u long, v long"), Workspace(spark, "roots"), "r").collect()}
    assert got == {i: 1 for i in range(1, 40)} | {i: 100 for i in (*range(100, 140), 200)}
    assert not roots(spark.createDataFrame([], "u long, v long"), Workspace(spark, "roots"), "r").collect()


@pytest.mark.parametrize("name", ["docs", "hostile"])
def test_substring(request, name):
    df = request.getfixturevalue(name)
    want = brute.substring(_texts(df))
    got = substring_dedup.digest(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert [r.n_words, r.n_removed, r.kept_sha256] == want[r.doc_id]
    left = substring_dedup.remove(df)
    assert left.columns == df.columns and left.count() == df.count()
    for r in left.where("text is not null").collect():
        assert hashlib.sha256(" ".join(brute.SPACED.findall(r.text)).encode()).hexdigest() == want[r.doc_id][2]


def _thue_morse(k=10):
    """Two words of 2**k letters, which a polynomial modulo a power of two does not tell apart."""
    bits = [0]
    for _ in range(k):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_substring_of_ids_with_several_texts(spark):
    """Rows of one id with different texts, and words that only a good hash tells apart."""
    one, other = _thue_morse()
    long, tail = " ".join(f"x{i}" for i in range(500)), " ".join(f"x{i}" for i in range(480, 500))
    rows = [(5, long), (5, tail), (5, long), (6, f"y {tail}"), (6, f"{tail}  z"), (4, f"{tail} {tail}"), (8, " ".join([one] * 20)), (9, " ".join([other] * 20)), (10, " ".join([other] * 14)), (None, long), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, *x) for i, _, *x in brute.substring_rows([r for r in rows if r[0] is not None]))
    got = sorted(tuple(r) for r in substring_dedup.digest(df).where("doc_id is not null").select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    left = substring_dedup.remove(df.withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("a b", F.lit(2)))
    assert left.columns == ["doc_id", "text", "row", "key", "a b"] and left.count() == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_factors_are_copies(spark, seed):
    """Each factor's words are those of its source from its start on; no window begun elsewhere is missed."""
    import random

    rnd = random.Random(seed)
    pool = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(1, 13):
        w = []
        while len(w) < 120:
            if i > 1 and rnd.random() < 0.6:
                src = texts[rnd.randrange(1, i)]
                at = rnd.randrange(len(src))
                w += src[at : at + rnd.randrange(5, 40)]
            else:
                w += rnd.choices(pool, k=rnd.randrange(1, 12))
        texts[i] = w
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    found = {r.doc_id: r.factors for r in substring_dedup.Parsed(df).factors.collect()}
    assert any(len(x) > 1 for x in found.values())
    for i, parts in found.items():
        for f in parts:
            size = f.end - f.start
            assert f.source < i and size >= 13 and texts[i][f.start : f.end] == texts[f.source][f.source_start : f.source_start + size]
    want = brute.substring([(i, " ".join(w)) for i, w in texts.items()])
    for i, w in texts.items():
        assert sum(any(f.start <= k < f.end for f in found.get(i, ())) for k in range(len(w))) == want[i][1]


@pytest.mark.parametrize("name", ["docs", "hostile"])
@pytest.mark.parametrize("block_words", [200_000, 300])
def test_leaks(request, spark, name, block_words):
    df = request.getfixturevalue(name)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [(900, None), (901, "..."), (902, PASSAGE), (902, PASSAGE), (903, "one"), (904, "the mit")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(_texts(df), items)
    got = decontamination.matches(df, bench, 10, block_words=block_words).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, len(r.hit_words), len(r.item_ids)) == want[r.doc_id][:3]
    for r in decontamination.digest(df, bench).collect() if block_words > 300 else ():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want[r.doc_id] and r.contaminated == (r.n_hit > 0)


@pytest.mark.parametrize("name", ["docs", "hostile"])
def test_rules(request, name):
    df = request.getfixturevalue(name)
    want = {i: brute.rules(t) for i, t in _texts(df)}
    for r in quality_rules.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_perplexity_model_is_a_distribution():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 128**3, 5000))
    model = quality_rules.Perplexity(keys, rng.integers(1, 9, len(keys)))
    sums = np.exp(model.table().reshape(-1, 128).astype(float)).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)
    assert list(model.keys) == sorted(model.keys)


class PlainKneserNey:
    """Modified Kneser-Ney over folded bytes, by dictionaries."""

    def __init__(self, texts):
        from collections import Counter

        three = Counter()
        for t in texts:
            s = self.fold(t)
            three.update(zip(s, s[1:], s[2:], strict=False))
        two, one = Counter((b, c) for _, b, c in three), Counter()
        one.update(c for _, c in two)
        self.levels = [self.level(x, cut) for x, cut in ((three, 2), (two, 1), ({(c,): n for c, n in one.items()}, 0))]

    @staticmethod
    def fold(text):
        return [32 if b < 32 else b if b < 128 else b & 31 for b in (text or "").encode()]

    @staticmethod
    def level(counts, cut):
        """(share of each gram within its context, what each context leaves)"""
        n1, n2, n3, n4 = (sum(n == i for n in counts.values()) for i in (1, 2, 3, 4))
        d = [0.5] * 3
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
        total, left = {}, {}
        for g, n in counts.items():
            total[g[:cut]] = total.get(g[:cut], 0) + n
            left[g[:cut]] = left.get(g[:cut], 0) + d[min(n, 3) - 1]
        return {g: (n - d[min(n, 3) - 1]) / total[g[:cut]] for g, n in counts.items()}, {c: x / total[c] for c, x in left.items()}

    def probability(self, gram, level=0):
        if not gram:
            return 1 / 128
        share, left = self.levels[level]
        return share.get(gram, 0.0) + left.get(gram[:-1], 1.0) * self.probability(gram[1:], level + 1)

    def nats(self, text):
        s = self.fold(text)
        return sum(-math.log(self.probability(g)) for g in zip(s, s[1:], s[2:], strict=False))


def test_verdict_against_brute_force(spark):
    """Each document's perplexity and verdict, from plainly counted n-grams and plainly taken quantiles."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    extra = [(-1, None, "en"), (-2, "ab", "de"), (-3, "Слова на другом языке. " * 30, None), (-4, "x | y | z | " * 9, "en")]
    rows = docs.union(spark.createDataFrame(extra, docs.schema)).collect()
    model = PlainKneserNey([r.text for r in rows])
    want, values = {}, {}
    for r in rows:
        w = brute.SPACED.findall(r.text or "")
        size = len((r.text or "").encode())
        if w and size > 2:
            nats = model.nats(r.text)
            lettered = sum(bool(brute.ALNUM.search(x.lower())) for x in w)
            want[r.doc_id] = nats / len(w), {"per_word": nats / max(lettered, 1), "per_symbol": nats / (size - 2)}
            for m, v in want[r.doc_id][1].items():
                values.setdefault((r.lang, m), []).append(v)

    def quantile(v, share, width):
        bins = sorted(math.floor(x / width) for x in v)
        return (bins[math.ceil(len(bins) * share) - 1] + 0.5) * width

    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, docs.schema)).collect()}
    assert len(got) == len(rows) and {got[r.doc_id].kept for r in rows} == {True, False}
    rejected = 0
    for r in rows:
        kept = not brute.rules(r.text)[5]
        if r.doc_id not in want:
            assert got[r.doc_id].nll is None and got[r.doc_id].kept == kept
            continue
        nll, measures = want[r.doc_id]
        assert got[r.doc_id].nll == pytest.approx(nll, rel=1e-4)
        wide, before = math.sqrt(1 + 100 / max(1, len(brute.SPACED.findall(r.text)))), kept
        for m, v in measures.items():
            below, above, margin, width = quality_rules.BANDS[m]
            own = values[r.lang, m]
            off, spread = v - quantile(own, 0.5, width), quantile(own, 0.75, width) - quantile(own, 0.25, width)
            kept = kept and -(spread * below + margin) * wide <= off <= (spread * above + margin) * wide
        rejected += before and not kept
        assert got[r.doc_id].kept == kept, r.doc_id
    assert rejected


def test_bytes_are_told_apart_and_looked_up_in_sorted_arrays():
    """Folding made one symbol of bytes 32 apart; the model of whole bytes is a distribution, and a search finds what a table of all trigrams holds."""
    import numpy as np
    import pyarrow as pa

    from lumenstack.llm.words import flat

    texts = pa.array(["слово за словом", "ббббб", "bbbbb \x1f\x00", None, "é", "€uro"])
    code, first = quality_rules._codes(*flat(texts), fold=False)
    raw = [(t or "").encode() for t in texts.to_pylist()]
    assert list(np.diff(first)) == [max(0, len(r) - 2) for r in raw]
    assert code.tolist() == [r[i] << 16 | r[i + 1] << 8 | r[i + 2] for r in raw for i in range(len(r) - 2)]
    keys, counts = np.unique(code, return_counts=True)
    model = quality_rules.Perplexity(keys, counts, 256)
    table = (model.back_off.reshape(256, 256)[:, :, None] + model.pair[None, :, :]).reshape(-1)
    table[model.keys] = model.value
    asked = np.random.default_rng(3).integers(0, 256**3, 10_000).astype(np.int32)
    for x in (asked, code, keys):
        assert np.array_equal(model.score(x), table[x])
    assert np.allclose(np.exp(table.astype(float)).reshape(-1, 256).sum(axis=1), 1, atol=1e-3)
    none = quality_rules.Perplexity(keys[:0], counts[:0], 256)
    assert np.allclose(none.score(code), -np.log(256))


def test_junk_of_another_script_is_seen_without_folding(spark):
    """Cyrillic texts, and one whose letters are moved to others that fold to the same symbols: only whole bytes show it."""
    import random

    rnd = random.Random(11)
    stock = "день ночь вода земля город река дорога книга время человек место рука слово дело жизнь дом".split()
    texts = [" ".join(rnd.choice(stock) for _ in range(120)) for _ in range(60)]
    odd = texts[0].translate({c: c - 0x20 if c >= 0x430 and c < 0x440 else c for c in range(0x430, 0x450)})  # second byte 32 less
    df = spark.createDataFrame([(i, t, "ru") for i, t in enumerate([*texts, odd])], "doc_id long, text string, lang string")
    kept = lambda fold: {r.doc_id: r.kept for r in quality_rules.judge(df, fold=fold).collect() if not r.base_failed}
    folded, whole = kept(True), kept(False)
    assert folded[60] and not whole[60] and all(whole[i] for i in range(60))


def test_perplexity_bands_reject_junk_on_either_side(spark):
    """Planted junk that passes the base rules goes, labelled junk goes, labelled good documents stay."""
    import random

    rnd = random.Random(7)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang")
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    planted = {
        -1: " | ".join(word("etaoinshr", 8) for _ in range(120)),  # above, hidden by cheap words
        -2: " ".join(word("qxzjkwvy", 2) for _ in range(150)),  # above per symbol, short words
        -3: " ".join(rnd.choice("th an in on er re at of ti ed".split()) for _ in range(150)),  # below
    }
    rows = docs.union(spark.createDataFrame([(i, t, "en") for i, t in planted.items()], docs.schema))
    got = {r.doc_id: r for r in quality_rules.judge(rows).collect() if not r.base_failed}
    assert set(planted) <= set(got) and not any(got[i].kept for i in planted)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    share = lambda q: sum(got[i].kept for i in got if quality.get(i) == q) / sum(quality.get(i) == q for i in got)
    assert share(1) >= 0.99 and share(0) <= 0.05


@pytest.mark.parametrize("name", ["docs", "hostile"])
def test_licenses(request, name):
    df = request.getfixturevalue(name)
    want = {i: brute.license_base(t) for i, t in _texts(df)}
    got = license_scan.scan(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_join_is_exact(spark):
    t = license_scan.TEMPLATES[5][1]
    words = t.split()
    rows = [(1, "\n".join(["nothing", " ".join(words[:-3])])), (2, " ".join(words[::2])), (3, " ".join(reversed(words))), (4, "\n".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(label, set(license_scan._template_words(x))) for label, x in license_scan.TEMPLATES]
    want = {(i, label) for i, text in rows for line in text.split("\n") for label, s in sets if len(s & set(brute.ALNUM.findall(brute.low(line)))) >= 0.8 * len(s)}
    assert {(r.doc_id, r.label) for r in license_scan.template_matches(df).collect()} == want and want


def test_wrapped_license_notices(spark):
    """Notices as they stand in files: wrapped, behind comment marks, deep in a long text."""
    wrapped = [
        ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
        ("isc", " * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted"),
        ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\r\nLicense, v. 2.0"),
        ("lgpl", "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License"),
        ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public\nLicense as published by the Free Software Foundation"),
    ]
    filler = " ".join(f"w{i}" for i in range(507))  # the notice lies across two pieces
    rows = [(i, f"{filler if i % 2 else 'head'}\n{text}\n{filler}") for i, (_, text) in enumerate(wrapped)]
    rows.append((99, "\n".join(f"{w} {filler}" for w in wrapped[1][1].split())))  # all the words, far apart
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(wrapped):
        assert label in got[i].labels.split(",") and got[i].score == 1.0, label
    assert (got[99].labels, got[99].score) == ("", 0.0)


def test_licenses_are_told_apart(spark):
    """Each template's text, and notices of licenses that share most words, against all templates."""
    texts = [(t, {label}) for label, t in [*license_scan.TEMPLATES, *license_scan.CLOSE]]
    texts += [
        ("Licensed under CC BY-SA 4.0", {"cc-by-sa"}), ("Licensed under CC BY-NC-SA 4.0.", {"cc-by-nc-sa"}), ("Licensed under CC BY 4.0, sa source", {"cc-by"}),
        ("Released under the BSD License", {"bsd"}), ("Licensed under the Mozilla Public License, Version 2.0", {"mpl"}), ("Released under the Foo License", set()),
        ("Released under the MIT License, BSD parts apart", {"mit"}), ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", {"lgpl"}),
        ("was released " + "x " * 40 + "under " + "x " * 40 + "the mit " + "x " * 40 + "license", set()),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (t, want) in enumerate(texts):
        assert set(filter(None, got[i].labels.split(","))) - set(got[i].base_labels.split(",")) == want - set(got[i].base_labels.split(",")), t
        assert want <= set(got[i].labels.split(",")), t


def test_license_rules(spark):
    """Long templates wherever the threshold is met, short ones only in order; rows of one id by their own texts."""
    granted = "Permission is hereby granted by apache, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, granted), (2, "they met under the license office of mit yesterday"), (3, "was released under the mit licence"), (5, "plain prose"), (5, "Released under the BSD License"), (None, "nothing here"), (None, "Released under the MIT License"), (None, None)]
    got = sorted((str(r.doc_id), r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "mit", 1.0), ("2", "", 0.0), ("3", "mit", 0.8), ("5", "", 0.0), ("5", "bsd", 1.0), ("None", "", 0.0), ("None", "mit", 1.0), ("None", "", 0.0)])


def test_mixing_of_repeated_and_null_ids(spark):
    """Rows of one id, or of none, are decided by their texts as well: each source comes near its target."""
    rows = [(None, f"w{i} " * 20, "a") for i in range(900)] + [(7, f"w{i} " * 20, "b") for i in range(900)] + [(i, f"w{i} " * 20, "c") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ("doc_id", "source")).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target


FLOOD = "<p>The river rose in the night and the bridge was closed by the council before dawn, as people slept.</p><p>Boats were moved to the upper harbour, and schools stayed shut for two days after that.</p>"
TALK = "<div><p>I do not agree with this at all, my friend.</p><p>Nor do I, it is a shame, really it is.</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="page with-sidebar"><h1>Flood</h1>{}</div>', '<div class="search-result-page"><h1>Flood</h1>{}</div>', '<div class="article share-price-report"><h1>Flood</h1>{}</div>',
        '<div role=main><div class="comment-free-zone"><h1>Flood</h1>{}</div></div>', '<article><h1>Flood</h1>{}</article><section id="reader-feedback">' + TALK + "</section>",
        '<article><h1>Flood</h1>{}</article><div id="disqus_thread">' + TALK + "</div>", '<article><h1>Flood</h1>{}<div class="partner-content"><p>Buy new boats today, cheap and fast, at our harbour shop.</p></div></article>',
        '<div class="post"><h1>Flood</h1>{}</div><div class="comments">' + TALK * 20 + "</div>",
    ],
)
def test_names_of_frames(page):
    """A name speaks against an element, but not against one that holds most of the page; readers' words go however many they are."""
    assert html_extraction.main_text(page.replace("{}", FLOOD)) == "Flood " + re.sub("<[^>]*>", "", FLOOD.replace("</p><p>", " "))


@pytest.mark.parametrize("name", ["docs", "hostile"])
def test_mixing(request, name):
    df = request.getfixturevalue(name)
    rows = mixing.mix(df, tuple(df.columns)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df, tuple(df.columns)).collect()))
    assert rows[0].__fields__ == [f"in_{c}" if c == "size" else c for c in df.columns] + ["size", "source_size", "target", "taken"]
    sizes, biggest = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        biggest[r.source] = max(biggest.get(r.source, 0), r.size)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, target = {s: i % 3 + 1 for i, s in enumerate(order)}, {}
    left, free = float(sum(sizes.values())), set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = {}
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken in [r.size * k for k in range(4)]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:  # one document, with its repeated rows, decides at most
        assert abs(taken[s] - target[s]) <= 2 * biggest[s]


def test_language(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries()["op6_language_id"](spark, MIDDLE).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def _plain_grams(text):
    """Counts of a text's n-grams, in plain words: letters and gaps, one to three at a time."""
    from collections import Counter

    codes = [0]
    for c in [*(text or ""), "\n"]:
        low = ord(c.lower()[0]) if c.isalpha() else 0
        code = 0 if not low else low - 96 if 97 <= low <= 122 else 27 + (low * 40503 >> 4) % language_id.SLOTS
        if code or codes[-1]:
            codes.append(code)
    out = Counter()
    for n, offset in ((1, 0), (2, 128), (3, 128 + 128**2)):
        for a in range(len(codes) - n + 1):
            number = sum(x * 128 ** (n - 1 - j) for j, x in enumerate(codes[a : a + n]))
            out[number + offset] += number > 0
    return {k: v for k, v in out.items() if v}


def _ranked(counts, profile):
    return {g: i for i, (_, g) in enumerate(sorted((-n, g) for g, n in counts.items())[:profile])}


def test_language_against_brute_force(spark):
    """Every document's language and score by plain counting, as the query has them."""
    from collections import Counter

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    extra = [(-1, " abc", "en"), (-2, "abc", "en"), (-3, None, "de"), (-4, "Ünïcode ßtraße", None), (-5, "\n\n?", "xx"), (-6, "İstanbul ÅÅ", "tr")]
    rows = docs.union(spark.createDataFrame(extra, docs.schema)).collect()
    totals = {}
    for r in rows:
        if r.lang is not None:
            totals.setdefault(r.lang, Counter()).update(_plain_grams(r.text))
    profiles = {lang: p for lang, c in totals.items() if (p := _ranked(c, 300))}
    df = spark.createDataFrame(rows, docs.schema).repartition(3)
    for r in language_id.predict(df, language_id.train(df), keep=("doc_id", "text")).collect():
        own = _ranked(_plain_grams(r.text), 300)
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(min(abs(p.get(g, 10**6) - i), 300) for g, i in own.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert (r.lang_pred, round(r.score, 9)) == (best, round(1 - far[best] / (300 * len(own)), 9)), r.doc_id


def test_language_of_odd_texts(spark, hostile):
    model = language_id.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r.doc_id: r for r in language_id.predict(hostile, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 15)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in got.values()) and got[14].lang_pred in model.langs


def test_quality_classifier(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    got = queries()["op1_quality_classifier"](spark, MIDDLE).collect()
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_quality_of_odd_texts(spark, hostile):
    labels = spark.createDataFrame([(6, 1), (15, 0), (8, 1)], "doc_id long, label int")
    model = quality_classifier.train(hostile, labels)
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(hostile, model).collect())
    assert {r.score for r in quality_classifier.score(hostile, quality_classifier.train(hostile, labels.where("1 = 0"))).collect()} == {0.5}


def test_quality_learns_from_long_documents(spark):
    """Labelled documents that are all long: none is left out of the fit."""
    rows = [(i, ("plain words of a text " if i % 2 else "### $$$ *** %%% ") * 4000, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r.doc_id: r.score for r in quality_classifier.score(df, quality_classifier.train(df, df.select("doc_id", "label"))).collect()}
    assert all((got[i] > 0.5) == (label == 1) and got[i] != 0.5 for i, _, label in rows)


def test_attention_gradient():
    """The gradient of every weight against finite differences of the loss."""
    import numpy as np

    q = quality_classifier
    rng = np.random.default_rng(3)
    sizes = [1, 3, 2, 5]
    first, h = np.concatenate(([0], np.cumsum(sizes))), rng.normal(size=(sum(sizes), q.WIDTH))
    labels, weight = np.array([1.0, 0, 1, 0]), np.array([0.7, 1.2, 0.7, 1.4])
    model = q.AttentionModel(np.zeros(q.WIDTH), np.ones(q.WIDTH), 0.5)
    model.p["c"] = rng.normal(0, 0.1, 2 * q.WIDTH)
    _, grad = model.loss(h, first, labels, weight)
    for name, value in model.p.items():
        flat, got = value.reshape(-1), grad[name].reshape(-1)
        for i in rng.choice(len(flat), min(len(flat), 12), replace=False):
            kept, sides = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = kept + step
                sides.append(model.loss(h, first, labels, weight)[0])
            flat[i] = kept
            assert got[i] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-8), name


def test_attention_learns_and_scores_in_blocks():
    """The fit tells bags apart, and the streamed score is that of a plain re-statement."""
    import numpy as np

    q = quality_classifier
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, q.WIDTH)) for n in (1, 3, 2, 5)]
    model = q.AttentionModel(np.full(q.WIDTH, 0.1), np.full(q.WIDTH, 1.3), 0.5)
    labels = np.array([1.0, 0, 1, 0])
    model.fit(bags, labels, epochs=60)
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    scores = model.scores(np.concatenate(bags), first)
    assert ((scores > 0.5) == (labels == 1)).all()
    assert np.allclose(scores, model.scores(np.concatenate(bags), first, block=2))
    p = model.p
    for bag, score in zip(bags, scores, strict=True):
        h = np.clip((bag - 0.1) / 1.3, -6, 6)
        gate = [float(p["w"] @ (np.tanh(p["V"] @ x) / (1 + np.exp(-(p["U"] @ x))))) for x in h]
        a = np.exp(gate) / np.exp(gate).sum()
        z = sum(w * np.concatenate((x, x * x / 6)) for w, x in zip(a, h, strict=True))
        assert score == pytest.approx(1 / (1 + np.exp(-(z @ p["c"] + p["b"][0]))))


def _plain_encoding(text):
    """One passage's figures, counted plainly."""
    q, raw = quality_classifier, text.encode()
    words = [x for x in re.split(rb"[\x20\x09-\x0D]+", raw) if x]
    out = [0.0] * q.WIDTH
    size = len(raw) + 1  # with the line feed that ends a text
    for b in raw + b"\n":
        out[q.CLASS[b]] += 1 / size
    for x, y in zip(raw, raw[1:] + b"\n", strict=True):
        out[q.CLASSES + (x * 31 + y * 17) % q.PAIRS] += 1 / size
    long = [len(x) for x in words]
    mean = sum(long) / len(long)
    return out[:-4] + [mean, (sum(x * x for x in long) / len(long) - mean**2) ** 0.5, sum(x <= 2 for x in long) / len(long), math.log1p(len(words))]


def test_encoding_of_passages():
    import numpy as np
    import pyarrow as pa

    q = quality_classifier
    texts = ["Plain words, of a text!", "Zwölf große Ähren 12 % &", " ".join(f"w{i}" for i in range(150)), None]
    got, first = q.encode(pa.array(texts))
    assert first.tolist() == [0, 1, 2, 5, 6]
    for i in range(2):
        assert np.allclose(got[i][:-4], _plain_encoding(texts[i])[:-4]) and np.allclose(got[i][-4:], _plain_encoding(texts[i])[-4:])
    assert np.allclose([x[-1] for x in got[2:5]], np.log1p([64, 64, 22]))


def test_labels_that_disagree(spark):
    """Documents labelled both ways, or neither 0 nor 1, are not learnt from."""
    df = spark.createDataFrame([(i, "some words here") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (2, None), (3, 7)], "doc_id long, label int")
    assert quality_classifier.train(df, labels).prior == 1.0


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries()["op4_html_extraction"](spark, SMALL).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<(?:/?p|/?h1|br)>", " ", re.sub("</?b>", "", article))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>only &amp; this</p>", "only & this"),
        ("<nav>menu</nav><main><p>a<b>b</b>c<p>d</main><footer>f</footer>", "abc d"),
        ("<article><p>long enough to stay here</p><div class='comments'><p>first!</p></div><aside>x</aside></article>", "long enough to stay here"),
        ("<div id=cookie-notice>we use cookies</div><div class=post><h1>T</h1><p>body of the post</p></div>", "T body of the post"),
        ("<script>if (a < b) '</p>'</script><article>x &lt;y&gt; &#233;&nbsp;z</article>", "x <y> é z"),
        ("<article><p>unclosed <p>second<table><tr><td>cell", "unclosed second cell"),
    ],
)
def test_page_shapes(page, text):
    assert html_extraction.main_text(page) == text


PARAGRAPH = "A paragraph of the article that is long enough to be told from the labels of a form, which are short. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><form id=aspnetForm><nav>menu</nav><article><p>the article</p></article><footer>f</footer></form>", "the article"),
        ("<body><form class=form><header><main><p>a</p></main></header><aside>x</aside></form>", "a"),
        (f"<body><form id=f><nav>menu</nav><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><p><label>Name</label></form>", f"{PARAGRAPH}{PARAGRAPH}".strip()),
        ("<article><p>long enough to stay here</p><form><label>Name</label><button>Send</button></form></article>", "long enough to stay here"),
        ("<aside><article>teaser</article></aside><article><p>long enough to stay here</p></article>", "long enough to stay here"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data=a.pdf><p>and this is said</p></object></article>", "so x=2 holds and this is said"),
    ],
)
def test_wrapped_pages(page, text):
    assert html_extraction.main_text(page) == text


LINES = "<div>The first line of the story is long enough to stand on its own, as is usual.</div><div>{}</div><div>And the last one is again as long as lines of a story are, with a full stop.</div>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # A word among long lines goes with them; alone it would not.
        (f"<body><div>{LINES.format('Yes')}</div></body>", re.sub("<[^>]*>", " ", LINES.format("Yes"))),
        # So do a dash and a name between paragraphs of a table cell.
        (f"<table><tr><td>{PARAGRAPH}<br>A. Name<br>{PARAGRAPH}</td></tr></table>", f"{PARAGRAPH}A. Name {PARAGRAPH}"),
        # A few words between links go with those, though they would pass alone.
        (f"<div><div><a href=/>Home</a></div><div>Best of all deals here</div><div><a href=/n>News</a></div><div><a href=/s>Sport</a></div></div><section><p>{PARAGRAPH}</p></section>", PARAGRAPH),
        (f"<ul><li><a href=/>Home</a><li>Your daily read<li><a href=/s>Sport</a></ul><section><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></section>", PARAGRAPH * 2),
    ],
)
def test_the_cut_decides(page, text):
    """Labels that differ from those of the blocks' own log-odds, and are right."""
    read = html_extraction.Reader(page)
    assert html_extraction.labels(read) != html_extraction.labels(html_extraction.Reader(page), smooth=False)
    assert html_extraction.main_text(page) == " ".join(text.split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>seen by all</p><script src=x/>alert(1)</script><p>and this too</p></article>", "seen by all and this too"),
        ("<article><p>seen by all</p><p style='color:red; display: none'>not <b>this</b></p><p hidden>nor this</p><p data-hidden=1>but this</p></article>", "seen by all but this"),
        ("<article><header><h1>Title</h1><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></header><p>The text of it, <a href=/x>with a link</a>.</p></article>", "Title The text of it, with a link."),
        ("<article><p>a drawing <svg><title>no</title><defs><g>no</g></defs><text>of words</text><style/></svg></p><p>and more</p></article>", "a drawing of words and more"),
        ('<p class="open>the quote never ends</p><p>so it is read without</p>', "the quote never ends so it is read without"),
        ("<p title='a > b'>quoted marks</p><p><!--> not cut <!-- this --> at all</p>", "quoted marks not cut at all"),
        ("<p>x < y and <3 of <", "x < y and <3 of <"),
        ("<p>lone</p>", "lone"),
    ],
)
def test_page_details(page, text):
    assert html_extraction.main_text(page) == text


def test_hostile_pages_take_time_in_proportion():
    import time

    pages = ["<div>x" * 160_000, '<a "' * 250_000, '<a ="' * 200_001, "<p>x" * 250_000, "<i>" * 300_000 + "</b>" * 100_000, "<div>" * 100_000 + "</x>" * 125_000, "<b><div>" * 120_000, "<p>the words of it</p><div>x</div>" * 30_000]
    for page in pages:
        start = time.process_time()
        html_extraction.main_text(page)
        assert time.process_time() - start < 10, page[:20]
    deep = "<div>" * 2000 + "<p>words at the bottom of all</p>" + "</div>" * 2000 + "<p>and words after them</p>"
    assert html_extraction.main_text(deep) == "words at the bottom of all and words after them"


def test_min_cut_against_all_labellings():
    import itertools
    import random

    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randint(1, 7)
        terminals = [(rnd.random() * 5, rnd.random() * 5) for _ in range(n)]
        joined = [(a, b, rnd.random() * 3) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.6]
        cost = lambda x: sum(t if k else s for (s, t), k in zip(terminals, x, strict=True)) + sum(w for a, b, w in joined if x[a] != x[b])  # noqa: E731, B023
        best = min(map(cost, itertools.product([True, False], repeat=n)))
        assert cost(html_extraction.min_cut(terminals, joined)) == pytest.approx(best)


def test_chat(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, 0, "tool>", "a\\l<b]"), (-2, 1, None, None), (-2, 1, "system", "<<SYS>>"), (None, 0, "assistant", "z" * 2_000_000), (None, 1, "assistant", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_conversations(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for key, r in got.items():
        own = sorted((t, role is not None, role or "", text or "") for k, t, role, text in rows if k == key)
        said = "".join(x[3] for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == brute.sha("".join(f"{x[2]}\n{x[3]}\n" for x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(said), brute.sha(said))


def test_template_language():
    from lumenstack.llm.templates import TemplateError, compile_template, fold, _Parser

    show = lambda source, **env: "".join(t for t, _ in compile_template(source)(env))
    assert show("{% for x in xs %}{% if x == 2 %}two{% elif x > 2 %}{{ x + 1 }}{% else %}-{% endif %}{% endfor %}", xs=[1, 2, 3]) == "-two4"
    assert show("{% set a = 'q' ~ 1 %}{{ a | upper }}{{ d.k[0] }}{{ none }}", d={"k": ["v"]}) == "Q1v"
    assert show("{{ x.__class__ }}{{ xs['__len__'] }}", x=1, xs=[]) == ""
    folded = fold(_Parser("a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{% else %}e{% endif %}", {}).body()[0], {})
    assert [(k.kind, k.value) for k in folded.kids] == [("text", "abcd")]
    for bad in ("{{ f() }}", "{% while x %}", "{% if x %}", "{{ x | nofilter }}", "{{ 1 + }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    assert list(compile_template("a{% generation %}b{% endgeneration %}")({})) == [("a", False), ("b", True)]


def test_empty_tables(spark, hostile):
    none = _empty(hostile)
    bench = spark.createDataFrame([], "item_id long, text string")
    frames = [
        near_dedup.near_duplicates(none), substring_dedup.digest(none), decontamination.digest(none, bench), quality_rules.judge(none), license_scan.scan(none), mixing.mix(none),
        language_id.predict(none, language_id.train(none)), quality_classifier.score(none, quality_classifier.train(none, spark.createDataFrame([], "doc_id long, label int"))),
        chat_format.digest(chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))), html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert not any(r.contaminated for r in decontamination.digest(hostile, bench).collect())


def test_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(60))
    df = spark.createDataFrame([(None, text, "en", "a"), (3, text, "en", "a"), (None, "alone here", None, None)], "doc_id long, text string, lang string, source string")
    assert sorted(r.component_id or 0 for r in near_dedup.near_duplicates(df).collect()) == [0, 3, 3]
    assert [r.n_removed for r in substring_dedup.digest(df).collect()] == [0, 0, 0]
    for out in (license_scan.scan(df), mixing.mix(df), quality_rules.judge(df)):
        assert out.count() == 3


def test_estimate_is_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[400:2400]
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.merge(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()
    got = near_dedup.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(got - 1600 / 2400) < 0.12


def test_native_queries_have_no_python(spark):
    for name in ("op3_license_scan", "op5_mixing"):
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_crc_matches(spark):
    row = spark.range(1).select(F.crc32(F.lit(123).cast("string")).alias("c")).first()
    assert row.c == zlib.crc32(b"123")
