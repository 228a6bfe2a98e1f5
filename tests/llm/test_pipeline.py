"""The pipeline's stages on the small tables, each judged on its own input."""

import corpus_pipeline
from lumenstack.llm.common import Workspace
from tests.conftest import SMALL

from . import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    tables, work = [docs], Workspace(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        tables.append(work.cut(stage(spark, tables[-1], SMALL), f"{len(tables)}"))
    rows = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])
    texts = [[(r.doc_id, r.text) for r in x] for x in rows]
    good = {i for i, t in texts[0] if not brute.rules(t)[5]}
    assert {i for i, _ in texts[1]} <= good and len(texts[1]) >= 0.9 * len(good)
    near = brute.near(texts[1], 5)
    assert {i for i, _ in texts[2]} == {i for i, (_, c) in near.items() if i == c}
    cut = brute.substring(texts[2])
    assert {i: brute.sha(" ".join(brute.SPACED.findall(t))) for i, t in texts[3]} == {i: x[2] for i, x in cut.items()}
    hit = brute.leaks(texts[3], bench)
    assert {i for i, _ in texts[4]} == {i for i, x in hit.items() if not x[1]}
    assert {r.doc_id for r in rows[5]} <= {i for i, _ in texts[4]} and all(r.taken > 0 for r in rows[5])


def test_quality_tells_scripts_apart(spark):
    """A text whose letters are moved to others that fold to the same symbols goes; those of real words stay."""
    import random

    rnd = random.Random(11)
    stock = "день ночь вода земля город река дорога книга время человек место рука слово дело жизнь дом".split()
    texts = [" ".join(rnd.choice(stock) for _ in range(120)) for _ in range(60)]
    odd = texts[0].translate({c: c - 0x20 for c in range(0x430, 0x440)})
    rows = [(i, t, "ru", "src1") for i, t in enumerate([*texts, odd])]
    kept = corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), SMALL)
    assert {r.doc_id for r in kept.collect()} == set(range(60))


def test_stages_on_hostile_rows(spark):
    """Null and repeated ids, empty and long texts, columns with the stages' own names: each row is judged by its own text."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = [r for r in docs.collect() if not brute.rules(r.text)[5] and len(r.text) < 4000][:40]
    a, b, c, d = (r.text for r in good[:4])
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in good[4:]]
    rows += [(None, a, "en", None), (None, a, "en", None), (None, "too short", "en", "s"), (None, None, None, None), (None, "", None, None)]
    rows += [(10**9, b, "en", "s"), (10**9, c, "en", "s"), (10**9, b, "en", "s"), (10**9 + 1, f"{c} more", "en", "s"), (10**9 + 2, " ".join(f"{w}x{i}" for i in range(4000) for w in d.split()[:9]), "en", "s")]
    names = ["size", "taken", "packed_row", "kept_id", "key", "row", "node", "a b"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    work, tables = Workspace(spark, "hostile"), [df]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(work.cut(stage(spark, tables[-1], SMALL), str(k)))
    for t in tables[1:-1]:
        assert t.columns == df.columns and all(r[n] == f"own {n}" for r in t.collect() for n in names)
    kept, single, cut, clean, mixed = ([(r.doc_id, r.text) for r in t.collect()] for t in tables[1:])
    assert all(not brute.rules(t)[5] for _, t in kept) and kept.count((10**9, b)) in (0, 2) and kept.count((None, a)) in (0, 2)
    # One row of each group stays; groups by brute force, with a number for each row.
    numbered = dict(enumerate(sorted(kept, key=lambda x: (x[0] is None, x[0] or 0))))
    groups = brute.near([(i, t) for i, (_, t) in numbered.items()], 5)
    assert len(single) == len({c for _, c in groups.values()})
    assert {i for i, _ in single} == {numbered[c][0] for _, c in groups.values()}
    assert sorted(x[-1] for x in brute.substring_rows([x for x in single if x[0] is not None])) == sorted(brute.sha(" ".join(brute.SPACED.findall(t))) for i, t in cut if i is not None)
    assert [x for x in cut if x[0] is None] == [x for x in single if x[0] is None]
    assert set(clean) <= set(cut) and set(mixed) <= set(clean)
    assert tables[-1].columns == [f"in_{c}" if c in ("size", "taken") else c for c in df.columns] + ["size", "source_size", "target", "taken"]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0, name
