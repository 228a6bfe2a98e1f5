"""Near-duplicate detection with SetSketch registers.

A document is the set of its distinct k-word shingles. Documents with equal sets form a
class, which its smallest doc_id stands for. Each class has a SetSketch: M registers,
each the truncated logarithm (base B) of a minimum of exponential variables over the set.
Registers merge by maximum; two sets' registers agree about as often as the sets overlap.
Bands of ROWS registers give bucket keys. At similarity 0.8 a pair shares no band with
probability (1 - 0.8**5)**40, about 1e-7.

1. Every member of a bucket is paired with the bucket's smallest member, its hub; of the hubs that the
   joint likelihood estimate finds near, each member is compared in full with the one that most
   members are near to, and links are connected. Those that are not connected to it are also compared with the member that has least of its own, of their hub and of a
   bucket's main hub: near copies of one text, which are farther from each other than from it, find it so.
2. Members of a bucket that are still in different components are candidates. Two members with
   the same verified-against hub can only share shingles of the hub, or shingles that both have
   beyond it. So either the smaller of their numbers of shingles that are the hub's, or that over COMMON of its
   members have beyond it, is large enough for a link already (these pairs are joined by ranges of set sizes, within which
   alone that can be), or they share a rarer shingle beyond the hub, on which they are joined: near copies
   of one text, each edited elsewhere, are not paired with each other. Other members of a bucket are paired,
   by ranges of set sizes again, leaving out pairs within the bucket's largest component or of its main hub, and those that
   shingles which no other open class holds rule out. All these bounds are exact. What they
   leave is verified, but for pairs whose estimate is far too low, and connected with the rest.

No link between classes that share a band is lost: its ends are either connected by step 1 or paired in
step 2. Pairs within a component never multiply. What is left of pairs grows with the number of texts that could
be linked by these bounds: subsets of one text of over PERCENT of their size each are compared with each other.

Null and empty texts have no shingles, and are components of their own. Texts with fewer
than k words have one shingle, the whole sequence. Very long texts are taken whole; a task's memory grows with the longest one. Repeated rows belong to the same
class. Rows of one doc_id with different texts are classes of their own, each linked by its own text. Rows with a null doc_id get
the smallest doc_id of their component, or null if all ids in it are null. Ties have no say: a component's id is its smallest doc_id. Other columns are not read,
so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import components, roots
from .words import ROLL_2, SPACED_LOWER, U, lists, mix, words

BANDS, ROWS = 40, 5
M = BANDS * ROWS
#: SetSketch parameters: base, rate, and the largest register value.
B, RATE, TOP = 1.001, 20.0, 65535
#: An estimate this far below the threshold is over five standard deviations off.
SLACK = 0.15
BLOCK = 512
#: How many members of a hub may share a shingle beyond it for the shingle to be joined on.
COMMON = 64
#: Parts that a hub's members are dealt into where they are joined with a row of its own.
SALTS = 32
#: Width of a bin of set sizes, as a share of the size.
FINE = 0.05

_rng = np.random.default_rng(20240229)
_FACTOR = _rng.integers(1, 1 << 63, M, np.int64).astype(U) * U(2) + U(1)
_SHIFT = _rng.integers(0, 1 << 63, M, np.int64).astype(U)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set of 64-bit hashes."""
    least = np.full(M, np.iinfo(U).max, U)
    for at in range(0, len(shingles), BLOCK):
        block = (shingles[at : at + BLOCK, None] ^ _SHIFT) * _FACTOR
        np.minimum(least, block.min(axis=0), out=least)
    uniform = ((least >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(B)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by maximum likelihood, from rows of registers and set sizes.

    The counts of registers above, below and equal have probabilities that depend on the
    similarity and the sizes alone; their log likelihood is concave, so its derivative's root is
    bisected.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    scale = (B - 1) / B
    log_b = np.log(B)

    def parts(j):
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-x * scale) / log_b, -np.log1p(-y * scale) / log_b
        dp, dq = -v * scale / (1 - x * scale) / log_b, -u * scale / (1 - y * scale) / log_b
        return p, q, dp, dq

    for _ in range(30):
        j = (low + high) / 2
        p, q, dp, dq = parts(j)
        slope = above * dp / np.maximum(p, 1e-12) + below * dq / np.maximum(q, 1e-12) - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def shingle_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(text, SPACED_LOWER)
    g, _ = w.grams(k)
    out, bounds = [], w.first.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            whole = w.hash[a : a + 1].copy()
            for h in w.hash[a + 1 : b]:
                whole = whole * U(ROLL_2) + h
            out.append(mix(whole ^ U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def _sketch(k):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2), k)
            pair = np.zeros((len(sets), 2), np.int64)
            held = []
            for i, s in enumerate(sets):
                if len(s):
                    pair[i] = [mix(s * U(ROLL_2)).sum(dtype=U).view(np.int64), mix(s ^ U(ROLL_2)).sum(dtype=U).view(np.int64)]
                    held.append(registers(s).tobytes())
                else:
                    held.append(None)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], n, pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(held, pa.binary())], ["doc_id", "text_key", "n_shingles", "c1", "c2", "sketch"])

    return run


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, c1, c2, sketch): c1 and c2 are a 128-bit digest of the set."""
    return docs.select(F.col("doc_id").cast("long"), text_key(), "text").mapInArrow(_sketch(k), "doc_id long, text_key long, n_shingles long, c1 long, c2 long, sketch binary")


def _sets(k):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), k)
            items = lists(np.concatenate([*sets, np.zeros(0, U)]).view(np.int64), np.array([len(x) for x in sets], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), items], ["node", "items"])

    return run


def _estimates(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (2, 4))
        j = estimate(a, b, *(batch.column(i).to_numpy().astype(float) for i in (3, 5))) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64())], ["u", "v", "estimate"])


def _confirm(percent):
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                same = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * same >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _compare(batches):
    """Of pairs of a node with a hub: the size of the intersection, and the node's items beyond the hub."""
    for batch in batches:
        same, extra = [], []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            both = np.intersect1d(a, b, assume_unique=True)
            same.append(len(both))
            extra.append(np.setdiff1d(a, both, assume_unique=True))
        more = lists(np.concatenate([*extra, np.zeros(0, np.int64)]), np.array([len(x) for x in extra], np.int64), pa.int64())
        sizes = (pa.array(batch.column(i).value_lengths(), pa.int64()) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64()), *sizes, more], ["node", "hub", "same", "size", "hub_size", "extra"])


def _rated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """pairs (u, v) with their estimate, without those whose sizes or estimate rule a link out."""
    a = reps.select(F.col("node").alias("u"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    b = reps.select(F.col("node").alias("v"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = pairs.join(a, "u").join(b, "v").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("u", "v", "sa", "na", "sb", "nb")
    return sized.mapInArrow(_estimates, "u long, v long, estimate double").where(F.col("estimate") >= percent / 100 - SLACK)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("node").alias("u"), F.col("items").alias("ia"))
    b = sets.select(F.col("node").alias("v"), F.col("items").alias("ib"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "ia", "ib")


def _bin(size: Column) -> Column:
    """A number that grows with a set's size, by one for each FINE of it."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(math.log(1 + FINE)))


def _sized_pairs(left: DataFrame, right: DataFrame, group: str, percent: int) -> DataFrame:
    """Rows (node, size, reach, ...) of left and right of one group whose sizes and reach, the most that they can share with
    another set, allow a link; columns of left end with u, those of right with v. Joined by bins of sizes."""
    share = percent / 100
    most = F.least(F.col("sizeu") / share, F.col("reachu") * (1 + share) / share - F.col("sizeu"))
    least = F.col("sizeu") * share
    u = left.select(*(F.col(c).alias(c if c == group else f"{c}u") for c in left.columns)).withColumn("most", most).withColumn("least", least).where("most >= least - 1")
    v = right.select(*(F.col(c).alias(c if c == group else f"{c}v") for c in right.columns)).withColumn("bin", _bin(F.col("sizev")))
    u = u.withColumn("bin", F.explode(F.sequence(_bin(F.col("least") - 1), _bin(F.col("most") + 1)))).drop("most", "least")
    possible = f"100 * least(reachu, reachv) >= {percent} * (sizeu + sizev - least(reachu, reachv))"
    return u.hint("merge").join(v, [group, "bin"]).where(possible)


def _reached(near: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Shingles beyond the hub that two or more members have, with how many do (hub, item, n), and each member's figures
    (hub, node, size, same, often), often being how many of the commoner ones it has."""
    beyond = near.select("hub", "node", F.explode("extra").alias("item"))
    counts = work.cut(beyond.groupBy("hub", "item").agg(F.count("*").alias("n")).where("n > 1"), "hub-counts")
    often = beyond.join(counts.where(f"n > {COMMON}"), ["hub", "item"]).groupBy("hub", "node").agg(F.count("*").alias("often"))
    figures = near.drop("extra").join(often, ["hub", "node"], "left").select("hub", "node", "size", "same", F.coalesce("often", F.lit(0)).alias("often"))
    return counts, work.cut(figures, "reached")


def _dealt(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """rows (key, node, ...) joined with by, one row a key, in SALTS parts of each key: a third of all rows may have one.
    The parts of by are not broadcast: Spark would judge by the size that it has before."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(by.select("*", salts).hint("merge"), [key, "salt"]).drop("salt")


def _central(figures: DataFrame, members: DataFrame, found: DataFrame, work: Workspace) -> DataFrame:
    """Pairs (u, v) of nodes with a central member that they are not connected to: of the hub that they were compared with, or of the hub
    that most members of a bucket were compared with. The central member is the one that has least of its own: if all are
    copies of one text, edited here and there, that is the text, or near to it."""
    others = figures.where("node <> hub")
    center = work.cut(others.groupBy("hub").agg(F.min_by("node", (F.col("size") - F.col("same") - F.col("often")) / F.col("size")).alias("v")), "center")
    of_hub = _dealt(others.select("hub", "node"), center, "hub").select(F.col("node").alias("u"), "v")
    hub_of = others.select("node", "hub").unionByName(center.select(F.col("hub").alias("node"), "hub"))
    main = members.select("key", "node").join(hub_of, "node").groupBy("key", "hub").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "hub")).alias("top"))
    of_key = work.cut(main.select("key", F.col("top.hub").alias("hub")).join(center, "hub").select("key", "v"), "key-center")
    pairs = of_hub.union(members.select("key", F.col("node").alias("u")).join(of_key, "key").select("u", "v")).distinct()
    part = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    apart = pairs.join(part("u"), "u", "left").join(part("v"), "v", "left").where("u <> v and coalesce(cu, u) <> coalesce(cv, v)")
    return work.cut(apart.select("u", "v"), "central-pairs")


def _same_hub(near: DataFrame, counts: DataFrame, figures: DataFrame, found: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Pairs (u, v) of different components that were compared with the same hub and may be linked.

    near has (node, hub, same, size, extra), with a row for each hub itself.
    """
    parts = figures.join(found, "node", "left").select("hub", "node", "size", "same", "often", F.coalesce("component", "node").alias("part"))
    sizes = parts.groupBy("hub", "part").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("k")).where("k > 1")
    parts = work.cut(_dealt(parts, sizes.select("hub", F.col("top.part").alias("main")), "hub").withColumn("outside", F.col("part") != F.col("main")).drop("main"), "hub-parts")
    apart = "partu <> partv and (not outsidev or partu < partv)"
    reached = parts.select("hub", "node", "size", (F.col("same") + F.col("often")).alias("reach"), "part", "outside")
    covered = _sized_pairs(reached.where("outside"), reached, "hub", percent).where(apart).select(F.col("nodeu").alias("u"), F.col("nodev").alias("v"))
    # A node's figures go with each of its shingles: no join gathers the shingles of a long text.
    beyond = near.select("hub", "node", "extra").join(parts, ["hub", "node"]).select("hub", "node", "size", "same", "often", "part", "outside", F.explode("extra").alias("item"))
    rare = work.cut(beyond.join(counts.where(f"n <= {COMMON}"), ["hub", "item"]), "hub-items")
    sides = [rare.select("hub", "item", *(F.col(c).alias(f"{c}{end}") for c in ("node", "size", "same", "often", "part", "outside"))) for end in "uv"]
    shared = sides[0].where("outsideu").join(sides[1], ["hub", "item"]).where(apart).groupBy("hub", "nodeu", "nodev").agg(F.count("*").alias("n"), *(F.first(f"{c}{end}").alias(f"{c}{end}") for c in ("size", "same", "often") for end in "uv"))
    # An intersection has no more than the hub's part, the commoner shingles and the rarer ones that both have.
    shared = shared.withColumn("most", F.expr("n + least(sameu + oftenu, samev + oftenv)")).where(f"100 * most >= {percent} * (sizeu + sizev - most)")
    return covered.union(shared.select("nodeu", "nodev"))


def _joined(found: DataFrame, links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Components (node, component) with further links (u, v), a written table: only components that those connect are joined anew."""
    if links.isEmpty():
        return found
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    bridges = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    merged = work.cut(components(bridges, work, name), f"{name}-merged")
    lone = merged.join(found, "node", "left_anti")
    moved = found.join(merged.select(F.col("node").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left")
    return work.cut(moved.select("node", F.coalesce("new", "component").alias("component")).union(lone), f"{name}-all")


def _shared_sizes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, common): set sizes, and how many of a set's shingles another of the nodes holds too."""
    held = sets.join(nodes, "node", "left_semi")
    alone = held.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last").groupBy("node").agg(F.count("*").alias("alone"))
    return held.select("node", F.size("items").alias("size")).join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _cross(parts: DataFrame, sets: DataFrame, near: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Pairs (u, v) of one bucket, but of different components and verified-against hubs, that may be linked. parts: (key, node, part)."""
    sizes = parts.groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = work.cut(parts.join(work.cut(sizes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "several"), "key"), "mixed")
    shared = work.cut(_shared_sizes(sets, mixed.select("node").distinct()), "shared")
    # A set shares at most `common` shingles with any other; below the threshold on its own, it has no link.
    hubs = near.select("node", F.col("hub").alias("near_hub"))
    open_ = mixed.join(shared, "node").where(f"100 * common >= {percent} * size").join(hubs, "node", "left")
    open_ = work.cut(open_.select("key", "node", "size", F.col("common").alias("reach"), "part", F.coalesce("near_hub", "node").alias("hub")), "open")
    # Of a pair, one is outside the bucket's largest component, and one is of another hub than its main one: whichever are fewer are paired.
    top = lambda by: open_.groupBy("key", by).agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", by)).alias(f"top_{by}"))
    tops = work.cut(top("part").join(top("hub"), "key"), "tops")
    fewer = F.when(F.col("top_part.n") >= F.col("top_hub.n"), F.col("part") != F.col("top_part.part")).otherwise(F.col("hub") != F.col("top_hub.hub"))
    left = open_.join(tops, "key").where(fewer).select(*open_.columns)
    return _sized_pairs(left, open_, "key", percent).where("partu <> partv and hubu <> hubv").select(F.col("nodeu").alias("u"), F.col("nodev").alias("v"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, chosen) for each row of docs.

    kept: the row's id is its component's. chosen: the row is of the one text that stands for its component, also where
    ids repeat or are null; rows without shingles are.
    """
    work = Workspace(docs.sparkSession, "near")
    all_ = work.cut(sketches(docs, k), "sketches")
    full = all_.where("n_shingles > 0")
    # One row of each class stands for it; node, a number that is fixed once it is written, names the class.
    grouped = full.groupBy("c1", "c2").agg(F.min("doc_id").alias("first_id"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("first_key"))
    # In the order of ids, so that hubs are what others were copied from, where copies come later.
    classes = work.cut(work.cut(grouped, "grouped").orderBy(F.asc_nulls_last("first_id")).withColumn("node", F.monotonically_increasing_id()), "classes")
    first_row = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    of_class = classes.select("first_id", "first_key", "node")
    reps = work.cut(full.join(of_class, first_row).select("node", "n_shingles", "sketch").dropDuplicates(["node"]), "reps")
    piece = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keyed = reps.select("node", F.explode(piece).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    # Written first: a join of two plain exchanges is one whose hot buckets Spark can split.
    members = work.cut(keyed.join(work.cut(hubs, "hubs"), "key"), "members")

    wanted = of_class.join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long"), text_key(), "text").join(wanted, first_row).select("node", "text").dropDuplicates(["node"])
    sets = work.cut(texts.mapInArrow(_sets(k), "node long, items array<long>"), "sets")

    first = _rated(members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), reps, percent)
    # The hub that most members are near to: so few pairs as possible have different hubs.
    rated = work.cut(first, "rated")
    weight = work.cut(rated.groupBy("v").agg(F.count("*").alias("n")), "weight")
    best = rated.join(weight, "v").groupBy("u").agg(F.max(F.struct("n", "estimate", "v")).alias("m")).select("u", F.col("m.v").alias("v"))
    compared = _with_sets(best, sets).mapInArrow(_compare, "node long, hub long, same long, size long, hub_size long, extra array<long>")
    near = work.cut(compared, "near")
    links = near.where(f"100 * same >= {percent} * (size + hub_size - same)").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    # One link a node, to a smaller one.
    found = work.cut(roots(links, work, "c1"), "components")
    itself = near.select(F.col("hub").alias("node"), "hub", F.col("hub_size").alias("same"), F.col("hub_size").alias("size"), F.array().cast("array<long>").alias("extra")).dropDuplicates(["node"])
    grouped_ = near.select("node", "hub", "same", "size", "extra").unionByName(itself)
    counts, figures = _reached(grouped_, work)
    central = work.cut(_with_sets(_rated(_central(figures, members, found, work), reps, percent), sets).mapInArrow(_confirm(percent), "u long, v long"), "central")
    found = _joined(found, central, work, "c2")

    parts = work.cut(members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")), "parts")
    pairs = _cross(parts, sets, near, percent, work).union(_same_hub(grouped_, counts, figures, found, percent, work))
    pairs = work.cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    more = work.cut(_with_sets(_rated(pairs, reps, percent), sets).mapInArrow(_confirm(percent), "u long, v long"), "more")
    final = _joined(found, more, work, "c3")

    ids = work.cut(classes.join(final, "node", "left").select("c1", "c2", "node", "first_id", F.coalesce("component", "node").alias("component")), "ids")
    # Written first, so that Spark can split a component that many classes are in.
    named = ids.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("least"))
    named = work.cut(named.select("component", "component_id", F.col("least.node").alias("chosen_node")), "named")
    label = work.cut(ids.join(named, "component").select("c1", "c2", "component_id", "first_id", (F.col("node") == F.col("chosen_node")).alias("of_chosen")), "label")
    work.drop("members", "weight", "hubs", "parts", "several", "mixed", "open", "tops", "shared", "near", "rated", "sets", "pairs", "reps", "hub-parts", "hub-counts", "hub-items", "reached", "center", "key-center", "central-pairs", "central", "more", "components", "c2-merged", "c2-all", "c3-merged", "c3-all", "ids", "named", "grouped", "classes")

    joined = all_.drop("sketch").join(label, ["c1", "c2"], "left")
    some = F.col("n_shingles") > 0
    component = F.when(some, F.col("component_id")).otherwise(F.col("doc_id"))
    chosen = ~some | (F.col("of_chosen") & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", chosen.alias("chosen")).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "chosen")
