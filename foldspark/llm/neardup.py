"""MinHash near-duplicates: banded candidates, odd sketches, confirmation on full shingle sets, components.

1. One pass over the texts gives every document its distinct ``k``-word shingles, a 128-bit digest of that set, MinHash
   samples folded into band keys, and an odd sketch: a bitmap holding the parity of the samples hashed to each bit.
2. Documents with equal sets form one class, whose smallest id is its node; all later work is on nodes, so a group of
   copies costs one node however large it is.
3. Every bucket of a band links its members to its smallest node: a star, never all pairs. Pairs whose sketches' XOR
   has too many bits for the wanted similarity go; the rest are confirmed on the full sets of their texts.
4. Connected components of the confirmed links. In buckets whose members still lie in different components, another
   round of stars follows, around a member picked by a hash that differs from bucket to bucket.
5. Buckets that are torn even then are compared member against member across components. In small ones the sketches
   filter inside a join, each pair in its first common bucket only. Large ones that share members are taken together.
   The members outside the group's largest component (few, as a rule) are compared with all members, a block of each in
   a task that holds a bounded number of shingles and lists only links that join two components. So no link between
   two components is lost, the pairs of a group are never listed, and texts of the largest component are sent once for
   each block of the others, not once for each block of the group.

With 50 bands of 6 rows a pair of similarity 0.8 escapes every band with probability 3e-7; the sketch limit lies five
standard deviations beside the expected distance of such a pair. Nothing is dropped, capped or sampled.

Edge cases: null, empty and blank texts have no shingles, are linked with nothing and kept. Texts of fewer than ``k``
words are one shingle. Repeated rows are in one class. A row whose id is null takes the smallest id of its class, or
null if it has none. Rows that repeat an id with another text are compared by their own texts; two groups in which the
repeated id is the smallest have that id as component and are one. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .scratch import BROADCAST_BYTES, cut, maybe_broadcast, text_batches

BANDS, ROWS, BITS = 50, 6, 1024
#: Rounds of stars around hashed centres.
ROUNDS = 1
#: Members from which a torn bucket is compared in blocks, and shingles of a block (one text at least).
LARGE, BLOCK = 64, 200_000
#: Bytes of a row of group members (id, component, group, block and sketch), for the broadcast bound.
MEMBER_BYTES = 256
_SIG = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch array<bigint>"


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(texts, bits / 64) words: bit j is the parity of the samples that hash to j."""
    k, n = samples.shape
    at = W.mix((samples.astype(np.uint64) << np.uint64(16)) + np.arange(k, dtype=np.uint64)[:, None]) % np.uint64(bits)
    at = at.astype(np.int64) + np.arange(n)[None, :] * bits
    odd = (np.bincount(at.ravel(), minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def sketch_similarity(differing: float, samples: int, bits: int = BITS) -> float:
    """The similarity at which two odd sketches differ in ``differing`` bits."""
    left = 1 - 2 * differing / bits
    return 0.0 if left <= 0 else max(0.0, 1 + bits * math.log(left) / (4 * samples))


def sketch_limit(similarity: float, samples: int, bits: int = BITS) -> int:
    """Most differing bits that a pair of at least ``similarity`` shows, five standard deviations beyond the mean.

    The number of differing samples is binomial; each flips two bits of the XOR, and flips that meet cancel.
    """
    differing = samples * (1 - similarity)
    left = math.exp(-4 * differing / bits)
    slope = 2 * left
    meeting = min(bits * (1 - left * left) / 4, (2 * differing) ** 2 * 2 / bits)
    deviation = math.sqrt(slope**2 * samples * max(similarity * (1 - similarity), 0.02) + meeting)
    return int(bits * (1 - left) / 2 + 5 * deviation) + 1


def signatures(
    docs: DataFrame, words: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set (set_a, set_b), band keys and odd sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, values, at in W.shingle_sets(batch.column(1), words):
                n = np.diff(at)
                full = np.flatnonzero(n)
                begins = at[:-1][full]
                set_a, set_b = (np.zeros(end - row, np.uint64) for _ in range(2))
                keys, sketch = np.zeros((0, bands), np.int64), np.zeros((0, BITS // 64), np.int64)
                if len(full):
                    set_a[full] = np.add.reduceat(W.mix(values), begins)
                    set_b[full] = np.add.reduceat(W.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)
                    samples = W.minhash(values, np.append(begins, at[-1]), bands * rows)
                    keys = np.stack([W.mix(W.fold(samples[b * rows : (b + 1) * rows]) + np.uint64(b)) for b in range(bands)], 1).view(np.int64)
                    sketch = odd_sketch(samples)
                bounds = np.zeros(end - row + 1, np.int32)
                np.cumsum(n > 0, out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row:end],
                        pa.array(n),
                        pa.array(set_a.view(np.int64)),
                        pa.array(set_b.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds * bands), pa.array(keys.ravel())),
                        pa.ListArray.from_arrays(pa.array(bounds * (BITS // 64)), pa.array(sketch.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, _SIG)


def _sized(df: DataFrame, rows: int, per: int = 50_000) -> DataFrame:
    """``df``, a join or aggregate of about ``rows`` counted rows, in tasks of about ``per`` rows (eight at least)."""
    return df.coalesce(max(8, -(-rows // per)))


def _apart(a: str, b: str, limit: int):
    """Whether two odd sketches differ in at most ``limit`` bits."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0)) <= limit


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (u, v) with den * intersection >= num * union of the full shingle sets of their texts."""
    n = pairs.count()
    ids = cut(_sized(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), n), "ids")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(maybe_broadcast(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = []
                for column in (2, 3):
                    sets = []
                    for _, _, values, bounds in W.shingle_sets(part.column(column), words):
                        sets += np.split(values, bounds[1:-1])
                    sides.append(sets)
                for i, (a, b) in enumerate(zip(*sides, strict=True)):
                    both = np.concatenate([a, b])
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[at + i] = shared > 0 and den * shared >= num * (len(both) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = texts.withColumnsRenamed({"id": "u", "text": "text_u"})
    right = texts.withColumnsRenamed({"id": "v", "text": "text_v"})
    rows = _sized(_sized(pairs.join(left, "u"), n, 1000).join(right, "v"), n, 1000).select("u", "v", "text_u", "text_v")
    return cut(_sized(rows.mapInArrow(run, "u bigint, v bigint").distinct(), n), "links")


def _links(rows: pd.DataFrame, words: int, num: int, den: int, limit: int) -> pd.DataFrame:
    """Confirmed links between the rows marked ``minor`` and all rows, one for each two components that they join."""
    rows = rows.sort_values(["node", "minor"]).drop_duplicates(["node", "minor"]).reset_index(drop=True)
    sets: list[np.ndarray] = []
    for _, _, values, at in W.shingle_sets(pa.array(rows["text"], pa.string()), words):
        sets += np.split(values, at[1:-1])
    sketch = np.stack(rows["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
    node, comp, minor = (rows[c].to_numpy() for c in ("node", "comp", "minor"))
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for a in np.flatnonzero(minor).tolist():
        near = np.flatnonzero(~minor & (comp != comp[a]))
        near = near[np.bitwise_count(sketch[near] ^ sketch[a]).sum(axis=1) <= limit]
        near = near[[find(c) != find(comp[a]) for c in comp[near].tolist()]] if len(near) else near
        for at in range(0, len(near), 256):
            part = near[at : at + 256]
            sizes = np.array([len(sets[b]) for b in part])
            both = np.isin(np.concatenate([sets[b] for b in part]), sets[a])
            shared = np.add.reduceat(both, np.concatenate([[0], sizes.cumsum()[:-1]]), dtype=np.int64)
            for b in part[den * shared >= num * (len(sets[a]) + sizes - shared)].tolist():
                x, y = find(comp[a]), find(comp[b])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(node[a], node[b]), max(node[a], node[b])))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node connected with each node that has an edge (u, v).

    Alternates large-star and small-star steps until the edges form stars; each step is an aggregation and a join, and
    the edges of a round are written to the shared folder.
    """

    def stars(e: DataFrame) -> bool:
        """Whether every node has one edge down, or only edges up."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
        return _sized(ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")), n).where("down > 1 or down = 1 and up = 1").isEmpty()

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return _sized(both.where("v > u").join(least, "u"), n).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = _sized(down.join(least, "u"), n)
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))

    n = edges.count()
    now = cut(_sized(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), n), "star")
    while not stars(now):
        now = cut(_sized(small_star(large(now).where("u <> v")).where("u <> v").distinct(), n), "star")
    return cut(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(_sized(now.select("v", "v").distinct(), n)), "components")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    similarity: tuple[int, int] = (80, 100),
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    ``similarity`` is a fraction: documents link if den * intersection >= num * union. See the module for edge cases.
    """
    text_batches(docs.sparkSession)
    num, den = similarity
    limit = sketch_limit(num / den, bands * rows)
    sig = cut(signatures(docs, words, bands, rows, id_col, text_col), "signatures")
    classes = sig.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles")
    classes = classes.agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes, "classes")
    nodes = classes.where("node is not null").select("node", "sketch", "n_shingles")

    def near(pairs: DataFrame, rows: int) -> DataFrame:
        """Pairs within the sketch limit, of at most ``rows``."""
        u, v = (nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
        pairs = _sized(_sized(pairs, rows).join(u, "u"), rows)
        return _sized(pairs.join(v, "v"), rows).where(_apart("sketch_u", "sketch_v", limit)).select("u", "v")

    def across(torn: DataFrame) -> DataFrame:
        """Pairs of members of one small bucket in different components, within the sketch limit."""
        n = torn.count()
        torn = torn.where(F.col("n") < LARGE).join(classes.where("node is not null").select("node", "sketch", "bands"), "node")
        left, right = (torn.select("key", "lo", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "comp", "sketch", "bands"))) for side in "uv")
        fresh = (F.col("node_u") < F.col("node_v")) & (F.col("node_u") != F.col("lo")) & (F.col("comp_u") != F.col("comp_v"))
        first = F.filter(F.zip_with("bands_u", "bands_v", lambda a, b: F.when(a == b, a)), lambda k: k.isNotNull())[0] == F.col("key")
        pairs = _sized(left.join(right.drop("lo"), "key"), n).where(fresh & _apart("sketch_u", "sketch_v", limit) & first)
        return cut(_sized(pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct(), n), "across")

    def within(torn: DataFrame) -> DataFrame:
        """Links (u, v) between components that share a large bucket, enough of them to join these components."""
        large = torn.where(F.col("n") >= LARGE)
        group = components(large.select(F.col("node").alias("u"), F.col("lo").alias("v"))).withColumnRenamed("comp", "group")
        members = large.select("node", "comp").distinct().join(group, "node").join(nodes, "node")
        members = cut(_sized(members, large.count()), "members")
        sizes = members.groupBy("group", "comp").agg(F.sum("n_shingles").alias("n"))
        most = F.max(F.struct("n", F.col("comp").alias("major"))).alias("m")
        sizes = sizes.groupBy("group").agg(F.sum("n").alias("every"), most)
        blocks = [F.ceil(n / BLOCK).cast("int") for n in (F.col("every"), F.col("every") - F.col("m.n"))]
        sizes = sizes.select("group", "m.major", blocks[0].alias("blocks"), blocks[1].alias("minors"))
        members = members.join(sizes, "group").where("minors > 0").drop("n_shingles")
        hashed = F.xxhash64("node")
        own = F.when(F.col("comp") != F.col("major"), F.pmod(hashed, "minors").cast("int"))
        members = members.withColumns({"j": F.pmod(hashed, "blocks").cast("int"), "own": own}).drop("major")
        members = cut(members, "blocks")
        texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).cast("string").alias("text"))
        rows = texts.join(maybe_broadcast(members, BROADCAST_BYTES // MEMBER_BYTES), "node")
        # A member of block j meets every block i of the others; one of the others takes its block i to every j.
        to = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: F.struct(i.alias("i"), F.col("j"), F.lit(False).alias("minor")))
        by = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("minor")))
        sent = F.explode(F.when(F.col("own").isNull(), to).otherwise(F.concat(to, by))).alias("s")
        rows = rows.select("group", "node", "comp", "sketch", "text", sent).select("*", "s.*").drop("s")
        found = rows.groupBy("group", "i", "j").applyInPandas(
            lambda block: _links(block, words, num, den, limit), "u bigint, v bigint"
        )
        return cut(found.distinct(), "within")

    keyed = classes.where("node is not null").select(F.explode("bands").alias("key"), "node")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    buckets = cut(buckets, "buckets")
    crowded = keyed.join(buckets.where("n > 2").select("key", "n", "lo"), "key")
    crowded = cut(crowded, "crowded")
    stars = buckets.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    stars = stars.union(crowded.where("node <> lo").select(F.col("lo").alias("u"), F.col("node").alias("v"))).distinct()
    links = confirmed(cut(near(stars, buckets.count() + crowded.count()), "pairs"), docs, words, num, den, id_col, text_col)
    comps = components(links)

    def torn(comps: DataFrame) -> DataFrame:
        """Members of buckets that lie in more than one component, with their components."""
        n = crowded.count()
        members = _sized(crowded.join(comps, "node", "left"), n, 200_000).select("key", "n", "lo", "node", F.coalesce("comp", "node").alias("comp"))
        members = cut(members, "members")
        keys = members.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        return cut(_sized(members.join(keys, "key", "left_semi"), n, 200_000), "torn")

    left_over = torn(comps)
    for turn in range(ROUNDS):
        if left_over.isEmpty():
            break
        centre = left_over.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("u"), F.col("comp").alias("comp_u")), F.xxhash64("node", "key", F.lit(turn))).alias("c"))
        pairs = _sized(left_over.join(centre, "key"), left_over.count()).where("comp <> c.comp_u and node <> lo and c.u <> lo")
        pairs = pairs.select(F.least("node", "c.u").alias("u"), F.greatest("node", "c.u").alias("v")).distinct()
        more = confirmed(cut(near(pairs, left_over.count()), "pairs"), docs, words, num, den, id_col, text_col)
        if not more.isEmpty():
            links = cut(links.union(more), "links")
            comps = components(links)
            left_over = torn(comps)
    rest = across(left_over)
    found = [confirmed(rest, docs, words, num, den, id_col, text_col)] if not rest.isEmpty() else []
    if not left_over.where(F.col("n") >= LARGE).isEmpty():
        found.append(within(left_over))
    found = [more for more in found if not more.isEmpty()]
    for more in found:
        links = links.union(more)
    if found:
        comps = components(links)

    label = classes.join(comps, "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    out = sig.select("doc_id", "n_shingles", "set_a", "set_b").join(label, ["set_a", "set_b", "n_shingles"], "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in the written table ``ids`` (column ``id``); the size of ``ids`` picks the join."""
    return docs.join(maybe_broadcast(ids), docs[id_col] == ids["id"], "left_anti")


def _numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and its name: the ids, or numbers written with the rows where
    an id is null or repeats."""
    n = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    if n.where("id is null or n > 1").isEmpty():
        return docs, id_col
    name = "row"
    while name in docs.columns:
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def deduplicate(
    docs: DataFrame,
    words: int = 5,
    similarity: tuple[int, int] = (80, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of every group of near-duplicates, with all columns: a row of the smallest id (nulls come last).

    Rows are told apart one by one, so rows without id and other texts under a repeated id take part like all others.
    Rows without words are linked with nothing and stay. An empty table gives an empty result.
    """
    rows, key = _numbered(docs, id_col)
    found = near_duplicates(rows, words, similarity, id_col=key, text_col=text_col)
    if key == id_col:
        dropped = found.where("not kept").select(F.col("doc_id").alias("id"))
        return without(rows, cut(dropped, "dropped"), key)
    found = cut(found.select(F.col("doc_id").alias("row"), "component_id"), "groups")
    many = cut(found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "many")
    found = found.join(maybe_broadcast(many), "component_id", "left_semi")
    named = found.join(rows.select(F.col(key).alias("row"), F.col(id_col).alias("id")), "row")
    named = named.select("component_id", F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("r"))
    named = cut(named, "named")
    first = named.groupBy("component_id").agg(F.min("r").alias("first"))
    dropped = named.join(first, "component_id").where("r.row <> first.row").select(F.col("r.row").alias("id"))
    return without(rows, cut(dropped, "dropped"), key).drop(key)
