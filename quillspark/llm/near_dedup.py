"""Operator 4: near-duplicate groups by MinHash bands, odd sketches and a check on full shingle sets.

1. Each text becomes its set of distinct k-word shingles (64-bit hashes) and, from it, 128 MinHash samples, 32 bands of 4
   samples, and an odd sketch: every sample is hashed to one bit of a 512-bit map, which it flips. Texts with equal sets
   form a class, and only one row of each class goes on.
2. Every class is paired with the least class id of each band bucket it is in. The odd sketches' XOR population count
   estimates the similarity of a pair; each class is checked on full sets with its most similar one, and the links' components are found.
3. Buckets that still hold more than one component are cut into blocks of fixed size, and in each pair of blocks the sketches are compared. A task hands on only a
   forest: at most one pair for each component that it joins to another, never all pairs. Components that may be alike so make families.
4. Families are cut into blocks of a fixed number of shingles, and each pair of blocks is compared by sketch and then on full sets; again only a forest of
   confirmed links leaves the task. Blocks that lie wholly in one component are not paired with each other, so a large group of copies costs its
   size times the number of texts outside its component. The components of all links are the result.
Pairs inside one component need no check, and no link that could join two components is left out.

At similarity 0.8 a pair shares no band with probability 5e-8. The sketch filter's margin is over six standard deviations. There is no cap
on buckets or partners. Work still grows with the square of a family that neither a hub nor a confirmed link holds together.

Defined cases: null, empty and all-space texts have no shingles and are linked with nothing; a text with fewer than k words
is one shingle, its whole sequence; A-Z are lower-cased and no other letters; repeated rows fall in one class. Rows with one id
and several texts are linked each for itself; component_id is the smallest id of the rows reached (null only if all of them are null), a row is kept if its id is that one (null is equal to null),
and `drop_near_copies` keeps one row of a component in any case. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import anti_by_bloom, give_back, join_by_size, join_groups, keyed_rows, materialise, mix64, pieces, release, semi_by_bloom, texts_of, window_hashes, word_hashes
from .components import components

BANDS, ROWS, SKETCH_BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
#: Size of a block: sketches of a band bucket, shingles of a family. A call of a task compares about two blocks.
SKETCHES, SHINGLES = 4096, 1 << 20
#: Subtracted from the threshold before a sketch estimate can reject a pair: over six standard deviations of the estimate.
MARGIN = 0.3
_rng = np.random.default_rng(20240229)
_MULT = (_rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SALT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(k, len(h))))


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.uint64(2**64 - 1))
    for i in range(0, len(s), 2048):
        np.minimum(out, np.multiply.outer(_MULT, s[i : i + 2048]).min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Eight 64-bit words: bit b is set if an odd number of samples hash to b."""
    flips = np.bincount((mix64(samples ^ _SALT) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def bands_of(samples: np.ndarray) -> np.ndarray:
    m, acc = samples.reshape(BANDS, ROWS), _SALT[:BANDS].copy()
    for j in range(ROWS):
        acc = mix64(acc ^ m[:, j])
    return acc.view(np.int64)


def most_differing_bits(threshold: float) -> int:
    """The largest XOR population count at which the odd-sketch estimate 1 + n/4k ln(1 - 2c/n) is above threshold - MARGIN."""
    low = threshold - MARGIN
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp((low - 1) * 4 * SAMPLES / SKETCH_BITS)))


def signatures(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches):
            n, lo, hi, bands, sketch = [], [], [], [], []
            for t in texts_of(b):
                s = shingles(t, k)
                n.append(len(s))
                if len(s):
                    m = minhash(s)
                    key = mix64(s)
                    lo.append(int(key.sum(dtype=np.uint64).view(np.int64)))
                    hi.append(int(np.bitwise_xor.reduce(mix64(key)).view(np.int64)))
                    bands.append(bands_of(m))
                    sketch.append(odd_sketch(m))
                else:
                    lo.append(0), hi.append(0), bands.append(None), sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
                + [pa.array(x, pa.list_(pa.int64())) for x in (bands, sketch)],
                names=["id", "n", "lo", "hi", "bands", "sketch"],
            )

    return df.select(id_col, text_col).mapInArrow(run, "id long, n long, lo long, hi long, bands array<long>, sketch array<long>")


def shingle_sets(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches):
            sets = [shingles(t, k).view(np.int64) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return df.select(id_col, text_col).mapInArrow(run, "id long, shingles array<long>")


def differing_bits(a: str, b: str):
    x = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)]
    return sum(x[1:], x[0])


def nearest_hub(stars: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """For each b of stars(a, b) the most similar a by sketch, if it may reach the threshold and is in another component of texts(id, component, sketch)."""
    sa, sb = (texts.select(F.col("id").alias(c), F.col("sketch").alias(f"k{c}"), F.col("component").alias(f"c{c}")) for c in "ab")
    near = stars.join(sb, "b").join(sa, "a").where("ca <> cb").select("a", "b", differing_bits("ka", "kb").alias("bits")).where(F.col("bits") <= most)
    return near.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full shingle sets."""
    of_a, of_b = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    j = pairs.select("a", "b").join(of_a, "a").join(of_b, "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return j.select("a", "b", both.alias("x"), (F.size("sa") + F.size("sb") - both).alias("u")).where(F.col("x") * 100 >= F.col("u") * percent).select("a", "b")


def confirmed(df: DataFrame, pairs: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    wanted = pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()
    wanted = materialise(wanted, "to-check")
    texts = semi_by_bloom(df.select(id_col, text_col), id_col, wanted, wanted.count())
    return similar(pairs, materialise(shingle_sets(texts, k, id_col, text_col), "sets"), percent)


def block_pairs(rows: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """`rows` with block, x, y, once for each pair of blocks (x, y) of its `group` that it is compared in; a block has about `most` of `size`.

    A component with an eighth of a block or more has blocks of its own, which aren't paired with each other; the other components share blocks.
    """
    parts = rows.groupBy(group, "component").agg(F.sum(size).alias("w"))
    parts = parts.withColumn("kind", F.when(F.col("w") * 8 >= most, F.col("component")).otherwise(F.lit(-1)))
    kinds = parts.groupBy(group, "kind").agg(F.ceil(F.sum("w") / most).cast("int").alias("blocks"))
    key = lambda kind, i: F.xxhash64(kind, i.cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.col("kind").alias("kind"), key(F.col("kind"), i).alias("block")))
    every = kinds.groupBy(group).agg(F.flatten(F.collect_list(blocks)).alias("all"))
    at = join_groups(rows, parts.select(group, "component", "kind").join(kinds, [group, "kind"]), [group, "component"], "id", 1)
    at = at.withColumn("block", key(F.col("kind"), F.pmod(F.xxhash64("id"), F.col("blocks")))).drop("blocks")
    at = join_groups(at, every, [group], "id", 1)
    others = F.filter("all", lambda o: (o["kind"] != F.col("kind")) | (o["kind"] == -1))
    at = at.withColumn("other", F.explode(F.transform(others, lambda o: o["block"])))
    return at.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("all", "kind", "other")


def common_sizes(sets: list[np.ndarray]):
    """A function (i, js) -> sizes of the intersections of set i with the sets js."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    mark = np.zeros(len(codes), bool)

    def common(i: int, js: np.ndarray) -> np.ndarray:
        own = codes[start[i] : start[i] + size[i]]
        mark[own] = True
        ends = np.cumsum(size[js])
        at = np.arange(ends[-1]) + np.repeat(start[js] - (ends - size[js]), size[js])
        out = np.add.reduceat(mark[codes[at]], ends - size[js], dtype=np.int64)
        mark[own] = False
        return out

    return common


def forest(component, block, size, sketch, percent: int, most: int, sets=None) -> list[tuple[int, int]]:
    """Rows (i, j) whose components may be alike by size and sketch, and are linked on full sets if these are given: one pair for each merge of components.

    `block` is None inside one block; else only rows of different blocks are compared.
    """
    label, out = np.unique(component, return_inverse=True)[1], []
    common = common_sizes(sets) if sets is not None else None
    for i in range(len(label) - 1):
        js = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if block is not None:
            js = js[block[js] != block[i]]
        # A pair's similarity is at most the ratio of the set sizes.
        js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
        js = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1) <= most]
        if common is not None and len(js):
            both = common(i, js)
            js = js[100 * both >= percent * (size[js] + size[i] - both)]
        for j in js.tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def forests(rows: DataFrame, group: str, weight: str, limit: int, percent: int, most: int, full: bool) -> DataFrame:
    """Distinct (a, b) of the rows that `forest` finds in each pair of blocks: ids if full sets are compared, else components."""
    total = rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    calls = max(1, math.ceil(total / limit))

    def find(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["g", "x", "y"], kind="stable")
        key = pdf[["g", "x", "y"]].to_numpy(np.int64)
        comp, size, block, name = (pdf[c].to_numpy(np.int64) for c in ("component", "n", "block", "id" if full else "component"))
        sketch = np.stack(pdf["sketch"].to_list()).view(np.uint64)
        sets = pdf["shingles"].to_list() if full else None
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        pairs = set()
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            own = None if key[s, 1] == key[s, 2] else block[s:e]
            found = forest(comp[s:e], own, size[s:e], sketch[s:e], percent, most, sets[s:e] if full else None)
            pairs.update((int(name[s + i]), int(name[s + j])) for i, j in found)
        del pdf, key, comp, size, block, name, sketch, sets
        give_back()
        return pd.DataFrame(sorted(pairs), columns=["a", "b"]).astype("int64")

    dealt = rows.withColumnRenamed(group, "g").withColumn("call", F.pmod(F.xxhash64("g", "x", "y"), F.lit(calls)))
    return dealt.groupBy("call").applyInPandas(find, "a long, b long").distinct()


def links_between_components(df: DataFrame, at: DataFrame, texts: DataFrame, percent: int, most: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) that join components of at(band, id) over texts(id, component, n, sketch)."""
    rows = materialise(block_pairs(at.select("band", "id").join(texts, "id").withColumn("one", F.lit(1)), "band", "one", SKETCHES), "sketch-blocks")
    alike = materialise(forests(rows, "band", "one", SKETCHES, percent, most, False), "alike")
    release(rows)
    family = components(alike).select(F.col("node").alias("component"), F.col("component").alias("family"))
    todo = materialise(texts.join(family, "component"), "families")
    wanted = semi_by_bloom(df.select(id_col, text_col), id_col, todo.select(F.col("id").alias(id_col)), todo.count())
    sets = shingle_sets(wanted, k, id_col, text_col)
    rows = materialise(block_pairs(todo, "family", "n", SHINGLES).join(sets, "id"), "set-blocks")
    links = materialise(forests(rows, "family", "n", 2 * SHINGLES, percent, most, True), "links")
    release(rows, alike, family, todo)
    return links


def linked(df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, component): the size of each row's set and the smallest id reachable. Ids tell rows apart."""
    most = most_differing_bits(percent / 100)
    sig = materialise(signatures(df, k, id_col, text_col), "signatures")
    some = sig.where("n > 0")
    classes = some.groupBy("n", "lo", "hi").agg(F.min("id").alias("rep"))
    members = materialise(join_groups(some.select("id", "n", "lo", "hi"), classes, ["n", "lo", "hi"], "id").select("id", "n", "rep"), "members")
    copies = members.where("id <> rep").select("id")
    reps = anti_by_bloom(some.select("id", "n", "bands", "sketch"), "id", copies, copies.count())
    reps = materialise(reps, "classes")
    sketches = reps.select("id", "n", "sketch", F.col("id").alias("component"))

    in_band = reps.select("id", F.explode("bands").alias("band"))
    buckets = in_band.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub")).where("size > 1")
    shared = materialise(join_by_size(in_band, buckets, ["band"], "size").select("band", "id", "hub"), "shared-bands")

    stars = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = materialise(confirmed(df, nearest_hub(stars, sketches, most), percent, k, id_col, text_col), "links")
    comp = components(links)

    at = shared.select("band", "id", "hub").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    banded = materialise(at.select("band", "id", F.coalesce("component", "id").alias("component")), "banded")
    mixed = banded.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y")
    at = materialise(join_by_size(banded, mixed, ["band"], "size").select("band", "id", "component"), "mixed-bands")
    texts = materialise(at.select("id", "component").distinct().join(sketches.select("id", "n", "sketch"), "id"), "mixed-texts")
    more = links_between_components(df, at, texts, percent, most, k, id_col, text_col)
    comp = components(links.unionByName(more)) if more.limit(1).count() else comp
    release(reps, shared, links, banded, at, texts, more)

    out = members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.select("id", "n", F.coalesce("component", "rep").alias("component"))
    return out.unionByName(sig.where("n = 0").select("id", "n", F.col("id").alias("component")))


def linked_rows(rows: DataFrame, key: str, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, own, least, first) for each of `rows`: its key, its set's size, its own id, and of its component the smallest id and the key of the first row with it."""
    out = linked(rows, k, percent, key, text_col)
    if key == id_col:
        return out.select("id", "n", F.col("id").alias("own"), F.col("component").alias("least"), F.col("component").alias("first"))
    named = materialise(out.join(rows.select(F.col(key).alias("id"), F.col(id_col).cast("bigint").alias("own")), "id"), "named-components")
    first = F.min_by("id", F.struct(F.isnull("own"), "own", "id")).alias("first")
    least = named.groupBy("component").agg(F.min("own").alias("least"), first, F.count(F.lit(1)).alias("size"))
    return join_by_size(named, least, ["component"], "size").select("id", "n", "own", "least", "first")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: `id_col`, n_shingles, component_id (the smallest id reachable), kept."""
    rows, key = keyed_rows(df, id_col, [id_col, text_col])
    out = linked_rows(rows, key, k, percent, id_col, text_col)
    return out.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("own").eqNullSafe(F.col("least")).alias("kept"))


def drop_near_copies(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one row of each group of near-duplicates; columns stay as they are."""
    rows, key = keyed_rows(df, id_col, df.columns)
    lost = linked_rows(rows, key, k, percent, id_col, text_col).where("id <> first").select(F.col("id").alias(key))
    lost = materialise(lost, "near-copies")
    return anti_by_bloom(rows, key, lost, lost.count()).select(*df.columns)
