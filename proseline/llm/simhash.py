"""Operator 1, SimHash near-duplicates: segment-popcount embedding, grid range join, exact verification.

A fingerprint's 64 bits form 32 segments of two bits. The vector of the segments' bit counts is its embedding; the
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. If that is 3 or less, one half
of the vector (16 segments) is within distance 1. The grid has a cell for each value of each half, and the range join
looks in a fingerprint's own cell and in those one step above it (the steps below are the other side's steps above).
Pairs that meet are verified on the whole fingerprint within the join itself.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseline.llm.common import body, cut, files, guarded, slices, split_join
from proseline.llm.graph import components
from proseline.llm.words import Hashes, Powers, hashed, windows

SEED = 42
#: Distance that two halves of 16 segments and one step of the grid cover.
RADIUS = 3
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Classes beyond which segments have one bit.
WIDE = 1 << 22
#: Bands of least shingle hashes that bring similar documents together, and hashes in each. Two texts of similarity 0.8 share
#: a band with a chance of 0.992, of 0.9 with one of 0.999995.
BANDS, BAND_ROWS = 16, 6
#: Pairs, and bytes of sets, up to which they are broadcast.
FEW_PAIRS, FEW_BYTES = 500_000, 32 << 20


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        count = len(part) - shingle + 1
        grams = zip(*(part[i : i + count] for i in range(shingle)), strict=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), ">u8", count)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",), bands: int = 0, similar_shingle: int = 5) -> DataFrame:
    """keep's columns and fp (the fingerprint as a signed long) of each row of docs; a null text counts as empty.

    With bands, a text's words are hashed once more into so many band keys (an array, bands).
    """

    def run(batches):
        known, powers, seeds = Hashes(), Powers(), multipliers(bands * BAND_ROWS)
        for batch in slices(batches):
            texts = batch.column(len(keep)).to_pylist()
            values = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            columns = [*batch.columns[: len(keep)], pa.array(values)]
            if bands:
                keys = [band_keys(shingle_hashes(x, similar_shingle, known, powers), seeds) for x in texts]
                columns.append(pa.array(keys, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fp", "bands"][: len(columns)])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, body().alias("body")).mapInArrow(run, f"{kinds}, fp bigint" + ", bands array<bigint>" * bool(bands))


def shingle_hashes(text: bytes, shingle: int, known: Hashes, powers: Powers) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles (of the whole sequence, if it has fewer words)."""
    words = hashed(text, known)
    size = max(1, min(shingle, len(words)))
    return np.unique(windows(words, size, *powers(len(words))))


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(grams: np.ndarray, seeds: np.ndarray) -> list[int]:
    """A key a band: a hash of the least values of BAND_ROWS permutations of the shingles' hashes; none without shingles."""
    if not len(grams):
        return []
    least = np.full(len(seeds), ~np.uint64(0))
    for at in range(0, len(grams), CHUNK // 16):
        np.minimum(least, (grams[None, at : at + CHUNK // 16] * seeds).min(1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(least.reshape(-1, BAND_ROWS))]


def counts(bits: Column, width: int = 2) -> Column:
    """Of 32 bits (a long that isn't negative): fields of `width` bits (1 or 2), each the number of ones in the segment there."""
    return bits if width == 1 else bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))


def links(prints: DataFrame, width: int = 2) -> DataFrame:
    """(a, b): pairs of different values of fp that differ in RADIUS bits or fewer, each at least once.

    width, the bits of a segment, changes the work and not the result: n random prints meet in about 3.4e-6 n^2 pairs
    with two bits, and 1.5e-8 n^2 with one, for a half more probes.
    """
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = prints.select("fp", F.posexplode(F.array(counts(upper, width), counts(lower, width))).alias("half", "cell"))
    # a segment's count can rise by one unless it is full: the field's highest value is `width`
    above = F.transform(
        F.array(*[F.lit(1 << width * i).cast("bigint") for i in range(32 // width)]),
        lambda one: F.when(F.col("cell").bitwiseAND(one * width) == 0, F.col("cell") + one),
    )
    probes = halves.select(
        F.col("fp").alias("a"),
        "half",
        F.explode(F.concat(F.array("cell"), F.filter(above, lambda x: x.isNotNull()))).alias("probe"),
        F.col("cell").alias("own"),
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    once = (F.col("own") != F.col("probe")) | (F.col("a") < F.col("b"))
    return probes.join(
        halves.select(F.col("fp").alias("b"), F.col("half").alias("half_b"), "cell"),
        (F.col("half") == F.col("half_b")) & (F.col("probe") == F.col("cell")) & near & once,
    ).select("a", "b")


def classes(prints: DataFrame, first: Column, rows: int) -> DataFrame:
    """prints (fp and other columns; so many rows) -> fp, n and first (an aggregate), a row for each fp, so that copies cost a
    row in joins.
    """
    return cut(prints.groupBy("fp").agg(F.count("*").alias("n"), first.alias("first")), rows)


def class_links(found: DataFrame) -> tuple[DataFrame, int]:
    """links between the classes, and how many classes there are; segments get narrower where there are very many."""
    n = found.count()
    return links(found.select("fp"), 2 if n <= WIDE else 1), n


def rooted(found: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """found (n rows) with root: the same for all classes that edges lead to, and the fp itself where none does."""
    member = components(edges, 4 * n).select(F.col("node").alias("fp"), "root")
    return found.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs.

    component_id is the smallest doc_id reachable over links, the row's own included. Rows with equal fingerprints form
    a class before anything is compared, so copies cost one row in the join; classes meet there by their fingerprint.
    Null and empty texts have fingerprint zero, and link like any other. Repeated rows give repeated results, a null
    doc_id is never a component_id unless its component has no other. No rows give none; other columns are ignored.
    """
    rows = docs.count()
    prints = cut(fingerprints(docs, shingle), rows, dealt=True)
    found = classes(prints, F.min("doc_id"), rows)
    edges, n = class_links(found)
    joined = cut(rooted(found, edges, n), n)
    reach = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(reach, "root").select("fp", "component_id")
    named = split_join(prints, named, ["fp"], found).coalesce(files(rows))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def met(cells: DataFrame, order: Column, rows: int | None = None) -> DataFrame:
    """(cell, node) -> distinct (a, b, n): each node and, in each of its cells, the node that comes first there; n is the
    size of the largest cell where they met. Cells are combined before the shuffle, and each gives fewer links than it
    has nodes, so a large group of near copies gives a number of links in proportion to its size.
    """
    least = cells.groupBy("cell").agg(F.min_by("node", order).alias("b"), F.count("*").alias("n")).where("n > 1")
    least = cut(least, rows)
    found = split_join(cells, least, ["cell"], least).where("node <> b")
    return found.groupBy(F.col("node").alias("a"), "b").agg(F.max("n").alias("n"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of pairs (a, b, n) whose nodes aren't joined yet."""
    many = pairs.groupBy("b").agg(F.count("*").alias("n"))
    own = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a")
    own = split_join(own, roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), ["b"], many)
    return own.where("_ra <> _rb").select("a", "b", "n")


def merged(roots: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """roots (node, root; n rows) after the nodes of each edge (a, b) are joined."""
    over = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b"
    )
    up = components(over.select(F.col("_ra").alias("a"), F.col("_rb").alias("b")), n).select(F.col("node").alias("root"), F.col("root").alias("_up"))
    return cut(roots.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), n)


def joined_by_similarity(docs: DataFrame, nodes: DataFrame, roots: DataFrame, n: int, shingle: int, least: float) -> DataFrame:
    """roots (node, root) after nodes whose texts have a Jaccard similarity of `least` or more over shingles are joined.

    nodes (n rows) has node, the keys of its row of docs (doc_id, _t) and bands. Nodes meet in the cells of single bands, and each
    is verified against the first node there, on whole sets of shingles; what is joined already needn't be. Where a cell
    of more than two has a node that isn't similar to the first, all nodes that met that one meet again in the cells of
    every two bands, one of each group that is joined by then, with a first one that a hash draws: so unrelated documents
    that share a long passage part from each other, and none of them stands between two similar ones.
    """
    seeds = F.col("bands")
    pairs = cut(met(nodes.select("node", F.explode("bands").alias("cell")), F.col("node"), n * BANDS // 2), n * BANDS)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = nodes.select("node", "doc_id", "_t").join(asked, "node", "left_semi")
    texts = docs.select("doc_id", "_t", "text").join(asked, ["doc_id", "_t"]).dropDuplicates(["doc_id", "_t"])
    # these tables are small in rows, but their rows are long or dear
    sets = cut(shingle_sets(texts, shingle), 8 * n)
    # one pair a node first: of a large group of near copies, that leaves few to verify
    single = pairs.groupBy("a").agg(F.min("b").alias("b"), F.min_by("n", "b").alias("n"))
    first = cut(verified(apart(single, roots), sets, least, n), 4 * n)
    roots = merged(roots, first.where("similar").select("a", "b"), n)
    rest = pairs.join(single.select("a", "b"), ["a", "b"], "left_anti")
    second = cut(verified(apart(rest, roots), sets, least, n * BANDS), 4 * n)
    roots = merged(roots, second.where("similar").select("a", "b"), n)
    done = first.unionByName(second)
    failed = done.where("not similar and n > 2").select("b").distinct()
    again = cut(pairs.join(failed, "b", "left_semi").select(F.explode(F.array("a", "b")).alias("node")).distinct(), n)
    cells = again.count() * BANDS * (BANDS - 1) // 2
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.size(seeds) - 2), lambda i: F.transform(
        F.sequence(i + 1, F.size(seeds) - 1), lambda j: F.xxhash64(i, j, F.get(seeds, i), F.get(seeds, j)))))
    double = nodes.where(F.size(seeds) > 1).join(again, "node", "left_semi").join(roots, "node").select("node", "root", F.explode(two).alias("cell"))
    double = double.groupBy("cell", "root").agg(F.min_by("node", F.xxhash64("cell", "node")).alias("node")).select("cell", "node")
    more = met(double, F.xxhash64("cell", "node"), cells // 2).join(done.select("a", "b"), ["a", "b"], "left_anti")
    return merged(roots, verified(more, sets, least, cells).where("similar").select("a", "b"), n)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node and grams: the sorted 64-bit hashes of each text's distinct shingles, as bytes."""

    def run(batches):
        known, powers = Hashes(), Powers()
        for batch in slices(batches):
            out = [shingle_hashes(x, shingle, known, powers).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "grams"])

    return docs.select("node", body().alias("body")).mapInArrow(run, "node bigint, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float, rows: int) -> DataFrame:
    """pairs (a, b, n; at most `rows`) with similar.

    Few pairs are sent to the sets, and the sets of the few nodes that the pairs are compared with sent to the pairs, both
    after their size is known; beyond that both are shuffled, and b, the node that many are compared with, is dealt in parts.
    """

    def run(batches):
        for batch in slices(batches):
            keep = []
            for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keep, pa.bool_())], names=["a", "b", "n", "similar"])

    pairs = cut(pairs, rows)
    few = pairs.count() <= FEW_PAIRS
    some = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    joined = sets.select(F.col("node").alias("a"), F.col("grams").alias("_ga")).join(some(pairs), "a")
    leads = sets.select(F.col("node").alias("b"), F.col("grams").alias("_gb")).join(some(pairs.select("b").distinct()), "b", "left_semi")
    if few and (leads.agg(F.sum(F.octet_length("_gb") + 32)).first()[0] or 0) <= FEW_BYTES:
        joined = joined.join(F.broadcast(leads), "b")
    else:
        joined = split_join(joined, leads, ["b"], pairs.groupBy("b").agg(F.count("*").alias("n")))
    return joined.select("a", "b", "n", "_ga", "_gb").mapInArrow(run, "a bigint, b bigint, n bigint, similar boolean")


def keep_first(docs: DataFrame, shingle: int = 3, similar: float | None = 0.8, similar_shingle: int = 5, bands: int = BANDS) -> DataFrame:
    """One row of docs for each group of near-duplicates, as it is: that of the smallest doc_id.

    Links are those of near_duplicates, and those between texts whose five-word shingles are similar to that degree (None:
    without these). Texts of one fingerprint count as one there, by the text of the smallest doc_id. Rows of one doc_id are told apart by their texts, so only copies and near
    copies go; of rows alike in doc_id and text any one stays, and of a group's rows with its smallest doc_id the one of
    least text hash. Null and empty texts are alike. Rows without doc_id stay. Columns are those of docs.
    """
    docs, names = guarded(docs)
    docs = docs.withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = docs.where("doc_id is not null")
    rows = known.count()
    prints = fingerprints(known, shingle, ("doc_id", "_t"), bands if similar is not None else 0, similar_shingle)
    prints = cut(prints, rows, dealt=True)
    found = classes(prints, F.min(F.struct("doc_id", "_t", "fp")), rows)
    edges, n = class_links(found)
    joined = cut(rooted(found, edges, n), n)
    if similar is not None:
        own = found.select(F.col("fp").alias("node"), "first.doc_id", "first._t")
        nodes = cut(own.join(prints.select("doc_id", "_t", "bands"), ["doc_id", "_t"]).dropDuplicates(["doc_id", "_t"]), n)
        roots = joined_by_similarity(docs, nodes, joined.select(F.col("fp").alias("node"), "root"), n, similar_shingle, similar)
        joined = found.join(roots.withColumnRenamed("node", "fp"), "fp")
    kept = joined.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    kept = docs.join(kept.select("doc_id", "_t"), ["doc_id", "_t"], "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "_t")]
    kept = kept.groupBy("doc_id", "_t").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row"))
    kept = kept.select("doc_id", *[F.col("_row").getField(c).alias(c) for c in rest]).select(*docs.columns[:-1])
    return kept.unionByName(docs.where("doc_id is null").drop("_t")).toDF(*names)
