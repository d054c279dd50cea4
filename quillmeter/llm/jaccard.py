"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

1. Every text is hashed to its set of n-word shingles. Texts with equal sets are one class of copies, counted with map-side
   aggregation; one member stands for it from here on.
2. Each class gets ``trees`` labels of ``max_depth`` MinHash digits, kept once. All labels are sorted, tree by tree, which is the
   forest's tries laid flat: neighbours in that order share their longest prefixes. One pass over the sorted labels links each class
   to the first one that shares as long a prefix as its neighbour does, with that length; so the links of at least d digits connect
   exactly the classes under one node of depth d, for every d up to the length that step 3 starts with; longer shared prefixes
   count as that long, so that all classes of a node are linked to its first. The sort is by ranges of label and class, so that neither a common
   label nor a large group is one task.
3. The prefix starts at the greatest length at which a pair at the threshold itself meets in some tree with probability
   ``recall`` or more: 1 - (1 - t ** depth) ** trees. After verification the share of pairs that were missed is estimated from how many
   linked pairs met in one tree only and in two (Chao's estimator), and while that says less than ``recall``, the prefix is
   shortened by a digit: shorter links are taken from the same table, and only the clusters that they join are verified again. At
   ``floor_for`` digits a pair at the threshold is missed once in 10 ** 9, and nothing is left to shorten.
4. Classes connected through nodes form clusters (links are contracted to their ends, round by round). Only classes in a cluster of
   two or more bring their texts along again. Clusters are verified exactly: small ones are packed together, large ones cut
   into blocks, each pair of blocks a task of bounded size. Blocks return a link count per class and links to one root per
   component, never pairs; so no link is lost and none is written out. A cluster of m different texts takes (m / block) ** 2 / 2 such
   tasks, since each link counts.

Edge cases: null and wordless texts have no shingles, no copies and no links, and are their own class; a text of fewer than n
words is one shingle; equal rows are copies of each other; a null id is a document as any other, but can't name a class (the class
id is the smallest id that isn't null); an empty table gives an empty result; other columns are ignored. ``one_of_each`` keeps a
class's document with the smallest id, a null one last, then the smallest hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

N, THRESHOLD, TREES, MAX_DEPTH, RECALL, MISSED, BLOCK, PACK = 5, 0.8, 24, 8, 0.999, 1e-9, 512, 400
BROADCAST_IDS, LABELS = 1_000_000, 300_000


def depth_for(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The longest prefix with which a pair at the threshold is met with probability recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def floor_for(threshold: float, trees: int, max_depth: int, missed: float = MISSED) -> int:
    """The longest prefix, of one digit at least, with which a pair at the threshold is missed no more often than that."""
    return depth_for(threshold, trees, max_depth, 1 - missed)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = wordhash.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seeds[:count].astype(np.uint32) | np.uint32(1), seeds[count:].astype(np.uint32)


def signatures(h: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """MinHash values of the sets h[bounds[k]:bounds[k + 1]], none of them empty: an array (sets, count)."""
    out = np.empty((len(bounds) - 1, count), dtype=np.uint32)
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for k, (a, b) in enumerate(zip(*permutations(count), strict=True)):
        x = (low ^ b) * a
        x ^= (x >> np.uint32(15)) ^ high
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        out[:, k] = np.minimum.reduceat(x, bounds[:-1])
    return out


def labels_of(values: np.ndarray, trees: int) -> list[bytes]:
    """Per set its trees' labels, one after the other: each a digit of two bytes for each of the set's values in that tree."""
    digits = ((values * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
    return [x.tobytes() for x in digits.reshape(len(values), -1, trees).transpose(0, 2, 1)]


def text_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of a column: first row, distinct shingles by row, their rows, and bounds of the rows that have any."""
    for first, data, bounds in wordhash.chunks(column):
        h, row = wordhash.distinct(*wordhash.shingles(*wordhash.words(data, bounds)[:2], n))
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
        yield first, h, row[begin] if len(row) else row, np.r_[begin, len(row)]


def set_name(h: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(h.tobytes())


def sketch(docs: DataFrame, n: int, trees: int, max_depth: int) -> DataFrame:
    """docs: id, key, text, mark. Per row: id, key, mark, cls (name of its shingle set; null without words) and labels."""

    def run(batches):
        for batch in batches:
            size = batch.num_rows
            cls, labels = [None] * size, [None] * size
            for first, h, rows, bounds in text_sets(batch.column(2), n):
                if not len(rows):
                    continue
                own = labels_of(signatures(h, bounds, trees * max_depth), trees)
                for k, r in enumerate(rows):
                    cls[first + r], labels[first + r] = set_name(h[bounds[k] : bounds[k + 1]]), own[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(cls, pa.binary()), pa.array(labels, pa.binary())], ["id", "key", "mark", "cls", "labels"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key string, mark long, cls binary, labels binary")


class Trie:
    """Reads (tree, label, rep) in sorted order and links each to the first that shares as long a prefix as the one before it does."""

    def __init__(self, digits: int, least: int):
        self.digits, self.least, self.tree, self.label = digits, least, -1, np.zeros(digits, dtype=np.uint16)
        self.first = np.zeros(digits + 1, dtype=np.int64)  # by length: the first class with the prefix of that length that was read last

    def read(self, tree: np.ndarray, label: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """label: (n, digits). Returns links: the earlier class, the later one, digits shared."""
        before = np.concatenate([self.label[None], label[:-1]])
        same = (label == before) & (tree == np.r_[self.tree, tree[:-1]])[:, None]
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        root = np.zeros(len(rep), dtype=np.int64)
        for size in range(1, self.digits + 1):
            begin = np.maximum.accumulate(np.where(shared < size, np.arange(len(rep)), -1))
            first = np.where(begin >= 0, rep[begin], self.first[size])
            root = np.where(shared == size, first, root)
            self.first[size] = first[-1]
        self.tree, self.label = tree[-1], label[-1]
        keep = shared >= self.least
        return root[keep], rep[keep], shared[keep]


def forest(classes: DataFrame, trees: int, max_depth: int, least: int, most: int) -> DataFrame:
    """classes: rep, labels. Links a, b of shared digits, from least to most: those of at least d connect just the classes under one node of depth d."""
    width = 2 * max_depth
    at = classes.select("rep", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    at = at.select("tree", F.substring("labels", F.col("tree") * width + 1, F.lit(width)).alias("label"), "rep")
    at = at.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")

    def run(batches):
        trie, last = Trie(most, least), None
        names = ["a", "b", "shared", "tree", "label"]
        end = lambda row: pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), row[2], pa.array([None], pa.int32()), row[0], row[1]], names)
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield end(batch.slice(0, 1).columns)
            digits = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(-1, max_depth)[:, :most]
            a, b, shared = trie.read(batch.column(0).to_numpy(), digits, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared, pa.int32()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names)
            last = batch.slice(batch.num_rows - 1, 1)
        if last is not None:
            yield end(last.columns)

    read = common.stored(at.mapInArrow(run, "a long, b long, shared int, tree int, label binary"), "forest")
    # Where a range ends and the next begins: two rows for each range, whatever is in it.
    ends = sorted((r.tree, bytes(r.label), r.b) for r in read.where("a IS NULL").collect())
    trie, over = Trie(most, least), []
    for tree, label, rep in ends:
        a, b, shared = trie.read(np.array([tree]), np.frombuffer(label, dtype=">u2")[None, :most], np.array([rep]))
        over += [(int(x), int(y), int(k)) for x, y, k in zip(a, b, shared, strict=True) if x != y]
    links = read.where("a IS NOT NULL").select("a", "b", "shared")
    return links.union(classes.sparkSession.createDataFrame(over, "a long, b long, shared int")) if over else links


def min_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: a, b. Per node of an edge, as a: comp, the smallest node that it is connected with.

    Each round points every node to the smallest among its neighbours and itself, follows the pointers to their ends and draws the edges
    anew between the ends, equal ones once. So an edge is read again only as one of those between ends that still differ; two rounds
    leave half of the nodes at most, as an end that takes in no other has a smaller neighbour in the next round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.stored(edges.hint("rebalance"), name)
    files = max(8, edges.count() // 250_000)
    side = lambda df: common.small_side(df, LABELS).select(F.col("a").alias("comp"), F.col("comp").alias("further"))
    found = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("comp")), name, files)
        while True:
            jump = side(ends)
            near = ends.join(jump, "comp").select("a", F.col("further").alias("comp"))
            step = common.stored(near.join(jump, "comp").select("a", F.col("further").alias("comp"), F.col("comp").alias("was")), name, files)
            ends = step.select("a", "comp")
            if step.where("comp <> was").isEmpty():
                break
        jump = side(ends)
        found = ends if found is None else common.stored(found.join(jump, "comp", "left").select("a", F.coalesce("further", "comp").alias("comp")), name, files)
        drawn = edges.join(jump.toDF("a", "x"), "a").join(jump.toDF("b", "y"), "b").where("x <> y")
        edges = common.stored(drawn.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), name, files)
        if edges.isEmpty():
            return found


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n members' components."""
    comp = np.arange(n)
    while True:
        new = comp.copy()
        np.minimum.at(new, a, comp[b])
        np.minimum.at(new, b, comp[a])
        new = np.minimum(new, new[new])
        if (new == comp).all():
            return comp
        comp = new


def verify_sets(h: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, cells: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of left x right with Jaccard similarity of threshold or more, by exact counts of shared shingles."""
    size = np.array([len(x) for x in h])
    owner = np.repeat(np.arange(len(h)), size)
    value, column = np.unique(np.concatenate(h), return_inverse=True)
    several = np.bincount(column, minlength=len(value)) > 1
    name = np.cumsum(several) - 1
    keep = several[column]
    owner, column, width = owner[keep], name[column[keep]], int(several.sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    step = max(1, cells // (len(left) + len(right)))
    for lo in range(0, width, step):
        part = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + step))
        dense = np.zeros((len(h), min(step, width - lo)), dtype=np.float32)
        dense[owner[part], column[part] - lo] = 1
        shared += dense[left] @ dense[right].T
    total = size[left][:, None] + size[right][None, :]
    a, b = np.nonzero(shared.astype(np.float64) * (1 + threshold) >= threshold * total - 1e-6)
    return left[a], right[b]


def verify(table: pa.Table, n: int, threshold: float) -> pa.Table:
    """table: cluster, i, j, block, rep, cls, copies, labels, text. Per class: links (by copies) and pairs (of classes, at one of the two) in this pair of blocks, a root it is linked with, and the pairs met in one tree and in two."""
    cluster, rep, block = table["cluster"].to_numpy(), table["rep"].to_numpy(zero_copy_only=False), table["block"].to_numpy()
    i, j, copies, cls = table["i"].to_numpy(), table["j"].to_numpy(), table["copies"].to_numpy(), table["cls"].to_pylist()
    labels = np.stack([np.asarray(x) for x in table["labels"].to_numpy(zero_copy_only=False)])
    h: list = [None] * table.num_rows
    at = 0
    for piece in table["text"].chunks:
        for first, values, rows, bounds in text_sets(piece, n):
            for k, r in enumerate(rows):
                h[at + first + r] = values[bounds[k] : bounds[k + 1]]
        at += len(piece)
    good = np.array([x is not None and set_name(x) == c for x, c in zip(h, cls, strict=True)])
    root, (links, pairs, once, twice) = rep.copy(), np.zeros((4, len(h)), dtype=np.int64)
    order = np.argsort(cluster, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0, True])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[lo:hi]
        own = own[good[own]]
        _, single = np.unique(rep[own], return_index=True)  # a document's row may be repeated
        own = own[single]
        if len(own) < 2:
            continue
        same = i[own[0]] == j[own[0]]
        left = np.arange(len(own)) if same else np.flatnonzero(block[own] == i[own[0]])
        right = left if same else np.flatnonzero(block[own] == j[own[0]])
        if not len(left) or not len(right):
            continue
        a, b = verify_sets([h[k] for k in own], left, right, threshold)
        if same:
            a, b = a[a < b], b[a < b]
        np.add.at(links, own[a], copies[own[b]])
        np.add.at(links, own[b], copies[own[a]])
        np.add.at(pairs, own[a], 1)
        for part in range(0, len(a), 100_000):
            x, y = own[a[part : part + 100_000]], own[b[part : part + 100_000]]
            met = (labels[x] == labels[y]).sum(axis=1)
            np.add.at(once, x[met == 1], 1)
            np.add.at(twice, x[met == 2], 1)
        root[own] = rep[own][connected(len(own), a, b)]
    return pa.table({"rep": pa.array(rep), "root": pa.array(root), "links": links, "pairs": pairs, "once": once, "twice": twice}).filter(pa.array(good))


def enough(once: int, twice: int, pairs: int, recall: float) -> bool:
    """Whether the pairs of classes that were missed, estimated from those met in one tree and in two, leave that recall of all pairs."""
    missed = once**2 / (2 * twice) if twice else once
    return not pairs or missed <= (1 - recall) * (pairs + missed)


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL, block: int = BLOCK, start: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, class_id (smallest id connected with it by links), n_links (other documents at the threshold or above)."""
    how = {"n": n, "threshold": threshold, "trees": trees, "max_depth": max_depth, "recall": recall, "block": block, "start": start}
    return joined_rows(docs, id_col, text_col, **how).select(F.col("id").alias(id_col), "class_id", "n_links")


def joined_rows(docs: DataFrame, id_col: str, text_col: str, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL, block: int = BLOCK, start: int | None = None) -> DataFrame:
    """Per document: id, mark (hash of its text), class_id, n_links, and survivor, the first of its class: (without, id, mark); null without copies and links.

    start: the length of the first prefix, if it isn't to follow from threshold, trees and recall.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.sha2(F.col(text_col).cast("binary"), 256)))
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    rows = common.stored(sketch(keyed, n, trees, max_depth), "sketch")
    by = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("key"), F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("without"), "id", "mark")).alias("first"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    # A class's number follows from its name alone; a clash of two in 2 ** 64 would still be told apart by cls when verified.
    classes = common.stored(by.withColumn("rep", F.xxhash64("cls")), "classes")
    depth, floor = depth_for(threshold, trees, max_depth, recall) if start is None else start, floor_for(threshold, trees, max_depth)
    edges = forest(classes, trees, max_depth, min(depth, floor), depth)
    linked = was = None
    while True:
        cluster = min_components(edges.where(F.col("shared") >= depth), "clusters").select(F.col("a").alias("rep"), F.col("comp").alias("cluster"))
        fresh = cluster
        if was is not None:  # a cluster is verified again only if it was several
            several = cluster.join(was, "rep", "left").groupBy("cluster").agg(F.min(F.coalesce("was", "rep")).alias("x"), F.max(F.coalesce("was", "rep")).alias("y")).where("x <> y").select("cluster")
            fresh = cluster.join(common.small_side(common.stored(several, "joined_clusters", 8), BROADCAST_IDS), "cluster", "left_semi").select("rep", "cluster")
        nodes = F.array(*(F.xxhash64(F.substring("labels", 2 * max_depth * t + 1, 2 * depth)) for t in range(trees)))
        members = classes.join(fresh, "rep").select("rep", "cls", "key", "copies", nodes.alias("labels"), "cluster")
        found = common.stored(verified(keyed, members, n, threshold, block), "linked")
        linked = found if linked is None else common.stored(linked.join(fresh, "rep", "left_anti").unionByName(found), "linked")
        once, twice, pairs = (x or 0 for x in linked.agg(F.sum("once"), F.sum("twice"), F.sum("pairs")).first())
        if depth <= floor or enough(once, twice, pairs, recall):
            break
        depth, was = depth - 1, cluster.select("rep", F.col("cluster").alias("was"))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = min_components(root_links(linked), "roots").withColumnRenamed("a", "rep")
    classes = classes.select("rep", "cls", "id", "first", "copies").join(links, "rep", "left").join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    classes = common.stored(classes, "joined")
    smallest = classes.groupBy("comp").agg(F.min("id").alias("class_id"), F.min("first").alias("survivor"))
    classes = classes.join(smallest, "comp").select("cls", "class_id", "survivor", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    classes = common.stored(classes, "classes")
    # A class of copies may hold a third of all rows: its rows are spread by a salt, and classes repeated for it where they have many copies.
    salts = 16
    many = F.col("n_links") >= 1000
    side = classes.withColumn("salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.sequence(F.lit(0), F.lit(0)))))
    hot = common.small_side(common.stored(classes.where(many).select("cls"), "hot"), BROADCAST_IDS).withColumn("hot", F.lit(True))
    rows = rows.select("id", "key", "mark", "cls").join(hot, "cls", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).otherwise(0))
    out = rows.join(side, ["cls", "salt"], "left")
    return out.select("id", "mark", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "survivor")


def verified(keyed: DataFrame, members: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Sends the texts of clustered classes to tasks of bounded size, a pack of small clusters or a pair of blocks each."""
    # Only clusters of more than a block need their sizes; these are few, so that members of a large one aren't sent to one task.
    large = members.groupBy("cluster").agg(F.count("*").alias("m")).where(F.col("m") > block)
    large = common.small_side(common.stored(large, "large", 8), BROADCAST_IDS)
    blocks = F.coalesce(F.ceil(F.col("m") / block).cast("int"), F.lit(1))
    placed = members.join(large, "cluster", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    placed = common.stored(placed.hint("rebalance"), "placed")
    small = placed.where("blocks = 1").count()
    packs = max(1, small // PACK)
    side = common.small_side(placed, 200_000)
    text = keyed.select("key", "text").join(side, "key")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = text.select("cluster", "block", "rep", "cls", "copies", "labels", "text", "blocks", F.inline(pair))
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("long")).otherwise(F.xxhash64("cluster", "i", "j"))
    dealt = dealt.withColumn("pack", pack).drop("blocks")
    return dealt.groupBy("pack", "i", "j").applyInArrow(lambda t: verify(t, n, threshold), "rep long, root long, links long, pairs long, once long, twice long")


def root_links(linked: DataFrame) -> DataFrame:
    """linked: rep, root, a row for each pair of blocks. Links a, b that connect the same: each class to its smallest root, and what roots it has to that one.

    A class of a large cluster has a row for each block of it. Classes with the same roots, as most of a block have in a dense cluster,
    have the links between these once for all of them, so that links grow with the classes and not with the classes times the blocks.
    """
    sets = linked.where("rep <> root").groupBy("rep").agg(F.sort_array(F.collect_set("root")).alias("roots"))
    sets = common.stored(sets, "root_sets")
    several = sets.where(F.size("roots") > 1).select("roots").distinct().select(F.col("roots")[0].alias("a"), F.explode(F.slice("roots", 2, F.size("roots") - 1)).alias("b"))
    return sets.select(F.col("roots")[0].alias("a"), F.col("rep").alias("b")).union(several)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 2_000_000, **how) -> DataFrame:
    """docs without the documents that aren't the first of their class; rows with that one's id and text are kept once."""
    found = common.stored(joined_rows(docs, id_col, text_col, **how).where("n_links > 0").hint("rebalance"), "near")
    own, of, mark, whole = common.unused(docs, "_id", "_of", "_mark", "_row")
    first = F.col("id").eqNullSafe(F.col("survivor.id")) & (F.col("mark") == F.col("survivor.mark"))
    some = lambda rows, name: common.small_side(common.stored(rows.select(F.col("id").alias(own), F.col("mark").alias(of)).hint("rebalance"), name), broadcast_ids)
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(of))
    kept = docs.withColumn(mark, F.xxhash64(text_col)).join(some(found.where(~first).select("id", "mark").distinct(), "gone"), same, "left_anti")
    again = found.where(first).groupBy("id", "mark").count().where("count > 1")
    if again.isEmpty():
        return kept.select(docs.columns)
    again = some(again, "again")
    row = F.struct(*docs.columns)
    one = kept.join(again, same, "left_semi").groupBy(id_col, mark).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias(whole))
    return kept.join(again, same, "left_anti").select(docs.columns).unionByName(one.select(f"{whole}.*"))


def op8(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(w, i + 1, i + 5)) AS h FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE k * 1.8 >= 0.8 * (x.n + y.n)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS class_id, CAST((SELECT count(*) FROM l WHERE l.a = d.doc_id) AS BIGINT) AS n_links FROM d
"""
