"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

Documents are sets of word shingles. A tree sends each set down a path of randomly chosen coordinates of its
minwise signature; sets that agree on the path meet in a node. Small nodes are compared exhaustively. In a
large node all members are compared with one of them; after the links found so far have been closed to
components, what is left to compare is members of different components: if few lie outside the largest
component they are compared with all, in blocks, else the node branches again, along two further coordinates. So a group
of thousands of copies costs comparisons in proportion to its size, and yet no pair of a node that could join
two components goes uncompared. Independent trees are repeated until a pair at the threshold misses all of them
with probability under one in a million. Every candidate is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import checkpointed, staged, table
from presswork.llm.components import components
from presswork.llm.textkit import LOWER, Prefix, bytes_of, mixed, pieces, words

COORDINATES = 64
DEPTH = 3
TREES = 20  # (1 - 0.8 ** DEPTH) ** TREES < 1e-6
SMALL = 16
FEW = 2048
BLOCK, CHUNK = 64, 256
BRANCHES = 2
LEVELS = 8
ROWS = 512
_KEY = np.uint64(54)
_X, _Y = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 54) - 1)
_rng = np.random.default_rng(99)
_MUL = _rng.integers(1, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_PATHS = np.arange(TREES * DEPTH).reshape(TREES, DEPTH)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of up to 1024 rows: sorted, row number in the top 10 bits, hash in the other 54.

    A row with fewer words than `size`, but at least one, has its whole sequence as its only shingle.
    """
    data = LOWER[data]
    start, end, row = words(data, at)
    if not len(start):
        return np.empty(0, np.uint64)
    word = Prefix(data).hash(start, end)
    count = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(count) - count
    n = len(word)
    key = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        key = key * _X + mixed(word[k : n - size + 1 + k] + np.uint64(k + 1))
    whole = row[: len(key)] == row[size - 1 :] if len(key) else np.empty(0, bool)
    key, rows = mixed(key[whole]), row[: len(whole)][whole]
    for short in range(1, size):
        few = np.flatnonzero(count == short)
        if len(few):
            h = np.full(len(few), short, np.uint64)
            for k in range(short):
                h = h * _Y + mixed(word[first[few] + k] + np.uint64(k + 1))
            key, rows = np.r_[key, mixed(h)], np.r_[rows, few]
    return np.unique((rows.astype(np.uint64) << _KEY) | (key >> np.uint64(10)))


def _signatures(size: int):
    """(id, text) -> (id, n, s1, s2, sig): set size, a 128-bit hash of the set, its minwise signature (null if empty)."""

    def run(batches):
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1), rows=ROWS):
                sets = shingle_sets(data, at, size)
                row = (sets >> _KEY).astype(np.int64)
                n = np.bincount(row, minlength=j - i)
                full = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[full]
                key = mixed(sets & _LOW)
                sums = np.zeros((2, j - i), np.uint64)
                sig = np.zeros((j - i, COORDINATES), np.uint32)
                if len(full):
                    sums[0, full], sums[1, full] = np.add.reduceat(key, begin), np.add.reduceat(mixed(key + _Y), begin)
                    small = (key >> np.uint64(16)).astype(np.uint32)
                    for t in range(COORDINATES):
                        sig[full, t] = np.minimum.reduceat((small ^ _ADD[t]) * _MUL[t], begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), pa.array([s.tobytes() if k else None for s, k in zip(sig, n, strict=True)], pa.binary())],
                    names=["id", "n", "s1", "s2", "sig"],
                )

    return run


def _sig_matrix(column: pa.Array) -> np.ndarray:
    data, at = bytes_of(column)
    return data[at[0] : at[-1]].view(np.uint32).reshape(len(column), COORDINATES)


def _path_keys(batches):
    """(rep, sig) -> (rep, keys): the node that each tree's path leads to."""
    for batch in batches:
        sig = _sig_matrix(batch.column(1)).astype(np.uint64)
        keys = np.empty((len(batch), TREES), np.uint64)
        for t in range(TREES):
            h = np.full(len(batch), t + 1, np.uint64)
            for c in _PATHS[t]:
                h = mixed(h * _X + sig[:, c] + np.uint64(c))
            keys[:, t] = h
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), TREES).cast(pa.list_(pa.int64()))], names=["rep", "keys"])


def _child_keys(batches):
    """(rep, sig, key) -> (rep, keys): the nodes that a large node branches to, along coordinates that it chooses."""
    for batch in batches:
        sig, key = _sig_matrix(batch.column(1)).astype(np.uint64), np.asarray(batch.column(2)).view(np.uint64)
        keys = np.empty((len(batch), BRANCHES), np.uint64)
        for b in range(BRANCHES):
            h = mixed(key ^ np.uint64(b * 0x5851F42D4C957F2D & (1 << 63) - 1))
            c = (h % np.uint64(COORDINATES)).astype(np.int64)
            keys[:, b] = mixed(h * _X + sig[np.arange(len(batch)), c])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BRANCHES).cast(pa.list_(pa.int64()))], names=["rep", "keys"])


def _alike(cutoff: float):
    """(a, b, sig_a, sig_b) -> (a, b) of those whose signatures agree on enough coordinates to be worth a look."""

    def run(batches):
        for batch in batches:
            if len(batch):
                ok = (_sig_matrix(batch.column(2)) == _sig_matrix(batch.column(3))).mean(1) >= cutoff
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])

    return run


def _links_in_block(size: int, share: int):
    """Cogroup of up to BLOCK texts and about CHUNK others, (rep, comp, text) each: every exact link between two
    components; of several between the same two, with the same text of the block, the first."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        reps, comps, sets = [], [], []
        for side in (left, right):
            reps.append(np.asarray(side["rep"]))
            comps.append(np.asarray(side["comp"]))
            rows = []
            for i, _, data, at in pieces(side["text"].combine_chunks(), rows=ROWS):
                found = shingle_sets(data, at, size)
                rows.append((found >> _KEY).astype(np.int64) + i), rows.append(found & _LOW)
            sets.append((np.concatenate(rows[::2] or [np.empty(0, np.int64)]), np.concatenate(rows[1::2] or [np.empty(0, np.uint64)])))
        (row_m, key_m), (row_r, key_r) = sets
        known, where = np.unique(key_m, return_inverse=True)
        both = np.zeros((len(reps[1]), len(reps[0])), np.float32)
        at = np.minimum(np.searchsorted(known, key_r), max(0, len(known) - 1))
        hit = np.flatnonzero(known[at] == key_r) if len(known) else np.empty(0, np.int64)
        for c in range(0, len(known), 1 << 14):  # the shared shingles, a slice of columns at a time
            m, r = (where >= c) & (where < c + (1 << 14)), hit[(at[hit] >= c) & (at[hit] < c + (1 << 14))]
            one, other = (np.zeros((len(x), min(1 << 14, len(known) - c)), np.float32) for x in reps)
            one[row_m[m], where[m] - c] = 1
            other[row_r[r], at[r] - c] = 1
            both += other @ one.T
        n_m, n_r = np.bincount(row_m, minlength=len(reps[0])), np.bincount(row_r, minlength=len(reps[1]))
        ok = (100 * both >= share * (n_r[:, None] + n_m[None, :] - both)) & (both > 0) & (comps[1][:, None] != comps[0][None, :])
        r, m = np.nonzero(ok)
        _, first = np.unique(np.c_[m, comps[1][r]], axis=0, return_index=True) if len(r) else (None, np.empty(0, np.int64))
        return pa.table({"a": pa.array(np.minimum(reps[0][m[first]], reps[1][r[first]])), "b": pa.array(np.maximum(reps[0][m[first]], reps[1][r[first]]))})

    return run


def _confirmed(size: int, share: int):
    """(a, b, text_a, text_b) -> (a, b) of those with 100 * shared >= share * union of their full sets."""

    def run(batches):
        for batch in batches:
            left, right = (bytes_of(batch.column(k))[1] for k in (2, 3))
            i = 0
            while i < len(batch):
                j = i + 1
                while j < len(batch) and j - i < ROWS and left[j + 1] - left[i] + right[j + 1] - right[i] < 1 << 20:
                    j += 1
                sets = []
                for k in (2, 3):
                    data, at = bytes_of(batch.column(k).slice(i, j - i))
                    sets.append(shingle_sets(data[at[0] : at[-1]], at - at[0], size))
                count = lambda x, m=j - i: np.bincount((x >> _KEY).astype(np.int64), minlength=m)
                both = count(np.intersect1d(*sets, assume_unique=True))
                ok = 100 * both >= share * (count(sets[0]) + count(sets[1]) - both)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i).filter(pa.array(ok & (both > 0))) for k in (0, 1)], names=["a", "b"])
                i = j

    return run


def _sized(nodes: DataFrame) -> DataFrame:
    """(key, rep, size, pivot) of the nodes with at least two members; pivot: the member that the node's key picks.

    The sizes are staged, so that the join is one of two plain inputs, whose large partitions Spark can split.
    """
    sizes = nodes.groupBy("key").agg(F.count("*").alias("size"), F.min_by("rep", F.xxhash64("key", "rep")).alias("pivot"))
    return staged(nodes.join(staged(sizes.where("size > 1")), "key"))


def _first_pairs(nodes: DataFrame) -> DataFrame:
    """All pairs of small nodes; in large ones each member with the pivot."""
    small, large = nodes.where(F.col("size") <= SMALL), nodes.where(F.col("size") > SMALL)
    other = small.select("key", F.col("rep").alias("b"))
    every = small.join(other, "key").where("rep < b").select(F.col("rep").alias("a"), "b")
    star = large.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    return every.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """Components of the documents whose sets of `size`-word shingles have 100 * shared >= share * union.

    Words are separated by ASCII white space; A-Z count as a-z. A document with fewer words has its whole
    sequence as one shingle; one without words (or null) has none and is linked with nothing. Returns for each row
    its id, n_shingles, component_id (the least id that can be reached, itself included) and kept (whether it is
    that one). Ids are whole numbers. Rows of equal id count as linked; a row with a null id is linked with
    nothing, has a null component and is kept. Other columns are ignored.

    Equal sets are one class from the start, so exact copies cost no comparisons. Signatures only rule out pairs
    that agree on fewer than share% - 25 points of 64 coordinates (five standard deviations).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cutoff = share / 100 - 0.25
    signed = staged(rows.mapInArrow(_signatures(size), "id long, n long, s1 long, s2 long, sig binary"))
    usable = signed.where("n > 0 and id is not null")
    classes = staged(usable.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    sigs = classes.select("rep", "sig", "n")
    texts = rows.where("id is not null and text is not null")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links, after their sizes and signatures have been compared."""
        a, b = (sigs.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        near = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {share} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")
        near = near.mapInArrow(_alike(cutoff), "a long, b long").distinct()
        text_a, text_b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        both = near.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b")
        return staged(both.mapInArrow(_confirmed(size, share), "a long, b long").distinct())

    paths = classes.select("rep", "sig").mapInArrow(_path_keys, "rep long, keys array<long>")
    nodes = _sized(paths.select("rep", F.explode("keys").alias("key")))
    comps = components(confirmed(_first_pairs(nodes)))
    large, level = nodes.where(F.col("size") > SMALL).select("key", "rep"), 0
    while True:
        left = _unsettled(large, comps, everything=level >= LEVELS)
        if left.isEmpty():
            break
        more = _cross_links(left.where("few"), texts, size, share)
        branch = left.where("not few")
        known = comps.select(F.col("v").alias("a"), F.col("comp").alias("b"))  # stands for the links so far
        if branch.isEmpty():
            comps = components(known.unionByName(more))
            break
        children = branch.join(sigs.select("rep", "sig"), "rep").select("rep", "sig", "key").mapInArrow(_child_keys, "rep long, keys array<long>")
        nodes = _sized(children.select("rep", F.explode("keys").alias("key")))
        comps = components(known.unionByName(more).unionByName(confirmed(_first_pairs(nodes))))
        large, level = nodes.where(F.col("size") > SMALL).select("key", "rep"), level + 1

    found = classes.select("s1", "s2", "n", "rep").join(comps, classes["rep"] == comps["v"], "left").select("s1", "s2", "n", F.coalesce("comp", "rep").alias("comp"))
    out = signed.drop("sig").join(found, ["s1", "s2", "n"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _unsettled(nodes: DataFrame, comps: DataFrame, everything: bool) -> DataFrame:
    """(key, rep, comp, top, few) of the members of nodes that hold several components.

    top: the node's largest component; few: the node has few members outside it.
    """
    placed = nodes.join(comps, nodes["rep"] == comps["v"], "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("k"))
    whole = parts.groupBy("key").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("top")).where("size > top.k")
    whole = staged(whole.select("key", F.col("top.comp").alias("top"), (F.lit(everything) | (F.col("size") - F.col("top.k") <= FEW)).alias("few")))
    return checkpointed(placed.join(whole, "key").select("key", "rep", "comp", "top", "few"))


def _cross_links(members: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """Links between different components of a node: all members outside its largest component against all members.

    Nodes with the same largest component are taken together. Members outside it are dealt to blocks; a block
    meets each other text once, in groups of bounded size, however many nodes they share.
    """
    placed = members.select(F.col("top").alias("fam"), "rep", "comp").distinct()
    sizes = placed.groupBy("fam").agg(F.ceil(F.count_if(F.col("comp") != F.col("fam")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = staged(sizes)
    minors = placed.where("comp <> fam").join(sizes, "fam").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")).cast("int"))
    met = placed.join(sizes, "fam").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    minors = minors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = ["fam", "block", "chunk"]
    left, right = (x.join(texts, x["rep"] == texts["id"]).select(*(F.col(c).alias(c) for c in (*group, "rep", "comp", "text"))) for x in (minors, met))
    return staged(left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_links_in_block(size, share), "a long, b long").distinct())


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents linked at 0.8 over two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, share=80)


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT n.doc_id, max(n.n)::BIGINT AS n_shingles, min(c)::BIGINT AS component_id, min(c) = n.doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id
"""
