"""Importance resampling towards a target: n-gram features in hashed buckets, over a dictionary of distinct strings.

The corpus is cut into blocks of whole texts. A block keeps its texts as numbers of its own words, and finds its
distinct n-grams with their counts. These strings, packed by partition of the dictionary, meet those of all other
blocks; there each distinct string is counted once over the corpus, hashed once, and its count added to its bucket. The
buckets go back to the blocks in the order in which they sent the strings, and each text's feature counts are joined
with the gains of their buckets.

A block sends at most one row to each partition of the dictionary, and none that is empty, so there are never more
rows than distinct n-grams of the blocks. The dictionary is dealt in ROUNDS shares one after the other, so that only
part of the strings is on disk at a time; so are the answers. N-grams are spread over partitions by hash and come once
from a block, so frequent ones don't make large partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import staged, table
from presswork.llm.textkit import LOWER, Prefix, mixed, pieces, words

BUCKETS = 10_000
LENGTHS = 3  # of the n-grams, in words, at most
BLOCK = 8 << 20  # bytes of text, but always whole texts
PARTITION = 1_500_000  # occurrences of n-grams to a partition of the dictionary
ROUNDS = 3
ADDERS = 8  # tasks that add up the partitions' totals
SHARES = 2  # of the blocks, when the answers come back
_BREAK = np.zeros(256, bool)
_BREAK[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_ZSTD = pa.Codec("zstd", 1)


def _packed(x: np.ndarray) -> bytes:
    return x.nbytes.to_bytes(8, "little") + _ZSTD.compress(x.tobytes(), asbytes=True)


def _unpacked(x: bytes, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), kind)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of data one after the other."""
    return data[np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] if len(size) else data[:0]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word; over a few MB at a time, as sums for each byte take room."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 21) - 2, "right")))
        out[i:j] = Prefix(data[start[i] : end[j - 1]]).hash(start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return out


def _distinct(keys: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct keys in order, how often each occurs, and (if asked for) of each key the number of its own."""
    order = np.argsort(keys) if places else None
    keys = keys[order] if places else np.sort(keys)
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    first = np.flatnonzero(new)
    index = None
    if places:
        index = np.empty(len(keys), np.int32)
        index[order] = np.cumsum(new) - 1
    return keys[first], np.diff(np.r_[first, len(keys)]), index


def _vocabulary(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Some texts: the hashes of their distinct words, these words (each with a space behind it), the number of the word
    at each place, and the number of words in each text."""
    data = LOWER[data]
    start, end, row = words(data, at, _BREAK)
    distinct, _, number = _distinct(_hashes(data, start, end))
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    size = (end - start)[first] + 1
    spelt = _gathered(np.r_[data, np.uint8(32)], start[first], size)
    spelt[np.cumsum(size) - 1] = 32
    return distinct, spelt, number, np.bincount(row, minlength=len(at) - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> blocks: ids, the number of words in all texts and in each, all words as numbers, and the words (each
    with a space behind it) by number. Texts are taken apart a MB at a time, and the MBs' vocabularies united."""
    for batch in batches:
        for i, j, _, _ in pieces(batch.column(1), BLOCK):
            parts = [_vocabulary(data, at) for _, _, data, at in pieces(batch.column(1).slice(i, j - i), 1 << 20)]
            distinct, spelt, numbers, n_words = zip(*parts, strict=True)
            every, text = np.concatenate(distinct), np.concatenate(spelt)
            ends = np.flatnonzero(text == 32) + 1
            starts = np.r_[0, ends[:-1]]
            _, first = np.unique(every, return_index=True)
            vocabulary = _gathered(text, starts[first], (ends - starts)[first])
            united = np.searchsorted(every[first], every).astype(np.int32)
            base = np.cumsum([0, *(len(d) for d in distinct)])
            number = np.concatenate([united[b + x] for b, x in zip(base, numbers, strict=False)])
            ids = batch.column(0).slice(i, j - i)
            packed = [pa.array([_packed(x)], pa.binary()) for x in (np.concatenate(n_words).astype(np.int32), number, vocabulary)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(number)]), *packed], names=["ids", "n", "n_words", "words", "vocabulary"])


class _Features:
    """The distinct n-grams of a block, in order of n and of the words' numbers, with their partitions of the dictionary.

    If asked for, also which of them stands at each place of the texts; of a share, only those of its partitions. Their words
    and counts are left out where nobody needs them, as a block's n-grams are many times its text.
    """

    def __init__(self, n_words: np.ndarray, number: np.ndarray, vocabulary: np.ndarray, places: bool, partitions: int = 1, share: int | None = None, spelt: bool = True):
        ends = np.flatnonzero(vocabulary == 32) + 1
        offsets = np.r_[0, ends].astype(np.int32)
        of = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
        self.inner, self.last = of(vocabulary), of(np.where(vocabulary == 32, np.uint8(10), vocabulary))  # with a space or a line's end behind each word
        word_hash = _hashes(vocabulary, offsets[:-1], offsets[1:])
        row, n, bits = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words), len(number), max(1, len(ends).bit_length())
        self.row, self.words, self.counts, self.where, found = [], [], [], [], []
        key, words_of = number.astype(np.int64), []  # the n-gram at each place, and the words of each n-gram
        for k in range(LENGTHS):
            inside = row[k:] == row[: max(0, n - k)]
            if k:
                if k > 1 and (k + 1) * bits > 63:  # more words than a key has room for: by the number of the shorter n-gram
                    at_place = np.full(len(key), -1, np.int64)
                    at_place[before] = _distinct(key[before])[2]
                    key, numbered = at_place, True
                else:
                    numbered = False
                key = key[: max(0, n - k)] << bits | number[k:]
            distinct, count, index = _distinct(key[inside], places)
            if not k:
                words_of = [distinct.astype(np.int32)]
            else:
                rest = distinct >> bits
                firsts = [w[rest] for w in words_of] if numbered else [(rest >> bits * (k - 1 - i) & (1 << bits) - 1).astype(np.int32) for i in range(k)]
                words_of = [*firsts, (distinct & (1 << bits) - 1).astype(np.int32)]
                del rest, firsts
            del distinct
            before = inside
            both = np.full(len(count), k, np.uint64)
            for w, f in zip(words_of, _FACTORS, strict=False):
                both += word_hash[w] * f
            part = (mixed(both) % np.uint64(partitions)).astype(np.min_scalar_type(partitions))
            del both
            if places:
                self.row.append(row[: max(0, n - k)][inside])
                self.where.append(index)
            own = slice(None) if share is None else np.flatnonzero(part % ROUNDS == share)
            if spelt:
                self.words.append([w[own] for w in words_of])
                self.counts.append(count[own].astype(np.uint32))
            found.append(part[own])
        self.part = np.concatenate(found)
        self.base = np.cumsum([0, *(len(p) for p in found)])

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams by partition of the dictionary: their places; each partition that has any, and where it begins."""
        order = np.argsort(self.part, kind="stable").astype(np.int32)
        size = np.bincount(self.part)
        found = np.flatnonzero(size)
        return order, found, np.r_[0, np.cumsum(size[found])]

    def strings(self, places: np.ndarray) -> np.ndarray:
        """The n-grams at some places (in rising order), a line each."""
        out, cuts = [], np.searchsorted(places, self.base)
        for k, words_of in enumerate(self.words):
            own = places[cuts[k] : cuts[k + 1]] - self.base[k]
            words = [(self.last if i == k else self.inner).take(pa.array(w[own])) for i, w in enumerate(words_of)]
            lines = pc.binary_join_element_wise(*words, b"") if k else words[0]
            ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
            if len(own):
                out.append(np.frombuffer(lines.buffers()[2], np.uint8)[ends[0] : ends[-1]])
        return np.concatenate(out)


def _features(block: pa.RecordBatch | pa.Table, i: int, places: bool, partitions: int, share: int | None = None) -> tuple[np.ndarray, _Features]:
    n_words, number, vocabulary = (_unpacked(block.column(c)[i].as_py(), kind) for c, kind in (("n_words", np.int32), ("words", np.int32), ("vocabulary", np.uint8)))
    return n_words, _Features(n_words, number, vocabulary, places, partitions, share, not places)


def _sent(partitions: int, share: int):
    """Blocks -> for each partition of this share: the block's distinct strings and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                _, features = _features(batch, i, False, partitions, share)
                order, found, begin = features.parts()
                counts = np.concatenate(features.counts)
                for part, a, b in zip(found.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), batch.column("block").slice(i, 1), pa.array([_packed(features.strings(order[a:b]))], pa.binary()), pa.array([_packed(counts[order[a:b]])], pa.binary())],
                        names=["part", "block", "strings", "counts"],
                    )

    return run


#: What each byte does to the checksum, from the library's own values.
_STEP = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each stretch: one byte of all of them at a time, long ones on their own."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    for i in np.flatnonzero(size > 96):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    short = np.flatnonzero(size <= 96)
    short = short[np.argsort(-size[short], kind="stable")]
    at, n = start[short], np.searchsorted(-size[short], -np.arange(1, 97), "right")
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for k, m in enumerate(n.tolist()):
        if not m:
            break
        crc[:m] = _STEP[(crc[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[short] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _dictionary(buckets: int):
    """A partition of the dictionary: what each block sent -> the bucket of each of its strings, and a row with the
    partition's totals by bucket."""

    def run(sent: pa.Table) -> pa.Table:
        texts = [_unpacked(x) for x in sent["strings"].to_pylist()]
        counts = [_unpacked(x, np.uint32) for x in sent["counts"].to_pylist()]
        data = np.concatenate(texts)
        ends = np.flatnonzero(data == 10)
        # a line break ends each string, so it may stay part of it when strings are compared
        lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends + 1].astype(np.int64)), pa.py_buffer(data)])
        coded = lines.dictionary_encode()
        at = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1]
        bucket = crc32(np.frombuffer(coded.dictionary.buffers()[2], np.uint8), at[:-1], at[1:] - 1) % np.uint32(buckets)
        index = np.asarray(coded.indices)
        total = np.bincount(index, np.concatenate(counts), len(bucket))
        totals = np.bincount(bucket, total, buckets).astype(np.int64)
        cuts = np.cumsum([len(c) for c in counts])[:-1]
        back = [_packed(b) for b in np.split(bucket.astype(np.min_scalar_type(buckets - 1))[index], cuts)]
        part = sent["part"][0].as_py()
        return pa.table({
            "part": pa.array([part] * (len(back) + 1), pa.int32()), "block": pa.array([*sent["block"].to_pylist(), None], pa.int64()),
            "buckets": pa.array([*back, None], pa.binary()), "totals": pa.array([None] * len(back) + [totals], pa.list_(pa.int64())),
        })

    return run


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts in staged blocks; see _blocks."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    packed = rows.mapInArrow(_blocks, f"ids array<{kind}>, n long, n_words binary, words binary, vocabulary binary")
    return staged(packed.withColumn("block", F.monotonically_increasing_id()))


def partitions_for(blocks: DataFrame) -> int:
    n = blocks.agg(F.sum("n")).first()[0] or 0
    return max(ROUNDS, -(-LENGTHS * n // PARTITION))


def dictionary(blocks: DataFrame, partitions: int, buckets: int = BUCKETS) -> tuple[DataFrame, np.ndarray]:
    """For each block and partition the buckets of the strings that it sent (null block: the partition's totals); and
    how many features of the corpus fall into each bucket."""
    found = []
    for share in range(ROUNDS):
        sent = blocks.mapInArrow(_sent(partitions, share), "part int, block long, strings binary, counts binary")
        found.append(staged(sent.groupBy("part").applyInArrow(_dictionary(buckets), "part int, block long, buckets binary, totals array<long>")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, summed(out.where("block IS NULL"), buckets)


def summed(rows: DataFrame, buckets: int) -> np.ndarray:
    """The sum of the arrays `totals`: within tasks, then in ADDERS groups, so that neither rows nor what reaches the driver
    grow with the number of partitions."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(buckets, np.int64), False
        for batch in batches:
            for x in batch.column("totals"):
                total, any_ = total + np.asarray(x.values), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["totals"])

    dealt = rows.select("totals").mapInArrow(within, "totals array<long>").repartition(ADDERS)
    return sum((np.asarray(r.totals, np.int64) for r in dealt.mapInArrow(within, "totals array<long>").collect()), np.zeros(buckets, np.int64))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of how much likelier each bucket is in the target), counts smoothed by one."""
    whole, aimed = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * aimed))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray, partitions: int):
    """A block and the buckets of its strings -> the weight of each of its texts."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(block):  # totals have no block
            return pa.table({"id": pa.array([], block.schema.field("ids").type.value_type), "n_words": pa.array([], pa.int64()), "weight": pa.array([], pa.int64())})
        block = block.combine_chunks()
        n_words, features = _features(block, 0, True, partitions)
        weight = np.zeros(len(n_words), np.int64)
        if len(answers):
            order, _, _ = features.parts()
            kind = np.min_scalar_type(len(gain) - 1)
            by_part = sorted(zip(answers["part"].to_pylist(), answers["buckets"].to_pylist(), strict=True))
            of_feature = np.empty(len(order), np.int64)
            of_feature[order] = gain[np.concatenate([_unpacked(b, kind) for _, b in by_part])]
            for row, index, base in zip(features.row, features.where, features.base, strict=False):
                sums = np.r_[0, np.cumsum(of_feature[base + index.astype(np.int64)])]
                begin = np.searchsorted(row, np.arange(len(n_words) + 1))
                weight += sums[begin[1:]] - sums[begin[:-1]]
        return pa.table({"id": block["ids"][0].values, "n_words": pa.array(n_words.astype(np.int64)), "weight": pa.array(weight)})

    return lambda key, block, answers: run(block, answers)


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features and weight of each row of docs: the sum of the gains of its n-grams' buckets.

    A-Z are lower-cased; words are stretches of letters, digits and all characters beyond ASCII. Null and empty texts have
    no features and weight 0. Repeated rows count as often as they stand there; an empty target (or empty docs) just
    has no counts. Other columns are ignored.
    """
    aims = blocks_of(target.select(F.lit(0).alias("_none"), F.col(target_text_col).alias("_text")), "_none", "_text")
    _, aimed = dictionary(aims, partitions_for(aims), buckets)
    blocks = blocks_of(docs, id_col, text_col)
    partitions = partitions_for(blocks)
    answers, own = dictionary(blocks, partitions, buckets)
    answers = answers.where("block IS NOT NULL").select(F.col("block").alias("of_block"), "part", "buckets")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    weigh = _weighed(gains(own, aimed), partitions)
    out = None
    for share in range(SHARES):  # one after the other, as the answers of all blocks are as large as the corpus
        of_share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES)) == share  # noqa: E731, B023
        met = blocks.where(of_share("block")).groupBy("block").cogroup(answers.where(of_share("of_block")).groupBy("of_block"))
        part = staged(met.applyInArrow(weigh, f"id {kind}, n_words long, weight long"))
        out = part if out is None else out.unionByName(part)
    features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(LENGTHS)), F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", features.alias("n_features"), "weight")


def gumbel(id_col: Column) -> Column:
    """Noise that makes the largest scores a draw without replacement; fixed by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], tie: Column) -> DataFrame:
    """Adds rank, from 1 in the order, without a task that sees all rows.

    Rows are sorted by ranges and written; the number of rows in each written partition, of which there are few, says
    where its ranks begin. tie: something to split rows on that are equal in the order, so that many of them don't
    make one large range.
    """
    placed = staged(rows.withColumn("_tie", tie).orderBy(*order, "_tie").drop("_tie").withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).count().collect()
    begins, n = [], 0
    for s in sorted(sizes, key=lambda s: s["_part"]):
        begins.append((s["_part"], n))
        n += s["count"]
    starts = rows.sparkSession.createDataFrame(begins, "_part long, _begin long")
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn("rank", F.col("_begin") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_begin", "_place")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", least: int = 20, percent: int = 5) -> DataFrame:
    """id, n_features, weight, score and rank of each row: `percent` of the rows with at least `least` words are drawn
    without replacement, likelier the more their n-grams look like the target's, and ranked; rank is null for all others.

    Ties go to the smaller id, null ids last; rows that are equal in both are drawn one by one. See `weights` for
    nulls, empty texts and empty tables.
    """
    scored = staged(weights(docs, target, id_col, text_col, target_text_col).withColumn("score", F.col("weight") + gumbel(F.col(id_col))))
    able = scored.where(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    in_order = ranked(able, [F.col("score").desc(), F.col(id_col).asc_nulls_last()], F.rand(7))
    in_order = in_order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    both = in_order.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return both.select(id_col, "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark; five in a hundred drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
