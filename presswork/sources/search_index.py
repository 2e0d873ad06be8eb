"""A stored index for word search: postings by term, with what they were made from, so that no text is read to search.

A folder holds `postings` (term, and an array of doc, tf, length for each block of documents) in files by bucket of the
term, sorted by term, `terms` (term, df, idf) the same way, and `card`: version, bucket count, documents, total length, and the state of the source. A search reads the
buckets of its terms only. An index of another version or of a source that has changed since is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.functions import text
from presswork.sources.logs import staged

VERSION = 2
CARD = "version int, buckets int, n long, total long, source string"
LISTED = 5_000  # terms that are named in a filter; more are joined
BLOCK = 8 << 20  # characters of the documents whose postings lie together
POSTINGS, ASKED = 1 << 20, 1 << 18  # of one task of a search: postings of asked terms, and terms of queries


def source_state(rows: DataFrame) -> str:
    """Changes whenever a file behind the rows does: a hash of the files' names, sizes and times. Reads no data."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in sorted(rows.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _packed(rows: DataFrame) -> DataFrame:
    """(term, posts) of rows (doc, body): the tokens of text.search_tokens, counted row by row in one pass, and the rows of
    some BLOCK characters put together by term. posts: doc, tf, length."""
    find = re.compile(text.TOKEN).findall

    def pack(docs: list, terms: list, tfs: list, sizes: list, lengths: list):
        coded = pa.array(terms, pa.string()).dictionary_encode()
        code, size = np.asarray(coded.indices), np.asarray(sizes)
        order = np.argsort(code, kind="stable")
        of, length = pa.concat_arrays(docs).take(pa.array(np.repeat(np.arange(len(size)), size)[order])), np.repeat(np.asarray(lengths, np.int64), size)[order]
        posts = pa.StructArray.from_arrays([of, pa.array(np.asarray(tfs, np.int64)[order]), pa.array(length)], ["doc", "tf", "length"])
        at = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(at), posts)], names=["term", "posts"])

    def count(batches):
        held, block = 0, ([], [], [], [], [])
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                docs, terms, tfs, sizes, lengths = block
                docs.append(batch.column("doc").slice(at, 100))
                for body in batch.column("body").slice(at, 100).to_pylist():
                    found = Counter(find((body or "").lower()))
                    terms.extend(found)
                    tfs.extend(found.values())
                    sizes.append(len(found))
                    lengths.append(found.total())
                    held += len(body or "")
                if held >= BLOCK:
                    yield pack(*block)
                    held, block = 0, ([], [], [], [], [])
        if block[1]:
            yield pack(*block)

    return rows.mapInArrow(count, f"term string, posts array<struct<doc: {rows.schema['doc'].dataType.simpleString()}, tf: bigint, length: bigint>>")


def _postings(documents: DataFrame, doc_id: str, body: Column) -> DataFrame:
    """(term, posts), each document once a term. Only documents whose ids come more than once are added up over rows."""
    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), body.alias("body"))
    repeated = rows.groupBy("doc").count().where("count > 1").select("doc")
    if repeated.isEmpty():
        return _packed(rows)
    again = _packed(rows.join(repeated, "doc", "left_semi")).select("term", F.inline("posts")).groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    again = again.join(again.groupBy("doc").agg(F.sum("tf").alias("length")), "doc")
    return _packed(rows.join(repeated, "doc", "left_anti")).unionByName(again.select("term", F.array(F.struct("doc", "tf", "length")).alias("posts")))


def build_index(documents: DataFrame, path: str, doc_id: str, body: Column, source: str, buckets: int | None = None) -> None:
    """Tokenises the documents once and writes their index. Null bodies have no tokens but count as documents; tokens of
    rows with equal ids are one document's. There are at least 64 buckets, and one for each 32 MB of text."""
    spark = documents.sparkSession
    n, size = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()
    buckets = buckets or max(64, -(-size // (32 << 20)))
    placed = _postings(documents, doc_id, body).withColumn("bucket", _bucket(F.col("term"), buckets))
    placed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = spark.read.schema(placed.schema).parquet(f"{path}/postings")
    counted = written.select("bucket", "term", F.size("posts").alias("df"), F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s + x["tf"]).alias("tf"))
    counted = staged(counted.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")), "terms")
    unnamed = documents.where(F.col(doc_id).isNull()).agg(F.coalesce(F.sum(F.size(text.search_tokens(F.coalesce(body, F.lit(""))))), F.lit(0))).first()[0]
    total = unnamed + counted.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    terms = counted.drop("tf").withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    # the card comes last: without it there is no index
    spark.createDataFrame([(VERSION, buckets, n, total, source)], CARD).coalesce(1).write.mode("overwrite").json(f"{path}/card")


def _best_of_documents(k: int):
    """Cogroup of a block of documents (doc, term, w) and a block of queries (query, term): each query's k best documents of
    the block by the sum of w over its terms, to nine digits; ties by doc. Terms are added in their own order."""

    def ordered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        coded = column.combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[np.asarray(order)] = np.arange(len(order))
        return coded.dictionary.take(order), place[np.asarray(coded.indices)]

    def run(data: pa.Table, asking: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        docs, queries = data["doc"].combine_chunks()[:0], asking["query"].combine_chunks()[:0]
        if len(data) and len(asking):
            docs, at = ordered(data["doc"])
            terms, term = ordered(data["term"])
            order = np.argsort(term, kind="stable")
            at, w, start = at[order], np.asarray(data["w"])[order], np.searchsorted(term[order], np.arange(len(terms) + 1))
            queries, query = ordered(asking["query"])
            known = np.asarray(pc.fill_null(pc.index_in(asking["term"].combine_chunks(), terms), -1))
            query, known = query[known >= 0], known[known >= 0]
            order = np.lexsort((known, query))
            query, known = query[order], known[order]
            bounds = np.searchsorted(query, np.arange(len(queries) + 1))
            for q in range(len(queries)):
                spans = [slice(start[x], start[x + 1]) for x in known[bounds[q] : bounds[q + 1]]]
                if not spans:
                    continue
                met, weight = np.concatenate([at[s] for s in spans]), np.concatenate([w[s] for s in spans])
                if len(met) * 8 < len(docs):  # few of many
                    which, met = np.unique(met, return_inverse=True)
                    score = np.bincount(met, weight, len(which))
                else:
                    score = np.bincount(met, weight, len(docs))
                    which = np.flatnonzero(score > 0)  # weights are positive
                    score = score[which]
                if len(which) > k:
                    near = score >= np.partition(score, len(score) - k)[len(score) - k] - 2e-9
                    which, score = which[near], score[near]
                values, inverse = np.unique(score, return_inverse=True)
                score = np.array([float(Decimal(repr(float(x))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for x in values])[inverse]
                best = np.lexsort((which, -score))[:k]
                found.append((np.full(len(best), q), which[best], score[best]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table([queries.take(pa.array(columns[0])), docs.take(pa.array(columns[1])), pa.array(columns[2])], names=["query", "doc", "score"])

    return lambda key, data, asking: run(data, asking)


@dataclass
class SearchIndex:
    """An index that has been checked against its source."""

    spark: SparkSession
    path: str
    buckets: int
    n: int
    total: int

    @property
    def postings(self) -> DataFrame:
        """(bucket, term, doc, tf, length), a row each."""
        return self.spark.read.parquet(f"{self.path}/postings").select("bucket", "term", F.inline_outer("posts"))  # none is empty

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def _of(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of the asked terms. Few terms are put into the scan's filter, many are joined; both read the same."""
        few = [r.term for r in asked.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            by = self.spark.createDataFrame([(t,) for t in few], "term string").select(_bucket(F.col("term"), self.buckets).alias("bucket")).distinct().collect()
            return rows.where(F.col("bucket").isin([b.bucket for b in by]) & F.col("term").isin(few))
        return rows.join(asked.withColumn("bucket", _bucket(F.col("term"), self.buckets)), ["bucket", "term"], "left_semi")

    def bm25(self, queries: DataFrame, query_id: str, query_text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """The k best documents of each query: query, doc, score (nine digits), rank; ties by doc. A query's terms count
        once; queries without a known term have no rows.

        The asked terms' postings are dealt by document, and a block of documents meets a block of queries in one task,
        which keeps the k best of each query: no pair of a query and a document is shuffled but these. Blocks hold about
        POSTINGS postings and ASKED terms, so memory stays bounded.
        """
        asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(text.search_tokens(F.col(query_text)))).alias("term"))
        asked = staged(asked.where(F.col("query").isNotNull()).distinct(), "asked-terms")
        wanted = asked.select("term").distinct()
        terms = staged(self._of(self.terms, wanted).select("term", "df", "idf"), "wanted-terms")
        average = max(self.total / max(self.n, 1), 1.0)
        norm = F.lit(k1) * (1 - b + b * F.col("length") / F.lit(average))
        weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
        met = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        blocks, query_blocks = max(-(-met // POSTINGS), min(-(-met // (POSTINGS // 16)), 32), 1), -(-asked.count() // ASKED) or 1
        place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        weighted = self._of(self.postings, wanted).join(terms, "term").select("doc", "term", weight.alias("w"), place("doc", blocks).alias("d"))
        weighted = weighted.withColumn("q", spread(query_blocks))
        asking = asked.select("query", "term", place("query", query_blocks).alias("q"), spread(blocks).alias("d"))
        kinds = (asked.schema["query"].dataType.simpleString(), weighted.schema["doc"].dataType.simpleString())
        n = max(blocks * query_blocks, int(self.spark.conf.get("spark.sql.shuffle.partitions")))  # what a task sorts stays a few blocks
        deal = lambda rows: rows.repartition(n, "d", "q").groupBy("d", "q")
        scored = deal(weighted).cogroup(deal(asking)).applyInArrow(_best_of_documents(k), f"query {kinds[0]}, doc {kinds[1]}, score double")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def open_index(spark: SparkSession, path: str, source: str) -> SearchIndex:
    """The index at a path; an error that says why if there is none, or none that fits the source as it is now."""
    from pyspark.errors import AnalysisException

    try:
        card = spark.read.schema(CARD).json(f"{path}/card").first()
    except AnalysisException:
        card = None
    if card is None:
        raise ValueError("no search index")
    if card.version != VERSION:
        raise ValueError(f"version is {card.version}, not {VERSION}")
    if card.source != source:
        raise ValueError("the source has changed since the index was made")
    return SearchIndex(spark, path, card.buckets, card.n, card.total)
