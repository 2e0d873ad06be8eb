"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import staged, table

_GAP = re.compile(r"\W+")


def plain(text: str | None) -> str:
    """Lower-cased words with single blanks between them."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def error_budget(n: int, error_rate: float, short: int) -> int:
    """How many edits an item of n characters may have suffered; none if it is short."""
    return int(n * error_rate) if n >= short else 0


def split_item(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces, one of which any text with no more edits must hold untouched: (place in the item, piece)."""
    cut = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def edit_distance_within(item: str, text: str) -> int:
    """Least edit distance between the item and any stretch of the text (Myers' bit vectors)."""
    m = len(item)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: no cost in the row above
        plus = (mh << 1 & full) | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best = score
    return best


class _Matcher:
    """Finds the items of a block in texts. An item is held as (place in the list, text, edits that it may have)."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, short: int):
        self.items: list[tuple[int | None, str, int]] = []
        self.pieces = ahocorasick.Automaton()
        for key, text in sorted(set(items), key=lambda x: (x[0] is None, x)):
            errors = error_budget(len(text), error_rate, short)
            held = text if errors else f" {text} "  # without edits it must begin and end where words do
            for place, piece in split_item(held, errors):
                self.pieces.add_word(piece, [*self.pieces.get(piece, []), (len(self.items), place + len(piece))])
            self.items.append((key, held, errors))
        if self.items:
            self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """(item's id, distance) of each item that the text holds with no more edits than its budget; the least
        distance of those that share an id."""
        best: dict[int, int] = {}
        if not self.items or not text:
            return []
        text, seen = f" {text} ", set()
        for end, hits in self.pieces.iter(text):
            for at, upto in hits:  # the item's first `upto` characters end here, if nothing is edited
                if best.get(at) == 0:
                    continue
                _, item, errors = self.items[at]
                start = end + 1 - upto
                if (at, start) in seen:
                    continue
                seen.add((at, start))
                window = text[max(0, start - errors) : start + len(item) + errors]
                distance = 0 if item in window else edit_distance_within(item, window) if errors else len(item)
                if distance <= errors and distance < best.get(at, errors + 1):
                    best[at] = distance
        least: dict[int | None, int] = {}
        for at, distance in best.items():
            key = self.items[at][0]
            least[key] = min(distance, least.get(key, distance))
        return sorted(least.items(), key=lambda x: (x[0] is None, x))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = 0.05, short: int = 40, block_chars: int = 8_000_000,
) -> DataFrame:
    """A row (id, item_id, distance) for each document and each benchmark item that the document holds.

    Both are lower-cased and their words joined by single blanks. An item is held if some stretch of the document
    is within error_rate * length edits of it (items under `short` characters: exactly, as whole words). Items without
    a word and null texts match nothing. Rows of the benchmark that share an id, null included, are one item with
    several texts, and documents that share one are one document: the least distance counts. Other columns are ignored.
    The benchmark is taken in blocks of about `block_chars` characters: one block is broadcast at a time,
    and its hits are written before the next, so neither the driver nor a task ever holds more than a block; each block
    reads the documents once.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(item_text_col).alias("t")).where("t is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = int(chars // block_chars) + 1
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in range(blocks):
        part = [(r.k, p) for r in items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).toLocalIterator() if (p := plain(r.t))]
        held = spark.sparkContext.broadcast(part)

        def run(batches, held=held):
            matcher = _Matcher(held.value, error_rate, short)
            for batch in batches:
                found = [(k, *hit) for k, text in zip(batch["id"], batch["text"], strict=True) for hit in matcher.find(plain(text))]
                if found:
                    yield pd.DataFrame(found, columns=["id", "item_id", "distance"]).astype({"item_id": "Int64"})

        found = staged(rows.mapInPandas(run, f"id {kind}, item_id long, distance int"))
        held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.groupBy(F.col("id").alias(id_col), "item_id").agg(F.min("distance").alias("distance"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: how many items it holds, which (a null id last), and the least distance (null if none).

    Rows that share an id, null included, each show what any of them holds.
    """
    docs = table(spark, sf_dir, "documents")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", "_id")
    ids = F.transform(F.collect_list(F.struct("item_id")), lambda x: x["item_id"])
    per = leaks.groupBy("_id").agg(F.count("*").alias("n"), F.array_sort(ids).alias("item_ids"), F.min("distance").alias("distance"))
    return docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "distance"
    )
