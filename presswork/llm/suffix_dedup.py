"""Exact removal of long repeated strings, by prefix-free parsing.

Departs from the letter of prefix-free parsing: triggers are minimisers (of any `spread` neighbouring positions the one
with the least hash of its 16 bytes), so equal text gets equal triggers wherever it stands; phrases are the fixed stretch of
bytes at a trigger, not the text between two; and neither a sequence of phrase ranks nor a suffix array is built. Every
string of `length` bytes belongs to the trigger that it chooses itself, and so only meets strings that share that trigger's
phrase. What remains is to tell apart the strings of each phrase:

* a phrase seen once ends here; a phrase that is the same wherever it occurs is repeated as a whole;
* phrases with several surroundings are compared as wholes, then in cells of neighbouring suffixes, and where a cell has
  several surroundings too, suffix by suffix, each cut at `length` bytes. Only whether two suffixes agree over `length`
  bytes matters, so their classes are formed by hash (128 bits) instead of by sorting.

All steps are joins and aggregations on hashes; a phrase that a third of all texts hold is counted map-side
and met by a join whose large keys Spark splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import staged, table
from presswork.llm.textkit import Prefix, bytes_of, pieces, sliding_min

GRAM = 16
CELL = 8


def _triggers(length: int, spread: int):
    """For Arrow batches of (id, mark, text): a row for each phrase with the strings that choose its trigger."""
    core = length - spread + 1

    def run(batches):
        for batch in batches:
            for i, _, data, at in pieces(batch.column(2)):
                n = len(data)
                if n < length:
                    continue
                row_len = np.diff(at)
                long = np.flatnonzero(row_len >= length)
                if not len(long):
                    continue
                step = np.zeros(n + 1, np.int8)
                np.add.at(step, at[long], 1)
                np.add.at(step, at[long] + row_len[long] - length + 1, -1)
                starts = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8) > 0)
                pre = Prefix(data)
                gram = pre.rolling(GRAM)
                bits = np.uint64((1 << max(24, n.bit_length())) - 1)
                key = (gram & ~bits) | (bits - np.arange(len(gram), dtype=np.uint64))
                least = sliding_min(key, spread)[starts]
                trigger = (bits - (least & bits)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)])
                last = np.r_[first[1:], len(starts)] - 1
                lo, hi, t = starts[first], starts[last], trigger[first]
                row = np.searchsorted(at, lo, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + i)),
                        batch.column(1).take(pa.array(row + i)),
                        pa.array((lo - at[row]).astype(np.int32)),
                        pa.array((hi - lo + 1).astype(np.int32)),
                        pa.array((t - lo).astype(np.int32)),
                        pa.array(pre.hash(t, t + core).view(np.int64)),
                        pa.array(pre.hash(lo, hi + length).view(np.int64)),
                    ],
                    names=["id", "mark", "lo", "n", "t", "phrase", "around"],
                )

    return run


def _contexts(length: int):
    """For (id, mark, text, parts: list of (lo, n, t, phrase)): each part with the bytes that its strings cover."""

    def run(batches):
        for batch in batches:
            parts = batch.column(3)
            part_at = np.asarray(parts.offsets, np.int64)
            flat = parts.values
            los, ns = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
            data, at = bytes_of(batch.column(2))
            row = np.repeat(np.arange(len(batch)), np.diff(part_at))
            a, b = int(part_at[0]), int(part_at[-1])
            begin = at[row] + los[a:b]
            around = [data[x:y].tobytes() for x, y in zip(begin, begin + ns[a:b] - 1 + length, strict=True)]
            columns = [batch.column(k).take(pa.array(row)) for k in (0, 1)] + [flat.field(k).slice(a, b - a) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(around, pa.binary())], names=["id", "mark", "lo", "n", "t", "phrase", "bytes"])

    return run


def _cells(length: int, width: int):
    """For contexts: runs of up to `width` strings at the same distance from the trigger, with the hash of what all
    of them cover together and of what they have in common."""

    def run(batches):
        for batch in batches:
            lo, n, t = (np.asarray(batch.column(k), np.int64) for k in (2, 3, 4))
            q0, q1 = (t - n + 1) // width, t // width  # distance of the string from the trigger: t - n + 1 .. t
            each = q1 - q0 + 1
            row = np.repeat(np.arange(len(batch)), each)
            q = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + q0[row]
            first = t[row] - np.minimum(q * width + width - 1, t[row])
            last = np.minimum(t[row] - q * width, n[row] - 1)
            core, full = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
            cut = np.r_[0, np.cumsum(each)]
            for i, j, data, at in pieces(batch.column(6)):
                k = slice(cut[i], cut[j])
                pre, base = Prefix(data), at[row[k] - i]
                inner = base + (t[row] - q * width)[k]  # in all strings of the cell, also those that neighbours cut off
                core[k] = pre.hash(inner, inner - width + 1 + length)
                full[k] = pre.hash(base + first[k], base + last[k] + length)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(pa.array(row)) for k in (0, 1, 2, 5)),
                    pa.array(first.astype(np.int32)),
                    pa.array((last - first + 1).astype(np.int32)),
                    pa.array(core.view(np.int64)),
                    pa.array(full.view(np.int64)),
                ],
                names=["id", "mark", "lo", "phrase", "first", "n", "core", "full"],
            )

    return run


def _suffixes(length: int):
    """For contexts with cells: list of (first, n): the hash of each string in them."""

    def run(batches):
        for batch in batches:
            cells = batch.column(5)
            cell_at = np.asarray(cells.offsets, np.int64)
            firsts, ns = (np.asarray(cells.values.field(k), np.int64) for k in (0, 1))
            for i, j, data, at in pieces(batch.column(4)):
                a, b = int(cell_at[i]), int(cell_at[j])
                row = np.repeat(np.arange(i, j), np.diff(cell_at[i : j + 1]))
                n = ns[a:b]
                offsets = np.r_[0, np.cumsum(n)]
                pos = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - at[row - i] - firsts[a:b], n)
                keys = Prefix(data).hash(pos, pos + length).view(np.int64)
                lo = np.asarray(batch.column(2), np.int64)[row] + firsts[a:b]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).take(pa.array(row)) for k in (0, 1)),
                        pa.array(lo.astype(np.int32)),
                        batch.column(3).take(pa.array(row)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys)),
                    ],
                    names=["id", "mark", "lo", "phrase", "keys"],
                )

    return run


def _cut(length: int):
    """For (id, text, spans: list of (lo, n)): the text without them, and the maximal removed runs."""

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            spans = batch.column(2)
            span_at = np.asarray(spans.offsets, np.int64)
            los, ns = (np.asarray(spans.values.field(k), np.int64) for k in (0, 1))
            kept, runs = [], []
            for i in range(len(batch)):
                text = data[at[i] : at[i + 1]]
                a, b = span_at[i], span_at[i + 1]
                if not spans.is_valid()[i].as_py() or a == b:
                    kept.append(text.tobytes())
                    runs.append([])
                    continue
                step = np.zeros(len(text) + 2, np.int32)
                np.add.at(step, los[a:b], 1)
                np.add.at(step, los[a:b] + ns[a:b] - 1 + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)))
                kept.append(text[~gone[: len(text)]].tobytes())
                runs.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at)),
                    pa.array(kept, pa.binary()),
                    pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["id", "n_bytes", "kept", "spans"],
            )

    return run


def _same(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["mark"] == b["mark"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, spread: int = 150) -> DataFrame:
    """Removes each byte that lies in a `length`-byte string which also starts anywhere else in the corpus.

    Returns, for each row: the id, n_bytes (of the text in UTF-8), kept (binary: what remains, which may cut
    a character) and spans (start and end of each maximal removed run, in bytes). Strings never cross rows;
    all are judged on the input. Null and empty texts, and texts shorter than `length`, come back whole. Rows
    that repeat each other lose all their strings; an id may be null or repeat. Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    long_rows = rows.where(F.octet_length("text") >= length)
    found = long_rows.mapInArrow(_triggers(length, spread), f"id {id_type}, mark long, lo int, n int, t int, phrase long, around long")
    dictionary = found.groupBy("phrase").agg(F.count("*").alias("c"), F.min("around").alias("a"), F.max("around").alias("b")).where("c > 1")
    # staged, so that the join is one of two plain inputs, whose large partitions Spark can split
    dictionary = staged(dictionary.select("phrase", (F.col("a") != F.col("b")).alias("several")))
    parse = staged(found.join(dictionary, "phrase"))

    several = parse.where("several")
    around = staged(several.groupBy("phrase", "around").agg(F.count("*").alias("c"), F.min(F.struct("mark", "lo", "n", "t", "id")).alias("one")))
    parts = around.select("phrase", "one.*").groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "n", "t", "phrase")).alias("parts"))
    with_parts = long_rows.join(parts, _same(long_rows, parts)).select(long_rows["id"], long_rows["mark"], "text", "parts")
    contexts = staged(with_parts.mapInArrow(_contexts(length), f"id {id_type}, mark long, lo int, n int, t int, phrase long, bytes binary"))

    cells = contexts.mapInArrow(_cells(length, CELL), f"id {id_type}, mark long, lo int, phrase long, first int, n int, core long, full long")
    cores = cells.groupBy("phrase", "core").agg(F.count("*").alias("c"), F.min("full").alias("a"), F.max("full").alias("b")).where("c > 1")
    cores = staged(cores.select("phrase", "core", (F.col("a") != F.col("b")).alias("several")))
    cells = staged(cells.join(cores, ["phrase", "core"]).drop("core", "full"))
    open_cells = cells.where("several").groupBy("id", "mark", "lo").agg(F.collect_list(F.struct("first", "n")).alias("cells"))
    with_cells = contexts.join(open_cells, _same(contexts, open_cells) & (contexts["lo"] == open_cells["lo"]))
    with_cells = with_cells.select(contexts["id"], contexts["mark"], contexts["lo"], "phrase", "bytes", "cells")
    suffixes = staged(with_cells.mapInArrow(_suffixes(length), f"id {id_type}, mark long, lo int, phrase long, keys array<long>"))
    each = suffixes.select("id", "mark", "lo", "phrase", F.posexplode("keys").alias("at", "key"))
    shared = staged(each.groupBy("phrase", "key").agg(F.count("*").alias("c")).where("c > 1").select("phrase", "key"))

    spans = (
        parse.where("not several").select("id", "mark", "lo", "n")
        .unionByName(several.join(around.where("c > 1").select("phrase", "around"), ["phrase", "around"]).select("id", "mark", "lo", "n"))
        .unionByName(cells.where("not several").select("id", "mark", (F.col("lo") + F.col("first")).alias("lo"), "n"))
        .unionByName(each.join(shared, ["phrase", "key"]).select("id", "mark", (F.col("lo") + F.col("at")).alias("lo"), F.lit(1).alias("n")))
    )
    spans = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    whole = rows.join(spans, _same(rows, spans), "left").select(rows["id"], "text", "spans")
    out = whole.mapInArrow(_cut(length), f"id {id_type}, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bytes of each document stand in repeated strings of 200 bytes, and a digest of the others."""
    out = remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200),
h AS (SELECT w.doc_id, i, md5(b[i:i + 199]) AS h FROM w JOIN d USING (doc_id)),
g AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
o AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM g),
r AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS a, s - 1 AS z FROM r UNION ALL SELECT d.doc_id, coalesce(max(e), 1), max(n) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
x AS (SELECT doc_id, string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, (d.n - length(kept) // 2)::BIGINT AS n_removed, (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN x USING (doc_id)
"""
