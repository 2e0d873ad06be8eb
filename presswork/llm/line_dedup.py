"""Removal of runs of lines that repeat across the corpus, cut by content.

Native: expressions, joins and aggregations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.llm.common import staged, table

#: Of a line's hash: 1 makes every line a boundary, so that no run of two lines is missed. A larger divisor gives fewer,
#: longer chunks, for corpora in which only long passages matter.
DIVISOR = 1
#: So many keys of two numbers are broadcast (some 30 MB), more are not.
KEYS = 1_000_000
_RUNS = "array<struct<first:int,last:int>>"


def _evaluated(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: a generator keeps the optimizer from copying their expressions
    into the functions over their elements, which would compute them anew for each element."""
    return rows.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("_x")).select(*rows.columns, "_x.*")


def _stretch(first: Column, last: Column) -> Column:
    """The lines from first to last (numbers from 1); none if last comes before first."""
    return F.slice(F.col("lines"), first, F.greatest(last - first + 1, F.lit(0)))


def _with_chunks(rows: DataFrame, divisor: int) -> DataFrame:
    """(id, mark, first, last, h1, h2) of each chunk: its lines (numbers from 1) and two hashes of its lines' hashes.

    Boundaries are the first and last line and those whose hash is divisible by the divisor; a chunk goes from one
    boundary to the next, both included. So it has two lines or more, depends on nothing outside it, and a repeated
    passage holds the same chunks wherever it stands. Chunks of blank lines only are left out.
    """
    lined = _evaluated(rows, lines=F.split("text", "\n", -1))
    lined = _evaluated(lined, one=F.transform("lines", lambda x: F.xxhash64(x)), two=F.transform("lines", lambda x: F.xxhash64(F.lit("again"), x)), worded=F.transform("lines", lambda x: F.length(F.trim(x)) > 0)).drop("lines")
    edge = lambda i: (i == 1) | (i == F.size("one")) | (F.pmod(F.element_at("one", i), F.lit(divisor)) == 0)
    every = F.sequence(F.lit(1), F.size("one"))
    cut = _evaluated(lined, edges=every if divisor == 1 else F.filter(every, edge))

    def chunk(k: Column) -> Column:
        first, last = F.element_at("edges", k), F.element_at("edges", k + 1)
        of = lambda c: F.slice(c, first, last - first + 1)
        return F.struct(first.alias("first"), last.alias("last"), F.xxhash64(of("one")).alias("h1"), F.xxhash64(of("two")).alias("h2"), F.exists(of("worded"), lambda w: w).alias("worded"))

    each = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), chunk)
    return cut.where(F.size("edges") > 1).select("id", "mark", F.explode(each).alias("chunk")).select("id", "mark", "chunk.*").where("worded").drop("worded")


def _with(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Joins on id and mark, ids of null included; the columns of rows, then the others of the other."""
    other = other.withColumnRenamed("id", "_id").withColumnRenamed("mark", "_mark")
    return rows.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), how).drop("_id", "_mark")


def _merged(runs: Column) -> Column:
    """Runs in order of their first lines, those that touch or overlap made one."""
    pair = lambda first, last: F.array(F.struct(first.alias("first"), last.alias("last")))

    def add(done: Column, run: Column) -> Column:
        end = F.element_at(done, F.greatest(F.size(done), F.lit(1)))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), pair(end["first"], F.greatest(end["last"], run["last"])))
        return F.when((F.size(done) > 0) & (run["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1), joined).otherwise(F.concat(done, pair(run["first"], run["last"])))

    return F.aggregate(F.array_sort(runs), F.array().cast(_RUNS), add)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """Removes runs of two lines or more whose bytes already stood elsewhere: with a smaller id, or further up.

    A chunk (see _with_chunks) is repeated if it is not the first of its kind in the corpus, found by 128 bits of hash;
    neighbouring chunks with neighbouring first places are joined to runs, and runs compared with their first places byte
    by byte. Returns for each row the id, n_lines, removed (first and last line of each maximal removed run, from 1)
    and kept (the other lines, joined by line feeds). Every removed chunk stands further up or under a smaller id, so
    the first place of each stays. With divisor 1 every repeated run is found; with a larger one, those that hold two
    boundaries. A null text has no lines and stays empty; an empty text has one. Rows that agree in id and text count as
    one place, and all of them keep what is kept there; a null id comes before others. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    chunks = _with_chunks(rows.where(F.col("text").contains("\n")), divisor)
    place = F.struct("id", "mark", "first")
    places = chunks.groupBy("h1", "h2").agg(F.min(place).alias("earliest"), F.max(place).alias("other"))
    # staged, here and below, so that Spark can split joins with chunks that a third of all texts hold
    places = staged(places.where("not (earliest <=> other)").drop("other"))
    again = chunks.join(places, ["h1", "h2"]).where(~place.eqNullSafe(F.col("earliest")))
    again = again.select("id", "mark", "first", "last", "earliest.id", "earliest.mark", "earliest.first").toDF("id", "mark", "first", "last", "e_id", "e_mark", "e_first").distinct()
    same_way = Window.partitionBy("id", "mark", "e_id", "e_mark", F.col("e_first") - F.col("first")).orderBy("first")
    runs = again.withColumn("run", F.sum(F.coalesce((F.col("first") > F.lag("last").over(same_way) + 1).cast("int"), F.lit(1))).over(same_way))
    runs = runs.withColumn("off", F.col("e_first") - F.col("first")).groupBy("id", "mark", "e_id", "e_mark", "off", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    # runs that touch are removed as one
    by_place = Window.partitionBy("id", "mark").orderBy("first", "last")
    reach = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("island", F.sum(F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1))).over(by_place))
    runs = staged(runs.withColumns({"e_first": F.col("first") + F.col("off"), "e_last": F.col("last") + F.col("off")}).drop("off"))

    wanted = runs.groupBy(F.col("e_id").alias("id"), F.col("e_mark").alias("mark")).agg(F.collect_set(F.struct("e_first", "e_last")).alias("wanted"))
    wanted = staged(wanted)
    # first places are few: if their keys are, they pick the texts out before these are shuffled; the result is the same
    few = wanted.count() <= KEYS
    texts = _with(rows, F.broadcast(wanted.select("id", "mark")), "left_semi") if few else rows
    holders = _evaluated(_with(texts, wanted, "inner"), lines=F.split("text", "\n", -1)).drop("text")
    stretch = lambda w: F.struct(w["e_first"].alias("e_first"), w["e_last"].alias("e_last"), F.array_join(_stretch(w["e_first"], w["e_last"]), "\n").alias("expected"))
    firsts = holders.select(F.col("id").alias("f_id"), F.col("mark").alias("e_mark"), F.explode(F.transform("wanted", stretch)).alias("w")).select("f_id", "e_mark", "w.*")
    firsts = staged(firsts.dropDuplicates(["f_id", "e_mark", "e_first", "e_last"]))
    known = runs.join(firsts, (runs.e_id.eqNullSafe(firsts.f_id)) & (runs.e_mark == firsts.e_mark) & (runs.e_first == firsts.e_first) & (runs.e_last == firsts.e_last))
    members = known.groupBy(runs.id, runs.mark, "island").agg(F.min(runs["first"]).alias("first"), F.max("last").alias("last"), F.collect_list(F.struct(runs["first"], "last", "expected")).alias("members"))
    gone = members.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("first", "last", "members"))).alias("islands"))

    out = _with(rows, gone, "left")
    fits = lambda m: F.array_join(_stretch(m["first"], m["last"]), "\n") == m["expected"]
    left = lambda i: _merged(F.transform(F.filter(i["members"], fits), lambda m: F.struct(m["first"].alias("first"), m["last"].alias("last"))))
    # hashes agree by chance next to never: a whole island goes, unless one of its runs turns out to differ
    removed = F.flatten(F.transform("islands", lambda i: F.when(F.forall(i["members"], fits), F.array(F.struct(i["first"].alias("first"), i["last"].alias("last")))).otherwise(left(i))))
    held = _evaluated(out.where("islands is not null"), lines=F.split("text", "\n", -1))
    held = _evaluated(held, removed=removed).select("id", "text", "removed")
    out = out.where("islands is null").select("id", "text", F.array().cast(_RUNS).alias("removed")).unionByName(held)

    n_lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0))
    untouched = out.where(F.size("removed") == 0).select("id", n_lines.alias("n_lines"), "removed", F.coalesce("text", F.lit("")).alias("kept"))
    cut = _evaluated(out.where(F.size("removed") > 0), lines=F.split("text", "\n", -1))
    gap = lambda r, k: _stretch(F.when(k > 0, F.element_at("removed", F.greatest(k, F.lit(1)))["last"]).otherwise(0) + 1, r["first"] - 1)
    rest = _stretch(F.element_at("removed", -1)["last"] + 1, F.size("lines"))
    kept = F.array_join(F.concat(F.flatten(F.transform("removed", gap)), rest), "\n")
    return untouched.unionByName(cut.select("id", n_lines.alias("n_lines"), "removed", kept.alias("kept"))).withColumnRenamed("id", id_col)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, how many of them are removed, and a digest of the rest."""
    out = remove_repeated_lines(table(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), n.cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] AS t FROM (SELECT doc_id, lines, unnest(range(1, len(lines))) AS i FROM d) WHERE length(trim(lines[i])) > 0 OR length(trim(lines[i + 1])) > 0),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM c),
g AS (SELECT doc_id, list_distinct(flatten(list([i, i + 1]))) AS gone FROM r WHERE k > 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i)), chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
