"""Secrets in texts: fixed forms, and strings that look random to character Markov models.

Two models give the probability of each character after the one before it: one of random strings, one of ordinary
identifiers and words. Their samples are labelled by the fixed forms: what these match is random, every other run of
identifier characters is ordinary. A run that no fixed form touches is reported if it is so much likelier under the
model of random strings that chance can't explain it. Scores are whole micro-nats, so sums don't depend on their order.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import table
from presswork.llm.textkit import pieces, words

# The forms, and the order of kinds at one place.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_LEAST = 8  # characters of an ordinary run that is learnt from
RUN_LEAST = 16  # characters of a run that is judged
THRESHOLD = 12.0  # nats, over the whole run
EVEN_RANDOM, EVEN_ORDINARY = 0.2, 0.01  # share of each model that goes evenly to all characters
MICRO = 1_000_000

_ASSIGN = re.compile(ASSIGN.encode(), re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_N = len(ALPHABET)
_CODE = np.full(256, _N, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(_N)
_OUTSIDE = _CODE == _N
_NO_HEX = ~np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def _rows_with(text: bytes, wanted: tuple[bytes, ...], at: list[int]) -> list[int]:
    """The rows in which one of the strings stands."""
    found = set()
    for word in wanted:
        place = text.find(word)
        while place >= 0:
            row = bisect.bisect_right(at, place) - 1
            if place + len(word) <= at[row + 1]:
                found.add(row)
                place = at[row + 1]
            place = text.find(word, max(place, at[row + 1] - len(word) + 1))
    return sorted(found)


def _fixed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the fixed forms match: row, kind, start, end, start of the secret itself; places are bytes."""
    text, ends = data.tobytes(), at.tolist()
    found = []
    for row in _rows_with(text.lower(), _KEYWORDS, ends):
        # every match takes its bytes, also one that is then too short
        found += [(row, 0, m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text, ends[row], ends[row + 1]) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    for row in _rows_with(text, (b"AKIA",), ends):
        found += [(row, 1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text, ends[row], ends[row + 1])]
    start, end, row = words(data, at, _NO_HEX)
    fine = end - start >= HEX_LEAST
    runs = np.c_[row[fine], np.full(fine.sum(), 2), start[fine], end[fine], start[fine]]
    return np.vstack([np.array(found, np.int64).reshape(-1, 5), runs])


def _runs(data: np.ndarray, at: np.ndarray, fixed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of identifier characters that no fixed form touches."""
    start, end, row = words(data, at, _OUTSIDE)
    fine = end - start >= least
    start, end, row = start[fine], end[fine], row[fine]
    touched = np.zeros(len(data) + 1, np.int32)
    np.add.at(touched, fixed[:, 2], 1)
    np.add.at(touched, fixed[:, 3], -1)
    covered = np.r_[0, np.cumsum(np.cumsum(touched[:-1]) > 0)]
    free = covered[end] == covered[start]
    return start[free], end[free], row[free]


def _steps(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each byte, the number of the step from the one before it to it; steps begin anew at `begins` and behind bytes
    that are not in the alphabet. For those themselves, (N + 1) * N."""
    code = _CODE[data]
    before = np.r_[_N, code[:-1]] if len(code) else code
    before[begins] = _N
    return np.where(code < _N, before * _N + code, (_N + 1) * _N)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> for ordinary (0) and random (1) samples, how often each step occurs."""
    total = np.zeros((2, (_N + 1) * _N), np.int64)
    for batch in batches:
        for _, _, data, at in pieces(batch.column(0), 1 << 22):
            fixed = _fixed(data, at)
            start, end, _ = _runs(data, at, fixed, SAMPLE_LEAST)
            for kind, (a, b) in enumerate(((start, end), (fixed[:, 4], fixed[:, 3]))):
                size = b - a
                place = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(a) else a
                begins = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(a) else a
                total[kind] += np.bincount(_steps(data[place], begins), minlength=(_N + 1) * _N + 1)[:-1]
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total))], names=["random", "counts"])


def ratios(counts: np.ndarray) -> np.ndarray:
    """The score of each step: micro-nats by which it is likelier in random strings. After a character that a model's
    samples never held, it goes by how often the next one occurs at all."""
    model = []
    for n, even in zip(counts.reshape(2, _N + 1, _N).astype(float), (EVEN_ORDINARY, EVEN_RANDOM), strict=True):
        n = np.where(n.sum(1, keepdims=True) > 0, n, n.sum(0, keepdims=True))
        whole = n.sum(1, keepdims=True)
        model.append(np.where(whole > 0, (1 - even) * n / np.maximum(whole, 1) + even / _N, 1 / _N))
    return np.floor(MICRO * np.log(model[1] / model[0])).astype(np.int64).ravel()


def learn(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The scores of all steps between characters, from all samples of the texts; without samples, no step tells."""
    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(_counts, "random int, counts array<long>")
    counts = np.zeros((2, (_N + 1) * _N), np.int64)
    for r in sums.select("random", F.posexplode("counts").alias("step", "n")).groupBy("random", "step").agg(F.sum("n").alias("n")).where("n > 0").collect():
        counts[r.random, r.step] = r.n
    return ratios(counts)


def _scan(scores: np.ndarray, threshold: float):
    table_ = np.r_[scores, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 4), np.int64)]
            for i, _, data, at in pieces(batch.column(1), 1 << 22):
                fixed = _fixed(data, at)
                start, end, row = _runs(data, at, fixed, RUN_LEAST)
                if len(start):
                    sums = np.r_[0, np.cumsum(table_[_steps(data, start)])]
                    hit = sums[end] - sums[start] >= threshold * MICRO
                    fixed = np.vstack([fixed, np.c_[row[hit], np.full(hit.sum(), 3), start[hit], end[hit], start[hit]]])
                if len(fixed):
                    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
                    row, base = fixed[:, 0], point[at[fixed[:, 0]]]
                    found.append(np.c_[row + i, fixed[:, 1], point[fixed[:, 2]] - base, point[fixed[:, 3]] - base])
            spans = np.vstack(found)
            spans = spans[np.lexsort((spans[:, 1], spans[:, 2], spans[:, 0]))]
            each = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(spans[:, 1])), pa.array(spans[:, 2]), pa.array(spans[:, 3])], names=["kind", "start", "end"])
            offsets = np.searchsorted(spans[:, 0], np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), each)], names=["id", "found"])

    return run


def find_secrets(docs: DataFrame, scores: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id and found of each row: the secrets as (kind, start, end) by start, then in order of KINDS; places are code
    points, the end exclusive.

    assign, access and hex are the fixed forms, leftmost first and not overlapping within a kind; random are runs of
    identifier characters that touch none of them and score at least `threshold` nats. Null and empty texts hold none;
    rows that repeat are judged each on its own. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan(scores, threshold), f"id {kind}, found array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all documents, by models learnt from all of them."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, learn(docs))
    count = {f"n_{k}": _of_kind(k) for k in KINDS[:3]}
    base = _listed(F.filter("found", lambda s: s["kind"] != KINDS[3]))
    return found.select("doc_id", *(v.alias(k) for k, v in count.items()), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def secret_sql() -> str:
    """The same in SQL: places of matches from the lengths of what lies between them."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    assign = either + r"""[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)""".replace('""', '"')
    forms = {"assign": assign, "access": rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", "hex": rf"[0-9a-f]{{{HEX_LEAST},}}", "run": rf"[A-Za-z0-9+/_=-]{{{SAMPLE_LEAST},}}"}
    places = "\nUNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, hits[i] AS hit, (list_sum(list_transform(gaps[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: len(x))), 0))::BIGINT AS s FROM ("
        f"SELECT rid, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, string_split_regex(text, '{form}') AS gaps, regexp_extract_all(text, '{form}') AS hits FROM d))"
        for kind, form in forms.items()
    )
    steps = lambda what, rows: f"SELECT {what}, CASE WHEN i = 1 OR substr(x, i - 1, 1) = '.' THEN '^' ELSE substr(x, i - 1, 1) END AS a, substr(x, i, 1) AS b FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM ({rows}))"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
places AS MATERIALIZED ({places}),
fixed AS MATERIALIZED (SELECT rid, kind, s, s + len(hit) AS e, CASE WHEN kind = 'assign' THEN regexp_extract(hit, '{assign}', 2) ELSE hit END AS x FROM places
  WHERE kind <> 'run' AND (kind <> 'assign' OR len(regexp_extract(hit, '{assign}', 2)) >= {ASSIGN_LEAST})),
runs AS MATERIALIZED (SELECT rid, s, s + len(hit) AS e, hit AS x FROM places p WHERE kind = 'run' AND NOT EXISTS (FROM fixed f WHERE f.rid = p.rid AND f.s < p.s + len(p.hit) AND p.s < f.e)),
letters AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c),
counted AS (SELECT random, a, b, count(*) AS n FROM ({steps("random", "SELECT 1 AS random, x FROM fixed UNION ALL SELECT 0, x FROM runs")}) WHERE b IN (SELECT c FROM letters) GROUP BY ALL),
p AS MATERIALIZED (SELECT k.random, k.a, k.b, CASE WHEN w.n > 0 THEN (1 - k.even) * coalesce(c.n, 0) / w.n + k.even / {_N}
    WHEN t.n > 0 THEN (1 - k.even) * coalesce(u.n, 0) / t.n + k.even / {_N} ELSE 1.0::DOUBLE / {_N} END AS p
  FROM (SELECT * FROM (VALUES (0, {EVEN_ORDINARY}::DOUBLE), (1, {EVEN_RANDOM}::DOUBLE)) v(random, even), (SELECT c AS a FROM letters UNION ALL SELECT '^'), (SELECT c AS b FROM letters)) k
  LEFT JOIN counted c USING (random, a, b) LEFT JOIN (SELECT random, a, sum(n)::BIGINT AS n FROM counted GROUP BY ALL) w USING (random, a)
  LEFT JOIN (SELECT random, b, sum(n)::BIGINT AS n FROM counted GROUP BY ALL) u USING (random, b) LEFT JOIN (SELECT random, sum(n)::BIGINT AS n FROM counted GROUP BY ALL) t USING (random)),
score AS MATERIALIZED (SELECT r.a, r.b, floor({MICRO} * ln(r.p / o.p))::BIGINT AS v FROM p r JOIN p o USING (a, b) WHERE r.random = 1 AND o.random = 0),
random AS (SELECT rid, s, e FROM ({steps("rid, s, e", f"SELECT rid, s, e, x FROM runs WHERE len(x) >= {RUN_LEAST}")}) JOIN score USING (a, b) GROUP BY ALL HAVING sum(v) >= {int(THRESHOLD * MICRO)}),
spans AS (SELECT rid, kind, s, e FROM fixed UNION ALL SELECT rid, 'random', s, e FROM random),
listed AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex'], kind)) FILTER (kind <> 'random') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex', 'random'], kind)) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (rid)"""
