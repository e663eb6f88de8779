"""Op 6. Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of ``size`` consecutive words; an item of fewer
words, but not none, is one window. A document word inside any occurrence of a
window is hit. A window is taken as the set of its positioned two-word shingles
(one-word windows: the word). As a window must be contained whole, a prefix of
one shingle is enough: its rarest, by counts over all documents. Documents meet
windows on that shingle only; its offset in the window and the window's length
then fix and bound the place in the document, where the words are compared
exactly.

The windows of the benchmark go to the workers in groups of about ``group_mb``
MB of item text, each group against all documents, so that what is broadcast is
bounded whatever the size of the benchmark; with more than one group the spans
of a document meet by one aggregation. Documents themselves are never shuffled
with one group.

Nulls: a null text has no words; a null item_id takes part and is shown as ''.
Repeated items and repeated documents keep their rows; an item id counts once
for a document. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plexgraph.llm.common import doc_text, sliced, stored, table

SIZE = 10
GROUP_MB = 8

#: ASCII to lower case, and all that is no word byte to a blank; bytes from 0x80 on are parts of word characters.
_TO = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO).split()


def _windows(items: list[tuple[str, bytes]], size: int) -> dict[tuple, set[str]]:
    """Each window and the items that have it."""
    out: dict[tuple, set[str]] = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[k : k + size]), set()).add(item)
    return out


def _shingles(window) -> list[tuple]:
    return list(zip(window, window[1:])) or [tuple(window)]


def _count(docs: DataFrame, wanted) -> DataFrame:
    """How often each wanted shingle occurs in all documents: (key, n)."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        from plexgraph.llm.common import utf8

        keys, n = wanted.value, Counter()
        alone = any(len(k) == 1 for k in keys)
        for b in batches:
            for t in utf8(b.column("text")):
                w = words(t)
                n.update(p for p in zip(w, w[1:]) if p in keys)
                if alone:
                    n.update(p for p in zip(w) if p in keys)
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(k) for k in n], pa.binary()), pa.array(list(n.values()), pa.int64())], ["key", "n"])

    return docs.mapInArrow(sliced(run), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _join(docs: DataFrame, index) -> DataFrame:
    """The input's rows with n_words, spans of hit words and ids of the items found."""

    def run(batches):
        import pyarrow as pa

        from plexgraph.llm.common import utf8

        by, alone, kinds = index.value
        for b in batches:
            n_words, spans, found = [], [], []
            for t in utf8(b.column("text")):
                w = words(t)
                n, at, items = len(w), [], set()
                hits = [(k, p) for k, p in enumerate(zip(w, w[1:])) if p in by]
                if alone:
                    hits += [(k, p) for k, p in enumerate(zip(w)) if p in by]
                for k, p in hits:
                    for (offset, length), of in by[p].items():
                        s = k - offset
                        if s >= 0 and s + length <= n and (got := of.get(tuple(w[s : s + length]))):
                            at.append((s, s + length))
                            items |= got
                merged: list[list[int]] = []
                for s, e in sorted(at):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                n_words.append(n)
                spans.append([{"start": s, "end": e} for s, e in merged])
                found.append(sorted(items))
            kept = [(x, b.column(x)) for x in kinds]
            new = [("n_words", pa.array(n_words, pa.int64())), ("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))), ("items", pa.array(found, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([x for _, x in kept + new], [x for x, _ in kept + new])

    kinds = index.value[2]
    added = StructType.fromDDL("n_words long, spans array<struct<start: long, end: long>>, items array<string>")
    return docs.mapInArrow(sliced(run), StructType([docs.schema[c] for c in kinds] + added.fields))


def overlaps(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, group_mb: float = GROUP_MB, keep: tuple = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs (which has ``text``; none of them named like what is added) with n_words, spans (maximal runs of hit words) and items (ids, sorted)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mb = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6
    groups = max(1, int(-(-mb // group_mb)))
    row = "_row"
    while row in {c.lower() for c in keep}:
        row += "_"
    if groups > 1:
        docs = stored(docs.select(F.monotonically_increasing_id().alias(row), *dict.fromkeys((*keep, "text"))))
    parts = None
    for g in range(groups):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect()
        windows = _windows([(r.item, r.text.encode()) for r in own], size)
        wanted = spark.sparkContext.broadcast({p for w in windows for p in _shingles(w)})
        rarity = {tuple(r.key.split(b" ")): r.n for r in _count(docs.select("text"), wanted).collect()} if windows else {}
        by: dict = {}
        for w, of in windows.items():
            offset, p = min(enumerate(_shingles(w)), key=lambda x: (rarity.get(x[1], 0), x[1], x[0]))
            if p in rarity:
                by.setdefault(p, {}).setdefault((offset, len(w)), {})[w] = of
        index = spark.sparkContext.broadcast((by, any(len(p) == 1 for p in by), ([row] if groups > 1 else []) + list(keep)))
        part = _join(docs, index)
        parts = part if parts is None else parts.unionByName(part)
    if groups == 1:
        return parts
    return _merged(parts, row, keep)


def _merged(parts: DataFrame, row: str, keep: tuple) -> DataFrame:
    """One row per document from its rows of each group: spans united, items united."""
    firsts = [F.first(c).alias(c) for c in (*keep, "n_words")]
    rows = parts.groupBy(row).agg(*firsts, F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grow = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s)))
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return rows.select(*keep, "n_words", F.aggregate("spans", empty, grow).alias("spans"), "items")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(overlaps(doc_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")))


QUERIES = {"op6_decontaminate": op6_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op6_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), {SIZE}) AS n, list_slice(w, k, k + {SIZE} - 1) AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {SIZE} - 1 + 3, 2))) AS k FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, k, n, list_slice(w, k, k + n - 1) AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
}
