"""Op 7. Suffix-array dedup of byte strings that repeat.

Removed is every byte covered by a string of ``LENGTH`` bytes that also starts
anywhere else. Strings are compared where they can be equal: each string of
``LENGTH`` bytes picks the least hash among its substrings of ``GRAM`` bytes as its
anchor, and equal strings pick the same. The strings of a document that share an
anchor start next to one another, so they form one region of text. An anchor that
occurs once is done with. The regions of all others are brought together by anchor:
each different text once, or as two copies if it occurs again. Their suffixes are
sorted in two stages: suffixes smaller than their successors directly, the others
induced from them by one scan over the buckets of first bytes. Adjacent common
prefixes of at least ``LENGTH`` bytes are the repeated strings.

An anchor may have more than ``GROUP`` different regions. They are split by the
bytes around the anchor: a string holds ``k`` bytes before the anchor's substring
and ``LENGTH - GRAM - k`` after it, so two equal strings agree either on the upper
half of the possible bytes before it or on the upper half of those after it. Each
region goes to the bucket of either half, and a bucket that is still too large is
split again, until it holds one string alone, which then needs no sorting. So every
bucket is bounded and no pair of equal strings is parted.

Texts stay where they are: they are written once, in buckets, and what is found
about a document is sent to its bucket. Anchors, regions and their counts are rows
of hashes that are summed before they are shuffled. Copies of a region are known by
three hashes of 64 bits: its anchor's, one of the whole region, and, where bytes are
cut out, another one of these bytes against those that were sorted. All steps are
tables in the shared folder and are removed once the next one is stored.

Nulls: a null text is empty; a null doc_id keeps its row. Repeated documents keep
their rows and are repeats of one another. Texts shorter than ``LENGTH`` lose
nothing. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm.common import Scratch, doc_text, parts_for, settings, sliced, stored, table
from plexgraph.llm.words import mixed as _mixed

LENGTH = 200
GRAM = 73
#: Regions that are sorted together at most; one has less than 2 x LENGTH bytes.
GROUP = 4096
SORT_BYTES = 1 << 18
CHUNK = 1 << 18

_TABLES: dict = {}


def _tables():
    """(a random number for each byte, powers of the base, powers of its inverse)."""
    import numpy as np

    if not _TABLES:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            power = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(CHUNK + 2 * LENGTH, b, np.uint64))])
            _TABLES["x"] = (_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)), power(base), power(inverse))
    return _TABLES["x"]


class Regions:
    """The regions of some texts: arrays text, start, end and at, the anchor's place (in the text), anchor and u, the hash of the region's text."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        import numpy as np

        parts, group, size = [], [], 0
        for k, t in enumerate(texts):
            for at in range(0, max(0, len(t) - length + 1), CHUNK):  # a long text in pieces that overlap by length - 1
                piece = t[at : at + CHUNK + length - 1]
                if size + len(piece) > CHUNK and group:
                    parts.append(self._of(group, length, gram))
                    group, size = [], 0
                group.append((k, at, piece))
                size += len(piece)
        if group:
            parts.append(self._of(group, length, gram))
        none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.text, self.start, self.end, self.at, self.anchor, self.u = (np.concatenate(x) for x in zip(*parts)) if parts else none

    @staticmethod
    def _of(group, length: int, gram: int):
        import numpy as np

        random, power, inverse = _tables()
        flat = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        n = len(flat)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(random[flat] * power[:n], out=sums[1:])
        grams = _mixed((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])
        low = np.uint64((1 << 21) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first
        window, have = length - gram + 1, 1
        while have < window:  # least of ever longer runs
            step = min(have, window - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        sizes = np.array([len(p) for _, _, p in group])
        first = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        starts = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = (least[starts] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        s, e, a = starts[new], starts[last] + length, at[new]
        u = _mixed((sums[e] - sums[s]) * inverse[s] + _mixed((e - s).astype(np.uint64)))
        of = np.searchsorted(first, s, side="right") - 1
        text = np.array([k for k, _, _ in group])[of]
        offset = np.array([o for _, o, _ in group])[of] - first[of]
        return text, s + offset, e + offset, a + offset, grams[a], u

    def key(self):
        """One number for each region of each text."""
        return _keys(self.u, self.text)


def _keys(u, text):
    import numpy as np

    return _mixed(u + _mixed(text.astype(np.uint64)))


def _listed(column, *fields: str):
    """Of an Arrow column of lists of structs: the row of each struct, and its fields."""
    import numpy as np

    flat, size = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), [flat.field(f) for f in fields]


def _pairs(batches):
    """(anchor, u, row, n) of each document."""
    import numpy as np
    import pyarrow as pa

    from plexgraph.llm.common import utf8

    for b in batches:
        r = Regions(utf8(b.column("text")))
        _, one, n = np.unique(r.key(), return_index=True, return_counts=True)
        rows = np.array(b.column("row").to_pylist(), np.int64)[r.text[one]]
        yield pa.RecordBatch.from_arrays([pa.array(r.anchor[one].view(np.int64)), pa.array(r.u[one].view(np.int64)), pa.array(rows), pa.array(n.astype(np.int32))], ["anchor", "u", "row", "n"])


def _texts_of(batches):
    """The texts of the regions asked for: (anchor, u, twice, at, content)."""
    import numpy as np
    import pyarrow as pa

    from plexgraph.llm.common import utf8

    for b in batches:
        texts = utf8(b.column("text"))
        r = Regions(texts)
        of, (u, twice) = _listed(b.column("asked"), "u", "twice")
        key = r.key()
        order = np.argsort(key, kind="stable")
        j = order[np.searchsorted(key[order], _keys(u.to_numpy().view(np.uint64), of))]
        content = [texts[k][s:e] for k, s, e in zip(of, r.start[j], r.end[j])]
        cols = [pa.array(r.anchor[j].view(np.int64)), u, twice, pa.array((r.at[j] - r.start[j]).astype(np.int32)), pa.array(content, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["anchor", "u", "twice", "at", "content"])


def sort_suffixes(t, raw: bytes, depth: int = LENGTH, asked=None):
    """Two-stage suffix sorting of symbols ``t`` (0 ends a string, bytes are 1 up), right to ``depth`` symbols.

    raw: the same text as bytes, padded by ``depth``; asked: where the suffixes start that must be in the result, all
    if None. Of the others only those are sorted that asked ones are induced from: after a run of asked places these go
    on to the next suffix that is smaller than its successor.
    """
    import numpy as np

    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # ends of runs of one symbol
    nxt = np.searchsorted(change, np.arange(n))
    after = np.where(nxt < len(change), t[np.minimum(change[np.minimum(nxt, max(0, len(change) - 1))] + 1, n - 1)] if len(change) else 0, -1)
    small = (t < after) | (t == 0)  # smaller than its successor
    own = np.flatnonzero(small)
    if asked is not None:
        after_run = np.flatnonzero(asked[:-1] & ~asked[1:]) + 1
        needed = asked.copy()
        needed[own[np.searchsorted(own, after_run)]] = True  # there is one: the end of the string
        own = own[needed[own]]
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), depth)
    order = np.argsort(np.ascontiguousarray(view[own]).view(f"S{depth}").ravel(), kind="stable")
    direct = own[order]
    direct = direct[np.argsort(t[direct], kind="stable")]  # ends of strings first, whatever byte stands for them
    cut = np.searchsorted(t[direct], np.arange(258))
    induced: list[list] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        large = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        front = large
        while len(front):  # suffixes of a run of this symbol, induced from one another
            p = front[front > 0] - 1
            front = p[(t[p] == c) & ~small[p]]
            if len(front):
                large = np.concatenate([large, front])
        bucket = np.concatenate([large, direct[cut[c] : cut[c + 1]]])
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[(t[p] > c) & ~small[p]]
        if len(p):
            p = p[np.argsort(t[p], kind="stable")]
            to, at = np.unique(t[p], return_index=True)
            for x, part in zip(to, np.split(p, at[1:])):
                induced[x].append(part)
    return np.concatenate(out)


def common_prefixes(sa, raw: bytes, most: int = LENGTH):
    """Of neighbours in ``sa``: the length of their common prefix in whole words of 8 bytes, up to ``most``."""
    import numpy as np

    words = np.lib.stride_tricks.as_strided(np.frombuffer(raw, np.uint8)[:8].view(np.uint64), (len(raw) - 7,), (1,))
    out, alive = np.zeros(max(0, len(sa) - 1), np.int64), np.arange(max(0, len(sa) - 1))
    for k in range(0, most, 8):
        alive = alive[words[sa[alive] + k] == words[sa[alive + 1] + k]]
        out[alive] += 8
    return out


def repeated(strings: list[bytes], length: int = LENGTH) -> list:
    """For each string, the starts of its substrings of ``length`` bytes that occur again among all strings."""
    import numpy as np

    raw = b"\0".join(strings) + bytes(length + 8)
    n = sum(map(len, strings)) + len(strings)
    t = np.frombuffer(raw, np.uint8)[:n].astype(np.int64) + 1
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    t[ends] = 0
    whole = np.zeros(n, bool)
    firsts = ends - [len(s) for s in strings]
    for a, b in zip(firsts, ends):
        whole[a : max(a, b - length + 1)] = True
    sa = sort_suffixes(t, raw, length, whole)
    sa = sa[whole[sa]]
    same = common_prefixes(sa, raw, length - length % 8) >= length - length % 8
    if length % 8 and len(sa):
        view = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(same)
        tail = np.arange(length - length % 8, length)
        same[at] = (view[sa[at][:, None] + tail] == view[sa[at + 1][:, None] + tail]).all(axis=1)
    hit = np.zeros(n, bool)
    hit[sa[:-1][same]] = True
    hit[sa[1:][same]] = True
    return [np.flatnonzero(hit[a:b]) for a, b in zip(firsts, ends)]


def _spans(starts, length: int = LENGTH) -> bytes:
    """Maximal runs (start, end) covered by substrings at sorted starts, as 32-bit pairs."""
    import numpy as np

    cut = np.flatnonzero(np.diff(starts) > length)
    a = starts[np.concatenate([[0], cut + 1])]
    b = starts[np.concatenate([cut, [len(starts) - 1]])] + length
    return np.stack([a, b], axis=1).astype("<i4").tobytes()


_FOUND = "anchor long, u long, check long, spans binary"


def _found(rows: list):
    """A batch of (anchor, u, check, spans); check is a hash of the region's bytes."""
    import pyarrow as pa

    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "u", "check", "spans"])


def _check(content: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(content) - (1 << 63)


def _sorted_groups(batches):
    """Rows sorted by key: the repeated strings of each region, as spans; null if that is all of it."""
    held, size, key = [], 0, None

    def out():
        strings = [h[3] for h in held]
        starts = repeated(strings + [h[3] for h in held if h[2]])
        return _found([(a, u, _check(c), None if len(s) == len(c) - LENGTH + 1 else _spans(s)) for (a, u, _, c), s in zip(held, starts) if len(s)])

    for b in batches:
        for k, *row in zip(*(b.column(c).to_pylist() for c in ("key", "anchor", "u", "twice", "content"))):
            if k != key and size >= SORT_BYTES:
                yield out()
                held, size = [], 0
            key = k
            held.append(row)
            size += len(row[3])
    if held:
        yield out()


def _single_strings(batches):
    """Rows of buckets that hold one string, ``l`` bytes before the anchor: that string of each region."""
    import numpy as np

    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("anchor", "u", "at", "l", "content")))
        yield _found([(a, u, _check(c), _spans(np.array([at - l]))) for a, u, at, l, c in rows])


def _split(rows: DataFrame) -> DataFrame:
    """Rows (l, r, at, content, ...), whose strings have ``l`` bytes at least before the anchor and ``r`` after it, in the buckets of either half."""
    free = LENGTH - GRAM
    middle = F.col("l") + ((free + 1 - F.col("l") - F.col("r")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("l"), F.col("r").alias("r")), F.struct(F.col("l").alias("l"), (free + 1 - middle).alias("r")))
    after = F.octet_length("content") - GRAM - F.col("at")
    out = rows.withColumn("half", F.explode(F.when(F.col("l") + F.col("r") < free, halves).otherwise(F.array(F.struct("l", "r")))))
    out = out.withColumns({"l": F.col("half.l"), "r": F.col("half.r")}).drop("half").filter((F.col("at") >= F.col("l")) & (after >= F.col("r")))
    around = F.substring("content", F.col("at") - F.col("l") + 1, F.col("l") + GRAM + F.col("r"))
    return out.withColumn("key", F.md5(F.concat(around, F.concat_ws(",", "l", "r").cast("binary"))))


def _sorted(rows: DataFrame, parts: int) -> DataFrame:
    return rows.select("key", "anchor", "u", "twice", "content").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(sliced(_sorted_groups), _FOUND)


def _split_groups(scratch: Scratch, content: DataFrame, parts: int, group: int) -> DataFrame:
    """What ``_sorted_groups`` finds in the regions of anchors that have more than ``group`` of them, bucket by bucket."""
    rows, found = content.withColumns({"l": F.lit(0), "r": F.lit(0)}), None
    while True:
        rows = scratch.put(_split(rows))
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("again")).filter("k > 1 OR again")
        met = scratch.put(rows.join(sizes.select("key", "k"), "key"))
        single = (F.col("k") > group) & (F.col("l") + F.col("r") == LENGTH - GRAM)
        part = scratch.put(_sorted(met.filter(F.col("k") <= group), parts).unionByName(met.filter(single).mapInArrow(sliced(_single_strings), _FOUND)))
        found = part if found is None else found.unionByName(part)
        left = met.filter((F.col("k") > group) & ~single).drop("k", "key")
        if left.isEmpty():
            return found
        rows = left


def _cut_out(batches):
    """Each document with the runs to remove and what is left: (doc_id, n_bytes, starts, ends, kept)."""
    import numpy as np
    import pyarrow as pa

    from plexgraph.llm.common import utf8

    for b in batches:
        texts = utf8(b.column("text"))
        of, (u, check, spans) = _listed(b.column("found"), "u", "check", "spans")
        some = np.zeros(len(texts), bool)
        some[of] = True
        r = Regions([t if s else b"" for t, s in zip(texts, some)])
        key, asked = r.key(), _keys(u.to_numpy().view(np.uint64), of)
        order = np.argsort(key, kind="stable")
        left, right = np.searchsorted(key[order], asked), np.searchsorted(key[order], asked, side="right")
        size = right - left
        at = np.repeat(np.arange(len(asked)), size)  # what was found, for each region it holds for
        j = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left, size)]
        whole, checks = spans.is_null().to_numpy(zero_copy_only=False), check.to_numpy()
        cuts: list[list] = [[] for _ in texts]
        for i, k, s, e in zip(at.tolist(), of[at].tolist(), r.start[j].tolist(), r.end[j].tolist()):
            if _check(texts[k][s:e]) == checks[i]:
                cuts[k] += [(s, e)] if whole[i] else [(s + x, s + y) for x, y in np.frombuffer(spans[i].as_py(), "<i4").reshape(-1, 2).tolist()]
        starts, ends, kept = [], [], []
        for t, own in zip(texts, cuts):
            runs: list[list[int]] = []
            for s, e in sorted(own):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            starts.append([s for s, _ in runs])
            ends.append([e for _, e in runs])
            kept.append(b"".join(t[x:y] for x, y in zip([0, *ends[-1]], [*starts[-1], len(t)])) if runs else t)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(starts, kind), pa.array(ends, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "ends", "kept"])


def remove_repeats(docs: DataFrame, group: int = GROUP, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): the maximal runs of bytes to remove from each document, and the bytes left.

    digest: instead (doc_id, n_bytes, n_removed, n_spans, kept_sha256).
    """
    spark = docs.sparkSession
    scratch, n, name = Scratch(spark), parts_for(docs), f"plexgraph_{uuid.uuid4().hex}"
    slot = F.shiftright("row", 33).alias("slot")  # the number of the part that the row was in
    named = doc_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").select("*", slot)
    # so that what goes to a part's documents is dealt by their slot alone, and the texts stay
    with settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
        try:
            named.write.bucketBy(n, "slot").option("compression", "zstd").option("path", scratch.path()).saveAsTable(name)
            texts = spark.table(name)
            found = _repeats(scratch, texts, n, group)
            by_row = found.groupBy("row").agg(F.collect_list(F.struct("u", "check", "spans")).alias("found")).select("*", slot)
            full = texts.join(by_row.hint("shuffle_hash"), ["slot", "row"], "left").select("doc_id", "text", "found")
            if digest:
                return stored(full.mapInArrow(sliced(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
            return stored(full.mapInArrow(sliced(_cut_out), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            scratch.drop()


def _repeats(scratch: Scratch, texts: DataFrame, n: int, group: int) -> DataFrame:
    """(row, u, check, spans): what is repeated of the regions of each row."""
    pairs = scratch.put(texts.select("row", "text").mapInArrow(sliced(_pairs), "anchor long, u long, row long, n int"))
    again = pairs.groupBy("anchor").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("anchor")
    some = scratch.put(pairs.join(again, "anchor"))
    scratch.drop(pairs)
    by_u = scratch.put(some.groupBy("anchor", "u").agg((F.sum("n") > 1).alias("twice"), F.min("row").alias("row")))
    hot = scratch.put(by_u.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > group).select("anchor"))

    def content(regions: DataFrame) -> DataFrame:
        asked = regions.groupBy("row").agg(F.collect_list(F.struct("u", "twice")).alias("asked")).select("*", F.shiftright("row", 33).alias("slot"))
        met = texts.join(asked.hint("shuffle_hash"), ["slot", "row"]).select("text", "asked")
        return met.mapInArrow(sliced(_texts_of), "anchor long, u long, twice boolean, at int, content binary")

    if hot.isEmpty():
        found = _sorted(content(by_u).withColumn("key", F.col("anchor")), n)
    else:
        calm = content(by_u.join(hot, "anchor", "left_anti")).withColumn("key", F.col("anchor"))
        split = _split_groups(scratch, scratch.put(content(by_u.join(hot, "anchor"))), n, group)
        found = _sorted(calm, n).unionByName(split)
    found = scratch.put(found)
    return scratch.put(some.select("anchor", "u", "row").join(found, ["anchor", "u"]).select("row", "u", "check", "spans"))


def _digest(batches):
    """The same with the kept bytes hashed where they are made."""
    import pyarrow as pa

    for b in _cut_out(batches):
        starts, ends = b.column("starts").to_pylist(), b.column("ends").to_pylist()
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column("kept")]
        removed = [sum(e) - sum(s) for s, e in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array([len(s) for s in starts], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op7_suffix_array": op7_suffix_array}
ORACLE: dict[str, str] = {}
