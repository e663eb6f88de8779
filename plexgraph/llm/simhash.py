"""Op 8. SimHash near-dedup by pigeonhole blocks.

Fingerprints of 64 bits come from the XXH64 hashes of the word shingles of a
text. Pairs that differ in at most ``max_bits`` bits are found by splitting the
fingerprint into ``max_bits + 2`` blocks: such a pair agrees on at least two of
them, so it meets on one of the keys made of two blocks, and is then verified by
its Hamming distance. Equal fingerprints collapse before any join.

A key under which more than ``bucket`` different fingerprints meet is split
again by the same rule over its remaining bits, until at most 8 bits remain,
where at most 256 different fingerprints can exist: buckets stay bounded without
losing a pair. Within a bucket only the edges of a spanning forest of the links
are emitted, never all pairs. Components come from alternating star contraction
over those edges, written to the shared folder each round.

``similar_documents`` asks for a similarity of texts instead, of 0.8 by words of
five. That is some 15 % of a fingerprint's bits, more than blocks can promise to
leave one alike; so its fingerprints are longer, and have as many blocks as let
such pairs share one with a chance of ``RECALL``.

Nulls: a null text has no words, so fingerprint 0, like an empty one. A null
doc_id keeps its row, gets the component of its fingerprint, and is never chosen
as a component's id unless no other is there. Repeated rows stay. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import doc_text, packed, sliced, stored, table, unpacked

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 1024
#: Of near-duplicates by similarity: words of a shingle, the least similarity, and the least share of pairs of that similarity that meet.
WORDS = 5
SIMILARITY = 0.8
RECALL = 0.95
#: Ids of a key that are compared as pairs, by sketches first; the standard deviations above the mean by which the sketches of a pair at the bound may differ.
FEW = 8
SKETCH = 6.0


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one UTF-8 text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    else:
        grams = [b" ".join(words)]
    h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        part = h[k : k + 8192]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and fp, the fingerprint of ``text`` as a signed long: one row per document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from plexgraph.llm.common import utf8

        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in utf8(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(sliced(run), f"{schema}, fp long")


def _blocks(free: int, n: int) -> list[int]:
    """Masks of ``n`` near-equal blocks over the set bits of ``free``."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [round(len(bits) * k / n) for k in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint under each mask: (mask, key, fp)."""
    pairs = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks])
    return fps.withColumn("m", F.explode(pairs)).select("m.mask", "m.key", "fp")


def _forest(max_bits: int):
    """For a bucket's fingerprints: the edges of a spanning forest of its links."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ones = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
        for b in batches:
            src, dst = [], []
            for fps in b.column("fps"):
                v = np.unique(np.array(fps.as_py(), np.int64)).view(np.uint64)
                todo = np.arange(len(v))
                while len(todo):  # breadth first over the links, one row of distances at a time
                    root, queue, todo = todo[0], [todo[0]], todo[1:]
                    while queue and len(todo):
                        x = v[todo] ^ v[queue.pop()]
                        near = sum(ones[(x >> np.uint64(s)).astype(np.uint16)] for s in (0, 16, 32, 48)) <= max_bits
                        queue += (found := todo[near].tolist())
                        src += [v[root]] * len(found)
                        dst += v[found].tolist()
                        todo = todo[~near]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)) for a in (src, dst)], ["a", "b"])

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints whose closure is that of all links of at most ``max_bits`` bits.

    fps: distinct fingerprints in ``fp``.
    """
    full, n = (1 << 64) - 1, max_bits + 2
    level = sorted({a | b for a, b in combinations(_blocks(full, n), 2)})
    keyed, edges = _keys(fps, level), None
    while True:
        last = all(bin(full & ~m).count("1") <= 8 for m in level)
        met = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = keyed.join(met, ["mask", "key"])
        small = rows if last else rows.filter(F.col("n") <= bucket)
        found = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_forest(max_bits), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if last:
            return edges
        hot, deeper = rows.filter(F.col("n") > bucket).select("mask", "fp"), {}
        for m in level:
            deeper[m] = sorted({m | a | b for a, b in combinations(_blocks(full & ~m, n), 2)})
        level = sorted({x for v in deeper.values() for x in v})
        to = F.create_map(*[c for m, v in deeper.items() for c in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in v]))])
        hot = hot.select("fp", F.explode(to[F.col("mask")]).alias("mask")).distinct()
        keyed = hot.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex that has an edge.

    Alternating large-star and small-star contraction; each round is written to
    the shared folder, and the number of rounds grows with the logarithm of the
    longest chain.
    """
    sym = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, seen = stored(sym), None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        cur = stored(small)
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return cur.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET, keep: tuple = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep`` (with doc_id), fp (signed long), root (one for each group), component_id (smallest doc_id reachable over links)."""
    marks = stored(fingerprints(docs, shingle, seed, keep))
    per_fp = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(per_fp.select("fp"), max_bits, bucket))
    rooted = per_fp.join(comp.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp").select(*keep, "fp", "root", "component_id")


# Near-duplicates by similarity: longer fingerprints, of which a block is shared often enough.


def block_plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits of a block, blocks, most bits that differ) for n different fingerprints.

    Sets of Jaccard similarity s have a cosine of at least 2 s / (1 + s), so each bit
    differs with a chance of at most p = acos(cosine) / pi. A block has log2(n) bits,
    so that unlike fingerprints seldom share one, and there are as many blocks as let
    pairs at the bound share one with a chance of ``recall``. Two standard deviations
    above the mean are allowed to differ.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(32, max(16, math.ceil(math.log2(max(n, 2)))))
    blocks = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** bits))
    total = bits * blocks
    return bits, blocks, math.ceil(total * p + 2 * math.sqrt(total * p * (1 - p)))


def _shingle_sets(texts: list[bytes], shingle: int):
    """For each text, the different keys of its shingles; a text of fewer words is one shingle, none is the empty one."""
    import numpy as np

    from plexgraph.llm.words import Words, chunks, mixed

    for _, some in chunks(texts):
        w = Words(some)
        run = w.key
        for _ in range(shingle - 1):
            run = mixed(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.key[len(w.key) - len(run) + 1 :]) if len(run) else run
        for i, j in zip(w.cut, w.cut[1:]):
            if j - i >= shingle:
                yield np.unique(run[i : j - shingle + 1])
            else:
                h = np.uint64(j - i)
                for x in w.key[i:j]:
                    h = mixed(np.array([h ^ x]))[0]
                yield np.array([h], np.uint64)


def _long_fingerprint(h, words: int):
    """``words`` x 64 bits of a set of shingle keys: each the majority of a bit of their hashes."""
    import numpy as np

    from plexgraph.llm.words import mixed

    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    votes = np.zeros(64 * words, np.int64)
    for k in range(0, len(h), 4080):
        part = mixed(h[k : k + 4080, None] ^ salt[None, :])
        for at in range(0, len(part), 255):  # so that the votes fit into bytes
            bits = np.unpackbits(np.ascontiguousarray(part[at : at + 255]).view(np.uint8), axis=1)
            votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(h))


def long_fingerprints(docs: DataFrame, words: int, shingle: int = WORDS, keep: tuple = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and fp, ``words`` x 8 bytes for the set of word shingles of ``text``: one row per document."""

    def run(batches):
        import pyarrow as pa

        from plexgraph.llm.common import utf8

        for b in batches:
            fps = [_long_fingerprint(h, words).tobytes() for h in _shingle_sets(utf8(b.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fps, pa.binary())], [*keep, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(sliced(run), f"{schema}, fp binary")


def _blocks_of(bits: int, blocks: int):
    """(block and its bits in one number, id, sketch) of each fingerprint: its blocks, and its last 64 bits to tell unlike ones apart."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            if not len(fps):
                continue
            flat = np.unpackbits(fps, axis=1)[:, : bits * blocks].reshape(len(fps), blocks, bits)
            key = (flat.astype(np.int64) << np.arange(bits)).sum(axis=2) | np.arange(blocks) << 32
            sketch = np.ascontiguousarray(fps[:, -8:]).view(np.int64).ravel()
            cols = [key.ravel(), np.repeat(b.column("id").to_numpy(), blocks), np.repeat(sketch, blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id", "sketch"])

    return run


def _met_pairs(most: int):
    """For the (id, sketch) of a key that few ids share: the pairs whose sketches differ by ``most`` bits at most."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            met = b.column("met")
            size = met.value_lengths().to_numpy()
            ids, v = (met.flatten().field(c).to_numpy() for c in ("id", "sketch"))
            v, of = v.view(np.uint64), np.repeat(np.arange(len(size)), size)
            src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for step in range(1, int(size.max(initial=0))):
                i = np.flatnonzero(of[:-step] == of[step:])
                i = i[np.bitwise_count(v[i] ^ v[i + step]) <= most]
                src.append(ids[i])
                dst.append(ids[i + step])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], ["a", "b"])

    return run


def _whole(fps, total: int):
    """Fingerprints (Arrow binary) as rows of 64-bit words, of which ``total`` bits count."""
    import numpy as np

    rows = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1)[:, : total // 8]
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view(np.uint64)


def _close(most: int, total: int):
    """For a bucket's (id, fp): the edges of a spanning forest of all its pairs that differ in ``most`` of ``total`` bits at most."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(b.num_rows):
                met = b.column("met").slice(k, 1).flatten()
                ids, v = met.field("id").to_numpy(), _whole(met.field("fp"), total)
                todo = np.arange(len(ids))
                while len(todo):
                    queue, todo = [todo[0]], todo[1:]
                    while queue and len(todo):
                        at = queue.pop()
                        close = np.bitwise_count(v[todo] ^ v[at]).sum(axis=1, dtype=np.int64) <= most
                        found = todo[close]
                        queue += found.tolist()
                        src.append(np.full(len(found), ids[at]))
                        dst.append(ids[found])
                        todo = todo[~close]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], ["a", "b"])

    return run


def _across(most: int, total: int):
    """For two chunks ``one`` and ``two`` of a key's (id, root, fp): (id, root) for each id of the first and each other root that it is close to in the second."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(b.num_rows):
                one, two = (b.column(c).slice(k, 1).flatten() for c in ("one", "two"))
                v, w = _whole(one.field("fp"), total), _whole(two.field("fp"), total)
                root = two.field("root").to_numpy()
                for x, at, own in zip(one.field("id").to_numpy(), v, one.field("root").to_numpy()):
                    near = np.unique(root[np.bitwise_count(w ^ at).sum(axis=1, dtype=np.int64) <= most])
                    near = near[near != own]
                    src.append(np.full(len(near), x))
                    dst.append(near)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], ["a", "b"])

    return run


def _bucketed(rows: DataFrame, fps: DataFrame, most: int, total: int) -> DataFrame:
    """Edges (a, b) of a spanning forest for each key of rows (key, id)."""
    met = rows.select("key", "id").join(fps, "id").groupBy("key").agg(F.collect_list(F.struct("id", "fp")).alias("met"))
    return met.select("met").mapInArrow(sliced(_close(most, total)), "a long, b long")


def _hot(hot: DataFrame, edges: DataFrame, fps: DataFrame, most: int, total: int, bucket: int) -> DataFrame:
    """Edges that ``edges`` and the keys of more than ``bucket`` ids (key, id, sketch) give: the closure is that of all close pairs.

    First the ids of a key are compared where 16 bits of their sketches are alike, each quarter in turn, then where two are:
    that links nearly all. Then, of each key, the ids outside its largest component are compared with all of the key.
    """
    quarter = lambda q: F.shiftright("sketch", 16 * q).bitwiseAND(F.lit(0xFFFF))
    part = hot
    for parts in ([(q,) for q in range(4)], list(combinations(range(4), 2)), [(0, 1, 2, 3)]):
        part = stored(part.select(F.explode(F.array(*[F.xxhash64("key", F.lit(k), *[quarter(q) for q in p]) for k, p in enumerate(parts)])).alias("key"), "id", "sketch"))
        n = part.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = part.join(n, "key")
        edges = edges.unionByName(_bucketed(rows.filter(F.col("n") <= bucket), fps, most, total))
        part = stored(rows.filter(F.col("n") > bucket).select("key", "id", "sketch"))
        if part.isEmpty():
            break
    edges = stored(edges)
    comp = components(edges).withColumnRenamed("v", "id")
    told = stored(hot.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    largest = told.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("most"))
    told = told.join(largest, "key").join(fps, "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("key")) / bucket)))
    chunks = lambda df, c: df.groupBy("key", "chunk").agg(F.collect_list(F.struct("id", "root", "fp")).alias(c))
    rest = chunks(told.filter("root <> most"), "one").drop("chunk")
    return edges.unionByName(rest.join(chunks(told, "two"), "key").select("one", "two").mapInArrow(sliced(_across(most, total)), "a long, b long"))


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WORDS, recall: float = RECALL, bucket: int = BUCKET, keep: tuple = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep`` and root, the same for documents that chains of pairs link, whose sets of word shingles are alike to ``similarity`` or more by their fingerprints."""
    texts = docs.agg(F.approx_count_distinct(F.xxhash64(F.col("text").cast("string")))).first()[0]
    bits, blocks, most = block_plan(texts, similarity, recall)
    marks = stored(long_fingerprints(docs, -(-bits * blocks // 64) + 1, shingle, keep).withColumn("id", F.xxhash64("fp")))
    fps = stored(marks.groupBy("id").agg(F.first("fp").alias("fp")))
    keyed = stored(fps.select("id", "fp").mapInArrow(sliced(_blocks_of(bits, blocks)), "key long, id long, sketch long"))
    p, total = math.acos(2 * similarity / (1 + similarity)) / math.pi, bits * blocks
    unlike = math.ceil(64 * p + SKETCH * math.sqrt(64 * p * (1 - p)))
    few = min(FEW, bucket)
    met = keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")
    pairs = met.filter(F.col("n") <= few).groupBy("key").agg(F.collect_list(F.struct("id", "sketch")).alias("met")).select("met").mapInArrow(sliced(_met_pairs(unlike), 20_000), "a long, b long")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = stored(met.filter(F.col("n") > few))
    one, other = (fps.select(F.col("id").alias(c), F.col("fp").alias(f"fp_{c}")) for c in "ab")

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x, y = (_whole(b.column(c), total) if b.num_rows else np.empty((0, 1), np.uint64) for c in ("fp_a", "fp_b"))
            yield b.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most))

    edges = pairs.join(one, "a").join(other, "b").select("a", "b", "fp_a", "fp_b").mapInArrow(sliced(verify), "a long, b long")
    edges = edges.unionByName(_bucketed(more.filter(F.col("n") <= bucket), fps, most, total))
    hot = more.filter(F.col("n") > bucket).select("key", "id", "sketch")
    comp = components(stored(edges if hot.isEmpty() else _hot(hot, edges, fps, most, total, bucket)))
    return marks.drop("fp").join(comp, marks["id"] == comp["v"], "left").select(*keep, F.coalesce("root", "id").alias("root"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The document with the smallest doc_id of each group of ``similar_documents``, with its own columns; of repeated rows one."""
    told = packed(docs, "doc_id", "text").withColumns({"_h": F.xxhash64(F.col("text").cast("string")), "_d": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    groups = similar_documents(told, keep=("doc_id", "_h", "_d"), **how)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_h", "_d")).alias("m")).select("m._d", "m._h")
    kept = told.join(first, ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"])  # dealt out once for both
    return unpacked(kept, docs.columns, "doc_id", "text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(doc_text(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE: dict[str, str] = {}
