"""Op 5. Token-ID output by an adaptive context-mixing range coder.

A file is a sequence of independently reset blocks; a block holds whole
documents, ``BLOCK`` ids or a little more. Layout, little-endian: magic ``PXT1``,
u32 documents, u32 ids, u32 lanes, u32 crc32 of the ids, u32 words; then the
doc_ids as i64 with a byte each for null, the lengths as u32, the words each
lane wrote as u32, the words (u32) of all lanes, and the u32 crc32 of all bytes
before it.

An id is predicted at three orders. The tables of order 2 and order 1 remember
the id that last followed the two ids before, or the one before, with a count of
how often it held; the shares of the code space those two predictions get are
learned for every pair of such counts from what came true so far. Order 0 has the
adaptive frequencies of all ids. The mixed prediction gives an id its interval in
a carryless range coder of 64 bits. A block is cut into lanes that advance
together, id by id, over one shared model, so that each step is one set of numpy
operations over all lanes, in the coder and the decoder alike.

Nulls: a null text is empty and has only its end id; a null doc_id sorts first.
Repeated documents keep their rows, in the order of a hash of their texts. Empty
tables give an empty file. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm.common import doc_text, parts_for, shared_dir, sliced, table
from plexgraph.llm.tokens import tokenizer_path

MAGIC = b"PXT1"
END = 2
BLOCK = 1 << 20
LANE_STEPS = 512
VOCABULARY = 1 << 16
SLOTS = 1 << 16
TOKENIZER = "word_bpe_49k.json"

_TOTAL_BITS = 16
_TOTAL = 1 << _TOTAL_BITS
_CONF = 8
_MOST = 1 << 27


class _Model:
    """What coder and decoder share: predictions from, and updates by, the ids of all lanes at a step.

    A table's entry is an id and, in its low 3 bits, the count of how often it held.
    """

    def __init__(self, lanes: int, vocabulary: int):
        import numpy as np

        self.np = np
        self.t1, self.t2 = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.a, self.b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # the id before the last, the last
        self.hits = np.ones((_CONF * _CONF, 3))  # by the two counts: order 2 held, order 1 held, neither
        self.hits[:, 2] = 2
        self.counts = np.ones(vocabulary, np.int64)
        self.step, self.next_fresh, self.pending, self.kinds = 0, 1, [], []
        self.fresh()

    def fresh(self) -> None:
        """Adds what came since the last time to order 0 and to the shares; cumulative frequencies."""
        np = self.np
        if self.pending:
            self.counts += 24 * np.bincount(np.concatenate(self.pending), minlength=len(self.counts))
            self.hits += np.bincount(np.concatenate(self.kinds), minlength=self.hits.size).reshape(self.hits.shape)
            self.pending, self.kinds = [], []
        while self.counts.sum() > _MOST:  # so that a single count keeps some of the smallest range
            self.counts = (self.counts + 1) >> 1
        self.cum = np.concatenate([[0], np.cumsum(self.counts)])
        self.low0, self.size0, self.total0 = self.cum[:-1].astype(np.uint64), self.counts.astype(np.uint64), np.uint64(self.cum[-1])
        f = self.hits / self.hits.sum(axis=1, keepdims=True) * (_TOTAL - _TOTAL // 16 - 64) + 16  # order 0 keeps a sixteenth at least
        self.f2, self.f1 = f[:, 0].astype(np.uint64), f[:, 1].astype(np.uint64)

    def predict(self, r):
        """(id of order 2, id of order 1, end of order 2's part of the code space, end of order 1's), r being the size of a share."""
        np = self.np
        self.s1 = (self.b * 40503 >> 3) & (SLOTS - 1)
        self.s2 = (self.a * 62089911 + self.b * 2654435761 >> 11) & (SLOTS - 1)
        self.e1, self.e2 = self.t1[self.s1], self.t2[self.s2]
        self.k1, self.k2 = self.e1 & 7, self.e2 & 7
        g1, g2 = self.e1 >> 3, self.e2 >> 3
        self.mix = self.k2 * _CONF + self.k1
        b2 = r * self.f2[self.mix]
        return g2, g1, b2, b2 + r * self.f1[self.mix] * (g1 != g2)

    def update(self, ids, live, h2, h1) -> None:
        """h2, h1: does the prediction of order 2, of order 1 hold?"""
        np = self.np
        self.kinds.append((self.mix * 3 + np.where(h2, 0, 2 - h1))[live])
        self.pending.append(ids[live])
        new = (ids << 3).astype(np.int32)
        for table, slot, e, k, h in ((self.t2, self.s2, self.e2, self.k2, h2), (self.t1, self.s1, self.e1, self.k1, h1)):
            half = k >> 1
            table[slot] = np.where(h, e + (k < _CONF - 1), np.where(k > 1, e - k, new) + half)
        self.a, self.b = self.b, ids
        self.step += 1
        if self.step >= self.next_fresh:
            self.fresh()
            self.next_fresh = self.step + min(32, max(1, self.step // 2))


def _shifted(low, rng, who):
    """Drops the upper 32 bits of the lanes whose range has become small; a range across a boundary is cut there, so no carry can follow. Their upper bits."""
    import numpy as np

    u = np.uint64
    x, r = low[who], rng[who]
    across = (x ^ (x + (r - u(1)))) >> u(32) != 0
    r = np.where(across, (~x + u(1)) & u((1 << 32) - 1), r)
    low[who], rng[who] = x << u(32), r << u(32)
    return x >> u(32)


def _lanes(n: int) -> int:
    return max(1, -(-n // LANE_STEPS))


def encode_ids(ids, vocabulary: int = VOCABULARY):
    """ids (numpy) -> (lanes, words of each lane, all words of 32 bits)."""
    import numpy as np

    n = len(ids)
    if not n:
        return 1, np.zeros(1, np.int64), np.zeros(0, np.uint32)
    lanes = _lanes(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    full = (n - np.arange(lanes) * steps).clip(0, steps)  # ids of each lane
    m = _Model(lanes, vocabulary)
    u = np.uint64
    low, rng = np.zeros(lanes, u), np.full(lanes, (1 << 64) - 1, u)
    out_lane, out_word = [], []
    for t in range(steps):
        x = grid[t]
        every = t < full[-1]  # the last lane is the shortest
        live = slice(None) if every else full > t
        g2, g1, b2, b1 = m.predict(rng >> u(_TOTAL_BITS))
        h2, h1 = x == g2, x == g1
        add, size = np.where(h2, u(0), b2), np.where(h2, b2, b1 - b2)
        rest = np.flatnonzero(~(h2 | h1))
        x0, b0 = x[rest], b1[rest]
        q = (rng[rest] - b0) // m.total0
        add[rest], size[rest] = b0 + q * m.low0[x0], q * m.size0[x0]
        if every:
            low += add
            rng = size
        else:
            low[live] += add[live]
            rng[live] = size[live]
        m.update(x, live, h2, h1)
        who = np.flatnonzero(rng < u(1 << 32))
        if len(who):
            out_lane.append(who)
            out_word.append(_shifted(low, rng, who))
    for part in (low >> u(32), low & u((1 << 32) - 1)):
        out_lane.append(np.arange(lanes))
        out_word.append(part)
    lane, word = np.concatenate(out_lane), np.concatenate(out_word).astype(np.uint32)
    return lanes, np.bincount(lane, minlength=lanes), word[np.argsort(lane, kind="stable")]


def decode_ids(n: int, lanes: int, sizes, words, vocabulary: int = VOCABULARY):
    """The inverse of encode_ids."""
    import numpy as np

    if not n:
        return np.zeros(0, np.int64)
    u = np.uint64
    steps = -(-n // lanes)
    full = (n - np.arange(lanes) * steps).clip(0, steps)
    grid = np.zeros((steps, lanes), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    words = np.concatenate([words, np.zeros(2, words.dtype)]).astype(u)
    code = words[at] << u(32) | words[at + 1]
    at += 2
    low, rng = np.zeros(lanes, u), np.full(lanes, (1 << 64) - 1, u)
    m = _Model(lanes, vocabulary)
    for t in range(steps):
        every = t < full[-1]
        live = slice(None) if every else full > t
        g2, g1, b2, b1 = m.predict(rng >> u(_TOTAL_BITS))
        off = code - low
        h2 = off < b2
        x = np.where(h2, g2, g1).astype(np.int64)
        add, size = np.where(h2, u(0), b2), np.where(h2, b2, b1 - b2)
        rest = np.flatnonzero(off >= b1)
        b0 = b1[rest]
        q = (rng[rest] - b0) // m.total0
        aim = ((off[rest] - b0) // np.maximum(q, u(1))).astype(np.int64)
        x0 = np.searchsorted(m.cum, np.minimum(aim, m.cum[-1] - 1), side="right") - 1
        x[rest], add[rest], size[rest] = x0, b0 + q * m.low0[x0], q * m.size0[x0]
        if not every:
            x[~live] = 0
        if every:
            low += add
            rng = size
        else:
            low[live] += add[live]
            rng[live] = size[live]
        grid[t] = x
        m.update(x, live, x == g2, x == g1)
        who = np.flatnonzero(rng < u(1 << 32))
        if len(who):
            _shifted(low, rng, who)
            code[who] = code[who] << u(32) | words[np.minimum(at[who], len(words) - 1)]
            at[who] += 1
    return grid.T.ravel()[:n]


def write_block(doc_ids: list, ids: list[bytes]) -> bytes:
    """One block from documents' doc_ids and their 16-bit ids."""
    import numpy as np

    flat = b"".join(ids)
    x = np.frombuffer(flat, "<u2").astype(np.int64)
    lanes, sizes, words = encode_ids(x)
    head = struct.pack("<4s5I", MAGIC, len(doc_ids), len(x), lanes, zlib.crc32(flat), len(words))
    null = bytes(d is None for d in doc_ids)
    parts = [head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null, np.array([len(b) // 2 for b in ids], "<u4").tobytes(), sizes.astype("<u4").tobytes(), words.astype("<u4").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list, list[int], bytes]:
    """(doc_ids, lengths, all ids as 16-bit words); raises if the block is damaged."""
    import numpy as np

    if block[:4] != MAGIC or len(block) < 28:
        raise ValueError("not a block of token ids")
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("checksum of a block differs")
    _, docs, n, lanes, crc, n_words = struct.unpack_from("<4s5I", block)
    at = 24

    def take(kind: str, count: int):
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, sizes = take("<i8", docs), take("u1", docs), take("<u4", docs)
    per_lane, words = take("<u4", lanes), take("<u4", n_words)
    flat = decode_ids(n, lanes, per_lane, words).astype("<u2").tobytes()
    if zlib.crc32(flat) != crc:
        raise ValueError("checksum of a block's ids differs")
    return [None if z else int(d) for d, z in zip(doc_ids, null)], sizes.tolist(), flat


_SCHEMA = "part int, block long, before long, n_ids long, data binary"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK) -> None:
    """Encodes all documents in ascending doc_id order and writes the blocks: a table (part, block, before, n_ids, data).

    ``before`` counts the ids of the part before the block.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from plexgraph.llm.common import utf8
        from plexgraph.llm.tokens import encoder

        part, number, before, ids, of, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        enc, tail = encoder(tokenizer), end.to_bytes(2, "little")

        def row():
            return pa.RecordBatch.from_pydict({"part": [part], "block": [number], "before": [before], "n_ids": [size], "data": [write_block(of, ids)]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), enc.encode(utf8(b.column("text")), tail)):
                of.append(d)
                ids.append(x)
                size += len(x) // 2
                if size >= block:
                    yield row()
                    number, before, ids, of, size = number + 1, before + size, [], [], 0
        if of:
            yield row()

    ordered = docs.repartitionByRange(parts_for(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(sliced(run), _SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the blocks at a path; ids are 32-bit little-endian."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row for each written partition
    base, at = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        base[r.part], at = at, at + r.n
    starts = spark.createDataFrame(sorted(base.items()), "part int, base long") if base else spark.createDataFrame([], "part int, base long")
    placed = blocks.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.col("before"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data")):
                doc_ids, sizes, flat = read_block(data.as_py())
                ends = np.cumsum(sizes)
                wide = np.frombuffer(flat, "<u2").astype("<u4")
                first = ends - sizes
                for k in range(0, len(doc_ids), 500):
                    s = slice(k, k + 500)
                    ids = [wide[i:j].tobytes() for i, j in zip(first[s], ends[s])]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[s], pa.int64()), pa.array(start + first[s], pa.int64()), pa.array(sizes[s], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.select("start", "data").mapInArrow(sliced(run, 1), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    path = shared_dir(docs.sparkSession)
    write(doc_text(docs), path, tokenizer or tokenizer_path(TOKENIZER))
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op5_tokenfile": op5_tokenfile}
ORACLE: dict[str, str] = {}
