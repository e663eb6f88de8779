"""Op 9. Language-model scoring by a probabilistic suffix tree.

Tokens are the words of a text, with A-Z lower-cased, and one end. Counts of all
words are taken over all training documents. The root of the tree is the unigram
distribution (c + 1) / (N + V + 1). A node is a context of one or more words; it is
retained if the distribution of its next symbols diverges from that of its suffix:
their Kullback-Leibler divergence times the context's count must exceed half of
ln N for each free parameter. Its distribution lists the next symbols, of all words,
seen at least ``MIN_COUNT`` times after it, less an absolute discount, and shares
what is left out in proportion to the suffix's distribution, so that each node's
probabilities sum to 1. The tree grows level by level: only contexts whose suffix
was retained are tested, until none passes (or has ``DEPTH`` words). A token is
scored in the state of the longest retained suffix of what stands before it. Both
bounds are counts, so the tree grows with the corpus.

The tree is a table in the shared folder. A text's score is its root score and a
sum of one number for each run of tokens: as a context, its backoff factor, and as
a context with a listed symbol, by how much that differs from it and from the
suffix. So a text meets the tree in one join by key. Only the ``NODES`` entries met
most often are broadcast, with the ``HEAD`` most frequent words, some 20 bytes each;
what remains is joined and not frequent, so no key is hot. Bitmaps of a fixed
number of bits keep runs that cannot occur in a table out of the shuffles; what
they let pass wrongly finds nothing in the join. A run is looked up only if one of
its two parts may be in the tree, without which it can't be.

A word is known by a 64-bit hash, and a run of words by one of the keys of the run
without its last word and of the run without its first: with n of them a false
meeting has a chance of about n squared / 2 ** 65.

Nulls: a null text is empty and has only its end; a null doc_id is training.
Repeated rows count and are scored one by one. Without training documents N and V
are 0 and every token has probability 1. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm.common import Scratch, doc_text, parts_for, sliced, stored, table
from plexgraph.llm.words import Table, Words, chunks, mixed, unmixed

HEAD = 1_000_000
NODES = 2_000_000
BITS = 26
#: The same for what is left of the tree, which every run of every text is held against.
TREE_BITS = 28
DEPTH = 12
MIN_COUNT = 4
DISCOUNT = 0.5
#: Bytes of input (as stored, about) for each part of a shuffle of runs.
PART_BYTES = 16 << 20
#: Pieces of such a part, a power of two, that are handled one after the other.
PIECES = 8
#: Runs that a worker gathers before it asks for them.
ASKED = 250_000
#: Records that a worker sums before it emits them.
HELD = 1_500_000
#: The key of the end, which no word has by more than chance.
END = 0x5851F42D4C957F2D


class Runs:
    """Symbols of texts in a row, each text's end included: arrays ``key`` (of the runs of ``order`` symbols that start there), ``left`` (symbols from there to the text's end) and ``first`` (the first symbol of each text)."""

    def __init__(self, texts: list[bytes]):
        import numpy as np

        w = Words(texts)
        size = np.diff(w.cut) + 1
        self.end = np.cumsum(size)
        self.first = self.end - size
        self.key = np.full(self.end[-1] if len(size) else 0, END, np.uint64)
        word = np.ones(len(self.key), bool)
        word[self.end - 1] = False
        self.key[word] = w.key
        self.left = np.repeat(self.end, size) - np.arange(len(self.key))
        self.order = 1

    def longer(self) -> None:
        """On to runs of one symbol more; keys of runs over a text's end mean nothing."""
        self.key = run_key(self.key[:-1], self.key[1:])
        self.left = self.left[: len(self.key)]
        self.order += 1


def run_key(a, b):
    """The key of a run from those of the run without its last and without its first symbol."""
    import numpy as np

    return mixed((a + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + b)


def _start_of(key, b):
    """The key of a run without its last symbol, from its own and that of the run without its first."""
    import numpy as np

    return (unmixed(key) - b) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64)) - np.uint64(0x9E3779B97F4A7C15)


def _passes(bits, key):
    """Of keys: may they be among those that the bitmap was made of?"""
    import numpy as np

    n = (len(bits) * 64 - 1).bit_length()
    bit = lambda at: (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    out = bit(key >> np.uint64(64 - n))
    some = np.flatnonzero(out)
    out[some] = bit(key[some] & np.uint64((1 << n) - 1))
    return out


def _bitmap(keys: DataFrame, parts: int, n: int = BITS):
    """A broadcast of 2 ** n bits, set where the upper and where the lower n bits of a ``key`` say: of the same size whatever the table.

    Places go through the shuffle as 16-bit numbers within pieces of 2 ** 16 bits, and pieces come to the driver as bits.
    """
    import numpy as np

    def places(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def out():
            key = np.concatenate(held)
            place = np.sort(np.concatenate([key >> np.uint64(64 - n), key & np.uint64((1 << n) - 1)]).astype(np.uint32))
            cut = np.concatenate([[0], np.flatnonzero(place[1:] >> 16 != place[:-1] >> 16) + 1, [len(place)]])
            low = place.astype(np.uint16)
            return pa.RecordBatch.from_arrays([pa.array((place[cut[:-1]] >> 16).astype(np.int32)), pa.array([low[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["piece", "data"])

        for b in batches:
            held.append(b.column("key").to_numpy().view(np.uint64))
            size += len(held[-1])
            if size > HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def bits(batches):
        import numpy as np
        import pyarrow as pa

        found: dict = {}
        for b in batches:
            for piece, x in zip(b.column("piece").to_pylist(), b.column("data")):
                if piece not in found:
                    found[piece] = np.zeros(1 << 16, bool)
                found[piece][np.frombuffer(x.as_buffer(), np.uint16)] = True
        data = [np.packbits(x, bitorder="little").tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(data, pa.binary())], ["piece", "data"])

    kind, tasks = "piece int, data binary", min(parts, 1 << (n - 16))
    dealt = keys.select("key").mapInArrow(places, kind).repartitionById(tasks, F.col("piece") % tasks)
    found = dealt.mapInArrow(bits, kind).toArrow()
    out = np.zeros((1 << (n - 16), 1 << 10), np.uint64)
    for piece, x in zip(found.column("piece").to_pylist(), found.column("data")):
        out[piece] = np.frombuffer(x.as_buffer(), np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out.ravel())


def _dealt(key, cols: list, parts: int):
    """Batches (piece, data): of each of ``PIECES`` times ``parts`` equal ranges of keys its entries, the columns (64 bits each) one after the other in bytes.

    Keys come first, sorted, as differences whose bytes are in 8 rows: those of the upper ones are 0 and are compressed away.
    """
    import numpy as np
    import pyarrow as pa

    def keys(k):
        return np.ascontiguousarray(np.diff(k, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()

    order = None if (key[1:] >= key[:-1]).all() else np.argsort(key)
    for at in range(0, len(key), 1 << 17):
        x = slice(at, at + (1 << 17)) if order is None else order[at : at + (1 << 17)]
        own = key[x]
        piece = ((own >> np.uint64(32)) * np.uint64(parts * PIECES)) >> np.uint64(32)
        cut = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1, [len(piece)]])
        some = [c[x] for c in cols]
        data = [b"".join([keys(own[i:j]), *(c[i:j].tobytes() for c in some)]) for i, j in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(piece[cut[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["piece", "data"])


def _entries(data, width: int):
    """The key and the other columns of a piece's entries, as rows of unsigned numbers."""
    import numpy as np

    out = np.frombuffer(data, np.uint64).reshape(width, -1).copy()
    np.cumsum(np.ascontiguousarray(out[0].view(np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), out=out[0])
    return out


def _by_part(dealt: DataFrame, parts: int) -> DataFrame:
    return dealt.repartitionById(parts, F.shiftright("piece", PIECES.bit_length() - 1))


def _taken(batches, width: int):
    """The keys and columns, as unsigned numbers, of all entries of each piece that was dealt to this task."""
    import numpy as np

    held: dict[int, list] = {}
    for b in batches:
        for piece, x in zip(b.column("piece").to_pylist(), b.column("data")):
            held.setdefault(piece, []).append(x.as_buffer())
    while held:
        yield np.concatenate([_entries(x, width) for x in held.popitem()[1]], axis=1)


def _batches(names: list[str], cols: list, rows: int = 200_000):
    import pyarrow as pa

    for at in range(0, len(cols[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + rows]) for c in cols], names)


def _merged(key, cols: list, n):
    """Of arrays with keys that repeat: each key once, its columns and the sum of n."""
    import numpy as np

    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], [c[order[at]] for c in cols], np.add.reduceat(n[order], at)


def _summed(batches_of, parts: int):
    """Batches (piece, data) of the columns and a count, those of one worker summed; batches_of yields (key, columns)."""
    import numpy as np

    held, size = [], 0

    def merged():
        return _merged(np.concatenate([h[0] for h in held]), [np.concatenate(c) for c in zip(*(h[1] for h in held))], np.concatenate([h[2] for h in held]))

    for key, cols in batches_of:
        if not len(key):
            continue
        held.append((key, cols, np.ones(len(key), np.int64)))
        size += len(key)
        if size > HELD:
            held = [merged()]
            size = len(held[0][0])
            if size > HELD * 2 // 3:
                yield from _dealt(held[0][0], [*held[0][1], held[0][2]], parts)
                held, size = [], 0
    if held:
        key, cols, n = merged()
        yield from _dealt(key, [*cols, n], parts)


def _added(texts: DataFrame, run, parts: int, names: list[str], least: int = 1) -> DataFrame:
    """(key, *names, n): what ``run`` has summed in the workers, added up for each key; those of ``least`` or more.

    names: the parts of a run, which its key is made of; none for a symbol, which has its key alone. The entries go
    through the shuffle in bytes, one row for each worker's share of a part, and are added up in numpy.
    """

    def add(batches):
        import numpy as np

        for key, *cols, n in _taken(batches, 3 if names else 2):
            key, cols, n = _merged(key, cols, n.view(np.int64))
            some = np.flatnonzero(n >= least)
            cols = [key[some], *(c[some] for c in cols)]
            if names:
                cols.insert(1, _start_of(*cols))
            yield from _batches(["key", *names, "n"], [*(c.view(np.int64) for c in cols), n[some]])

    return _by_part(texts.mapInArrow(sliced(run), "piece int, data binary"), parts).mapInArrow(add, ", ".join(f"{c} long" for c in ("key", *names, "n")))


def symbol_counts(texts: DataFrame, parts: int) -> DataFrame:
    """(key, n) of all symbols over all rows of ``text``."""

    def run(batches):
        from plexgraph.llm.common import utf8

        def keys():
            for b in batches:
                for _, some in chunks(utf8(b.column("text"))):
                    key = Runs(some).key
                    yield key, []

        return _summed(keys(), parts)

    return _added(texts, run, parts, [])


def runs_of(texts: DataFrame, order: int, parts: int, shorter, grown=None) -> DataFrame:
    """(key, a, b, n): runs of ``order`` symbols that occur MIN_COUNT times or more, with the keys of their parts.

    shorter: a bitmap of the runs of one symbol less that do so, which both parts of such a run are among; grown: one of the contexts retained so far, which what is between the first and the last symbol is among.
    """

    def run(batches):
        from plexgraph.llm.common import utf8

        def keys():
            for b in batches:
                for _, some in chunks(utf8(b.column("text"))):
                    r, inner = Runs(some), None
                    while r.order < order - 1:
                        inner = r.key
                        r.longer()
                    if len(r.key) < 2:
                        continue
                    fine = _passes(shorter.value, r.key)
                    ok = fine[:-1] & fine[1:] & (r.left[: len(r.key) - 1] >= order)
                    if inner is not None:
                        ok &= _passes(grown.value, inner[1 : len(ok) + 1])
                    a, b_ = r.key[:-1][ok], r.key[1:][ok]
                    yield run_key(a, b_), [b_]

        return _summed(keys(), parts)

    return _added(texts, run, parts, ["a", "b"], MIN_COUNT)


def _nodes(rows: DataFrame, contexts: DataFrame, total: int) -> DataFrame:
    """(a, m, back): the contexts retained, their counts, and log10 of the factor their suffix's probabilities get.

    rows: (a, n, q): counts n of a next symbol, log10 q of its probability in the suffix; contexts: (key, n).
    """
    q, n = F.pow(F.lit(10.0), "q"), F.col("n")
    by = rows.groupBy("a").agg(F.sum("n").alias("s"), F.sum(n * (F.log(n) - F.col("q") * F.log(F.lit(10.0)))).alias("l"), F.sum(q).alias("q"), F.count(F.lit(1)).alias("k"))
    by = by.join(contexts.select(F.col("key").alias("a"), F.col("n").alias("m")), "a")
    m, k = F.col("m"), F.col("k")
    kl = F.col("l") / m - F.col("s") / m * F.log(m)
    rest_p, rest_q, left = F.greatest(1 - F.col("s") / m, F.lit(0.0)), F.greatest(1 - F.col("q"), F.lit(1e-12)), F.greatest(1 - (F.col("s") - DISCOUNT * k) / m, F.lit(1e-12))
    kl = kl + F.when(rest_p > 0, rest_p * F.log(rest_p / rest_q)).otherwise(0.0)
    return by.filter(kl * m > F.lit(0.5) * F.log(F.lit(float(max(total, 2)))) * k).select("a", "m", F.log10(left / rest_q).alias("back"))


def fit(scratch: Scratch, texts: DataFrame, counts: DataFrame, total: int, distinct: int, parts: int) -> tuple[DataFrame, int]:
    """(key, n, d): the tree. What a run adds to log10 of a text's probability at the root, and how often it occurs.

    counts: (key, n) of all symbols.
    """
    unit = float(total + distinct + 1)
    last = scratch.put(counts.filter(F.col("n") >= MIN_COUNT).select("key", "n", F.log10((F.col("n") + 1) / unit).alias("q")))
    grown, entries = None, []
    for words in range(1, DEPTH + 1):
        often = _bitmap(last, parts)
        runs = scratch.put(runs_of(texts, words + 1, parts, often, grown))
        for used in (often, grown):
            if used is not None:
                used.destroy()
        told = scratch.put(runs.join(last.select(F.col("key").alias("b"), "q"), "b").select("key", "a", "n", "q"))
        scratch.drop(runs)
        nodes = scratch.put(_nodes(told, last, total))
        if nodes.isEmpty():
            break
        p = F.log10((F.col("n") - DISCOUNT) / F.col("m"))
        state = told.join(nodes, "a", "left").select("key", "n", F.coalesce(p, "q").alias("q"), (p - F.col("q") - F.col("back")).alias("d"))
        scratch.drop(last)
        last = scratch.put(state)
        scratch.drop(told)
        entries.append(nodes.select(F.col("a").alias("key"), F.col("m").alias("n"), F.col("back").alias("d")))
        entries.append(scratch.put(last.filter("d IS NOT NULL").select("key", "n", "d")))
        grown = _bitmap(nodes.select(F.col("a").alias("key")), parts)
    tree = entries[0] if entries else last.select("key", "n", F.col("q").alias("d")).limit(0)
    for part in entries[1:]:
        tree = tree.unionByName(part)
    tree = scratch.put(tree.groupBy("key").agg(F.max("n").alias("n"), F.sum("d").alias("d")))
    return tree, words


def least_count(counts: DataFrame, by: str, most: int) -> int | None:
    """A least ``by`` that at most ``most`` rows reach, None if there is none.

    That count is found in a histogram over powers of 2 ** (1 / 16), so that no more than the result reaches the driver.
    """
    bins = counts.groupBy(F.floor(F.log2(by) * 16).alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min(by).alias("least")).orderBy(F.desc("b")).collect()
    held, least = 0, None
    for r in bins:
        held += r.k
        if held > most:
            break
        least = r.least
    return least


_MET: dict = {}


def _met(model):
    """The broadcast arrays (keys, values) as tables, made once in a worker."""
    import numpy as np

    if model.id not in _MET:
        _MET.clear()
        out = []
        for key, value in model.value:
            t = Table()
            t.add(key, np.arange(len(key), dtype=np.int32))
            out.append((t, np.append(value, 0.0)))  # -1 is none
        _MET[model.id] = out
    return _MET[model.id]


class _Broadcast:
    """A broadcast with a number that workers know it by."""

    def __init__(self, spark: SparkSession, *tables: DataFrame):
        import uuid

        import numpy as np

        arrow = [t.toArrow() for t in tables]  # bounded by least_count
        self.id = uuid.uuid4().hex
        self.held = spark.sparkContext.broadcast([(t.column(0).to_numpy().astype(np.int64).view(np.uint64), t.column(1).to_numpy().astype(float)) for t in arrow])

    @property
    def value(self):
        return self.held.value


def _ge(df: DataFrame, least: int | None) -> F.Column:
    return F.lit(False) if least is None else F.col("n") >= least


def score(scratch: Scratch, docs: DataFrame, counts: DataFrame, tree: DataFrame, words: int, total: int, distinct: int, parts: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of docs (doc_id, text, held_out)."""
    import numpy as np

    spark, unit = docs.sparkSession, float(np.log10(total + distinct + 1))
    often, near = _ge(counts, least_count(counts, "n", HEAD)), _ge(tree, least_count(tree, "n", NODES))
    model = _Broadcast(spark, counts.filter(often).select("key", F.log10(F.col("n") + 1)), tree.filter(near).select("key", "d"))
    # what isn't broadcast: a word's share, known by its key, and an entry of the tree, known by the complement of its key
    seldom = counts.filter(~often).select("key", F.log10(F.col("n") + 1).alias("value"), F.lit(1).alias("one"), F.lit(0).alias("node"))
    deep = tree.filter(~near).select("key", F.col("d").alias("value"), F.lit(0).alias("one"), F.lit(1).alias("node"))
    bits, rare_bits = _bitmap(deep, parts, TREE_BITS), _bitmap(seldom, parts)
    rest = seldom.unionByName(deep.withColumn("key", F.bitwise_not("key")))
    kinds = {"row": "long", "doc_id": "long", "held_out": "boolean", "n_tokens": "long", "known": "long", "base": "double", "score": "double", "piece": "int", "data": "binary"}

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from plexgraph.llm.common import utf8

        (log, log_value), (node, node_value) = _met(model)
        base_row = TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary()]
        held, size = [], 0

        def asking():
            key, row = (np.concatenate(x) for x in zip(*held))
            for dealt in _dealt(key, [row.view(np.uint64)], parts):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(dealt.num_rows, t) for t in types[:7]), *dealt.columns], list(kinds))

        for b in batches:
            for at, some in chunks(utf8(b.column("text"))):
                r = Runs(some)
                rows = base_row + np.arange(len(some))
                base_row += len(some)
                first, end, n = r.first, r.end, r.end - r.first
                k = log.find(r.key)
                base, more = log_value[k] - unit, np.zeros(len(r.key))
                rare = np.flatnonzero(k < 0)
                rare = rare[_passes(rare_bits.value, r.key[rare])]
                asked = [(rare, r.key[rare])]
                known = np.add.reduceat(k >= 0, first, dtype=np.int64)
                alive = np.ones(len(r.key), bool)  # runs that may be in the tree
                for _ in range(words + 1):
                    at_ = np.flatnonzero(alive & (r.left >= r.order))
                    if not len(at_):
                        break
                    key = r.key[at_]
                    j = node.find(key)
                    more[at_] += node_value[j]
                    out = np.flatnonzero(j < 0)
                    far = out[_passes(bits.value, key[out])]
                    asked.append((at_[far], ~key[far]))
                    if len(r.key) < 2:
                        break
                    alive = np.zeros(len(r.key), bool)
                    alive[at_[j >= 0]] = True
                    alive[at_[far]] = True
                    alive = alive[:-1] | alive[1:]
                    r.longer()
                add = lambda x: np.add.reduceat(x, first)
                total_base = add(base)
                cols = [rows, b.column("doc_id").slice(at, len(some)), b.column("held_out").slice(at, len(some)), n, known, total_base, total_base + add(more), None, None]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], list(kinds))
                of, key = np.concatenate([x for x, _ in asked]), np.concatenate([x for _, x in asked])
                held.append((key, rows[np.searchsorted(end, of, side="right")]))
                size += len(key)
                if size > ASKED:
                    yield from asking()
                    held, size = [], 0
        if size:
            yield from asking()

    def entries(batches):
        for b in batches:
            key, value, node = (b.column(c).to_numpy() for c in ("key", "value", "node"))
            key = key.view(np.uint64)
            yield from _dealt(key, [value.view(np.uint64), node.astype(np.uint64)], parts)

    def added(signed, value, n):
        """Each row, or its complement where nodes are met, once, with the sums of the values and of n."""
        signed, of = np.unique(signed, return_inverse=True)
        return signed, np.bincount(of, value, len(signed)), np.bincount(of, n, len(signed)).astype(np.int64)

    def looked_up(batches):
        """What is met, added up by row: the row, or its complement where nodes are met, the sum of the values and their number."""
        asked, known, found = {}, {}, []
        for b in batches:
            for piece, x, entry in zip(b.column("piece").to_pylist(), b.column("data"), b.column("entry").to_pylist()):
                held, width = (known, 3) if entry else (asked, 2)
                held.setdefault(piece, []).append(_entries(x.as_buffer(), width))
        for piece in known.keys() & asked.keys():
            key, value, node = np.concatenate(known.pop(piece), axis=1)
            order = np.argsort(key)
            key, value, node = key[order], value[order].view(float), node[order] > 0
            want, row = np.concatenate(asked.pop(piece), axis=1)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            met = np.flatnonzero(key[at] == want)
            row, at = row[met], at[met]
            found.append((np.where(node[at], ~row, row), value[at]))
        if found:
            signed, value = (np.concatenate(x) for x in zip(*found))
            signed, value, k = added(signed, value, np.ones(len(signed)))
            yield from _dealt(mixed(signed), [value.view(np.uint64), k.view(np.uint64)], parts)

    def sums(batches):
        for key, value, k in _taken(batches, 3):
            signed, value, k = added(unmixed(key), value.view(float), k.view(np.int64))
            node = signed >> np.uint64(63) > 0
            cols = [np.where(node, ~signed, signed).view(np.int64), np.where(node, 0, k), np.where(node, 0.0, value), np.where(node, value, 0.0)]
            yield from _batches(["row", "ones", "logs", "deep"], cols)

    told = scratch.put(docs.mapInArrow(sliced(run), ", ".join(f"{k} {t}" for k, t in kinds.items())))
    both = told.filter("piece IS NOT NULL").select("piece", "data", F.lit(False).alias("entry"))
    both = both.unionByName(rest.mapInArrow(entries, "piece int, data binary").withColumn("entry", F.lit(True)))
    met = _by_part(both, parts).mapInArrow(looked_up, "piece int, data binary")
    more = _by_part(met, parts).mapInArrow(sums, "row long, ones long, logs double, deep double")
    more = more.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("ones", "logs", "deep")))  # words and nodes
    rows = told.filter("piece IS NULL").drop("piece", "data").join(more, "row", "left")
    of = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("known") + of("ones")).alias("n_known"), (F.col("base") + of("logs")).alias("base_score"), (F.col("score") + of("logs") + of("deep")).alias("score"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, held: F.Column) -> DataFrame:
    """Learns from the rows that aren't held out and scores all: adds train_tokens to what ``score`` gives."""
    scratch = Scratch(docs.sparkSession)
    docs = doc_text(docs).withColumn("held_out", held)
    train = docs.filter(~F.col("held_out")).select("text")
    parts = parts_for(docs, PART_BYTES)
    counts = scratch.put(symbol_counts(train, parts))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tree, words = fit(scratch, train, counts, total, distinct, parts)
    out = stored(score(scratch, docs, counts, tree, words, total, distinct, parts).withColumn("train_tokens", F.lit(total).cast("long")))
    scratch.drop()
    return out


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"), held_out())
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_suffix_tree": op9_suffix_tree}
ORACLE: dict[str, str] = {}
