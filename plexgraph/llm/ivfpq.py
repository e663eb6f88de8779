"""Op 3. Approximate nearest neighbours by an inverted file with product quantisation.

Coarse centroids split the vectors into lists; the direction of a vector's
residual from its centroid is product-quantised, and its length and the distance
of its code from it are kept. A query scores codes with one asymmetric table of
inner products and reranks exactly, in double precision, on the original vectors,
which the index keeps. Centroids and codebooks are fitted on at most about
``SAMPLE`` vectors; every vector is indexed.

Nothing is left out by guess: a query's (k + 1)-th best in the sample bounds its
results from below. By the inequality of Cauchy and Schwarz the inner product of q
with a vector is at most that with its centroid plus |q| times the longest residual
of the list, and at most that with its code plus |q| times the code's distance. Lists
and vectors that can't reach the bound are passed over, all others are probed and
reranked, so the neighbours are those of brute force whatever the vectors are.
The ``RERANK`` best codes of a list part go first and raise the bound for its rest.

Equal vectors are indexed and searched once: as they tie everywhere, only the
smallest ids of such a group can be results, and these stay with it.
Lists are cut into parts of about ``PART`` vectors that queries meet one by one,
so a large list is spread over tasks.

Vectors that are null, zero or hold null or non-finite components take no part,
nor do those whose length differs from the most frequent one, nor null ids.
Every row is a candidate, with repeated ids too, but for those of the query's own
id; a query id with different vectors is a query with each of them, each with its
own ranks. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import sliced, stored, table

K = 20
SAMPLE = 20_000
SAMPLE_MB = 32
MAX_LISTS = 4096
RERANK = 256
SUB = 4
PART = 32_768
#: Part of the product of two lengths that rounding may take from an inner product of theirs.
ROUNDING = 1e-12


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = v.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0.0))
    top = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return v.filter(F.size("v") == (top.d if top else 0))


def _kmeans(x, k: int, rounds: int, rng):
    import numpy as np

    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n, np.bincount(near, x[:, j], k) / np.maximum(n, 1), c[:, j])
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def _near(x, c):
    return (x @ c.T - (c * c).sum(1) / 2).argmax(1)


def _residuals(x, c, near):
    """(directions of the residuals, padded to whole sub-vectors; their lengths)."""
    import numpy as np

    r = x - c[near]
    length = np.linalg.norm(r, axis=1)
    r = np.divide(r, length[:, None], out=np.zeros_like(r), where=length[:, None] > 0)
    return np.pad(r, ((0, 0), (0, -r.shape[1] % SUB))), length


def fit(x, lists: int, seed: int = 5):
    """(centroids, codebooks of each sub-vector) from sample vectors."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = _kmeans(x, lists, 12, rng)
    r, _ = _residuals(x, c, _near(x, c))
    return c, np.stack([_kmeans(r[:, k : k + SUB], 256, 8, rng) for k in range(0, r.shape[1], SUB)])


def _index(model):
    """Adds the list and the code of each vector, the length of its residual and the distance of the code from it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c, books = model.value
        for b in batches:
            x = np.array(b.column("v").to_pylist(), float)
            if not len(x):
                continue
            near = _near(x, c)
            r, length = _residuals(x, c, near)
            code = np.stack([_near(r[:, k * SUB : (k + 1) * SUB], books[k]) for k in range(len(books))], axis=1).astype(np.uint8)
            coded = books[np.arange(len(books)), code].reshape(len(x), -1)
            off = length * np.linalg.norm(r - coded, axis=1) + ROUNDING * np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array([row.tobytes() for row in code], pa.binary()), pa.array(length), pa.array(off)], [*b.schema.names, "list", "code", "length", "off"])

    return run


def _probe(model, sampled, reach: dict, k: int):
    """The lists that a query probes, those that may hold what reaches its k-th best in the sample. reach: of each list the longest residual."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c, _ = model.value
        some = sampled.value
        longest = np.array([reach.get(j, -np.inf) for j in range(len(c))])
        most = max(np.linalg.norm(some, axis=1).max(), np.linalg.norm(c, axis=1).max(), longest.max())
        for b in batches:
            x = np.array(b.column("v").to_pylist(), float)
            if not len(x):
                continue
            norm = np.linalg.norm(x, axis=1)
            least = np.full(len(x), -np.inf)
            for at in range(0, len(x) if len(some) >= k else 0, 256):
                least[at : at + 256] = np.partition(x[at : at + 256] @ some.T, len(some) - k, axis=1)[:, len(some) - k]
            least -= ROUNDING * norm * most
            who, top = np.nonzero(~(x @ c.T + norm[:, None] * longest < least[:, None]))  # what overflows is kept
            yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(who)), b.column("v").take(pa.array(who)), pa.array(least[who]), pa.array(top.astype(np.int32))], ["q", "v", "least", "list"])

    return run


def _packed(most: int, columns: list[str]):
    """Rows sorted by (list, part) into rows of at most ``most`` of them, each column an array."""

    def run(batches):
        import pyarrow as pa

        held, key = [], None

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.num_rows
            cols = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t.column(c).combine_chunks()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), *cols], ["list", "part", *columns])

        for b in batches:
            keys = list(zip(b.column("list").to_pylist(), b.column("part").to_pylist()))
            at = 0
            while at < len(keys):
                n = sum(x.num_rows for x in held)
                if held and (keys[at] != key or n >= most):
                    yield out()
                    held, n = [], 0
                key, end = keys[at], at
                while end < len(keys) and keys[end] == key and end - at < most - n:
                    end += 1
                held.append(b.slice(at, end - at).select(columns))
                at = end
        if held:
            yield out()

    return run


def _search(model, k: int, rerank: int):
    """Packed vectors and packed queries of a list part: each query's best k; of the codes, only those are passed over that can't be among them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c, books = model.value
        for b in batches:
            for j in range(b.num_rows):
                get = lambda n: b.column(n)[j].values
                ids, groups = np.array(get("x").to_pylist()), np.array(get("g").to_pylist())
                vectors = np.array(get("v").to_pylist(), float)
                code = np.frombuffer(b"".join(get("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                ids, groups, vectors, code = ids[order], groups[order], vectors[order], code[order]
                length, off = (np.array(get(n).to_pylist())[order] for n in ("length", "off"))
                qs, qv = np.array(get("q").to_pylist()), np.array(get("qv").to_pylist(), float)
                middle = qv @ c[b.column("list")[j].as_py()]
                padded = np.pad(qv, ((0, 0), (0, len(books) * SUB - qv.shape[1]))).reshape(len(qv), len(books), 1, SUB)
                tables = (padded * books[None]).sum(-1)  # queries, sub-vectors, 256
                out = ([], [], [], [])
                for t, q, v, mid, norm, least in zip(tables, qs, qv, middle, np.linalg.norm(qv, axis=1), get("least").to_pylist()):
                    approx = t[np.arange(len(books)), code].sum(1) * length + mid
                    above = approx + norm * off
                    best = np.flatnonzero(~(above < least))
                    if len(best) > rerank:
                        far = np.argpartition(-approx[best], rerank)
                        first, rest = best[far[:rerank]], best[far[rerank:]]
                        exact = vectors[first] @ v
                        if rerank >= k:
                            # as many as are asked for reach this, so that what can't is none of them
                            rest = rest[~(above[rest] < np.partition(exact, rerank - k)[rerank - k])]
                        best, exact = np.r_[first, rest], np.r_[exact, vectors[rest] @ v]
                    else:
                        exact = vectors[best] @ v
                    best, exact = best[~(exact < least)], exact[~(exact < least)]
                    top = np.lexsort((ids[best], -exact))[:k]
                    out[0].append(np.full(len(top), q))
                    out[1].append(ids[best][top])
                    out[2].append(groups[best][top])
                    out[3].append(exact[top])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["q", "x", "g", "score"])

    return run


def search(rows: DataFrame, queries: F.Column, k: int = K, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (a condition on vec_id) selects, its k nearest others."""
    spark = rows.sparkSession
    own = valid(rows).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v")).alias("h2"))
    asked = own.filter(queries).select("vec_id", "h1", "h2")
    # a result list begins with rows of the query's own id, as many as there are, one by far the most often
    m = k + (asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1)
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = own.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= m)  # at most m of each map task
    groups = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # g names a group of equal vectors; x, its smallest id, may be that of other groups too
    groups = stored(groups.withColumns({"g": F.monotonically_increasing_id(), "x": F.element_at("ids", 1)}))
    n, dim = groups.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    import numpy as np

    most = max(1, min(sample, int(SAMPLE_MB * 1e6 / 8 / dim)))
    drawn = groups.filter(F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(1_000_003)) < F.lit(min(1.0, most / n) * 1_000_003)).select("v").limit(most).toArrow() if n > 1 else groups.select("v").toArrow()
    if not drawn.num_rows:
        drawn = groups.select("v").limit(1).toArrow()
    x = drawn.column("v").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dim)
    lists = int(min(MAX_LISTS, max(1, round(n ** (1 / 3))), len(x)))
    fitted = fit(x, lists)
    model, sampled = spark.sparkContext.broadcast(fitted), spark.sparkContext.broadcast(x)
    indexed = stored(groups.select("g", "x", "v").mapInArrow(sliced(_index(model), 5000), "g long, x long, v array<double>, list int, code binary, length double, off double"))
    parts = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"), F.max("length").alias("longest"))  # a row for each list, MAX_LISTS at most
    reach = {r.list: r.longest for r in parts.collect()}
    cut = indexed.join(F.broadcast(parts.select("list", "parts")), "list").select("list", F.pmod(F.xxhash64("g"), "parts").alias("part"), "g", "x", "v", "code", "length", "off")
    one = lambda df, most, cols: df.repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(sliced(_packed(most, cols), 5000), f"list int, part long, {', '.join(f'{c} array<{dict(df.dtypes)[c]}>' for c in cols)}")
    blocks = stored(one(cut, 8192, ["g", "x", "v", "code", "length", "off"]))
    asked_groups = asked.select("h1", "h2").distinct().join(groups, ["h1", "h2"])
    probed = asked_groups.select(F.col("g").alias("q"), "v").mapInArrow(sliced(_probe(model, sampled, reach, m), 5000), "q long, v array<double>, least double, list int")
    probed = probed.join(F.broadcast(parts.select("list", "parts")), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "q", F.col("v").alias("qv"), "least")
    met = stored(one(probed, 256, ["q", "qv", "least"])).join(blocks, ["list", "part"])
    found = met.select("list", "q", "qv", "least", "g", "x", "v", "code", "length", "off").mapInArrow(sliced(_search(model, m, rerank), 16), "q long, x long, g long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "x", "g")
    top = stored(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= m).select("q", "g", "score"))
    members = groups.select("g", "ids")
    each = top.join(members, "g").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    flat = F.flatten(F.transform("found", lambda m: F.transform(m["ids"], lambda i: F.struct((-m["score"]).alias("s"), i.alias("vec_id")))))
    each = each.select("q", F.slice(F.array_sort(flat), 1, m).alias("found"))
    who = asked.join(groups.select("h1", "h2", F.col("g").alias("q")), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "q").distinct()
    rest = who.join(each, "q").select("query_id", F.slice(F.filter("found", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return rest.select("query_id", F.posexplode("found").alias("p", "s")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "s.vec_id", (-F.col("s.s")).alias("score"))


def op3_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op3_ivfpq": op3_ivfpq}
ORACLE: dict[str, str] = {}
