"""Op 1. Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector shared by all
ordered thresholds, over sparse features x = log(1 + count per 100 words) of selected words.
Weights carry an L2 penalty and are found by L-BFGS; thresholds are written as a
first one and positive gaps, so they stay in order. The result is the expected severity,
the sum over k of P(grade > k).

Fitted on a bounded sample of labelled documents (``MAX_DOCS``, half of them from
each label where there are that many, reweighted to the labels' shares). The
features are the words bound to the label by a chi-square test over that sample
(``MIN_CHI``) that are in ``MIN_SHARE`` of either label's documents, the
``MAX_WORDS`` strongest of them. Labels say only toxic or not; the query's
grades are 0 (not toxic), 1 (toxic) and 2 (toxic, with more than the median
share of toxicity-bound words among the toxic sample).

Nulls: a null text has no words and gets the severity of an empty one; labels
with null toxic or doc_id are left out; several labels of a document count as
the highest. Repeated rows are scored alike. Without both labels, severity is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm.common import doc_text, sliced, table
from plexgraph.llm.decontaminate import words

MAX_DOCS = 20_000
MAX_WORDS = 4096
MIN_DOCS = 5
MIN_SHARE = 0.01
MIN_CHI = 40.0
L2 = 1e-4
ROUNDS = 200


def draw(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[DataFrame, dict]:
    """(text, toxic) of the sampled labelled documents, and each label's weight."""
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r.toxic in (0, 1)}
    share = {t: min(1.0, max_docs / 2 / c) for t, c in n.items()}
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_003))
    keep = F.coalesce(*[F.when(F.col("toxic") == t, hashed < s * 1_000_003) for t, s in share.items()], F.lit(False))
    drawn = own.filter(keep).limit(2 * max_docs)  # at most 2 x max_docs rows of 12 bytes: bounded, so it may be broadcast
    return doc_text(docs).join(F.broadcast(drawn), "doc_id"), {t: 1 / s for t, s in share.items()}


def _document_counts(rows: DataFrame) -> DataFrame:
    """(word, clean, toxic): how many sampled documents of each label have the word."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        from plexgraph.llm.common import utf8

        n = (Counter(), Counter())
        for b in batches:
            for t, y in zip(utf8(b.column("text")), b.column("toxic").to_pylist()):
                n[y].update(set(words(t)))
        keys = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in n)], ["word", "clean", "toxic"])

    return rows.mapInArrow(sliced(run), "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def choose_words(rows: DataFrame, n_clean: int, n_toxic: int, most: int = MAX_WORDS) -> list:
    """The words most associated with the label: [(word, is toxicity-bound)]."""
    n = n_clean + n_toxic
    has, a = F.col("clean") + F.col("toxic"), F.col("toxic")
    expected = has * n_toxic / F.lit(n)
    chi = F.pow(a - expected, 2) / (expected * (1 - has / F.lit(n)) * F.lit(n_clean / n) + 1e-9)
    top = _document_counts(rows).filter((has >= MIN_DOCS) & ((a >= MIN_SHARE * n_toxic) | (F.col("clean") >= MIN_SHARE * n_clean))).select("word", chi.alias("chi"), (a > expected).alias("bound")).filter(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "word").limit(most)
    return [(bytes(r.word), r.bound) for r in top.collect()]


def features(text: bytes, index: dict):
    """(feature numbers, log of 1 + count per 100 words)."""
    import numpy as np

    w = words(text)
    at = np.array([index[x] for x in w if x in index], np.int32)
    at, n = np.unique(at, return_counts=True)
    return at, np.log1p(100 * n / max(1, len(w))).astype(np.float32)


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(v, at, value, row, grade, weight, n_words: int, l2: float):
    """Penalised mean negative log likelihood and its gradient; v: weights, first threshold, log gaps."""
    import numpy as np

    n, top = len(grade), int(grade.max())
    w, gaps = v[:n_words], np.exp(v[n_words + 1 :])
    theta = v[n_words] + np.concatenate([[0.0], np.cumsum(gaps)])
    z = np.bincount(row, value * w[at], n)
    up = np.where(grade < top, _sigmoid(theta[np.minimum(grade, top - 1)] - z), 1.0)
    lo = np.where(grade > 0, _sigmoid(theta[np.maximum(grade - 1, 0)] - z), 0.0)
    p = np.maximum(up - lo, 1e-12)
    du, dl = weight * up * (1 - up) / p, weight * lo * (1 - lo) / p
    by_theta = np.bincount(np.maximum(grade - 1, 0), dl * (grade > 0), top) - np.bincount(np.minimum(grade, top - 1), du * (grade < top), top)
    after = np.cumsum(by_theta[::-1])[::-1]  # moving a threshold moves those above it
    g = np.concatenate([np.bincount(at, value * (du - dl)[row], n_words) + l2 * w, after[:1], after[1:] * gaps])
    return -(weight * np.log(p)).sum() + l2 / 2 * w @ w, g


def fit(at, value, row, grade, weight, n_words: int, l2: float = L2, rounds: int = ROUNDS):
    """Sparse features as (feature, value, row) triples: (w, thresholds). L-BFGS with backtracking."""
    import numpy as np

    weight, top = weight / weight.sum(), int(grade.max())
    share = np.array([weight[grade <= k].sum() for k in range(top)])
    theta = np.log(share + 1e-4) - np.log(1 - share + 1e-4)
    v = np.concatenate([np.zeros(n_words), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    args = (at, value, row, grade, weight, n_words, l2)
    f, g = _loss(v, *args)
    past: list = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, _r = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(alphas)):
            q += s * (a - r * (y @ q))
        step, slope = 1.0, -(g @ q)
        while step > 1e-8:
            new = v - step * q
            f2, g2 = _loss(new, *args)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - v, g2 - g
        done = f - f2 < 1e-9 * max(1.0, f)
        v, f, g = new, f2, g2
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        if done:
            break
    return v[:n_words], v[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(v[n_words + 1 :]))])


def severity_model(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS):
    """(words with their weights, thresholds) or None, learned from documents and labels."""
    import numpy as np

    rows, by_label = draw(docs, labels, max_docs)
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    vocabulary = choose_words(rows, n[0], n[1])
    if not vocabulary:
        return None
    index = {w: k for k, (w, _) in enumerate(vocabulary)}

    def run(batches):
        import pyarrow as pa

        from plexgraph.llm.common import utf8

        for b in batches:
            got = [features(t, index) for t in utf8(b.column("text"))]
            cols = [pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *cols], ["toxic", "at", "value"])

    sample = rows.mapInArrow(sliced(run), "toxic int, at binary, value binary").collect()  # bounded by the sample
    at, value = ([np.frombuffer(bytes(r[c]), kind) for r in sample] for c, kind in (("at", np.int32), ("value", np.float32)))
    row = np.repeat(np.arange(len(sample)), [len(a) for a in at])
    toxic = np.array([r.toxic for r in sample])
    at, value = np.concatenate(at), np.concatenate(value).astype(float)
    bound = np.array([b for _, b in vocabulary])
    density = np.bincount(row, bound[at] * np.expm1(value), len(sample))
    grade = np.where(toxic == 1, 1 + (density > np.median(density[toxic == 1])), 0)
    w, theta = fit(at, value, row, grade, np.array([by_label[t] for t in toxic]), len(index))
    return {x: float(w[k]) for x, k in index.items() if w[k]}, theta


def score(docs: DataFrame, model, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` with expected_severity, grade (the likeliest) and toxic (P(grade > 0) >= 1/2)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from plexgraph.llm.common import utf8

        weights, theta = model if model else ({}, np.array([40.0]))
        index = {x: k for k, x in enumerate(weights)}
        w = np.array(list(weights.values()))
        for b in batches:
            z = []
            for t in utf8(b.column("text")):
                at, value = features(t, index)
                z.append(float(value @ w[at]) if len(at) else 0.0)
            above = _sigmoid(np.array(z)[:, None] - theta)  # P(grade > k)
            full = np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1)
            new = [pa.array(above.sum(axis=1)), pa.array((full[:, :-1] - full[:, 1:]).argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], [*keep, "expected_severity", "grade", "toxic"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(sliced(run), f"{schema}, expected_severity double, grade int, toxic boolean")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_text(table(spark, sf_dir, "documents"))
    return score(docs, severity_model(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
