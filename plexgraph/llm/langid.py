"""Op 4. Language identification by a byte convolutional network.

The lower-cased UTF-8 bytes of a text are cut into windows of ``WINDOW`` bytes
that cover it whole. A window's bytes are embedded, convolved with filters of
several widths, rectified, pooled by their maximum over the window, and
classified by a softmax; a document gets the mean of its windows' probabilities,
weighted by their bytes. The network is trained in numpy on a bounded sample of
labelled rows (``MAX_DOCS`` documents, spread evenly over the languages, of each
``DOC_WINDOWS`` windows spread evenly over the text) and applied batch by batch
with no shuffle. Classes are the ``MAX_LANGS`` languages with the most rows; rows of
any further language are not learned from and are told as one of these.

Nulls: rows with a null lang are not learned from; a null text, or one without a
letter, is ``und`` with score 0. A null doc_id counts as not held out. Repeated
rows are scored alike. Without any labelled row every document is ``und``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm.common import sliced, table

WINDOW = 128
EMBED = 6
WIDTHS = (2, 3, 4)
FILTERS = 16
MAX_DOCS = 4000
MAX_LANGS = 256
DOC_WINDOWS = 4
EPOCHS = 8
UNKNOWN = "und"


def cut(text: bytes, window: int = WINDOW):
    """(windows of bytes, zero-padded; bytes of the text in each)."""
    import numpy as np

    n = max(1, -(-len(text) // window))
    x = np.zeros(n * window, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    size = np.full(n, window)
    size[-1] = len(text) - (n - 1) * window
    return x.reshape(n, window), size


def _columns(e, x):
    """The embedded bytes at each place and the widest filter's reach after it: (windows x places, reach x embedding)."""
    import numpy as np

    reach = max(WIDTHS)
    v = e[x]  # windows, window, embedding
    places = x.shape[1] - reach + 1
    return np.concatenate([v[:, k : k + places] for k in range(reach)], axis=2).reshape(-1, reach * e.shape[1]), places


def _mask():
    import numpy as np

    m = np.zeros((max(WIDTHS), EMBED, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        m[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
    return m.reshape(-1, len(WIDTHS) * FILTERS)


def _softmax(z):
    import numpy as np

    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(x, y, classes: int, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """x: (n, WINDOW) bytes; y: class numbers. Adam over mini-batches."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mask, n_f = _mask(), len(WIDTHS) * FILTERS
    p = {
        "e": rng.normal(0, 0.5, (256, EMBED)),
        "w": rng.normal(0, 0.25, mask.shape) * mask,
        "b": np.zeros(n_f),
        "u": rng.normal(0, 0.1, (n_f, classes)),
        "c": np.zeros(classes),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, t = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)), None, 0
    m, s = m
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            xb, yb = x[order[at : at + 128]], y[order[at : at + 128]]
            cols, places = _columns(p["e"], xb)
            conv = (cols @ p["w"] + p["b"]).reshape(len(xb), places, n_f)
            top = conv.argmax(axis=1)
            pooled = np.take_along_axis(conv, top[:, None], 1)[:, 0]
            act = np.maximum(pooled, 0)
            d = _softmax(act @ p["u"] + p["c"])
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            da = (d @ p["u"].T) * (pooled > 0)  # only the places of the maxima take part
            rows = (np.arange(len(xb))[:, None] * places + top).ravel()
            flat = da.ravel()
            picked = cols[rows].reshape(len(xb), n_f, -1)
            dw = np.einsum("nf,nfk->kf", da, picked) * mask
            dcol = (p["w"].T[None] * da[:, :, None]).reshape(-1, max(WIDTHS), EMBED)
            de = np.zeros_like(p["e"])
            place = top.ravel()
            who = np.repeat(np.arange(len(xb)), n_f)
            for k in range(max(WIDTHS)):
                np.add.at(de, xb[who, place + k], dcol[:, k])
            g = {"e": de, "w": dw, "b": flat.reshape(len(xb), n_f).sum(0), "u": act.T @ d, "c": d.sum(0)}
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= (0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def probabilities(p: dict, x, batch: int = 256):
    """(windows, classes)."""
    import numpy as np

    out = np.empty((len(x), len(p["c"])), np.float32)
    for at in range(0, len(x), batch):
        cols, places = _columns(p["e"], x[at : at + batch])
        pooled = (cols @ p["w"]).reshape(-1, places, len(p["b"])).max(axis=1) + p["b"]
        out[at : at + batch] = _softmax(np.maximum(pooled, 0) @ p["u"] + p["c"])
    return out


def sample_windows(rows: DataFrame, max_docs: int = MAX_DOCS, per_doc: int = DOC_WINDOWS) -> list:
    """(lang, window) of about ``max_docs`` rows, spread over the languages by a hash of their doc_id."""
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = [(r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    if not counts:
        return []
    share = {lang: min(1.0, max_docs / len(counts) / n) for lang, n in counts}
    part = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])[F.col("lang")]
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < part * 1_000_003).select("lang", "text").limit(4 * max_docs)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from plexgraph.llm.common import utf8

        for b in batches:
            lang, out = [], []
            for k, t in zip(b.column("lang").to_pylist(), utf8(b.column("text"))):
                x, size = cut(t.lower())
                for at in np.unique(np.linspace(0, len(x) - 1, min(per_doc, len(x))).astype(int)):
                    if size[at] >= min(len(t), 16):
                        lang.append(k)
                        out.append(x[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "x"])

    return drawn.mapInArrow(sliced(run), "lang string, x binary").collect()


def fit(rows: DataFrame, max_docs: int = MAX_DOCS) -> tuple[dict, list] | None:
    """Train on labelled rows (doc_id, text, lang): (network, names of its classes)."""
    import numpy as np

    got = sorted(sample_windows(rows, max_docs))
    if not got:
        return None
    names = sorted({r.lang for r in got})
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([names.index(r.lang) for r in got]), len(names)), names


def predict(docs: DataFrame, model: tuple[dict, list] | None) -> DataFrame:
    """docs with lang_pred and score added, and any columns of those names replaced."""
    docs = docs.drop("lang_pred", "score")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column("text").to_pylist()
            live = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at in range(0, len(live), 64):
                some = live[at : at + 64]
                pieces = [cut(texts[k].encode().lower()) for k in some]
                probs = probabilities(model[0], np.concatenate([x for x, _ in pieces])).astype(float)
                size = np.concatenate([s for _, s in pieces]).astype(float)
                starts = np.cumsum([0] + [len(x) for x, _ in pieces])[:-1]
                mean = np.add.reduceat(probs * size[:, None], starts) / np.add.reduceat(size, starts)[:, None]
                for k, row in zip(some, mean):
                    lang[k], score[k] = model[1][int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(sliced(run), schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


QUERIES = {"op4_langid": op4_langid}
ORACLE: dict[str, str] = {}
