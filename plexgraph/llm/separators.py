"""Op 2. Token counts by a separator scan.

A flat token file is a run of ids with an end-of-document id after each document
and no index, cut into blocks of a fixed number of ids wherever they fall. Each
block is searched for separators with one vectorised comparison. Blocks are
stitched by prefix scans over a table with one row for a block: the separators
before it number its documents, the ids before it place them, and the ids since
the last separator before it are the part of its first document that lies in
earlier blocks, however many of them that document spans.

The scans run within ranges of ``RANGE`` blocks and then over the ranges, so that a
large file is not one task's. Runs of more than ``LONG_RUN`` white-space characters
are encoded apart, as the tokenizer's rule would cut them: its regular expression
would follow such a run to a depth that ends the process.

Nulls: a null text is empty and counts only its separator; a null doc_id keeps
its row. Repeated documents keep their rows. Ids after the last separator of a file
form a last document. Empty tables and empty files give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import doc_text, shared_dir, sliced, stored, table
from plexgraph.llm.tokens import tokenizer_path

TOKENIZER = "byte_bpe_50k.tiktoken"
#: The id that this vocabulary leaves free.
END = 50256
BLOCK = 1 << 18
RANGE = 4096
LONG_RUN = 1000

#: White space as the tokenizer's rule has it.
_RUN = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")
_IDS, _NAMES = 0, 1
_SCHEMA = "part int, kind int, block long, data binary"


def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str) -> list[int]:
    """The ids of a whole text, with long runs of white space encoded apart: all of such a run but its last character, which goes with what follows."""
    out, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def write_flat(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK) -> None:
    """Writes a file of 16-bit ids for each part of the input, in its order, and beside it the doc_ids in that order."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
        part, number, held, size, named = TaskContext.get().partitionId(), 0, [], 0, 0
        enc = _encoding(tokenizer)

        def row(kind, n, data):
            return pa.RecordBatch.from_pydict({"part": [part], "kind": [kind], "block": [n], "data": [data]}, schema=schema)

        for b in batches:
            ids = b.column("doc_id")
            yield row(_NAMES, named, np.array([[d or 0, d is None] for d in ids.to_pylist()], "<i8").tobytes())
            named += len(ids)
            for t in b.column("text").to_pylist():
                held.append(np.array([*encode(enc, t or ""), end], "<u2"))
                size += len(held[-1])
                if size >= block:
                    flat = np.concatenate(held)
                    for k in range(0, size - size % block, block):
                        yield row(_IDS, number, flat[k : k + block].tobytes())
                        number += 1
                    held, size = [flat[size - size % block :]], size % block
        if size:
            yield row(_IDS, number, np.concatenate(held).tobytes())

    docs.mapInArrow(sliced(run), _SCHEMA).write.option("compression", "zstd").parquet(path)


def _scan(end: int):
    """A row for each separator, and one (k = -1) for each block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for part, block, data in zip(b.column("part").to_pylist(), b.column("block").to_pylist(), b.column("data")):
                ids = np.frombuffer(data.as_py(), "<u2")
                at = np.flatnonzero(ids == end)
                last = int(at[-1]) + 1 if len(at) else 0
                k = np.arange(-1, len(at))
                n = np.diff(at, prepend=-1)
                cols = [np.full(len(k), part, np.int32), np.full(len(k), block), k, np.concatenate([[len(ids)], at + 1]), np.concatenate([[len(at)], n]), np.full(len(k), len(ids) - last)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "block", "k", "pos", "n", "tail"])

    return run


def count_documents(blocks: DataFrame, end: int = END) -> DataFrame:
    """blocks: (part, block, data) of flat files. (part, ordinal, start, n_tokens) of each document; start is in its file."""
    found = stored(blocks.select("part", "block", "data").mapInArrow(sliced(_scan(end), 64), "part int, block long, k long, pos long, n long, tail long"))
    before = (Window.unboundedPreceding, -1)
    inside, over = Window.partitionBy("part", "range").orderBy("block"), Window.partitionBy("part").orderBy("range")
    total = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*before)), F.lit(0))
    own = found.filter("k = -1").select("part", "block", F.floor(F.col("block") / RANGE).alias("range"), F.col("pos").alias("size"), F.col("n").alias("seps"), "tail")
    # of a range: separators and ids before it, and whether it is the file's last
    ranges = own.groupBy("part", "range").agg(F.sum("size").alias("size"), F.sum("seps").alias("seps"))
    ranges = ranges.select("part", "range", total("seps", over).alias("seps0"), total("size", over).alias("size0"), F.lead("range").over(over).isNull().alias("final"))
    own = own.join(ranges, ["part", "range"]).select("*", (F.col("seps0") + total("seps", inside)).alias("first"), (F.col("size0") + total("size", inside)).alias("offset"))
    own = own.withColumn("closed", F.when(F.col("seps") > 0, F.col("offset") + F.col("size") - F.col("tail")))
    closed = own.groupBy("part", "range").agg(F.max("closed").alias("closed")).select("part", "range", F.max("closed").over(over.rowsBetween(*before)).alias("closed0"))
    own = own.join(closed, ["part", "range"])
    own = own.withColumn("carry", F.col("offset") - F.coalesce(F.max("closed").over(inside.rowsBetween(*before)), "closed0", F.lit(0)))
    own = own.withColumn("last", F.col("final") & F.lead("block").over(inside).isNull())
    ends = found.filter("k >= 0").select("part", "block", "k", "pos", "n").join(own, ["part", "block"])
    n = F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    rows = ends.select("part", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("offset") + F.col("pos") - n).alias("start"), n.alias("n_tokens"))
    open_n = F.col("tail") + F.when(F.col("seps") == 0, F.col("carry")).otherwise(0)
    rest = own.filter("last").filter(open_n > 0).select("part", (F.col("first") + F.col("seps")).alias("ordinal"), (F.col("offset") + F.col("size") - open_n).alias("start"), open_n.alias("n_tokens"))
    return rows.unionByName(rest)


def token_counts(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) from flat files written for docs; n_tokens counts the separator."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_flat(doc_text(docs), path, tokenizer or tokenizer_path(TOKENIZER), block=block)
    rows = spark.read.schema(_SCHEMA).parquet(path)
    counts = count_documents(rows.filter(F.col("kind") == _IDS))

    def names(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for part, first, data in zip(b.column("part").to_pylist(), b.column("block").to_pylist(), b.column("data")):
                x = np.frombuffer(data.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(first + np.arange(len(x))), pa.array(x[:, 0], mask=x[:, 1] == 1)], ["part", "ordinal", "doc_id"])

    named = rows.filter(F.col("kind") == _NAMES).select("part", "block", "data").mapInArrow(sliced(names, 64), "part int, ordinal long, doc_id long")
    return named.join(counts, ["part", "ordinal"]).select("doc_id", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
