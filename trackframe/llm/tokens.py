"""Token counts by separator scan over flat token files without an index.

write(): documents are tokenised and appended to one flat file a task (little-endian ids, an
end-of-document id after each document). The only record kept is the order of documents in
each file. count(): files are cut into blocks of ids regardless of documents; each block is
range-read and searched for separators at once; a prefix scan over a file's blocks (running
number of separators, ids carried since the last one) stitches documents across blocks.

Defined cases: null and empty texts have 0 tokens; repeated rows give a row each; documents
without an id keep a null id; an empty table gives no file; ids after a file's last separator are a
last document; extra columns are ignored; a run of white space or of one letter may be as long as a text. A task names its file by its attempt, and only files in
the committed order table count.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, save, shuffle_width, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public splitting pattern (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK_IDS = 1 << 20
_ORDER = "file string, ordinal long, doc_id long, ids long"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A run of white space (as the pattern's \\s takes it) too long for the pattern's matcher, which recurses along it.
LONG = 1 << 15
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


def encoded(tokens, text: str) -> np.ndarray:
    """The ids of a text, as encode_ordinary gives them.

    A long run of white space is one piece of the pattern but for its last character, which begins what follows it; such pieces are
    given to the encoder by themselves, and the matcher sees the text between them only."""
    out, at = [], 0
    for m in _LONG_RUN.finditer(text):
        a, b = m.span()
        b -= b < len(text)
        out.append(np.asarray(tokens.encode_ordinary(text[at:a]), dtype="<u2"))
        out.append(np.asarray(tokens._encode_single_piece(text[a:b]), dtype="<u2"))
        at = b
    out.append(np.asarray(tokens.encode_ordinary(text[at:]), dtype="<u2"))
    return np.concatenate(out) if len(out) > 1 else out[0]


def _store(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _writer(folder: str, ranks: str, eod: int):
    def run(batches):
        task = TaskContext.get()
        store, path = _store(folder)
        name, out, ordinal = f"{path}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin", None, 0
        tokens = encoder(ranks)
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(name, compression=None)
            size = 0
            for text in batch.column("text"):
                ids = encoded(tokens, text.as_py() or "")
                out.write(ids.tobytes())
                out.write(np.array([eod], dtype="<u2").tobytes())
                size += len(ids) + 1
            n = len(batch)
            yield pa.record_batch(
                [pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id"), pa.array([size] + [0] * (n - 1), pa.int64())], names=["file", "ordinal", "doc_id", "ids"]
            )
            ordinal += n
        if out is not None:
            out.close()

    return run


def write(docs: DataFrame, folder: str, ranks: str = RANKS, eod: int = EOD) -> DataFrame:
    """Token files of docs (doc_id, text) under folder. Returns the order of documents: file,
    ordinal, doc_id, ids (whose sum over a file is the file's number of ids)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(d.mapInArrow(_writer(folder, ranks, eod), _ORDER), "order")


def _scanner(folder: str, eod: int):
    def run(batches):
        for batch in batches:
            store, _ = _store(folder)
            for name, block, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "first", "n"))):
                with store.open_input_file(name) as f:
                    f.seek(2 * offset)
                    raw = f.read(2 * n)
                if len(raw) != 2 * n:
                    raise OSError(f"{name} is too short")
                at = np.flatnonzero(np.frombuffer(raw, dtype="<u2") == eod)
                counts = np.diff(at, prepend=-1) - 1
                tail = n - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.record_batch(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([tail], pa.int64()), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["file", "block", "tail", "counts"]
                )

    return run


def count(files: DataFrame, folder: str, eod: int = EOD, block_ids: int = BLOCK_IDS) -> DataFrame:
    """files: (file, n): flat files and their numbers of ids. Returns file, ordinal, n_tokens of
    every document between separators (a last one without a separator only if it has ids)."""
    blocks = files.where("n > 0").select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_ids).cast("long"))).alias("block"))
    blocks = blocks.withColumn("first", F.col("block") * block_ids).withColumn("n", F.least(F.lit(block_ids).cast("long"), F.col("n") - F.col("first")))
    found = blocks.repartition(shuffle_width(files.sparkSession), "file", "block").mapInArrow(_scanner(folder, eod), "file string, block long, tail long, counts array<long>")
    found = save(found, "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = found.withColumn("ends", F.size("counts").cast("long"))
    s = s.withColumn("base", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("t", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    mark = F.last(F.when(F.col("ends") > 0, F.col("t")), ignorenulls=True).over(before)
    s = s.withColumn("carry", F.col("t") - F.coalesce(mark, F.lit(0)))
    closed = s.select("file", "base", "carry", F.posexplode("counts").alias("i", "c"))
    closed = closed.select("file", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("c") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    end = s.groupBy("file").agg(F.max(F.struct("block", "base", "ends", "carry", "tail")).alias("x"))
    left = F.col("x.tail") + F.when(F.col("x.ends") == 0, F.col("x.carry")).otherwise(0)
    last = end.select("file", (F.col("x.base") + F.col("x.ends")).alias("ordinal"), left.alias("n_tokens")).where("n_tokens > 0")
    return closed.unionByName(last)


def op10_token_counts(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every document, counted from its token file."""
    folder = fresh(spark, "tokens")
    order = write(table(spark, sf_dir, "documents"), folder, ranks)
    counts = count(order.groupBy("file").agg(F.sum("ids").alias("n")), folder)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
