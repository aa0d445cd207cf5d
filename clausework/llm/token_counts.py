"""Token counts by a separator scan of flat, unindexed token files.

A stream is a file of fixed-width little-endian token ids in which an end-of-document id closes each document; there is no index.
It is read in blocks cut without regard to documents: each task opens the file and reads the byte range of its blocks, so no file is
ever held as a whole. Each block is scanned for the separator with one vectorised comparison; a prefix scan over the blocks of a
stream (number of separators so far, place of the last one) stitches documents that cross blocks. Only block summaries are
ordered within a stream, never the tokens.

Files lie in a folder that all executors share and that pyarrow can open (file, hdfs, s3, gs). A task writes a file of its own name
for each attempt, and only the files that the written table of documents names are read, so retried tasks leave no trace.

Defined results. A document without tokens has n_tokens 0. Tokens after the last separator of a stream come out as one document
with complete = false. An empty file has no documents. A trailing part of a token is ignored. Null texts are written as
empty documents. Rows that repeat an id, or have none, are counted row by row; there are no ties. Texts are taken whole whatever their length.
Extra columns, whatever their names, are ignored; an empty table gives empty results. Ids take two bytes where the vocabulary allows, else four.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm import _words as w
from clausework.llm._store import materialise, partitions, scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
BLOCK_TOKENS = 1 << 19
_DTYPE = {2: "<u2", 4: "<u4"}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream, path, length) of the flat token files of a folder; only their names and sizes are read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "path", "length")


def document_counts(files: DataFrame, end: int = END, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """stream, ordinal, start, n_tokens, complete for each document of the files (stream, path, length)."""
    size = block_tokens * token_bytes

    def scan(batches):
        path, file = None, None
        for batch in batches:
            sizes, ends = [], []
            for p, block in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != path:
                    fs, at = _open(p)
                    path, file = p, fs.open_input_file(at)
                raw = file.read_at(size, block * size)
                tokens = np.frombuffer(raw, _DTYPE[token_bytes], len(raw) // token_bytes)
                sizes.append(len(tokens))
                ends.append(np.flatnonzero(tokens == end))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["stream", "block", "size", "ends"])

    kind = files.schema["stream"].dataType.simpleString()
    blocks = files.where(f"length >= {token_bytes}").select("stream", F.expr(f"explode(sequence(0L, (length - 1) div {size}))").alias("block"), "path")
    blocks = blocks.repartition(partitions(files.sparkSession), "path", "block").sortWithinPartitions("path", "block")
    found = blocks.mapInArrow(w.released(scan), f"stream {kind}, block long, size long, ends array<long>")
    at = F.col("block") * block_tokens
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    some = F.size("ends") > 0
    found = found.withColumns(
        {
            "first": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"),
            "open": F.coalesce(F.max(F.when(some, at + F.element_at("ends", -1))).over(before), F.lit(-1)) + 1,
            "is_last": F.lead("block").over(Window.partitionBy("stream").orderBy("block")).isNull(),
        }
    )
    stops = F.transform("ends", lambda e: e + at)
    starts = F.concat(F.array("open"), F.transform("_stops", lambda e: e + 1))
    found = found.withColumn("_stops", stops).withColumn("_starts", starts)
    total = at + F.col("size")
    docs = F.transform("_stops", lambda e, i: F.struct((F.col("first") + i).alias("ordinal"), F.get("_starts", i).alias("start"), e.alias("stop"), F.lit(True).alias("complete")))
    tail = F.struct((F.col("first") + F.size("ends")).alias("ordinal"), F.element_at("_starts", -1).alias("start"), total.alias("stop"), F.lit(False).alias("complete"))
    rows = F.when(F.col("is_last") & (F.element_at("_starts", -1) < total), F.concat(docs, F.array(tail))).otherwise(docs)
    out = found.select("stream", F.explode(rows).alias("d"))
    return out.select("stream", "d.ordinal", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), "d.complete")


_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _largest(path: str) -> int:
    return max(int(line.split()[1]) for line in open(path, "rb"))


def write_streams(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Tokenises docs into one flat file per input partition; (stream, path, length), the order (stream, ordinal, doc_id), bytes of a token."""
    kind = docs.schema[id_col].dataType.simpleString()
    folder = folder or scratch_path(docs.sparkSession, "streams")
    token_bytes = 2 if max(end, _largest(vocabulary)) < 1 << 16 else 4

    def run(batches):
        enc, task = _encoding(vocabulary), TaskContext.get()
        stream, path = task.partitionId(), f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        ordinal, length, file, id_type = 0, 0, None, None
        try:
            for batch in batches:
                id_type = batch.schema.field(0).type
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    coded = [enc.encode_ordinary(t or "") for t in part.column(1).to_pylist()]
                    if file is None:
                        fs, at = _open(path)
                        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                        file = fs.open_output_stream(at)
                    for x in coded:
                        raw = np.array([*x, end], _DTYPE[token_bytes]).tobytes()
                        file.write(raw)
                        length += len(raw)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([stream] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), part.column(0), pa.nulls(n, pa.string())], names=["stream", "place", "doc_id", "path"])
                    ordinal += n
        finally:
            if file is not None:
                file.close()
        if file is not None:  # the file's own row comes last, when all of it is written
            yield pa.RecordBatch.from_arrays([pa.array([stream], pa.int64()), pa.array([length], pa.int64()), pa.nulls(1, id_type), pa.array([path])], names=["stream", "place", "doc_id", "path"])

    both = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(w.released(run), f"stream long, place long, doc_id {kind}, path string")
    both = materialise(both, "streams")
    files = both.where("path is not null").select("stream", "path", F.col("place").alias("length"))
    return files, both.where("path is null").select("stream", F.col("place").alias("ordinal"), "doc_id"), token_bytes


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, stream, ordinal, start: documents written as flat files, then counted from the files alone."""
    files, order, token_bytes = write_streams(docs, vocabulary, id_col=id_col, text_col=text_col)
    counts = document_counts(files, token_bytes=token_bytes, block_tokens=block_tokens)
    return counts.join(order, ["stream", "ordinal"]).select("doc_id", "n_tokens", "stream", "ordinal", "start")
