"""The corpus as token ids of a public tokenizer, and each text's number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.tokenizer import StreamDecoder, shared

#: Texts that are tokenized together; only a matter of speed.
TOGETHER = 128


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(k, TOGETHER)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (list of integers) of each row, in one pass without a shuffle.

    Null and empty texts have the empty list; white space is text like any other. Rows are neither dropped nor
    joined: a repeated key gives a row each time. Other columns are left out, so their names can't clash. ``path`` is
    the vocabulary's file on every executor. Texts longer than a block go through the streaming transducer.
    """
    kind = df.schema[key].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path)
        for b in _batches(it):
            flat, ends = bpe.encode_batch(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["key", "ids"])

    out = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, out).withColumnRenamed("key", key)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and ``text`` of each list of ids, by the incremental byte-to-text state machine; null ids give null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path)
        for b in it:
            texts = []
            for row in b.column(1).to_pylist():
                machine = StreamDecoder(bpe)
                texts.append(None if row is None else "".join(machine.feed(row)) + machine.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    out = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(key).alias("key"), F.col(ids)).mapInArrow(run, out).withColumnRenamed("key", key)


def token_counts(df: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the text's number of tokens; 0 for null and empty texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path)
        for b in _batches(it):
            counts = pa.array(bpe.count_batch(b.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], counts], names=[*keep, "tokens"])

    out = T.StructType([*(df.schema[k] for k in keep), T.StructField("tokens", T.LongType())])
    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, out)
