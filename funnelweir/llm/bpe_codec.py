"""Texts to token ids and back.

Method: :mod:`funnelweir.llm.bpe` stores the unique last token of every prefix of a piece;
following these back from the end gives the ids. Ids are kept as little-endian unsigned
32-bit integers in one binary value, as training files hold them.

Null texts encode as empty, null ids decode as the empty text. Each input row gives one
output row; other columns of the input are not read.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.llm.bpe import encoder, forget, vocabulary_path
from funnelweir.llm.common import slices

VOCABULARY = "byte_bpe_50k.json"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", keep: bool = True) -> DataFrame:
    """id, n_tokens, ids. Without ``keep`` a worker gives its encoder's memory back after each task, for other operators to use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary))
        if sys.byteorder != "little":
            raise RuntimeError("ids are packed little-endian")
        for batch in slices(batches):
            texts = batch.column(1)
            ids = [own.encode(texts[i].as_py()) for i in range(len(texts))]
            out = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "ids"])
        if not keep:
            forget()

    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"id {_kind(docs, id_column)}, n_tokens long, ids binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id, n_tokens, ids, text; special tokens are written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary))
        for batch in slices(batches):
            packed = batch.column(1)
            texts = [own.decode(array("I", packed[i].as_py())) for i in range(len(packed))]
            sizes = pa.array([len(packed[i].as_py()) // 4 for i in range(len(packed))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, packed, pa.array(texts, pa.string())], names=["id", "n_tokens", "ids", "text"])

    ids = encoded.select(F.col(id_column).alias("id"), F.coalesce(F.col(ids_column), F.lit(b"")).alias("ids"))
    return ids.mapInArrow(run, f"id {_kind(encoded, id_column)}, n_tokens long, ids binary, text string").withColumnRenamed("id", id_column)
