"""Exact token counts of texts and of all their prefixes.

Method: the program of :mod:`funnelweir.llm.bpe` stores the token count of every prefix of
every piece; a text's prefix costs the tokens of the pieces before it and one look-up. The
whole count, the longest prefix within a budget and, on demand, the count at every
character come from these tables, and nothing is encoded again.

Null texts count as empty. Ids may be null or repeated: each input row gives one output row.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.llm.bpe import encoder, vocabulary_path
from funnelweir.llm.common import slices

#: Entries of each half of the caches of counts.
CACHE_ENTRIES = 200_000


def token_counts(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, id_column: str = "doc_id", text_column: str = "text", prefixes: bool = False
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit), fit_chars, and prefix_tokens if asked for.

    ``fit_chars``: characters of the longest prefix of at most ``limit`` tokens.
    ``prefix_tokens``: token count of every prefix by number of characters, from 0 on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary))
        own.counts.entries = own.chunk_count.entries = CACHE_ENTRIES
        for batch in slices(batches):
            texts = batch.column(1)
            total, fit, every = [], [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                n, chars = own.count_and_fit(text, limit)
                total.append(n)
                fit.append(chars)
                if prefixes:
                    every.append(own.prefix_counts(text))
            out = [batch.column(0), batch.column(2), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array(fit, pa.int64())]
            names = ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if prefixes:
                out.append(pa.array(every, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(out, names=names)

    text = F.coalesce(F.col(text_column), F.lit(""))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * prefixes
    found = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_column)
