"""Token counts of texts by a public byte-level BPE vocabulary, read from a path and never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(2)
def encoding(path: str):
    """The encoder of a ``.tiktoken`` rank file, with the split pattern that lies beside it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, k, tokens)`` as a written table; ``k`` is the text's content hash.

    Null and empty texts have 0 tokens; special-token strings in a text are ordinary text.  A batch's equal texts
    are encoded once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            text = batch.column("text").dictionary_encode()
            sizes = np.array([len(encode(t)) if t else 0 for t in text.dictionary.to_pylist()] + [0], np.int64)
            keys = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in text.dictionary.to_pylist()] + [0], np.uint64)
            at = text.indices.fill_null(len(sizes) - 1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(keys[at].view(np.int64)), pa.array(sizes[at])],
                names=["doc_id", "source", "k", "tokens"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return written(rows.mapInArrow(count, "doc_id bigint, source string, k bigint, tokens bigint"), "tokens")
