"""Token counts of whole texts with a compiled transducer (``transducer.py``), one pass, no shuffle.

Defined results: a null text is empty; an empty text has no tokens; repeated rows are counted alike, each with its own
row; a text longer than a slice is a slice of its own, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from isoreach.llm import transducer

_SLICE_CHARS = 1 << 21
_loaded: dict[str, transducer.Transducer] = {}


def _of(path: str) -> transducer.Transducer:
    if path not in _loaded:
        _loaded[path] = transducer.sentencepiece(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit. ``model``: a sentencepiece BPE file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _of(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_tokens: list[int] = []
            first, chars = 0, 0
            for k, text in enumerate(texts):
                chars += len(text)
                if chars >= _SLICE_CHARS or k == len(texts) - 1:
                    n_tokens += machine.counts(texts[first : k + 1]).tolist()
                    first, chars = k + 1, 0
            n = pa.array(n_tokens, pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), n_bytes, n, pc.greater(n, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
