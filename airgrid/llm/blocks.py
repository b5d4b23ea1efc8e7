"""Blocks of documents: what one task handles at once, bounded by bytes of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext

BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 8_192


def text_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES,
                most: int = BLOCK_DOCS) -> Iterator[tuple[int, list, list[str]]]:
    """(block id, ids, texts) from batches of (id, text); null texts are read as empty.

    A block ends at ``size`` bytes of text or ``most`` rows; a longer text ends its
    block.  Ids are unique over all tasks and the same when a task is run again.
    """
    base = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[str] = []
    held = n = 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            held += len(texts[-1])
            if held >= size or len(ids) >= most:
                yield base + n, ids, texts
                ids, texts, held, n = [], [], 0, n + 1
    if ids:
        yield base + n, ids, texts
