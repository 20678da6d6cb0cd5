"""Packing by power-of-two decomposition.

A document's ids (with a closing end id) are cut into pieces whose lengths are powers of two: as
many of the full length as fit, then the binary digits of the rest, longest first. Pieces of one
length share a bucket; each piece is a sequence of its own, so that no sequence crosses documents
and none is padded. Documents are tokenised where they are read; only narrow piece rows move, to
be numbered.

Edge cases: a null text counts as empty and gives one piece holding the end id; very long texts
give many pieces of the full length; repeated rows are packed one by one; an empty table gives an
empty result. Columns other than doc_id and text are ignored; ids keep their type.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.tokens import ByteBpe

MAX_LENGTH = 1024
END_ID = 0
_FIELDS = "start long, length long, ids_crc32 long, doc_tokens long"


def decompose(n: int, most: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; `most` is a power of two."""
    pieces = [(s, most) for s in range(0, n - n % most, most)]
    at, bit = n - n % most, most >> 1
    while bit:
        if n & bit:
            pieces.append((at, bit))
            at += bit
        bit >>= 1
    return pieces


def pieces(docs: DataFrame, most: int = MAX_LENGTH, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FIELDS}" + (", ids array<int>" if keep_ids else "")
    encoder = ByteBpe(path)

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("at", "start", "length", "ids_crc32", "doc_tokens")}
            held: list[np.ndarray] = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.uint32(END_ID)).astype("<u4", copy=False)
                for start, length in decompose(len(ids), most):
                    piece = ids[start : start + length]
                    for name, value in zip(out, (at, start, length, zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        out[name].append(value)
                    if keep_ids:
                        held.append(piece.astype(np.int32))
            columns = [pa.array(v, pa.int64()) for v in out.values()]
            columns[0] = batch.column(0).take(columns[0])
            if keep_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *list(out)[1:], *["ids"] * keep_ids])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, most: int = MAX_LENGTH, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """The pieces with sequence_id (gapless over all buckets, shortest lengths first) and offset.

    The pieces of one length are numbered side by side in as many cells as a cell has pieces, or so: neither
    a cell nor the table of all cells grows faster than the root of the number of pieces.
    """
    cut = common.stored(pieces(docs, most, path, keep_ids), "pieces")
    cells = max(1, round(cut.count() ** 0.5))
    cell = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)).cast("int")
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    return (
        common.numbered(cut.withColumn("cell", cell), [], ["length", "cell"], order, "sequence_id")
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("cell")
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, each holding sequences of that length only."""
    packed.write.mode("overwrite").partitionBy("length").parquet(path)
