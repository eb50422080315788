"""Operator 8: token ids as directly addressable codes.

An id is split into chunks of ``WIDTH`` bits, the lowest first. Level 0 holds the first chunk of every id and a bitmap that says
which ids go on; level 1 holds the second chunk of those, and so on; the last level needs no bitmap. A rank directory
(ones before every block of 512 bits) leads from a place in one level to its place in the next, so any id is read
without decoding the others.

Bytes of a document: number of levels (uint32), entries of each level (uint32), then for each level its chunks (one byte each), and but for
the last the bitmap (lowest bit first) and the directory (uint32).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .tokens import TOKENIZER, chunks

WIDTH = 8
_BLOCK = 512
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """The codes of an array of non-negative ids below 2**32."""
    ids = np.asarray(ids, np.uint32)
    sizes, parts = [], []
    while True:
        sizes.append(len(ids))
        parts.append(ids.astype(np.uint8).tobytes())
        rest = ids >> WIDTH
        more = rest > 0
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        blocks = -(-len(ids) // _BLOCK)
        ones = np.add.reduceat(_POPCOUNT[bits], np.arange(0, len(bits), _BLOCK // 8))
        directory = np.zeros(blocks, np.uint32)
        np.cumsum(ones[:-1], out=directory[1:])
        parts += [bits.tobytes(), directory.tobytes()]
        ids = rest[more]
    return np.array([len(sizes), *sizes], np.uint32).tobytes() + b"".join(parts)


def _levels(codes: bytes) -> list[tuple[int, int, int, int]]:
    """Entries, and the offsets of chunks, bitmap and directory, of each level."""
    n = int(np.frombuffer(codes, np.uint32, 1)[0])
    sizes = np.frombuffer(codes, np.uint32, n, 4).tolist()
    out, at = [], 4 + 4 * n
    for size in sizes:
        bitmap = at + size
        directory = bitmap + -(-size // 8)
        out.append((size, at, bitmap, directory))
        at = directory + 4 * -(-size // _BLOCK)
    return out


def size(codes: bytes) -> int:
    """The number of ids."""
    return int(np.frombuffer(codes, np.uint32, 1, 4)[0])


def access(codes: bytes, i: int) -> int:
    """The id at place i, from one chunk a level and at most 64 bytes of bitmap each."""
    levels = _levels(codes)
    if not 0 <= i < levels[0][0]:
        raise IndexError(i)
    value = 0
    for k, (_, at, bitmap, directory) in enumerate(levels):
        value |= codes[at + i] << (WIDTH * k)
        if k + 1 == len(levels) or not codes[bitmap + i // 8] >> (i % 8) & 1:
            break
        block = i // _BLOCK
        rank = int.from_bytes(codes[directory + 4 * block : directory + 4 * block + 4], "little")
        start = block * _BLOCK // 8
        ones = int.from_bytes(codes[bitmap + start : bitmap + i // 8 + 1], "little") & ((1 << (i - block * _BLOCK)) - 1)
        i = rank + ones.bit_count()
    return value


def decode(codes: bytes) -> np.ndarray:
    """All ids."""
    levels = _levels(codes)
    values = None
    for k in range(len(levels) - 1, -1, -1):
        n, at, bitmap, _ = levels[k]
        low = np.frombuffer(codes, np.uint8, n, at).astype(np.uint32)
        if values is not None:
            more = np.unpackbits(np.frombuffer(codes, np.uint8, -(-n // 8), bitmap), count=n, bitorder="little").astype(bool)
            low[more] |= values << np.uint32(WIDTH)
        values = low
    return values


def _encode_texts(path: str):
    def of(batches):
        tokenizer = chunks(path)
        for batch in batches:
            counts, codes = [], []
            for text in batch.column(1).to_pylist():
                if text is None:
                    counts.append(None), codes.append(None)
                else:
                    ids = tokenizer.encode(text)
                    counts.append(len(ids)), codes.append(encode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(codes, pa.binary())], names=["doc_id", "n_tokens", "codes"])

    return of


def token_codes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, codes), one row for each row of ``docs``, in one pass without a shuffle.

    A null text gives nulls, an empty one 0 and codes without entries; null and repeated doc_ids pass through. Further
    columns are dropped. An empty table gives an empty result. ``tokenizer`` is the path of a rank file that all executors can read.
    """
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode_texts(tokenizer), "doc_id long, n_tokens int, codes binary")


def token_at(codes: pa.ChunkedArray | list, places: list[int]) -> list[int]:
    """For a few codes, the ids at the places."""
    return [access(c, i) for c, i in zip(codes, places)]


def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
