"""What the operators share: column picking, the shared folder, word hashing, Arrow helpers.

Words.  Everywhere in this subpackage a *word* is a white-space separated piece of the
lower-cased text with everything but letters and digits removed; pieces that become empty
are dropped.  ``None`` and blank texts have no words.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast as 64-bit keys (about 100 MB in the JVM); beyond it the side is shuffled.
BROADCAST_ROWS = 2_000_000
#: Entries of a worker's word cache before it is emptied; bounds memory, never changes a result.
CACHE_ENTRIES = 200_000
#: Rows that go to a Python worker at once, at most: texts can be long. A session that has fewer keeps them.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Have the session send texts to Python in batches of at most BATCH_ROWS."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what this process has freed to the system; idle workers would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns of ``df``, found by their exact spelling.

    Other columns, also ones that differ in case only or share an internal name, are dropped first
    by position, so they can't clash.  Of several columns with one name the first counts.
    """
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    small_batches(df)
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{at[n]}").alias(n) for n in names])


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns ``_0``, ``_1``, ... and the new name of each of ``names``; ``toDF(*df.columns)`` undoes it."""
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    small_batches(df)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), {n: f"_{at[n]}" for n in names}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session; where it is unset, one of our own in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="xylem-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: What ``cut`` has written in this process.
_WRITTEN: list[str] = []


def swept(result: DataFrame, kept: int = 0) -> DataFrame:
    """``result``, of ``cut``, after all that ``cut`` wrote before it is deleted, but for the first ``kept`` folders. To be called once nothing else is read from them."""
    spark = result.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = _WRITTEN[kept:-1]
    del _WRITTEN[kept:-1]
    for x in gone:
        path(x).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(x), True)
    return result


def written() -> int:
    """How many folders of ``cut`` there are."""
    return len(_WRITTEN)


def cut(df: DataFrame, *partition_by: str, row_group: int | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends here and its size is known.

    ``row_group``: bytes of a row group, about, for large rows (Parquet's own choice is 128 MB).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/xylem-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    writer = df.write.option("compression", "zstd")
    if row_group:
        writer = writer.option("parquet.block.size", row_group).option("parquet.page.size.row.check.min", 10)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def semi_or_anti(df: DataFrame, keys: DataFrame, on: Column, how: str, n_keys: int) -> DataFrame:
    """Join ``df`` with ``keys`` (``left_semi`` or ``left_anti``): broadcast up to BROADCAST_ROWS keys, else shuffled."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, on, how)


_NOT_WORD = re.compile(r"[\W_]+").sub
#: Bytes of text that are worked on at once, but for a longer text.
_CHUNK_BYTES = 400_000
#: Bytes of a column that are lower-cased at once, about.
_SLICE_BYTES = 4_000_000
#: Of each byte, 0: ignored, 1: part of a word, 2: white space. Bytes of letters beyond ASCII are parts of words.
_KIND = np.zeros(256, np.uint8)
_KIND[[i for i in range(128) if chr(i).isalnum()]] = 1
_KIND[128:] = 1
_KIND[[i for i in range(128) if chr(i).isspace()]] = 2
#: First bytes of UTF-8 characters that needn't be letters; texts with one take the slower way.
_DOUBT = np.zeros(256, bool)
_DOUBT[0xC0:0xC3] = _DOUBT[0xC9:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?;:,")] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of the multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 2 * len(_POWERS[k])), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def run_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of values[lo:hi] for each pair of ends: the same for the same run of values, wherever it lies."""
    p, q = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=prefix[1:])
    return mix((prefix[hi] - prefix[lo]) * q[lo] + (hi - lo).astype(np.uint64))


def _doubtful(text: str) -> str:
    """A text whose words are the same and that holds nothing but letters, digits, white space and sentence ends."""
    out = []
    for line in text.split("\n"):
        pieces = []
        for piece in line.split():
            word = _NOT_WORD("", piece)
            pieces.append(word + piece[-1] if piece[-1] in ".!?;:," else word)
        out.append(" ".join(pieces))
    return "\n".join(out)


def _hash_chunk(data: np.ndarray, edges: np.ndarray, ends: bool, stems: tuple[int, ...] = ()):
    """Word hashes of all texts in ``data``, each text's first word, and whether a sentence ends with each word; with ``stems`` a row of hashes each."""
    kind = _KIND[data]
    keep = kind == 1
    gap = (kind == 2).astype(np.int32)
    starts = edges[:-1][edges[:-1] < len(data)]
    gap[starts] += 1
    at = np.flatnonzero(keep)
    group = np.cumsum(gap)[at]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    bounds = np.append(first, len(at))
    values = data[at].astype(np.uint64) + np.uint64(1)
    h = run_hashes(values, bounds[:-1], bounds[1:])
    h[h == 0] = 1
    if stems:
        h = np.stack([h, *(mix(run_hashes(values, bounds[:-1], np.minimum(bounds[:-1] + n, bounds[1:])) + np.uint64(n)) for n in stems)])
    begins = at[first]
    of = np.searchsorted(begins, edges)
    if not ends:
        return h, of, None
    mark = data == 10
    stop = np.flatnonzero(_STOP[data])
    after = np.append(kind, 2)[stop + 1] == 2
    after |= np.isin(stop + 1, edges)
    mark[stop[after]] = True
    marks = np.concatenate([[0], np.cumsum(mark)])
    end = marks[np.append(begins[1:], len(data))[: len(begins)]] > marks[begins]
    last = of[1:][of[1:] > of[:-1]] - 1
    end[last] = True
    return h, of, end


def word_arrays(column: pa.Array, ends: bool = False) -> list:
    """All of ``each_word_array`` at once."""
    return list(each_word_array(column, ends))


def each_word_array(column: pa.Array, ends: bool = False, stems: tuple[int, ...] = ()) -> Iterator:
    """For each text of an Arrow column the hashes of its words, in order; with ``ends`` also whether a sentence ends there.

    With ``stems`` a matrix: the words in the first row, then for each number the words' beginnings of so many bytes.

    A sentence ends with a white-space separated piece whose last character is one of ``. ! ? ; : ,``, with a line, and with the text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = min(len(column), 1 + column.nbytes // _SLICE_BYTES)
    if parts > 1:
        edges = [len(column) * k // parts for k in range(parts + 1)]
        for a, b in zip(edges, edges[1:]):
            yield from each_word_array(column[a:b], ends, stems)
        return
    lower = pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "")
    edges = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, 8 * lower.offset)
    data = np.frombuffer(lower.buffers()[2], np.uint8) if lower.buffers()[2] is not None else np.empty(0, np.uint8)
    lo, n = 0, len(lower)
    if n > 1:
        give_back()
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + _CHUNK_BYTES, "right")) - 1)
        part, local = data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo]
        odd = np.flatnonzero(_DOUBT[part]) if len(part) else part
        odd = np.union1d(odd, _signs(part)) if len(part) else odd
        if len(odd):
            texts = lower[lo:hi].to_pylist()
            for k in np.unique(np.searchsorted(local, odd, "right") - 1):
                texts[k] = _doubtful(texts[k])
            raw = [t.encode() for t in texts]
            part = np.frombuffer(b"".join(raw), np.uint8)
            local = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        h, of, end = _hash_chunk(part, local, ends, stems)
        of = of.tolist()
        for a, b in zip(of, of[1:]):
            yield (h[a:b], end[a:b]) if ends else h[..., a:b]
        lo = hi


def _signs(data: np.ndarray) -> np.ndarray:
    """Places of the two signs among the letters that begin with byte C3."""
    at = np.flatnonzero(data[:-1] == 0xC3)
    return at[(data[at + 1] == 0x97) | (data[at + 1] == 0xB7)]


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of the words of one text, in order."""
    return word_arrays(pa.array([text], pa.string()))[0]


_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> _S29)
    h = h * _M2
    return h ^ (h >> _S32)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; of fewer words, one of the whole run."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    m = len(words) - n + 1
    h = words[:m] + np.uint64(n)
    for k in range(1, n):
        h = h * _M + words[k : m + k]
    return mix(h)


def set_hash(grams: np.ndarray) -> int:
    """One signed 64-bit value for a sorted array of distinct hashes."""
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)
