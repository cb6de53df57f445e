"""What the text operators share: reading tables, adding Arrow columns, words and hashes of byte buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evencut.functions.loop import materialize, new_path, shared_dir

__all__ = ["materialize", "new_path", "shared_dir"]

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 2 << 20  # bytes of text that numpy works on at once; a longer text is a chunk of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, with underscores in front until no column has that name in any case."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def give_back() -> None:
    """Returns freed memory to the system."""
    import ctypes

    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run for mapInArrow, after which the Python worker gives freed memory back: idle workers stay with their executor."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def slices(batches, rows: int):
    """The batches in pieces of at most so many rows."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def with_column(docs: DataFrame, name: str, kind: T.DataType, make, replace: bool = False) -> DataFrame:
    """docs with one more column (or the last one made anew); make maps a record batch to a list or array of as many values."""
    old = docs.schema.fields[: len(docs.columns) - replace]
    schema = T.StructType([*old, T.StructField(name, kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches):
        for b in slices(batches, 2500):
            made = make(b)
            made = made.cast(arrow) if isinstance(made, pa.Array) else pa.array(made, arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(old)], made], names=[*[f.name for f in old], name])

    return docs.mapInArrow(lean(run), schema)


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null texts are empty."""
    big = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string())
    if big.null_count:
        big = big.fill_null("")
    off = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1] if len(big) else np.zeros(1, np.int64)
    data = np.frombuffer(big.buffers()[2], np.uint8) if big.buffers()[2] is not None and big.buffers()[2].size else np.zeros(0, np.uint8)
    return data, off


def chunks(col: pa.Array, most: int = CHUNK):
    """(first row, bytes, offsets from 0) of runs of whole texts, of about most bytes each."""
    data, off = buffer(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where inside holds; a run never crosses a text's border."""
    n = len(inside)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    cut = off[(off >= 0) & (off <= n)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[cut] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text in which each byte position lies."""
    return np.searchsorted(off, at, "right") - 1


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """64-bit hashes of any byte spans of a buffer: polynomial sums of per-byte random values."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[:n], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))

    def every(self, k: int) -> np.ndarray:
        """The hash of each k bytes, at each start."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def held_out(id_col: str, mod: int, rest: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == rest


def training(labels: DataFrame, target: str, most: int | None, held) -> DataFrame:
    """(doc_id, y): labelled rows outside the held-out part, one per doc_id; of more than most (if given), those whose hash falls under most / count."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~F.coalesce(held, F.lit(True)))
    rows = rows.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    n = rows.count() if most is not None else 0
    if most is not None and n > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return rows
