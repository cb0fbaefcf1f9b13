"""Resampling: a replicate is one more key, a draw is a row number.

Draws are 52 bits of md5(seed:replicate:position), so they need no state, agree between runs and
engines, and come back after a lost task; they do not depend on the series, so all series of a task share them.
A task holds a unit of series as places in tables of their distinct values and draws a share of the replicates, each hashed once for all of them and folded
over every series a lap at a time (`replicates`): no join, no sort and no window for a replicate. Series longer than LONGEST values go another way to the same
results: draws are rows that meet the series in a join, gathered into blocks, whose products, peaks and
drawdowns compose (`path_metrics`).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.scratch import scratch_folder

LONGEST = 1 << 26
"""Values of a series that a task holds as an array (512 MB)."""
UNIT_VALUES = 1 << 25
"""Numbers of eight bytes that the series take that are folded together, on average (256 MB; coded series have eight times as many values): draws are hashed once a unit."""
LAP, STEP = 1 << 20, 1 << 14
"""Positions that are hashed before the series take them up one by one, and that are folded in one go."""
CODES = 1 << 16
"""Most distinct values of a series that is held as places in a table of them."""
RUIN = -40.0
"""A drawdown in logarithms that no double tells from a total loss."""
CHUNK = 8192
"""Values of a series in a row on their way to the tasks."""
PATH_BLOCK = 4096
"""Positions of a replicate in a block, where the series is too long for an array."""
SMALL_SERIES = 1_000_000
"""A table of series is broadcast if it has been counted to have no more rows (about 100 MB)."""


def with_bits(rows: DataFrame, i: Column, seed: int) -> DataFrame:
    """rows (rep, ...) with _bits: 52 random bits for each replicate and i."""
    text = F.concat(F.lit(f"{seed}:"), F.col("rep").cast("string"), F.lit(":"), i.cast("string"))
    return rows.withColumn("_bits", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"))


def with_draw(rows: DataFrame, i: Column, n: Column, seed: int) -> DataFrame:
    """rows with src: a position from 0 to n - 1 for each replicate and i."""
    return with_bits(rows, i, seed).withColumn("src", F.col("_bits") % n).drop("_bits")


def with_uniform(rows: DataFrame, i: Column, seed: int, name: str) -> DataFrame:
    """rows with a number in [0, 1)."""
    return with_bits(rows, i, seed).withColumn(name, F.col("_bits") / float(1 << 52)).drop("_bits")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """keys, pos (from 0), n and v."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return rows.select(*keys, (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(w).alias("n"), F.col(value).alias("v"))


def _slots(series: DataFrame, keys: Sequence[str], reps: int) -> DataFrame:
    """One row for each key, replicate and position."""
    sizes = series.groupBy(*keys).agg(F.max("n").alias("n")) if keys else series.agg(F.max("n").alias("n")).where("n is not null")
    rows = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(*keys, "rep")
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))


def _by_keys(rows: DataFrame, side: DataFrame, keys: Sequence[str], also: Sequence[str] = (), few: bool = False) -> DataFrame:
    """rows with the other columns of side, which has one row for equal keys; null keys meet each other."""
    own = [*keys, *also]
    named = side.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(own)), *(c for c in side.columns if c not in own))
    named = F.broadcast(named) if few else named.hint("shuffle_merge")
    if not own:
        return rows.join(F.broadcast(named))  # one row
    same = [rows[c].eqNullSafe(named[f"_k{i}"]) for i, c in enumerate(own)]
    return rows.join(named, same).drop(*(f"_k{i}" for i in range(len(own))))


def _take(slots: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Beside a broadcast series the slots stay where they are, all of a replicate in one partition.
    values = series.select(*keys, F.col("pos").alias("src"), "v")
    return _by_keys(slots, values, keys, ["src"], values.count() <= SMALL_SERIES)


def iid(series: DataFrame, keys: Sequence[str], reps: int, seed: int) -> DataFrame:
    """keys, rep, i, v: each position drawn from all."""
    slots = with_draw(_slots(series, keys, reps), F.col("i"), F.col("n"), seed)
    return _take(slots, series, keys)


def circular_blocks(series: DataFrame, keys: Sequence[str], reps: int, block: int, seed: int) -> DataFrame:
    """Blocks from random starts, wrapping round."""
    b = F.expr(f"i div {block}")
    slots = with_draw(_slots(series, keys, reps), b, F.col("n"), seed).withColumn("src", F.pmod(F.col("src") + F.pmod(F.col("i"), F.lit(block)), F.col("n")))
    return _take(slots, series, keys)


def plain_blocks(series: DataFrame, keys: Sequence[str], reps: int, block: int, seed: int) -> DataFrame:
    """Blocks from starts at which a whole block fits; positions keep their place in time."""
    b, room = F.expr(f"i div {block}"), F.greatest(F.col("n") - block + 1, F.lit(1))
    slots = with_draw(_slots(series, keys, reps), b, room, seed).withColumn("src", F.least(F.col("src") + F.pmod(F.col("i"), F.lit(block)), F.col("n") - 1))
    return _take(slots, series, keys)


def _blocks_at_most(n: int, mean_block: float) -> int:
    """Blocks that are drawn; the last of them runs to the end (eight deviations beyond the mean number)."""
    return math.ceil(n / mean_block + 8 * math.sqrt(n / mean_block)) + 64


def stationary(series: DataFrame, keys: Sequence[str], reps: int, mean_block: float | None, seed: int) -> DataFrame:
    """Blocks of geometric length; mean_block None: the cube root of the length.

    Starts and lengths are drawn once a block, lengths by inverse transform; positions follow from their prefix sums.
    """
    length = F.lit(float(mean_block)) if mean_block else F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    sizes = series.groupBy(*keys).agg(F.max("n").alias("n")) if keys else series.agg(F.max("n").alias("n")).where("n is not null")
    rows = sizes.withColumn("_l", length).withColumn("_most", (F.ceil(F.col("n") / F.col("_l") + 8 * F.sqrt(F.col("n") / F.col("_l"))) + 64).cast("long"))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(*keys, "rep")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1)))
    rows = with_uniform(rows, F.col("k"), seed + 1, "_u")
    drawn = F.when(F.col("_l") <= 1, 1).otherwise(1 + F.floor(F.log(1 - F.col("_u")) / F.log(1 - 1 / F.col("_l"))))
    rows = rows.withColumn("_len", F.when(F.col("k") == F.col("_most") - 1, F.col("n")).otherwise(F.least(drawn, F.col("n"))).cast("long"))
    upto = Window.partitionBy(*keys, "rep").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum("_len").over(upto), F.lit(0).cast("long"))).where("_first < n")
    rows = with_draw(rows, F.col("k"), F.col("n"), seed)
    slots = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_len", F.col("n") - F.col("_first")) - 1)))
    slots = slots.select(*keys, "n", "rep", (F.col("_first") + F.col("_o")).alias("i"), F.pmod(F.col("src") + F.col("_o"), F.col("n")).alias("src"))
    return _take(slots, series, keys)


@dataclass(frozen=True)
class Draw:
    """How a replicate is drawn: iid, circular or plain blocks, or stationary (block None: the cube root of the length).

    Stressed: every value less half the mean absolute value that all replicates draw times (multiple - 1); one in ten loses slip more.
    """

    kind: str
    block: float | None = None
    multiple: float = 1.0
    slip: float = 0.0

    @property
    def plain(self) -> Draw:
        return replace(self, multiple=1.0, slip=0.0)


_MD5_SHIFTS = [x for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in r * 4]
_MD5_WORDS = [k if r == 0 else (5 * k + 1) % 16 if r == 1 else (3 * k + 5) % 16 if r == 2 else 7 * k % 16 for r in range(4) for k in range(16 * r, 16 * r + 16)]
_MD5_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_LANES = 80_000
_MD5_MOVES = [(np.array(x, np.uint32), np.array(32 - x, np.uint32)) for x in _MD5_SHIFTS]
_LOW_DIGITS = 4


@cache
def _endings(digits: int) -> np.ndarray:
    """The numbers of so many digits (at most _LOW_DIGITS, with leading zeros) as text, and the mark that ends a message."""
    i = np.arange(10**digits, dtype=np.uint64)
    out = np.full(len(i), 0x80 << 8 * digits, np.uint64)
    for k in range(digits):
        out |= (i // np.uint64(10 ** (digits - 1 - k)) % np.uint64(10) + np.uint64(48)) << np.uint64(8 * k)
    return out


def _message(head: bytes, first: int, n: int, digits: int) -> list[int | np.ndarray]:
    """The sixteen words of head + i for n numbers i from first, all of so many digits; a word that all have is one number."""
    low = min(digits, _LOW_DIGITS)
    lead = np.arange(first // 10**low, (first + n - 1) // 10**low + 1)
    texts = [head + (b"%d" % q if digits > low else b"") for q in lead.tolist()]
    size = len(texts[0])
    rows = np.frombuffer(b"".join(t.ljust(56, b"\0") + ((size + low) * 8).to_bytes(8, "little") for t in texts), "<u4").reshape(-1, 16)
    count = np.minimum((lead + 1) * 10**low, first + n) - np.maximum(lead * 10**low, first)
    word = [int(x[0]) if (x == x[0]).all() else np.repeat(x, count) for x in rows.T]
    ending = np.resize(np.roll(_endings(low), -(first % 10**low)), n) << np.uint64(8 * (size % 4))
    at = size // 4
    word[at] = word[at] | (ending & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    if size % 4 + low >= 4:
        word[at + 1] = word[at + 1] | (ending >> np.uint64(32)).astype(np.uint32)
    return word


def _md5_bits(head: bytes, first: int, n: int, digits: int) -> np.ndarray:
    """The first 52 bits of md5(head + i) for n numbers i from first, all of so many digits, one array for each word of the hash."""
    word = _message(head, first, n, digits)
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, f), np.bitwise_and(b, f, f), np.bitwise_xor(d, f, f)
        elif k < 32:
            np.bitwise_xor(b, c, f), np.bitwise_and(d, f, f), np.bitwise_xor(c, f, f)
        elif k < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f), np.bitwise_or(b, f, f), np.bitwise_xor(c, f, f)
        np.add(a, f, f)
        own = word[_MD5_WORDS[k]]
        if isinstance(own, int):
            np.add(f, np.array((own + _MD5_SINES[k]) % 2**32, np.uint32), f)
        else:
            np.add(f, own, f), np.add(f, np.array(_MD5_SINES[k], np.uint32), f)
        left, right = _MD5_MOVES[k]
        np.left_shift(f, left, t), np.right_shift(f, right, f), np.bitwise_or(f, t, f)
        np.add(f, b, a)
        a, b, c, d = d, a, b, c
    high, low = ((x + np.uint32(y)).byteswap().astype(np.uint64) for x, y in ((a, _MD5_START[0]), (b, _MD5_START[1])))
    return ((high << np.uint64(32) | low) >> np.uint64(12)).view(np.int64)


def _bits_between(seed: int, rep: int, first: int, end: int) -> np.ndarray:
    """52 random bits for each position from first to end - 1, as with_bits draws them."""
    have, i = np.empty(end - first, np.int64), first
    while i < end:
        digits = len(str(i))
        j = min(end, i + _MD5_LANES, 10**digits)
        have[i - first : j - first] = _md5_bits(b"%d:%d:" % (seed, rep), i, j - i, digits)
        i = j
    return have


class Bits:
    """52 random bits by seed, replicate and position, as with_bits draws them."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def of(self, seed: int, rep: int, n: int) -> np.ndarray:
        have = self.held.get((seed, rep))
        if have is None or len(have) < n:
            have = self.held[seed, rep] = _bits_between(seed, rep, 0, n)
        return have[:n]


def _modulo(bits: np.ndarray, n: int) -> np.ndarray:
    """bits % n; numpy divides by one number faster than it takes remainders."""
    out = bits // n
    out *= -n
    out += bits
    return out


def _lengths(n: int, mean_block: float | None, bits: Bits, seed: int, rep: int) -> tuple[np.ndarray, float]:
    size = mean_block or n ** (1 / 3)
    most = _blocks_at_most(n, size)
    u = bits.of(seed + 1, rep, most) / float(1 << 52)
    own = np.ones(most) if size <= 1 else 1 + np.floor(np.log(1 - u) / math.log(1 - 1 / size))
    own[-1] = n
    own = np.minimum(own, n).astype(np.int64)
    ends = np.cumsum(own)
    k = int(np.searchsorted(ends, n)) + 1
    own = own[:k]
    own[-1] -= ends[k - 1] - n
    return own, size


def drawn(draw: Draw, v: np.ndarray, bits: Bits, seed: int, rep: int, size: float = 0.0) -> np.ndarray:
    """One replicate of a series; size: the mean absolute value that stress takes its share of."""
    n = len(v)
    if draw.kind == "iid":
        src = _modulo(bits.of(seed, rep, n), n)
    elif draw.kind == "stationary":
        own, _ = _lengths(n, draw.block, bits, seed, rep)
        start = bits.of(seed, rep, len(own)) % n
        src = _modulo(np.repeat(start - (np.cumsum(own) - own), own) + np.arange(n), n)
    else:
        block = int(draw.block)
        start = bits.of(seed, rep, -(-n // block)) % (n if draw.kind == "circular" else max(n - block + 1, 1))
        src = (start[:, None] + np.arange(block)).ravel()[:n]
        src = _modulo(src, n) if draw.kind == "circular" else np.minimum(src, n - 1)
    out = v.take(src)
    if draw != draw.plain:
        u = bits.of(seed + 2, rep, n) / float(1 << 52)
        out = out - size * (draw.multiple - 1) * 0.5 - np.where(u < 0.1, draw.slip, 0.0)
    return out


PATH_FIELDS = ("final", "mdd", "mean", "std")


def path_fold(v: np.ndarray) -> tuple[float | None, ...]:
    """Final equity, greatest drawdown (the start counts), mean and deviation.

    While no value loses everything, equity is a sum of logarithms: products of long series underflow, and arithmetic on such numbers is slow.
    """
    mean, std = v.mean(), v.std(ddof=1) if len(v) > 1 else None
    if v.min() > -1:
        equity = np.log1p(v)
        np.cumsum(equity, out=equity)
        peak = np.maximum.accumulate(equity)
        np.maximum(peak, 0.0, out=peak)
        with np.errstate(over="ignore"):
            final = np.exp(equity[-1])
        equity -= peak
        return final, min(0.0, np.expm1(equity.min())), mean, std
    equity = 1 + v
    np.cumprod(equity, out=equity)
    final = equity[-1]
    peak = np.maximum.accumulate(equity)
    np.maximum(peak, 1.0, out=peak)
    equity /= peak
    return final, min(0.0, equity.min() - 1), mean, std


@dataclass
class Coded:
    """A series as places in a table of its distinct values, or (codes None) the values alone; it goes on from its start, and ends in its last two values for positions -2 and -1."""

    n: int
    table: np.ndarray
    codes: np.ndarray | None

    def values(self) -> np.ndarray:
        return (self.table if self.codes is None else self.table.take(self.codes))[: self.n]


def coded(pieces: list[tuple[np.ndarray, bytes | None]], beyond: int) -> Coded:
    """A series from its chunks, each as _encoded() gives it; beyond: positions that draws may stand behind its end."""
    wrapped = lambda x: np.concatenate([np.resize(x, len(x) + beyond + 2), np.resize(x[::-1], 2)[::-1]])
    table = np.unique(np.concatenate([v for v, c in pieces if c is not None] or [np.zeros(0)]))
    read = lambda v, c: np.frombuffer(c, np.uint8 if len(v) <= 256 else np.uint16)
    if len(table) > CODES or any(c is None for _, c in pieces):
        whole = np.concatenate([v if c is None else v.take(read(v, c)) for v, c in pieces])
        return Coded(len(whole), wrapped(whole), None)
    kind = np.uint8 if len(table) <= 256 else np.uint16
    whole = np.concatenate([np.searchsorted(table, v).astype(kind).take(read(v, c)) for v, c in pieces])
    return Coded(len(whole), table, wrapped(whole))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk as its distinct values and places in them; as its values where most are distinct."""
    for batch in batches:
        values, codes = [], []
        for p in batch.column("v"):
            v = np.array(x, float) if (x := p.values).null_count else x.to_numpy()
            own, at = np.unique(v, return_inverse=True)
            few = 2 * len(own) <= len(v)
            values.append(own if few else v)
            codes.append(at.astype(np.uint8 if len(own) <= 256 else np.uint16).tobytes() if few else None)
        rest = batch.drop_columns(["v"])
        yield pa.record_batch([*rest.columns, pa.array(values, pa.list_(pa.float64())), pa.array(codes, pa.binary())], names=[*rest.schema.names, "values", "codes"])


def _sources(draw: Draw, n: int, bits: np.ndarray, first: int, end: int) -> np.ndarray:
    """Positions drawn for those from first on, as Coded takes them (-1 to n + block); bits as numbers, of positions or (in blocks) of blocks from first on."""
    # A quotient that rounding takes over a whole number gives -1 or n, which Coded holds as well.
    q = np.multiply(bits, 1.0 / n)
    np.floor(q, q), np.multiply(q, n, q), np.subtract(bits, q, q)
    src = q.astype(np.int64)
    if draw.kind == "iid":
        return src
    block = int(draw.block)
    return (src[:, None] + np.arange(block)).ravel()[: end - first]


class Path:
    """One draw of a series, folded a step at a time: equity in logarithms, moments about the series' mean, absolute values."""

    def __init__(self, draw: Draw, one: Coded, size: float, fields: Sequence[str]):
        own = [one.table]
        if draw != draw.plain:
            lower = one.table - size * (draw.multiple - 1) * 0.5
            own = [lower - 0.0, lower - draw.slip]
        self.table, self.n, self.slips = np.concatenate(own), one.n, len(own) > 1
        self.able = bool(self.table.min(initial=np.inf) > -1)
        self.fields = fields
        path, moments = {"final", "mdd"} & set(fields), {"mean", "std"} & set(fields)
        with np.errstate(all="ignore"):
            self.logs = np.log1p(self.table) if path else None
        self.middle = float(self.table.mean()) if moments else 0.0
        self.off = self.table - self.middle if moments else None
        self.sizes = np.abs(self.table) if "_size" in fields else None
        self.start()

    def start(self) -> None:
        self.equity = self.peak = self.worst = self.sum = self.squares = self.total = 0.0

    def take(self, at: np.ndarray, out: np.ndarray) -> None:
        """at: places in the table; out: two rows of numbers to work in."""
        x, peak = out[0, : len(at)], out[1, : len(at)]
        if self.logs is not None:
            self.logs.take(at, out=x, mode="clip")
            if self.worst > RUIN:
                x[0] += self.equity
                np.cumsum(x, out=x)
                self.equity = float(x[-1])
                np.maximum.accumulate(x, out=peak)
                np.maximum(peak, self.peak, out=peak)
                self.peak = float(peak[-1])
                x -= peak
                self.worst = min(self.worst, float(x.min()))
            else:
                self.equity += float(x.sum())
        if self.off is not None:
            self.off.take(at, out=x, mode="clip")
            self.sum += float(x.sum())
            self.squares += float(np.dot(x, x))
        if self.sizes is not None:
            self.total += float(self.sizes.take(at, out=x, mode="clip").sum())

    def facts(self) -> tuple[float | None, ...]:
        off = self.sum / self.n
        with np.errstate(over="ignore"):
            known = {"final": float(np.exp(self.equity)), "mdd": min(0.0, float(np.expm1(self.worst))), "mean": self.middle + off, "_size": self.total / self.n}
        known["std"] = math.sqrt(max(0.0, self.squares - off * self.sum) / (self.n - 1)) if self.n > 1 else None
        return tuple(known[f] for f in self.fields)


def folded(series: list[Coded], paths: list[dict[str, Path]], draws: dict[str, Draw], seed: int, rep: int) -> None:
    """One replicate of every series, iid or in circular blocks: positions go by laps that are hashed once, a lap by steps of a series."""
    longest, work, base = max(x.n for x in series), np.empty((2, STEP)), np.empty(STEP, np.int64)
    blocks = {d.plain: int(d.block or 1) for d in draws.values()}
    lap = max(STEP, LAP // math.prod(set(blocks.values())) * math.prod(set(blocks.values())))
    for first in range(0, longest, lap):
        end = min(first + lap, longest)
        bits = {d: _bits_between(seed, rep, first // b, -(-end // b)).astype(float) for d, b in blocks.items()}
        slips = _bits_between(seed + 2, rep, first, end) < 0.1 * (1 << 52) if any(d != d.plain for d in draws.values()) else None
        for one, own in zip(series, paths, strict=True):
            for d, b in blocks.items():
                step = max(1, STEP // b) * b
                for i in range(first, min(end, one.n), step):
                    j = min(i + step, end, one.n)
                    at = _sources(d, one.n, bits[d][(i - first) // b : -(-(j - first) // b)], i, j)
                    if one.codes is not None:
                        at = one.codes.take(at, mode="wrap").astype(np.int64)
                    else:
                        np.add(at, len(one.table), out=at, where=at < 0)
                    for name, draw in draws.items():
                        if draw.plain == d and name in own:
                            path = own[name]
                            if path.slips:
                                moved = np.multiply(slips[i - first : j - first], len(one.table), out=base[: j - i])
                                moved += at
                            path.take(moved if path.slips else at, work)


def replicates(series: DataFrame, keys: Sequence[str], reps: int, draws: dict[str, Draw], seed: int, fold: Callable[[np.ndarray], tuple] | None = None, fields: Sequence[str] = PATH_FIELDS) -> DataFrame:
    """keys, method, rep and fields of each replicate, for each series of at most LONGEST values: those of a path, or what fold makes of the values. series as numbered() gives it, written out."""
    spark, place = series.sparkSession, scratch_folder(series.sparkSession, "coded")
    chunk = F.expr(f"cast(pos as long) div {CHUNK}").alias("_chunk")
    own = series.where(F.col("n") <= LONGEST).groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).getField("v").cast("array<double>").alias("v"))
    kinds = dict(series.dtypes)
    named = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    form = named + "_chunk long, values array<double>, codes binary"
    own.mapInArrow(_encoded, form).write.parquet(place)
    own = spark.read.schema(form).parquet(place)
    total = own.agg(F.sum(F.coalesce(F.octet_length("codes"), F.lit(0)) + 8 * F.size("values"))).first()[0] or 0
    stressed = next((d.plain for d in draws.values() if d != d.plain), None)
    if stressed:
        # Written out: to deal by ranges, Spark runs what comes before twice.
        _replicates(own, total, keys, named, reps, {"": stressed}, seed, None, ("_size",)).groupBy(*keys).agg(F.avg("_size").alias("_size")).write.parquet(f"{place}-sizes")
        sizes = spark.read.parquet(f"{place}-sizes")
        own = _by_keys(own, sizes, keys, few=sizes.count() <= SMALL_SERIES)
    return _replicates(own, total, keys, named, reps, draws, seed, fold, fields)


def _replicates(own: DataFrame, total: int, keys: Sequence[str], named: str, reps: int, draws: dict[str, Draw], seed: int, fold: Callable[[np.ndarray], tuple] | None, fields: Sequence[str]) -> DataFrame:
    units = max(1, math.ceil(total / (8 * UNIT_VALUES)))
    parts = min(reps, max(1, math.ceil(2 * own.sparkSession.sparkContext.defaultParallelism / units)))
    each = own.withColumn("_unit", F.pmod(F.xxhash64(*keys) if keys else F.lit(0), F.lit(units)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = named + ", ".join(["method string", "rep int", *(f"`{f}` double" for f in fields)])
    beyond = max(int(d.block or 1) for d in draws.values())
    by_laps = fold is None and all(d.kind in ("iid", "circular") for d in draws.values())
    if not by_laps and "_size" in fields:
        fold = lambda v: (np.abs(v).mean(),)
    pick = fold or (lambda v: tuple(x for f, x in zip(PATH_FIELDS, path_fold(v), strict=True) if f in fields))

    def work(table: pa.Table) -> pa.Table:
        part, found = table["_part"][0].as_py(), {}
        for at, (*own_keys, k) in enumerate(zip(*(table[c].to_pylist() for c in keys), table["_chunk"].to_pylist(), strict=True)):
            found.setdefault(tuple(own_keys), []).append((k, at))
        places = [[at for _, at in sorted(x)] for x in found.values()]
        places.sort(key=lambda x: -len(x))
        series = [coded([(table["values"][at].values.to_numpy(), c.as_py() if (c := table["codes"][at]).is_valid else None) for at in x], beyond) for x in places]
        size = table["_size"].take(pa.array([x[0] for x in places], pa.int64())).to_pylist() if "_size" in table.column_names else [0.0] * len(series)
        paths = [{name: p for name, draw in draws.items() if (p := Path(draw, one, s, fields)).able or "_size" in fields} if by_laps else {} for one, s in zip(series, size, strict=True)]
        values = [one.values() if len(own) < len(draws) else None for one, own in zip(series, paths, strict=True)]
        rows, bits = [], Bits()
        for rep in range(part, reps, parts):
            bits.held.clear()
            for own in paths:
                for path in own.values():
                    path.start()
            if any(paths):
                folded(series, paths, draws, seed, rep)
            for s, own in enumerate(paths):
                rows += [(s, name, rep, *(own[name].facts() if name in own else pick(drawn(draw, values[s], bits, seed, rep, size[s])))) for name, draw in draws.items()]
        at, method, rep_of, *told = zip(*rows, strict=True) if rows else ([],) * (3 + len(fields))
        picked = table.select(list(keys)).take(pa.array([places[s][0] for s in at], pa.int64()))
        columns = [*picked.columns, pa.array(method, pa.string()), pa.array(rep_of, pa.int32()), *(pa.array([None if x is None else float(x) for x in f], pa.float64()) for f in told)]
        return pa.table(columns, names=[*keys, "method", "rep", *fields])

    # A task for each group: they are few, of equal work, and small in bytes, so hashes would collide and tasks be merged.
    return each.repartitionByRange(2 * units * parts, "_unit", "_part").groupBy("_unit", "_part").applyInArrow(work, schema)


def draw_rows(draw: Draw, series: DataFrame, keys: Sequence[str], reps: int, seed: int) -> DataFrame:
    """The same draws as rows keys, rep, i, v."""
    if draw.kind == "iid":
        rows = iid(series, keys, reps, seed)
    elif draw.kind == "stationary":
        rows = stationary(series, keys, reps, draw.block, seed)
    else:
        rows = (circular_blocks if draw.kind == "circular" else plain_blocks)(series, keys, reps, int(draw.block), seed)
    if draw == draw.plain:
        return rows
    rows = _by_keys(rows, rows.groupBy(*keys).agg(F.avg(F.abs("v")).alias("_size")), keys)
    rows = with_uniform(rows, F.col("i"), seed + 2, "_u")
    return rows.withColumn("v", F.col("v") - F.col("_size") * (draw.multiple - 1) * 0.5 - F.when(F.col("_u") < 0.1, draw.slip).otherwise(0.0)).drop("_size", "_u")


def resampled_paths(series: DataFrame, keys: Sequence[str], reps: int, draws: dict[str, Draw], seed: int, fields: Sequence[str] = PATH_FIELDS) -> DataFrame:
    """keys, method, rep and fields (final, mdd, mean and std, or some of them in this order) of each replicate, over series of any length."""
    spark, place = series.sparkSession, scratch_folder(series.sparkSession, "series")
    series.select(*keys, "pos", "n", "v").write.parquet(place)
    series = spark.read.parquet(place)
    out = replicates(series, keys, reps, draws, seed, fields=fields)
    long = series.where(F.col("n") > LONGEST)
    if not long.limit(1).count():
        return out
    for name, draw in draws.items():
        out = out.unionByName(path_metrics(draw_rows(draw, long, keys, reps, seed), keys).withColumn("method", F.lit(name)).select(*out.columns))
    return out


def mean_interval(paths: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval of the replicates' means."""
    a = (1 - level) / 2
    return paths.groupBy(*keys).agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"), F.avg("mean").alias("mean"))


def bootstrap_mean(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, reps: int, seed: int, most: int | None = None) -> DataFrame:
    """Interval of a mean; most: a parameter to draw from at most so many rows of a key, chosen by a hash."""
    series = numbered(rows, keys, order, value)
    if most is not None:
        series = numbered(series.withColumn("h", F.xxhash64("pos", F.lit(seed))), keys, ["h", "pos"], "v").where(F.col("pos") < most).withColumn("n", F.least(F.col("n"), F.lit(most)))
    return mean_interval(resampled_paths(series, keys, reps, {"iid": Draw("iid")}, seed, ("mean",)), keys)


def _block_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of values with its product, highest and lowest product on the way."""
    for batch in batches:
        found = [np.cumprod(1 + np.array(v, float)) for v in batch.column("values").to_pylist()]
        for name, pick in (("product", lambda e: e[-1]), ("top", np.max), ("low", np.min)):
            batch = batch.append_column(name, pa.array([float(pick(e)) for e in found], pa.float64()))
        yield batch


def _block_falls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's greatest drawdown, from the equity and the peak before it."""
    for batch in batches:
        falls = []
        for v, before, peak in zip(batch.column("values").to_pylist(), batch.column("before").to_pylist(), batch.column("peak").to_pylist(), strict=True):
            equity = before * np.cumprod(1 + np.array(v, float))
            falls.append(float((equity / np.maximum(np.maximum.accumulate(equity), peak) - 1).min()))
        yield batch.append_column("fall", pa.array(falls, pa.float64()))


def path_metrics(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final equity, greatest drawdown, mean and deviation of every replicate of draws (keys, rep, i, v).

    No task holds a replicate: its positions are gathered in blocks, the equity before a block is the product of those before it.
    """
    own = [*keys, "rep"]
    kinds = dict(draws.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", b long, values array<double>"
    blocks = draws.groupBy(*own, F.expr(f"cast(i as long) div {PATH_BLOCK}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).getField("v").cast("array<double>").alias("values"))
    place = scratch_folder(draws.sparkSession, "blocks")
    facts = f"{schema}, product double, top double, low double"
    blocks.mapInArrow(_block_facts, facts).write.parquet(place)
    facts_of = draws.sparkSession.read.schema(facts).parquet(place)
    w = Window.partitionBy(*own).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("product")
    rows = facts_of.withColumns({"_log": F.sum(F.when(x != 0, F.log(F.abs(x)))).over(w), "_zero": F.max((x == 0).cast("int")).over(w), "_minus": F.sum((x < 0).cast("int")).over(w)})
    rows = rows.withColumn("before", F.when(F.col("_log").isNull() & F.col("_zero").isNull(), 1.0).when(F.col("_zero") == 1, 0.0).otherwise(F.exp("_log") * F.when(F.col("_minus") % 2 == 1, -1).otherwise(1)))
    reach = F.greatest(F.col("before") * F.col("top"), F.col("before") * F.col("low"))
    rows = rows.withColumn("peak", F.greatest(F.lit(1.0), F.max(reach).over(w))).select(*own, "b", "values", "product", "before", "peak")
    ends = rows.mapInArrow(_block_falls, f"{schema}, product double, before double, peak double, fall double")
    # sums of values and of their squares about the replicate's own mean come from the rows themselves
    moments = draws.groupBy(*own).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    out = ends.groupBy(*own).agg(F.max_by(F.col("before") * F.col("product"), "b").alias("final"), F.least(F.lit(0.0), F.min("fall")).alias("mdd"))
    return _by_keys(out, moments, own)


def resampled_rules(days: DataFrame, keys: Sequence[str], reps: int, draw: Draw, seed: int, daily_loss: float, total_loss: float, target: float, min_days: int) -> DataFrame:
    """keys, rep, violated_total, target_reached, violated_daily, final_pnl: account rules replayed over each replicate of a series of days, dates kept in order."""
    from barloom.operators import account

    spark, place = days.sparkSession, scratch_folder(days.sparkSession, "series")
    days.select(*keys, "pos", "n", "v").write.parquet(place)
    days = spark.read.parquet(place)
    rules = (float(daily_loss), float(total_loss), float(target), int(min_days))
    out = replicates(days, keys, reps, {"own": draw}, seed, lambda v: account.replay_days(v, *rules), account.REPLAY_FIELDS).drop("method")
    long = days.where(F.col("n") > LONGEST)
    if not long.limit(1).count():
        return out
    rows = account.replay(draw_rows(draw, long, keys, reps, seed), [*keys, "rep"], ["i"], F.col("i"), F.col("v"), *rules)
    return out.unionByName(rows.select(*keys, "rep", *(F.col(c).cast("double").alias(c) for c in account.REPLAY_FIELDS)))


def path_quantiles(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p5, p25, p50, p75 and p95 of both, by floor rank."""
    from barloom.functions.ranks import floor_rank

    wanted = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    each = paths.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in ("final", "mdd")))).alias("m"))
    return floor_rank(each.select(*keys, "m.metric", "m.x"), [*keys, "metric"], "x", wanted, bounded=True)


STRESSED = Draw("iid", None, 2.0, 0.001)


def all_methods(series: DataFrame, keys: Sequence[str], reps: int, block: int, seed: int) -> DataFrame:
    """Quantiles of plain, block and stressed resampling, one below the other, from one pass over the series."""
    paths = resampled_paths(series, keys, reps, {"iid": Draw("iid"), "block": Draw("circular", block), "stressed": STRESSED}, seed, ("final", "mdd"))
    return path_quantiles(paths, [*keys, "method"])


def series_risk(paths: DataFrame, keys: Sequence[str], level: float = 0.95, limit: float = -0.10) -> DataFrame:
    """From replicates of daily returns: intervals of mean, Sharpe and drawdown, chance of a loss and of a drawdown beyond a limit."""
    paths = paths.withColumn("sharpe", F.coalesce(F.try_divide("mean", "std"), F.lit(0.0)) * F.sqrt(F.lit(365.0)))
    a = (1 - level) / 2
    ends = [F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("mean", "sharpe", "mdd", "final") for name, q in (("low", a), ("high", 1 - a))]
    return paths.groupBy(*keys).agg(*ends, F.avg((F.col("final") < 1).cast("double")).alias("p_loss"), F.avg((F.col("mdd") <= limit).cast("double")).alias("p_drawdown"))
