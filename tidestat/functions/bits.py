"""Packed bit vectors as arrays of 64-bit words (least significant bit first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def pack(df: DataFrame, by: list[str], position: str, nbits: int) -> DataFrame:
    """by..., words: bit `position` (0-based, below nbits) set for every row; repeated positions are idempotent."""
    n = -(-nbits // WORD)
    word = F.floor(F.col(position) / WORD).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(`{position}` % {WORD} as int))")
    per = df.where(F.col(position).between(0, nbits - 1)).groupBy(*by, word.alias("_w")).agg(F.bit_or(bit).alias("_v"))
    made = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_v"))).alias("_m"))
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long")))
    return made.select(*by, words.alias("words"))


def get_bit(words: Column, position: Column) -> Column:
    """The bit at a 0-based position; null outside the vector."""
    w = F.get(words, F.floor(position / WORD).cast("int"))
    return F.getbit(w, (position % WORD).cast("int"))


def total_bits(words: Column) -> Column:
    """The number of set bits."""
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def lag_matches(a: Column, b: Column, lag: int) -> Column:
    """The number of positions i with a[i] and b[i + lag] set, a word at a time; lag is not negative."""
    if lag < 0:
        raise ValueError("lags are not negative")
    q, r = divmod(lag, WORD)

    def shifted(i: Column) -> Column:
        low = F.coalesce(F.get(b, i + q), F.lit(0).cast("long"))
        if not r:
            return low
        high = F.coalesce(F.get(b, i + q + 1), F.lit(0).cast("long"))
        return F.shiftrightunsigned(low, r).bitwiseOR(F.shiftleft(high, WORD - r))

    matches = F.transform(a, lambda w, i: F.bit_count(w.bitwiseAND(shifted(i))))
    return F.aggregate(matches, F.lit(0), lambda s, n: s + n)


def crosscor(a: Column, b: Column, lags: list[int]) -> Column:
    """array<double> of lag_matches / sqrt(total_bits(a) * total_bits(b)), null where a side has no bit."""
    norm = F.sqrt(total_bits(a).cast("double") * total_bits(b))
    return F.array(*[F.try_divide(lag_matches(a, b, g), norm) for g in lags])


def words_sql(positions: str, base: str, top: str) -> str:
    """SQL: the words of an array of distinct positions in base..top; bit 0 of the first word is base."""
    one = f"transform(filter({positions}, x -> (x - {base}) div 64 = w), x -> shiftleft(1L, int((x - {base}) % 64)))"
    return f"transform(sequence(0, int(({top} - {base}) div 64)), w -> aggregate({one}, 0L, (s, x) -> s | x))"


def lag_matches_sql(a: str, b: str, lag: str) -> str:
    """SQL: lag_matches of two word arrays for a lag that is a value of the row."""
    low, high = f"coalesce(get({b}, i + int({lag} div 64)), 0L)", f"coalesce(get({b}, i + int({lag} div 64) + 1), 0L)"
    moved = f"if({lag} % 64 = 0, {low}, shiftrightunsigned({low}, int({lag} % 64)) | shiftleft({high}, 64 - int({lag} % 64)))"
    return f"aggregate(transform({a}, (v, i) -> bit_count(v & {moved})), 0, (s, n) -> s + n)"


def from_bits(flags: Column) -> Column:
    """The words of an array of booleans (null counts as false), bit 0 first."""
    n = F.size(flags)
    at = F.expr("transform(sequence(0, 63), i -> i)")

    def word(w: Column) -> Column:
        bits = F.transform(at, lambda i: F.when(F.coalesce(F.get(flags, w * WORD + i), F.lit(False)), F.expr("1L")).otherwise(F.expr("0L")))
        return F.aggregate(F.transform(bits, lambda v, i: F.call_function("shiftleft", v, i)), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))

    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / WORD).cast("int")), word))


def set_bit(words: Column, position: Column, value: bool = True) -> Column:
    """words with the bit at a 0-based position set or cleared; a position outside changes nothing."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (position % WORD).cast("int"))
    changed = (lambda w: w.bitwiseOR(mask)) if value else (lambda w: w.bitwiseAND(F.bitwise_not(mask)))
    return F.transform(words, lambda w, i: F.when(i == F.floor(position / WORD), changed(w)).otherwise(w))
