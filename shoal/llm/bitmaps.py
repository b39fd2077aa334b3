"""Sets of hashed keys as bitmaps, tested by DataFrame functions.

A set is a table (bucket, bitmap), one row per 32,768 positions. It is broadcast
in pieces of a bounded size; a row only needs the piece that its position is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stash

#: Positions a bitmap of bitmap_construct_agg holds.
BITS = 32768
#: Bits for each row, and bytes of the bitmaps that are broadcast at a time.
BITS_PER_ROW, PIECE_BYTES = 32, 64 << 20
#: Bytes of a set's bitmaps up to which they are broadcast whole; beyond, rows are joined by shuffle.
SMALL_BYTES = 256 << 20


def positions_for(rows: int, bits_per_row: int = BITS_PER_ROW) -> int:
    size = BITS
    while size < rows * bits_per_row:
        size *= 2
    return size


def position(hashed: Column, size: int) -> Column:
    return F.pmod(hashed, F.lit(size))


def built(positions: DataFrame) -> DataFrame:
    """(bucket, bitmap) of the values of column pos."""
    return positions.groupBy(F.shiftright("pos", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("pos").bitwiseAND(F.lit(BITS - 1))).alias("bitmap"))


def pieces(size: int, piece_bytes: int = PIECE_BYTES) -> int:
    return -(-size // (8 * piece_bytes))


def piece_of(pos: Column, size: int, piece_bytes: int = PIECE_BYTES) -> Column:
    """Number of the piece that holds a position; pieces are of whole buckets."""
    buckets = max(1, piece_bytes * 8 // BITS)
    return F.floor(F.shiftright(pos, 15) / buckets).cast("int")


def tested(rows: DataFrame, members: DataFrame, pos: Column, flag: str) -> DataFrame:
    """rows with a column flag, whether pos is in members, which is broadcast."""
    own = f"{flag}_bucket", f"{flag}_bitmap", f"{flag}_pos"
    table = members.select(F.col("bucket").alias(own[0]), F.col("bitmap").alias(own[1]))
    out = rows.withColumn(own[2], pos).join(F.broadcast(table), F.shiftright(own[2], 15) == F.col(own[0]), "left")
    at = F.col(own[2]).bitwiseAND(F.lit(BITS - 1))
    byte = F.conv(F.hex(F.substring(F.col(own[1]), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr(f"shiftleft(1, int(`{own[2]}` & 7))")
    return out.withColumn(flag, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop(*own)


def _level_position(level: int, on: list[str], size: int) -> Column:
    return position(F.xxhash64(F.lit(level), *on), size)


def cascade(members: DataFrame, others: DataFrame, on: list[str], rows: int) -> list[tuple[int, DataFrame]]:
    """Bitmaps, with their sizes, by which each key (columns on) of members is told from each of others.

    The first holds members, the second those of others that hit it by chance, the
    third the members that hit that, and so on until no key is mistaken.
    """
    out = []
    while rows:
        size = positions_for(rows)
        pos = _level_position(len(out), on, size)
        held = stash(built(members.select(pos.alias("pos"))), "keys")
        out.append((size, held))
        mistaken = stash(tested(others, held, pos, "hit").where("hit").select(*on), "mistaken")
        members, others, rows = mistaken, members, mistaken.count()
    return out


def outside(rows: DataFrame, members: DataFrame, others: DataFrame, on: list[str], flags: list[str], small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The rows whose key (columns on, never null) isn't in members; others has the keys of all other rows. flags: two names free in rows.

    Exact. rows aren't shuffled while the bitmaps are small.
    """
    n = members.count()
    if not n:
        return rows
    if positions_for(n) > 8 * small_bytes:
        return rows.join(members.select(*on), on, "left_anti")
    hit, verdict = flags
    state = rows.withColumn(verdict, F.lit(None).cast("boolean"))
    filters = cascade(members, others, on, n)
    for i, (size, held) in enumerate(filters):
        # the first bitmap that doesn't hold the key tells: an even one that it is no member, an odd one that it is
        state = tested(state, held, _level_position(i, on, size), hit)
        state = state.withColumn(verdict, F.coalesce(verdict, F.when(~F.col(hit), F.lit(i % 2 == 1)))).drop(hit)
    return state.where(~F.coalesce(verdict, F.lit(len(filters) % 2 == 1))).drop(verdict)


def among(rows: DataFrame, members: DataFrame, on: list[str], flag: str, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """rows without most of those whose key isn't in members, to be joined to members next."""
    n = members.count()
    size = positions_for(n)
    if not n or size > 8 * small_bytes:
        return rows
    held = stash(built(members.select(_level_position(0, on, size).alias("pos"))), "keys")
    return tested(rows, held, _level_position(0, on, size), flag).where(F.col(flag)).drop(flag)
