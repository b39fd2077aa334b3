"""Log tokens and approximate whitelists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signs stripped before, after and inside tokens.
LEADING = r"^[^\sA-Za-z0-9_/-]+"
TRAILING = r"[^\sA-Za-z0-9_/-]+$"
INSIDE = r"[^A-Za-z0-9_./:@-]"
BITS, HASHES = 1 << 15, 4


# The same at once, over a whole message: the runs that stay (what INSIDE keeps, and spaces; a run costs less than a
# replacement), and then, of each word, from the first sign that stays to the last one.
WANTED = r"[\sA-Za-z0-9_./:@-]+"
WORD = r"(?<!\S)[.:@]*+([0-9./:@]*+[A-Za-z_-](?:\S*[A-Za-z0-9_/-])?)"


def _same(token: Column) -> Column:
    return token


def tokens(message: Column, inside: str = INSIDE, trailing: str = TRAILING, leading: str = LEADING, post=_same, keep=None) -> Column:
    """Words of a message, stripped of signs, that hold a letter, an underscore or a hyphen (and pass keep)."""
    if (inside, trailing, leading, post) == (INSIDE, TRAILING, LEADING, _same):
        wanted = F.array_join(F.regexp_extract_all(message, F.lit(WANTED), F.lit(0)), "")
        good = F.regexp_extract_all(wanted, F.lit(WORD), F.lit(1))
    else:
        parts = F.split(F.regexp_replace(message, r"\s+", " "), " ")
        clean = F.transform(parts, lambda t: post(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, inside, ""), trailing, ""), leading, "")))
        good = F.filter(clean, lambda t: t.rlike("[A-Za-z_-]"))
    return F.filter(good, keep) if keep is not None else good


def positions(word: Column) -> Column:
    """The bits of a word: four slices of its md5, the same in any SQL engine."""
    digest = F.md5(word)
    return F.array(*[(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % BITS).cast("int") for i in range(HASHES)])


def train_whitelist(words: DataFrame, word: str) -> DataFrame:
    """One row: the bitmap of all bits of the words (null if there are none)."""
    return words.select(F.explode(positions(F.col(word))).alias("p")).agg(F.bitmap_construct_agg(F.col("p").cast("long")).alias("bitmap"))


def combine_whitelists(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def has_bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)).cast("int") % 2 == 1


def maybe_contains(bitmap: Column, word: Column) -> Column:
    """False only for words that aren't in the whitelist."""
    return F.forall(positions(word), lambda p: has_bit(bitmap, p))
