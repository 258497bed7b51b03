"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that normalisation drops or folds.
DIACRITICS = "ًٌٍَُِّْ"
SUPERSCRIPT_ALEF = "ٰ"
KORANIC_MARKS = r"ۖ-ۭ"
TATWEEL, BOM = "ـ", "﻿"
FOLD_FROM, FOLD_TO = "أإآٱةىؤئ", "ااااهيءء"
ARABIC_BLOCK = r"؀-ۿ"


def normalize_arabic(c: Column) -> Column:
    """Drops vowel marks, small signs, tatweel and BOM; folds letter variants; trims."""
    dropped = F.regexp_replace(c, f"[{DIACRITICS}{SUPERSCRIPT_ALEF}{KORANIC_MARKS}{TATWEEL}{BOM}]", "")
    return F.trim(F.translate(dropped, FOLD_FROM, FOLD_TO))


def normalize_text(c: Column) -> Column:
    """``normalize_arabic`` in small letters; null is empty."""
    return F.lower(normalize_arabic(F.coalesce(c, F.lit(""))))


def tokens(c: Column, least: int = 3) -> Column:
    """Words of letters and digits in small letters, of at least ``least`` characters."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: F.length(w) >= least)


def bigrams(words: Column) -> Column:
    """Adjacent words joined by an underscore."""
    return F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b)), lambda x: x.isNotNull())


def script_share(c: Column, block: str = ARABIC_BLOCK) -> Column:
    """Share of characters (all count, spaces too) that lie in a block; 0 for empty texts."""
    return F.coalesce(F.length(F.regexp_replace(c, f"[^{block}]", "")) / F.nullif(F.length(c), F.lit(0)), F.lit(0.0))


def language_class(c: Column, block: str = ARABIC_BLOCK, names: tuple[str, str, str] = ("arabic", "mixed", "english")) -> Column:
    """By share of the block: from 0.6 the first name, from 0.3 the second, else the third."""
    share = script_share(c, block)
    return F.when(share >= 0.6, names[0]).when(share >= 0.3, names[1]).otherwise(names[2])


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def strip_prefix(c: Column, pattern: str, least: int = 20) -> Column:
    """Without a leading match, unless no more than ``least`` characters would stay."""
    cut = F.regexp_replace(c, f"^(?:{pattern})", "")
    return F.when(F.length(cut) > least, cut).otherwise(c)


def strip_tail(c: Column, pattern: str, from_share: float = 0.3) -> Column:
    """Without the tail that begins with a match, if that lies past a share of the text."""
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(at - 1 > F.floor(F.length(c) * from_share), F.substring(c, F.lit(1), at - 1)).otherwise(c)


def chapter_band(chapter: Column, number: Column, width: int = 50) -> Column:
    """The chapter, or for N/A a band of numbers; ``band0`` where the number cannot be read."""
    band = F.floor(F.coalesce(number.try_cast("double"), F.lit(0.0)) / width) * width
    return F.coalesce(F.nullif(F.nullif(chapter, F.lit("N/A")), F.lit("")), F.concat(F.lit("band"), band.cast("string")))


def contains_all(words: Column, needles: Column) -> Column:
    """Whether every needle is among the words."""
    return F.size(F.array_except(needles, words)) == 0


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets (arrays of distinct values); two empty sets have 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def duplicate_sets(a: Column, b: Column, least: float = 0.4) -> Column:
    """Jaccard at least ``least``; or the smaller set (of 4 at least) wholly or to 0.75 within the other; or (of 5) to 0.6."""
    both, small = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return (jaccard(a, b) >= least) | ((small >= 4) & (both >= 0.75 * small)) | ((small >= 5) & (both >= 0.6 * small))


def fuzzy_score(query: Column, name: Column) -> Column:
    """1 for a prefix, 0.95 for a substring, 0 for under three letters, else the best windowed edit likeness times 0.95."""
    n = F.length(query)
    width = lambda d: F.greatest(n + d, F.lit(1))
    windows = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - width(d) + 1, F.lit(1))), lambda i: F.substring(name, i, width(d)))))
    best = F.array_max(F.transform(windows, lambda w: 1 - F.levenshtein(query, w) / F.greatest(n, F.length(w))))
    return F.when(name.startswith(query), 1.0).when(name.contains(query), 0.95).when(n < 3, 0.0).otherwise(best * 0.95)


def status_of(rate: Column, correct: float = 0.05, locked: float = 0.75) -> Column:
    """Error rate to status."""
    return F.when(rate <= correct, "correct").when(rate >= locked, "locked").otherwise("errors")
