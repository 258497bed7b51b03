"""Light stemming and tokenising of Arabic and English words, row by row in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from wadi.functions.text import BOM, DIACRITICS, FOLD_FROM, FOLD_TO, SUPERSCRIPT_ALEF, TATWEEL

# Affixes, longest first.
CONJUNCTIONS = ("و", "ف")
ARTICLES = ("وال", "فال", "بال", "كال", "لل", "ال")
PREPOSITIONS = ("ب", "ل", "ك")
SUFFIXES = ("ونها", "ونه", "ونك", "تها", "تهم", "تكم", "يها", "يهم", "ها", "هم", "كم", "نا", "وا", "ون", "ين", "ان", "ات", "يت", "ت", "ي", "ه")
LONG_REMAINDER = {"ون", "ين", "ان", "ات", "وا", "يت"}

_DROP = {ord(c): None for c in DIACRITICS + SUPERSCRIPT_ALEF + TATWEEL + BOM} | {c: None for c in range(0x06D6, 0x06EE)}
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def normalize(text: str | None) -> str:
    return (text or "").translate(_DROP).translate(_FOLD).strip()


def _off_front(word: str, parts: tuple[str, ...], least: int) -> str | None:
    """The word without the first fitting part, if ``least`` letters stay; null if none fits."""
    return next((word[len(p) :] for p in parts if word.startswith(p) and len(word) - len(p) >= least), None)


def light_stem(word: str) -> str:
    """One conjunction, then an article or a preposition, then one suffix; length guards keep roots whole.

    The longest suffix that matches decides, even where its guard keeps it.
    """
    bare = _off_front(word, ARTICLES, 3)
    if bare is None:
        word = _off_front(word, CONJUNCTIONS, 4) or word
        bare = (_off_front(word, ARTICLES, 3) if len(word) else None) or _off_front(word, PREPOSITIONS, 4) or word
    suffix = next((s for s in SUFFIXES if bare.endswith(s)), "")
    keep = 4 if suffix in LONG_REMAINDER else 3
    return bare[: len(bare) - len(suffix)] if suffix and len(bare) - len(suffix) >= keep else bare


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores (combining marks split words)."""
    return re.findall(r"\w+", text or "")


def stem_tokens(text: str | None, stop: frozenset[str] = frozenset()) -> list[str]:
    """Stems of normalised words of three letters and more, without stop words (as stem, as is, or without a conjunction)."""
    out = []
    for raw in words(normalize(text)):
        if len(raw) < 3:
            continue
        stem = light_stem(raw)
        plain = raw[1:] if raw[:1] in CONJUNCTIONS else raw
        if stop and {stem, raw, plain} & stop:
            continue
        out.append(stem)
    return out


def query_tokens(text: str | None, stop: frozenset[str] = frozenset()) -> list[str]:
    """Stem and, where it differs, the word itself; each once."""
    out = dict.fromkeys(())
    for raw in words(normalize(text)):
        if len(raw) < 3 or raw in stop:
            continue
        stem = light_stem(raw)
        if stem not in stop:
            out[stem] = None
        if raw != stem:
            out[raw] = None
    return list(out)


def proclitic_variants(df: dict[str, int], least: int = 20, ratio: float = 3.0) -> dict[str, str]:
    """Words whose form without a one-letter proclitic is far more frequent: word to bare form."""
    out = {}
    for w, n in df.items():
        bare = w[1:]
        if w[:1] in CONJUNCTIONS + PREPOSITIONS and len(bare) >= 3 and df.get(bare, 0) >= least and df[bare] >= ratio * n:
            out[w] = bare
    return out


def is_mark(c: str) -> bool:
    return unicodedata.combining(c) != 0


def stem_tokens_column(text):
    """Column array<string> of ``stem_tokens``, as an Arrow-batched UDF."""

    @F.pandas_udf("array<string>")
    def stems(texts: pd.Series) -> pd.Series:
        return texts.map(stem_tokens)

    return stems(text)
