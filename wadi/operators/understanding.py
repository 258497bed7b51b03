"""What a query asks for: type, scope, early exit, instruction, as Column cascades over a table of queries.

Word and phrase lists are a ``Signals`` value of the caller; each phrase counts once
if the small-lettered query, or its normalised form, contains it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wadi.functions import text as T

Phrases = tuple[str, ...]


@dataclass(frozen=True)
class Signals:
    """Phrase lists by purpose; an empty list never matches."""

    fragments: Phrases = ()
    comparative_strong: Phrases = ()
    comparative_weak: Phrases = ()
    dual_source: Phrases = ()
    definitional_first: Phrases = ()
    definitional_second: Phrases = ()
    definitional_strong: Phrases = ()
    legal: Phrases = ()
    narrative: Phrases = ()
    historical: Phrases = ()
    story_frames: Phrases = ()
    prayer_times: Phrases = ()
    questions: Phrases = ()
    theme_nouns: Phrases = ()
    connectors: Phrases = ()
    connector_prefix: str = "و"
    ambiguous: Phrases = ()
    book: Phrases = ()
    reports: Phrases = ()
    emotions: Phrases = ()
    book_terms: Phrases = ()
    report_terms: Phrases = ()
    legal_terms: Phrases = ()


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _sum(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [x.cast("int") for x in tests], F.lit(0))


def forms(query: Column) -> tuple[Column, Column]:
    """Small letters, and the normalised form of those."""
    small = F.lower(F.coalesce(query, F.lit("")))
    return small, T.normalize_arabic(small)


def hits(query: Column, phrases: Phrases) -> Column:
    """How many of the phrases the query holds in either form."""
    small, normal = forms(query)
    return _sum([small.contains(p) | normal.contains(p) for p in phrases])


def word_hits(words: Column, listed: Phrases) -> Column:
    """Whether any word of the array is listed."""
    return F.arrays_overlap(words, F.array(*[F.lit(x) for x in listed])) if listed else F.lit(False)


def is_dual(query: Column, s: Signals) -> Column:
    return hits(query, s.dual_source) > 0


def is_prayer_time(query: Column, s: Signals) -> Column:
    return hits(query, s.prayer_times) > 0


def query_type(query: Column, language: Column, s: Signals, scoped: Column | None = None) -> Column:
    """The first rule that holds, in this order.

    Known fragment; comparison (a strong sign or two weak ones); both sources
    named; definition, which a legal sign turns legal; legal; story, which an
    event without a story's frame turns thematic unless a scope was given; prayer
    time; up to three words in Arabic without question, connector or theme noun,
    or a known pair; else thematic.
    """
    small, normal = forms(query)
    words = F.split(normal, r"\s+")
    n_words = F.size(F.filter(F.split(small, r"\s+"), lambda w: w != ""))
    defined = (hits(query, s.definitional_first) > 0) | (language.isin("english", "mixed") & (hits(query, s.definitional_second) > 0))
    strong, legal = hits(query, s.definitional_strong) > 0, hits(query, s.legal) > 0
    told = F.replace(F.replace(normal, F.lit("قصه"), F.lit("قصة")), F.lit("قصص"), F.lit("قصة"))
    story = (hits(query, s.narrative) > 0) | _any([told.contains(p) for p in s.narrative])
    event = _any([normal.contains(p) for p in s.historical]) & ~_any([normal.contains(p) for p in s.story_frames])
    if scoped is not None:
        event = event & ~scoped
    known = normal.isin(*s.ambiguous) if s.ambiguous else F.lit(False)
    linked = F.exists(words, lambda w: w.isin(*s.connectors) | (w.startswith(s.connector_prefix) & (F.length(w) > 1)))
    plain = ~word_hits(words, s.questions) & ~word_hits(words, s.theme_nouns) & ~linked
    short = (language == "arabic") & (n_words <= 3) & (known | plain)
    rules = [
        (_any([normal.contains(p) for p in s.fragments]), "named_concept"),
        ((hits(query, s.comparative_strong) >= 1) | (hits(query, s.comparative_weak) >= 2), "comparative"),
        (is_dual(query, s), "thematic"),
        (defined & strong & legal, "fiqh"),
        (defined & strong, "definitional"),
        (legal, "fiqh"),
        (story & event, "thematic"),
        (story, "narrative"),
        (is_prayer_time(query, s), "thematic"),
        (short, "arabic_keyword"),
    ]
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise("thematic")


def _leaning(book: Column, reports: Column) -> Column:
    return F.when(book > reports, "quran").when(reports > book, "hadith").otherwise("all")


def query_scope(query: Column, language: Column, s: Signals) -> Column:
    """The source with more signs, a tie is both; words of feeling count for the book where nothing else does, but for Arabic."""
    book = hits(query, s.book)
    felt = language.isin("english", "mixed") & (book == 0) & word_hits(F.regexp_extract_all(forms(query)[0], F.lit(r"[\p{L}\p{N}_]+"), 0), s.emotions)
    return _leaning(book + felt.cast("int"), hits(query, s.reports))


def keyword_scope(query: Column, s: Signals) -> Column:
    """Scope of a short query: phrases anywhere, single words only as whole words; legal terms count for the reports."""
    normal = T.normalize_arabic(F.lower(F.trim(query)))
    words = F.split(normal, r"\s+")
    count = lambda listed: _sum([normal.contains(p) if " " in p else F.array_contains(words, p) for p in listed])
    return _leaning(count(s.book_terms), count(s.report_terms) + count(s.legal_terms))


def keyword_kind(query: Column, s: Signals) -> Column:
    """A fragment of the book, a term (or part of one) of several meanings, or neither."""
    normal = T.normalize_arabic(F.lower(F.trim(query)))
    fragment = _any([normal.contains(p) for p in s.fragments])
    unclear = _any([normal.contains(p) | F.lit(p).contains(normal) for p in s.ambiguous])
    return F.when(fragment, "quran_fragment").when(unclear, "ambiguous_term").otherwise("normal")


def direct_source(kind: Column, chunk_id: Column) -> Column:
    """Source of a direct result: by its kind, named ones by the prefix of their id."""
    named = F.when(chunk_id.startswith("Q_"), "quran").when(chunk_id.startswith("H_"), "hadith").otherwise("unknown")
    return F.when(kind == "quran_ref", "quran").when(kind == "hadith_ref", "hadith").when(kind == "named_concept", named).otherwise("unknown")


def early_exit(kind: Column, chunk_id: Column, scope: Column) -> Column:
    """Whether a direct result may end the search: always without a scope, else in its own."""
    return (scope == "all") | (scope.isin("quran", "hadith") & (scope == direct_source(kind, chunk_id)))


def instruction(kind: Column, scope: Column, language: Column) -> Column:
    """Name of the embedding instruction."""
    by_scope = F.when(scope == "quran", "quran").when(scope == "hadith", "hadith")
    return (
        F.when(kind == "narrative", "narrative")
        .when(kind.isin("definitional", "fiqh", "comparative"), F.coalesce(by_scope, kind))
        .when(language == "mixed", "mixed")
        .otherwise(F.coalesce(by_scope, F.lit("general")))
    )


def rerank_query(query: Column, gloss: Column | None = None, most: int = 300) -> Column:
    """The trimmed query, cut at a word's end within ``most`` characters, with the gloss behind it."""
    trimmed = F.trim(query)
    head = F.substring(trimmed, 1, most)
    cut = F.when(F.length(trimmed) > most, F.regexp_replace(head, r"(?s)^(.*) .*$", "$1")).otherwise(trimmed)
    return cut if gloss is None else F.when(F.coalesce(gloss, F.lit("")) != "", F.concat(cut, F.lit(": "), gloss)).otherwise(cut)


def strip_frame(query: Column, phrases: Phrases, least: int = 2) -> Column:
    """Without the literal phrases, spaces squeezed; the query itself if fewer than ``least`` characters would stay."""
    bare = T.squeeze(reduce(lambda c, p: F.replace(c, F.lit(p), F.lit(" ")), phrases, query))
    return F.when(F.length(bare) >= least, bare).otherwise(query)


def strip_connectors(query: Column, connectors: Phrases, block: str = T.ARABIC_BLOCK, share: float = 0.5) -> Column:
    """Without connecting words of the other script, where at least ``share`` of the words have a letter of the block."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    inside = F.size(F.filter(words, lambda w: w.rlike(f"[{block}]")))
    kept = F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(*connectors)), " ")
    return F.when((F.size(words) > 0) & (inside >= share * F.size(words)), kept).otherwise(query)


def strip_opening(text: Column, number: Column, opening: Phrases) -> Column:
    """Without the opening words at the head of a section's text, but for section 1."""
    bare = lambda w: F.translate(F.regexp_replace(w, "[ً-ٰٟۖ-ۭـ﻿]", ""), "أإآٱ", "اااا")
    clean = F.trim(F.replace(text, F.lit("﻿"), F.lit("")))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    n = len(opening)
    same = F.transform(F.slice(words, 1, n), bare) == F.array(*[F.lit(w) for w in opening])
    return F.when((number != 1) & same, F.array_join(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), " ")).otherwise(clean)


def document_terms(text: Column, first: Column, second: Column) -> Column:
    """Terms of a document: words of both scripts and the pairs of neighbouring words of the first."""
    return F.concat(first, second, T.bigrams(first))


def book_priority(chunk_id: Column, ranks: dict[str, int], pattern: str = r"^H_eng-([a-z]+)_", other: int = 9) -> Column:
    name = F.regexp_extract(F.coalesce(chunk_id, F.lit("")), pattern, 1)
    return reduce(lambda c, r: c.when(name == r[0], r[1]), list(ranks.items())[1:], F.when(name == next(iter(ranks)), next(iter(ranks.values())))).otherwise(other)


def cache_key(query: Column, ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lower(query), F.array_join(ids, ",")))
