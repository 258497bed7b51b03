"""Narrations: the chain of narrators before a text, its own words, notes after it.

Words are reduced to one letter each (transmission, speech, prophet, other), so the
end of a chain is one regular expression over a short string, inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks dropped before words are compared, and what is trimmed off them.
MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ‏‎]"
TRIMMED = "،,.:;\"'()[]-–‏ "


@dataclass(frozen=True)
class Chains:
    """Word lists (fixed values for the narrations of the corpus) and limits."""

    transmission: tuple[str, ...] = (
        "حدثنا", "حدثني", "اخبرنا", "اخبرني", "انبانا", "انباني", "سمعت", "سمعنا", "سمع",
        "عن", "حدثه", "حدثهم", "اخبره", "اخبرهم", "يحدث", "حدثناه", "اخبرناه", "ح", "ثنا", "نا",
    )
    speech: tuple[str, ...] = ("قال", "قالت", "قالا", "يقول", "تقول", "قالوا", "ان", "انه", "انها", "انهم", "انهما")
    prophet: tuple[str, ...] = ("رسول", "النبي", "نبي")
    joined: str = "وف"
    gap: int = 12
    least: int = 30
    markers: tuple[str, ...] = ("قال رسول الله", "قال النبي", "قال صلى الله عليه وسلم", "قال صلي الله عليه وسلم", "يقول رسول الله", "يقول النبي صلى")
    said: str = "قال"
    direct: tuple[str, ...] = ('‏"‏', '"', "‏\"", "رسول", "النبي", "صلى", "أن ", "ان ", "بينما")
    chain_words: tuple[str, ...] = ("عن", "بن", "ابن", "ابو", "أبو", "عبد", "انه", "أنّه", "قال", "عنه", "انها", "حدثنا", "أخبرنا", "اخبرنا", "سمعت", "حدثني")


#: Citations inside a narration, the chain of a translation, the compiler's grading note.
CITATION = r"(اقرء|يقول|قال|وذلك قوله|كما قال|في قوله|قوله تعالى|قال تعالى)\s*[؀-ۿ\s]{0,20}(سورة|آية|ال[^\s]+)"
ENGLISH_CHAIN = r"(?iU)^(Narrated\s+[\w\s'`\.]+?:|[\w\s'`\.]+?\s+reported\s*:|[\w\s'`\.]+?\s+said\s*:)\s*"
GRADING = r"(قال\s+(ابو|أبو)\s+(عيسي|عيسى)|قال\s+(ابو|أبو)\s+داود|هذا\s+حديث\s+(حسن|صحيح|غريب)|وفي\s+الباب\s+عن)"


def _literal(words: tuple[str, ...]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


def word_kinds(words: Column, c: Chains = Chains()) -> Column:
    """One letter a word: t, s, p or o; a joined letter before a word of the first two kinds does not count."""

    def bared(w: Column) -> Column:
        return F.translate(F.btrim(F.regexp_replace(w, MARKS, ""), F.lit(TRIMMED)), "أإآٱ", "اااا")

    def kind(bare: Column) -> Column:
        rest = F.substr(bare, F.lit(2))
        known = lambda x: F.when(x.isin(*c.transmission), "t").when(x.isin(*c.speech), "s")
        after = F.when((F.length(bare) > 2) & F.left(bare, F.lit(1)).isin(*c.joined), known(rest))
        return F.coalesce(after, F.when(bare.isin(*c.prophet), "p"), known(bare), F.lit("o"))

    # bare words first: inside a lambda a column is worked out wherever it is named
    return F.array_join(F.transform(F.transform(words, bared), kind), "")


def opens(words: Column, c: Chains = Chains()) -> Column:
    """Whether a chain opens the text, from its first three words."""
    return F.contains(word_kinds(F.slice(words, 1, 3), c), F.lit("t"))


def own_words_start(kinds: Column, gap: int = 12) -> Column:
    """Index of the first word after the chain, null where no chain opens the text.

    A chain goes on from one transmission word to the next within ``gap`` words, over
    speech words only right before a transmission. It ends before other speech, at the
    prophet (with a transmission right before him), or after its last transmission word.
    """
    link = r"(?:o|s(?=t))"
    pattern = rf"^([^tp]{{0,2}}(?:t{link}{{0,{gap - 1}}}(?=t))*+)(t{link}{{0,{gap}}})(p|s(?!t))?"
    chain, tail, end = (F.regexp_extract(kinds, pattern, g) for g in (1, 2, 3))
    last, reach = F.length(chain), F.length(tail)
    start = F.when(end == "s", last + reach).when((end == "p") & (reach == 1), last).otherwise(last + 1)
    return F.when(kinds.rlike("^.{0,2}t"), F.when(kinds.rlike("^[^tp]?p"), 0).otherwise(start))


def own_text(text: Column, c: Chains = Chains()) -> Column:
    """Struct (text, marked): the words after the chain, and whether a chain or a marker told where.

    Without a chain: from the last marker on, else from the last "said" before direct
    speech, else from the last "said", else the last 65 %; all beyond the first tenth and
    with enough text after them. Null and empty texts stay as they are.
    """
    n = F.length(text)
    words = F.split(F.btrim(F.regexp_replace(text, r"\s+", " ")), " ")
    start = own_words_start(word_kinds(words, c), c.gap)
    after_chain = F.when(start < F.size(words), F.array_join(F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0))), " "))
    tenth = F.floor(n * F.lit(0.1)).cast("int")

    def last(part: str, least_after: Column) -> Column:
        """Index of the last ``part`` with so many characters after it, from the tenth on; else null."""
        head = F.left(text, F.greatest(n - least_after, F.lit(0)))
        back = F.instr(F.reverse(head), part[::-1])
        at = F.length(head) - back + 1 - len(part)
        return F.when((back > 0) & (at >= tenth), at)

    marker = F.greatest(*[last(m, F.lit(c.least)) for m in c.markers])
    rest = F.substr(text, tenth + 1)
    no_chain = rf"(?!\s*(?:{_literal(c.chain_words)})(?:\s|\z))"
    before = F.regexp_extract(rest, rf"(?s)^(.*)\Q{c.said}\E(?=\s*(?:{_literal(c.direct)})){no_chain}", 1)
    direct = F.when(rest.rlike(rf"(?s)\Q{c.said}\E(?=\s*(?:{_literal(c.direct)})){no_chain}"), tenth + F.length(before))
    said = last(c.said, F.lit(0))
    enough = lambda at: F.when(n - at >= c.least, at)
    cut = F.coalesce(marker, enough(direct), enough(said), F.floor(n * F.lit(0.35)).cast("int"))
    found = F.length(after_chain) >= c.least
    chosen = F.when(found, after_chain).otherwise(F.substr(text, cut + 1))
    marked = F.coalesce(found, F.lit(False)) | marker.isNotNull()
    return F.when(n > 0, F.struct(chosen.alias("text"), marked.alias("marked"))).otherwise(F.struct(text.alias("text"), F.lit(False).alias("marked")))


def without_citations(text: Column, pattern: str = CITATION) -> Column:
    return F.regexp_replace(text, pattern, " ")


def without_english_chain(text: Column, pattern: str = ENGLISH_CHAIN, least: int = 20) -> Column:
    """The text after the narrators, if more than ``least`` characters are left."""
    rest = F.regexp_replace(F.btrim(text), pattern, "")
    return F.when(F.length(rest) > least, rest).otherwise(text)


def without_grading(text: Column, pattern: str = GRADING, beyond: float = 0.3) -> Column:
    """The text before the first grading note in its last 70 %."""
    from_ = F.ceil(F.length(text) * F.lit(beyond)).cast("int")
    at = F.regexp_instr(F.substr(text, from_ + 1), F.lit(pattern))
    return F.when(at > 0, F.left(text, from_ + at - 1)).otherwise(text)
