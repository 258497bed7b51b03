"""Rewrite rules from vowelled Arabic script towards its sounds, as chains of regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and signs by code point, and letter classes.
HAMZA, HAMZAS = "ء", "ءأإؤئٔ"
ALIF, BAA, TAA_MARBOOTA, TAA, HAA2 = "ا", "ب", "ة", "ت", "ح"
LAM, NOON, MEEM, HAA, WAW, MAKSORA, YAA = "ل", "ن", "م", "ه", "و", "ى", "ي"
FATH2, DAM2, KASR2, FATHA, DAMMA, KASRA, SHADDA, SUKUN, MADD = "ً", "ٌ", "ٍ", "َ", "ُ", "ِ", "ّ", "ْ", "ٓ"
WASL, KASHIDA, SMALL_ALIF, SMALL_WAW, SMALL_YAA_LINK, SMALL_YAA, SMALL_NOON = "ٱ", "ـ", "ٰ", "ۥ", "ۦ", "ۧ", "ۨ"
ROUND_ZERO, LONG_ZERO, SMALL_MEEM, LOW_MEEM = "۟", "۠", "ۢ", "ۭ"
HIDING, MERGING = "تثجدذزسشصضطظفقك", "يرملون"
CONSONANTS = "بتثجحخدذرزسشصضطظعغفقكلمنه"
ECHOED, ECHO = "قطبجد", "\u0687"
VOWELS = FATHA + DAMMA + KASRA
_FATH = f"(?:{FATH2}{LOW_MEEM}|{FATH2}{SMALL_MEEM}|{FATH2})"

# Names of rule groups in their order, each with its (pattern, replacement) rows in theirs.
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "initial_sukun": ((f"(^.){SUKUN}", rf"\1{KASRA}"),),
    "alif_maksora": (
        (f"({_FATH}){MAKSORA}", r"\1"), (f"({FATHA}){MAKSORA}( |$)", rf"\1{ALIF}\2"), (f"{MAKSORA}{SMALL_ALIF}", ALIF), (f"{KASRA}{MAKSORA}", KASRA + YAA),
        (f"{MAKSORA}([{VOWELS}{SUKUN}{SHADDA}{DAM2}{MADD}])", rf"{YAA}\1"),
    ),
    "hamza": ((f"[{HAMZAS}]", HAMZA),),
    "yaa_of_verbs": ((f"([{HAMZA}{NOON}{YAA}{TAA}]{DAMMA}{HAA2}{SUKUN}{YAA}{KASRA})( |$)", rf"\1{YAA}\2"),),
    "kashida": ((KASHIDA, ""),),
    "mid_wasl": ((f"(?!^){WASL}", ""),),
    "round_zero": ((f"(.){ROUND_ZERO}", ""),),
    "long_zero": ((f"{ALIF}{LONG_ZERO} ", " "), (f"{ALIF}{LONG_ZERO}$", ALIF)),
    "madd_iwad": ((f"({_FATH}){ALIF}( |$)", r"\1\2"), (f"{_FATH}$", FATHA + ALIF)),
    "waw_alif": ((WAW + SMALL_ALIF, ALIF),),
    "small_letters": (
        (SMALL_ALIF, ALIF), (SMALL_NOON, NOON), (f"{HAA}{DAMMA}{SMALL_WAW}{MADD}?$", HAA + DAMMA), (SMALL_WAW, WAW), (SMALL_YAA, SMALL_YAA_LINK),
        (f"{HAA}{KASRA}{SMALL_YAA_LINK}{MADD}?$", HAA + KASRA), (SMALL_YAA_LINK, YAA),
    ),
    "word_end": ((f"(?:[{VOWELS}{MADD}]|[{DAM2}{KASR2}](?:{LOW_MEEM}|{SMALL_MEEM})?)$", ""),),
    "taa_marboota": ((f"{TAA_MARBOOTA}$", HAA), (TAA_MARBOOTA, TAA)),
    "divine_name": ((f"({LAM}{KASRA}?{LAM}{SHADDA}{FATHA})({HAA}(?:.|$)(?![{BAA}{WAW}]))", rf"\1{ALIF}\2"),),
    "nasal_merging": (
        (NOON + SMALL_MEEM, MEEM), (f"{FATH2}.( {BAA})", rf"{FATHA}{MEEM}\1"), (f"{DAM2}.( {BAA})", rf"{DAMMA}{MEEM}\1"), (f"{KASR2}.( {BAA})", rf"{KASRA}{MEEM}\1"),
        (f"{FATH2}.( [{HIDING}{MERGING}])", rf"{FATHA}{NOON}\1"), (f"{DAM2}.( [{HIDING}{MERGING}])", rf"{DAMMA}{NOON}\1"), (f"{KASR2}.( [{HIDING}{MERGING}])", rf"{KASRA}{NOON}\1"),
        (FATH2, FATHA + NOON + SUKUN), (DAM2, DAMMA + NOON + SUKUN), (KASR2, KASRA + NOON + SUKUN),
        (f"(?:[{FATHA}{DAMMA}]{YAA}|[{FATHA}{KASRA}]{WAW}|[{MAKSORA}{CONSONANTS}]) ?([{MAKSORA}{CONSONANTS}{WAW}{YAA}]{SHADDA})", r"\1"),
    ),
    "double_sukun": (
        (f"({NOON}){SUKUN}( .[{SUKUN}{SHADDA}])", rf"\1{KASRA}\2"), (f"{FATHA}{ALIF}( .[{SUKUN}{SHADDA}])", rf"{FATHA}\1"), (f"{DAMMA}{WAW}( .[{SUKUN}{SHADDA}])", rf"{DAMMA}\1"),
        (f"{KASRA}{YAA}( .[{SUKUN}{SHADDA}])", rf"{KASRA}\1"), (f"{ALIF}{MADD}( .[{SUKUN}{SHADDA}])", rf"{FATHA}\1"), (f"{WAW}{MADD}( .[{SUKUN}{SHADDA}])", rf"{DAMMA}\1"),
        (f"{YAA}{MADD}( .[{SUKUN}{SHADDA}])", rf"{KASRA}\1"),
    ),
    "initial_shadda": ((f"(^.){SHADDA}", r"\1"),),
    "echo": ((f"([{ECHOED}](?:{SHADDA}$|{SUKUN}|$))", rf"\1{ECHO}"),),
    "doubled": ((f"(.){SHADDA}", r"\1\1"), (SUKUN, "")),
}


def phonetic(c: Column, groups: tuple[str, ...] = tuple(RULES)) -> Column:
    """The text after the named groups of rules, each over the whole text, in the order given. Null stays null.

    An end is the end of the text, never before a last line feed; a dot is any character but a line feed.
    """
    rows = [(pattern, new) for name in groups for pattern, new in RULES[name]]
    return reduce(lambda text, row: F.regexp_replace(text, "(?d)" + row[0].replace("$", r"\z"), row[1].replace("\\", "$")), rows, c)


# Signs of the lengthened script, and letter classes of its sounds.
HIDDEN_NOON, HIDDEN_MEEM, EASED_HAMZA, LEANING, EASING, PAUSE, STOLEN_DAMMA = "\u06ba", "\u06fe", "\u0672", "\u06ea", "\u06ec", "\u06dc", "\u0619"
LONG = {"alif": (FATHA, ALIF, ALIF), "waw": (DAMMA, WAW, SMALL_WAW), "yaa": (KASRA, YAA, SMALL_YAA_LINK)}  # vowel, letter, and its sound when long
NASAL_BEATS, MERGED_BEATS, FIXED_BEATS, USUAL_BEATS = 3, 2, 6, 2

#: A replacement: texts, groups as "$1", and (text, beats) with a number or the name of an option.
Pieces = tuple[str | tuple[str, int | str], ...]


def _long(build) -> tuple[tuple[str, Pieces], ...]:
    return tuple(build(f"({vowel}){letter}", letter, sound) for vowel, letter, sound in LONG.values())


# Rules that give sounds their length, in groups in their order.
LENGTHS: dict[str, tuple[tuple[str, Pieces], ...]] = {
    "nasals": (
        (f"{MEEM} ?{BAA}", (("{hidden_meem}", NASAL_BEATS), BAA)), (f"{NOON} ([{YAA}{WAW}])", ("$1",) * (MERGED_BEATS + 1)), (f"{NOON} ?([{HIDING}])", ((HIDDEN_NOON, NASAL_BEATS), "$1")),
        (f"([{MEEM}{NOON}]){SHADDA}$", ("$1",) * NASAL_BEATS), (f"([{MEEM}{NOON}]){SHADDA}", ("$1",) * (NASAL_BEATS + 1)),
    ),
    "easing": ((ALIF + EASING, (EASED_HAMZA,)),),
    "leaning": ((LEANING + ALIF, (LEANING, (KASHIDA, 2))),),
    "called": (
        (f"((?:^| |(?:(?:^| )[ف{WAW}{HAMZA}]{FATHA}))[{YAA}{HAA}]{FATHA}){ALIF}{MADD}({HAMZA}.(?! ))", ("$1", (ALIF, "separated"), "$2")),
    ),
    "separated": _long(lambda p, _, sound: (f"{p}{MADD}( {HAMZA})", ("$1", (sound, "separated"), "$2"))),
    "joined": (
        *_long(lambda p, _, sound: (f"{p}{MADD}({HAMZA}$)", ("$1", (sound, "joined_pause"), "$2"))),
        *_long(lambda p, _, sound: (f"{p}{MADD}({HAMZA})", ("$1", (sound, "joined"), "$2"))),
    ),
    "fixed": (
        (f"({FATHA}){YAA}{MADD}", ("$1", (YAA, "letter_name"))), (f"({MEEM}{KASRA}){YAA}{MADD}({MEEM}{FATHA})", ("$1", (SMALL_YAA_LINK, "linked_meem"), "$2")),
        *_long(lambda p, _, sound: (f"{p}{MADD}(.(?:{SHADDA}|{SUKUN}|[{NOON}{MEEM}{HIDDEN_NOON}]{{2,3}}))", ("$1", (sound, FIXED_BEATS), "$2"))),
    ),
    "pause": (
        *_long(lambda p, _, sound: (f"{p}([^{SHADDA}](?:{SUKUN}$|$|{PAUSE}))", ("$1", (sound, "pause"), "$2"))),
        (f"({FATHA})([{YAA}{WAW}]){SUKUN}?([^{SHADDA}]{SUKUN}?$)", ("$1", ("$2", "soft"), "$3")),
    ),
    "usual": _long(lambda p, letter, sound: (f"{p}(?![{letter}{SUKUN}{SHADDA}{VOWELS}])", ("$1", (sound, USUAL_BEATS)))),
}
#: Options of a text with their defaults: beats; ``soft`` is that of ``pause`` where none is given, and never more.
OPTIONS = {"separated": 4, "joined": 4, "joined_pause": 4, "pause": 4, "soft": None, "letter_name": 6, "linked_meem": 6, "hidden_meem": "ikhfaa"}


def with_options(df: DataFrame, options: DataFrame, on: str) -> DataFrame:
    """``df`` with a struct ``options`` for each row, from a table of options (``on``, any of ``OPTIONS``); what is missing has its default.

    Beats of a soft vowel above those of a pause are an error, as are beats that are not 2 to 6.
    """
    given = lambda name: F.col(f"_o.{name}") if name in options.columns else F.lit(None)
    beats = {name: F.coalesce(given(name).cast("int"), F.lit(default)) for name, default in OPTIONS.items() if name not in ("soft", "hidden_meem")}
    beats["soft"] = F.coalesce(given("soft").cast("int"), beats["pause"])
    wrong = reduce(lambda a, b: a | b, [~c.between(2, 6) for c in beats.values()]) | (beats["soft"] > beats["pause"])
    meem = F.coalesce(given("hidden_meem").cast("string"), F.lit(OPTIONS["hidden_meem"]))
    own = F.struct(
        *[c.alias(n) for n, c in beats.items() if n not in ("letter_name", "soft", "joined_pause")],
        # the first beat of a soft vowel is its letter; a pause lengthens a joined one at least as far
        (beats["letter_name"] - 1).alias("letter_name"), (beats["soft"] - 1).alias("soft"), F.greatest(beats["joined_pause"], beats["pause"]).alias("joined_pause"),
        F.when(meem == "meem", MEEM).otherwise(HIDDEN_MEEM).alias("hidden_meem"),
    )
    chosen = F.when(wrong, F.raise_error(F.lit("beats must be 2 to 6, and those of a soft vowel not above those of a pause"))).otherwise(own)
    rows = options.select(F.col(on), F.struct(*[c for c in options.columns if c != on]).alias("_o"))
    return df.join(rows, on, "left").withColumn("options", chosen).drop("_o")


def lengthened(c: Column, options: Column, groups: tuple[str, ...] = tuple(LENGTHS)) -> Column:
    """The text with its sounds as long as the options (a struct as ``with_options`` makes it) say. Null stays null."""

    def piece(p: str | tuple[str, int | str]) -> Column:
        if isinstance(p, str):
            return F.lit(p)
        text, beats = p
        text = options["hidden_meem"] if text == "{hidden_meem}" else F.lit(text)
        return F.repeat(text, options[beats] if isinstance(beats, str) else F.lit(beats))

    rows = [row for name in groups for row in LENGTHS[name]]
    return reduce(lambda text, row: F.regexp_replace(text, F.lit(row[0]), F.concat(*[piece(p) for p in row[1]])), rows, c)


# Sounds by attribute; the name that a sound has in the list, and the one that others have.
BREATHED, STOPPED, BETWEEN_STOPS = "فحهخشصسكتث", "ءجدقطبكت", "لنعمر"
HEAVY, COVERED, HEAVY_WITH_R, LIGHTER_BEFORE_I = "خصضغطقظ", "صضطظ", "خصضغطقظر", "غخق"
SIMPLE_ATTRIBUTES = {
    "breath": (BREATHED, "hams", "jahr"), "cover": (COVERED, "motbaq", "monfateh"), "whistle": ("صسز", "safeer", "no_safeer"), "repeat": ("ر", "mokarar", "not_mokarar"),
    "spread": ("ش", "motafashie", "not_motafashie"), "stretch": ("ض", "mostateel", "not_mostateel"), "nasal": (NOON + MEEM + HIDDEN_NOON + HIDDEN_MEEM, "maghnoon", "not_maghnoon"),
}


def with_neighbours(chunks: Column) -> Column:
    """Array of structs (chunk, before, after) for an array of chunks; the neighbours come along, so that none is looked up."""
    n = F.greatest(F.size(chunks) - 1, F.lit(0))
    none = F.array(F.lit(""))
    zipped = F.arrays_zip(chunks.alias("chunk"), F.concat(none, F.slice(chunks, 1, n)).alias("before"), F.concat(F.slice(chunks, 2, n), none).alias("after"))
    return F.filter(zipped, lambda s: s["chunk"].isNotNull())


def sound_attributes(chunk: Column, before: Column, after: Column) -> list[Column]:
    """The ten attributes of a chunk, of which ``weight`` looks at the chunks beside it.

    A long alif is as heavy as the sound before it, a hidden noon as the one after it; light where there is none.
    """
    inside = lambda c, letters: (c != "") & F.lit(letters).contains(c)
    first, last = F.substring(chunk, 1, 1), F.substring(chunk, -1, 1)
    before, after = (F.substring(F.coalesce(c, F.lit("")), 1, 1) for c in (before, after))
    heavy = lambda test: F.when(test, "mofakham").otherwise("moraqaq")
    weight = (
        F.when(first == HIDDEN_NOON, heavy(inside(after, HEAVY)))
        .when(first == ALIF, heavy(inside(before, HEAVY_WITH_R)))
        .when(inside(first, LIGHTER_BEFORE_I) & (last == KASRA), "low_mofakham")
        .otherwise(heavy(inside(first, HEAVY)))
    )
    simple = [F.when(inside(first, letters), yes).otherwise(no).alias(name) for name, (letters, yes, no) in SIMPLE_ATTRIBUTES.items()]
    stop = F.when(inside(first, STOPPED), "shadeed").when(inside(first, BETWEEN_STOPS), "between").otherwise("rikhw").alias("stop")
    echoed = F.when(~inside(last, VOWELS) & inside(first, ECHOED), "moqalqal").otherwise("not_moqalqal").alias("echo")
    return [*simple, stop, weight.alias("weight"), echoed]


def last_slice(values: Column, chunks: Column, word: Column) -> Column:
    """The values that belong to a word's chunks: those at the last place where ``chunks`` has them in a row, else the last ones, as many.

    ``values`` go with ``chunks`` from the first on, and may be fewer; an empty word has none.
    """
    n = F.size(word)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(chunks) - n + 1, F.lit(1))), lambda i: F.slice(chunks, i, n) == word)
    tail = F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, n)
    return F.when(n == 0, F.slice(values, 1, 0)).when(F.size(places) > 0, F.slice(values, F.array_max(places), n)).otherwise(tail)
