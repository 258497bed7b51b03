"""Contrasted concepts of a query, balance of results between them, transliterated terms, attribute labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wadi.functions import text as T

Words = tuple[str, ...]

#: A lookup of up to so many keys is broadcast; a larger one is merged by key.
LOOKUP_ROWS = 100_000

#: Marks written for one apostrophe, and a word of a transliteration.
APOSTROPHES = "['’`ʿʾ]"
LATIN_WORD = "[A-Za-z][A-Za-z'’`ʿʾ]*"
#: Fixed value: the conjunction that joins two concepts.
ATTACHED_AND = r"\s+و(?:ال)?\s*"
#: Fixed value: what stands between two contrasted concepts.
SEPARATORS = r"(?iU)\b(?:and|vs|versus|or)\b|(?<!\w)(?:مع|عن)(?!\w)|(?<=\s)و(?=\S)|\bو\b"
#: Fixed value: a context that ends the last concept and holds for all.
SHARED_CONTEXT = r"(?i)^(.*\S)\s+(في|in|during)\s+(\S.*)$"
#: Words of a context that name a source only.
SOURCE_WORDS = ("القران", "والقران", "السنه", "والسنه", "الحديث", "والحديث", "الاحاديث", "الاسلام", "الكتاب", "quran", "qur'an", "sunnah", "sunna", "hadith", "hadiths", "islam")
#: A tag's pool, least score and lead; least share of the best score and least side score of a promotion.
TAG_POOL, TAG_LEAST, TAG_LEAD, BALANCE_SHARE, SIDE_LEAST = 30, 0.3, 1.3, 0.4, 0.05
#: Attribute, label of the model's vocabulary, name.
LABELS = (
    ("hams_or_jahr", "[همس]", "hams"), ("hams_or_jahr", "[جهر]", "jahr"),
    ("shidda_or_rakhawa", "[شديد]", "shadeed"), ("shidda_or_rakhawa", "[بين الشدة والرخاوة]", "between"), ("shidda_or_rakhawa", "[رخو]", "rikhw"),
    ("tafkheem_or_taqeeq", "[مفخم]", "mofakham"), ("tafkheem_or_taqeeq", "[مرقق]", "moraqaq"), ("tafkheem_or_taqeeq", "[أدنى المفخم]", "low_mofakham"),
    ("itbaq", "[مطبق]", "motbaq"), ("itbaq", "[منفتح]", "monfateh"), ("safeer", "[صفير]", "safeer"), ("safeer", "[لا صفير]", "no_safeer"),
    ("qalqla", "[مقلقل]", "moqalqal"), ("qalqla", "[لا قلقلة]", "not_moqalqal"), ("tikraar", "[مكرر]", "mokarar"), ("tikraar", "[لا تكرار]", "not_mokarar"),
    ("tafashie", "[متفشي]", "motafashie"), ("tafashie", "[لا تفشي]", "not_motafashie"), ("istitala", "[مستطيل]", "mostateel"), ("istitala", "[لا إستطالة]", "not_mostateel"),
    ("ghonna", "[مغن]", "maghnoon"), ("ghonna", "[لا غنة]", "not_maghnoon"),
)


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def attribute_label(head: Column, token: Column) -> Column:
    """English name of an attribute's label; any other token stays as it is."""
    names = F.create_map(*[F.lit(x) for h, label, name in LABELS for x in (f"{h}|{label}", name)])
    return F.coalesce(F.try_element_at(names, F.concat_ws("|", head, token)), token)


def transliteration_key(c: Column) -> Column:
    """Small letters, one apostrophe, words parted by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), APOSTROPHES, "'"), r"[\s\-]+", " "))


def alias_key(c: Column) -> Column:
    """Small letters, hyphens and underscores as spaces, normalised, spaces squeezed."""
    return T.squeeze(T.normalize_arabic(F.regexp_replace(F.lower(F.trim(c)), "[-_]+", " ")))


def _without(part: Column, frame: Words, least: int) -> Column:
    return F.concat_ws(" ", F.filter(F.split(part, r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(*frame)))


def split_concepts(query: Column, frame: Words, separator: str = ATTACHED_AND) -> Column:
    """Parts of the normalised query without frame words and single letters; fewer than two parts are none."""
    parts = F.transform(F.split(T.normalize_arabic(query), separator), lambda p: _without(p, frame, 2))
    kept = F.filter(parts, lambda p: p != "")
    return F.when(F.size(kept) >= 2, kept).otherwise(F.array().cast("array<string>"))


def comparative_concepts(query: Column, signals: Words, frame: Words, separator: str = SEPARATORS, context: str = SHARED_CONTEXT, source_words: Words = SOURCE_WORDS) -> Column:
    """Concepts that a query contrasts: signals (whole words, longest first) and frame words go, the rest is split.

    A context at the end of the last concept is put behind all of them, unless it only names sources.
    One concept or none is given as it is; null is an empty array.
    """
    text = F.regexp_replace(F.lower(T.normalize_arabic(F.coalesce(query, F.lit("")))), "[؟?،,!.:;]+", " ")
    for phrase in sorted(signals, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?U)(?<!\w){re.escape(phrase)}(?!\w)", " ")
    found = F.filter(F.transform(F.split(text, separator), lambda p: _without(p, frame, 1)), lambda p: F.length(p) >= 2)

    def share(found: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        core, link, shared = (F.regexp_extract(last, context, i) for i in (1, 2, 3))
        cut = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(core))
        framing = F.forall(F.filter(F.split(shared, r"\s+|(?<=\s)و"), lambda w: w != ""), lambda w: w.isin(*source_words))
        spread = F.when(framing, cut).otherwise(F.transform(cut, lambda c: F.concat_ws(" ", c, link, shared)))
        return F.when((F.size(found) >= 2) & (core != ""), spread).otherwise(found)

    return _with(found, share)


def contrast_query(concepts: Column, joiner: Column, context: str = SHARED_CONTEXT) -> Column:
    """The concepts joined; a context that all of them end with is written once, at the end."""

    def join(concepts: Column) -> Column:
        first = F.try_element_at(concepts, F.lit(1))
        tail = F.concat_ws(" ", F.regexp_extract(first, context, 2), F.regexp_extract(first, context, 3))
        shared = (F.regexp_extract(first, context, 1) != "") & F.forall(concepts, lambda c: c.endswith(tail))
        bare = F.transform(concepts, lambda c: F.substring(c, F.lit(1), F.length(c) - F.length(tail) - 1))
        joined = F.when(shared, F.concat(F.array_join(bare, "\0"), F.lit(" "), tail)).otherwise(F.array_join(concepts, "\0"))
        return F.replace(joined, F.lit("\0"), joiner)

    return _with(concepts, join)


def expand_terms(rows: DataFrame, text: str, lookup: DataFrame, most_words: int) -> DataFrame:
    """``rows`` with ``expanded``: phrases of the lookup (key, replacement) replaced, from left to right, the longest first.

    Words of a phrase are parted by spaces or hyphens only. A key of five letters and more that ends in s
    is also looked up without it. ``{match}`` in a replacement is the text replaced. Candidates meet the
    lookup in a join and only matches are gathered, by row. Of equal keys the least replacement is taken.
    Null stays null. Made for queries: output is copied once for each match of a text.
    """
    known = lookup.groupBy("key").agg(F.min("replacement").alias("replacement"))
    parts = F.regexp_extract_all(text, F.lit(f"({LATIN_WORD}|[^A-Za-z]+)"), F.lit(1))
    cut = rows.select("*", F.col(text).alias("_text"), F.sha2(text, 256).alias("_row"), parts.alias("_tokens"))
    sizes = F.sequence(F.lit(1), F.lit(most_words))

    def phrases(word: Column, at: Column) -> Column:
        at_each = F.transform(sizes, lambda n: F.struct((at + 1).alias("i"), n.alias("n"), F.slice("_tokens", at + 1, 2 * n - 1).alias("t")))
        fits = F.filter(at_each, lambda p: (F.size(p["t"]) == 2 * p["n"] - 1) & F.forall(p["t"], lambda t: t.rlike(rf"^(?:{LATIN_WORD}|[\s\-]+)$")))
        return F.when(word.rlike("^[A-Za-z]"), F.transform(fits, lambda p: F.struct(p["i"].alias("i"), p["n"].alias("n"), F.array_join(p["t"], "").alias("span"))))

    texts = cut.where(F.col("_text").isNotNull()).select("_row", "_tokens").dropDuplicates(["_row"])
    spans = texts.select("_row", F.explode(F.transform("_tokens", phrases)).alias("p")).where("p IS NOT NULL").select("_row", F.inline("p"))
    keyed = spans.withColumn("key", transliteration_key(F.col("span")))
    singular = F.when(F.col("key").endswith("s") & (F.length("key") > 4), F.expr("left(key, length(key) - 1)"))
    forms = keyed.select("_row", "i", "n", "span", F.posexplode(F.array_compact(F.array("key", singular))).alias("form", "key"))
    match = F.struct("i", (-F.col("n")).alias("less"), "form", "span", "replacement")
    known = F.broadcast(known) if known.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else known.hint("merge")
    found = forms.join(known, "key").groupBy("_row").agg(F.sort_array(F.collect_list(match)).alias("_found"))
    out = cut.join(found, "_row", "left")

    def step(done: Column, m: Column) -> Column:
        before = F.array_join(F.slice("_tokens", done["at"], F.greatest(m["i"] - done["at"], F.lit(0))), "")
        after = F.struct((m["i"] - 2 * m["less"] - 1).alias("at"), F.concat(done["text"], before, F.replace(m["replacement"], F.lit("{match}"), m["span"])).alias("text"))
        return F.when(m["i"] < done["at"], done).otherwise(after)

    folded = F.aggregate("_found", F.struct(F.lit(1).alias("at"), F.lit("").alias("text")), step, lambda d: F.concat(d["text"], F.array_join(F.slice("_tokens", d["at"], F.size("_tokens")), "")))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(folded, F.col("_text")).alias("expanded"))


def tag_concepts(ranked: DataFrame, scores: DataFrame, pool: int = TAG_POOL, least: float = TAG_LEAST, lead: float = TAG_LEAD) -> DataFrame:
    """``ranked`` (query_id, doc_id, rank, score) with ``concept``: the one that a result of the pool is evidence for, else null.

    ``scores``: (query_id, doc_id, place, concept, concept_score); a concept needs ``least`` and ``lead`` times
    the next one's score; of equal scores the first place is the best.
    """
    head = ranked.where(F.col("rank") <= pool).select("query_id", "doc_id")
    order = F.sort_array(F.collect_list(F.struct((-F.col("concept_score")).alias("less"), "place", "concept")))
    best = scores.join(head, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id").agg(order.alias("o"))
    top, other = -F.col("o")[0]["less"], F.coalesce(-F.try_element_at("o", F.lit(2))["less"], F.lit(0.0))
    tags = best.where((top >= least) & (top >= lead * other)).select("query_id", "doc_id", F.col("o")[0]["concept"].alias("concept"))
    return ranked.join(tags, ["query_id", "doc_id"], "left")


def _lists(tagged: DataFrame) -> DataFrame:
    """(query_id, r): results in order, ranks without gaps or ties."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score", "concept")))
    placed = F.transform(rows, lambda x, i: F.struct((i + 1).alias("rank"), x["doc_id"].alias("doc_id"), x["score"].alias("score"), x["concept"].alias("concept")))
    return tagged.groupBy("query_id").agg(placed.alias("r"))


def _ranks(lists: DataFrame) -> DataFrame:
    return lists.select("query_id", F.posexplode("r").alias("at", "x")).select("query_id", "x.doc_id", "x.score", "x.concept", (F.col("at") + 1).alias("rank"))


def balance_concepts(tagged: DataFrame, concepts: Words, top_k: int, each: int, share: float = BALANCE_SHARE) -> DataFrame:
    """Ranks anew so that up to ``each`` results of every concept are among the first ``top_k`` of a query.

    A result moves up if it has ``share`` of the best score; the last one of the head that has no concept,
    or one that more than ``each`` results share, makes room and leads the tail. The head is then ordered
    by score. A query of no more than ``top_k`` results stays. Lists are the bounded results of a query.
    """
    score = lambda x: F.coalesce(x["score"], F.lit(0.0))

    def step(s: Column, c: Column) -> Column:
        of = lambda rows, name: F.size(F.filter(rows, lambda y: y["concept"] == name))
        ready = F.filter(s["tail"], lambda x: (x["concept"] == c) & (score(x) >= s["floor"]))
        spare = F.filter(s["head"], lambda x: x["concept"].isNull() | ((x["concept"] != c) & (of(s["head"], x["concept"]) > each)))
        goes, comes = F.try_element_at(spare, F.lit(-1)), F.try_element_at(ready, F.lit(1))
        head = F.concat(F.filter(s["head"], lambda x: x["rank"] != goes["rank"]), F.array(comes))
        tail = F.concat(F.array(goes), F.filter(s["tail"], lambda x: x["rank"] != comes["rank"]))
        moved = F.struct(head.alias("head"), tail.alias("tail"), s["floor"].alias("floor"))
        return F.when((of(s["head"], c) < each) & goes.isNotNull() & comes.isNotNull(), moved).otherwise(s)

    turns = F.array(*[F.lit(c) for c in concepts for _ in range(each)]).cast("array<string>")
    begin = F.struct(F.slice("r", 1, top_k).alias("head"), F.slice("r", top_k + 1, F.greatest(F.size("r"), F.lit(1))).alias("tail"), (score(F.col("r")[0]) * share).alias("floor"))
    by_score = lambda head: F.transform(
        F.sort_array(F.transform(head, lambda x, i: F.struct((-score(x)).alias("less"), i.alias("i"), x.alias("x")))), lambda y: y["x"]
    )
    if not each:
        return _ranks(_lists(tagged))
    done = F.aggregate(turns, begin, step, lambda s: F.concat(by_score(s["head"]), s["tail"]))
    return _ranks(_lists(tagged).select("query_id", F.when(F.size("r") > top_k, done).otherwise(F.col("r")).alias("r")))


def promote_each_concept(tagged: DataFrame, concepts: Words, least: float = SIDE_LEAST) -> DataFrame:
    """Ranks anew: of each concept in turn, the first result goes to the third place if it is behind it and has the score."""

    def step(r: Column, c: Column) -> Column:
        at = F.array_position(F.transform(r, lambda x: F.coalesce(x["concept"] == c, F.lit(False))), F.lit(True)).cast("int")
        item = F.try_element_at(r, F.greatest(at, F.lit(1)))
        moved = F.concat(F.slice(r, 1, 2), F.array(item), F.slice(r, F.lit(3), F.greatest(at - 3, F.lit(0))), F.slice(r, at + 1, F.size(r)))
        return F.when((at > 3) & (F.coalesce(item["score"], F.lit(0.0)) >= least), moved).otherwise(r)

    turns = F.array(*[F.lit(c) for c in concepts]).cast("array<string>")
    return _ranks(_lists(tagged).select("query_id", F.aggregate(turns, F.col("r"), step).alias("r")))
