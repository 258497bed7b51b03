"""Concepts, transliterated terms and attribute labels over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wadi.functions import phonetics as P
from wadi.operators import concepts as C
from wadi.operators import rewriting as R
from wadi.plans.tables import table

#: Phrases of the driver's invented prose stand for the lists of a real corpus.
FRAME, SIGNALS, BETWEEN = ("the", "la", "le", "der"), ("is that", "of the", "tion"), r"\s+(?:and|or|et|und)\s+"
TERMS = (("of the", "du"), ("in the", "{match} (dans)"), ("the", "{match} [le]"), ("tion", "T"), ("that the of", "x"), ("in", "i-n"), ("to", "à"), ("erblest", "bl"), ("onble", "{match}{match}"))


def attribute_names(spark, sf):
    o, n = table(spark, sf, "orders"), len(C.LABELS)
    heads, tokens = (F.array(*[F.lit(x[i]) for x in C.LABELS]) for i in (0, 1))
    head = F.element_at(heads, (F.col("o_orderkey") % n + 1).cast("int"))
    token = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderstatus")).otherwise(F.element_at(tokens, ((F.col("o_orderkey") + F.col("o_custkey") % 2) % n + 1).cast("int")))
    return o.groupBy(head.alias("head"), C.attribute_label(head, token).alias("label")).agg(F.count("*").alias("n"))


def alias_keys(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.md5(C.transliteration_key(F.col("text"))).alias("key_md5"), F.md5(C.alias_key(F.col("text"))).alias("alias_md5"))


def attached_concepts(spark, sf):
    parts = C.split_concepts(F.coalesce("text", F.lit("")), FRAME, r"\s+(?:de|of)\s+")
    return table(spark, sf, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|")).alias("parts_md5"))


def contrasted_concepts(spark, sf):
    parts = C.comparative_concepts(F.col("text"), SIGNALS, FRAME, BETWEEN)
    d = table(spark, sf, "documents").select("doc_id", parts.alias("c"))
    joiner = F.when(F.col("doc_id") % 2 == 0, " and ").otherwise(" و")
    return d.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("concepts_md5"), F.md5(F.coalesce(C.contrast_query(F.col("c"), joiner), F.lit(""))).alias("query_md5"))


def expanded_terms(spark, sf):
    lookup = spark.createDataFrame(list(TERMS), "key string, replacement string")
    return C.expand_terms(table(spark, sf, "benchmark").select("item_id", "text"), "text", lookup, 3).select("item_id", "expanded")


def _ranked(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_tax").alias("l_tax"))
    li = li.withColumn("doc_id", F.col("l_linenumber").cast("long"))
    ranked = li.select("query_id", "doc_id", F.col("l_linenumber").cast("int").alias("rank"), (1 / F.col("l_linenumber")).alias("score"))
    sides = F.array(F.struct(F.lit(0).alias("place"), F.lit("first").alias("concept"), (F.col("l_quantity") / 50).cast("double").alias("concept_score")),
                    F.struct(F.lit(1).alias("place"), F.lit("second").alias("concept"), (F.col("l_tax") * 10).cast("double").alias("concept_score")))
    return ranked, li.select("query_id", "doc_id", F.inline(sides))


def concept_tags(spark, sf):
    return C.tag_concepts(*_ranked(spark, sf), pool=5).select("query_id", "doc_id", "concept")


def promoted_concepts(spark, sf):
    return C.promote_each_concept(C.tag_concepts(*_ranked(spark, sf), pool=7), ("first", "second"), 0.15).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def balanced_concepts(spark, sf):
    return C.balance_concepts(C.tag_concepts(*_ranked(spark, sf)), ("first", "second"), 4, 2, 0.15).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


#: Letters of the driver's prose stand for letters and signs that the rules are about.
LATIN = "abcdefghilmnopqrstuvxéèê.,"
SCRIPT = "".join((P.FATHA, P.BAA, P.SUKUN, P.SHADDA, P.KASRA, P.TAA_MARBOOTA, P.HAMZAS[1], P.HAA, P.DAMMA, P.LAM, P.MEEM, P.NOON, P.ALIF, P.YAA, P.MAKSORA, P.WAW, P.FATH2, P.DAM2, P.SMALL_ALIF, P.SMALL_WAW, P.WASL, P.KASR2, P.SMALL_MEEM, P.MADD, P.ROUND_ZERO, P.LONG_ZERO))
GROUPS = tuple(g for g in P.RULES if g not in ("mid_wasl", "divine_name"))  # these look around, which the SQL's expressions cannot


def phonetic_texts(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.md5(P.phonetic(F.translate(F.lower("text"), LATIN, SCRIPT), GROUPS)).alias("phonetic_md5"))


#: Rules whose map the SQL can tell by counting; here f and g stand for kashida and an echoed letter too.
MAPPED = tuple((find.replace("$", r"\Z"), new) for g in ("hamza", "kashida", "echo", "doubled") for find, new in P.RULES[g])
MAPPED_SCRIPT = SCRIPT.translate({ord(P.TAA_MARBOOTA): P.KASHIDA, ord(P.NOON): "ق"})


def phonetic_maps(spark, sf):
    """Code points of every text that are not copied as one, with the interval that stands for them after the rules."""
    d = table(spark, sf, "documents").select("doc_id", F.translate(F.lower("text"), LATIN, MAPPED_SCRIPT).alias("t"))
    rows = R.char_rows(R.with_map(d, "t", MAPPED, ["doc_id"]), ["doc_id"])
    return rows.where(F.col("deleted") | (F.col("end") - F.col("start") != 1)).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("place", "start", "end")), "deleted")


QUERIES = {f.__name__: f for f in (phonetic_texts, phonetic_maps, attribute_names, alias_keys, attached_concepts, contrasted_concepts, expanded_terms, concept_tags, promoted_concepts, balanced_concepts)}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


_APOSTROPHES, _WORD = C.APOSTROPHES.replace("'", "''"), C.LATIN_WORD.replace("'", "''")
_KEY = rf"trim(regexp_replace(regexp_replace(lower({{0}}), '{_APOSTROPHES}', '''', 'g'), '[\s\-]+', ' ', 'g'))"
_WITHOUT = rf"array_to_string(list_filter(string_split_regex(p, '\s+'), lambda w: length(w) >= {{0}} AND w NOT IN {FRAME}), ' ')"


def _unsignalled(text: str) -> str:
    for phrase in sorted(SIGNALS, key=len, reverse=True):
        for _ in range(2):  # neighbours share the character between them
            text = rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_]){phrase}($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1 \2', 'g')"
    return text


_TAGS = """t AS (SELECT l_orderkey AS query_id, l_linenumber::BIGINT AS doc_id, l_linenumber AS rank, 1 / l_linenumber AS score, (min(l_quantity) / 50)::DOUBLE AS a, (min(l_tax) * 10)::DOUBLE AS b FROM lineitem GROUP BY l_orderkey, l_linenumber),
  g AS (SELECT query_id, doc_id, rank, score, CASE WHEN rank <= {0} AND greatest(a, b) >= 0.3 AND greatest(a, b) >= 1.3 * least(a, b) THEN CASE WHEN a >= b THEN 'first' ELSE 'second' END END AS concept FROM t)"""
_MOVE = """SELECT * EXCLUDE (spot), CASE WHEN spot > 3 AND side >= 0.15 THEN CASE WHEN r = spot THEN 3 WHEN r BETWEEN 3 AND spot - 1 THEN r + 1 ELSE r END ELSE r END AS moved
  FROM (SELECT *, min(r) FILTER (WHERE concept = '{0}') OVER q AS spot, arg_min(score, r) FILTER (WHERE concept = '{0}') OVER q AS side FROM {1} WINDOW q AS (PARTITION BY query_id))"""
# The rules of ``phonetic_texts`` in plain code points, apart from the library's names.
_PLAIN_RULES = (
    ('(^.)\u0652', '\\1\u0650'),
    ('((?:\u064b\u06ed|\u064b\u06e2|\u064b))\u0649', '\\1'),
    ('(\u064e)\u0649( |$)', '\\1\u0627\\2'),
    ('\u0649\u0670', '\u0627'),
    ('\u0650\u0649', '\u0650\u064a'),
    ('\u0649([\u064e\u064f\u0650\u0652\u0651\u064c\u0653])', '\u064a\\1'),
    ('[\u0621\u0623\u0625\u0624\u0626\u0654]', '\u0621'),
    ('([\u0621\u0646\u064a\u062a]\u064f\u062d\u0652\u064a\u0650)( |$)', '\\1\u064a\\2'),
    ('\u0640', ''),
    ('(.)\u06df', ''),
    ('\u0627\u06e0 ', ' '),
    ('\u0627\u06e0$', '\u0627'),
    ('((?:\u064b\u06ed|\u064b\u06e2|\u064b))\u0627( |$)', '\\1\\2'),
    ('(?:\u064b\u06ed|\u064b\u06e2|\u064b)$', '\u064e\u0627'),
    ('\u0648\u0670', '\u0627'),
    ('\u0670', '\u0627'),
    ('\u06e8', '\u0646'),
    ('\u0647\u064f\u06e5\u0653?$', '\u0647\u064f'),
    ('\u06e5', '\u0648'),
    ('\u06e7', '\u06e6'),
    ('\u0647\u0650\u06e6\u0653?$', '\u0647\u0650'),
    ('\u06e6', '\u064a'),
    ('(?:[\u064e\u064f\u0650\u0653]|[\u064c\u064d](?:\u06ed|\u06e2)?)$', ''),
    ('\u0629$', '\u0647'),
    ('\u0629', '\u062a'),
    ('\u0646\u06e2', '\u0645'),
    ('\u064b.( \u0628)', '\u064e\u0645\\1'),
    ('\u064c.( \u0628)', '\u064f\u0645\\1'),
    ('\u064d.( \u0628)', '\u0650\u0645\\1'),
    ('\u064b.( [\u062a\u062b\u062c\u062f\u0630\u0632\u0633\u0634\u0635\u0636\u0637\u0638\u0641\u0642\u0643\u064a\u0631\u0645\u0644\u0648\u0646])', '\u064e\u0646\\1'),
    ('\u064c.( [\u062a\u062b\u062c\u062f\u0630\u0632\u0633\u0634\u0635\u0636\u0637\u0638\u0641\u0642\u0643\u064a\u0631\u0645\u0644\u0648\u0646])', '\u064f\u0646\\1'),
    ('\u064d.( [\u062a\u062b\u062c\u062f\u0630\u0632\u0633\u0634\u0635\u0636\u0637\u0638\u0641\u0642\u0643\u064a\u0631\u0645\u0644\u0648\u0646])', '\u0650\u0646\\1'),
    ('\u064b', '\u064e\u0646\u0652'),
    ('\u064c', '\u064f\u0646\u0652'),
    ('\u064d', '\u0650\u0646\u0652'),
    ('(?:[\u064e\u064f]\u064a|[\u064e\u0650]\u0648|[\u0649\u0628\u062a\u062b\u062c\u062d\u062e\u062f\u0630\u0631\u0632\u0633\u0634\u0635\u0636\u0637\u0638\u0639\u063a\u0641\u0642\u0643\u0644\u0645\u0646\u0647]) ?([\u0649\u0628\u062a\u062b\u062c\u062d\u062e\u062f\u0630\u0631\u0632\u0633\u0634\u0635\u0636\u0637\u0638\u0639\u063a\u0641\u0642\u0643\u0644\u0645\u0646\u0647\u0648\u064a]\u0651)', '\\1'),
    ('(\u0646)\u0652( .[\u0652\u0651])', '\\1\u0650\\2'),
    ('\u064e\u0627( .[\u0652\u0651])', '\u064e\\1'),
    ('\u064f\u0648( .[\u0652\u0651])', '\u064f\\1'),
    ('\u0650\u064a( .[\u0652\u0651])', '\u0650\\1'),
    ('\u0627\u0653( .[\u0652\u0651])', '\u064e\\1'),
    ('\u0648\u0653( .[\u0652\u0651])', '\u064f\\1'),
    ('\u064a\u0653( .[\u0652\u0651])', '\u0650\\1'),
    ('(^.)\u0651', '\\1'),
    ('([\u0642\u0637\u0628\u062c\u062f](?:\u0651$|\u0652|$))', '\\1\u0687'),
    ('(.)\u0651', '\\1\\1'),
    ('\u0652', ''),
)
_ECHOED = "('\u0642', '\u0637', '\u0628', '\u062c', '\u062f')"
_PHONETIC = f"translate(lower(text), '{LATIN}', '{SCRIPT}')"
for _pattern, _new in _PLAIN_RULES:
    _PHONETIC = f"regexp_replace({_PHONETIC}, '{_pattern}', '{_new}', 'g')"
SQL = {
    "phonetic_texts": f"SELECT doc_id, md5({_PHONETIC}) AS phonetic_md5 FROM documents WHERE text IS NOT NULL",
    "phonetic_maps": f"""WITH c AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) - 1 AS place
        FROM (SELECT doc_id, translate(lower(text), '{LATIN}', '{MAPPED_SCRIPT}') AS t FROM documents WHERE text <> '')),
      k AS (SELECT *, lag(c) OVER w AS one, lag(c, 2) OVER w AS two, lead(c) OVER w IS NULL AS last FROM c WHERE c <> '\u0640' WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
      n AS (SELECT c.doc_id, c.place, CASE WHEN c.c IN ('\u0640', '\u0652') OR c.c = '\u0651' AND one = '\u0652' AND coalesce(two NOT IN {_ECHOED}, true) THEN 0 ELSE 1 END AS own, CASE WHEN one = '\u0652' AND two IN {_ECHOED} OR last AND k.c = chr(10) AND (one IN {_ECHOED} OR one = '\u0651' AND two IN {_ECHOED}) THEN 1 ELSE 0 END AS echo
        FROM c LEFT JOIN k USING (doc_id, place)),
      p AS (SELECT *, sum(own + echo) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM n)
      SELECT doc_id, place, CAST(upto - own - echo AS BIGINT) AS start, CAST(upto AS BIGINT) AS end, own + echo = 0 AS deleted FROM p WHERE own + echo <> 1""",
    "attribute_names": f"""WITH l(i, head, token, name) AS (VALUES {_values((i, *x) for i, x in enumerate(C.LABELS))}),
      o AS (SELECT h.head, CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus ELSE k.token END AS token FROM orders JOIN l h ON h.i = o_orderkey % {len(C.LABELS)} JOIN l k ON k.i = (o_orderkey + o_custkey % 2) % {len(C.LABELS)})
      SELECT o.head, coalesce(l.name, o.token) AS label, count(*) AS n FROM o LEFT JOIN l ON l.head = o.head AND l.token = o.token GROUP BY ALL""",
    "alias_keys": rf"SELECT doc_id, md5({_KEY.format('text')}) AS key_md5, md5(trim(regexp_replace(regexp_replace(lower(trim(text)), '[-_]+', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS alias_md5 FROM documents WHERE text IS NOT NULL",
    "attached_concepts": rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(coalesce(text, '')), '\s+(?:de|of)\s+'), lambda p: {_WITHOUT.format(2)}), lambda p: p <> '') AS c FROM documents)
      SELECT doc_id, CASE WHEN len(c) >= 2 THEN len(c) ELSE 0 END AS n, md5(CASE WHEN len(c) >= 2 THEN array_to_string(c, '|') ELSE '' END) AS parts_md5 FROM d""",
    "contrasted_concepts": rf"""WITH a AS (SELECT doc_id, regexp_replace(lower(trim(coalesce(text, ''))), '[؟?،,!.:;]+', ' ', 'g') AS t FROM documents),
      b AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_unsignalled('t')}, '{BETWEEN}'), lambda p: {_WITHOUT.format(1)}), lambda p: length(p) >= 2) AS c FROM a),
      x AS (SELECT *, regexp_extract(c[-1], '^(.*\S)\s+(in|during)\s+(\S.*)$', 1) AS core, ' ' || regexp_extract(c[-1], '^(.*\S)\s+(in|during)\s+(\S.*)$', 2) || ' ' || regexp_extract(c[-1], '^(.*\S)\s+(in|during)\s+(\S.*)$', 3) AS tail FROM b),
      y AS (SELECT doc_id, CASE WHEN len(c) >= 2 AND core <> '' THEN list_transform(list_append(c[:-2], core), lambda p: p || tail) ELSE c END AS c FROM x),
      z AS (SELECT *, regexp_extract(c[1], '^(.*\S)\s+(in|during)\s+(\S.*)$', 1) AS one, ' ' || regexp_extract(c[1], '^(.*\S)\s+(in|during)\s+(\S.*)$', 2) || ' ' || regexp_extract(c[1], '^(.*\S)\s+(in|during)\s+(\S.*)$', 3) AS tail, CASE WHEN doc_id % 2 = 0 THEN ' and ' ELSE ' و' END AS j FROM y)
      SELECT doc_id, len(c) AS n, md5(array_to_string(c, '|')) AS concepts_md5,
        md5(replace(CASE WHEN one <> '' AND len(list_filter(c, lambda p: NOT ends_with(p, tail))) = 0 THEN array_to_string(list_transform(c, lambda p: p[:length(p) - length(tail)]), chr(1)) || tail ELSE coalesce(array_to_string(c, chr(1)), '') END, chr(1), j)) AS query_md5 FROM z""",
    "expanded_terms": rf"""WITH RECURSIVE l(key, replacement) AS (VALUES {_values(TERMS)}), t AS (SELECT item_id, text, regexp_extract_all(text, '{_WORD}|[^A-Za-z]+') AS k FROM benchmark),
      s AS (SELECT item_id, k, unnest(range(1, len(k) + 1)) AS i FROM t),
      g AS (SELECT item_id, i, n, array_to_string(k[i:i + 2 * n - 2], '') AS span FROM s, range(1, 4) r(n) WHERE i + 2 * n - 2 <= len(k) AND regexp_matches(k[i], '^[A-Za-z]') AND (n < 2 OR regexp_full_match(k[i + 1], '[\s\-]+')) AND (n < 3 OR regexp_full_match(k[i + 3], '[\s\-]+'))),
      f AS (SELECT *, {_KEY.format('span')} AS key FROM g),
      m AS (SELECT f.*, l.replacement, 0 AS form FROM f JOIN l USING (key) UNION ALL SELECT f.*, l.replacement, 1 FROM f JOIN l ON f.key LIKE '%s' AND length(f.key) > 4 AND l.key = f.key[:-2]),
      b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY item_id, i ORDER BY n DESC, form) = 1),
      x AS (SELECT s.item_id, s.i AS spot, min(b.i) OVER (PARTITION BY s.item_id ORDER BY s.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i FROM s LEFT JOIN b ON b.item_id = s.item_id AND b.i = s.i),
      w AS (SELECT item_id, 1::BIGINT AS spot, '' AS done FROM t UNION ALL
        SELECT w.item_id, b.i + 2 * b.n - 1, w.done || array_to_string(t.k[w.spot:b.i - 1], '') || replace(b.replacement, '{{match}}', b.span) FROM w JOIN x USING (item_id, spot) JOIN b ON b.item_id = x.item_id AND b.i = x.i JOIN t ON t.item_id = w.item_id)
      SELECT t.item_id, coalesce(arg_max(w.done || array_to_string(t.k[w.spot:], ''), w.spot), any_value(t.text)) AS expanded FROM t JOIN w USING (item_id) GROUP BY t.item_id""",
    "concept_tags": f"WITH {_TAGS.format(5)} SELECT query_id, doc_id, concept FROM g",
    "promoted_concepts": f"""WITH {_TAGS.format(7)}, h AS (SELECT query_id, doc_id, score, concept, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS r FROM g),
      i AS (SELECT query_id, doc_id, score, concept, moved AS r FROM ({_MOVE.format('first', 'h')})) SELECT query_id, doc_id, moved::BIGINT AS rank FROM ({_MOVE.format('second', 'i')})""",
}
