"""Lengths and attributes of sounds over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wadi.functions import phonetics as P
from wadi.operators.session import phoneme_chunks
from wadi.plans.tables import table

#: Letters of the driver's prose stand for letters and signs that the rules are about.
LATIN = "abcdefghilmnopqrstuvx"
SCRIPT = "\u064e\u0628\u0652\u0651\u0650\u0641\u0642\u0647\u064f\u0644\u0645\u0646\u0627\u064a\u0637\u0648\u0633\u0653\u0621\u06ec\u06ea"
GROUPS = tuple(g for g in P.LENGTHS if g not in ("called", "usual"))  # these look around, which the SQL's expressions cannot


def _options(spark, sf):
    """Options of 25 readers, a nation each."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    even = lambda by: (2 + 2 * (F.floor(k / by) % 3)).cast("int")
    soft = F.when(k % 2 == 0, 2).cast("int")
    return n.select(k.alias("reader"), even(1).alias("separated"), even(3).alias("joined"), even(9).alias("pause"), soft.alias("soft"), F.when(k % 5 == 0, "meem").alias("hidden_meem"))


def lengthened_texts(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", (F.col("doc_id") % 25).alias("reader"), F.translate(F.lower("text"), LATIN, SCRIPT).alias("t"))
    rows = P.with_options(d, _options(spark, sf), "reader")
    long = P.lengthened(F.col("t"), F.col("options"), GROUPS)
    return rows.select("doc_id", F.md5(long).alias("long_md5"), (F.length(long) - F.length("t")).cast("long").alias("grown"))


def _sounds(rows, text, *ids):
    """A row for each sound, with its place."""
    chunks = phoneme_chunks(F.translate(F.lower(F.coalesce(text, F.lit(""))), LATIN, SCRIPT))
    each = rows.select(*ids, chunks.alias("chunks")).select(*ids, F.posexplode(P.with_neighbours(F.col("chunks"))).alias("place", "s")).select(*ids, "place", "s.*")
    return each.select(*ids, F.col("place").cast("long").alias("place"), "chunk", *P.sound_attributes(F.col("chunk"), F.col("before"), F.col("after")))


ATTRIBUTES = "breath cover whistle repeat spread stretch nasal stop weight echo".split()


def item_sounds(spark, sf):
    """Every sound of the benchmark's items with its ten attributes."""
    return _sounds(table(spark, sf, "benchmark"), F.col("text"), "item_id")


def document_sounds(spark, sf):
    """How many sounds of all documents have which attributes."""
    return _sounds(table(spark, sf, "documents"), F.col("text")).groupBy(*ATTRIBUTES).agg(F.count("*").alias("n"))


def attribute_slices(spark, sf):
    """For the second word of each turn: the attributes, told for all but the turn's last two sounds, that belong to it."""
    script = F.translate(F.lower("text"), LATIN, SCRIPT)
    c = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", script.alias("t"))
    c = c.select("conv_id", "turn", phoneme_chunks(F.col("t")).alias("chunks"), phoneme_chunks(F.coalesce(F.get(F.split("t", " "), F.lit(1)), F.lit(""))).alias("word"))
    told = F.transform(F.slice("chunks", 1, F.greatest(F.size("chunks") - 2, F.lit(0))), lambda x: F.substring(x, 1, 1))
    own = P.last_slice(F.col("told"), F.col("chunks"), F.col("word"))
    return c.withColumn("told", told).select("conv_id", "turn", F.size("word").cast("long").alias("sounds"), F.array_join(own, "").alias("told"))


QUERIES = {f.__name__: f for f in (attribute_slices, lengthened_texts, item_sounds, document_sounds)}

# The same rules in plain code points, apart from the library's names; a replacement's lengths are columns of the options.
_PLAIN_LENGTHS = (
    ('\u0645 ?\u0628', "repeat(hidden_meem, 3) || '\u0628'"),
    ('\u0646 ([\u064a\u0648])', "'\\1' || '\\1' || '\\1'"),
    ('\u0646 ?([\u062a\u062b\u062c\u062f\u0630\u0632\u0633\u0634\u0635\u0636\u0637\u0638\u0641\u0642\u0643])', "repeat('\u06ba', 3) || '\\1'"),
    ('([\u0645\u0646])\u0651$', "'\\1' || '\\1' || '\\1'"),
    ('([\u0645\u0646])\u0651', "'\\1' || '\\1' || '\\1' || '\\1'"),
    ('\u0627\u06ec', "'\u0672'"),
    ('\u06ea\u0627', "'\u06ea' || repeat('\u0640', 2)"),
    ('(\u064e)\u0627\u0653( \u0621)', "'\\1' || repeat('\u0627', separated) || '\\2'"),
    ('(\u064f)\u0648\u0653( \u0621)', "'\\1' || repeat('\u06e5', separated) || '\\2'"),
    ('(\u0650)\u064a\u0653( \u0621)', "'\\1' || repeat('\u06e6', separated) || '\\2'"),
    ('(\u064e)\u0627\u0653(\u0621$)', "'\\1' || repeat('\u0627', joined_pause) || '\\2'"),
    ('(\u064f)\u0648\u0653(\u0621$)', "'\\1' || repeat('\u06e5', joined_pause) || '\\2'"),
    ('(\u0650)\u064a\u0653(\u0621$)', "'\\1' || repeat('\u06e6', joined_pause) || '\\2'"),
    ('(\u064e)\u0627\u0653(\u0621)', "'\\1' || repeat('\u0627', joined) || '\\2'"),
    ('(\u064f)\u0648\u0653(\u0621)', "'\\1' || repeat('\u06e5', joined) || '\\2'"),
    ('(\u0650)\u064a\u0653(\u0621)', "'\\1' || repeat('\u06e6', joined) || '\\2'"),
    ('(\u064e)\u064a\u0653', "'\\1' || repeat('\u064a', letter_name)"),
    ('(\u0645\u0650)\u064a\u0653(\u0645\u064e)', "'\\1' || repeat('\u06e6', linked_meem) || '\\2'"),
    ('(\u064e)\u0627\u0653(.(?:\u0651|\u0652|[\u0646\u0645\u06ba]{2,3}))', "'\\1' || repeat('\u0627', 6) || '\\2'"),
    ('(\u064f)\u0648\u0653(.(?:\u0651|\u0652|[\u0646\u0645\u06ba]{2,3}))', "'\\1' || repeat('\u06e5', 6) || '\\2'"),
    ('(\u0650)\u064a\u0653(.(?:\u0651|\u0652|[\u0646\u0645\u06ba]{2,3}))', "'\\1' || repeat('\u06e6', 6) || '\\2'"),
    ('(\u064e)\u0627([^\u0651](?:\u0652$|$|\u06dc))', "'\\1' || repeat('\u0627', pause) || '\\2'"),
    ('(\u064f)\u0648([^\u0651](?:\u0652$|$|\u06dc))', "'\\1' || repeat('\u06e5', pause) || '\\2'"),
    ('(\u0650)\u064a([^\u0651](?:\u0652$|$|\u06dc))', "'\\1' || repeat('\u06e6', pause) || '\\2'"),
    ('(\u064e)([\u064a\u0648])\u0652?([^\u0651]\u0652?$)', "'\\1' || repeat('\\2', soft) || '\\3'"),
)

_OPTIONS = """SELECT n_nationkey AS reader, 2 + 2 * (n_nationkey % 3) AS separated, 2 + 2 * ((n_nationkey // 3) % 3) AS joined, 2 + 2 * ((n_nationkey // 9) % 3) AS pause, greatest(4, 2 + 2 * ((n_nationkey // 9) % 3)) AS joined_pause,
  CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 2 + 2 * ((n_nationkey // 9) % 3) END - 1 AS soft, 5 AS letter_name, 6 AS linked_meem, CASE WHEN n_nationkey % 5 = 0 THEN '\u0645' ELSE '\u06fe' END AS hidden_meem FROM nation"""
_LONG = "t"
for _pattern, _new in _PLAIN_LENGTHS:
    _LONG = f"regexp_replace({_LONG}, '{_pattern}', {_new}, 'g')"
_CORE, _RESIDUALS = "\u0621\u0628\u0641\u0642\u0647\u0644\u0645\u0646\u0627\u064a\u0637\u0648\u0633", "\u064e\u064f\u0650"
_CHUNKS = f"""regexp_extract_all(translate(lower(coalesce(text, '')), '{LATIN}', '{SCRIPT}'), '(?:{"|".join(c + "+" for c in _CORE)})[{_RESIDUALS}\u06ea]?')"""
_ONE = lambda letters, yes, no: f"CASE WHEN contains('{letters}', c[1]) THEN '{yes}' ELSE '{no}' END"
_ATTRIBUTES = f"""{_ONE("\u0641\u0647\u0633", "hams", "jahr")} AS breath, {_ONE("\u0637", "motbaq", "monfateh")} AS cover, {_ONE("\u0633", "safeer", "no_safeer")} AS whistle, 'not_mokarar' AS repeat, 'not_motafashie' AS spread,
  'not_mostateel' AS stretch, {_ONE("\u0646\u0645", "maghnoon", "not_maghnoon")} AS nasal, CASE WHEN contains('\u0621\u0642\u0637\u0628', c[1]) THEN 'shadeed' WHEN contains('\u0644\u0646\u0645', c[1]) THEN 'between' ELSE 'rikhw' END AS stop,
  CASE WHEN c[1] = '\u0627' THEN CASE WHEN lag(c[1]) OVER w IN ('\u0637', '\u0642') THEN 'mofakham' ELSE 'moraqaq' END WHEN c[1] = '\u0642' AND c[-1] = '\u0650' THEN 'low_mofakham' WHEN c[1] IN ('\u0637', '\u0642') THEN 'mofakham' ELSE 'moraqaq' END AS weight,
  CASE WHEN NOT contains('{_RESIDUALS}', c[-1]) AND c[1] IN ('\u0642', '\u0637', '\u0628') THEN 'moqalqal' ELSE 'not_moqalqal' END AS echo"""
_FOUND = lambda text: _CHUNKS.replace("coalesce(text, '')", text)
SQL = {
    "attribute_slices": f"""WITH c AS (SELECT conv_id, turn, {_FOUND("text")} AS c, {_FOUND("coalesce(string_split(text, ' ')[2], '')")} AS w FROM conversations WHERE text IS NOT NULL),
      v AS (SELECT *, list_transform(c[:greatest(len(c) - 2, 0)], lambda x: x[1]) AS v, list_max(list_filter(range(1, len(c) + 1), lambda i: c[i:i + len(w) - 1] = w)) AS i FROM c)
      SELECT conv_id, turn, len(w) AS sounds, CASE WHEN len(w) = 0 THEN '' WHEN i IS NOT NULL THEN coalesce(array_to_string(v[i:i + len(w) - 1], ''), '') ELSE coalesce(array_to_string(v[greatest(len(v) - len(w), 0) + 1:], ''), '') END AS told FROM v""",
    "lengthened_texts": f"""WITH o AS ({_OPTIONS}), d AS (SELECT doc_id, doc_id % 25 AS reader, translate(lower(text), '{LATIN}', '{SCRIPT}') AS t FROM documents WHERE text IS NOT NULL),
      l AS (SELECT doc_id, t, {_LONG} AS long FROM d JOIN o USING (reader)) SELECT doc_id, md5(long) AS long_md5, length(long) - length(t) AS grown FROM l""",
    "item_sounds": f"""WITH c AS (SELECT item_id, unnest({_CHUNKS}) AS c, generate_subscripts({_CHUNKS}, 1) - 1 AS place FROM benchmark)
      SELECT item_id, place, c AS chunk, {_ATTRIBUTES} FROM c WINDOW w AS (PARTITION BY item_id ORDER BY place)""",
    "document_sounds": f"""WITH c AS (SELECT doc_id, unnest({_CHUNKS}) AS c, generate_subscripts({_CHUNKS}, 1) - 1 AS place FROM documents),
      a AS (SELECT {_ATTRIBUTES} FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY place)) SELECT *, count(*) AS n FROM a GROUP BY ALL""",
}
