"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is cut into lines; in each, letters become small, every run of other
than ASCII letters, digits and non-ASCII characters becomes one space, and
equivalent spellings become one. Lines that are copyright lines or empty after
that go. The remaining lines joined by spaces are the canonical text, so line
breaks do not matter. SHA-256 digests of whole canonical texts are hash-joined
to those of known licences; digests of single lines to those of known notices
("Released under the MIT License.").

The known table is a parameter (license_id, kind 'text' or 'notice', body); it is
broadcast only up to ``KNOWN_LIMIT`` rows, beyond that joined by a shuffle.

Defined results: null texts count as empty, an empty canonical text matches
nothing; of several licences with one digest the least id is reported; repeated
documents get a row each.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.license_texts import NOTICES, SPELLINGS, TEXTS

KNOWN_LIMIT = 10_000
COPYRIGHT = r"^ ?(copyright|\x{A9}|c copyright|all rights reserved)"


def canonical(df: DataFrame, text: str) -> DataFrame:
    """Adds ``lines`` (canonical non-empty lines without copyright lines) and ``digest``.

    Built column by column, so that no costly step is evaluated twice.
    """
    small = F.replace(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("\n"), F.lit("\x01"))
    df = df.withColumn("_squeezed", F.regexp_replace(small, r"[^a-z0-9\x{80}-\x{10FFFF}\x01]+", " "))
    spelled = F.col("_squeezed")
    for a, b in SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"(?<![^ \x01]){a}(?![^ \x01])", b)
    df = df.withColumn("_spelled", F.when(reduce(or_, [F.col("_squeezed").contains(a) for a, _ in SPELLINGS]), spelled).otherwise(F.col("_squeezed")))
    df = df.withColumn("_split", F.split("_spelled", "\x01", -1))
    df = df.withColumn("lines", F.filter(F.transform("_split", lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(COPYRIGHT)))
    return df.withColumn("digest", digest(F.col("lines"))).drop("_squeezed", "_spelled", "_split")


def digest(lines: Column) -> Column:
    """SHA-256 of the canonical text; null if it is empty."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(known: DataFrame) -> DataFrame:
    """(kind, digest, size, license_id), one row per kind and digest."""
    d = canonical(known.select("license_id", "kind", "body"), "body").where(F.col("digest").isNotNull())
    return d.groupBy("kind", "digest").agg(F.max(F.length(F.array_join("lines", " "))).alias("size"), F.min("license_id").alias("license_id"))


def built_in(spark: SparkSession) -> DataFrame:
    rows = [(k, "text", v) for k, v in TEXTS.items()] + [(k, "notice", v) for k, v in NOTICES]
    return spark.createDataFrame(rows, "license_id string, kind string, body string")


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def scan(docs: DataFrame, known: DataFrame, limit: int = KNOWN_LIMIT) -> DataFrame:
    """(doc_id, digest, license_id, notices): whole-text licence and the sorted ids of notices in single lines.

    One pass over the texts. Only lines as long as a known notice are looked up;
    past ``limit`` known rows every line is.
    """
    digests = known_digests(known)
    texts = _small(digests.where("kind = 'text'").select("digest", "license_id"), limit)
    lines = digests.where("kind = 'notice'")
    sizes = [r["size"] for r in lines.select("size").distinct().limit(limit + 1).collect()]
    notices = _small(lines.select(F.col("digest").alias("line_digest"), F.col("license_id").alias("notice")), limit)
    base = canonical(docs.select("doc_id", "text"), "text").withColumn("row", F.monotonically_increasing_id())
    maybe = F.filter("lines", lambda s: F.length(s).isin(sizes)) if len(sizes) <= limit else F.col("lines")
    rows = base.select("row", "doc_id", "digest", F.explode_outer(F.transform(maybe, lambda s: F.sha2(s, 256))).alias("line_digest"))
    found = rows.join(notices, "line_digest", "left").groupBy("row", "doc_id", "digest").agg(F.sort_array(F.collect_set("notice")).alias("notices"))
    return found.join(texts, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, built_in(spark))
    return found.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(k, "text", v) for k, v in TEXTS.items()] + [(k, "notice", v) for k, v in NOTICES]
    values = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in rows)
    spelled = "{L}"
    for a, b in SPELLINGS:
        # RE2 has no look-around: words are found between spaces that are doubled first
        spelled = f"regexp_replace({spelled}, ' {a} ', ' {b} ', 'g')"
    canon = (
        "list_filter(list_transform(string_split(lower(coalesce({t}, '')), chr(10)), "
        "lambda x: trim(replace(" + spelled + ", '  ', ' '))), lambda s: s <> '' AND NOT regexp_matches(s, '" + COPYRIGHT + "'))"
    )
    inner = r"(' ' || replace(trim(regexp_replace(x, '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g')), ' ', '  ') || ' ')"
    canon = canon.replace("{L}", inner)
    return f"""
WITH known AS (
  SELECT kind, digest, min(license_id) AS license_id FROM (
    SELECT license_id, kind, CASE WHEN len(l) > 0 THEN sha256(array_to_string(l, ' ')) END AS digest
    FROM (SELECT license_id, kind, {canon.replace("{t}", "body")} AS l FROM (VALUES {values}) v(license_id, kind, body)))
  WHERE digest IS NOT NULL GROUP BY kind, digest
), base AS (SELECT doc_id, {canon.replace("{t}", "text")} AS l FROM documents),
hits AS (
  SELECT doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
  FROM (SELECT doc_id, sha256(unnest(l)) AS d FROM base) b JOIN known k ON k.kind = 'notice' AND k.digest = b.d GROUP BY doc_id
)
SELECT b.doc_id, CASE WHEN len(b.l) > 0 THEN sha256(array_to_string(b.l, ' ')) END AS digest, k.license_id, coalesce(h.notices, '') AS notices
FROM base b LEFT JOIN known k ON k.kind = 'text' AND k.digest = CASE WHEN len(b.l) > 0 THEN sha256(array_to_string(b.l, ' ')) END
LEFT JOIN hits h USING (doc_id)
"""


OP3_SQL = _sql()
