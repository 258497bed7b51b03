"""Fill-in-middle transformation by bit-parallel work on big integers.

A text is cut into units: a word with the white space before it; white space at
the end of the text is a unit of its own. ``bytes.translate`` turns the UTF-8
bytes into a string of binary digits, one for each byte, and so into one integer:
bit i tells of byte i. A word's last byte is a word byte with no word byte above
it, ``words & ~(words >> 1)``; all units are counted by ``bit_count``, and the
byte where the k-th unit ends is found by halving: the lower half's count tells
which half holds it. Half the bits go with each step, so a search costs no more
than a pass over the text. A text needs memory of a few times its own length.

A document's two cuts, its form and the order of its parts come from SHA-256 of
seed and id, so they depend neither on other rows nor on partitions.

Defined results: a null text counts as empty; an empty text, or one that holds a
sentinel, stays plain; a null id counts as the empty id in the digest and stays
null; repeated rows get a row each, equal rows equal ones. No rows, no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.textcore import chunks

SEED = 42
#: Percent of documents that are transformed, and of those, percent with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_WORD_DIGIT = bytes(48 if b in _SPACE else 49 for b in range(256))
#: Bytes that start a code point.
_LEAD_DIGIT = bytes(48 if 128 <= b < 192 else 49 for b in range(256))


def mask(data: bytes, digits: bytes) -> int:
    """Bit i is set if ``digits`` has a 1 for byte i."""
    return int(data.translate(digits)[::-1], 2) if data else 0


def unit_ends(data: bytes) -> int:
    """Bit i is set if a unit ends with byte i."""
    words = mask(data, _WORD_DIGIT)
    ends = words & ~(words >> 1)
    return ends | (1 << (len(data) - 1)) if data else 0


def select(bits: int, k: int) -> int:
    """The place of the k-th set bit, from 1, by halving."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k <= below:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - below, at + half
    return at


def draws(doc_id: object, seed: int) -> list[int]:
    """The first four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(doc_id: object, text: str | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ends = unit_ends(data)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= rate or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return n, "plain", None, None, text or ""
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = select(ends, first) + 1 if first else 0
    b = select(ends, second) + 1 if second else 0
    leads = mask(data[:b], _LEAD_DIGIT)
    before = (leads & ((1 << a) - 1)).bit_count()
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    spm = h4 % 100 < suffix_first
    parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, "spm" if spm else "psm", before, leads.bit_count() - before, b"".join(parts).decode("utf-8", "surrogatepass")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row; one pass, no shuffle, a text at a time."""
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            ids = part.column(0)
            got = [transform(i.as_py(), t.as_py(), seed, rate, suffix_first) for i, t in zip(ids, part.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from; sentinels stand in no transformed text."""
    parts = F.split(F.substr(output, F.lit(4)), "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[0], parts[2], parts[1])).otherwise(F.concat(parts[1], parts[2], parts[0]))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

OP11_SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), hashed AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, CAST(i AS INT), 8) AS BIGINT)) AS h FROM drawn
), formed AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {RATE} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM hashed
), cuts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM cuts
"""
