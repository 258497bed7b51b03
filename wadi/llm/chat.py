"""Chat formatting from an event log, in DataFrame functions only.

Log: (conv_id, turn, seq, kind, role, text). ``message``, ``edit`` and
``regenerate`` set the text of their turn anew, ``delta`` appends to it,
``delete`` empties the log of the turn up to there (a turn without a later text
is gone). Where several messages share a turn number, a column slot tells them
apart. Events are folded in the order (seq, kind, text) within a turn (and slot), turns
stand in the order (turn, role, text). Each turn is folded first, in partial
aggregates, so a conversation is put together from its turns, not its events;
its rendering is one value by nature, hence one row.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. In roles and texts
``&``, ``<``, ``[INST]`` and ``[/INST]`` (in roles line feeds too) are written as
``&amp;``, ``&lt;``, ``&lb;INST]``, ``&lb;/INST]``, ``&nl;``; that is undone by the
same replacements in reverse order, so no text can forge a control string and
every text is read back exactly. The loss mask covers assistant texts as they
stand in the output (0-based code-point spans).

Defined results: null texts and roles are empty, a null turn comes first, a
null kind is a message, equal rows repeat a turn once for each row of
``conversations``; columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[INST]", "&lb;INST]"), ("[/INST]", "&lb;/INST]")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("&nl;", "\n"), ("&lb;", "["), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final message of every turn, or slot of it, that has one.

    The role is that of the last event that sets the text, or else of the first.
    """
    key = ["conv_id", "turn"] + ["slot"] * ("slot" in log.columns)
    e = log.select(*key, F.struct(F.col("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e"))
    turns = e.groupBy(*key).agg(F.array_sort(F.collect_list("e")).alias("events"))
    empty = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    step = lambda s, x: (
        F.when(x["kind"] == "delete", empty)
        .when(x["kind"] == "delta", F.struct(F.coalesce(s["role"], x["role"]).alias("role"), F.concat(F.coalesce(s["text"], F.lit("")), x["text"]).alias("text")))
        .otherwise(F.struct(x["role"].alias("role"), x["text"].alias("text")))
    )
    return turns.select("conv_id", "turn", F.aggregate("events", empty, step).alias("m")).select("conv_id", "turn", "m.role", "m.text").where(F.col("text").isNotNull())


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as message events of their turn, each in a slot of its own."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", "turn", F.monotonically_increasing_id().alias("slot"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted) from (conv_id, turn, role, text)."""
    m = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    piece = lambda x: F.concat(F.lit(START), F.replace(escape(x["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n"), escape(x["text"]), F.lit(END))
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("ms")).select("conv_id", F.array_join(F.transform("ms", piece), "").alias("formatted"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text, loss, start, length), parsed from ``formatted``.

    Start and length are code points of the text as it stands in the output.
    """
    parts = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p != "")
    raw = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), p.alias("body")))
    turn = F.transform(raw, lambda r: F.struct(r["role"].alias("role"), r["body"].substr(F.length(r["role"]) + 2, F.length(r["body"]) - F.length(r["role"]) - 1 - len(END)).alias("text")))
    return rendered.withColumn("parsed", turn).withColumn(
        "turns", F.transform("parsed", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"), F.length(t["text"]).alias("length")))
    ).drop("parsed")


def loss_spans(parsed: DataFrame) -> DataFrame:
    """(conv_id, start, length): assistant texts in ``formatted``, by code points."""
    one = parsed.select("conv_id", F.posexplode(F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p != "")).alias("pos", "p"), F.col("turns"))
    offsets = F.aggregate(F.slice("turns", 1, F.col("pos")), F.lit(0), lambda s, t: s + t["length"] + len(START) + 1 + len(END))
    roles = F.aggregate(F.slice("turns", 1, F.col("pos") + 1), F.lit(0), lambda s, t: s + F.length(F.replace(escape(t["role"]), F.lit("\n"), F.lit("&nl;"))))
    got = one.select("conv_id", (offsets + roles + len(START) + 1).alias("start"), F.get("turns", F.col("pos")).alias("t"))
    return got.where("t.loss").select("conv_id", "start", F.col("t.length").alias("length"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    parsed = read_back(render(fold_events(as_events(table.unionByName(extra)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]')) AS text_size,
    length(replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[INST]', '&lb;INST]'), '[/INST]', '&lb;/INST]'), chr(10), '&nl;')) AS role_size
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_size + role_size + 12 + 1 + 11) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
