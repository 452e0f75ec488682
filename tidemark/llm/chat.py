r"""Chat formatting with typed content parts.

A turn's content is text or an array of parts (type, text, ref, size). A visitor walks the parts in
order: runs of text parts are joined and escaped, others become one placeholder each, `<|type:k|>`, k counting the
conversation's attachments from 0; the attachment's type, reference and expanded token count
are recorded. A conversation is rendered as

    <|im_start|>ROLE\nTEXT<|im_end|>\n ...

Escaping adds a backslash inside every `<|` of a text (`<\|`, `<\\|` where there was one), so no control string can
come from a text, and removing one restores it. Roles also write line feeds as `\n` and backslashes as `\-`.

Turns are sorted by turn (nulls first), then role and text. Null role and text: empty. Null conv_id is a conversation of its own. Repeated rows are
turns of their own. A conversation is one row, as its format asks for. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, STOP = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type:string,text:string,ref:string,size:array<double>>"
#: Tokens that an attachment expands to: images by patches of 28 by 28 pixels, audio by 25 tokens a second, documents by 500 tokens a page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 500
CHECKED = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\-")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\-"), F.lit("\\"))


def expanded_tokens(part: Column) -> Column:
    size = part["size"]
    side = lambda i: F.ceil(F.coalesce(F.get(size, F.lit(i)), F.lit(0.0)) / IMAGE_PATCH)
    first = F.coalesce(F.get(size, F.lit(0)), F.lit(0.0))
    return (
        F.when(part["type"] == "image", side(0) * side(1))
        .when(part["type"] == "audio", F.ceil(first * AUDIO_RATE))
        .when(part["type"] == "document", F.ceil(first) * PAGE_TOKENS)
        .otherwise(F.lit(0)).cast("long")
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _kind(part: Column) -> Column:
    """A part's type as a placeholder names it: what isn't a letter, digit, `_` or `-` is written as `_`."""
    return F.regexp_replace(part["type"], "[^A-Za-z0-9_-]", "_")


def flatten(parts: Column, attachments_before: Column) -> Column:
    """A turn's parts as one escaped text; attachments count on from attachments_before.

    Neighbouring text parts are joined before they are escaped, so a control string can't be put together from several.
    """
    state = lambda text, run, n: F.struct(text.alias("text"), run.alias("run"), n.alias("n"))
    said = lambda a: F.concat(a["text"], escape(a["run"]))
    mark = lambda a, p: F.concat(F.lit("<|"), _kind(p), F.lit(":"), a["n"].cast("string"), F.lit("|>"))
    step = lambda a, p: F.when(_is_text(p), state(a["text"], F.concat(a["run"], F.coalesce(p["text"], F.lit(""))), a["n"])).otherwise(
        state(F.concat(said(a), mark(a, p)), F.lit(""), a["n"] + 1)
    )
    return F.aggregate(parts, state(F.lit(""), F.lit(""), attachments_before.cast("long")), step, said)


def _as_parts(content: Column, kind: str) -> Column:
    """An array of PART; a text is one part."""
    if kind.startswith("array"):
        return F.coalesce(content.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), content.cast("string").alias("text"), null("string").alias("ref"), null("array<double>").alias("size")))


def format_conversations(rows: DataFrame, content: str = "text") -> DataFrame:
    """conv_id, formatted, mask (structs of code points from, to: the texts of assistant turns) and attachments.

    content names a column of text or of an array of PART; the visitor walks both alike.
    """
    parts = _as_parts(F.col(content), dict(rows.dtypes)[content])
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    c = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    others = F.transform("turns", lambda t: F.filter(t["parts"], lambda p: ~_is_text(p)))
    c = c.withColumn("others", others).withColumn("n", F.transform("others", F.size))
    before = F.expr("transform(n, (x, i) -> aggregate(slice(n, 1, i), 0, (a, y) -> a + y))")
    c = c.withColumn("before", F.when(F.exists("n", lambda x: x > 0), before))
    body = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), flatten(t["parts"], F.coalesce(F.get("before", i), F.lit(0))).alias("text")))
    attached = F.flatten(F.transform("others", lambda ps, i: F.transform(ps, lambda p: F.struct(i.alias("turn"), p.alias("p")))))
    found = F.transform(attached, lambda x, i: F.struct(i.alias("index"), x["turn"].alias("turn"), x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), expanded_tokens(x["p"]).alias("tokens")))
    c = c.select("conv_id", body.alias("body"), found.alias("attachments"))
    head = F.transform("body", lambda t: F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")))
    c = c.select("conv_id", "body", "attachments", head.alias("head"))
    # Ends of turns add up in one pass; the mask keeps the assistants' texts.
    steps = F.expr(f"""aggregate(zip_with(head, body, (h, b) -> struct(length(h) as h, length(b.text) as b, b.role as role)),
        struct(0L as at, cast(array() as array<struct<from:bigint,to:bigint>>) as m),
        (a, x) -> struct(a.at + x.h + x.b + {len(STOP)} as at, CASE WHEN x.role = 'assistant' THEN concat(a.m, array(struct(a.at + x.h as from, a.at + x.h + x.b as to))) ELSE a.m END as m), a -> a.m)""")
    text = F.array_join(F.zip_with("head", "body", lambda h, b: F.concat(h, b["text"], F.lit(STOP))), "")
    return c.select("conv_id", text.alias("formatted"), steps.alias("mask"), "attachments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    cut = lambda x: F.instr(x, "\n")
    return F.transform(turns, lambda x: F.struct(_role_in(F.substring(x, F.lit(1), cut(x) - 1)).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x) - cut(x) - len(STOP))).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted output and its mask say, read back."""
    d = formatted.withColumn("turns", read_back(F.col("formatted")))
    d = d.withColumn("said", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    masked = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["from"] + 1).cast("int"), (m["to"] - m["from"]).cast("int"))))
    d = d.withColumn("loss", F.array_join(masked, ""))
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHECKED).alias("text"))
    return digests(format_conversations(c.unionByName(probe)))


ORACLE = rf"""
    WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, i, r, '{CHECKED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
    e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS escaped FROM c)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
        sum(length(role) + length(escaped) + {len(START) + 1 + len(STOP)})::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""
