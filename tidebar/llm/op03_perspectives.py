"""Chat formatting: every participant's view of a dialogue.

For each speaker of a conversation the dialogue is rendered with that speaker as the assistant and all others as users with
their names; system messages stay system messages. Loss masks cover what the assistant says. Long conversations come in parts
of a fixed span of turns, and a part with more messages than that (repeated or null turns) in pieces of as many, dealt by turn,
speaker and digest of the text, so no row and no task holds a whole one. Within a piece, messages are sorted by turn, speaker and
text. In rendered texts a backslash parts the characters of any mark that a content or a name holds, so that none can pass for the
start or end of a message; `unescaped` takes it out again, and `messages` has contents as they are.

Only column functions are used. Defined results: null texts are empty; a null speaker is a participant named "unknown"; a null
conv_id is a conversation of its own and a null turn a part of its own, after the others; repeated rows are rendered as often as
they occur; texts of any length are kept whole; a conversation of system messages alone has no participant and no rows; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import small, written

PART_TURNS = 256
SYSTEM = "system"
UNKNOWN = "unknown"


def escaped(text: Column) -> Column:
    """No `<|` is left: a backslash is put before the bar, also where there are backslashes already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _pieces(rows: DataFrame, part_turns: int) -> DataFrame:
    """Adds `piece`: 0, or in a part of more than `part_turns` rows the row's place there divided by that.

    Rows of such parts are range-partitioned and numbered by partition; a partition starts after the rows of the part's earlier
    ones. Equal rows are spread by where they were stored.
    """
    key = ("conv_id", "part")
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > part_turns).select(*[F.col(c).alias(f"_{c}") for c in key])
    large = written(large, "parts")
    if large.isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long"))
    large = small(large)
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("part").eqNullSafe(F.col("_part"))
    stored = written(rows.join(large, same, "left_semi").withColumn("_digest", F.md5("text")), "turns")
    tied = stored.select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("_tie"))
    order = ("turn", "who", "_digest", "_tie")
    dealt = written(tied.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (dealt.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_rows"))
              .select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), F.col("_range").alias("_at"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*order))
    cut = (dealt.withColumn("_place", place).join(counts, same & (F.col("_range") == F.col("_at")))
           .select(*rows.columns, F.floor((F.col("_before") + F.col("_place") - 1) / part_turns).cast("long").alias("piece")))
    return rows.join(large, same, "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(cut)


def perspectives(turns: DataFrame, speaker: str = "role", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, part, piece, n_messages, messages, text, masks) per participant and piece of a part.

    `messages`: array of (role, name, content, trained); `masks`: array of (start, end) in characters of `text`. Texts of a
    perspective follow each other in order of `part` and `piece`.
    """
    who = F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), who.alias("who"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.floor(F.col("turn") / part_turns))
    parts = (_pieces(rows, part_turns).groupBy("conv_id", "part", "piece")
             .agg(F.array_sort(F.collect_list(F.struct("turn", "who", "text"))).alias("m")))
    speakers = rows.filter(F.col("who") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("who").alias("perspective")).distinct()
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def rendered(x):
        own = x["who"] == F.col("perspective")
        role = F.when(x["who"] == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
        return F.struct(role.alias("role"), F.when(role == "user", x["who"]).alias("name"), x["text"].alias("content"), own.alias("trained"))

    views = views.withColumn("messages", F.transform("m", rendered))
    name = lambda x: F.regexp_replace(escaped(x["name"]), r"\|(\\*)>", r"|$1\\>")
    head = lambda x: F.concat(F.lit("<|"), x["role"], F.coalesce(F.concat(F.lit(" name="), name(x)), F.lit("")), F.lit("|>\n"))
    tail = F.lit("\n<|end|>\n")
    views = views.withColumn("pieces", F.transform("messages", lambda x: F.concat(head(x), escaped(x["content"]), tail)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def grow(state, x):
        begin = state["at"] + F.char_length(head(x))
        end = begin + F.char_length(escaped(x["content"]))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + F.char_length(tail)).alias("at"), F.when(x["trained"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return views.select("conv_id", "perspective", "part", "piece", F.size("m").cast("long").alias("n_messages"), "messages",
                        F.array_join("pieces", "").alias("text"), F.aggregate("messages", start, grow, lambda s: s["spans"]).alias("masks"))


def digest(turns: DataFrame) -> DataFrame:
    """The views with their masks written out and their text as a digest."""
    return perspectives(turns).select(
        "conv_id", "perspective", "part", "piece", "n_messages", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"),
        F.array_join(F.transform("masks", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias("masks"),
        F.aggregate("masks", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("trained_chars"))


ORACLE_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS who, coalesce(text, '') AS raw, floor(turn / {PART_TURNS})::BIGINT AS part FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, who, md5(raw)) - 1) // {PART_TURNS} AS piece,
  regexp_replace(raw, '<(\\*)\|', '<\1\\|', 'g') AS t, regexp_replace(regexp_replace(who, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') AS name FROM r),
s AS (SELECT DISTINCT conv_id AS c, who AS perspective FROM r WHERE who <> '{SYSTEM}'),
v AS (SELECT n.*, perspective, '<|' || CASE WHEN who = '{SYSTEM}' THEN '{SYSTEM}' WHEN who = perspective THEN 'assistant' ELSE 'user name=' || name END
  || '|>' || chr(10) AS head, chr(10) || '<|end|>' || chr(10) AS tail FROM n JOIN s ON conv_id IS NOT DISTINCT FROM c),
w AS (SELECT *, row_number() OVER o AS i, coalesce(sum(length(head) + length(t) + length(tail)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + length(head) AS a FROM v WINDOW o AS (PARTITION BY conv_id, perspective, part, piece ORDER BY turn, who, raw))
SELECT conv_id, perspective, part, piece::BIGINT AS piece, count(*) AS n_messages, sum(length(head) + length(t) + length(tail))::BIGINT AS n_chars,
  md5(string_agg(head || t || tail, '' ORDER BY i)) AS text_md5,
  coalesce(string_agg(a::BIGINT || '-' || (a + length(t))::BIGINT, ',' ORDER BY i) FILTER (WHERE who = perspective), '') AS masks,
  coalesce(sum(length(t)) FILTER (WHERE who = perspective), 0)::BIGINT AS trained_chars
FROM w GROUP BY conv_id, perspective, part, piece
"""
