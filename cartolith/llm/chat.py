"""Chat formatting by perspective rotation: a dialogue is rendered once for every one of its speakers.

In a rendering, the turns of the speaker whose perspective it is are the assistant's, all others are those of named
users, and system turns stay. A mask holds the spans (code points, end exclusive) that the assistant is to learn:
its texts and their end marks, never the headers or anyone else's words.

A dialogue of any length is cut into blocks of ``BLOCK_TURNS`` turn numbers, which are rows of their own; put together
in order, a perspective's blocks are the whole rendering. ``start`` is where a block begins in it, and the spans of its
mask are places in the whole. They come from sums by block, so that no task holds a dialogue, and dialogues meet their
speakers' names, not each other's turns.

Defined results: a null text is empty; a null role is a speaker called ``unknown``; null turns come first, in a block
of their own (-1); turns of one number are ordered by role and text; repeated rows are rendered as often as they come;
rows with a null conv_id make one dialogue; a dialogue of system turns alone has no perspective; marks within texts
and roles are broken up by a zero-width space (``unescaped`` takes it out again), and line ends in roles are spaces, so
that neither can end its own turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
_NONE = -(1 << 63)
START, END = "<|im_start|>", "<|im_end|>\n"
_GAP = "\u200b"


def escaped(text: Column) -> Column:
    """``text`` without marks: a zero-width space goes between ``<`` and ``|``, and is doubled where it stands after ``<`` already."""
    return F.replace(F.replace(text, F.lit("<" + _GAP), F.lit("<" + 2 * _GAP)), F.lit("<|"), F.lit(f"<{_GAP}|"))


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, f"<{_GAP}([|{_GAP}])", "<$1")


def turns(conversations: DataFrame) -> DataFrame:
    """conv, block, turn, role, text under fixed names, without nulls."""
    c = conversations
    turn = c["turn"].cast("long")
    return c.select(
        F.coalesce(c["conv_id"].cast("long"), F.lit(_NONE)).alias("conv"),
        F.coalesce(F.floor(turn / BLOCK_TURNS), F.lit(-1)).cast("long").alias("block"),
        F.coalesce(turn, F.lit(-1)).cast("long").alias("turn"),
        F.translate(escaped(F.coalesce(c["role"].cast("string"), F.lit("unknown"))), "\n\r", "  ").alias("role"),
        escaped(F.coalesce(c["text"].cast("string"), F.lit(""))).alias("text"),
    )


def _name(role: Column) -> Column:
    return F.when(role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), role))


def header(role: Column, speaker: Column) -> Column:
    return F.concat(F.lit(START), F.when(role == speaker, F.lit("assistant")).otherwise(_name(role)), F.lit("\n"))


def _blocks_of(t: DataFrame) -> DataFrame:
    """conv, block, speaker, start: every block of every perspective, and where it begins in the rendering."""
    role = F.col("role")
    length = F.length("text") + F.length(_name(role)) + len(START) + 1 + len(END)
    by_role = t.groupBy("conv", "block", "role").agg(F.sum(length.cast("long")).alias("n"), F.count("*").alias("turns"))
    # as everybody's third person; a speaker's own turns have another name
    sizes = by_role.groupBy("conv", "block").agg(F.sum("n").alias("n"))
    own = by_role.where(role != "system").select("conv", "block", role.alias("speaker"), (F.col("turns") * (F.lit(len("assistant")) - F.length(_name(role)))).alias("more"))
    speakers = own.select("conv", "speaker").distinct()
    wanted = sizes.join(speakers, "conv").join(own, ["conv", "block", "speaker"], "left")
    before = Window.partitionBy("conv", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return wanted.select("conv", "block", "speaker", F.coalesce(F.sum(F.col("n") + F.coalesce("more", F.lit(0))).over(before), F.lit(0)).alias("start"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, block, start, n_turns, text, mask array<struct<start, end>>."""
    t = turns(conversations)
    blocks = t.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # names meet block numbers first, without any text, so that texts go through one exchange only
    both = blocks.join(_blocks_of(t), ["conv", "block"]).select(F.nullif("conv", F.lit(_NONE)).alias("conv_id"), "speaker", "block", "start", "turns")
    shown = F.transform("turns", lambda m: F.struct(header(m["role"], F.col("speaker")).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), (m["role"] == F.col("speaker")).alias("own")))
    both = both.select("conv_id", "speaker", "block", "start", shown.alias("shown"))
    sizes = F.transform("shown", lambda m: F.struct(F.length(m["head"]).alias("h"), F.length(m["body"]).alias("b"), m["own"].alias("own")))
    spans = "array<struct<start:bigint,end:bigint>>"
    zero = F.struct(F.col("start").alias("at"), F.array().cast(spans).alias("out"))

    def add(s: Column, m: Column) -> Column:
        start = s["at"] + m["h"]
        span = F.array(F.struct(start.alias("start"), (start + m["b"]).alias("end")))
        return F.struct((start + m["b"]).alias("at"), F.when(m["own"], F.concat(s["out"], span)).otherwise(s["out"]).cast(spans).alias("out"))

    return both.select(
        "conv_id",
        "speaker",
        "block",
        "start",
        F.size("shown").alias("n_turns"),
        F.array_join(F.transform("shown", lambda m: F.concat(m["head"], m["body"])), "").alias("text"),
        F.aggregate(sizes, zero, add, lambda s: s["out"]).alias("mask"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, block, start, n_turns, text, mask (start:end, comma-joined)."""
    r = rotate(conversations)
    return r.select("conv_id", "speaker", "block", "start", "n_turns", "text", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",").alias("mask"))


#: DuckDB: the same.
SQL = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, coalesce(floor(turn / 256)::BIGINT, -1) AS block, coalesce(turn, -1) AS turn,
         translate(replace(replace(coalesce(role, 'unknown'), '<' || chr(8203), '<' || chr(8203) || chr(8203)), '<|', '<' || chr(8203) || '|'), chr(10) || chr(13), '  ') AS role,
         replace(replace(coalesce(text, ''), '<' || chr(8203), '<' || chr(8203) || chr(8203)), '<|', '<' || chr(8203) || '|') AS text
  FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), m AS (
  SELECT t.conv_id, s.speaker, t.block, t.turn, t.role, t.text,
         '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head,
         t.text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY block, turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS until FROM m
)
SELECT conv_id, speaker, block, min(until - length(head) - length(body))::BIGINT AS start, count(*)::INTEGER AS n_turns, string_agg(head || body, '' ORDER BY turn, role, text) AS text,
       coalesce(string_agg((until - length(body)) || ':' || until, ',' ORDER BY turn, role, text) FILTER (WHERE role = speaker), '') AS mask
FROM o GROUP BY conv_id, speaker, block
"""
