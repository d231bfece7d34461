"""Chat formatting: a role state machine over declarative templates.

Native: DataFrame functions only. A conversation is the unit of output (its
digests run over all its turns), so its rows meet in one group; nothing larger
than one conversation ever does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, escapes and turn order, all as data.

    ``escapes`` maps a character that a marker begins with (or the escape
    character itself, last) to the letter that stands for it after
    ``escape_char``. Escaped text therefore holds no marker character at all,
    so a split at the markers is exact and the mapping is reversible. A
    template whose marker begins with a character that has no escape, or whose
    escapes are ambiguous, is refused.
    """

    turn_start: str = "### "
    role_end: str = ": "
    turn_end: str = "</turn>\n"
    escape_char: str = "\\"
    escapes: tuple[tuple[str, str], ...] = (("#", "h"), ("<", "l"), (":", "c"), ("\\", "b"))
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def __post_init__(self) -> None:
        chars, letters = [c for c, _ in self.escapes], [x for _, x in self.escapes]
        for marker in (self.turn_start, self.role_end, self.turn_end):
            if not marker or marker[0] not in chars:
                raise ValueError(f"no escape for the first character of the marker {marker!r}")
        if len({*chars}) < len(chars) or len({*letters}) < len(letters) or any(len(x) != 1 for x in (*chars, *letters)):
            raise ValueError("escapes are pairs of one character and one letter, each used once")
        if not chars or chars[-1] != self.escape_char or {*chars} & {*letters}:
            raise ValueError("the escape character is escaped last, and no letter is an escaped character")

    def escape(self, text: Column) -> Column:
        """The escape character first, then the others."""
        for char, letter in reversed(self.escapes):
            text = F.replace(text, F.lit(char), F.lit(self.escape_char + letter))
        return text

    def unescape(self, text: Column) -> Column:
        """Every escape character precedes exactly one letter, so single replacements undo it, the escape character last."""
        for char, letter in self.escapes:
            text = F.replace(text, F.lit(self.escape_char + letter), F.lit(char))
        return text


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per ``conv_id``: ``segments`` (array of text and loss flag), ``valid``, ``first_bad_turn``.

    Rows are ordered by turn, then role and text, so repeated turns have a
    defined place (nulls first). Null text and null role are empty strings; a
    null ``conv_id`` is a conversation of its own. ``valid`` says whether the
    role order is one the state machine accepts; ``first_bad_turn`` is the
    0-based place of the first refused turn, or null. Refused conversations are
    emitted as well, so the caller decides. No rows give no rows; further
    columns are ignored.
    """
    t = template
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    moves = F.create_map(*[x for (state, role), to in t.transitions.items() for x in (F.lit(f"{state}>{role}"), F.lit(to))])
    states = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda acc, turn: F.struct(
            F.coalesce(F.element_at(moves, F.concat(acc["state"], F.lit(">"), turn["role"])), F.lit("refused")).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(
                acc["bad"],
                F.when(F.element_at(moves, F.concat(acc["state"], F.lit(">"), turn["role"])).isNull(), acc["at"]),
            ).alias("bad"),
        ),
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.turn_start), t.escape(x["role"]), F.lit(t.role_end)).alias("text"), F.lit(False).alias("loss")),
                F.struct(t.escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.turn_end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return grouped.select("conv_id", segments.alias("segments"), states["bad"].alias("first_bad_turn")).withColumn(
        "valid", F.col("first_bad_turn").isNull()
    )


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Undo :func:`format_conversations` from the emitted text alone: adds ``formatted``, ``turns_read`` and ``loss_text``."""
    t = template
    whole = formatted.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    parts = F.split("formatted", "\\Q" + t.turn_end.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    read = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            t.unescape(F.substring(p, F.lit(len(t.turn_start) + 1), F.instr(p, t.role_end) - len(t.turn_start) - 1)).alias("role"),
            t.unescape(F.substring(p, F.instr(p, t.role_end) + len(t.role_end), F.length(p))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
    return whole.select("*", read.alias("turns_read"), loss.alias("loss_text"))


#: The contract's conversation whose text imitates markers.
PROBE_TEXT = "\\### Assistant: </turn> ok"
PROBE = [(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)]


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_conversations(turns)).select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns_read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + length(role || text) - length(translate(role || text, '\\#<:', ''))) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)*u?') AS valid
FROM rows_ GROUP BY conv_id
"""
