"""Chat formatting with Spark expressions only.

Rows are turns. A conversation becomes one string: adjacent turns of one role form a block that opens with a role
header and closes with an end mark, and the turns inside a block are set apart by a separator, so that every turn can
be read back. Control strings inside texts and roles are escaped reversibly. The loss mask holds byte spans (in UTF-8)
of the assistant texts alone.

Work is split so that no group is unbounded: turns are first gathered in runs of TURNS_PER_PIECE consecutive turn
numbers, each formatted on its own, and a conversation then joins its pieces (its own output string is the only thing
that must fit in one row).

Defined cases: null text or role counts as empty; a null conversation id is one conversation; a null turn sorts first;
turns with equal numbers are ordered by role, then text; repeated rows are repeated turns; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, HEAD, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[NEXT]", "</s>"
#: What opens a control string, in a text; a backslash goes after its first char. Backslashes are doubled before.
_CONTROL = r"([<\[])(?=/?s>|/?INST\]|NEXT\])"
TURNS_PER_PIECE = 64
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted string, loss_mask array of (start, length) in UTF-8 bytes), one row per conversation."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"),
        F.floor(F.col(turn) / TURNS_PER_PIECE).alias("piece"),
    )
    # Runs of turns: sorted structs, then an aggregation that merges neighbours of one role into blocks.
    runs = rows.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    blocks = F.aggregate(
        "ts",
        F.expr("cast(array() as array<struct<role:string, texts:array<string>>>)"),
        lambda acc, t: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["role"] == t["role"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(t["role"].alias("role"), F.concat(F.element_at(acc, -1)["texts"], F.array(escape(t["text"]))).alias("texts"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"))))),
    )
    pieces = runs.select("conv_id", "piece", blocks.alias("blocks")).select(
        "conv_id",
        F.struct(
            "piece",
            F.element_at("blocks", 1)["role"].alias("first"),
            F.element_at("blocks", -1)["role"].alias("last"),
            # The first block's header is left to the join, which knows what stands before it.
            F.array_join(F.transform("blocks", lambda b, i: F.concat(F.when(i > 0, _turnover(b["role"])).otherwise(F.lit("")), F.array_join(b["texts"], NEXT))), "").alias("body"),
            _mask("blocks").alias("mask"),
        ).alias("p"),
    )
    joined = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice("ps", 1, F.size("ps") - 1), lambda p: p["last"]))
    led = joined.select(
        "conv_id",
        F.zip_with(
            "ps",
            before,
            lambda p, prev: F.struct(
                F.when(prev.isNull(), F.concat(F.lit(OPEN), escape(p["first"]), F.lit(HEAD))).when(prev == p["first"], F.lit(NEXT)).otherwise(_turnover(p["first"])).alias("lead"),
                p["body"].alias("body"),
                p["mask"].alias("mask"),
            ),
        ).alias("ps"),
    )
    # Where each piece begins in the whole string, in bytes; linear in the number of pieces but for short arrays of longs.
    placed = F.aggregate(
        "ps",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("starts")),
        lambda acc, p: F.struct(
            (acc["at"] + F.octet_length(p["lead"]) + F.octet_length(p["body"])).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.octet_length(p["lead"]))).alias("starts"),
        ),
    )["starts"]
    return led.select("conv_id", "ps", placed.alias("starts")).select(
        "conv_id",
        F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten(F.zip_with("ps", "starts", lambda p, at: F.transform(p["mask"], lambda m: F.struct((m["start"] + at).alias("start"), m["length"].alias("length"))))).alias("loss_mask"),
    )


def _turnover(role: Column) -> Column:
    return F.concat(F.lit(CLOSE + OPEN), escape(role), F.lit(HEAD))


def _mask(blocks: str) -> Column:
    """Spans of the loss role's texts inside a piece's body; the body begins with the first block's first text."""
    step = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("first"), F.expr("cast(array() as array<struct<start:bigint, length:bigint>>)").alias("spans")),
        lambda acc, b: F.aggregate(
            b["texts"],
            F.struct(
                (acc["at"] + F.when(acc["first"], 0).otherwise(F.octet_length(_turnover(b["role"])) - len(NEXT))).alias("at"),
                acc["first"].alias("first"),
                acc["spans"].alias("spans"),
            ),
            lambda s, text: F.struct(
                (s["at"] + F.when(s["first"], 0).otherwise(len(NEXT)) + F.octet_length(text)).alias("at"),
                F.lit(False).alias("first"),
                F.when(
                    b["role"] == LOSS_ROLE,
                    F.concat(s["spans"], F.array(F.struct((s["at"] + F.when(s["first"], 0).otherwise(len(NEXT))).alias("start"), F.octet_length(text).cast("long").alias("length")))),
                ).otherwise(s["spans"]).alias("spans"),
            ),
        ),
    )
    return step["spans"]


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, "</s>"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, HEAD, -1), r"\[NEXT\]"),
                lambda text: F.struct(unescape(F.regexp_extract(b, r"(?s)^<s>\[INST\](.*?)\[/INST\]", 1)).alias("role"), unescape(text).alias("text")),
            ),
        )
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    raw = F.encode(formatted, "UTF-8")
    return F.array_join(F.transform(mask, lambda m: unescape(F.decode(F.substring(raw, m["start"].cast("int") + 1, m["length"].cast("int")), "UTF-8"))), "")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = format_conversations(turns.unionByName(extra))
    read = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same rows in DuckDB: escapes counted in the length, blocks found by comparing a turn's role with the one before.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS k,
    length(text) + (length(text) - length(replace(text, '\', ''))) + length(regexp_replace(text, '(</?s>|\[/?INST\]|\[NEXT\])', 'X\1', 'g')) - length(text) AS text_len,
    length(role) + (length(role) - length(replace(role, '\', ''))) + length(regexp_replace(role, '(</?s>|\[/?INST\]|\[NEXT\])', 'X\1', 'g')) - length(role) AS role_len
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(text_len) + sum(CASE WHEN prev IS NULL THEN 20 + role_len WHEN prev <> role THEN 20 + role_len ELSE 6 END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
