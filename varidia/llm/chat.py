"""Chat formatting with Spark expressions only: sorted turns, merged neighbours, one string a conversation.

    <|im_start|>role\n text <|im_next|> text of the same role's next turn <|im_end|>\n ...

Adjacent turns of one role share a block, with a mark between them, so the turns can be read back. Control
strings inside a text or role get a backslash after their first character, after each backslash has been
doubled; a newline in a role becomes backslash n. Both are undone on reading. The loss mask covers the texts of
assistant turns, as spans of code points of the formatted string.

Turns sort by turn (null first), role, text. Null text and role count as empty; a null conv_id is a conversation.
An empty table gives no row. Repeated rows are turns of their own. Other columns are not used. A conversation's
string needs all its turns in one row; its parts are made for each turn and joined once, in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strings of this template and of other public chat templates that must not occur unescaped in a text.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def _unescape_controls(text: Column) -> Column:
    for c in CONTROL:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return text


def unescape(text: Column) -> Column:
    return F.replace(_unescape_controls(text), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # between doubled backslashes, each backslash n is a newline
    parts = F.transform(F.split(role, r"\\\\"), lambda p: _unescape_controls(F.replace(p, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(parts, "\\")


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id and its formatted string."""
    empty = F.lit("")
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))

    def piece(x: Column, i: Column) -> Column:
        before = F.get(F.col("t"), i - 1)["role"]
        block = F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n"))
        opening = F.when(i == 0, block).when(before == x["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), block))
        return F.concat(opening, escape(x["text"]))

    return conv.select("conv_id", F.concat(F.array_join(F.transform("t", piece), ""), F.lit(END)).alias("formatted"))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs of role and text."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = _unescape_role(F.substring_index(block, "\n", 1))
        head = F.length(F.substring_index(block, "\n", 1)) + 1
        body = F.substr(block, head + 1, F.length(block) - head - len(END))
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_pieces(formatted: Column, loss_role: str = "assistant") -> Column:
    """The mask over a formatted string: its pieces in order, as structs of text and whether it is learned.

    Joined, the pieces give the formatted string again; those that are learned are the escaped texts of loss_role.
    """
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    make = lambda text, learned: F.struct(text.alias("text"), F.lit(learned).alias("learned") if isinstance(learned, bool) else learned.alias("learned"))

    def pieces(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        head = F.length(role) + 1
        body = F.substr(block, head + 1, F.length(block) - head - len(END))
        learned = _unescape_role(role) == loss_role
        texts = F.split(body, r"<\|im_next\|>")
        inner = F.flatten(F.transform(texts, lambda t, i: F.array(make(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT)), False), make(t, learned))))
        return F.concat(F.array(make(F.concat(F.lit(START), role, F.lit("\n")), False)), inner, F.array(make(F.lit(END), False)))

    return F.filter(F.flatten(F.transform(blocks, pieces)), lambda x: x["text"] != "")


def op9_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chat(turns).withColumns({"t": read_chat(F.col("formatted")), "m": loss_pieces(F.col("formatted"))})
    learned = unescape(F.array_join(F.transform(F.filter("m", lambda x: x["learned"]), lambda x: x["text"]), ""))
    return out.withColumn("learned", learned).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_length(column: str) -> str:
    """DuckDB SQL for the length of an escaped text: each backslash and each control string adds one."""
    often = lambda x, n: f"(length({column}) - length(replace({column}, {x}, ''))) // {n}"
    return " + ".join([f"length({column})", often("chr(92)", 1), *(often(f"'{c}'", len(c)) for c in CONTROL)])


#: Digests come straight from the rows; only the formatted length counts marks and escapes. A newline in a role adds one more.
OP9_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    {_escaped_length("text")} AS escaped,
    {_escaped_length("role")} + length(role) - length(replace(role, chr(10), '')) AS escaped_role
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN before = role THEN {len(NEXT)} ELSE {len(START)} + escaped_role + 1 + {len(END)} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
