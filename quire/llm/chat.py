"""Chat formatting with one training example for every assistant turn, in DataFrame operations alone.

A turn is written ``<|turn_start|>role<|turn_role|>text<|turn_end|>``. Inside roles and texts every backslash is doubled and
every control string (of this template and of other common ones, see CONTROL) gets a backslash after its first
character, so a control string in the output is always a mark, and removing the escapes gives the text back.

``format_conversations`` writes each conversation once. ``prefix_examples`` explodes it into one row for every
assistant turn: all turns before it are context, and only its text is trainable. An example is a prefix of the written
conversation, cut from it as a text of its own, with its mask: where the trainable part begins and ends. A row also has a digest of all turns
of the context, which is carried along from turn to turn. ``read_back`` takes the loss text from the examples' texts under
their masks. These texts take, for a conversation of n turns, time in n squared; one is in memory at a time, and only what the
mask leaves is kept, so the query takes no such space. ``with_text`` returns them, which does.

Defined results: turns are ordered by turn, then role, then text, nulls first; a null text or role is empty; repeated
rows are turns of their own; a null conv_id is one conversation; a conversation without assistant turns has no
example; an empty table gives an empty table; further columns are ignored. A conversation is one row from here on,
since its digest is that of one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, ROLE, END = "<|turn_start|>", "<|turn_role|>", "<|turn_end|>"
#: Control strings by their first character; fixed values, those of public chat templates and this one.
CONTROL = (
    ("<", (r"\|turn_start\|>", r"\|turn_role\|>", r"\|turn_end\|>", r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", r"s>", r"/s>", r"<SYS>>", r"</SYS>>")),
    (r"\[", (r"INST\]", r"/INST\]")),
)
TRAINED = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for first, rests in CONTROL:
        out = F.regexp_replace(out, f"({first})({'|'.join(rests)})", r"$1\\$2")
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: every turn of the conversation, written with the template."""
    text, role = F.coalesce(turns["text"], F.lit("")), F.coalesce(turns["role"], F.lit(""))
    written = F.concat(F.lit(START), escape(role), F.lit(ROLE), escape(text), F.lit(END))
    rows = turns.select("conv_id", F.struct(turns["turn"].alias("turn"), role.alias("role"), text.alias("text"), written.alias("written")).alias("row"))
    # The order needs the plain text; the written form follows from it.
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return packed.select("conv_id", F.array_join(F.transform("rows", lambda x: x["written"]), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns: array of (role, text as written, length of the written turn), read from formatted alone."""
    marks = lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), r"<\|turn_role\|>", 2)
    pieces = F.filter(F.split("formatted", r"<\|turn_end\|>"), lambda x: x != "")
    turn = lambda x: F.struct(unescape(marks(x)[0]).alias("role"), marks(x)[1].alias("written"), (F.length(x) + len(END)).cast("long").alias("length"))
    return formatted.withColumn("turns", F.transform(pieces, turn))


def _digest(number: Column, role: Column, written: Column) -> Column:
    """60 bits of a hash of a turn and its place."""
    return F.conv(F.substring(F.md5(F.concat_ws("\n", number.cast("string"), role, written)), 1, 15), 16, 10).cast("long")


def prefix_examples(formatted: DataFrame, with_text: bool = False, outer: bool = False) -> DataFrame:
    """Every column but the written ones, and target, reply, context_chars, context_digest, loss_start, loss_end: a row for every assistant turn.

    target is the number of turns in the context, reply the trainable part as written. with_text adds text, the
    whole example: the context, and the turn of which the characters from loss_start to loss_end are trainable. outer adds a row of nulls
    for each conversation without examples.

    conv_id has one row in formatted, in which a conversation's turns are placed in one pass; each example is then cut from the written
    conversation on its own, so the texts of a conversation's examples are never in memory together.
    """
    parsed = formatted if "turns" in formatted.columns else parse(formatted)
    rest = [c for c in parsed.columns if c not in ("turns", "formatted")]
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("chars"), none.alias("digest"), F.lit(0).alias("number"), F.array().cast("array<struct<target:int,context_chars:bigint,context_digest:bigint,loss_start:bigint,loss_end:bigint,_first:bigint,_size:bigint>>").alias("examples"), none.alias("bytes"))

    def step(a: Column, t: Column) -> Column:
        end, size = a["chars"] + t["length"] - len(END), F.octet_length(t["written"]).cast("long")
        past = a["bytes"] + F.octet_length(escape(t["role"])) + size + len(START) + len(ROLE) + len(END)
        example = F.struct(a["number"].alias("target"), a["chars"].alias("context_chars"), a["digest"].alias("context_digest"), (end - F.length(t["written"])).alias("loss_start"), end.alias("loss_end"), (past - len(END) - size).alias("_first"), size.alias("_size"))
        examples = F.when(t["role"] == TRAINED, F.array_append(a["examples"], example)).otherwise(a["examples"])
        return F.struct((a["chars"] + t["length"]).alias("chars"), a["digest"].bitwiseXOR(_digest(a["number"], t["role"], t["written"])).alias("digest"), (a["number"] + 1).alias("number"), examples.alias("examples"), past.alias("bytes"))

    # Bytes are cut where they stand; characters would be counted from the beginning of the conversation.
    rows = parsed.select(*rest, "formatted", (F.explode_outer if outer else F.explode)(F.aggregate("turns", start, step, lambda a: a["examples"])).alias("example")).select(*rest, "formatted", "example.*")
    cut = lambda x, first, size: F.substr(x, (first + 1).cast("int"), size.cast("int"))
    rows = rows.withColumn("text", cut(F.col("formatted").cast("binary"), F.lit(0), F.col("_first") + F.col("_size") + len(END)))
    rows = rows.withColumn("reply", cut(F.col("text"), F.col("_first"), F.col("_size")).cast("string")).withColumn("text", F.col("text").cast("string")).drop("formatted", "_first", "_size")
    return rows if with_text else rows.drop("text")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation; the loss text is what the masks of the examples' texts leave, in order, escapes removed.

    examples_sha256 is a digest of target, context_chars, loss_start, loss_end and context_digest of all examples.
    """
    parsed = parse(formatted)
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["written"]), F.lit("\n"))), "")
    base = parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "turns", "formatted")
    line = F.concat(F.concat_ws(":", *[F.col(c).cast("string") for c in ("target", "context_chars", "loss_start", "loss_end", "context_digest")]), F.lit("\n"))
    examples = F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", line.alias("line"), "reply"))))
    grouped = prefix_examples(base, with_text=True, outer=True).groupBy("conv_id").agg(*[F.first(c).alias(c) for c in ("n_turns", "turns_sha256", "formatted_chars")], examples.alias("examples"))
    joined = lambda c: F.array_join(F.transform("examples", lambda x: x[c]), "")
    grouped = grouped.withColumn("loss", unescape(joined("reply")))
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", F.size("examples").cast("long").alias("n_examples"), F.sha2(joined("line"), 256).alias("examples_sha256"))


#: A conversation whose texts hold control strings, added to those of the table.
PROBE = """SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"""


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(spark.sql(PROBE))))


_ESCAPED = r"""regexp_replace(regexp_replace(replace(%s, '\', '\\'), '(<)(\|turn_start\|>|\|turn_role\|>|\|turn_end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '\1\\\2', 'g'), '(\[)(INST\]|/INST\])', '\1\\\2', 'g')"""
OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS number, {_ESCAPED % 'role'} AS e_role, {_ESCAPED % 'text'} AS e_text FROM t
), p AS (
  SELECT *, length(e_role) + length(e_text) + {len(START) + len(ROLE) + len(END)} AS size,
         ('0x' || substr(md5(number || chr(10) || role || chr(10) || e_text), 1, 15))::BIGINT AS digest FROM w
), c AS (
  SELECT *, coalesce(sum(size) OVER before, 0)::BIGINT AS context_chars, coalesce(bit_xor(digest) OVER before, 0) AS context_digest
  FROM p WINDOW before AS (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), x AS (
  SELECT *, number || ':' || context_chars || ':' || context_chars + size - {len(END)} - length(e_text) || ':' || context_chars + size - {len(END)} || ':' || context_digest || chr(10) AS line FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
       coalesce(length(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant')), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples,
       sha256(coalesce(string_agg(line, '' ORDER BY number) FILTER (role = 'assistant'), '')) AS examples_sha256
FROM x GROUP BY conv_id
"""
