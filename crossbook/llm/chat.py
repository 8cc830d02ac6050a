"""Chat formatting as Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent
turns of one role are merged into a block, and blocks are concatenated by a
template. A block is

    header role after_role text (joint text)* close

so the turns of a merged block can still be told apart. Control strings of the
template (and the escape character) are replaced inside roles and texts by a
two-character code each, so none of them ever appears there and ``read_turns``
gets every role and text back. ``loss_spans`` are the code points of the
assistant texts in ``formatted``: the joints and headers lie outside.

All steps are linear in the length of a conversation: blocks are slices of the
sorted array, and spans are read from pieces of SPAN_PIECE characters.

Defined cases: a null text or role is empty; turns sort by (turn, role, text),
nulls first, so ties and repeated rows have one order and each stays; rows
with a null conv_id are one conversation whose id is null; an empty text keeps
its turn; an empty table has no conversations. Extra columns are ignored. A
formatted conversation is one string, so it must stay below Spark's limit of
2 GB for a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
SPAN_PIECE = 8192


@dataclass(frozen=True)
class ChatTemplate:
    """The control strings. None may end with what itself or another begins
    with, and none may hold the escape character."""

    header: str = "### "
    after_role: str = ":"
    joint: str = "<turn/>"
    close: str = "</turn>"
    trained: tuple[str, ...] = ("assistant",)

    def codes(self, role: bool = False) -> list[tuple[str, str]]:
        """(string, code) in the order of escaping: the escape character first."""
        found = [(ESCAPE, ESCAPE + "e"), (self.header, ESCAPE + "h"), (self.joint, ESCAPE + "j"),
                 (self.close, ESCAPE + "c")]
        return found + [(self.after_role, ESCAPE + "r")] if role else found


def escaped(text: Column, codes: list[tuple[str, str]]) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes: list[tuple[str, str]]) -> Column:
    """The inverse: the code of the escape character is read last, when no
    other code is left that it could complete."""
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _after(array: Column, i: Column) -> Column:
    """Element i (from 1) of an array, null beyond its end."""
    return F.try_element_at(array, i.cast("int"))


def merged_blocks(turns: Column) -> Column:
    """Sorted turn structs (role, text) as an array of (role, texts): adjacent
    turns of one role share a block."""
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)),
                      lambda i: (i == 1) | (_after(turns, i)["role"] != _after(turns, i - 1 + (i == 1).cast("int"))["role"]))

    def block(start, k):
        stop = F.coalesce(_after(starts, k + 2), F.size(turns) + 1)
        return F.struct(_after(turns, start)["role"].alias("role"),
                        F.transform(F.slice(turns, start, stop - start), lambda t: t["text"]).alias("texts"))

    return F.transform(starts, block)


def format_conversations(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points of each
    trained text, from 0), n_blocks."""
    text_codes, role_codes = template.codes(), template.codes(role=True)
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_turns = (rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"))
                    .groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")))
    blocks = sorted_turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), escaped(t["text"], text_codes).alias("text"))).alias("turns")).select(
            "conv_id", merged_blocks(F.col("turns")).alias("blocks"))

    def head(b):
        return F.concat(F.lit(template.header), escaped(b["role"], role_codes), F.lit(template.after_role))

    # pieces: (length, trained) of everything that is concatenated, in order
    def pieces(b):
        trained = b["role"].isin(*template.trained) if template.trained else F.lit(False)
        return F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            F.struct(F.when(i == 0, F.length(head(b))).otherwise(F.lit(len(template.joint))).alias("gap"),
                     F.length(t).alias("length"), trained.alias("trained"),
                     F.when(i == F.size(b["texts"]) - 1, F.lit(len(template.close))).otherwise(F.lit(0)).alias("tail")))))

    written = F.array_join(F.transform("blocks", lambda b: F.concat(
        head(b), F.array_join(b["texts"], template.joint), F.lit(template.close))), "")
    listed = blocks.select("conv_id", written.alias("formatted"), F.size("blocks").alias("n_blocks"),
                           F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    return listed.select("conv_id", "formatted", loss_spans("pieces").alias("loss_spans"), "n_blocks")


#: Turns whose places are summed in one go (see loss_spans).
SUM_RUN = 256


def loss_spans(pieces: str) -> Column:
    """Start and length of each trained piece. Running sums are taken in two
    steps, over runs of SUM_RUN pieces and inside each, as an array that grows
    element by element is copied each time."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / SUM_RUN).cast("int")),
        lambda r: F.slice(pieces, r * SUM_RUN + 1, F.lit(SUM_RUN)))

    def width(p):
        return p["gap"] + p["length"] + p["tail"]

    def spans(run, base):
        first = F.struct(base.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found"))
        return F.aggregate(run, first, lambda a, p: F.struct(
            (a["at"] + width(p)).alias("at"),
            F.when(p["trained"], F.array_append(a["found"], F.struct(
                (a["at"] + p["gap"]).alias("start"), p["length"].cast("bigint").alias("length"))))
            .otherwise(a["found"]).alias("found")), lambda a: a["found"])

    totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda a, p: a + width(p)))
    bases = F.aggregate(totals, F.array(F.lit(0).cast("bigint")),
                        lambda a, t: F.array_append(a, F.element_at(a, -1) + t))
    return F.flatten(F.zip_with(runs, F.slice(bases, 1, F.size(runs)), spans))


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The (role, text) structs of every turn, out of a formatted string."""
    blocks = F.split(formatted, _literal(template.close))
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block):
        upto = F.position(F.lit(template.after_role), block, F.lit(len(template.header) + 1))
        role = F.substr(block, F.lit(len(template.header) + 1), upto - len(template.header) - 1)
        texts = F.split(F.substr(block, upto + len(template.after_role)), _literal(template.joint))
        return F.transform(texts, lambda t: F.struct(
            unescaped(role, template.codes(role=True)).alias("role"), unescaped(t, template.codes()).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def _literal(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return "\\Q" + text + "\\E"


def read_loss_texts(formatted: Column, spans: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    pieces = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % SPAN_PIECE), F.lit(0))

    def text(s):
        first = F.floor(s["start"] / SPAN_PIECE).cast("int")
        last = F.floor((s["start"] + s["length"]) / SPAN_PIECE).cast("int")
        around = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.substr(around, (s["start"] - first * SPAN_PIECE + 1).cast("int"), s["length"].cast("int"))

    return F.transform(spans, lambda s: unescaped(text(s), template.codes()))


def digest_conversations(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Every conversation formatted, then read back: the turns from the string,
    the trained texts from string and mask, as digests."""
    out = format_conversations(rows, template)
    read = out.select("conv_id", "formatted", "n_blocks",
                      read_turns(F.col("formatted"), template).alias("turns"),
                      F.array_join(read_loss_texts(F.col("formatted"), F.col("loss_spans"), template), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


#: A conversation that holds control strings in its texts.
TRICKY = "\\### Assistant: </turn> ok"
TRICKY_ID = -7


def with_tricky(rows: DataFrame) -> DataFrame:
    """``rows`` and the conversation TRICKY_ID: a user, then an assistant, both saying TRICKY."""
    narrow = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                         F.col("role").cast("string"), F.col("text").cast("string"))
    own = rows.sparkSession.range(2).select(
        F.lit(TRICKY_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return narrow.unionByName(own)


def _sql_escaped(column: str, codes: list[tuple[str, str]]) -> str:
    for plain, code in codes:
        column = f"replace({column}, '{plain}', '{code}')"
    return column


def chat_sql(template: ChatTemplate = ChatTemplate()) -> str:
    """The digests in SQL, from the turns themselves (not read back)."""
    trained = ", ".join(f"'{r}'" for r in template.trained)
    text, role = _sql_escaped("text", template.codes()), _sql_escaped("role", template.codes(role=True))
    head, joint = len(template.header) + len(template.after_role), len(template.joint)
    return f"""
WITH rows_ AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT {TRICKY_ID}, 0, 'user', '{TRICKY}' UNION ALL SELECT {TRICKY_ID}, 1, 'assistant', '{TRICKY}'),
placed AS (
  SELECT *, lag(role) OVER w AS before,
         row_number() OVER w AS n
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({trained})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role IN ({trained})), '')) AS loss_sha256,
       CAST(sum(length({text}) + CASE WHEN before IS NOT NULL AND before = role THEN {joint}
                ELSE {head + len(template.close)} + length({role}) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
