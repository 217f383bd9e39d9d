"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (text, image, audio, document). A visitor over the parts flattens them, in order,
into one string with a placeholder for each attachment, and records each attachment's reference and expanded token count.
Turns are marked by control strings; a control string inside a text gets a ``~`` after its first character (more if it has
some there), which takes it out of the tokenizer's reach and can be taken back exactly.

The loss mask is kept turn by turn: how many code points of the turn's stretch to skip, then how many count.

Defined cases: null text, role or parts read as empty; turns with equal numbers go by role and then text; null turn numbers
come first; a null conversation id is a conversation of its own; unknown part kinds read as text; an empty table gives an
empty result. A conversation is one result row by contract, so its text must fit one row; its turns are formatted where
they lie and are gathered with partial aggregation. Texts are formatted whole; columns other than those named are not read, so
their names don't matter; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
# The control strings of common chat templates.
CONTROL = r"(\|im_start\|>|\|im_end\|>|\|image\|>|\|audio\|>|\|document\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|/?s>|/?SYS>|unk>|pad>|/?INST\])"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, SECOND_TOKENS, PAGE_TOKENS = 14, 25, 256


def escape(text: Column) -> Column:
    """Control strings broken by a ``~`` after their first character."""
    return F.regexp_replace(text, r"([<\[])(~*)" + CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + CONTROL, "$1$2$3")


#: A role stands on one line before its turn and holds no marks at all.
_ROLE = (("~", "~0"), ("\n", "~1"), ("<", "~2"), ("[", "~3"))


def escape_role(role: Column) -> Column:
    for a, b in _ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in reversed(_ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).cast(f"array<{PART}>")


def part_tokens(part: Column) -> Column:
    """Tokens an attachment expands to: patches of an image, steps of a sound, pages of a document; at least one."""
    patches = F.ceil(F.coalesce(part.width, F.lit(0)) / PATCH) * F.ceil(F.coalesce(part.height, F.lit(0)) / PATCH)
    steps, pages = F.ceil(F.coalesce(part.seconds, F.lit(0.0)) * SECOND_TOKENS), F.coalesce(part.pages, F.lit(0)) * PAGE_TOKENS
    n = F.when(part.kind == "image", patches).when(part.kind == "audio", steps).when(part.kind == "document", pages)
    return F.greatest(F.lit(1), n).cast("long")


def flatten_parts(parts: Column) -> Column:
    """The visitor: every part to its piece of text, joined in order."""

    def visit(part):
        mark = F.concat(F.lit("<|"), part.kind, F.lit("|>"))
        return F.when(part.kind.isin(*KINDS), mark).otherwise(escape(F.coalesce(part.text, F.lit(""))))

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit), "")


def attachments(parts: Column) -> Column:
    """(place among the parts, kind, ref, tokens) of each attachment, in order."""
    placed = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p, i: F.struct(i.alias("part"), p.kind.alias("kind"), p.ref.alias("ref"), part_tokens(p).alias("tokens")))
    return F.filter(placed, lambda p: F.coalesce(p.kind, F.lit("")).isin(*KINDS))


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted, loss_mask array<struct<skip,keep>>, attachments), one row a conversation."""
    who = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), who.alias("_role"), flatten_parts(F.col(parts)).alias("_body"), attachments(F.col(parts)).alias("_att"))
    head = F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n"))
    keep = F.when(F.col("_role").isin(*learn), F.char_length("_body")).otherwise(0)
    rows = rows.select("_conv", F.struct("_turn", "_role", "_body", F.concat(head, "_body", F.lit(f"{END}\n")).alias("piece"), F.char_length(head).alias("skip"), keep.alias("keep"), "_att").alias("t"))
    whole = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return whole.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("ts", lambda t: t.piece), "").alias("formatted"),
        F.transform("ts", lambda t: F.struct(t["skip"].alias("skip"), t["keep"].alias("keep"))).alias("loss_mask"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["_att"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_back(formatted: DataFrame, text: str = "formatted", mask: str = "loss_mask") -> DataFrame:
    """The rows with ``turns`` array<struct<role,text>> and ``loss_text``, read from the formatted text and the mask alone."""
    stretches = F.slice(F.split(F.col(text), r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(F.col(text), r"<\|im_start\|>", -1)) - 1, F.lit(0)))
    tail = len(END) + 1

    def turn(s):
        line = F.instr(s, F.lit("\n"))
        return F.struct(unescape_role(F.substring(s, F.lit(1), line - 1)).alias("role"), unescape(F.substring(s, line + 1, F.char_length(s) - line - tail)).alias("text"))

    under = F.zip_with("_s", F.col(mask), lambda s, m: unescape(F.substring(s, m["skip"] - len(START) + 1, m["keep"])))
    return formatted.withColumn("_s", stretches).withColumn("turns", F.transform("_s", turn)).withColumn("loss_text", F.array_join(under, "")).drop("_s")
