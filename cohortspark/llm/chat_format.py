"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted (turn, role, text), neighbours of the same role are
merged into one block by array functions, and blocks are concatenated:
``<|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n``. Inside texts and roles a backslash is put after the first
character of every control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``; after those backslashes that
are there already), so no control string is left and taking one backslash away restores the text exactly.
The loss mask is an array of (start, chars) over the formatted string: one entry per assistant text.

Offsets come from sums of chunks, computed once per block, and text under the mask is read from chunks of the string, so
the work grows in proportion to the conversation, also with very many turns of one role or very long texts.

Defined cases: null text and null role count as empty; equal turn numbers sort by role, then text; repeated rows
stay repeated turns; a null ``conv_id`` is one conversation; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_CONTROL = r"([|]|/?s>|/?INST\]|/?SYS>>)"
CHUNK = 256  # turns
READ = 4096  # characters


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(?=" + _CONTROL + ")", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(?=" + _CONTROL + ")", "$1$2")


def _role(role: Column) -> Column:
    """A role on one line: backslash and line feed are spelt, then control strings escaped."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _running(sizes: Column) -> Column:
    """Sum of the entries before each one: sums of chunks first, so that the work stays near linear."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(sizes, c * CHUNK + 1, CHUNK), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.struct(chunks.alias("chunks"), sizes.alias("sizes"))


def _before(run: Column, i: Column) -> Column:
    add = lambda a, x: a + x
    c = F.floor(i / CHUNK).cast("int")
    return F.aggregate(F.slice(run["chunks"], F.lit(1), c), F.lit(0).cast("long"), add) + F.aggregate(F.slice(run["sizes"], c * CHUNK + 1, i % CHUNK), F.lit(0).cast("long"), add)


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start,chars>> (0-based). One shuffle, on conv_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = _role(F.coalesce(F.col("role"), F.lit("")))
    loss = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), escape(text).alias("body"), loss.alias("loss"))
    d = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    d = d.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1))))
    until = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns"))
    d = d.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda i, k: F.struct(
                role_at(i).alias("role"), F.get(F.col("turns"), i)["loss"].alias("loss"), F.transform(F.slice("turns", i + 1, until(k) - i), lambda t: t["body"]).alias("bodies")
            ),
        ),
    )
    piece = lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["bodies"], SEP), F.lit(END))
    sized = lambda b: _running(F.transform(b["bodies"], lambda t: F.length(t) + len(SEP)))
    d = d.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["role"].alias("role"), b["loss"].alias("loss"), b["bodies"].alias("bodies"), piece(b).alias("piece"), sized(b).alias("run"))))
    d = d.withColumn("run", _running(F.transform("blocks", lambda b: F.length(b["piece"]))))
    # Where the first body of each block begins.
    d = d.withColumn("begin", F.transform("blocks", lambda b, k: _before(F.col("run"), k) + len(START) + F.length(b["role"]) + 1))
    spans = F.transform(
        "blocks",
        lambda b, k: F.when(
            b["loss"],
            F.transform(b["bodies"], lambda t, j: F.struct((F.get(F.col("begin"), k) + _before(b["run"], j)).alias("start"), F.length(t).cast("long").alias("chars"))),
        ).otherwise(F.array().cast("array<struct<start:bigint,chars:bigint>>")),
    )
    d = d.withColumn("pieces", F.transform("blocks", lambda b: b["piece"]))
    return d.select("conv_id", F.array_join("pieces", "").alias("formatted"), F.flatten(spans).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns inside a formatted string, unescaped."""

    def turns(block: Column) -> Column:
        inside = F.regexp_replace(block.substr(F.instr(block, "\n") + 1, F.length(block)), r"<\|im_end\|>\n\z", "")
        return F.transform(F.split(inside, r"<\|im_sep\|>"), lambda t: F.struct(_role_back(F.substring_index(block, "\n", 1)).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30), turns))


def under_mask(chunks: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. ``chunks``: the formatted string in pieces of READ characters."""

    def text(m: Column) -> Column:
        first = F.floor(m["start"] / READ).cast("int")
        n = F.floor((m["start"] % READ + m["chars"]) / READ).cast("int") + 1
        return unescape(F.array_join(F.slice(chunks, first + 1, n), "").substr((m["start"] % READ + 1).cast("int"), m["chars"].cast("int")))

    return F.array_join(F.transform(mask, text), "")


def chat_digest(chats: DataFrame) -> DataFrame:
    """What the output says when it is read back: turns and loss text as counts and digests."""
    d = chats.select("conv_id", "formatted", "loss_mask", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{READ}}}"), F.lit(0)).alias("chunks"))
    d = d.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("chunks"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
