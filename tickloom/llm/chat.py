"""Chat formatting from event logs, in DataFrame operations only.

Logs are partitioned by conversation and by block of messages, sorted by sequence and folded: deltas are appended,
edits replace, regenerations empty the last message. A block is rendered where it was folded; a conversation is its
blocks in order, so a conversation with very many messages is folded by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Messages that are folded together.
BLOCK = 32
#: What opens a control string of this or another template: <| or </s> or <s> or [INST] or [/INST]. A backslash goes after its first character.
_CONTROL = r"(<(?=\||/?s>)|\[(?=/?INST\]))"


def escaped(text: Column) -> Column:
    """Reversible: backslashes are doubled, then control strings are broken by one."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_CONTROL), F.lit("$1\\\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def message_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as an event log: one whole message each. Null role or text: empty."""
    turn = F.col("turn").cast("long")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("msg"), turn.alias("seq"), F.lit("message").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def streamed_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as the event log that a chat service would have written, whose fold is the rows again.

    A hash of the row chooses between one whole message; an empty one and three deltas; a draft (the text's first third) and an edit
    to the whole text; a draft, a regeneration and three deltas. copy tells rows of one turn apart. Null role or text: empty.
    """
    turn, text = F.col("turn").cast("long"), F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("msg"), F.monotonically_increasing_id().alias("copy"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.pmod(F.xxhash64("conv_id", turn, text), F.lit(4)).alias("way"))
    third = F.ceil(F.length("text") / 3).cast("int")
    part = lambda k: F.substring("text", third * k + 1, third)
    event = lambda seq, kind, said: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    deltas = [event(2 + k, "delta", part(k)) for k in range(3)]
    draft, whole = event(0, "message", part(0)), F.col("text")
    log = (
        F.when(F.col("way") == 0, F.array(event(0, "message", whole)))
        .when(F.col("way") == 1, F.array(event(0, "message", F.lit("")), *deltas))
        .when(F.col("way") == 2, F.array(draft, event(1, "edit", whole)))
        .otherwise(F.array(draft, event(1, "regenerate", F.lit("")), *deltas))
    )
    return rows.select("conv_id", "msg", "copy", "role", F.explode(log).alias("e")).select("conv_id", "msg", "copy", "e.seq", "e.kind", "role", "e.text")


def _folded(events: Column) -> Column:
    """Sorted events to messages. message begins one; delta, edit and regenerate change the last, or begin one if there is none."""
    empty = F.array().cast("array<struct<msg:bigint,role:string,text:string,copy:bigint>>")

    def step(done: Column, e: Column) -> Column:
        same = (F.size(done) > 0) & (e["kind"] != "message") & F.element_at(done, -1)["msg"].eqNullSafe(e["msg"]) & F.element_at(done, -1)["copy"].eqNullSafe(e["copy"])
        last = F.element_at(done, -1)
        before = F.when(same, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        old = F.when(same, last["text"]).otherwise(F.lit(""))
        text = F.when(e["kind"] == "delta", F.concat(old, e["text"])).when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])
        return F.concat(before, F.array(F.struct(e["msg"].alias("msg"), F.when(same, last["role"]).otherwise(e["role"]).alias("role"), text.alias("text"), e["copy"].alias("copy"))))

    return F.aggregate(events, empty, step)


def format_conversations(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """events: (conv_id, msg, seq, kind, role, text); kind is message, delta, edit or regenerate. One row for each conv_id: (conv_id, formatted).

    Messages go by msg, the events of one by seq, equal ones by kind, role and text. Two message events of one msg are two messages.
    An optional copy (a whole number) tells messages of one msg apart whose events would mix; these then go by role and folded text.
    Null roles and texts count as empty, a null msg or seq comes first, a null conv_id is a conversation of its own. Roles are
    percent-encoded, texts escaped. Extra columns are ignored; an empty log gives an empty result.
    """
    kind = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    told = "copy" in events.columns
    copy = F.col("copy").cast("long") if told else F.lit(None).cast("long")
    rows = events.select("conv_id", F.floor(F.col("msg") / block).alias("block"), F.struct("msg", copy.alias("copy"), "seq", kind.alias("nth"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "kind").alias("e"))
    messages = _folded(F.array_sort(F.collect_list("e")))
    blocks = rows.groupBy("conv_id", "block").agg((F.array_sort(messages) if told else messages).alias("messages"))
    shown = F.transform("messages", lambda m: F.concat(F.lit(START), F.url_encode(m["role"]), F.lit("\n"), escaped(m["text"]), F.lit(END), F.lit("\n")))
    blocks = blocks.select("conv_id", F.struct("block", F.array_join(shown, "").alias("text")).alias("b"))
    whole = F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"])
    return blocks.groupBy("conv_id").agg(F.array_join(whole, "").alias("formatted"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text, in_loss). The loss mask covers the text of assistant turns."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    parts = F.slice(parts, 2, F.size(parts))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - len(END) - 2)
        role = F.url_decode(head)
        return F.struct(role.alias("role"), unescaped(body).alias("text"), (role == "assistant").alias("in_loss"))

    return F.transform(parts, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it."""
    read = formatted.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: t["text"]), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: Both turns of conversation -1 say what another template uses to control a model.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    rows = [f"select -1L as conv_id, {k}L as turn, '{role}' as role, '{PROBE}' as text" for k, role in enumerate(("user", "assistant"))]
    probe = spark.sql(" union all ".join(rows))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
