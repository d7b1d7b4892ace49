"""Chat formatting from event logs, in DataFrame functions only.

A log row is an event on a message of a conversation: `message` and `edit` set its
text, `regenerate` drops what was streamed and starts again, `delta` adds to it,
`delete` removes it. Events are dealt by conversation and message, so a long
conversation is folded by many tasks, sorted by sequence and folded to the text
after the last reset; only then are the final messages of a conversation gathered
and rendered. A conversation becomes one string, so its messages must fit a task.

The template marks turns with control strings. Control strings inside texts and
roles are escaped with a backslash code, a backslash itself included, so that
unescaping gives the text back exactly. `loss` holds the code point spans of
assistant texts in the formatted string.

Defined results: a null text or role is empty; a null conversation id is a
conversation of its own; equal sequence numbers are ordered by kind, role, text; rows
that repeat are events that repeat; an empty log gives no conversations; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings and their codes (fixed values).
CODES = {"<|": "\\p", "<s>": "\\b", "</s>": "\\e", "[INST]": "\\i", "[/INST]": "\\j", "<<SYS>>": "\\y", "<</SYS>>": "\\z"}
BACKSLASH, NEWLINE = "\\s", "\\n"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column, newlines: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit(BACKSLASH))
    for control, code in CODES.items():
        out = F.replace(out, F.lit(control), F.lit(code))
    return F.replace(out, F.lit("\n"), F.lit(NEWLINE)) if newlines else out


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(NEWLINE), F.lit("\n"))
    for control, code in CODES.items():
        out = F.replace(out, F.lit(code), F.lit(control))
    return F.replace(out, F.lit(BACKSLASH), F.lit("\\"))


def fold(events: DataFrame, conv: str = "conv_id", message: tuple[str, ...] = ("message",), seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: __conv, __first (sequence of its first event), __m0.., __role, __text."""
    keys = [f"__m{i}" for i in range(len(message))]
    ev = events.select(
        F.col(f"`{conv}`").alias("__conv"),
        *[F.col(f"`{m}`").alias(k) for m, k in zip(message, keys, strict=True)],
        F.struct(F.col(f"`{seq}`").alias("seq"), F.col(f"`{kind}`").alias("kind"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("__e"),
    )
    of = Window.partitionBy("__conv", *keys)
    reset = F.when(F.col("__e.kind").isin(*RESETS), F.col("__e"))
    live = ev.withColumn("__reset", F.max(reset).over(of)).withColumn("__first", F.min("__e").over(of)).where(F.col("__reset").isNull() | (F.col("__e") >= F.col("__reset")))
    # Repeats of the resetting event set the same text again: only one of them counts.
    parts = F.array_sort(F.collect_list(F.when(F.col("__reset").isNull() | (F.col("__e") > F.col("__reset")), F.col("__e"))))
    done = live.groupBy("__conv", *keys).agg(parts.alias("__parts"), F.first("__reset").alias("__reset"), F.first("__first").alias("__first"))
    tail = F.array_join(F.transform("__parts", lambda p: p["text"]), "")
    removed = (F.coalesce(F.col("__reset.kind"), F.lit("")) == "delete") & (F.size("__parts") == 0)
    head = F.when(F.col("__reset.kind") == "delete", F.lit("")).otherwise(F.coalesce(F.col("__reset.text"), F.lit("")))
    return done.where(~removed).select("__conv", F.col("__first.seq").alias("__first"), *keys, F.col("__first.role").alias("__role"), F.concat(head, tail).alias("__text"))


def render(messages: DataFrame) -> DataFrame:
    """Conversations: conv_id, n_turns, formatted, loss (array of start, end: code points, end exclusive)."""
    keys = [c for c in messages.columns if c.startswith("__m")]
    lead = F.concat(F.lit(START), escape(F.col("__role"), newlines=True), F.lit("\n"))
    turns = messages.select("__conv", "__first", *keys, F.col("__role"), lead.alias("__lead"), escape(F.col("__text")).alias("__body"))
    order = Window.partitionBy("__conv").orderBy("__first", *keys, "__role", "__body")
    size = F.length("__lead") + F.length("__body") + len(END)
    placed = turns.withColumn("__n", F.row_number().over(order)).withColumn("__at", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    span = F.struct((F.col("__at") + F.length("__lead")).alias("start"), (F.col("__at") + F.length("__lead") + F.length("__body")).alias("end"))
    turn = F.struct("__n", F.concat("__lead", "__body", F.lit(END)).alias("piece"), F.when(F.col("__role") == "assistant", span).alias("span"))
    got = placed.groupBy("__conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return got.select(
        F.col("__conv").alias("conv_id"),
        F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """Turns of a formatted string: array of role, text."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))

    def turn(p: Column) -> Column:
        name = F.substring_index(p, "\n", 1)
        return F.struct(unescape(name).alias("role"), unescape(F.substring(p, F.length(name) + 2, F.length(p))).alias("text"))

    return F.transform(bodies, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def format_events(events: DataFrame, **columns) -> DataFrame:
    """Fold, then render. A conversation whose messages were all deleted gives no row."""
    return render(fold(events, **columns))
