"""Chat formatting by a declarative template, with DataFrame functions only.

A template gives for each role the marks before and after a turn's text and whether
the text is learned from. A finite-state machine over roles (state: the role of the
turn before) tells whether a conversation's turns are in a valid order. The result is a list of
text segments, each with a loss flag; only the texts of learned roles carry it.

Control strings inside texts are escaped reversibly: a control string, or one that has
backslashes after its first character, gets one more backslash there. Escaped texts
hold no control string, so marks split the output without doubt.

Defined cases: null text is empty; null role is the empty role; roles that the
template doesn't name are marked with their (escaped) name, carry no loss and are never
valid; rows of equal turn are ordered by role and text, null turns come first; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

TEMPLATE = {
    "system": {"before": "<<SYS>>\n", "after": "\n<</SYS>>\n", "loss": False},
    "user": {"before": "<s>[INST] ", "after": " [/INST]\n", "loss": False},
    "assistant": {"before": "<s>[ANS] ", "after": " </s>\n", "loss": True},
}
#: For roles without an entry: the name stands between the first two.
OTHER = {"before": "<s>[ROLE] ", "between": "\n[TEXT] ", "after": " [/TEXT]\n"}
CONTROL = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[TEXT]", "[/TEXT]")
#: Roles that may follow each state; "" is the start. A conversation may end in the states of ENDS.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ENDS = ("user", "assistant")

_FIRST = "[<\\[]"
_REST = "|".join(re.escape(c[1:]).replace("/", "/") for c in sorted(CONTROL, key=len, reverse=True))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_FIRST})(\\\\*)({_REST})", "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_FIRST})\\\\(\\\\*)({_REST})", "$1$2$3")


def _by_role(role: Column, field: str, other) -> Column:
    out = None
    for name, entry in TEMPLATE.items():
        out = (F.when if out is None else out.when)(role == name, F.lit(entry[field]))
    return out.otherwise(other)


def segments(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, segments (array of text, loss), in order of turns."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    moves = F.create_map(*[x for state, roles in NEXT.items() for x in (F.lit(state), F.array(*[F.lit(r) for r in roles]))])
    # the state after a bad turn is null, which no turn leaves
    step = lambda state, t: F.when(F.coalesce(F.array_contains(F.try_element_at(moves, state), t["role"]), F.lit(False)), t["role"])
    final = F.aggregate("t", F.lit("").cast("string"), step)

    def marked(t: Column) -> Column:
        known = t["role"].isin(list(TEMPLATE))
        before = _by_role(t["role"], "before", F.concat(F.lit(OTHER["before"]), escape(t["role"]), F.lit(OTHER["between"])))
        loss = F.coalesce(known & _by_role(t["role"], "loss", F.lit(False)), F.lit(False))
        part = lambda x, flag: F.struct(x.alias("text"), flag.alias("loss"))
        return F.array(part(before, F.lit(False)), part(escape(t["text"]), loss), part(_by_role(t["role"], "after", F.lit(OTHER["after"])), F.lit(False)))

    return whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.coalesce(final.isin(list(ENDS)), F.lit(False)).alias("valid"), F.flatten(F.transform("t", marked)).alias("segments"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) back from formatted text: marks can't occur in escaped texts."""
    begins = [re.escape(e["before"]) for e in (*TEMPLATE.values(), OTHER)]
    parts = F.split(formatted, f"(?={'|'.join(begins)})")
    parts = F.filter(parts, lambda p: p != F.lit(""))

    def turn(p: Column) -> Column:
        role = text = None
        for name, e in TEMPLATE.items():
            begin, end = len(e["before"]), len(e["after"])
            hit = F.startswith(p, F.lit(e["before"]))
            role = (F.when if role is None else role.when)(hit, F.lit(name))
            body = F.substring(p, F.lit(begin + 1), F.length(p) - F.lit(begin + end))
            text = (F.when if text is None else text.when)(hit, body)
        at = F.instr(p, OTHER["between"])
        other_role = F.substring(p, F.lit(len(OTHER["before"]) + 1), at - F.lit(len(OTHER["before"]) + 1))
        start = at + F.lit(len(OTHER["between"]))
        other_text = F.substring(p, start, F.length(p) - start + F.lit(1 - len(OTHER["after"])))
        return F.struct(unescape(role.otherwise(other_role)).alias("role"), unescape(text.otherwise(other_text)).alias("text"))

    return F.transform(parts, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what segments() returned, read back from its output."""
    whole = formatted.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    turns = parse(F.col("formatted"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = whole.select("conv_id", "valid", F.size(turns).cast("long").alias("n_turns"), spoken.alias("spoken"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("spoken", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid")
