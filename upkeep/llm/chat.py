"""Chat formatting in budgeted windows.

Prefix sums of turn tokens place every turn on a line of spans of ``stride``
tokens; the turns that start in a span form a window, so windows are aligned
with turns. A turn longer than the stride stands alone in a window of its own. A
window holds the conversation's system turn (its first turn, if the role is
``system``), a limited history (the turns before it that start within its
history tokens) and its new turns. Only new assistant turns are under the
loss mask; the system turn after its first window and repeated history are
masked, so each assistant text is a target exactly once.

A turn's tokens are those of its formatted text, marks and escapes included;
tokens never cross the line breaks around a turn, so a window has exactly the sum
of its turns' tokens. Each conversation has a stride of its own: of the budget
less its system turn, at most a quarter, and at most ``history`` tokens, is
history, and half of the rest is the stride. The new turns of a window have less
than two strides, and a turn that stands alone gets no more history than it
leaves room for. So a window exceeds the budget only where the system turn and a
single new turn do so by themselves; then there is no history, and nothing is cut.

Template: ``### role``, newline, text, newline, ``</turn>``, newline. Inside
texts and roles a backslash is doubled and ``</turn>`` and ``### `` get a
backslash in front (and a newline inside a role becomes backslash n), so neither
mark can occur in a text, and reading back is exact.

Prefix sums are taken over range partitions and a window's rows are bounded by
its budget, so a conversation of any length spreads over many tasks; reading
back streams through a conversation in order.

Cases: null texts and roles are empty; null conversation ids form one
conversation; null turns come first; rows with equal turns keep the input's
order and are all kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm.common import prefix_sums, written
from upkeep.llm.token_counts import TOKENIZER, counter

BUDGET = 1024
HISTORY = 160
END = "\n</turn>\n"


def _escaped(c):
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("</turn>"), F.lit("\\</turn>"))
    return F.replace(c, F.lit("### "), F.lit("\\### "))


def _head(role):
    return F.concat(F.lit("### "), F.replace(_escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def unescape_role(role: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.partition("\n")
        out.append((unescape_role(role[4:]), unescape(text)))
    return out


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``conv_id, window`` (in order), ``formatted``, ``context`` (leading turns
    that repeat earlier ones), ``loss`` (start and length of the masked-in spans,
    in code points) and ``tokens`` of the formatted text."""

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        c = counter(tokenizer)
        return text.map(c.count)

    rows = written(conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
                   .withColumn("_cost", tokens(F.concat(_head(F.col("role")), _escaped(F.col("text")), F.lit(END))))
                   .withColumn("_rid", F.monotonically_increasing_id()), "turns")
    lead = written(rows.groupBy("conv_id").agg(F.min_by(F.struct("_rid", "role", "_cost"), F.struct("turn", "_rid")).alias("_lead"))
                   .select(F.col("conv_id").alias("_c"), F.col("_lead._rid").alias("_first"),
                           F.greatest(F.lit(0), budget - F.when(F.col("_lead.role") == "system", F.col("_lead._cost")).otherwise(0)).alias("_room")), "leads")
    marked = (rows.join(lead, F.col("conv_id").eqNullSafe(F.col("_c")))
              .withColumn("_system", (F.col("role") == "system") & (F.col("_rid") == F.col("_first"))).drop("_c", "_first")
              .withColumn("_weight", F.when(F.col("_system"), 0).otherwise(F.col("_cost")))
              .withColumn("_past", F.least(F.lit(history), F.floor(F.col("_room") / 4)))
              .withColumn("_stride", F.greatest(F.lit(1), F.floor((F.col("_room") - F.col("_past")) / 2))))
    placed = prefix_sums(marked, ["conv_id"], ["turn", "_rid"], "_weight", "_start", "placed")
    # even numbers: the turns that start in a span; odd ones: a span's turn that is longer than the stride
    alone = F.col("_weight") > F.col("_stride")
    placed = written(placed.withColumn("window", 2 * F.floor(F.col("_start") / F.col("_stride")) + alone.cast("long"))
                     .withColumn("_past", F.when(alone, F.least("_past", F.col("_room") - F.col("_weight"))).otherwise(F.col("_past"))).drop("_room", "_stride"), "spans")
    fields = ["_kind", "_start", "turn", "_rid", "role", "text", "_cost"]
    new = placed.withColumn("_kind", F.when(F.col("_system"), 0).otherwise(2))
    windows = (placed.groupBy("conv_id", "window").agg(F.min("_start").alias("_from"), F.max("_system").alias("_has"), F.min("_past").alias("_reach"))
               .withColumnsRenamed({"conv_id": "_c", "window": "_w"}))
    system = placed.where("_system").select("conv_id", "_start", "turn", "_rid", "role", "text", "_cost", F.lit(0).alias("_kind"))
    kept = (windows.where("not _has").join(system, F.col("_c").eqNullSafe(F.col("conv_id"))).select("conv_id", F.col("_w").alias("window"), *fields))
    # a turn can be history of the windows up to one span on
    past = (placed.where((~F.col("_system")) & (F.col("window") % 2 == 0)).drop("_system", "_past")
            .withColumn("_to", F.explode(F.array(*[F.col("window") + k for k in (1, 2, 3)]))))
    past = (past.join(windows, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_to") == F.col("_w")))
            .where((F.col("_start") < F.col("_from")) & (F.col("_start") >= F.col("_from") - F.col("_reach")))
            .select("conv_id", F.col("_to").alias("window"), F.lit(1).alias("_kind"), *fields[1:]))
    turns = (new.select("conv_id", "window", *fields, F.lit(True).alias("_new")).unionByName(kept.withColumn("_new", F.lit(False)))
             .unionByName(past.withColumn("_new", F.lit(False))))
    head = _head(F.col("role"))
    body = _escaped(F.col("text"))
    turns = turns.select("conv_id", "window", F.struct("_kind", "_start", "turn", "_rid", head.alias("head"), body.alias("body"),
                                                       (F.col("_new") & (F.col("role") == "assistant")).alias("target"), "_new", "_cost").alias("t"))
    whole = turns.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sum("t._cost").alias("tokens"))
    lengths = F.transform("ts", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END))
    starts = F.transform("ts", lambda t, i: F.aggregate(F.slice("_lengths", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(t["head"]))
    spans = F.transform(F.filter(F.arrays_zip(F.col("ts").alias("t"), F.col("_starts").alias("s")), lambda x: x["t"]["target"]),
                        lambda x: F.struct(x["s"].alias("start"), F.length(x["t"]["body"]).alias("length")))
    return (whole.withColumn("_lengths", lengths).withColumn("_starts", starts)
            .select("conv_id", "window", F.concat_ws("", F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"),
                    F.size(F.filter("ts", lambda t: ~t["_new"])).alias("context"), spans.alias("loss"), "tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows``."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows = (windows.select(F.col("conv_id").cast("long").alias("conv_id"), "window", "formatted", "context", "loss")
            .repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "window"))

    def run(batches):
        state, out = None, []

        def close():
            if state:
                out.append((state["id"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["windows"]))

        def told():
            got, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], kinds[i]) for i in range(7)], names)

        for b in batches:
            for conv, formatted, context, loss in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "context", "loss"))):
                if state is None or state["id"] != conv:
                    close()
                    state = {"id": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "windows": 0}
                for role, text in parse(formatted)[context:] if context else parse(formatted):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"]:span["start"] + span["length"]])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["size"] += len(formatted)
                state["windows"] += 1
            yield told()
        close()
        yield told()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
