"""Events of streamed model turns, as a batch: (session_id, run, seq, mode, node, text, tool_calls)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.content import tool_label

from .scan import Running, running


def routed(events: DataFrame) -> DataFrame:
    """Tokens of the model node, all updates, and ends; empty tokens go, those of white space stay."""
    token = "mode = 'messages' and node = 'model' and text <> ''"
    return events.where(f"({token}) or mode in ('updates', 'end', 'interrupt')")


def labels(events: DataFrame) -> DataFrame:
    """A row for each tool call of the model's updates, with its label. A task call without arguments ends its update's
    list, as do all after it."""
    calls = events.where("mode = 'updates' and node = 'model'").select("session_id", "run", "seq", F.posexplode("tool_calls").alias("pos", "call"), "tool_calls")
    broken = F.expr("transform(tool_calls, c -> c.name = 'task' and c.args is null)")
    first_broken = F.array_position(broken, True)
    return calls.where((first_broken == 0) | (F.col("pos") + 1 < first_broken)).select("session_id", "run", "seq", "pos", tool_label(F.col("call")).alias("label"))


def segments(events: DataFrame) -> DataFrame:
    """Text between tool calls, one row a segment, without empty ones: (session_id, run, segment, text). A segment's number
    is the number of boundaries before it in its run; at one seq boundaries come first, and tokens are put together in the
    order of their texts. A run of any length is dealt over time slices; only a segment's text is put together in one task."""
    # an update cuts the text only if the model calls a tool in it; an end or interrupt always does
    cuts = F.expr("coalesce(cast((mode = 'updates' and node = 'model' and size(tool_calls) > 0) or mode in ('end', 'interrupt') as bigint), 0L)")
    rows = routed(events).select("session_id", "run", "seq", "mode", "text", cuts.alias("cut")).where("cut = 1 or mode = 'messages'")
    numbered = running(rows.withColumn("after", 1 - F.col("cut")), ["session_id", "run"], ["seq", "after", "text"], {"segment": Running("sum", "cut")})
    return numbered.where("mode = 'messages'").groupBy("session_id", "run", "segment").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY seq, text)").alias("text"))
