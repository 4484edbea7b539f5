"""Messages of conversation threads: (thread_id, seq, type, content VARIANT). A thread never has to fit one task but for
windows over its own rows, which are bounded by what one conversation holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.content import extract_text, speaker, strip

from .scan import Running, running

#: Message types of the roles in a conversations table.
ROLES = {"user": "human", "assistant": "ai"}


def messages_of(conversations: DataFrame) -> DataFrame:
    """A conversations table (conv_id, turn, role, text) as messages."""
    kind = F.col("role")
    for role, name in ROLES.items():
        kind = F.when(F.col("role") == role, name).otherwise(kind)
    return conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), kind.alias("type"), F.col("text").cast("variant").alias("content"))


def replay(messages: DataFrame) -> DataFrame:
    """What a resumed session shows: human and ai messages with text that is not blank, labelled, and the count of all
    messages of the thread beside them."""
    counted = messages.withColumn("n_messages", F.count("*").over(Window.partitionBy("thread_id")))
    shown = counted.select("thread_id", "seq", speaker(F.col("type")).alias("label"), extract_text(F.col("content")).alias("text"), "n_messages")
    return shown.where(F.col("label").isNotNull() & (strip(F.col("text")) != ""))


def history_counts(messages: DataFrame) -> DataFrame:
    """All messages and shown messages of each thread: one shuffle of partial counts."""
    shown = speaker(F.col("type")).isNotNull() & (strip(extract_text(F.col("content"))) != "")
    return messages.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.count_if(shown).alias("n_shown"))


def transcript(messages: DataFrame) -> DataFrame:
    """The text of each thread, its messages put together by seq, then by text."""
    return messages.select("thread_id", "seq", extract_text(F.col("content")).alias("text")).groupBy("thread_id").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY seq, text)").alias("transcript"))


def transcript_pages(messages: DataFrame, chars: int) -> DataFrame:
    """(thread_id, page, text): the transcript of each thread in pages, each with the messages that begin in its stretch of
    so many characters. Threads may be of any length: how far a message is from the start is a scan over time slices.
    Messages of one seq come in the order of their texts."""
    rows = messages.select("thread_id", "seq", extract_text(F.col("content")).alias("text")).withColumn("size", F.length("text").cast("long"))
    found = running(rows, ["thread_id"], ["seq", "text"], {"end": Running("sum", "size")})
    paged = found.withColumn("page", F.floor((F.col("end") - F.col("size")) / F.lit(chars)))
    return paged.groupBy("thread_id", "page").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY seq, text)").alias("text"))


def latest_state(messages: DataFrame) -> DataFrame:
    """The last message of each thread, by partial aggregates rather than a window; of several at the last seq the greatest
    by type, then text."""
    last = F.max(F.struct("seq", "type", extract_text(F.col("content")).alias("text")))
    return messages.groupBy("thread_id").agg(last.alias("m")).select("thread_id", "m.seq", "m.type", "m.text")


def thread(messages: DataFrame, thread_id) -> DataFrame:
    """One thread in order; the filter reaches the scan."""
    return messages.where(F.col("thread_id") == thread_id).orderBy("seq")


def shown_of(asked: DataFrame, messages: DataFrame) -> DataFrame:
    """(thread_id, found, n_shown) of the threads asked for: an absent thread has an empty history and shows nothing."""
    counts = history_counts(messages).select("thread_id", "n_shown", F.lit(True).alias("found"))
    out = asked.select("thread_id").join(counts, "thread_id", "left")
    return out.select("thread_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("n_shown", F.lit(0)).cast("long").alias("n_shown"))


def unanswered(messages: DataFrame) -> DataFrame:
    """Human messages with no later ai message in their thread: an aggregate, not a range join."""
    last = messages.where("type = 'ai'").groupBy("thread_id").agg(F.max("seq").alias("last_reply"))
    human = messages.where("type = 'human'").select("thread_id", "seq")
    return human.join(last, "thread_id", "left").where("last_reply is null or seq > last_reply").select("thread_id", "seq")


def first_turns(messages: DataFrame, most: int = 18) -> DataFrame:
    """The first human turns of each thread, at most so many (a cap that simulated users have)."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    return messages.where("type = 'human'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("thread_id", "seq", "n")


def first_of_thread(messages: DataFrame) -> DataFrame:
    """Lookup with insert if absent: a thread's first message makes its entry, later ones find it."""
    return messages.groupBy("thread_id").agg(F.min("seq").alias("seq"))
