"""Sequential operators: rising chains, packing, diffs, cue clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.times import epoch
from textloom.operators import sequences as S

from .registry import Tables, query


def line_lengths(t: Tables):
    return t.documents.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x)).alias("lengths"))


@query()
def longest_rising_lines(t: Tables):
    chain = S.longest_rising(F.col("lengths"))
    return line_lengths(t).select("doc_id", F.size("lengths").alias("n"), chain.alias("chain"))


@query()
def paragraph_packing(t: Tables):
    pieces = t.documents.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("pieces"))
    return pieces.select("doc_id", S.packed(F.col("pieces"), 2000).alias("chunks")).select("doc_id", "chunks", (F.array_max("chunks") + 1).alias("n_chunks"))


@query()
def word_diff(t: Tables):
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("later"))
    both = c.join(nxt, ["conv_id", "turn"]).withColumn("changes", S.changes(F.col("text"), F.col("later")))
    return both.select("conv_id", "turn", F.size("changes").alias("n_changes"), F.aggregate("changes", F.lit(0), lambda a, x: a + x["len"]).alias("words_added"))


@query(r"""SELECT c.conv_id, c.turn, md5(array_to_string(regexp_extract_all(c.text, '[^ \t\n\r\x0b\f]+'), ' ')) AS earlier, len(regexp_extract_all(c.text, '[^ \t\n\r\x0b\f]+')) AS words FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 2""")
def hydrate_diff(t: Tables):
    """Earlier turns made again from the later one and the stored changes."""
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("later"))
    both = c.join(nxt, ["conv_id", "turn"]).withColumn("changes", S.changes(F.col("text"), F.col("later")))
    made = both.select("conv_id", "turn", S.hydrated(F.col("later"), F.col("changes")).alias("made"))
    return made.select("conv_id", "turn", F.md5(F.array_join("made", " ")).alias("earlier"), F.size("made").cast("long").alias("words"))


@query()
def overlapping_cues(t: Tables):
    cues = t.events.select("user_id", F.col("event_id").alias("id"), epoch("ts").alias("lo"), (epoch("ts") + F.col("value") * 60).alias("hi"))
    return S.kept_cues(cues, "user_id")
