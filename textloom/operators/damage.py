"""Signs that stand for letters, inferred from a corpus's own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values: letters that one sign may stand for, share and number of a completion, share and words of a sign
MOST_LETTERS, LEAST_SHARE, LEAST_SEEN, SIGN_SHARE, SIGN_WORDS = 2, 0.70, 2, 0.80, 2
#: a word with one sign at its begin or inside: what stands before, the sign, what stands after
WELDED = r"^([a-z]*)([^\p{L}\p{N}\s'’.,;:!?()\[\]\"“”‘«»…/_–—-])([a-z]+)$"


def welded(tokens: DataFrame, token: str, n: str | None = None) -> DataFrame:
    """(token, prefix, sign, suffix, n): distinct tokens of three letters or more with one sign among them, and how often they occur.

    n: the column with how often a row's token occurs, where the rows are counted already.
    """
    low = F.lower(F.col(token))
    rows = tokens.select(low.alias("token"), (F.col(n) if n else F.lit(1)).alias("n")).filter(F.col("token").rlike(WELDED)).groupBy("token").agg(F.sum("n").alias("n"))
    part = lambda k: F.regexp_extract("token", WELDED, k)
    return rows.select("token", part(1).alias("prefix"), part(2).alias("sign"), part(3).alias("suffix"), "n").filter(F.length("prefix") + F.length("suffix") >= 3)


def gapped(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prefix, suffix, fill, n): words with one gap of up to MOST_LETTERS letters, for the (prefix, suffix) wanted.

    A word of n letters has about 2 n gaps. Only words that share the length and the outer letters of something wanted
    are gapped, so the index grows with what is damaged, not with the vocabulary.
    """
    ends = lambda p, s: F.concat_ws("|", F.substring(p, 1, 1), F.right(s, F.lit(1)))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(MOST_LETTERS)))
    shape = wanted.select(F.when(F.col("prefix") != "", ends("prefix", "suffix")).otherwise(F.concat(F.lit("|"), F.right("suffix", F.lit(1)))).alias("shape"), (F.length("prefix") + F.length("suffix")).alias("kept")).distinct()
    shape = shape.withColumn("gap", sizes).select("shape", "gap", (F.col("kept") + F.col("gap")).alias("length"))
    rows = words.withColumn("length", F.length("word")).withColumn("shape", F.explode(F.array(ends("word", "word"), F.concat(F.lit("|"), F.right("word", F.lit(1))))))
    rows = rows.join(shape, ["shape", "length"])
    at = F.explode(F.when(F.col("shape").startswith("|"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("length") - F.col("gap")))))
    rows = rows.withColumn("at", at)
    return rows.select(F.left("word", F.col("at")).alias("prefix"), F.substring("word", F.col("at") + F.col("gap") + 1, F.col("length")).alias("suffix"), F.substring("word", F.col("at") + 1, F.col("gap")).alias("fill"), "n")


def completions(words: DataFrame, damaged: DataFrame) -> DataFrame:
    """damaged (token, prefix, sign, suffix, n) with the `fill` that the corpus's words (word, n) put in the sign's place.

    A fill needs LEAST_SHARE of the weight of all and LEAST_SEEN occurrences; of equal ones the first by letters counts.
    """
    wanted = damaged.select("prefix", "suffix").distinct()
    index = gapped(words, wanted).join(wanted, ["prefix", "suffix"], "left_semi").groupBy("prefix", "suffix", "fill").agg(F.sum("n").alias("n"))
    best = index.groupBy("prefix", "suffix").agg(F.sum("n").alias("total"), F.min_by(F.struct("fill", "n"), F.struct(-F.col("n"), "fill")).alias("best"))
    sure = best.filter((F.col("best.n") >= LEAST_SEEN) & (F.col("best.n") >= LEAST_SHARE * F.col("total"))).select("prefix", "suffix", F.col("best.fill").alias("fill"))
    return damaged.join(sure, ["prefix", "suffix"])


def substitutions(words: DataFrame, damaged: DataFrame) -> DataFrame:
    """(sign, fill, n, total, words, sure): what most tokens of each sign say that it stands for, of how many, by how many words.

    sure: SIGN_SHARE of the tokens agree, and SIGN_WORDS words or more speak.
    """
    # a word-initial sign whose rest is a word is a mark that stands before it
    known = words.select(F.col("word").alias("suffix")).distinct().withColumn("prefix", F.lit(""))
    found = completions(words, damaged.join(known, ["prefix", "suffix"], "left_anti"))
    each = found.groupBy("sign", "fill").agg(F.sum("n").alias("n"))
    signs = found.groupBy("sign").agg(F.sum("n").alias("total"), F.count_distinct("token").alias("words"))
    best = each.groupBy("sign").agg(F.min_by(F.struct("fill", "n"), F.struct(-F.col("n"), "fill")).alias("best"))
    sure = (F.col("best.n") >= SIGN_SHARE * F.col("total")) & (F.col("words") >= SIGN_WORDS)
    return best.join(signs, "sign").select("sign", "best.fill", "best.n", "total", "words", sure.alias("sure"))
