"""Spelling variants of words by a rare-first q-gram prefix filter (operator 13).

Two words are near if they differ by one inserted, deleted or replaced code point. One
such edit touches at most two bigrams of either word. So if the bigrams of all words are
put in one order, rarest first, two near words share a bigram among the first three of both,
at the same place, or one place on if the longer word got its code point before it.

Rare bigrams make small groups, but some words have only frequent ones. The edit lies on one side of the
shared bigram, so the other side of both words is equal, and of the edited side either the first half or
the rest behind it. Their texts belong to the join key too, which keeps groups small where
the three rarest bigrams are frequent. Keys are joined as hashes; what the join finds is verified exactly.
All of this is DataFrame code over the distinct words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstride.llm.common import durable

#: Bigrams of a word that are joined: one edit of one code point touches at most two.
PREFIX = 3
#: Parts into which a bigram's words are dealt where they meet its count.
SALTS = 16
#: Doublings of a chain: a form is at least this many times as frequent as its word, so no chain of longs has over 28 steps.
FACTOR, DOUBLINGS = 5, 5


def word_counts(runs: DataFrame, least_length: int = 6, least_count: int = 5, word_col: str = "word") -> DataFrame:
    """(word, n) of the words of at least so many code points that occur so often; null words do not count."""
    rows = runs.select(F.col(word_col).alias("word")).where(F.char_length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _prefixes(words: DataFrame) -> DataFrame:
    """(word, place, gram, left, right): the three rarest bigrams of each word, and the text on each side of them."""
    size = F.char_length("word")
    places = words.select("word", F.explode(F.sequence(F.lit(1), size - 1)).alias("place")).withColumn("gram", F.substring("word", F.col("place"), F.lit(2)))
    often = places.groupBy("gram").agg(F.count("*").alias("often"))
    # a frequent bigram's words meet its count in several parts
    often = often.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    counted = places.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(SALTS).cast("long"))).join(often, ["gram", "part"])
    ordered = counted.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "place"))).alias("grams"))  # a word's own bigrams
    first = ordered.select("word", F.explode(F.slice("grams", 1, PREFIX)).alias("g")).select("word", "g.place", "g.gram")
    return first.withColumn("left", F.substring("word", F.lit(1), F.col("place") - 1)).withColumn("right", F.substring("word", F.col("place") + 2, size))


def _keys(longer: int, same: str, edited: str) -> list[F.Column]:
    """Hashes that two words share if the text ``same`` beside a bigram is equal and the other side is edited.

    ``longer`` is what the other word has more code points than this one: -1, 0 or 1.
    The place is the longer word's, the halves those of the shorter word's edited side.
    """
    size, place = F.char_length("word") + max(longer, 0), F.col("place") + (1 if longer == 1 and edited == "left" else 0)
    m = F.char_length(edited)
    half = F.floor((m - (1 if longer == -1 else 0)) / 2).cast("int")
    rest = m + max(longer, 0) - half  # code points behind the half in the longer word, equal to as many in the shorter one
    start = F.substring(edited, F.lit(1), half)
    end = F.substring(edited, m - rest + 1, rest)
    common = [F.lit(abs(longer)), F.lit(same), "gram", F.col(same), place, size]
    return [F.xxhash64(*common, F.lit(k), text) for k, text in enumerate((start, end))]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near), both ways, of the words (distinct, of four code points or more, else they may miss) that differ by one code point."""
    grams = durable(_prefixes(words))
    sides = [("left", "right"), ("right", "left")]
    rows = lambda name, *longer: grams.select(F.col("word").alias(name), F.explode(F.array(*[k for d in longer for side in sides for k in _keys(d, *side)])).alias("key"))
    met = rows("a", 0, 1).join(rows("b", 0, -1), "key").where((F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b")))
    found = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()
    return found.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least
    ``FACTOR`` times the word's n, else null; ``root`` is where following forms ends, the
    word itself if it has none. Null words are left out; an empty table gives no rows.
    """
    words = durable(words.where(F.col("word").isNotNull()).select("word", "n"))
    near = near_pairs(words.select("word")).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    enough = -F.col("best.less") >= FACTOR * F.col("n")
    rows = durable(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = durable(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.where("moved").take(1):
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
