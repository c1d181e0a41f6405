"""Token-set similarity joins by filter and verification: only texts that can reach the ratio are compared.

With a ratio r, texts a and b of the distinct words A and B and n(.) the length of words joined by blanks, token_set()
reaches r in one of two ways only.

* Common words are most of one side: n(A and B) >= r / (2 - r) * n(A), or of n(B); all of a side is a case of it. The
  words of that side that are not common are so few that its rarest words, up to one more than may be missing, hold a
  common one. So one side is entered by those and the other looks up all its words.
* The words joined in order are alike: insertions and deletions are at most (1 - r) of both lengths, and so at most
  2 (1 - r) / r * n(a). Each touches one piece of a word at most, so of one piece more than that some stand unchanged
  inside a word of the other text, whose length is within r / (2 - r). One side is entered by its longest pieces, of the
  greatest length that gives enough, and by its class of length, and the other looks up every part of its words.

What meets is compared exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import lcs_length
from ..plans.written import discard, materialise

LONGEST_PIECE = 16


@lru_cache(64)  # pairs of one text follow each other
def _set_of(text: str) -> tuple[frozenset[str], int]:
    """The words of a text and their length in all."""
    words = frozenset(text.split(" ")) - {""}
    return words, sum(map(len, words))


def near_pair(a: str, b: str, ratio: float) -> bool:
    """Whether token_set() of two normalised texts reaches the ratio; bounds only spare alignments that cannot."""
    (x, nx), (y, ny) = _set_of(a), _set_of(b)
    if not x or not y:
        return False
    both = x & y
    if both and len(both) == min(len(x), len(y)):
        return True
    length = lambda letters, words: letters + max(words - 1, 0)
    shared = sum(map(len, both))
    common, na, nb = length(shared, len(both)), length(nx - shared, len(x) - len(both)), length(ny - shared, len(y) - len(both))
    if both and 2 * common / (2 * common + 1 + min(na, nb)) >= ratio:
        return True
    head = common + 1 if both else 0
    total = 2 * head + na + nb
    most = min(na, nb)
    if 2 * (head + most) / total < ratio:
        return False
    one, two = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    most = sum((Counter(one) & Counter(two)).values())
    return 2 * (head + most) / total >= ratio and 2 * (head + lcs_length(one, two)) / total >= ratio


def _near(ratio: float):
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([near_pair(x, y, ratio) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    near.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}  # the names are strings here
    return F.arrow_udf(near, "boolean")


def _words(text: Column | str) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, " "), ""))


def _length(words: Column | str) -> Column:
    """Length of words joined by blanks."""
    return F.length(F.array_join(words, " ")).cast("long")


def _pieces(words: Column, need: Column) -> Column:
    """The `need` longest pieces that words are cut into, as long as they can be and still be so many; the empty piece,
    which all texts share, if there are fewer characters (with a ratio of 0.8 or less, in texts of short words)."""
    cuts = lambda w, k: F.greatest(F.lit(1), F.floor(F.length(w) / k)).cast("int")
    enough = F.filter(F.sequence(F.lit(1), F.lit(LONGEST_PIECE)), lambda k: F.aggregate(words, F.lit(0), lambda n, w: n + cuts(w, k)) >= need)

    def cut(w: Column, k: Column) -> Column:
        n = cuts(w, k)
        edge = lambda i: F.floor(F.length(w) * i / n).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(w, edge(i) + 1, edge(i + 1) - edge(i)))

    def longest(every: Column) -> Column:
        ordered = F.array_sort(F.transform(every, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
        return F.when(F.size(every) < need, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(F.slice(ordered, F.lit(1), need), lambda x: x["p"])))

    # a lambda binds what it is given: the length and the pieces are found once a text, not anew for each word and use
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    return once(F.coalesce(F.array_max(enough), F.lit(1)), lambda k: once(F.flatten(F.transform(words, lambda w: cut(w, k))), longest))


def _parts(words: Column) -> Column:
    """Every run of up to 2 LONGEST_PIECE - 1 characters inside a word, and the empty one."""
    ends = lambda w, i: F.sequence(F.lit(1), F.least(F.lit(2 * LONGEST_PIECE - 1), F.length(w) - i + 1))
    of = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(ends(w, i), lambda n: F.substr(w, i, n))))
    return F.array_append(F.array_distinct(F.flatten(F.transform(words, of))), F.lit(""))


def _rarest(tokens: DataFrame, key: str, size: str, missing: float) -> DataFrame:
    """Of (key, size, word, n), n the texts with the word, the rarest words of each key: as many as may be missing and one."""
    rare = Window.partitionBy(key).orderBy("n", F.desc(F.length("word")), "word").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("word") + 1).over(rare), F.lit(0))
    return tokens.withColumn("_before", before).where(F.col("_before") <= missing * F.col(size) + 1e-9).drop("_before")


def candidates(texts: DataFrame, block: DataFrame, ratio: float) -> DataFrame:
    """(key, b_id), repeats possible: all pairs of texts (key, words, size) and block (b_id, b_words, b_size) that can
    reach the ratio, and others. Block is a written table of words of the other side, and is read several times."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be over 0 and at most 1")
    most = ratio / (2 - ratio)
    least, longest = block.agg(F.min("b_size"), F.max("b_size")).first()
    if longest is None:
        return texts.select("key", F.lit(None).cast("long").alias("b_id")).limit(0)
    b_words = block.select("b_id", "b_size", F.explode("b_words").alias("word"))
    vocabulary = b_words.select("word").distinct()
    words = texts.select("key", "size", F.explode("words").alias("word"))
    # how many texts hold each word of the block: counted on the way into the shuffle
    counts = materialise(vocabulary.join(words.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    # written, so that its size is known before all words of the texts are shuffled to it
    entered = materialise(_rarest(b_words.join(counts, "word"), "b_id", "b_size", 1 - most))
    held = words.join(entered.select("word", "b_id"), "word").select("key", "b_id")
    # texts that are mostly words of one of the block: those of no block word count as missing
    short = texts.where(F.col("size") * most <= longest + 1e-9).select("key", "size", F.explode("words").alias("word")).join(counts, "word")
    known = short.groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("n", (-F.length("word")).alias("l"), "word"))).alias("own"), F.sum(F.length("word") + 1).alias("in"))
    missing = F.col("size") + 1 - F.col("in")
    taken = F.aggregate(
        "own", F.struct(missing.cast("long").alias("n"), F.array().cast("array<string>").alias("w")),
        lambda s, x: F.struct((s["n"] + 1 - x["l"]).cast("long").alias("n"), F.when(s["n"] <= (1 - most) * F.col("size") + 1e-9, F.concat(s["w"], F.array(x["word"]))).otherwise(s["w"]).alias("w")),
    )
    holding = known.select("key", F.explode(taken["w"]).alias("word")).join(b_words, "word").select("key", "b_id")
    # alike as strings
    band = lambda n: F.floor(F.ln(n.cast("double")) / math.log(1 / most) + 1e-9) if most < 1 else n
    need = (F.floor(2 * (1 - ratio) / ratio * F.col("size") + 1e-9) + 1).cast("int")
    fitting = texts.where((F.col("size") >= most * least - 1e-9) & (F.col("size") * most <= longest + 1e-9))
    pieces = fitting.select("key", "size", band(F.col("size")).alias("band"), F.explode(_pieces(F.col("words"), need)).alias("part"))
    b_band = band(F.col("b_size"))
    parts = block.select("b_id", "b_size", F.explode(_parts(F.col("b_words"))).alias("part"), F.array(b_band - 1, b_band, b_band + 1).alias("bands")).withColumn("band", F.explode("bands"))
    alike = pieces.join(parts, ["part", "band"]).where(F.least("size", "b_size") >= most * F.greatest("size", "b_size") - 1e-9).select("key", "b_id")
    return held.union(holding).union(alike)


def near_any(texts: DataFrame, block: DataFrame, ratio: float) -> DataFrame:
    """The keys of texts (key, text) within `ratio` of a text of block (text), both normalised and distinct, by token sets.

    Null texts and texts without a word are near nothing. Neither side is collected; Spark broadcasts the smaller one
    where its size allows, and shuffles both else.
    """
    sized = lambda df: df.where(F.size("words") > 0).withColumn("size", _length("words"))
    b = materialise(sized(block.select(F.xxhash64("text").alias("b_id"), F.col("text").alias("b_text"), _words("text").alias("words"))).withColumnsRenamed({"words": "b_words", "size": "b_size"}))
    # read several times by each way to be alike: words are cut once, and adaptive plans can't merge these readings into few tasks
    own = materialise(sized(texts.select("key", "text", _words("text").alias("words"))))
    pairs = materialise(candidates(own.drop("text"), b, ratio).distinct())
    met = pairs.join(b.select("b_id", "b_text"), "b_id").join(own.select("key", "text"), "key")
    found = materialise(met.where(_near(ratio)("text", "b_text")).select("key").distinct())
    discard(b, own, pairs)
    return found
