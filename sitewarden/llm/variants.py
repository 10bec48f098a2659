"""Spelling variants of words by an index of grams of variable length.

The dictionary of grams is a tree: a gram of a marked word ("<word>") is lengthened by its next letter as long as more
than `frequent` places of words hold it, up to `longest_gram` letters. So each place of a word has one gram, the shortest
rare one, and the gram depends on its own letters alone: an edit changes the grams that cover its place and no others.
How many grams one edit can affect bounds what a near word must still share. As grams are intervals, all of a set can be
affected together only if every two of them meet; so the two rarest grams of a word that do not meet are enough: the lists
of both are merged, and every near word is in one of them. A list holds the words of one length with the gram at one
place. What the lists give is verified.

Words shorter than a long gram can have no two rare grams apart. Where a list could be longer than `longest_list`, the
word is looked up by its forms without one letter instead, among the words of that kind, which is exact too; a pair with
one word of the other kind is found by that word's lists.

Only places up to `PLACES` of a word are looked at, as two grams apart are found there already.

Texts that are null or empty have no words. A null id counts as the empty text. Repeated rows count each. Ties of the
most frequent near word go to the first in code-point order. An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.tables import run_folder, saved

LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
FREQUENT, LONGEST_LIST, PLACES = 100, 1000, 64
#: The test corpus gets typing errors: one letter goes where the checksum of id and word is a multiple of this.
ERROR_EVERY = 199
LETTERS = "a-zÀ-ÿ"
#: A gram that stands at one of this many places of words or more has a proven small number of rivals, and is broadcast.
HOT_SHARE = 1000


def lowered(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_errors(run: Column, key: Column, every: int = ERROR_EVERY) -> Column:
    """The run without one letter where its checksum says so."""
    check = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (check % F.length(run)).cast("int")
    return F.when(check % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = ERROR_EVERY,
) -> DataFrame:
    """(word, n) of the words of all texts; counted before the shuffle, so a very common word is a few rows there."""
    runs = F.regexp_extract_all(lowered(F.col(text)), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    words = rows.select(with_errors(F.col("run"), F.col("key"), every).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def grams_of(words: DataFrame, longest_gram: int) -> DataFrame:
    """(id, place, gram): all grams of 2 to `longest_gram` letters of marked words, at the places that are needed."""
    # One place more than the lists are asked for: a letter put in before moves a gram by one.
    marked = F.concat(F.lit("<"), F.substring("word", 1, PLACES + longest_gram), F.when(F.length("word") <= PLACES + longest_gram, F.lit(">")).otherwise(F.lit("")))
    every = [
        F.transform(F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)), lambda g, at: F.struct(at.alias("place"), g.alias("gram")))
        for q in range(2, longest_gram + 1)
    ]
    return words.select("id", F.inline(F.concat(*every))).where(F.col("place") <= PLACES + 1)


def with_counts(grams: DataFrame) -> DataFrame:
    """`grams` with the number of places that hold the gram. Very common grams are at most HOT_SHARE rows, by arithmetic,
    and come by broadcast; the others are joined, none of them with a large share of the rows."""
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    total = grams.count()
    hot = F.broadcast(counts.where(F.col("n") * HOT_SHARE >= total))
    both = grams.join(hot, "gram", "left")
    rest = both.where("n IS NULL").drop("n").join(counts.where(F.col("n") * HOT_SHARE < total), "gram")
    return both.where("n IS NOT NULL").unionByName(rest)


def decompose(words: DataFrame, frequent: int, longest_gram: int) -> DataFrame:
    """(id, grams): per place of a word the shortest gram that is not frequent, or the longest there is."""
    counted = with_counts(grams_of(words, longest_gram)).repartition("id")
    size = F.length("gram")
    order = F.when(F.col("n") <= frequent, size).otherwise(longest_gram * 2 - size)
    best = counted.groupBy("id", "place").agg(F.min(F.struct(order.alias("order"), "gram", "n")).alias("best"))
    gram = F.struct("place", F.col("best.gram").alias("gram"), F.col("best.n").alias("n"))
    return best.groupBy("id").agg(F.sort_array(F.collect_list(gram)).alias("grams"))


def rarest_apart(grams: Column) -> Column:
    """Two grams that do not meet, so that no single edit affects both: those with the shortest lists."""
    first = F.filter(grams, lambda g: g.place < PLACES)

    def pair(g: Column) -> Column:
        behind = F.filter(first, lambda h: h.place >= g.place + F.length(g.gram))
        other = F.array_min(F.transform(behind, lambda h: F.struct(h.n.alias("n"), h.place.alias("place"), h.gram.alias("gram"))))
        return F.struct(F.greatest(g.n, other.n).alias("longest"), (g.n + other.n).alias("sum"), g.place.alias("place"), g.gram.alias("gram"), other.place.alias("place2"), other.gram.alias("gram2"))

    return F.array_min(F.filter(F.transform(first, pair), lambda p: p.place2.isNotNull()))


def near_pairs(words: DataFrame, folder: str, frequent: int = FREQUENT, longest_list: int = LONGEST_LIST, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(a, b), a < b: ids of all words (id, word) that differ by exactly one letter put in, left out or replaced.

    Words have at least `least_letters` letters; grams have at most as many, so that each word has two of them apart.
    """
    grams = decompose(words, frequent, least_letters)
    parts = words.select("id", "word", F.length("word").alias("letters")).join(grams, "id")
    parts = saved(parts.withColumn("two", rarest_apart(F.col("grams"))), f"{folder}/parts")
    crowded = (F.col("two.longest") > longest_list) & (F.col("letters") <= PLACES)
    lists = parts.select("letters", "id", "word", F.inline("grams")).drop("n")
    # Asked for: the same place in words as long, and in words a letter longer or shorter the places that one edit leads to.
    places = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]
    asked = F.array(*[
        F.struct((F.col("letters") + more).alias("letters"), (F.col(f"two.place{x}") + moved).alias("place"), F.col(f"two.gram{x}").alias("gram"))
        for x in ("", "2") for more, moved in places
    ])
    asked = parts.where(~crowded).select(F.col("id").alias("other"), F.col("word").alias("word2"), F.inline(asked))
    found = lists.join(asked, ["letters", "place", "gram"]).where("id <> other")
    # Words of the other kind meet where one letter is left out of one or both of them.
    without = F.transform(F.sequence(F.lit(1), F.col("letters")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.col("letters"))))
    forms = parts.where(crowded).select("id", "word", F.explode(F.array_distinct(F.concat(F.array("word"), without))).alias("form"))
    both = forms.join(forms.select("form", F.col("id").alias("other"), F.col("word").alias("word2")), "form").where("id < other")
    columns = ["id", "word", "other", "word2"]
    pairs = found.select(*columns).unionByName(both.select(*columns)).where(F.levenshtein("word", "word2", 1) == 1)
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(id, root) from (id, form): forms are followed to the last by doubling, in about the logarithm of the longest chain."""
    far, n = saved(forms.select("id", F.col("form").alias("root")), f"{folder}/roots-0"), 0
    while True:
        n += 1
        step = far.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = far.join(step, "root")
        if longer.isEmpty():
            return far
        far = saved(far.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")), f"{folder}/roots-{n}")


def variants(counts: DataFrame, factor: int = FORM_FACTOR, frequent: int = FREQUENT, longest_list: int = LONGEST_LIST, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of (word, n); words are distinct."""
    folder = run_folder(counts.sparkSession)
    words = saved(counts.select("word", "n", F.monotonically_increasing_id().alias("id")), f"{folder}/words")
    pairs = saved(near_pairs(words.select("id", "word"), folder, frequent, longest_list, least_letters), f"{folder}/pairs")
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = links.join(words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    best = named.groupBy(F.col("a").alias("id")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("first"), "near", "b")).alias("best")
    )
    rows = words.join(best, "id", "left")
    rows = saved(rows.withColumn("best", F.when(-F.col("best.first") >= factor * F.col("n"), F.col("best"))), f"{folder}/rows")
    ends = roots(rows.where("best IS NOT NULL").select("id", F.col("best.b").alias("form")), folder)
    ends = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").drop("root")
    return rows.join(ends, "id", "left").select(
        "word",
        F.col("best.near").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        (-F.col("best.first")).alias("form_n"),
    )
