"""Words that are spelled alike: edit distance with transpositions as a Column, candidates by shared remains of words.

Two words of at most k edits have a remain in common after k letters or fewer are taken out of each (Garbe's symmetric deletes;
swapped neighbours lose one letter each). So candidates are an equi-join of remains, and no word is compared with all others.
Long words have too many remains; they are cut into five pieces of which two edits leave one as it is, at most two places
aside, and are joined by those pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shortest words for one and for two edits.
ONE_EDIT, TWO_EDITS = 5, 9
MOST_EDITS = 2
#: Words of more letters are joined by pieces; two letters over it by remains as well, so that every pair meets in one of the ways.
LONG = 24
PIECES = 2 * MOST_EDITS + 1


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours that make ``b`` of ``a``, no letter edited twice.

    That is the optimal string alignment; it keeps three rows of the table. Null if either is null.
    """
    x, y = F.split(a, ""), F.split(b, "")  # an empty text splits into one empty letter
    n, m = F.length(a), F.length(b)

    def row(state: Column, i: Column) -> Column:
        prev2, prev = state["prev2"], state["prev"]

        def cell(cur: Column, j: Column) -> Column:
            same = F.get(x, i - 1) == F.get(y, j - 1)
            least = F.least(F.get(prev, j) + 1, F.get(cur, j - 1) + 1, F.get(prev, j - 1) + F.when(same, 0).otherwise(1))
            swapped = (i > 1) & (j > 1) & (F.get(x, i - 1) == F.get(y, j - 2)) & (F.get(x, i - 2) == F.get(y, j - 1))
            return F.array_append(cur, F.when(swapped, F.least(least, F.get(prev2, j - 2) + 1)).otherwise(least))

        filled = F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell)
        return F.struct(prev.alias("prev2"), filled.alias("prev"))

    first = F.sequence(F.lit(0), m)
    made = F.aggregate(F.sequence(F.lit(1), n), F.struct(first.alias("prev2"), first.alias("prev")), row)
    return F.when((n == 0) | (m == 0), n + m).otherwise(F.get(made["prev"], m))


def edits_allowed(a: Column, b: Column) -> Column:
    """How many edits may be between two words: none below five letters, two from nine on, by the shorter one."""
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter >= TWO_EDITS, 2).when(shorter >= ONE_EDIT, 1).otherwise(0)


def _without_one(words: Column) -> Column:
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(w == "", F.array(w)).otherwise(cut(w)))))


def _keys(words: DataFrame, side: str) -> DataFrame:
    """word and key: texts that it has in common with each word that may be spelled alike."""
    word, length = F.col("word"), F.length("word")
    one = F.concat(F.array(word), _without_one(F.array(word)))
    # words of nine letters take part as neighbours of shorter ones, too: with one edit
    remains = F.when(length >= TWO_EDITS, F.array_distinct(F.concat(one, _without_one(_without_one(F.array(word)))))).otherwise(one)
    short = words.where((length >= ONE_EDIT) & (length <= LONG + MOST_EDITS)).select("word", F.explode(F.transform(remains, lambda r: F.concat(F.lit("-"), r))).alias("key"))
    piece = lambda total, i, aside: F.substring(word, F.floor(total * i / PIECES).cast("int") + aside + 1, (F.floor(total * (i + 1) / PIECES) - F.floor(total * i / PIECES)).cast("int"))
    tagged = lambda total, i, aside: F.concat(total.cast("string"), F.lit(":"), i.cast("string"), F.lit(":"), piece(total, i, aside))
    places = F.sequence(F.lit(0), F.lit(PIECES - 1))
    if side == "a":
        found = F.transform(places, lambda i: tagged(length, i, F.lit(0)))
    else:
        near = F.sequence(F.lit(-MOST_EDITS), F.lit(MOST_EDITS))
        aside = lambda total, i: F.transform(F.filter(near, lambda s: F.floor(total * i / PIECES).cast("int") + s >= 0), lambda s: tagged(total, i, s))
        found = F.flatten(F.flatten(F.transform(F.transform(near, lambda d: length + d), lambda total: F.transform(places, lambda i: aside(total, i)))))
    long = words.where(length > LONG).select("word", F.explode(F.array_distinct(found)).alias("key"))
    return short.unionByName(long)


def spelled_alike(words: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """word, other and distance of every pair of different words within the edits that their lengths allow.

    ``words`` and ``others`` have a column ``word``, compared as it is; repeated and null words count once and not at all.
    Without ``others`` pairs are taken inside ``words``, the lesser word first.
    """
    own = words.select("word").where("word is not null").distinct()
    far = own if others is None else others.select("word").where("word is not null").distinct()
    left, right = _keys(own, "a"), _keys(far, "b").select(F.col("word").alias("other"), "key")
    met = left.join(right, "key").where(F.col("word") != F.col("other"))
    if others is None:  # pieces find a pair from either side
        met = met.select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other"))
    a, b = F.col("word"), F.col("other")
    near = met.where(F.abs(F.length(a) - F.length(b)) <= edits_allowed(a, b)).select("word", "other").distinct()
    return near.withColumn("distance", edit_distance(a, b)).where(F.col("distance") <= edits_allowed(a, b))


def phrases_alike(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """phrase and known phrase of as many words, each equal or spelled alike, and not all equal.

    ``phrases`` and ``known`` have a column ``phrase``, words between single spaces. Candidates share the place and pair of a word
    that differs.
    """
    def parts(rows: DataFrame, name: str) -> DataFrame:
        split = rows.select("phrase").where("phrase is not null").distinct().withColumn("parts", F.split("phrase", " "))
        return split.select(F.col("phrase").alias(name), F.size("parts").alias("n"), F.posexplode("parts").alias("place", f"{name}_word"))

    mine, theirs = parts(phrases, "phrase"), parts(known, "known")
    pairs = spelled_alike(mine.select(F.col("phrase_word").alias("word")), theirs.select(F.col("known_word").alias("word"))).select(F.col("word").alias("phrase_word"), F.col("other").alias("known_word"))
    met = mine.join(pairs, "phrase_word").join(theirs, ["n", "place", "known_word"]).select("phrase", "known").distinct()
    fits = lambda x, y: (x == y) | ((F.abs(F.length(x) - F.length(y)) <= edits_allowed(x, y)) & (edit_distance(x, y) <= edits_allowed(x, y)))
    return met.where(F.forall(F.zip_with(F.split("phrase", " "), F.split("known", " "), fits), lambda ok: ok))
