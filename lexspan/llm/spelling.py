"""Grouping of spelling variants by a symmetric-delete join.

Every word emits itself and its single deletions as keys. Two words are near, one edit apart, in
two ways only: a key of one is the other word itself (a letter more or less), or both have the same key by
deleting at the same place (a letter replaced). So words are joined on shared keys: a word's deletions
with the word that they spell, and the words that share (key, place) with the best two of them and
their number. All pairs of a shared key are never listed, a key costs its words; and as keys are the
strings themselves, what meets is exactly one edit apart. Keys over ``LONG`` letters are named by two
residues of their letters' polynomial instead, at random points, so that a word of a million letters emits
numbers rather than a million strings of its length; what meets by name is verified letter by letter.

A word's form is its near word of the largest count, if that is large enough beside its own; the root
is where the forms of forms lead, found by doubling pointers until none moves. Counts at least
double with each form, so there are no circles.

``word_counts`` takes any documents: null and empty texts hold no words, repeated rows count again, other
columns are not read, an empty table gives an empty one. ``group_variants`` takes distinct words; ties of counts
go to the smaller word in code-point order.
"""

from __future__ import annotations

import secrets

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspan.llm._shared import arrow_map, forget, materialize

#: Letters of a key that stands for itself; longer ones are named.
LONG = 200
#: A Mersenne prime: names of long keys are residues.
PRIME = (1 << 61) - 1
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of words, as a pattern, after A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]+"


def without(word: Column, place: Column) -> Column:
    """The word less its letter at ``place``, from 0."""
    return F.concat(F.substring(word, F.lit(1), place.cast("int")), F.substring(word, place.cast("int") + 2, F.char_length(word)))


def runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, word) for each run of letters, A-Z lower-cased."""
    low = F.translate(F.col(text_col), CAPITALS, SMALL)
    return docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("word"))


def misspelt(words: DataFrame, every: int = 97) -> DataFrame:
    """``runs`` in which one of ``every`` kinds of (id, word) lacks a letter, by the checksum of both; a null id is empty."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "word").cast("binary"))
    hit = words.withColumn("lexspan_h", h)
    lacking = without(F.col("word"), F.col("lexspan_h") % F.char_length("word"))
    return hit.select("id", F.when(F.col("lexspan_h") % every == 0, lacking).otherwise(F.col("word")).alias("word"))


def word_counts(words: DataFrame, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): distinct words long and frequent enough; counts are added up before anything is shuffled."""
    return words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def short_keys(words: DataFrame) -> DataFrame:
    """(key, place, last, rank): the words themselves (place -1) and their single deletions, for keys of up to
    LONG letters. ``last`` marks the last of the places whose deletion gives the same key."""
    size = F.char_length("word")
    own = words.where(size <= LONG).select(F.col("word").alias("key"), F.lit(-1).alias("place"), F.lit(False).alias("last"), "rank")
    places = words.where(size <= LONG + 1).select("word", "rank", F.explode(F.sequence(F.lit(0), size - 1)).alias("place"))
    letter = lambda k: F.substring("word", F.col("place") + k, F.lit(1))
    cut = places.select(without(F.col("word"), F.col("place")).alias("key"), "place", (letter(1) != letter(2)).alias("last"), "rank")
    return own.unionByName(cut)


def long_keys(words: DataFrame) -> DataFrame:
    """As ``short_keys``, for keys over LONG letters, by name: length and residues at two random points."""
    points = [secrets.randbelow(PRIME - 1000) + 500 for _ in range(2)]

    def names(word: str) -> list[list[int]]:
        """For each point: the residue of the word, then of each deletion. A residue is the sum of letter
        times power; behind a deleted letter each power is one less."""
        found = []
        for x in points:
            upto, behind, power = [0], [0], 1
            for c in word:
                upto.append((upto[-1] + ord(c) * power) % PRIME)
                behind.append((behind[-1] + ord(c) * power) % PRIME)
                power = power * x % PRIME
            less = pow(x, PRIME - 2, PRIME)
            whole = upto[-1]
            found.append([whole, *((upto[i] + (whole - upto[i + 1]) * less) % PRIME for i in range(len(word)))])
        return found

    def run(batches):
        for batch in batches:
            for word, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(word)
                a, b = names(word)
                first, until = (0 if size > LONG else 1), (size + 1 if size > LONG + 1 else 1)
                for k in range(first, until, 10_000):
                    rows = range(k, min(k + 10_000, until))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": [f"{size - (r > 0)}#{a[r]:x}#{b[r]:x}" for r in rows],
                            "place": pa.array([r - 1 for r in rows], pa.int32()),
                            "last": [r > 0 and (r == size or word[r - 1] != word[r]) for r in rows],
                            "rank": [rank] * len(rows),
                        }
                    )

    return arrow_map(words.where(F.char_length("word") > LONG).select("word", "rank"), run, "key string, place int, last boolean, rank long")


def near(words: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are one edit away, and the least rank among them.

    ``words`` has (rank, word). One exchange of the keys serves both kinds of links. The keys of a word
    name its links once each: a deletion of the longer word spells the shorter one once, as only the last of the places that
    give the same key counts, and words of one length that are one edit apart differ at one place.
    """
    keys = short_keys(words).unionByName(long_keys(words))
    shared = Window.partitionBy("key", "place")
    first_two = shared.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = keys.repartition(F.col("key"))
    places = dealt.where("place >= 0").select(
        "key", "place", "last", "rank",
        F.count("*").over(shared).alias("members"), F.first("rank").over(first_two).alias("r1"), F.nth_value("rank", 2).over(first_two).alias("r2"),
    )
    spelt = keys.where("place < 0").select("key", F.col("rank").alias("shorter"))
    met = places.join(spelt, "key", "left").where("members > 1 or (last and shorter is not null)")
    met = verified(met.withColumn("other", F.when(F.col("r1") == F.col("rank"), F.col("r2")).otherwise(F.col("r1"))), words)
    replaced = met.where("members > 1").select("rank", (F.col("members") - 1).alias("links"), F.col("other").alias("best"))
    one = F.lit(1).cast("long").alias("links")
    longer = met.where("last and shorter is not null")
    both = replaced.unionByName(longer.select("rank", one, F.col("shorter").alias("best"))).unionByName(longer.select(F.col("shorter").alias("rank"), one, F.col("rank").alias("best")))
    return both.groupBy("rank").agg(F.sum("links").alias("n_near"), F.min("best").alias("best"))


def verified(met: DataFrame, words: DataFrame) -> DataFrame:
    """``met`` as written; where keys are names, what met is compared letter by letter, and a name that two
    strings share ends the job (its chance is below 1e-24; another run draws other names)."""
    met = materialize(met, "near-words")
    named = met.where(F.instr("key", "#") > 0)
    word = lambda at, name: words.select(F.col("rank").alias(at), F.col("word").alias(name))
    mine = named.join(word("rank", "mine"), "rank").withColumn("key_text", without(F.col("mine"), F.col("place"))).drop("mine")
    replaced = mine.where("members > 1").join(word("other", "theirs"), "other").where(F.col("key_text") != without(F.col("theirs"), F.col("place")))
    spelt = mine.where("last and shorter is not null").join(word("shorter", "theirs"), "shorter").where(F.col("key_text") != F.col("theirs"))
    if not (replaced.select("rank").unionByName(spelt.select("rank")).isEmpty()):
        raise RuntimeError("two long keys share a name; run again")
    return met


def group_variants(counts: DataFrame, ratio: float = 2.0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n): see the module.

    The words are written in order of count and word, so that a rank says which of two near words is
    the better form and keys carry a number, whatever the length of a word.
    """
    counted = materialize(counts.select("word", "n"), "words")
    words = materialize(counted.orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()), "ranked-words")
    forget(counted)
    found = words.join(near(words.select("rank", "word")), "rank", "left")
    other = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    fits = F.col("form_n") >= ratio * F.col("n")
    joined = found.join(other, "best", "left")
    forms = materialize(
        joined.select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best")).alias("to"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(forms.where("to is not null").select("rank", "to"))
    last = forms.join(ends.select("rank", F.col("to").alias("end")), "rank", "left")
    named = last.join(words.select(F.col("rank").alias("end"), F.col("word").alias("root")), "end", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(rank, to): where the pointers of each row lead in the end. Each round every pointer takes over that of
    its target, so the rounds grow with the logarithm of the longest way."""
    at = materialize(forms, "pointers")
    while True:
        step = at.select(F.col("rank").alias("to"), F.col("to").alias("next"))
        after = materialize(at.join(step, "to", "left").select("rank", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "pointers")
        moved = not after.where("moved").isEmpty()
        forget(at)
        at = after.select("rank", "to")
        at.lexspan_path = after.lexspan_path
        if not moved:
            return at
