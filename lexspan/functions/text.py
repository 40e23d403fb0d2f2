"""Tokens, stems and small text functions. All but the stemmer are column expressions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stop words of the stop stage.
STOPWORDS = (
    "a about an and any are as at be being by can defines describe description did do does for from give "
    "had has have his how i if in is isn it its like many may me much my of on once one ones or s should so some "
    "such t tell than that the their them there these they this to use using was we well were what when "
    "where which who why will with you your"
).split()
#: The texts that mean yes.
YES = ["y", "yes", "on", "true", "okay", "ok", "Y", "Yes", "On", "True", "Okay", "Ok", "OK"]


def ascii_words(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, as they stand."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def index_terms(word: Column) -> Column:
    """Terms of one word at its address: lower case alone, and the word itself too if a capital
    stands after its first letter."""
    inner = word.substr(F.lit(2), F.length(word)).rlike("[A-Z]")
    return F.when(inner, F.array(word, F.lower(word))).otherwise(F.array(F.lower(word)))


def query_term(word: Column) -> Column:
    """The term that finds a query word: itself with a capital after the first letter, else lower case."""
    return F.when(word.substr(F.lit(2), F.length(word)).rlike("[A-Z]"), word).otherwise(F.lower(word))


def xml_words(text: Column) -> Column:
    """Words and tags: ``<name ...>`` is the token ``<name>``; entities are no tokens."""
    raw = F.regexp_extract_all(F.regexp_replace(text, "&[A-Za-z0-9#]+;", " "), F.lit("(</?[A-Za-z][^<>\\n]*>|[A-Za-z0-9]+)"), F.lit(1))
    return F.transform(raw, lambda t: F.regexp_replace(t, "^(</?[A-Za-z][A-Za-z0-9]*)[^>]*>$", "$1>"))


def utf8_words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and numbers; symbols and ideographs are one token each."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{IsHan}]|\\p{So}|(?:(?!\\p{IsHan})[\\p{L}\\p{M}\\p{N}])+)"), F.lit(1))


def tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", how=words) -> DataFrame:
    """(doc_id, term, pos): every token with its place in the document, from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(how(F.col(text_col))).alias("pos", "term")).select("doc_id", "term", F.col("pos").cast("long").alias("pos"))


#: Bytes of text that are cut into words at once, besides those of one document.
CUT = 4 << 20


def _cut(batches):
    """Pieces of batches whose last column is a text in lower case: the piece's rows, its words as codes, and the row of each word."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(batch.num_columns - 1)))
        size = np.cumsum([0, *pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()])
        cuts = np.unique(np.searchsorted(size, np.arange(0, size[-1] + 1, CUT))).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            lists = pc.split_pattern_regex(part.column(part.num_columns - 1), "[^a-z0-9]+")
            said = lists.flatten()
            real = pc.not_equal(said, "")
            coded, doc = said.filter(real).dictionary_encode(), pc.list_parent_indices(lists).filter(real).to_numpy()
            if len(coded):
                yield part, coded, doc


def _counted(batches):
    """The rows of ``word_lists`` of batches (id, text in lower case)."""
    for part, coded, doc in _cut(batches):
        # by word, then by row: what is sorted by word and document later finds long sorted runs
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        key = rank[coded.indices.to_numpy()] * part.num_rows + doc
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        length = np.bincount(doc, minlength=part.num_rows)
        place = np.arange(len(doc)) - (np.cumsum(length) - length)[doc]
        ends, at = np.append(starts, len(key)), order[starts]
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
        columns = [coded.dictionary.take(coded.indices.take(pa.array(at))), part.column(0).take(pa.array(doc[at])), pa.array(np.diff(ends)), pa.array(length[doc[at]]), places]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "tf", "len", "places"])


def word_lists(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, len, places): a row for each word of each row (doc_id, text), as ``tokens`` cuts it, with its number and places in the
    text and the text's number of words. Nothing is shuffled; rows of one doc_id are not put together."""
    schema = docs.select(F.lit("").alias("term"), "doc_id", F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("len"), F.array(F.lit(0)).alias("places")).schema
    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(_counted, schema)


def _tallied(batches):
    """The rows of ``tallies`` of batches (text in lower case)."""
    for part, coded, doc in _cut(batches):
        word, n = coded.indices.to_numpy(), len(coded.dictionary)
        df = np.bincount(np.unique(doc.astype(np.int64) * n + word) % n, minlength=n)
        cf = np.bincount(word, minlength=n)
        said = len(np.unique(doc))
        columns = [pa.concat_arrays([pa.array([""], coded.dictionary.type), coded.dictionary]), pa.array(np.append(said, df)), pa.array(np.append(len(word), cf))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "df", "cf"])


def tallies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, cf) of pieces of the texts, to be added up: in how many of a piece's rows a word stands and how often, and under an empty
    term its rows with a word and all their words. A piece is some neighbouring rows, so it gives one row for each of its different words. Of a stream too."""
    return docs.select(F.lower(F.col(text_col)).alias("text")).mapInArrow(_tallied, "term string, df long, cf long")


def one_row_each(docs: DataFrame) -> bool:
    """Whether no two rows have the same doc_id; the texts are not read."""
    return docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of all words of (doc_id, text), without an exchange if each document is one row."""
    rows = word_lists(docs).select("doc_id", "term", "tf")
    return rows if one_row_each(docs) else rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def okay(text: Column) -> Column:
    """Whether a parameter says yes."""
    return text.isin(*YES)


def truncated(text: Column, most: int) -> Column:
    """The text's first ``most`` bytes, cut at a character."""
    shorter = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(most))), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.array_max(shorter)))


# Porter's stemmer, from the published rules.

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last none of w, x, y."""
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: Endings and what replaces them, by step.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _swap(w: str, rules: list[tuple[str, str]]) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w


def porter(word: str) -> str:
    """The stem of a lower-case word; words under three letters or with other characters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if base is not None and _has_vowel(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stem_all(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: t if t is None else porter(t))


def stems(terms: DataFrame, col: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms: the Python stemmer sees each term once."""
    distinct = terms.select(col).distinct()
    return distinct.select(F.col(col).alias("term"), F.pandas_udf(_stem_all, "string")(F.col(col)).alias("stem"))


def with_stems(tokens_: DataFrame) -> DataFrame:
    """Tokens with those stems beside them that differ, as ``porter:`` terms at the same address."""
    joined = tokens_.join(stems(tokens_), "term")  # each distinct word is stemmed once
    changed = joined.where("term <> stem").select("doc_id", F.concat(F.lit("porter:"), "stem").alias("term"), "pos")
    return tokens_.unionByName(changed)
