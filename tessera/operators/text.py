"""Tokens and bigrams.

Tokenising is built-in string functions on whole texts; stop words are a
parameter (Spark's English list by default). Bigrams are formed within one
text by zipping the token array with itself shifted by one; the optional
cross-boundary pairs (last token of text i with the first token of text i+1,
in key order) use a dense rank from the distributed rank machinery and an
equi-join on rank + 1, not a global window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import words
from tessera.operators.summary import adjacent_pairs


def default_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords("english")


def tokenize(df: DataFrame, text: str, out: str = "tokens",
             stop_words: Sequence[str] | Mapping[str, Sequence[str]] | None = None,
             lang: str | None = None, letters: str = "a-zA-Z") -> DataFrame:
    """Letters only, lower case, whitespace split, stop words removed (B1, X6). Stop words by
    language go with its column ``lang``; texts of a null or other language keep all words."""
    toks = words(text, letters)
    if isinstance(stop_words, Mapping):
        if lang is None:
            raise ValueError("stop words by language need the language column")
        given = [(F.col(lang).eqNullSafe(F.lit(name)), sorted(set(some))) for name, some in stop_words.items() if some]

        def stops_here(w):
            return reduce(or_, [here & w.isin(some) for here, some in given])

        if given:
            toks = F.filter(toks, lambda w: ~stops_here(w))
        return df.withColumn(out, toks)
    stops = list(stop_words) if stop_words is not None else default_stop_words()
    if stops:
        stop_arr = F.array(*[F.lit(w) for w in sorted(set(stops))])
        toks = F.filter(toks, lambda w: ~F.array_contains(stop_arr, w))
    return df.withColumn(out, toks)


def token_counts(tokens: DataFrame, col: str = "tokens") -> DataFrame:
    return tokens.select(F.explode(col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(tokens: DataFrame, col: str = "tokens", key: str | None = None,
                  cross_boundary: bool = False) -> DataFrame:
    """Counts of adjacent token pairs (B2, W4). ``cross_boundary=True`` also
    pairs the last token of each text with the first token of the next text in
    ``key`` order, as concatenating every text into one stream would (D18)."""
    pairs = tokens.select(F.explode(adjacent_pairs(F.col(col))).alias("p")).select(
        F.col("p.first").alias("first"), F.col("p.second").alias("second"))
    if cross_boundary:
        if key is None:
            raise ValueError("cross_boundary needs the key that orders the texts")
        from tessera.operators.rank import cumulative_counts
        ne = tokens.where(F.size(col) > 0).select(key, F.col(col)[0].alias("__first"),
                                                  F.element_at(col, -1).alias("__last"))
        ranked = cumulative_counts(ne.withColumn("__cnt", F.lit(1)), [], key, "__cnt", out="__rank")
        a = ranked.select(F.col("__rank").alias("__r"), F.col("__last").alias("first"))
        b = ranked.select((F.col("__rank") - 1).alias("__r"), F.col("__first").alias("second"))
        pairs = pairs.unionByName(a.join(b, "__r").select("first", "second"))
    return pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
