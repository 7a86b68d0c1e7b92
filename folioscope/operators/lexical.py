"""Lexical signals: how many of a page's words are rare, are in no list, or are rare and come again and again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: What counts as a token (of lower-cased text), and the Zipf values that tell words apart.
TOKEN = r"[a-z][a-z\-_/0-9]*"
JARGON_BELOW, RARE_BELOW, FOCUS_BELOW, FOCUS_COUNT = 1.5, 3, 4, 4

#: Function words of English that are left out unless the caller brings a list of their own.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its itself just me might more most must my no nor not now of off on once only or "
    "other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up upon us very was "
    "we were what when where which while who whom whose why will with would you your yours"
).split()


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_counts(texts: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """``id, word, n`` of the tokens of ``texts(id, text)`` that are no stop words; a null text has none.

    A text's tokens are counted where it lies, in runs of its sorted tokens, so nothing is moved; ids are unique.
    """
    rows = texts.select("id", F.sort_array(F.filter(_tokens(F.col("text")), lambda w: ~w.isin(list(stop_words)) if stop_words else F.lit(True))).alias("words"))
    # where runs begin, and where the next one does
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get(F.col("words"), i) != F.get(F.col("words"), i - 1)))
    rows = rows.where(F.size("words") > 0).select("id", "words", starts.alias("starts"))
    runs = F.transform("starts", lambda i, k: F.struct(F.get(F.col("words"), i).alias("word"), (F.coalesce(F.get(F.col("starts"), k + 1), F.size("words")) - i).cast("long").alias("n")))
    return rows.select("id", F.inline(runs))


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all of ``texts``, stop words included; only a task's different words are moved.  A written table."""
    return materialise(texts.select(F.explode(_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")


def zipf_of(texts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``word, zipf`` from the corpus itself: the logarithm of a word's uses in a billion; stop words included."""
    counts = corpus_counts(texts) if counts is None else counts
    total = counts.agg(F.sum("n")).head()[0] or 1
    return counts.select("word", F.log10(F.col("n") * (1e9 / total)).alias("zipf"))


def lexical_signals(texts: DataFrame, zipf: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """``id`` and the three lexical signals, for all of ``texts(id, text)``; zero without tokens.

    Words of a text that need no look at the rest of the list are summed up where the text lies; only the others are moved.
    ``zipf(word, zipf)`` has each word once and is read twice, so it should be a written table; a word that is not in it counts as 0.  Words at ``FOCUS_BELOW`` or
    above count for nothing but the total: as uses in a billion there are 100,000 of them at most, which are
    broadcast, so that no frequent word is a key of the join with the rest of the list.
    """
    counts = word_counts(texts, stop_words)
    usual = zipf.where(F.col("zipf") >= FOCUS_BELOW).select("word", F.lit(True).alias("known"))
    if usual.limit(100_001).count() <= 100_000:
        usual = F.broadcast(usual)
    marked = counts.join(usual, "word", "left")
    rare = marked.where("known is null").drop("known").join(zipf.where(F.col("zipf") < FOCUS_BELOW), "word", "left").select("id", "n", F.coalesce("zipf", F.lit(0.0)).alias("z"))
    known = marked.where("known").groupBy("id").agg(F.sum("n").alias("n"))
    part = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    found = rare.groupBy("id").agg(F.sum("n").alias("n"), part(F.col("z") < JARGON_BELOW).alias("jargon"), part(F.col("z") < RARE_BELOW).alias("rare"), part((F.col("z") < FOCUS_BELOW) & (F.col("n") >= FOCUS_COUNT)).alias("focus"))
    rows = found.unionByName(known.select("id", "n", *(F.lit(0).cast("long").alias(c) for c in ("jargon", "rare", "focus"))))
    share = lambda c: F.sum(c) / F.sum("n")
    per = rows.groupBy("id").agg(share("jargon").alias("lexic_jargon_share"), share("rare").alias("lexic_rare_words_share"), share("focus").alias("lexic_topical_focus"))
    names = ("lexic_jargon_share", "lexic_rare_words_share", "lexic_topical_focus")
    return texts.select("id").join(per, "id", "left").select("id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
