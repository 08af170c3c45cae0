"""Spelling variants: a symmetric-delete join finds words at distance one, a far more frequent one is the form."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, struct

#: Which runs lose a code point, the least code points and occurrences of a word, how much more often its form occurs.
EVERY, LENGTH, TIMES, RATIO = 31, 7, 2, 10
#: One byte a code point: A-Z fall on a-z, U+00C0 to U+00FF stay, all else parts words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
MOST = 500_000  # words that a task counts before it sends them on


def damaged(run: bytes, prefix: int, every: int = EVERY) -> bytes:
    """A lower-cased run (a byte a code point), less one code point where the checksum with its document says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n) of all words of ``length`` code points or more that occur ``times`` times or more.

    Tasks count words of whole texts in memory, ``MOST`` at a time, and send sums; so a word that
    every row has is one row a task. Null texts have no words; a null id is written as nothing.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for i, x in zip(b["id"], b["text"], strict=True):
                prefix = zlib.crc32(f"{i}:".encode())
                for run, n in Counter(x.encode("latin-1", "replace").translate(LETTERS).split()).items():
                    if len(run) >= length and len(word := damaged(run, prefix)) >= length:
                        total[word] += n
                if len(total) >= MOST:
                    yield _table(total)
                    total.clear()
        if total:
            yield _table(total)

    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInPandas(count, struct("word string, n long")).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _table(total: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())})


def emitted(words: DataFrame) -> DataFrame:
    """The keys of each word: itself (``first`` 0), and its distinct single deletions.

    A deletion has the places, from 1, that give it: ``first`` to ``last``, a run of one letter.
    """
    at = F.col("first")
    places = words.select("word", "n", F.length("word").alias("size"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("first"))
    here = F.substring("word", at, F.lit(1))
    again = (at > 1) & (here == F.substring("word", at - 1, F.lit(1)))
    run = F.length(F.regexp_extract(F.substring("word", at, F.col("size")), r"^((.)\2*)", 1))
    last = F.when(at == 0, 0).when(here == F.substring("word", at + 1, F.lit(1)), at + run - 1).otherwise(at)
    key = F.when(at == 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), at - 1), F.substring("word", at + 1, F.col("size"))))
    return places.filter(~again).select(key.alias("key"), "first", last.cast("int").alias("last"), "word", "n")


def nearest(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of words with a word at distance one; ``best`` is (-n, word) of the most frequent, ties to the smaller.

    Words meet at shared keys. A key and a word that loses one letter to it are one insertion
    apart. Two words that lose a letter at the same place to the same key differ in that letter
    alone: an exact check without comparing them. A key is one word and, at each of its places,
    at most a word a letter, so groups are bounded by the alphabet, whatever the table's size;
    within a group counts and the two best stand for all pairs, of which none is made.
    """
    me = F.struct((-F.col("n")).alias("down"), "word")
    key = Window.partitionBy("key")
    longer = F.col("first") > 0
    met = emitted(words).withColumn("n_longer", F.sum(longer.cast("long")).over(key)).withColumn("longer", F.min(F.when(longer, me)).over(key)).withColumn("shorter", F.min(F.when(~longer, me)).over(key))
    met = met.filter((F.col("n_longer") > 1) | ((F.col("n_longer") == 1) & F.col("shorter").isNotNull()))
    inserted = met.filter(F.when(longer, F.col("shorter").isNotNull()).otherwise(F.col("n_longer") > 0))
    inserted = inserted.select("word", F.when(longer, 1).otherwise(F.col("n_longer")).alias("n_near"), F.when(longer, F.col("shorter")).otherwise(F.col("longer")).alias("best"))
    place = Window.partitionBy("key", "place")
    order = place.orderBy(F.desc("n"), "word")
    both = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = met.filter(longer).withColumn("place", F.explode(F.sequence("first", "last")))
    placed = placed.withColumn("size", F.count(F.lit(1)).over(both)).withColumn("top", F.first(me).over(both)).withColumn("second", F.nth_value(me, 2).over(both))
    replaced = placed.filter("size > 1").select("word", (F.col("size") - 1).alias("n_near"), F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top")).alias("best"))
    return inserted.unionByName(replaced).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): the last form that forms of forms lead to.

    Each round looks up where the present end itself leads, which doubles the steps taken; a
    form's count grows by the ratio at each step, so there are few. A form has few words, so no
    key of the join is hot.
    """
    ends = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while ends.filter("moved").limit(1).count():
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, ends = ends, materialize(ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
    return ends.select("word", "root")


def variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of a text column.

    Two words are near at one inserted, deleted or replaced code point. A word's form is its near
    word that occurs most often, if that is ``ratio`` times as often as the word or more, and its
    root where forms lead. Words without one are their own root. Null and empty texts add
    nothing; repeated rows count each time; without words there are no rows. Only the two columns
    named are read, so no name can clash.
    """
    words = materialize(word_counts(df, doc_id, text, length, times), "words")
    near = words.join(nearest(words), "word", "left")
    top = -F.col("best.down")
    is_form: Column = top >= ratio * F.col("n")
    near = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, top).alias("form_n")), "near")
    discard(words)
    roots = rooted(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
