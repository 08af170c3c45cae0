"""Benchmark decontamination: rare word pairs find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import struct, text_batches

SHORTEST = 3  # words of the shortest item that is aligned; shorter ones are found word for word
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST, HIGH, RUN = 0.4, 0.8, 8  # share of the best possible score: see ``least``
ITEMS = 20_000  # items of a block; the documents are read twice for each block
#: Scripts that put no spaces between words; there each character counts as one.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")


def least(size: int) -> float:
    """Share of an item's best possible score that makes a copy.

    Two fifths of it (a third of the words may be others), but no less than eight words in a row
    give, and four fifths of items under ten words: a common phrase of a short item is no copy.
    """
    return max(LEAST, min(HIGH, RUN / size))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case; single characters of scripts that are written without spaces."""
    return WORD.findall((text or "").lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the place in the passage where it ends (exclusive).

    Row by row; a gap along a row costs the same for each word, so it is a running maximum.
    """
    ramp = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.where(passage == w, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[0] = 0
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        row = np.maximum.accumulate(new + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Index:
    """Seeds of a block of items: sorted word-pair keys, and where in which item each stands.

    No alignment that reaches ``least`` is missed. Two matches after one another cost what the wider of
    their steps (in the item, in the passage) leaves out. With p steps of one word on both sides and q of
    at most two, the score is at most 2 + 2 p + q; so a passage holds word pairs of the item, a step of one
    or two words apart, whose weights (two if both steps are one, else one) add up to ``need``.
    """

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocab: dict[str, int] = {}
        self.items = [(i, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64)) for i, ws in items if len(ws) >= SHORTEST]
        self.base = len(self.vocab) + 1
        pairs = [[ids[:-step] * self.base + ids[step:] for step in (1, 2)] for _, ids in self.items]
        self.keys = np.unique(np.concatenate([k for two in pairs for k in two])) if pairs else np.empty(0, np.int64)
        self.where = [[np.searchsorted(self.keys, k) for k in two] for two in pairs]
        self.size = np.array([len(ids) for _, ids in self.items], np.int64)
        self.weight = np.zeros(len(self.keys) + 1, np.int64)  # of one item's pairs, while it is looked at
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, ws in items:
            if 0 < len(ws) < SHORTEST:
                self.short.setdefault(tuple(ws), []).append(i)
        self.choose(np.zeros(len(self.keys), np.int64))

    def need(self, size: int) -> float:
        return least(size) * MATCH * size - MATCH - 1e-9

    def choose(self, count: np.ndarray) -> None:
        """Seeds are the pairs from all places of an item but those that the corpus has most.

        Places left out weigh less than ``need`` together, so a passage holds one of the others.
        """
        none = np.empty(0, np.int64)
        number, item, place = [none], [none], [none]
        for n, (near, far) in enumerate(self.where):
            cost = count[near]
            cost[: len(far)] += count[far]
            spare = max(0, math.ceil(self.need(len(near) + 1) / MATCH) - 1)
            kept = np.argsort(cost, kind="stable")[: len(near) - spare]
            for pairs, at in ((near, kept), (far, kept[kept < len(far)])):
                number.append(pairs[at])
                item.append(np.full(len(at), n))
                place.append(at)
        number = np.concatenate(number)
        order = np.argsort(number, kind="stable")
        self.item, self.place = np.concatenate(item)[order], np.concatenate(place)[order]
        self.first = np.searchsorted(number[order], np.arange(len(self.keys) + 1))
        self.is_seed = np.append(np.diff(self.first) > 0, False)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' ids (-1 for others), and by place the number (or -1) of the pair with the next word and the one after."""
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        out = []
        for step in (1, 2):
            found = np.full(len(ids), -1, np.int64)
            if len(ids) > step and len(self.keys):
                at = np.flatnonzero((ids[:-step] >= 0) & (ids[step:] >= 0))
                key = ids[at] * self.base + ids[at + step]
                n = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                same = self.keys[n] == key
                found[at[same]] = n[same]
            out.append(found)
        return ids, *out

    def search(self, words: list[str]):
        """(item id, score, first word, end word) of each item whose best alignment in the text reaches ``least``."""
        if self.short:
            yield from self._word_for_word(words)
        ids, near, far = self.hits(words)
        at = [np.flatnonzero(self.is_seed[x]) for x in (near, far)]
        number = np.concatenate([near[at[0]], far[at[1]]])
        if not len(number):
            return
        times = self.first[number + 1] - self.first[number]
        k = np.arange(times.sum()) + np.repeat(self.first[number] - np.cumsum(times) + times, times)
        item, start = self.item[k], np.repeat(np.concatenate(at), times) - self.place[k]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        size = self.size[item]
        share = np.maximum(LEAST, np.minimum(HIGH, RUN / size))
        room = (size * (1 - share) * MATCH).astype(np.int64) + 1  # words that edits may have put in
        low, high = start - room, start + size + room
        new = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (low[1:] > high[:-1])))
        last = np.append(new[1:], len(item)) - 1
        found: dict[int, tuple[float, int, int]] = {}
        for n, a, b in zip(item[new].tolist(), np.maximum(low[new], 0).tolist(), np.minimum(high[last], len(ids)).tolist(), strict=True):
            for x, y in self._dense(n, near[a:b], far[a:b]):
                got = self._scored(self.items[n][1], ids, a + x, a + y)
                if n not in found or got > found[n]:
                    found[n] = got
        for n, best in found.items():
            if best[0] >= least(len(self.items[n][1])):
                yield self.items[n][0], *best

    def _word_for_word(self, words: list[str]):
        """Items of one or two words where a text has them as they are, the first place of each."""
        seen = set()
        for n in (1, 2):
            for i, some in enumerate(zip(*(words[k:] for k in range(n)))):
                if some in self.short and some not in seen:
                    seen.add(some)
                    for item in self.short[some]:
                        yield item, 1.0, i, i + n

    def _dense(self, n: int, near: np.ndarray, far: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of a text with enough of an item's pairs for an alignment within them."""
        size = int(self.size[n])
        one, two = self.where[n]
        self.weight[two], self.weight[one] = 1, 2
        total = np.append(0, np.cumsum(np.maximum(self.weight[near], np.minimum(self.weight[far], 1))))
        self.weight[two] = self.weight[one] = 0
        need = self.need(size)
        if total[-1] < need:
            return []
        span = int(size * (MATCH + 1 - least(size) * MATCH)) + 1  # the longest passage that can reach the score
        end = np.minimum(np.arange(len(near)) + span, len(near))
        at = np.flatnonzero(total[end] - total[:-1] >= need)
        if not len(at):
            return []
        new = np.flatnonzero(np.append(True, at[1:] > end[at[:-1]]))
        return list(zip(at[new].tolist(), end[at[np.append(new[1:], len(at)) - 1]].tolist(), strict=True))

    def _scored(self, target: np.ndarray, ids: np.ndarray, low: int, high: int) -> tuple[float, int, int]:
        part = ids[low:high]
        most = MATCH * int(np.isin(target, part).sum())
        if most < least(len(target)) * MATCH * len(target):
            return 0.0, low, low
        score, end = align(target, part)
        if score < least(len(target)) * MATCH * len(target):
            return score / (MATCH * len(target)), low, low + end
        back, start = align(target[::-1], part[:end][::-1])
        return score / (MATCH * len(target)), low + end - start, low + end


def find_leaks(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start, end) where a text holds a copy of an item, edited or not.

    Score is the Smith-Waterman score of the best passage over that of an exact copy; start and
    end count words. Items are the stated query set: blocks of 20,000 go to all executors, and
    every row of ``df`` is searched for every block. Of a block's word pairs the whole corpus is
    counted first, pre-aggregated by task. Items of one or two words are found word for word, items
    without words nowhere; null and empty texts hold nothing; equal rows give equal results; a
    repeated item gives one row.
    """
    spark = df.sparkSession
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((df, doc_id), (items, item_id)))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, item_id {item_kind}, score double, start bigint, `end` bigint"
    out, block = None, []
    queries = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct().orderBy("i", "t")
    for row in queries.toLocalIterator():
        block.append((row.i, words_of(row.t)))
        if len(block) == ITEMS:
            part = _search(docs, block, schema)
            out, block = (part if out is None else out.unionByName(part)), []
    if block or out is None:
        part = _search(docs, block, schema) if block else spark.createDataFrame([], schema)
        out = part if out is None else out.unionByName(part)
    return out


def _ready(docs: DataFrame, items: list[tuple[object, list[str]]]):
    """A block's index with seeds chosen by counts over all texts, as a broadcast variable."""
    text_batches(docs.sparkSession)
    index = Index(items)
    send = lambda x: docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(x))  # noqa: E731  by value, as executors need not have this package
    shared = send(index)

    def count(frames):
        index = cloudpickle.loads(shared.value)
        total = np.zeros(len(index.keys), np.int64)
        for frame in frames:
            for text in frame["text"]:
                for numbers in index.hits(words_of(text))[1:]:
                    np.add.at(total, numbers[numbers >= 0], 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"g": at, "n": total[at]})

    total = np.zeros(len(index.keys), np.int64)
    for r in docs.select("text").mapInPandas(count, struct("g long, n long")).groupBy("g").agg(F.sum("n").alias("n")).collect():
        total[r.g] = r.n
    index.choose(total)
    return send(index)


def _search(docs: DataFrame, items: list[tuple[object, list[str]]], schema: str) -> DataFrame:
    ready = _ready(docs, items)

    def search(batches):
        index = cloudpickle.loads(ready.value)
        for batch in batches:  # Arrow keeps ids exact beside nulls
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                found = [(d, *hit) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for hit in index.search(words_of(t))]
                if found:
                    names = ["doc_id", "item_id", "score", "start", "end"]
                    columns = dict(zip(names, map(list, zip(*found, strict=True)), strict=True))
                    ids = pa.array(columns["doc_id"], batch.schema.field("doc_id").type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(columns[n]) for n in names[1:])], names=names)

    return docs.mapInArrow(search, schema)


def remove_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text holds no copy of an item, all columns as they are. Null texts stay."""
    out, block = df, []
    for row in items.select(F.col(item_text).alias("t")).distinct().orderBy("t").toLocalIterator():
        block.append((len(block), words_of(row.t)))
        if len(block) == ITEMS:
            out, block = _without(out, df, block, text), []
    return _without(out, df, block, text) if block else out


def _without(out: DataFrame, df: DataFrame, block: list, text: str) -> DataFrame:
    ready = _ready(df.select(F.col(text).alias("text")), block)

    @F.pandas_udf(T.BooleanType())
    def leaks(texts: pd.Series) -> pd.Series:
        index = cloudpickle.loads(ready.value)
        return pd.Series([next(index.search(words_of(t)), None) is not None for t in texts], dtype=bool)

    return out.filter(~leaks(F.col(text)))
