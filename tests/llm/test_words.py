"""Importance resampling, licence scans and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from tracklake.llm import licenses, resample, spelling
from tracklake.llm.common import ascii_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed, n, size=60):
    """Invented texts with copies, an empty one, a null one, a long one and letters of several scripts."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gámma", "dELTA9", "école", "x", "straße", "Ünder", "日本", "naïve", "42"]
    made = [" ".join(rng.choices(words, k=rng.randrange(1, size))) + rng.choice([".", "!\n", " ", "\x00"]) for _ in range(n)]
    return [*made, made[0], made[0], made[1], "", None, "long Words " * 5000]


def by_hand(docs, target, runs=1, buckets=10_000, seed=2024, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) without grouping, hashing or packing anything."""

    def features(text):
        w = WORD.findall(lowered(text))
        return [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    have, want = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (have + buckets) / ((s[b] + 1) * (want + buckets)))) for b in map(bucket, features(x)))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall(lowered(x)))])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, r in enumerate(able, 1):
        r[4:] = [place if place <= percent * len(able) // 100 else None]
    return [tuple(r[:4]) + (r[4] if r in able else None,) for r in rows]


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"runs": 3, "buckets": 97, "percent": 40, "least": 5, "seed": 7}])
def test_resampling_by_hand(spark, docs, options):
    source, target = texts(1, 60), texts(2, 20)
    got = resample.importance(docs(source), docs(target), **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert plain(got.collect()) == plain(by_hand(list(enumerate(source)), target, **options))


def test_hot_texts_and_repeated_rows(spark):
    text = "one two three four " * 6
    rows = [(i, text) for i in range(3000)] + [(7, text)] * 5 + [(None, text), (None, None)] + [(9000 + i, f"other {i} " * 12) for i in range(500)]
    got = resample.importance(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("one two",)], "text string")).collect()
    want = by_hand(rows, ["one two"])
    assert plain(r[:4] for r in got) == plain(r[:4] for r in want)
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 10 * len([r for r in want if r[1] >= 20]) // 100
    lowest = min(r.score for r in got if r.rank)
    assert not [r for r in got if not r.rank and r.n_features >= 20 and r.score > lowest]


def test_resampling_of_empty_tables(spark, docs):
    none = docs([])
    assert resample.importance(none, docs(["a b"])).collect() == []
    got = resample.importance(docs(["a b c", None]), none).collect()
    assert plain(got) == plain(by_hand([(0, "a b c"), (1, None)], []))
    assert resample.resample(none, none).columns == none.columns


def test_drawn_rows_keep_their_columns(spark, docs):
    source = texts(3, 80, 100)
    df = docs(source).withColumnRenamed("lang", "rank").withColumnRenamed("secrets", "score").withColumnRenamed("source", "digest")
    want = {r.doc_id for r in resample.importance(df, docs(["alpha beta"])).collect() if r.rank}
    got = resample.resample(df, docs(["alpha beta"]))
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == want and want


def test_resampling_draws_what_the_target_is_like(spark):
    rng = random.Random(4)
    of = {"law": "court judge law appeal claim order case".split(), "sea": "wave tide ship sail wind storm reef".split()}
    rows = [(i, " ".join(rng.choices(of["sea" if i % 10 == 0 else "law"], k=30))) for i in range(400)]
    target = [(" ".join(rng.choices(of["sea"], k=30)),) for _ in range(20)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "text string")).collect()
    assert len(got) == 40 and all(r.doc_id % 10 == 0 for r in got)


# ---- licences ----


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def licences_by_hand(words, count, files):
    """Labels, base places and score by laying every template at every place."""
    idf = lambda w: 1 + math.log((files + 1) / (count.get(w, 0) + 1))
    labels, base, base_labels, best = set(), [], set(), 0.0
    for t in licenses.templates():
        tw = list(t.words)
        if not t.keys:
            at = places(words, tw)
            if at:
                labels.add(t.label)
                best = max(best, 1.0)
                if t.base:
                    base += at
                    base_labels.add(t.label)
            continue
        for start in range(-len(tw), len(words)):
            near = [w in words[max(0, start + i - licenses.DRIFT) : max(0, start + i + licenses.DRIFT + 1)] for i, w in enumerate(tw)]
            keyed = all(any(start - licenses.DRIFT <= p <= start + len(tw) + licenses.DRIFT for p in places(words, list(k))) for k in t.keys)
            if sum(near) >= t.least and keyed:
                labels.add(t.label)
                best = max(best, round(sum(idf(w) for w, n in zip(tw, near, strict=True) if n) / sum(map(idf, tw)), 6))
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), best


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else rng.choice(["", "foo", w + " bar"]) for w in text.split())


def licence_texts():
    rng = random.Random(5)
    fill = lambda n: " ".join(rng.choices("the of software free license by cc to copy public general rights file any".split(), k=n))
    out = [
        "Licensed under CC BY-NC 4.0.", "ALL RIGHTS\nRESERVED, all rights reserved", "general public license General-Public/License", "cc by cc by",
        "// SPDX-License-Identifier: Apache-2.0", "released under the MIT License.", "cc bý", "all rights (c) reserved", "", None, "license " * 20_000, fill(300),
    ]
    for _, text, _ in licenses.NOTICES:
        out += [text, fill(30) + " " + text + " " + fill(20), edited(rng, text, 0.08), fill(10) + edited(rng, text, 0.2), edited(rng, text, 0.6), text[: len(text) // 2]]
    return out


def test_licences_by_hand(spark, docs):
    source = licence_texts()
    rows = docs(source).withColumnRenamed("lang", "license").withColumnRenamed("secrets", "labels")
    got = licenses.scan_licenses(rows)
    assert set(got.columns) == set(rows.columns)
    split = [[w.decode() for w in ascii_words((x or "").encode())] for x in source]
    assert split == [WORD.findall(lowered(x)) for x in source]
    count = Counter(w for words in split for w in set(words))
    found = {r.doc_id: tuple(r.license) for r in got.collect()}
    for i, words in enumerate(split):
        if len(words) > 5000:  # one word again and again: no template
            assert found[i] == (len(words), 0, None, None, "", "", 0.0)
        else:
            assert found[i] == pytest.approx(licences_by_hand(words, count, len(source))), source[i]


def test_notices_are_found_and_edits_survive():
    index = licenses.Index.make(0, {})
    rng = random.Random(6)
    for label, text, _ in licenses.NOTICES:
        name = lambda x: {index.templates[k].label for k, *_ in licenses.scan(ascii_words(x.encode()), index)}
        assert label in name("/* " + text.replace(" ", "\n * ") + " */")
        assert label in name(rng.choice(["a b c ", ""]) + text.replace("the", "thee", 1))
        assert label not in name(" ".join(rng.sample(text.split(), len(text.split()))))


def test_licence_index_is_small_and_complete():
    for t in licenses.templates():
        index = licenses.Index.make(10, {"license": 9, "the": 10}, (t,))
        posted = sum(map(len, index.postings.values()))
        assert posted == (1 if not t.keys else len(t.words) - t.least + licenses.AGREE)
        if "license" in t.words and not t.keys and len(set(t.words)) > 1:
            assert b"license" not in index.rare


def test_licences_of_an_empty_table(spark, docs):
    assert licenses.scan_licenses(docs([])).collect() == []
    assert licenses.scan_licenses(docs([None, None])).select("license.*").distinct().collect() == [(0, 0, None, None, "", "", 0.0)]


# ---- spelling ----


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_hand(rows, length=7, times=2, ratio=10):
    total = Counter()
    for i, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(x)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in total.items() if len(w) >= length and k >= times}
    forms, out = {}, []
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        forms[w] = (close[0] if close and n[close[0]] >= ratio * n[w] else None), len(close)
    for w, (form, k) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, form, root, n[w], k, n[form] if form else None))
    return out


def misspelt(seed, n):
    rng = random.Random(seed)
    base = ["Ministère", "balloon", "aabbaacc", "aaaaaaaa", "committee", "straßenÿ", "zzzzzzz×zzzzzzz"]

    def change(w):
        k, c = rng.randrange(len(w)), rng.choice("abéz")
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    rows = []
    for i in range(n):
        words = [w if rng.random() < 0.7 else change(w) if rng.random() < 0.8 else change(change(w)) for w in rng.choices(base, weights=(90, 60, 9, 30, 200, 3, 1), k=25)]
        rows.append((i, rng.choice([" ", "-", "日"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spelling_by_hand(spark, seed):
    rows = [*misspelt(seed, 60), (None, "committee commitee"), (None, None), (5, ""), (5, ""), (6, "comittee " * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert plain(got.collect()) == plain(spelling_by_hand(rows))


def test_roots_follow_chains(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    rows = [(i, " ".join([w] * 2 * 10**k)) for k, w in enumerate(chain) for i in [next(i for i in range(999) if zlib.crc32(f"{i}:{w}".encode()) % 31)]]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w: (v, chain[-1]) for w, v in zip(chain, [*chain[1:], None], strict=True)}


def test_keys_are_distinct_and_exact(spark):
    words = ["aabbb", "abc", "zzzz", "ÿàÿ"]
    got = spelling.emitted(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    want = {(w, w, 0, 0) for w in words}
    for w in words:
        for d in {w[:i] + w[i + 1 :] for i in range(len(w))}:
            at = [i + 1 for i in range(len(w)) if w[:i] + w[i + 1 :] == d]
            want.add((d, w, at[0], at[-1]))
    assert sorted((r.key, r.word, r.first, r.last) for r in got) == sorted(want)


def test_no_words_no_rows(spark, docs):
    assert spelling.variants(docs([])).collect() == [] == spelling.variants(docs([None, "", "short run", "çedille"])).collect()


def test_many_replacements_at_one_place(spark):
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"
    words = pd.DataFrame({"word": ["prefix" + c for c in letters] + ["prefix"], "n": range(2, len(letters) + 3)})
    got = {r.word: (r.n_near, r.best.word) for r in spelling.nearest(spark.createDataFrame(words)).collect()}
    n = dict(words.itertuples(index=False))
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        assert got[w] == (len(close), close[0])
