"""Components, shingle sets and benchmark leaks against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklake.llm import decontam, graph, ngrams
from tracklake.llm.queries import op4_decontaminate, op6_ngram_jaccard_join

SF = "/root/testdata/sf0.001"


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(texts: dict):
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def made(n, seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyzuvw") * rng.randint(1, 3)
    line = "  ".join(word() for _ in range(20))
    base = [[word() for _ in range(rng.choice((3, 5, 8, 30, 90)))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w) + (f"\n{line}" if i % 3 == 0 else ""))
    return out


def test_components_are_those_of_brute_force(docs):
    texts = [*made(160), None, "", "  \n ", "One two", "one TWO", "one two three", "É a b c d", "é a b c d", "w " * 3000]
    df = docs(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.near_duplicates(df).collect()}
    assert got == plain_components(dict(enumerate(texts)))
    assert len({c for _, c in got.values()}) < 0.8 * len(texts)


def test_blocks_of_a_large_group(docs, monkeypatch):
    """Blocks of eight sets; most of one group hangs together, others meet it in pairs of blocks."""
    monkeypatch.setattr(ngrams, "BLOCK", 8)
    monkeypatch.setattr(ngrams, "PIVOTS", 2)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    chain = []
    for k in range(90):  # each text is near the one before; far ones link only through those between
        base[rng.randrange(60)] = f"x{k}"
        chain.append(" ".join(base))
    hub = [" ".join([*(f"h{i}" for i in range(50)), f"end{k}"]) for k in range(60)]
    texts = [*made(80, 9), *chain, *hub]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.near_duplicates(docs(texts)).collect()}
    assert got == plain_components(dict(enumerate(texts)))


def test_column_blocks_are_sized_by_the_texts(docs, monkeypatch):
    """Many blocks, small batches, an n-gram that all texts of a batch share: the same components."""
    monkeypatch.setattr(ngrams, "BLOCK_CHARS", 40)
    monkeypatch.setattr(ngrams, "BATCH_CHARS", 3000)
    texts = [*made(120, 4), "all texts have these words " * 3]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.near_duplicates(docs(texts)).collect()}
    assert got == plain_components(dict(enumerate(texts)))


def test_kept_row_of_ties_is_the_same_in_each_order(spark):
    rows = [(1, "a b c d e f", f"x{k}", {"m": k}) for k in range(6)] + [(1, "A b c d e f", "w", {"m": 0}), (2, "a b c d e F", "a", {"m": 0})]
    kinds = "doc_id long, text string, near_key string, extra map<string,int>"
    kept = [ngrams.keep_one(spark.createDataFrame(r, kinds).repartition(3)).collect() for r in (rows, rows[::-1])]
    assert len(kept[0]) == len(kept[1]) == 1 and kept[0][0][:3] == kept[1][0][:3]


def test_query_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op6_ngram_jaccard_join(spark, SF).collect()} == plain_components(texts)


def test_awkward_rows_and_keeping_one(spark, docs):
    df = docs(["a b c d e f", "a b c d e f", None, "", "q r s t u", "a b c d e f"]).unionByName(docs(["a b c d e f"]))
    kept = ngrams.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert [r.component_id for r in ngrams.near_duplicates(nulls).collect()] == [None] * 3 and ngrams.keep_one(nulls).count() == 2
    assert ngrams.near_duplicates(df.limit(0)).count() == ngrams.keep_one(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abAB \n\t é", max_size=30), max_size=5))
def test_shingles_match_words(texts):
    for text, hs in zip(texts, ngrams.shingle_sets(texts), strict=True):
        assert len(hs) == len(plain_set(text))


def test_graph(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for u, v in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    seen: dict = {}
    for start in sorted(near):
        todo = [start] if start not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = start
                todo += near[x]
    assert got == seen


# ---- benchmark leaks ----


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(-1, 4), max_size=20))
def test_alignment(a, b):
    b = [x if x >= 0 else -1 for x in b]
    score, end = decontam.align(np.array(a, np.int64), np.array(b, np.int64))
    assert score == plain_align(a, b) and 0 <= end <= len(b)


def test_leaks_exact_and_edited(spark, docs):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (20, 30, 45, 2)]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    edited = items[1].split()
    edited[5], edited[17] = "other", "new words"
    del edited[25]
    texts = [noise(300), f"{noise(40)} {items[0].upper()}! {noise(40)}", f"{noise(9)} {' '.join(edited)}", items[2], None, "", items[3], " ".join(items[2].split()[:15]), f"{items[2]}\n{items[0]}"]
    bench = spark.createDataFrame([(10 + i, t, 1) for i, t in enumerate([*items, None, items[0]])], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(docs(texts), bench).collect()}
    pair = f" {items[3]} "  # two words: found word for word
    short = {(d, 13) for d, t in enumerate(texts) if t and pair in f" {' '.join(decontam.words_of(t))} "}
    assert (6, 13) in short and set(got) == {(1, 10), (1, 15), (2, 11), (3, 12), (8, 12), (8, 10), (8, 15)} | short and got[3, 12] == got[6, 13] == 1 and got[2, 11] < 1
    kept = decontam.remove_leaks(docs(texts), bench)
    assert kept.columns == docs(texts).columns and {r.doc_id for r in kept.collect()} == {0, 4, 5, 7} - {d for d, _ in short}
    assert decontam.find_leaks(docs(texts), bench.limit(0)).count() == 0 and decontam.remove_leaks(docs(texts).limit(0), bench).count() == 0


def test_leak_blocks_and_common_items(docs, spark, monkeypatch):
    """An item that every text holds stays findable; blocks of items give what one block gives."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(k, f"{item} {k} {k} x{k}") for k in range(5)], "item_id long, text string")
    df = docs([f"some {item} {k % 5} {k % 5} x{k % 5} text" for k in range(20)])
    one = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()}
    monkeypatch.setattr(decontam, "ITEMS", 2)
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()} == one >= {(k, k % 5) for k in range(20)}


def test_leaks_of_the_query(spark):
    """Every text with an item in it word for word is found, and nothing that aligns badly."""
    texts = {r.doc_id: decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in op4_decontaminate(spark, SF).collect()}
    whole = {(d, i) for d, t in texts.items() for i, w in items.items() if f" {' '.join(w)} " in f" {' '.join(t)} "}
    assert whole <= set(got)
    for (d, i), r in got.items():
        assert abs(plain_align(items[i], texts[d][max(0, r.start - 5) : r.end + 5]) / (2 * len(items[i])) - r.score) < 1e-9


def edited_copies(seed, vocabulary):
    """Items and texts with copies of them, a fifth to a third of whose words are replaced, inserted or left out, at random or in a period."""
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 3)}"  # noqa: E731  some words are common
    items = [[word() for _ in range(rng.choice((3, 4, 7, 12, 20, 40)))] for _ in range(12)]
    texts = []
    for k in range(120):
        period, kind, copy = rng.choice((3, 4, 5)), rng.choice(("replace", "insert", "leave", "any")), []
        for n, w in enumerate(items[k % len(items)]):
            hit = n % period == period // 2 if k % 2 else rng.random() < 1 / period
            edit = rng.choice(("replace", "insert", "leave")) if kind == "any" else kind
            copy += [w] if not hit else {"replace": [word()], "insert": [w, word()], "leave": []}[edit]
        texts.append([*(word() for _ in range(rng.randint(0, 60))), *copy, *(word() for _ in range(rng.randint(0, 60)))])
    texts += [[x for w in items[5] for x in (w, "z")], items[0], items[1][1:]]
    return items, texts


def test_edited_copies_are_those_of_brute_force():
    for seed, vocabulary in enumerate((8, 40, 400, 4000)):
        items, texts = edited_copies(seed, vocabulary)
        index = decontam.Index(list(enumerate(items)))
        total = np.zeros(len(index.keys), np.int64)
        for text in texts:
            for numbers in index.hits(text)[1:]:
                np.add.at(total, numbers[numbers >= 0], 1)
        index.choose(total)
        got = {(n, i): round(score * 2 * len(items[i])) for n, text in enumerate(texts) for i, score, _, _ in index.search(text)}
        names = {w: k for k, w in enumerate({w for t in (*items, *texts) for w in t})}
        numbers = lambda ws: np.array([names[w] for w in ws], np.int64)
        best = {(n, i): decontam.align(numbers(item), numbers(text))[0] for n, text in enumerate(texts) for i, item in enumerate(items)}
        assert got == {k: s for k, s in best.items() if s >= decontam.least(len(items[k[1]])) * 2 * len(items[k[1]])}


def test_every_fifth_word_replaced(spark, docs):
    """No five words in a row are as they were, and the words put in make absent grams."""
    items = [" ".join(f"w{(7 * i + k * k) % 50}" for k in range(40)) for i in range(8)]
    texts = [" ".join(f"new{k}" if k % 5 == 4 else w for k, w in enumerate(t.split())) for t in items]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(k, k) for k in range(8)} <= {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(texts), bench).collect()}
    assert decontam.remove_leaks(docs(texts), bench).count() == 0


def test_short_and_unspaced_items():
    items = ["yes", "Paris France", "東京は日本の首都であり人口が最も多い", "the end of the long day", None, "..."]
    index = decontam.Index([(i, decontam.words_of(t)) for i, t in enumerate(items)])
    found = lambda text: {i for i, *_ in index.search(decontam.words_of(text))}
    assert found("Yes!") == {0} and found("yesterday in Paris, France") == {1} and found("Paris in France") == set()
    assert found("では、東京は日本の首都であり人口が最も多い。") == {2} and found("東京は日本の首都であるが人口が最も多い") == {2} and found("京都は日本の古都") == set()
    assert found("at the end of the day we went") == set() and found("it was the end of the long day") == {3} and found("") == set()


def test_recall_by_share_of_edits():
    """Of copies with a tenth to two fifths of the words edited, all that full alignment accepts are found."""
    rng = random.Random(11)
    items = [[f"w{rng.randrange(3000)}" for _ in range(40)] for _ in range(20)]
    index = decontam.Index(list(enumerate(items)))
    for share in (0.1, 0.2, 0.3, 1 / 3, 0.4):
        hit = want = 0
        for n, item in enumerate(items * 3):
            text = [f"new{k}" if (k % 3 == 1 if share == 1 / 3 else rng.random() < share) else w for k, w in enumerate(item)]
            text = [f"w{rng.randrange(3000)}" for _ in range(30)] + text + [f"w{rng.randrange(3000)}" for _ in range(30)]
            names = {w: k for k, w in enumerate({*item, *text})}
            good = decontam.align(np.array([names[w] for w in item]), np.array([names[w] for w in text]))[0] >= decontam.least(40) * 80
            want += good
            hit += good and any(i == n % 20 for i, *_ in index.search(text))
        assert hit == want and (want >= 55 or share == 0.4), share


def test_shuffles_go_when_a_table_is_written(spark):
    from pyspark.sql import functions as F

    from tracklake.llm.common import materialize, released

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, store = spark.conf.get(name), spark.sparkContext._jsc.sc().env().mapOutputTracker()
    n = store.shuffleStatuses().size()
    with released(spark):
        assert spark.conf.get(name) == "true"
        kept = [materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "released") for _ in range(3)]
    assert spark.conf.get(name) == before and store.shuffleStatuses().size() <= n
    assert [t.count() for t in kept] == [7, 7, 7]
