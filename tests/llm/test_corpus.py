"""Quality rules, the source mix, and the pipeline."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklake.llm import decontam, mix, ngrams, quality
from tracklake.llm.queries import op5_mix_sources, op10_quality_rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a ", "b ", "é\n", "# ", "\t", "a b a b a b a b ", "\x0b", "\u00a0", "|x "]), max_size=30).map("".join))
def test_counts(text):
    assert quality.features(text)[:5] == plain_counts(text)


def test_query_counts_and_verdicts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.99  # clean documents stay
    assert np.mean([bool(q) == k for q, k in judged]) > 0.95


def test_em_finds_which_rules_to_trust():
    rng = np.random.default_rng(0)
    k = len(quality.RULES)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.6] + [0.8] * (k - 4))
    right = rng.random((len(truth), k)) < accuracy
    votes = np.where(right, truth[:, None], ~truth[:, None])
    said = rng.random(votes.shape) < 0.8
    patterns = Counter("".join("-" if not s else "1" if v else "0" for v, s in zip(row, mask, strict=True)) for row, mask in zip(votes, said, strict=True))
    model = quality.fit(patterns)
    assert abs(model.prior - 0.8) < 0.03 and len(model.good) == 2
    assert np.abs(model.rates[model.good][0] - accuracy).max() < 0.06 and np.abs(model.rates[~model.good][0] - (1 - accuracy)).max() < 0.12
    assert quality.fit({}).prior == 0.8


def test_the_verdict_is_no_count_of_bad_votes():
    """Two rules that fail by themselves, often and independently, are noise; two that fail together mark bad text, and one of these is enough."""
    rng = np.random.default_rng(1)
    k, n = len(quality.RULES), 50_000
    good = np.ones((n, k), bool)
    noisy, kin = [0, 4], [2, 6, 8]
    for i in noisy:
        good[rng.random(n) < 0.15, i] = False
    bad = rng.random(n) < 0.06
    for i in kin:
        good[bad & (rng.random(n) < 0.9), i] = False
    votes = ["".join("1" if g else "0" for g in row) for row in good]
    model = quality.fit(Counter(votes))
    keep = {v: model.p_good(v) >= quality.THRESHOLD for v in set(votes)}
    both_noisy = "".join("0" if i in noisy else "1" for i in range(k))
    assert keep[both_noisy] and not keep["".join("0" if i in kin[:2] else "1" for i in range(k))]
    kept = np.array([keep[v] for v in votes])
    assert kept[~bad].mean() > 0.999 and kept[bad].mean() < 0.05
    counted = np.array([v.count("0") < 2 for v in votes])
    assert (kept != counted).mean() > 0.02 and kept[both_noisy == np.array(votes)].all()


def test_labels_by_em_alone(spark):
    """No text is fixed beforehand: what the classes decide keeps good texts and drops bad ones, and depends on what votes go together."""
    texts = {r.doc_id: quality.features(r.text)[5] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    patterns = Counter(texts.values())
    model = quality.fit(patterns)
    keep = {v: model.p_good(v) >= quality.THRESHOLD for v in patterns}
    of = lambda q: np.mean([keep[texts[i]] for i, y in labels.items() if y == q])
    assert of(0) <= 0.05 and of(1) >= 0.99 and len(model.good) >= 3
    shuffled = [list(col) for col in zip(*(v for v in texts.values()), strict=True)]
    rng = np.random.default_rng(3)
    for col in shuffled:
        rng.shuffle(col)  # the same votes by rule, on other texts: nothing goes together any more
    alone = quality.fit(Counter(map("".join, zip(*shuffled, strict=True))))
    assert alone.prior > 0.99
    assert {v: alone.p_good(v) >= quality.THRESHOLD for v in patterns} != keep


def test_posterior_column_is_that_of_the_model(spark):
    model = quality.fit({"111111111": 900, "110111110": 60, "101-11011": 30, "011-11-11": 40, "---------": 1})
    votes = ["111111111", "110111110", "---------", "0--------", "101010-01"]
    got = spark.createDataFrame([(v,) for v in votes], "v string").select("v", model.posterior(F.col("v")).alias("p")).collect()
    assert all(abs(r.p - model.p_good(r.v)) < 1e-9 for r in got)


def test_fitted_verdicts_beat_unfitted_ones(spark):
    """Rates are estimated, none stands at a bound, and what they decide is nearer to the labels."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("text", "quality").collect()
    patterns = Counter(quality.features(r.text)[5] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())
    model = quality.fit(patterns)
    assert ((model.rates > 0) & (model.rates < 1)).all() and len(set(model.rates.ravel().round(4))) >= 10 and (~model.good).any()

    def right(m):
        keep = {v: m.p_good(v) >= quality.THRESHOLD for v in patterns}
        return np.mean([keep[quality.features(r.text)[5]] == bool(r.quality) for r in rows]), np.mean([keep[quality.features(r.text)[5]] for r in rows if r.quality])

    fitted, start = right(model), right(quality.fit({}))
    assert fitted[0] > start[0] + 0.03 and fitted[1] >= 0.98


@settings(max_examples=100, deadline=None)
@given(st.text("aBcПРиéÉ ß\u2160\U00010400\U00010428", min_size=1, max_size=20), st.integers(2, 60))
def test_repeating_a_text_keeps_its_case_vote(text, times):
    """One way of counting letters at every size, in every script."""
    up, low = sum(map(str.isupper, text)), sum(map(str.islower, text))
    assert quality.shouted(text) == quality.shouted(text * times) == up / max(1, up + low)


def test_filter_on_awkward_rows(docs):
    good = " ".join(f"wordy{i}" for i in range(60)).replace("0", "a").replace("1", "b")
    df = docs([None, "", "short", good, good, "spam " * 200, "x" * 100_000])
    out = quality.filter_quality(df)
    assert out.columns == df.columns
    got = {r.doc_id for r in out.collect()}
    assert {3, 4} <= got and not {0, 1, 5} & got  # without words; one word over and over
    assert quality.filter_quality(df.limit(0)).count() == 0
    clash = df.withColumnRenamed("lang", "quality").withColumnRenamed("secrets", "Quality_")
    assert quality.filter_quality(clash).columns == clash.columns


# ---- mix ----


def plain_targets(sizes):
    """Raise the common level until the budget is spent: the fixed point of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high, budget = 0.0, 2.0 * sum(sizes.values()) + 1, 1.5 * sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(weight[s] * mid, 2 * sizes[s]) for s in sizes) < budget else (low, mid)
    return {s: min(weight[s] * high, 2 * sizes[s]) for s in sizes}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abé", max_size=2)), st.integers(0, 10_000), min_size=1, max_size=8))
def test_plain_targets_spend_the_budget(sizes):
    want = plain_targets(sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=1e-6, abs=1e-3)


@pytest.mark.parametrize("sizes", [{None: 5, "a": 0}, {"a": 10, "b": 10_000, "é": 3, None: 700}, {"a": 0}, {f"s{i:04d}": (i * i * 37) % 5000 for i in range(2000)}])
def test_targets(spark, sizes):
    got = {r.source: (r.source_size, r.target) for r in mix.targets(spark.createDataFrame(list(sizes.items()), "source string, n long")).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(sizes) and all(got[s] == (sizes[s], pytest.approx(want[s], rel=1e-6, abs=1e-6)) for s in sizes)


def check_mix(rows, texts):
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id][0] or ""))
        sizes[texts[r.doc_id][1]] += r.size
    want, taken, largest = plain_targets(sizes), defaultdict(int), max(r.size for r in rows)
    for r in rows:
        source = texts[r.doc_id][1]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source]) and r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest + 0.03 * want[s]


def test_mix_query(spark):
    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_mix_sources(spark, SF).collect()
    assert len(rows) == len(texts)
    check_mix(rows, texts)
    assert sorted(rows) == sorted(op5_mix_sources(spark, SF).collect())


def test_cut_is_that_of_a_full_sort(spark, docs):
    df = docs(["w " * (i % 17) for i in range(300)])
    p = mix.plan(df)
    copies = sorted(((r.upto + e * r.source_size) / r.target, r.rank, e, r.size) for r in p.rows.collect() if r["size"] for e in (0, 1) if r.target)
    total, budget = 0, 1.5 * sum(r["size"] for r in p.rows.collect())
    for *key, size in copies:
        if total + size > budget:
            break
        total, last = total + size, tuple(key)
    assert p.last == last


def test_mix_of_awkward_rows(docs):
    df = docs([None, "", "a b c", "a b c", "d " * 1000, *["e f"] * 30])
    out = mix.mix(df)
    assert out.columns == df.columns and not {0, 1} & {r.doc_id for r in out.collect()}
    count = Counter(r.doc_id for r in out.collect())
    taken = {r.doc_id: r.n for r in (lambda p: p.rows.withColumn("n", p.taken()))(mix.plan(df)).collect()}
    assert {d: n for d, n in taken.items() if n} == count and max(count.values()) <= 2
    order = [r.finish for r in mix.ordered(mix.plan(df)).collect()]
    assert order == sorted(order) and len(order) == sum(count.values())
    assert mix.mix(df.limit(0)).count() == 0 and mix.plan(docs([None, ""])).last is None


# ---- pipeline ----


def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "source_mix", "token_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after[name] = [r.doc_id for r in docs.collect()]
    kept = {r.doc_id for r in op10_quality_rules(spark, SF).filter(f"n_words > 0 AND p_good >= {quality.THRESHOLD}").collect()}
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(kept & labels) >= 0.98 * len(labels)
    assert set(after["quality_rules"]) == kept and len(after["quality_rules"]) == len(kept)
    near = ngrams.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet").filter(f"doc_id IN ({','.join(map(str, kept))})")).collect()
    assert set(after["near_duplicates"]) == {r.component_id for r in near} and len(after["near_duplicates"]) == len(set(after["near_duplicates"]))
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d in after["near_duplicates"] for w in items if f" {' '.join(w)} " in f" {' '.join(decontam.words_of(texts[d]))} "}
    assert leaked and not leaked & set(after["benchmark_decontamination"])
    assert set(after["near_duplicates"]) - leaked == set(after["benchmark_decontamination"])
    last = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(after["source_mix"])


def test_run(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
