"""Secrets and personal data against plain regular expressions."""

import hashlib
import math
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tracklake.llm import pii, secrets
from tracklake.llm.queries import op1_secret_scan, op9_pii

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def plain_pii(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(s):
        d = digits(s)[::-1]
        return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if luhn(m[0])]
    return sorted(out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15])


PIECES = ["token", "SECRET", "api_key", "=", ": ", '"', " ", "abc123", "AKIA", "ABCDEF0123456789", "deadbeef" * 2, "f00", "é", "\n", "ſecret", "K"]
PII = ["a", "b.c", "@", ".", "x-y", "4111 1111", "4111111111111111", "-", " ", "+1 (5", "5) 555", "0123", "255", "256", "é", "\n", "1.2.3.4"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_secrets(text):
    assert secrets.base_spans(text) == plain_secrets(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PII), max_size=14).map("".join))
def test_base_pii(text):
    assert sorted(pii.base_spans(text)) == plain_pii(text)


@given(st.text("abcABC012", min_size=5, max_size=40))
def test_window_entropy(s):
    want = []
    for i in range(len(s) - 4):
        w = s[i : i + 5]
        want.append(-sum(w.count(c) / 5 * math.log2(w.count(c) / 5) for c in set(w)))
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(secrets.window_entropy(s, 5), want, strict=True))


def test_entropy_finds_keys_and_spares_texts():
    key = "q9ZtR4vLx8KpW2mNc7Bd"
    assert secrets.entropy_spans(f"use {key} here") == [(4, 24)]
    for text in ("mentementemente mentementementeciónmente", "123e4567-e89b-12d3-a456-426614174000", "2024-01-01T00:00:00+00:00 2024", "your_api_key_example_0a1B2c3D4e5F6g7H", "A" * 500, "HTHEONANDHETHEINGTHETION"):
        assert secrets.entropy_spans(text) == [], text


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83WEST12345698765432")
    _, spans = pii.scan("pay to IBAN GB82 WEST 1234 5698 7654 32 now")
    assert [(pii.KINDS[k], s) for k, _, _, s in spans] == [("iban", 1.0)]
    assert [pii.KINDS[k] for k, *_ in pii.scan("my social security number 078-05-1120")[1]] == ["ssn"]
    assert pii.scan("order 078-05-1120")[1] == []


def plain_entropy_spans(text):
    """Windows one by one: entropy by counting each anew, each test by its words."""
    taken = set()
    for name, (pattern, width, least) in secrets.CLASSES.items():
        for m in pattern.finditer(text):
            for i in range(m.start(), m.end() - width + 1):
                w = text[i : i + width]
                bits = -sum(w.count(c) / width * math.log2(w.count(c) / width) for c in set(w))
                if bits < least - 1e-12 or any(x.start() < i + width and x.end() > i for x in secrets.ALLOW.finditer(text)):
                    continue
                switches = sum(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in zip(w, w[1:]))
                if w.isdigit() or (not any(c.isdigit() for c in w) and (name == "hex" or switches < secrets.SWITCHES * (width - 1) or min(sum(map(str.isupper, w)), sum(map(str.islower, w))) < secrets.SWITCHES * width)):
                    continue
                taken |= set(range(i, i + width))
    return taken


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["q9ZtR4vLx8", "KpW2mNc7Bd", "abcdef0123", "QwErTyUiOp", "wordsalone", "-", " ", "example", "2024-01-02", "aG5kLmPqXz", "/", "77"]), max_size=8).map("".join))
def test_entropy_spans_are_those_of_brute_force(text):
    got = secrets.entropy_spans(text)
    assert {i for a, b in got for i in range(a, b)} == plain_entropy_spans(text) and got == sorted(got)


def test_allow_list_is_by_span():
    key, letters = "q9ZtR4vLx8KpW2mNc7Bd", "qXzRtBvLxKpWgmNcJyBdHs"
    assert [b - a for a, b in secrets.entropy_spans(f"use {letters} here")] == [22]
    assert secrets.entropy_spans("use SomeCamelCaseNameOfManyWords or someverylongplainwordalone") == []
    assert secrets.entropy_spans(f"see example_{key}") == [(12, 32)] and secrets.entropy_spans("see example_q9ZtR4vLx8Kp") == []


def test_recall_by_kind():
    """Planted personal data of each kind in plain text, with and without a word beside it."""
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    def iban():
        body = "DE" + "%02d", digits(18)
        return next(x for k in range(2, 99) if pii.mod97(x := body[0] % k + body[1]))

    made = {
        "email": lambda: f"u{digits(3)}@mail.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": card, "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "iban": iban, "ssn": lambda: f"SSN {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "credential": lambda: f'token = "{rng.randbytes(20).hex()}"',
    }
    for kind, one in made.items():
        texts = [f"some words before {one()} and after" for _ in range(200)]
        assert sum(any(pii.KINDS[k] == kind and s >= 0.5 for k, _, _, s in pii.scan(t)[1]) for t in texts) >= 196, kind
    clean = ["plain words 98079157628 and 3.14 or 12-34-56", "hash da39a3ee5e6b4b0d3255bfef95601890afd80709 of a file", "in 2024-01-01 there were 100,000"]
    assert all(not pii.scan(t)[1] for t in clean)


def test_time_grows_with_the_text():
    """Twice the text takes about twice the time, also where every place could be a span."""
    def took(f, text):
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            f(text)
            best = min(best, time.perf_counter() - start)
        return best

    for f, piece in ((pii.scan, "1.2.3.4 078-05-1120 "), (secrets.scan, "token=abcdefgh q9ZtR4vLx8KpW2mNc7Bd "), (pii.scan, "GB82 WEST 1234 5698 7654 32 a@b.co "), (secrets.scan, "q9ZtR4vLx8KpW2mNc7Bd")):
        assert took(f, piece * 8000) < 3.5 * took(f, piece * 4000) + 0.05, piece


def test_long_texts_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1.1." * 50_000, "+1(" * 50_000, "token=" * 30_000, "AKIA" * 50_000):
        secrets.scan(text)
        pii.scan(text)


def test_operators_on_awkward_rows(docs):
    df = docs([None, "", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "x" * 300_000, "mail a@b.co", "mail a@b.co"])
    out = secrets.scan_secrets(df)
    assert out.columns == df.columns
    got = [r.secrets.asDict() for r in out.orderBy("doc_id").collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0]["base_sha256"] == got[1]["base_sha256"] == empty and got[0]["spans"] == ""
    assert (got[2]["n_assign"], got[2]["n_hex"], got[2]["spans"]) == (1, 1, "assign:0:49,hex:9:49")
    found = [r.pii for r in pii.scan_pii(df).orderBy("doc_id").collect()]
    assert found[4] == found[5] and found[4].spans == "email:5:11" and found[0].spans == ""
    assert secrets.scan_secrets(df.limit(0)).count() == pii.scan_pii(df.limit(0)).count() == 0


def test_queries_cover_every_document(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_secret_scan(spark, sf).collect():
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in plain_secrets(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) - {""} <= set(r.spans.split(","))
    rows = op9_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain_pii(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
