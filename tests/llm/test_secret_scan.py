from __future__ import annotations

import hashlib
import random
import re

from diffmill.llm import secret_scan as s

KEY = "AKI" + "A" + "Q7" * 8
FORTY = "aB3" * 13 + "x"


def brute(text):
    """The base rules as stated, run as they are."""
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort()
    return [sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")], ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_base_spans_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdefgh", "short", "tokentoken=", KEY, "AKIA", "0123456789abcdef", "f" * 31, "\n", "é", "ſecret=abcdefgh", "\U0001f600", "g", "toKen=abcdefghi"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([1, 4, 12, 60])))) for i in range(300)]
    rows += [(900, None), (901, ""), (901, ""), (None, f"token={KEY}"), (902, "a" * 200_000), (903, "secret=abcdefgh1 " * 5000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, spans int")
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in s.secret_scan(docs).collect()), key=str)
    want = sorted(((i, *brute(t)[0], hashlib.sha256(brute(t)[1].encode()).hexdigest()) for i, t in rows), key=str)
    assert got == want
    base = {(r.doc_id): r.spans for r in s.secret_scan(docs).collect()}
    for i, t in rows[:300]:
        own = brute(t)[1]
        assert set(filter(None, own.split(","))) <= set(base[i].split(","))


def found(text):
    base = s.base_spans(text)
    return s.linked(base, s.weak_spans(text, base))


def test_weak_parts_need_their_complement():
    assert found(f"x {FORTY} y") == []
    assert found("see https://db.example.com:5432/x") == []
    assert found("login: alice1") == []
    assert [k for k, _, _ in found(f"{KEY} {FORTY}")] == ["weak_secret"]
    assert [k for k, _, _ in found(f"client_id = abc123 then {FORTY} at https://db.example.com")] == ["weak_access", "weak_secret", "weak_endpoint"]
    assert [k for k, _, _ in found("username=alice password=abcdefgh9")] == ["weak_access"]
    assert found(f"{KEY}{' ' * (s.WINDOW + 1)}{FORTY}") == []
    assert len(found(f"{KEY}{' ' * s.WINDOW}{FORTY}")) == 1


def test_links_against_all_pairs():
    rng = random.Random(4)
    for _ in range(60):
        parts = [(rng.choice(s.KINDS), a := rng.randrange(5000), a + rng.randrange(1, 60)) for _ in range(rng.randrange(1, 40))]
        base = [p for p in parts if p[0] in s.KINDS[:3]]
        weak = [p for p in parts if p[0] not in s.KINDS[:3]]
        near = lambda p, kinds: any(q[0] in kinds and q[1] <= p[2] + s.WINDOW and q[2] >= p[1] - s.WINDOW for q in parts)
        assert s.linked(base, weak) == [p for p in weak if all(near(p, group) for group in s.NEEDS[p[0]])]


def test_no_rows(spark):
    assert s.secret_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_secrets_right_after_an_equals_sign_and_of_other_lengths():
    for form in ("AWS_SECRET_ACCESS_KEY={}", "secret_key={}", "https://h.example.com/?x=1&sig={}&y", 'KEY="{}"', "KEY: {}"):
        for size in (32, 40, 43, 64, 88, 3000):
            value = ("aB3x/" * size)[:size]
            text = f"AWS_ACCESS_KEY_ID={KEY}\n{form.format(value)}\nend"
            assert [text[a:b] for k, a, b in found(text) if k == "weak_secret"] == [value], (form, size)
    for value in ("aB3x/" * 6, "ab3x/" * 8, "AB3X/" * 8, "aBcx/" * 8):  # too short, or without one kind of character
        assert not [k for k, _, _ in found(f"{KEY}\nKEY={value}") if k == "weak_secret"]
    padded = "aB3x" * 21 + "ab=="
    assert [b - a for k, a, b in found(f"{KEY}\nKEY={padded}") if k == "weak_secret"] == [88]
    assert [k for k, _, _ in found(f"AWS_ACCESS_KEY_ID={KEY}\nAWS_SECRET_ACCESS_KEY={FORTY}\nhttps://s.example.com/x")] == ["weak_secret", "weak_endpoint"]


def test_weak_parts_inside_a_base_span_of_many_others():
    runs = "0123456789abcdef" * 2
    inner = "=".join([runs] * 4 + ["aB3x" * 8])
    text = f"{KEY} secret={inner}"
    assert [k for k, _, _ in s.base_spans(text)] == ["assign", "access", *["hex"] * 4]
    assert found(text) == []


def test_one_very_long_run_keeps_linking_linear():
    text = "f" * 2_000_000 + " " + f"login=alice{' ' * 900}x " * 3_000
    assert len(found(text)) == 1 and found(text)[0][0] == "weak_access"
