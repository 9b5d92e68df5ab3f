"""The rules' automaton next to Python's own pattern matching."""

import random
import re

import pytest

import odd_rows
from siftmark.llm import secret_scan
from siftmark.llm.automaton import compile_rules

#: (kind, pattern as in the contract, which matches count)
PLAIN = [
    ("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", rb"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ("github", rb"gh[pousr]_[A-Za-z0-9]+", lambda m: len(m[0]) >= 40),
    ("slack", rb"xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m[0]) >= 15),
    ("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: len(m[0].rpartition(b".")[2]) >= 8),
    ("pem", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", lambda m: True),
]
PARTS = [
    b"password", b"PassWd", b"secret", b"toke", b"token", b"api", b"_", b"key", b"=", b":", b" ", b"'", b'"', b"AKIA",
    b"AKI", b"ABC1", b"deadbeef", b"0123456789abcdef", b"ghp_", b"xoxb-", b"eyJ", b".", b"abcdefghij",
    b"-----BEGIN ", b"RSA ", b"PRIVATE KEY-----", b"\xc3\xa9", b"zz", b"x1",
]


def plainly(data):
    return sorted(
        (m.start(), k, m.end()) for k, (_, p, good) in enumerate(PLAIN) for m in re.finditer(p, data) if good(m)
    )


@pytest.fixture(scope="module")
def scanner():
    rules = secret_scan.BASE + secret_scan.MORE
    return secret_scan.Scanner(rules, secret_scan.compiled(rules))


def test_spans_of_random_texts(scanner):
    rng = random.Random(1)
    for _ in range(6000):
        data = b"".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        assert scanner.spans(data) == plainly(data), data


def test_a_short_match_hides_what_is_inside(scanner):
    assert scanner.spans(b"secret=token:abcdefgh") == []
    assert scanner.spans(b"token=secret=abc") == [(0, 0, 16)]


@pytest.mark.parametrize("pattern", [rb"a(b|cd)*e?", rb"[^a]b{2,3}", rb"(ab|a)c+.", rb"x?y{2}(z|[0-9]{1,2})"])
def test_minimal_automaton_accepts_what_the_pattern_does(pattern):
    moves, accepted = compile_rules([pattern])
    rng = random.Random(4)
    for _ in range(3000):
        data = bytes(rng.choice(b"abcdexyz01") for _ in range(rng.randint(0, 7)))
        state = 0
        for byte in data:
            state = moves[state][byte] if state >= 0 else state
        assert (state >= 0 and bool(accepted[state])) == bool(re.fullmatch(pattern, data, re.S))
    rows = [(tuple(m), a) for m, a in zip(moves, accepted)]
    assert len(set(rows)) == len(rows)


def test_odd_rows(spark):
    found = secret_scan.secret_spans(odd_rows.frame(spark)).collect()
    want = []
    for i, text, *_ in odd_rows.rows():
        data = (text or "").encode()
        points = [(PLAIN[k][0], len(data[:s].decode()), len(data[:e].decode())) for s, k, e in plainly(data)]
        want.append((i, points))
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in found), key=repr) == sorted(want, key=repr)
    assert any(p for _, p in want)
    assert secret_scan.secret_spans(odd_rows.empty(spark)).collect() == []
