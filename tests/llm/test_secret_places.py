"""Secrets after dots and slashes, before '@', and without digits."""

from __future__ import annotations

import random
import string

from tripleframe.llm.secretscan import find_secrets, scan
from tripleframe.llm.vocabulary import FOLDER, TIKTOKEN, encoder


def drawn(r, n, letters=string.ascii_letters + string.digits):
    return "".join(r.choice(letters) for _ in range(n))


def test_secrets_in_their_places(spark):
    r = random.Random(31)
    a, b, mixed = drawn(r, 22), drawn(r, 43), drawn(r, 32, string.ascii_letters)
    texts = {
        f"key SG.{a}.{b} end": [a, b],
        f"post to https://hooks.slack.com/services/T{drawn(r, 8)}/B{drawn(r, 8)}/{a}2": [a + "2"],
        f"http://localhost/hook/{b}": [b],
        f"postgres://admin:{a}@db.example.com/base": [a],
        f"postgres://admin:{a}@localhost:5432/base": [a],
        f"key={mixed} and": [mixed],
        f"write to {a}@example.com or first.{b}@mail.example.org.": [],
        "see http://www.example.com/some/internationalization/pages and file.internationalization": [],
    }
    for text, want in texts.items():
        got = scan(text)
        assert [s for _, s in got] == want and all(text[i : i + len(s)] == s for i, s in got), text
    df = spark.createDataFrame(list(enumerate([*texts, "getElementsByClassNameAndTitle"])), "doc_id long, text string")
    assert sorted((x.doc_id, x.secret) for x in find_secrets(df).collect()) == sorted((i, s) for i, want in enumerate(texts.values()) for s in want)


def plain_scan(text):
    """Strings of the alphabets by walking over the characters, without the operator's expressions."""
    letters = set(string.ascii_letters + string.digits + "+/_-")
    inside = lambda k: 0 <= k < len(text) and text[k] in letters
    out, i = [], 0
    while i < len(text):
        if not inside(i):
            i += 1
            continue
        j = i
        while inside(j):
            j += 1
        end = j
        while end < len(text) and text[end] == "=" and end < j + 2:
            end += 1
        run = text[i:end]
        path = "/" in run and (run.startswith("//") or text[i - 1 : i] == ".")
        parts, at = [], i
        for part in run.split("/") if path else [run]:
            parts.append((at, part))
            at += len(part) + 1
        if text[i - 1 : i] != "@":
            out += [(a, p) for a, p in parts if len(p.rstrip("=")) >= 12]
        i = j
    return [(a, p) for a, p in out if not plainly_known(text, a, p)]


def plainly_known(text, start, s):
    s = s.rstrip("=")
    if not any(c.isalpha() for c in s):
        return True
    hexa = set(s) <= set("0123456789abcdef") or set(s) <= set("0123456789ABCDEF")
    if hexa and len(s) in (32, 40, 56, 64, 96, 128):
        return not text[:start].rstrip(" =:").endswith("token") or text[:start].endswith("token")
    pieces_ = s.replace("/", "-").replace("_", "-").split("-")
    if [len(p) for p in pieces_] == [8, 4, 4, 4, 12] and all(c in string.hexdigits for p in pieces_ for c in p):
        return True
    plain = lambda p: p.rstrip(string.digits)
    return all(len(p) - len(plain(p)) <= 4 and (plain(p) == "" or plain(p).islower() or plain(p)[1:].islower() or (plain(p).isupper() and p == plain(p))) and plain(p).isalpha() | (plain(p) == "") for p in pieces_)


def test_against_a_plain_walk(spark):
    e = encoder(f"{FOLDER}/{TIKTOKEN}")
    r = random.Random(8)
    near = ["getElementsByClassNameAndTitle", "internationalization2024Configuration", "some_long_identifier_name_2", "550e8400-e29b-41d4-a716-446655440000", "UPPERCASEWORDS", "20240102-101112", "weltanschauungen", "the-cat-sat-on-the-mat"]
    rows = []
    for i in range(300):
        what = [r.choice([drawn(r, r.randrange(8, 50)), drawn(r, 40, "0123456789abcdef"), drawn(r, 20, string.ascii_letters), r.choice(near), "plain", "words"]) for _ in range(5)]
        rows.append((i, r.choice(["", "see "]) + " ".join(f"{r.choice(['token = ', 'hash: ', '(', '', 'x.', 'https://ab.io/p/'])}{w}{r.choice(['', ')', ',', '.', '=='])}" for w in what)))
    want = sorted((d, a, s) for d, t in rows for a, s in plain_scan(t) if len(s) <= 2.5 * len(e.encode_ordinary(s)))
    got = sorted((x.doc_id, x.start, x.secret) for x in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and len(want) > 300


def test_the_ratio_decides():
    e = encoder(f"{FOLDER}/{TIKTOKEN}")
    r = random.Random(9)
    ratio = lambda s: len(s) / len(e.encode_ordinary(s))
    words = ["getElementsByClassNameAndTitle", "internationalization2024Configuration", "defaultConnectionTimeoutMillis", "OrderLineItem2Controller"]
    assert all([s for _, s in scan(w)] == [w] for w in words), "these are candidates"
    assert min(map(ratio, words)) > 2.5 > max(ratio(drawn(r, n)) for n in range(15, 60) for _ in range(20))


def test_secrets_of_the_review(spark):
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    want = {
        "kQzXvBnMwErTyUiOpLkJhGfDsAaZ": ["kQzXvBnMwErTyUiOpLkJhGfDsAaZ"], "sk_live.A9fK2mQ8zL4xR7tB1vN6": ["A9fK2mQ8zL4xR7tB1vN6"],
        "https://x.io/A9fK2mQ8zL4xR7tB1vN6": ["A9fK2mQ8zL4xR7tB1vN6"], "hash: A9fK2mQ8zL4xR7tB1vN6Qq": ["A9fK2mQ8zL4xR7tB1vN6Qq"], "key A9fK2mQ8zL4xR7t": ["A9fK2mQ8zL4xR7t"],
        "password:" + " " * 300 + "04dbebab91ab85687d33eeaaf9ac699e1188f962": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
    }
    df = spark.createDataFrame([*enumerate(want), (99, jwt)], "doc_id long, text string")
    got = [(x.doc_id, x.secret) for x in find_secrets(df).collect()]
    assert [g for g in got if g[0] != 99] == [(i, s) for i, own in enumerate(want.values()) for s in own]
    assert {s for d, s in got if d == 99} >= set(jwt.split(".")[1:]), "payload and signature"
