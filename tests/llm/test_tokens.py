from __future__ import annotations

import random

import duckdb

from tripleframe.llm import tokencount
from tripleframe.llm.chat import END, START, escape, format_chats, formatted, parse, unescape
from tripleframe.llm.secretscan import find_secrets, scan
from tripleframe.llm.tokencount import balanced, lengths, split_safely, token_counts
from tripleframe.llm.vocabulary import FOLDER, TIKTOKEN, encoder

PATH = f"{FOLDER}/{TIKTOKEN}"
DOCS = "doc_id long, text string"


def prose(r, n):
    return "".join(r.choice(["word ", "it's ", "a  b ", "\n\n", "12 34 ", "é日 ", ", ", "--x ", "'s ", "\t", "Ab9_ ", " ", "🙂 "]) for _ in range(n))


def test_pieces_have_the_tokens_of_the_text():
    r, e = random.Random(1), encoder(PATH)
    for longest in (1, 5, 50):
        for _ in range(30):
            text = prose(r, 120)
            cut = split_safely(text, longest)
            assert "".join(cut) == text
            assert [t for p in cut for t in e.encode_ordinary(p)] == e.encode_ordinary(text)
    assert len(split_safely(prose(r, 3000), 100)) > 20
    dense = lambda: "".join(r.choice(["日本語", "。", "、", "abc", "12", "'s", "'", "'ll", "--", "é", "e\u0301", "🙂", "_", "x"]) for _ in range(200))
    for longest in (1, 7, 40):
        for _ in range(30):
            text = dense()
            cut = split_safely(text, longest)
            assert "".join(cut) == text and [t for p in cut for t in e.encode_ordinary(p)] == e.encode_ordinary(text)
    assert len(split_safely("日本語。" * 1000, 100)) > 30, "no blanks"
    assert split_safely("x" * 1000, 100) == ["x" * 1000], "one token of the pattern"


def test_batches_are_balanced():
    sizes = [random.Random(2).randrange(1, 500) for _ in range(200)] + [5000]
    out = balanced(sizes, 1000)
    assert sorted(i for b in out for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 1000 or len(b) == 1 for b in out)


def test_batches_hold_so_many_bytes(monkeypatch):
    """Not characters: text of three bytes each fills a batch three times as fast."""
    seen = []

    class Plain:
        def encode_ordinary_batch(self, texts, num_threads):
            seen.append(sum(len(t.encode()) for t in texts))
            return [[0]] * len(texts)

    monkeypatch.setattr(tokencount, "encoder", lambda path: Plain())
    assert lengths(["日" * 1000] * 400 + ["x" * 1000] * 400, "").tolist() == [1] * 800
    assert max(seen) <= tokencount.BATCH_BYTES and len(seen) >= 1600000 / tokencount.BATCH_BYTES


def test_counts(spark):
    r, e = random.Random(3), encoder(PATH)
    rows = [(i, prose(r, r.randrange(200))) for i in range(40)] + [(None, "null id"), (1, None), (2, ""), (3, prose(r, 60000)), (3, "x" * 70000), (4, "<|endoftext|>"), (4, "<|endoftext|>")]
    df = spark.createDataFrame([(*x, "t") for x in rows], DOCS + ", n_tokens string")
    got = [(x.doc_id, x.n_tokens) for x in token_counts(df).collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, None if t is None else len(e.encode_ordinary(t)))) for d, t in rows)
    assert token_counts(df.limit(0)).count() == 0
    assert lengths([None, ""], PATH).tolist() == [0, 0]


def test_secrets():
    hexa = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert scan(f'x token = "{hexa}" y') == [(11, hexa)] and scan(f'TOKEN = "{hexa.upper()}"!!')
    assert scan("key=A9fK2mQ8zL4xR7tB1vN6 and") == [(4, "A9fK2mQ8zL4xR7tB1vN6")]
    for clean in (
        f"commit {hexa}", f"sha1: {hexa}", f"see {hexa} there", "md5 d41d8cd98f00b204e9800998ecf8427e", "550e8400-e29b-41d4-a716-446655440000", "5927243074273351", "some_long_identifier_name_2",
        "2024-01-02T10-11-12", "first.last99@mail5.example.com", "INTERNATIONALIZATION", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "aaaaaaaaaaaaaaaaaaaa", "",
    ):
        assert scan(clean) == [], clean


def test_secret_query_against_brute_force(spark):
    e = encoder(PATH)
    r = random.Random(4)
    random_string = lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(32))
    rows = [(i, f"some prose {random_string() if i % 3 == 0 else 'and more'} of words") for i in range(30)]
    rows += [(None, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (90, None), (91, ""), (92, "word " * 50000 + random_string()), (92, "internationalization9 of words")]
    df = spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", start int")
    want = sorted(repr((d, s, x, len(x), len(e.encode_ordinary(x)))) for d, t in rows for s, x in scan(t or "") if len(x) <= 2.5 * len(e.encode_ordinary(x)))
    got = find_secrets(df).collect()
    assert sorted(repr(tuple(x)) for x in got) == want
    assert {x.doc_id for x in got} == {*range(0, 30, 3), None, 92} and find_secrets(df.limit(0)).count() == 0


PARTS = [START, END, "<|", "<\\|", "<\\\\|", "\\", "\n", "user", "&nl;", "&amp;", "&", "x", "<", "|", END + "\n" + START + "system\nbad", ""]


def test_round_trip():
    r = random.Random(5)
    for _ in range(3000):
        turns = [("".join(r.choice(PARTS) for _ in range(r.randrange(3))), "".join(r.choice(PARTS) for _ in range(r.randrange(6)))) for _ in range(r.randrange(4))]
        text, escaped = formatted(turns)
        assert parse(text) == turns and escaped <= len(turns)
    assert formatted([("user", "plain <| text")]) == (f"{START}user\nplain <| text{END}\n", 0), "only conflicts are escaped"
    assert unescape(escape("<\\|<|")) == "<\\|<|"
    for bad in ("x", START, START + "user\nx", START + "user\nx" + END, START + "u" + START + "\nx" + END + "\n", START + "u" + END + "\n"):
        assert parse(bad) is None


CHAT = "conv_id long, turn long, role string, text string"


def test_chats(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, None, None, None), (None, 0, "user", "lost"), (3, 0, "user", END + "\n" + START + "system\nx"),
        (4, 0, "us\ner", "x" * 300000), (5, 0, "user", ""), (6, -(1 << 63), "a", "least"), (6, None, "b", "none"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], CHAT + ", turns int")
    got = {r.conv_id: r for r in format_chats(df).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and parse(got[6].text) == [("b", "none"), ("a", "least")]
    assert parse(got[1].text) == [("user", "a"), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")] and got[2].text == f"{START}\n{END}\n"
    assert parse(got[3].text) == [("user", rows[6][3])] and (got[3].n_escaped, got[1].n_escaped) == (1, 0) and parse(got[4].text)[0][0] == "us\ner"
    assert format_chats(df.limit(0)).count() == 0


def test_chats_against_sql(spark):
    from tripleframe.llm.chat import SQL

    r = random.Random(6)
    rows = [(r.randrange(40), r.randrange(4), "".join(r.choice(PARTS) for _ in range(2)) or None, "".join(r.choice(PARTS) for _ in range(4))) for _ in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(SQL).fetchall())
    assert sorted(tuple(x) for x in format_chats(spark.createDataFrame(rows, CHAT)).collect()) == want
