"""Secret scans: strings of few characters a token."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tripleframe.llm.common import pick, slices
from tripleframe.llm.vocabulary import FOLDER, TIKTOKEN, encoder

LEAST = 12
#: runs of the alphabets that are more than one word in lower case or with a capital
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_@-])(?![A-Z]?[a-z]+(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
#: what can be a part of an address, whole: a local part and a host with a dot
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGESTS = {32, 40, 56, 64, 96, 128}
#: names of what is a credential, although it has a digest's form
NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|credential|auth\w*|bearer|(?:api|access|private|signing)[_-]?key)", re.IGNORECASE)
KNOWN = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|\d{4}-\d\d-\d\d(?:[T_-][\d-]*)?Z?"  # date
    r"|(?:sha(?:1|224|256|384|512)|md5)-[A-Za-z0-9+/_-]+"  # subresource integrity
    r"|(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+\d{0,4})(?:[_/-](?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+)?\d{0,4})*"  # words
)


def name_before(text: str, start: int) -> str:
    """The word to which what begins at `start` is assigned, or which it follows."""
    j = start
    while j and (text[j - 1].isspace() or text[j - 1] in "\"':=>"):
        j -= 1
    k = j
    while k and (text[k - 1].isalnum() or text[k - 1] in "_-"):
        k -= 1
    return text[k:j]


def excluded(text: str, start: int, string: str) -> bool:
    """Whether the string has the form of an identifier, or of a digest that is no credential by its name."""
    if not any(c.isalpha() for c in string):
        return True
    bare = string.rstrip("=")
    if HEX.fullmatch(bare) and len(bare) in DIGESTS:
        return not NAMED.search(name_before(text, start))
    return bool(KNOWN.fullmatch(bare))


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """Runs of the alphabets; of a run in an address with a dotted host or after "//", the parts between slashes."""
    for m in CANDIDATE.finditer(text):
        start, string = m.start(), m.group()
        if "/" in string and (string.startswith("//") or text[max(0, start - 1) : start] == "."):
            for part in re.finditer(r"[^/]+", string):
                if len(part.group().rstrip("=")) >= LEAST:
                    yield start + part.start(), part.group()
        else:
            yield start, string


def _login(text: str, start: int) -> bool:
    """Whether scheme://user: stands before, up to the last blank."""
    k = start
    while k and not text[k - 1].isspace():
        k -= 1
    scheme, sign, rest = text[k:start].rpartition("://")
    return bool(sign) and ":" in rest and "@" not in rest and "/" not in rest.partition(":")[0]


def addresses(text: str) -> list[tuple[int, int]]:
    """Where e-mail addresses are; the password of scheme://user:password@host is none."""
    if "@" not in text:
        return []
    return [m.span() for m in ADDRESS.finditer(text) if not _login(text, m.start())]


def scan(text: str) -> list[tuple[int, str]]:
    out, spans, k = [], addresses(text), 0
    for start, string in candidates(text):
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        inside = k < len(spans) and spans[k][0] < start + len(string)
        if not inside and not excluded(text, start, string):
            out.append((start, string))
    return out


def find_secrets(docs: DataFrame, max_ratio: float = 2.5, vocabulary: str = f"{FOLDER}/{TIKTOKEN}") -> DataFrame:
    """(doc_id, start, secret, n_chars, n_tokens): strings that look random to a tiktoken vocabulary.

    Candidates are runs of 12 or more characters of the alphabets of base64, base64url and hex, wherever they stand: in
    quotes, after a name, after dots (each part of a dotted token on its own), in a path, before a host. Of a path after
    a dotted host or "//" each part is a candidate. Excluded are, by their form, digests (hex of a known length, unless
    the word before it names a credential) and identifiers: UUIDs, dates, numbers, subresource integrity, words joined
    by signs, words with a number of up to four digits, e-mail addresses. What is left is a secret if it has at most
    `max_ratio` characters a token. `start` is a character of the text.

    Null texts, empty texts and empty tables yield nothing. Rows keep their doc_id, null or not; a row given twice is
    reported twice. Texts are scanned whole, whatever their length. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                rows = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for start, string in scan(text) if text else ():
                        tokens = len(encode.encode_ordinary(string))
                        if len(string) <= max_ratio * tokens:
                            rows.append((i, start, string, len(string), tokens))
                if rows:
                    i, *rest = zip(*rows)
                    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(i)), *map(pa.array, rest, kinds)], ["doc_id", "start", "secret", "n_chars", "n_tokens"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, start int, secret string, n_chars int, n_tokens int")
