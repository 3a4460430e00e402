"""Chat formatting: render, reparse, and escape until the turns come back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import pick

START, END = "<|im_start|>", "<|im_end|>"
MARK = re.compile(r"<(\\*)\|")
MARKED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One more backslash between each < and |."""
    return MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("&", "&amp;").replace("\n", "&nl;")


def unescape_role(role: str) -> str:
    return unescape(role.replace("&nl;", "\n").replace("&amp;", "&"))


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{role}\n{text}{END}\n" for role, text in turns)


def parse(text: str) -> list[tuple[str, str]] | None:
    """turn: START role NL content END NL; role has no NL, neither has a marker. None where the text is no such list."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            return None
        at += len(START)
        line = text.find("\n", at)
        end = text.find(END, at)
        if line < 0 or end < line:
            return None
        role, content = text[at:line], text[line + 1 : end]
        if START in role or START in content or not text.startswith("\n", end + len(END)):
            return None
        out.append((unescape_role(role), unescape(content)))
        at = end + len(END) + 1
    return out


def formatted(turns: list[tuple[str, str]]) -> tuple[str, int]:
    """The rendered turns, and how many are escaped: those that do not come back from a parse of them alone."""
    shown, escaped = [], 0
    for role, text in turns:
        if parse(render([(role, text)])) == [(role, text)]:
            shown.append((role, text))
        else:
            # the role alone, the text alone, then both
            for r, t in ((escape_role(role), text), (role, escape(text)), (escape_role(role), escape(text))):
                if parse(render([(r, t)])) == [(role, text)]:
                    break
            shown.append((r, t))
            escaped += 1
    out = render(shown)
    if parse(out) != turns:
        raise AssertionError("a rendered conversation does not parse to its turns")
    return out, escaped


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_escaped, text): each conversation in ChatML, which parses back to exactly its turns.

    Turns are in order of turn, ties by role, then text; a turn given twice is there twice. Each turn is rendered,
    reparsed by the grammar and compared; content that would not come back (markers, or escapes of them) is escaped
    until it does: a backslash goes into each "<|" of it. The whole rendering is parsed and compared once more.

    A null role is "", a null text is "", a null turn comes first. Rows without conv_id are left out; an empty table
    yields nothing. Very long texts are turns as others are. Other columns are ignored; of two that differ in case only,
    the last counts.
    """
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null").na.fill("", ["role", "text"])
    grouped = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("said"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                done = [([(t["role"], t["text"]) for t in turns]) for turns in part.column("turns").to_pylist()]
                text, escaped = zip(*map(formatted, done))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([len(d) for d in done], pa.int32()), pa.array(escaped, pa.int32()), pa.array(text)], ["conv_id", "n_turns", "n_escaped", "text"])

    return grouped.mapInArrow(run, "conv_id long, n_turns int, n_escaped int, text string")


SQL = r"""
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
mk AS (SELECT *, contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') AS bad_text,
  contains(role, '<|im_start|>') OR contains(role, '<|im_end|>') OR regexp_matches(role, '<\\+\|') OR contains(role, chr(10)) OR contains(role, '&nl;') OR contains(role, '&amp;') AS bad_role FROM src),
sh AS (SELECT conv_id, turn, role AS r0, text AS t0, bad_text OR bad_role AS bad,
  CASE WHEN bad_role THEN replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '&', '&amp;'), chr(10), '&nl;') ELSE role END AS role,
  CASE WHEN bad_text THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS text FROM mk)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (WHERE bad) AS INTEGER) AS n_escaped,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, r0, t0) AS text
FROM sh GROUP BY conv_id
"""
