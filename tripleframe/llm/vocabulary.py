"""Public vocabularies, read where they are used; their path is a parameter."""

from __future__ import annotations

import base64

from tripleframe.llm.common import kept

FOLDER = "/opt/tokenizers"
TIKTOKEN = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(path: str):
    """The tiktoken encoding of a file of ranks, made once in each worker. It has no special tokens."""

    def make():
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    return kept(f"tiktoken {path}", make)


def end_of(path: str) -> int:
    """The first number after the ranks: what stands between documents."""
    return encoder(path).max_token_value + 1


def pieces(path: str):
    def make():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)

    return kept(f"pieces {path}", make)
