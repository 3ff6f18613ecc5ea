"""Vocabulary files of public tokenizers; their place is a parameter and they are never copied here."""

from __future__ import annotations

import base64
import functools


def vocabulary(name: str) -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The pre-token pattern of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def ranks(path: str, pattern: str):
    """A tiktoken encoding over the ranks in ``path``, without special tokens; one per Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=pattern, mergeable_ranks=merges, special_tokens={})


@functools.lru_cache(maxsize=4)
def pretokens(pattern: str):
    import regex

    return regex.compile(pattern)


@functools.lru_cache(maxsize=2)
def fast(path: str, special_as_text: bool = False):
    """A ``tokenizers`` tokenizer as its file has it: strings of special tokens inside a text are these tokens, unless
    ``special_as_text``."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = special_as_text
    return made


@functools.lru_cache(maxsize=4)
def added(path: str) -> tuple[str, ...]:
    """Strings of the tokens that a ``tokenizers`` file adds to its vocabulary."""
    return tuple(t.content for t in fast(path).get_added_tokens_decoder().values())
