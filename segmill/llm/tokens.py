"""Token counts of texts under public tokenizers, without ever holding tokens."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter of every function here.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Tokenizer names of specifications -> vocabulary file. The two names without a file here are counted
#: with the one nearest in kind: code and English, and many languages.
FILES = {"gpt2": "byte_bpe_50k.tiktoken", "cl100k_base": "byte_bpe_50k.tiktoken", "o200k_base": "byte_bpe_multi_50k.tiktoken"}

#: Pre-token pattern of these vocabularies (fixed value) and its form for ASCII text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_ANY = regex.compile(PATTERN)
#: A line break after a visible character always ends a pre-token, so the pieces can be counted alone.
_PIECES = re.compile(r"(?<=\S)(?=\n)")
_KEPT = 400_000


class Counter(dict):
    """Number of tokens of every pre-token seen so far; forgets all of them when there are too many."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT:
            self.clear()
        n = len(self._encoding.encode_ordinary(word))
        if len(word) < 64:
            self[word] = n
        return n


def folder() -> str:
    if os.path.isdir(VOCABULARIES):
        return VOCABULARIES
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.submodule_search_locations:
        raise FileNotFoundError("set TOKENIZER_DIR to the folder of the vocabulary files")
    return next(iter(spec.submodule_search_locations))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def pre_tokens(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists; ASCII stretches take the faster pattern."""
    if text.isascii():
        yield _ASCII.findall(text)
        return
    held: list[str] = []  # neighbouring ASCII pieces are split together
    for piece in _PIECES.split(text):
        if piece.isascii():
            held.append(piece)
        else:
            if held:
                yield _ASCII.findall("".join(held))
                held = []
            yield _ANY.findall(piece)
    if held:
        yield _ASCII.findall("".join(held))


def counted(df: DataFrame, keep: list[str], text_col: str, files: Mapping[str, str], directory: str | None = None) -> DataFrame:
    """``keep`` columns and one BIGINT column per entry of ``files`` (column -> vocabulary file).

    One narrow pass; every text is split once for all vocabularies, and a word is encoded once per worker.
    NULL and empty texts have 0 tokens. Counts equal the tokenizer's own, special strings being text.
    """
    base = directory or folder()
    paths = {c: f"{base}/{f}" for c, f in files.items()}
    own = sorted(set(paths.values()))
    place = [own.index(p) for p in paths.values()]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` long" for c in files)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [counter(p).__getitem__ for p in own]
        for batch in batches:
            totals: list[list[int]] = [[] for _ in own]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                sums = [0] * len(own)
                for words in pre_tokens(text or ""):
                    for k, lookup in enumerate(lookups):
                        sums[k] += sum(map(lookup, words))
                for k, n in enumerate(sums):
                    totals[k].append(n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), *(pa.array(totals[k], pa.int64()) for k in place)], names=[*keep, *files]
            )

    return df.select(*keep, text_col).mapInArrow(count, schema)
