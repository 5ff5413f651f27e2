"""Byte-level BPE ids and token counts of whole texts, equal to those of the ``tokenizers`` library for ``byte_bpe_50k.json``.

The rank file of the same vocabulary is read by ``tiktoken``, which is several times faster; tests hold both against each other.
Texts in which no two white-space characters meet don't need the pattern's look-ahead, and without it the pattern runs on a plain automaton.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import held, map_texts, read, text_slices, token_file

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
LOOKAHEAD = r"|\s+(?!\S)"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TWO_SPACES = re.compile(r"\s\s")
#: Pre-tokens whose counts a worker remembers.
MEMO = 200_000


def _ranks(vocabulary: str | None) -> dict[bytes, int]:
    with open(token_file("byte_bpe_50k.tiktoken", vocabulary), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _encodings(vocabulary: str | None) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """Encodings with the whole pattern and with that for single-spaced texts, held by the worker."""

    def make() -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
        ranks = _ranks(vocabulary)
        one = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        return one("whole", PATTERN), one("single-spaced", PATTERN.replace(LOOKAHEAD, ""))

    return held("encoding", vocabulary, make)


def encoder(vocabulary: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids. The special string becomes its id, as the library does by default."""
    full, single = _encodings(vocabulary)

    def encode(text: str) -> np.ndarray:
        chosen = full if _TWO_SPACES.search(text) else single
        return chosen.encode_to_numpy(text, allowed_special="all" if SPECIAL in text else set(), disallowed_special=())

    return encode


@functools.cache
def whole_tokens(vocabulary: str | None = None) -> frozenset[str]:
    """The vocabulary's strings that are proved to encode alone as one token, by encoding each of them; a string that the merges reach as
    several tokens is left out."""
    full, _ = _encodings(vocabulary)
    out = []
    for raw in _ranks(vocabulary):
        try:
            s = raw.decode()
        except UnicodeDecodeError:
            continue
        if len(full._encode_single_piece(s)) == 1:
            out.append(s)
    return frozenset(out)


class _Counts(dict):
    """Tokens of a pre-token: 1 for the proved whole tokens, which it starts with; others are merged once and remembered."""

    def __init__(self, vocabulary: str | None) -> None:
        self.vocabulary = vocabulary
        self.merge = _encodings(vocabulary)[1]._encode_single_piece
        self.refill()

    def refill(self) -> None:
        self.clear()
        self.update(dict.fromkeys(whole_tokens(self.vocabulary), 1))

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.merge(piece))
        return n


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every whole text, by the whole-token shortcut.

    Pre-tokens that are proved whole tokens count one; only the rest go through the merges. Null texts count as empty: no bytes, no tokens.
    Special strings count as one token. Repeated rows are counted again; other columns don't matter. An empty table gives no rows.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Counts(vocabulary)
        whole, single = regex.compile(PATTERN), regex.compile(PATTERN.replace(LOOKAHEAD, ""))
        for part, texts in text_slices(batches):
            tokens = []
            for t in texts:
                n = 0
                for i, piece in enumerate(t.split(SPECIAL) if SPECIAL in t else (t,)):
                    n += (i > 0) + sum(map(known.__getitem__, (whole if _TWO_SPACES.search(piece) else single).findall(piece)))
                tokens.append(n)
                if len(known) > MEMO:
                    known.refill()
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
