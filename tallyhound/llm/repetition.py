"""Quality rules on repetition: how much of a text lies inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import map_texts, read, text_slices
from tallyhound.llm.words import ngram_hashes, words_of

#: Largest share of word characters inside duplicated n-grams, by n (published thresholds for web text).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters in lines equal to an earlier one. Their number isn't judged: one of three short lines says little.
LINE_CHAR_LIMIT = 0.20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(grams: np.ndarray, later: bool = False) -> np.ndarray:
    """Which grams occur twice or more in the text; with ``later``, without their first occurrence."""
    _, at, which, n = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
    out = n[which] > 1
    if later:
        out[at] = False
    return out


def covered(hit: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the windows of ``n`` words that ``hit`` marks."""
    depth = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + n, -1)
    return np.cumsum(depth[:-1]) > 0


def measure(texts: list[str], ngrams: tuple[int, ...]) -> dict[str, list]:
    """Counts of each text; see :func:`repetition`."""
    raw = [t.encode() for t in texts]
    w = words_of(raw)
    lead = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))  # code points before a byte
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[w.data])))
    chars = lead[w.end] - lead[w.start]
    chars_before = np.concatenate(([0], np.cumsum(chars)))
    newline = np.flatnonzero(w.data == 0x0A)
    grams = {n: ngram_hashes(w.hash, n) for n in {5, *ngrams}}
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}" for n in ngrams))}
    for i, t in enumerate(raw):
        a, b = w.first[i], w.first[i + 1]
        at, end = w.text_at[i], w.text_at[i + 1] - 1
        out["n_words"].append(b - a)
        out["word_chars"].append(chars_before[b] - chars_before[a])
        out["n_symbols"].append(symbols[end] - symbols[at])
        cuts = newline[np.searchsorted(newline, at) : np.searchsorted(newline, end)]
        word_at = np.concatenate(([a], np.searchsorted(w.start, cuts), [b]))  # first word of each line
        size = np.diff(chars_before[word_at])
        seen, lines, dup, dup_chars = set(), 0, 0, 0
        for line, c in zip(t.split(b"\n"), size, strict=True) if len(cuts) else ((t, size[0]),):
            if c:
                lines += 1
                if line in seen:
                    dup += 1
                    dup_chars += c
                seen.add(line)
        out["n_lines"].append(lines)
        out["n_dup_lines"].append(dup)
        out["dup_line_chars"].append(dup_chars)
        repeat, short = 0, False  # without a repeated short window there is no repeated longer one
        for n in sorted(grams):
            c = 0
            if b - a > n and not short:
                own = grams[n][a : b - n + 1]
                hit = repeated(own)
                short = not hit.any()
                if not short:
                    if n == 5:
                        repeat = int(covered(hit, 5, b - a).sum())
                    if n in ngrams:
                        c = int(chars[a:b][covered(repeated(own, later=True), n, b - a)].sum())
            if n in ngrams:
                out[f"dup_{n}"].append(c)
        out["n_repeat_words"].append(repeat)
    return out


def repetition(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_char_limit: float = LINE_CHAR_LIMIT) -> DataFrame:
    """Repetition measures and verdicts of every whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that equal an earlier line),
    ``n_repeat_words`` (words in 5-word windows found twice or more), ``base_failed`` (under 10 words, or over 20 % of them repeated);
    then ``n_lines``, ``dup_line_chars``, ``dup_<n>`` (characters of words inside n-grams seen earlier in the text) and ``kept``: not
    failed and no share above its limit. Null and empty texts have no words and fail. Rows are judged one by one, repeated ones
    too; other columns are ignored; an empty table gives no rows.
    """
    limits = dict(ngram_limits or NGRAM_LIMITS)
    ngrams = tuple(sorted(limits))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}" for n in ngrams)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            found = measure(texts, ngrams)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.asarray(found[k], np.int64)) for k in names)], names=["doc_id", *names])

    out = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{k} long" for k in names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = F.col("dup_line_chars") <= line_char_limit * F.col("word_chars")
    for n, limit in limits.items():
        fine &= F.col(f"dup_{n}") <= limit * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = repetition(read(spark, sf_dir, "documents"))
    return out.select(*first, *(c for c in out.columns if c not in first))
