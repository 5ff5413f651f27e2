"""Secret scans: known forms, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import map_texts, read, text_slices

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

#: Strings that may hide a random key: long runs of the characters of base 64 and its URL form.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Runs within a candidate: of hex digits of one case, and of what no joint (= _ - /) parts.
HEX_RUNS, RUN = (re.compile(r"[0-9a-f]+"), re.compile(r"[0-9A-F]+")), re.compile(r"[^=_/-]+")
#: Window in characters and the least bits per character by class. A window of 20 random hex digits has about 3.4 bits, of 20 random
#: base-64 characters about 4.1; digits alone are no key.
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "base64": 3.8}
#: A word: of one case, or in humps of three letters or more; and up to four digits.
_WORD = r"(?:[A-Z]{0,12}|[A-Z]?[a-z]{0,20}|[A-Z]?[a-z]{2,20}(?:[A-Z][a-z]{2,20})+)\d{0,4}"
#: Harmless forms: UUIDs, dates and times, paths and slugs of words, digests of the length that the word before them says, in hex or base 64.
ALLOWED = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"\d{4}-\d\d-\d\d(?:[T_-][\d-]*)?",
    rf"(?:{_WORD}[/_=-])*{_WORD}",
    *(rf"{name}[-=](?:[0-9a-f]{{{n // 4}}}|[0-9A-F]{{{n // 4}}}|[A-Za-z0-9+/_-]{{{-(-n // 6)}}}=*)" for name, n in (("md5", 128), ("sha1", 160), ("sha256", 256), ("sha384", 384), ("sha512", 512))),
)
_C_LOG = [0.0] + [n * math.log2(n) for n in range(1, 4096)]


def character_class(s: str) -> str:
    """``hex``, ``base64`` or, for strings that can't be keys (no digit, or no letter), an empty string."""
    digit, letter = any(map(str.isdigit, s)), any(map(str.isalpha, s))
    if not (digit and letter):
        return ""
    return "hex" if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s) else "base64"


def dense_windows(s: str, window: int, least: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``s`` with at least ``least`` bits per character; counts change by one character in and one out."""
    counts: dict[str, int] = {}
    held, out = 0.0, []
    whole = window * math.log2(window)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        held += _C_LOG[n + 1] - _C_LOG[n]
        counts[c] = n + 1
        if i >= window:
            old = s[i - window]
            n = counts[old]
            held += _C_LOG[n - 1] - _C_LOG[n]
            counts[old] = n - 1
        if i >= window - 1 and whole - held >= least * window - 1e-9:
            a = i - window + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the known forms, sorted."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def run_spans(s: str, window: int, least_bits: dict[str, float]) -> list[tuple[int, int]]:
    """Dense parts of a candidate, apart and sorted. Runs of hex digits are judged as hex wherever they stand, and the candidate as its own
    class; what a dense window touches is covered to the end of its run."""
    out = [m.span() for hexed in HEX_RUNS for m in hexed.finditer(s) if m.end() - m.start() >= window and character_class(m.group()) and dense_windows(m.group(), window, least_bits["hex"])]
    if character_class(s) == "base64" and (dense := dense_windows(s, window, least_bits["base64"])):
        runs = [m.span() for m in RUN.finditer(s)]
        out += dense + [(a, b) for a, b in runs if any(a < y and x < b for x, y in dense)]
    apart: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if apart and a <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(apart[-1][1], b))
        else:
            apart.append((a, b))
    return apart


def entropy_spans(text: str, window: int = WINDOW, least_bits: dict[str, float] = LEAST_BITS, allowed: re.Pattern | None = None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of dense runs in candidates that no allowed form matches whole."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if character_class(s) and not (allowed and allowed.fullmatch(s)):
            out += [(m.start() + a, 3, m.start() + b) for a, b in run_spans(s, window, least_bits)]
    return out


def scan(docs: DataFrame, window: int = WINDOW, least_bits: dict[str, float] | None = None, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``doc_id, spans`` with ``spans array<struct<kind, start, end>>`` (code points, end exclusive) for every whole text.

    Known forms always stay; the entropy method only adds spans. Null and empty texts have none. Every row gives one row.
    """
    bits = dict(least_bits or LEAST_BITS)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        harmless = re.compile("|".join(f"(?:{x})" for x in allowed)) if allowed else None
        for part, texts in text_slices(batches):
            spans = [sorted(base_spans(t) + entropy_spans(t, window, bits, harmless)) for t in texts]
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of :func:`scan` replaced by ``mark`` in ``text``, and ``n_chars`` (where present) set anew for those rows.

    Null and empty texts stay as they are, repeated rows are handled one by one, other columns are kept whatever their names, and an empty table gives no rows."""
    bits, allowed = dict(options.get("least_bits") or LEAST_BITS), options.get("allowed", ALLOWED)
    window = options.get("window", WINDOW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        harmless = re.compile("|".join(f"(?:{x})" for x in allowed)) if allowed else None
        for part, texts in text_slices(batches):
            column, changed = part.column("text").to_pylist(), False
            sizes = part.column("n_chars").to_pylist() if "n_chars" in part.schema.names else None
            for i, t in enumerate(texts):
                spans = sorted(base_spans(t) + entropy_spans(t, window, bits, harmless))
                if spans:
                    out, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            out += [t[at:a], mark]
                        at = max(at, b)
                    column[i], changed = "".join([*out, t[at:]]), True
                    if sizes is not None:
                        sizes[i] = len(column[i])
            if changed:
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(column, part.schema.field(at).type))
                if sizes is not None:
                    at = part.schema.get_field_index("n_chars")
                    part = part.set_column(at, part.schema.field(at), pa.array(sizes, part.schema.field(at).type))
            yield part

    return map_texts(docs, run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        of("entropy").alias("n_entropy"),
    )
