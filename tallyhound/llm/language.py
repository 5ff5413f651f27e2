"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of labelled running text. A text is parsed against each of them into the longest phrases that occur
there; the language that needs the fewest phrases, normalised by its own usual rate on text that its automaton doesn't hold, wins. Phrases
run over words. The automata of all languages are one table of transitions in numpy, and all texts of a slice are parsed against all
languages in lockstep, a character at a time.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import held, map_texts, read, text_slices

#: Bounds of the labelled sample: documents per language (those with the least hashes), characters of each, characters in an automaton.
SAMPLE_DOCS, SAMPLE_CHARS, AUTOMATON_CHARS = 256, 6000, 48_000
#: Characters of a text that are parsed in one go; no phrase crosses such a border, in any language.
SEGMENT = 256
UNKNOWN = "und"
#: Phrases at the usual rate that every text is credited with when its excess is told, so that a few letters alone don't reject it.
PRIOR = 8
#: A text that needs this many times the phrases usual for the best language is in none of the learned ones.
REJECT_ABOVE = 2.5
BREAK = "\n"


@functools.cache
def _kinds() -> np.ndarray:
    """For every code point: 2 for letters (Unicode categories L), 1 for the marks on them (M), else 0."""
    known = {"L": 2, "M": 1}
    return np.fromiter((known.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters and marks of all texts in a row, one space before each word; where each text begins (one more entry than texts);
    the number of letters of each."""
    lower = [t.lower() for t in texts]
    flat = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[flat]
    keep = kind > 0
    out = np.where(keep, flat, np.uint32(32))
    keep[:-1] |= keep[1:]
    first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)))
    kept, letters = np.concatenate(([0], np.cumsum(keep))), np.concatenate(([0], np.cumsum(kind == 2)))
    return out[keep], kept[first], np.diff(letters[first])


class SuffixAutomaton:
    """All substrings of a text that hold no ``BREAK``, as transitions ``source, symbol, target``; 1 is the root."""

    def __init__(self, text: str) -> None:
        moves: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in text:
            if c == BREAK:
                last = 1
                continue
            s = ord(c)
            q = moves[last].get(s, 0)
            if q and length[q] == length[last] + 1:
                last = q
                continue
            new, p = len(moves), last
            if not q:
                moves.append({})
                link.append(1)
                length.append(length[last] + 1)
                while p and s not in moves[p]:
                    moves[p][s] = new
                    p = link[p]
                q = moves[p][s] if p else 0
            if q and length[q] != length[p] + 1:  # split q: its shorter strings now end here too
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and moves[p].get(s) == q:
                    moves[p][s] = copy
                    p = link[p]
                link[q] = copy
                if new == copy:  # the text's prefix was known already
                    last = copy
                    continue
                q = copy
            if q:
                link[new] = q
            last = new
        self.states = len(moves)
        sizes = np.fromiter(map(len, moves), np.int64, len(moves))
        self.source = np.repeat(np.arange(len(moves)), sizes)
        self.symbol = np.fromiter((s for m in moves for s in m), np.int64, int(sizes.sum()))
        self.target = np.fromiter((q for m in moves for q in m.values()), np.int64, int(sizes.sum()))


class Automata:
    """The automata of several texts as one hash table of transitions; ``roots`` holds the root of each."""

    def __init__(self, texts: list[str]) -> None:
        source, symbol, target, shift, self.roots = [], [], [], 0, []
        for text in texts:
            one = SuffixAutomaton(text)
            source.append(one.source + shift)
            symbol.append(one.symbol)
            target.append(one.target + shift)
            self.roots.append(1 + shift)
            shift += one.states
        empty = [np.zeros(0, np.int64)]
        key = (np.concatenate(empty + source) << 21) | np.concatenate(empty + symbol)
        value = np.concatenate(empty + target).astype(np.int32)
        bits = max(4, (4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(key)), self.slot(key)
        while len(left):
            free = np.flatnonzero(self.key[at] < 0)
            _, one = np.unique(at[free], return_index=True)  # one of those that want the same slot
            done = free[one]
            self.key[at[done]], self.value[at[done]] = key[left[done]], value[left[done]]
            open_ = np.ones(len(left), bool)
            open_[done] = False
            left, at = left[open_], (at[open_] + 1) & self.mask

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states reached, 0 where there is no such transition."""
        key = (state << 21) | symbol
        at = self.slot(key)
        found = self.key[at]
        out = np.where(found == key, self.value[at], 0)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.key[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.value[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def phrases(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each text (a row; ``flat`` and ``first`` as of :func:`symbols`) in each automaton (a column).

        A phrase is the longest match from where the one before ended; a character that begins no match is a phrase by itself.
        """
        size = np.diff(first)
        parts = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[text] + nth * SEGMENT
        length = np.minimum(first[text + 1] - begin, SEGMENT)
        order = np.argsort(-length, kind="stable")
        langs = len(self.roots)
        text, begin, length = text[order], begin[order], length[order]
        flat = flat.astype(np.int64)
        root = np.tile(np.array(self.roots, np.int64), len(text))  # lanes: the languages of a segment side by side
        state, n = root.copy(), np.zeros(len(root), np.int64)
        for j in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -j, "left"))  # segments with more than j characters
            c = np.repeat(flat[begin[:live] + j], langs)
            live *= langs
            to = self.move(state[:live], c).astype(np.int64)
            lost = np.flatnonzero(to == 0)
            if len(lost):
                n[lost] += state[lost] != root[lost]  # a phrase ends before this character
                again = self.move(root[lost], c[lost])
                n[lost] += again == 0
                to[lost] = np.where(again == 0, root[lost], again)
            state[:live] = to
        n += state != root
        out = np.zeros((len(size), langs), np.int64)
        np.add.at(out, text, n.reshape(-1, langs))
        return out


def excerpt(text: str, most: int) -> str:
    """Whole words of a text, at most ``most`` characters of them, from a place that the text's hash gives."""
    if len(text) <= most:
        return text
    at = zlib.crc32(text.encode()) % (len(text) - most + 1)
    start = text.find(" ", at) + 1 if at else 0
    window = text[start : start + most]
    return window[: window.rfind(" ")] if " " in window and start + most < len(text) else window


def train(samples: tuple) -> tuple[tuple[str, ...], tuple[str, ...], tuple[float, ...]]:
    """Languages, the text of each one's automaton, and its usual phrases per letter, from ``((lang, texts), …)``.

    Every third text of a language (of a single one, its last third) is kept out of its automaton and gives the usual rate. Languages whose
    texts hold no letter aren't learned.
    """
    names, bodies, usual = [], [], []
    for lang, texts in samples:
        plain = []
        for t in texts:
            flat, first, letters = symbols([t])
            if letters[0]:
                plain.append("".join(map(chr, flat[: first[1]])))
        if len(plain) == 1:
            cut = 2 * len(plain[0]) // 3
            plain = [plain[0][:cut] or plain[0], plain[0][cut:]]
        own, apart = [t for k, t in enumerate(plain) if k % 3 != 1], [t for k, t in enumerate(plain) if k % 3 == 1]
        if not own:
            continue
        most = max(1, AUTOMATON_CHARS // len(own) - len(BREAK))
        body = BREAK.join(excerpt(t, most) for t in own)
        flat, first, letters = symbols(apart)
        rate = Automata([body]).phrases(flat, first).sum() / max(1, letters.sum())
        names.append(lang)
        bodies.append(body)
        usual.append(max(1e-6, float(rate)))
    return tuple(names), tuple(bodies), tuple(usual)


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple:
    """The bounded labelled sample ``((lang, texts), …)`` of the documents outside the held-out fold.

    A language gives at most ``sample_docs`` documents, one for each hash range of ids, and a window of ``sample_chars`` characters of each, at a hashed place. Ids are
    found by an aggregation on integers; texts are read for these ids only. Rows without lang, id or text teach nothing.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    h = F.xxhash64("doc_id")
    ids = rows.groupBy("lang", F.pmod(h, F.lit(sample_docs)).alias("_part")).agg(F.min_by(F.col("doc_id").cast("long"), h).alias("_id"))
    ids = F.broadcast(ids.select("_id").distinct())  # at most sample_docs for each language
    at = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)) + 1).cast("int")
    chosen = rows.join(ids, rows.doc_id == ids._id, "left_semi").select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.substring("text", at, F.lit(sample_chars)).alias("text")).distinct()
    by: dict[str, list[tuple[int, str]]] = {}
    for lang, doc_id, text in chosen.collect():
        by.setdefault(lang, []).append((doc_id, text))
    return tuple((k, tuple(t for _, t in sorted(v)[:sample_docs])) for k, v in sorted(by.items()))


def identify(docs: DataFrame, samples: tuple | None = None, carry: str | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, excess``; with ``carry`` the columns of ``docs`` and, last, a struct of
    ``lang_pred, score, excess`` of that name, in place of another of this name.

    ``score`` is 1 - best / second best normalised phrases (1 with a single language). ``excess`` is the best language's phrases over
    its usual number, both plus ``PRIOR``. Texts that are null or have no letter, and all texts if nothing could be learned, are ``und`` with score 0 and no
    excess. Ties go to the first language by name. Every row is judged by its whole text alone; repeated rows are judged again.
    """
    samples = learn(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(train(samples))  # AUTOMATON_CHARS for each language at most
    name = carry or "_verdict"
    verdict = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("excess", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bodies, usual = shared.value
        automata = held("language", bodies, lambda: Automata(list(bodies)))
        for part, texts in text_slices(batches):
            flat, first, letters = symbols(texts)
            total = automata.phrases(flat, first) if names else None
            rows = []
            for i, n in enumerate(letters.tolist()):
                if not n or not names:
                    rows.append({"lang_pred": UNKNOWN, "score": 0.0, "excess": None})
                    continue
                need = total[i] / n / np.array(usual)
                best = int(np.argmin(need))
                rest = np.delete(need, best)
                score = float(1 - need[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0 if not len(rest) else 0.0
                rows.append({"lang_pred": names[best], "score": score, "excess": float((total[i][best] + PRIOR) / (n * usual[best] + PRIOR))})
            columns = [*(part.columns if carry else [part.column("doc_id")]), pa.array(rows, verdict)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(part.schema.names if carry else ["doc_id"]), name])

    out = docs.drop(carry) if carry else docs.select("doc_id", "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (out.schema if carry else out.schema[:1]))
    found = map_texts(out, run, f"{kept}, `{name}` struct<lang_pred: string, score: double, excess: double>")
    return found if carry else found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "_verdict.lang_pred", "_verdict.score", "_verdict.excess")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
