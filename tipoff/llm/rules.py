"""Quality rules with distribution divergence.

Base rules count words, symbols, repeated lines and words in repeated five-word
windows.  The method's verdict compares a document's character-class and
common-word histograms to those of its language with the Jensen-Shannon distance
(base 2, so 0 to 1).  The references are sums over all documents of a language that
pass the base rules, found in a first pass, so that junk doesn't shift what it is held
against; a document with fewer words than the guard isn't judged by its histograms,
since short texts diverge by chance.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tipoff.llm.common import bounded_batches, text_or_empty

#: Frequent function words of each language with a list.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "at", "from", "have", "an", "they", "which", "you"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "so", "dass", "bei"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "ce", "il", "sont", "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o", "pero", "sus", "le"),
}
LANGS = (*COMMON_WORDS, "other")
CLASSES = ("lower", "upper", "other letter", "digit", "space", "line break", "punctuation", "symbol", "rest")


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_percent: int = 20
    guard_words: int = 100
    #: Between the distances of labelled good and bad documents of 100 or more words.
    max_class_distance: float = 0.25
    max_word_distance: float = 0.27


def _class_of(c: int) -> int:
    ch = chr(c)
    kind = unicodedata.category(ch)
    if ch == "\n":
        return 5
    if ch.isspace():
        return 4
    if kind[0] == "L":
        return 0 if c < 128 and ch.islower() else 1 if ch.isupper() else 2
    return 3 if kind == "Nd" else 6 if kind[0] == "P" and ch not in "#*%&" else 7 if kind[0] == "S" or ch in "#*%&" else 8


_EDGE = 0x250
_CLASS = np.array([_class_of(c) for c in range(_EDGE)], np.uint8)
_class_beyond = functools.lru_cache(maxsize=1 << 16)(_class_of)


class _Words:
    """Lookup of common words by the hash of their bytes, in this process."""

    def __init__(self) -> None:
        self.by_lang = []
        for lang in LANGS:
            words = COMMON_WORDS.get(lang) or tuple(sorted({w for ws in COMMON_WORDS.values() for w in ws}))
            hashes = np.array([hash(v.encode()) for w in words for v in (w, w.capitalize())], np.int64)
            slots = np.repeat(np.arange(len(words)), 2)
            order = np.argsort(hashes, kind="stable")
            self.by_lang.append((hashes[order], slots[order], len(words)))

    def histogram(self, words: np.ndarray, lang: int) -> np.ndarray:
        hashes, slots, n = self.by_lang[lang]
        at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        hit = hashes[at] == words
        counts = np.bincount(slots[at[hit]], minlength=n + 1)
        counts[n] = len(words) - int(hit.sum())
        return counts


WORDS = _Words()


def common_histogram(words: np.ndarray, lang: int) -> np.ndarray:
    """Counts of the language's common words, and of all other words last.

    Hashes of bytes differ between processes: tasks must reach the table through
    this function, which they import, not through a pickled copy of it.
    """
    return WORDS.histogram(words, lang)


_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def class_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = points < _EDGE
    if near.all():
        return np.bincount(_CLASS[points], minlength=len(CLASSES))
    counts = np.bincount(_CLASS[points[near]], minlength=len(CLASSES))
    for c, n in zip(*(x.tolist() for x in np.unique(points[~near], return_counts=True)), strict=True):
        counts[_class_beyond(c)] += n
    return counts


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(hash, words), np.int64, len(words))


def repeat_words(words: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    w = words.view(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(h, twice)
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:n] += starts
    covered[width : width + n] -= starts
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def base_counts(text: str) -> tuple[int, int, int, int]:
    """(word characters, symbols, repeated lines, words)."""
    lines = [x for x in text.split("\n") if x and x.encode("utf-8", "surrogatepass").split()] if "\n" in text else []
    return len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2; 0 where one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nansum(np.where(p > 0, p * np.log2(p / m), 0)) + np.nansum(np.where(q > 0, q * np.log2(q / m), 0))
    return float(np.sqrt(max(0.0, d / 2)))


def lang_slot(col: str) -> Column:
    slot = F.lit(len(LANGS) - 1)
    for i, lang in enumerate(COMMON_WORDS):
        slot = F.when(F.col(col) == lang, F.lit(i)).otherwise(slot)
    return slot.cast("int")


def base_failed(n: int, repeats: int, rules: Rules) -> bool:
    return n < rules.min_words or 100 * repeats > rules.repeat_percent * n


def references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> list[tuple[np.ndarray, np.ndarray]]:
    """(class histogram, common-word histogram) of every language, over all documents
    that pass the base rules.

    Each task adds up its rows and hands on at most one number a language and
    slot; what reaches the driver is that fixed table.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(text)
                if base_failed(len(words), repeat_words(words), rules):
                    continue
                c, w = class_histogram(text), common_histogram(words, lang)
                if lang in sums:
                    sums[lang][0][:] += c
                    sums[lang][1][:] += w
                else:
                    sums[lang] = (c.astype(np.int64), w.astype(np.int64))
        rows = [(lang, view, i, int(n)) for lang, two in sums.items() for view, h in enumerate(two) for i, n in enumerate(h)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["lang", "view", "slot", "n"])

    got = docs.select(lang_slot(lang_col).alias("lang"), text_or_empty(text_col).alias("text")).mapInArrow(run, "lang int, view int, slot int, n long")
    out = [(np.zeros(len(CLASSES)), np.zeros(n + 1)) for _, _, n in WORDS.by_lang]
    for r in got.groupBy("lang", "view", "slot").agg(F.sum("n").alias("n")).collect():
        out[r.lang][r.view][r.slot] = r.n
    return out


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def judge(text: str, lang: int, refs: list[tuple[np.ndarray, np.ndarray]], rules: Rules) -> tuple[int, int, int, int, int, bool, float, float, bool]:
    """The measures of one text, in the order of MEASURES."""
    words = word_hashes(text)
    n = len(words)
    chars, symbols, dup_lines = base_counts(text)
    repeats = repeat_words(words)
    failed = base_failed(n, repeats, rules)
    dc = dw = 0.0
    if n >= rules.guard_words:
        dc = round(distance(class_histogram(text), refs[lang][0]), 6)
        dw = round(distance(common_histogram(words, lang), refs[lang][1]), 6)
    return n, chars, symbols, dup_lines, repeats, failed, dc, dw, not failed and dc <= rules.max_class_distance and dw <= rules.max_word_distance


def measure(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of docs and those of MEASURES; like-named ones are replaced.

    Null texts are empty: no words, so they fail.  A null or unlisted language
    compares to the reference of all such documents.  Repeated rows are judged
    each; an empty table gives no rows.  A text is judged whole, however long; a
    language without any document that passes the base rules rejects by them alone.
    """
    refs = references(docs, rules, text_col, lang_col)
    names = [f.split()[0] for f in MEASURES.split(", ")]
    kept = docs.drop(*names, "__lang", "__text")
    n = len(kept.columns)
    got = kept.withColumns({"__lang": lang_slot(lang_col), "__text": text_or_empty(text_col)})
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(MEASURES).fields])
    columns = [*kept.columns, *names]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [judge(t, la, refs, rules) for la, t in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=columns)

    return got.mapInArrow(run, schema)
