"""Per-document text statistics, and telling prose from lists, tables and junk by weak supervision.

A text is cut into segments, the sentences of its lines. Thresholds on a segment's statistics make noisy labelling
functions: each gives one of two or three symbols, and begins with a belief which types of text show it. How far each
can be trusted for each type is learned by expectation-maximization from where they agree over the whole corpus; what
the corpus gives is the count of each pattern of symbols, a table bounded by the product of the symbols. A pattern then
has a posterior over the types, a document the mean of its segments', weighted by their characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types of text; a segment's first type is a sentence.
TYPES = ("prose", "list", "table", "junk")
#: Labelling functions: for each symbol, the types that are first believed to show it more often.
FUNCTIONS = {
    "words": ("table junk", "list table junk", "prose"),  # none, fewer than 4, more
    "common": ("list table junk", "list junk", "prose"),  # common words: none, below the rate, more
    "letters": ("table junk", "table junk", "prose list"),  # letters: below 35 %, below 60 %, more
    "size": ("list table junk", "list", "prose"),  # characters: fewer than 12, than 40, more
    "mean": ("table junk", "junk", "prose list"),  # letters of a word: below 2.2, above 11, between
    "end": ("list table junk", "prose"),  # ends without and with punctuation
    "line": ("list table", "junk", "prose"),  # the line's words: fewer than 4, more without the rate of common ones, with it
    "layout": ("prose junk", "list", "table"),  # the line: plain, with a list's mark, with a table's separators
}
SIZES = [len(v) for v in FUNCTIONS.values()]
#: Share of common words, of Han characters in common words, from which a segment has many.
RATE, HAN_RATE = 0.08, 0.04
#: How much more often a function is first believed to give a symbol for the types that show it.
BELIEF = 6.0
ROUNDS = 50

_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_SPLIT = re.compile(r"(?<=[.;:!?])\s+|(?<=[。；：！？])")
_END = ".!?;:。！？；：…\"”»"
_LIST = re.compile(r"(?:[-*•·–◦▪‣+]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)])\s")
_TABLE = re.compile(r"(?:\t|\s?\|\s?|\S\s{3,}\S).*(?:\t|\||\S\s{3,}\S)|;.*;.*;.*;")
COLUMNS = "words long, mean_word double, symbol_ratio double, punct_lines double, common_share double, letter_share double, repeated double"


class Common:
    def __init__(self, words: list[str]):
        self.words = frozenset(w.lower() for w in words if w and not _HAN.search(w))
        han = sorted({w for w in words if w and _HAN.search(w)}, key=len, reverse=True)
        self.han = re.compile("|".join(map(re.escape, han))) if han else None


def _segment(seg: str, common: Common) -> tuple[int, int, int, int, int]:
    """(words, letters, common words, non-blank characters, symbols of the functions before "line" as one number)."""
    words = _WORD.findall(seg.lower())
    letters = sum(map(len, words))
    size = len("".join(seg.split()))
    end = seg.rstrip()[-1:] in _END
    if not letters:
        return 0, 0, 0, size, _code(0, 0, 0, 0 if size < 12 else 1 if size < 40 else 2, 0, end)
    known = sum(map(common.words.__contains__, words))
    n = len(words)
    han = 0 if seg.isascii() else len(_HAN.findall(seg))
    if han * 3 > letters:
        hits = sum(map(len, common.han.findall(seg))) if common.han else 0
        n = n - sum(1 for w in words if _HAN.search(w)) + han
        many = 0 if not hits else 1 if hits < HAN_RATE * han else 2
        full = 0 if letters * 4 < size else 1 if letters * 2 < size else 2
        return n, letters, known + hits, size, _code(1 if han < 6 else 2, many, full, 0 if han < 4 else 1 if han < 12 else 2, 2, end)
    many = 0 if not known else 1 if known < RATE * n else 2
    full = 0 if letters * 20 < size * 7 else 1 if letters * 5 < size * 3 else 2
    mean = 0 if letters < 2.2 * n else 1 if letters > 11 * n else 2
    return n, letters, known, size, _code(1 if n < 4 else 2, many, full, 0 if size < 12 else 1 if size < 40 else 2, mean, end)


def _code(*symbols: int) -> int:
    code = 0
    for k, s in zip(SIZES, symbols):
        code = code * k + s
    return code


def symbols(code: int) -> list[int]:
    """The symbol of each function in a pattern's number."""
    out = []
    for k in reversed(SIZES):
        code, s = divmod(code, k)
        out.append(s)
    return out[::-1]


def statistics(text: str | None, common: Common) -> tuple | None:
    """The values of COLUMNS and {pattern: (segments, non-blank characters)}; None for null and blank texts.

    Han characters count as words of their own.
    """
    if text is None or not text.strip():
        return None
    words = letters = known = size = lines = punct = 0
    seen: dict[str, int] = {}
    found: dict[int, list[int]] = {}
    for line in text.split("\n"):
        raw, line = line, line.strip()
        if not line:
            continue
        lines += 1
        punct += line[-1] in _END
        seen[line] = seen.get(line, 0) + 1
        segs = [x for x in _SPLIT.split(line) if x] if len(line) > 40 else [line]
        if len(segs) > 1 and len(segs[0]) < 7 and not _WORD.search(segs[0]):  # a claim's number belongs to its sentence
            segs[:2] = [" ".join(segs[:2])]
        parts = [_segment(seg, common) for seg in segs]
        n, k = sum(p[0] for p in parts), sum(p[2] for p in parts)
        here = 0 if n < 4 else 2 if k >= RATE * n else 1
        layout = 1 if _LIST.match(line) else 2 if _TABLE.search(raw.rstrip()) else 0
        for a, b, c, d, code in parts:
            words, letters, known, size = words + a, letters + b, known + c, size + d
            at = found.setdefault((code * 3 + here) * 3 + layout, [0, 0])
            at[0] += 1
            at[1] += d
    return (
        words, letters / words if words else 0.0, (size - letters) / size, punct / lines, known / words if words else 0.0,
        letters / size, 1 - len(seen) / lines, found,
    )


def text_statistics(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """``key``, the statistics of each row's text and its patterns, segments and chars; all null for null and blank texts.

    One pass over the texts, no shuffle. The table of common words goes to every worker; it is a vocabulary, whose size
    does not follow the corpus.
    """
    words = [r[0] for r in common_words.select(word).distinct().collect()]
    shared = df.sparkSession.sparkContext.broadcast(words)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    ints = pa.list_(pa.int32())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(shared.value)
        for b in it:
            rows = [statistics(t, common) or (None,) * (len(names) + 1) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.float64()) for k in range(len(names))]
            found = [r[-1] for r in rows]
            cols.append(pa.array([None if f is None else [*f] for f in found], ints))
            cols += [pa.array([None if f is None else [v[k] for v in f.values()] for f in found], ints) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["key", *names, "patterns", "segments", "chars"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, {COLUMNS}, patterns array<int>, segments array<int>, chars array<int>")
    return out.withColumnRenamed("key", key)


def learn(patterns: list[tuple[int, int]], rounds: int = ROUNDS) -> dict[int, list[float]]:
    """The posterior over TYPES of each pattern, by expectation-maximization over (pattern, segments).

    For each type a function has a rate of each symbol, begun by FUNCTIONS' beliefs and smoothed by one count. Any
    counts do; without patterns the result is empty.
    """
    if not patterns:
        return {}
    import numpy as np

    sym = np.array([symbols(p) for p, _ in patterns])
    n = np.array([float(k) for _, k in patterns])
    rate = []
    for shows in FUNCTIONS.values():
        r = np.array([[BELIEF if t in s.split() else 1.0 for s in shows] for t in TYPES])
        rate.append(r / r.sum(1, keepdims=True))
    prior = np.full(len(TYPES), 1 / len(TYPES))
    post = None
    for _ in range(rounds):
        log = np.log(prior)[None, :] + sum(np.log(r[:, sym[:, k]]).T for k, r in enumerate(rate))
        log -= log.max(1, keepdims=True)
        post = np.exp(log)
        post /= post.sum(1, keepdims=True)
        mass = post * n[:, None]
        prior = (mass.sum(0) + 1) / (n.sum() + len(TYPES))
        for k, size in enumerate(SIZES):
            got = np.stack([mass[sym[:, k] == s].sum(0) for s in range(size)], 1) + 1
            rate[k] = got / got.sum(1, keepdims=True)
    return {p: [float(x) for x in post[i]] for i, (p, _) in enumerate(patterns)}


def text_types(stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """The statistics with a column for each of TYPES, the posterior shares of a document's characters, and ``type``.

    ``type`` is prose from half of the characters on, else the likeliest of the others; all are null without statistics.
    ``stats`` is read twice; pass a table that is written.
    """
    counts = stats.where(F.col("patterns").isNotNull()).select(F.explode(F.arrays_zip("patterns", "segments")).alias("x"))
    counts = counts.groupBy(F.col("x.patterns").alias("p")).agg(F.sum("x.segments").alias("n"))
    known = learn(sorted((r[0], r[1]) for r in counts.collect()))  # at most the product of SIZES
    shared = stats.sparkSession.sparkContext.broadcast(known)
    names = [key, *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = shared.value
        for b in it:
            rows = []
            for ps, cs in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                whole = sum(cs) if cs else 0
                rows.append([sum(c * post[p][t] for p, c in zip(ps, cs)) / whole for t in range(len(TYPES))] if whole else None)
            cols = [pa.array([None if r is None else r[t] for r in rows], pa.float64()) for t in range(len(TYPES))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], names=[*names, *TYPES])

    schema = f"`{key}` {stats.schema[key].dataType.simpleString()}, {COLUMNS}, " + ", ".join(f"{t} double" for t in TYPES)
    out = stats.select(*names, "patterns", "chars").mapInArrow(run, schema)
    others = F.greatest(*TYPES[1:])
    kind = F.when(F.col("prose") >= 0.5, "prose")
    for t in TYPES[1:]:
        kind = kind.when(F.col(t) == others, t)
    return out.withColumn("type", kind)
