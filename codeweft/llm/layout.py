"""Generated, minified, vendored and data files among source code, by comparing layouts.

Each file is lexed and emitted again in canonical layout: a line for each statement and bracket edge, indented by depth.
Where that has many times the file's own lines, of which few are left as they were, the file is minified; where its
pieces repeat one shape, line breaks and columns included, without a deviation, a tool wrote it; where literals make up
the tokens, it is data. Copies of outside libraries are found by the share of normalized lines that a file has in common
with one library file, in either direction. What layout does not show, a tool's mark at the head may.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.lexing import ID, LINE, NL, NUM, STR, language_of, lexer

#: Canonical lines for each line from which on a file is minified, the average line length that goes with it, and the
#: share of canonical lines that the file has as lines of its own, below which it is.
EXPANSION, WIDE, SAME = 3.0, 90, 0.5
#: Share of the most frequent shape among a file's pieces, and the least number of pieces.
UNIFORM, PIECES = 0.8, 5
#: Share of literals among a file's tokens or characters.
LITERALS, LITERAL_CHARS = 0.5, 0.7
#: Share of lines in common with a library file; shorter lines say nothing.
COMMON, LINE_LEAST = 0.5, 12
#: Library files of up to so many characters in all are sent to all executors; more are joined by lines.
LIBRARIES_MOST = 50_000_000

# What tools write at the head of their output, in several languages: the known marks, and a word for
# being made together with the tool that did it or a warning not to edit.
MARKS = re.compile(
    r"(?im)^\W*(?:code generated by (?!our|my|the|this)\S.{0,60}do not edit\.?|autogenerated(?: file)?\b.{0,60}|<auto-?generated\b.*|@generated(?: by \S.*| signedsource.*|\s*)"
    r"|(?:this \w+ (?:is|was) )?auto(?:matically)?[- ]generated\b.{0,80}"
    r"|.*\b(?:generated|produced|created|written|emitted|erzeugt|generiert|produit|généré|generado|generato|сгенерирован\w*|生成)\b.{0,60}"
    r"\b(?:(?:do|must) not (?:edit|modify|change)|nicht (?:bearbeiten|ändern|editieren)|(?:ne pas|toute) modif\w*|no (?:editar|modificar)|compiler\b.{0,20}\d|protoc|не (?:изменя|редактир)\w*).*)$"
)
_BY_HAND = re.compile(r"(?i)\bhand|\belsewhere|\bour exporter\b|\bskip")
_HEAD_COMMENT = re.compile(r"\A(?:\s*(?:#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|package [\w.]+;?|[\"']use strict[\"'];?)\s*?(?:\n|\Z))+")
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*)")


def head_marked(text: str) -> bool:
    """Whether a comment at the file's head, beside which only a package line may stand, is a tool's mark."""
    m = _HEAD_COMMENT.match(text)
    if not m:
        return False
    head = "\n".join(x for x in m.group().replace("\r", "").split("\n") if not re.match(r"\s*package ", x) and not _BY_HAND.search(x))
    return MARKS.search(head) is not None


def norm_lines(text: str) -> set[str]:
    """Lines without white space, comments and short lines left out."""
    lines = ("".join(x.split()) for x in text.split("\n") if len(x) >= LINE_LEAST and not _COMMENT.match(x))
    return {x for x in lines if len(x) >= LINE_LEAST}


class Libraries:
    """Lines of library files; those of more than two libraries are common property and don't count."""

    def __init__(self, files: list[tuple[str, str]]):
        sets = [(lib, norm_lines(text or "")) for lib, text in files]
        held: dict[str, set[str]] = {}
        for lib, lines in sets:
            for x in lines:
                held.setdefault(x, set()).add(lib)
        self.sizes, self.where = [], {}
        for k, (_, lines) in enumerate(sets):
            own = {x for x in lines if len(held[x]) <= 2}
            self.sizes.append(len(own))
            for x in own:
                self.where.setdefault(x, []).append(k)

    def share(self, text: str) -> float:
        lines = norm_lines(text)
        hits: Counter = Counter()
        for x in lines:
            for k in self.where.get(x, ()):
                hits[k] += 1
        return max((max(n / self.sizes[k] if self.sizes[k] >= 3 else 0, n / len(lines) if n >= 4 else 0) for k, n in hits.items()), default=0.0)


_LINES = re.compile(f"[{chr(LINE)}-{chr(LINE + 999)}]")


class Layout:
    """Canonical layout of one language, on strings of one symbol for each token."""

    def __init__(self, language: str):
        self.language, self.lex = language, lexer(language, layout=True)
        sym = self.lex.symbol
        self.open, self.close, semi = sym["{"], sym["}"], sym[";"]
        edges = re.escape(semi) if language == "python" else re.escape(semi + self.open + self.close)
        self.cut = re.compile(f"[^{edges}]*[{edges}]|[^{edges}]+")
        self.edge = re.compile(f"[{edges}]")
        self.semi = semi
        ends = re.escape("".join((ID, NUM, STR, sym[")"], sym["]"], sym["}"])))
        self.statement = re.compile(f"(?<=[{ends}])[{chr(LINE)}-{chr(LINE + 999)}]")  # a line's end that ends a statement

    def emit(self, s: str) -> list[tuple[int, str]]:
        """The canonical lines of symbols with line marks, each with its depth."""
        if self.language == "python":
            columns = [0, *(ord(c) - LINE for c in _LINES.findall(s))]
            return [(k, y) for k, line in zip(columns, _LINES.split(s)) for x in self.cut.findall(line) if (y := x.rstrip(self.semi))]
        if self.language in ("go", "javascript", "typescript"):
            s = self.statement.sub(self.semi, s)
        depth, out = 0, []
        for line in self.cut.findall(_LINES.sub("", s)):
            if line == self.semi:
                continue
            body, edge = (line[:-1], line[-1]) if line[-1] in (self.open, self.close, self.semi) else (line, "")
            if edge == self.close:
                if body:
                    out.append((depth, body))
                depth = max(0, depth - 1)
                out.append((depth, edge))
            else:
                out.append((depth, body + edge if edge == self.open else body))
                depth += edge == self.open
        return out

    def pieces(self, s: str) -> tuple[list[str], list[str]]:
        """Slices of ``s``, layout included, at the top, and within the outermost brackets or blocks."""
        if self.language == "python":
            widths = sorted({ord(c) - LINE for c in _LINES.findall(s)} - {0})
            tops = (chr(LINE), chr(LINE) + (f"-{chr(LINE + widths[0])}" if widths else ""))
            return tuple([x for x in re.split(f"[{top}]+", s) if x] for top in tops)
        top: list[str] = []
        inner: list[str] = []
        depth = at = at_inner = 0
        for m in self.edge.finditer(s):
            c, end = m.group(), m.end()
            if c == self.open:
                depth += 1
                if depth == 1:
                    at_inner = end
                continue
            if c == self.close:
                depth = max(0, depth - 1)
                if depth == 0:
                    at_inner = end
            elif depth == 0:
                at_inner = end
            if depth == 0:
                top.append(s[at:end])
                at = end
            elif depth == 1:
                inner.append(s[at_inner:end])
                at_inner = end
        return tuple([y for x in out if (y := x.lstrip(_MARKS).rstrip(_MARKS))] for out in (top, inner))

    def uniform(self, s: str) -> float:
        """Share of the most frequent shape among the pieces of several lines; 0 for few pieces.

        A shape is a piece's symbols and line marks: names and literals count as one, words, marks and layout as they are.
        """
        best = max(([p for p in pieces if _LINES.search(p)] for pieces in self.pieces(s)), key=len)
        return Counter(best).most_common(1)[0][1] / len(best) if len(best) >= PIECES else 0.0


_LITERAL = frozenset((STR, NUM))
_MARKS = "".join(map(chr, range(LINE, LINE + 1000)))
_layouts: dict[str, Layout] = {}


def measure(language: str, text: str) -> dict[str, float]:
    """Expansion, average line, lines left as they were, uniformity and share of literals of one file."""
    if language not in _layouts:
        _layouts[language] = Layout(language)
    layout = _layouts[language]
    lex = layout.lex
    tokens = lex.tokens(text)
    symbols = [*map(lex.table.__getitem__, tokens)]
    sym = lex.symbol
    s = "".join(symbols).replace(NL, "")
    n = max(1, sum(1 for x in text.split("\n") if x and not x.isspace()))
    canonical = layout.emit(s)
    own = Counter(x.rstrip(layout.semi) for x in _LINES.split(s) if x)
    same = sum((Counter(x for _, x in canonical) & own).values())
    literals = [t for t, c in zip(tokens, symbols) if c in _LITERAL]
    literal_chars = sum(map(len, literals))
    plain = sum(len(t) for t in literals if len(t) > 60 and t.count(" ") * 12 > len(t))
    count = Counter(s)
    data = count[STR] + count[NUM] + count[sym[","]] + count[sym["-"]]
    every = sum(v for k, v in count.items() if not 0x4E00 <= ord(k) < 0xD800)
    chars = len("".join(text.split())) or 1
    return {
        "expansion": max(1, len(canonical)) / n,
        "same": same / max(1, len(canonical)),
        "width": len(text) / n,
        "uniform": layout.uniform(s),
        "literal_tokens": data / every if every >= 30 else 0.0,
        "literal_chars": (literal_chars - plain) / chars if chars >= 400 else 0.0,
        "code_tokens": every - data,
    }


def kind_of(language: str, text: str, libraries: Libraries | None) -> tuple[str, float]:
    """(kind, strength): minified, generated, data, vendored or '' for a hand-written file."""
    if not text or text.isspace():
        return "", 0.0
    m = measure(language, text)
    if m["expansion"] >= EXPANSION and m["width"] >= WIDE and m["same"] < SAME:
        return "minified", m["expansion"]
    if libraries and (share := libraries.share(text)) >= COMMON:
        return "vendored", share
    if m["uniform"] >= UNIFORM:
        return "generated", m["uniform"]
    if m["literal_tokens"] >= LITERALS:
        return "data", m["literal_tokens"]
    if m["literal_chars"] >= LITERAL_CHARS and m["code_tokens"] < 150:
        return "data", m["literal_chars"]
    return ("generated", 1.0) if head_marked(text) else ("", 0.0)


def _lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` with each normalized line of the text once, as :func:`norm_lines` has them."""
    rows = df.select(*keep, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("__x"))
    rows = rows.where(~F.col("__x").rlike(r"(?U)^\s*(?://|#|/\*|\*)")).select(*keep, F.regexp_replace("__x", r"(?U)[\s\x1c-\x1f]+", "").alias("line"))
    return rows.where(F.length("line") >= LINE_LEAST).distinct()


def shares(files: DataFrame, libraries: DataFrame, path: str = "path", text: str = "content", lib: str = "lib") -> DataFrame:
    """(path, share) as :meth:`Libraries.share` has it, for paths that have a line in common with any library, by joins.

    For libraries too large to send to executors. Lines of more than two libraries don't count, so a line meets few
    library files, however many files of the corpus hold it.
    """
    libs = _lines(libraries.where(F.col(text).isNotNull()).select(F.col(lib).alias("__lib"), F.xxhash64(text).alias("__k"), text), text, "__lib", "__k")
    rare = libs.groupBy("line").agg(F.countDistinct("__lib").alias("n")).where("n <= 2").select("line")
    own = libs.join(rare, "line", "left_semi").select("__k", "line").distinct()
    sizes = own.groupBy("__k").agg(F.count("*").alias("size"))
    mine = _lines(files.dropDuplicates([path]), text, path)
    count = mine.groupBy(path).agg(F.count("*").alias("lines"))
    hits = mine.join(own, "line").groupBy(path, "__k").agg(F.count("*").alias("n")).join(sizes, "__k").join(count, path)
    of_library = F.when(F.col("size") >= 3, F.col("n") / F.col("size")).otherwise(0.0)
    of_file = F.when(F.col("n") >= 4, F.col("n") / F.col("lines")).otherwise(0.0)
    return hits.groupBy(F.col(path).alias("path")).agg(F.max(F.greatest(of_library, of_file)).alias("share"))


def classify_files(files: DataFrame, libraries: DataFrame | None = None, path: str = "path", text: str = "content", lib: str = "lib") -> DataFrame:
    """(path, language, kind, strength) of each row of the six languages, by the extension of its path.

    ``libraries`` holds outside libraries' files (``lib``, content); its size is checked before it is sent to the
    executors, and larger ones are joined by lines, with the same result. Null and empty texts are hand-written. Rows
    repeat as they do in ``files``.
    """
    shared = None
    too_large = False
    if libraries is not None:
        size = libraries.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
        too_large = size > LIBRARIES_MOST
        if not too_large:
            rows = [(r[0], r[1]) for r in libraries.select(lib, "content").where(F.col("content").isNotNull()).collect()]
            shared = files.sparkSession.sparkContext.broadcast(Libraries(rows))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else None
        for b in it:
            out = ([], [], [], [])
            for p, t in zip(*(c.to_pylist() for c in b.columns)):
                language = language_of(p)
                if language is None:
                    continue
                for column, v in zip(out, (p, language, *kind_of(language, t or "", known))):
                    column.append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["path", "language", "kind", "strength"])

    code = F.lower(F.col(path)).rlike(r"\.(py|js|ts|java|go|rs)$")
    out = files.where(code).select(path, text).mapInArrow(run, "path string, language string, kind string, strength double")
    if not too_large:
        return out
    held = shares(files.where(code), libraries, path, text, lib).where(F.col("share") >= COMMON)
    held = files.where(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) > 0).select(F.col(path).alias("path")).distinct().join(held, "path")
    copied = F.col("share").isNotNull() & (F.col("kind") != "minified")
    out = out.join(held, "path", "left")
    return out.select("path", "language", F.when(copied, "vendored").otherwise(F.col("kind")).alias("kind"), F.when(copied, F.col("share")).otherwise(F.col("strength")).alias("strength"))
