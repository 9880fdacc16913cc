"""Source files that do not parse: least-cost syntax repair by error-correcting chart parsing.

A file is lexed to one symbol for each token. Its brackets (for Python also its indented blocks) become chart cells
from the innermost out; equal contents share a cell. The whole file is valid exactly if its cell holds the rule
``module``. Otherwise each cell without a rule is repaired, and number and places of the edits tell what happened.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.automata import cell
from codeweft.llm.grammars import BREAK, GENERIC, rules
from codeweft.llm.lexing import BAD, ID, LIFE, LINE, NL, NUM, STR, language_of, lexer

#: Equal contents that are kept with their cells.
CELLS_KEPT = 200_000


#: Chart items, closures and steps that a worker's parser keeps before it starts anew.
MOST_KEPT = 3_000_000


def _unmatched(rest: list[tuple[str, int]], closer: dict[str, str], out: dict[int, int]) -> list[tuple[str, int]]:
    """``rest`` without brackets that have none of their kind to pair with on their side, and without the pairs that then
    stand side by side, which go to ``out``; some choice of the most pairs has all of these."""
    opener = {a: b for b, a in closer.items()}
    n = -1
    while n != len(rest):
        n = len(rest)
        later = Counter(c for c, _ in rest if c in closer)
        before: Counter[str] = Counter()
        kept: list[tuple[str, int]] = []
        for c, k in rest:
            if c not in closer:
                if later[opener[c]]:
                    before[c] += 1
                    kept.append((c, k))
                continue
            later[c] -= 1
            if kept and kept[-1][0] == closer[c]:
                out[k] = kept.pop()[1]
                before[closer[c]] -= 1
            elif before[closer[c]]:
                kept.append((c, k))
        rest = kept
    return rest


def _most_pairs(rest: list[tuple[str, int]], closer: dict[str, str]) -> dict[int, int]:
    """The most pairs that don't cross: {place of the closing one: place of the opening one}.

    Row i holds the most pairs between i and each later place. A pair counts for a row only if it beats what the row has
    up to its end without it, so few closing brackets are tried for an opening one.
    """
    out: dict[int, int] = {}
    rest = _unmatched(rest, closer, out)
    n = len(rest)
    closing: dict[str, list[int]] = {}
    none = np.zeros(1, np.int16 if n < 1 << 16 else np.int32)
    best: list[np.ndarray] = [none] * (n + 1)  # best[i][j - i] is of the places i to j - 1
    tried: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        c = rest[i][0]
        row = np.concatenate((none, best[i + 1]))
        if c in closer:
            closing.setdefault(closer[c], []).append(i)
        for m in reversed(closing.get(c, ())):
            more = 1 + best[i + 1][m - i - 1]
            if more > row[m + 1 - i]:
                np.maximum(row[m + 1 - i :], more + best[m + 1], out=row[m + 1 - i :])
                tried[i].append(m)
        best[i] = row
    todo = [(0, n)]
    while todo:
        i, j = todo.pop()
        while i < j and best[i][j - i]:
            m = next((m for m in tried[i] if m < j and best[i][j - i] == 1 + best[i + 1][m - i - 1] + best[m + 1][j - m - 1]), None)
            if m is not None:
                out[rest[m][1]] = rest[i][1]
                todo.append((i + 1, m))
                i = m + 1
            else:
                i += 1
    return out


_CONFLICT = re.compile(r"(?ms)^<{7}[^\n]*\n(.*?)(?:^\|{7}[^\n]*\n.*?)?^={7}[ \t\r]*\n.*?^>{7}[^\n]*\n?")


class Parser:
    def __init__(self, language: str):
        self.language, self.lex, self.rules = language, lexer(language), rules(language)
        sym = self.lex.symbol
        self.round, self.square, self.curly = (sym["("], sym[")"]), (sym["["], sym["]"]), (sym["{"], sym["}"])
        o, c = "".join(p[0] for p in self._pairs()), "".join(p[1] for p in self._pairs())
        self.inner = re.compile("|".join(f"{re.escape(a)}([^{re.escape(o + c)}]*){re.escape(b)}" for a, b in self._pairs()))
        self.brackets = re.compile(f"[{re.escape(o + c)}]")
        self.lines = re.compile(f"[{chr(LINE)}-{chr(0xD7FF)}]")
        self.cells: dict[tuple[str, str], str] = {}
        self.repaired: dict[tuple[str, str, int], tuple[int, int]] = {}
        self.failed: list[tuple[str, str]] | None = None
        words = lambda t: "".join(re.escape(sym[w]) for w in t.split() if w in sym)
        if language == "go":
            enders = "".join((ID, NUM, STR)) + words("break continue fallthrough return ++ -- ) ] }")
            self.ends, self.semi = re.compile(f"([{enders}]){NL}"), rf"\1{sym[';']}"
        elif language in ("javascript", "typescript"):
            soft = words(" ".join(w for w in sym if w.isalpha() and w not in ("in", "of", "instanceof", "as", "extends", "from", "is", "satisfies", "implements")))
            closers = "".join((ID, NUM, STR)) + words(") ] } ++ -- this super null true false return break continue debugger yield let of async get set static from as type any string")
            names = words(" ".join(w for w in sym if w.isalpha()))
            starters = "".join((ID, NUM, STR, BAD)) + soft + words("{ ++ -- ! ~ @ #")
            self.ends = re.compile(f"([{closers}{names}]){NL}(?=[{starters}])")
            self.paren_brace = re.compile(f"({re.escape(sym[')'])}){BREAK}(?={re.escape(sym['{'])})")
            self.more = re.compile(f"(?<=[{words('return break continue')}]){NL}")
        if language in ("java", "rust", "typescript"):
            inside = "".join((ID, LIFE, GENERIC, NUM, STR, NL, BREAK)) + words(". , ? & && | : :: [ ] extends super + * mut dyn impl -> => = - @ self Self crate const keyof readonly typeof infer unique in is as null true false this void string for type of get set from async static fn _ ! ( ) ...")
            self.generic = re.compile(f"{re.escape(sym['<'])}((?:[{inside}]|[{chr(0xE000)}-{chr(0xEBFF)}])*){re.escape(sym['>'])}")
        else:
            self.generic = None

    def _pairs(self):
        return self.round, self.square, self.curly

    def _cell(self, kind: str, content: str) -> str:
        key = (kind, content)
        known = self.cells.get(key)
        if known is None:
            if len(self.cells) > CELLS_KEPT:
                self.cells.clear()
            bits = self._derive(kind, content)[0]
            known = self.cells[key] = cell(kind, bits)
        if self.failed is not None and known == cell(kind, 0):
            self.failed.append(key)
        return known

    def _forms(self, kind: str, content: str) -> list[str]:
        """The content, with and without taking what may be generic arguments together."""
        language = self.language
        if language in ("javascript", "typescript"):
            content = content.replace(BREAK, "") if kind != "B" else content + BREAK
        elif language == "go":
            semi = self.lex.symbol[";"]
            content = content + semi if kind == "B" or content.endswith(semi) or semi in content else content
            if kind == "S" or kind == "P" and content.count(semi) == 1 and content.endswith(semi):
                content = content.replace(semi, "")
        elif language == "python" and kind != "B":
            content = self.lines.sub("", content)
        forms = [content]
        if self.generic and self.lex.symbol["<"] in content:
            other, n = content, 1
            while n:
                other, n = self.generic.subn(GENERIC, other)
            if other != content:
                forms.insert(0, other)
        return forms

    def _derive(self, kind: str, content: str) -> tuple[int, str]:
        bits, best = 0, ""
        for form in self._forms(kind, content):
            got, _ = self.rules.kinds[kind].run(form)
            bits |= got
            best = best or form
        return bits, best

    def _fold(self, s: str) -> str:
        kinds = {self.round[0]: "P", self.square[0]: "S", self.curly[0]: "B"}

        def one(m: re.Match) -> str:
            t = m.group()
            return self._cell(kinds[t[0]], t[1:-1] if self.language != "python" else self.lines.sub("", t[1:-1]))

        n = 1
        while n:
            s, n = self.inner.subn(one, s)
        return s

    def symbols(self, text: str) -> str:
        s = self.lex.symbols(text)
        if self.language == "go":
            s = self.ends.sub(self.semi, s).replace(NL, "")
        elif self.language in ("javascript", "typescript"):
            s = self.ends.sub(rf"\1{BREAK}", s)
            s = self.paren_brace.sub(r"\1", s)
            s = self.more.sub(BREAK, s).replace(NL, "")
        return s

    def balance(self, s: str, least: bool = True) -> tuple[str, list[tuple[str, int]]]:
        """``s`` with the least brackets added or left out such that they nest, and those edits with their places in ``s``.

        Brackets that nest as they stand drop out first; among the rest the most pairs that don't cross are kept.
        Without ``least`` one edit stands for any number, and ``s`` comes back as it is.
        """
        pairs = dict(self._pairs())
        closer = {b: a for a, b in self._pairs()}
        marks = [(m.group(), m.start()) for m in self.brackets.finditer(s)]
        mate: dict[int, int] = {}  # places of closing brackets to those of their opening ones
        rest: list[tuple[str, int]] = []
        for c, k in marks:
            if rest and closer.get(c) == rest[-1][0]:
                mate[k] = rest.pop()[1]
            else:
                rest.append((c, k))
        if not rest:
            return s, []
        if not least:
            return s, [("delete", rest[0][1])]
        mate.update(_most_pairs(rest, closer))
        stack: list[tuple[str, int]] = []
        edits, out, at = [], [], 0
        for c, k in marks:
            if c in pairs:
                stack.append((c, k))
            elif k not in mate:
                out.append(s[at:k])
                at = k + 1
                edits.append(("delete", k))
            else:
                if stack[-1][1] != mate[k]:
                    out.append(s[at:k])
                    at = k
                while stack[-1][1] != mate[k]:
                    out.append(pairs[stack.pop()[0]])
                    edits.append(("insert", k))
                stack.pop()
        out.append(s[at:])
        while stack:
            out.append(pairs[stack.pop()[0]])
            edits.append(("insert", len(s)))
        return "".join(out), edits

    def _indent(self, s: str) -> tuple[str, int]:
        """Python's lines folded to blocks; the number of lines that fit no column."""
        bad = 0
        levels, bodies = [0], [[]]
        parts = self.lines.split(s)
        marks = self.lines.findall(s)
        widths = [0 if not marks or parts[0] else None, *(ord(m) - LINE for m in marks)]
        for width, part in zip(widths, parts):
            if not part:
                continue
            width = width or 0
            while width < levels[-1]:
                body = "".join(bodies.pop())
                levels.pop()
                if width > levels[-1]:
                    bad += 1
                    levels.append(width)
                    bodies.append([body])
                    break
                bodies[-1].append(self._cell("B", body))
            if width > levels[-1]:
                levels.append(width)
                bodies.append([])
            bodies[-1].append(part + "N")
        while len(levels) > 1:
            body = "".join(bodies.pop())
            levels.pop()
            bodies[-1].append(self._cell("B", body))
        return "".join(bodies[0]), bad

    def valid(self, text: str) -> bool:
        return not self.check(text, False)[0]

    def check(self, text: str, repair: bool = True) -> tuple[int, str]:
        """(number of edits, cause); (0, "") for a valid file. Without repair: 1 for any number."""
        s = self.symbols(text)
        self.failed = None
        if not self.lines.sub("", s):  # nothing but blanks and comments
            return 0, ""
        flat, edits = self.balance(s, repair)
        if edits and not repair:
            return 1, ""
        odd = 0
        folded = self._fold(flat)
        if self.language == "python":
            folded, odd = self._indent(folded)
        bits, _ = self._derive("B", folded)
        module = 1 << self.rules.contents["B"].index("module")
        if not edits and not odd and bits & module:
            return 0, ""
        if not repair:
            return 1, ""
        self.failed = []
        folded = self._fold(flat)
        if self.language == "python":
            folded, _ = self._indent(folded)
        keys = [*self.failed, *([("B", folded)] if not bits & module else [])]
        self.failed = None
        number, ends = len(edits) + odd, sum(1 for kind, k in edits if kind == "insert" and k >= len(s))
        for (kind, content), times in Counter(keys).items():
            cost, late = self._repair(kind, content, module if (kind, content) == ("B", folded) else (1 << 10) - 1)
            number, ends = number + cost * times, ends + late * times
        number = max(number, 1)
        return number, self.cause(text, number, ends, len(s))

    def _repair(self, kind: str, content: str, want: int) -> tuple[int, int]:
        """(edits of the content's repair, those of them that add something at its end); equal contents share one."""
        key = (kind, content, want)
        known = self.repaired.get(key)
        if known is None:
            if len(self.repaired) > CELLS_KEPT:
                self.repaired.clear()
            way = min((self.rules.kinds[kind].repair(form, want) for form in self._forms(kind, content)), key=len)
            known = self.repaired[key] = len(way), sum(1 for how, k in way if how == "insert" and k >= len(content) - 1)
        return known

    def cause(self, text: str, number: int, ends: int, size: int) -> str:
        """From number and places of the edits: at marker lines, the whole file, its end, or some place within.

        The edits are at marker lines if most are gone once each marked conflict is settled for its first side.
        """
        if _CONFLICT.search(text) and self.check(_CONFLICT.sub(r"\1", text))[0] * 2 < number:
            return "conflict"
        if number > max(6, size // 5):
            return "mismatch"
        if ends and ends * 2 >= number:
            return "truncation"
        return "local"

    def kept(self) -> int:
        r = self.rules
        return len(r.closed) + len(r.going) + len(r.stacks) + sum(map(len, (t for d in r.kinds.values() for t in d.table)))


_parsers: dict[str, Parser] = {}


def parser(language: str, fresh: bool = False) -> Parser:
    if fresh or language not in _parsers:
        _parsers[language] = Parser(language)
    return _parsers[language]


def check_files(files: DataFrame, path: str = "path", text: str = "content", repair: bool = True) -> DataFrame:
    """(path, language, edits, cause) of each row whose path's extension names one of the six languages.

    ``edits`` is 0 for valid and for empty files; null texts count as empty. Rows repeat as they do in ``files``.
    Without ``repair`` edits is 1 for all invalid files and cause is ''.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for language in [x for x, p in _parsers.items() if p.kept() > MOST_KEPT]:
                parser(language, fresh=True)
            out = ([], [], [], [])
            for p, t in zip(*(c.to_pylist() for c in b.columns)):
                language = language_of(p)
                if language is None:
                    continue
                edits, cause = parser(language).check(t or "", repair)
                for column, v in zip(out, (p, language, edits, cause)):
                    column.append(v)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["path", "language", "edits", "cause"])

    code = F.lower(F.col(path)).rlike(r"\.(py|js|ts|java|go|rs)$")
    return files.where(code).select(path, text).mapInArrow(run, "path string, language string, edits int, cause string")
