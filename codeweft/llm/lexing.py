"""Source text to token symbols: one character for each token, so that layouts and grammars work on short strings.

Six languages. A token's text is looked up in a table that fills itself; only new texts are classed, so a file costs one
regular expression pass and one table look-up for each token.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Languages by the extension of a path.
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust"}

# Reserved words and the words that are names except in places.
WORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "javascript": "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield null true false of async get set static from as",
    "java": "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while null true false record permits sealed yield when",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
}
WORDS["typescript"] = WORDS["javascript"] + " enum implements interface type namespace module declare abstract public private protected readonly override keyof infer is satisfies any_ unique asserts"
#: Words above that are names too.
SOFT = {
    "python": "match case type", "javascript": "of async get set static from as let", "java": "record permits sealed yield when",
    "go": "", "rust": "",
    "typescript": "of async get set static from as let type namespace module declare abstract public private protected readonly override keyof infer is satisfies any_ unique asserts enum implements interface",
}
WORDS["typescript"] = WORDS["typescript"].replace(" any_", "")
SOFT["typescript"] = SOFT["typescript"].replace(" any_", "").replace(" enum", "")

# Operators, longest first; "<" and ">" stand alone where type arguments may close.
OPS = {
    "python": "**= //= >>= <<= ... -> := ** // << >> <= >= == != += -= *= /= %= &= |= ^= @= ( ) [ ] { } , : . ; @ = + - * / % & | ^ ~ < >",
    "javascript": "... === !== **= <<= &&= ||= ??= => ** ++ -- << <= >= == != && || ?? ?. += -= *= /= %= &= |= ^= ( ) [ ] { } , : . ; ? = + - * / % & | ^ ~ ! < > @ #",
    "java": "... -> :: ++ -- << <= >= == != && || += -= *= /= %= &= |= ^= <<= ( ) [ ] { } , : . ; ? @ = + - * / % & | ^ ~ ! < >",
    "go": "... <<= >>= &^= &^ := <- ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= ( ) [ ] { } , : . ; = + - * / % & | ^ ~ ! < >",
    "rust": "..= ... .. -> => :: <<= << <= >= == != && || += -= *= /= %= &= |= ^= ( ) [ ] { } , : . ; ? @ # $ = + - * / % & | ^ ~ ! < >",
}
OPS["typescript"] = OPS["javascript"]

_STRING = {
    "python": r"[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')",
    "javascript": r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{(?:[^{}]|\{[^{}]*\})*\})*\})*`",
    "java": r"\"\"\"[^\S\n]*\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'",
    "go": r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'",
    "rust": r"b?r(#*)\"(?:[^\"]|\"(?!\1))*\"\1|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,6}\}|.))'|'[A-Za-z_]\w*(?!')",
}
_STRING["typescript"] = _STRING["javascript"]
_COMMENT = {"python": r"#[^\n]*", "rust": r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"}
_REGEX = r"(?:(?<=[=(,:;!&|?{}\[\n+*%<>~^])|(?<=[=(,:;!&|?{}\[] )|(?<=return )|^)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*(?![\w(])"
_NUMBER = {
    "python": r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|(?:0|[1-9](?:_?\d)*)[jJ])",
    "javascript": r"(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?|\d[\d_]*n)",
    "java": r"(?:0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?)",
    "go": r"(?:0[xX][0-9a-fA-F_]+|0[oO]?[0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)",
    "rust": r"(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.\d[\d_]*)?\.?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?",
}
_NUMBER["typescript"] = _NUMBER["javascript"]
_NUMBER_TEXT = {"rust": r"\d(?:[eE][+-]?\d|\.(?![.A-Za-z_])|\w)*"}

ID, NUM, STR, NL, BAD, LIFE = "inzN!L"
#: Symbols of words and operators begin here, in the order of the tables; line starts of Python carry their column.
FIRST, LINE = 0x100, 0x4E00


class Lexer:
    """With ``layout`` each line start is a symbol that carries its column, in every language."""

    def __init__(self, language: str, layout: bool = False):
        self.language, self.layout = language, layout
        literals = WORDS[language].split() + OPS[language].split()
        self.symbol = {t: chr(FIRST + k) for k, t in enumerate(literals)}
        self.text = {c: t for t, c in self.symbol.items()}
        comment = _COMMENT.get(language, r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/")
        ops = "|".join(re.escape(o) for o in sorted(OPS[language].split(), key=len, reverse=True))
        number = _NUMBER_TEXT.get(language, r"(?:\d|\.\d)(?:[eE][+-]\d|[\w.])*")
        alike = [r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)+[ \t\f]*|\\\r?\n"] if language == "python" else [r"(?:[ \t\f]*\r?\n)+"] if language in ("go", "javascript", "typescript") else []
        if layout:
            alike = [r"(?:[ \t\f]*\r?\n)+[ \t\f]*"]
        parts = [*alike, comment, _STRING[language]] + ([_REGEX] if language in ("javascript", "typescript") else [])
        parts += [r"[^\W\d]\w*" if language != "javascript" and language != "typescript" else r"#?[^\W\d][\w$]*|\$[\w$]*", number, ops, r"[^\s]"]
        self.pattern = re.compile("|".join(p.replace("(#*)", "(?P<h>#*)").replace(r"\1", "(?P=h)") for p in parts), re.M)
        self.strict = re.compile(_NUMBER[language])
        lexer = self

        class Table(dict):
            def __missing__(self, token: str) -> str:
                c = lexer.classify(token)
                if len(token) < 40:
                    if len(self) > 200_000:
                        self.clear()
                        self.update(lexer.symbol)
                    self[token] = c
                return c

        self.table = Table(self.symbol)

    def classify(self, t: str) -> str:
        c, language = t[0], self.language
        if self.layout and "\n" in t and c in " \t\f\r\n":
            return chr(LINE + min(len(t[t.rfind("\n") + 1 :].expandtabs(8)), 999))
        if language == "python" and "\n" in t and c in " \t\f#\r\n\\":
            if c == "\\":
                return ""
            return chr(LINE + len(t[t.rfind("\n") + 1 :].replace("\f", "").expandtabs(8)))
        if language != "python" and (t.startswith(("//", "/*"))) and len(t) > 1:
            return NL if "\n" in t and language in ("go", "javascript", "typescript") else ""
        if c == "#" and language == "python":
            return ""
        if c.isspace():
            return NL
        if c in "\"`" or c == "'" and t[-1] == "'" and len(t) > 1:
            return STR if len(t) > 1 else BAD
        if c == "'":
            return LIFE if len(t) > 1 else BAD
        if len(t) > 1 and t[-1] in "\"'#" and re.match(r"[A-Za-z#]{0,3}[\"']|b?r#*\"", t):
            return STR
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return NUM if self.strict.fullmatch(t) else BAD
        if c == "/" and len(t) > 1:
            return STR
        if t.isidentifier() or c in "$#" and len(t) > 0 and language in ("javascript", "typescript") and (c == "$" or len(t) > 1):
            return ID
        return BAD

    def tokens(self, text: str) -> list[str]:
        if text.startswith("﻿"):
            text = text[1:]
        if self.language in ("javascript", "typescript") and text.startswith("#!"):
            text = text[text.find("\n") if "\n" in text else len(text) :]
        if self.language == "rust":
            if text.startswith("#!") and not text.startswith("#!["):
                text = text[text.find("\n") if "\n" in text else len(text) :]
            return [m.group() for m in self.pattern.finditer(text)]
        return self.pattern.findall(text)

    def symbols(self, text: str) -> str:
        return "".join(map(self.table.__getitem__, self.tokens(text)))


@lru_cache(16)
def lexer(language: str, layout: bool = False) -> Lexer:
    return Lexer(language, layout)


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1]) if path and "." in path.rsplit("/", 1)[-1] else None
