"""Credentials in source code and configuration: find them across a corpus and mask them in place.

1. Literals are indexed corpus-wide with their owners, all of them: those that may be credentials with points for their
   structure and for where they stand (a name, a URL, a header, a call), all others with those of their structure.
2. A value that many owners hold, in whatever role, is a placeholder, whatever it looks like: values are counted by owner.
3. Rare values whose best place and structure together have enough points are confirmed; plain words and digits only
   if they also stand in few owners' texts, as literals or not.
4. Every file is read again with an automaton over the confirmed values, so that a value is found wherever it stands.
"""

from __future__ import annotations

import base64
import binascii
import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value that stands in more owners' files than this is a placeholder.
MOST_OWNERS = 3
#: Confirmed values in one automaton; beyond it files are read once for each block of values.
BLOCK = 200_000
#: Shortest value that is looked for.
SHORTEST = 6
#: Points of a value's structure and of its place from which on it is confirmed, if it is rare.
ENOUGH = 3
#: Points of structure: a placeholder, a path, sentence or name, plain letters, digits or words, a drawn or chosen value.
FAKE, ODD, WORDS, DRAWN = -4, -2, 0, 2
#: Points of a place: a literal anywhere, an unknown parameter of a URL, one that is named as a secret, one that gives
#: access by what it is (a URL's password, a header, a provider's token, a private key).
ANYWHERE, UNKNOWN, NAMED, SURE = 0, 1, 3, 6

# Words that name a secret, in several languages, as parts of identifiers.
SECRET_WORDS = (
    "password passwd passwort passphrase passcode pass pwd pw kennwort contrasena contraseña motdepasse senha parola "
    "wachtwoord haslo lozinka secret token apikey accesskey authkey privatekey secretkey signingkey encryptionkey "
    "credential credentials cred creds bearer auth authtoken signing hmac hmacseed seed enc salt tok clientsecret key "
    "webhooksecret sessionkey masterkey"
).split()
# An identifier that ends in one of these names something about a secret, not the secret.
ABOUT_WORDS = (
    "field label header name url uri path file length min max ttl type id expiry expires timeout count size hint prefix "
    "policy placeholder regex pattern format backend provider store manager service endpoint rotation index ref mode "
    "public publickey algorithm algo kind message error text title prompt env var"
).split()
# Identifiers of digests and ids.
DIGEST_WORDS = "sha sha1 sha256 sha512 md5 crc digest checksum integrity etag commit revision hash trace traceid uuid guid fingerprint resolved".split()
# Prefixes and forms of tokens that providers give out.
PROVIDER = (
    r"(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w\-]{18,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}"
    r"|[sr]k_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{28,}|pypi-[\w\-]{30,}|AIza[\w\-]{35}|ya29\.[\w\-]{20,}"
    r"|SG\.[\w\-]{16,}\.[\w\-]{16,}|dop_v1_[a-f0-9]{40,}|shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}|hf_[A-Za-z0-9]{30,}"
    r"|eyJ[\w\-]{8,}\.[\w\-]{10,}\.[\w\-]{10,}"
)
# Calls whose literal arguments are taken for credentials.
CALLS = r"login|log_in|signin|sign_in|connect|authenticate|auth|authorize|basic_auth|basicauth|decode_secret|decodesecret|set_password|setpassword|with_password|credentials"
# Whole values that stand for a secret without being one.
PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.•#\-_?]+|<.*>|\{.*\}|\$.*|%\w.*%?|\[.*\]|!\w.*|#\{.*|.*\{\{.*|.*\$\{.*|null|none|nil|true|false|undefined|todo"
    r"|.*(?:replace.?me|change.?(?:me|it)|your.?(?:password|token|key|secret|api)|example|placeholder|dummy|redacted|insert|sample|fixme|goes.?here|set.?me|not.?set).*"
    r"|(?:my|the|your|some|a|new|old|user|db|admin|test)?[ _\-]?(?:password|passwd|pass|secret|token|key|api.?key|passwort|pwd)s?\d{0,3})$"
)
_PROVIDER = re.compile(r"(?<![A-Za-z0-9_])(?:" + PROVIDER + ")")
_LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
_ASSIGN = re.compile(r"([A-Za-z_ñ][\w.\-ñ]*)\\?[\"'\]]?\s*(?::\s*&?\w+(?:<\w+>)?\s*)?(?::=|=>|=(?!=)|:(?!:))\s*")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s:/@\"'`]*):([^\s/@\"'`]{3,})@[\w.\-]+")
_PARAM = re.compile(r"[?&]([\w\-]+)=([^&\s\"'`#]{6,})")
_SECRET_PARAM = re.compile(r"(?i)[\w\-]*(?:key|token|secret|passw(?:or)?d|pwd|sig|signature|auth|access)")
_ESCAPED = re.compile(r'\\"((?:[^"\\\n]|\\\\.)*)\\"()()')  # a literal within a literal
_QUOTED = re.compile(r"[\"'`]([^\s\"'`]{6,200})(?=[\"'`])")
_HEADER = re.compile(r"(?i)\b(basic|bearer)\s+([A-Za-z0-9+/=_\-.~]{8,})")
_FLAG = re.compile(r"(?i)(?:^|\s)--?(?:[\w\-]*(?:token|password|passwd|secret|api-?key|pass|pwd))[ =]([^\s\"'`]{6,})")
_USER = re.compile(r"(?:^|\s)(?:-u|--user)[ =]([^\s:\"'`]+):([^\s\"'`]{4,})")
_CALL = re.compile(r"(?i)(?<![A-Za-z])(?:" + CALLS + r")\s*\(([^()]*)\)")
_PROSE = re.compile(r"(?i)\b(?:log ?in|ssh|sign ?in|connect|user(?:name)?)\b[^\n]{0,60}?(?:\s/\s*|\bwith\s+|\bpassword(?:\s+is)?:?\s+|\bpw:?\s+)(?:[\w.\-]+\s*/\s*)?(\S{6,})")
_SAID = re.compile(r"(?i)\b(?:password|passwd|pass|pwd|token|secret|api[_ ]?key)(?:\s+is)?:?\s+[\"'`]?([^\s\"'`]{8,})")
_WORDS_LINE = re.compile(r"(?i)^\s*(?:export\s+|env\s+|set\s+|arg\s+)?([A-Za-z_][\w.\-]*)\s+(\S{6,})\s*$")
_PIECES = re.compile(r'"([^"\n]{4,})"\s*(?:\+|\.|,|&)\s*"([^"\n]{4,})"|\'([^\'\n]{4,})\'\s*(?:\+|\.|,|&)\s*\'([^\'\n]{4,})\'')
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:[\s\\nrt\"'+,;|#*/]|[A-Za-z0-9+/=])*?)(?:-----END|$|(?=[^A-Za-z0-9+/=\s\\\"'+,;|#*]))")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zñ]+|\d+")
_LEAD = re.compile(r"^\s*(?://|#|\*|/\*|--|;)\s*(?:\w+:\s+)?")  # of a comment, with a note's first word
_COMMENT = re.compile(r"^\s*(?://|#|\*|/\*|--|;|\"\"\")")

#: Strings one of which is on every line that the patterns can fit; the prefilter of the index.
HINTS = (
    "pass pwd pw secret token key cred login log_in auth connect bearer basic akia asia abia acca ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat xox "
    "_live_ npm_ pypi- aiza ya29 sg. dop_v1 shpat hf_ eyj :// kennwort contrase motdepasse mot_de_passe senha parola wachtwoord haslo lozinka signing "
    "sign_in hmac seed enc salt tok ssh user concat"
).split() + ['" + "', "' + '", '"+"', "'+'", " -u "]


@lru_cache(1)
def _hints() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in HINTS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def entropy(s: str) -> float:
    """Bits for each character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def parts(name: str) -> list[str]:
    """The words of an identifier, in lower case."""
    return [w.lower() for w in _NAME.findall(name)]


def names_secret(name: str) -> bool:
    """Whether an identifier says that its value is a secret."""
    w = parts(name)
    if not w or w[-1] in ABOUT_WORDS or "public" in w or any(x in DIGEST_WORDS for x in w):
        return False
    joined = {w[-1], "".join(w[-2:]), "".join(w[-3:])}
    return any(x in SECRET_WORDS for x in joined) or any(x in SECRET_WORDS for x in w if x not in ("key", "pass", "auth", "pw", "seed", "enc", "salt"))


def classes(v: str) -> int:
    return bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^A-Za-z0-9]", v))


def like_password(v: str) -> bool:
    """The structure of a chosen or drawn password: mixed classes with a digit or a mark, no path, sentence or name."""
    if len(v) < SHORTEST or len(v) > 200 or PLACEHOLDER.match(v) or re.search(r"\s", v) or v.count("/") > 1 or v.startswith(("/", "./", "http", "@")):
        return False
    if re.fullmatch(r"[A-Za-z]+[_\-][A-Za-z_\-]+|[A-Za-z]+|[\d.:\-]+|[a-z]+(?:\.[a-z]+)+", v):
        return False
    return classes(v) >= 3 or bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v)) and (len(v) >= 10 or classes(v) >= 3)


def random_like(v: str) -> bool:
    """Drawn at random: long, of high entropy, with upper and lower case and digits in turn."""
    return len(v) >= 12 and classes(v) >= 3 and entropy(v) >= min(3.2, math.log2(len(v)) * 0.85) and len(re.findall(r"[a-z][A-Z0-9]|[A-Z0-9][a-z]", v)) >= 3


def hex_key(v: str) -> bool:
    return len(v) >= 24 and bool(re.fullmatch(r"(?:[0-9a-f]+|[0-9A-F]+)", v)) and entropy(v) > 2.8


def decoded(v: str) -> str | None:
    """The text that base64 ``v`` holds, if it is printable."""
    if len(v) < 8 or not re.fullmatch(r"[A-Za-z0-9+/_\-]+={0,2}", v):
        return None
    try:
        text = base64.b64decode(v + "=" * (-len(v) % 4), altchars=b"-_" if set(v) & set("-_") else None).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return text if text.isprintable() else None


def secret_value(v: str) -> bool:
    """A value that, named as a secret, is one."""
    if PLACEHOLDER.match(v):
        return False
    inner = decoded(v)
    return like_password(v) or hex_key(v) or random_like(v) or inner is not None and like_password(inner)


def plain_value(v: str) -> bool:
    """Letters, digits or words: the form says nothing, so the name must, and few owners may hold it anywhere."""
    return SHORTEST <= len(v) <= 200 and not PLACEHOLDER.match(v) and bool(re.fullmatch(r"[^\W_]+(?:[ _\-.'][^\W_]+)*[.!?]?", v))


def names_plainly(name: str) -> bool:
    """Names a secret and no place: a name whose only such word is ``key`` may be one of a map."""
    w = parts(name)
    return names_secret(name) and w != ["key"]


def drawn_letters(v: str) -> bool:
    """Letters or digits whose case changes within, or digits only: no word of a text."""
    return plain_value(v) and bool(re.fullmatch(r"\d+|(?=.*[a-z][A-Z])(?=.*[A-Z].*[A-Z])[A-Za-z\d]+", v))


def structure(v: str) -> int:
    """Points of a value for its form alone."""
    if PLACEHOLDER.match(v):
        return FAKE
    if secret_value(v):
        return DRAWN
    return WORDS if plain_value(v) else ODD


def candidates(path: str, text: str) -> Iterator[tuple[str, int, int]]:
    """(raw value, its place, points) of each literal whose place says that it may be a credential; none in empty texts."""
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", m.group(2))
            if len(body) >= 40 and entropy(body) > 3.5:
                first = re.search(r"[A-Za-z0-9+/=]{16,}", m.group(2))
                end = m.start(2) + (first.end() if first else 0)
                yield text[m.start() : end], m.start(), SURE + DRAWN
    low = text.lower()
    done, lines = -1, []
    for end, _ in _hints().iter(low):
        if end <= done:
            continue
        a = text.rfind("\n", 0, end + 1) + 1
        done = text.find("\n", end)
        done = len(text) if done < 0 else done
        lines.append((a, done))
    config = not re.search(r"\.(?:py|js|ts|java|go|rs|c|h|cpp|cs|rb|php|kt|scala|swift|tsx|jsx)$", path)
    for a, b in lines:
        yield from _line(text[a:b].rstrip("\r"), a, config)


def _line(line: str, at: int, config: bool) -> Iterator[tuple[str, int, int]]:
    for m in _PROVIDER.finditer(line):
        yield m.group(), at + m.start(), FAKE if PLACEHOLDER.match(m.group()) else SURE + DRAWN
    if "://" in line:
        for m in _URL.finditer(line):
            fake = PLACEHOLDER.match(m.group(2)) or re.search(r"[<>{}$]", m.group(2))
            yield m.group(2), at + m.start(2), (FAKE if fake else SURE + max(structure(m.group(2)), ODD))
    if "=" in line:
        for m in _PARAM.finditer(line):
            name, v = m.group(1), m.group(2)
            if _SECRET_PARAM.fullmatch(name):
                yield v, at + m.start(2), NAMED + (structure(v) if structure(v) != WORDS or drawn_letters(v) else ODD)
            elif random_like(v) and not any(x in ABOUT_WORDS or x in DIGEST_WORDS or x == "k" for x in parts(name)):
                yield v, at + m.start(2), UNKNOWN + structure(v)
    for m in _HEADER.finditer(line):
        inner = decoded(m.group(2))
        basic = m.group(1).lower() == "basic" and inner is not None and re.fullmatch(r"[^:\s]+:(\S{4,})", inner)
        if basic and not PLACEHOLDER.match(inner.split(":", 1)[1]) or m.group(1).lower() == "bearer" and (random_like(m.group(2)) or hex_key(m.group(2))):
            yield m.group(2), at + m.start(2), SURE
    if "-" in line:
        for m in _FLAG.finditer(line):
            v = m.group(1)
            yield v, at + m.start(1), NAMED + (structure(v) if structure(v) != WORDS or drawn_letters(v) else ODD)
        for m in _USER.finditer(line):
            yield m.group(2), at + m.start(2), NAMED + (DRAWN if secret_value(m.group(2)) else ODD)
    for m in _PIECES.finditer(line):
        a, b = (m.group(1), m.group(2)) if m.group(1) is not None else (m.group(3), m.group(4))
        start = m.start(1) if m.group(1) is not None else m.start(3)
        end = m.end(2) if m.group(2) is not None else m.end(4)
        glue = line[m.end(1) if m.group(1) is not None else m.end(3) : m.start(2) if m.group(2) is not None else m.start(4)]
        if "," in glue and "concat" not in line[: m.start()] and "join" not in line:
            continue
        if _PROVIDER.fullmatch(a + b) or (like_password(a + b) and (random_like(a + b) or named_before(line, m.start()))):
            yield line[start:end], at + start, NAMED + DRAWN
    for m in _CALL.finditer(line):
        values = [(x, m.start(1) + y.start() + 1) for y in _LITERAL.finditer(m.group(1)) for x in y.groups() if x is not None]
        if values:
            v, pos = values[-1]
            if "://" not in v:
                yield v, at + pos, NAMED + (DRAWN if secret_value(v) else ODD)
    lead = _LEAD.match(line)
    for m in _ASSIGN.finditer(line, lead.end() if lead else 0):
        if not names_secret(m.group(1)):
            continue
        rest = line[m.end() :]
        lit = _LITERAL.match(rest) or _ESCAPED.match(rest) or (re.match(r'[\w!&.:<>\s]*?\(?\s*"((?:[^"\\]|\\.)*)"()()', rest) if not config and '"' in rest[:24] else None)
        if lit:
            g = next(k for k in (1, 2, 3) if lit.group(k) is not None)
            v, pos = lit.group(g), m.end() + lit.start(g)
        elif config or _COMMENT.match(line) or "export " in line:
            word = re.match(r"[^\s\"'`,;]+", rest)
            if not word or word.group().startswith(("!", "$", "&", "*")):
                continue
            v, pos = word.group(), m.end()
        else:
            continue
        if "://" in v:
            continue
        points = structure(v)
        if points == WORDS and not (names_plainly(m.group(1)) and (lit or line[pos + len(v) :].strip() in ("", ",", ";"))):
            points = ODD
        yield v, at + pos, NAMED + points
    if config:
        m = _WORDS_LINE.match(line)
        if m and names_secret(m.group(1)):
            points = structure(m.group(2))
            if points == WORDS and not (len(parts(m.group(1))) > 1 and names_plainly(m.group(1))):
                points = ODD
            yield m.group(2), at + m.start(2), NAMED + points
    if config or _COMMENT.match(line):
        for pattern in (_PROSE, _SAID):
            for m in pattern.finditer(line):
                v = m.group(1).rstrip(".,;:)")
                if "://" not in v and "=" not in v[:-2]:
                    yield v, at + m.start(1), NAMED + (DRAWN if like_password(v) and classes(v) >= 3 else ODD)


def named_before(line: str, end: int) -> bool:
    m = re.findall(r"[A-Za-z_][\w]*", line[:end])
    return any(names_secret(w) for w in m[-4:])


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms: dict[str, int] = {}  # of literals of the batch
    for b in it:
        out: dict[tuple[str, str], int] = {}
        for path, owner, text in zip(*(c.to_pylist() for c in b.columns)):
            if not text:
                continue
            owner = owner if owner is not None else (path or "").split("/")[0]
            for raw in set(_QUOTED.findall(text)):
                if (raw, owner) not in out:
                    known = forms.get(raw)
                    if known is None:
                        known = forms[raw] = ANYWHERE + structure(raw)
                    out[raw, owner] = known
            for raw, _, points in candidates(path or "", text):
                if raw and points > out.get((raw, owner), FAKE - 1):
                    out[raw, owner] = points
        forms.clear()
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(out.values(), pa.int8())], names=["raw", "owner", "points"])


def index_literals(files: DataFrame, path: str = "path", text: str = "content", owner: str | None = "repo") -> DataFrame:
    """Literals as (raw, owner, points), each once for each owner and batch of files. Null paths and texts have none.

    Quoted literals come wherever they stand, other values where their place says that they may be credentials.
    """
    who = F.col(owner) if owner else F.lit(None).cast("string")
    return files.select(F.col(path), who, F.col(text)).where(F.col(text).isNotNull()).mapInArrow(_rows, "raw string, owner string, points byte")


def confirm(index: DataFrame, most_owners: int = MOST_OWNERS, enough: int = ENOUGH) -> DataFrame:
    """Values (raw, owners, points) with ``enough`` points anywhere that no more than ``most_owners`` owners hold.

    Wider spread ones are placeholders. Owners are counted in two steps, so that no task sees all rows of a value that
    stands everywhere.
    """
    pairs = index.groupBy("raw", "owner").agg(F.max("points").alias("points"))
    values = pairs.groupBy("raw").agg(F.count("*").alias("owners"), F.max("points").alias("points"))
    return values.where((F.col("owners") <= most_owners) & (F.col("points") >= enough))


def without_words(confirmed: DataFrame, files: DataFrame, path: str = "path", text: str = "content", owner: str | None = "repo", most_owners: int = MOST_OWNERS, block: int = BLOCK) -> DataFrame:
    """``confirmed`` without the plain values (just NAMED + WORDS points) that more owners hold anywhere in their texts."""
    plain = confirmed.where(F.col("points") == NAMED + WORDS)
    who = F.coalesce(F.col(owner), F.element_at(F.split(path, "/"), 1)) if owner else F.element_at(F.split(path, "/"), 1)
    seen = None
    for shared in _blocks(plain, block):

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = _scanner(shared)
            for b in it:
                rows = {(v, o): None for o, t in zip(*(c.to_pylist() for c in b.columns)) for v in scan.values(t)}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["raw", "owner"])

        part = files.where(F.col(text).isNotNull()).select(F.coalesce(who, F.lit("")), text).mapInArrow(run, "raw string, owner string")
        seen = part if seen is None else seen.union(part)
    common = seen.distinct().groupBy("raw").agg(F.count("*").alias("n")).where(F.col("n") > most_owners)
    return confirmed.join(common, "raw", "left_anti")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap made one."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if kept and a < kept[-1][1]:
            kept[-1] = (kept[-1][0], max(b, kept[-1][1]))
        else:
            kept.append((a, b))
    return kept


class Scanner:
    """An automaton over confirmed values; a hit may not continue a word to either side."""

    def __init__(self, values: list[str]):
        self.automaton = ahocorasick.Automaton()
        for v in values:
            self.automaton.add_word(v, len(v))
        if values:
            self.automaton.make_automaton()
        self.empty = not values

    def _hits(self, text: str) -> Iterator[tuple[int, int]]:
        if self.empty:
            return
        for end, n in self.automaton.iter(text):
            a, b = end + 1 - n, end + 1
            if a and text[a - 1].isalnum() and text[a].isalnum() and not text[a - 2 : a] in ("\\n", "\\t") or b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                continue
            yield a, b

    def values(self, text: str) -> set[str]:
        """The values that stand in ``text``, those within others too."""
        return {text[a:b] for a, b in self._hits(text)}

    def spans(self, text: str) -> list[tuple[int, int]]:
        out = []
        for a, b in self._hits(text):
            if text.startswith("-----BEGIN", a):
                close = text.find("-----END", b)
                b = b if close < 0 else close
            out.append((a, b))
        return merged(out)


_scanners: dict[str, Scanner] = {}


def _scanner(shared) -> Scanner:
    if shared.id not in _scanners:
        _scanners.clear()
        _scanners[shared.id] = Scanner(pickle.loads(shared.value))
    return _scanners[shared.id]


class _Block:
    """A broadcast block of values with an id of its own that workers keep their automaton by."""

    def __init__(self, spark, values: list[str]):
        self.cast, self.id = spark.sparkContext.broadcast(pickle.dumps(values)), uuid.uuid4().hex

    @property
    def value(self) -> bytes:
        return self.cast.value


def _blocks(confirmed: DataFrame, block: int) -> Iterator[_Block]:
    """The confirmed values in blocks of at most ``2 * block``, each read to the driver by itself."""
    spark = confirmed.sparkSession
    n = confirmed.count()
    parts = max(1, -(-n // block))
    for k in range(parts):
        rows = confirmed.where(F.pmod(F.xxhash64("raw"), F.lit(parts)) == k).select("raw").limit(2 * block + 1).collect()
        if len(rows) > 2 * block:
            raise ValueError("a block of values is larger than its bound")
        yield _Block(spark, sorted(r[0] for r in rows))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with stars for the characters of the spans; line ends and PEM header lines stay, and so its length."""
    out, at = [], 0
    for a, b in spans:
        head = re.match(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", text[a:b])
        a += head.end() if head else 0
        out += [text[at:a], re.sub(r"[^\s\"'`+,\\]" if head else r"[^\r\n]", "*", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


SPAN = pa.list_(pa.int32())


def _located(files: DataFrame, confirmed: DataFrame, path: str, text: str, block: int) -> DataFrame:
    """All rows as (path, content, spans): begins and ends in turn of the masked parts of the row's own text.

    Each block adds its spans to those of the blocks before, so they are the same in however many blocks values come.
    """
    out = files.select(F.col(path).alias("path"), F.col(text).alias("content"), F.lit(None).cast("array<int>").alias("spans"))
    for shared in _blocks(confirmed, block):

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = _scanner(shared)
            for b in it:
                spans = []
                for t, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    known = [*zip(known[::2], known[1::2])] if known else []
                    new = [] if t is None else scan.spans(t)
                    spans.append([x for ab in (merged(known + new) if known else new) for x in ab])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, SPAN)], names=["path", "content", "spans"])

        out = out.mapInArrow(run, "path string, content string, spans array<int>")
    return out


def find(files: DataFrame, confirmed: DataFrame, path: str = "path", text: str = "content", block: int = BLOCK) -> DataFrame:
    """(path, line_no) of each line on which a confirmed value begins; each once, however often a file's row repeats."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: dict[tuple[str, int], None] = {}
            for p, t, spans in zip(*(c.to_pylist() for c in b.columns)):
                line, at = 1, 0
                for a in spans[::2]:
                    line, at = line + t.count("\n", at, a), a
                    rows[p, line] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["path", "line_no"]
            )

    hits = _located(files.where(F.col(text).isNotNull()), confirmed, path, text, block).where(F.size("spans") > 0)
    return hits.mapInArrow(run, "path string, line_no int").distinct()


def redact(files: DataFrame, confirmed: DataFrame, path: str = "path", text: str = "content", block: int = BLOCK) -> DataFrame:
    """All rows of (``path``, ``text``) with the confirmed values masked; other characters, row counts and nulls stay."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [mask(t, [*zip(s[::2], s[1::2])]) if s else t for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["path", "content"])

    return _located(files, confirmed, path, text, block).mapInArrow(run, "path string, content string")
