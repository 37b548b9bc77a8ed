"""Secrets in texts: plain patterns, and literals that reach names of secrets through assignments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the plain kinds.
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "literal")
#: Least product of a name's and a literal's score.
THRESHOLD = 0.5

# Words of names and how much they say that a value is secret; pairs of words are tried before single ones.
STRONG = "password passwd passwort passphrase pwd pass secret secrets apikey credential credentials privatekey accesskey secretkey authkey authtoken bearer"
GOOD = "token tokens jwt pat webhook"
FAIR = "auth authorization key keys pin salt dsn cookie session license"
OF_KEYS = "api access private secret signing signature encryption master account storage shared auth service license consumer client deploy ssh hmac aes rsa app subscription"
#: Last words of names whose values are about a secret but none.
ABOUT = (
    "count counts length len size type name names id ids url uri path file files dir field fields label regex pattern prefix suffix limit ttl expiry expires expired expiration index header hint "
    "policy min max format algorithm alg version env var variable placeholder prompt message error errors enabled required rotation age timeout mode provider manager class store template strength"
)
#: Names that say nothing, so that the name of what they stand in counts.
PLAIN = "value val data default text content string plain raw current"
_WEIGHT = {w: x for x, words in ((0.5, FAIR), (0.9, GOOD), (1.0, STRONG)) for w in words.split()}
_OF_KEYS, _ABOUT, _PLAIN = set(OF_KEYS.split()), set(ABOUT.split()), set(PLAIN.split())
#: A text without any of these has no name of a secret.
_HINT = re.compile("(?i)" + "|".join(sorted({re.escape(w) for w in _WEIGHT}, key=len)))
#: Nor has one without any of these an assignment.
_SHAPE = re.compile(r"""[=:<]|\(\s*["'`]|define""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_TOKEN = re.compile(r"""(?P<name>[^\W\d][\w$]*(?:(?:\.|::|->|-)[^\W\d][\w$]*)*)|(?P<quote>\"{3}|'{3}|["'`])|(?P<op>:=|=>|<-|={1,3}|!=|<=|>=|\|\||\?\?|&&|[:+,;(){}\[\]<>/|?])|(?P<line>\n)|(?P<other>[^\s\w"'`]|[\w$]+)""")
_STRINGS = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*){q}") for q in "\"'`"} | {q * 3: re.compile(rf"(?s){q * 3}(.*?){q * 3}") for q in "\"'"}
_BARE = re.compile(r"""[^\s"'`<>,;(){}\[\]]+""")
_TAG = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>\n]{1,4096})</\1\s*>")
_ATTRIBUTES = re.compile(r"""<[A-Za-z_][^<>\n]{0,400}?\b(?:key|name)\s*=\s*["']([^"'<>\n]{1,4096})["'][^<>\n]{0,400}?\bvalue\s*=\s*["']([^"'<>\n]{1,4096})["']""")
_ASSIGNS = {"=", ":=", ":", "=>", "<-"}
_NO_VALUE = re.compile(
    r"(?i)^(?:null|none|nil|true|false|undefined|todo|fixme|redacted|hidden|secret|password|passwd|token|test|example|sample|dummy|foo|bar|string|str|int|bytes|bool)$"
    r"|change.?me|your[-_ ]|placeholder|example|^<.*>$|\$\{|\{\{|%\w?\(|^%[sd]$|^\$[A-Za-z_]|^\*+$|^x+$|^\.+$|^-+$"
)


@dataclass
class Value:
    """Literals and names that one assignment takes its value from; parts that are joined are one literal."""

    literals: list[list[tuple[int, int, bool]]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def sensitivity(name: str) -> float:
    """How much a name says that its value is a secret, 0 to 1."""
    words = [w.lower() for w in _PART.findall(name)]
    if not words or words[-1] in _ABOUT:
        return 0.0
    best = max((_WEIGHT.get(w, 0.0) for w in words), default=0.0)
    for a, b in zip(words, words[1:]):
        if b in ("key", "keys") and a in _OF_KEYS or a + b in _WEIGHT:
            best = max(best, 1.0)
    return best


def plausibility(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, 0 to 1: its information, its kinds of characters, and no stand-in."""
    if len(value) < 6 or _NO_VALUE.search(value):
        return 0.0
    counts = [value.count(c) for c in set(value)]
    bits = -sum(n * log2(n / len(value)) for n in counts)
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if any(c.isspace() for c in value):
        return 0.2 if value.replace(" ", "").isalpha() or not quoted else 0.5 * min(1.0, bits / 60)
    if re.fullmatch(r"[A-Za-z]+(?:[-_.][A-Za-z]+)+", value) or re.match(r"(?:[a-z]+:/)?/|\.{0,2}/|[A-Za-z]:\\", value) and "@" not in value:
        return 0.2  # names, addresses and paths
    if not any(c.isdigit() for c in value) and kinds < 3:
        return 0.6 if quoted and len(value) >= 8 and bits >= 20 else 0.2
    if bits >= 36 and kinds >= 2:
        return 1.0
    return (0.8 if quoted else 0.6) if bits >= 15 and kinds >= 2 else 0.3


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): n a name, s the inside of a string, o an operator, l a line end, x anything else.

    A quote right after a letter or digit, or without its partner on the line, is no string.
    """
    out, at, dead = [], 0, {}
    while m := _TOKEN.search(text, at):
        at, start = m.end(), m.start()
        kind = m.lastgroup
        if kind == "quote":
            q, s = m.group(), None
            if start >= dead.get(q, 0) and not (start and (text[start - 1].isalnum() or text[start - 1] == "_") and text[max(0, start - 2) : start].strip("rbufRBUF \n\t=(:,[{")):
                s = _STRINGS[q].match(text, start)
                if s is None:
                    end = len(text) if len(q) == 3 else text.find("\n", start)
                    dead[q] = end if end >= 0 else len(text)
            if s:
                out.append(("s", s.start(1), s.end(1)))
                at = s.end()
            else:
                out.append(("x", start, start + 1))
                at = start + 1
        else:
            out.append(({"name": "n", "op": "o", "line": "l", "other": "x"}[kind], start, at))
    return out


def _target(text: str, t: list[tuple[str, int, int]], i: int) -> str | None:
    """The name that the operator at token i assigns to."""
    op = text[t[i][1] : t[i][2]]
    j = i - 1
    if j < 0:
        return None
    if t[j][0] == "o" and text[t[j][1]] == "]":  # settings["name"] = or name: Type[...] =
        k = j - 1
        while k > max(0, j - 8) and text[t[k][1] : t[k][2]] != "[":
            k -= 1
        if k < 1 or t[k - 1][0] != "n":
            return None
        inner = ".".join(text[a:b] for x, a, b in t[k + 1 : j] if x == "s")
        if inner:
            return text[t[k - 1][1] : t[k - 1][2]] + "." + inner
        j = k - 1
    if t[j][0] not in "ns":
        return None
    if op == "=" and j >= 2 and t[j - 1][0] == "o" and text[t[j - 1][1] : t[j - 1][2]] == ":" and t[j - 2][0] == "n" and t[j][0] == "n":
        return text[t[j - 2][1] : t[j - 2][2]]  # name: type = value
    return text[t[j][1] : t[j][2]]


def _value(text: str, t: list[tuple[str, int, int]], i: int) -> Value:
    """What stands to the right of the operator at token i."""
    out, joined, depth, j = Value(), False, 0, i + 1
    config = text[t[i][1] : t[i][2]] in ("=", ":")
    before = ""
    while j < len(t):
        kind, a, b = t[j]
        word = text[a:b]
        if kind == "s":
            if joined and out.literals:
                out.literals[-1].append((a, b, True))
            else:
                out.literals.append([(a, b, True)])
            joined = True  # strings side by side are joined
        elif kind in "nx" and j == i + 1 and config and (m := _BARE.match(text, a)) and (m.end() != b or kind == "x"):
            out.literals.append([(a, m.end(), False)])
            return out
        elif kind == "n":
            if before in ("n", "s"):
                break
            if word in ("or", "and", "await", "new", "return"):
                j += 1
                continue
            if j + 1 == len(t) or text[t[j + 1][1] : t[j + 1][2]] != "(":
                out.names.append(word)
                if j == i + 1 and config:
                    out.literals.append([(a, b, False)])
            joined = False
        elif kind == "l":
            if not depth and before != "+":
                break
            j += 1
            continue
        elif kind == "o" and word == "+":
            pass
        elif kind == "o" and word == "(":
            depth, joined = depth + 1, False
        elif kind == "o" and word == ")" and depth:
            depth -= 1
        elif kind == "o" and (word in ("||", "??", "|", "?") or word == "," and depth):
            joined = False  # another one
        else:
            break
        before = word if kind == "o" else kind
        j += 1
    return out


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of the assignments of a text in the syntaxes of programs and settings.

    Names are those left of ``=``, ``:=``, ``:``, ``=>`` and ``<-``, keys in brackets, first of two arguments, names
    of setters, elements and their name and value attributes, and ``#define``. A name that says nothing takes on the
    name of the block or of the less indented line that it stands in.
    """
    t = _tokens(text)
    blocks: list[str] = []
    lines: list[tuple[int, str]] = []
    begin, head = 0, -1  # of the line, and its first name
    for i, (kind, a, b) in enumerate(t):
        if kind == "l":
            begin, head = b, -1
            continue
        word = text[a:b]
        if head < 0 and word != "-":
            head = i
        if kind == "o" and word in _ASSIGNS:
            name = _target(text, t, i)
            if not name:
                continue
            then = t[i + 1] if i + 1 < len(t) else ("l", b, b)
            if word == ":" and head == i - 1:
                indent = t[head][1] - begin
                while lines and lines[-1][0] >= indent:
                    lines.pop()
                if then[0] == "l":
                    lines.append((indent, name))
            if _PART.findall(name) and _PART.findall(name)[-1].lower() in _PLAIN:
                parents = [n for _, n in lines if n != name][-1:] + [n for n in blocks if n][-1:]
                name = ".".join(parents + [name]) if not parents else parents[-1]
            if then[0] == "o" and text[then[1]] == "{":
                continue
            yield name, _value(text, t, i)
        elif kind == "o" and word == "{":
            named = i >= 2 and text[t[i - 1][1] : t[i - 1][2]] in _ASSIGNS
            blocks.append((_target(text, t, i - 1) or "") if named else "")
        elif kind == "o" and word == "}":
            if blocks:
                blocks.pop()
        elif kind == "o" and word == "(" and i and t[i - 1][0] == "n" and i + 2 < len(t) and t[i + 1][0] == "s":
            if text[t[i + 2][1] : t[i + 2][2]] == ")":  # setPassword("...")
                yield text[t[i - 1][1] : t[i - 1][2]], Value([[(*t[i + 1][1:], True)]])
            elif text[t[i + 2][1] : t[i + 2][2]] == "," and i + 3 < len(t):  # put("password", value)
                yield text[t[i + 1][1] : t[i + 1][2]], _value(text, t, i + 2)
        elif kind == "n" and word == "define" and i + 2 < len(t) and t[i + 1][0] == "n" and t[i + 2][0] == "s":
            yield text[t[i + 1][1] : t[i + 1][2]], Value([[(*t[i + 2][1:], True)]])
    for m in _TAG.finditer(text):
        yield m.group(1), Value([[(*m.span(2), True)]])
    for m in _ATTRIBUTES.finditer(text):
        yield m.group(1), Value([[(*m.span(2), True)]])


def literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans of the literals whose name's and own score reach ``threshold``.

    A name passes its score on to the names that it takes its value from, so a constant counts as what it is used
    for; every name is followed once, the highest score first.
    """
    if not _SHAPE.search(text) or not _HINT.search(text):
        return []
    sources: dict[str, list[Value]] = {}
    score: dict[str, float] = {}
    for name, value in pairs(text):
        sources.setdefault(name, []).append(value)
        score.setdefault(name, sensitivity(name))
    last: dict[str, set[str]] = {}
    for name in sources:
        last.setdefault(re.split(r"\.|::|->", name)[-1], set()).add(name)
    out, done = set(), set()
    for name in sorted(score, key=lambda n: -score[n]):
        weight = score[name]
        if weight < threshold:
            break
        todo = [name]
        while todo:
            at = todo.pop()
            if at in done:
                continue
            done.add(at)
            for value in sources[at]:
                for parts in value.literals:
                    quoted = parts[0][2]
                    known = not quoted and text[parts[0][0] : parts[0][1]] in sources  # the name of a constant
                    if not known and weight * plausibility("".join(text[a:b] for a, b, _ in parts), quoted) >= threshold:
                        out.update((a, b) for a, b, _ in parts if b > a)
                for used in value.names:
                    todo += [used] if used in sources else last.get(re.split(r"\.|::|->", used)[-1], ())
    return sorted(out)


def base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, leftmost and without overlap in each kind."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    return out + [(*m.span(), "access") for m in ACCESS.finditer(text)] + [(*m.span(), "hex") for m in HEX.finditer(text)]


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text by start, then kind, then end; in code points, end exclusive."""
    if not text:
        return []
    found = base(text) + [(a, b, "literal") for a, b in literals(text, threshold)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def _task(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "stop": b} for a, b, k in scan(x.as_py(), threshold)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: kind, start and stop of each secret, in code points, stop exclusive.

    ``assign``, ``access`` and ``hex`` are the plain patterns; ``literal`` is the inside of a string or a bare value that an
    assignment, directly or through constants, gives to the name of a secret. Null and empty texts have no spans;
    repeated rows and null ids come out row by row; columns other than the two named are ignored; an empty table
    gives no rows. Whole texts are read, in time linear in their length; no row is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_task(threshold), "doc_id long, spans array<struct<kind:string,start:bigint,stop:bigint>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digests(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts of the plain kinds, a digest of their spans, and all spans as text, for every document."""
    found = secret_spans(docs, threshold)
    of = {k: F.expr(f"filter(spans, s -> s.kind = '{k}')") for k in KINDS[:3]}
    plain = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    counts = [F.size(of[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
