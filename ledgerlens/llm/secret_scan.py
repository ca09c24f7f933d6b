"""Secret scans: three base patterns, and assignment-aware lexing of source and configuration text.

Lexing turns a text into tokens: strings of all quote kinds (also triple ones),
comments, names, operators, brackets, line starts with their indentation, tags.
A pass over them keeps a stack of what is open:

* mappings and elements, ended by their bracket, tag or a smaller indentation,
  give nested names a path (``password: {value: ...}``, ``<token><id>...``);
* functions and blocks, ended likewise, are scopes: a name means what the nearest
  enclosing scope assigned to it.

Every assignment is a pair of a name and a value.  A value is a literal (quoted,
bare, a block scalar, a list of literals), several quoted ones joined by ``+`` or
standing side by side, which fold into one, the literals among a call's arguments,
or a reference to another name (``K``, ``$K``, ``${K}``, ``{{K}}``), which is
followed to the literal it was given.  Member access and calls are no literals.
In a mapping with ``name`` (or ``key``) and ``value``, the former names the latter.
What a comment holds is lexed by itself and assigns nothing outside of it.

A literal is reported, where it stands, if the name it reaches is sensitive and
the literal looks like a credential; the two scores multiply.  Literals of fewer
than ``MIN_LITERAL`` characters are none; blanks inside quotes count as other
characters do, unless they part plain words.

Base spans stay as they are; lexing adds spans of kind ``named``.  Kinds sort in
the order ``KINDS``.  Positions are code points, ends exclusive.

Every whole text is scanned where it is read: no shuffle.  A text is lexed only
if it holds a sensitive stem at all, which any reported pair must.

Defined results: null and empty text have no spans; a name assigned several
times in a scope stands for its latest literal before the use, or its first one if
it is used before; references in a circle reach nothing; brackets, quotes and
comments that do not close end with their line; rows are independent, so ties
and repeated rows need no rule; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

KINDS = ("assign", "access", "hex", "named")

# The base patterns.
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need no look

#: Words of a name, and how surely a literal under it is a credential.
_TARGETS = {
    "password": 1.0, "passwd": 1.0, "pass": 0.8, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "auth key": 1.0, "encryption key": 1.0, "signing key": 1.0, "account key": 0.9,
    "client key": 0.8, "auth": 0.6, "bearer": 0.8, "connection string": 0.7, "secrets": 0.9, "passwords": 0.9, "tokens": 0.8,
}
#: Words that turn a sensitive name into a description of one.
_HARMLESS = frozenset("count length len size min max limit type name names label hint url uri path file field id ids expiry expires ttl policy regex pattern prefix public example".split())
_STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer", b"connection")
_PLACEHOLDER = re.compile(rb"(?i)(?:change.?me|your|example|sample|dummy|placeholder|redacted|x{4,}|\*{3,}|null$|none$|true$|false$|undefined$|todo|test$)")
MIN_LITERAL, MIN_SCORE = 8, 0.45

#: Callees whose arguments name what they look up.
_LOOKUPS = re.compile(rb"(?i)(?:^|[._])(?:get_?env|environ|env|lookup|find\w*|read\w*|load\w*|open|fetch\w*|param\w*|prompt\w*|input|print\w*|log\w*|format|getattr|has\w*|is\w*)$")
_SCOPES = frozenset((b"def", b"class", b"function", b"func", b"fn", b"sub", b"module", b"namespace", b"impl", b"interface", b"struct"))

_NAME = rb"[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z0-9_]++)*+"
#: Tokens; what opens a longer one (triple quotes, block comments) is closed by a search.
_TOKEN = re.compile(
    rb"""(?P<line>\n[\x20\t]*+(?P<item>(?:-[\x20\t]++)*+))
    |(?P<triple>\"{3}|'{3})
    |(?P<block>/\*|<!--)
    |(?P<comment>(?<![^\s;{}(),])(?:\#(?!\{)|//)[^\n]*+)
    |(?P<string>(?<![A-Za-z0-9_])[rRbBfFuU]{0,2}(?:"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\\n])*+`))
    |<(?P<tag>""" + _NAME + rb""")(?P<closed>\s*+>)?
    |(?P<end></""" + _NAME + rb"""\s*+>|/>)
    |(?P<name>(?<![A-Za-z0-9_])(?:--?)?""" + _NAME + rb""")
    |(?P<op>=>|:=|::|==|!=|<=|>=|->|[:=+(){}\[\],;])""", re.VERBOSE)
_MARGIN = re.compile(rb"[\x20\t]*+(?:-[\x20\t]++)*+")
_SPACE = re.compile(rb"\s*+")
_BELOW = re.compile(rb"(?:\r?\n[\x20\t]*+(?:-[\x20\t]++)*+)++")
_GAP = re.compile(rb"[\x20\t]*+")
_REF = re.compile(rb"\$?\{{1,2}\x20*(?P<ref>" + _NAME + rb")\x20*\}{1,2}|\$\(?(?P<var>" + _NAME + rb")\)?")
_BARE = re.compile(rb"""[^\s"'`;,(){}\[\]<>\#]++""")
_SCALAR = re.compile(rb"[|>][-+0-9]*+[\x20\t]*+(?=\n)")
_TYPE = re.compile(rb":[\x20\t]*+[A-Za-z_][A-Za-z0-9_.<>\[\]]*+[\x20\t]*+(?==[^=>])")
_ADDRESS = re.compile(rb"://[^\s\"'`<>?]*+")  # what follows a scheme, without the query
_TAG_BODY = re.compile(rb"[^<>\n]++")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    name: str
    score: float


def name_score(name: bytes) -> float:
    """How surely a name means a credential (0 to 1)."""
    words = [w.lower() for w in _CAMEL.findall(name.decode("utf-8", "replace"))]
    if words and words[-1] in _HARMLESS:
        return 0.0
    return max([0.0, *(_TARGETS.get(w, 0.0) for w in words), *(_TARGETS.get(f"{a} {b}", 0.0) for a, b in zip(words, words[1:], strict=False))])


def literal_score(value: bytes) -> float:
    """How much a literal looks like a credential (0 to 1): length, entropy, kinds of characters."""
    if len(value) < MIN_LITERAL or _PLACEHOLDER.match(value):
        return 0.0
    if len(parts := value.split()) > 1 and all(p.strip(b".,;:!?()").isalpha() for p in parts):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    if kinds == 1 and value.isalpha():  # a plain word
        return 0.3 if n < 20 else 0.6
    return min(1.0, entropy / 3.5) * min(1.0, 0.5 + 0.25 * kinds)


class Value(NamedTuple):
    """A literal (no ref) or a reference, where it stands; ``text`` is the folded literal."""

    start: int
    end: int
    text: bytes
    ref: bytes | None = None
    weight: float = 1.0


@dataclass
class Frame:
    """Something open: ``name`` of a mapping or element (None: anonymous), or a scope; ended by a bracket or an indentation."""

    closer: bytes | None
    indent: int = -1
    name: bytes | None = None
    scope: int | None = None
    listed: bool = False
    inner_name: bytes | None = None  # nearest name and scope, this frame's included
    inner_scope: int = 0
    label: dict[int, bytes] = field(default_factory=dict)  # by indentation: the literal of name or key


class Pair(NamedTuple):
    name: bytes
    parent: bytes | None  # the nearest name that it stands under
    scope: int
    value: Value


class Lexer:
    """Pairs of a text, and which scope encloses which."""

    def __init__(self, text: bytes, parents: list[int] | None = None):
        self.text, self.pairs = text, []
        self.parents = [-1] if parents is None else parents  # of each scope
        self.base = 0 if parents is None else len(parents)
        if parents is not None:
            parents.append(-1)
        self.frames = [Frame(None, -2, inner_scope=self.base)]  # the text itself
        self.absent: set[bytes] = set()  # closers that do not come any more

    def _push(self, frame: Frame) -> None:
        top = self.frames[-1]
        frame.inner_name = top.inner_name if frame.name is None else frame.name
        frame.inner_scope = top.inner_scope if frame.scope is None else frame.scope
        self.frames.append(frame)

    def _closing(self, closer: bytes, at: int) -> int:
        """Place of the next ``closer``, or -1 (searched in vain once at most)."""
        if closer in self.absent:
            return -1
        if (found := self.text.find(closer, at)) < 0:
            self.absent.add(closer)
        return found

    def _open_scope(self, closer: bytes | None, indent: int = -1) -> None:
        self.parents.append(self.frames[-1].inner_scope)
        self._push(Frame(closer, indent, scope=len(self.parents) - 1))

    def _close(self, closer: bytes) -> None:
        for k in range(len(self.frames) - 1, max(0, len(self.frames) - 50), -1):  # a bracket closes one of those last opened
            if self.frames[k].closer == closer:
                del self.frames[k:]
                return

    def _literal(self, m: re.Match) -> Value:
        raw = m["string"]
        skip = next(i for i, c in enumerate(raw) if c in b"\"'`") + 1
        body = raw[skip:-1]
        whole = _REF.fullmatch(body)
        return Value(m.start() + skip, m.end() - 1, body, whole and (whole["ref"] or whole["var"]))

    def _quoted(self, at: int) -> tuple[Value, int] | None:
        """A string at ``at``, plain or triple, and where it ends."""
        m = _TOKEN.match(self.text, at)
        if m is None:
            return None
        if m["string"]:
            return self._literal(m), m.end()
        if m["triple"] and (end := self._closing(m["triple"], m.end())) >= 0:
            return Value(m.end(), end, self.text[m.end():end]), end + 3
        return None

    def _folded(self, value: Value, at: int) -> tuple[Value, int]:
        """Further strings, joined by + or side by side, folded into the first."""
        while value.ref is None:
            gap = _GAP.match(self.text, at).end()
            plus = self.text[gap:gap + 1] == b"+"
            after = _SPACE.match(self.text, gap + 1).end() if plus else gap
            more = self._quoted(after)
            if more is None or more[0].ref is not None:
                break
            value, at = Value(value.start, more[0].end, value.text + more[0].text), more[1]
        return value, at

    def _value(self, at: int, indent: int) -> tuple[list[Value], int, bytes | None]:
        """Values of an assignment whose right side begins at ``at``, where to go on, and the bracket that opens there."""
        text = self.text
        if found := self._quoted(at):
            value, after = self._folded(*found)
            return [value], after, None
        if m := _REF.match(text, at):
            return [Value(*m.span("ref" if m["ref"] else "var"), b"", m["ref"] or m["var"])], m.end(), None
        if m := _SCALAR.match(text, at):
            end, lines, first = m.end(), [], None
            while end < len(text):
                stop = text.find(b"\n", end + 1)
                stop = len(text) if stop < 0 else stop
                line = text[end + 1:stop]
                if line.strip() and len(line) - len(line.lstrip()) <= indent:
                    break
                if line.strip():
                    first = end + 1 + len(line) - len(line.lstrip()) if first is None else first
                    lines.append((line.strip(), end + 1 + len(line.rstrip())))
                end = stop
            return [Value(first, lines[-1][1], b"".join(x for x, _ in lines))] if lines else [], end, None
        if text[at:at + 1] in (b"{", b"["):
            return [], at, text[at:at + 1]
        m = _BARE.match(text, at)
        if m is None:
            return [], at, None
        word, after = m[0], m.end()
        if text[after:after + 1] == b"(":  # a call: its literal arguments, unless they name what it looks up
            out, depth, k = [], 0, after
            for t in iter(lambda: _TOKEN.search(text, k), None):
                if t["line"] is not None:
                    break
                k = t.end()
                depth += {b"(": 1, b")": -1}.get(t["op"], 0)
                if t["op"] == b")" and not depth:
                    break
                if t["string"]:
                    out.append(self._literal(t)._replace(weight=0.8))
            keep = [] if _LOOKUPS.search(word) else [v for v in out if not name_score(v.text)]
            return keep, k, None
        word = word.rstrip(b".:")
        if re.fullmatch(_NAME, word):
            if b"." in word and not any(len(p) >= 16 and re.search(rb"[0-9]", p) and re.search(rb"[A-Z]", p) and re.search(rb"[a-z]", p) for p in word.split(b".")):
                return [], after, None  # member access
            return [Value(at, at + len(word), word, word)], after, None
        return [Value(at, at + len(word), word)], after, None

    def _assign(self, name: bytes, values: list[Value], indent: int) -> None:
        label = self.frames[-1].label
        short = name.lower().lstrip(b"-")
        if short in (b"name", b"key") and values and values[0].text:
            label[indent] = values[0].text
        if short in (b"value", b"val") and indent in label:
            name = label[indent]
        for v in values:
            self.pairs.append(Pair(name, self.frames[-1].inner_name, self.frames[-1].inner_scope, v))

    def run(self) -> list[Pair]:
        text, before = self.text, b""
        at = indent = _MARGIN.match(text).end()
        while m := _TOKEN.search(text, at):
            at = m.end()
            if m["line"] is not None:
                if at >= len(text) or text[at:at + 1] in (b"\n", b"\r"):
                    continue  # a blank line ends nothing
                indent = at - m.start() - 1
                while self.frames[-1].closer is None and self.frames[-1].indent >= indent:
                    self.frames.pop()
                if m["item"]:
                    self.frames[-1].label.pop(indent, None)
                before = b"\n"
            elif m["comment"] or m["block"]:
                if m["block"]:
                    closer = b"*/" if m["block"] == b"/*" else b"-->"
                    if (end := self._closing(closer, at)) < 0:
                        continue
                    body, start, at = text[at:end], at, end + len(closer)
                else:
                    body, start = m["comment"].lstrip(b"#/"), m.end() - len(m["comment"].lstrip(b"#/"))
                if any(s in body.lower() for s in _STEMS):
                    inner = Lexer(body, self.parents).run()
                    self.pairs += [p._replace(value=p.value._replace(start=p.value.start + start, end=p.value.end + start)) for p in inner]
            elif m["tag"]:
                if m["closed"]:
                    body = _TAG_BODY.match(text, at)
                    if body and text[body.end():body.end() + 2] == b"</" and (v := body[0].strip()):
                        a = at + len(body[0]) - len(body[0].lstrip())
                        whole = _REF.fullmatch(v)
                        self._assign(m["tag"], [Value(a, a + len(v), v, whole and (whole["ref"] or whole["var"]))], indent)
                        at = body.end()
                    self._push(Frame(b"</" + m["tag"], name=m["tag"]))
                else:
                    self.frames[-1].label.clear()
                before = b"<"
            elif m["end"]:
                self._close(m["end"].rstrip(b"> \t\r\n"))
                before = b">"
            elif m["op"]:
                op = m["op"]
                if op == b"{":
                    if before in (b"=", b":", b",", b"(", b"[", b"\n", b"", b"{"):
                        self._push(Frame(b"}"))
                    else:
                        self._open_scope(b"}")
                elif op in (b"[", b"("):
                    self._push(Frame(b"]" if op == b"[" else b")"))
                elif op in (b"}", b"]", b")"):
                    self._close(op)
                before = op
            elif m["triple"]:
                if (end := self._closing(m["triple"], at)) >= 0:
                    at = end + 3
                before = b"s"
            else:
                before, at = self._named(m, at, indent)
        return self.pairs

    def _named(self, m: re.Match, at: int, indent: int) -> tuple[bytes, int]:
        """A name or string: an assignment if an operator follows; returns what stands before the next token, and its place."""
        text = self.text
        if m["name"]:
            name = m["name"].lstrip(b"-")
            if name in _SCOPES and not text[m.start() - indent - 1:m.start()].strip(b"\n \t"):
                self._open_scope(None, indent)  # ended by the indentation; with brackets by theirs
                return name, at
        else:
            name = self._literal(m).text
            if not re.fullmatch(_NAME, name):
                if self.frames[-1].listed:
                    self._assign(self.frames[-1].name or b"", [self._literal(m)], indent)
                return b"s", at
        k = at
        if text[k:k + 1] == b"]":  # map["name"] = value
            k += 1
        k = _GAP.match(text, k).end()
        if t := _TYPE.match(text, k):
            k = t.end()
        op = next((x for x in (b"=>", b":=", b"=", b":") if text.startswith(x, k)), None)
        if op == b":" and m["name"] and (url := _ADDRESS.match(text, k)):
            return b"n", url.end()
        if op is None or text[k:k + 2] in (b"==", b"::"):
            if self.frames[-1].listed and not m["name"]:
                self._assign(self.frames[-1].name or b"", [self._literal(m)], indent)
            return b"n", at
        k = _GAP.match(text, k + len(op)).end()
        if text[k:k + 1] in (b"\n", b"\r") and op == b":":  # a mapping of larger indentation, if one follows
            line = _BELOW.match(text, k)
            deeper = line is not None and line.end() - text.rfind(b"\n", 0, line.end()) - 1 > indent
            if deeper:
                self._push(Frame(None, indent, name=name))
            return b":", k
        values, after, bracket = self._value(k, indent)
        if bracket:
            self._push(Frame(b"}" if bracket == b"{" else b"]", name=name, listed=bracket == b"["))
            return bracket, after + 1
        self._assign(name, values, indent)
        return b"v", max(after, at)


def pair_weight(name: bytes, parent: bytes | None) -> float:
    """How surely a literal under a name is a credential: by the name, else by the one that it stands under."""
    words = [w.lower() for w in _CAMEL.findall(name.decode("utf-8", "replace"))]
    if words and words[-1] in _HARMLESS:
        return 0.0
    return name_score(name) or (0.9 * name_score(parent) if parent else 0.0)


def named_literals(text: bytes) -> list[Span]:
    """Literals that sensitive names reach; byte positions."""
    lexer = Lexer(text)
    pairs = lexer.run()
    given: dict[tuple[int, bytes], list[tuple[int, Value]]] = {}
    for p in sorted(pairs, key=lambda p: p.value.start):
        given.setdefault((p.scope, p.name), []).append((p.value.start, p.value))
    known: dict[tuple[int, bytes, int], Value | None] = {}

    def home(name: bytes, scope: int) -> tuple[int, bytes] | None:
        while scope >= 0:
            if (scope, name) in given:
                return scope, name
            scope = lexer.parents[scope]
        return None

    def reach(value: Value, scope: int) -> Value | None:
        """The literal that a value stands for."""
        path: dict[tuple[int, bytes, int], None] = {}
        found = None
        while True:
            if value.ref is None:
                found = value
                break
            place = home(value.ref, scope)
            if place is None:  # a bare word that no one assigns is itself the literal
                found = value._replace(ref=None) if value.text == value.ref else None
                break
            have = given[place]
            at, after = have[max(bisect_left(have, value.start, key=lambda x: x[0]) - 1, 0)]
            if (step := (*place, at)) in path:
                break
            if step in known:
                found = known[step]
                break
            path[step] = None
            value, scope = after, place[0]
        known.update(dict.fromkeys(path, found))
        return found

    out: dict[tuple[int, int], Span] = {}
    for p in pairs:
        weight = pair_weight(p.name, p.parent)
        if not weight or (found := reach(p.value, p.scope)) is None:
            continue
        score, where = weight * p.value.weight * literal_score(found.text), (found.start, found.end)
        if score >= MIN_SCORE and (where not in out or out[where].score < score):
            out[where] = Span(found.start, 3, found.end, p.name.decode("utf-8", "replace"), round(score, 4))
    return list(out.values())


def scan_text(text: bytes) -> list[Span]:
    """All spans of a UTF-8 text, sorted; positions in code points."""
    out = [Span(m.start(), 2, m.end(), "", 1.0) for m in _HEX.finditer(text)]
    low = text.lower()
    if any(s in low for s in _ASSIGN_STEMS):
        out += [Span(m.start(), 0, m.end(), "", 1.0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if b"AKIA" in text:
        out += [Span(m.start(), 1, m.end(), "", 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if any(s in low for s in _STEMS):
        out += named_literals(text)
    if out and not text.isascii():
        before = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
        out = [s._replace(start=int(before[s.start]), end=int(before[s.end])) for s in out]
    return sorted(out)


def redact(text: str, found: list[Span]) -> str:
    """The text with each stretch of spans replaced by its first kind in brackets."""
    out, at = [], 0
    for s in found:
        if s.end > at:
            if s.start >= at:
                out += [text[at:s.start], f"[{KINDS[s.kind]}]"]
            at = s.end
    return "".join([*out, text[at:]])


def _scan(with_text: bool):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
    fields = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(span))]
    schema = pa.schema(fields + [("redacted", pa.string())] * with_text)

    def run(batches):
        for batch in batches:
            for t in C.chunks(batch):
                out = {name: [] for name in schema.names}
                out["doc_id"] = t.column("doc_id").to_pylist()
                for text in C.texts(t.column("text")):
                    found = scan_text(text)
                    said = [(s.kind, f"{KINDS[s.kind]}:{s.start}:{s.end}") for s in found]
                    for k in range(3):
                        out[f"n_{KINDS[k]}"].append(sum(kind == k for kind, _ in said))
                    out["base_sha256"].append(hashlib.sha256(",".join(x for kind, x in said if kind < 3).encode()).hexdigest())
                    out["spans"].append(",".join(x for _, x in said))
                    out["found"].append([{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "name": s.name, "score": s.score} for s in found])
                    if with_text:
                        out["redacted"].append(redact(text.decode(), found))
                yield pa.RecordBatch.from_pydict(out, schema)

    return run


def scan(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (structs), redacted."""
    out = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
           "found array<struct<kind:string,start:long,end:long,name:string,score:double>>" + ", redacted string" * with_text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(with_text), out)
