"""Light parsers for languages whose bodies stand in braces.

Comments, strings and preprocessor lines are blanked first (line ends stay), so that brackets can be
paired and heads be found by patterns.  A head with a name, and the braces that follow it, is a class
or a symbol; bodies nest by their places.  Text whose brackets do not pair is a SyntaxError, upon which
the chunker makes windows of lines.  This is not a full grammar: what it finds are the definitions,
imports, variables and calls that chunks are made of.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from chunkyard.operators.symbols import Node

_ID = r"[A-Za-z_$][\w$]*"
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_COMMENTS = r"//[^\n]*|/\*[\s\S]*?\*/"
_CHAR = r"'(?:\\.[^'\n]{0,8}|[^'\\\n])'"
_TICKS = r"'(?:\\.|[^'\\\n])*'"
_NOT_CALLED = frozenset(
    "if for foreach while switch catch return function fun func fn new else do try using lock synchronized sizeof typeof instanceof throw await async yield when guard where super this "
    "print echo match case in is as elseif isset unset array list defined static_cast dynamic_cast const_cast reinterpret_cast decltype alignof nameof fixed checked unchecked import init and or not".split()
)


@dataclass(frozen=True)
class Grammar:
    """Patterns over blanked text; each has a group ``name``.  ``functions`` ends before its parenthesis."""

    blank: str
    classes: str
    functions: str
    #: What may stand between a function's parentheses and its body.
    tail: str = r"[^;{}()=]*"
    #: Definitions with a body in braces that are symbols all the same.
    shapes: str = ""
    imports: str = ""
    variables: str = ""
    #: Function names count only right below a class (or at the top), as calls look alike elsewhere.
    only_members: bool = False
    #: Methods without a keyword, inside classes only.
    methods: str = ""
    #: Bodies that are an expression: ``=`` or ``=>`` after the parentheses.
    expressions: str = ""
    arrows: bool = False
    #: Statements end with their lines, so a head begins on its own line, or with the annotations above it.
    by_line: bool = False


_GENERIC = r"(?:\s*<[^<>(){};]*(?:<[^<>]*>[^<>(){};]*)*>)?"
_SCRIPT = dict(
    blank=rf"{_COMMENTS}|{_QUOTED}|{_TICKS}|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?\[\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
    functions=rf"\bfunction\s*\*?\s*(?P<name>{_ID})?{_GENERIC}\s*(?=\()",
    methods=rf"(?:(?<=[;{{}}\n\s*#])|^)(?P<name>#?{_ID}){_GENERIC}\s*(?=\()",
    imports=r"(?m)^[ \t]*import\b(?:[^;{\n]|\{[^}]*\})*;?",
    variables=r"(?m)^[ \t]*(?:export\s+)?(?:const|let|var)\s[^;\n]*;?",
    arrows=True,
    by_line=True,
)
_TYPED = rf"(?P<name>~?{_ID}(?:::~?{_ID})*)\s*(?=\()"
_FIELDS = rf"(?m)^[ \t]*(?:[\w<>\[\],.?:*&]+[ \t]+)+[*&]*{_ID}(?:\[[^\]]*\])*[ \t]*(?:=[^;{{}}]*)?;"

GRAMMARS = {
    "javascript": Grammar(classes=rf"\bclass\b(?:\s+(?!extends\b)(?P<name>{_ID}))?[^;{{}}()]*(?=\{{)", **_SCRIPT),
    "typescript": Grammar(
        classes=rf"\bclass\b(?:\s+(?!extends\b|implements\b)(?P<name>{_ID}))?[^;{{}}()]*(?=\{{)", shapes=rf"\b(?:interface|enum|namespace)\s+(?P<name>{_ID})[^;{{}}()]*(?=\{{)|\btype\s+(?P<alias>{_ID}){_GENERIC}\s*=\s*(?=\{{)", **_SCRIPT
    ),
    "java": Grammar(
        blank=rf'{_COMMENTS}|"""[\s\S]*?"""|{_QUOTED}|{_CHAR}', classes=rf"(?<!\.)\b(?:class|interface|enum|record)\s+(?P<name>{_ID})[^;{{}}]*(?=\{{)", functions=_TYPED, only_members=True,
        imports=r"(?m)^[ \t]*import\s[^;]*;", variables=_FIELDS,
    ),
    "c_sharp": Grammar(
        blank=rf'{_COMMENTS}|@"(?:""|[^"])*"|{_QUOTED}|{_CHAR}|(?m:^[ \t]*\#[^\n]*)', classes=rf"(?<!\.)\b(?:class|interface|enum|record|struct|namespace)\s+(?P<name>{_ID}(?:\.{_ID})*)[^;{{}}()]*(?=\{{)",
        functions=rf"(?P<name>{_ID}){_GENERIC}\s*(?=\()", tail=r"\s*(?::\s*(?:base|this)\s*\([^()]*\)\s*)?(?:where[^{;=]*)?", shapes=rf"(?<=[\w>\]?])\s+(?P<name>{_ID})\s*(?=\{{\s*(?:(?:public|private|protected|internal)\s+)?(?:get|set|init)\b)", only_members=True,
        expressions=r"\s*=>", imports=r"(?m)^[ \t]*(?:global\s+)?using\s+[\w.=<>, \t]+;", variables=_FIELDS,
    ),
    "go": Grammar(
        blank=rf"{_COMMENTS}|{_QUOTED}|`[^`]*`|{_CHAR}", classes=r"(?!)(?P<name>)", functions=rf"(?m)^func\s+(?:\([^()]*\)\s*)?(?P<name>{_ID})(?:\[[^\]]*\])?\s*(?=\()", tail=r"[^;{}=\n]*", by_line=True,
        shapes=rf"\btype\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+(?:struct|interface)\s*(?=\{{)", imports=r"(?m)^import\s*(?:\([^)]*\)|[^\n]*)", variables=r"(?m)^(?:var|const)\s*(?:\([^)]*\)|[^\n]*)",
    ),
    "c": Grammar(
        blank=rf"{_COMMENTS}|{_QUOTED}|{_CHAR}|(?m:^[ \t]*\#(?:\\\n|[^\n])*)", classes=r"(?!)(?P<name>)", functions=_TYPED, tail=r"\s*", only_members=True, shapes=rf"\b(?:struct|union|enum)\s+(?P<name>{_ID})\s*(?=\{{)",
        imports=r"(?m)^[ \t]*#[ \t]*include[^\n]*", variables=_FIELDS,
    ),
    "cpp": Grammar(
        blank=rf"{_COMMENTS}|{_QUOTED}|{_CHAR}|(?m:^[ \t]*\#(?:\\\n|[^\n])*)", classes=rf"(?<!enum )\b(?:class|struct|union|namespace)\s+(?P<name>{_ID}(?:::{_ID})*)[^;{{}}()=]*(?=\{{)", functions=_TYPED,
        tail=r"(?:\s|const|noexcept|override|final|mutable|&|->[^;{}()]*)*(?::(?!:)[^;]*?(?=\{(?!\s*\}\s*,)))?", shapes=rf"\benum\s+(?:class\s+)?(?P<name>{_ID})[^;{{}}()]*(?=\{{)", only_members=True,
        imports=r"(?m)^[ \t]*#[ \t]*include[^\n]*", variables=_FIELDS,
    ),
    "php": Grammar(
        blank=rf"{_COMMENTS}|\#(?!\[)[^\n]*|{_QUOTED}|{_TICKS}|\?>[\s\S]*?(?:<\?(?:php|=)?|\Z)|\A[\s\S]*?(?:<\?(?:php|=)?|\Z)", classes=rf"\b(?:class|interface|trait|enum)\s+(?P<name>{_ID})[^;{{}}()]*(?=\{{)",
        functions=rf"\bfunction\s+&?(?P<name>{_ID})\s*(?=\()", imports=r"(?m)^[ \t]*(?:use|require|require_once|include|include_once)\b[^;{]*;", variables=r"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|const|var)\s+)*\$?[A-Za-z_][\w$ \t?]*=[^;{]*;",
    ),
    "kotlin": Grammar(
        blank=rf'{_COMMENTS}|"""[\s\S]*?"""|{_QUOTED}|{_CHAR}', classes=rf"\b(?:class|object|interface)\s+(?P<name>{_ID})[^;{{}}=\n]*(?:\([^()]*\)[^;{{}}=\n]*)?(?=\{{)",
        functions=rf"\bfun\s+(?:<[^<>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>{_ID})\s*(?=\()", tail=r"[^;{}()=\n]*", by_line=True, expressions=r"[^;{}()=\n]*=", imports=r"(?m)^import\s[^\n]*", variables=r"(?m)^[ \t]*(?:(?:private|public|internal|protected|override|const|lateinit)\s+)*(?:val|var)\s[^\n{]*",
    ),
    "swift": Grammar(
        blank=rf'{_COMMENTS}|"""[\s\S]*?"""|{_QUOTED}', classes=rf"(?<!\.)\b(?:class|struct|protocol|extension|enum|actor)\s+(?!func\b|var\b|let\b)(?P<name>{_ID}(?:\.{_ID})*)[^;{{}}()\n]*(?=\{{)", functions=rf"\bfunc\s+(?P<name>{_ID}){_GENERIC}\s*(?=\()|\b(?P<alias>init)[?!]?\s*(?=\()",
        tail=r"[^;{}=]*", by_line=True, imports=r"(?m)^import\s[^\n]*", variables=r"(?m)^[ \t]*(?:(?:private|public|internal|static|fileprivate|lazy|weak)\s+)*(?:let|var)\s[^\n{]*",
    ),
}
GRAMMARS["tsx"] = GRAMMARS["typescript"]

_OPEN, _CLOSE = "([{", ")]}"


def blanked(text: str, pattern: str) -> str:
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def pairs(text: str) -> dict[int, int]:
    """The place of each opening bracket's closing one."""
    found, held = {}, []
    for m in re.finditer(r"[()\[\]{}]", text):
        if m[0] in _OPEN:
            held.append(m.start())
        elif not held or _OPEN.index(text[held[-1]]) != _CLOSE.index(m[0]):
            raise SyntaxError(f"a bracket at {m.start()} closes nothing")
        else:
            found[held.pop()] = m.start()
    if held:
        raise SyntaxError(f"the bracket at {held[-1]} stays open")
    return found


_GOES_ON = re.compile(r"\s*[.?:+*/&|]")


def _statement_end(text: str, at: int, closing: dict[int, int]) -> int:
    """Where the expression from ``at`` on ends: at a semicolon, a closing bracket, or a line's end after something."""
    begun = False
    while at < len(text):
        c = text[at]
        if c in _OPEN:
            at, begun = closing[at], True
        elif c in _CLOSE or c == ";" or (c == "\n" and begun and not _GOES_ON.match(text, at)):
            return at
        elif not c.isspace():
            begun = True
        at += 1
    return at


def _definitions(text: str, g: Grammar, closing: dict[int, int]) -> list[tuple[str, str, int, int, int, int]]:
    """kind, name, places of the head, of the body, of its end and of the parenthesis after the name (or -1); those inside come after those around."""
    out = []
    for kind, pattern in (("class", g.classes), ("symbol", g.shapes)):
        for m in re.finditer(pattern, text) if pattern else ():
            if m.end() in closing:
                out.append((kind, m["name"] or m.groupdict().get("alias") or "", m.start(), m.end(), closing[m.end()], -1))
    tail, expression = re.compile(g.tail), re.compile(g.expressions) if g.expressions else None
    for pattern, members in ((g.functions, g.only_members), (g.methods, True)):
        for m in re.finditer(pattern, text) if pattern else ():
            name = m["name"] or m.groupdict().get("alias") or ""
            if m.end() not in closing or (members and (name in _NOT_CALLED or re.search(r"(?:\bnew|\breturn|[.=,(!&|?+-])\s*$", text[max(0, m.start() - 12) : m.start()]))):
                continue
            after = closing[m.end()] + 1
            body = tail.match(text, after).end() if tail.match(text, after) else after
            if body in closing and text[body] == "{":
                out.append(("member" if members else "symbol", name, m.start(), body, closing[body], m.end()))
            elif expression and (e := expression.match(text, after)):
                out.append(("member" if members else "symbol", name, m.start(), e.end(), _statement_end(text, e.end(), closing), m.end()))
    if g.arrows:
        for m in re.finditer(rf"(?P<name>{_ID})\s*(?::[^=;(){{}}]*)?=\s*(?:async\s*)?(?:(?=\()|{_ID}\s*=>\s*)", text):
            body = m.end()
            if text[body : body + 1] == "(" and body in closing:
                arrow = re.compile(r"\s*(?::[^=;{}]*)?=>\s*").match(text, closing[body] + 1)
                body = arrow.end() if arrow else -1
            if body >= 0 and "=>" in text[m.start() : body]:
                out.append(("symbol", m["name"], m.start(), body, closing[body] if body in closing and text[body] == "{" else _statement_end(text, body, closing) - 1, -1))
    return sorted(out, key=lambda d: (d[3], -d[4]))


def _head(text: str, at: int, by_line: bool) -> int:
    """Where the statement that ``at`` is in begins: after the last semicolon, brace or label before it."""
    begin = max(text.rfind(c, 0, at) for c in ";{}") + 1
    label = list(re.finditer(r"\b(?:public|private|protected|case\b[^:\n]*|default)\s*:(?!:)", text[begin:at]))
    begin += label[-1].end() if label else 0
    if by_line and (line := text.rfind("\n", begin, at) + 1):
        while (above := text.rfind("\n", begin, line - 1) + 1 or begin) < line - 1 and text[above:line].lstrip().startswith("@"):
            line = above
        begin = line
    return begin + len(text[begin:at]) - len(text[begin:at].lstrip())


def parse(language: str, source: str) -> Node:
    """Raises SyntaxError if brackets do not pair."""
    g = GRAMMARS[language]
    text = blanked(source, g.blank)
    closing, lines = pairs(text), source.splitlines()
    line_of = [0]
    for m in re.finditer("\n", source):
        line_of.append(m.end())
    row = lambda at: bisect_right(line_of, at) - 1
    found = _definitions(text, g, closing)
    # A head looks like a call; the parenthesis after its name is none.
    heads = {m.end() for p in (g.functions, g.methods) if p for m in re.finditer(p, text)} & {paren for *_, paren in found}
    call = re.compile(rf"({_ID}){_GENERIC}\s*\(")
    called = lambda a, b: frozenset(m[1] for m in call.finditer(text, a, b) if m[1] not in _NOT_CALLED and m.end() - 1 not in heads)
    root = Node("other", "", 0, max(len(lines) - 1, 0), source, called(0, len(text)))
    open_: list[tuple[int, int, Node]] = [(0, len(text), root)]
    placed: list[tuple[int, int, Node]] = []
    for kind, name, head, body, end, _ in found:
        while not open_[-1][0] <= body <= open_[-1][1]:
            open_.pop()
        around = open_[-1][2]
        if kind == "member" and around.kind == "symbol":
            continue
        if any(b == body for _, b, _ in placed[-2:]):  # two patterns saw one body
            continue
        first, last = row(_head(text, head, g.by_line)), row(min(end, max(len(source) - 1, 0)))
        node = Node("class" if kind == "class" else "symbol", name, first, last, "\n".join(lines[first : last + 1]), called(body, end + 1))
        around.below.append(node)
        placed.append((head, body, node))
        open_.append((body, end, node))
    spans = [(body, closing.get(body, body), n) for _, body, n in placed]
    inside = lambda a: [n for b, e, n in spans if b < a < e]
    taken = [(n.first, n.last) for _, _, n in placed if n.kind == "symbol"]
    where = (("import", g.imports, source if "#" in g.imports else text), ("variable", g.variables, text))
    for kind, a, b in [(kind, *m.span()) for kind, pattern, t in where if pattern for m in re.finditer(pattern, t)]:
        a += len(source[a:b]) - len(source[a:b].lstrip())
        first, last, around = row(a), row(max(a, b - 1)), inside(a)
        if any(n.kind == "symbol" for n in around) or (kind == "variable" and (any(f <= first <= t for f, t in taken) or re.match(r"\s*(?:return|import|package|using|namespace|throw|goto|break|continue|else|typedef|use|require)\b", text[a:b]))):
            continue
        (around[-1] if around else root).below.append(Node(kind, "", first, last, "\n".join(lines[first : last + 1])))
    for n in [root, *(n for _, _, n in placed)]:
        n.below.sort(key=lambda x: x.first)
    return root


PARSERS: dict[str, Callable[[str], Node]] = {language: partial(parse, language) for language in GRAMMARS}
