"""Grammars that find functions with their documentation: Python (docstrings) and JavaScript (/** comments).

Each grammar gives a tree of Definition by semantic actions; offsets are those of the text with line ends made \\n.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

from sextant.llm.peg import State, absent, act, ahead, choice, many, opt, rule, rx, seq


@dataclass
class Definition:
    kind: str  # function, class
    name: str
    start: int
    stop: int = 0
    documentation: str | None = None
    inner: list = field(default_factory=list)


def _definitions(value) -> list:
    """Definitions of a nested value, outermost only."""
    if isinstance(value, Definition):
        return [value]
    if isinstance(value, (list, tuple)):
        return [d for v in value for d in _definitions(v)]
    return []


# ---- tokens of Python ----
_SPACE = rx(r"(?:[ \t\f]|\\\n)*")
_COMMENT = rx(r"#[^\n]*")
_END = rx(r"\n|\Z")
_BLANKS = rx(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*(?:[ \t\f]*(?:#[^\n]*)?\Z)?")
# ---- stretches that need no rules: words, short strings that are not formatted, brackets up to three deep on one line ----
_CHARS = r"\w++(?!['\"])|[^\w'\"#()\[\]{}\\\n]++"
_QUOTED = r"""(?<!\w)[rRbBuU]{0,2}(?:'(?!'')[^'\\\n]*+'(?!')|"(?!"")[^"\\\n]*+"(?!"))"""
_INNER = rf"(?:{_CHARS}|{_QUOTED})*+"
for _ in range(2):
    _INNER = rf"(?:{_CHARS}|{_QUOTED}|[(\[{{]{_INNER}[)\]}}])*+"
_FLAT = rf"{_CHARS}|{_QUOTED}|[(\[{{]{_INNER}[)\]}}]"
_GAP = r"(?:[ \t\f]*+(?:#[^\n]*+)?\n)*+"


_WORD = rx(r"\w+")
_LITERAL = rx(r"""[rRbBuUfFtT]{0,2}(?:'''(?:[^'\\]|\\.|'(?!''))*'''|\"""(?:[^"\\]|\\.|"(?!""))*\"""|'(?!'')(?:[^'\\\n]|\\.)*'|"(?!"")(?:[^"\\\n]|\\.)*"|''(?!')|""(?!"))""", re.S)


def _formatted(quote: str) -> object:
    """A formatted literal, whose fields may hold the quote that closes it."""
    text = rf"(?:[^{{\\{quote[0]}{'' if len(quote) == 3 else chr(92) + 'n'}]|\\.|\{{\{{" + (rf"|{quote[0]}(?!{quote[0] * 2})" if len(quote) == 3 else "") + ")+"
    return seq(rx(rf"(?:[fF][rR]?|[rR][fF]){quote}"), many(choice(rx(text, re.S), _bracket())), rx(quote))


string = rule("string", lambda: choice(seq(ahead(rx(r"(?:[fF][rR]?|[rR][fF])['\"]")), choice(_formatted("'''"), _formatted('"""'), _formatted("'"), _formatted('"'))), _LITERAL))
_bracket = rule("bracket", lambda: seq(rx(r"[(\[{]"), many(choice(rx(r"[ \t\f\n]+"), _COMMENT, _token)), rx(r"[)\]}]")))
_token = choice(rx(rf"(?:{_FLAT})++"), string(), _WORD, _bracket(), rx(r"\\\n"))
_line = seq(many(_token), opt(_COMMENT), _END)  # one logical line


def _filler(n: int):
    """Lines of at least n blanks that are whole in themselves and begin no definition, with the gaps between them.

    This is what most of a source is; anything else (strings over lines, open brackets, tabs, joined lines) is left to
    the rules for statements.
    """
    return rx(rf"(?:{_GAP} {{{n},}}+(?![ \t\f\n#])(?!(?:async|def|class)\b|@)(?:{_FLAT})*+(?:#[^\n]*+)?\n)++")


def _width(blank: str) -> int:
    return len(blank.replace("\f", "").expandtabs(8))


def _indent(test):
    """White space at the start of a line, before something, whose width passes the test."""

    def parse(s, p):
        m = _indentation.match(s.text, p)
        return (m.end(), _width(m[0])) if m and m.end() < len(s.text) and test(_width(m[0])) else None

    return parse


_indentation = re.compile(r"[ \t\f]*(?![ \t\f\n#])")
_texts = choice(
    act(seq(string(), many(seq(_SPACE, string()))), lambda s, a, b, v: s.text[a:b]),
    act(seq(rx(r"\("), rx(r"[ \t\f\n]*"), many(seq(choice(string(), rx(r"#[^\n]*")), rx(r"(?:[ \t\f\n]|\\\n)*")), 1), rx(r"\)")), lambda s, a, b, v: s.text[a:b]),
)


def _literal(s, a, b, v) -> str | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval("(" + v[0] + "\n)")
    except (SyntaxError, ValueError):
        return None
    return value if isinstance(value, str) else None


documentation = act(seq(_texts, ahead(seq(_SPACE, choice(rx(";"), seq(opt(_COMMENT), _END))))), _literal)
_header_rest = many(choice(rx(r"(?:" + _FLAT.replace(r"[^\w", r"[^:\w", 1) + ")++"), string(), _WORD, _bracket(), rx(r"\\\n")))


def _suite(n: int):
    """What follows the colon: statements on the same line, or a block of deeper lines."""
    return choice(
        seq(_SPACE, opt(_COMMENT), rx(r"\n"), _BLANKS, _deeper(n)),
        act(seq(_SPACE, opt(ahead(documentation)), _line), lambda s, a, b, v: ("body", v[1], [])),
    )


def _enter(n):
    def parse(s, p):
        r = _indent(lambda w: w > n)(s, p)
        return None if r is None else block(r[1])(s, p)

    return parse


_deeper = rule("deeper", _enter)


def _first(n):
    return seq(_indent(lambda w: w == n), opt(ahead(documentation)), statement(n))


def _block_value(s, a, b, v):
    first, rest = v
    return "body", first[1], _definitions([first[2], rest])


# after a filler the lines of a deeper block may follow, whose first line the filler has taken
_deeper_rest = lambda n: act(seq(_BLANKS, _deeper(n)), lambda s, a, b, v: _body(v[1])[1])
block = rule("block", lambda n: act(seq(_first(n), many(choice(_filler(n), act(seq(_BLANKS, _indent(lambda w: w == n), statement(n)), lambda s, a, b, v: v[2]), _deeper_rest(n)))), _block_value))


def _body(value):
    """The (documentation, definitions) of a suite."""
    found = value if isinstance(value, tuple) and value[:1] == ("body",) else next(x for x in reversed(value) if isinstance(x, tuple))
    return found[1], found[2]


def _defined(s, a, b, v):
    head, rest = v[0], v[-1]
    doc, inner = _body(rest)
    return Definition("class" if head["word"] == "class" else "function", head["name"], a, b, doc, inner)


definition = rule("definition", lambda n: act(seq(rx(r"(?P<word>class|(?:async(?:[ \t\f]|\\\n)+)?def)(?:[ \t\f]|\\\n)+(?P<name>\w+)"), _header_rest, rx(":"), _suite(n)), _defined))
_decorator = seq(rx("@"), _line, _BLANKS)
statement = rule(
    "statement",
    lambda n: choice(
        act(seq(many(seq(_decorator, _indent(lambda w: w == n))), definition(n)), lambda s, a, b, v: v[1]),
        act(seq(absent(_END), _line, opt(act(seq(_BLANKS, _deeper(n)), lambda s, a, b, v: _body(v[1])[1]))), lambda s, a, b, v: _definitions(v[2])),
    ),
)
module = act(seq(_BLANKS, many(choice(_filler(0), act(seq(_indent(lambda w: w == 0), statement(0), _BLANKS), lambda s, a, b, v: v[1]), _deeper_rest(0), seq(_line, _BLANKS)))), lambda s, a, b, v: _definitions(v[1]))


def _valid_python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


# ---- JavaScript ----
_JS_SPACE = rx(r"(?:\s|//[^\n]*|/\*(?!\*)(?:[^*]|\*(?!/))*\*/)*")
_JS_STRING = rx(r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`""", re.S)
_js_bracket = rule("js_bracket", lambda: seq(rx(r"[(\[{]"), many(choice(_JS_STRING, rx(r"//[^\n]*|/\*(?!\*)(?:[^*]|\*(?!/))*\*/"), _js_definition(), rx(r"/\*(?:[^*]|\*(?!/))*\*/"), _js_bracket(), rx(r"\w+|[^\w'\"`(){}\[\]/]+|/"))), rx(r"[)\]}]")))
_js_head = rx(r"(?:(?:export|default|static|async)\s+)*(?:(?P<class>class)\s+(?P<cname>[\w$]+)[^{]*|function\s*\*?\s*(?P<fname>[\w$]+)\s*|(?:const|let|var)\s+(?P<vname>[\w$]+)\s*=\s*(?:async\s*)?(?:function\s*\*?\s*)?(?=\()|(?!(?:if|for|while|switch|catch|return)\b)(?P<mname>[\w$]+)\s*(?=\([^()]*\)\s*\{))")


def _js_doc(s, a, b, v):
    return re.sub(r"(?m)^\s*\*+ ?", "", v[0][3:-2]).strip()


def _js_defined(s, a, b, v):
    head = v[1]
    name = next(x for x in (head["cname"], head["fname"], head["vname"], head["mname"]) if x)
    return Definition("class" if head["class"] else "function", name, s.text.index(head[0], a), b, v[0], _definitions(v[2:]))


_js_definition = rule(
    "js_definition",
    lambda: act(seq(opt(act(seq(rx(r"/\*\*(?:[^*]|\*(?!/))*\*/"), _JS_SPACE), lambda s, a, b, v: _js_doc(s, a, b, v[0]))), _js_head, opt(seq(ahead(rx(r"\(")), _js_bracket())), _JS_SPACE, opt(rx(r"=>\s*")), _js_bracket()), _js_defined),
)
script = act(many(choice(_js_definition(), _JS_STRING, rx(r"/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*"), _js_bracket(), rx(r"\w+|\s+|."))), lambda s, a, b, v: _definitions(v))

#: Suffix of a file -> (grammar, validity of a text).
LANGUAGES = {".py": (module, _valid_python), ".js": (script, lambda text: True)}


def definitions(text: str, suffix: str) -> tuple[str, list[Definition], str | None]:
    """The text as parsed (line ends \\n, no byte-order mark), its outermost definitions, and why it could not be read."""
    grammar, valid = LANGUAGES[suffix]
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if not valid(text):
        return text, [], "not valid"
    try:
        return text, grammar(State(text), 0)[1], None
    except RecursionError:
        return text, [], "nests too deep"
