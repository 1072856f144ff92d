"""Declarations of source files as a table: types with their members, annotations, parameters and bodies, nested to any depth.

One lexing pass a file tells comments, texts and brackets apart; brackets are matched on a stack, and what stands between
them is cut into statements. Comments never count as code, and a body ends where its bracket or its indentation ends.
Parsers are registered by language and yield the same rows for all, so scanners are Spark expressions on one table:

    declarations(files, "java").where("kind = 'class'").select("space", "name", F.explode("members"))

In SQL, after register(spark): SELECT d.* FROM files, LATERAL declarations('java', content) AS d

A row stands for a file (kind `file`, the first of each), or for a type in it:

    part      its place among the file's rows         name, kind   Order, class
    space     package, namespace or enclosing modules outer        enclosing types, by dots
    words     the head without annotations            notes        annotations (name, args)
    bases     what stands behind the name             broken       why the file is not well-formed; null if it is
    members   (pos, notes, words, params, tail, value, block): params (notes, words, value) is null where there are no
              parentheses; tail stands behind them; value behind `=`, or a type behind `:` where the language has it so

Broken files are read as far as they go: what is open at the end ends there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = {")": "(", "]": "[", "}": "{"}


class Note(NamedTuple):
    name: str
    args: str | None = None


class Param(NamedTuple):
    notes: list[Note]
    words: str
    value: str | None = None


class Member(NamedTuple):
    pos: int
    notes: list[Note]
    words: str
    params: list[Param] | None = None
    tail: str | None = None
    value: str | None = None
    block: bool = False


class Declared(NamedTuple):
    kind: str
    name: str | None
    space: str | None
    outer: str | None
    words: str
    notes: list[Note]
    bases: str | None
    members: list[Member]


@cache
def _lexis(comments: str, texts: str, marks: str) -> re.Pattern:
    return re.compile(rf"(?P<comment>{comments})|(?P<text>{texts})|[()\[\]{{}}{marks}]", re.DOTALL)


@cache
def _steps(mark: str) -> re.Pattern:
    return re.compile(rf"[(\[{{<>{mark}\"'`]|=>|->")


class Code:
    """A text without comments, its brackets matched: `close` has the place of each opening bracket's partner."""

    def __init__(self, text: str, comments: str, texts: str, marks: str = ""):
        lexis = _lexis(comments, texts, marks)
        out: list[str] = []
        self.tokens: list[tuple[int, str]] = []  # places of brackets and marks
        self.close: dict[int, int] = {}
        self.broken: str | None = None
        at = size = 0
        open_: list[tuple[int, str]] = []
        for m in lexis.finditer(text):
            out.append(text[at : m.start()])
            size += m.start() - at
            at = m.end()
            if m.lastgroup == "comment":
                kept = "\n" * m[0].count("\n") or " "
            else:
                kept = m[0]
                if m.lastgroup is None:
                    self.tokens.append((size, kept))
                    if kept in "([{":
                        open_.append((size, kept))
                    elif kept in PAIRS:
                        while open_ and open_[-1][1] != PAIRS[kept]:  # as if the inner ones had ended here
                            self.close[open_.pop()[0]] = size
                            self.broken = "unbalanced brackets"
                        if open_:
                            self.close[open_.pop()[0]] = size
                        else:
                            self.broken = "unbalanced brackets"
            out.append(kept)
            size += len(kept)
        out.append(text[at:])
        self.text = "".join(out)
        for place, _ in open_:
            self.close[place] = len(self.text)
            self.broken = "unbalanced brackets"

    def parts(self, start: int, stop: int, mark: str = ",", angles: bool = True) -> list[tuple[int, int]]:
        """The stretches between marks that stand in no bracket, angle brackets of types included."""
        out, at, depth, i = [], start, 0, start
        step = _steps(mark)
        while (m := step.search(self.text, i, stop)) is not None:
            c, i = m[0], m.end()
            if c in "([{" and m.start() in self.close:
                i = min(stop, self.close[m.start()] + 1)
            elif c in "\"'`":
                i = min(stop, _text_end(self.text, m.start()))
            elif c == "<" and angles:
                depth += 1
            elif c == ">" and angles:
                depth = max(0, depth - 1)
            elif c == mark and not depth:
                out.append((at, m.start()))
                at = i
        if out or self.text[at:stop].strip():
            out.append((at, stop))
        return out


_TEXT = re.compile(r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?|`(?:[^`\\]|\\.)*`?', re.DOTALL)


def _text_end(text: str, at: int) -> int:
    m = _TEXT.match(text, at)
    return m.end() if m else at + 1


def _bare(text: str) -> str:
    return " ".join(text.split())


_AT = re.compile(r"\s*((?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*)@(?!interface\b)\s*([\w.]+)\s*")
_SHARP, _SHARP_NAME = re.compile(r"\s*\["), re.compile(r"\s*(?:\w+\s*:\s*)?([\w.]+)\s*(\()?")


def _notes(code: Code, at: int, stop: int, sharp: bool) -> tuple[list[Note], str, int]:
    """The annotations that stand at a place, modifiers among them, and where they end: @Name(...), or [Name(...), Other]
    if sharp."""
    notes: list[Note] = []
    modifiers = ""
    while m := (_SHARP if sharp else _AT).match(code.text, at, stop):
        if sharp:
            end = code.close.get(m.end() - 1, stop)
            for a, b in code.parts(m.end(), end):
                if one := _SHARP_NAME.match(code.text, a, b):
                    notes.append(Note(one[1].split(".")[-1], code.text[one.end() : code.close.get(one.end() - 1, b)] if one[2] else None))
            at = min(stop, end + 1)
        else:
            at, args = m.end(), None
            modifiers += m[1]
            if at < stop and code.text[at] == "(":
                end = code.close.get(at, stop)
                args, at = code.text[at + 1 : end], min(stop, end + 1)
            notes.append(Note(m[2].split(".")[-1], args))
    return notes, modifiers, at


def _param(code: Code, start: int, stop: int, sharp: bool) -> Param:
    notes, modifiers, at = _notes(code, start, stop, sharp)
    sides = code.parts(at, stop, "=", angles=False)
    words = _bare(modifiers + code.text[slice(*sides[0])]) if sides else ""
    return Param(notes, words, code.text[sides[1][0] : stop].strip() if len(sides) > 1 else None)


_PAREN_OR_IS, _VALUE_AHEAD = re.compile(r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`[^`]*+`|[(=]'), re.compile(r"[=,]\s*$|\breturn\s*$")


def _member(code: Code, start: int, stop: int, pos: int, block: bool, sharp: bool) -> Member:
    notes, modifiers, at = _notes(code, start, stop, sharp)
    m = next((x for x in _PAREN_OR_IS.finditer(code.text, at, stop) if x[0] in "(="), None)
    if m is None:
        return Member(pos, notes, _bare(modifiers + code.text[at:stop]), block=block)
    words = _bare(modifiers + code.text[at : m.start()])
    if m[0] == "=":
        return Member(pos, notes, words, value=code.text[m.end() : stop].strip().removeprefix("> "), block=block)
    end = min(stop, code.close.get(m.start(), stop))
    params = [_param(code, a, b, sharp) for a, b in code.parts(m.end(), end)]
    return Member(pos, notes, words, params, _bare(code.text[end + 1 : stop]) or None, block=block)


#: A block whose members are those of the type around it.
_CHOICE = re.compile(r"\s*oneof\s+\w+\s*$")


class _Block(NamedTuple):
    start: int  # of its head
    stop: int
    level: int
    children: list
    closed: bool  # whether it has a body, in braces


def _blocks(code: Code, ends: str) -> _Block:
    """The statements of a file, nested by braces; a statement ends with one of `ends` or with its body."""
    top = _Block(0, 0, 0, [], True)
    stack, start, skip = [top], 0, -1
    for place, c in code.tokens:
        if place < skip:
            continue
        if c in "([":
            skip = code.close[place]
        elif c == "{":
            if _VALUE_AHEAD.search(code.text[max(start, place - 40) : place]):  # a value, not a body
                skip = code.close[place] + 1
                continue
            one = _Block(start, place, len(stack), [], True)
            stack[-1].children.append(one)
            stack.append(one)
            start = place + 1
        elif c == "}":
            if len(stack) > 1:
                if code.text[start:place].strip():
                    stack[-1].children.append(_Block(start, place, len(stack), [], False))
                stack.pop()
            start = place + 1
        elif c in ends:
            if code.text[start:place].strip():
                stack[-1].children.append(_Block(start, place, len(stack), [], False))
            start = place + 1
    if code.text[start:].strip():
        stack[-1].children.append(_Block(start, len(code.text), len(stack), [], False))
    return top


def _braced(comments: str, texts: str, kinds: str, space: str, sharp: bool = False, ends: str = ";") -> Callable:
    """A parser for languages with braces: kinds and space are patterns of the heads of types and of what names the space."""
    type_head, space_head = re.compile(rf"\b({kinds})\s+([\w$]+)"), re.compile(rf"^(?:{space})\s+([\w.]+)")

    def parse(text: str) -> tuple[list[Declared], str | None]:
        code = Code(text, comments, texts, ends)
        top, out = _blocks(code, ends), []
        todo: list[tuple[_Block, str | None, str | None]] = [(top, None, None)]
        file_space = None
        members = []
        for k, b in enumerate(top.children):
            if not b.closed:
                members.append(_member(code, b.start, b.stop, k, False, sharp))
                if m := space_head.match(members[-1].words):
                    file_space = file_space or m[1]
        while todo:
            block, outer, inside = todo.pop()
            nested = []
            for b in block.children:
                if not b.closed:
                    continue
                head = _member(code, b.start, b.stop, 0, True, sharp)
                if m := space_head.match(head.words):
                    nested.append((b, outer, ".".join(filter(None, (inside, m[1])))))
                    continue
                m = type_head.search(head.words)
                if m is None:
                    nested.append((b, outer, inside))  # types in bodies of methods and the like
                    continue
                flat = [x for c in b.children for x in (c.children if _CHOICE.match(code.text, c.start, c.stop) else [c])]
                own = [_member(code, c.start, c.stop, k, c.closed, sharp) for k, c in enumerate(flat)]
                raw = code.text[b.start : b.stop]
                named = type_head.search(raw, re.search(rf"\b{m[1]}\s+{re.escape(m[2])}", raw).start())
                bases = _bare(raw[named.end() :]) or None
                order = b.start, Declared(m[1], m[2], inside or file_space, outer, head.words, head.notes, bases, own)
                out.append(order)
                nested.append((b, ".".join(filter(None, (outer, m[2]))), inside))
            todo += nested
        types = [d for _, d in sorted(out, key=lambda x: x[0])]
        return [Declared("file", None, file_space, None, "", [], None, members), *types], code.broken

    return parse


C_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
C_TEXTS = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\''


def _indent(line: str) -> int:
    return len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())


_DECORATOR, _DEF = re.compile(r"@\s*([\w.]+)\s*(\()?"), re.compile(r"(?:async\s+)?(def|class)\s+(\w+)\s*(\()?")
_ASSIGNMENT = re.compile(r"([A-Za-z_]\w*)\s*(?::(?!=)\s*([^=]+?))?\s*(?:=(?!=)\s*(.*))?$", re.DOTALL)


def _python(text: str) -> tuple[list[Declared], str | None]:
    """Blocks by indentation: a logical line, which open brackets carry on, belongs to the last line with less before it."""
    code = Code(text, r"#[^\n]*|\\\n", r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', r"\n")
    lines: list[tuple[int, int]] = []
    start = skip = 0
    for place, c in code.tokens:
        if place < skip:
            continue
        if c in "([{":
            skip = code.close[place]
        elif c == "\n":
            lines.append((start, place))
            start = place + 1
    lines.append((start, len(code.text)))
    stack: list[tuple[int, Declared | None]] = []  # indentation, and the class that begins there
    functions: list[Member] = []
    out: list[Declared] = []
    notes: list[Note] = []
    for a, b in lines:
        line = code.text[a:b]
        if not line.strip():
            continue
        depth = _indent(line.split("\n", 1)[0])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        owner = stack[-1][1] if stack else None
        at = a + len(line) - len(line.lstrip())
        if code.text[at] == "@":
            if m := _DECORATOR.match(code.text, at, b):
                notes.append(Note(m[1], code.text[m.end() : code.close.get(m.end() - 1, b)] if m[2] else None))
            continue
        if m := _DEF.match(code.text, at, b):
            end = code.close.get(m.end() - 1, b) if m[3] else m.end() - 1
            params = [_python_param(code, x, y) for x, y in code.parts(m.end(), min(end, b), angles=False)] if m[3] else []
            tail = re.sub(r":\s*[^:]*$", "", code.text[end + 1 : b]).strip() or None
            if m[1] == "class":
                outer = ".".join(d.name for _, d in stack if d is not None) or None
                bases = code.text[m.end() : min(end, b)] if m[3] else None
                one = Declared("class", m[2], None, outer, m[0].rstrip("( "), notes, bases and _bare(bases), [])
                out.append(one)
                stack.append((depth, one))
            else:
                made = Member(len(functions), notes, _bare(m[0].rstrip("( ")), params, tail, block=True)
                functions.append(made)
                if owner is not None:
                    owner.members.append(made._replace(pos=len(owner.members)))
                stack.append((depth, None))
            notes = []
            continue
        notes = []
        if owner is not None:
            m = _ASSIGNMENT.match(code.text, at, b)
            if m and (m[2] or m[3]):
                owner.members.append(Member(len(owner.members), [], m[1], None, m[2] and _bare(m[2]), m[3] and m[3].strip()))
        if line.rstrip().endswith(":"):
            stack.append((depth, owner if owner is not None and re.match(r"(if|else|elif|try|except|finally|with)\b", line.strip()) else None))
    return [Declared("file", None, None, None, "", [], None, functions), *out], code.broken


def _python_param(code: Code, start: int, stop: int) -> Param:
    """name, with its type as a note without name where there is one, and its default."""
    sides = code.parts(start, stop, "=", angles=False)
    head = code.text[slice(*sides[0])] if sides else ""
    name, _, hint = head.partition(":")
    return Param([Note("type", _bare(hint))] if hint.strip() else [], name.strip(), code.text[sides[1][0] : stop].strip() if len(sides) > 1 else None)


_RUBY_OPENS = re.compile(r"^(?:class|module|def|if|unless|while|until|case|begin|for)\b(?!.*\bend$)|(?:=|<<|\()\s*(?:if|unless|case|begin)\b(?!.*\bend\b)|\bdo\s*(?:\|[^|]*\|)?\s*$")


def _ruby(text: str) -> tuple[list[Declared], str | None]:
    """Blocks by keywords: what opens a block goes on to its `end`."""
    code = Code(text, r"(?:(?<=\n)|\A)=begin\b.*?\n=end[^\n]*|#(?![{])[^\n]*", r'"(?:[^"\\]|\\.)*+"|\'(?:[^\'\\]|\\.)*+\'', "")
    stack: list[tuple[str, Declared | None]] = []
    out: list[Declared] = []
    hidden: dict[int, bool] = {}
    for line in code.text.split("\n"):
        line = line.strip()
        owner = next((d for _, d in reversed(stack) if d is not None), None)
        m = re.match(r"(class|module)\s+(?!<<)([A-Z][\w:]*)\s*(?:<\s*([\w:.]+))?", line)
        if m:
            outer = [d.name for _, d in stack if d is not None]
            one = Declared(m[1], m[2], "::".join(outer) or None, None, line, [], m[3], [])
            out.append(one)
            if not re.search(r"\bend$", line):
                stack.append((m[1], one))
            continue
        if line == "end" or re.match(r"end\b", line):
            if stack:
                stack.pop()
            continue
        if owner is not None and line:
            if re.fullmatch(r"private|protected", line):
                hidden[id(owner)] = True
            elif re.fullmatch(r"public", line):
                hidden[id(owner)] = False
            note = [Note("hidden")] if hidden.get(id(owner)) else []
            if m := re.match(r"def\s+((?:self\.)?[\w?!=]+)", line):
                owner.members.append(Member(len(owner.members), note, f"def {m[1]}", block=True))
            else:
                owner.members.append(Member(len(owner.members), note, line))
        if _RUBY_OPENS.search(line) and not re.match(r"def\s+[\w.?!]+(?:\([^)]*\))?\s*=", line):
            stack.append((line, None))
    return [Declared("file", None, None, None, "", [], None, []), *out], code.broken or ("blocks without end" if stack else None)


def _graphql(text: str) -> tuple[list[Declared], str | None]:
    """The definitions of a schema, by its grammar: each token tells what follows."""
    code = Code(text, r"#[^\n]*", r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*+"')
    tokens = [m[0] for m in re.finditer(r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\.\.\.|[A-Za-z_]\w*|-?\d[\d.eE+-]*|[!$&()\[\]{}:=@|]', code.text, re.DOTALL)]
    tokens = [t for t in tokens if t[0] != '"' or t[1:2] == ""] + [""]
    at = 0

    def take(want: str = "") -> str:
        nonlocal at
        t = tokens[at]
        if not t or (want and t != want):
            raise ValueError(f"{want or 'more'} expected at token {at}, {t or 'the end'} found")
        at += 1
        return t

    def skipped(opens: str, closes: str) -> None:
        depth = 0
        while True:
            t = take()
            depth += (t == opens) - (t == closes)
            if not depth:
                return

    def value() -> None:
        if tokens[at] in ("[", "{"):
            skipped(tokens[at], "]" if tokens[at] == "[" else "}")
        else:
            if tokens[at] == "$":
                take()
            take()

    def directives() -> list[Note]:
        out = []
        while tokens[at] == "@":
            take()
            out.append(Note(take()))
            if tokens[at] == "(":
                skipped("(", ")")
        return out

    def kind() -> str:
        if tokens[at] == "[":
            take()
            out = f"[{kind()}]"
            take("]")
        else:
            out = take()
        return out + (take() if tokens[at] == "!" else "")

    def inputs(closes: str) -> Iterator[tuple[str, str, list[Note]]]:
        while tokens[at] != closes:
            name = take()
            take(":")
            of = kind()
            if tokens[at] == "=":
                take()
                value()
            yield name, of, directives()
        take(closes)

    def fields() -> Iterator[Member]:
        n = 0
        while tokens[at] != "}":
            name, params = take(), None
            if tokens[at] == "(":
                take()
                params = [Param(notes, x, of) for x, of, notes in inputs(")")]
            take(":")
            of = kind()
            yield Member(n, directives(), name, params, None, of)
            n += 1
        take("}")

    out: list[Declared] = []
    broken = code.broken
    try:
        while tokens[at]:
            extends = tokens[at] == "extend"
            if extends:
                take()
            what = take()
            if what == "{":
                raise ValueError("a definition expected, { found")
            if what == "schema":
                directives()
                if tokens[at] == "{":
                    skipped("{", "}")
                continue
            if what == "directive":
                take("@")
                take()
                if tokens[at] == "(":
                    skipped("(", ")")
                while tokens[at] and tokens[at] not in ("type", "input", "interface", "union", "enum", "scalar", "schema", "extend", "directive"):
                    take()
                continue
            name, bases, members = take(), [], []
            if tokens[at] == "implements":
                take()
                while tokens[at] and tokens[at] not in ("{", "@"):
                    if (t := take()) != "&":
                        bases.append(t)
            notes = directives()
            if what == "union" and tokens[at] == "=":
                take()
                while tokens[at] == "|" or (members and tokens[at - 1] == "|") or not members:
                    if tokens[at] == "|":
                        take()
                        continue
                    members.append(Member(len(members), [], take()))
            elif tokens[at] == "{":
                take()
                if what in ("type", "interface"):
                    members = list(fields())
                elif what == "input":
                    members = [Member(k, own, x, None, None, of) for k, (x, of, own) in enumerate(inputs("}"))]
                else:
                    while tokens[at] != "}":
                        members.append(Member(len(members), [], take()))
                        directives()
                    take("}")
            out.append(Declared(what, name, None, None, "extend " * extends + f"{what} {name}", notes, ", ".join(bases) or None, members))
    except (ValueError, RecursionError) as e:
        broken = broken or f"no schema: {e}"
    return [Declared("file", None, None, None, "", [], None, []), *out], broken


_TYPES = "class|interface|enum|record"
#: Parsers by language: a text's declarations, the file's first, and why it is not well-formed.
PARSERS: dict[str, Callable[[str], tuple[list[Declared], str | None]]] = {
    "java": _braced(C_COMMENTS, r'"""(?:[^\\]|\\.)*?"""|' + C_TEXTS, _TYPES, "package"),
    "csharp": _braced(C_COMMENTS + r"|(?m:^[ \t]*#[^\n]*)", r'\$?@\$?"(?:[^"]|"")*+"|' + C_TEXTS, _TYPES + "|struct", "namespace", sharp=True),
    "protobuf": _braced(C_COMMENTS, C_TEXTS, "message|service|enum", "package"),
    "sql": _braced(r"--[^\n]*|/\*.*?(?:\*/|\Z)", r"'(?:[^']|'')*+'", "(?!x)x", "(?!x)x"),
    "go": _braced(C_COMMENTS, r'`[^`]*`|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', "type", "package", ends=";\n"),
    "python": _python,
    "ruby": _ruby,
    "graphql": _graphql,
}
_NOTES = "array<struct<name:string,args:string>>"
_MEMBERS = f"array<struct<pos:int,notes:{_NOTES},words:string,params:array<struct<notes:{_NOTES},words:string,value:string>>,tail:string,value:string,block:boolean>>"
COLUMNS = f"part int, kind string, name string, space string, outer string, words string, notes {_NOTES}, bases string, members {_MEMBERS}, broken string"


def parse(language: str, text: str | None) -> Iterator[tuple]:
    """The rows of a text, by COLUMNS. A language without a parser gives one row that says so."""
    parser = PARSERS.get(language)
    if parser is None:
        yield 0, "file", None, None, None, "", [], None, [], f"no parser for {language}"
        return
    try:
        rows, broken = parser(text or "")
    except (ValueError, IndexError, RecursionError) as e:  # what a parser cannot read is that file's failure alone
        rows, broken = [Declared("file", None, None, None, "", [], None, [])], f"not read: {e}"
    for part, d in enumerate(rows):
        yield part, d.kind, d.name, d.space, d.outer, d.words, d.notes, d.bases, d.members, broken


def _arrow_types() -> list[tuple[str, pa.DataType]]:
    notes = pa.list_(pa.struct([("name", pa.string()), ("args", pa.string())]))
    params = pa.list_(pa.struct([("notes", notes), ("words", pa.string()), ("value", pa.string())]))
    member = pa.struct([("pos", pa.int32()), ("notes", notes), ("words", pa.string()), ("params", params), ("tail", pa.string()), ("value", pa.string()), ("block", pa.bool_())])
    text = pa.string()
    return [("part", pa.int32()), ("kind", text), ("name", text), ("space", text), ("outer", text), ("words", text), ("notes", notes), ("bases", text), ("members", pa.list_(member)), ("broken", text)]


def _plain(v: object) -> object:
    if isinstance(v, tuple) and hasattr(v, "_fields"):
        return {n: _plain(x) for n, x in zip(v._fields, v, strict=True)}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def declarations(files: DataFrame, language: str) -> DataFrame:
    """(rel_path, *COLUMNS) of files (rel_path, content); each file gives one row at least, a null content an empty one."""
    types = _arrow_types()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(1 + len(types))]
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in parse(language, text):
                    for column, v in zip(out, (path, *row), strict=True):
                        column.append(_plain(v))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(c, t) for c, (_, t) in zip(out[1:], types, strict=True))], ["rel_path", *(n for n, _ in types)])

    return files.select("rel_path", "content").mapInArrow(run, f"rel_path string, {COLUMNS}")


class Declarations:
    """The table function `declarations(language, content)`."""

    def eval(self, language: str, content: str) -> Iterator[tuple]:
        yield from parse(language, content)


def register(spark: SparkSession) -> None:
    spark.udtf.register("declarations", F.udtf(Declarations, returnType=COLUMNS))
