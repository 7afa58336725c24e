"""JavaScript (script or module, 2023), TypeScript and TSX."""

from __future__ import annotations

import re

from codelode.llm.syntax.derivatives import FreeState, Grammar, Language

COMMON = r"""
program: item*

item: stmt | import | export

import: 'import' STR attrs? SC | 'import' importclause 'from' STR attrs? SC

attrs: ('with' | 'assert') object

importclause: ident (',' (nsimport | namedimports))? | nsimport | namedimports

nsimport: '*' 'as' ident

namedimports: '{' (importspec (',' importspec)* ','?)? '}'

exportspec: (name | STR) ('as' (name | STR))?

stmt: block | vardecl SC | func | class | 'if' '(' expr ')' stmt ('else' stmt)? | for | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' SC? | 'continue' ident? SC | 'break' ident? SC | 'return' expr? SC | 'throw' expr SC | try | switch | 'debugger' SC | ';' | ident ':' stmt | 'with' '(' expr ')' stmt | ~'{' ~'function' ~'class' expr SC | 'async' func

block: '{' stmt* '}'

for: 'for' 'await'? '(' ((vardecl | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') target | lhs) ('of' assign | 'in' expr) | 'var' ident '=' assign 'in' expr) ')' stmt

try: 'try' block (catch ('finally' block)? | 'finally' block)

switch: 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}'

vardecl: ('var' | 'let' | 'const') binding (',' binding)*

target: ident | objectpattern | arraypattern

objectpattern: '{' (patternprop (',' patternprop)* ','?)? '}'

patternprop: propname ':' target ('=' assign)? | ident ('=' assign)? | '...' target

arraypattern: '[' patternelem? (',' patternelem?)* ']'

patternelem: '...'? target ('=' assign)?

expr: assign (',' assign)*

assign: arrow | cond (assignop assign)? | 'yield' '*'? assign?

assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='

body: block | ~'{' assign

cond: binary ('?' assign ':' assign)?

binop: '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '**'

unary: ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* lhs ('++' | '--')?

lhs: ('new'+ newtarget | primary) suffix*

newtarget: '.' name | primary

args: '(' (arg (',' arg)* ','?)? ')'

arg: '...'? assign

array: '[' arg? (',' arg?)* ']'

object: '{' (prop (',' prop)* ','?)? '}'

propname: name | STR | NUM | '[' assign ']'

name: ident | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with'

ident: ID | 'async' | 'of' | 'get' | 'set' | 'static' | 'let' | 'await' | 'yield' | 'from' | 'as' | 'assert' | 'accessor' | 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'public' | 'private' | 'protected' | 'override' | 'implements' | 'keyof' | 'infer' | 'unique' | 'is' | 'asserts' | 'satisfies' | 'global' | 'require' | 'undefined' | 'out' | 'using'

decorator: '@' lhs
"""

SCRIPT = r"""
vardecl: ('var' | 'let') binding (',' binding)* | 'const' initialised (',' initialised)*

initialised: target '=' assign

assign: arrow | cond | pattern '=' assign | simple assignop assign | 'yield' '*'? assign?

simple: ident | (primary | 'new'+ newtarget suffix* args) suffix* ('.' (name | PRIVATE) | '[' expr ']' | args) | '(' simple ')'

pattern: '{' (assignprop (',' assignprop)* ','?)? '}' | '[' assignelem? (',' assignelem?)* ']'

assignprop: propname ':' (pattern | simple) ('=' assign)? | ident ('=' assign)? | '...' (pattern | simple)

assignelem: '...'? (pattern | simple) ('=' assign)?

unary: ('!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await')* (lhs | simple ('++' | '--') | ('++' | '--') simple)

for: 'for' 'await'? '(' ((vardecl | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') target | simple | pattern) ('of' assign | 'in' expr) | 'var' ident '=' assign 'in' expr) ')' stmt

importspec: ident | (name | STR) 'as' ident

export: 'export' ('*' ('as' (name | STR))? 'from' STR attrs? SC | '{' (exportspec (',' exportspec)* ','?)? '}' ('from' STR attrs?)? SC | 'default' (func | class | 'async' func | ~'function' ~'class' assign SC) | vardecl SC | func | 'async' func | class)

binding: ident ('=' assign)? | (objectpattern | arraypattern) '=' assign

catch: 'catch' ('(' target ')')? block

func: 'function' '*'? ident? params block

params: '(' (param (',' param)* ','?)? ')'

param: '...'? target ('=' assign)?

arrow: 'async'? (ident | params) '=>' body

binary: unary (binop unary)* | PRIVATE 'in' unary (binop unary)*

suffix: '.' (name | PRIVATE) | '?.' (name | PRIVATE | '[' expr ']' | args) | '[' expr ']' | args | TPL

primary: ident | NUM | STR | TPL | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | array | object | func | 'async' func | class | '(' expr ')' | 'import' ('(' assign (',' assign)? ','? ')' | '.' name)

prop: propname ':' assign | ident | '...' assign | method

method: ('get' | 'set' | 'async'? '*'?) propname params block

class: decorator* 'class' (~'extends' ident)? ('extends' lhs)? '{' member* '}'

member: ';' | 'static' block | decorator* 'static'? 'accessor'? (('get' | 'set' | 'async'? '*'?) (propname | PRIVATE) params block | (propname | PRIVATE) ('=' assign)? SC)
"""

TYPED = r"""
importspec: 'type'? (ident | (name | STR) 'as' ident)

import: 'import' STR attrs? SC | 'import' 'type'? importclause 'from' STR attrs? SC | 'import' 'type'? ident '=' ('require' '(' STR ')' | ident ('.' name)*) SC

export: 'export' ('type'? '*' ('as' (name | STR))? 'from' STR attrs? SC | 'type'? '{' ('type'? exportspec (',' 'type'? exportspec)* ','?)? '}' ('from' STR attrs?)? SC | 'default' (func | class | 'abstract' class | 'async' func | interface | ~'function' ~'class' assign SC) | '=' expr SC | 'as' 'namespace' ident SC | 'import' ident '=' ('require' '(' STR ')' | ident ('.' name)*) SC | vardecl SC | func | 'async' func | class | typed)

stmt: block | vardecl SC | func | class | 'if' '(' expr ')' stmt ('else' stmt)? | for | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' SC? | 'continue' ident? SC | 'break' ident? SC | 'return' expr? SC | 'throw' expr SC | try | switch | 'debugger' SC | ';' | ident ':' stmt | 'with' '(' expr ')' stmt | ~'{' ~'function' ~'class' expr SC | 'async' func | typed

typed: interface | 'type' ident typeparams? '=' type SC | 'const'? 'enum' ident '{' (enumitem (',' enumitem)* ','?)? '}' | 'abstract' class | ('namespace' | 'module') (ident ('.' name)* | STR) '{' item* '}' | 'global' '{' item* '}' | 'declare' (typed | vardecl SC | func | class | 'module' STR SC)

vardecl: ('var' | 'let' | 'const' | 'await'? 'using') binding (',' binding)*

interface: 'interface' ident typeparams? ('extends' typeref (',' typeref)*)? typebody

enumitem: propname ('=' assign)?

binding: target '!'? (':' type)? ('=' assign)?

catch: 'catch' ('(' target (':' type)? ')')? block

func: 'function' '*'? ident? signature (block | SC)

signature: typeparams? params (':' returntype)?

returntype: type | 'asserts' (ident | 'this') ('is' type)? | (ident | 'this') 'is' type

params: '(' (param (',' param)* ','?)? ')'

param: decorator* ('public' | 'private' | 'protected' | 'readonly' | 'override')* '...'? (target | 'this') '?'? (':' type)? ('=' assign)?

arrow: 'async'? (ident | signature) '=>' body

binary: castunary (binop castunary | ('as' | 'satisfies') (type | 'const'))* | PRIVATE 'in' unary

suffix: '.' (name | PRIVATE) | '?.' (name | PRIVATE | '[' expr ']' | typeargs? args) | '[' expr ']' | args | TPL | '!' | typeargs

prop: propname ':' assign | ident ('=' assign)? | '...' assign | method

method: ('get' | 'set' | 'async'? '*'?) propname signature block

class: decorator* 'class' (~'extends' ~'implements' ident)? typeparams? ('extends' lhs)? ('implements' typeref (',' typeref)*)? '{' member* '}'

member: ';' | 'static' block | decorator* modifier* (('get' | 'set' | 'async'? '*'?) (propname | PRIVATE) '?'? signature (block | SC) | (propname | PRIVATE) ('?' | '!')? (':' type)? ('=' assign)? SC | '[' ident ':' type ']' ':' type SC)

modifier: 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'readonly' | 'override' | 'declare' | 'accessor'

typeparams: '<' typeparam (',' typeparam)* ','? '>'

typeparam: ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)?

typeargs: '<' type (',' type)* ','? '>'

typeref: ident ('.' name)* typeargs? | 'this'

type: uniontype ('extends' (uniontype | functype) '?' type ':' type)? | functype

functype: ('abstract'? 'new')? typeparams? params '=>' returntype

uniontype: ('|' | '&')? unarytype (('|' | '&') unarytype)*

unarytype: ('keyof' | 'unique' | 'readonly')* posttype | 'infer' ident ('extends' uniontype)?

posttype: atomtype ('[' type? ']')*

atomtype: typeref | 'void' | 'null' | 'undefined' | 'true' | 'false' | STR | '-'? NUM | TPL | '(' type ')' | '[' (tupleitem (',' tupleitem)* ','?)? ']' | typebody | 'typeof' (ident | 'this' | 'import' '(' STR ')') ('.' (name | PRIVATE))* typeargs? | 'import' '(' STR ')' ('.' name)* typeargs?

tupleitem: '...'? (name '?'? ':' type | type '?'?)

typebody: '{' (mapped | (typemember typesep)* typemember? ) '}'

typesep: ',' | SC

typemember: ('readonly' | '+' 'readonly' | '-' 'readonly')? propname '?'? (':' type)? | ('get' | 'set')? propname '?'? signature | 'new'? signature | ('readonly')? '[' ident ':' type ']' (':' type)?

mapped: (('+' | '-')? 'readonly')? '[' ident 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? (';' | ',')?
"""

PLAIN_TS = r"""
castunary: unary | '<' (type | 'const') '>' castunary

primary: ident | NUM | STR | TPL | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | array | object | func | 'async' func | class | '(' expr ')' | 'import' ('(' assign (',' assign)? ','? ')' | '.' name)
"""

JSX = r"""
castunary: unary

primary: ident | NUM | STR | TPL | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | array | object | func | 'async' func | class | '(' expr ')' | 'import' ('(' assign (',' assign)? ','? ')' | '.' name) | element

element: '<' jsxname typeargs? jsxattr* ('/' '>' | '>' child* '<' '/' jsxname '>') | '<' '>' child* '<' '/' '>'

jsxname: name ('-' name?)* ((':' | '.') name ('-' name?)*)*

jsxattr: name ('-' (name | NUM)?)* (':' name)? ('=' (STR | '{' assign '}' | element))? | '{' '...' assign '}'

child: element | '{' ('...'? expr)? '}' | JTEXT | ~'<' ~'>' ~'{' ~'}' ANY
"""

_RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_CONTEXT = set("async of get set static let await yield from as assert accessor type interface namespace module declare abstract readonly public private protected override implements keyof infer unique is asserts satisfies global require undefined out using".split())
_OPS = "... => === !== **= <<= &&= ||= ??= == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @".split()
_STRING = r"(?:\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_NUMBER = r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)"
_IDENT = r"(?:[^\W\d]|\$|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:\w|\$|‌|‍|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*"
_TEXT = r"(?:[^`\\$]+|\\[\s\S]|\$(?!\{))*"  # between the holes of a template
_REGEX = r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
# a slash after "<" ends an element in TSX
_BEFORE_REGEX = r"(?:(?<=[=(,:\[!&|?{;+\-*%~^>\n])|(?<=return)|(?<=typeof)|(?<=case)|(?<=^))[ \t]*"


def _pattern(jsx: bool) -> re.Pattern:
    text = r"(?<=[>}])[^<>{}]*[^<>{}\s][^<>{}]*(?=</)|" if jsx else ""
    # after a line end a slash begins a regular expression only where no operand is before it; there it
    # is told from a division by the blank that follows the operator
    return re.compile(r"\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|^#![^\n]*|" + text + ("" if jsx else r"(?<=<)(?=" + _REGEX + ")" + _REGEX + "|") + _BEFORE_REGEX + "(?=" + _REGEX + ")" + _REGEX + "|" + _STRING + "|#" + _IDENT + "|" + _IDENT + "|" + _NUMBER + "|" + r"\?\.(?!\d)|" + "|".join(re.escape(x) for x in _OPS if x != "?.") + r"|[^\s]")


_FULL = {k: re.compile(v) for k, v in {"STR": _STRING, "NUM": _NUMBER, "ID": _IDENT, "PRIVATE": "#" + _IDENT, "REGEX": r"[ \t]*" + _REGEX}.items()}
_CHUNK, _SLASHED = re.compile(_TEXT), re.compile(_REGEX)


def _template(pattern: re.Pattern, text: str, at: int) -> tuple[int, list[tuple[int, int]]] | None:
    """The end of the template that begins at ``at`` and its holes' places; its expressions are read as
    tokens with a depth of braces, so that it may nest as deep as it likes. None if it isn't closed."""
    i, open_, holes, first = at + 1, [-1], [], 0  # -1: in the text of a template, else braces open in a hole
    while open_:
        if open_[-1] < 0:
            i = _CHUNK.match(text, i).end()
            if text.startswith("`", i):
                open_.pop()
                i += 1
            elif text.startswith("${", i):
                i += 2
                if len(open_) == 1:
                    first = i
                open_.append(0)
            else:
                return None
            continue
        m = pattern.search(text, i)
        if not m:
            return None
        i, t = m.end(), m.group()
        if t == "`":
            open_.append(-1)
        elif t == "{":
            open_[-1] += 1
        elif t == "}" and open_[-1]:
            open_[-1] -= 1
        elif t == "}":
            open_.pop()
            if len(open_) == 1:
                holes.append((first, m.start()))
    return i, holes


class _Language(Language):
    """Templates are one token each."""

    def tokens(self, text: str) -> list[str]:
        return [t for _, t in self.places(text)] if "`" in text else super().tokens(text)

    def places(self, text: str, i: int = 0):
        closed = True
        while m := self.pattern.search(text, i):
            i = m.end()
            if m.group() == "`" and closed:
                found = _template(self.pattern, text, m.start())
                closed = found is not None or self.kinds.classify.jsx  # a lone one may be an element's text
                if found:
                    i = found[0]
            yield m.start(), text[m.start() : i]

    def check(self, text: str, rule: str | None = None) -> tuple[bool, int | None, bool]:
        """As for any language, but that a slash after a parenthesis is a division or begins a regular
        expression: where the first can't be derived the second is tried."""
        got = super().check(text, rule)
        if got[0] or ")" not in text or "/" not in text:
            return got
        text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        s, i, known = self.state.start(self.grammar, rule), 0, 0
        while True:
            for at, t in self.places(text, i):
                new = s[self.kinds[t]]
                if new.dead() and t in ("/", "/=") and at >= known and (m := _SLASHED.match(text, at)):
                    new, t = s["REGEX"], None
                if new.dead():
                    return False, text.count("\n", 0, at + (t == "\n")) + 1, False
                s = new
                if t is None:
                    i = known = m.end()
                    break
            else:
                return (True, None, False) if s.complete() else (False, text.count("\n") + 1, True)


class _Classify:
    """Kinds of tokens; the expressions inside a template are checked by the same language."""

    def __init__(self, jsx: bool):
        self.jsx, self.language = jsx, None

    def __call__(self, t: str):
        if t == "\n":
            return "NL"
        if t.startswith("//") or t.startswith("#!"):
            return "SKIP"
        if t.startswith("/*"):
            return ("NL" if "\n" in t else "SKIP") if len(t) > 3 and t.endswith("*/") else "BAD"
        if t in _RESERVED or t in _CONTEXT or t in _OPS:
            return t
        c = t[0]
        if c in "\"'":
            return "STR" if _FULL["STR"].fullmatch(t) else "JTEXT" if self.jsx else "BAD"
        if c == "`" and (found := _template(self.language.pattern, t, 0)):
            return "TPL" if all(self.language.check(t[s:e], "expr")[0] for s, e in found[1]) else "BAD"
        for kind in ("ID", "NUM", "PRIVATE", "REGEX"):
            if _FULL[kind].fullmatch(t):
                return "BAD" if kind == "NUM" and re.fullmatch(r"0\d+n|\d+_|.*__.*", t) else kind
        return "JTEXT" if self.jsx else "BAD"


def _language(grammar: str, jsx: bool) -> Language:
    classify = _Classify(jsx)
    classify.language = _Language(Grammar(grammar, "program"), FreeState, _pattern(jsx), classify)
    return classify.language


def javascript() -> Language:
    return _language(COMMON + SCRIPT, False)


def typescript() -> Language:
    return _language(COMMON + TYPED + PLAIN_TS, False)


def tsx() -> Language:
    return _language(COMMON + TYPED + JSX, True)
