"""Python 3 (3.8 to 3.13)."""

from __future__ import annotations

import keyword
import re
import unicodedata

from codelode.llm.syntax.derivatives import Grammar, IndentState, Language

GRAMMAR = r"""
hole: '(' starlist ')' NEWLINE

file: (stmt | NEWLINE)*

stmt: simple | compound

simple: small (';' small)* ';'? NEWLINE

small: exprstmt | 'pass' | 'break' | 'continue' | 'return' starlist? | 'raise' (test ('from' test)?)? | 'global' name (',' name)* | 'nonlocal' name (',' name)* | 'del' deltarget (',' deltarget)* ','? | 'assert' test (',' test)? | importname | importfrom | 'type' name typeparams? '=' test

exprstmt: starlist | (targets '=')+ rhs | single augassign rhs | (single | '(' single ')') ':' test ('=' rhs)?

rhs: starlist | yieldexpr

augassign: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='

importname: 'import' dotted ('as' name)? (',' dotted ('as' name)?)*

importfrom: 'from' ('.' | '...')* dotted 'import' importwhat | 'from' ('.' | '...')+ 'import' importwhat

importwhat: '*' | '(' importas (',' importas)* ','? ')' | importas (',' importas)*

importas: name ('as' name)?

dotted: name ('.' name)*

compound: ifstmt | whilestmt | forstmt | trystmt | withstmt | def | classdef | decorated | 'async' (def | forstmt | withstmt) | match

block: simple | NEWLINE INDENT stmt+ DEDENT

ifstmt: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?

whilestmt: 'while' named ':' block ('else' ':' block)?

forstmt: 'for' targets 'in' starlist ':' block ('else' ':' block)?

trystmt: 'try' ':' block (except+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)

except: 'except' ('*'? test (',' test)* ('as' name)?)? ':' block

withstmt: 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block

withitem: test ('as' target)?

decorated: ('@' named NEWLINE)+ (def | classdef | 'async' def)

def: 'def' name typeparams? '(' params? ')' ('->' test)? ':' block

typeparams: '[' typeparam (',' typeparam)* ','? ']'

typeparam: ('*' | '**')? name (':' test)? ('=' test)?

params: before ','?

before: plain (',' (before | '/' (',' after)?))? | default (',' defaults)? | star

defaults: default (',' defaults)? | star | '/' (',' (default (',' keyworddefaults)? | star))?

after: plain (',' after)? | default (',' keyworddefaults)? | star

keyworddefaults: default (',' keyworddefaults)? | star

star: '*' name (':' (test | '*' atomexpr))? (',' keywords)? | '*' ',' (plain | default) (',' keywords)? | '**' plain

keywords: (plain | default) (',' keywords)? | '**' plain

plain: name (':' test)?

default: name (':' test)? '=' test

classdef: 'class' name typeparams? ('(' args? ')')? ':' block

match: 'match' starlist ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT

patterns: pattern (',' pattern)* ','?

pattern: orpattern ('as' name)? | '*' name

orpattern: closed ('|' closed)*

closed: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (patarg (',' patarg)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (patkv (',' patkv)* ','?)? '}'

patarg: (name '=')? pattern

patkv: ('-'? NUM | STR+ | 'None' | 'True' | 'False' | dotted) ':' pattern | '**' name

targets: target (',' target)* ','?

one: single | '(' targets? ')' | '[' targets? ']'

single: name | atom trailer* ('.' name | '[' subs ']')

deltarget: single | '(' (deltarget (',' deltarget)* ','?)? ')' | '[' (deltarget (',' deltarget)* ','?)? ']'

target: '*'? one

starlist: plainitem (',' plainitem)* ','? | yieldexpr

plainitem: '*' bitor | test

staritem: '*' bitor | named

yieldexpr: 'yield' ('from' test | starlist)?

named: test | name ':=' test

test: lambda | ortest ('if' ortest 'else' test)?

lambda: 'lambda' (lbefore ','?)? ':' test

lbefore: name (',' (lbefore | '/' (',' lafter)?))? | ldefault (',' ldefaults)? | lstar

ldefaults: ldefault (',' ldefaults)? | lstar | '/' (',' (ldefault (',' lrest)? | lstar))?

lafter: name (',' lafter)? | ldefault (',' lrest)? | lstar

lrest: ldefault (',' lrest)? | lstar

lstar: '*' name (',' lkeywords)? | '*' ',' (name | ldefault) (',' lkeywords)? | '**' name

lkeywords: (name | ldefault) (',' lkeywords)? | '**' name

ldefault: name '=' test

ortest: notcmp (('or' | 'and') notcmp)*

notcmp: 'not'* bitor (compop bitor)*

compop: '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?

bitor: unary (binop unary)*

binop: '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'

unary: ('+' | '-' | '~')* 'await'? atomexpr

atomexpr: atom trailer*

trailer: '(' args? ')' | '[' subs ']' | '.' name

subs: sub (',' sub)* ','?

sub: named | '*' bitor | test? ':' test? (':' test?)?

args: named compfor | (positional (',' positional)* (',' keyed)? | keyed) ','?

positional: named | '*' test

keyed: (name '=' test | '*' test) (',' keyed)? | unpacked

unpacked: '**' test (',' (name '=' test (',' unpackedmore)? | unpacked))?

unpackedmore: name '=' test (',' unpackedmore)? | unpacked

atom: name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (yieldexpr | staritem (compfor | (',' staritem)* ','?))? ')' | '[' (staritem (compfor | (',' staritem)* ','?))? ']' | '{' (dictitem (compfor | (',' dictitem)* ','?) | staritem (compfor | (',' staritem)* ','?))? '}'

dictitem: test ':' test | '**' bitor

compfor: 'async'? 'for' targets 'in' ortest (compfor | compif)?

compif: 'if' ortest (compfor | compif)?

name: ID | 'match' | 'case' | 'type'
"""

_SOFT = {"match", "case", "type"}
_OPS = "... **= //= >>= <<= -> := += -= *= /= %= @= &= |= ^= == != <= >= << >> ** // + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()
_FSTART = r"(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|\"|')"
_STRING = r"(?:[rRuUbB]{1,2})?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!\'\'))*'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!\'\')(?:[^'\\\n]|\\[\s\S])*')"
_NUMBER = r"(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
PATTERN = re.compile(r"\n[ \t\f]*|#[^\n]*|\\\n|" + _FSTART + "|" + _STRING + r"|[^\W\d](?:\w|[^\x00-\x7f\s])*|" + _NUMBER + "|" + "|".join(map(re.escape, _OPS)) + r"|[^\s]")
_FULL_NUMBER, _FULL_STRING = re.compile(_NUMBER), re.compile("(?:" + _STRING + ")")


_OPEN, _FTEXT = re.compile(_FSTART), re.compile(r"[^\\{}\n\"']+")
_CONVERSION = re.compile(r"\s*[rsa]\s*(?=[:}])")
_MOST_NESTED = 150  # as in CPython


def fstring(text: str, at: int, holes: list[tuple[int, int]] | None = None, level: int = 0) -> int | None:
    """The end of the f-string that begins at ``at``, or None if its quotes or braces don't close; the
    places of its expressions, those in format specifications too, are added to ``holes``."""
    m = _OPEN.match(text, at)
    if not m or level >= _MOST_NESTED:
        return None
    quote = m.group().lstrip("fFtTrR")
    raw, i, spec = "r" in m.group().lower(), m.end(), 0
    while i < len(text):
        c = text[i]
        if text.startswith(quote, i):
            return None if spec else i + len(quote)
        if c == "\n" and (len(quote) == 1 or spec):
            return None
        if c == "\\":
            if not raw and text.startswith("N{", i + 1):
                i = text.find("}", i) + 1
                if not i:
                    return None
            else:
                i += 1 if text[i + 1 : i + 2] in ("{", "}") else 2
        elif c == "}":
            if spec:
                spec -= 1
                i += 1
            elif text.startswith("}}", i):
                i += 2
            else:
                return None
        elif c == "{" and not spec and text.startswith("{{", i):
            i += 2
        elif c == "{":
            first, end, depth, last = i + 1, None, 0, ""
            while m := PATTERN.search(text, i + 1 if i < first else i):
                t, i = m.group(), m.end()
                if _OPEN.fullmatch(t):
                    i = fstring(text, m.start(), None, level + 1)
                    if i is None:
                        return None
                elif t in ("(", "[", "{"):
                    depth += 1
                elif depth and t in (")", "]", "}"):
                    depth -= 1
                elif not depth and t in ("!", ":", ":=", "}"):
                    end = m.start()
                    break
                if t[0] not in "#\n":
                    last, last_at = t, m.start()
            if end is None:
                return None
            if t == "!":
                conversion = _CONVERSION.match(text, i)
                if not conversion:
                    return None
                i = conversion.end() + 1
                t = text[i - 1]
            elif t == ":=":
                i -= 1
            if holes is not None:
                holes.append((first, last_at if last == "=" else end))
            spec += t != "}"
        else:
            m = _FTEXT.match(text, i)
            i = m.end() if m else i + 1
    return None


class _Language(Language):
    """F-strings are one token each."""

    def tokens(self, text: str) -> list[str]:
        return [t for _, t in self.places(text)] if _OPEN.search(text) else super().tokens(text)

    def places(self, text: str):
        i = 0
        while m := self.pattern.search(text, i):
            i = m.end()
            if _OPEN.fullmatch(m.group()):
                i = fstring(text, m.start()) or i
            yield m.start(), text[m.start() : i]


class _Classify:
    """Kinds of tokens; the expressions inside an f-string are checked by the same language."""

    language: Language

    def __call__(self, t: str):
        if _OPEN.match(t):
            holes: list[tuple[int, int]] = []
            return "STR" if fstring(t, 0, holes) == len(t) and all(self.language.check("(" + t[s:e] + "\n)", "hole")[0] for s, e in holes) else "BAD"
        return classify(t)


_ESCAPE = re.compile(r"\\(?:x([\da-fA-F]{2})?|u([\da-fA-F]{4})?|U([\da-fA-F]{8})?|N(?:\{([^}]*)\})?|[\s\S])")


def escapes(t: str) -> bool:
    """Are a literal's escapes, and a bytes literal's characters, allowed?"""
    lead = re.match("[A-Za-z]*", t).group().lower()
    if "b" in lead and not t.isascii():
        return False
    if "r" in lead or "\\" not in t:
        return True
    for m in _ESCAPE.finditer(t):
        c = t[m.start() + 1]
        if c == "x" and not m.group(1) or "b" not in lead and (c == "u" and not m.group(2) or c == "U" and (not m.group(3) or int(m.group(3), 16) > 0x10FFFF)):
            return False
        if c == "N" and "b" not in lead:
            try:
                unicodedata.lookup(m.group(4) or "")
            except KeyError:
                return False
    return True


def classify(t: str):
    c = t[0]
    if c == "\n":
        width = 0
        for x in t[1:]:
            width = (width // 8 + 1) * 8 if x == "\t" else 0 if x == "\f" else width + 1
        return width
    if c == "#" or t == "\\\n":
        return "SKIP"
    if t in _OPS or t in _SOFT:
        return t
    if t.isidentifier():
        return t if keyword.iskeyword(t) else "ID"
    if _FULL_NUMBER.fullmatch(t):
        return "BAD" if re.fullmatch(r"0\d+", t.replace("_", "")) and t.strip("0_") else "NUM"
    return "STR" if _FULL_STRING.fullmatch(t) and escapes(t) else "BAD"


def language() -> Language:
    kinds = _Classify()
    kinds.language = _Language(Grammar(GRAMMAR, "file"), IndentState, PATTERN, kinds)
    return kinds.language
