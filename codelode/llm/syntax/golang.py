"""Go 1.22."""

from __future__ import annotations

import re

from codelode.llm.syntax.derivatives import Grammar, Language, LineState

GRAMMAR = r"""
file: 'package' ID ';' (importdecl ';')* (topdecl ';')*

importdecl: 'import' (importspec | '(' (importspec (';' importspec)* ';'?)? ')')

importspec: (ID | '.')? STR

topdecl: decl | 'func' receiver? ID typeparams? signature block?

receiver: params

decl: 'const' (constspec | '(' (constspec (';' constspec)* ';'?)? ')') | 'var' (varspec | '(' (varspec (';' varspec)* ';'?)? ')') | 'type' (typespec | '(' (typespec (';' typespec)* ';'?)? ')')

constspec: idents (type? '=' exprs)?

varspec: idents (type ('=' exprs)? | '=' exprs)

typespec: ID typeparams? '='? type

typeparams: '[' typeparam (',' typeparam)* ','? ']'

typeparam: idents constraint

constraint: '~'? type ('|' '~'? type)*

idents: ID (',' ID)*

signature: params (params | ~'(' type)?

params: '(' (param (',' param)* ','?)? ')'

param: ID? '...'? type | ID

type: typename | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature | struct | interface | '(' type ')'

typename: ID ('.' ID)? ('[' type (',' type)* ','? ']')?

struct: 'struct' '{' (field (';' field)* ';'?)? '}'

field: (idents type | '*'? typename) STR?

interface: 'interface' '{' (interfaceitem (';' interfaceitem)* ';'?)? '}'

interfaceitem: ID signature | constraint

block: '{' stmts '}'

stmts: stmt? (';' stmt?)*

stmt: decl | simple | 'go' callexpr | 'defer' callexpr | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | switch | select | for | ID ':' stmt?

simple: effect | exprs assignop exprs | exprs ('++' | '--') | expr '<-' expr | idents ':=' exprs

effect: '<-' unary | callexpr

callexpr: operand primarytail* callargs | '(' expr ')' primarytail* callargs | '(' (callexpr | '<-' unary) ')'

assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='

if: 'if' (simple? ';')? expr block ('else' (if | block))?

switch: 'switch' ((simple? ';')? (expr | simple)?) '{' (case ':' stmts)* '}' | 'switch' (simple? ';')? (ID ':=')? operand primarytail* '.' '(' 'type' ')' '{' (typecase ':' stmts)* '}'

case: 'case' exprs | 'default'

typecase: 'case' type (',' type)* | 'default'

select: 'select' '{' (('case' simple | 'default') ':' stmts)* '}'

for: 'for' (simple? ';' expr? ';' simple? | expr | (exprs '=' | idents ':=')? 'range' expr)? block

exprs: expr (',' expr)*

expr: unary (binop unary)*

binop: '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'

unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* primary

primary: operand primarytail*

operand: NUM | STR | ID | '(' expr ')' | '(' type ')' | 'func' signature block | littype litvalue | conversion callargs | 'interface' '{' '}'

littype: struct | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | typename

conversion: '[' ']' type | 'map' '[' type ']' type | 'chan' type | '[' expr ']' type | interface | 'func' signature

litvalue: '{' (element (',' element)* ','?)? '}'

element: (expr | litvalue) (':' (expr | litvalue))?

primarytail: '.' (ID | '(' type ')') | '[' (expr | type (',' type)* ','?) ']' | '[' expr? ':' expr? (':' expr)? ']' | callargs

callargs: '(' (callarg (',' callarg)* '...'? ','?)? ')'

callarg: expr | type
"""

_RESERVED = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_OPS = "... <<= >>= &^= := <- ++ -- == != <= >= && || += -= *= /= %= &= |= ^= << >> &^ { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ : = .".split()
_STRING = r"(?:\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`)"
_RUNE = r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))'"
_NUMBER = r"(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)"
_IDENT = r"[^\W\d]\w*"
PATTERN = re.compile(r"\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|" + _STRING + "|" + _RUNE + "|" + _IDENT + "|" + _NUMBER + "|" + "|".join(map(re.escape, _OPS)) + r"|[^\s]")
_FULL = {k: re.compile(v) for k, v in {"STR": _STRING, "NUM": _NUMBER + "|" + _RUNE, "ID": _IDENT}.items()}


def classify(t: str):
    if t == "\n":
        return "NL"
    if t.startswith("//"):
        return "SKIP"
    if t.startswith("/*"):
        return ("NL" if "\n" in t else "SKIP") if len(t) > 3 and t.endswith("*/") else "BAD"
    if t in _RESERVED or t in _OPS:
        return t
    return next((kind for kind, p in _FULL.items() if p.fullmatch(t)), "BAD")


def language() -> Language:
    return Language(Grammar(GRAMMAR, "file"), LineState, PATTERN, classify)
