"""Java 17."""

from __future__ import annotations

import re

from codelode.llm.syntax.derivatives import FreeState, Grammar, Language

GRAMMAR = r"""
file: (annotation* 'package' qname ';')? (import | ';')* typedecl* | annotation* 'open'? 'module' qname '{' directive* '}' | (import | ';')+ annotation* 'open'? 'module' qname '{' directive* '}'

directive: ('requires' ('static' | 'transitive')* qname | ('exports' | 'opens') qname ('to' qname (',' qname)*)? | 'uses' qname | 'provides' qname 'with' qname (',' qname)*) ';'

import: 'import' 'static'? qname ('.' '*')? ';'

qname: ident ('.' ident)*

typedecl: modifier* anytype | ';'

anytype: class | interface | enum | record | annotationtype

modifier: annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'

annotation: '@' qname ('(' (elementvalue | ident '=' elementvalue (',' ident '=' elementvalue)*)? ')')?

elementvalue: cond | annotation | '{' (elementvalue (',' elementvalue)*)? ','? '}'

class: 'class' ident typeparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody

interface: 'interface' ident typeparams? ('extends' types)? ('permits' types)? classbody

enum: 'enum' ident ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'

constant: annotation* ident args? classbody?

record: 'record' ident typeparams? '(' params? ')' ('implements' types)? classbody

annotationtype: '@' 'interface' ident classbody

classbody: '{' member* '}'

member: ';' | 'static'? block | modifier* (anytype | typeparams? annotation* (ident '(' params? ')' throws? block | (type | 'void') ident '(' params? ')' dims? throws? (block | ('default' elementvalue)? ';')) | ident block | type declarator (',' declarator)* ';')

throws: 'throws' types

params: param (',' param)*

param: modifier* type annotation* '...'? (ident dims? | (ident '.')* 'this')

declarator: ident dims? ('=' (expr | arrayinit))?

arrayinit: '{' ((expr | arrayinit) (',' (expr | arrayinit))*)? ','? '}'

types: type (',' type)*

type: annotation* (primitive | ident typeargs? ('.' annotation* ident typeargs?)*) dims?

dims: (annotation* '[' ']')+

primitive: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'

typeparams: '<' typeparam (',' typeparam)* '>'

typeparam: annotation* ident ('extends' type ('&' type)*)?

typeargs: '<' (typearg (',' typearg)*)? '>'

typearg: type | annotation* '?' (('extends' | 'super') type)?

block: '{' blockstmt* '}'

blockstmt: stmt | modifier* (class | interface | enum | record) | ('final' | annotation)* type declarator (',' declarator)* ';'

stmt: block | ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | for | try | switch | 'synchronized' '(' expr ')' block | 'return' expr? ';' | 'throw' expr ';' | 'break' ident? ';' | 'continue' ident? ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | ident ':' stmt | effect ';'

for: 'for' '(' ((('final' | annotation)* type declarator (',' declarator)* | effect (',' effect)*)? ';' expr? ';' (effect (',' effect)*)? | ('final' | annotation)* type ident dims? ':' expr) ')' stmt

try: 'try' block (catch+ finally? | finally) | 'try' '(' resource (';' resource)* ';'? ')' block catch* finally?

catch: 'catch' '(' ('final' | annotation)* type ('|' type)* ident ')' block

finally: 'finally' block

resource: ('final' | annotation)* type ident '=' expr | lhs

switch: 'switch' '(' expr ')' '{' (switchlabel ':' blockstmt*)* '}' | 'switch' '(' expr ')' '{' (switchlabel '->' (expr ';' | block | 'throw' expr ';'))* '}'

switchlabel: 'case' caseitem (',' caseitem)* | 'default'

caseitem: cond | 'default' | pattern ('&&' binary)?

pattern: 'final'? type (ident | '(' (pattern (',' pattern)*)? ')' ident?)

effect: ('++' | '--') unary | primary suffix* (call | '++' | '--' | assignop expr) | 'new' creator | primary assignop expr | primary ('++' | '--') | ('this' | 'super') args

expr: lambda | cond (assignop expr)?

assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='

lambda: (ident | '(' (params | ident (',' ident)*)? ')') '->' (block | expr)

cond: binary ('?' (cond | lambda) ':' (cond | lambda))?

binary: unary (binop unary | 'instanceof' (pattern | 'final'? type))*

binop: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'

unary: ('+' | '-' | '++' | '--' | '!' | '~') unary | '(' type ('&' type)* ')' (unary | lambda) | lhs ('++' | '--')*

lhs: primary suffix*

suffix: call | '.' typeargs? ident | '.' 'this' | '.' 'super' | '.' 'class' | '.' 'new' creator | '[' expr ']' | '::' typeargs? (ident | 'new')

call: args

args: '(' (expr (',' expr)*)? ')'

primary: NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'super' | ident | '(' expr ')' | 'new' creator | switch | (primitive | 'void') dims? '.' 'class' | primitive dims '::' 'new' | ident typeargs ('.' ident typeargs?)* dims? '::' (ident | 'new') | ident ('.' ident)* dims ('.' 'class' | '::' 'new')

creator: annotation* typeargs? newtype (args classbody? | (annotation* '[' expr ']')+ dims? | dims arrayinit)

newtype: primitive | ident typeargs? ('.' ident typeargs?)*

ident: ID | 'record' | 'sealed' | 'permits' | 'yield' | 'module' | 'open' | 'opens' | 'exports' | 'requires' | 'uses' | 'provides' | 'to' | 'with' | 'transitive' | 'non'
"""

_RESERVED = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
_CONTEXT = set("record sealed permits yield module open opens exports requires uses provides to with transitive non".split())
_OPS = "... -> :: <<= == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @".split()
_STRING = r"(?:\"\"\"[ \t\f]*\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\[^\n])*\")"
_CHAR = r"'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\[btnfrs\"'\\])'"
_NUMBER = r"(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"
_IDENT = r"[^\W\d][\w$]*|\$[\w$]*"
PATTERN = re.compile(r"\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|" + _STRING + "|" + _CHAR + "|" + _IDENT + "|" + _NUMBER + "|" + "|".join(map(re.escape, _OPS)) + r"|\x1a$|[^\s]")
_FULL = {k: re.compile(v) for k, v in {"STR": _STRING, "CHR": _CHAR, "ID": _IDENT, "NUM": _NUMBER}.items()}


def classify(t: str):
    if t == "\n" or t == "\x1a" or t.startswith("//"):
        return "SKIP"
    if t.startswith("/*"):
        return "SKIP" if len(t) > 3 and t.endswith("*/") else "BAD"
    if t in _RESERVED or t in _CONTEXT or t in _OPS:
        return t
    return next((kind for kind, p in _FULL.items() if p.fullmatch(t)), "BAD") if t != "_" else "BAD"


def language() -> Language:
    return Language(Grammar(GRAMMAR, "file"), FreeState, PATTERN, classify)
