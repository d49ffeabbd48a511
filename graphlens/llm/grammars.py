"""Grammars of the supported languages, for ``gll.Grammar``."""

from __future__ import annotations

from functools import cache

from graphlens.llm.gll import Grammar

PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
PYTHON_SOFT = "match case type _".split()

PYTHON = """
file: stmt* ;
file_match: stmt_m* ;
stmt: compound | simple_line ;
stmt_m: compound | match | simple_line ;
simple_line: simple (';' simple)* ';'? NEWLINE ;
simple: (star_targets '=')+ value | single_target (AUG value | ':' test ('=' value)?) | star_list | yield
  | 'return' star_list? | 'raise' (test ('from' test)?)? | 'pass' | 'break' | 'continue'
  | 'del' del_targets | 'assert' test (',' test)? | 'global' id (',' id)* | 'nonlocal' id (',' id)*
  | 'import' dotted_as (',' dotted_as)* | from_import | 'type' id type_params? '=' test ;
value: yield | star_list ;
yield: 'yield' ('from' test | star_list)? ;
star_targets: star_target (',' star_target)* ','? ;
star_target: '*'? target ;
target: id | member | '(' star_targets? ')' | '[' star_targets? ']' ;
single_target: id | member | '(' single_target ')' ;
del_targets: del_target (',' del_target)* ','? ;
del_target: id | member | '(' del_targets? ')' | '[' del_targets? ']' ;
member: atom trailer* ('.' id | '[' subscripts ']') ;
dotted: id ('.' id)* ;
dotted_as: dotted ('as' id)? ;
from_import: 'from' (('.' | '...')+ dotted? | dotted) 'import' ('*' | '(' as_name (',' as_name)* ','? ')' | as_name (',' as_name)*) ;
as_name: id ('as' id)? ;
id: NAME | 'match' | 'case' | 'type' | '_' ;
compound: if | 'while' named ':' block else? | for | try | with | def | class | decorated | 'async' (def | for | with) ;
if: 'if' named ':' block ('elif' named ':' block)* else? ;
else: 'else' ':' block ;
for: 'for' star_targets 'in' star_list ':' block else? ;
try: 'try' ':' block ((except+ | except_group+) else? ('finally' ':' block)? | 'finally' ':' block) ;
except: 'except' (test ('as' id)?)? ':' block ;
except_group: 'except' '*' test ('as' id)? ':' block ;
with: 'with' (item (',' item)* | '(' item (',' item)* ','? ')') ':' block ;
item: test ('as' star_target)? ;
def: 'def' id type_params? '(' (params ','?)? ')' ('->' test)? ':' block ;
class: 'class' id type_params? ('(' args? ')')? ':' block ;
decorated: ('@' named NEWLINE)+ ('async'? def | class) ;
type_params: '[' type_param (',' type_param)* ','? ']' ;
type_param: id (':' test)? ('=' test)? | '*' id ('=' star_item)? | '**' id ('=' test)? ;
params: plain (',' star_params)? | star_params ;
plain: param (',' param)* (',' '/' (',' param)*)? (',' default)* | (param ',')* default (',' default)* (',' '/' (',' default)*)? ;
star_params: '*' id (':' star_item)? (',' any_param)* (',' '**' param)? | '*' (',' any_param)+ (',' '**' param)? | '**' param ;
param: id (':' test)? ;
default: id (':' test)? '=' test ;
any_param: id (':' test)? ('=' test)? ;
lambda_params: lambda_plain (',' lambda_stars)? | lambda_stars ;
lambda_plain: id (',' id)* (',' '/' (',' id)*)? (',' id '=' test)* | (id ',')* id '=' test (',' id '=' test)* (',' '/' (',' id '=' test)*)? ;
lambda_stars: '*' id (',' id ('=' test)?)* (',' '**' id)? | '*' (',' id ('=' test)?)+ (',' '**' id)? | '**' id ;
block: NEWLINE INDENT stmt_m+ DEDENT | simple_line ;
match: 'match' (named | star_named ',' (star_named (',' star_named)* ','?)?) ':' NEWLINE INDENT case+ DEDENT ;
case: 'case' (pattern | open_sequence) ('if' named)? ':' block ;
open_sequence: star_pattern ',' (star_pattern (',' star_pattern)* ','?)? ;
star_pattern: '*' id | pattern ;
pattern: closed ('|' closed)* ('as' id)? ;
literal: strings | '-'? NUMBER (('+' | '-') NUMBER)? | 'None' | 'True' | 'False' ;
closed: literal | id | id ('.' id)+ | dotted '(' (pattern_args ','?)? ')' | '(' (pattern | open_sequence)? ')' | '[' (star_pattern (',' star_pattern)* ','?)? ']'
  | '{' (pattern_item (',' pattern_item)* (',' '**' id)? ','? | '**' id ','?)? '}' ;
pattern_args: pattern (',' pattern)* (',' id '=' pattern)* | id '=' pattern (',' id '=' pattern)* ;
pattern_item: (literal | id ('.' id)+) ':' pattern ;
star_list: star_item (',' star_item)* ','? ;
star_item: '*' bits | test ;
star_named: '*' bits | named ;
named: test | id ':=' test ;
test: bin ('if' bin 'else' test)? | 'lambda' lambda_params? ','? ':' test ;
bin: 'not'* bits (('not' 'in' | 'in' | 'is' 'not'? | CMP) bits)* (('or' | 'and') 'not'* bits (('not' 'in' | 'in' | 'is' 'not'? | CMP) bits)*)* ;
bits: ('-' | '+' | '~')* 'await'? atom trailer* (('*' | '**' | '@' | '/' | '-' | '+' | '|' | OP) ('-' | '+' | '~')* 'await'? atom trailer*)* ;
trailer: '.' id | '(' (args | named comp+)? ')' | '[' subscripts ']' ;
subscripts: subscript (',' subscript)* ','? ;
subscript: named | '*' bits | test? ':' test? (':' test?)? ;
args: positional (',' positional)* (',' keywords)? ','? | keywords ','? ;
positional: '*' test | named ;
keywords: keyword (',' keyword)* (',' '**' test (',' late)*)? | '**' test (',' late)* ;
keyword: id '=' test | '*' test ;
late: id '=' test | '**' test ;
comp: 'async'? 'for' star_targets 'in' bin ('if' bin)* ;
atom: id | NUMBER | strings | '...' | 'None' | 'True' | 'False' | '(' (yield | named comp* | star_named ',' (star_named (',' star_named)* ','?)?)? ')'
  | '[' (named comp+ | star_named (',' star_named)* ','?)? ']' | '{' (entry (',' entry)* ','? | test ':' test comp+ | named comp+ | star_named (',' star_named)* ','?)? '}' ;
entry: '**' bits | test ':' test ;
strings: (STRING | FBEGIN field* FEND)+ | BYTES+ ;
field: FOPEN (yield | star_list) FDEBUG? FCONV? (FSPEC field*)? FCLOSE ;
"""

JSON = """
text: value ;
value: STRING | NUMBER | 'true' | 'false' | 'null' | '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']' ;
pair: STRING ':' value ;
"""

CSS = """
sheet: ('<!--' | '-->' | rule)* ;
rule: AT_IMPORT prelude ';' | at_block | style ;
at_block: AT prelude (';' | '{' inner '}') ;
inner: (rule | declaration ';' | ';')* declaration? ;
style: selectors '{' inner '}' ;
selectors: selector (',' selector)* ;
selector: COMBINATOR? compound (COMBINATOR? compound)* ;
compound: simple+ ;
simple: IDENT | '*' | PERCENT | HASH | CLASS | '&' | '|' | ':' ':'? (IDENT | FUNCTION any* ')') | '[' IDENT ('|' IDENT)? (MATCH (IDENT | STRING) IDENT?)? ']' ;
declaration: (IDENT | CUSTOM) ':' term* ('!' IDENT)? ;
term: IDENT | CUSTOM | NUMBER | PERCENT | HASH | STRING | URL | FUNCTION any* ')' | '(' any* ')' | '[' any* ']' | ',' | '/' | '*' | '-' | COMBINATOR | CLASS ;
any: term | ':' | '&' | '|' | '<' | MATCH | AT ;
prelude: prelude_part* ;
prelude_part: term | ':' | '&' | '|' ;
"""

YAML = """
stream: (node '...'*)? (directives? '---' node? '...'*)* ;
directives: DIRECTIVE+ ;
node: ALIAS | props content? | content ;
block_node: ALIAS | props content? | content | props? in_sequence ;
props: TAG ANCHOR? | ANCHOR TAG? ;
content: SCALAR | flow | block ;
block: BLOCK_SEQ ('-' node?)* END | BLOCK_MAP pair* END ;
pair: KEY block_node? (VALUE block_node?)? | VALUE block_node? ;
in_sequence: ('-' node?)+ ;
flow: '[' (flow_item (',' flow_item)* ','?)? ']' | '{' (flow_pair (',' flow_pair)* ','?)? '}' ;
flow_item: flow_node | KEY flow_node? (VALUE flow_node?)? | VALUE flow_node? ;
flow_pair: flow_node | KEY flow_node? (VALUE flow_node?)? | VALUE flow_node? ;
flow_node: ALIAS | props flow_content? | flow_content ;
flow_content: SCALAR | flow ;
"""

TS_RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
TS_SOFT = "abstract accessor any as asserts assert async await bigint boolean constructor declare from get global implements infer interface is keyof let module namespace never number object of out override package private protected public readonly require satisfies set static string symbol type undefined unique unknown using yield".split()

_ID = " | ".join(f"'{w}'" for w in TS_SOFT)
_WORD = " | ".join(f"'{w}'" for w in TS_RESERVED)

TYPESCRIPT = f"""
module: statement* ;
id: NAME | {_ID} ;
word: id | {_WORD} ;
end: ';' | &NL ;
statement: block | ';' | var end | import | export | if | for | 'while' '(' list ')' statement | 'do' statement 'while' '(' list ')' end
  | switch | try | 'throw' list end | 'return' list? end | ('break' | 'continue') id? end | 'debugger' end | id ':' statement
  | decl | list end ;
decl: function | class | interface | type_alias | enum | 'declare' ambient | namespace ;
ambient: var end | function | class | interface | type_alias | enum | namespace | 'global' block ;
namespace: ('namespace' | 'module') (id ('.' id)* | STRING) (block | end) ;
block: '{{' statement* '}}' ;
var: ('var' | 'let' | 'const' | 'using' | 'await' 'using') binding (',' binding)* ;
binding: pattern '!'? (':' type)? ('=' assign)? ;
pattern: id | '[' (pattern_item? (',' pattern_item?)*) ']' | '{{' (pattern_prop (',' pattern_prop)* ','?)? '}}' ;
pattern_item: '...'? pattern ('=' assign)? ;
pattern_prop: '...' id | id ('=' assign)? | prop_name ':' pattern ('=' assign)? ;
if: 'if' '(' list ')' statement ('else' statement)? ;
for: 'for' 'await'? '(' (for_head | var ';' list? ';' list? | list? ';' list? ';' list?) ')' statement ;
for_head: ('var' | 'let' | 'const') pattern ('of' assign | 'in' list) | lhs ('of' assign | 'in' list) ;
switch: 'switch' '(' list ')' '{{' (('case' list | 'default') ':' statement*)* '}}' ;
try: 'try' block ('catch' ('(' pattern (':' type)? ')')? block ('finally' block)? | 'finally' block) ;
import: 'import' ('type'? clause 'from')? STRING attributes? end | 'import' 'type'? id '=' (('require' '(' STRING ')') | lhs) end ;
attributes: ('with' | 'assert') object ;
clause: id | (id ',')? ('*' 'as' id | '{{' (specifier (',' specifier)* ','?)? '}}') ;
specifier: 'type'? (word | STRING) ('as' (word | STRING))? ;
export: 'export' (decl | var end | 'default' (function | class | interface | assign end) | 'type'? '*' ('as' (word | STRING))? 'from' STRING attributes? end
  | 'type'? '{{' (specifier (',' specifier)* ','?)? '}}' ('from' STRING attributes?)? end | '=' list end | 'as' 'namespace' id end | 'import' id '=' lhs end) | decorator+ 'export' 'default'? class ;
function: 'async'? 'function' '*'? id? signature (block | end) ;
signature: type_params? '(' params? ')' (':' return_type)? ;
params: param (',' param)* ','? ;
param: decorator* modifier* '...'? (pattern | 'this') '?'? (':' type)? ('=' assign)? ;
type_params: '<' type_param (',' type_param)* ','? '>' ;
type_param: ('const' | 'in' | 'out')* id ('extends' type)? ('=' type)? ;
modifier: 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'async' | 'accessor' ;
decorator: '@' ('(' list ')' | id ('.' word)* type_args? call_args*) ;
class: decorator* 'abstract'? 'class' id? type_params? ('extends' lhs type_args?)? ('implements' type (',' type)*)? '{{' member* '}}' ;
member: ';' | 'static' block | decorator* modifier* (('get' | 'set') prop_name signature (block | end) | '*'? prop_name ('?' | '!')? (signature (block | end) | (':' type)? ('=' assign)? end) | index end) ;
index: '[' id ':' type ']' (':' type)? ;
prop_name: word | STRING | NUMBER | PRIVATE | '[' assign ']' ;
interface: 'interface' id type_params? ('extends' type (',' type)*)? object_type ;
object_type: '{{' (type_member (type_member_end type_member)* type_member_end?)? '}}' ;
type_member_end: ',' | ';' | &NL ;
type_member: ('readonly' | '+' 'readonly' | '-' 'readonly')? (index_or_mapped | prop_name '?'? (signature | (':' type)?)) | 'new'? signature | ('get' | 'set') prop_name signature ;
index_or_mapped: '[' id (':' type | 'in' type ('as' type)?) ']' ('?' | '-' '?' | '+' '?')? (':' type)? ;
type_alias: 'type' id type_params? '=' type end ;
enum: 'const'? 'enum' id '{{' (enum_member (',' enum_member)* ','?)? '}}' ;
enum_member: prop_name ('=' assign)? ;
type: union ('extends' union '?' type ':' type)? | function_type ;
return_type: type | 'asserts' (id | 'this') ('is' type)? | (id | 'this') 'is' type ;
function_type: 'abstract'? 'new'? type_params? '(' params? ')' '=>' return_type ;
union: '|'? intersection ('|' intersection)* ;
intersection: '&'? postfix_type ('&' postfix_type)* ;
postfix_type: ('keyof' | 'unique' | 'readonly')* simple_type ('[' type? ']')* | function_type ;
simple_type: 'infer' id ('extends' union)? | id ('.' word)* type_args? | STRING | '-'? NUMBER | 'true' | 'false' | 'null' | 'void' | 'this' | object_type | tuple | '(' type ')'
  | 'typeof' (id | 'this' | 'import' '(' type ')') ('.' (word | PRIVATE))* type_args? | 'import' '(' type (',' object)? ')' ('.' word)* type_args? | template_type ;
template_type: TEMPLATE | TPL_HEAD type (TPL_MID type)* TPL_TAIL ;
tuple: '[' (tuple_item (',' tuple_item)* ','?)? ']' ;
tuple_item: '...'? (id '?'? ':')? type '?'? ;
type_args: '<' type (',' type)* '>' ;
list: assign (',' assign)* ;
assign: conditional (assign_op assign)? | arrow | 'yield' ('*'? assign)? ;
assign_op: '=' | ASSIGN | '>' '>' '=' | '>' '>' '>' '=' ;
arrow: 'async'? (id | type_params? '(' params? ')' (':' return_type)?) '=>' (block | assign) ;
conditional: binary ('?' assign ':' assign)? ;
binary: unary (binary_op unary | ('as' | 'satisfies') ('const' | type))* ;
binary_op: BINARY | '+' | '-' | '*' | '/' | '<' | '>' | '>' '=' | '>' '>' | '>' '>' '>' | '&' | '|' | 'in' | 'instanceof' ;
unary: (UNARY | '!' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | INC | '<' type '>')* lhs INC? ;
lhs: 'new'* primary suffix* ;
suffix: '.' (word | PRIVATE) | '?.' (word | PRIVATE | '[' list ']' | type_args? call_args | template) | '[' list ']' | type_args? call_args | type_args | template | '!' ;
call_args: '(' (arg (',' arg)* ','?)? ')' ;
arg: '...'? assign ;
primary: id | 'this' | 'super' | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | PRIVATE | template | array | object | 'async'? 'function' '*'? id? signature block | class
  | '(' list ')' | 'import' (call_args | '.' word) | '.' 'target' ;
template: TEMPLATE | TPL_HEAD list (TPL_MID list)* TPL_TAIL ;
array: '[' (element? (',' element?)*) ']' ;
element: '...'? assign ;
object: '{{' (property (',' property)* ','?)? '}}' ;
property: '...' assign | id ('=' assign)? | prop_name ':' assign | 'async'? '*'? prop_name signature block | ('get' | 'set') prop_name signature block ;
"""

CS_WORDS = "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
CS_SOFT = "add alias and ascending async await by descending dynamic equals file from get global group init into join let managed nameof not notnull on or orderby partial record remove required scoped select set unmanaged value var when where with yield".split()
_CID = " | ".join(f"'{w}'" for w in CS_SOFT)

CSHARP = f"""
unit: extern* using* attribute* (type_decl | namespace)* ;
unit_file_scoped: extern* using* attribute* 'namespace' name ';' using* (type_decl | namespace)* ;
unit_script: extern* using* attribute* statement+ (type_decl | namespace)* ;
id: NAME | {_CID} ;
extern: 'extern' 'alias' id ';' ;
using: 'global'? 'using' ('static' | 'unsafe')? (id '=')? type ';' ;
namespace: 'namespace' name '{{' extern* using* (type_decl | namespace)* '}}' ';'? ;
name: id ('.' id)* ;
attribute: '[' (attr_target ':')? attr (',' attr)* ','? ']' ;
attr_target: id | 'return' | 'event' ;
attr: type_name call_args? ;
modifier: 'public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'async' | 'partial' | 'required' | 'file' | 'const' | 'ref' ;
type_decl: attribute* modifier* (class_decl | enum_decl | delegate_decl) ;
class_decl: ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) id type_params? ('(' params? ')')? (':' base (',' base)*)? constraint* ('{{' member* '}}' ';'? | ';') ;
base: type call_args? ;
enum_decl: 'enum' id (':' type)? '{{' (enum_member (',' enum_member)* ','?)? '}}' ';'? ;
enum_member: attribute* id ('=' expr)? ;
delegate_decl: 'delegate' type id type_params? '(' params? ')' constraint* ';' ;
type_params: '<' attribute* ('in' | 'out')? id (',' attribute* ('in' | 'out')? id)* '>' ;
constraint: 'where' id ':' bound (',' bound)* ;
bound: type | 'class' '?'? | 'struct' | 'new' '(' ')' | 'default' ;
member: attribute* modifier* (class_decl | enum_decl | delegate_decl | method | field | property | 'event' type (declarators ';' | member_name '{{' accessor* '}}')
  | '~'? id '(' params? ')' (':' ('base' | 'this') call_args)? body | type 'this' '[' params ']' property_body | (type explicit_name? 'operator' operator | ('implicit' | 'explicit') 'operator' type) '(' params ')' body) ;
explicit_name: type_name '.' ;
operator: 'true' | 'false' | '+' | '-' | '!' | '~' | INC | '*' | '/' | '&' | '|' | BINARY | '<' | '>' | '>' '>' | '>' '=' | 'checked' operator ;
method: type member_name type_params? '(' params? ')' constraint* body ;
field: type declarators ';' ;
declarators: declarator (',' declarator)* ;
declarator: id ('[' expr ']')? ('=' init)? ;
init: expr | array_init ;
array_init: '{{' (init (',' init)* ','?)? '}}' ;
property: type member_name property_body ;
property_body: '{{' accessor+ '}}' ('=' init ';')? | '=>' expr ';' ;
member_name: name_part ('.' name_part)* ;
name_part: id type_args? ;
accessor: attribute* modifier* ('get' | 'set' | 'init' | 'add' | 'remove') body ;
body: block | '=>' expr ';' | ';' ;
params: param (',' param)* ;
param: attribute* ('ref' | 'out' | 'in' | 'params' | 'this' | 'scoped' | 'readonly')* type id ('=' expr)? ;
type: ('ref' 'readonly'?)? base_type ('?' | '*' | '[' ','* ']')* ;
base_type: type_name | BUILTIN | '(' tuple_item (',' tuple_item)+ ')' ;
tuple_item: type id? ;
type_name: (id '::')? name_part ('.' name_part)* ;
type_args: '<' ','* '>' | '<' type (',' type)* '>' ;
block: '{{' statement* '}}' ;
statement: block | ';' | id ':' statement | declaration ';' | local_function | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' (declaration | exprs)? ';' expr? ';' exprs? ')' statement | 'await'? 'foreach' '(' (type id | deconstruct | 'var' deconstruct) 'in' expr ')' statement | switch | try
  | 'return' expr? ';' | 'throw' expr? ';' | 'break' ';' | 'continue' ';' | 'goto' (id | 'case' expr | 'default') ';' | 'yield' ('return' expr | 'break') ';'
  | 'lock' '(' expr ')' statement | 'await'? 'using' ('(' (declaration | expr) ')' statement | declaration ';') | ('checked' | 'unchecked' | 'unsafe') block | 'fixed' '(' declaration ')' statement | expr ';' ;
deconstruct: '(' deconstruct_item (',' deconstruct_item)+ ')' ;
deconstruct_item: type? id | deconstruct ;
declaration: ('const' | 'static' | 'ref' | 'scoped')* type declarators ;
local_function: attribute* ('static' | 'async' | 'unsafe' | 'extern')* type id type_params? '(' params? ')' constraint* body ;
switch: 'switch' '(' expr ')' '{{' (('case' pattern ('when' expr)? | 'default') ':' statement*)* '}}' ;
try: 'try' block (catch+ ('finally' block)? | 'finally' block) ;
catch: 'catch' ('(' type id? ')')? ('when' '(' expr ')')? block ;
exprs: expr (',' expr)* ;
expr: assign | lambda | query ;
assign: conditional ((ASSIGN | '=' | '>' '>' '=') (expr | array_init) | ('?' expr ':' expr))? ;
conditional: binary ;
lambda: attribute* ('static' | 'async')* (id | type? '(' lambda_params? ')') '=>' (block | expr) | 'async'? 'delegate' ('(' params? ')')? block ;
lambda_params: lambda_param (',' lambda_param)* ;
lambda_param: attribute* ('ref' | 'out' | 'in' | 'params')? (type id ('=' expr)? | id) ;
query: 'from' type? id 'in' expr query_clause* ('select' expr | 'group' expr 'by' expr) ('into' id query_clause* ('select' expr | 'group' expr 'by' expr))* ;
query_clause: 'from' type? id 'in' expr | 'let' id '=' expr | 'where' expr | 'join' type? id 'in' expr 'on' expr 'equals' expr ('into' id)? | 'orderby' expr ('ascending' | 'descending')? (',' expr ('ascending' | 'descending')?)* ;
binary: unary (binary_op unary | 'is' pattern | 'as' type | 'switch' '{{' (arm (',' arm)* ','?)? '}}' | 'with' object_init)* ;
arm: pattern ('when' expr)? '=>' expr ;
binary_op: BINARY | '+' | '-' | '*' | '/' | '<' | '>' | '>' '=' | '>' '>' | '&' | '|' | '..' ;
pattern: and_pattern ('or' and_pattern)* ;
and_pattern: not_pattern ('and' not_pattern)* ;
not_pattern: 'not'* (('<' | '>' | '>' '=' | BINARY) unary | type (positional property_pattern? id? | property_pattern id? | id)? | positional property_pattern? id? | property_pattern id? | 'var' (id | deconstruct) | unary | '[' (pattern (',' pattern)*)? ']' | '..' pattern?) ;
positional: '(' (sub_pattern (',' sub_pattern)*)? ')' ;
property_pattern: '{{' (sub_pattern (',' sub_pattern)* ','?)? '}}' ;
sub_pattern: (name ':')? pattern ;
unary: ('+' | '-' | '!' | '~' | '*' | '&' | INC | 'await' | '^' | 'ref' | 'throw' | '..')* (cast unary | postfix) ;
cast: '(' type ')' ;
postfix: primary (suffix | INC | '!')* ;
suffix: ('.' | '?.' | '->') name_part | '?'? '[' args ']' | call_args ;
call_args: '(' args? ')' ;
args: arg (',' arg)* ;
arg: (id ':')? ('ref' | 'out' | 'in')? (expr | type id) ;
primary: name_part | id '::' name_part | BUILTIN | NUMBER | STRING | CHAR | 'true' | 'false' | 'null' | 'this' | 'base' | '(' expr ')' | '(' arg (',' arg)+ ')' | new | 'typeof' '(' type ')' | 'sizeof' '(' type ')' | 'default' ('(' type ')')?
  | ('checked' | 'unchecked') '(' expr ')' | 'stackalloc' type? ('[' expr? ']')? array_init? | '[' ((('..')? expr) (',' '..'? expr)* ','?)? ']' ;
new: 'new' (base_type '?'? (call_args object_init? | object_init | ('[' exprs? ','* ']')+ array_init? | ('[' ','* ']')+ array_init) | call_args object_init? | '[' ','* ']' array_init | anonymous) ;
anonymous: '{{' (anonymous_item (',' anonymous_item)* ','?)? '}}' ;
anonymous_item: (id '=')? expr ;
object_init: '{{' (init_item (',' init_item)* ','?)? '}}' ;
init_item: (id | '[' args ']') '=' (expr | object_init) | expr | array_init ;
"""

_SOURCES = {
    "python": (PYTHON, {"python3": "file", "python3.10": "file_match"}),
    "json": (JSON, {"rfc8259": "text"}),
    "css": (CSS, {"css3": "sheet"}),
    "yaml": (YAML, {"yaml": "stream"}),
    "typescript": (TYPESCRIPT, {"module": "module"}),
    "csharp": (CSHARP, {"unit": "unit", "file_scoped": "unit_file_scoped", "top_level": "unit_script"}),
}


@cache
def grammar(language: str) -> Grammar:
    """The compiled grammar of a language, once for each process."""
    return Grammar(*_SOURCES[language])
