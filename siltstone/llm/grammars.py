"""Token grammars of the languages that files are checked against.

They describe what a parser of the language accepts, a little more freely:
names, types and scopes are not looked at.
"""

# Classes: ID NUM STR TPL(template string) RE(regex) NL INDENT DEDENT, keywords
# and signs as themselves; OP is any other binary operator, ASG an assignment
# with an operator, SGN plus or minus, NOT ! or ~, INC ++ or --.

PYTHON = """
file = (NL | stmt)* ;
stmt = simples | compound ;
simples = simple (';' simple)* ';'? NL ;
simple = exprs | tgts ('=' tgts)* '=' (exprs | yield_x) | single ASG (exprs | yield_x) | single ':' test ('=' (exprs | yield_x))? | yield_x | TYPE ID tparams? '=' test
  | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (test ('from' test)?)? | 'del' tgts
  | 'global' ID (',' ID)* | 'nonlocal' ID (',' ID)* | 'assert' test (',' test)?
  | 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)*
  | 'from' ('.' | '...')* dotted? 'import' ('*' | names | '(' names ','? ')') ;
names = ID ('as' ID)? (',' ID ('as' ID)?)* ;
dotted = ID ('.' ID)* ;
yield_x = 'yield' ('from' test | exprs)? ;
block = NL INDENT stmt+ DEDENT | simples ;
compound = ('@' walrus NL)* (('async')? 'def' ID tparams? '(' params? ')' ('->' test)? ':' block | 'class' ID tparams? ('(' args? ')')? ':' block)
  | 'if' walrus ':' block ('elif' walrus ':' block)* ('else' ':' block)?
  | 'while' walrus ':' block ('else' ':' block)?
  | 'async'? 'for' tgts 'in' exprs ':' block ('else' ':' block)?
  | 'async'? 'with' withs ':' block
  | 'try' ':' block (('except' '*'? (exprs ('as' ID)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)
  | MATCH exprs ':' NL INDENT (CASE exprs ('as' ID)? ('if' walrus)? ':' block)+ DEDENT ;
tparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = ('*' | '**')? ID (':' test)? ('=' '*'? test)? ;
withs = with (',' with)* | '(' with (',' with)* ','? ')' ;
with = test ('as' tgt)? ;
params = phase (',' tail)? ','? | tail ','? ;
phase = named (',' (named | '/'))* (',' (given | '/'))* | given (',' (given | '/'))* ;
tail = '*' ID (':' '*'? test)? (',' (named | given))* (',' '**' named)? | '*' (',' (named | given))+ (',' '**' named)? | '**' named ;
named = ID (':' test)? ;
given = named '=' test ;
args = arg (',' arg)* (',' later)* ','? | later (',' later)* ','? ;
arg = walrus comp? | '*' test ;
later = ID '=' test | ('*' | '**') test ;
comp = ('async'? 'for' tgts 'in' ors ('if' ors)*)+ ;
tgts = tgt (',' tgt)* ','? ;
tgt = '*'? (ID | atom trailer* place | '(' tgts? ')' | '[' tgts? ']') ;
single = ID | atom trailer* place | '(' single ')' ;
place = '.' ID | '[' subs ']' ;
walrus = test (':=' test)? ;
exprs = starred (',' starred)* ','? ;
starred = '*' bits | test (':=' test)? ;
test = ors ('if' ors 'else' test)? | 'lambda' params? ':' test ;
ors = nots (('and' | 'or') nots)* ;
nots = 'not' nots | bits (compare bits)* ;
compare = '<' | '>' | CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
bits = unary (('*' | '**' | SGN | OP | '/' | '@') unary)* ;
unary = SGN unary | NOT unary | 'await'? primary ;
primary = atom trailer* ;
atom = ID | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (yield_x | starred comp | exprs)? ')' | '[' (starred comp | exprs)? ']' | '{' (dict | starred comp | exprs)? '}' ;
dict = pair (comp | (',' pair)* ','?) ;
pair = test ':' test | '**' bits ;
trailer = '(' args? ')' | '[' subs ']' | '.' ID ;
subs = sub (',' sub)* ','? ;
sub = '*'? walrus | test? ':' test? (':' test?)? ;
"""

JSON = """
file = value ;
value = STR | NUM | LIT | '{' (STR ':' value (',' STR ':' value)*)? '}' | '[' (value (',' value)*)? ']' ;
"""

# NL stands where a line end may end a statement.
_SCRIPT = """
file = stmts ;
stmts = (NL | ';' | stmt)* ;
end = NL | ';' ;
block = '{' stmts_in '}' ;
stmts_in = (NL | ';' | stmt)* last? ;
last = bare ;
stmt = bare end | full ;
bare = decl | 'return' exprs? | 'throw' exprs | ('break' | 'continue') ID? | 'debugger' | exprs | 'import' import_x | 'export' export_x | 'do' body 'while' '(' exprs ')' $BARE ;
full = block | fun | classy | 'if' '(' exprs ')' body (NL* 'else' body)? | 'while' '(' exprs ')' body
  | 'for' 'await'? '(' (decl_for | exprs)? (('of' | 'in') exprs | ';' exprs? ';' exprs?) ')' body
  | 'try' block ('catch' ('(' binding type_of? ')')? block ('finally' block)? | 'finally' block)
  | 'switch' '(' exprs ')' '{' NL* (('case' exprs | 'default') ':' stmts_in)* '}'
  | ID ':' stmt | 'export' 'default'? (fun | classy $EXPORTED) | 'do' body NL* 'while' '(' exprs ')' $FULL ;
body = NL* (stmt | bare | ';') ;
decl_for = ('const' | 'let' | 'var') binding type_of? ('=' asg)? (',' binding type_of? ('=' asg)?)* ;
decl = ('let' | 'var') binding type_of? ('=' asg)? (',' NL* binding type_of? ('=' asg)?)* | 'const' binding type_of? '=' asg (',' NL* binding type_of? '=' asg)* ;
binding = ID | '[' (','* bound (','+ bound)* ','*)? ']' | '{' (prop_b (',' NL* prop_b)* ','?)? NL* '}' ;
bound = '...'? binding ('=' asg)? ;
prop_b = NL* (name (':' binding)? ('=' asg)? | '...' ID) ;
import_x = STR | (ID | '*' 'as' ID | braces) (',' ('*' 'as' ID | braces))? 'from' STR | 'type' braces 'from' STR ;
export_x = '*' ('as' ID)? 'from' STR | braces ('from' STR)? | 'default' asg | decl ;
braces = '{' NL* (any ('as' any)? (',' NL* any ('as' any)?)* ','?)? NL* '}' ;
any = ID | 'default' | 'type' | 'of' | 'as' | 'from' | STR ;
fun = 'async'? 'function' '*'? ID gens? '(' params? ')' result? block ;
classy = deco* $ABSTRACT 'class' ID gens? ('extends' unary)? $IMPLEMENTS class_body ;
deco = '@' ID ('.' ID)* ('(' args? ')')? NL* ;
class_body = '{' (NL | ';' | member)* '}' ;
member = deco* mod* ('get' | 'set' | '*' | 'async')* pname $MEMBER ( gens? '(' params? ')' result? (block | end | '?' end) | type_of? ('=' asg)? end ) | 'static' block $INDEXER ;
mod = 'static' $MODS ;
pname = name | '#' ID | '[' asg ']' ;
name = ID | STR | NUM | KW | 'get' | 'set' | 'of' | 'as' | 'from' | 'type' | 'static' | 'async' | 'default' | '[' asg ']' | $WORDS ;
params = param (',' NL* param)* ','? ;
param = deco* $PMODS '...'? binding $OPT type_of? ('=' asg)? ;
exprs = asg (',' NL* asg)* ;
asg = 'yield' '*'? asg? | unary tail ;
tail = ( (OP | SGN | '*' | '<' | '>' | 'in' | 'instanceof') unary | ('=' | ASG) asg | '?' asg ':' asg | '=>' (asg | block) $CAST )* ;
unary = (SGN | NOT | INC | 'typeof' | 'void' | 'delete' | 'await' $UNARY)* post ;
post = atom (('.' | '?.') (name | '#' ID) | '?.'? '[' exprs ']' | '?.'? '(' args? ')' | TPL $NONNULL)* INC? ;
args = '...'? asg (',' NL* '...'? asg)* ','? ;
atom = ID | NUM | STR | TPL | RE | KV | 'of' | 'as' | 'from' | 'type' | 'get' | 'set' | 'async' | 'static' $ATOMS
  | '(' (exprs ','? | NL)? ')' $PARENS | '(' pars ')' result? '=>' (asg | block)
  | 'async' (ID | '(' params? ')' result?) '=>' (asg | block)
  | '[' (','* ('...'? asg (','+ '...'? asg)*)? ','*) ']' | '{' (NL | obj)* (obj_last NL*)? '}'
  | 'async'? 'function' '*'? ID? gens? '(' params? ')' result? block | 'class' ID? ('extends' unary)? class_body
  | 'new' (atom ('.' name)* gens_call? ('(' args? ')')? | '.' ID) | 'import' ('(' asg ')' | '.' ID) | 'super' ;
pars = (bound_p (',' NL* bound_p)* ','?)? ;
bound_p = '...'? binding $OPT type_of? ('=' asg)? ;
obj = obj_last ',' ;
obj_last = NL* (('get' | 'set' | 'async' | '*')* name ('(' params? ')' result? block)? | name ':' asg | '...' asg | ID '=' asg) ;
"""


_JS_FILL = {
    "BARE": "", "FULL": "", "EXPORTED": "", "ABSTRACT": "", "IMPLEMENTS": "", "MEMBER": "", "MODS": "", "WORDS": "'let'",
    "PMODS": "", "OPT": "", "CAST": "", "UNARY": "", "NONNULL": "", "ATOMS": "", "PARENS": "", "INDEXER": "",
}
_JS_TYPES = "type_of = NEVER ; gens = NEVER ; result = NEVER ; gens_call = NEVER ;"
_TS_FILL = {
    "BARE": "| 'export'? 'default'? 'async'? 'function' ID gens? '(' params? ')' result? | 'type' ID gens? '=' type_x | 'export'? 'declare' (decl | 'const' binding type_of (',' binding type_of)* | 'function' ID gens? '(' params? ')' result?) | 'export' 'type' (ID gens? '=' type_x | braces ('from' STR)?) | 'export'? 'import' ID '=' asg | 'export' '=' asg",
    "FULL": "| 'export'? 'declare'? ('interface' ID gens? ('extends' type_x (',' type_x)*)? obj_type | 'const'? 'enum' ID '{' NL* (name ('=' asg)? NL* (',' NL* name ('=' asg)? NL*)* ','? NL*)? '}' | ('namespace' | 'module') (ID ('.' ID)* | STR) block) | 'declare' (fun | classy)",
    "EXPORTED": "",
    "ABSTRACT": "'abstract'?",
    "IMPLEMENTS": "('<' types '>')? ('implements' type_x (',' type_x)*)?",
    "MEMBER": "('?' | NOT)?",
    "MODS": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'",
    "WORDS": "'let' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'public' | 'private' | 'protected' | 'interface' | 'override' | 'implements' | 'keyof' | 'is' | 'infer' | 'satisfies'",
    "PMODS": "('public' | 'private' | 'protected' | 'readonly')*",
    "OPT": "'?'?",
    "CAST": "| ('as' | 'satisfies') ('const' | type_x)",
    "UNARY": "| '<' type_x '>'",
    "NONNULL": "| NOT | '<' types '>' '(' args? ')'",
    "ATOMS": "| 'async'? gens '(' pars ')' result? '=>' (asg | block) | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'is' | 'infer' | 'keyof' | 'satisfies'",
    "PARENS": "",
    "INDEXER": "| mod* '[' ID ':' type_x ']' type_of end",
}
_TS_TYPES = """
type_of = ':' NL* type_x ;
result = ':' NL* (('asserts')? (ID | KV) 'is' type_x | 'asserts' ID | type_x) ;
gens = '<' gen (',' NL* gen)* ','? '>' ;
gen = 'const'? ID ('extends' type_x)? ('=' type_x)? ;
gens_call = '<' types '>' ;
types = type_x (',' NL* type_x)* ;
type_x = OP? type_u (OP type_u)* ('extends' type_x '?' type_x ':' type_x)? ;
type_u = ('keyof' | 'readonly' | 'typeof' | 'infer' | 'unique')* type_p ('[' type_x? ']')* ;
type_p = (ID | KV | 'void' | 'get' | 'set' | 'type' | 'of' | 'from' | 'as') ('.' ID)* ('<' types '>')? | STR | NUM | SGN NUM | TPL | '(' type_x ')' | obj_type
  | '[' (('...'? (ID '?'? ':')? type_x '?'?) (',' ('...'? (ID '?'? ':')? type_x '?'?))* ','?)? ']'
  | 'new'? gens? '(' params? ')' '=>' (type_x | ID 'is' type_x) | 'import' '(' STR ')' ('.' ID)* ;
obj_type = '{' (NL | ';' | ',' | type_m)* '}' ;
type_m = (SGN? 'readonly')? ( (name) '?'? (type_of | gens? '(' params? ')' result?) | '[' ID (':' | 'in') type_x ('as' type_x)? ']' (SGN? '?')? type_of | 'new'? gens? '(' params? ')' result? ) (end | ',' )? ;
"""


def _fill(text: str, values: dict[str, str]) -> str:
    for key, value in values.items():
        text = text.replace(f"| ${key}", f"| {value}" if value else "").replace(f"${key}", value)
    return text


JAVASCRIPT = _fill(_SCRIPT, _JS_FILL) + _JS_TYPES
TYPESCRIPT = _fill(_SCRIPT, _TS_FILL) + _TS_TYPES

_GO_EXPR = """
expr@ = unary@ ((OP | SGN | '*' | '&' | '<' | '>' | '<-') unary@)* ;
unary@ = (SGN | NOT | '*' | '&' | '<-')* post@ ;
post@ = atom@ ('.' (ID | '(' (type_x | 'type') ')') | '[' (types_or (',' types_or)* ','? | expr? ':' expr? (':' expr)?) ']' | '(' args? ')' | $LIT)* ;
"""
GO = (
    """
file = ';'* 'package' ID ';' (top? ';')* ;
top = 'import' (spec_i | '(' (spec_i ';')* spec_i? ')') | 'func' ('(' params ')')? ID gens? sig block? | decl ;
spec_i = (ID | '.')? STR ;
decl = 'type' (spec_t | '(' (spec_t ';')* spec_t? ')') | ('var' | 'const') (spec_v | '(' (spec_v ';')* spec_v? ')') ;
spec_t = ID gens? '='? type_x ;
spec_v = ID (',' ID)* type_x? ('=' exprs)? ;
gens = '[' ID (',' ID)* union_t (',' ID (',' ID)* union_t)* ','? ']' ;
union_t = NOT? type_x (OP NOT? type_x)* ;
sig = '(' params ')' (type_x | '(' params ')')? ;
params = (param (',' param)* ','?)? ;
param = ID '...'? type_x | '...'? type_x ;
type_x = ID ('.' ID)? ('[' type_x (',' type_x)* ']')? | '*' type_x | '[' (expr | '...')? ']' type_x | 'map' '[' type_x ']' type_x
  | '<-'? 'chan' '<-'? type_x | 'func' sig | '(' type_x ')' | 'struct' '{' (field? ';')* field? '}' | 'interface' '{' (meth? ';')* meth? '}' ;
field = (ID (',' ID)* type_x | '*'? ID ('.' ID)?) STR? ;
meth = ID sig | union_t ;
block = '{' stmts '}' ;
stmts = (stmt? ';')* stmt? ;
stmt = decl | simple | 'return' exprs? | ('break' | 'continue' | 'goto') ID? | 'fallthrough' | ('go' | 'defer') expr | block | ID ':' stmt?
  | if_x | 'for' (range_h | simple_h? ';' expr_h? ';' simple_h? | expr_h)? block
  | 'switch' (simple_h? ';')? (simple_h)? '{' (('case' (types_or (',' types_or)*) | 'default') ':' stmts)* '}'
  | 'select' '{' (('case' simple | 'default') ':' stmts)* '}' ;
if_x = 'if' (simple_h ';')? expr_h block ('else' (if_x | block))? ;
range_h = (exprs_h ('=' | ':='))? 'range' expr_h ;
types_or = expr | type_x ;
simple = exprs (('=' | ':=' | ASG) exprs | INC | '<-' expr)? ;
simple_h = exprs_h (('=' | ':=' | ASG) exprs_h | INC | '<-' expr_h)? ;
exprs = expr (',' expr)* ;
exprs_h = expr_h (',' expr_h)* ;
args = types_or '...'? (',' types_or '...'?)* ','? ;
atom = ID | NUM | STR | '(' types_or ')' | 'func' sig block | lit_t lit | 'map' '[' type_x ']' type_x '(' args? ')' | '[' ']' type_x '(' args? ')' | 'chan' type_x ;
atom_h = ID | NUM | STR | '(' types_or ')' | 'func' sig block | '[' (expr | '...')? ']' type_x (lit | '(' args? ')') | 'map' '[' type_x ']' type_x lit ;
lit_t = '[' (expr | '...')? ']' type_x | 'map' '[' type_x ']' type_x | 'struct' '{' (field? ';')* field? '}' ;
lit = '{' (item (',' item)* ','?)? '}' ;
item = (expr | lit) (':' (expr | lit))? ;
"""
    + _GO_EXPR.replace("@", "").replace("$LIT", "lit")
    + _GO_EXPR.replace("@", "_h").replace("| $LIT", "")
)

JAVA = """
file = ';'* (annos 'package' dotted ';')? ('import' 'static'? dotted ('.' '*')? ';' | ';')* (type_d | ';')* ;
dotted = ID ('.' ID)* ;
annos = anno* ;
anno = '@' dotted ('(' (anno_v (',' anno_v)*)? ')')? ;
anno_v = (ID '=')? (expr | '{' (expr (',' expr)*)? ','? '}' | anno) ;
mods = (MOD | 'static' | 'final' | 'default' | 'sealed' | anno)* ;
type_d = mods (class_d | enum_d | iface_d | record_d) ;
class_d = 'class' ID gens? ('extends' type_x)? ('implements' types)? ('permits' types)? class_b ;
iface_d = '@'? 'interface' ID gens? ('extends' types)? ('permits' types)? class_b ;
record_d = 'record' ID gens? '(' params? ')' ('implements' types)? class_b ;
enum_d = 'enum' ID ('implements' types)? '{' (annos ID ('(' args? ')')? class_b? (',' annos ID ('(' args? ')')? class_b?)*)? ','? (';' member*)? '}' ;
class_b = '{' member* '}' ;
member = ';' | type_d | 'static'? block | mods gens? ( (type_x | 'void') nameid ( '(' params? ')' ('[' ']')* throws (block | ';' | 'default' anno_v ';') | dims ('=' init)? (',' nameid dims ('=' init)?)* ';' ) | ID '(' params? ')' throws block | ID block ) ;
nameid = ID | 'record' ;
throws = ('throws' types)? ;
dims = ('[' ']')* ;
gens = '<' gen (',' gen)* '>' ;
gen = annos ID ('extends' type_x ('&' type_x)*)? ;
types = type_x (',' type_x)* ;
type_x = annos ID ('.' annos ID)* targs? ('.' ID targs?)* dims ;
targs = '<' (targ (',' targ)*)? '>' ;
targ = type_x | annos '?' (('extends' | 'super') type_x)? ;
params = param (',' param)* ;
param = mods type_x '...'? nameid dims | mods type_x 'this' ;
block = '{' stmt* '}' ;
stmt = block | ';' | type_d | local ';' | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (mods type_x ID ':' expr | (local | args)? ';' expr? ';' args?) ')' stmt | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') ID? ';' | 'yield' expr ';'
  | 'try' ('(' res (';' res)* ';'? ')')? block ('catch' '(' mods type_x (OP type_x)* ID ')' block)* ('finally' block)?
  | switch_x | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | ID ':' stmt ;
res = mods type_x ID '=' expr | dotted ;
local = mods type_x nameid dims ('=' init)? (',' ID dims ('=' init)?)* ;
init = expr | '{' (init (',' init)*)? ','? '}' ;
switch_x = 'switch' '(' expr ')' '{' ( ('case' cases | 'default') (':' stmt* | '->' (expr ';' | block | 'throw' expr ';')) )* '}' ;
cases = (expr | type_x ID) (',' (expr | type_x ID))* ('if' expr)? ;
expr = unary ( (OP | SGN | '*' | '&' | '<' | '>' '>'* '='?) unary | ('=' | ASG) expr | '?' expr ':' expr | '->' (expr | block) | 'instanceof' 'final'? type_x ID? )* ;
unary = (SGN | NOT | INC | '(' type_x ('&' type_x)* ')')* post ;
post = atom ('.' (ID | 'class' | 'this' | 'new' ID targs? '(' args? ')' | targs ID | 'super' ('(' args? ')')?) | '[' expr ']' | '(' args? ')' | '::' (ID | 'new') )* INC? ;
args = expr (',' expr)* ;
atom = ID | NUM | STR | KV | 'record' | '(' expr ')' | '(' (lam (',' lam)*)? ')' '->' (expr | block) | 'new' annos ID ('.' ID)* targs? ( '(' args? ')' class_b? | ('[' expr? ']')+ ('{' (init (',' init)*)? ','? '}')? )
  | switch_x | type_x '::' (ID | 'new') | type_x '.' 'class' | 'super' ;
lam = ID | mods type_x ID ;
"""

#: SQL statements by their first word; what a statement holds is a loose phrase of balanced parts.
SQL = """
file = ';'* (stmt ';'+)* stmt? ;
stmt = query | insert | create | alter | 'DELETE' 'FROM' tname alias? ('USING' phrase)? where? ('RETURNING' phrase)? | 'UPDATE' tname alias? 'SET' sets ('FROM' phrase)? where? ('RETURNING' phrase)?
  | 'DROP' word word* tname (',' tname)* word* | 'TRUNCATE' word* tname (',' tname)* word* | 'GRANT' phrase | 'REVOKE' phrase | 'BEGIN' phrase? | 'COMMIT' phrase? | 'ROLLBACK' phrase?
  | 'USE' phrase | 'SET' phrase | 'PRAGMA' phrase | 'COMMENT' phrase | 'EXPLAIN' phrase? stmt | 'MERGE' phrase | 'CALL' phrase | 'VACUUM' phrase? | 'ANALYZE' phrase? | 'START' phrase | 'END' phrase? | 'DECLARE' phrase | 'LOCK' phrase | 'SHOW' phrase | 'COPY' phrase ;
query = ('WITH' 'RECURSIVE'? cte (',' cte)*)? (select | values) (setop (select | values))* order* | ('WITH' 'RECURSIVE'? cte (',' cte)*) (insert | 'DELETE' phrase | 'UPDATE' phrase) ;
cte = ID ('(' ID (',' ID)* ')')? 'AS' word* '(' (query | insert) ')' ;
setop = ('UNION' | 'INTERSECT' | 'EXCEPT') ('ALL' | 'DISTINCT')? ;
select = 'SELECT' ('DISTINCT' ('ON' '(' exprs ')')? | 'ALL')? items ('INTO' tname)? ('FROM' from_x)? where? ('GROUP' 'BY' exprs)? ('HAVING' expr)? ('WINDOW' phrase)? order* | '(' query ')' ;
values = 'VALUES' row (',' row)* ;
row = '(' exprs ')' ;
items = item (',' item)* ;
item = expr ('AS'? (ID | STR))? ;
from_x = source (',' source)* ;
source = table_x (join table_x ('ON' expr | 'USING' '(' ID (',' ID)* ')')?)* ;
join = ('INNER' | ('LEFT' | 'RIGHT' | 'FULL') 'OUTER'? | 'CROSS' | 'NATURAL')* 'JOIN' ;
table_x = 'LATERAL'? (tname ('(' exprs? ')')? | '(' (query | source) ')') ('AS'? ID ('(' ID (',' ID)* ')')?)? ;
tname = ID ('.' ID)* | STR ;
alias = 'AS'? ID ;
where = 'WHERE' expr ;
order = 'ORDER' 'BY' oitem (',' oitem)* | ('LIMIT' | 'OFFSET') expr (',' expr)? | 'FETCH' phrase | 'FOR' phrase ;
oitem = expr ('ASC' | 'DESC')? ('NULLS' ID)? ;
sets = expr (',' expr)* ;
insert = ('INSERT' | 'REPLACE') ('OR' ('REPLACE' | ID))? ('IGNORE' | ID)* 'INTO' tname ('(' ID (',' ID)* ')')? (query | 'DEFAULT' 'VALUES' | 'SET' sets) ('ON' phrase)? ('RETURNING' phrase)? ;
create = 'CREATE' ('OR' 'REPLACE')? word* ( 'TABLE' ifn? tname ('(' cols ')' word* phrase? | 'AS' query | 'LIKE' phrase) | 'VIEW' ifn? tname ('(' ID (',' ID)* ')')? 'AS' query
  | 'INDEX' word* ifn? ID? 'ON' tname phrase | ('FUNCTION' | 'PROCEDURE' | 'TRIGGER' | 'TYPE' | 'SCHEMA' | 'DATABASE' | 'SEQUENCE' | 'EXTENSION' | 'ROLE' | 'USER') phrase ) ;
ifn = 'IF' 'NOT' 'EXISTS' ;
cols = col (',' col)* ;
col = ID type_x cons* | 'CONSTRAINT' ID tcons | tcons ;
type_x = (ID | 'SET' | 'SCHEMA' | 'TYPE')+ ('(' (NUM | ID | STR) (',' (NUM | ID | STR))* ')')? (ID | 'WITH')* ('[' NUM? ']')* ;
cons = 'NOT'? 'NULL' | 'DEFAULT' unary | 'PRIMARY' 'KEY' ID? | 'UNIQUE' | 'REFERENCES' tname ('(' ID (',' ID)* ')')? ('ON' ('DELETE' | 'UPDATE') ('SET' ('NULL' | 'DEFAULT') | ID+))* | 'CHECK' '(' expr ')' | 'CONSTRAINT' ID | ID | 'AS' '(' expr ')' | 'COMMENT' STR | 'ON' 'UPDATE' unary ;
tcons = 'PRIMARY' 'KEY' '(' exprs ')' | 'UNIQUE' ID? '(' exprs ')' | 'FOREIGN' 'KEY' '(' exprs ')' cons+ | 'CHECK' '(' expr ')' | ('KEY' | 'INDEX') ID? '(' exprs ')' ;
alter = 'ALTER' word+ tname? (action (',' action)* | phrase) ;
action = ('ADD' | 'DROP' | 'RENAME' | 'ALTER' | 'SET' | 'OWNER') phrase ;
word = ID | 'TABLE' | 'IF' | 'NOT' | 'EXISTS' | 'UNIQUE' | 'VIEW' | 'INDEX' | 'CASCADE' | 'USER' | 'SCHEMA' | 'DATABASE' | 'ROLE' | 'TYPE' | 'SEQUENCE' | 'FUNCTION' | 'EXTENSION' | 'TRIGGER' | 'WITH' ;
exprs = oitem (',' oitem)* ;
expr = unary ( (OP | SGN | '*' | '=' | 'AND' | 'OR' | 'NOT'? ('LIKE' | 'ILIKE' | 'BETWEEN') | '::' ) unary | 'IS' 'NOT'? ('NULL' | 'DISTINCT' 'FROM' unary | unary) | 'NOT'? 'IN' '(' (query | exprs) ')' | 'COLLATE' ID )* ;
unary = ('NOT' | SGN | NOT | 'EXISTS' | 'DISTINCT' | 'ANY' | 'ALL')* atom ;
atom = (ID | FN) ('.' (ID | '*'))* ('(' ('DISTINCT'? exprs ('FROM' expr)? ('AS' type_x)? | '*')? ')' ('FILTER' '(' where ')')? ('OVER' ('(' phrase? ')' | ID))? )? STR? ('[' expr ']')* | NUM | STR | PARAM | '*' | 'NULL' | 'DEFAULT' | '(' (query | exprs) ')' | CAST '(' expr 'AS' type_x ')'
  | 'CASE' expr? ('WHEN' expr 'THEN' expr)+ ('ELSE' expr)? 'END' | 'REPLACE' '(' exprs ')' | 'LEFT' '(' exprs ')' | 'RIGHT' '(' exprs ')' ;
phrase = bit+ ;
bit = ID | FN | NUM | STR | PARAM | OP | SGN | NOT | '*' | '=' | '.' | ',' | '::' | CAST | W | '(' phrase? ')' | '[' phrase? ']' ;
"""

YAML = """
file = doc? (SEP doc?)* ;
doc = node ;
node = map | list | scalar NL (INDENT cont DEDENT | PLAIN NL)* | flow NL | prop+ NL? node | BLOCK ;
scalar = PLAIN | QUOTED | ALIAS ;
prop = TAG | ANCHOR ;
map = pair+ ;
pair = key ':' ( NL (INDENT node DEDENT | list_same)? | prop* value | prop* NL INDENT node DEDENT ) | '?' node (':' node)? ;
key = prop* (PLAIN | QUOTED | ALIAS | flow) ;
value = scalar NL (INDENT cont DEDENT)? | flow NL | BLOCK | prop NL ;
cont = (PLAIN NL | INDENT cont DEDENT)+ ;
list_same = list ;
list = item+ ;
item = '-' ( NL (INDENT node DEDENT)? | prop* scalar NL (INDENT cont DEDENT)? | prop* flow NL | prop* BLOCK | INDENT node DEDENT ) ;
flow = '{' (fpair (',' fpair)* ','?)? '}' | '[' (fval (',' fval)* ','?)? ']' ;
fpair = prop* fkey (':' fval?)? ;
fkey = scalar | flow ;
fval = prop* (scalar | flow) (':' fval?)? ;
"""
