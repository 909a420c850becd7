"""Parsing-expression grammars of the ten languages, in the notation of :mod:`symweave.llm.peg`."""

from __future__ import annotations

from functools import cache

from symweave.llm.peg import Grammar

_JS = r"""
file = item* EOF
item = import / export / stmt
semi = ';' / ^ / &'}' / &EOF
block = '{' stmt* '}'
import = 'import' (STR / clause 'from' STR) ('with' object)? semi
clause = ID ',' (star / names) / star / names / ID
star = '*' 'as' ID
names = '{' (spec (',' spec)* ','?)? '}'
spec = (ID / KW / STR) ('as' (ID / KW / STR))?
export = 'export' ('default' (func / class / !'function' !'class' assign semi) / '*' ('as' (ID / KW / STR))? 'from' STR semi / names ('from' STR)? semi / decl)
decl = var semi / func / class
stmt = block / ';' / decl / if / loop / switch / try / 'return' (~ expr)? semi / 'throw' ~ expr semi / ('break' / 'continue') (~ ID)? semi / 'debugger' semi / ID ':' stmt / !'function' !'class' expr semi
if = 'if' '(' expr ')' stmt ('else' stmt)?
loop = 'for' 'await'? '(' forhead ')' stmt / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'?
forhead = (('var' / 'const' / 'let') pattern / lhs) ('of' assign / 'in' expr) / (var / expr)? ';' expr? ';' expr?
switch = 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' stmt*)* '}'
try = 'try' block ('catch' ('(' pattern ')')? block ('finally' block)? / 'finally' block)
var = ('var' / 'let') bind (',' bind)* / 'const' constbind (',' constbind)*
constbind = pattern '=' assign
bind = pattern '=' assign / ID
pattern = ID / '{' (pprop (',' pprop)* ','?)? '}' / '[' (','* pelem (','+ pelem)* ','*)? ']' / '[' ','* ']'
pprop = '...' ID / propname ':' pattern ('=' assign)? / ID ('=' assign)?
pelem = '...' pattern / pattern ('=' assign)?
propname = ID / KW / STR / NUM / PRIV / '[' assign ']'
func = ('async' ~)? 'function' '*'? ID? params block
params = '(' (param (',' param)* ','?)? ')'
param = '...' pattern / pattern ('=' assign)?
class = decorator* 'class' ID? ('extends' lhs)? '{' member* '}'
decorator = '@' lhs
member = ';' / 'static' block / decorator* mods method / decorator* mods field
mods = ('static' !('(' / '=' / ';'))?
method = (('async' ~ '*'? / 'get' / 'set' / '*') &propname)? propname params block
field = 'accessor'? propname ('=' assign)? semi
expr = assign (',' assign)*
assign = arrow / 'yield' (~ '*'? assign)? / lhs assignop assign / cond
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '>' '>=' / '>' '>' '>='
arrow = ('async' ~)? (ID / params) ~ '=>' body
body = block / !'{' assign
cond = binary ('?' assign ':' assign)?
binary = unary (binop unary)* / PRIV 'in' unary
binop = '+' / '-' / '*' / '/' / '%' / '**' / '==' / '!=' / '===' / '!==' / '<' / '<=' / '>=' / '>' '>' '>' !'=' / '>' '>' / '>' / '&&' / '||' / '??' / '&' / '|' / '^' / '<<' / 'in' / 'instanceof'
unary = ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / 'await' / '++' / '--') unary / postfix
postfix = lhs (~ ('++' / '--'))?
lhs = primary suffix*
suffix = '.' (ID / KW / PRIV) / '?.' (ID / KW / PRIV / '[' expr ']' / args) / '[' expr ']' / args / string
args = '(' (arg (',' arg)* ','?)? ')'
arg = '...'? assign
string = STR / SB expr? (SM expr?)* SE
new = 'new' ('.' ID / 'new' newtarget args? / newtarget args?)
newtarget = primary ('.' (ID / KW / PRIV) / '[' expr ']')*
primary = func / class / new / ID / NUM / string / RE / 'this' / 'super' / 'null' / 'true' / 'false' / array / object / '(' expr ')' / 'import' ('(' assign (',' assign)? ','? ')' / '.' ID)
array = '[' ','* (arg (','+ arg)* ','*)? ']'
object = '{' (oprop (',' oprop)* ','?)? '}'
oprop = '...' assign / propname ':' assign / method / ID ('=' assign)?
"""

_TS = (
    _JS
    + r"""
item = import / export / ambient / stmt
import = 'import' ('type' &(ID 'from' / '{' / '*'))? (STR / clause 'from' STR) ('with' object)? semi / 'import' 'type'? ID '=' ('require' '(' STR ')' / qualified) semi
spec = 'type'? (ID / KW / STR) ('as' (ID / KW / STR))? / (ID / KW) ('as' (ID / KW))?
export = 'export' ('default' (func / 'abstract'? class / interface / !'function' !'class' assign semi) / 'type'? '*' ('as' (ID / KW / STR))? 'from' STR semi / 'type'? names ('from' STR)? semi / '=' expr semi / 'as' 'namespace' ID semi / ambient / decl)
ambient = 'declare' (ambient / 'function' ID typeparams? tparams typeann? semi / 'global' '{' item* '}' / decl) / interface / alias / enum / namespace
decl = decorator* 'abstract' class / interface / alias / enum / namespace / var semi / func / class
interface = 'interface' ID typeparams? ('extends' type (',' type)*)? objtype
alias = 'type' ~ ID typeparams? '=' type semi
enum = 'const'? 'enum' ID '{' ((propname ('=' assign)?) (',' propname ('=' assign)?)* ','?)? '}'
namespace = ('namespace' / 'module') ~ (qualified / STR) '{' item* '}'
qualified = ID ('.' (ID / KW))*
typeann = ':' ('asserts' ID ('is' type)? / (ID / 'this') 'is' type / type)
typeparams = '<' typeparam (',' typeparam)* ','? '>'
typeparam = ('const' / 'in' / 'out')* ID ('extends' type)? ('=' type)?
typeargs = '<' type (',' type)* ','? '>'
type = functype / condtype
functype = 'abstract'? 'new'? typeparams? tparams '=>' ('asserts' ID ('is' type)? / (ID / 'this') 'is' type / type)
condtype = uniontype (~ 'extends' uniontype '?' type ':' type)?
uniontype = ('|' / '&')? optype (('|' / '&') optype)*
optype = ('keyof' / 'unique' / 'readonly' / 'infer') optype ('extends' optype !'?')? / 'typeof' qualified typeargs? arrtype* / ptype arrtype*
arrtype = ~ '[' type? ']'
ptype = '(' type ')' / 'import' '(' STR ')' ('.' ID)* typeargs? / ('void' / 'null' / 'this' / 'true' / 'false' / 'undefined') / '-'? NUM / STR / SB type (SM type)* SE / objtype / '[' (tuple (',' tuple)* ','?)? ']' / qualified (~ typeargs)?
tuple = '...'? (ID '?'? ':' type / type '?'?)
objtype = '{' (tmember (';' / ',' / ^ / &'}'))* '}'
tmember = ('readonly' / '+' / '-')* '[' ID 'in' type ('as' type)? ']' (('+' / '-')? '?')? typeann? / 'readonly'? '[' ID ':' type ']' typeann / 'new'? typeparams? tparams typeann? / (('get' / 'set') &propname)? 'readonly'? propname '?'? typeparams? tparams typeann? / ('readonly' &propname)? propname '?'? typeann?
tparams = '(' (tparam (',' tparam)* ','?)? ')'
tparam = '...'? (pattern / 'this') '?'? typeann? ('=' assign)?
string = STR / SB jsx? (SM jsx?)* SE
jsx = '...' assign / expr
constbind = bind
bind = pattern '!'? typeann? '=' assign / ID '!'? typeann?
try = 'try' block ('catch' ('(' pattern typeann? ')')? block ('finally' block)? / 'finally' block)
forhead = (('var' / 'const' / 'let') pattern typeann? / lhs) ('of' assign / 'in' expr) / (var / expr)? ';' expr? ';' expr?
func = ('async' ~)? 'function' '*'? ID? typeparams? params typeann? (block / semi)
params = '(' (param (',' param)* ','?)? ')'
param = decorator* pmod* ('...' pattern typeann? / 'this' typeann / pattern '?'? typeann? ('=' assign)?)
pmod = ('public' / 'private' / 'protected' / 'readonly' / 'override') &(ID / '{' / '[')
class = decorator* 'abstract'? 'class' !'implements' ID? typeparams? ('extends' lhs typeargs?)? ('implements' type (',' type)*)? '{' member* '}' / decorator* 'class' ('extends' lhs typeargs?)? ('implements' type (',' type)*)? '{' member* '}'
member = ';' / 'static' block / decorator* mods ('readonly'? '[' ID ':' type ']' typeann semi / method / field)
mods = (('public' / 'private' / 'protected' / 'static' / 'abstract' / 'override' / 'readonly' / 'declare' / 'accessor') !('(' / '=' / ';' / ':' / '?' / '!' / ',' / '}'))*
method = (('async' ~ '*'? / 'get' / 'set' / '*') &propname)? propname '?'? typeparams? params typeann? (block / semi)
field = propname ('?' / '!')? typeann? ('=' assign)? semi
oprop = '...' assign / propname ':' assign / omethod / ID ('=' assign)?
omethod = (('async' ~ '*'? / 'get' / 'set' / '*') &propname)? propname typeparams? params typeann? block
arrow = ('async' ~)? (ID / typeparams? params typeann?) ~ '=>' body
binary = unary cast* (binop unary cast*)*
cast = ~ ('as' ('const' / type) / 'satisfies' type)
suffix = '.' (ID / KW / PRIV) / '?.' (ID / KW / PRIV / '[' expr ']' / typeargs? args) / '[' expr ']' / args / string / typeargs (args / string / !(ID / NUM / '(')) / ~ '!'
unary = ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / 'await' / '++' / '--') unary / '<' ('const' / type) '>' unary / postfix
newtarget = primary ('.' (ID / KW / PRIV) / '[' expr ']')* typeargs?
"""
)

_JAVA = r"""
file = (annotation* 'package' name ';')? (import / ';')* (module / top*) EOF
name = ID ('.' ID)*
import = 'import' ('module' name / 'static'? name ('.' '*')?) ';'
module = annotation* 'open'? 'module' name '{' (!'}' (ID / KW / '.' / ',' / ';'))* '}'
top = ';' / member
annotation = '@' !'interface' name ('(' (ID '=' annval (',' ID '=' annval)* / annval)? ')')?
annval = annotation / '{' (annval (',' annval)* ','?)? '}' / cond
mod = annotation / 'public' / 'protected' / 'private' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !':' / 'sealed' &typeword / 'non' '-' 'sealed'
typeword = mod / 'class' / 'interface' / 'abstract'
typedecl = class / interface / enum / record / '@' 'interface' ID '{' (';' / mod* (typedecl / type ID '(' ')' dims ('default' annval)? ';' / fieldrest))* '}'
class = 'class' ID typeparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
interface = 'interface' ID typeparams? ('extends' types)? ('permits' types)? classbody
record = 'record' ID typeparams? '(' formals? ')' ('implements' types)? classbody
enum = 'enum' ID ('implements' types)? '{' (enumconst (',' enumconst)*)? ','? (';' member*)? '}'
enumconst = annotation* ID args? classbody?
classbody = '{' member* '}'
member = ';' / 'static' block / block / mod* (typedecl / method / fieldrest)
method = typeparams? (annotation* ('void' / type))? ID '(' formals? ')' dims ('throws' types)? (block / ';') / ID block
fieldrest = type declarator (',' declarator)* ';'
declarator = (ID / '_') dims ('=' varinit)?
varinit = arrayinit / expr
arrayinit = '{' (varinit (',' varinit)*)? ','? '}'
dims = (annotation* '[' ']')*
formals = formal (',' formal)*
formal = ('final' / annotation)* type annotation* '...'? ((ID '.')* 'this' / (ID / '_') dims)
typeparams = '<' typeparam (',' typeparam)* '>'
typeparam = annotation* ID ('extends' type ('&' type)*)?
types = type (',' type)*
type = annotation* (prim / ID typeargs? ('.' annotation* ID typeargs?)*) dims
prim = 'boolean' / 'byte' / 'short' / 'int' / 'long' / 'char' / 'float' / 'double'
typeargs = '<' (typearg (',' typearg)*)? '>'
typearg = annotation* '?' (('extends' / 'super') type)? / type
block = '{' stmt* '}'
local = ('final' / annotation)* type declarator (',' declarator)*
stmt = block / ';' / ID ':' stmt / if / for / 'while' par stmt / 'do' stmt 'while' par ';' / switch / try / 'synchronized' par block / 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') ID? ';' / 'yield' !('=' / '.' / '(' / '++' / '--' / '[') expr ';' / 'assert' expr (':' expr)? ';' / localtype / local ';' / expstmt ';'
localtype = ('final' / 'abstract' / 'static' / 'strictfp' / annotation)* (class / interface / enum / record)
par = '(' expr ')'
if = 'if' par stmt ('else' stmt)?
for = 'for' '(' (('final' / annotation)* type (ID / '_') ':' expr / (local / expstmt (',' expstmt)*)? ';' expr? ';' (expstmt (',' expstmt)*)?) ')' stmt
switch = 'switch' par '{' switchcase* '}'
switchcase = (label ':')+ (!label stmt)* / label '->' (block / 'throw' expr ';' / expr ';')
label = 'case' caseitem (',' caseitem)* ('when' expr)? / 'default' !('->' '->')
caseitem = 'default' / casepattern / cond
casepattern = ('final' / annotation)* type ('(' (casepattern (',' casepattern)*)? ')' ID? / ID / '_') / '_'
try = 'try' (resources block catch* finally? / block (catch+ finally? / finally))
resources = '(' resource (';' resource)* ';'? ')'
resource = ('final' / annotation)* type ID '=' expr / expr
catch = 'catch' '(' ('final' / annotation)* type ('|' type)* (ID / '_') ')' block
finally = 'finally' block
expstmt = unaryinc / postfix assignop expr / call
unaryinc = ('++' / '--') unary / postfix0 ('++' / '--')
postfix0 = primary suffix*
call = postfix
expr = lambda / postfix0 assignop expr / cond
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '<<=' / '&=' / '|=' / '^=' / '>' '>=' / '>' '>' '>='
lambda = (ID / '_' / '(' ((ID / '_') (',' (ID / '_'))* / lformal (',' lformal)*)? ')') '->' (block / expr)
lformal = formal
cond = binary ('?' expr ':' (lambda / cond))?
binary = unary ('instanceof' 'final'? (casepattern / type) / binop (lambda / unary))*
binop = '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '<=' / '<<' / '<' / '>=' / '>' '>' '>' / '>' '>' / '>' / '&&' / '||' / '&' / '|' / '^'
unary = ('++' / '--' / '+' / '-' / '!' / '~') unary / cast / postfix
cast = '(' prim dims ')' unary / '(' type ('&' type)* ')' (lambda / !('+' / '-') unary)
postfix = postfix0 ('++' / '--')*
suffix = '.' (typeargs? (ID args? / 'super' args / 'this') / 'new' creator / 'class') / '[' expr ']' / args / '::' typeargs? (ID / 'new') / typeargs? dims ('.' 'class' / '::' (ID / 'new'))
args = '(' (expr (',' expr)*)? ')'
primary = NUM / STR / CHR / 'true' / 'false' / 'null' / 'this' / 'super' / switch / 'new' creator / (prim / 'void') dims ('.' 'class' / '::' 'new') / ID / '(' expr ')'
creator = annotation* typeargs? (prim / ID typeargs? ('.' ID typeargs?)*) (('[' expr ']')+ dims / ('[' ']')+ arrayinit / args classbody?)
"""

_GO = r"""
file = 'package' ID ';' (import ';')* (top ';')* top? EOF
import = 'import' (impspec / '(' (impspec ';')* impspec? ')')
impspec = ('.' / ID)? STR
top = func / decl
decl = 'const' group_c / 'var' group_v / 'type' group_t
group_c = '(' (constfirst (';' constspec)* ';'?)? ')' / constfirst
constfirst = idents type? '=' exprs
group_v = '(' (varspec ';')* varspec? ')' / varspec
group_t = '(' (typespec ';')* typespec? ')' / typespec
constspec = idents (type? '=' exprs)?
varspec = idents (type ('=' exprs)? / '=' exprs)
typespec = ID typeparams? '='? type
idents = ID (',' ID)*
func = 'func' (params ID / ID typeparams?) signature block?
typeparams = '[' idents constraint (',' idents constraint)* ','? ']'
constraint = '~'? type ('|' '~'? type)*
signature = params (params / type)?
params = '(' (param (',' param)* ','?)? ')'
param = ID '...' type / '...' type / ID type / type
type = '(' type ')' / '*' type / '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / '<-' 'chan' type / 'chan' '<-'? type / 'func' signature / struct / interface / ID ('.' ID)? ('[' type (',' type)* ','? ']')?
struct = 'struct' '{' (fielddecl ';')* fielddecl? '}'
fielddecl = (idents type / '*'? ID ('.' ID)? ('[' type (',' type)* ']')?) STR?
interface = 'interface' '{' (imember ';')* imember? '}'
imember = ID signature / constraint
block = '{' stmts '}'
stmts = (stmt? ';')* stmt?
stmt = decl / ID ':' stmt? / 'return' exprs? / ('break' / 'continue') ID? / 'goto' ID / 'fallthrough' / ('go' / 'defer') expr / block / if / switch / select / for / simple
simple = exprs (':=' exprs / assignop exprs / '++' / '--' / '<-' expr)?
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '&^=' / '>' '>='
nsimple = nexprs (':=' nexprs / assignop nexprs / '++' / '--' / '<-' nexpr)?
if = 'if' (nsimple? ';')? nexpr block ('else' (if / block))?
switch = 'switch' ((nsimple? ';')? (ID ':=')? nsimple)? '{' (('case' (types / exprs) / 'default') ':' stmts)* '}' / 'switch' nsimple ';' '{' (('case' (types / exprs) / 'default') ':' stmts)* '}'
types = (type) (',' type)* &':'
select = 'select' '{' (('case' simple / 'default') ':' stmts)* '}'
for = 'for' ((nexprs (':=' / '='))? 'range' nexpr / nsimple? ';' nexpr? ';' nsimple? / nexpr)? block
exprs = expr (',' expr)*
nexprs = nexpr (',' nexpr)*
expr = unary (binop unary)*
nexpr = nunary (binop nunary)*
binop = '||' / '&&' / '==' / '!=' / '<=' / '<<' / '<' / '>=' / '>' '>' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '&^' / '&'
unary = ('+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~') unary / primary suffix*
nunary = ('+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~') nunary / nprimary nsuffix*
primary = lit / 'func' signature block / 'func' signature / comptype value / '(' (expr / type) ')' / ID / &('[' / 'map' / 'chan' / 'struct' / 'interface' / '*') type
nprimary = lit / 'func' signature block / &('[' / 'map' / 'struct') comptype value / '(' (expr / type) ')' / ID / &('[' / 'map' / 'chan' / 'struct' / 'interface') type
lit = NUM / STR / CHR
comptype = struct / '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / ID ('.' ID)? ('[' type (',' type)* ']')?
value = '{' (elem (',' elem)* ','?)? '}'
elem = (value / expr) (':' (value / expr))?
suffix = '.' ('(' ('type' / type) ')' / ID value? ) / '[' (index ':' / expr (',' type)* ','? / type (',' type)* ','?) ']' value? / '[' slice ']' / args
nsuffix = '.' ('(' ('type' / type) ')' / ID) / '[' expr (',' type)* ','? ']' / '[' type (',' type)* ','? ']' / '[' slice ']' / args
index = '.' '.' '.'
slice = expr? ':' expr? (':' expr)?
args = '(' (arg (',' arg)* '...'? ','?)? ')'
arg = expr / type
"""

_PY = r"""
file = stmts EOF
stmts = stmt*
stmt = compound / simples
simples = simple (';' simple)* ';'? NEWLINE
block = NEWLINE INDENT stmt+ DEDENT / simples
simple = 'pass' / 'break' / 'continue' / 'return' stars? / 'raise' (expr ('from' expr)?)? / 'global' names / 'nonlocal' names / 'del' deltargets &(';' / NEWLINE) / 'assert' expr (',' expr)? / import / typealias / assignment / stars
names = ID (',' ID)*
deltargets = deltarget (',' deltarget)* ','?
deltarget = place / ID / '(' deltarget ')' / '(' deltargets? ')' / '[' deltargets? ']'
import = 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' impas (',' impas)* ','? ')' / impas (',' impas)*)
dotted = ID ('.' ID)*
impas = ID ('as' ID)?
typealias = 'type' ID typeparams? '=' expr
assignment = (place / ID / '(' single ')') ':' expr ('=' (yield / stars))? / single augop (yield / stars) / (targets '=')+ (yield / stars) !'='
single = place / ID / '(' single ')'
augop = '+=' / '-=' / '*=' / '@=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**=' / '//='
targets = startarget (',' startarget)* ','?
startarget = '*' target / target
target = place / ID / '(' target ')' / '(' (startarget ',' targets?)? ')' / '[' targets? ']'
place = atom (trailer &more)* ('.' ID / '[' slices ']') !more
more = '.' / '(' / '['
compound = decorated / func / class / if / while / for / try / with / match / 'async' (func / for / with)
decorated = ('@' named NEWLINE)+ ('async'? func / class)
func = 'def' ID typeparams? '(' params? ')' ('->' expr)? ':' block
typeparams = '[' typeparam (',' typeparam)* ','? ']'
typeparam = '*' ID ('=' star)? / '**' ID ('=' expr)? / ID (':' expr)? ('=' expr)?
params = pslash / pmain
pslash = pplain (',' pplain)* ',' '/' (',' pmain?)? / (pplain ',')* pvalue (',' pvalue)* ',' '/' (',' (pvalues ','?)?)?
pmain = pplain (',' pplain)* (',' pvalues)? ','? / pvalues ','?
pvalues = pvalue (',' pvalue)* (',' pstar)? / pstar
pstar = '*' (ID (':' '*'? expr)? (',' param)* / (',' param)+) (',' pkw)? / pkw
pkw = '**' ID (':' expr)?
pplain = ID (':' expr)? !'='
pvalue = ID (':' expr)? '=' expr
param = ID (':' expr)? ('=' expr)?
class = 'class' ID typeparams? ('(' (args ','?)? ')')? ':' block
if = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while = 'while' named ':' block ('else' ':' block)?
for = 'for' targets 'in' stars ':' block ('else' ':' block)?
try = 'try' ':' block ((except+ / exceptstar+) ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
except = 'except' (expr ('as' ID / (',' expr)*))? ':' block
exceptstar = 'except' '*' expr ('as' ID / (',' expr)*) ':' block
with = 'with' ('(' withitem (',' withitem)* ','? ')' ':' / withitem (',' withitem)* ':') block
withitem = expr 'as' startarget &(',' / ')' / ':') / expr
match = 'match' subject ':' NEWLINE INDENT case+ DEDENT
subject = named (',' named)* ','? / '*' expr ',' 
case = 'case' cpats ('if' named)? ':' block
cpats = cpat (',' cpat)* ','?
cpat = '*' ID / corpat ('as' ID)?
corpat = cprim ('|' cprim)*
cprim = '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / '(' cpats? ')' / '[' cpats? ']' / '{' (ckey (',' ckey)* ','?)? '}' / dotted ('(' (cargs)? ')')?
ckey = '**' ID / (('-'? NUM / STR+ / 'None' / 'True' / 'False' / dotted) ':' cpat)
cargs = carg (',' carg)* ','?
carg = ID '=' cpat / cpat
stars = yield / sole (',' sole)* ','?
sole = '*' bitor / expr !':='
star = '*' bitor / named
yield = 'yield' ('from' expr / stars)?
named = ID ':=' expr / expr !':='
expr = lambda / or ('if' or 'else' expr)?
lambda = 'lambda' lparams? ':' expr
lparams = lslash / lmain
lslash = lplain (',' lplain)* ',' '/' (',' lmain?)? / (lplain ',')* lvalue (',' lvalue)* ',' '/' (',' (lvalues ','?)?)?
lmain = lplain (',' lplain)* (',' lvalues)? ','? / lvalues ','?
lvalues = lvalue (',' lvalue)* (',' lstar)? / lstar
lstar = '*' (ID (',' lparam)* / (',' lparam)+) (',' lkw)? / lkw
lkw = '**' ID
lplain = ID !'='
lvalue = ID '=' expr
lparam = ID ('=' expr)?
or = and ('or' and)*
and = not ('and' not)*
not = 'not' not / compare
compare = bitor (compop bitor)*
compop = '==' / '!=' / '<=' / '>=' / '<' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
bitor = unary (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@') unary)*
unary = ('+' / '-' / '~') unary / power
power = 'await'? atom trailer* ('**' unary)?
trailer = '.' ID / '(' (args ','? ')' / named compfor ')' / ')') / '[' slices ']'
slices = slice (',' slice)* ','?
slice = expr? ':' expr? (':' expr?)? / '*' bitor / named
args = arg (',' arg)* (',' kwargs)? / kwargs
kwargs = kwarg (',' kwarg)* (',' kwpart (',' kwpart)*)? / kwpart (',' kwpart)*
arg = ('*' expr / named) !'='
kwarg = ID '=' expr / '*' expr
kwpart = ID '=' expr / '**' expr
compfor = ('async'? 'for' targets 'in' or ('if' orl)*)+
orl = or !'else'
atom = ID / NUM / string / 'None' / 'True' / 'False' / '...' / group / list / dictset
string = (STR field*)+
field = FB (yield / stars) field* FE field*
group = '(' (yield / named compfor / star ',' (star (',' star)* ','?)? / named)? ')'
list = '[' (named compfor / star (',' star)* ','?)? ']'
dictset = '{' (expr ':' expr compfor / pair (',' pair)* ','? / named compfor / star (',' star)* ','?)? '}'
pair = '**' bitor / expr ':' expr
"""

_RUST = r"""
file = inner* item* EOF
inner = '#' '!' '[' tree* ']'
outer = '#' '[' tree* ']'
tree = '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / ID / KW / NUM / STR / CHR / LIFE / RAW / sign
sign = !'(' !')' !'[' !']' !'{' !'}' OP
item = outer* vis? (macrorules / use / mod / fn / struct / enum / union / const / static / typealias / trait / impl / extern / macroitem)
vis = 'pub' ('(' ('crate' / 'self' / 'super' / 'in' path) ')')? / 'crate' !'::'
use = 'use' usetree ';'
usetree = ('::')? ('*' / '{' (usetree (',' usetree)* ','?)? '}') / '::'? seg ('::' seg)* ('::' ('*' / '{' (usetree (',' usetree)* ','?)? '}'))? ('as' (ID / '_'))?
seg = ID / RAW / 'self' / 'super' / 'crate' / 'Self'
mod = 'unsafe'? 'mod' ID (';' / '{' inner* item* '}')
fn = fnquals 'fn' name generics? '(' (fparam (',' fparam)* ','?)? ')' ('->' type)? where? (block / ';')
name = ID / RAW
fnquals = ('const' / 'async' / 'unsafe' / 'safe' / 'extern' STR?)*
fparam = outer* (('&' LIFE?)? 'mut'? 'self' (':' type)? / pattern ':' type / '...' / type)
generics = '<' (gparam (',' gparam)* ','?)? '>'
gparam = outer* (LIFE (':' LIFE ('+' LIFE)*)? / 'const' ID ':' type ('=' (block / '-'? lit / ID))? / ID (':' bounds?)? ('=' type)?)
bounds = bound ('+' bound)* '+'?
bound = LIFE / '(' bound ')' / ('?' / '~' 'const' / 'const' / 'async')* ('for' generics)? path / 'use' '<' (LIFE / ID / 'Self' / ',')* '>'
where = 'where' (wherepred (',' wherepred)* ','?)?
wherepred = LIFE ':' (LIFE ('+' LIFE)*)? / ('for' generics)? type ':' bounds?
struct = 'struct' name generics? (where? '{' fields '}' / '(' tfields ')' where? ';' / where? ';')
fields = (field (',' field)* ','?)?
field = outer* vis? name ':' type
tfields = (outer* vis? type (',' outer* vis? type)* ','?)?
enum = 'enum' name generics? where? '{' (variant (',' variant)* ','?)? '}'
variant = outer* vis? name ('{' fields '}' / '(' tfields ')')? ('=' expr)?
union = 'union' name generics? where? '{' fields '}'
const = 'const' (name / '_') ':' type ('=' expr)? ';'
static = 'unsafe'? 'static' 'mut'? name ':' type ('=' expr)? ';'
typealias = 'type' name generics? (':' bounds)? where? ('=' type)? where? ';'
trait = 'unsafe'? 'auto'? 'trait' name generics? (':' bounds?)? where? ('=' bounds ';' / '{' inner* item* '}')
impl = 'unsafe'? 'impl' generics? 'const'? ('!'? type 'for')? type where? '{' inner* ('default'? item)* '}'
extern = 'extern' 'crate' (name / 'self') ('as' (name / '_'))? ';' / 'unsafe'? 'extern' STR? '{' inner* item* '}'
macrorules = 'macro_rules' '!' ID delim ';'?
macroitem = path '!' ID? ('{' tree* '}' / ('(' tree* ')' / '[' tree* ']') ';')
delim = '(' tree* ')' / '[' tree* ']' / '{' tree* '}'
path = '::'? pseg ('::' pseg)*
pseg = (seg) ('::'? gargs / '(' (type (',' type)* ','?)? ')' ('->' type)?)? / '<' type ('as' path)? '>'
gargs = '<' (garg (',' garg)* ','?)? '>'
garg = LIFE / ID gargs? '=' type / ID gargs? ':' bounds / type / block / '-'? lit
type = 'impl' bounds / 'dyn' bounds / '(' (type (',' type)* ','?)? ')' / '!' / '*' ('const' / 'mut') type / '&' LIFE? 'mut'? type / '&&' LIFE? 'mut'? type / '[' type (';' expr)? ']' / '_' / ('for' generics)? fnquals 'fn' '(' ((outer* ((ID / '_') ':')? type / '...') (',' (outer* ((ID / '_') ':')? type / '...'))* ','?)? ')' ('->' type)? / path ('!' delim)? ('+' bounds)? / 'for' generics path
block = '{' inner* stmt* expr? '}'
stmt = ';' / let / item &sep / item / outer* blocklike !('.' / '?') ';'? / outer* macrostmt / outer* expr ';'
sep = '}' / ID
macrostmt = path '!' '{' tree* '}' !('.' / '?') ';'?
let = outer* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';'
blocklike = (LIFE ':')? ('unsafe' block / 'const' block / 'async' 'move'? block / 'loop' block / 'while' cexpr block / 'for' pattern 'in' nexpr block / block) / if / match
if = 'if' cexpr block ('else' (if / block))?
cexpr = nexpr
match = 'match' nexpr '{' inner* arm* '}'
arm = outer* '|'? pattern ('if' expr)? '=>' (block !('.' / '?' / binop) ','? / expr (',' / &'}'))
pattern = '|'? pat ('|' pat)*
pat = '..=' patend / '..' / '_' / '&' 'mut'? pat / '&&' 'mut'? pat / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / 'box' pat / ('ref' / 'mut')* ID !('::' / '(' / '{' / '!' / '..' / '..=' / '...') ('@' pat)? / patend (('..=' / '...') patend / '..' patend?)? / path ('(' (pattern (',' pattern)* ','?)? ')' / '{' (fpat (',' fpat)* ','?)? '}') / path '!' delim / path
patend = '-'? lit / path !('(' / '{' / '!')
fpat = outer* ('..' / (name / NUM) ':' pattern / 'box'? 'ref'? 'mut'? name)
lit = NUM / STR / CHR / 'true' / 'false'
expr = closure / 'return' expr? / 'break' LIFE? expr? / 'continue' LIFE? / 'yield' expr? / 'become' expr / range
range = ('..' / '..=') or? / or ('..' or? / '..=' or)? (assignop expr)?
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>='
or = unary ('as' type / binop (unary / closure / jump))*
jump = 'return' expr? / 'break' LIFE? expr? / 'continue' LIFE?
binop = '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '<=' / '<<' / '<' / '>=' / '>' '>' / '>' / '&&' / '||' / '&' / '|' / '^'
unary = ('-' / '*' / '!') unary / ('&' / '&&') ('raw' ('const' / 'mut'))? 'mut'? (unary) / 'let' pattern '=' unary / primary suffix*
closure = outer* ('for' generics)? 'static'? 'async'? 'move'? ('||' / '|' (cparam (',' cparam)* ','?)? '|') ('->' type block / expr)
cparam = outer* pat (':' type)?
suffix = '.' ('await' / (seg / NUM) ('::' gargs)? args? ) / args / '[' expr ']' / '?'
args = '(' (outer* expr (',' outer* expr)* ','?)? ')'
primary = lit / blocklike / '(' (outer* expr (',' outer* expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?)?)? ']' / path '!' delim / path structlit / path / '_'
structlit = '{' (sfield (',' sfield)* ','?)? '}'
sfield = outer* ('..' expr? / (name / NUM) ':' expr / name)
nexpr = nclosure / nrange
nclosure = 'move'? ('||' / '|' (cparam (',' cparam)* ','?)? '|') nexpr / 'return' nexpr? / 'break' LIFE? nexpr? / 'continue' LIFE?
nrange = ('..' / '..=') nor? / nor ('..' nor? / '..=' nor)? (assignop nexpr)?
nor = nunary ('as' type / binop nunary)*
nunary = ('-' / '*' / '!') nunary / ('&' / '&&') 'mut'? nunary / 'let' pattern '=' nunary / nprimary suffix*
nprimary = lit / blocklike / '(' (expr (',' expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?)?)? ']' / path '!' delim / path / '_'
"""

_SWIFT = r"""
file = stmts EOF
stmts = (stmt semi)*
semi = ';'+ / ^ / &'}' / &EOF / &'case' / &'default'
block = '{' stmts '}'
stmt = directive / decl / if / guard / for / 'while' conds block / 'repeat' block 'while' expr / switch / do / 'defer' block / 'return' (~ !'}' expr)? / 'throw' expr / ('break' / 'continue') (~ ID)? / 'fallthrough' / ID ':' (for / 'while' conds block / switch / 'repeat' block 'while' expr / if / do) / expr
directive = AT (~ (ID / '(' / ')' / NUM / STR / '&&' / '||' / '!' / ',' / ':' / '.' / '>=' / '<'))*
attr = '@' ID (~ '(' balanced* ')')?
balanced = '(' balanced* ')' / '[' balanced* ']' / '{' balanced* '}' / !'(' !')' !'[' !']' !'{' !'}' (ID / KW / NUM / STR / OP / SB / SM / SE / AT)
mod = attr / ('public' / 'private' / 'fileprivate' / 'internal' / 'open' / 'package') ('(' 'set' ')')? / 'static' / 'class' &(mod / 'func' / 'var' / 'let' / 'subscript') / 'final' / 'override' / 'mutating' / 'nonmutating' / 'lazy' / 'weak' / 'unowned' ('(' ID ')')? / 'required' / 'convenience' / 'optional' / 'indirect' / 'dynamic' / 'prefix' / 'postfix' / 'infix' / 'async' &'let' / 'nonisolated' ('(' ID ')')? / 'isolated' / 'distributed' / 'borrowing' / 'consuming'
decl = (mod !('=' / '.' / '(' / '+='))* (import / var / func / typedecl / enum / extension / protocol / init / 'deinit' block / subscript / typealias / opdecl)
import = 'import' ('typealias' / 'struct' / 'class' / 'enum' / 'protocol' / 'let' / 'var' / 'func')? ID ('.' ID)*
var = ('let' / 'var') vbind (',' vbind)*
vbind = pattern (':' type)? (~ '=' expr / '=' expr)? accessors?
accessors = ~ '{' (attr / mod)* accessor+ '}' / ~ block
accessor = (mod)* ('get' ('async' / 'throws' throwtype?)* / 'set' ('(' ID ')')? / 'willSet' ('(' ID ')')? / 'didSet' ('(' ID ')')? / '_read' / '_modify') block? ';'?
pattern = ('let' / 'var') pattern / '(' (tpat (',' tpat)*)? ')' / 'is' type / '_' / ID
tpat = (ID ':')? pattern
func = 'func' (ID / operator) generics? params effects ('->' type)? where? block?
operator = ('+' / '-' / '*' / '/' / '%' / '=' / '<' / '>' / '!' / '&' / '|' / '^' / '~' / '?' / '==' / '!=' / '<=' / '>=' / '===' / '!==' / '&&' / '||' / '<<' / '...' / '..<' / '+=' / '-=' / '*=' / '/=' / '??' / '++' / '--' / '~=' / '.')+
effects = ('async' / 'throws' throwtype? / 'rethrows' / 'reasync')*
throwtype = ~ '(' type ')'
params = '(' (param (',' param)* ','?)? ')'
param = attr* (ID / KW / '_') (ID / '_')? ':' type '...'? ('=' expr)?
generics = '<' gparam (',' gparam)* ','? '>'
gparam = 'each'? 'let'? ID (':' type)?
where = 'where' wreq (',' wreq)*
wreq = type ('==' / ':') type / expr
typedecl = ('class' / 'struct' / 'actor') ID generics? (':' type (',' type)*)? where? members
members = '{' (member semi)* '}'
member = directive / decl
enum = 'enum' ID generics? (':' type (',' type)*)? where? '{' ((enumcase / member) semi)* '}'
enumcase = mod* 'case' ecase (',' ecase)*
ecase = ID ('(' (eparam (',' eparam)*)? ')')? ('=' expr)?
eparam = ((ID / '_') ID? ':')? type ('=' expr)?
extension = 'extension' type (':' type (',' type)*)? where? members
protocol = 'protocol' ID ('<' ID (',' ID)* '>')? (':' type (',' type)*)? where? '{' ((assoc / member) semi)* '}'
assoc = mod* 'associatedtype' ID (':' type (',' type)*)? ('=' type)? where?
init = 'init' ('?' / '!')? generics? params effects where? block?
subscript = 'subscript' generics? params '->' type where? accessors?
typealias = 'typealias' ID generics? '=' type where?
opdecl = ('operator' / 'precedencegroup') (ID / operator) (':' ID)? ('{' balanced* '}')?
type = attr* ('inout' / 'some' / 'any' / 'borrowing' / 'consuming' / '__owned' / 'sending' / 'isolated' / 'each' / 'repeat' / '~')* typebase tsuffix* ('&' type)? (effects '->' type)?
tsuffix = ~ '?' / ~ '!' / ~ '??' / '.' (ID / 'Type' / 'Protocol') typeargs?
typebase = '(' (ttype (',' ttype)*)? ')' / '[' type (':' type)? ']' / ('Self' / 'Any' / '_') / ID typeargs?
ttype = ((ID / '_' / KW) (ID / '_')? ':')? type '...'? ('=' expr)?
typeargs = ~ '<' type (',' type)* '>'
conds = cond (',' cond)*
cond = 'case' cpattern (':' type)? '=' expr0 / ('let' / 'var') (pattern) (':' type)? ('=' expr0)? / AT '(' balanced* ')' / expr0
if = 'if' conds block ('else' (if / block))?
guard = 'guard' conds 'else' block
for = 'for' ('try' / 'await')* 'case'? cpattern (':' type)? 'in' expr0 ('where' expr0)? block
switch = 'switch' expr0 '{' (directive? case)* '}'
case = attr? ('case' citem (',' citem)* / 'default') ':' stmts
citem = cpattern ('where' expr)?
cpattern = ('let' / 'var') cpattern / 'is' type / expr
do = 'do' ('throws' throwtype?)? block catch*
catch = 'catch' (citem (',' citem)*)? block
expr = ('try' ('?' / '!')? / 'await' / 'consume' / 'copy' / 'each' / 'repeat')* seq
seq = unary (bin)*
bin = assign expr / binop ('try' ('?' / '!')? / 'await')* unary / ternary / 'is' type / 'as' ('?' / '!')? type
ternary = '?' expr ':' expr
assign = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>='
binop = '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '===' / '!==' / '<=' / '<<' / '<' / '>=' / '>' '>' / '>' / '&&' / '||' / '??' / '&' / '|' / '^' / '...' / '..<' / '&+' / '&-' / '&*' / '~='
unary = ('-' / '+' / '!' / '~' / '&' / '...' / '..<' / '++' / '--') unary / postfix
postfix = primary suffix*
suffix = '.' (ID / KW / NUM) typeargs2? / ~ args / ~ '[' (arg (',' arg)* ','?)? ']' / ~ '?' !(unary ':') / ~ '!' / ~ closure tclosure* / ~ ('++' / '--') / ~ '...' !(ID / NUM / '(')
tclosure = ~ ID ':' closure
typeargs2 = ~ '<' type (',' type)* '>' &('(' / '.' / ')' / ',' / '{')
args = '(' (arg (',' arg)* ','?)? ')'
arg = (ID / KW / '_') ':' (expr / operator) / expr / operator
closure = '{' csig? stmts '}'
csig = attr* capture? (params2 / ID (',' ID)* / '_' (',' (ID / '_'))*) effects ('->' type)? 'in' / capture 'in'
capture = '[' (('weak' / 'unowned' ('(' ID ')')?)? (ID / 'self') ('=' expr)? (',' ('weak' / 'unowned' ('(' ID ')')?)? (ID / 'self') ('=' expr)?)*)? ']'
params2 = '(' (param2 (',' param2)*)? ')'
param2 = attr* (ID / '_') (ID / '_')? (':' type '...'?)?
string = STR / SB (arg (',' arg)*)? (SM (arg (',' arg)*)?)* SE
primary = NUM / string / 'true' / 'false' / 'nil' / 'self' / 'Self' / 'super' / 'init' / 'Any' / closure / '.' (ID / KW) / AT (~ '(' balanced* ')')? / '\\' typebase? ('.' (ID / NUM / 'self') / '[' arg (',' arg)* ']' / '?' / '!')* / '(' (arg (',' arg)* ','?)? ')' / '[' (arg (',' arg)* ','?)? ']' / '[' ':' ']' / '[' pair (',' pair)* ','? ']' / if / switch / '_' / ID typeargs2? / attr / ('let' / 'var') pattern
pair = expr ':' expr
expr0 = ('try' ('?' / '!')? / 'await')* seq0
seq0 = unary0 (bin0)*
bin0 = assign expr0 / binop ('try' ('?' / '!')? / 'await')* unary0 / '?' expr0 ':' expr0 / 'is' type / 'as' ('?' / '!')? type
unary0 = ('-' / '+' / '!' / '~' / '&' / '...' / '..<') unary0 / primary0 suffix0*
primary0 = !'{' primary
suffix0 = '.' (ID / KW / NUM) typeargs2? / ~ args / ~ '[' (arg (',' arg)* ','?)? ']' / ~ '?' !(unary ':') / ~ '!' / ~ ('++' / '--')
"""

_KOTLIN = r"""
file = fileanno* (package semis)? (import semis)* (decl semis)* EOF
fileanno = '@' 'file' ':' (annobody / '[' annobody+ ']')
semis = ';'+ / ^ ';'* / &'}' / &EOF
package = anno* 'package' ident
ident = sid ('.' sid)*
sid = ID
import = 'import' ident ('.' '*' / 'as' ID)?
anno = '@' (('field' / 'property' / 'get' / 'set' / 'receiver' / 'param' / 'setparam' / 'delegate') ':')? ('[' annobody+ ']' / annobody)
annobody = utype (~ args)?
mod = anno / ('public' / 'private' / 'internal' / 'protected' / 'abstract' / 'final' / 'open' / 'sealed' / 'override' / 'lateinit' / 'const' / 'suspend' / 'inline' / 'noinline' / 'crossinline' / 'tailrec' / 'operator' / 'infix' / 'external' / 'enum' / 'annotation' / 'data' / 'inner' / 'companion' / 'vararg' / 'expect' / 'actual' / 'value' / 'fun' &'interface' / 'reified' / 'out' / 'in') &(mod / 'class' / 'interface' / 'object' / 'fun' / 'val' / 'var' / 'typealias' / 'constructor' / ID / '@')
decl = mod* (class / object / fun / prop / typealias)
class = ('class' / 'interface') ID typeparams? (mod* 'constructor'? cparams)? (':' supers)? where? classbody?
cparams = '(' (cparam (',' cparam)* ','?)? ')'
cparam = mod* ('val' / 'var')? ID ':' type ('=' expr)?
supers = super (',' super)*
super = anno* (type 'by' expr / type args?)
classbody = '{' enumentries? (member semis)* '}'
enumentries = enumentry (',' enumentry)* ','? (';' / &'}')
enumentry = mod* ID args? classbody? &(',' / ';' / '}')
member = mod* 'init' block / mod* 'companion' 'object' ID? (':' supers)? classbody? / mod* 'constructor' params (':' ('this' / 'super') args)? block? / decl
object = 'object' ID (':' supers)? classbody?
fun = 'fun' typeparams? (rtype '.')? ID? params (':' type)? where? (block / '=' expr)?
rtype = anno* ('(' type ')' / utype1) '?'?
utype1 = ID targs? ('.' ID targs? &'.')*
params = '(' (param (',' param)* ','?)? ')'
param = mod* ID ':' type ('=' expr)?
prop = ('val' / 'var') typeparams? (rtype '.')? (destruct / vdecl) where? ('=' expr / 'by' expr)? ';'? (getter setter? / setter getter?)?
getter = mod* 'get' ('(' ')' (':' type)? (block / '=' expr))? 
setter = mod* 'set' ('(' ID (':' type)? ','? ')' (':' type)? (block / '=' expr))?
destruct = '(' vdecl (',' vdecl)* ','? ')'
vdecl = anno* (ID / '_') (':' type)?
typealias = 'typealias' ID typeparams? '=' type
typeparams = '<' typeparam (',' typeparam)* ','? '>'
typeparam = mod* ID (':' type)?
where = 'where' ID ':' type (',' ID ':' type)*
type = (anno / 'suspend')* (functype / basetype) ('&' type)?
functype = (rtype '.')? '(' (ftype (',' ftype)* ','?)? ')' '->' type
ftype = (ID ':')? type
basetype = ('(' type ')' / utype / 'dynamic') ('?' / '!!')*
utype = ID targs? ('.' ID targs?)*
targs = '<' targ (',' targ)* ','? '>'
targ = '*' / ('in' / 'out')? type
block = '{' (stmt semis)* '}'
stmt = label* (decl / for / while / dowhile / assign / expr)
label = ID '@'
for = 'for' '(' anno* (destruct / vdecl) 'in' expr ')' (block / stmt / ';')
while = 'while' '(' expr ')' (block / stmt / ';')
dowhile = 'do' (block / stmt)? 'while' '(' expr ')'
assign = postfix ('=' / '+=' / '-=' / '*=' / '/=' / '%=') expr
expr = or
or = binary
binary = unary (bin)*
bin = ~ ('*' / '/' / '%' / '+' / '-' / '..' / '..<' / '<' / '<=' / '>' / '>=' / '==' / '!=' / '===' / '!==' / 'in' / '!in') unary / ('&&' / '||' / '?:') unary / ('as' '?'? / 'is' / '!is') type / ~ infix unary
infix = ID !('=' / '+=' / '-=' / '*=' / '/=' / '%=' / ')' / ',' / ';')
unary = (anno / label / ('-' / '+' / '!' / '++' / '--'))* postfix
postfix = primary suffix*
suffix = ~ ('++' / '--' / '!!') / ('.' / '?.') (ID / 'class' / primaryp) / '::' (ID / 'class') / ~ targs &('(' / '{' / '::') / ~ args / ~ '[' (expr (',' expr)* ','?)? ']' / ~ label? lambda / '?' &'::'
primaryp = '(' expr ')'
args = '(' (arg (',' arg)* ','?)? ')'
arg = anno? (ID '=')? '*'? expr
lambda = '{' (lparams '->')? (stmt semis)* '}'
lparams = (lparam (',' lparam)* ','?)?
lparam = vdecl / destruct (':' type)?
string = STR / SB stmt? (SM stmt?)* SE
primary = '(' expr ')' / NUM / string / CHR / 'true' / 'false' / 'null' / lambda / 'suspend'? anonfun / mod* 'object' (':' supers)? classbody / 'this' at? / 'super' ('<' type '>')? at? / if / when / try / jump / '[' (expr (',' expr)* ','?)? ']' / '::' (ID / 'class') / ID
at = ~ '@' ID
anonfun = 'fun' (type '.')? params (':' type)? where? (block / '=' expr)?
if = 'if' '(' expr ')' ((block / stmt)? ';'? 'else' (block / stmt / ';') / block / stmt / ';')
when = 'when' ('(' (anno* 'val' vdecl '=')? expr ')')? '{' whenentry* '}'
whenentry = (wcond (',' wcond)* ','? / 'else') ('if' expr)? '->' (block / stmt) semis?
wcond = ('in' / '!in') expr / ('is' / '!is') type / expr
try = 'try' block (catch+ finally? / finally)
catch = 'catch' '(' anno* (ID / '_') ':' type ','? ')' block
finally = 'finally' block
jump = 'throw' expr / 'return' at? (~ expr)? / ('continue' / 'break') at?
"""

_DART = r"""
file = meta* (library / part)* (import / part)* top* EOF
meta = '@' qual targs? args?
qual = ID ('.' (ID / 'new'))*
library = meta* ('library' qual? / 'part' 'of' (qual / string)) ';'
part = meta* 'part' string ';'
import = meta* ('import' 'augment'? string config* ('deferred'? 'as' ID)? comb* / 'export' string config* comb*) ';'
config = 'if' '(' qual ('==' string)? ')' string
comb = ('show' / 'hide') ID (',' ID)*
string = (STR / SB expr? (SM expr?)* SE)+
top = meta* (class / mixin / enum / extension / typedef / 'external'? function / topvar)
topvar = 'external'? 'late'? ('final' / 'const') (type &ID)? inits ';' / 'external'? 'late'? ('var' / type) ids ';'
inits = ID ('=' expr)? (',' ID ('=' expr)?)*
ids = ID ('=' expr)? (',' ID ('=' expr)?)*
class = ('abstract' / 'base' / 'interface' / 'final' / 'sealed' / 'mixin' / 'augment' / 'macro')* 'class' ID tparams? ('=' type 'with' types ('implements' types)? ';' / ('extends' type)? ('with' types)? ('implements' types)? body)
mixin = 'base'? 'mixin' ID tparams? ('on' types)? ('implements' types)? body
extension = 'extension' ('type' 'const'? ID tparams? ('.' ID)? '(' meta* 'final'? type ID ')' ('implements' types)? body / ID? tparams? 'on' type body)
enum = 'enum' ID tparams? ('with' types)? ('implements' types)? '{' (enumval (',' enumval)*)? ','? (';' member*)? '}'
enumval = meta* ID (targs? ('.' ID)? args)?
typedef = 'typedef' (ID tparams? '=' type / (type &ID)? ID tparams? params) ';'
types = type (',' type)*
tparams = '<' meta* tparam (',' meta* tparam)* '>'
tparam = ID ('extends' type)?
targs = '<' type (',' type)* '>'
type = (functype0 / record / ('void' / ID ('.' ID)?) targs? '?'?) funcsuffix*
functype0 = 'Function' tparams? fparams '?'?
funcsuffix = 'Function' tparams? fparams '?'?
fparams = '(' (fp (',' fp)* ','?)? (('[' fp (',' fp)* ','? ']' / '{' nfp (',' nfp)* ','? '}'))? ')'
fp = meta* type ID? &(',' / ')' / ']' / '[' / '{') ','?
nfp = meta* 'required'? type ID
record = '(' (rfield (',' rfield)* ','?)? ('{' meta* type ID (',' meta* type ID)* ','? '}')? ')' '?'?
rfield = meta* type ID?
body = '{' member* '}'
member = meta* ('external' / 'static' / 'abstract' / 'covariant' / 'augment')* (ctor / method / field)
ctor = 'const'? 'factory'? ID ('.' (ID / 'new'))? params (':' minit (',' minit)*)? (fbody / ';') / 'const'? 'factory' ID ('.' ID)? params '=' type ('.' ID)? ';' / 'const' ID ('.' ID)? params (':' minit (',' minit)*)? ';'
minit = 'super' ('.' (ID / 'new'))? args / 'this' ('.' (ID / 'new'))? args / ('this' '.')? ID '=' !'{' expr0 / 'assert' '(' expr (',' expr)? ','? ')'
expr0 = expr
method = type? 'get' ID (fbody / ';') / type? 'set' ID params (fbody / ';') / type? 'operator' opname params (fbody / ';') / (type &(ID ('(' / '<')))? ID tparams? params (fbody / ';')
opname = '[' ']' '='? / '==' / '<=' / '>=' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '~/' / '&' / '|' / '^' / '~'
field = 'late'? ('final' / 'const') (type &ID)? ids ';' / 'late'? 'var' ids ';' / 'late'? 'covariant'? type ids ';'
function = type? 'get' ID (fbody / ';') / type? 'set' ID params (fbody / ';') / (type &(ID ('(' / '<')))? ID tparams? params (fbody / ';')
fbody = ('async' '*'? / 'sync' '*')? (block / '=>' expr ';') / 'native' STR? ';'
params = '(' (plist ','?)? ')'
plist = param (',' param)* (',' popt)? / popt
popt = '[' param (',' param)* ','? ']' / '{' param (',' param)* ','? '}'
param = meta* ('required' / 'covariant' / 'final' / 'var' / 'const' / 'late')* (type &(ID / 'this' / 'super'))? (('this' / 'super') '.')? ID (tparams? params '?'?)? (('=' / ':') expr)?
block = '{' stmt* '}'
stmt = block / ';' / ID ':' stmt / if / for / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';' / switch / try / 'return' expr? ';' / ('break' / 'continue') ID? ';' / 'assert' '(' expr (',' expr)? ','? ')' ';' / 'yield' '*'? expr ';' / localfunc / localvar ';' / patvar ';' / expr ';'
localvar = meta* 'late'? (('final' / 'const') (type &ID)? / 'var' / type &ID) ids
patvar = ('final' / 'var') pattern '=' expr
localfunc = meta* (type &(ID ('(' / '<')))? ID tparams? params (('async' '*'? / 'sync' '*')? block / 'async'? '=>' expr ';')
if = 'if' '(' expr ('case' pattern ('when' expr)?)? ')' stmt ('else' stmt)?
for = 'await'? 'for' '(' (meta* ('final' / 'var' / 'const')? (type &ID)? ID 'in' expr / ('final' / 'var') pattern 'in' expr / (localvar / patvar / expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)?) ')' stmt
switch = 'switch' '(' expr ')' '{' ((ID ':')* ('case' pattern ('when' expr)? / 'default') ':' stmt*)* '}'
try = 'try' block ((on+ finally?) / finally)
on = ('on' type ('catch' '(' ID (',' ID)? ')')? / 'catch' '(' ID (',' ID)? ')') block
finally = 'finally' block
pattern = rpat (('||' / '&&') rpat)*
rpat = ('==' / '!=' / '<=' / '>=' / '<' / '>') bit / ppat ('?' / '!' / 'as' type)*
ppat = 'const' unary / ('var' / 'final') (type &ID)? ID / (type &ID) ID / qual targs? '(' (pfield (',' pfield)* ','?)? ')' / '(' (pfield (',' pfield)* ','?)? ')' / targs? '[' (pelem (',' pelem)* ','?)? ']' / targs? '{' (expr ':' pattern (',' expr ':' pattern)* ','?)? '}' / bit
pfield = ID? ':' pattern / pattern
pelem = '...' pattern? / pattern
expr = 'throw' expr / lambda / unary assign expr / cond (cascade)*
assign = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '~/=' / '&=' / '|=' / '^=' / '<<=' / '>' '>=' / '>' '>' '>=' / '??='
cond = bit ('?' expr ':' expr)?
bit = unary (('is' '!'? / 'as') type / binop (unary))*
binop = '??' / '||' / '&&' / '==' / '!=' / '<=' / '<<' / '<' / '>=' / '>' '>' '>' / '>' '>' / '>' / '+' / '-' / '*' / '/' / '%' / '~/' / '&' / '|' / '^'
unary = ('-' / '!' / '~' / 'await' / '++' / '--') unary / primary suffix* ('++' / '--')?
lambda = tparams? params ('async' '*'? / 'sync' '*')? ('=>' expr / block)
suffix = ('.' / '?.') (ID / 'new') / '!' !'=' / ('?[' / '[') expr ']' / targs? args / targs !(ID / NUM / '(' / STR / SB)
args = '(' (arg (',' arg)* ','?)? ')'
arg = (ID ':')? expr
cascade = ('..' / '?..') (ID / '[' expr ']') (suffix)* (assign expr)?
primary = NUM / string / 'true' / 'false' / 'null' / 'this' / 'super' / 'new' type ('.' (ID / 'new'))? args / 'const' type ('.' (ID / 'new'))? args / 'const'? targs? list / 'const'? targs? map / 'switch' '(' expr ')' '{' (pattern ('when' expr)? '=>' expr (',' pattern ('when' expr)? '=>' expr)* ','?)? '}' / lambda / '(' (arg (',' arg)* ','?)? ')' / '#' (ID / opname) / 'void' / ID
list = '[' (elem (',' elem)* ','?)? ']'
map = '{' (elem (',' elem)* ','?)? '}'
elem = ('...' / '...?') expr / 'if' '(' expr ('case' pattern ('when' expr)?)? ')' elem ('else' elem)? / 'await'? 'for' '(' (('final' / 'var')? (type &ID)? ID 'in' expr / ('final' / 'var') pattern 'in' expr / (localvar / expr)? ';' expr? ';' (expr (',' expr)*)?) ')' elem / '?'? expr (':' '?'? expr)?
"""

_OBJC = r"""
file = top* EOF
top = ';' / objc / decl / func
objc = interface / implementation / protocol / '@class' / classfwd / atimport
interface = AT ID (':' ID)? targs? ('(' ID? ')')? protos? ivars? imember* AT
implementation = AT ID (':' ID)? ('(' ID ')')? ivars? member* AT
protocol = AT ID protos? imember* AT
classfwd = AT ID (',' ID)* ';'
atimport = AT ID ('.' ID)* ';'
targs = '<' type (',' type)* '>'
protos = '<' ID (',' ID)* '>'
ivars = '{' (AT / ivar)* '}'
ivar = specs declarators ';'
imember = property / mdecl ';' / decl / func / ';'
property = AT ('(' (ID / KW / '=' / ',' / ':')* ')')? specs declarators ';'
mdecl = ('-' / '+') ('(' type ')')? (selpart+ (',' '...')? / (ID / KW)) attribute*
selpart = (ID / KW)? ':' ('(' type ')')? ID
member = mdecl ';'? block / AT (ID ('=' ID)?) (',' ID ('=' ID)?)* ';' / func / decl / ';'
func = specs declarator block
decl = 'typedef' specs declarators? ';' / specs declarators? ';'
specs = (qual)* (tagged / base / ID targs?) qual*
qual = 'const' / 'static' / 'extern' / 'inline' / 'register' / 'volatile' / 'restrict' / 'auto' / '__block' / '__weak' / '__strong' / 'nullable' / 'nonnull' / '_Nullable' / '_Nonnull' / '__kindof' / 'typedef' / attribute
attribute = '__attribute__' '(' '(' balanced* ')' ')'
balanced = '(' balanced* ')' / '[' balanced* ']' / '{' balanced* '}' / !'(' !')' !'[' !']' !'{' !'}' (ID / KW / NUM / STR / CHR / OP / AT)
base = ('void' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double' / 'signed' / 'unsigned' / '_Bool')+
tagged = ('struct' / 'union') ID? ('{' (specs declarators? ';')* '}')? / 'enum' ID? (':' specs)? ('{' (ID ('=' cond)?) (',' ID ('=' cond)?)* ','? '}')?
declarators = declarator ('=' init)? (',' declarator ('=' init)?)*
declarator = (('*' / '^') qual*)* (ID / '(' declarator ')')? dsuffix* attribute* (':' cond)?
dsuffix = '[' expr? ']' / '(' (cparam (',' cparam)*)? (',' '...')? ')'
cparam = specs declarator
type = specs (('*' / '^') qual*)* ('(' ('^' / '*') qual* ID? ')' '(' (cparam (',' cparam)*)? ')')? ('[' expr? ']')*
init = '{' (ielem (',' ielem)* ','?)? '}' / assign
ielem = (('.' ID / '[' cond ']')+ '=')? init
block = '{' stmt* '}'
stmt = block / ';' / ID ':' !':' stmt / 'case' cond ('...' cond)? ':' stmt? / 'default' ':' stmt? / 'if' '(' expr ')' stmt ('else' stmt)? / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';' / 'for' '(' (specs declarator 'in' expr / (decl / expr? ';') expr? ';' expr?) ')' stmt / 'switch' '(' expr ')' stmt / 'return' expr? ';' / 'break' ';' / 'continue' ';' / 'goto' ID ';' / atstmt / expr ';' / decl
atstmt = AT '(' expr ')' block / AT block (AT ('(' (specs declarator / '...') ')')? block)* / AT expr? ';'
expr = assign (',' assign)*
assign = unary assignop assign / cond
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '<<=' / '&=' / '|=' / '^=' / '>' '>='
cond = binary ('?' expr? ':' cond)?
binary = cast (binop cast)*
binop = '+' / '-' / '*' / '/' / '%' / '==' / '!=' / '<=' / '<<' / '<' / '>=' / '>' '>' / '>' / '&&' / '||' / '&' / '|' / '^'
cast = '(' type ')' ('{' (ielem (',' ielem)* ','?)? '}' / cast) / unary
unary = ('++' / '--') unary / ('&' / '*' / '+' / '-' / '~' / '!' / '&&') cast / 'sizeof' ('(' type ')' / unary) / postfix
postfix = primary suffix*
suffix = '[' expr ']' / '(' (assign (',' assign)*)? ')' / ('.' / '->') ID / '++' / '--'
primary = NUM / (STR)+ / CHR / message / array / dict / boxed / blocklit / AT '(' balanced* ')' / '(' (expr / block) ')' / ID
message = '[' (expr) (msgarg+ / (ID / KW)) ']'
msgarg = (ID / KW)? ':' assign (',' assign)*
array = '@' '[' (assign (',' assign)* ','?)? ']'
dict = '@' '{' (assign ':' assign (',' assign ':' assign)* ','?)? '}'
boxed = '@' ('(' expr ')' / '-'? NUM / CHR / ID)
blocklit = '^' type? ('(' (cparam (',' cparam)*)? ')')? block
"""

GRAMMARS = {"js": _JS, "ts": _TS, "tsx": _TS, "java": _JAVA, "go": _GO, "py": _PY, "rs": _RUST, "swift": _SWIFT, "kt": _KOTLIN, "dart": _DART, "objc": _OBJC}


@cache
def grammar(name: str) -> Grammar:
    """The compiled grammar of a language; one for each worker."""
    return Grammar(GRAMMARS[name])
