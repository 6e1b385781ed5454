"""Bundled grammars, in the notation of ``tables.Grammar``.

They recognise: precedence, names and types are of no concern. A terminal in
quotes is a keyword or sign; in capitals a class of the language's lexer.
"""

C = """
unit = ext*
ext = function | declaration | ';' | 'asm' '(' STR+ ')' ';'
function = specs pointer? direct '(' parameters? ')' attribute* block
declaration = specs (initialised % ',')? ';' | '_Static_assert' '(' expr (',' STR)? ')' ';'
initialised = declarator attribute* ('=' initialiser)?
specs = qualifier* core
core = basic (basic | qualifier)* | NAME qualifier* | record qualifier*
qualifier = 'const' | 'volatile' | 'restrict' | 'static' | 'extern' | 'inline' | 'register' | 'typedef' | 'auto' | '_Noreturn' | '_Atomic' | '_Thread_local' | '__inline' | attribute
attribute = '__attribute__' '(' '(' tokens ')' ')' | '_Alignas' '(' tokens ')'
tokens = (NAME | NUM | STR | ',' | '(' tokens ')' | 'const')*
basic = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex'
record = ('struct' | 'union') attribute* (NAME | NAME? '{' field* '}') | 'enum' (NAME | NAME? '{' (NAME ('=' cond)?) % ',' ','? '}')
field = specs ((declarator (':' cond)? | ':' cond) % ',')? ';' | '_Static_assert' '(' expr (',' STR)? ')' ';'
declarator = pointer? direct
pointer = ('*' qualifier*)+
direct = NAME | '(' attribute* declarator ')' | direct '[' subscript? ']' | direct '(' parameters? ')'
subscript = 'static'? qualifier* assign | '*'
parameters = parameter % ',' (',' '...')?
parameter = specs (declarator | abstract)? attribute*
abstract = pointer | pointer? sub
sub = '(' abstract ')' | sub? '[' subscript? ']' | sub? '(' parameters? ')'
typename = specs abstract?
initialiser = assign | '{' ((designator* initialiser) % ',' ','?)? '}'
designator = '[' cond ('...' cond)? ']' '='? | '.' NAME '='?
block = '{' (statement | declaration | function)* '}'
statement = block | expr? ';' | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' (expr? ';' | declaration) expr? ';' expr? ')' statement | 'switch' '(' expr ')' statement | 'case' cond ('...' cond)? ':' (statement | declaration) | 'default' ':' (statement | declaration) | NAME ':' (statement | declaration) | 'goto' NAME ';' | 'break' ';' | 'continue' ';' | 'return' expr? ';' | 'asm' qualifier* '(' STR tokens ')' ';'
expr = assign % ','
assign = cond | unary assignop assign
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
cond = binary ('?' expr? ':' cond)?
binary = unary % binop
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||'
unary = postfix | ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--') unary | 'sizeof' unary | ('sizeof' | '_Alignof') '(' typename ')' | '(' typename ')' unary
postfix = primary | postfix '[' expr ']' | postfix '(' (assign % ',')? ')' | postfix ('.' | '->') NAME | postfix ('++' | '--') | '(' typename ')' '{' ((designator* initialiser) % ',' ','?)? '}'
primary = NAME | NUM | CHAR | STR+ | '(' expr ')' | '(' block ')' | '_Generic' '(' assign ',' ((typename | 'default') ':' assign) % ',' ')'
"""

JAVA = """
unit = (annotation* 'package' qualified ';')? (import | ';')* (type | ';')*
import = 'import' 'static'? qualified ('.' '*')? ';'
qualified = name % '.'
name = NAME | 'var' | 'record' | 'yield' | 'sealed' | 'permits' | 'module'
annotation = '@' qualified ('(' ((name '=' elementvalue) % ',' | elementvalue)? ')')?
elementvalue = cond | annotation | '{' (elementvalue % ',')? ','? '}'
modifier = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed'
type = modifier* (class | interface | enum | record | annotationtype)
class = 'class' name typeparams? ('extends' reftype)? ('implements' reftype % ',')? ('permits' reftype % ',')? body
interface = 'interface' name typeparams? ('extends' reftype % ',')? ('permits' reftype % ',')? body
enum = 'enum' name ('implements' reftype % ',')? '{' (constant % ',')? ','? (';' member*)? '}'
constant = annotation* name arguments? body?
record = 'record' name typeparams? '(' (parameter % ',')? ')' ('implements' reftype % ',')? body
annotationtype = '@' 'interface' name body
body = '{' member* '}'
member = ';' | 'static'? block | type | modifier* typeparams? (typ | 'void') name '(' (parameter % ',')? ')' dims? ('throws' reftype % ',')? (block | 'default' elementvalue ';' | ';') | modifier* typeparams? name '(' (parameter % ',')? ')' ('throws' reftype % ',')? block | modifier* typ declarators ';' | modifier* name block
declarators = (name dims? ('=' varinit)?) % ','
varinit = expr | '{' (varinit % ',')? ','? '}'
parameter = modifier* typ annotation* '...'? (name dims? | 'this')
dims = (annotation* '[' ']')+
typeparams = '<' (annotation* name ('extends' reftype % '&')?) % ',' '>'
typ = reftype | primitive dims?
primitive = 'int' | 'long' | 'short' | 'byte' | 'char' | 'float' | 'double' | 'boolean'
reftype = plaintype dims? | primitive dims
plaintype = annotation* name typeargs? | plaintype '.' annotation* name typeargs?
typeargs = '<' (typearg % ',')? '>'
typearg = reftype | annotation* '?' (('extends' | 'super') reftype)?
block = '{' blockstatement* '}'
blockstatement = statement | modifier* typ declarators ';' | type
statement = block | ';' | expr ';' | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' (modifier* typ declarators | expr % ',')? ';' expr? ';' (expr % ',')? ')' statement | 'for' '(' modifier* typ name dims? ':' expr ')' statement | 'return' expr? ';' | 'break' name? ';' | 'continue' name? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | name ':' statement | 'synchronized' '(' expr ')' block | try | switch
try = 'try' ('(' (resource % ';') ';'? ')')? block ('catch' '(' modifier* (reftype % '|') name ')' block)* ('finally' block)?
resource = modifier* typ name '=' expr | expr
switch = 'switch' '(' expr ')' '{' (oldcase* | newcase*) '}'
oldcase = label ':' blockstatement*
newcase = label '->' (expr ';' | block | 'throw' expr ';')
label = 'case' (caseitem % ',') ('when' expr)? | 'default'
caseitem = cond | pattern | 'default'
pattern = modifier* typ name | reftype '(' (pattern % ',')? ')' name?
expr = cond | unary assignop expr | lambda
lambda = (name | '(' (name % ',')? ')' | '(' (parameter % ',') ')') '->' (expr | block)
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>='
cond = binary ('?' expr ':' (cond | lambda))?
binary = unary | binary binop unary | binary 'instanceof' ('final'? reftype name? | pattern)
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||'
unary = postfix | ('+' | '-' | '!' | '~' | '++' | '--') unary | '(' typ ('&' reftype)* ')' (unary | lambda)
postfix = primary ('++' | '--')*
primary = literal | name | 'this' | 'super' | '(' expr ')' | primary '.' typeargs? (name | 'this' | 'super' | 'class') | primary '.' 'new' name typeargs? arguments body? | primary arguments | primary '[' expr ']' | 'new' newtype | (reftype | primary) '::' typeargs? (name | 'new') | typ '.' 'class' | 'void' '.' 'class' | switch
newtype = annotation* plaintype arguments body? | (plaintype | primitive) ('[' expr ']')+ dims? | (plaintype | primitive) dims '{' (varinit % ',')? ','? '}'
arguments = '(' (expr % ',')? ')'
literal = NUM | STR | CHAR | 'true' | 'false' | 'null'
"""

GO = """
unit = 'package' NAME ';' ('import' (importspec | '(' (importspec % ';')? ';'? ')') ';')* (top ';')*
importspec = (NAME | '.')? STR
top = declaration | 'func' NAME typeparams? signature block? | 'func' parameters NAME signature block?
declaration = 'const' (constspec | '(' (constspec % ';')? ';'? ')') | 'var' (varspec | '(' (varspec % ';')? ';'? ')') | 'type' (typespec | '(' (typespec % ';')? ';'? ')')
constspec = NAME % ',' (typ? '=' expr % ',')?
varspec = NAME % ',' (typ ('=' expr % ',')? | '=' expr % ',')
typespec = NAME typeparams? '='? typ
typeparams = '[' (NAME % ',' constraint) % ',' ','? ']'
constraint = ('~'? typ) % '|'
signature = parameters (parameters | typ)?
parameters = '(' (parameter % ',' ','?)? ')'
parameter = NAME? '...'? typ
typ = NAME ('.' NAME)? ('[' typ % ',' ']')? | '*' typ | '[' ']' typ | '[' expr ']' typ | '[' '...' ']' typ | 'map' '[' typ ']' typ | 'chan' '<-'? typ | '<-' 'chan' typ | 'func' signature | 'struct' '{' (field % ';')? ';'? '}' | 'interface' '{' (element % ';')? ';'? '}' | '(' typ ')'
field = NAME % ',' typ STR? | '*'? NAME ('.' NAME)? STR?
element = NAME signature | constraint
block = '{' statements '}'
statements = statement % ';'
statement = simple | declaration | block | 'return' (expr % ',')? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | NAME ':' statement | 'go' expr | 'defer' expr | if | for | switch | select
simple = | expr | expr '<-' expr | expr ('++' | '--') | (expr % ',') assignop (expr % ',') | (expr % ',') ':=' (expr % ',')
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
if = 'if' (simple ';')? expr block ('else' (if | block))?
for = 'for' (expr? | simple ';' expr? ';' simple | ((expr % ',') ('=' | ':='))? 'range' expr) block
switch = 'switch' (simple ';')? (expr | NAME ':=' primary '.' '(' 'type' ')' | primary '.' '(' 'type' ')')? '{' (('case' ((expr | typ) % ',') | 'default') ':' statements)* '}'
select = 'select' '{' (('case' simple | 'default') ':' statements)* '}'
expr = unary % binop
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||'
unary = primary | ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary
primary = NUM | STR | CHAR | NAME | '(' expr ')' | 'func' signature block | primary '.' NAME | primary '.' '(' typ ')' | primary '[' expr (',' typ % ',')? ']' | primary '[' expr? ':' expr? (':' expr)? ']' | primary '(' ((expr | typ) % ',' '...'? ','?)? ')' | littype composite | primary composite | littype '(' expr ','? ')'
littype = '[' ']' typ | '[' expr ']' typ | '[' '...' ']' typ | 'map' '[' typ ']' typ | 'struct' '{' (field % ';')? ';'? '}' | 'chan' typ | 'interface' '{' '}' | '(' '*' typ ')'
composite = '{' (keyed % ',' ','?)? '}'
keyed = (expr | composite) (':' (expr | composite))?
"""

RUST = """
unit = inner* item*
inner = '#' '!' '[' tree* ']'
attr = '#' '[' tree* ']'
tree = TOKEN | '(' tree* ')' | '[' tree* ']' | '{' tree* '}'
item = attr* vis? (fn | struct | enum | union | impl | trait | mod | use | const | type | extern | macrodef) | attr* macroitem
vis = 'pub' ('(' ('crate' | 'super' | 'self' | 'in' path) ')')? | 'crate'
fn = ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' NAME generics? '(' (param % ',' ','?)? ')' ('->' typ)? where? (block | ';')
param = attr* (pattern ':' typ | '&'? LIFE? 'mut'? 'self' (':' typ)? | '&' LIFE 'mut'? 'self' | '...')
generics = '<' (genericparam % ',' ','?)? '>'
genericparam = attr* (LIFE (':' LIFE % '+')? | NAME (':' bounds)? ('=' typ)? | 'const' NAME ':' typ ('=' expr)?)
where = 'where' ((typ ':' bounds | LIFE ':' LIFE % '+' | 'for' generics typ ':' bounds) % ',')? ','?
bounds = (bound % '+')?
bound = LIFE | '?'? ('for' generics)? typepath | '(' bound ')'
struct = 'struct' NAME generics? (where? '{' (structfield % ',' ','?)? '}' | '(' ((attr* vis? typ) % ',' ','?)? ')' where? ';' | where? ';')
structfield = attr* vis? NAME ':' typ
union = 'union' NAME generics? where? '{' (structfield % ',' ','?)? '}'
enum = 'enum' NAME generics? where? '{' ((attr* NAME ('{' (structfield % ',' ','?)? '}' | '(' ((attr* vis? typ) % ',' ','?)? ')')? ('=' expr)?) % ',' ','?)? '}'
impl = 'unsafe'? 'impl' generics? '!'? typ ('for' typ)? where? '{' inner* associated* '}'
associated = attr* vis? 'default'? (fn | const | type) | attr* macroitem
trait = 'unsafe'? 'trait' NAME generics? (':' bounds)? where? '{' associated* '}'
mod = 'mod' NAME (';' | '{' inner* item* '}')
use = 'use' usetree ';' | 'extern' 'crate' NAME ('as' NAME)? ';'
usetree = '::'? usepath
usepath = segment ('as' (NAME | '_'))? | segment '::' usepath | '*' | '{' (usetree % ',' ','?)? '}'
segment = NAME | 'self' | 'super' | 'crate' | 'Self'
const = ('const' | 'static' 'mut'?) (NAME | '_') ':' typ ('=' expr)? ';'
type = 'type' NAME generics? (':' bounds)? where? ('=' typ)? where? ';'
extern = 'unsafe'? 'extern' STR? '{' associated* '}'
macrodef = 'macro_rules' '!' NAME ('{' tree* '}' | '(' tree* ')' ';')
macroitem = path '!' ('{' tree* '}' | ('(' tree* ')' | '[' tree* ']') ';')
path = '::'? segment % '::'
typ = typepath | '&' LIFE? 'mut'? typ | '&&' LIFE? 'mut'? typ | '*' ('const' | 'mut') typ | '[' typ (';' expr)? ']' | '(' (typ % ',' ','?)? ')' | '!' | '_' | ('for' generics)? ('unsafe' | 'extern' STR?)* 'fn' '(' (((NAME | '_') ':')? typ) % ',' ','? ')' ('->' typ)? | ('for' generics)? ('unsafe' | 'extern' STR?)* 'fn' '(' ')' ('->' typ)? | ('impl' | 'dyn') bound % '+' | path '!' '(' tree* ')'
typepath = '::'? typesegment % '::' | '<' typ ('as' typepath)? '>' '::' typesegment % '::'
typesegment = segment | segment '::'? typeargs | segment '(' (typ % ',' ','?)? ')' ('->' typ)?
typeargs = '<' ((LIFE | typ | NAME typeargs? '=' typ | NAME ':' bounds | literal | '-' literal | block) % ',' ','?)? '>'
pattern = '|'? onepattern % '|'
onepattern = '_' | '..' | literal | '-' literal | ('ref'? 'mut'? NAME ('@' onepattern)?) | '&' 'mut'? onepattern | '&&' 'mut'? onepattern | '(' (pattern % ',' ','?)? ')' | '[' (pattern % ',' ','?)? ']' | exprpath | exprpath '(' (pattern % ',' ','?)? ')' | exprpath '{' ((attr* (NAME ':' pattern | NUM ':' pattern | 'ref'? 'mut'? NAME | '..')) % ',' ','?)? '}' | patternend ('..' | '..=' | '...') patternend? | ('..' | '..=') patternend | path '!' '(' tree* ')'
patternend = literal | '-' literal | exprpath
block = 'unsafe'? '{' inner* statement* blockend? '}' | 'async' 'move'? block
blockend = expr
statement = ';' | item | attr* 'let' pattern (':' typ)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* blocklike
blocklike = (LIFE ':')? (block | if | match | 'loop' block | 'while' conditions block | 'for' pattern 'in' expr block) | path '!' '{' tree* '}'
conditions = condition % '&&'
condition = expr | 'let' pattern '=' expr
if = 'if' conditions block ('else' (if | block))?
match = 'match' expr '{' inner* (arm* lastarm)? '}'
arm = attr* pattern ('if' conditions)? '=>' (expr ',' | blocklike)
lastarm = arm | attr* pattern ('if' conditions)? '=>' expr
expr = range | unary assignop expr | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | closure
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
closure = 'static'? 'async'? 'move'? ('|' (closureparam % ',' ','?)? '|' | '||') (expr | '->' typ block)
closureparam = attr* onepattern (':' typ)?
range = binary? ('..' | '..=') binary? | binary
binary = unary | binary binop (unary | closure | 'return' expr?) | binary 'as' typ
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||'
unary = postfix | ('-' | '!' | '*') unary | ('&' | '&&') ('raw'? ('mut' | 'const'))? unary
postfix = primary | postfix '?' | postfix '.' (NAME | NUM | 'await') | postfix '.' NAME '::' typeargs | postfix '(' (expr % ',' ','?)? ')' | postfix '[' expr ']'
primary = literal | exprpath | '(' (expr % ',' ','?)? ')' | '[' (expr % ',' ','?)? ']' | '[' expr ';' expr ']' | blocklike | exprpath '{' ((attr* (NAME | NUM) (':' expr)?) % ',' ','?)? '}' | exprpath '{' ((attr* (NAME | NUM) (':' expr)? ',')*) '..' expr? '}' | path '!' ('(' tree* ')' | '[' tree* ']')
exprpath = '::'? exprsegment % '::' | '<' typ ('as' typepath)? '>' '::' exprsegment % '::'
exprsegment = segment | typeargs
literal = NUM | STR | CHAR | 'true' | 'false'
"""

PYTHON = """
unit = statement*
statement = simple | compound
simple = small % ';' ';'? NEWLINE
small = testlist (':' test ('=' (yield | testlist))?)? | testlist augassign (yield | testlist) | testlist ('=' (yield | testlist))+ | yield | 'del' testlist | 'pass' | 'break' | 'continue' | 'return' testlist? | 'raise' (test ('from' test)?)? | 'global' NAME % ',' | 'nonlocal' NAME % ',' | 'assert' test (',' test)? | import | 'type' NAME typeparams? '=' test
augassign = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='
import = 'import' (dotted ('as' NAME)?) % ',' | 'from' ('.' | '...')* dotted 'import' importlist | 'from' ('.' | '...')+ 'import' importlist
importlist = '*' | '(' asname % ',' ','? ')' | asname % ','
asname = name ('as' name)?
dotted = name % '.'
name = NAME | 'match' | 'case' | 'type' | '_'
compound = if | while | for | try | with | function | class | 'async' (function | with | for) | decorated | match
decorated = ('@' namedtest NEWLINE)+ (function | class | 'async' function)
function = 'def' name typeparams? '(' parameters? ')' ('->' test)? ':' suite
typeparams = '[' (('*' | '**')? NAME (':' test)? ('=' test)?) % ',' ','? ']'
parameters = parameter % ',' ','?
parameter = name (':' (test | star))? ('=' test)? | '*' (name (':' (test | star))?)? | '**' name (':' test)? | '/'
class = 'class' name typeparams? ('(' arguments? ')')? ':' suite
suite = simple | NEWLINE INDENT statement+ DEDENT
if = 'if' namedtest ':' suite ('elif' namedtest ':' suite)* ('else' ':' suite)?
while = 'while' namedtest ':' suite ('else' ':' suite)?
for = 'for' exprlist 'in' testlist ':' suite ('else' ':' suite)?
try = 'try' ':' suite (('except' '*'? (testlist ('as' name)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
with = 'with' (withitem % ',' | '(' withitem % ',' ','? ')') ':' suite
withitem = test ('as' starexpr)?
match = 'match' testlist ':' NEWLINE INDENT ('case' patterns ('if' namedtest)? ':' suite)+ DEDENT
patterns = pattern % ',' ','?
pattern = orpattern ('as' name)? | '*' name
orpattern = closed % '|'
closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted | '(' patterns? ')' | '[' patterns? ']' | '{' (((closed ':' pattern) | '**' name) % ',' ','?)? '}' | dotted '(' ((name '=' pattern | pattern) % ',' ','?)? ')'
testlist = (namedtest | star) % ',' ','?
exprlist = starexpr % ',' ','?
starexpr = '*'? binary
star = '*' binary
namedtest = test | name ':=' test
test = ortest ('if' ortest 'else' test)? | lambda
lambda = 'lambda' (lambdaparam % ',' ','?)? ':' test
lambdaparam = name ('=' test)? | '*' name? | '**' name | '/'
ortest = nottest % ('and' | 'or')
nottest = 'not' nottest | comparison
comparison = binary % compop
compop = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
binary = unary % binop
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>'
unary = ('+' | '-' | '~') unary | power
power = 'await'? atomexpr ('**' unary)?
atomexpr = atom | atomexpr '(' arguments? ')' | atomexpr '[' subscripts ']' | atomexpr '.' name
subscripts = subscript % ',' ','?
subscript = namedtest | star | test? ':' test? (':' test?)?
arguments = argument % ',' ','?
argument = namedtest comprehension? | name '=' test | '*' test | '**' test
comprehension = ('async'? 'for' exprlist 'in' ortest ('if' filtertest)*)+
filtertest = ortest | name ':=' ortest | lambda
atom = '(' (yield | testlist | (namedtest | star) comprehension)? ')' | '[' (testlist | (namedtest | star) comprehension)? ']' | '{' (entries | testlist | (test ':' test | namedtest) comprehension)? '}' | name | NUM | STR+ | '...' | 'None' | 'True' | 'False'
entries = (test ':' test | '**' binary) % ',' ','?
yield = 'yield' (testlist | 'from' test)?
"""

#: JavaScript; ``{types}`` rules are TypeScript's or their absence.
_SCRIPT = """
unit = HASHBANG? item*
{items}
statement = block | ';' | expr ';' | variable ';' | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'? | for | 'return' expr? ';' | 'break' name? ';' | 'continue' name? ';' | 'throw' expr ';' | 'debugger' ';' | name ':' statement | try | switch | function | class{with}{decls}
declared = 'let' | 'const' | 'var'
variable = declared (binding % ',')
binding = target {annot} ('=' assign)?
target = name | '[' (element?) % ',' ']' | '{' ((property_target) % ',' ','?)? '}'
element = target ('=' assign)? | '...' target
property_target = name ('=' assign)? | propname ':' target ('=' assign)? | '...' target
block = '{' statement* '}'
for = 'for' 'await'? '(' ((variable | expr)? ';' expr? ';' expr? | (declared target | lhs) ('of' assign | 'in' expr)) ')' statement
try = 'try' block ('catch' ('(' target {annot} ')')? block ('finally' block)? | 'finally' block)
switch = 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' statement*)* '}'
name = NAME | 'of' | 'async' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let'{softs}
function = 'async'? 'function' '*'? name {tparams} params {ret} {fnbody}
params = '(' ((parameter % ',') ','?)? ')'
parameter = {pmods} (target {opt} {annot} ('=' assign)? | '...' target {annot}{thisparam})
class = {cmods} 'class' name? {tparams} ('extends' lhs {targs})? {implements} '{' member* '}'
member = ';' | {mmods} (('async' | 'get' | 'set')? '*'? propname {opt} {tparams} params {ret} {fnbody} | 'async' '*' propname params {ret} block | propname {mark} {annot} ('=' assign)? ';' | 'static' block){members}
propname = name | keyword | STR | NUM | PRIVATE | '[' assign ']'
keyword = 'if' | 'else' | 'while' | 'do' | 'for' | 'return' | 'break' | 'continue' | 'throw' | 'debugger' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'function' | 'class' | 'extends' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' | 'export' | 'const' | 'var' | 'with' | 'yield' | 'await' | 'enum'
expr = assign % ','
assign = cond | lhs assignop assign | arrow | 'yield' '*'? assign | 'yield'
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '**=' | '&&=' | '||=' | '??='
arrow = 'async'? (name | {tparams} params {ret}) '=>' (block | assign)
cond = binary ('?' assign ':' assign)?
binary = unary | binary binop unary | PRIVATE 'in' unary{asexpr}
binop = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | 'in' | 'instanceof'
unary = postfix | ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await') unary
postfix = lhs ('++' | '--')?
lhs = primary | lhs ('.' | '?.') (name | keyword | PRIVATE) | lhs '?.'? '[' expr ']' | lhs '?.'? {targs} args | lhs TEMPLATE | 'new' lhs {targs} | 'super' | 'import' args | 'import' '.' name | 'new' '.' name{nonnull}
args = '(' ((('...'? assign) % ',') ','?)? ')'
primary = name | NUM | STR | TEMPLATE | REGEX | 'this' | 'null' | 'true' | 'false' | '(' expr ')' | '[' ((('...'? assign)?) % ',') ']' | '{' ((entry % ',') ','?)? '}' | 'async'? 'function' '*'? name? {tparams} params {ret} block | class
entry = name | name '=' assign | propname ':' assign | '...' assign | ('async' | 'get' | 'set')? '*'? propname {tparams} params {ret} block | 'async' '*' propname params block
"""
_MODULE_ITEMS = """item = statement | import | export{exports}
import = 'import' {typeonly} (STR | clause 'from' STR) ('with' '{' ((name | STR) ':' STR) % ',' '}')? ';'{importeq}
clause = name | '*' 'as' name | namedimports | name ',' ('*' 'as' name | namedimports)
namedimports = '{' (({typeonly} (name | keyword | STR) ('as' name)?) % ',' ','?)? '}'
export = 'export' (variable ';' | function | class | {typeonly} '*' ('as' (name | STR))? 'from' STR ';' | {typeonly} '{' (({typeonly} (name | keyword | STR) ('as' (name | keyword | STR))?) % ',' ','?)? '}' ('from' STR)? ';' | 'default' (assign ';' | 'async'? 'function' '*'? name? {tparams} params {ret} block | class))"""
_TYPES = """
annotation = ':' (typ | predicate)
predicate = 'asserts'? (name | 'this') 'is' typ | 'asserts' (name | 'this')
typeparams = '<' ((('const' | 'in' | 'out')* name ('extends' typ)? ('=' typ)?) % ',' ','?) '>'
typeargs = '<' (typ % ',' ','?) '>'
typ = union ('extends' union '?' typ ':' typ)? | 'new'? typeparams? params '=>' (typ | predicate) | 'abstract' 'new' typeparams? params '=>' typ
union = ('|' | '&')? operand % ('|' | '&')
operand = array | ('keyof' | 'readonly' | 'unique' | 'infer') operand | 'typeof' (name % '.') typeargs?
array = basic | array '[' ']' | array '[' typ ']'
basic = name (('.' name)* typeargs?) | 'this' | 'void' | 'null' | 'true' | 'false' | STR | '-'? NUM | TEMPLATE | '(' typ ')' | '{' (typemember ((';' | ',') typemember)* (';' | ',')?)? '}' | '[' ((('...'? (name '?'? ':')? typ '?'?) % ',') ','?)? ']' | 'import' '(' STR ')' ('.' name)* typeargs? | 'asserts'
typemember = ('readonly' | '+' | '-')* propname '?'? annotation? | 'readonly'? '[' name ':' typ ']' annotation | ('get' | 'set')? propname? '?'? typeparams? params annotation? | 'new' typeparams? params annotation? | ('readonly' | '+' | '-')* '[' name 'in' typ ('as' typ)? ']' ('+' | '-')? '?'? annotation?
interface = 'interface' name typeparams? ('extends' (lhs typeargs?) % ',')? '{' (typemember (';' | ',')?)* '}'
alias = 'type' name typeparams? '=' typ ';'
enum = 'const'? 'enum' name '{' ((propname ('=' assign)?) % ',' ','?)? '}'
namespace = ('namespace' | 'module') (name % '.' | STR) '{' item* '}'
declare = 'declare' (variable ';' | function | class | interface | alias | enum | namespace | 'global' '{' item* '}')
decorator = '@' lhs
access = 'public' | 'private' | 'protected' | 'readonly' | 'static' | 'abstract' | 'override' | 'declare' | 'accessor' | decorator
"""
_SOFT_TYPES = " | 'type' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'is' | 'asserts' | 'keyof' | 'infer' | 'unique' | 'out' | 'global' | 'public' | 'private' | 'protected' | 'override' | 'accessor' | 'satisfies' | 'interface' | 'implements'"


def _script(module: bool, types: bool) -> str:
    none = dict.fromkeys("annot tparams ret opt pmods cmods targs implements mark typeonly".split(), "")
    parts = none | {"softs": "", "with": "", "decls": "", "mmods": "'static'?", "members": "", "asexpr": "", "nonnull": "", "fnbody": "block", "exports": "", "importeq": "", "thisparam": ""}
    if types:
        parts |= {
            "annot": "annotation?", "tparams": "typeparams?", "ret": "annotation?", "opt": "'?'?", "mark": "('?' | '!')?", "pmods": "access*", "cmods": "(decorator* 'abstract'?)", "targs": "typeargs?",
            "implements": "('implements' (lhs typeargs?) % ',')?", "typeonly": "'type'?", "softs": _SOFT_TYPES, "decls": " | interface | alias | enum | namespace | declare", "mmods": "access*", "fnbody": "(block | ';')",
            "thisparam": " | 'this' annotation",
            "members": " | access* '[' name ':' typ ']' annotation ';'", "asexpr": " | binary ('as' | 'satisfies') (typ | 'const')", "nonnull": " | lhs '!' | '<' typ '>' unary", "exports": " | 'export' (interface | alias | enum | namespace | declare | 'as' 'namespace' name ';' | 'default' interface | '=' assign ';')", "importeq": " | 'import' 'type'? name '=' (name % '.' | name '(' STR ')') ';'",
        }
    if not module:
        parts["with"] = " | 'with' '(' expr ')' statement"
    items = _MODULE_ITEMS if module else "item = statement"
    text = _SCRIPT.replace("{items}", items)
    for key, value in parts.items():
        text = text.replace("{" + key + "}", value)
    return text + (_TYPES if types else "")


MODULE = _script(True, False)
SCRIPT = _script(False, False)
TYPESCRIPT = _script(True, True)

CSHARP = """
unit = ('extern' 'alias' name ';')* using* (attributes)* ('namespace' qualified ';')? using* (namespace | type | statement)*
using = 'global'? 'using' ('static'? qualifiedtype | name '=' typ) ';'
qualified = name % '.'
qualifiedtype = typ
name = NAME | 'get' | 'set' | 'init' | 'add' | 'remove' | 'value' | 'var' | 'record' | 'partial' | 'where' | 'when' | 'async' | 'await' | 'yield' | 'global' | 'from' | 'select' | 'and' | 'or' | 'not' | 'with' | 'nameof' | 'alias' | 'required' | 'file' | 'unmanaged' | 'notnull' | 'dynamic'
attributes = '[' (name ':')? (typ arguments?) % ',' ','? ']'
modifier = 'public' | 'private' | 'protected' | 'internal' | 'static' | 'sealed' | 'abstract' | 'virtual' | 'override' | 'readonly' | 'const' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'async' | 'partial' | 'ref' | 'required' | 'file' | 'fixed'
namespace = 'namespace' qualified '{' using* (namespace | type)* '}' ';'?
type = attributes* modifier* (class | enum | delegate)
class = ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) name typeparams? ('(' (parameter % ',')? ')')? (':' (typ arguments?) % ',')? constraint* ('{' member* '}' ';'? | ';')
enum = 'enum' name (':' typ)? '{' ((attributes* name ('=' expr)?) % ',' ','?)? '}' ';'?
delegate = 'delegate' (typ | 'void') name typeparams? '(' (parameter % ',')? ')' constraint* ';'
typeparams = '<' (attributes* ('in' | 'out')? name) % ',' '>'
constraint = 'where' name ':' ((typ | 'class' '?'? | 'struct' | 'new' '(' ')' | 'default') % ',')
member = type | attributes* modifier* (typ | 'void') (typ '.')? name typeparams? '(' (parameter % ',')? ')' constraint* fnbody | attributes* modifier* name '(' (parameter % ',')? ')' (':' ('base' | 'this') arguments)? fnbody | attributes* modifier* '~' name '(' ')' fnbody | attributes* modifier* typ declarators ';' | attributes* modifier* typ (typ '.')? name accessors | attributes* modifier* typ 'this' '[' parameter % ',' ']' accessors | attributes* modifier* 'event' typ (declarators ';' | name '{' accessor+ '}') | attributes* modifier* typ 'operator' operator '(' parameter % ',' ')' fnbody | attributes* modifier* ('implicit' | 'explicit') 'operator' typ '(' parameter ')' fnbody | ';'
operator = binop | '!' | '~' | '++' | '--' | 'true' | 'false'
accessors = '{' accessor* '}' ('=' expr ';')? | '=>' expr ';'
accessor = attributes* modifier* ('get' | 'set' | 'init' | 'add' | 'remove') fnbody
fnbody = block | '=>' expr ';' | ';'
parameter = attributes* ('ref' | 'out' | 'in' | 'params' | 'this' | 'scoped' | 'readonly')* typ name ('=' expr)?
declarators = (name ('=' (expr | '{' (varinit % ',' ','?)? '}'))?) % ','
varinit = expr | '{' (varinit % ',' ','?)? '}'
typ = basic | typ '?' | typ '[' ','* ']' | typ '*' | 'ref' typ
basic = name typeargs? | basic '.' name typeargs? | 'global' '::' name typeargs? | primitive | '(' (typ name?) % ',' ')'
primitive = 'int' | 'long' | 'short' | 'byte' | 'sbyte' | 'uint' | 'ulong' | 'ushort' | 'char' | 'float' | 'double' | 'decimal' | 'bool' | 'string' | 'object'
typeargs = '<' (typ % ',' | ','*) '>'
block = '{' statement* '}'
statement = block | ';' | expr ';' | modifier* typ declarators ';' | 'const' typ declarators ';' | modifier* (typ | 'void') name typeparams? '(' (parameter % ',')? ')' constraint* (block | '=>' expr ';') | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' (typ declarators | expr % ',')? ';' expr? ';' (expr % ',')? ')' statement | 'await'? 'foreach' '(' (typ name | typ '(' name % ',' ')' | 'var' '(' name % ',' ')') 'in' expr ')' statement | 'return' 'ref'? expr? ';' | 'break' ';' | 'continue' ';' | 'throw' expr? ';' | 'goto' (name | 'case' expr | 'default') ';' | name ':' statement | try | switch | 'lock' '(' expr ')' statement | 'await'? 'using' ('(' (typ declarators | expr) ')' statement | typ declarators ';') | 'yield' ('return' expr | 'break') ';' | ('checked' | 'unchecked' | 'unsafe') block | 'fixed' '(' typ declarators ')' statement
try = 'try' block (('catch' ('(' typ name? ')')? ('when' '(' expr ')')? block)+ ('finally' block)? | 'finally' block)
switch = 'switch' '(' expr ')' '{' ((('case' pattern ('when' expr)? | 'default') ':')+ statement+)* '}'
pattern = ('not' pattern | relational) % ('and' | 'or')
relational = binary | ('<' | '>' | '<=' | '>=') binary | typ name | typ? '{' ((expr ':' pattern) % ',' ','?)? '}' name? | typ? '(' ((name ':')? pattern) % ',' ')' name? | 'var' name | '[' (pattern % ',')? ']' | '..'
expr = cond | unary assignop expr | lambda | 'throw' expr | 'ref' expr | query
query = 'from' typ? name 'in' expr clause* ('select' expr | 'group' expr 'by' expr)
clause = 'from' typ? name 'in' expr | 'where' expr | 'let' name '=' expr | 'orderby' (expr ('ascending' | 'descending')?) % ','
lambda = ('async' | 'static')* (name | '(' ((name | parameter) % ',')? ')' | 'delegate' ('(' (parameter % ',')? ')')?) ('=>' (expr | block)) | 'async'? 'delegate' ('(' (parameter % ',')? ')')? block
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '??='
cond = binary ('?' expr ':' expr)? | binary '??' expr
binary = unary | binary binop unary | binary 'is' pattern | binary 'as' typ | binary 'switch' '{' ((pattern ('when' expr)? '=>' expr) % ',' ','?)? '}' | binary? '..' binary?
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||'
unary = postfix | ('+' | '-' | '!' | '~' | '++' | '--' | '&' | '*' | '^' | 'await') unary | '(' typ ')' unary
postfix = primary | postfix ('++' | '--' | '!')
primary = literal | name typeargs? | primitive | 'this' | 'base' | '(' expr ')' | '(' ((name ':')? (expr | typ name)) % ',' ')' | primary ('.' | '?.' | '->' | '::') name typeargs? | primary arguments | primary '?'? '[' ((name ':')? expr) % ',' ']' | 'new' (typ? arguments initialiser? | typ initialiser | initialiser | '[' (expr % ',')? ']' arrayinit? | typ '[' expr % ',' ']' ('[' ','* ']')* arrayinit? | typ arrayinit) | ('typeof' | 'sizeof' | 'default') '(' (typ | 'void') ')' | 'default' | 'stackalloc' typ '[' expr ']' | ('checked' | 'unchecked') '(' expr ')' | '[' (('..'? expr) % ',' ','?)? ']' | primary 'with' initialiser
arguments = '(' (((name ':')? (('ref' | 'out' | 'in')? expr | 'out' (typ | 'var') name)) % ',')? ')'
initialiser = '{' ((('[' expr % ',' ']' | name) '=' (expr | initialiser) | expr | '{' expr % ',' '}') % ',' ','?)? '}'
arrayinit = '{' (varinit % ',' ','?)? '}'
literal = NUM | STR | CHAR | 'true' | 'false' | 'null'
"""

PHP = """
unit = (HTML | OPEN item* (CLOSE | END))*
item = statement | 'namespace' NAME ';' | 'namespace' NAME? '{' statement* '}' | 'use' ('function' | 'const')? usename % ',' ';' | 'const' (ident '=' expr) % ',' ';' | CLOSE HTML? OPEN
usename = NAME ('as' NAME)? | NAME '{' (('function' | 'const')? NAME ('as' NAME)?) % ',' ','? '}'
ident = NAME | 'match' | 'enum' | 'readonly' | 'list' | 'self' | 'parent' | 'static' | 'class' | 'print' | 'default' | 'new' | 'for' | 'function' | 'array' | 'empty' | 'isset' | 'use' | 'var' | 'return' | 'echo' | 'public' | 'private' | 'protected' | 'and' | 'or' | 'if' | 'else' | 'while' | 'do' | 'try' | 'catch' | 'throw' | 'clone' | 'include' | 'require' | 'namespace' | 'const' | 'global' | 'fn' | 'unset' | 'exit' | 'yield' | 'break' | 'continue' | 'switch' | 'case' | 'foreach' | 'as' | 'abstract' | 'final' | 'interface' | 'trait' | 'extends' | 'implements' | 'goto' | 'finally' | 'instanceof' | 'xor' | 'elseif' | 'declare'
attribute = '#[' (NAME args?) % ',' ','? ']'
statement = block | ';' | expr ';' | 'echo' expr % ',' ';' | if | 'while' paren (statement | ':' statement* 'endwhile' ';') | 'do' statement 'while' paren ';' | 'for' '(' (expr % ',')? ';' (expr % ',')? ';' (expr % ',')? ')' (statement | ':' statement* 'endfor' ';') | 'foreach' '(' expr 'as' ('&'? expr '=>')? '&'? expr ')' (statement | ':' statement* 'endforeach' ';') | switch | 'return' expr? ';' | 'break' NUM? ';' | 'continue' NUM? ';' | 'global' VAR % ',' ';' | 'static' (VAR ('=' expr)?) % ',' ';' | 'unset' '(' expr % ',' ','? ')' ';' | try | 'declare' '(' NAME '=' expr ')' (';' | statement) | attribute* function | attribute* class | 'goto' NAME ';' | NAME ':' | CLOSE HTML? OPEN | '__halt_compiler' '(' ')' ';'
block = '{' statement* '}'
paren = '(' expr ')'
if = 'if' paren statement ('elseif' paren statement)* ('else' statement)? | 'if' paren ':' statement* ('elseif' paren ':' statement*)* ('else' ':' statement*)? 'endif' ';'
switch = 'switch' paren ('{' ';'? case* '}' | ':' case* 'endswitch' ';')
case = ('case' expr | 'default') (':' | ';') statement*
try = 'try' block ('catch' '(' NAME % '|' VAR? ')' block)* ('finally' block)?
function = 'function' '&'? ident '(' (parameter % ',' ','?)? ')' (':' typ)? block
parameter = attribute* ('public' | 'private' | 'protected' | 'readonly')* typ? '&'? '...'? VAR ('=' expr)?
typ = '?'? onetype % ('|' | '&') | '(' onetype % '&' ')' ('|' typ)?
onetype = NAME | 'array' | 'callable' | 'static' | 'self' | 'parent'
class = ('abstract' | 'final' | 'readonly')* 'class' NAME ('extends' NAME)? ('implements' NAME % ',')? '{' member* '}' | 'interface' NAME ('extends' NAME % ',')? '{' member* '}' | 'trait' NAME '{' member* '}' | 'enum' NAME (':' typ)? ('implements' NAME % ',')? '{' member* '}'
member = attribute* modifier* 'function' '&'? ident '(' (parameter % ',' ','?)? ')' (':' typ)? (block | ';') | attribute* modifier+ typ? (VAR ('=' expr)?) % ',' ';' | attribute* modifier* 'const' typ? (ident '=' expr) % ',' ';' | 'use' NAME % ',' (';' | '{' ((NAME '::')? ident ('as' modifier? ident? | 'insteadof' NAME % ',') ';')* '}') | attribute* 'case' ident ('=' expr)? ';'
modifier = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'var' | 'readonly'
expr = binary ('?' expr? ':' expr)? | unary assignop '&'? expr | 'yield' (expr ('=>' expr)?)? | 'yield' 'from' expr | 'throw' expr | 'print' expr | ('include' | 'include_once' | 'require' | 'require_once') expr | arrowfn | 'list' '(' (arrayitem? % ',') ')' '=' expr
arrowfn = attribute* 'static'? 'fn' '&'? '(' (parameter % ',' ','?)? ')' (':' typ)? '=>' expr
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '.=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '??='
binary = unary | binary binop unary | binary binop unary assignop expr | binary 'instanceof' (NAME | postfix | 'self' | 'static')
binop = '+' | '-' | '*' | '/' | '%' | '**' | '.' | '&' | '|' | '^' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '<>' | '<=>' | '&&' | '||' | '??' | 'and' | 'or' | 'xor'
unary = postfix | ('+' | '-' | '!' | '~' | '@' | '++' | '--' | '&' | 'clone' | CAST) unary | postfix ('++' | '--') | 'new' newclass
newclass = (NAME | 'static' | 'self' | 'parent' | postfix) args? | 'class' args? ('extends' NAME)? ('implements' NAME % ',')? '{' member* '}'
postfix = VAR | '$' VAR | '$' '{' expr '}' | NAME | 'static' | 'self' | 'parent' | NUM | STR | '(' expr ')' | '[' (arrayitem? % ',') ']' | 'array' '(' (arrayitem % ',' ','?)? ')' | 'isset' '(' expr % ',' ','? ')' | 'empty' '(' expr ')' | ('exit' | 'die') ('(' expr? ')')? | postfix args | postfix '[' expr? ']' | postfix '{' expr '}' | postfix ('->' | '?->') (ident | VAR | '{' expr '}') | postfix '::' (ident | VAR | '{' expr '}') | attribute* 'static'? 'function' '&'? '(' (parameter % ',' ','?)? ')' ('use' '(' ('&'? VAR) % ',' ','? ')')? (':' typ)? block | 'match' paren '{' (((expr % ',' ','? | 'default') '=>' expr) % ',' ','?)? '}'
arrayitem = (expr '=>')? '&'? expr | '...' expr
args = '(' (((ident ':')? '...'? expr | '...') % ',' ','?)? ')'
"""

RUBY = """
unit = NL? statements?
statements = statement (NL statement)* NL?
body = statements?
statement = plain modifier* | 'alias' fname fname | 'undef' fname % ',' | 'BEGIN' '{' NL? body '}' | 'END' '{' NL? body '}'
modifier = (MOD | RESCUEMOD) plain
plain = expression | multiple '=' values | multiple '=' command
multiple = mlhs (',' mlhs?)+ | '*' primary
mlhs = '*'? primary | '(' mlhs % ',' ')'
values = ('*'? arg) % ','
expression = notexpr % ('and' | 'or')
notexpr = 'not' notexpr | '!' command | arg | command | arg 'in' pattern | arg '=>' pattern
command = callee commandargs doblock? | ('return' | 'break' | 'next') commandargs | 'yield' commandargs | 'super' commandargs | primary assignop command | primary assignop ('*'? arg) (',' '*'? arg)+ | primary assignop arg RESCUEMOD arg
callee = FNAME | primary ('.' | '&.' | '::') method | NAME | CONST
commandargs = argument % ',' | (argument ',')* command
argument = arg | '*' arg | '**' arg | '&' arg | '&' | LABEL arg? | arg '=>' arg | '*' | '**'
method = NAME | CONST | FNAME | keyword | operator
keyword = 'class' | 'if' | 'then' | 'end' | 'begin' | 'in' | 'do' | 'for' | 'nil' | 'self' | 'not' | 'and' | 'or' | 'next' | 'return' | 'yield' | 'true' | 'false' | 'module' | 'def' | 'when' | 'case' | 'unless' | 'while' | 'until' | 'else' | 'rescue' | 'ensure' | 'super' | 'break' | 'redo' | 'retry' | 'alias'
operator = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '===' | '=~' | '<<' | '>>' | '!' | '&' | '|' | '^' | '~' | '[]' | '+@' | '-@'
fname = NAME | CONST | FNAME | keyword | operator | '[]' '=' | NAME '=' | CONST '=' | SYMBOL
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '||=' | '&&=' | '|=' | '&=' | '<<=' | '>>=' | '^='
arg = ternary | primary assignop NL? arg | 'defined?' arg | 'def' defname ('(' (param % ',')? ')')? '=' NL? arg
ternary = range ('?' NL? arg (':' | LABELCOLON) NL? arg)? | range '?' NL? LABEL NL? arg
range = binary (('..' | '...') binary?)? | ('..' | '...') binary
binary = unary | binary binop NL? unary
binop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '===' | '=~' | '!~' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||'
unary = primary | ('-' | '+' | '!' | '~') unary
primary = NAME | CONST | IVAR | FNAME | 'self' | 'nil' | 'true' | 'false' | '__method__' | NUM | STR+ | XSTR | REGEX | SYMBOL | WORDS | HEREDOC | '(' NL? body ')' | '[' NL? (argument % (',' NL?) ','? NL?)? ']' | '{' NL? (pair % (',' NL?) ','? NL?)? '}' | '->' lambdaparams? ('{' NL? body '}' | 'do' NL? rescued 'end') | primary ('.' | '&.' | '::') NL? method | primary '::' CONST | '::' CONST | primary '(' NL? (argument % (',' NL?) ','? NL?)? ')' | primary INDEX NL? (argument % (',' NL?) ','? NL?)? ']' | primary block | 'yield' | 'yield' '(' (argument % ',')? ')' | 'super' | 'super' '(' (argument % ',')? ')' | 'return' | 'break' | 'next' | 'redo' | 'retry' | if | unless | while | case | for | 'begin' NL? rescued 'end' | def | class | module | 'not' '(' expression ')' | 'defined?' '(' expression ')'
pair = arg '=>' NL? arg | LABEL NL? arg | LABEL | '**' arg | STRLABEL NL? arg
block = '{' blockparams? NL? body '}' | doblock
doblock = 'do' blockparams? NL? rescued 'end'
blockparams = '|' (blockparam % ',')? ','? (';' NAME % ',')? '|' | '||'
blockparam = NAME ('=' primary)? | '*' NAME? | '**' NAME? | '&' NAME? | LABEL primary? | '(' blockparam % ',' ')'
lambdaparams = '(' (param % ',')? ')' | param % ','
rescued = body rescue* ('else' NL? body)? ('ensure' NL? body)?
rescue = 'rescue' (('*'? arg) % ',')? ('=>' primary)? then body
then = NL 'then'? | 'then' NL?
if = 'if' expression then body ('elsif' expression then body)* ('else' NL? body)? 'end'
unless = 'unless' expression then body ('else' NL? body)? 'end'
while = ('while' | 'until') expression ('do' NL? | NL) body 'end'
for = 'for' (mlhs % ',') 'in' expression ('do' NL? | NL) body 'end'
case = 'case' expression? NL (('when' (('*'? arg) % (',' NL?)) then body)+ | ('in' pattern (MOD expression)? then body)+) ('else' NL? body)? 'end'
pattern = onepattern % ',' 
onepattern = arg | '*' NAME? | '**' NAME? | LABEL onepattern? | onepattern '|' onepattern | onepattern '=>' NAME | '[' (onepattern % ',')? ']' | '{' (onepattern % ',')? '}' | '^' primary | CONST '(' (onepattern % ',')? ')'
def = 'def' defname params rescued 'end'
defname = fname | ('self' | CONST | NAME) '.' fname
params = '(' NL? (param % (',' NL?) NL?)? ')' NL? | (param % ',')? NL
param = NAME ('=' arg)? | '*' NAME? | '**' (NAME | 'nil')? | '&' NAME? | LABEL arg? | '...' | '(' param % ',' ')'
class = 'class' ('::'? CONST ('::' CONST)*) ('<' expression)? NL rescued 'end' | 'class' '<<' expression NL rescued 'end'
module = 'module' CONST ('::' CONST)* NL rescued 'end'
"""
