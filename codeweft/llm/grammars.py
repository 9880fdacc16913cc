"""Rules of six languages in the notation of :mod:`automata`."""

from __future__ import annotations

from functools import lru_cache

from codeweft.llm.automata import Rules
from codeweft.llm.lexing import BAD, ID, LIFE, NUM, SOFT, STR, lexer

#: A newline that may end a statement; generic arguments that were taken together.
BREAK, GENERIC = "s", "g"

PYTHON = """
ATOM = ( NAME / NUM { NOTHING } / STRS / P:args / S:subs / B:dict / CONST )
STRS = STR { STR }
TRAIL = ( . NAME / P:args / S:subs )
OPERAND = { UN / lambda [ LPARAMS ] : } ATOM { TRAIL }
OPS = OPERAND { ( BIN / not in ) OPERAND }
EXPR = OPS { if OPS else OPS }
WALRUS = [ NAME := ] EXPR
STAREXPR = [ * ] EXPR
EXPRS = STAREXPR { , STAREXPR } [ , ]
LPARAM = ( [ * / ** ] NAME [ = EXPR ] / * / DIV )
LPARAMS = LPARAM { , LPARAM } [ , ]
TARGET = [ * ] ATOM { TRAIL }
COMP = { [ async ] for TARGET { , TARGET } [ , ] in OPS { if OPS } }
ARG = ( NAME = EXPR / * EXPR / ** EXPR / WALRUS COMP )
args = [ ( ARG { , ARG } [ , ] / yield [ EXPRS ] / yield from EXPR ) ]
PARAM = ( [ * / ** ] NAME [ : STAREXPR ] [ = EXPR ] / * / DIV )
params = [ PARAM { , PARAM } [ , ] ]
SUB = ( WALRUS COMP / * EXPR / [ EXPR ] : [ EXPR ] [ : [ EXPR ] ] )
subs = [ SUB { , SUB } [ , ] ]
PAIR = ( EXPR : EXPR / ** EXPR )
dict = [ ( PAIR COMP { , PAIR } [ , ] / SETITEM COMP { , SETITEM } [ , ] ) ]
SETITEM = ( WALRUS / * EXPR )
WITHITEM = EXPR [ as TARGET ]
withs = WITHITEM { , WITHITEM } [ , ]
DOTTED = NAME { . NAME }
ALIAS = DOTTED [ as NAME ]
NAMES = NAME [ as NAME ] { , NAME [ as NAME ] } [ , ]
names = NAMES
SIMPLE = ( EXPRS { = ( EXPRS / YIELD ) } / EXPR AUG ( EXPRS / YIELD ) / EXPR : EXPR [ = ( EXPRS / YIELD ) ] / YIELD / WORD / return [ EXPRS ] / del EXPRS / raise [ EXPR [ from EXPR ] ] / assert EXPR [ , EXPR ] / global NAMES / nonlocal NAMES / import ALIAS { , ALIAS } / from ( { DOTS } DOTTED / DOTS { DOTS } ) import ( * / NAMES / P:names ) / type NAME [ S:subs ] = EXPR )
YIELD = yield [ EXPRS / from EXPR ]
SUITE = : ( N B:stmts / SIMPLE { ; SIMPLE } [ ; ] N )
CLAUSE = ( if WALRUS / elif WALRUS / while WALRUS / else / try / finally / except [ * ] [ EXPRS [ as NAME ] ] / [ async ] for TARGET { , TARGET } [ , ] in EXPRS / [ async ] with ( WITHITEM { , WITHITEM } / P:withs ) / [ async ] def NAME [ S:subs ] P:params [ -> EXPR ] / class NAME [ S:subs ] [ P:args ] )
MATCH = match EXPRS : N B:cases
PATTERN = EXPRS [ as NAME ] { BINOR EXPRS }
cases = { case PATTERN [ if WALRUS ] SUITE }
STMT = ( SIMPLE { ; SIMPLE } [ ; ] N / CLAUSE SUITE / MATCH / @ WALRUS N )
stmts = STMT { STMT }
module = { STMT }
"""

JS = """
ATOM = ( NAME / LIT / P:args / S:arr / B:obj / FUNC / CLASS / [ async ] ( NAME / P:params [ RET ] ) => B:stmts / import P:args / import . NAME / new . NAME / NOTHING )
FUNC = [ async ] function [ * ] [ NAME ] [ TARGS ] P:params [ RET ] B:stmts
CLASS = { DECOR } [ ABSTRACT ] class [ NAME ] [ TARGS ] [ extends EXTEND ] [ IMPL ] B:cls
EXTEND = ( NAME / P:args / CLASSLESS ) { . ANYNAME / P:args / S:arr } [ TARGS ]
CLASSLESS = null
DECOR = @ NAME { . ANYNAME } [ P:args ]
POST = ( . ANYNAME / ?. ( ANYNAME / P:args / S:arr ) / [ TARGS ] P:args / S:arr / STR / INC / NONNULL )
OPERAND = { UN / [ async ] [ TARGS ] ( NAME / P:params [ RET ] ) => } ( ATOM { POST } [ ASTYPE ] / yield )
OPS = OPERAND { BIN OPERAND }
EXPR = OPS { ? OPS { ? OPS : OPS } : OPS }
EXPRS = EXPR { , EXPR }
ARG = [ ... ] EXPR
args = [ ( ARG { , ARG } [ , ] ) ]
arr = { , } [ ARG { , { , } ARG } { , } ]
PARAM = { DECOR } { MOD } [ ... ] ( NAME / this / S:arr / B:obj ) [ OPTIONAL ] [ ANN ] [ = EXPR ]
params = [ PARAM { , PARAM } [ , ] ]
DECL = ( NAME / S:arr / B:obj ) [ DEFINITE ] [ ANN ] [ = EXPR ]
DECLS = DECL { , DECL }
for = ( [ VAR DECLS / EXPRS ] ; [ EXPRS ] ; [ EXPRS ] / [ VAR ] ( NAME / S:arr / B:obj ) [ ANN ] ( of / in ) EXPRS )
KEY = ( ANYNAME / STR / NUM / S:arr )
PROP = ( KEY : EXPR / NAME [ = EXPR ] / ... EXPR / { GETSET } [ * ] KEY [ TARGS ] P:params [ RET ] B:stmts )
obj = [ PROP { , PROP } [ , ] ] [ BREAK ]
MEMBER = ( { DECOR [ BREAK ] } { GETSET / MOD } [ * ] KEY [ OPTIONAL ] [ DEFINITE ] ( [ TARGS ] P:params [ RET ] ( B:stmts / BODYLESS ) / [ ANN ] [ = EXPR ] ENDM ) / static B:stmts / ENDM / INDEXSIG )
cls = { MEMBER }
ENDM = ( ; / BREAK )
sw = { BREAK } { ( case EXPRS / default ) : { STMT } }
SPEC = ( ANYNAME / STR ) [ as ( ANYNAME / STR ) ]
names = [ [ TYPEWORD ] SPEC { , [ TYPEWORD ] SPEC } [ , ] ] [ BREAK ]
FROM = from STR [ with B:obj ] END
END = ( ; / BREAK )
CTRL = ( ( if / while / with ) P:args / for [ await ] P:for / NAME : / else / do / try )
CORE = ( B:stmts / ; / BREAK / VAR DECLS END / [ async ] function [ * ] NAME [ TARGS ] P:params [ RET ] ( B:stmts / BODYLESS ) / CLASSDECL / ( return / throw ) [ EXPRS ] END / ( break / continue / debugger ) [ NAME ] END / catch [ P:params ] B:stmts / finally B:stmts / switch P:args B:sw / while P:args END / EXPRS END / TSDECL )
CLASSDECL = { DECOR [ BREAK ] } [ ABSTRACT ] class NAME [ TARGS ] [ extends EXTEND ] [ IMPL ] B:cls
STMT = { CTRL [ BREAK ] } CORE
EXPORT = export ( default ( EXPR END / FUNC / CLASS ) / VAR DECLS END / [ async ] function [ * ] NAME [ TARGS ] P:params [ RET ] ( B:stmts / BODYLESS ) / CLASSDECL / [ TYPEWORD ] B:names [ from STR ] END / [ TYPEWORD ] * [ as ANYNAME ] FROM / TSDECL )
IMPORT = import [ TYPEWORD ] ( STR END / NAME [ , ( B:names / * as NAME ) ] FROM / B:names FROM / * as NAME FROM )
stmts = { STMT }
module = { STMT / EXPORT / IMPORT }
"""
JS_ONLY = """
RET = NOTHING
TARGS = NOTHING
IMPL = NOTHING
ABSTRACT = NOTHING
NONNULL = NOTHING
ASTYPE = NOTHING
MOD = static
OPTIONAL = NOTHING
DEFINITE = NOTHING
ANN = NOTHING
BODYLESS = NOTHING
INDEXSIG = NOTHING
TYPEWORD = NOTHING
TSDECL = NOTHING
"""
TS_ONLY = """
PRIM = { TYPEOP } ( ANYNAME { . ANYNAME } [ GENERIC ] / LIT / - NUM / B:tobj / S:typ / P:typ / import P:args { . NAME } [ GENERIC ] ) { S:typ }
ARROW = [ new ] [ GENERIC ] P:params =>
UNION = [ BAR ] { ARROW } PRIM { BAR { ARROW } PRIM }
TYPE = [ [ asserts ] ( NAME / this ) is ] UNION { extends UNION ? UNION : UNION }
TELEM = ( [ ... ] [ NAME [ ? ] : ] TYPE [ ? ] )
typ = [ TELEM { , TELEM } [ , ] ]
TMEMBER = ( { TMOD } ( KEY [ ? ] ( [ GENERIC ] P:params [ : TYPE ] / [ : TYPE ] ) / [ new ] [ GENERIC ] P:params [ : TYPE ] / INDEX ) ( ; / , / BREAK ) / ; / BREAK )
INDEX = { TMOD } S:index [ ? / - ? ] : TYPE
index = ( NAME : TYPE / NAME in TYPE [ as TYPE ] )
tobj = { TMEMBER } [ { TMOD } ( KEY [ ? ] ( [ GENERIC ] P:params [ : TYPE ] / [ : TYPE ] ) / [ new ] [ GENERIC ] P:params [ : TYPE ] / INDEX ) ]
RET = : TYPE
TARGS = GENERIC
IMPL = implements TYPE { , TYPE }
ABSTRACT = abstract
NONNULL = !
ASTYPE = ( as / satisfies ) TYPE { ( as / satisfies ) TYPE }
MOD = MODS
OPTIONAL = ?
DEFINITE = !
ANN = : TYPE
BODYLESS = ( ; / BREAK )
INDEXSIG = { MOD } S:index : TYPE ENDM
TYPEWORD = type
enum = [ ( NAME / STR ) [ = EXPR ] { , ( NAME / STR ) [ = EXPR ] } [ , ] ] [ BREAK ]
TSDECL = [ declare ] ( interface NAME [ GENERIC ] [ extends TYPE { , TYPE } ] B:tobj / type NAME [ GENERIC ] = TYPE END / [ const ] enum NAME B:enum / ( namespace / module ) ( NAME { . NAME } / STR ) B:module / VAR DECLS END / function NAME [ GENERIC ] P:params [ RET ] END / CLASSDECL )
"""

JAVA = """
ANNOT = @ QN [ P:ann ]
QN = NAME { . NAME }
ann = [ ( EXPR / B:arr / NAME = ( EXPR / B:arr / ANNOT ) { , NAME = ( EXPR / B:arr / ANNOT ) } / ANNOT ) ]
TYPE = { ANNOT } NAME [ GENERIC ] { . NAME [ GENERIC ] } { S:empty }
empty = [ NOTHING ]
types = TYPE { & TYPE }
ATOM = ( NAME / LIT / this / super / P:args / new { ANNOT } NAME [ GENERIC ] { . NAME [ GENERIC ] } ( P:args [ B:cls ] / S:expr { S:expr } { S:empty } / S:empty { S:empty } B:arr ) / switch P:args B:sw / ( NAME / P:args / P:params ) -> B:stmts / NAME GENERIC / NOTHING )
POST = ( . ( [ GENERIC ] NAME / this / super / class / new NAME [ GENERIC ] P:args [ B:cls ] ) / P:args / S:expr / S:empty / INC / :: ( NAME / new ) )
OPERAND = { UN / P:types / ( NAME / P:args / P:params ) -> } ATOM { POST }
OPS = OPERAND { BIN OPERAND / instanceof [ final ] TYPE [ NAME / P:params ] }
EXPR = OPS { ? OPS { ? OPS : OPS } : OPS }
expr = EXPR
args = [ EXPR { , EXPR } ]
arr = [ ( EXPR / B:arr ) { , ( EXPR / B:arr ) } ] [ , ]
PARAM = { final / ANNOT } TYPE [ ... ] ( NAME / [ NAME . ] this ) { S:empty }
params = [ PARAM { , PARAM } ]
DECL = NAME { S:empty } [ = ( EXPR / B:arr ) ]
LOCAL = { final / ANNOT } TYPE DECL { , DECL }
for = ( [ LOCAL / EXPR { , EXPR } ] ; [ EXPR ] ; [ EXPR { , EXPR } ] / { final / ANNOT } TYPE NAME : EXPR )
res = ( LOCAL / EXPR ) { ; ( LOCAL / EXPR ) } [ ; ]
catch = { final / ANNOT } TYPE { BAR TYPE } NAME
LABEL = ( case ( EXPR { , EXPR } / TYPE ( NAME / P:params ) [ when EXPR ] ) / default )
sw = { LABEL ( : { STMT } / -> ( B:stmts / EXPR ; / throw EXPR ; ) ) }
CTRL = ( ( if / while ) P:args / for P:for / NAME : / else / do )
CORE = ( B:stmts / ; / LOCAL ; / EXPR { , EXPR } ; / ( return / throw / yield ) [ EXPR ] ; / ( break / continue ) [ NAME ] ; / try [ P:res ] B:stmts { catch P:catch B:stmts } [ finally B:stmts ] / switch P:args B:sw / synchronized P:args B:stmts / assert EXPR [ : EXPR ] ; / CLASS )
STMT = { CTRL } CORE
stmts = { STMT }
THROWS = throws TYPE { , TYPE }
CLASS = { MOD / ANNOT } ( class NAME [ GENERIC ] [ extends TYPE ] [ implements TYPES ] [ permits TYPES ] B:cls / interface NAME [ GENERIC ] [ extends TYPES ] [ permits TYPES ] B:cls / enum NAME [ implements TYPES ] B:enum / record NAME [ GENERIC ] P:params [ implements TYPES ] B:cls / @ interface NAME B:cls )
TYPES = TYPE { , TYPE }
MEMBER = ( { MOD / ANNOT } [ GENERIC ] ( TYPE NAME P:params { S:empty } [ THROWS ] ( B:stmts / [ default ( EXPR / B:arr ) ] ; ) / NAME P:params [ THROWS ] B:stmts / NAME B:stmts / TYPE DECL { , DECL } ; ) / CLASS / [ static ] B:stmts / ; )
cls = { MEMBER }
ENUMC = { ANNOT } NAME [ P:args ] [ B:cls ]
enum = [ ENUMC { , ENUMC } ] [ , ] [ ; { MEMBER } ]
module = [ { ANNOT } package QN ; ] { import [ static ] QN [ . * ] ; / ; } { CLASS / ; }
"""

GO = """
BASE = ( NAME [ . NAME ] [ S:types ] / struct B:fields / interface B:iface / func P:params [ RESULT ] / P:types )
TYPE = { * / S:len / chan [ <- ] / <- chan / map S:types } BASE
RESULT0 = { * / S:len / chan [ <- ] / <- chan / map S:types } ( NAME [ . NAME ] [ S:types ] / struct B:fields / interface B:iface / P:types / func P:params )
RESULT = ( RESULT0 / P:params )
types = TYPE { , TYPE } [ , ]
len = [ ( EXPR / ... ) ]
ATOM = ( NAME / LIT / P:args / P:types / func P:params [ RESULT ] B:stmts / NAME [ . NAME ] [ S:types ] B:lit / { S:len / map S:types } S:len TYPE ( B:lit / P:args ) / map S:types TYPE ( B:lit / P:args ) / S:len TYPE ( B:lit / P:args ) / struct B:fields B:lit / ( chan / map S:types / interface B:iface / * ) TYPE / interface B:iface / NOTHING )
POST = ( . NAME / . P:types / . P:typ / P:args / S:sub )
typ = type
OPERAND = { UN } ATOM { POST }
EXPR = OPERAND { BIN OPERAND }
EXPRS = EXPR { , EXPR }
ARG = ( EXPR / { S:len / map S:types } TYPE )
args = [ ARG { , ARG } [ ... ] [ , ] ]
sub = ( TYPE { , TYPE } [ , ] / [ EXPR ] : [ EXPR ] [ : EXPR ] / EXPR )
ELEM = ( EXPR / B:lit ) [ : ( EXPR / B:lit ) ]
lit = [ ELEM { , ELEM } [ , ] ] [ ; ]
PARAM = ( NAME [ ... ] TYPE / [ ... ] TYPE / NAME )
params = [ PARAM { , PARAM } [ , ] ]
tparams = NAME { , NAME } CONS { , NAME { , NAME } CONS } [ , ]
CONS = { TILDE } TYPE { BAR { TILDE } TYPE }
fields = { [ NAME { , NAME } TYPE [ STR ] / [ * ] NAME [ . NAME ] [ S:types ] [ STR ] ] ; }
iface = { [ NAME P:params [ RESULT ] / CONS ] ; }
SIMPLE = EXPRS [ ( = / := / AUG ) ( EXPRS / range EXPR ) / INC / <- EXPR ]
VARS = NAME { , NAME } ( TYPE [ = EXPRS ] / = EXPRS )
vars = { [ VARS ] ; }
consts = { [ NAME { , NAME } [ [ TYPE ] = EXPRS ] ] ; }
TYPEDEF = NAME [ S:tparams ] [ = ] TYPE
typedefs = { [ TYPEDEF ] ; }
DECL = ( var ( VARS / P:vars ) / const ( NAME { , NAME } [ TYPE ] = EXPRS / P:consts ) / type ( TYPEDEF / P:typedefs ) )
HEAD = if [ SIMPLE ; ] EXPR
CASE = ( case EXPRS / case TYPE { , TYPE } / default ) : { [ STMT ] ; }
sw = { CASE }
sel = { ( case SIMPLE / default ) : { [ STMT ] ; } }
STMT = { NAME : [ ; ] } ( SIMPLE / DECL / B:stmts / return [ EXPRS ] / ( break / continue / goto ) [ NAME ] / fallthrough / ( go / defer ) EXPR / HEAD B:stmts { else HEAD B:stmts } [ else B:stmts ] / for [ [ SIMPLE ] ; [ EXPR ] ; [ SIMPLE ] / EXPR / SIMPLE / range EXPR ] B:stmts / switch [ [ SIMPLE ] ; ] [ SIMPLE ] B:sw / select B:sel )
stmts = { [ STMT ] ; }
IMPORT = [ NAME / . ] STR
imports = { [ IMPORT ] ; }
module = { ; } package NAME ; { import ( IMPORT / P:imports ) ; / ; } { [ DECL / func [ P:params ] NAME [ S:tparams ] P:params [ RESULT ] [ B:stmts ] ] ; }
"""

RUST = """
PATH = [ :: ] ( NAME / GENERIC :: ) [ GENERIC ] { :: ( NAME [ GENERIC ] / GENERIC ) }
TYPE = { & / && / mut / dyn / impl / LIFE / * / const / for GENERIC / ? } ( PATH { [ + ] NOTHING } [ P:types [ -> TYPE1 ] ] / P:types / S:arrtype / ! / [ unsafe ] [ extern [ STR ] ] fn P:types [ -> TYPE1 ] / PATH ! P:* ) { + ( [ ? ] PATH [ P:types [ -> TYPE1 ] ] / LIFE ) }
TYPE1 = { & / && / mut / dyn / impl / LIFE / * / const } ( PATH / P:types / S:arrtype / ! ) { + ( PATH / LIFE ) }
types = [ [ NAME : ] TYPE { , [ NAME : ] TYPE } [ , ] ]
arrtype = TYPE [ ; EXPR ]
PAT1 = ( { & / && / ref / mut / box } ( PATH [ P:pats / B:pat ] [ @ PATX ] / [ - ] LIT / P:pats / S:pats / .. / PATH ! P:* ) [ RANGE [ [ - ] LIT / PATH ] ] / RANGE [ - ] LIT )
PATX = ( [ - ] LIT [ RANGE [ [ - ] LIT ] ] / P:pats / S:pats / .. )
PAT = [ BAR ] PAT1 { BAR PAT1 }
pats = [ PAT { , PAT } [ , ] ]
FPAT = { ATTR } ( { ref / mut } NAME [ : PAT ] / .. )
pat = [ FPAT { , FPAT } [ , ] ]
ATTR = # [ ! ] S:*
MACRO = PATH ! [ NAME ] ( P:* / S:* / B:* )
SATOM = ( PATH [ B:lit ] / LIT / P:args / S:arr / MACRO / [ unsafe ] B:stmts / CLOSURE B:stmts )
SOPERAND = { UN / CLOSURE / RANGE } SATOM { POST }
SEXPR = ( SOPERAND { BIN SOPERAND / RANGE [ SOPERAND ] } / RANGE [ SOPERAND ] / loop B:stmts )
BLOCKY = ( [ LIFE : ] ( [ unsafe / async [ move ] / const ] B:stmts / loop B:stmts / while COND B:stmts / for PAT in SEXPR B:stmts ) / if COND B:stmts { else if COND B:stmts } [ else B:stmts ] / match SEXPR B:arms )
COND = [ let PAT = ] SEXPR { && let PAT = SEXPR }
ATOM = ( PATH [ B:lit ] / LIT / P:args / S:arr / MACRO / BLOCKY / ( break / continue / return ) [ LIFE ] / RANGE / CLOSURE B:stmts / NOTHING )
CLOSURE = [ async ] [ move ] ( || / BAR CPARAM { , CPARAM } [ , ] BAR ) [ -> TYPE ]
CPARAM = PAT1 [ : TYPE ]
POST = ( . ( NAME [ :: GENERIC ] / NUM / await ) / P:args / S:arr / ? / as TYPE1 )
OPERAND = { UN / CLOSURE / RANGE / ( break / return ) [ LIFE ] } ATOM { POST }
EXPR = OPERAND { BIN OPERAND / RANGE [ OPERAND ] }
args = { ATTR } [ EXPR { , EXPR } [ , ] ]
arr = [ EXPR ( { , EXPR } [ , ] / ; EXPR ) ]
FIELD = { ATTR } ( ( NAME / NUM ) [ : EXPR ] / .. [ EXPR ] )
lit = [ FIELD { , FIELD } [ , ] ]
arms = { ATTR } [ ARM { ARM } ]
ARM = { ATTR } PAT [ if COND ] => ( EXPR , / B:stmts [ , ] / EXPR )
LET = let PAT [ : TYPE ] [ = EXPR [ else B:stmts ] ] ;
stmts = { { ATTR } ( ; / ITEM / LET / EXPR ; / BLOCKY / MACRO ) } [ { ATTR } EXPR ]
WHERE = where [ WPRED { , WPRED } [ , ] ]
WPRED = ( [ for GENERIC ] TYPE : TYPE / LIFE : LIFE )
VIS = pub [ P:vis ]
vis = ( NAME / in PATH )
SELF = { ATTR } [ & ] [ LIFE ] [ mut ] self [ : TYPE ]
FPARAM = { ATTR } ( PAT1 : TYPE / ... )
params = [ ( SELF { , FPARAM } / FPARAM { , FPARAM } ) [ , ] ]
FN = { const / async / unsafe / extern [ STR ] } fn NAME [ GENERIC ] P:params [ -> TYPE ] [ WHERE ] ( B:stmts / ; )
SFIELD = { ATTR } [ VIS ] NAME : TYPE
fields = [ SFIELD { , SFIELD } [ , ] ]
tfields = [ { ATTR } [ VIS ] TYPE { , { ATTR } [ VIS ] TYPE } [ , ] ]
VARIANT = { ATTR } NAME [ P:tfields / B:fields ] [ = EXPR ]
enumv = [ VARIANT { , VARIANT } [ , ] ]
USE = [ :: ] ( NAME { :: NAME } [ :: ( * / B:use ) ] [ as NAME ] / B:use / * )
use = [ USE { , USE } [ , ] ]
ITEM = [ VIS ] ( FN / struct NAME [ GENERIC ] ( [ WHERE ] B:fields / P:tfields [ WHERE ] ; / ; ) / enum NAME [ GENERIC ] [ WHERE ] B:enumv / union NAME [ GENERIC ] B:fields / [ unsafe ] impl [ GENERIC ] [ ! ] [ TYPE for ] TYPE [ WHERE ] B:items / [ unsafe ] trait NAME [ GENERIC ] [ : TYPE ] [ WHERE ] B:items / type NAME [ GENERIC ] [ : TYPE ] [ WHERE ] [ = TYPE ] ; / ( const / static [ mut ] ) NAME : TYPE [ = EXPR ] ; / use USE ; / [ unsafe ] mod NAME ( ; / B:items ) / [ unsafe ] extern [ STR ] B:items / extern crate NAME [ as NAME ] ; ) / MACRO [ ; ]
items = { { ATTR } ( ITEM / ; ) } { ATTR }
module = { { ATTR } ( ITEM / ; ) }
"""

CONTENTS = {
    "python": {"P": ["args", "params", "withs", "names"], "S": ["subs"], "B": ["dict", "stmts", "cases", "module"]},
    "javascript": {"P": ["args", "params", "for"], "S": ["arr"], "B": ["stmts", "obj", "cls", "sw", "names", "module"]},
    "typescript": {"P": ["args", "params", "for", "typ"], "S": ["arr", "typ", "index"], "B": ["stmts", "obj", "cls", "sw", "names", "tobj", "enum", "module"]},
    "java": {"P": ["args", "params", "for", "res", "catch", "ann", "types"], "S": ["empty", "expr"], "B": ["stmts", "cls", "arr", "sw", "enum", "module"]},
    "go": {"P": ["args", "params", "types", "imports", "vars", "consts", "typedefs", "typ"], "S": ["sub", "types", "len", "tparams"], "B": ["stmts", "fields", "iface", "lit", "sw", "sel", "module"]},
    "rust": {"P": ["args", "params", "types", "pats", "tfields", "vis"], "S": ["arr", "arrtype", "pats"], "B": ["stmts", "fields", "enumv", "lit", "items", "arms", "pat", "use", "module"]},
}


def _sets(language: str) -> dict[str, str]:
    soft = SOFT[language]
    js_un = "! ~ + - ++ -- typeof void delete await new"
    js_bin = "+ - * / % ** == != === !== < > <= >= && || ?? & | ^ << = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= in instanceof"
    words = " ".join(w for w in lexer(language).symbol if w.isalpha())
    return {
        "python": {
            "NAME": f"ID {soft}", "CONST": "None True False ...", "DIV": "/", "UN": "not + - ~ await", "DOTS": ". ...", "BINOR": "|",
            "BIN": "+ - * / // % ** @ << >> & | ^ == != < > <= >= in is and or", "AUG": "+= -= *= /= //= %= **= >>= <<= &= |= ^= @=",
            "WORD": "pass break continue", "SYNC": "N",
        },
        "javascript": {
            "NAME": f"ID {soft}", "ANYNAME": f"ID {words}", "LIT": "NUM STR this super null true false", "INC": "++ --", "UN": js_un,
            "BIN": js_bin, "VAR": "var let const", "GETSET": "get set async static", "SYNC": "; BREAK",
        },
        "typescript": {
            "NAME": f"ID {soft}", "ANYNAME": f"ID {words}", "LIT": "NUM STR this super null true false", "INC": "++ --", "UN": js_un,
            "BIN": js_bin, "VAR": "var let const", "GETSET": "get set async static", "SYNC": "; BREAK", "BAR": "| &",
            "TYPEOP": "keyof readonly typeof infer unique", "TMOD": "readonly get set + -", "MODS": "public private protected readonly override static abstract declare async",
        },
        "java": {
            "NAME": f"ID {soft}", "LIT": "NUM STR null true false", "UN": "! ~ + - ++ --", "INC": "++ --", "BAR": "|",
            "BIN": "+ - * / % == != < > <= >= && || & | ^ << = += -= *= /= %= &= |= ^= <<=", "SYNC": ";",
            "MOD": "public private protected static final abstract synchronized native transient volatile strictfp default sealed",
        },
        "go": {
            "NAME": "ID", "LIT": "NUM STR", "UN": "! ^ + - * & <-", "BIN": "+ - * / % == != < > <= >= && || & | ^ << >> &^ ", "INC": "++ --",
            "AUG": "+= -= *= /= %= &= |= ^= <<= >>= &^=".replace(">>=", ">>="), "TILDE": "~", "BAR": "|", "SYNC": ";",
        },
        "rust": {
            "NAME": "ID self Self super crate union", "LIT": "NUM STR true false", "UN": "! - * & && mut", "RANGE": ".. ..=", "BAR": "|",
            "BIN": "+ - * / % == != < > <= >= && || & | ^ << = += -= *= /= %= &= |= ^= <<=", "SYNC": "; ,",
        },
    }[language]


@lru_cache(8)
def rules(language: str) -> Rules:
    lex = lexer(language)
    own = {"ID": ID, "NUM": NUM, "STR": STR, "N": "N", "BREAK": BREAK, "GENERIC": GENERIC, "LIFE": LIFE, "NOTHING": "\x00", "INDENT": "\x00"}

    def symbol(t: str) -> str:
        if t in own:
            return own[t]
        return lex.symbol.get(t, "\x00")

    text = {
        "python": PYTHON, "javascript": JS + JS_ONLY, "typescript": JS + TS_ONLY, "java": JAVA, "go": GO, "rust": RUST,
    }[language]
    return Rules(text, CONTENTS[language], symbol, _sets(language))
