"""JSON texts as arrays of nodes, in columns: reading, aligning and editing of trees.

A text is cut into tokens by one pattern, and the tokens are folded once with a stack of open containers. That keeps member
order, takes any depth, and tells malformed texts. Everything is an expression on the row: nothing is exchanged and no row
leaves the JVM. The fold runs over chunks of about as many tokens as there are chunks, because Spark copies the state at every
step and arrays must stay short. Two texts that Spark's own reader finds sound are compared without a fold: objects and lists are cut into
their parts by one pattern, level by level, and only parts that differ are looked into.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control characters cannot stand in a JSON text as such, so they serve as marks.
MARK = "\x01"  # of an escape in coded text; before s or # it starts a path's next segment, before e it is itself
GONE = "\x02"  # stands for a removed member
CHUNK = 8  # least number of tokens folded into one piece
WRAPPED = 8  # objects around the only difference that are looked into

_TOKEN = r'("[^"]*+"[:,]?|[{\[]|[}\]],?|[^ \t\r\n{}\[\],:"]++,?|[,:"])'  # with the colon or comma behind it
_PAIR, _BACK, _SPACE = r"\\([\s\S])", "\\", r"[ \t\r\n]"
_PADDED = r'("[^"]*+")|[ \t\r\n]*+([{}\[\],:])[ \t\r\n]*+'  # a string, or punctuation with the white space around it
KEY, END = r'"[^"]*+":', '":'  # of a member in a coded text
BEGIN, LIST = r"\G", r"\["
SCALAR = r'|(")[^"]*+"|[-0-9][^,}\]]*+|([tf])[^,}\]]*+'
_RAW = r"[\x00\x02-\x1f]"
_NAME = r'^("[^"]*+":)[{]'  # of a member that holds an object
NESTED = 6  # levels of a member's value that the pattern of members follows
DEEP = 12  # levels of a text that is compared part by part
_WHOLE = r"^-?(0|[1-9][0-9]*)$"
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_ESCAPE = MARK + r'(?![q\\/bfnrt]|u[0-9a-fA-F]{4})'  # what follows the mark of no valid escape
# Kinds of tokens: 0 {, 1 [, 2 }, 3 ], 4 key, 5 string, 6 whole number, 7 other number, 8 true or false, 9 null, 10 none of these.
# What may come: 0 value, 1 value or ], 2 key, 3 key or }, 4 }, 5 end, 6 nothing (malformed), 7 ]. Acts: 0 malformed, 1 open, 2 scalar, 3 key, 4 close.
_ACTS = (1, 1, 0, 0, 0, 2, 2, 2, 2, 2, 0,
         1, 1, 0, 4, 0, 2, 2, 2, 2, 2, 0,
         0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0,
         0, 0, 4, 0, 3, 0, 0, 0, 0, 0, 0,
         0, 0, 4, 0, 0, 0, 0, 0, 0, 0, 0,
         0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
         0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
         0, 0, 0, 4, 0, 0, 0, 0, 0, 0, 0)
_FRAME = "STRUCT<path: STRING, ord: STRING, obj: BOOLEAN, n: INT, start: INT>"
_NODE = "STRUCT<path: STRING, parent: STRING, ord: STRING, type: STRING, n: INT, start: INT, stop: INT, same: STRING>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _let(name: str, value: str, body: str) -> str:
    """The same in SQL text."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def coded(text: Column) -> Column:
    """Escapes as ``MARK`` and a letter, so that a string holds no quote and ends at the next one."""
    return F.replace(F.regexp_replace(text, r"\\([\s\S])", MARK + "$1"), F.lit(MARK + '"'), F.lit(MARK + "q"))


def restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "q"), F.lit(MARK + '"')), F.lit(MARK), F.lit("\\"))


def _restored(text: str) -> str:
    return f"replace(replace({text}, '{MARK}q', '{MARK}\"'), '{MARK}', '\\\\')"


def _plain(token: str) -> str:
    """SQL for the value of a coded string."""
    return f"CASE WHEN contains({token}, '{MARK}') THEN get_json_object(concat('[', {_restored(token)}, ']'), '$[0]') ELSE substring({token}, 2, char_length({token}) - 2) END"


def _bare(text: str) -> str:
    """SQL for a text coded and without white space; null for one that holds a mark."""
    marked = f"replace(regexp_replace({text}, {_quoted(_PAIR)}, '{MARK}$1'), '{MARK}\"', '{MARK}q')"
    code = f"CASE WHEN contains({text}, {_quoted(_BACK)}) THEN {marked} ELSE {text} END"
    bare = f"CASE WHEN {text} RLIKE {_quoted(_SPACE)} THEN regexp_replace({code}, {_quoted(_PADDED)}, '$1$2') ELSE {code} END"
    return f"CASE WHEN NOT contains({text}, '{MARK}') AND NOT contains({text}, '{GONE}') THEN {bare} END"


def _tokens(bare: str) -> str:
    """SQL for the tokens of a coded text as structs: the token ``t``, the colon or comma behind it ``e`` and its kind ``c``."""
    string = f"CASE WHEN (wild AND u RLIKE '[\\\\x00\\\\x02-\\\\x1f]') OR (contains(u, '{MARK}') AND u RLIKE {_quoted(_ESCAPE)}) THEN 10 "

    def parted(e: str) -> str:
        kind = (
            "CASE u WHEN '{' THEN 0 WHEN '[' THEN 1 WHEN '}' THEN 2 WHEN ']' THEN 3 WHEN 'true' THEN 8 WHEN 'false' THEN 8 WHEN 'null' THEN 9 ELSE "
            f"CASE WHEN startswith(u, '\"') AND char_length(u) > 1 THEN {string} WHEN {e} = ':' THEN 4 ELSE 5 END "
            f"WHEN u RLIKE {_quoted(_WHOLE)} THEN 6 WHEN u RLIKE {_quoted(_NUMBER)} THEN 7 ELSE 10 END END"
        )
        return f"named_struct('t', u, 'e', {e}, 'c', {kind})"

    token = f"CASE WHEN e IN (':', ',') AND char_length(t) > 1 THEN {_let('u', 'left(t, char_length(t) - 1)', parted('e'))} ELSE {_let('u', 't', parted(_quoted('')))} END"
    listed = f"transform(regexp_extract_all({bare}, {_quoted(_TOKEN)}, 1), t -> {_let('e', 'right(t, 1)', token)})"
    return _let("wild", f"{bare} RLIKE {_quoted(_RAW)}", listed)


def _chunks(k: str) -> str:
    size = f"greatest({CHUNK}, CAST(ceil(sqrt(size({k}))) AS INT))"
    return f"transform(sequence(0, (size({k}) - 1) div {size}), j -> slice({k}, CAST(j * {size} + 1 AS INT), {size}))"


def _same(t: str) -> str:
    """SQL for what is equal for equal scalars: whole numbers exactly, others as doubles."""
    double = f"try_cast({t}.t AS DOUBLE)"
    return (f"CASE {t}.c WHEN 5 THEN concat('\"', {_plain(t + '.t')}) WHEN 7 THEN CASE WHEN {double} = floor({double}) AND abs({double}) < 9007199254740992D "
            f"THEN CAST(CAST({double} AS BIGINT) AS STRING) ELSE CAST({double} AS STRING) END WHEN 6 THEN CASE WHEN {t}.t = '-0' THEN '0' ELSE {t}.t END ELSE {t}.t END")


def _shape(k: str) -> str:
    """SQL for the text of tokens with types in place of scalars and only the first item of lists.

    The containers around a token are a string: ``o`` an object, ``a`` a list at its first item, ``z`` a list behind it, whose items are left out.
    """
    rest = "left(s.s, char_length(s.s) - 1)"
    later = lambda x: f"CASE WHEN t.e = ',' AND endswith({x}, 'a') THEN concat(left({x}, char_length({x}) - 1), 'z') ELSE {x} END"
    comma = lambda x: f"CASE WHEN endswith({x}, 'o') THEN t.e ELSE '' END"
    kind = "CASE t.c WHEN 5 THEN '\"string\"' WHEN 8 THEN '\"boolean\"' WHEN 9 THEN 'null' ELSE '\"number\"' END"
    step = f"""named_struct(
      's', CASE WHEN t.c > 4 THEN {later('s.s')} WHEN t.c = 4 THEN s.s WHEN t.c > 1 THEN {later(rest)} ELSE concat(s.s, CASE t.c WHEN 0 THEN 'o' ELSE 'a' END) END,
      'o', CASE WHEN t.c IN (2, 3) THEN CASE WHEN contains({rest}, 'z') THEN s.o ELSE concat(s.o, t.t, {comma(rest)}) END WHEN contains(s.s, 'z') THEN s.o
        WHEN t.c > 4 THEN concat(s.o, {kind}, {comma('s.s')}) WHEN t.c = 4 THEN concat(s.o, t.t, ':') ELSE concat(s.o, t.t) END)"""
    piece = f"aggregate(c, named_struct('s', a.s, 'o', ''), (s, t) -> {step}, s -> named_struct('s', s.s, 'o', array_append(a.o, s.o)))"
    return f"aggregate({_chunks(k)}, named_struct('s', '', 'o', CAST(array() AS ARRAY<STRING>)), (a, c) -> {piece}, a -> array_join(a.o, ''))"


def _leaves(k: str) -> str:
    """SQL for the strings, numbers and booleans of tokens, equal where they are equal."""
    return f"transform(filter({k}, t -> t.c IN (5, 6, 7, 8)), t -> {_same('t')})"


def _sound(text: str) -> str:
    """SQL for whether Spark's own reader takes a text whole, without a member name given twice; it stops behind the first value,
    and what is behind one cannot go on both as a list's next item and as an object's next member."""
    return f"try_parse_json(concat('[', {text}, ']')) IS NOT NULL AND try_parse_json(concat('{{\"x\":', {text}, '}}')) IS NOT NULL"


def _value(levels: int) -> str:
    """The pattern of a value in a coded text, at most ``levels`` levels deep. Nothing is tried twice."""
    part = r'(?:"[^"]*+"|[^{}\[\]"]++)'
    inner = part
    for _ in range(levels):
        inner = rf'(?:{part}|[{{\[]{inner}*+[}}\]])'
    return rf'(?:"[^"]*+"|[^{{}}\[\]",]++|[{{\[]{inner}*+[}}\]])'


def _members() -> str:
    """The pattern of an object's next member in a coded text, its value at most ``NESTED`` levels deep."""
    return rf'\G[{{,]("[^"]*+":{_value(NESTED)})'


def _unlike(a: str, b: str, levels: int) -> str:
    """SQL for a struct of two coded texts without the members that both have word by word; texts that are no objects stay as they are.

    Where one member of each is left, of one name and an object in both, its members are compared in the same way, ``levels`` objects deep.
    What is left out is equal at equal paths, so it holds no difference and lies in no list around one. Texts must be sound.
    """
    def members(text):
        return _let("m", f"regexp_extract_all({text}, {_quoted(_members())}, 1)", f"CASE WHEN concat('{{', array_join(m, ','), '}}') = {text} THEN m END")

    name = lambda d: f"regexp_extract({d}[0], {_quoted(_NAME)}, 1)"
    inner = lambda d: f"substring({d}[0], char_length({name('v.a')}) + 1)"
    only = f"size(v.a) = 1 AND size(v.b) = 1 AND {name('v.a')} <> '' AND {name('v.a')} = {name('v.b')}"
    whole = lambda d: f"concat('{{', array_join({d}, ','), '}}')"
    state = lambda h, x, y, t, go: f"named_struct('h', {h}, 'a', {x}, 'b', {y}, 't', {t}, 'go', {go})"
    split = _let("w", f"named_struct('a', {members('s.a')}, 'b', {members('s.b')})", _let(
        "v", "named_struct('a', array_except(w.a, w.b), 'b', array_except(w.b, w.a))",
        f"CASE WHEN v.a IS NULL OR v.b IS NULL THEN {state('s.h', 's.a', 's.b', 's.t', 'false')} "
        f"WHEN {only} THEN {state('concat(s.h, ' + _quoted('{') + ', ' + name('v.a') + ')', inner('v.a'), inner('v.b'), 'concat(' + _quoted('}') + ', s.t)', 'true')} "
        f"ELSE {state('s.h', whole('v.a'), whole('v.b'), 's.t', 'false')} END"))
    return (f"aggregate(sequence(1, {levels}), {state(_quoted(''), a, b, _quoted(''), 'true')}, (s, i) -> CASE WHEN s.go THEN {split} ELSE s END, "
            "s -> named_struct('a', concat(s.h, s.a, s.t), 'b', concat(s.h, s.b, s.t)))")


# What a comparison part by part finds: -1 no difference, 0 two objects or two lists to be looked into, one of SIDES, a list in another order.
SIDES = ("left", "right", "null", "type", "length", "value", "custom")
MOVED = 8
_FOUND = "STRUCT<k: INT, p: STRING, a: STRING, b: STRING, n: INT, m: INT, r: STRING>"
_NONE = f"CAST(array() AS ARRAY<{_FOUND}>)"
_NULL = "CAST(NULL AS STRING)"


def _found(k: int | str, p: str, a: str, b: str, r: str, n: str = "CAST(NULL AS INT)", m: str = "CAST(NULL AS INT)") -> str:
    return f"named_struct('k', {k}, 'p', {p}, 'a', {a}, 'b', {b}, 'n', {n}, 'm', {m}, 'r', {r})"


def _parted(text: str) -> str:
    """SQL for the members of a coded object or the items of a list; null for another text and one that is more than ``DEEP`` levels deep."""
    cut = lambda first, name: f"regexp_extract_all({text}, {_quoted(rf'{BEGIN}[{first},]({name}{_value(DEEP)})')}, 1)"
    return f"CASE WHEN startswith({text}, '{{') THEN {cut('{', KEY)} WHEN startswith({text}, '[') THEN {cut(LIST, '')} END"


def _whole(parts: str, text: str) -> str:
    return f"CASE WHEN concat(left({text}, 1), array_join({parts}, ','), right({text}, 1)) = {text} THEN {parts} END"


def _key(member: str) -> str:
    """SQL for the name of a coded member, as it stands in a path."""
    name = f"substring({member}, 2, locate('\":', {member}, 2) - 2)"
    return f"CASE WHEN contains({name}, '{MARK}') THEN replace({_plain(f'left({member}, locate({_quoted(END)}, {member}, 2))')}, '{MARK}', '{MARK}e') ELSE {name} END"


def _held(member: str) -> str:
    """SQL for the value of a coded member."""
    return f"substring({member}, locate('\":', {member}, 2) + 2)"


def _type(text: Column) -> Column:
    """The type of a coded value."""
    first = text.substr(1, 1)
    kinds = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
    return reduce(lambda c, k: c.when(first == k, kinds[k]), list(kinds)[1:], F.when(first == "{", "object")).otherwise("number")


def _alike(a: str, b: str) -> str:
    """SQL for whether two coded strings, numbers or booleans of other texts are equal."""
    string = lambda t: f"startswith({t}, '\"')"
    word = lambda t: f"left({t}, 1) IN ('t', 'f')"
    digits = lambda t: f"{t} RLIKE '^[0-9]++$'"
    number = lambda t: _let("u", f"named_struct('t', {t}, 'c', CASE WHEN {t} RLIKE {_quoted(_WHOLE)} THEN 6 ELSE 7 END)", _same("u"))
    return (f"CASE WHEN {string(a)} OR {string(b)} THEN {string(a)} AND {string(b)} AND (contains({a}, '{MARK}') OR contains({b}, '{MARK}')) AND {_plain(a)} <=> {_plain(b)} "
            f"WHEN {word(a)} OR {word(b)} OR ({digits(a)} AND {digits(b)}) THEN false ELSE {number(a)} = {number(b)} END")


def _verdict(h: str, stops: Iterable[str]) -> str:
    """SQL for what two coded values ``h.a`` and ``h.b`` of other texts at the path ``h.p`` are."""
    first = lambda t: f"translate(left({t}, 1), '-123456789f', '0000000000t')"
    stop = "".join(f"WHEN {h}.p = {_quoted(s)} THEN 7 " for s in stops)
    return (f"CASE {stop}WHEN {first(f'{h}.a')} = {first(f'{h}.b')} THEN CASE WHEN left({h}.a, 1) IN ('{{', '[') THEN 0 WHEN {_alike(f'{h}.a', f'{h}.b')} THEN -1 ELSE 6 END "
            f"WHEN left({h}.a, 1) = 'n' OR left({h}.b, 1) = 'n' THEN 3 ELSE 4 END")


def _judged(place: str, a: str, b: str, r: str, stops: Iterable[str]) -> str:
    return _let("h", f"named_struct('p', {place}, 'a', {a}, 'b', {b})", _found(_verdict("h", stops), "h.p", "h.a", "h.b", r))


def _unlike_members(path: str, r: str, a: str, b: str, stops: Iterable[str]) -> str:
    """SQL for what is found in the members that one of two objects has, ``a`` and ``b``."""
    at = lambda key: f"concat({path}, '{MARK}s', {key})"
    left = _let("key", _key("x"), _let("j", "CAST(array_position(kb, key) AS INT)", (
        f"CASE WHEN j > 0 THEN {_judged(at('key'), _held('x'), _held(f'get({b}, j - 1)'), r, stops)} ELSE {_found(1, at('key'), _held('x'), _NULL, r)} END")))
    lone = (f"transform(filter({b}, (x, i) -> NOT array_contains(ka, get(kb, i))), x -> {_found(2, at(_key('x')), _NULL, _held('x'), r)})")
    right = f"CASE WHEN size({b}) = 0 THEN {_NONE} ELSE " + _let("ka", f"transform({a}, x -> {_key('x')})", lone) + " END"
    return _let("kb", f"transform({b}, x -> {_key('x')})", f"flatten(array(transform({a}, x -> {left}), {right}))")


def _opened(q: str, stops: Iterable[str]) -> str:
    """SQL for what is found in two objects or two lists."""
    both = f"named_struct('a', {_parted(f'{q}.a')}, 'b', {_parted(f'{q}.b')})"
    objects = _let("v", "named_struct('a', array_except(w.a, w.b), 'b', array_except(w.b, w.a))", _unlike_members(f"{q}.p", f"{q}.r", "v.a", "v.b", stops))
    within = "least(size(w.a), size(w.b))"
    item = _judged(f"concat({q}.p, '{MARK}#', CAST(i AS STRING))", "get(w.a, i)", "get(w.b, i)", f"CASE WHEN o THEN {q}.p ELSE {q}.r END", stops)
    lists = _let(
        "o", f"{q}.r IS NULL AND size(w.a) = size(w.b) AND sort_array(w.a) = sort_array(w.b)",
        f"flatten(array(CASE WHEN {within} > 0 THEN transform(filter(sequence(0, {within} - 1), i -> get(w.a, i) <> get(w.b, i)), i -> {item}) ELSE {_NONE} END, "
        f"CASE WHEN size(w.a) <> size(w.b) THEN array({_found(5, f'{q}.p', f'{q}.a', f'{q}.b', f'{q}.r', 'size(w.a)', 'size(w.b)')}) "
        f"WHEN o THEN array({_found(MOVED, f'{q}.p', f'{q}.a', _NULL, _NULL)}) ELSE {_NONE} END))")
    return _let("w", both, f"CASE WHEN startswith({q}.a, '{{') THEN {objects} ELSE {lists} END")


def _compared(a: str, b: str, ma: str, mb: str, root: str, stops: Iterable[str]) -> str:
    """SQL for the differences of two sound coded texts at most ``DEEP`` levels deep, as ``_FOUND`` structs; ``ma`` and ``mb`` are their parts, if they have any.

    Objects are paired by name and lists by place, one level a round, and only what differs is looked into again.
    """
    members = _let("v", f"named_struct('a', array_except({ma}, {mb}), 'b', array_except({mb}, {ma}))", _unlike_members(_quoted(root), _NULL, "v.a", "v.b", stops))
    start = (f"CASE WHEN {a} = {b} THEN {_NONE} WHEN startswith({a}, '{{') AND startswith({b}, '{{') THEN {members} "
             f"ELSE array({_judged(_quoted(root), a, b, _NULL, stops)}) END")
    state = lambda todo, done: f"named_struct('todo', {todo}, 'done', {done})"
    parts = lambda of: state(f"filter({of}, f -> f.k = 0)", f"filter({of}, f -> f.k > 0)")
    step = _let("e", f"flatten(transform(s.todo, q -> {_opened('q', stops)}))", state("filter(e, f -> f.k = 0)", "flatten(array(s.done, filter(e, f -> f.k > 0)))"))
    rounds = f"aggregate(sequence(1, {DEEP} + 2), {parts('d')}, (s, n) -> CASE WHEN size(s.todo) = 0 THEN s ELSE {step} END, s -> CASE WHEN size(s.todo) = 0 THEN s.done END)"
    return _let("d", start, f"CASE WHEN exists(d, f -> f.k < 1) THEN {rounds} ELSE d END")


def _leaf_texts(code: str) -> str:
    """SQL for the strings, numbers and booleans of a sound coded text, as they stand there."""
    pattern = KEY + r'|("[^"]*+"|[-0-9tf][^,}\]]*+)'
    return f"array_remove(regexp_extract_all({code}, {_quoted(pattern)}, 1), '')"


def _shape_text(code: str) -> str:
    """:func:`_shape` of a sound coded text at most ``DEEP`` levels deep. Each scalar is a mark and a letter until names are told from strings."""
    text = f"regexp_replace({code}, {_quoted('(' + KEY + ')' + SCALAR)}, '$1{GONE}$2$3')"
    for old, made in (('":' + GONE, '":'), (GONE + '"', '"string"'), (GONE + "t", '"boolean"'), (GONE + "f", '"boolean"'), (GONE, '"number"')):
        text = f"replace({text}, {_quoted(old)}, {_quoted(made)})"
    rest = rf'("[^"]*+")|(?:,{_value(DEEP)})++(?=\])'  # the items behind a list's first
    return f"regexp_replace({text}, {_quoted(rest)}, '$1')"


def _parts(text: str, root: str, ordered: bool, k: str, f: str, read: bool = True) -> tuple[str, str, str]:
    """A JSON text, given as an SQL expression, as SQL for its tokens ``k``, their fold ``f`` and, of both, a struct: ``nodes`` (path, parent, ord, type, n, start, stop, same), ``tokens``.

    Nodes come in the order they end. A path is the root and a segment for each step, ``MARK s key`` or ``MARK # place``; ``ord``, if
    ``ordered``, sorts the nodes of a text as they begin; ``n`` counts a container's children; ``start`` and ``stop`` are the places of its
    tokens, from 1; ``same`` is equal for equal scalars (whole numbers exactly, others as doubles), lists of equal length and objects.
    A token holds the colon or comma behind it. Null for a null or malformed text; a member name given twice makes two nodes of one
    path. The text is coded already if not ``read``.
    """
    m = MARK
    act = f"get(array({', '.join(map(str, _ACTS))}), s.want * 11 + t.c)"
    path = f"CASE WHEN s.top IS NULL THEN {_quoted(root)} WHEN s.top.obj THEN concat(s.top.path, '{m}s', s.key) ELSE concat(s.top.path, '{m}#', CAST(s.top.n AS STRING)) END"
    order = "CASE WHEN s.top IS NULL THEN '' ELSE concat(s.top.ord, '.', lpad(CAST(s.top.n AS STRING), 8, '0')) END" if ordered else "''"
    count = "CASE WHEN s.want IN (1, 3) THEN 0 ELSE s.top.n + 1 END"
    same = _same("t")
    frame = f"named_struct('path', {path}, 'ord', {order}, 'obj', t.c = 0, 'n', 0, 'start', s.i)"
    node = (f"named_struct('path', {path}, 'parent', s.top.path, 'ord', {order}, 'type', CASE t.c WHEN 5 THEN 'string' WHEN 8 THEN 'boolean' WHEN 9 THEN 'null' ELSE 'number' END, "
            f"'n', CAST(NULL AS INT), 'start', s.i, 'stop', s.i, 'same', {same})")
    whole = ("named_struct('path', s.top.path, 'parent', get(s.stack, size(s.stack) - 1).path, 'ord', s.top.ord, 'type', CASE WHEN s.top.obj THEN 'object' ELSE 'array' END, "
             f"'n', {count}, 'start', s.top.start, 'stop', s.i, 'same', CASE WHEN s.top.obj THEN '{{' ELSE concat('[', CAST({count} AS STRING)) END)")
    bump = lambda f: f"CASE WHEN t.e = ',' THEN named_struct('path', {f}.path, 'ord', {f}.ord, 'obj', {f}.obj, 'n', {f}.n + 1, 'start', {f}.start) ELSE {f} END"
    after = lambda f: f"CASE WHEN {f} IS NULL THEN CASE WHEN t.e = ',' THEN 6 ELSE 5 END WHEN {f}.obj THEN CASE WHEN t.e = ',' THEN 2 ELSE 4 END ELSE CASE WHEN t.e = ',' THEN 0 ELSE 7 END END"
    up = "get(s.stack, size(s.stack) - 1)"
    # bound values are copied whole, so the state is not. The act is looked up once, for what may come next: a malformed text never
    # comes back from there, so the rest goes by the kind alone
    step = f"""named_struct(
      'top', CASE WHEN t.c > 4 THEN {bump('s.top')} WHEN t.c = 4 THEN s.top WHEN t.c > 1 THEN {bump(up)} ELSE {frame} END,
      'stack', CASE WHEN t.c > 3 THEN s.stack WHEN t.c > 1 THEN slice(s.stack, 1, greatest(size(s.stack) - 1, 0)) ELSE array_append(s.stack, s.top) END,
      'want', CASE WHEN {act} = 0 THEN 6 WHEN t.c > 4 THEN {after('s.top')} WHEN t.c = 4 THEN 0 WHEN t.c > 1 THEN {after(up)} WHEN t.c = 0 THEN 3 ELSE 1 END,
      'key', CASE WHEN t.c = 4 THEN replace({_plain('t.t')}, '{m}', '{m}e') ELSE s.key END,
      'nodes', CASE WHEN t.c > 4 THEN array_append(s.nodes, {node}) WHEN t.c > 1 AND t.c < 4 THEN array_append(s.nodes, {whole}) ELSE s.nodes END,
      'i', s.i + 1)"""
    zero = (f"named_struct('top', CAST(NULL AS {_FRAME}), 'stack', CAST(array() AS ARRAY<{_FRAME}>), 'want', 0, 'key', '', "
            f"'nodes', CAST(array() AS ARRAY<ARRAY<{_NODE}>>), 'i', 1)")
    piece = (f"aggregate(c, named_struct('top', a.top, 'stack', a.stack, 'want', a.want, 'key', a.key, 'nodes', CAST(array() AS ARRAY<{_NODE}>), 'i', a.i), "
             f"(s, t) -> {step}, s -> named_struct('top', s.top, 'stack', s.stack, 'want', s.want, 'key', s.key, 'nodes', concat(a.nodes, array(s.nodes)), 'i', s.i))")
    made = f"CASE WHEN {f}.want = 5 THEN named_struct('nodes', flatten({f}.nodes), 'tokens', transform({k}, t -> concat(t.t, t.e))) END"
    folded = f"aggregate({_chunks(k)}, {zero}, (a, c) -> {piece})"
    return _let("b", _bare(text), _tokens("b")) if read else _tokens(text), folded, made


def json_tree(text: str, root: str = "$", ordered: bool = False) -> str:
    """:func:`_parts` as one SQL expression."""
    tokens, folded, made = _parts(text, root, ordered, "k", "f")
    return _let("k", tokens, f"CASE WHEN size(k) > 0 THEN {_let('f', folded, made)} END")


def with_tree(rows: DataFrame, text: str, out: str, root: str = "$", ordered: bool = False, read: bool = True) -> DataFrame:
    """``rows`` with the tree of ``text`` as a column; its parts are columns, so that none is copied. The text is coded already if not ``read``."""
    tokens, folded, made = _parts(text, root, ordered, f"{out}_k", f"{out}_f", read)
    rows = rows.withColumn(f"{out}_k", F.expr(tokens)).withColumn(f"{out}_f", F.expr(f"CASE WHEN size({out}_k) > 0 THEN {folded} END"))
    return rows.withColumn(out, F.expr(made)).drop(f"{out}_k", f"{out}_f")


def plain(token: Column) -> Column:
    """The value of a coded string token."""
    inner = F.substring(token, F.lit(2), F.char_length(token) - 2)
    return F.when(F.contains(token, F.lit(MARK)), F.get_json_object(F.concat(F.lit("["), restored(token), F.lit("]")), "$[0]")).otherwise(inner)


def text_of(tree: Column, node: Column) -> Column:
    """The JSON text of a node, without white space."""
    return F.rtrim(restored(F.array_join(F.slice(tree["tokens"], node["start"], node["stop"] - node["start"] + 1), "")), F.lit(","))


def value_of(tree: Column, node: Column) -> Column:
    """A string's value, null for null, else the JSON text."""
    return F.when(node["type"] == "string", plain(F.rtrim(F.get(tree["tokens"], node["start"] - 1), F.lit(",")))).when(node["type"] != "null", text_of(tree, node))


def segments_of(path: Column) -> Column:
    """Root, member names, and ``#place`` for list items."""
    back = lambda s: F.replace(F.substring(s, F.lit(2), F.char_length(s)), F.lit(MARK + "e"), F.lit(MARK))
    parts = F.split(path, MARK + "(?=[s#])")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.when(s.startswith("s"), back(s)).otherwise(s))
    return F.concat(F.slice(parts, 1, 1), tail)


def _place(segments: Iterable[str]) -> str:
    """:func:`path_of` given segments."""
    first, *rest = segments
    return first + "".join(MARK + s if re.fullmatch(r"#[0-9]+", s) else f"{MARK}s{s.replace(MARK, MARK + 'e')}" for s in rest)


def path_of(segments: Column) -> Column:
    """The path of segments; a segment ``#`` and digits is a list place."""
    def step(s):
        return F.when(s.rlike(r"^#\d+$"), F.concat(F.lit(MARK), s)).otherwise(F.concat(F.lit(MARK + "s"), F.replace(s, F.lit(MARK), F.lit(MARK + "e"))))

    return F.concat(F.get(segments, F.lit(0)), F.array_join(F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), step), ""))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of character bigrams, white space ignored. What both texts begin and end with is counted without looking it up."""
    def grams(text):
        return let(F.split(text, ""), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda p, q: F.concat(p, q)))

    def alike(x, y):
        return F.array_position(F.concat(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.array(F.lit(False))), False).cast("int") - 1

    def tail(x, n):
        return F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))

    def middle(s):
        p = s["p"]
        return let(F.struct(F.reverse(tail(s["x"], p)).alias("x"), F.reverse(tail(s["y"], p)).alias("y")), lambda r: let(alike(r["x"], r["y"]), lambda q: let(
            F.struct(tail(r["x"], q).alias("x"), tail(r["y"], q).alias("y")), lambda z: p + q + F.aggregate(
                F.array_intersect(z["x"], z["y"]), F.lit(0), lambda n, g: n + F.least(F.size(F.filter(z["x"], lambda h: h == g)), F.size(F.filter(z["y"], lambda h: h == g)))))))

    def in_order(s):
        return let(F.struct(grams(s["a"]).alias("x"), grams(s["b"]).alias("y")), lambda g: let(
            F.struct(g["x"].alias("x"), g["y"].alias("y"), alike(g["x"], g["y"]).alias("p")), middle))

    def pieces(text):  # up to the next comma and the character behind it: all bigrams stand in one piece
        return F.regexp_extract_all(text, F.lit(r"(?s)(?=([^,]*+,?+.?+))(?:[^,]++,?+|,)"), F.lit(1))

    def both(s):  # pieces that both have once are left out; no bigram of theirs is looked up
        two = lambda c: F.flatten(F.transform(c, lambda p: F.regexp_extract_all(p, F.lit("(?s)(?=(..))."), F.lit(1))))
        times = lambda c, g: F.size(c) - F.size(F.array_remove(c, g))
        rest = F.struct(two(F.array_except(s["x"], s["y"])).alias("x"), two(F.array_except(s["y"], s["x"])).alias("y"))
        return let(rest, lambda r: s["n"] - F.size(r["x"]) + F.aggregate(
            F.array_intersect(r["x"], r["y"]), F.lit(0), lambda n, g: n + F.least(times(r["x"], g), times(r["y"], g))))

    def scored(s):
        once = lambda c: F.size(F.array_distinct(c)) == F.size(c)
        size = lambda c: F.char_length(c) - 1
        count = let(F.struct(pieces(s["a"]).alias("x"), pieces(s["b"]).alias("y"), size(s["a"]).alias("n")), lambda p: F.when(once(p["x"]) & once(p["y"]), both(p)))
        return F.lit(2.0) * F.coalesce(count, in_order(s)) / (size(s["a"]) + size(s["b"]))

    flat = lambda t: F.regexp_replace(t, r"\s+", "")
    return let(F.struct(flat(a).alias("a"), flat(b).alias("b")), lambda s: F.when(s["a"] == s["b"], 1.0)
               .when((F.char_length(s["a"]) < 2) | (F.char_length(s["b"]) < 2), 0.0).when(s["a"].isNotNull() & s["b"].isNotNull(), scored(s)))


NODE = ("segments array<string>, side string, base_type string, cand_type string, base_value string, cand_value string, base_len int, cand_len int, reorder array<string>")


def align(rows: DataFrame, base: str, cand: str, out: str, root: str, stops: Iterable[str] = ()) -> DataFrame:
    """``rows`` with the struct ``out``: where the JSON texts ``base`` and ``cand`` (SQL expressions) differ, and how.

    ``nodes`` holds a struct of ``NODE`` for each difference: side ``left`` or ``right`` for a member of one text only, ``null``, ``type``,
    ``length`` and ``value`` for a node of both, ``custom`` at a dotted path of ``stops``, under which nothing is compared. ``reorder`` is the
    outermost list around it that holds the same items in another order. Sound texts are compared part by part (``_compared``); those that are
    not, hold a member name twice or are too deep are read whole, as ``parted`` tells. There, a node of both texts has all its ancestors in both, of the
    same kinds, so only its own and its parent's counterparts are looked up. Equal members are left out before (``_unlike``), except around a stop,
    whose texts are compared whole. ``moved`` has the base text of those lists by path. ``malformed`` tells that a text could not be
    read; then there are no nodes. A missing text is one difference at the root. The column ``out_code`` has the second text coded, and the
    struct ``out_stats`` describes whole texts that differ: ``base_shape``, ``cand_shape``, ``base_leaves``, ``cand_leaves``, ``same_leaves``.
    Each is made only where it is used.
    """
    a, b = F.col("_tree_a"), F.col("_tree_b")
    has_a, has_b = F.expr(f"({base}) IS NOT NULL"), F.expr(f"({cand}) IS NOT NULL")
    rows = rows.withColumn("_code_a", F.expr(_bare(base))).withColumn("_code_b", F.expr(_bare(cand)))
    rows = rows.withColumn("_part_a", F.expr(_parted("_code_a"))).withColumn("_part_b", F.expr(_parted("_code_b")))
    rows = rows.withColumn("_part_a", F.expr(_whole("_part_a", "_code_a"))).withColumn("_part_b", F.expr(_whole("_part_b", "_code_b")))
    # a text whose parts make it up ends with its first value, where Spark's reader stops
    sound = lambda c, text: (f"CASE WHEN _part_{c} IS NOT NULL THEN try_parse_json({text}) IS NOT NULL "  # noqa: E731
                             f"WHEN _code_{c} IS NULL OR left(_code_{c}, 1) IN ('{{', '[') THEN false ELSE {_sound(text)} END")
    ready = f"(({base}) IS NULL OR {sound('a', base)}) AND (({cand}) IS NULL OR {sound('b', cand)})"
    rows = rows.withColumn("_ready", F.lit(False) if root in stops else F.expr(ready))
    quick = F.col("_ready")
    parted = quick & has_a & has_b
    found = _compared("_code_a", "_code_b", "_part_a", "_part_b", root, [_place(s.split(".")) for s in stops])
    rows = rows.withColumn("_found", F.when(parted, F.expr(found)))
    levels = 0 if root in stops else 1 if stops else WRAPPED
    kept = "named_struct('a', _code_a, 'b', _code_b)"
    if levels:
        kept = f"CASE WHEN {_sound(base)} AND {_sound(cand)} THEN {_unlike('_code_a', '_code_b', levels)} ELSE {kept} END"
    rows = rows.withColumn("_kept", F.when(~quick, F.expr(kept)))
    rows = with_tree(with_tree(rows, "_kept.a", "_tree_a", root, read=False), "_kept.b", "_tree_b", root, read=False)

    def shown(tree: Column) -> Column:
        if not stops:
            return tree["nodes"]
        paths = [path_of(F.array(*(F.lit(s) for s in stop.split(".")))) for stop in stops]
        under = lambda n: reduce(lambda x, y: x | y, (n["path"].startswith(F.concat(p, F.lit(MARK))) for p in paths))
        at = lambda n: reduce(lambda x, y: x | y, (n["path"] == p for p in paths))
        return F.transform(F.filter(tree["nodes"], lambda n: ~under(n)), lambda n: F.when(at(n), n.withField("same", F.concat(F.lit(GONE), text_of(tree, n)))).otherwise(n))

    entry = lambda n: F.concat(n["path"], F.lit(MARK + "t"), n["type"].substr(1, 3), n["same"])
    entries = lambda c: F.transform(c, entry)
    both = a.isNotNull() & b.isNotNull()
    none = F.lit(None)
    where = lambda p: F.coalesce(p["a"]["path"], p["b"]["path"])
    around = lambda path, inner: inner.startswith(F.concat(path, F.lit(MARK)))
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def differing(c: Column, x: Column) -> Column:
        return F.when(F.size(x) > 0, F.filter(c, lambda n: F.array_contains(x, entry(n)))).otherwise(F.slice(c, 1, 0))

    def paired(s: Column, d: Column) -> Column:
        objects = lambda c: F.transform(F.filter(c, lambda n: n["type"] == "object"), lambda n: n["path"])
        some = (F.size(d["a"]) > 0) | (F.size(d["b"]) > 0)

        def made(held: Column) -> Column:
            left = F.transform(d["a"], lambda x: pair(x, F.get(F.filter(d["b"], lambda y: y["path"] == x["path"]), F.lit(0))))
            left = F.filter(left, lambda p: p["b"].isNotNull() | F.array_contains(held, p["a"]["parent"]))
            right = F.filter(d["b"], lambda y: ~F.exists(d["a"], lambda x: x["path"] == y["path"]) & F.array_contains(held, y["parent"]))
            return F.concat(left, F.transform(right, lambda y: pair(F.when(F.lit(False), y), y)))

        return let(F.when(some, F.array_intersect(objects(s["a"]), objects(s["b"]))), made)

    def reordered(s: Column, pairs: Column) -> Column:
        """Lists around a difference that hold the same items on both sides."""
        lists = F.filter(s["a"], lambda n: (n["type"] == "array") & F.exists(pairs, lambda p: around(n["path"], where(p))))
        items = lambda tree, c, path: F.sort_array(F.transform(F.filter(c, lambda n: n["parent"] == path), lambda n: text_of(tree, n)))
        held = F.filter(lists, lambda n: F.exists(s["b"], lambda o: (o["path"] == n["path"]) & (o["type"] == "array") & (o["n"] == n["n"])))
        moved = F.filter(held, lambda n: items(a, a["nodes"], n["path"]) == items(b, b["nodes"], n["path"]))
        return F.array_sort(F.transform(moved, lambda n: F.struct(n["path"].alias("path"), text_of(a, n).alias("text"))))

    def node(p: Column, moved: Column) -> Column:
        x, y = p["a"], p["b"]
        two = x.isNotNull() & y.isNotNull()
        side = (F.when(y.isNull(), "left").when(x.isNull(), "right").when(x["same"].startswith(GONE) | y["same"].startswith(GONE), "custom")
                .when((x["type"] == "null") | (y["type"] == "null"), "null").when(x["type"] != y["type"], "type").when(x["type"] == "array", "length").otherwise("value"))
        long = two & (x["type"] == "array") & (y["type"] == "array") & ~x["same"].startswith(GONE)
        outer = F.get(F.filter(moved, lambda m: around(m["path"], where(p))), F.lit(0))["path"]
        return F.struct(
            segments_of(where(p)).alias("segments"), side.alias("side"), F.coalesce(x["type"], F.lit("null")).alias("base_type"), F.coalesce(y["type"], F.lit("null")).alias("cand_type"),
            value_of(a, x).alias("base_value"), value_of(b, y).alias("cand_value"), F.when(long, x["n"]).alias("base_len"), F.when(long, y["n"]).alias("cand_len"),
            F.when(outer.isNotNull(), segments_of(outer)).alias("reorder"))

    def difference(f: Column) -> Column:
        type_ = lambda t: F.when(t.isNull(), "null").otherwise(_type(t))
        value = lambda t: F.when(t.startswith('"'), plain(t)).when(~t.startswith("n"), restored(t))
        return F.struct(
            segments_of(f["p"]).alias("segments"), F.get(F.array(*(F.lit(s) for s in SIDES)), f["k"] - 1).alias("side"), type_(f["a"]).alias("base_type"), type_(f["b"]).alias("cand_type"),
            value(f["a"]).alias("base_value"), value(f["b"]).alias("cand_value"), f["n"].alias("base_len"), f["m"].alias("cand_len"),
            F.when(f["r"].isNotNull(), segments_of(f["r"])).alias("reorder"))

    # only for rows that are read whole: nothing of it is computed for the others
    result = lambda pairs, moved: F.struct(F.transform(pairs, lambda p: node(p, moved)).alias("nodes"), moved.alias("moved"))
    read = let(pair(shown(a), shown(b)), lambda s: let(pair(entries(s["a"]), entries(s["b"])), lambda e: let(
        pair(differing(s["a"], F.array_except(e["a"], e["b"])), differing(s["b"], F.array_except(e["b"], e["a"]))), lambda d: let(
            paired(s, d), lambda pairs: let(reordered(s, pairs), lambda moved: result(pairs, moved))))))

    def alone(side: str, kind: Column) -> Column:
        text = F.expr(base if side == "left" else cand)
        null, nil = F.lit(None).cast("string"), F.lit("null")
        return F.array(F.struct(
            F.array(F.lit(root)).alias("segments"), F.lit(side).alias("side"), (kind if side == "left" else nil).alias("base_type"), (nil if side == "left" else kind).alias("cand_type"),
            (text if side == "left" else null).alias("base_value"), (null if side == "left" else text).alias("cand_value"),
            none.cast("int").alias("base_len"), none.cast("int").alias("cand_len"), none.cast("array<string>").alias("reorder")))

    empty = F.array().cast(f"array<struct<{NODE}>>")
    kind = lambda tree, code: F.when(quick, _type(F.col(code))).otherwise(F.element_at(tree["nodes"], -1)["type"])
    one = lambda there, tree, other: ((quick & there) | tree.isNotNull()) & ~other
    rows = rows.withColumn("_read", F.when(both, read))
    nodes = (F.when(parted, F.transform(F.filter("_found", lambda f: f["k"] < MOVED), difference)).when(both, F.col("_read.nodes"))
             .when(one(has_a, a, has_b), alone("left", kind(a, "_code_a"))).when(one(has_b, b, has_a), alone("right", kind(b, "_code_b"))).otherwise(empty))
    moved = F.when(parted, F.transform(F.filter("_found", lambda f: f["k"] == MOVED), lambda f: F.struct(f["p"].alias("path"), restored(f["a"]).alias("text")))).otherwise(F.col("_read.moved"))
    rows = rows.withColumn("_nodes", nodes)
    some = (parted | both) & (F.size("_nodes") > 0)
    leaves = lambda c: F.when(some, F.when(parted, F.expr(_leaf_texts(f"_code_{c}"))).otherwise(F.expr(_let("k", _tokens(f"_code_{c}"), _leaves("k")))))
    rows = rows.withColumn("_la", leaves("a")).withColumn("_lb", leaves("b"))
    alike = F.expr(f"zip_with(_la, _lb, (x, y) -> coalesce(CASE WHEN x = y THEN true WHEN _ready THEN {_alike('x', 'y')} END, false))")
    zero = lambda c: F.when(some, c).otherwise(0)
    shape = lambda c: F.when(some, F.when(parted, F.expr(_shape_text(f"_code_{c}"))).otherwise(F.expr(_let("k", _tokens(f"_code_{c}"), _shape("k")))))
    rows = rows.withColumn(out, F.struct(
        F.col("_nodes").alias("nodes"), moved.alias("moved"), (~quick & ((has_a & a.isNull()) | (has_b & b.isNull()))).alias("malformed"), parted.alias("parted")))
    rows = rows.withColumn(f"{out}_stats", F.struct(
        shape("a").alias("base_shape"), shape("b").alias("cand_shape"),
        zero(F.size("_la")).alias("base_leaves"), zero(F.size("_lb")).alias("cand_leaves"), zero(F.size(F.array_remove(alike, False))).alias("same_leaves")))
    rows = rows.withColumnRenamed("_code_b", f"{out}_code")
    return rows.drop("_code_a", "_part_a", "_part_b", "_ready", "_found", "_kept", "_tree_a", "_tree_b", "_read", "_nodes", "_la", "_lb")


def edit(tree: Column, repairs: Column) -> Column:
    """The text of ``tree`` after ``repairs`` (segments, action, value as JSON text).

    ``add-field``, ``remove-field``, ``map-value``, ``convert-type``, ``reorder-array``, ``handle-null`` (a null or missing value is filled) and
    ``adjust-array`` (cut, or padded with nulls, to the length in ``value``). A repair is a span of the text's tokens and what replaces it;
    spans inside a replaced one go with it. What has no place in the text is left out; the text comes without white space.
    """
    nodes = tree["nodes"]

    def span(first, last, text):
        return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), text.alias("text"))

    def change(r):
        path = path_of(r["segments"])
        up = path_of(F.slice(r["segments"], 1, F.greatest(F.size(r["segments"]) - 1, F.lit(1))))
        at = lambda p: F.get(F.filter(nodes, lambda n: n["path"] == p), F.lit(0))
        name = F.element_at(r["segments"], -1)

        def made(s):
            t, p, text = s["t"], s["p"], F.coalesce(s["value"], F.lit("null"))
            member = p["type"] == "object"
            quoted = F.regexp_extract(F.to_json(F.array(name)), r"^\[([\s\S]*)\]$", 1)
            added = span(p["stop"], p["stop"] - 1, F.concat(F.when(p["n"] > 0, ",").otherwise(GONE + ","), quoted, F.lit(":"), text))
            length = s["value"].try_cast("int")
            child = at(F.concat(path, F.lit(MARK + "#"), length.cast("string")))
            padded = F.array_join(F.array_repeat(F.lit("null"), F.greatest(length - t["n"], F.lit(0))), ",")
            longer = span(t["stop"], t["stop"] - 1, F.concat(F.when(t["n"] > 0, ",").otherwise(""), padded))
            shorter = span(child["start"], t["stop"] - 1, F.lit(GONE))
            comma = F.when(F.get(tree["tokens"], t["stop"] - 1).endswith(","), ",").otherwise("")  # a span's last token may hold one
            replaced = span(t["start"], t["stop"], F.concat(text, comma))
            open_ = F.when(t.isNull() & (p["type"] == "object"), added)
            act = s["action"]
            return (
                F.when((act == "remove-field") & t.isNotNull(), span(F.when(member, t["start"] - 1).otherwise(t["start"]), t["stop"], F.concat(F.lit(GONE), comma)))
                .when(act.isin("map-value", "convert-type", "reorder-array") & t.isNotNull(), replaced)
                .when((act == "add-field") & t.isNotNull(), replaced).when((act == "handle-null") & (t["type"] == "null"), replaced)
                .when(act.isin("add-field", "handle-null"), open_)
                .when((act == "adjust-array") & (t["type"] == "array") & (length > t["n"]), longer)
                .when((act == "adjust-array") & (t["type"] == "array") & (length < t["n"]) & (length >= 0), shorter))

        places = F.struct(path.alias("path"), up.alias("up"))  # each path is rendered once, not for every node
        return let(places, lambda q: let(F.struct(at(q["path"]).alias("t"), at(q["up"]).alias("p"), r["action"].alias("action"), r["value"].alias("value")), made))

    def outermost(spans):
        inside = lambda e, f: (f["first"] <= e["first"]) & (f["last"] >= e["last"]) & (f["last"] - f["first"] > e["last"] - e["first"])
        twice = lambda e, f: (f["first"] == e["first"]) & (f["last"] == e["last"]) & (e["last"] >= e["first"]) & (f["text"] < e["text"])
        return F.array_sort(F.filter(spans, lambda e: ~F.exists(spans, lambda f: inside(e, f) | twice(e, f))))

    def between(first, last):
        return F.array_join(F.slice(tree["tokens"], first, F.greatest(last - first + 1, F.lit(0))), "")

    def joined(spans):
        before = lambda i: F.coalesce(F.get(spans, i - 1)["last"], F.lit(0)) + 1
        pieces = F.transform(spans, lambda e, i: F.concat(between(before(i), e["first"] - 1), e["text"]))
        return F.concat(F.array_join(pieces, ""), between(before(F.size(spans)), F.size(tree["tokens"])))

    spans = F.array_distinct(F.array_compact(F.transform(repairs, change)))
    text = let(spans, lambda s: let(outermost(s), joined))
    for pattern in (GONE + ",", "," + GONE, GONE):
        text = F.replace(text, F.lit(pattern), F.lit(""))
    return restored(text)


def edit_members(code: str, repairs: str) -> Column:
    """:func:`edit` of a sound coded object (both SQL expressions) without reading it; null unless each repair is of another member that it holds."""
    value = "get(r.repairs, j - 1).value"
    changed = _let("j", "CAST(array_position(n, get(k, i)) AS INT)", (
        f"CASE WHEN j = 0 THEN x WHEN get(r.repairs, j - 1).action = 'remove-field' THEN NULL WHEN get(r.repairs, j - 1).action = 'handle-null' AND {_held('x')} <> 'null' THEN x "
        f"ELSE concat(left(x, locate({_quoted(END)}, x, 2) + 1), coalesce({value}, 'null')) END"))
    text = _restored(f"concat('{{', array_join(transform(r.members, (x, i) -> {changed}), ','), '}}')")
    plain_names = ("forall(r.repairs, f -> size(f.segments) = 2 AND NOT get(f.segments, 1) RLIKE '^#[0-9]+$' "
                   "AND f.action IN ('remove-field', 'map-value', 'convert-type', 'reorder-array', 'handle-null'))")
    made = _let("n", f"transform(r.repairs, f -> replace(get(f.segments, 1), '{MARK}', '{MARK}e'))", _let(
        "k", f"transform(r.members, x -> {_key('x')})", f"CASE WHEN size(array_distinct(n)) = size(n) AND size(array_except(n, k)) = 0 THEN {text} END"))
    parts = f"named_struct('members', CASE WHEN startswith({code}, '{{') THEN {_let('m', _parted(code), _whole('m', code))} END, 'repairs', {repairs})"
    return F.expr(_let("r", parts, f"CASE WHEN r.members IS NOT NULL AND {plain_names} THEN {made} END"))


def strip_nulls(text: Column) -> Column:
    """Drops the null members of every object of a JSON text, nested ones too; nulls inside lists stay.

    Strings are stepped over whole and without backtracking, so member order, numbers and the rest stay as written, at any length.
    """
    string = r'"[^"]*+"'
    null = rf"{string}\s*+:\s*+null(?=\s*+[,}}])"
    later = F.regexp_replace(coded(text), rf",\s*+{null}|({string})", "$1")
    return restored(F.regexp_replace(later, rf"{null}\s*+,?+\s*+|({string})", "$1"))


def flat_nodes(text: str) -> Column:
    """Every node of a JSON text (an SQL expression) as (path, parent, depth, node_type, value, ordinal); none for null or malformed texts."""
    def shown(path):
        return F.replace(F.replace(F.regexp_replace(path, MARK + r"#(\d+)", "[$1]"), F.lit(MARK + "s"), F.lit(".")), F.lit(MARK + "e"), F.lit(MARK))

    def node(tree, n):
        container = n["type"].isin("object", "array")
        return F.struct(
            shown(n["path"]).alias("path"), shown(n["parent"]).alias("parent"), (F.size(F.split(n["ord"], re.escape("."))) - 1).alias("depth"), n["type"].alias("node_type"),
            F.when(~container, value_of(tree, n)).alias("value"), n["ord"].alias("ordinal"))

    return let(F.expr(json_tree(text, ordered=True)), lambda tree: F.transform(tree["nodes"], lambda n: node(tree, n)))
