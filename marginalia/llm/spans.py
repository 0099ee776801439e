"""Regular-expression matches with their places, as SQL text over a text column.

Whatever a text holds, work grows with its length alone: places are running sums
in blocks, context comes from the pieces around a match, and overlaps are found
by running maxima over sorted spans.
"""

from __future__ import annotations

#: Elements of a running sum that are added up one by one; sums of blocks are added up in turn.
BLOCK = 256
LEAST = "-9223372036854775807L"


def quoted(text: str) -> str:
    """A SQL string literal (not raw: backslashes double)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(a: str, op: str = "sum") -> str:
    """Sums (or with ``max``, maxima) of an array<bigint> up to each element."""
    both = (lambda x, y: f"greatest({x}, {y})") if op == "max" else (lambda x, y: f"{x} + {y}")
    blocks = f"transform(sequence(0, (size(_a) - 1) div {BLOCK}), _k -> slice(_a, {BLOCK} * _k + 1, {BLOCK}))"
    last = "{0}[size({0}) - 1]".format
    inner = f"transform({blocks}, _b -> aggregate(_b, cast(array() as array<bigint>), (_o, _x) -> concat(_o, array(if(size(_o) = 0, _x, {both(last('_o'), '_x')})))))"
    heads = f"aggregate(_c, array({LEAST if op == 'max' else '0L'}), (_o, _x) -> concat(_o, array({both(last('_o'), last('_x'))})))"
    whole = let(inner, "_c", let(heads, "_h", f"flatten(transform(_c, (_x, _k) -> transform(_x, _y -> {both('_y', '_h[_k]')})))"))
    return let(a, "_a", f"if(size(_a) = 0, cast(array() as array<bigint>), {whole})")


def kind_of(context: int) -> str:
    return "struct<kind:string,start:bigint,end:bigint,value:string" + (",ahead:string,after:string>" if context else ">")


def spans(text: str, pattern: str, kind: str, needs: str | None = None, context: int = 48, back: int = 4) -> str:
    """array<struct<kind,start,end,value>> of the leftmost non-overlapping matches; places are code points.

    Splitting by the pattern gives what lies between the matches; lengths of
    both, added up, give the places. With ``context`` the up to so many code
    points before a match, in lower case (ahead), and the one after it come with
    it, read from the last ``back`` matches and what lies between.
    ``needs`` is a cheap condition without which there can't be a match.
    """
    rx = quoted(pattern)
    empty = f"cast(array() as array<{kind_of(context)}>)"
    first = f"greatest(0, _i - {back})"
    around = f"array_join(transform(sequence({first}, _i), _j -> concat(if(_j > {first}, _z.v[_j - 1], ''), _z.p[_j])), '')"
    more = f", 'ahead', lower(right({around}, {context})), 'after', left(_z.p[_i + 1], 1)" if context else ""
    made = f"transform(_z.v, (_v, _i) -> named_struct('kind', '{kind}', 'start', _e[_i] - length(_v), 'end', _e[_i], 'value', _v{more}))"
    ends = running("transform(_z.v, (_v, _i) -> cast(length(_z.p[_i]) + length(_v) as bigint))")
    found = let(f"named_struct('p', split({text}, {rx}, -1), 'v', regexp_extract_all({text}, {rx}, 0))", "_z", f"if(size(_z.v) = 0, {empty}, {let(ends, '_e', made)})")
    return f"if({needs or 'true'}, {found}, {empty})"


def apart(proposed: str, base: str, context: int = 48) -> str:
    """The proposals that no base span overlaps, in order of their start."""
    kind = kind_of(context)
    marks = (f"array_sort(concat(transform({base}, _b -> named_struct('at', _b.start, 'own', 0, 'end', _b.end, 'c', cast(null as {kind}))),"
             f" transform({proposed}, _p -> named_struct('at', _p.start, 'own', 1, 'end', _p.end, 'c', _p))))")
    reach = running(f"transform(_m, _x -> if(_x.own = 0, _x.end, {LEAST}))", "max")
    following = f"reverse({running(f'reverse(transform(_m, _x -> if(_x.own = 0, -_x.at, {LEAST})))', 'max')})"
    free = "transform(filter(_m, (_x, _i) -> _x.own = 1 and _r[_i] <= _x.at and -_f[_i] >= _x.end), _x -> _x.c)"
    return f"if(size({proposed}) = 0 or size({base}) = 0, {proposed}, {let(marks, '_m', let(reach, '_r', let(following, '_f', free)))})"


def clusters(a: str) -> str:
    """Structs of start, end, ... as an array of arrays: those that overlap, directly or by others, together."""
    heads = "filter(sequence(0, size(_s) - 1), _i -> _i = 0 or _s[_i].start >= _r[_i - 1])"
    cut = "transform(_g, (_x, _k) -> slice(_s, _x + 1, coalesce(get(_g, _k + 1), size(_s)) - _x))"
    parts = let(running("transform(_s, _x -> _x.end)", "max"), "_r", let(heads, "_g", cut))
    return let(f"array_sort({a})", "_s", f"if(size(_s) = 0, array(_s), {parts})")


#: Code points of a block that ``replaced`` takes pieces from.
PIECE = 1024


def replaced(text: str, groups: str, put: str) -> str:
    """``text`` with each group's stretch (least start to greatest end) replaced by ``put``, an expression over the group _q."""
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"

    def piece(a: str, b: str) -> str:
        held = f"array_join(slice(_t, cast({a} div {PIECE} as int) + 1, cast(({b} - 1) div {PIECE} - {a} div {PIECE} as int) + 1), '')"
        return f"if({b} <= {a}, '', substring({held}, cast({a} % {PIECE} as int) + 1, cast({b} - {a} as int)))"

    end = "array_max(transform({}, _x -> _x.end))".format
    before = f"if(_k = 0, 0L, {end('_n[_k - 1]')})"
    parts = f"array_join(transform(_n, (_q, _k) -> concat({piece(before, '_q[0].start')}, {put})), '')"
    tail = piece(end("_n[size(_n) - 1]"), "_l")
    return let(groups, "_n", f"if(size(_n[0]) = 0, {text}, {let(blocks, '_t', let(f'cast(length({text}) as bigint)', '_l', f'concat({parts}, {tail})'))})")


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(value: str) -> str:
    """Whether the digits of ``value`` pass Luhn's check."""
    d = f"reverse({digits(value)})"
    return f"""aggregate(transform(split({d}, ''), (c, i) -> if(c = '', 0, if(i % 2 = 0, cast(c as int), if(2 * cast(c as int) > 9, 2 * cast(c as int) - 9, 2 * cast(c as int))))), 0, (a, b) -> a + b) % 10 = 0"""


def flag(condition: str) -> str:
    return f"if({condition}, 1D, 0D)"
