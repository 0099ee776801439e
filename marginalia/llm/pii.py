"""Personal data: candidate spans and a gradient-boosted choice among them.

Base rules find e-mail addresses, IPv4 addresses, card and phone numbers, and
always stand. High-recall generators propose more spans, which may overlap;
features of format and context go through boosted trees whose probability is
calibrated; those above their kind's threshold are added. From the text to the
spans everything is SQL; the trees, fitted on a fixed labelled set of short
made-up lines, are SQL CASE expressions.

Work grows with the length of a text only, however many spans or labels it has:
patterns don't recurse or go back over what they read, places are running sums,
overlaps are found in sorted order.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import filled, only
from marginalia.llm.spans import apart, clusters, digits, flag, let, luhn, quoted, replaced, spans
from marginalia.llm.trees import Boosted, boost

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
LOCAL = "A-Za-z0-9._%+-"
#: Starts only where a run starts, or where the match before ended: elsewhere there's none that isn't found from there.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Proposals beside the base rules: (kind, pattern). Repetitions that aren't bounded are possessive: those loop, others recurse.
MORE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,64}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{2,64}+)++"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    ("phone", r"(?<![0-9+])00[1-9](?:[ -]?[0-9]){7,13}+(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
#: Code points before a proposal that its features see.
CONTEXT = 40
#: A kind's threshold is the least at which so many of the held-out lines' proposals are personal data; at least the second number.
PRECISION, LEAST_P = 0.97, 0.5
HINTS = {
    "mail": "mail|contact|write to|reach", "phone": "phone|tel|call|mobile|cell|fax|whatsapp", "card": "card|visa|master|amex|credit|debit|payment",
    "person": "ssn|social security|taxpayer", "bank": "iban|account|bank|transfer", "number": "order|invoice|ref|ticket|serial|part|isbn|item|tracking|version|build|id[ :#]|no\\\\.",
    "code": "token|hash|sha|md5|commit|key|uuid|hex",
    "host": "ip|host|address|server|client|login|connect|peer|node", "clock": "time|clock|start|end|duration|elapsed|mac|ether|at ",
}


def valid(c: str) -> str:
    """Whether a base candidate passes its rule; failing ones are dropped."""
    parts = f"split({c}.value, '[.]')"
    n = f"length({digits(f'{c}.value')})"
    return f"""case {c}.kind when 'email' then true
        when 'ip' then forall({parts}, p -> length(ltrim('0', p)) <= 3 and cast(concat('0', substring(ltrim('0', p), 1, 3)) as int) <= 255)
        when 'card' then {n} between 13 and 19 and {luhn(f'{c}.value')}
        when 'phone' then {n} between 9 and 15 else false end"""


def features(c: str) -> dict[str, str]:
    """Numbers about a candidate: its format, and the words and characters around it."""
    v, ahead = f"{c}.value", f"{c}.ahead"
    n = f"length({digits(v)})"
    out = {f"is_{k}": flag(f"{c}.kind = '{k}'") for k in KINDS}
    out |= {
        "length": f"cast(length({v}) as double)", "digits": f"cast({n} as double)", "digit_share": f"{n} / length({v})",
        "luhn": flag(f"{n} > 0 and {luhn(v)}"), "first_digit": f"coalesce(try_cast(substring({digits(v)}, 1, 1) as double), -1D)",
        "distinct_digits": f"cast(size(array_distinct(split({digits(v)}, ''))) as double)", "breaks": f"cast(length(regexp_replace({v}, '[^ .()-]', '')) as double)",
        "capitals": f"length(regexp_replace({v}, '[^A-Z]', '')) / length({v})",
        "glued_before": flag(f"rlike(right({ahead}, 1), '[a-z0-9_]')"), "glued_after": flag(f"rlike({c}.after, '[A-Za-z0-9_]')"),
        "colons": f"cast(length(regexp_replace({v}, '[^:]', '')) as double)", "letters": f"length(regexp_replace({v}, '[^A-Za-z]', '')) / length({v})",
        "longest": f"cast(array_max(transform(split({v}, '[^0-9A-Za-z]'), x -> length(x))) as double)", "double_colon": flag(f"contains({v}, '::')"), "octets": flag(f"forall(split({v}, '[^0-9]+'), x -> length(x) <= 3 and coalesce(try_cast(x as int), 0) <= 255)"),
        "assigned": flag(f"rlike(right({ahead}, 3), '[=:#]')"),
    }
    out |= {f"near_{k}": flag(f"rlike({ahead}, '(?<![a-z])(?:{rx})')") for k, rx in HINTS.items()}
    return out


def candidates(text: str = "text") -> tuple[str, str]:
    """SQL of the base candidates (before their rules) and of the proposals."""
    needs = {"email": f"contains({text}, '@')", "phone": f"contains({text}, '+')"}
    base = ", ".join(spans(text, rx, k, needs.get(k, f"rlike({text}, '[0-9]')"), 0) for k, rx in BASE.items())
    at = {"email": f"rlike({text}, '[\\\\[(](?:at|AT)[\\\\])]')"}
    more = ", ".join(spans(text, rx, k, at.get(k, f"rlike({text}, '[0-9]')"), CONTEXT) for k, rx in MORE)
    return f"concat({base})", f"concat({more})"


def labelled_lines(n: int = 2400, seed: int = 7) -> list[tuple[str, str, int]]:
    """Made-up lines with one candidate each: text, kind, 1 if it's personal data."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        body = r.choice("3456") + digit(14) if good else r.choice("0123456789") + digit(14)
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        check = (-total) % 10 if good else (-total + r.randint(1, 9)) % 10
        s, gap = body + str(check), r.choice(["", " ", "-"])
        return gap.join(s[i : i + 4] for i in range(0, 16, 4))

    names = ["anna", "j.smith", "maria.k", "info", "peter_77", "sales"]
    lead = {
        "email": ["contact ", "mail: ", "write to ", "reach me at ", ""], "card": ["card ", "visa: ", "paid with ", "payment card ", ""],
        "phone": ["call ", "tel. ", "phone: ", "mobile ", "fax ", ""], "ssn": ["ssn ", "social security number ", "ssn: ", ""], "iban": ["iban ", "account: ", "bank transfer to ", ""],
        "ip": ["ip ", "login from ", "host ", "server address ", "client: ", "connected to ", ""],
    }
    noise = ["order ", "invoice ref ", "serial ", "part no. ", "tracking ", "token = ", "commit ", "build ", "item id: ", "version ", "sha ", ""]
    out = []
    for _ in range(n):
        kind, good = r.choice(["email", "ip", "card", "phone", "ssn", "iban"]), r.random() < 0.5
        if kind == "email":
            dot = r.choice([" (dot) ", "[dot]", ".", " [dot] "])
            value = f"{r.choice(names)}{r.choice([' (at) ', '[at]', ' [at] '])}mail{r.randint(1, 99)}{dot}{r.choice(['com', 'org', 'net', 'de'])}"
            if not good:
                value = f"{r.choice(['v1', 'x', 'a', 'loop', 'row'])[:4]}00 (at) {digit(2)}.{digit(2)}"
        elif kind == "ip":
            group = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
            value = r.choice([
                lambda: ":".join(group(r.randint(1, 4)) for _ in range(8)), lambda: f"{r.choice(['2001', 'fe80', 'fd' + group(2)])}:{group(r.randint(1, 4))}::{group(r.randint(1, 4))}",
                lambda: r.choice(["[.]", "(dot)", " (dot) ", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4))])()
            if not good:
                value = r.choice([
                    lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", lambda: ":".join(group(2) for _ in range(6)), lambda: "::".join(r.choice(["a", "b", "cafe", "add", "dec", "1"]) for _ in range(3)),
                    lambda: ":".join(str(r.randint(1, 99)) for _ in range(r.randint(3, 5))), lambda: "[.]".join(str(r.randint(256, 999)) for _ in range(4))])()
        elif kind == "card":
            value = card(good)
        elif kind == "phone":
            value = r.choice([f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"00{r.randint(1, 9)}{digit(10)}"])
        elif kind == "ssn":
            value = f"{digit(3)}-{digit(2)}-{digit(4)}"
        else:
            value = r.choice(["DE", "FR", "ES", "GB"]) + digit(2) + r.choice(["", " "]).join([""] + [digit(4) for _ in range(4)])
            if not good:
                value = "".join(r.choice("ABCDEFGH") for _ in range(2)) + digit(2) + "".join(r.choice("ABCDEF0123456789") for _ in range(16))
        # phone, ssn and the like can only be told apart by what stands before them
        ahead = r.choice(lead[kind] if good else noise)
        if kind in ("phone", "ssn") and ahead == "":
            ahead, good = ("", False)
        tail = r.choice(["", " today", ", thanks", " and more", "."])
        glue = "" if good or r.random() < 0.7 else r.choice(["x", "a", "_"])
        out.append((f"{r.choice(['', 'please ', 'the list says ', 'as noted, '])}{ahead}{glue}{value}{tail}", kind, int(good)))
    return out


@lru_cache(maxsize=4)
def _fitted(rows: tuple[tuple, ...], held: tuple[tuple, ...]) -> tuple[Boosted, tuple[tuple[str, float], ...]]:
    split = lambda rows: (np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float))
    model = boost(*split(rows))
    x, y = split(held)
    p, kinds = model.predict(x), np.array([r[0] for r in held])
    return model, tuple((k, _threshold(p[kinds == k], y[kinds == k])) for k in KINDS)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least probability from which on ``PRECISION`` of the held-out proposals are right; over 1 (none is) where no one is."""
    order = np.argsort(-p, kind="stable")
    last = np.concatenate([p[order][1:] < p[order][:-1], [True]]) if len(p) else np.empty(0, bool)  # equal ones stand or fall together
    good = last & (np.cumsum(y[order]) >= PRECISION * np.arange(1, len(p) + 1))
    return max(LEAST_P, float(p[order][np.flatnonzero(good)[-1]])) if good.any() else 2.0


def fit(spark: SparkSession) -> Boosted:
    return calibrated(spark)[0]


def calibrated(spark: SparkSession) -> tuple[Boosted, dict[str, float]]:
    """Boosted trees over the labelled lines, and each kind's threshold from lines that they haven't seen.

    Features come from the same SQL as a corpus's.
    """
    made = features("c")
    lines = [(0, *x) for x in labelled_lines()] + [(1, *x) for x in labelled_lines(1800, seed=8)]
    frame = spark.createDataFrame(lines, "held int, text string, kind string, mark int").coalesce(1)
    rows = (
        frame.select("held", "kind", "mark", F.expr(f"explode(filter({candidates()[1]}, x -> x.kind = kind)) as c"))
        .select("held", "kind", "mark", *[F.expr(sql).alias(name) for name, sql in made.items()]).collect())  # at most one or two a line
    rows.sort()
    model, limits = _fitted(tuple(tuple(r[1:]) for r in rows if not r.held), tuple(tuple(r[1:]) for r in rows if r.held))
    return model, dict(limits)


def _with_spans(documents: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """All columns, and __text, __base, __added (kind, start, end, value, and p for added), found in the row."""
    model, limits = calibrated(documents.sparkSession)
    limits |= thresholds or {}
    base, more = candidates("__text")
    inner = ", ".join(f"'{n}', {sql}" for n, sql in features("c").items())
    p = model.sql([f"f.{n}" for n in features("c")])
    limit = "case c.kind " + " ".join(f"when {quoted(k)} then {v!r}D" for k, v in limits.items()) + " end"
    scored = f"transform(__free, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'value', c.value, 'p', {let(f'named_struct({inner})', 'f', p)}))"
    # of a stretch of overlapping spans the likeliest names the kind
    best = "array_max(transform(g, x -> named_struct('p', x.p, 'early', -x.start, 'kind', x.kind, 'value', x.value)))"
    whole = "named_struct('kind', b.kind, 'start', g[0].start, 'end', array_max(transform(g, x -> x.end)), 'value', b.value, 'p', b.p)"
    one = f"transform({clusters('__sure')}, g -> {let(best, 'b', whole)})"
    none = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:string,p:double>>)"
    out = documents.withColumn("__text", filled(F.col("text")))
    out = out.withColumns({"__base": F.expr(f"filter({base}, c -> {valid('c')})"), "__more": F.expr(more)})
    out = out.withColumn("__free", F.expr(apart("__more", "__base", CONTEXT)))
    out = out.withColumn("__sure", F.expr(f"filter({scored}, c -> c.p >= {limit})"))
    return out.withColumn("__added", F.expr(f"if(size(__sure) = 0, {none}, {one})")).drop("__more", "__free", "__sure")


def find(documents: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """doc_id, base and added: arrays of kind, start, end (code points, end exclusive) and value; added has p as well.

    Each array is in order of kind, then start. A proposal that a base span of
    any kind overlaps is left to the base; added spans that overlap, directly or
    by others, are one, of the likeliest one's kind and value. ``thresholds``
    replaces those chosen on held-out lines. Null text is empty: both arrays
    are. Repeated rows stay repeated; an empty table gives no rows; other
    columns are left out.
    """
    rank = "array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), c.kind)"
    tidy = lambda a, extra="": F.expr(f"array_sort(transform({a}, c -> named_struct('rank', {rank}, 'start', c.start, 'end', c.end, 'kind', c.kind, 'value', c.value{extra})))")
    return _with_spans(only(documents, "doc_id", "text"), thresholds).select("doc_id", tidy("__base").alias("base"), tidy("__added", ", 'p', c.p").alias("added"))


def redacted(documents: DataFrame, mask: str = "[{}]") -> DataFrame:
    """All columns, the text with every span replaced by its kind in upper case.

    Overlapping spans are one, of the first one's kind. Spans are found and
    replaced in the row itself, so ids may repeat or be null; null text stays null.
    """
    short = "transform({}, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind))".format
    left, right = map(quoted, mask.split("{}"))
    out = _with_spans(documents).withColumn("__groups", F.expr(clusters(f"concat({short('__base')}, {short('__added')})")))
    return out.withColumn("text", F.expr(f"if(text is null, null, {replaced('__text', '__groups', f'concat({left}, upper(_q[0].kind), {right})')})")).select(
        *[f"`{c}`" for c in documents.columns])
