"""The corpus operators' results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from marginalia.llm import mixing, quality
from marginalia.llm.common import ASCII_LOWER, ASCII_UPPER

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS pos FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[pos : pos + n - 1], ' ') AS gram FROM i),
p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM g)),
q AS (SELECT doc_id, n, pos, array_to_string(w[pos : pos + n - 1], ' ') AS gram FROM p),
m AS (SELECT q.doc_id, q.n, q.pos, g.item FROM q JOIN g USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {mixing.REPEATS} AS cap, sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, total - coalesce(sum(cap) OVER o, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left FROM w
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(left_over, -weight_left) AS l, max(weight_left) AS wl FROM r WHERE left_over / weight_left <= cap / weight),
t AS (SELECT source, source_size, CASE WHEN CAST(l * weight AS DOUBLE) / wl < cap THEN CAST(l * weight AS DOUBLE) / wl ELSE CAST(cap AS DOUBLE) END AS target FROM r, f),
n AS (SELECT greatest(1, CAST(round(sum(target) / {mixing.BLOCK_WORDS}) AS BIGINT)) AS seats FROM t),
k AS (SELECT source, target / (2 * unnest(range(0, CAST(target / {mixing.BLOCK_WORDS} + 20 AS BIGINT))) + 1) AS quotient FROM t WHERE target > 0),
a AS (SELECT source, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST) AS pos FROM k),
q AS (SELECT source, count(*) AS quota FROM a, n WHERE pos <= seats GROUP BY source),
p AS (SELECT t.*, least(coalesce(quota, 0) * {mixing.BLOCK_WORDS}, source_size * {mixing.REPEATS}) AS wanted FROM t LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source),
x AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY place, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS low FROM d),
y AS (SELECT x.doc_id, x.size, x.low, p.source_size, p.target, p.wanted, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS rounds FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(rounds * size + greatest(0, least(size, wanted - rounds * source_size - low)) AS BIGINT) AS taken FROM y"""

SHARDING = r"""
WITH bits AS (SELECT CAST(c AS UBIGINT) AS c0, CAST(c AS UBIGINT) AS c FROM range(256) t(c)),
""" + "".join(
    f"b{k} AS (SELECT c0, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END AS c FROM {'bits' if k == 0 else f'b{k - 1}'}),\n" for k in range(8)) + r"""
lut AS (SELECT list(c ORDER BY c0) AS t FROM b7),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
h AS (SELECT doc_id, size, place, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST((strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1 AS UBIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, size, place, CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], bytes), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM h, lut),
x AS (SELECT *, sum(size) OVER (ORDER BY place, doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS low, sum(size) OVER () AS total, row_number() OVER (ORDER BY place, doc_id, size, text_crc32) AS nth FROM c),
s AS (SELECT *, CAST(least(39, ((2 * low + size) * 40) // (2 * total)) AS INT) AS shard FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""


def quality_sql() -> str:
    """Counts, pools, concentration steps (those after the subset stays change nothing) and the verdict; one CTE a step."""
    p, scale = quality.P, quality.SCALE
    axes, pairs = range(p), [(i, j) for i in range(p) for j in range(i + 1)]
    floor = [scale * s for s in quality.STATISTICS.values()]
    rate = lambda x, usual: f"ln(1 + 100 * ({x} + {usual}) / (word_chars + 500))"
    xs = ["(word_chars + 500) / (n_words + 100)", rate("n_symbols", 0), rate("n_capitals", 8), rate("n_stops", 13), "ln(1 + 10 * n_dup_lines / (n_lines + 10))"]
    dist = " + ".join("(" + " + ".join(f"k{i}{j} * (x{j} - m{j})" for j in range(i + 1)) + ") ** 2" for i in axes)
    count = lambda keep: f"length(regexp_replace(t, '{keep}', '', 'g'))"
    parts = [rf"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS pos FROM w)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {count('[^#*$%&|<>]+')} AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, {count('[^' + chr(92) + 'p{Lu}]+')} AS n_capitals, {count('[^.,;:!?]+')} AS n_stops FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed, {', '.join(f'CAST(round({scale} * ({x})) AS BIGINT) AS x{i}' for i, x in enumerate(xs))} FROM c),
n AS (SELECT lang, source, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
named AS (SELECT lang, source, '0|' || coalesce(lang, '-') || '|' || coalesce(source, '-') AS own, '1|' || coalesce(lang, '-') AS by_lang, n, sum(n) OVER (PARTITION BY lang) AS in_lang FROM n),
pools AS (SELECT *, CASE WHEN n >= {quality.MIN_POOL} THEN own WHEN in_lang >= {quality.MIN_POOL} THEN by_lang ELSE '2' END AS pool FROM named),
used AS (SELECT DISTINCT pool FROM pools),
rated AS MATERIALIZED (SELECT u.pool, {', '.join(f'x{i}' for i in axes)} FROM v JOIN pools p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source JOIN used u ON u.pool IN (p.own, p.by_lang, '2') WHERE NOT base_failed)"""]
    wide = [[f"{f!r}::DOUBLE" for f in floor], [f"greatest({f!r}::DOUBLE, (quantile_disc(x{i}, 0.75) - quantile_disc(x{i}, 0.25)) / 1.349::DOUBLE)" for i, f in enumerate(floor)]]
    for start in (0, 1):
        parts.append(f"""
e{start}_0 AS MATERIALIZED (SELECT pool, {', '.join(f'CAST(quantile_disc(x{i}, 0.5) AS DOUBLE) AS m{i}' for i in axes)}, {', '.join(f'1::DOUBLE / {wide[start][i]} AS k{i}{j}' if i == j else f'0::DOUBLE AS k{i}{j}' for i, j in pairs)} FROM rated GROUP BY pool)""")

    def shape(name: str, rows: str) -> None:
        """The estimate of a pool's rows, in small steps of scalar terms."""
        parts.append(f"""
s{name} AS (SELECT pool, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'CAST(sum(x{i}) AS DOUBLE) AS s{i}' for i in axes)}, {', '.join(f'CAST(sum(x{i} * x{j}) AS DOUBLE) AS s{i}{j}' for i, j in pairs)} FROM {rows} GROUP BY pool),
v{name}_0 AS (SELECT pool, {', '.join(f's{i} / n AS m{i}' for i in axes)}, {', '.join(f'(s{i}{j} - s{i} * s{j} / n) / n + {floor[i] ** 2 if i == j else 0.0}::DOUBLE AS c{i}{j}' for i, j in pairs)} FROM s{name})""")
        total = lambda terms: "(" + " + ".join(terms or ["0::DOUBLE"]) + ")"
        at = 0

        def more(made: list[str]) -> None:
            nonlocal at
            if made:
                parts.append(f"\nv{name}_{at + 1} AS (SELECT *, {', '.join(made)} FROM v{name}_{at})")
                at += 1

        for j in axes:
            more([f"sqrt(c{j}{j} - {total([f'l{j}{k} * l{j}{k}' for k in range(j)])}) AS l{j}{j}"])
            more([f"(c{i}{j} - {total([f'l{i}{k} * l{j}{k}' for k in range(j)])}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, p)])
        for d in axes:
            more([f"1 / l{j}{j} AS k{j}{j}" if d == 0 else f"-{total([f'l{j + d}{k} * k{k}{j}' for k in range(j, j + d)])} / l{j + d}{j + d} AS k{j + d}{j}" for j in range(p - d)])
        parts.append(f"\ne{name} AS MATERIALIZED (SELECT *, {' * '.join(f'l{j}{j}' for j in axes)} AS det FROM v{name}_{at})")

    def step(before: str, name: str) -> None:
        parts.append(f"""
a{name} AS MATERIALIZED (SELECT rated.*, CAST(floor(64 * log2({dist} + 1e-9)) AS INT) AS bin FROM rated JOIN {before} USING (pool)),
u{name} AS (SELECT pool, min(bin) AS last FROM (SELECT pool, bin, sum(count(*)) OVER (PARTITION BY pool ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY pool) AS whole FROM a{name} GROUP BY pool, bin)
  WHERE upto >= ceil({quality.SUBSET} * whole) GROUP BY pool)""")
        shape(name, f"a{name} JOIN u{name} USING (pool) WHERE bin <= last")

    shape("2_0", "rated")
    for start in range(quality.STARTS):
        for k in range(quality.TRIAL):
            step(f"e{start}_{k}", f"{start}_{k + 1}")
    held = ["pool", *(f"m{i}" for i in axes), *(f"k{i}{j}" for i, j in pairs), "det"]
    tried = " UNION ALL ".join(f"SELECT {', '.join(held)}, {start} AS start FROM e{start}_{quality.TRIAL}" for start in range(quality.STARTS))
    parts.append(f"\ne{quality.TRIAL} AS MATERIALIZED (SELECT * FROM ({tried}) QUALIFY row_number() OVER (PARTITION BY pool ORDER BY det, start) = 1)")
    for k in range(quality.TRIAL, quality.STEPS):
        step(f"e{k}", f"{k + 1}")
    consistent = quality.SUBSET / quality.chi2_cdf(quality.chi2_at(1 - quality.SUBSET, p), p + 2)
    parts.append(f"""
enough AS (SELECT pool FROM rated GROUP BY pool HAVING count(*) >= {quality.MIN_POOL}),
shape AS (SELECT pools.lang, pools.source, e{quality.STEPS}.* FROM pools JOIN e{quality.STEPS} USING (pool) JOIN enough USING (pool))""")
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(({dist}) / {consistent!r}, 0) <= {quality.chi2_at(quality.TAIL, p)!r} AS kept
FROM v LEFT JOIN shape ON v.lang IS NOT DISTINCT FROM shape.lang AND v.source IS NOT DISTINCT FROM shape.source"""
