"""The quality rules in DuckDB SQL, as an independent check of the DataFrame plan."""

from __future__ import annotations

from tessera.llm import quality_rules as q

_PAIRS = [(i, j) for i in range(q.D) for j in range(i + 1)]
_OWN = [*(f"m{i}" for i in range(q.D)), *(f"l{i}_{j}" for i, j in _PAIRS)]


def _distance(params: str) -> str:
    """The squared distance of x0 .. from the estimate in the row `params`."""
    parts, terms = [], []
    for i in range(q.D):
        rest = f"(x{i} - {params}.m{i})" + "".join(f" - {params}.l{i}_{j} * ({parts[j]})" for j in range(i))
        parts.append(f"({rest}) / {params}.l{i}_{i}")
        terms.append(f"({parts[i]}) * ({parts[i]})")
    return " + ".join(terms)


def _factor(name: str, moments: str, keys: str, factor: float) -> list[str]:
    """Tables that lead from sums (n, s<i>, s<i>_<j>) and a prior (nu, p<i>, p<i>_<j>) to means, covariances and Cholesky factors."""
    out = [f"{name}_m AS (SELECT *, " + ", ".join(f"(s{i}::DOUBLE + nu * p{i}) / (n + nu) AS m{i}" for i in range(q.D)) + f" FROM {moments})"]
    cs = []
    for i, j in _PAIRS:
        c = f"((s{i}_{j}::DOUBLE + nu * (p{i}_{j} / {factor!r}::DOUBLE + p{i} * p{j})) / (n + nu) - m{i} * m{j}) * {factor!r}::DOUBLE"
        cs.append(f"greatest({c}, 0) AS c{i}_{j}" if i == j else f"{c} AS c{i}_{j}")
    out.append(f"{name}_c AS (SELECT *, {', '.join(cs)} FROM {name}_m)")
    before = f"{name}_c"
    for step, (i, j) in enumerate(_PAIRS):
        c = f"c{i}_{j}" + (f" + {(q.FLOOR[i] * q.SCALE) ** 2!r}::DOUBLE" if i == j else "") + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        value = f"sqrt(greatest({c}, 0.001))" if i == j else f"({c}) / l{j}_{j}"
        out.append(f"{name}_{step} AS (SELECT *, {value} AS l{i}_{j} FROM {before})")
        before = f"{name}_{step}"
    logdet = " + ".join(f"ln(l{i}_{i})" for i in range(q.D))
    out.append(f"{name} AS MATERIALIZED (SELECT {keys}, 2 * ({logdet}) AS logdet, {', '.join([*(f'm{i}' for i in range(q.D)), *(f'c{i}_{j}' for i, j in _PAIRS), *(f'l{i}_{j}' for i, j in _PAIRS)])} FROM {before})")
    return out


def _sums() -> str:
    return ", ".join(["count(*) AS n", *(f"sum(x{i}) AS s{i}" for i in range(q.D)), *(f"sum((x{i} * x{j})::HUGEINT) AS s{i}_{j}" for i, j in _PAIRS)])


def _estimates(name: str, rows: str, prior: str, shrunk: bool) -> list[str]:
    """Tables that lead to `name`: the estimates of the groups (kl, ks) of `rows`."""
    keys, by = "kl, ks", "kl, ks, start"
    out = [f"{name}_n AS MATERIALIZED (SELECT kl, ks, least(count(*), (count(*) + {q.D + 1}) // 2) AS target FROM {rows} GROUP BY 1, 2)"]
    for i in range(q.D):
        out.append(f"""{name}_q{i} AS (SELECT {keys}, min(v) FILTER (rn >= 0.25 * n) AS lo, min(v) FILTER (rn >= 0.5 * n) AS mid, min(v) FILTER (rn >= 0.75 * n) AS hi
  FROM (SELECT {keys}, x{i} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY x{i}) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM {rows}) GROUP BY {keys})""")
    cols = [f"q{i}.mid::DOUBLE AS m{i}" for i in range(q.D)]
    for i, j in _PAIRS:
        own = f"sqrt(((q{i}.hi - q{i}.lo) / 1.349::DOUBLE) * ((q{i}.hi - q{i}.lo) / 1.349::DOUBLE) + {(q.FLOOR[i] * q.SCALE) ** 2!r}::DOUBLE)"
        cols.append(f"{own if i == j else '0.0::DOUBLE'} AS l{i}_{j}")
    joins = f"{name}_q0 q0 " + " ".join(f"JOIN {name}_q{i} q{i} USING ({keys})" for i in range(1, q.D))
    if shrunk:
        second = f"SELECT {keys}, 1 AS start, {', '.join(f'q_{c} AS {c}' for c in _OWN)} FROM {prior}"
    else:
        out.append(f"{name}_w AS (SELECT * FROM (SELECT {keys}, {_sums()} FROM {rows} GROUP BY {keys}) JOIN {prior} USING ({keys}))")
        out += _factor(f"{name}_v", f"{name}_w", keys, 1.0)
        second = f"SELECT {keys}, 1 AS start, {', '.join(_OWN)} FROM {name}_v"
    out.append(f"{name}_e0 AS MATERIALIZED (SELECT * FROM (SELECT {keys}, 0 AS start, {', '.join(cols)}, NULL::DOUBLE AS logdet FROM {joins} UNION ALL BY NAME SELECT *, NULL::DOUBLE AS logdet FROM ({second})) JOIN {name}_n USING ({keys}))")
    for step in range(q.STEPS):
        at = f"{name}_{step}"
        out.append(f"{at}d AS MATERIALIZED (SELECT {by}, target, {', '.join(f'x{i}' for i in range(q.D))}, floor(ln(1 + {_distance('e')}) * {q.BINS}) AS bin FROM {rows} r JOIN {name}_e{step} e USING ({keys}))")
        out.append(f"{at}u AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto FROM (SELECT {by}, target, bin, count(*) AS n FROM {at}d GROUP BY ALL))")
        out.append(f"{at}g AS MATERIALIZED (SELECT {by}, min(bin) AS edge, arg_min((target - upto + n) / n, bin) AS part FROM {at}u WHERE upto >= target GROUP BY {by})")
        sums = [f"(coalesce({f}(*) FILTER (bin < edge), 0)::DOUBLE + any_value(part) * {f}(*) FILTER (bin = edge)::DOUBLE) AS n" for f in ("count",)]
        for alias, value in [*((f"s{i}", f"x{i}") for i in range(q.D)), *((f"s{i}_{j}", f"(x{i} * x{j})::HUGEINT") for i, j in _PAIRS)]:
            sums.append(f"coalesce(sum({value}) FILTER (bin < edge), 0)::DOUBLE + any_value(part) * (sum({value}) FILTER (bin = edge))::DOUBLE AS {alias}")
        out.append(f"{at}s AS (SELECT * FROM (SELECT {by}, {', '.join(sums)} FROM {at}d JOIN {at}g USING ({by}) WHERE bin <= edge GROUP BY {by}) JOIN {prior} USING ({keys}))")
        out += _factor(f"{at}f", f"{at}s", by, q._consistency(0.5))
        falls = f"(o.logdet IS NULL OR f.logdet < o.logdet - {q.FALL})"
        out.append(f"{name}_e{step + 1} AS MATERIALIZED (SELECT o.kl AS kl, o.ks AS ks, o.start AS start, target, {', '.join(f'CASE WHEN {falls} THEN f.{c} ELSE o.{c} END AS {c}' for c in ('logdet', *_OWN))} FROM {name}_e{step} o JOIN {at}f f USING ({by}))")
    out.append(f"{name}_b AS MATERIALIZED (SELECT * FROM {name}_e{q.STEPS} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY logdet, start) = 1)")
    inside = f"(SELECT {keys}, {_sums()} FROM {rows} r JOIN {name}_b e USING ({keys}) WHERE round({_distance('e')}, 6) <= {q.WITHIN} GROUP BY {keys})"
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in q._names()[1:])
    out.append(f"{name}_i AS (SELECT g.kl AS kl, g.ks AS ks, greatest(coalesce(n, 0), CASE WHEN nu > 0 THEN 0 ELSE 1 END) AS n, {zero}, p.* EXCLUDE (kl, ks) FROM {name}_n g LEFT JOIN {inside} w USING ({keys}) JOIN {prior} p USING ({keys}))")
    return out + _factor(name, f"{name}_i", keys, q._consistency(0.975))


def sql() -> str:
    """The whole query."""
    xs = ", ".join(f"x{i}" for i in range(q.D))
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stats = f"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS lang, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS source,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, hash(w[i:i + {q.WINDOW - 1}]) AS h, w[i:i + {q.WINDOW - 1}] AS v FROM (SELECT rid, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM d WHERE len(w) >= {q.WINDOW})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h, v) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, sum(least({q.WINDOW}, i - before))::BIGINT AS rep FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -100) AS before FROM r) GROUP BY 1),
b AS (SELECT d.rid AS rid, doc_id, lang, source, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda l: length(trim(l, {spaces})) > 0)) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: length(trim(l, {spaces})) > 0))) AS n_dup_lines,
  coalesce(rep, 0) AS n_repeat_words FROM d LEFT JOIN c ON d.rid = c.rid),
st AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT} * n_words AS base_failed,
  round(ln(greatest(word_chars, 1) / greatest(n_words, 1)) * {q.SCALE})::BIGINT AS x0, round(ln(1 + 100 * n_symbols / greatest(word_chars, 1)) * {q.SCALE})::BIGINT AS x1,
  round(ln(1 + n_dup_lines) * {q.SCALE})::BIGINT AS x2, round(sqrt(n_repeat_words / greatest(n_words, 1)) * {q.SCALE})::BIGINT AS x3 FROM b),
good AS MATERIALIZED (SELECT * FROM st WHERE NOT base_failed),
rl AS MATERIALIZED (SELECT lang AS kl, '*' AS ks, {xs} FROM good), rs AS MATERIALIZED (SELECT lang AS kl, source AS ks, {xs} FROM good)"""
    zero = ", ".join(f"0.0::DOUBLE AS {c}" for c in (*(f"p{i}" for i in range(q.D)), *(f"p{i}_{j}" for i, j in _PAIRS)))
    given = ", ".join([*(f"m{i} AS p{i}" for i in range(q.D)), *(f"c{i}_{j} AS p{i}_{j}" for i, j in _PAIRS), *(f"{c} AS q_{c}" for c in _OWN)])
    tables = [stats, f"pl AS MATERIALIZED (SELECT DISTINCT kl, ks, 0.0::DOUBLE AS nu, {zero} FROM rl)", *_estimates("el", "rl", "pl", False)]
    tables.append(f"ps AS MATERIALIZED (SELECT g.kl AS kl, g.ks AS ks, {float(q.PRIOR_ROWS)}::DOUBLE AS nu, {given} FROM (SELECT DISTINCT kl, ks FROM rs) g JOIN el ON g.kl = el.kl)")
    tables += _estimates("es", "rs", "ps", True)
    tables.append(f"f AS (SELECT rid, {_distance('e')} AS dist FROM good x JOIN es e ON x.lang = e.kl AND x.source = e.ks)")
    return "WITH " + ",\n".join(tables) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(dist, 6) AS distance, coalesce(NOT base_failed AND round(dist, 6) <= {q.CUTOFF}, false) AS kept
FROM st LEFT JOIN f ON st.rid = f.rid"""
