"""SQL that grows the trees of the queries step by step, as oracle for the fitted models.

Rows are first added up by their feature values (a cell); a tree is then levels of
(node, feature, value) sums over the cells, the best cut of each node, and, under a leaf limit,
the cuts in best-first order.
"""

from __future__ import annotations

LEHMER, STEP = (1 << 31) - 1, 48_271


def row_number(key: str, seed: int) -> str:
    """The number that samples of a row start from."""
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT % {LEHMER - 1} + 1)"


def uniform(row: str, draw: int) -> str:
    return f"({row} * {pow(STEP, draw + 1, LEHMER)} % {LEHMER} / {float(LEHMER)})"


def tree(name: str, source: str, p: int, depth: int, part: str, *, leaves: int | None = None, least: float = 1, value: str = "sum(a) / sum(n)", valid: str = "true") -> list[str]:
    """Tables of one tree over ``source`` (x0.., n, a, b); ``name`` has the columns of source and ``leaf``, ``{name}_v`` the value of each leaf.

    ``part`` is what sums {n}, {a}, {b} add to a cut's gain; ``valid`` may name al, bl, ar, br.
    """
    xs = "[" + ", ".join(f"x{i}" for i in range(p)) + "]"
    out = [f"{name}_l0 AS MATERIALIZED (SELECT *, 1::BIGINT AS node FROM {source})"]
    gain = part.format(n="nl", a="al", b="bl") + " + " + part.format(n="nr", a="ar", b="br") + " - " + part.format(n="nz", a="az", b="bz")
    for d in range(depth):
        out.append(f"""{name}_b{d} AS MATERIALIZED (SELECT node, f, v, gain FROM (SELECT *, round({gain}, 9) AS gain FROM (
 SELECT *, nz - nl AS nr, az - al AS ar, bz - bl AS br FROM (
  SELECT node, f, v, sum(n) OVER w AS nl, sum(a) OVER w AS al, sum(b) OVER w AS bl, sum(n) OVER t AS nz, sum(a) OVER t AS az, sum(b) OVER t AS bz FROM (
   SELECT node, f, {xs}[f + 1] AS v, sum(n) AS n, sum(a) AS a, sum(b) AS b FROM {name}_l{d}, (SELECT unnest(range({p})) AS f) WHERE node >= {1 << d} AND n > 0 GROUP BY ALL)
  WINDOW w AS (PARTITION BY node, f ORDER BY v), t AS (PARTITION BY node, f))) WHERE nl >= {least} AND nr >= {least} AND nl > 0 AND nr > 0 AND {valid})
 WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1)""")
        out.append(f"{name}_l{d + 1} AS MATERIALIZED (SELECT l.* REPLACE (CASE WHEN c.node IS NULL THEN l.node WHEN {xs}[f + 1] <= v THEN 2 * l.node ELSE 2 * l.node + 1 END AS node) FROM {name}_l{d} l LEFT JOIN {name}_b{d} c USING (node))")
    out.append(f"{name}_c AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {name}_b{d}" for d in range(depth)) + ")")
    if leaves:
        out.append(f"{name}_p1 AS MATERIALIZED (SELECT node FROM {name}_c WHERE node = 1)")
        for k in range(2, leaves):
            out.append(f"{name}_p{k} AS MATERIALIZED (SELECT * FROM {name}_p{k - 1} UNION ALL (SELECT node FROM {name}_c WHERE node // 2 IN (SELECT node FROM {name}_p{k - 1}) AND node NOT IN (SELECT node FROM {name}_p{k - 1}) ORDER BY gain DESC, node LIMIT 1))")
        out.append(f"{name}_k AS MATERIALIZED (SELECT c.* FROM {name}_c c JOIN {name}_p{leaves - 1} USING (node))")
    else:
        out.append(f"{name}_k AS MATERIALIZED (SELECT * FROM {name}_c)")
    out.append(f"{name}_d0 AS MATERIALIZED (SELECT *, 1::BIGINT AS leaf FROM {source})")
    for d in range(depth):
        out.append(f"{name}_d{d + 1} AS MATERIALIZED (SELECT l.* REPLACE (CASE WHEN c.node IS NULL THEN leaf WHEN {xs}[f + 1] <= v THEN 2 * leaf ELSE 2 * leaf + 1 END AS leaf) FROM {name}_d{d} l LEFT JOIN {name}_k c ON c.node = leaf)")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_d{depth})")
    out.append(f"{name}_v AS MATERIALIZED (SELECT leaf, {value} AS value FROM {name} WHERE n > 0 GROUP BY 1)")
    return out


SQUARED = "{a} * {a} / {n}"
NEWTON = "{a} * {a} / {b}"


def boosted(cells: str, p: int, rounds: int, leaves: int, rate: float, slope: str, curve: str, base: list[str], least: int = 20) -> tuple[list[str], str]:
    """Tables of boosting over cells (x0.., n, and sums used by ``slope``), and the last one with scores s0..

    ``slope`` and ``curve`` give the sums of gradient and curvature of a cell for output {k}; base scores are SQL.
    """
    xs, outs = ", ".join(f"x{i}" for i in range(p)), range(len(base))
    tables = [f"r0 AS MATERIALIZED (SELECT *, {', '.join(f'{b} AS s{k}' for k, b in enumerate(base))} FROM {cells})"]
    for r in range(rounds):
        for k in outs:
            tables.append(f"g{r}_{k} AS MATERIALIZED (SELECT {xs}, n::DOUBLE AS n, {slope.format(k=k)} AS a, {curve.format(k=k)} AS b FROM r{r})")
            tables += tree(f"t{r}_{k}", f"g{r}_{k}", p, leaves - 1, NEWTON, leaves=leaves, least=least, value="-sum(a) / sum(b)", valid="bl >= 1e-3 AND br >= 1e-3")
        scores = ", ".join(f"s{k} + {rate} * v{k}.value AS s{k}" for k in outs)
        joins = " ".join(f"JOIN t{r}_{k} m{k} ON " + " AND ".join(f"m{k}.x{i} = r.x{i}" for i in range(p)) + f" JOIN t{r}_{k}_v v{k} ON v{k}.leaf = m{k}.leaf" for k in outs)
        tables.append(f"r{r + 1} AS MATERIALIZED (SELECT r.* REPLACE ({scores}) FROM r{r} r {joins})")
    return tables, f"r{rounds}"
