"""DuckDB SQL for fits: logistic regression by Newton steps, principal
components by repeated squaring. Oracles of the model queries."""
from __future__ import annotations

NEWTON_STEPS = 14


def logistic_ctes(rows: str, feats: list[str], y: str, fits: list[tuple[str, str, str]]) -> str:
    """Common table expressions that end in ``model``: fit, b0 (intercept), b1..,
    and the preprocessing ``c_med, c_mean, c_scale`` of every feature. fits:
    (name, condition of its train rows, regularisation in terms of ``lr_n``, their
    number)."""
    p = len(feats)
    member = " ".join(f"WHEN '{name}' THEN {cond}" for name, cond, _ in fits)
    reg = " ".join(f"WHEN '{name}' THEN {expr}" for name, _, expr in fits)
    names = ", ".join(f"('{name}')" for name, _, _ in fits)
    med = ", ".join(f"median({c}) AS {c}_med" for c in feats)
    scale = ", ".join(f"avg(v_{c}) AS {c}_mean, CASE WHEN stddev_pop(v_{c}) = 0 THEN 1.0 ELSE stddev_pop(v_{c}) END AS {c}_scale"
                      for c in feats)
    filled = ", ".join(f"CAST(coalesce({c}, {c}_med) AS DOUBLE) AS v_{c}" for c in feats)
    x = ", ".join(f"(v_{c} - {c}_mean) / {c}_scale AS x{i}" for i, c in enumerate(feats, 1))
    at = range(p + 1)
    margin = " + ".join(f"b{i} * x{i}" for i in at)
    sums = ", ".join([f"sum(w * (pr - y) * x{i}) + {f'any_value(reg) * b{i}' if i else '0'} AS g{i}" for i in at]
                     + [f"sum(w * pr * (1 - pr) * x{i} * x{j}){' + any_value(reg)' if i == j and i else ''} AS h{i}_{j}"
                        for i in at for j in range(i + 1)])
    # Cholesky, forward and backward, one column each (a column sees those before it)
    solve = []
    for i in at:
        for j in range(i + 1):
            rest = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            solve.append(f"sqrt(h{i}_{i}{rest}) AS l{i}_{i}" if i == j else f"(h{i}_{j}{rest}) / l{j}_{j} AS l{i}_{j}")
    for i in at:
        solve.append(f"(g{i}{''.join(f' - l{i}_{k} * f{k}' for k in range(i))}) / l{i}_{i} AS f{i}")
    for i in reversed(at):
        solve.append(f"(f{i}{''.join(f' - l{k}_{i} * s{k}' for k in range(i + 1, p + 1))}) / l{i}_{i} AS s{i}")
    bs = ", ".join(f"b{i}" for i in at)
    return f"""lr_rows AS ({rows}),
lr_train AS (SELECT f.fit, r.* FROM lr_rows r, (VALUES {names}) f(fit) WHERE CASE f.fit {member} END),
lr_med AS (SELECT fit, count(*) AS lr_n, count(*) FILTER (WHERE {y} = 1) AS lr_n1, {med} FROM lr_train GROUP BY fit),
lr_fill AS (SELECT fit, lr_n, lr_n1, CAST({y} AS DOUBLE) AS y, {filled} FROM lr_train JOIN lr_med USING (fit)),
lr_scale AS (SELECT fit, {scale} FROM lr_fill GROUP BY fit),
lr_data AS (SELECT fit, 1.0::DOUBLE AS x0, {x}, y, CASE WHEN y = 1 THEN 0.5 / lr_n1 ELSE 0.5 / (lr_n - lr_n1) END AS w,
  CASE fit {reg} END AS reg FROM lr_fill JOIN lr_scale USING (fit)),
lr_it AS (
  SELECT fit, 0 AS k, {', '.join(f'0.0::DOUBLE AS b{i}' for i in at)} FROM lr_med
  UNION ALL
  SELECT fit, k + 1, {', '.join(f'b{i} - s{i}' for i in at)} FROM (SELECT fit, k, {bs}, {', '.join(solve)} FROM (
    SELECT fit, k, {bs}, {sums} FROM (
      SELECT i.*, d.* EXCLUDE (fit), 1 / (1 + exp(-({margin}))) AS pr FROM lr_it i JOIN lr_data d ON i.fit = d.fit WHERE k < {NEWTON_STEPS}) e
    GROUP BY fit, k, {bs}) a) b),
model AS (SELECT * EXCLUDE (k, lr_n, lr_n1) FROM lr_it JOIN lr_med USING (fit) JOIN lr_scale USING (fit) WHERE k = {NEWTON_STEPS})"""


def logistic_p1(feats: list[str]) -> str:
    """Probability of class 1 of a row beside its ``model``."""
    terms = " + ".join(f"b{i} * ((coalesce({c}, {c}_med) - {c}_mean) / {c}_scale)" for i, c in enumerate(feats, 1))
    return f"1 / (1 + exp(-(b0 + {terms})))"


def components_ctes(rows: str, cols: list[str], k: int, squarings: int = 40) -> str:
    """Common table expressions ``pc_scaled`` (id, c, x: standardised cells),
    ``pc_share`` (component, share of the variance) and ``pc_load`` (component, c,
    v: loadings, the largest positive). rows: id and the columns. The leading
    component of a covariance is a column of its high powers; it is taken out
    (deflated) before the next."""
    long = ", ".join(cols)
    steps = []
    for j in range(1, k + 1):
        before = "pc_cov" if j == 1 else f"pc_left{j - 1}"
        steps.append(f"""pc_pow{j} AS (
  SELECT 0 AS s, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM {before}
  UNION ALL
  SELECT s + 1, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (
    SELECT a.s, a.i, b.j, sum(a.v * b.v) AS v FROM pc_pow{j} a JOIN pc_pow{j} b ON a.j = b.i WHERE a.s < {squarings} GROUP BY ALL) q),
pc_vec{j} AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM pc_pow{j}
  WHERE s = {squarings} AND j = (SELECT arg_max(i, v) FROM pc_pow{j} WHERE s = {squarings} AND i = j)),
pc_val{j} AS (SELECT sum(a.v * c.v * b.v) AS l FROM {before} c JOIN pc_vec{j} a ON a.i = c.i JOIN pc_vec{j} b ON b.i = c.j),
pc_left{j} AS (SELECT c.i, c.j, c.v - l * a.v * b.v AS v FROM {before} c JOIN pc_vec{j} a ON a.i = c.i JOIN pc_vec{j} b ON b.i = c.j, pc_val{j})""")
    number = {c: i for i, c in enumerate(cols)}
    index = " ".join(f"WHEN '{c}' THEN {i}" for c, i in number.items())
    load = " UNION ALL ".join(f"""SELECT {j} AS component, i AS c,
  v * (SELECT sign(arg_max(v, abs(v))) FROM pc_vec{j}) AS v FROM pc_vec{j}""" for j in range(1, k + 1))
    share = " UNION ALL ".join(f"SELECT {j} AS component, l / (SELECT sum(v) FROM pc_cov WHERE i = j) AS share FROM pc_val{j}"
                               for j in range(1, k + 1))
    return f"""pc_rows AS ({rows}),
pc_long AS (SELECT id, CASE c {index} END AS c, CAST(x AS DOUBLE) AS x FROM (UNPIVOT pc_rows ON {long} INTO NAME c VALUE x)),
pc_stat AS (SELECT c, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS s FROM pc_long GROUP BY c),
pc_scaled AS (SELECT id, c, (x - m) / s AS x FROM pc_long JOIN pc_stat USING (c)),
pc_cov AS (SELECT a.c AS i, b.c AS j, sum(a.x * b.x) / (count(*) - 1) AS v FROM pc_scaled a JOIN pc_scaled b USING (id) GROUP BY ALL),
{', '.join(steps)},
pc_share AS ({share}), pc_load AS ({load})"""
