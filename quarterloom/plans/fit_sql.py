"""SQL of the statistics that need more than an aggregate: fits with fixed effects, and tail probabilities.

Effects of two kinds are taken out by turns in a recursive query, normal equations are solved by sweeping, one pivot a step, and tail
probabilities are integrals by Simpson's rule. All of it independent of the ways of operators.stats.
"""

from __future__ import annotations

_STEPS = 60


def normal_tail(z: str) -> str:
    """Two-sided p of a normal value."""
    weight = "case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(case when {z} is not null then 2 / sqrt(2 * pi()) * 0.006 / 3 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * exp(-0.5 * pow(abs({z}) + i * 0.006, 2)))) end)"


def correlation_tail(r: str, n: str) -> str:
    """Two-sided p of a correlation of n pairs: the tail of Student's t as an integral over angles."""
    weight = "case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end"
    low = f"asin(abs({r}))"
    area = f"(pi() / 2 - {low}) / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * pow(cos({low} + (pi() / 2 - {low}) / 2000 * i), {n} - 3)))"
    return f"(case when {r} is null or {n} < 3 then null when abs({r}) >= 1 then 0 else 2 * {area} * exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0)) / sqrt(pi()) end)"


def fit(name: str, source: str, y: str, xs: list[str], entity: str, time: str | None = None) -> str:
    """CTEs that end in ``name``: term, coef, se, t, p, n, entities, r2_within, as fe_fit gives them."""
    columns = ["y", *(f"x{k}" for k in range(len(xs)))]
    p = len(xs)
    present = " and ".join(f"{c} is not null" for c in [y, *xs, entity, *([time] if time else [])])
    base = f"{name}_b as (select {entity} as e, {time or 'null'} as t, ({y})::double as y, " + ", ".join(f"({x})::double as x{k}" for k, x in enumerate(xs)) + f" from {source} where {present})"
    less = lambda by, frm: f"select i, e, t, {', '.join(f'{c} - avg({c}) over (partition by {by}) as {c}' for c in columns)} from {frm}"
    if time:
        inner = less("e", f"(select * from {name}_r where i < {_STEPS})")
        rest = f"{name}_r as (select 0 as i, * from {name}_b union all select i + 1 as i, e, t, {', '.join(columns)} from ({less('t', f'({inner})')}))"
        rows = f"{name}_d as ({less('e', f'(select * from {name}_r where i = {_STEPS})')})"
    else:
        rest = ""
        rows = f"{name}_d as ({less('e', f'(select 0 as i, * from {name}_b)')})"
    parts = [base, *([rest] if rest else []), rows]
    cells = [(i, j) for i in range(p + 1) for j in range(p + 1)]
    col = lambda i: f"x{i}" if i < p else "y"
    parts.append(f"{name}_s0 as (select count(*) as n, count(distinct e) as g, greatest(0, count(distinct t) - 1) as q, sum(y * y) as yy, {', '.join(f'sum({col(i)} * {col(j)}) as a{i}_{j}' for i, j in cells)} from {name}_d)")
    for r in range(p):
        d = f"a{r}_{r}"
        step = []
        for i, j in cells:
            a = f"a{i}_{j}"
            value = f"1 / {d}" if (i, j) == (r, r) else f"{a} / {d}" if i == r else f"-{a} / {d}" if j == r else f"{a} - a{i}_{r} * a{r}_{j} / {d}"
            step.append(f"{value} as {a}")
        parts.append(f"{name}_s{r + 1} as (select n, g, q, yy, {', '.join(step)} from {name}_s{r})")
    error = "y - " + " - ".join(f"x{k} * a{k}_{p}" for k in range(p))
    parts.append(f"{name}_c as (select {', '.join(f'sum(x{k} * ({error})) as s{k}' for k in range(p))} from {name}_d, {name}_s{p} group by e)")
    parts.append(f"{name}_m as (select {', '.join(f'sum(s{i} * s{j}) as m{i}_{j}' for i in range(p) for j in range(p))} from {name}_c)")
    free = f"(n - ({p} + g + q))"
    factor = f"(case when g > 1 and {free} > 0 then g / (g - 1)::double * (n - 1) / {free} end)"
    fitted = " + ".join(f"a{k}_{p} * b{k}" for k in range(p))
    totals = f"(select {', '.join(f'sum(x{k} * y) as b{k}' for k in range(p))} from {name}_d)"
    ends = []
    for k, x in enumerate(xs):
        meat = " + ".join(f"a{k}_{i} * m{i}_{j} * a{j}_{k}" for i in range(p) for j in range(p))
        ends.append(f"select '{x}' as term, a{k}_{p} as coef, sqrt({factor} * greatest(0, {meat})) as se, n, g as entities, ({fitted}) / yy as r2_within from {name}_s{p}, {name}_m, {totals}")
    parts.append(f"{name}_u as ({' union all '.join(ends)}), {name} as (select term, coef, se, coef / nullif(se, 0) as t, {normal_tail('coef / nullif(se, 0)')} as p, n, entities, r2_within from {name}_u)")
    return ", ".join(parts)
