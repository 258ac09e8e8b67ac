"""SQL for DuckDB that states what the queries on preprocessing, components and regressions must return.

Each is worked out in another way than the library's: windows by Cramer's rule, eigenvectors by squaring the covariance,
regressions by deflating the rows themselves.
"""

from __future__ import annotations

from oracle_queries import GAPPY, N_BANDS, preprocessed, r, spectra

EACH = f"range(1, {N_BANDS + 1})"


def by_band(columns: str, source: str) -> str:
    """One row per band of the lists ``f``."""
    return f"select {columns}, 400 + 2.5 * (pos - 1) as band, {r('v', 6)} as value from (select *, unnest(f) as v, generate_subscripts(f, 1) as pos from {source})"


def local_fit(width: int, order: int) -> str:
    """A parabola fitted to the window of every band by Cramer's rule; its value or slope at the band."""
    value = {
        0: "t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)",
        1: "s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)",
    }[order]
    determinant = "s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)"
    powers = ", ".join(f"sum(u ** {k}) as s{k}" for k in range(5)) + ", " + ", ".join(f"sum(v * u ** {k}) as t{k}" for k in range(3))
    start = f"least(greatest(a.pos - {width // 2}, 1), {N_BANDS - width + 1})"
    return f"""with long as (select id, unnest(y) as v, generate_subscripts(y, 1) as pos from ({spectra()})),
        windows as (select a.pos, b.pos as at, 2.5 * (b.pos - a.pos) as u from {EACH} a(pos), {EACH} b(pos)
            where b.pos between {start} and {start} + {width - 1}),
        sums as (select id, windows.pos, {powers} from long join windows on long.pos = windows.at group by all)
        select id, 400 + 2.5 * (pos - 1) as band, {r(f'({value}) / ({determinant})', 6)} as value from sums"""


def spikes(width: int, threshold: float, least: float) -> str:
    near = f"least(greatest(i - {width // 2}, 1), {N_BANDS - width + 1})"
    reach = f"greatest(least({width // 2}, i - 1, {N_BANDS} - i), 1)"
    start = f"least(greatest(i - {reach}, 1), {N_BANDS - 2})"

    return f"""with a as (select id, y, [list_median(y[{start} : {start} + 2 * {reach}]) for i in {EACH}] as m from ({spectra()})),
        e as (select *, [case i when 1 then 2 * m[1] - m[3] when {N_BANDS} then 2 * m[{N_BANDS}] - m[{N_BANDS - 2}] else m[i] end for i in {EACH}] as e from a),
        b as (select *, greatest({threshold} * 1.4826 * list_median([abs(y[i] - e[i]) for i in {EACH}]),
            {least} * (list_max(m) - list_min(m))) as bar from e),
        c as (select *, [case when greatest(y[i] - list_max(e[greatest(i - 1, 1) : i + 1]), list_min(e[greatest(i - 1, 1) : i + 1]) - y[i]) <= bar
            then y[i] end for i in {EACH}] as k from b),
        d as (select id, [coalesce(k[i], list_median(k[{near} : {near} + {width - 1}]), m[i]) for i in {EACH}] as f from c)
        {by_band('id', 'd')}"""


def less(a: str, b: str, share: str = "1") -> str:
    """A list less a multiple of another."""
    return f"[z[1] - ({share}) * z[2] for z in list_zip({a}, {b})]"


def part(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / list_dot_product({b}, {b})"


# The mean spectrum and the powers of the axis made orthogonal one after the other.
SCATTER = f"""with s as ({spectra()}), long as (select unnest(y) as v, generate_subscripts(y, 1) as pos from s),
    means as (select list(mean order by pos) as m from (select pos, avg(v) as mean from long group by pos)),
    u as (select m, [1.0::double for i in range({N_BANDS})] as p0, [2 * i::double / {N_BANDS - 1} - 1 for i in range({N_BANDS})] as u from means),
    p1 as (select *, {less('u', 'p0', part('u', 'p0'))} as p1, [x * x for x in u] as uu from u),
    p2a as (select *, {less('uu', 'p0', part('uu', 'p0'))} as uv from p1),
    p2 as (select *, {less('uv', 'p1', part('uv', 'p1'))} as p2 from p2a),
    q0 as (select *, {less('m', 'p0', part('m', 'p0'))} as m0 from p2),
    q1 as (select *, {less('m0', 'p1', part('m0', 'p1'))} as m1 from q0),
    q as materialized (select m, p0, p1, p2, {less('m1', 'p2', part('m1', 'p2'))} as q from q1),
    shares as (select id, y, m, p0, p1, p2, {part('y', 'q')} as b from s, q),
    rest as (select *, {less('y', 'm', 'b')} as rest from shares),
    parts as (select *, {part('rest', 'p0')} as a0, {part('rest', 'p1')} as a1, {part('rest', 'p2')} as a2 from rest),
    found as (select id, [(y[i] - a0 * p0[i] - a1 * p1[i] - a2 * p2[i]) / b for i in {EACH}] as f from parts)
    {by_band('id', 'found')}"""

SCALED = f"""select id, 400 + 2.5 * (pos - 1) as band, {r('(v - avg(v) over w) / stddev_samp(v) over w', 6)} as value
    from (select id, unnest(y) as v, generate_subscripts(y, 1) as pos from ({GAPPY})) window w as (partition by pos)"""

TAILS = f"""with s as ({spectra()}), long as (select id, unnest(y) as v, generate_subscripts(y, 1) as pos from s),
    steps as (select pos, v, v - (lag(v) over w + lead(v) over w) / 2 as off from long window w as (partition by id order by pos)),
    told as (select pos, avg(off * off) / 1.5 as own, var_pop(v) as signal from steps group by pos),
    noise as (select a.pos, b.own as noise, a.signal from told a join told b on b.pos = least(greatest(a.pos, 2), {N_BANDS - 1})),
    fine as (select min(pos) as lowest, max(pos) as highest from noise where noise * 1.02 <= signal)
    select 400 + 2.5 * (pos - 1) as band, {r('noise', 6)} as noise, {r('signal', 6)} as signal, pos < lowest or pos > highest as dropped
    from noise, fine"""


def components(count: int, source: str = spectra()) -> str:
    """The leading eigenvectors of the covariance by squaring it again and again, one after the other: CTEs up to ``model``."""
    trace = f"list_sum([m[i][i] for i in {EACH}])"
    square = "[[list_dot_product(a, b) for b in m] for a in m]"
    ctes = f"""s as ({source}), long as (select unnest(y) as v, generate_subscripts(y, 1) as pos from s),
        means as materialized (select list(mean order by pos) as mean from (select pos, avg(v) as mean from long group by pos)),
        d as materialized (select id, {less('y', 'mean')} as d from s, means),
        cells as (select id, unnest(d) as v, generate_subscripts(d, 1) as pos from d),
        cov0 as materialized (select list(line order by i) as c from (select i, list(v order by j) as line from (
            select a.pos as i, b.pos as j, sum(a.v * b.v) / ((select count(*) from d) - 1) as v from cells a join cells b using (id)
            group by all) group by i)),
        total as (select list_sum([c[i][i] for i in {EACH}]) as total from cov0)"""
    for k in range(count):
        ctes += f""",
        power{k} as (select 0 as step, [[x / total for x in line] for line in c] as m from cov{k}, total
            union all select step + 1, [[x / t for x in line] for line in m] from (
                select step, m, {trace} as t from (select step, {square} as m from power{k} where step < 36))),
        line{k} as (select m[list_position(diagonal, list_max(diagonal))] as line from (
            select m, [m[i][i] for i in {EACH}] as diagonal from power{k} where step = 36)),
        vector{k} as materialized (select [x / sqrt(list_dot_product(line, line)) for x in line] as v from line{k}),
        value{k} as materialized (select v, list_dot_product(v, [list_dot_product(line, v) for line in c]) as e from vector{k}, cov{k}),
        cov{k + 1} as materialized (select [[c[i][j] - e * v[i] * v[j] for j in {EACH}] for i in {EACH}] as c from cov{k}, value{k})"""
    every = " union all ".join(f"select {k + 1} as component, v, e from value{k}" for k in range(count))
    return ctes + f", model as materialized ({every})"


LOADINGS = f"""with recursive {components(3)} select component::int as component, {r('e', 6)} as variance, {r('e / total', 6)} as explained,
    400 + 2.5 * (pos - 1) as band, {r('x', 6)} as loading from (select component, e, unnest(v) as x, generate_subscripts(v, 1) as pos from model), total"""


def component_scores(count: int, source: str = spectra()) -> str:
    columns = ", ".join(f"{r(f'max(case when component = {k} then list_dot_product(d, v) end)', 6)} as score_{k}" for k in range(1, count + 1))
    return f"""with recursive {components(count, source)}
        select every.id, {columns} from (select vec_id as id from embeddings) every left join d on every.id = d.id, model group by every.id"""


# The 97.5 % quantiles of the chi-square distribution with three degrees of freedom and of the normal one.
OUTLIERS = f"""with recursive {components(3)},
    distances as (select id, sum(list_dot_product(d, v) ** 2 / e) as score, any_value(list_dot_product(d, d)) - sum(list_dot_product(d, v) ** 2) as residual
        from d, model group by id),
    spread as (select avg(residual) as m, var_pop(residual) as s from distances),
    limits as (select 9.348403604496148 as score_limit,
        m * (1 - s / (9 * m * m) + 1.959963984540054 * sqrt(s / (9 * m * m))) ** 3 as residual_limit from spread)
    select id, instrument_txt, {r('score', 6)} as score_distance, {r('residual', 6)} as residual_distance, {r('score_limit', 6)} as score_limit,
        {r('residual_limit', 6)} as residual_limit, score > score_limit or residual > residual_limit as outlying
    from distances join ({spectra()}) using (id), limits"""


def latent(count: int, known: str, c: str = "") -> str:
    """Partial least squares by deflation of the rows, one component after the other; ``known`` tells the rows learned from.

    CTEs whose names end in ``c`` and the component's number: weights ``w``, scores ``t``, loadings ``p`` and ``q``.
    """
    ctes = f"""every{c} as materialized (select id, y, case when id % 50 not in (7, 8) then instrument_txt::double end as target,
            id % 50 not in (7, 8) and ({known}) as used from ({spectra()})),
        mean{c} as materialized (select list(v order by pos) as mean, any_value(t) as target_mean from (
            select pos, avg(v) as v, avg(target) as t from (
                select target, unnest(y) as v, generate_subscripts(y, 1) as pos from every{c} where used) group by pos)),
        x{c}0 as materialized (select id, {less('y', 'mean')} as x, target - target_mean as t, used from every{c}, mean{c})"""
    for a in range(count):
        ctes += f""",
        w{c}{a} as materialized (select [v / sqrt(list_dot_product(l, l)) for v in l] as w from (select list(v order by pos) as l from (
            select pos, sum(v * t) as v from (select t, unnest(x) as v, generate_subscripts(x, 1) as pos from x{c}{a} where used) group by pos))),
        t{c}{a} as materialized (select id, x, t, used, list_dot_product(x, w) as score from x{c}{a}, w{c}{a}),
        q{c}{a} as materialized (select sum(score * t) / sum(score * score) as q, sum(score * score) as tt from t{c}{a} where used),
        p{c}{a} as materialized (select list(v order by pos) as p from (select pos, sum(v * score) / (select tt from q{c}{a}) as v from (
            select score, unnest(x) as v, generate_subscripts(x, 1) as pos from t{c}{a} where used) group by pos)),
        x{c}{a + 1} as materialized (select id, {less('x', 'p', 'score')} as x, t, used from t{c}{a}, p{c}{a})"""
    return ctes


def predicted(count: int) -> str:
    terms = " + ".join(f"t{a}.score * (select q from q{a})" for a in range(count))
    joins = " ".join(f"join t{a} using (id)" for a in range(1, count))
    return f"with {latent(count, 'true')} select t0.id, {r(f'(select target_mean from mean) + {terms}', 6)} as predicted from t0 {joins}"


def importance(count: int) -> str:
    """Weights turned into directions of the original spectra: each less its part along the loading before."""
    ctes = latent(count, "true") + ", r0 as (select w as r from w0)"
    for a in range(1, count):
        ctes += f", r{a} as (select {less('w', 'r', 'list_dot_product(p, w)')} as r from w{a}, p{a - 1}, r{a - 1})"
    tables = ", ".join(f"w{a}, q{a}, r{a}" for a in range(count))
    squares = " + ".join(f"q{a}.q ** 2 * q{a}.tt * w{a}.w[i] ** 2" for a in range(count))
    every = " + ".join(f"q{a}.q ** 2 * q{a}.tt" for a in range(count))
    coefficient = " + ".join(f"q{a}.q * r{a}.r[i]" for a in range(count))
    return f"""with {ctes} select 400 + 2.5 * (i - 1) as band, {r(f'sqrt({N_BANDS} * ({squares}) / ({every}))', 6)} as importance,
        {r(coefficient, 6)} as coefficient from {tables}, {EACH} bands(i)"""


def validated(count: int, folds: int) -> str:
    """Separate fits, one for each fold left out."""
    ctes = ", ".join(latent(count, f"id % {folds} <> {f}", f"_{f}_") for f in range(folds))
    parts = []
    for f in range(folds):
        for a in range(count):
            joins = " ".join(f"join t_{f}_{b} using (id)" for b in range(1, a + 1))
            terms = " + ".join(f"t_{f}_{b}.score * (select q from q_{f}_{b})" for b in range(a + 1))
            parts.append(f"select {a + 1} as components, t_{f}_0.t - ({terms}) as error from t_{f}_0 {joins} where not t_{f}_0.used and t_{f}_0.t is not null")
    spread = "(select sum((target - m) ** 2) from (select target, avg(target) over () as m from every_0_) where target is not null)"
    return f"""with {ctes} select components, count(*) as rows, {r('sum(error ** 2)', 6)} as press, {r('sqrt(avg(error ** 2))', 6)} as rmse,
        {r(f'1 - sum(error ** 2) / {spread}', 6)} as explained from ({' union all '.join(parts)}) group by components"""


def oracle_sql() -> dict[str, str]:
    return {
        "preprocess_length": preprocessed("v / sqrt(sum(v * v) over w)"),
        "preprocess_smooth": local_fit(7, 0),
        "preprocess_slope": local_fit(9, 1),
        "preprocess_spikes": spikes(7, 1.5, 0.02),
        "preprocess_scatter": SCATTER,
        "preprocess_scaled": SCALED,
        "trimmed_tails": TAILS,
        "pca_loadings": LOADINGS,
        "pca_scores": component_scores(3),
        "pca_missing": component_scores(2, f"select * from ({spectra()}) where id % 10 > 1"),
        "pca_outliers": OUTLIERS,
        "pls_predict": predicted(3),
        "pls_importance": importance(3),
        "pls_cross_validation": validated(3, 4),
    }
