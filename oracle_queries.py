"""SQL for DuckDB that states what each query of ``__spark_entry__`` must return, over the whole tables."""

from __future__ import annotations

N_BANDS = 64
ALL = list(range(N_BANDS))
TENS = [4 * i for i in range(16)]

def even(expression: str, digits: int) -> str:
    """Rounded the way numeric arrays are: scaled, halves to even, scaled back."""
    scale = float(10**digits)
    return f"(round_even(({expression}) * {scale}, 0) / {scale} + 0.0)"


def r(expression: str, digits: int) -> str:
    """Rounded; the addition turns -0.0 into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"


SITE = """select c_custkey as id, c_name as name_txt, c_nationkey as nation_code, c_acctbal as balance_m,
    c_mktsegment as segment_txt from customer"""


def lab(key: str = "o_custkey") -> str:
    return f"""select {key} as id, case when o_orderstatus <> 'P' then o_totalprice end as price_w_usd,
    case when o_orderpriority <> '5-LOW'
        then cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as double) end as age_index,
    o_orderkey as order_n from orders"""


def spectra(key: str = "vec_id") -> str:
    return f"select {key} as id, label as instrument_txt, embedding::double[] as y from embeddings"


GAPPY = "select vec_id as id, list_transform(embedding::double[], lambda v: case when v >= -0.1 then v end) as y from embeddings"


def label(i: int) -> str:
    value = 400 + 2.5 * i
    return f"{value:g}"


def bands(positions: list[int], prefix: str = "b") -> str:
    return ", ".join(f'y[{i + 1}] as "{prefix}{label(i).replace(".", "_")}"' for i in positions)


REGISTRY = """select p_brand as dataset_code,
    case when p_type <> 'SMALL' then 'lib_' || case when p_size <= 9 then 'mir' when p_size <= 18 then 'visnir'
        when p_size <= 24 then 'NIR' when p_size <= 36 then 'soillab' when p_size <= 48 then 'soilsite' else 'notes' end
        || '_v' || p_size || case when p_type = 'PROMO' then '.csv.gz' else '.parquet' end end as file_name,
    'store/' || p_brand || '/' || p_partkey as public_url, p_partkey as line_no from part"""

CLASSIFIED = f"""select *, case when contains(file_name, 'soilsite') then 'soilsite'
        when contains(file_name, 'soillab') then 'soillab' when contains(lower(file_name), '_mir_') then 'mir'
        when contains(lower(file_name), '_visnir_') then 'visnir' when contains(lower(file_name), '_nir_') then 'nir'
        end as role
    from ({REGISTRY}) where contains(file_name, '.parquet')"""

COLUMNS = """select distinct 'store/' || p_brand || '/' || p_partkey as public_url,
    case when l_linenumber = 1 then 'id.scan_local_c'
        when l_linenumber = 2 then lower(l_linestatus) || '_' || lower(l_returnflag) || '_txt'
        when l_linenumber = 3 then 'scan_mir.bad' || tail
        else 'scan_mir.' || cast(400 + 2.5 * l_quantity as varchar) || tail end as "column"
    from (select *, case l_returnflag when 'A' then '_abs' when 'R' then '_ref' else '_bc.abs' end as tail from lineitem)
    join part on l_partkey = p_partkey"""

BAND_NAMES = f"""select public_url, "column", case when starts_with("column", 'scan_') then try_cast(
        regexp_replace(regexp_replace("column", '^scan_.*?\\.', ''), '_(abs|ref|bc\\.abs)$', '') as double) end as band
    from ({COLUMNS})"""

DESCRIBED = f"""select public_url, string_agg("column", ',' order by "column") as columns,
    min(band) as scan_min, max(band) as scan_max, count(band) as scan_count,
    coalesce(string_agg("column", ',' order by "column") filter (where not starts_with("column", 'scan_')
        and "column" not in ('id.layer_local_c', 'id.scan_local_c', 'id.layer_uuid_c', 'id.layer_uuid')), '')
        as meta_columns
    from ({BAND_NAMES}) group by public_url"""

CATALOG = f"""with described as ({DESCRIBED}), files as ({CLASSIFIED}),
    soil as (select *, row_number() over (partition by dataset_code, role order by line_no) as rn
        from files where role in ('soilsite', 'soillab')),
    spectral as (select *, row_number() over (partition by dataset_code, role order by line_no desc) as rn
        from files where role in ('mir', 'visnir', 'nir') and public_url in (select public_url from described))
    select dataset_code, role, public_url as url, columns, null::double as scan_min, null::double as scan_max,
        null::bigint as scan_count, null::varchar as meta_columns
    from soil join described using (public_url) where rn = 1
    union all
    select dataset_code, role, public_url, null, scan_min, scan_max, scan_count, meta_columns
    from spectral join described using (public_url) where rn = 1"""

FIRST = f"select dataset_code, role, min_by(public_url, line_no) as public_url from ({CLASSIFIED}) where role is not null group by 1, 2"

OVERVIEW = """select 'Brand#' || (n_nationkey + 3) as new_code, r_name as extent,
    case when n_regionkey = 0 then 'mir' when n_regionkey <= 2 then 'vnir, mir' else 'nir' end as spectral_range,
    n_name as country from nation join region on n_regionkey = r_regionkey"""

SOIL = f"""select l.id, l.price_w_usd, l.order_n, s.segment_txt, s.balance_m
    from ({lab()}) l join ({SITE}) s on l.id = s.id where l.price_w_usd is not null and s.balance_m >= 0"""


def soil(key: str) -> str:
    return SOIL.replace(lab(), lab(key))


def extract(how: str, lab_key: str = "o_custkey", spectra_key: str = "vec_id", id_type: str = "bigint") -> str:
    return f"""with soil as ({soil(lab_key)}), spec as ({spectra(spectra_key)})
    select cast(coalesce(soil.id, spec.id) as {id_type}) as id, price_w_usd, cast(order_n as double) as order_n,
        segment_txt, balance_m, cast(instrument_txt as double) as instrument_txt, {bands(ALL)}
    from soil {how} join spec on soil.id = spec.id"""


HOT_LAB = "case when o_orderstatus = 'F' then 7 else o_custkey end"
HOT_SPECTRA = "case when label <= 2 then 8 else vec_id end"
NO_SPECTRA = "case when label <= 2 then null else vec_id end"


def summary(source: str, properties: dict[str, str]) -> str:
    parts = []
    for name, x in properties.items():
        parts.append(f"""select '{name}' as property, count(x) as count, {even('min(x)', 4)} as min,
    {even('avg(x)', 4)} as mean, {even('stddev_samp(x)', 4)} as std, {even('quantile_cont(x, 0.5)', 4)} as median,
    {even('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 4)} as iqr, {even('max(x)', 4)} as max,
    case when count(x) < 3 then null when min(x) = max(x) then 0.0 else {even('skewness(x)', 4)} end as skewness,
    case when count(x) < 4 then null when min(x) = max(x) then 0.0 else {even('kurtosis(x)', 4)} end as kurtosis
    from (select cast({x} as double) as x from ({source}))""")
    return "\nunion all\n".join(parts)


def profile(source: str) -> str:
    return f"""select 400 + 2.5 * (pos - 1) as band, count(v) as n, {r('avg(v)', 8)} as mean, {r('stddev_pop(v)', 8)} as sd,
    {r('avg(v) - stddev_pop(v)', 8)} as lower, {r('avg(v) + stddev_pop(v)', 8)} as upper
    from (select unnest(y) as v, generate_subscripts(y, 1) as pos from ({source})) group by pos"""


def resampled(source: str, lo: float, hi: float, step: float, keep: str = "id", n: int = N_BANDS, digits: int = 8) -> str:
    points = int((hi - lo) // step) + 1
    last = 400 + 2.5 * (n - 1)
    return f"""select {keep}, band, {r('case when band <= 400 then y[1] when band >= ' + str(last) + f' then y[{n}] when w = 0 then y[i + 1] else y[i + 1] + (y[i + 2] - y[i + 1]) * w end', digits)} as value
    from (select *, (band - (400 + 2.5 * i)) / 2.5 as w from (
        select *, cast(floor((band - 400) / 2.5) as bigint) as i from (
            select *, {float(lo)}::double + k * {float(step)}::double as band
            from ({source}), (select unnest(range({points})) as k))))"""


def sampled(source: str, columns: str, key: str, target: str) -> str:
    return f"""select {columns} from (select *, row_number() over (order by md5({key} || '|42'), {key}) as rn,
        count(*) over () as total from ({source})) where rn <= {target}"""


def stratified(source: str, columns: str, key: str, group: str, target: str) -> str:
    return f"""select {columns} from (select *, row_number() over (partition by {group} order by md5({key} || '|42'), {key}) as rn,
        count(*) over () as total, count(*) over (partition by {group}) as size from ({source}))
    where {group} is not null and rn <= greatest(1, round_even(({target}) * size / total, 0))"""


COPIES = "select o_orderstatus, o_orderpriority from orders"
COPY_KEY = "o_orderstatus || '|' || o_orderpriority"


def levels(table: str, columns: list[str], limit: int | None = None) -> str:
    return "\nunion all\n".join(
        f"""(select '{c}' as "column", level from (select distinct cast({c} as varchar) as level from ({table}))
        where level is not null{f" order by level limit {limit}" if limit else ""})"""
        for c in columns
    )


def transformed(transform: str) -> str:
    f = {"log1p": "ln(1 + cast({} as double))", "sqrt": "sqrt(cast({} as double))"}[transform]
    columns = ", ".join(f"{r(f.format(c), 8)} as {c}_{transform}" for c in ("price_w_usd", "age_index", "order_n"))
    return f"select id, {columns} from ({lab()}) where price_w_usd is not null and age_index is not null"


def preprocessed(value: str, shift: float = 0) -> str:
    return f"""select id, 400 + 2.5 * (pos - 1) + {shift} as band, {r('x', 6)} as value from (select id, pos, {value} as x from (
        select id, unnest(y) as v, generate_subscripts(y, 1) as pos from ({spectra()})) window w as (partition by id))
        where x is not null"""


def _many() -> str:
    """Even orders with whole spectra, odd ones with every second band; both on 400, 410, ... 550, where no value is missing."""
    tens = ", ".join(f"{r(f'b{400 + 10 * i}', 8)} as b{400 + 10 * i}" for i in range(16))
    parts = [
        f"""select '{code}' as dataset_code, id, price_w_usd, order_n, {segment} as segment_txt, balance_m, instrument_txt, {tens}
        from ({extract('')}) where cast(order_n as bigint) % 2 = {rest}"""
        for code, rest, segment in (("EVEN", 0, "segment_txt"), ("ODD", 1, "null"))
    ]
    return " union all ".join(parts)


MANY = _many()


def oracle_sql() -> dict[str, str]:
    lineitem_properties = {c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")}
    pivot = ", ".join(f"max(value) filter (where band = {x}) as \"b{x}\"" for x in range(405, 556, 10))
    wide_file = f"""select id, {r('sqrt(price_w_usd)', 8)} as price_w_usd_sqrt, {r('sqrt(order_n)', 8)} as order_n,
        * exclude (id, price_w_usd, order_n) from ({extract('')}) where instrument_txt in (0, 2, 9)"""
    return {
        "catalog_codes": f"select distinct dataset_code from ({REGISTRY}) where contains(file_name, '.parquet')",
        "catalog_parquet_rows": f"select * from ({REGISTRY}) where contains(file_name, '.parquet')",
        "catalog_roles": f"select public_url, role from ({CLASSIFIED}) where role is not null",
        "catalog_first_url": FIRST,
        "catalog_types": f"""select dataset_code, string_agg(distinct role, ',' order by role) as spectra_types
            from ({CLASSIFIED}) where role in ('mir', 'visnir', 'nir') group by 1""",
        "catalog_complete": f"""select *, has_site and has_lab and has_spectra as complete from (
            select dataset_code, coalesce(bool_or(role = 'soilsite'), false) as has_site,
                coalesce(bool_or(role = 'soillab'), false) as has_lab,
                coalesce(bool_or(role in ('mir', 'visnir', 'nir')), false) as has_spectra
            from (select distinct dataset_code from ({REGISTRY})) left join ({CLASSIFIED}) using (dataset_code) group by 1)""",
        "catalog_resolve": f"""with first as ({FIRST})
            select p.dataset_code, p.role as spectra_type, p.public_url as spectra_url, s.public_url as site_url,
                l.public_url as lab_url
            from first p join first s on p.dataset_code = s.dataset_code and s.role = 'soilsite'
            join first l on p.dataset_code = l.dataset_code and l.role = 'soillab'
            where p.role in ('mir', 'visnir', 'nir')""",
        "catalog_band_names": BAND_NAMES,
        "catalog_band_range": f"select public_url, scan_min, scan_max, scan_count from ({DESCRIBED})",
        "catalog_column_lists": f"select public_url, columns, meta_columns from ({DESCRIBED})",
        "catalog_build": f"select * replace (cast(scan_count as double) as scan_count) from ({CATALOG})",
        "catalog_documents": f"""with built as ({CATALOG})
            select dataset_code, coalesce(string_agg(role, ',' order by role)
                filter (where role in ('mir', 'visnir', 'nir')), '') as spectra_types,
                coalesce(string_agg(role, ',' order by role), '') as roles,
                cast(coalesce(sum(scan_count), 0) as bigint) as bands
            from (select distinct dataset_code from ({REGISTRY}) where contains(file_name, '.parquet'))
            left join built using (dataset_code) group by dataset_code""",
        "overview_project": f"select distinct extent, spectral_range as ranges from ({OVERVIEW})",
        "overview_filter": f"""select distinct extent, spectral_range as ranges from ({OVERVIEW})
            where contains(lower(spectral_range), 'mir') and contains(lower(extent), 'a')""",
        "missing_libraries": f"""select distinct new_code as dataset_code from ({OVERVIEW}) o
            where not exists (select 1 from ({REGISTRY}) p where p.dataset_code = o.new_code)""",
        "range_mismatches": f"""with o as ({OVERVIEW}),
            listed as (select distinct new_code as dataset_code, case trim(w) when 'vnir' then 'visnir' else trim(w) end
                as spectra_type from (select new_code, unnest(string_split(spectral_range, ',')) as w from o)),
            filed as (select distinct dataset_code, role as spectra_type from ({CLASSIFIED})
                where role in ('mir', 'visnir', 'nir') and dataset_code in (select new_code from o))
            select dataset_code, spectra_type, listed.spectra_type is not null as listed,
                filed.spectra_type is not null as filed
            from listed full join filed using (dataset_code, spectra_type)
            where (listed.spectra_type is null) <> (filed.spectra_type is null)""",
        "site_in_range": """select c_custkey as id, c_mktsegment as segment_txt, c_acctbal as balance_m,
            c_nationkey as nation_code from customer where c_mktsegment in ('BUILDING', 'MACHINERY')
            and c_acctbal >= 0 and c_acctbal <= 5000 and c_nationkey::varchar in ('1', '2', '3', '5', '8', '13')""",
        "site_lower_bound": "select c_custkey as id, c_acctbal as balance_m, c_name as name_txt from customer where c_acctbal >= 2500",
        "site_levels": levels(SITE, ["segment_txt", "name_txt", "nation_code"]),
        "site_levels_first": levels(SITE, ["segment_txt", "name_txt", "nation_code"], 7),
        "spec_levels": levels("select * from documents", ["lang", "source", "n_chars"]),
        "level_counts": f"""select "column", count(*) as levels from ({levels("select * from documents", ["lang", "source", "n_chars"])}) group by 1""",
        "site_typed_levels": """select c_custkey as id, c_nationkey as nation_code, c_acctbal < 0 as owes_logical,
            c_nationkey / 8 as share_code, c_acctbal as balance_m from customer
            where c_nationkey in (1, 2, 3, 5, 8, 13) and not (c_acctbal < 0) and c_nationkey / 8 in (0.125, 0.25, 0.625, 1.0)""",
        "site_stale_selection": "select c_custkey as id, c_mktsegment as segment_txt, c_name as name_txt from customer where c_mktsegment = 'BUILDING'",
        "lab_default_property": f"select id, age_index from ({lab()}) where age_index is not null",
        "lab_complete_case": f"select * from ({lab()}) where price_w_usd is not null and age_index is not null",
        "lab_log1p": transformed("log1p"),
        "lab_sqrt": transformed("sqrt"),
        "lab_out_of_domain": f"""select c_custkey as id,
            case when c_acctbal >= 0 then {r('sqrt(c_acctbal)', 8)} end as balance_m_sqrt,
            case when c_acctbal > -1 then {r('ln(1 + c_acctbal)', 8)} end as balance_m_log1p from customer""",
        "domain_errors": "select 'balance_m' as property, count(*) as out_of_domain from customer where c_acctbal <= -1",
        "spec_meta_filter": f"""select id, instrument_txt, 400 + 2.5 * (pos - 1) as band, v as value from (
            select id, instrument_txt, unnest(y) as v, generate_subscripts(y, 1) as pos from ({spectra()})
            where instrument_txt in (1, 4, 7))""",
        "band_range_thin": f"select id, {bands([i for i in TENS if 420 <= 400 + 2.5 * i <= 530])} from ({spectra()})",
        "export_projection": f"select id, instrument_txt, {bands(ALL)} from ({spectra()})",
        "preview_rows": f"select *, {even('p_retailprice / 3', 5)} as third from (select * replace ({even('p_retailprice', 5)} as p_retailprice) from part) order by p_partkey limit 10",
        "soil_preview": SOIL,
        "soil_name_clash": f"""select l.id, l.age_index, l.order_n, s.segment_txt from ({lab()}) l
            join ({SITE}) s on l.id = s.id where l.age_index is not null""",
        "extract_inner": extract(""),
        "extract_full": extract("full"),
        "extract_left": extract("left"),
        "extract_wide_file": wide_file,
        "extract_hot_lab_inner": extract("", HOT_LAB),
        "extract_hot_lab_full": extract("full", HOT_LAB),
        "extract_hot_spectra_left": extract("left", HOT_LAB, HOT_SPECTRA),
        "extract_hot_spectra_full": extract("full", HOT_LAB, HOT_SPECTRA),
        "extract_hot_default": extract("", HOT_LAB),
        "extract_shuffled": extract("full", HOT_LAB, HOT_SPECTRA),
        "extract_many": MANY,
        "sample_extract": stratified(
            sampled(f"select * from ({SOIL})", "* exclude (rn, total)", "order_n", "greatest(1, floor(total * 50 / 100))"),
            "* exclude (rn, total, size)", "order_n", "segment_txt", "floor(total * 10 / 100)",
        ),
        "preprocess_snv": preprocessed("(v - avg(v) over w) / stddev_samp(v) over w"),
        "preprocess_area": preprocessed("v / sum(abs(v)) over w"),
        "preprocess_derivative": preprocessed("(lead(v) over (partition by id order by pos) - v) / 2.5", 1.25),
        "extract_null_keys": extract("full", HOT_LAB, NO_SPECTRA, "double"),
        "step_counts": f"""select 'site' as step, count(*) as rows from customer
            union all select 'site_filtered', count(*) from customer where c_acctbal >= 0
            union all select 'lab', count(*) from orders
            union all select 'lab_complete', count(*) from ({lab()}) where price_w_usd is not null
            union all select 'spectra', count(*) from embeddings
            union all select 'spectra_filtered', count(*) from embeddings where label in (1, 2)
            union all select 'soil', count(*) from ({SOIL})
            union all select 'extract', count(*) from ({extract('')}) where instrument_txt in (1, 2)""",
        "key_duplicates": "select o_custkey, count(*) as rows from orders group by 1 having count(*) > 1",
        "summary_stats": summary(
            f"select * from ({lab()}) where price_w_usd is not null and age_index is not null",
            {"price_w_usd": "price_w_usd", "age_index": "age_index"},
        ),
        "summary_stats_many": summary("select * from lineitem", lineitem_properties),
        "summary_stats_missing": summary(
            "select * from events",
            {
                "gappy": "case when value >= 20 then value end",
                "constant": "6.5",
                "empty": "case when value < 0 then value end",
                "three": "case when event_id < 3 then value end",
                "two": "case when event_id < 2 then value end",
            },
        ),
        "summary_stats_extract": summary(
            f"select price_w_usd, order_n from ({extract('')})",
            {"price_w_usd_log1p": "ln(1 + price_w_usd)", "order_n_log1p": "ln(1 + order_n)"},
        ),
        "summary_stats_brackets": summary(
            "select * from lineitem", {"l_extendedprice": "l_extendedprice", "l_quantity": "l_quantity"}
        ),
        "band_profile": profile(spectra()),
        "band_profile_missing": profile(GAPPY),
        "band_profile_extract": f"""select 400 + 2.5 * (pos - 1) as band, n, mean, sd, lower, upper from (
            select pos, count(v) as n, {r('avg(v)', 8)} as mean, {r('stddev_pop(v)', 8)} as sd,
                {r('avg(v) - stddev_pop(v)', 8)} as lower, {r('avg(v) + stddev_pop(v)', 8)} as upper
            from (select unnest(y) as v, generate_subscripts(y, 1) as pos from ({SOIL}) soil
                join ({spectra()}) spec on soil.id = spec.id) group by pos)""",
        "band_extent": f"""select count(*) as bands, min(band) as x_min, max(band) as x_max, min(lower) as y_min,
            max(upper) as y_max from ({profile(spectra())})""",
        "sample_n": sampled("select * from customer", "* exclude (rn, total)", "c_custkey", "200"),
        "sample_pct": sampled("select * from orders", "* exclude (rn, total)", "o_orderkey", "greatest(1, floor(total * 12.5 / 100))"),
        "sample_stratified": stratified("select * from customer", "* exclude (rn, total, size)", "c_custkey", "c_mktsegment", "333"),
        "sample_stratified_pct": stratified(
            "select doc_id, text, lang, n_chars, case when lang <> 'en' then source end as source_c from documents",
            "* exclude (rn, total, size)", "doc_id", "source_c", "floor(total * 20 / 100)",
        ),
        "sample_copies": sampled(COPIES, "o_orderstatus, o_orderpriority", COPY_KEY, "floor(total * 30 / 100)"),
        "sample_copies_stratified": stratified(
            COPIES, "o_orderstatus, o_orderpriority", COPY_KEY, "o_orderstatus", "floor(total * 30 / 100)"
        ),
        "sample_hot_group": stratified(
            "select *, case when o_orderstatus <> 'F' then 'hot' else o_orderpriority end as group_c from orders",
            "* exclude (rn, total, size)", "o_orderkey", "group_c", "floor(total * 10 / 100)",
        ),
        "resample_linear": resampled(spectra(), 400, 557.5, 2),
        "resample_extrapolate": resampled(spectra(), 390, 570, 10, "id, instrument_txt"),
        "resample_gaps": resampled(GAPPY, 401, 557.5, 2),
        "resample_descending": f"""select id, instrument_txt, {pivot} from (
            {resampled(spectra(), 405, 557.5, 10, 'id, instrument_txt')}) group by id, instrument_txt""",
        "resample_extract": resampled(spectra(), 400, 557.5, 10),
    }
