"""SQL for DuckDB that states what queries must return, for those that SQL can express."""

from __future__ import annotations

from spectraloom.llm.pii import CONTEXT_BONUS, KINDS
from spectraloom.llm.secrets import BASE, CLASS, NEEDS, WEAK
from spectraloom.llm.warc import KEPT_HEADERS, VISIT_PARAMETERS

TOPK = """
with v as (
    select vec_id, min(list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint))) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    group by vec_id),
scores as (
    select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) as bigint) as score
    from v as q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scores qualify rank <= 10"""

PII = {k.name: k for k in KINDS}


def names(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


WARC = rf"""
with captures as (
    select 4 * page_id as record_id, 'response' as kind, url, 1000000 + (page_id * 7919 % 100003) * 60 as moment,
        map {{'etag': '"' || md5(html)[1:12] || '"', 'last-modified': 'day ' || page_id % 50, 'content-type': 'text/html',
            'content-length': cast(length(html) as varchar), 'server': 'one'}} as headers, md5(html) as digest
    from pages
    union all
    select 4 * page_id + 1, 'revisit',
        case page_id % 4 when 0 then url || '#again' when 1 then replace(url, '://', '://www.') when 2 then replace(url, 'http', 'HTTP')
            else url || case when contains(url, '?') then '&' else '?' end || 'utm_source=mail' end,
        1000000 + (page_id * 7919 % 100003) * 60 + 3600 * (1 + page_id % 5) - case when page_id % 11 = 0 then 100000 else 0 end,
        map_concat(case page_id % 7 when 0 then map {{'etag': '"other"'}} when 1 then map {{'last-modified': 'day ' || page_id % 50}}
            when 2 then map {{'via': 'proxy'}} else map {{'etag': 'W/"' || md5(html)[1:12] || '"'}} end,
            map {{'cache-control': 'max-age=' || page_id % 100, 'content-length': '0', 'server': 'two'}}), null
    from pages
    union all
    select 4 * page_id + 2, case when page_id % 50 = 0 then 'response' else 'revisit' end,
        'https://static.example.com:443/site.js?sid=' || page_id, 1000000 + page_id * 10, map {{'etag': '"v' || (page_id // 500) || '"'}},
        case when page_id % 50 = 0 then cast(page_id as varchar) end
    from pages),
parsed as (
    select *, regexp_extract(trim(url), '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$',
        ['host', 'port', 'path', 'query']) as u
    from captures),
records as (
    select record_id, kind, moment, headers, digest,
        'http://' || regexp_replace(lower(u.host), '^www\.|\.$', '', 'g') || case when u.port in ('', '80', '443') then '' else ':' || u.port end
        || regexp_replace(regexp_replace(u.path, '//+', '/', 'g'), '/$', '')
        || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(u.query, '&'),
            lambda p: p <> '' and lower(split_part(p, '=', 1)) not in {names(VISIT_PARAMETERS)})), '&'), ''), '') as url
    from parsed),
full_ones as (
    select url, moment, max(record_id) as response, arg_max(headers, record_id) as theirs, arg_max(digest, record_id) as body
    from records where kind = 'response' group by url, moment),
seen as (
    select r.record_id, r.url, r.headers as own, f.response, f.theirs, f.body
    from (select * from records where kind = 'revisit') r asof left join full_ones f on r.url = f.url and r.moment > f.moment),
judged as (
    select *, case when response is null then 'missing'
        when own['etag'] is not null and theirs['etag'] is not null
            then case when regexp_replace(own['etag'], '^W/', '') = regexp_replace(theirs['etag'], '^W/', '') then 'resolved' else 'mismatch' end
        when own['last-modified'] is not null and theirs['last-modified'] is not null
            then case when own['last-modified'] = theirs['last-modified'] then 'resolved' else 'mismatch' end
        else 'unchecked' end as outcome,
        list_filter(map_entries(own), lambda e: e.key not in {names(KEPT_HEADERS)}) as updates
    from seen)
select record_id, url, outcome, case when good then response end as refers_to, case when good then array_to_string(list_sort(list_transform(
        list_concat(updates, list_filter(map_entries(theirs), lambda e: not list_contains(list_transform(updates, lambda x: x.key), e.key))),
        lambda e: e.key || '=' || e.value)), chr(10)) end as headers,
    case when good then body end as digest
from (select *, outcome in ('resolved', 'unchecked') as good from judged)"""


# ---- spans --------------------------------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rows_of(kind: str, number: int, pattern: str, test: str, score: str = "''", source: str = "texts") -> str:
    """Rows ``key, nth, kind, s, e, value, context, score`` of the valid matches of one kind; ``source`` has ``key, t``."""
    inner = f"select *, regexp_extract_all(t, {quoted(pattern)}) as m, string_split_regex(t, {quoted(pattern)}) as g from {source}"
    spans = """unnest(list_transform(range(1, len(m) + 1), lambda i: {
        's': cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint),
        'value': m[i]})) as x"""
    context = "t[greatest(x.s - 39, 1) : x.s] || chr(10) || t[x.s + length(x.value) + 1 : x.s + length(x.value) + 40] as context"
    return f"""select key, {number} as nth, '{kind}' as kind, x.s as s, x.s + length(x.value) as e, x.value as value, context, {score} as score
        from (select *, {context} from (select key, t, {spans} from ({inner}))) where {test}"""


DIGITS = "regexp_replace(x.value, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i:
    case when i % 2 = 1 then cast(reverse({DIGITS})[i] as integer) when cast(reverse({DIGITS})[i] as integer) > 4
    then 2 * cast(reverse({DIGITS})[i] as integer) - 9 else 2 * cast(reverse({DIGITS})[i] as integer) end)) % 10 = 0"""
COMPACT = "replace(x.value, ' ', '')"
MOD97 = f"""list_reduce(list_transform(string_split({COMPACT}[5:] || {COMPACT}[1:4], ''), lambda c: case when c >= 'A' then ascii(c) - 55 else ascii(c) - 48 end),
    lambda a, b: (a * case when b > 9 then 100 else 10 end + b) % 97, 0) = 1"""
PII_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x.value, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || right(p, 3) as integer) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) between 16 and 19 and {LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) between 8 and 15"),
    "iban": (PII["iban"].pattern, MOD97),
    "identity": (PII["identity"].pattern, f"not regexp_matches(x.value, '^(?:000|666|9)|-00-|-0000$') and regexp_matches(context, '(?i)\\b(?:{PII['identity'].words})\\b')"),
}


def written(kinds: int, order: str) -> str:
    return f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by {order}) filter (where nth < {kinds}), '')"


def scored(kind: str) -> str:
    plain, near = (f"{min(1.0, PII[kind].score + bonus):.1f}" for bonus in (0, CONTEXT_BONUS))
    return f"case when regexp_matches(context, '(?i)\\b(?:{PII[kind].words})\\b') then '{near}' else '{plain}' end"


def digest(kinds: dict[str, tuple[str, str]], base: int, order: str) -> str:
    """Counts, hash and text of the spans of each document, repeated rows by themselves."""
    found = " union all ".join(rows_of(k, i, *rule, scored(k)) for i, (k, rule) in enumerate(kinds.items()))
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in list(kinds)[:base])
    return f"""with texts as (select row_number() over () as key, doc_id, coalesce(text, '') as t from documents),
    found as ({found})
    select doc_id, {counts}, sha256({written(base, order)}) as base_sha256, {written(len(kinds), order)} as spans,
        coalesce(string_agg(score, ',' order by {order}), '') as scores
    from texts left join found using (key) group by key, doc_id"""


SECRET_KINDS = {
    "assign": (BASE["assign"], f"length(regexp_extract(x.value, {quoted(BASE['assign'])}, 1)) >= 8"),
    "access": (BASE["access"], "length(x.value) >= 16"),
    "hex": (BASE["hex"], "true"),
    # A run of just 40 characters; an equals sign beside it would be part of the run.
    "bare_key": ("[A-Za-z0-9+/=]+", "length(x.value) = 40 and not contains(x.value, '=') and regexp_matches(x.value, '[0-9]') and regexp_matches(x.value, '[A-Z]') and regexp_matches(x.value, '[a-z]')"),
    "identifier": (WEAK["identifier"], "true"),
    "endpoint": (WEAK["endpoint"], "true"),
}


def secrets_sql() -> str:
    """Weak parts are held against all parts of their scope."""
    every = " union all ".join(rows_of(k, i, *rule) for i, (k, rule) in enumerate(SECRET_KINDS.items()))
    blank = "list_filter(string_split(t[1:s], chr(10))[2:-2], lambda line: regexp_full_match(line, '[ \\t\\r]*'))"
    classes = " ".join(f"when '{k}' then '{c}'" for k, c in CLASS.items())
    near = "b.key = a.key and b.scope = a.scope and (b.s <= a.s and a.s - b.e <= 400 or b.s >= a.s and b.s - a.e <= 400)"
    tests = " or ".join(
        f"kind = '{k}' and " + " and ".join(f"exists (select 1 from parts b where b.class = '{c}' and {near})" for c in needs) for k, needs in NEEDS.items()
    )
    return f"""with texts as (select row_number() over () as key, doc_id, coalesce(text, '') as t from documents),
    parts as (select every.*, case kind {classes} end as class, len({blank}) as scope from ({every}) every join texts using (key)),
    found as (select * from parts where nth < 3 union all select * from parts a where nth >= 3 and ({tests}))
    select doc_id, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)},
        sha256({written(3, "s, nth")}) as base_sha256, {written(6, "s, nth")} as spans
    from texts left join found using (key) group by key, doc_id"""


SQL = {"op1_pii": digest(PII_KINDS, 4, "nth, s"), "op4_topk": TOPK, "op5_secrets": secrets_sql(), "op7_warc": WARC}
