r"""The queries in DuckDB's SQL, for those SQL can express."""

from __future__ import annotations

from ..operators.flatten import Level
from .found import JSON_LEVELS, REFERENCES
from .projection import COLUMNS, KINDS

_W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _first(table: str) -> str:
    return f"(select * exclude (_r) from (select *, row_number() over (partition by coalesce(id, 'seq' || seq) order by seq) _r from {table}) where _r = 1)"


def _norm(x: str) -> str:
    return f"coalesce(regexp_replace({_strip(x)}, '^[^:]*:', ''), '')"


def _blank(x: str) -> str:
    return f"coalesce({_strip(x)} = '', true)"


_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"
_TRACKING = "['fbclid','gclid','gclsrc','dclid','msclkid','mc_eid','mc_cid','igshid','_ga']"


def canonical(source: str, column: str, keep: str) -> str:
    """A query that gives ``keep`` and the canonical form ``url`` of a column of URLs with a host."""
    decode = "url_decode(replace({0}, '+', ' '))"
    encode = "replace(url_encode({0}), '%20', '+')"
    pair = "{{'k': {}, 'v': {}}}".format(decode.format("split_part(p, '=', 1)"), decode.format("case when instr(p, '=') > 0 then substr(p, instr(p, '=') + 1) else '' end"))
    return f"""select {keep}, 'https://' || host || case when coalesce(try_cast(port as int), 0) > 0 then ':' || cast(port as int) else '' end
        || case when regexp_replace(path, '/+$', '') = '' then '/' else regexp_replace(path, '/+$', '') end
        || case when len(pairs) > 0 then '?' || array_to_string(list_transform(list_sort(pairs), lambda p: {encode.format("p.k")} || '=' || {encode.format("p.v")}), '&') else '' end as url
      from (select {keep}, path, lower(split_part(net, ':', 1)) as host, split_part(net, ':', 2) as port,
          list_filter(list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: {pair}),
            lambda p: not list_contains({_TRACKING}, lower(p.k)) and not starts_with(lower(p.k), 'utm_')) as pairs
        from (select {keep}, regexp_extract(regexp_extract(u, '{_PARTS}', 1), '^(?:[\\s\\S]*@)?([\\s\\S]*)$', 1) as net, regexp_extract(u, '{_PARTS}', 2) as path, regexp_extract(u, '{_PARTS}', 3) as query
          from (select {keep}, regexp_replace({_strip(column)}, '[\\t\\r\\n]', '', 'g') as u from {source} where not {_blank(column)})))"""


def _references() -> str:
    rows = " union all ".join(f"select '{t}' tabla, '{c}' campo, seq, coalesce(substr(ts, 1, 7), '') periodo, '{to}' destino, {c} id from {t} where {c} is not null and {c} <> ''" for t, c, to in REFERENCES)
    there = " union all ".join(f"select '{to}' destino, id, min(seq) alta from {to} where id is not null group by id" for _, _, to in REFERENCES)
    return f"""select tabla, campo, seq, periodo, clase, id from (select r.*, case when b.id is not null then 'baja' when s.id is null then 'ausente' when s.alta > r.seq then 'tardia' end clase
      from ({rows}) r left join (select distinct tabla destino, id from baja) b using (destino, id) left join ({there}) s using (destino, id)) where clase is not null"""


def _groups() -> str:
    sides = "referente_assert"
    a = canonical(f"(select * from {sides} where not {_blank('referente_b')})", "referente_a", "seq")
    b = canonical(f"(select * from {sides} where not {_blank('referente_a')})", "referente_b", "seq")
    relation = f"lower({_strip('relacion')})"
    return f"""with recursive v as (select least(x.url, y.url) a, greatest(x.url, y.url) b, x.seq, r.relacion from ({a}) x join ({b}) y using (seq)
        join (select seq, {relation} relacion from referente_assert) r using (seq) where r.relacion in ('mirror', 'espejo', 'split', 'separado') and x.url <> y.url),
      l as (select a, b from v group by a, b having arg_max(relacion, seq) in ('mirror', 'espejo')),
      e as (select a, b from l union all select b, a from l),
      c(n, m) as (select a, a from e union select c.n, e.b from c join e on c.m = e.a)
      select min(m) as grupo, n as referente from c group by n"""


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '{_W}+'), lambda w: w <> ''))"


def _iso(x: str) -> str:
    """Is a text one that Python's two ISO readers take?"""
    time = r"[01]\d|2[0-3]"
    part = r"(?:[0-5]\d)"
    clock = rf"(?:{time})(?::{part}(?::{part}(?:[.,]\d+)?)?|{part}(?:{part}(?:[.,]\d+)?)?)?"
    zone = rf"(?:Z|[+-](?:{time})(?::?{part}(?::?{part}(?:[.,]\d+)?)?)?)?"
    rest = rf"(?:[\s\S]{clock}{zone})?$"
    t = _strip(x)
    loose = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})T(?:{time}|\d):(?:[0-5]?\d):(?:[0-5]?\d)$"
    day = "try_cast({0} || '-' || lpad({1}, 2, '0') || '-' || lpad({2}, 2, '0') as date) is not null"
    by_day = rf"^(\d{{4}})(?:-(\d\d)-(\d\d)|(\d\d)(\d\d)){rest}"
    by_week = rf"^(\d{{4}})(?:-W(\d\d)(?:-[1-7])?|W(\d\d)[1-7]?){rest}"

    def group(pattern: str, k: int) -> str:
        return f"regexp_extract({t}, '{pattern}', {k})"

    weeks = f"case when isodow(try_cast({group(by_week, 1)} || '-12-31' as date)) = 4 or isodow(try_cast({group(by_week, 1)} || '-01-01' as date)) = 4 then 53 else 52 end"
    return f"""coalesce((regexp_matches({t}, '{loose}') and {day.format(group(loose, 1), group(loose, 2), group(loose, 3))})
      or (regexp_matches({t}, '{by_day}') and {day.format(group(by_day, 1), f"({group(by_day, 2)} || {group(by_day, 4)})", f"({group(by_day, 3)} || {group(by_day, 5)})")})
      or (regexp_matches({t}, '{by_week}') and try_cast({group(by_week, 2)} || {group(by_week, 3)} as int) between 1 and {weeks}), false)"""


def _hollow(x: str) -> str:
    """Is a JSON value one that Python takes for false?"""
    return f"""case json_type({x}) when 'ARRAY' then json_array_length({x}) = 0 when 'OBJECT' then len(json_keys({x})) = 0 when 'NULL' then true when 'VARCHAR' then json_extract_string({x}, '$') = ''
      when 'BOOLEAN' then cast({x} as varchar) = 'false' else try_cast(cast({x} as varchar) as double) = 0 end"""


def _elements(x: str) -> str:
    """The list a JSON value stands for where an array is expected."""
    inner = f"json_extract_string({x}, '$')"
    boxed = rf"json_type({x}) = 'VARCHAR' and regexp_matches({inner}, '^[ \t\n\r]*[\[{{]') and json_valid({inner})"
    return f"""case when {x} is null then null when json_type({x}) = 'ARRAY' then json_extract({x}, '$[*]') when {boxed} and json_type({inner}) = 'ARRAY' then json_extract(cast({inner} as json), '$[*]')
      when {boxed} then [cast({inner} as json)] else [cast({x} as json)] end"""


def _flat(table: str, column: str, level: Level) -> str:
    """Rows of one JSON column, level by level."""
    parts, ctes, todo = [], [f"t0 as (select seq, '' ruta, cast({column} as json) x from {table} where json_valid({column}))"], [("t0", level)]
    while todo:
        above, lv = todo.pop()
        name = f"e{len(ctes)}"
        ctes.append(f"""{name} as (select seq, ruta || i as ruta, x from (select seq, ruta, unnest(l) x, generate_subscripts(l, 1) - 1 i from (select seq, ruta, {_elements("x")} l from {above})) where json_type(x) <> 'NULL')""")
        value = "json_extract_string(x, '$')" if lv.valor is None else f"case json_type(x) when 'OBJECT' then coalesce(json_extract_string(x, '$.{lv.valor}'), '') when 'ARRAY' then '' else json_extract_string(x, '$') end"
        parts.append(f"select '{lv.tipo}' tipo, seq, ruta, {value} valor from {name}")
        for member, below in lv.below.items():
            inside = f"m{len(ctes)}"
            ctes.append(f"{inside} as (select seq, ruta || '.' as ruta, json_extract(x, '$.{member}') x from {name} where json_type(x) = 'OBJECT')")
            todo.append((inside, below))
    return f"(with {', '.join(ctes)} {' union all '.join(parts)})"


# Documents of the table grano: what stands in consultas, whether its tree is one of a document, and the events it gives.
def _grains(lint: bool = False) -> str:
    """CTEs k (seq, sid, mala), q (seq, i, f) and r (seq, i, j, ...) of every document; a reference needs a URL or a referent unless only linted."""
    named = "false" if lint else "coalesce(r ->> 'referente_id', '') = '' and r ->> 'url' is null"
    return f"""g as (select seq, coalesce(session_id, '') sid, schema_version, ts, coalesce(nullif(consultas, ''), '[]') t from grano),
      j as (select *, case when json_valid(t) then cast(t as json) end x from g),
      qq as (select seq, unnest(json_extract(x, '$[*]')) q, generate_subscripts(json_extract(x, '$[*]'), 1) i from j where json_type(x) = 'ARRAY'),
      rl as (select seq, i, q, q -> 'referencias' l from qq where json_type(q) = 'OBJECT'),
      rr as (select seq, i, unnest(json_extract(l, '$[*]')) r, generate_subscripts(json_extract(l, '$[*]'), 1) k from rl where json_type(l) = 'ARRAY'),
      malas as (select seq from j where x is null or (json_type(x) <> 'ARRAY' and not {_hollow("x")}) union select seq from qq where json_type(q) <> 'OBJECT'
        union select seq from rl where l is not null and json_type(l) <> 'ARRAY' and not {_hollow("l")} union select seq from rr where json_type(r) <> 'OBJECT' or ({named})),
      k as (select *, seq in (select seq from malas) mala from g),
      q as (select seq, i, q ->> 'formulacion' f from rl), r as (select seq, i, k, r ->> 'url' url, r ->> 'referente_id' referente, r ->> 'content_hash' h, r ->> 'capture_ts' c from rr)"""


def _grain_events(fields: bool = False) -> str:
    nec = "sha256(concat_ws(chr(31), sid, 'nec', '', ''))"
    query = f"sha256(concat_ws(chr(31), sid, 'consulta', {nec}, coalesce(f, '')))"
    referent = "coalesce(nullif(referente, ''), u.url, 'https:/')"
    urls = canonical("(select seq, i, k, url from r)", "url", "seq, i, k")
    return f"""with {_grains()}, u as ({urls}),
      e as (select seq, 0 i, 0 k, 'necesidad' ev, {nec} id, null nec_id, null formulacion, null referente_id, null content_hash, null q_id from k where not mala
        union all select seq, i, 0, 'consulta', {query}, {nec}, f, null, null, null from q join k using (seq) where not mala
        union all select seq, i, r.k, 'referencia', sha256(concat_ws(chr(31), 'ref', {referent}, {_norm("h")}, coalesce(c, ''))), null, null, {referent}, {_norm("h")}, {query}
          from r join k using (seq) join q using (seq, i) left join u using (seq, i, k) where not mala)
      select seq, cast(row_number() over (partition by seq order by i, k) - 1 as int) pos, id, ev{", nec_id, formulacion, referente_id, content_hash, q_id" if fields else ""} from e"""


def _grain_lint() -> str:
    hashes = f"select content_hash from {_SNAPSHOTS}"
    return f"""with {_grains(lint=True)}, f as (select seq, 'YAML' regla from k where mala union all select seq, 'C1' from k where not mala and coalesce(schema_version, '') <> 'aec-1'
        union all select seq, 'C6' from k, (values (1), (2)) twice where not mala
        union all select seq, 'C3' from r join k using (seq) where not mala and {_norm("h")} not in ({hashes})
        union all select seq, 'C5' from r join k using (seq) where not mala and not {_iso("c")})
      select seq, regla, count(*) n from f group by all"""


def _claim_lint() -> str:
    def lacks(x: str) -> str:
        return f"({x} is null or {x} = '' or coalesce({_hollow(f"try_cast({x} as json)")}, false))"

    return f"""with c as (select a.id, nullif(a.ref_id, '') ref_id, nullif(a.insc_id, '') insc_id, i.id insc, premisa, busqueda, resultados_crudos, v.id ref, v.content_hash, v.capture_ts, n.pregunta, n.gatillo
        from {_first("afirmacion")} a left join {_first("inscripcion")} i on nullif(a.insc_id, '') = i.id left join {_first("version")} v on nullif(a.ref_id, '') = v.id
        left join {_first("consulta")} q on v.q_id = q.id left join {_first("necesidad")} n on q.nec_id = n.id where a.id is not null),
      f as (select id, 'C2' regla from c where insc is not null and ({_blank("premisa")} or {lacks("busqueda")} or {lacks("resultados_crudos")})
        union all select id, 'C3' from c where ref is not null and {_norm("content_hash")} not in (select content_hash from {_SNAPSHOTS})
        union all select id, 'C5' from c where ref is not null and not {_iso("capture_ts")}
        union all select id, 'C6' from c where not coalesce(starts_with(gatillo, 'explicito:') or starts_with(gatillo, 'implicito-de:'), false)
        union all select id, 'C6' from c where {_blank("pregunta")}
        union all select id, 'C4' from c where ref_id is null or insc_id is null
        union all select id, 'C4' from c where ref_id is not null and insc_id is not null and ref is null
        union all select id, 'C4' from c where ref_id is not null and insc_id is not null and insc is null)
      select id, regla, count(*) n from f group by all"""


_SNAPSHOTS = "(select distinct content_hash from version where equipo in ('nube-a', 'mx-nodo-1') and content_hash is not null)"
_STATE = "(select q_id, count(*) total, count(u.id) presentes from version v left join (select distinct ref_id id from afirmacion where ref_id is not null) u using (id) group by q_id)"
_STATES = f"(select q_id, total, presentes, case when presentes = 0 then 'NO-CONSUMIDO' when presentes = total then 'CONSUMIDO' else 'PARCIAL' end estado from {_STATE})"
_PREFLIGHT = f"""(select id, load_bearing, estado, case when estado in ('OK', 'YA') then null when load_bearing then 'BLOQUEANTE' else 'AVISO' end severidad from
  (select v.id, u.id is not null load_bearing, case when content_hash is not null and content_hash not in ('MATERIALIZAR', '') then 'YA' when left(v.id, 1) in ('0', '1', '2', '3') then 'DNS'
     when left(v.id, 1) in ('4', '5') then 'TIMEOUT' when left(v.id, 1) in ('6', '7') then 'HTTP' else 'OK' end estado
   from {_first("version")} v left join (select distinct ref_id id from afirmacion where ref_id is not null and ref_id <> '') u on u.id = v.id))"""


_OUTCOMES = f"""(select id, u.id is not null load_bearing, estado, case estado when 'ya' then content_hash when 'materializada' then sha256(url_cruda) end content_hash,
    case estado when 'materializada' then '2026-01-01T00:00:00' end capture_ts, case estado when 'materializada' then strlen(url_cruda) end bytes,
    case when estado = 'fallida' then case when coalesce(url_cruda, '') = '' then 'OSError: no URL' else 'OSError: down' end end error from
  (select *, case when content_hash is not null and content_hash not in ('MATERIALIZAR', '') then 'ya' when coalesce(url_cruda, '') = '' or left(sha256(url_cruda), 1) in ('0', '1', '2', '3') then 'fallida' else 'materializada' end estado
    from {_first("version")}) v left join (select distinct ref_id id from afirmacion where ref_id is not null and ref_id <> '') u using (id))"""


def _dumped(table: str, source: str, but: tuple[str, ...] = ()) -> str:
    fields = ", ".join(f"'{c}': coalesce({c}, chr(0))" for c in sorted(COLUMNS[table]) if c not in but)
    return f"select '{table}' tabla, cast(to_json({{{fields}}}) as varchar) fila from {source}"


_CAPTURES = "(select referente_id, case when arg_min_null(capture_ts, seq) is not null then min(capture_ts) end primera_captura from version group by referente_id)"
_LOG_IDS = " union all ".join(f"select id from {t} where id is not null" for t, _, _ in KINDS.values())
_LINE = """'{"ev": "consulta", "formulacion": ' || coalesce(cast(to_json(formulacion) as varchar), 'null') || ', "id": ' || coalesce(cast(to_json(id) as varchar), 'null') || ', "nec_id": ' || coalesce(cast(to_json(nec_id) as varchar), 'null') || ', "ts": ' || coalesce(cast(to_json(ts) as varchar), 'null') || '}'"""

ORACLES = {
    "p2_found": _groups(),
    "p5_found": f"select tabla, campo, seq, periodo, clase from ({_references()})",
    "p5_report": f"select tabla, campo, periodo, clase, count(*) filas, count(distinct id) ids from ({_references()}) group by all",
    "current_version": f"select referente_id, id, content_hash, capture_ts from (select *, row_number() over (partition by referente_id order by capture_ts desc nulls last, id desc nulls last) _n from {_first('version')}) where _n = 1",
    "first_write_wins": f"select id, seq, referente_id, content_hash, capture_ts, q_id from {_first('version')}",
    "first_capture": "select referente_id, case when arg_min_null(capture_ts, seq) is not null then min(capture_ts) end primera_captura from version group by referente_id",
    "orphans": f"select id, txt from {_first('afirmacion')} where ref_id is null or insc_id is null",
    "unsafe_claims": f"select a.id aid from {_first('afirmacion')} a join {_first('version')} v on a.ref_id = v.id where a.estatus = 'afirmado' and (v.content_hash is null or (v.content_hash <> '' and v.content_hash not in (select content_hash from {_SNAPSHOTS})))",
    "trace_up": f"""select a.id, a.txt afirmacion, i.conclusion, case when i.id is not null then coalesce(i.inferidor_model, 'None') || '@' || coalesce(i.inferidor_ts, 'None') end inferida_por, left(i.huella, 12) huella,
      v.referente_id, v.content_hash, v.url_cruda, v.capture_ts, q.formulacion consulta, n.pregunta, n.gatillo, n.origen_nodo ancla
      from {_first("afirmacion")} a left join {_first("inscripcion")} i on nullif(a.insc_id, '') = i.id left join {_first("version")} v on nullif(a.ref_id, '') = v.id
      left join {_first("consulta")} q on v.q_id = q.id left join {_first("necesidad")} n on q.nec_id = n.id""",
    "pinned_versions": f"select v.id ref_id, a.id aid, v.content_hash, v.capture_ts from {_first('afirmacion')} a join {_first('version')} v on a.ref_id = v.id",
    "load_bearing": f"select id, referente_id, id in (select ref_id from afirmacion where ref_id is not null and ref_id <> '') load_bearing from {_first('version')} where id is not null",
    "missing_events": "select insc_id id, seq from afirmacion where insc_id is not null and insc_id not in (select id from inscripcion where id is not null)",
    "consumption_state": f"select * from {_STATES}",
    "consumption_gate": f"select count(*) filter (where estado = 'CONSUMIDO') consumidos, count(*) filter (where estado <> 'CONSUMIDO') pendientes, coalesce(bool_and(estado = 'CONSUMIDO'), true) todos from {_STATES}",
    "divergence": f"""select seq, left(huella, 12) huella, len(list_intersect(x, y)) comunes, len(list_distinct(list_concat(x, y))) todas from
      (select r.seq, r.huella, {_words("f.base")} x, {_words("r.conclusion")} y from inscripcion r join
        (select huella, arg_min_null(conclusion, seq) base, min(seq) primera from inscripcion where huella is not null group by huella) f using (huella)
       where r.seq > f.primera and f.base is not null and r.conclusion is not null)""",
    # Shares that are whole sixteenths are the ones that lie halfway between two of three digits exactly.
    "divergence_rounded": """select seq, huella, case when (s * 16) % 1 = 0 then round_even(s, 3) else round(s, 3) end similitud, case when (s * 16) % 1 = 0 then round_even(1 - s, 3) else round(1 - s, 3) end divergencia
      from (select seq, huella, case when todas = 0 then 1.0::double else comunes / todas end s from (DIVERGENCE))""",
    "preflight": f"select id, load_bearing, estado, severidad from {_PREFLIGHT}",
    "preflight_counts": f"select count(*) filter (where severidad = 'BLOQUEANTE') bloqueantes, count(*) filter (where severidad = 'AVISO') avisos, count(*) filter (where estado = 'OK') ok, count(*) filter (where estado = 'YA') ya from {_PREFLIGHT}",
    "snapshot_dedup": "select distinct sha256(text) content_hash from documents where text is not null",
    "export_lines": f"select sha256({_LINE}) line_sha, {_LINE} event from consulta",
    "export_upsert": f"select distinct sha256({_LINE}) line_sha from consulta where sha256({_LINE}) not in (select sha256({_LINE}) from consulta where ts < '2024')",
    "lint_inferences": f"select seq, {_blank('premisa')} sin_premisa from inscripcion",
    "lint_triplets": f"""select seq, not {_blank("premisa")} and coalesce(case when json_valid(busqueda) then json_array_length(busqueda) > 0 end, false)
      and coalesce(case when json_valid(resultados_crudos) then json_array_length(resultados_crudos) > 0 end, false) completa, coalesce(inferidor_model, 'None') || '@' || coalesce(inferidor_ts, 'None') firma from inscripcion""",
    "lint_needs": f"select seq, coalesce(starts_with(gatillo, 'explicito:') or starts_with(gatillo, 'implicito-de:'), false) gatillo_ok, {_blank('pregunta')} sin_pregunta from necesidad",
    "lint_versions": f"select seq, {_norm('content_hash')} hash, content_hash is null or content_hash in ('MATERIALIZAR', '') pendiente from version",
    "lint_schema": "select seq, coalesce(schema_version = 'aec-1', false) version_ok, coalesce(session_id, '') session_id from grano",
    "canonical_urls": canonical("version", "url_cruda", "seq"),
    "det_ids": f"select seq, sha256(concat_ws(chr(31), 'ref', coalesce(referente_id, ''), {_norm('content_hash')}, coalesce(capture_ts, ''))) det_id from version",
    "content_hashes": "select doc_id, sha256(text) content_hash from documents",
    "assert_bag": "select id, referente_a, referente_b, relacion, gatillo, ts from referente_assert",
    "log_counts": " union all ".join(f"select '{t}' tabla, count(*) filas, count(distinct id) ids from {t}" for t in ("version", "inscripcion", "necesidad", "consulta", "afirmacion", "referente_assert")),
    "p4_found": " union all ".join(f"select * from {_flat(t, c, level)}" for t, c, level in JSON_LEVELS),
    "lint_times": f"select seq, {_iso('capture_ts')} iso_ok from version",
    "log_scan": " union all ".join(f"select '{k}' ev, count(*) lineas, count(distinct id) ids from {t}" for k, (t, _, _) in KINDS.items()),
    "rebuild_dump": " union all ".join(_dumped(t, {"referente": _CAPTURES, "referente_assert": t}.get(t) or _first(t), ("busqueda", "resultados_crudos")) for t in COLUMNS),
    "grain_events": _grain_events(),
    "grain_lint": _grain_lint(),
    "claim_lint": _claim_lint(),
    "grain_states": f"""with e as ({_grain_events()}), d as (select seq, seq in (select seq from e) any_event, coalesce(session_id, '') session_id, ts from grano),
        there as (select distinct id from e join d using (seq) where ts < '2024'),
        n as (select seq, count(*) total, count(there.id) presentes from e left join there using (id) group by seq)
      select seq, case when any_event then session_id else '' end session_id, case when not any_event then 'ERROR' when presentes = 0 then 'NO-CONSUMIDO' when presentes = total then 'CONSUMIDO' else 'PARCIAL' end estado, coalesce(total, 0) total, coalesce(presentes, 0) presentes from d left join n using (seq)""",
    "grain_ingest": f"""with e as ({_grain_events()}), there as (select id from e join grano using (seq) where ts < '2024')
      select id, arg_min(ev, [seq, pos]) ev, min([seq, pos])[1] seq, cast(min([seq, pos])[2] as int) pos from e where id not in (select id from there) group by id""",
    "materialize_outcomes": f"select * from {_OUTCOMES}",
    "materialize_counts": f"select estado, load_bearing, count(*) n, sum(bytes)::bigint bytes from {_OUTCOMES} group by all",
    "reinferred": f"""select seq, huella, premisa conclusion, 'model-b@2026-01-01T00:00:00' firma, len(list_intersect({_words("conclusion")}, {_words("premisa")})) comunes,
      len(list_distinct(list_concat({_words("conclusion")}, {_words("premisa")}))) todas from inscripcion""",
    "snapshot_store": "select sha256(text) content_hash, strlen(any_value(text)) bytes, not bool_or(coalesce(lang = 'es', false)) nueva from documents where text is not null group by sha256(text)",
    "store_ingest": f"""select id, ev, '2026-01-01T00:00:00' ts, nec_id, formulacion, referente_id, content_hash, q_id from ({_grain_events(True)}) qualify row_number() over (partition by id order by seq, pos) = 1""",
    "dump_tables": """select 'equipo' tabla, cast(to_json({'equipo': equipo, 'orden_fecha': orden_fecha, 'zona': zona}) as varchar) fila from equipo
      union all select 'envase', cast(to_json({'capacidad': cast(capacidad as varchar), 'envase': envase}) as varchar) from envase
      union all select 'mezcla', cast(to_json({'max_rep': cast(max_rep as varchar), 'peso': cast(peso as varchar), 'source': source}) as varchar) from mezcla""",
    "dump_projection": " union all ".join(_dumped(t, {"referente": _CAPTURES, "referente_assert": t}.get(t) or _first(t)) for t in COLUMNS),
    "missing_log_events": f"select * from ({' union all '.join(f"select '{t}' tabla, '{c}' campo, {c} id, seq from {t} where {c} is not null" for t, c, _ in REFERENCES)}) where id not in ({_LOG_IDS})",
}
ORACLES["divergence_rounded"] = ORACLES["divergence_rounded"].replace("DIVERGENCE", ORACLES["divergence"])
