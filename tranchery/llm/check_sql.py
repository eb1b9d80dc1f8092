"""Check queries in the SQL of another engine, for the operators that SQL can express."""

from __future__ import annotations

from tranchery.llm import weak_quality as W
from tranchery.llm.line_dedup import MIN_CHARS, TAU

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def lowered(t: str) -> str:
    return f"translate({t}, '{UPPER}', '{LOWER}')"


OP2 = f"""with recursive w as (select doc_id, {_WORDS.format(t=lowered("coalesce(text, '')"))} w from documents),
s as (select distinct doc_id, case when len(w) >= 5 then unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) else array_to_string(w, ' ') end g from w where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r(v, c) as (select doc_id, doc_id from documents union select e.y, r.c from r join e on e.x = r.v where r.c < e.y),
select d.doc_id, coalesce(n.n, 0) n_shingles, (select min(c) from r where r.v = d.doc_id) component_id from documents d left join n using (doc_id)"""

OP4 = f"""with raw as (select doc_id, text, unnest(range(len(string_split(text, chr(10))))) place, unnest(string_split(text, chr(10))) rawline from documents),
l as (select doc_id, place, rawline, trim(rawline, {_SPACE}) line from raw),
e as (select * from l where length(line) >= {MIN_CHARS}),
f as (select line, min((doc_id, place)) fa, length(line) n from e group by line),
near as (select distinct case when a.fa < b.fa then b.line else a.line end line, true hit from f a join f b on a.line < b.line and b.n between a.n - {TAU} and a.n + {TAU} and levenshtein(a.line, b.line) <= {TAU}),
g as (select l.doc_id, l.place, l.rawline, f.line is not null and near.hit is null and (l.doc_id, l.place) <> f.fa exact, near.hit is not null near
  from l left join f on f.line = l.line and length(l.line) >= {MIN_CHARS} left join near on near.line = f.line),
d as (select doc_id, count(*) n_lines, count(*) filter (exact) n_exact, count(*) filter (near) n_near, coalesce(string_agg(rawline, chr(10) order by place) filter (not exact and not near), '') t from g group by 1)
select documents.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_exact, 0) n_exact, coalesce(n_near, 0) n_near, length(coalesce(t, text)) n_chars_left, sha256(coalesce(t, text)) text_sha256 from documents left join d using (doc_id)"""

_ITEM_WORDS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""with b as (select item_id, {_ITEM_WORDS.format(t=lowered("text"))} w from benchmark where text is not null and item_id is not null),
i as (select distinct item_id, least(len(w), 10) m, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda k: array_to_string(w[k:k + 9], ' '))) g from b where len(w) > 0),
d as (select doc_id, {_ITEM_WORDS.format(t=lowered("coalesce(text, '')"))} w from documents),
ms as (select distinct m from i),
g as (select doc_id, m, unnest(range(1, len(w) - m + 2)) k, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) g from d, ms where len(w) >= m),
h as (select g.doc_id, g.k, g.m, i.item_id from g join i on g.m = i.m and g.g = i.g),
c as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(k, k + m)) pos from h) group by 1),
s as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, cast(item_id as varchar) item_id from h) group by 1)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join c using (doc_id) left join s using (doc_id)"""


def _op8() -> str:
    names = ", ".join(f"v_{n}" for n in W.RULES)
    gone = lambda cls: f"length(t) - length(regexp_replace(t, '{cls}', '', 'g'))"
    parts = [
        f"d as (select doc_id, coalesce(text, '') t, {_WORDS.format(t="coalesce(text, '')")} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACE}) <> '') l from documents)",
        "win as (select doc_id, unnest(range(1, len(w) - 6)) k, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) g from d where len(w) >= 8)",
        "rep as (select doc_id, count(distinct pos) r from (select doc_id, unnest(range(k, k + 8)) pos from (select *, count(*) over (partition by doc_id, g) c from win) where c > 1) group by 1)",
        f"cnt as (select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, {gone('[#*$%&|<>]')} n_symbols, len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(r, 0) n_repeat_words, {gone('[A-Z]')} n_capitals, {gone('[!-/:-@{-~]')} n_marks, {gone('!')} n_shouts, {gone('[.?]')} n_stops from d left join rep using (doc_id))",
        f"v as (select *, {', '.join(f'{r} v_{n}' for n, r in W.RULES.items())} from cnt)",
        f"pat as (select {names}, cast(count(*) as double) n from v group by {names})",
        "m0 as (select " + ", ".join(f"{x!r}::double {k}" for k, x in W.START.items()) + ")",
    ]
    post = W.posterior("p", [f"a_{n}" for n in W.RULES], [f"b_{n}" for n in W.RULES])
    for i in range(W.ITERATIONS):
        parts.append(f"m{i + 1} as materialized (select {', '.join(W.updates())} from (select pat.*, {post} q from pat, m{i}))")
    failed = "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)"
    return "with " + ",\n".join(parts) + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} base_failed, not {failed} and {post} >= {W.THRESHOLD} kept from v, m{W.ITERATIONS}"


def _op12(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Doubles hold these whole numbers exactly, as all stay below 2**53."""
    dist = "list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q)"
    parts = [
        f"v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})",
        f"c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), q) - 1 c, q from v where vec_id is not null order by 1 limit {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select r, any_value(vec_id) vec_id, any_value(vq) q, arg_min(c, (d, c)) c, min(d) d from (select v.r, v.vec_id, v.q vq, c.c, {dist} d from v, c{i} c) group by r)")
        if i < rounds:
            parts.append(f"m{i} as (select c, list(s order by k) q from (select c, k, floor(sum(x) / count(*)) s from (select c, unnest(q) x, unnest(range({dims})) k from a{i}) group by c, k) group by c)")
            parts.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(m{i}.q, c{i}.q) q from c{i} left join m{i} using (c))")
    digest = "sha256(array_to_string(list_transform(f.q, lambda x: x::bigint::varchar), ','))"
    return "with " + ",\n".join(parts) + f"\nselect a.vec_id, a.c::int cluster, a.d::bigint distance, (sum(a.d) over (partition by a.c))::bigint cluster_inertia, (sum(a.d) over ())::bigint inertia, {digest} centroid_sha256 from a{rounds} a join c{rounds} f using (c)"


def _op13(levels: int = 7) -> str:
    """Trees of up to 8**levels leaves.  CRC-32 by its shifts: a byte is met by exclusive or, then eight shifts follow."""
    code = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(code(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: list_concat([ascii(x)::bigint], list_transform(range(8), lambda i: -1::bigint))))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda c, s: case when s >= 0 then xor(c, s) when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end), 4294967295::bigint)"
    parts = [
        f"d as materialized (select row_number() over () r, doc_id, lang, {leaf('text')} leaf, case when {crc} % 3 = 0 then {leaf(lowered('text'))} end bad from documents)",
        "p as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i from d)",
        "l0 as (select lang t, i, leaf x from p)",
    ]
    runs = []
    for tree in ("l", "g"):
        if tree == "g":
            tops = " union all ".join(f"select t, x from l{k} where (select count(*) from l{k} o where o.t is not distinct from l{k}.t) = 1" for k in range(levels + 1))
            parts.append(f"s as materialized (select t, x, row_number() over (order by t nulls first) - 1 i from (select t, any_value(x) x from ({tops}) group by t))")
            parts.append("g0 as (select null::varchar t, i, x from s)")
        for k in range(levels):
            many = f"(select t from {tree}{k} group by t having count(*) > 1)"
            parts.append(f"{tree}r{k} as materialized (select t, i // 8 j, list(x order by i) xs from {tree}{k} where exists (select 1 from {many} m where m.t is not distinct from {tree}{k}.t) group by 1, 2)")
            parts.append(f"{tree}{k + 1} as materialized (select t, j i, sha256(array_to_string(xs, '')) x from {tree}r{k})")
            runs.append((tree, k))
    parts.append(f"root as (select x from (select x, 0 k from g0 where (select count(*) from g0) = 1 {''.join(f' union all select x, {k} from g{k} where (select count(*) from g{k}) = 1' for k in range(1, levels + 1))}) order by k limit 1)")
    parts.append("f0 as (select p.r, p.doc_id, p.leaf, s.x subroot, p.lang t, p.i, s.i gi, '' pr, coalesce(p.bad, p.leaf) f from p join s on s.t is not distinct from p.lang)")
    for n, (tree, k) in enumerate(runs):
        at, on = ("i", "q.t is not distinct from f.t") if tree == "l" else ("gi", "true")
        mine = f"(f.{at} // {8**k})"
        side = lambda a, b: f"array_to_string(q.xs[{a}:{b}], '')"
        before, after = side("1", f"{mine} % 8"), side(f"{mine} % 8 + 2", "8")
        parts.append(f"f{n + 1} as materialized (select r, doc_id, leaf, subroot, f.t, f.i, gi, case when q.xs is null then pr else pr || {before} || {after} end pr, case when q.xs is null then f else sha256({before} || f || {after}) end f from f{n} f left join {tree}r{k} q on {on} and q.j = {mine} // 8)")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, root.x root, sha256(pr) proof_sha256, f folded_root, f = root.x verified from f{len(runs)}, root"


SQL = {"op12_zone_clusters": _op12(), "op13_merkle_manifest": _op13(), "op2_jaccard_join": OP2, "op4_line_dedup": OP4, "op8_quality_rules": _op8(), "op10_decontamination": OP10}
