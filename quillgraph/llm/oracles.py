"""DuckDB SQL of the queries that plain SQL can state; everything is written out over whole tables, without the operators' methods."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ARCHIVES = """
with p as (select page_id, coalesce(html, '') body from pages),
m as (select page_id, octet_length(encode(body)) n, sha1(body) digest, max(page_id) over (partition by body) last from p)
select page_id, n::bigint payload_bytes, digest payload_digest, case when n >= 1000 and page_id <> last then 'revisit' else 'response' end record_type,
  case when n >= 1000 and page_id <> last then last end refers_to
from m
"""

#: Sets of shingles, all pairs that share one, and the closure of the links; equal sets are one node.
JACCARD = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') w from documents
),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) end)) s from words
),
known as materialized (select doc_id, len(s)::bigint n, case when len(s) > 0 and doc_id is not null then min(doc_id) over (partition by s) end node, s from sets),
spelt as materialized (select doc_id node, n, unnest(s) token from known where doc_id = node),
common as (select a.node x, b.node y, any_value(a.n) n, any_value(b.n) m, count(*) c from (select distinct * from spelt) a join (select distinct * from spelt) b on a.token = b.token and a.node < b.node group by a.node, b.node),
links as materialized (select x, y from common where 100 * c >= 90 * (n + m - c) union all select y, x from common where 100 * c >= 90 * (n + m - c)),
reach as (select distinct x node, x seen from links union select reach.node, links.y from reach join links on links.x = reach.seen),
lowest as (select node, min(seen) component from reach group by node),
copies as (select node, count(*) copies from known where node is not null group by node),
near as (select x node, sum(copies) others from links join copies on y = copies.node group by x)
select doc_id, n n_shingles, coalesce(component, node, doc_id) component_id, coalesce(copies - 1, 0)::bigint + coalesce(others, 0)::bigint n_links
from known left join lowest using (node) left join copies using (node) left join near using (node)
"""

#: BM25 of every hundredth document over all; contributions are whole multiples of 2^-34, so copies tie.
SEARCH = """
with t as materialized (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') w from documents where doc_id is not null),
size_ as (select doc_id, sum(len(w))::double n from t group by 1),
stats as (select (select count(*) from t)::double n, greatest((select sum(len(w)) from t) / greatest((select count(*) from t), 1), 1e-9) mean),
tf as materialized (select doc_id, term, count(*)::double tf from (select doc_id, unnest(w) term from t) group by all),
df as (select term, count(*) df from tf group by 1),
q as (select doc_id query_id, tf.term, ln(1 + (stats.n - df + 0.5) / (df + 0.5)) weight from tf join df using (term), stats where doc_id % 100 = 0),
scored as (
  select query_id, tf.doc_id, sum(greatest(round(weight * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size_.n / mean))) * 17179869184), 1) / 17179869184) score
  from q join tf using (term) join size_ on size_.doc_id = tf.doc_id, stats group by all
)
select query_id, rank::int as rank, doc_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored) where rank <= 10
"""

FILL_IN_MIDDLE = """
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
c as (select *, length(t)::bigint n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form
  from c
),
o as (
  select *, case form when 'plain' then t
    when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    else '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end output
  from f
),
r as (
  select *, case form when 'plain' then output
    when 'psm' then substring(output, 4, strpos(output, '<S>') - 4) || substring(output, strpos(output, '<M>') + 3) || substring(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
    else substring(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3) || substring(output, strpos(output, '<M>') + 3) || substring(output, 4, strpos(output, '<P>') - 4) end restored
  from o
)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars, sha256(output) output_sha256, sha256(restored) restored_sha256 from r
"""


def _encoded(*columns: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')" for c in columns)


def _levels(name: str, first: str, depth: int) -> tuple[list[str], str]:
    """Tables of a forest's nodes by level, each node with the digests left (l) and right (r) of it; a lone node stays as it is, without them."""
    tables, source = [], first
    for k in range(depth):
        run = "(partition by grp, pos // 16 order by pos rows between"
        left, right = f"string_agg(d, '') over {run} unbounded preceding and 1 preceding)", f"string_agg(d, '') over {run} 1 following and unbounded following)"
        tables.append(f"{name}{k} as (select grp, pos, d, n, case when n > 1 then coalesce({left}, '') end l, case when n > 1 then coalesce({right}, '') end r from {source})")
        source = f"{name}{k}up"
        digest = "case when any_value(n) > 1 then sha256(string_agg(d, '' order by pos)) else any_value(d) end"
        tables.append(f"{source} as (select grp, pos // 16 pos, {digest} d, (any_value(n) + 15) // 16 n from {name}{k} group by grp, pos // 16)")
    return tables, source


def merkle(depth: int = 6, above: int = 4) -> str:
    """The manifest for up to 16^``depth`` rows a source and 16^``above`` sources: SQL needs the number of levels written out."""
    byte = "ascii(substr(doc_id::varchar, k, 1))::bigint"
    bits = "list_reduce([xor(acc, byte)] || range(8), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(1, length(doc_id::varchar)::bigint + 1), lambda k: {byte}), lambda acc, byte: {bits}))"
    changed = _encoded("doc_id", "source", "lang", "n_chars", f"translate(text, '{_UPPER}', '{_LOWER}')")
    own, top = _levels("a", "numbered", depth)
    upper, summit = _levels("b", "listed", above)
    steps = [(f"a{k}", f"placed.grp = a{k}.grp and placed.pos // {16**k} = a{k}.pos") for k in range(depth)]
    steps += [(f"b{k}", f"placed.place // {16**k} = b{k}.pos") for k in range(above)]
    siblings = " || ".join(f"coalesce({name}.l || {name}.r, '')" for name, _ in steps)
    sides = ", ".join(f"{name}.l l{k}, {name}.r r{k}" for k, (name, _) in enumerate(steps))
    tables = [
        f"hashed as (select doc_id, coalesce('=' || source, '') grp, sha256({_encoded('doc_id', 'source', 'lang', 'n_chars', 'text')}) leaf, case when doc_id is not null and {crc} % 5 = 0 then sha256({changed}) end claimed from documents)",
        "leaves as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by grp) n from hashed)",
        "numbered as (select grp, pos, leaf d, n from leaves)",
        *own,
        f"subroots as (select grp, d, row_number() over (order by grp) - 1 pos, count(*) over () n from {top})",
        "listed as (select '' grp, pos, d, n from subroots)",
        *upper,
        f"placed as (select leaves.*, subroots.d subroot, subroots.pos place, (select d from {summit}) root from leaves join subroots using (grp))",
        f"folded0 as (select doc_id, leaf, subroot, root, sha256({siblings}) proof_sha256, coalesce(claimed, leaf) folded, {sides} from placed {' '.join(f'join {name} on {on}' for name, on in steps)})",
        *(f"folded{k + 1} as (select * replace (case when l{k} is null then folded else sha256(l{k} || folded || r{k}) end as folded) from folded{k})" for k in range(len(steps))),
    ]
    return "with " + ",\n".join(tables) + f"\nselect doc_id, leaf, subroot, root, proof_sha256, folded folded_root, folded = root verified from folded{len(steps)}"
