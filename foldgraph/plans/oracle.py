"""The registered queries restated in DuckDB SQL over the supplied tables."""

from __future__ import annotations

from foldgraph.functions.vectors import NORM_FLOOR
from foldgraph.spec import EncoderShape, GraphSpec

SHARD_RECORDS, SHARD_NODES = 64, 20_000
BATCH_NODES, BATCH_EDGES = 6_000, 30_000
SMALL = EncoderShape(hidden=4, layers=1, out_dim=4, spec=GraphSpec(positional=False))

RNA = """
letters as (select doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') as letters from documents),
cuts as (select doc_id, letters, unnest(range(0, (length(letters) - 1) // 400 + 1)) as piece from letters where length(letters) >= 1),
bits as (select doc_id, piece, substr(letters, 400 * piece + 1, 400) as bit from cuts),
sized as (
  select doc_id, piece, length(bit) as n, 4 + (doc_id + piece) % 5 as stem, doc_id % 3 as helix,
    case when length(bit) >= 60 then 3 else 0 end as closing,
    translate(lower(bit), 'abcdefghijklmnopqrstuvwxyz', 'ACGUACGUACGUACGUACGUACGUAC') as sequence
  from bits),
units as (
  select *, repeat('(', helix) || '.' || repeat('(', stem) || '....' || repeat(')', stem)
    || repeat('(', stem) || '....' || repeat(')', stem) || repeat(')', helix) || '...' as unit from sized),
rna as (
  select doc_id, piece, n, doc_id * 65536 + piece as row_ord, 'rna-' || doc_id || '-' || piece as transcript_id, sequence,
    repeat('(', closing) || rpad(repeat(unit, (n - 2 * closing) // (2 * helix + 4 * stem + 12)), cast(n - 2 * closing as integer), '.')
    || repeat(')', closing) as structure
  from units),
rec as (select transcript_id as graph_id, sequence, structure, row_ord, row_ord * 16777216 as record_ord, n, doc_id, piece from rna)
"""

NUC = """,
spots as (select graph_id, n, sequence, structure, unnest(range(0, n)) as pos from rec),
nuc as (select graph_id, n, pos, substr(sequence, pos + 1, 1) as base, substr(structure, pos + 1, 1) as state from spots)
"""

PAIRS = NUC + """,
dep as (
  select *, sum(case state when '(' then 1 when ')' then -1 else 0 end)
    over (partition by graph_id order by pos rows unbounded preceding) as depth from nuc),
lev as (select *, case state when '(' then depth when ')' then depth + 1 else 0 end as level from dep),
par as (
  select graph_id, n, pos, base, state, depth,
    case state when '(' then lead(pos) over w when ')' then lag(pos) over w else -1 end as partner
  from lev window w as (partition by graph_id, level order by pos))
"""

EDGES = PAIRS + """,
opn as (
  select graph_id, n, pos, partner, row_number() over (partition by graph_id order by pos) - 1 as r,
    count(*) over (partition by graph_id) as p from par where state = '('),
npairs as (select graph_id, count(*) as p from par where state = '(' group by graph_id),
spot as (select par.graph_id, par.n, par.pos, coalesce(npairs.p, 0) as p from par left join npairs using (graph_id)),
edg as (
  select graph_id, pos as edge_ord, pos as src, pos + 1 as dst, 0 as edge_type from spot where pos < n - 1
  union all select graph_id, n - 1 + pos, pos + 1, pos, 1 from spot where pos < n - 1
  union all select graph_id, 2 * (n - 1) + r, pos, partner, 2 from opn
  union all select graph_id, 2 * (n - 1) + p + r, partner, pos, 3 from opn
  union all select graph_id, 2 * (n - 1) + 2 * p + 2 * pos, pos, pos + 2, 4 from spot where pos < n - 2
  union all select graph_id, 2 * (n - 1) + 2 * p + 2 * pos + 1, pos + 2, pos, 5 from spot where pos < n - 2)
"""

WINDOWS = """,
wbase as (select *, n // 4 as q, (doc_id + piece) % 2 = 0 as one from rna),
wcut as (
  select *, null as s, null as e, 0 as w from wbase where n < 20
  union all select *, q, q + 11, 0 from wbase where n >= 20 and one
  union all select *, q, q + 9, 0 from wbase where n >= 20 and not one
  union all select *, q + 3, n, 1 from wbase where n >= 20 and not one),
wrec as (
  select transcript_id as molecule_id, case when s is null then transcript_id else transcript_id || ':' || s || '-' || e end as graph_id,
    sequence, structure, s, e, n, coalesce(e - s, n) as core_length, row_ord * 16777216 + w as record_ord, doc_id, piece from wcut)
"""

CORE = """,
core as (
  select w.graph_id, w.molecule_id, w.s, w.e, p.pos, p.partner from wrec w join par p
    on p.graph_id = w.molecule_id and p.pos >= coalesce(w.s, 0) and p.pos < coalesce(w.e, w.n)),
hop1 as (select graph_id, molecule_id, s, e, partner as pos from core where partner >= 0 and s is not null and (partner < s or partner >= e))
"""


def context(hops: int, skip2: bool = True) -> str:
    sql = CORE
    for k in range(2, hops + 1):
        sql += f""",
hop{k} as (
  select graph_id, molecule_id, s, e, pos from hop{k - 1}
  union select h.graph_id, h.molecule_id, h.s, h.e, x.dst from hop{k - 1} h join edg x
    on x.graph_id = h.molecule_id and x.src = h.pos where (x.dst < h.s or x.dst >= h.e){"" if skip2 else " and x.edge_type < 4"})
"""
    return sql + f""",
picked as (
  select graph_id, molecule_id, pos, 0 as role from core union all select graph_id, molecule_id, pos, 1 from hop{hops}),
sel as (select *, row_number() over (partition by graph_id order by pos) - 1 as idx from picked),
ind as (
  select a.graph_id, x.edge_ord, a.pos as src_pos, b.pos as dst_pos, a.idx as src, b.idx as dst, x.edge_type
  from sel a join edg x on x.graph_id = a.molecule_id and x.src = a.pos join sel b on b.graph_id = a.graph_id and b.pos = x.dst)
"""


DIRTY = """,
kinds as (select *, (doc_id + piece) % 11 as k from rna),
dirty as (
  select row_ord, k,
    case k when 5 then 'rna-dup' when 7 then '  ' when 8 then 'a' || chr(9) || transcript_id else transcript_id end as raw_id,
    case k when 1 then substr(sequence, 1, length(sequence) - 1) || 'N' when 6 then ' ' || lower(replace(sequence, 'U', 'T')) || ' '
      when 9 then ' ' else sequence end as raw_sequence,
    case k when 2 then substr(structure, 2) when 3 then ')' || substr(structure, 2)
      when 4 then substr(structure, 1, length(structure) - 1) || '(' when 10 then replace(structure, '....', '.[].') else structure end as raw_structure
  from kinds),
norm as (
  select row_ord, trim(raw_id) as id, translate(upper(trim(raw_sequence)), 'T', 'U') as sequence, trim(raw_structure) as structure from dirty),
walk as (
  select row_ord, pos, substr(structure, pos + 1, 1) as state,
    sum(case substr(structure, pos + 1, 1) when '(' then 1 when ')' then -1 else 0 end)
      over (partition by row_ord order by pos rows unbounded preceding) as depth
  from (select row_ord, structure, unnest(range(0, length(structure))) as pos from norm)),
ends as (
  select row_ord, min(case when depth < 0 then pos end) as close_at, arg_max(depth, pos) as final,
    coalesce(max(case when depth = 0 then pos end), -1) as settled from walk group by row_ord),
opens as (
  select w.row_ord, min(w.pos) as open_at from walk w join ends e using (row_ord)
  where e.final > 0 and w.pos > e.settled and w.state = '(' group by w.row_ord),
faults as (
  select norm.*, close_at, case when final > 0 then open_at end as open_at,
    list_aggregate(list_sort(list_distinct(string_split(regexp_replace(sequence, '[ACGU]+', '', 'g'), ''))), 'string_agg', ' ') as odd_bases,
    list_aggregate(list_sort(list_distinct(string_split(regexp_replace(structure, '[.()]+', '', 'g'), ''))), 'string_agg', ' ') as odd_states
  from norm left join ends using (row_ord) left join opens using (row_ord)),
first_fault as (
  select *, case when sequence = '' then 'empty_sequence' when length(sequence) > 4096 then 'too_long'
    when length(sequence) <> length(structure) then 'length_mismatch' when odd_bases <> '' then 'sequence_alphabet'
    when odd_states <> '' then 'structure_alphabet' when close_at is not null then 'unmatched_close'
    when open_at is not null then 'unmatched_open' when id = '' then 'empty_identifier'
    when contains(id, chr(9)) then 'identifier_break' end as fault from faults),
judged as (
  select *, case when fault is not null then fault
    when row_number() over (partition by id, fault is null order by row_ord) > 1 then 'duplicate_identifier' end as rule from first_fault),
rejects as (
  select row_ord * 16777216 as record_ord, id as molecule_id, rule, case rule when 'empty_sequence' then 'the sequence is empty'
    when 'length_mismatch' then 'structure has ' || length(structure) || ' characters, sequence has ' || length(sequence)
    when 'sequence_alphabet' then 'unknown bases: ' || odd_bases when 'structure_alphabet' then 'unknown symbols: ' || odd_states
    when 'unmatched_close' then ''')'' without partner at position ' || close_at
    when 'unmatched_open' then '''('' without partner at position ' || open_at
    when 'empty_identifier' then 'the identifier is empty' when 'identifier_break' then 'the identifier holds a tab or line break'
    when 'duplicate_identifier' then 'identifier seen before: ' || id end as message from judged where rule is not null)
"""

SHARDS = f""",
ordered as (
  select graph_id, record_ord, n, row_number() over (order by record_ord) as rn, sum(n) over (order by record_ord) as upto from rec),
steps as (select unnest(range(1, {SHARD_RECORDS} + 1)) as step),
ahead as (select rn, n, upto, rn + step as to_rn, step from ordered cross join steps),
follow as (
  select a.rn, min(b.rn) as next from ahead a join ordered b on b.rn = a.to_rn
  where a.step = {SHARD_RECORDS} or b.upto - a.upto + a.n > {SHARD_NODES} group by a.rn),
heads as (
  with recursive h(rn, shard_id) as (
    select cast(1 as bigint), cast(0 as bigint) union all select follow.next, h.shard_id + 1 from h join follow on follow.rn = h.rn)
  select * from h),
spans as (select rn as low, lead(rn, 1, 9223372036854775807) over (order by rn) as high, shard_id from heads),
shd as (select o.graph_id, o.record_ord, o.rn, o.n, s.shard_id from ordered o join spans s on o.rn >= s.low and o.rn < s.high),
sizes as (
  select s.*, 2 * (s.n - 1) + 2 * coalesce(p, 0) + 2 * greatest(s.n - 2, 0) as m
  from shd s left join (select graph_id, length(structure) - length(replace(structure, '(', '')) as p from rec) using (graph_id))
"""


def edge_digest(table: str, ids: str, src: str = "src", dst: str = "dst") -> str:
    text = f"string_agg({src} || '>' || {dst} || ':' || edge_type, ',' order by edge_ord)"
    return (
        f"select i.graph_id, cast(coalesce(d.m, 0) as bigint) as edge_count, md5(coalesce(d.t, '')) as edges "
        f"from {ids} i left join (select graph_id, count(*) as m, {text} as t from {table} group by graph_id) d using (graph_id)"
    )


def small_weights(tensor: str) -> str:
    """Rows of one tensor of the weight table made of ``embeddings``."""
    first = 0
    for name, (rows, width) in SMALL.tensors().items():
        if name == tensor:
            break
        first += rows
    slots = f"least({sum(r for r, _ in SMALL.tensors().values())}, (select count(*) from embeddings))"
    value = "steps / 64"
    if tensor.endswith("mlp.1.weight") or (tensor.startswith("norms.") and tensor.endswith(".weight")):
        value = "1.0"
    if tensor.endswith(".running_var"):
        value = "1 + abs(steps) / 64"
    return (
        f"(select r.row, c.c, cast({value} as double) as v from (select unnest(range(0, {rows})) as row) r "
        f"cross join (select unnest(range(0, {width})) as c) c "
        f"join (select slot, c as at, (sum(cast(round(x * 64) as bigint)) + 64) % 128 as rest, case when rest < 0 then rest + 64 else rest - 64 end as steps "
        f"from (select vec_id % {slots} as slot, unnest(embedding) as x, unnest(range(0, len(embedding))) as c from embeddings) group by slot, c) x "
        f"on x.slot = ({first} + r.row) % {slots} and x.at = c.c % 64)"
    )


def spec_variants() -> dict[str, GraphSpec]:
    return {"default": GraphSpec(), "states": GraphSpec(structure_feature="B"), "no_skip": GraphSpec(skip2=False, edge_dim=4), "plain": GraphSpec(positional=False)}


def wide(alias: str, tensor: str) -> str:
    """One row with a column ``alias_row_c`` for each value of a tensor."""
    rows, width = SMALL.tensors()[tensor]
    cells = ", ".join(f"max(case when row = {r} and c = {c} then v end) as {alias}_{r}_{c}" for r in range(rows) for c in range(width))
    return f"{alias} as (select {cells} from {small_weights(tensor)})"


def layer_sql(nodes: str = "par", edges: str = "edg") -> str:
    """Input layer and the neighbour sums of one encoder layer, four wide, over nodes (graph_id, pos, base, state) and edges."""
    h = 4
    parts = [
        wide("wi", "input.weight"), wide("bi", "input.bias"),
        wide("we", "convs.0.edge_lin.weight"), wide("be", "convs.0.edge_lin.bias"),
    ]
    terms = []
    for i in range(h):
        known = [f"case when base = '{b}' then wi_{i}_{k} else 0 end" for k, b in enumerate("ACGU")]
        known.append(f"case when state <> '.' then wi_{i}_4 else 0 end")
        terms.append(f"bi_0_{i} + {' + '.join(known)} as h{i}")
    parts.append(f"st as (select graph_id, pos, {', '.join(terms)} from {nodes} cross join wi cross join bi)")
    kinds = " union all ".join(
        f"select {t} as edge_type, {', '.join(f'we_{i}_{t} + be_0_{i} as k{i}' for i in range(h))} from we cross join be" for t in range(6)
    )
    parts.append(f"kv as ({kinds})")
    sums = ", ".join(f"sum(greatest(s.h{i} + kv.k{i}, 0)) as a{i}" for i in range(h))
    parts.append(
        f"ag as (select x.graph_id, x.dst as pos, {sums} from {edges} x join st s on s.graph_id = x.graph_id and s.pos = x.src "
        "join kv on kv.edge_type = x.edge_type group by x.graph_id, x.dst)"
    )
    both = ", ".join(f"st.h{i}, coalesce(ag.a{i}, 0) as a{i}" for i in range(h))
    parts.append(f"nb as (select st.graph_id, st.pos, {both} from st left join ag on ag.graph_id = st.graph_id and ag.pos = st.pos)")
    return ",\n".join(parts)


def conv_sql() -> str:
    """The rest of that layer: MLP with batch norm, layer norm, residual."""
    h, h2, conv = 4, 8, "convs.0"
    names = {
        "ma": "mlp.0.weight", "ca": "mlp.0.bias", "ga": "mlp.1.weight", "sa": "mlp.1.bias", "mu": "mlp.1.running_mean",
        "va": "mlp.1.running_var", "mb": "mlp.4.weight", "cb": "mlp.4.bias", "ep": "eps",
    }
    parts = [wide(alias, f"{conv}.{name}") for alias, name in names.items()]
    parts += [wide("ng", "norms.0.weight"), wide("ns", "norms.0.bias")]
    cross = " ".join(f"cross join {alias}" for alias in names)
    mixed = ", ".join(f"(1 + ep_0_0) * h{i} + a{i} as t{i}" for i in range(h))
    parts.append(f"mixed as (select *, {mixed} from nb {cross})")
    inner = ", ".join(
        f"greatest(({' + '.join(f't{i} * ma_{j}_{i}' for i in range(h))} + ca_0_{j} - mu_0_{j}) / sqrt(va_0_{j} + 1e-5) * ga_0_{j} + sa_0_{j}, 0) as u{j}"
        for j in range(h2)
    )
    parts.append(f"hidden as (select *, {inner} from mixed)")
    outer = ", ".join(f"{' + '.join(f'u{j} * mb_{i}_{j}' for j in range(h2))} + cb_0_{i} as o{i}" for i in range(h))
    parts.append(f"outward as (select graph_id, pos, h0, h1, h2, h3, {outer} from hidden)")
    parts.append("centred as (select *, (o0 + o1 + o2 + o3) / 4 as mean from outward)")
    square = " + ".join(f"(o{i} - mean) * (o{i} - mean)" for i in range(h))
    parts.append(f"spread as (select *, sqrt(({square}) / 4 + 1e-5) as sd from centred)")
    out = ", ".join(f"h{i} + ((o{i} - mean) / sd * ng_0_{i} + ns_0_{i}) as y{i}" for i in range(h))
    parts.append(f"layer as (select graph_id, pos, {out} from spread cross join ng cross join ns)")
    return ",\n".join(parts)


#: Nodes of the windows' graphs, numbered as their edges are.
WINDOW_NODES = """,
wnode as (select l.graph_id, l.idx as pos, l.pos as residue, l.role, p.base, p.state from sel l join par p on p.graph_id = l.molecule_id and p.pos = l.pos)
"""


def head_sql() -> str:
    """The head and the unit vectors ``vec`` (graph_id, pos, e0 ... e3) of every node."""
    h = 4
    names = {"ha": "head.0.weight", "hb": "head.0.bias", "hc": "head.2.weight", "hd": "head.2.bias"}
    parts = [wide(alias, name) for alias, name in names.items()]
    inner = ", ".join(f"greatest({' + '.join(f'y{i} * ha_{j}_{i}' for i in range(h))} + hb_0_{j}, 0) as z{j}" for j in range(h))
    parts.append(f"headed as (select graph_id, pos, {inner} from layer cross join ha cross join hb)")
    outer = ", ".join(f"{' + '.join(f'z{j} * hc_{i}_{j}' for j in range(h))} + hd_0_{i} as v{i}" for i in range(h))
    parts.append(f"outed as (select graph_id, pos, {outer} from headed cross join hc cross join hd)")
    parts.append(f"norms as (select *, greatest(sqrt({' + '.join(f'v{i} * v{i}' for i in range(h))}), {NORM_FLOOR}) as norm from outed)")
    parts.append(f"vec as (select graph_id, pos, {', '.join(f'v{i} / norm as e{i}' for i in range(h))} from norms)")
    return ",\n".join(parts)


VECTOR_SUMS = "count(*) as core_length, " + ", ".join(f"cast(sum(cast(round(e{i} * 1000.0) as bigint) * (residue + 1)) as bigint) as s{i}" for i in range(4))


def molecule_vectors() -> str:
    """A digest of all vectors of every whole molecule."""
    return (
        f"with {RNA}{EDGES},\n{layer_sql()},\n{conv_sql()},\n{head_sql()} "
        f"select graph_id, {VECTOR_SUMS} from (select *, pos as residue from vec) v group by graph_id"
    )


def window_vectors() -> str:
    """A digest of the core vectors of every window, with context of two hops."""
    return (
        f"with {RNA}{EDGES}{WINDOWS}{context(2)}{WINDOW_NODES},\n{layer_sql('wnode', 'ind')},\n{conv_sql()},\n{head_sql()} "
        f"select graph_id, {VECTOR_SUMS} from vec join wnode using (graph_id, pos) where role = 0 group by graph_id"
    )
