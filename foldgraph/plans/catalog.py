"""Every operator as a query over the supplied tables, with its DuckDB statement.

Molecules come from the whole ``documents`` table, weights from ``embeddings``.
Long results are folded to one row per graph, over all of its nodes or edges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foldgraph import fixtures
from foldgraph.functions import features, selection, text, vectors as V
from foldgraph.functions.arrays import as_text, count_value, first_n, let
from foldgraph.functions.edges import edge_digests, entries_at
from foldgraph.functions.pairing import pair_table, scan_brackets
from foldgraph.operators import checks, encoder, graphs as G, packing, records as R
from foldgraph.plans import jobs, oracle as O
from foldgraph.session import scratch_dir
from foldgraph.sources import shards, tables
from foldgraph.spec import EncoderShape, GraphSpec
from foldgraph.streaming.arriving import embed_arriving_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def full_records(spark, sf) -> DataFrame:
    return R.records_from_df(fixtures.rna(spark, sf).drop("doc_id", "piece"), order="row_ord").records


def window_records(spark, sf) -> DataFrame:
    return R.records_from_df(fixtures.rna_windows(spark, sf), order="row_ord").records


def dirty_judged(spark, sf) -> DataFrame:
    return R.judged_records(fixtures.rna_dirty(spark, sf), order="row_ord")


def window_graphs(spark, sf, hops=2) -> DataFrame:
    return G.build_graphs(window_records(spark, sf), keep_paired_neighbours=True, context_hops=hops)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def damage_key() -> Column:
    """The piece's place in its document and the document itself, modulo 7."""
    row = F.shiftright("record_ord", R.WINDOW_BITS)
    return ((F.shiftright(row, 16) + F.pmod(row, F.lit(65536))) % 7).cast("int")


def edge_digest(g: DataFrame) -> DataFrame:
    return g.select("graph_id", F.col("edge_count").cast("long").alias("edge_count"), edge_digests("edge_src", "edge_dst", "edge_types").alias("edges"))


def static_text(g: DataFrame, name="features") -> DataFrame:
    flat = F.flatten(F.transform("node_features", lambda f: F.slice(f, 1, 5))).cast("array<int>")
    return g.select("graph_id", F.md5(F.array_join(flat.cast("array<string>"), "")).alias(name))


ONE_HOT = "replace(replace(replace(replace({}, 'A', '1000{t}'), 'C', '0100{t}'), 'G', '0010{t}'), 'U', '0001{t}')"
STATIC_SQL = """string_agg(case base when 'A' then '1000' when 'C' then '0100' when 'G' then '0010' else '0001' end
  || case when state = '.' then '0' else '1' end, '' order by pos)"""


# Sources -------------------------------------------------------------------


def windows_table(spark, sf) -> str:
    path = scratch_dir(spark)
    return fixtures.write_table(fixtures.rna_windows(spark, sf).drop("row_ord"), path)


@query(
    f"with {O.RNA}{O.WINDOWS} select graph_id, molecule_id, sequence, structure, cast(s as bigint) as window_start, "
    "cast(e as bigint) as window_end, cast(n as bigint) as length, cast(core_length as bigint) as core_length from wrec"
)
def read_records(spark, sf):
    got = tables.read_records(spark, windows_table(spark, sf)).records
    got = got.withColumnsRenamed({"start": "window_start", "end": "window_end"}).drop("record_ord")
    return longs(got, "window_start", "window_end", "length", "core_length")


@query(
    f"with {O.RNA}, held(name, place) as (values ('transcript_id', 0), ('sequence', 1), ('secondary_structure', 2), ('start', 3), ('end', 4)), "
    "total as (select count(*) as cells from rna) select name, cast(place as bigint) as place, cells from held, total"
)
def check_header(spark, sf):
    header, rows = tables.scan_table(spark, windows_table(spark, sf))
    columns = tables.check_header(header)
    used = [columns.identifier, columns.sequence, columns.structure, columns.start, columns.end]
    counted = rows.agg(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(header.index(n)).cast("long").alias("place"), F.count(F.col(f"`{n}`")).alias("cells")) for n in used]).alias("c"))
    return counted.select(F.inline("c"))


@query(
    f"with {O.RNA}, kinds as (select *, (doc_id + piece) % 5 as k from rna) select transcript_id as molecule_id, "
    "case k when 1 then 'extra_fields' else 'required_text' end as rule, transcript_id || case k when 1 then chr(9) || sequence || chr(9) "
    "|| structure || chr(9) || 'more' else '' end as raw from kinds where k in (1, 2)"
)
def reject_malformed(spark, sf):
    rows = fixtures.rna(spark, sf).withColumn("k", (F.col("doc_id") + F.col("piece")) % 5)
    line = F.concat_ws("\t", "transcript_id", "sequence", "secondary_structure")
    lines = rows.select(
        F.when(F.col("k") == 1, F.concat_ws("\t", line, F.lit("more"))).when(F.col("k") == 2, F.col("transcript_id")).otherwise(line).alias("transcript_id\tsequence\tsecondary_structure")
    )
    path = scratch_dir(spark)
    # A separator that never occurs keeps each prepared line as it is.
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return tables.read_records(spark, path).rejects.select("molecule_id", "rule", "raw")


@query(f"with {O.RNA} select count(*) as records, cast(sum(n) as bigint) as nucleotides from rec")
def require_non_empty(spark, sf):
    records = R.require_non_empty(full_records(spark, sf))
    return records.agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("nucleotides"))


@query(
    f"with {O.RNA}{O.DIRTY} select id as graph_id, sequence, structure, cast(length(sequence) as bigint) as length, "
    "row_ord * 16777216 as record_ord from judged where rule is null"
)
def records_from_df(spark, sf):
    clean = R.split_judged(dirty_judged(spark, sf)).records
    return longs(clean.select("graph_id", "sequence", "structure", "length", "record_ord"), "length")


@query(f"with {O.RNA}{O.DIRTY} select record_ord, molecule_id, rule, message from rejects")
def reject_rows(spark, sf):
    return R.split_judged(dirty_judged(spark, sf)).rejects.select("record_ord", "molecule_id", "rule", "message")


def shard_dataset(spark, sf, checksum=False) -> str:
    path = scratch_dir(spark)
    sharded = packing.assign_shards(full_records(spark, sf), max_records=O.SHARD_RECORDS, max_nodes=O.SHARD_NODES)
    shards.write_shards(G.build_graphs(sharded), path, checksum=checksum, arranged=True)
    return path


@query(f"with {O.RNA}{O.SHARDS} select graph_id, shard_id, cast(n as bigint) as node_count, cast(m as bigint) as edge_count from sizes")
def read_shards(spark, sf):
    got = shards.read_shards(spark, shard_dataset(spark, sf, True), GraphSpec(), verify_checksum=True, validation="full")
    return longs(got.select("graph_id", "shard_id", "node_count", "edge_count"), "node_count", "edge_count")


@query(
    f"with {O.RNA} select graph_id, array_to_string(range(0, n), ',') as residues, repeat('0', cast(n as integer)) as roles from rec"
)
def upgrade_legacy_shards(spark, sf):
    old = G.build_graphs(full_records(spark, sf)).drop("residue_index", "node_roles", "core_count")
    new = shards.upgrade_legacy_shards(old)
    return new.select("graph_id", as_text(F.col("residue_index")).alias("residues"), F.array_join(F.col("node_roles").cast("array<string>"), "").alias("roles"))


# Scalar functions ----------------------------------------------------------


@query(f"with {O.RNA}{O.DIRTY} select row_ord, sequence, structure from norm")
def normalize_records(spark, sf):
    rows = R.standardize(fixtures.rna_dirty(spark, sf), R.Columns(), "row_ord")
    return R.normalize_records(rows).select("row_ord", "sequence", "structure")


@query(
    f"with {O.RNA}{O.WINDOWS} select transcript_id, case when k = 1 then null when n < 20 then '' else q || (case when one then '' else ',' || (q + 3) end) end as positions, "
    "case k when 1 then case when n < 20 then null else 'not an integer in start: x' end end as error from (select *, case when (doc_id + piece) % 5 = 1 and n >= 20 then 1 else 0 end as k from wbase)"
)
def parse_position_list(spark, sf):
    rows = fixtures.rna_windows(spark, sf).withColumn("k", damage_mod5())
    cell = F.when((F.col("k") == 1) & (F.length("sequence") >= 20), F.concat("start", F.lit(" , x"))).otherwise(F.concat(F.lit(" "), "start"))
    parsed = text.parse_position_list(cell, T.StringType(), "start")
    return rows.select(
        "transcript_id", F.when(parsed["error"].isNull(), as_text(parsed["values"])).alias("positions"), parsed["error"].alias("error")
    )


def damage_mod5() -> Column:
    return (F.shiftright("row_ord", 16) + F.pmod(F.col("row_ord"), F.lit(65536))) % 5


@query(f"with {O.RNA} select transcript_id || ':0-' || n as graph_id from rna")
def window_identifier(spark, sf):
    rows = fixtures.rna(spark, sf)
    return rows.select(text.window_identifier(F.col("transcript_id"), F.lit(0), F.length("sequence")).alias("graph_id"))


@query(f"with {O.RNA}{O.WINDOWS} select graph_id, cast(n as bigint) as length, s is not null as sliced, cast(core_length as bigint) as core_length from wrec")
def record_measures(spark, sf):
    return longs(R.record_measures(window_records(spark, sf)), "length", "core_length")


def digits(array: Column) -> Column:
    return F.array_join(F.flatten(array).cast("array<int>").cast("array<string>"), "")


@query(f"with {O.RNA} select graph_id, {ONE_HOT.format('sequence', t='')} as features from rec")
def base_one_hot(spark, sf):
    return full_records(spark, sf).select("graph_id", digits(F.transform(F.split("sequence", ""), features.base_one_hot)).alias("features"))


@query(f"with {O.RNA} select graph_id, translate(structure, '(.)', '101') as features from rec")
def paired_flag(spark, sf):
    return full_records(spark, sf).select("graph_id", digits(F.transform(F.split("structure", ""), features.paired_flag)).alias("features"))


@query(f"with {O.RNA} select graph_id, replace(replace(replace(structure, '(', '100'), '.', '010'), ')', '001') as features from rec")
def structure_one_hot(spark, sf):
    return full_records(spark, sf).select("graph_id", digits(F.transform(F.split("structure", ""), features.structure_one_hot)).alias("features"))


ANGLE = "cast(cast(pos as float) / cast(greatest(n - 1, 1) as float) as float) * cast(pi() as float)"


@query(
    f"with {O.RNA}{O.NUC} select graph_id, cast(sum(cast(round(cast(cast(sin({ANGLE}) as float) as double) * 10000.0) as bigint)) as bigint) as sines, "
    f"cast(sum(cast(round(cast(cast(cos({ANGLE}) as float) as double) * 10000.0) as bigint)) as bigint) as cosines from nuc group by graph_id"
)
def relative_position(spark, sf):
    at = G.explode_nucleotides(full_records(spark, sf), "length")
    pair = features.relative_position(F.col("pos"), F.col("length"))
    whole = lambda c: F.sum(F.round(c.cast("double") * 10000.0).cast("long"))
    return at.select("graph_id", pair.alias("p")).groupBy("graph_id").agg(whole(F.col("p")[0]).alias("sines"), whole(F.col("p")[1]).alias("cosines"))


@query(
    f"with {O.RNA} select graph_id, 'plain' as spec, 5 * n as size, {ONE_HOT.format('sequence', t='')} as bases from rec "
    f"union all select graph_id, 'default', 7 * n, {ONE_HOT.format('sequence', t='')} from rec "
    f"union all select graph_id, 'states', 9 * n, {ONE_HOT.format('sequence', t='')} from rec"
)
def assemble_features(spark, sf):
    records = full_records(spark, sf).withColumn("partner", pair_table("structure"))
    out = []
    for name in ("plain", "default", "states"):
        built = features.node_features(F.col("sequence"), F.col("partner"), first_n(F.length("sequence")), O.spec_variants()[name])
        bases = digits(F.transform("f", lambda v: F.slice(v, 1, 4)))
        out.append(
            records.withColumn("f", built).select("graph_id", F.lit(name).alias("spec"), F.size(F.flatten("f")).cast("long").alias("size"), bases.alias("bases"))
        )
    return out[0].unionByName(out[1]).unionByName(out[2])


NAMES = ["backbone_forward", "backbone_reverse", "base_pair_forward", "base_pair_reverse", "skip2_forward", "skip2_reverse"]
NAME_SQL = "case edge_type " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(NAMES)) + " end"


@query(
    f"with {O.RNA}{O.EDGES} select {NAME_SQL} as name, cast(edge_type as bigint) as code, "
    "repeat('0', edge_type) || '1' || repeat('0', 9 - edge_type) as one_hot, count(*) as edges from edg group by edge_type"
)
def edge_type_code(spark, sf):
    e = G.unpack_edges(G.build_graphs(full_records(spark, sf))).groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))
    named = e.withColumn("name", features.edge_type_name(F.col("edge_type")))
    hot = F.array_join(features.edge_one_hot(F.col("edge_type")).cast("array<int>").cast("array<string>"), "")
    return named.select("name", features.edge_type_code(F.col("name")).cast("long").alias("code"), hot.alias("one_hot"), "edges")


@query(
    "with e as (select vec_id, embedding, unnest(range(0, len(embedding))) as k from embeddings), "
    "v as (select vec_id, k, cast(embedding[k + 1] as double) as x from e), "
    "m as (select vec_id, greatest(sqrt(sum(x * x)), 1e-12) as norm from v group by vec_id) "
    "select vec_id, cast(sum(cast(round(x / norm * 100000.0) as bigint) * (k + 1)) as bigint) as digest from v join m using (vec_id) group by vec_id"
)
def l2_normalize(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", vector_digest(V.l2_normalize(F.col("embedding")), 100000.0))


def vector_digest(vector: Column, scale: float) -> Column:
    terms = F.transform(vector, lambda x, k: F.round(x.cast("double") * scale).cast("long") * (k + 1))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, b: a + b).alias("digest")


@query(
    "with e as (select vec_id, embedding, unnest(range(0, len(embedding))) as k from embeddings), "
    "v as (select vec_id, k, cast(embedding[k + 1] as double) as x from e), "
    "s as (select *, case when x = 0 then 1.0 else pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) end as step from v) "
    "select vec_id, cast(sum(cast(round_even(x / step, 0) * step * 16777216.0 as bigint) * (k + 1)) as bigint) as digest from s group by vec_id"
)
def cast_embedding(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("half", V.cast_embedding(F.col("embedding"), "float16"))
    return e.select("vec_id", vector_digest(F.col("half"), 16777216.0))


@query(
    f"with {O.RNA} "
    + " union all ".join(
        f"select '{name}' as name, sha256('{spec.canonical()}') as fingerprint, {spec.feature_width} * cast(sum(n) as bigint) as feature_values from rec"
        for name, spec in O.spec_variants().items()
    )
)
def spec_fingerprint(spark, sf):
    records = full_records(spark, sf).agg(F.sum("length").alias("n"))
    rows = [
        records.select(F.lit(name).alias("name"), features.spec_fingerprint(spec).alias("fingerprint"), (F.col("n") * spec.feature_width).alias("feature_values"))
        for name, spec in O.spec_variants().items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# Rules ---------------------------------------------------------------------


def rows_with(spark, sf, *rules) -> DataFrame:
    rows = R.judge_rows(R.standardize(fixtures.rna_dirty(spark, sf), R.Columns(), "row_ord"))
    return rows.where(F.col("fault.rule").isin(*rules)).select("row_ord", "fault.rule", "fault.message")


def reject_sql(*rules) -> str:
    listed = ", ".join(f"'{r}'" for r in rules)
    return f"with {O.RNA}{O.DIRTY} select record_ord // 16777216 as row_ord, rule, message from rejects where rule in ({listed})"


ALPHABET = ("empty_sequence", "too_long", "length_mismatch", "sequence_alphabet", "structure_alphabet")


@query(reject_sql(*ALPHABET))
def check_alphabet(spark, sf):
    return rows_with(spark, sf, *ALPHABET)


@query(reject_sql("unmatched_close", "unmatched_open"))
def check_balance(spark, sf):
    return rows_with(spark, sf, "unmatched_close", "unmatched_open")


@query(reject_sql("empty_identifier", "identifier_break"))
def check_identifier(spark, sf):
    rows = fixtures.rna_dirty(spark, sf)
    judged = R.judged_records(rows, order="row_ord", unique=False)
    bad = judged.where(F.col("fault.rule").isin("empty_identifier", "identifier_break"))
    return bad.select("row_ord", "fault.rule", "fault.message")


@query(
    f"with {O.RNA}{O.WINDOWS}, bent as (select molecule_id, (doc_id + piece) % 4 as k, n, s, e from wrec where s is not null), "
    "moved as (select molecule_id, n, case k when 1 then s - n when 2 then e else s end as s, case k when 3 then e + n else e end as e from bent) "
    "select molecule_id, 'window [' || s || ', ' || e || ') is not inside ' || n || ' nt' as message from moved where s < 0 or e > n or s >= e"
)
def check_window(spark, sf):
    w = window_records(spark, sf).where("start is not null").withColumn("k", F.expr("((record_ord >> 40) + ((record_ord >> 24) & 65535)) % 4"))
    start = F.when(F.col("k") == 1, F.col("start") - F.col("length")).when(F.col("k") == 2, F.col("end")).otherwise(F.col("start"))
    end = F.when(F.col("k") == 3, F.col("end") + F.col("length")).otherwise(F.col("end"))
    judged = w.withColumn("fault", text.window_fault(start, end, F.col("length")))
    return judged.where("fault is not null").select("molecule_id", "fault.message")


@query(
    f"with {O.RNA}{O.WINDOWS} select transcript_id as molecule_id, 'start has ' || (case when one then 2 else 3 end) || ' entries and end has ' "
    "|| (case when one then 1 else 2 end) as message from wbase where n >= 20 and (doc_id + piece) % 3 = 0"
)
def check_window_lists(spark, sf):
    rows = fixtures.rna_windows(spark, sf)
    third = (F.shiftright("row_ord", 16) + F.pmod(F.col("row_ord"), F.lit(65536))) % 3 == 0
    longer = F.when(third & (F.col("start") != ""), F.concat("start", F.lit(",1"))).otherwise(F.col("start"))
    rejects = R.records_from_df(rows.withColumn("start", longer), order="row_ord").rejects
    return rejects.where("rule = 'window_lists'").select("molecule_id", "message")


@query(f"with {O.RNA}, ids as (select sequence as graph_id from rec) select graph_id, count(*) as copies from ids group by graph_id having count(*) > 1")
def check_unique_ids(spark, sf):
    named = full_records(spark, sf).select(F.col("sequence").alias("graph_id"))
    return checks.check_unique_ids(named)


@query(
    f"with {O.RNA} select row_ord * 16777216 as record_ord, 'required_text' as rule, 'identifier, sequence and structure must be text' as message "
    "from rna where (doc_id + piece) % 5 in (1, 2)"
)
def check_required_text(spark, sf):
    rows = fixtures.rna(spark, sf).drop("doc_id", "piece").withColumn("k", damage_mod5())
    rows = rows.withColumn("sequence", F.when(F.col("k") != 1, F.col("sequence")))
    rows = rows.withColumn("transcript_id", F.when(F.col("k") != 2, F.col("transcript_id"))).drop("k")
    return R.records_from_df(rows, order="row_ord").rejects.select("record_ord", "rule", "message")


def damaged_graphs(spark, sf) -> DataFrame:
    g = G.build_graphs(full_records(spark, sf)).withColumn("k", F.when(F.col("node_count") > 2, damage_key()).otherwise(0))
    k, n = F.col("k"), F.col("node_count")
    return g.withColumns(
        {
            "edge_dst": F.when(k == 1, F.transform("edge_dst", lambda x, i: F.when(i == 0, n).otherwise(x))).otherwise(F.col("edge_dst")),
            "node_roles": F.when(k == 2, F.transform("node_roles", lambda x: F.lit(1).cast("tinyint"))).otherwise(F.col("node_roles")),
            "residue_index": F.when(k == 3, F.reverse("residue_index")).otherwise(F.col("residue_index")),
            "node_features": F.when(k == 4, F.slice("node_features", F.lit(1), n - 1)).otherwise(F.col("node_features")),
            "edge_types": F.when(k == 5, F.transform("edge_types", lambda x: F.lit(10).cast("tinyint"))).otherwise(F.col("edge_types")),
        }
    ).drop("k")


DAMAGED = (
    f"with {O.RNA}, hurt as (select graph_id, record_ord, n, case when n > 2 then (doc_id + piece) % 7 else 0 end as k from rec), "
    "named as (select *, case k when 1 then 'edge_range' when 2 then 'no_core' when 3 then 'residue_order' when 4 then 'feature_shape' "
    "when 5 then 'edge_type_range' end as rule from hurt)"
)


@query(f"{DAMAGED} select graph_id, rule from named where rule is not null")
def check_graphs(spark, sf):
    return checks.check_graphs(damaged_graphs(spark, sf))


@query(
    f"{DAMAGED}, s as (select record_ord // 16777216 // 65536 as shard_id, rule, k from named) "
    "select shard_id, rule, count(*) as rows from s where rule is not null group by shard_id, rule "
    "union all select shard_id, 'duplicate_identifier', count(*) from s where k = 6 group by shard_id"
)
def check_shards(spark, sf):
    g = damaged_graphs(spark, sf).withColumn("shard_id", F.shiftright("record_ord", R.WINDOW_BITS + 16))
    again = g.where((damage_key() == 6) & (F.col("node_count") > 2))
    return checks.check_shards(g.unionByName(again))


@query(
    f"with {O.RNA}, hurt as (select graph_id, case when n > 2 then (doc_id + piece) % 7 else 0 end as k from rec) "
    "select graph_id, case k when 1 then 'not_finite' else 'crossing_edge' end as rule from hurt where k in (1, 2)"
)
def check_values(spark, sf):
    g = G.build_graphs(full_records(spark, sf)).withColumn("k", F.when(F.col("node_count") > 2, damage_key()).otherwise(0))
    bad = F.transform("node_features", lambda f, i: F.when(i == 1, F.transform(f, lambda x: F.lit(float("nan")).cast("float"))).otherwise(f))
    far = F.transform("edge_src", lambda x, i: F.when(i == 0, -1).otherwise(x))
    g = g.withColumn("node_features", F.when(F.col("k") == 1, bad).otherwise(F.col("node_features")))
    g = g.withColumn("edge_src", F.when(F.col("k") == 2, far).otherwise(F.col("edge_src")))
    return checks.check_values(g)


@query(
    f"with {O.RNA}, docs as (select distinct doc_id from rec) select doc_id as shard_id, case doc_id % 5 when 1 then 'node_count' "
    "when 2 then 'not_in_manifest' else 'version' end as rule from docs where doc_id % 5 in (1, 2, 3)"
)
def check_manifest(spark, sf):
    g = G.build_graphs(full_records(spark, sf)).withColumn("shard_id", F.shiftright("record_ord", R.WINDOW_BITS + 16))
    manifest = shards.shard_manifest(g).where("shard_id % 5 <> 2")
    manifest = manifest.withColumn("node_count", F.expr("node_count + if(shard_id % 5 = 1, 1, 0)"))
    manifest = manifest.withColumn("format_version", F.expr("if(shard_id % 5 = 3, 2, format_version)"))
    return checks.check_manifest(g, manifest, GraphSpec())


@query(f"with {O.RNA} select graph_id, sha256('{GraphSpec(structure_feature='B').canonical()}') as graph_spec_sha256 from rec where (doc_id + piece) % 7 = 3")
def check_spec(spark, sf):
    r = full_records(spark, sf)
    other = G.build_graphs(r.where(damage_key() == 3), GraphSpec(structure_feature="B"))
    return checks.check_spec(G.build_graphs(r.where(damage_key() != 3)).unionByName(other))


@query(f"with {O.RNA} select graph_id, cast(n as bigint) as size, 'max_nodes' as \"limit\" from rec where n > 390")
def check_limits(spark, sf):
    return packing.check_limits(full_records(spark, sf), "length", 390, "max_nodes")


SHAPES = ", ".join(f"('{name}', {rows}, {width})" for name, (rows, width) in O.SMALL.tensors().items())


@query(
    f"with shape(tensor, rows, width) as (values {SHAPES}), v as (select count(*) as vectors from embeddings) "
    "select tensor, case when rows > 1 then cast(rows - 1 as bigint) end as rows, case when rows > 1 then cast(width as bigint) end as width "
    "from shape, v where tensor like '%weight' and vectors > 0"
)
def check_weights(spark, sf):
    weights = fixtures.weights_from_embeddings(spark, sf, O.SMALL)
    found = checks.check_weights(weights.where("not (tensor like '%weight' and row = 0)"), O.SMALL)
    return longs(found, "rows", "width")


@query(f"select cast({O.SMALL.parameter_count} as bigint) as parameters from (select count(*) as n from embeddings) where n > 0")
def parameter_total(spark, sf):
    return checks.parameter_total(fixtures.weights_from_embeddings(spark, sf, O.SMALL))


# Windows and context -------------------------------------------------------

RESIDUES = "string_agg(cast({p} as varchar), ',' order by {p})"


def residue_sql(source: str) -> str:
    return (
        f"select w.graph_id, coalesce(r.t, '') as residues from wrec w left join "
        f"(select graph_id, {RESIDUES.format(p='pos')} as t from ({source}) group by graph_id) r using (graph_id)"
    )


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)} select graph_id, count(*) as nodes, {RESIDUES.format(p='pos')} as residues from sel where role = 0 group by graph_id")
def filter_core(spark, sf):
    core = encoder.filter_core(G.unpack_nodes(window_graphs(spark, sf)))
    return core.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), as_text(F.array_sort(F.collect_list("residue_index"))).alias("residues"))


@query(
    f"with {O.RNA}{O.WINDOWS} select graph_id, molecule_id, cast(s as bigint) as window_start, cast(e as bigint) as window_end, record_ord from wrec"
)
def expand_windows(spark, sf):
    rows = R.normalize_records(R.standardize(fixtures.rna_windows(spark, sf), R.Columns(), "row_ord")).withColumn("fault", F.lit(None))
    return R.expand_windows(rows).select("graph_id", "molecule_id", F.col("start").alias("window_start"), F.col("end").alias("window_end"), "record_ord")


@query(f"with {O.RNA} select graph_id, cast(n as bigint) as length, cast(null as bigint) as window_start from rec")
def ignore_windows(spark, sf):
    got = tables.read_records(spark, windows_table(spark, sf), use_windows=False).records
    return got.select("graph_id", F.col("length").cast("long").alias("length"), F.col("start").cast("long").alias("window_start"))


def selected(spark, sf, hops=2) -> DataFrame:
    return G.select_residues(window_records(spark, sf), keep_paired_neighbours=True, context_hops=hops)


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.CORE} {residue_sql('select graph_id, pos from core')}")
def select_core(spark, sf):
    r = G.select_residues(window_records(spark, sf))
    return r.select("graph_id", as_text(F.col("residue_index")).alias("residues"))


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.CORE} {residue_sql('select graph_id, pos from hop1')}")
def crossing_partners(spark, sf):
    r = window_records(spark, sf).withColumn("partner", pair_table("structure"))
    found = F.array_sort(selection.crossing_partners(F.col("partner"), F.col("start"), F.col("end")))
    return r.select("graph_id", F.coalesce(as_text(found), F.lit("")).alias("residues"))


def context_of(spark, sf, hops, skip2) -> DataFrame:
    r = window_records(spark, sf).withColumn("partner", pair_table("structure"))
    found = selection.expand_context(F.col("partner"), F.col("start"), F.col("end"), hops, skip2)
    return r.select("graph_id", F.coalesce(as_text(found), F.lit("")).alias("residues"))


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(3)} {residue_sql('select graph_id, pos from hop3')}")
def expand_context(spark, sf):
    return context_of(spark, sf, 3, True)


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(5, False)} {residue_sql('select graph_id, pos from hop5')}")
def expand_context_deep(spark, sf):
    return context_of(spark, sf, 5, False)


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)} {O.edge_digest('ind', 'wrec', 'src_pos', 'dst_pos')}")
def induced_edges(spark, sf):
    g = window_graphs(spark, sf)
    return edge_digest(g.withColumns({name: entries_at(name, "residue_index") for name in ("edge_src", "edge_dst")}))


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)} {O.edge_digest('ind', 'wrec')}")
def reindex_nodes(spark, sf):
    return edge_digest(window_graphs(spark, sf))


@query(
    f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)}, f as (select s.graph_id, s.pos, p.base, p.state from sel s join par p on p.graph_id = s.molecule_id and p.pos = s.pos) "
    f"select graph_id, md5({STATIC_SQL}) as features from f group by graph_id"
)
def gather_features(spark, sf):
    return static_text(window_graphs(spark, sf))


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(3)} select graph_id, cast(sum((idx + 1) * (pos + 1)) as bigint) as digest, count(*) as nodes from sel group by graph_id")
def dense_index(spark, sf):
    nodes = G.unpack_nodes(window_graphs(spark, sf, 3), features=False)
    digest = F.sum((F.col("node_idx") + 1).cast("long") * (F.col("residue_index") + 1))
    return nodes.groupBy("graph_id").agg(digest.alias("digest"), F.count(F.lit(1)).alias("nodes"))


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)} {residue_sql('select graph_id, pos from sel')}")
def select_union(spark, sf):
    return selected(spark, sf).select("graph_id", as_text(F.col("residue_index")).alias("residues"))


@query(
    f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)} {residue_sql('select graph_id, pos from hop2 except select graph_id, pos from hop1')}"
)
def select_except(spark, sf):
    r = window_records(spark, sf).withColumn("partner", pair_table("structure"))
    args = F.col("partner"), F.col("start"), F.col("end")
    new = F.array_except(selection.expand_context(*args, 2, True), selection.crossing_partners(*args))
    return r.select("graph_id", F.coalesce(as_text(new), F.lit("")).alias("residues"))


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)} select graph_id, string_agg(cast(role as varchar), '' order by pos) as roles from sel group by graph_id")
def split_roles(spark, sf):
    return window_graphs(spark, sf).select("graph_id", F.array_join(F.col("node_roles").cast("array<string>"), "").alias("roles"))


# Nodes and edges -----------------------------------------------------------


@query(f"with {O.RNA}{O.NUC} select base, state, count(*) as nodes, cast(sum(pos) as bigint) as positions from nuc group by base, state")
def explode_nucleotides(spark, sf):
    nodes = G.explode_nucleotides(full_records(spark, sf))
    return nodes.groupBy("base", "state").agg(F.count(F.lit(1)).alias("nodes"), F.sum("pos").alias("positions"))


def edge_totals(spark, sf, *codes) -> DataFrame:
    e = G.unpack_edges(G.build_graphs(full_records(spark, sf))).where(F.col("edge_type").isin(*codes))
    return e.groupBy("graph_id", F.col("edge_type").cast("long").alias("edge_type")).agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum(F.col("src").cast("long") * F.col("edge_ord")).alias("sources"),
        F.sum(F.col("dst").cast("long") * F.col("edge_ord")).alias("targets"),
    )


def edge_totals_sql(*codes) -> str:
    return (
        f"with {O.RNA}{O.EDGES} select graph_id, cast(edge_type as bigint) as edge_type, count(*) as edges, "
        "cast(sum(src * edge_ord) as bigint) as sources, cast(sum(dst * edge_ord) as bigint) as targets "
        f"from edg where edge_type in ({', '.join(map(str, codes))}) group by graph_id, edge_type"
    )


@query(edge_totals_sql(0, 1))
def backbone_edges(spark, sf):
    return edge_totals(spark, sf, 0, 1)


@query(edge_totals_sql(2, 3))
def pair_edges(spark, sf):
    return edge_totals(spark, sf, 2, 3)


@query(edge_totals_sql(4, 5))
def skip2_edges(spark, sf):
    return edge_totals(spark, sf, 4, 5)


@query(
    f"with {O.RNA}{O.EDGES}, e as ({O.edge_digest('edg', 'rec')}), f as (select graph_id, md5({STATIC_SQL}) as features, count(*) as node_count from par group by graph_id) "
    "select graph_id, node_count, edge_count, edges, features from e join f using (graph_id)"
)
def build_graphs(spark, sf):
    g = G.build_graphs(full_records(spark, sf))
    flat = F.flatten(F.transform("node_features", lambda f: F.slice(f, 1, 5))).cast("array<int>").cast("array<string>")
    return g.select(
        "graph_id", F.col("node_count").cast("long").alias("node_count"), F.col("edge_count").cast("long").alias("edge_count"),
        edge_digests("edge_src", "edge_dst", "edge_types").alias("edges"), F.md5(F.array_join(flat, "")).alias("features"),
    )


@query(f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)} {O.edge_digest('ind', 'wrec')}")
def pack_graphs(spark, sf):
    g = window_graphs(spark, sf)
    return edge_digest(G.pack_graphs(G.unpack_nodes(g), G.unpack_edges(g)))


@query(f"with {O.RNA}{O.PAIRS} select graph_id, string_agg(cast(partner as varchar), ',' order by pos) as partners from par group by graph_id", name="pair_table")
def pair_tables(spark, sf):
    return full_records(spark, sf).select("graph_id", as_text(pair_table("structure")).alias("partners"))


@query(f"with {O.RNA}{O.PAIRS} select graph_id, cast(max(depth) as bigint) as deepest, cast(sum(depth * pos) as bigint) as digest from par group by graph_id")
def bracket_depth(spark, sf):
    depth = G.bracket_depth(G.explode_nucleotides(G.by_molecule(full_records(spark, sf))))
    return depth.groupBy("graph_id").agg(F.max("depth").cast("long").alias("deepest"), F.sum(F.col("depth") * F.col("pos")).alias("digest"))


@query(f"with {O.RNA}{O.PAIRS} select graph_id, cast(sum((partner + 2) * (pos + 1)) as bigint) as digest from par group by graph_id")
def partner_by_level(spark, sf):
    pairs = G.partner_by_level(G.bracket_depth(G.explode_nucleotides(G.by_molecule(full_records(spark, sf)))))
    return pairs.groupBy("graph_id").agg(F.sum((F.col("partner") + 2).cast("long") * (F.col("pos") + 1)).alias("digest"))


@query(f"with {O.RNA}{O.EDGES} select graph_id, cast(sum(r * pos) as bigint) as digest, count(*) as openers from opn group by graph_id")
def opener_rank(spark, sf):
    ranks = G.opener_rank(G.explode_nucleotides(G.by_molecule(full_records(spark, sf))))
    return ranks.groupBy("graph_id").agg(F.sum(F.col("opener").cast("long") * F.col("pos")).alias("digest"), F.count(F.lit(1)).alias("openers"))


@query(f"with {O.RNA}, hurt as (select graph_id, n, case when n > 2 then (doc_id + piece) % 7 else 0 end as k from rec) select graph_id, k <> 3 as increasing from hurt")
def strictly_increasing(spark, sf):
    g = damaged_graphs(spark, sf)
    return g.select("graph_id", (~checks.not_increasing(F.col("residue_index"))).alias("increasing"))


# Aggregates ----------------------------------------------------------------

COUNTS = f"with {O.RNA}, c as (select graph_id, n, length(structure) - length(replace(structure, '(', '')) as p from rec)"


@query(
    f"{COUNTS} select graph_id, cast(n as bigint) as node_count, cast(2 * (n - 1) + 2 * p + 2 * greatest(n - 2, 0) as bigint) as edge_count, "
    "cast(n as bigint) as core_count from c"
)
def graph_counts(spark, sf):
    return longs(G.graph_counts(G.build_graphs(full_records(spark, sf))), "node_count", "edge_count", "core_count")


@query(f"with {O.RNA}{O.WINDOWS} select graph_id, cast(coalesce(s, 0) as bigint) as core_start, cast(coalesce(e, n) as bigint) as core_end, cast(core_length as bigint) as core_positions from wrec")
def core_span(spark, sf):
    got = G.core_span(window_graphs(spark, sf)).withColumn("core_positions", F.size("core_positions"))
    return longs(got, "core_start", "core_end", "core_positions")


@query(
    f"{COUNTS} select count(*) as records, cast(sum(n) as bigint) as nodes, cast(sum(2 * (n - 1) + 2 * p + 2 * greatest(n - 2, 0)) as bigint) as edges, "
    f"'{GraphSpec().fingerprint}' as graph_spec_sha256 from c"
)
def build_summary(spark, sf):
    return jobs.build_summary(G.build_graphs(full_records(spark, sf)))


@query(f"with {O.RNA}{O.SHARDS} select shard_id, count(*) as record_count, cast(sum(n) as bigint) as node_count, cast(sum(n) as bigint) as core_count, cast(sum(m) as bigint) as edge_count from sizes group by shard_id")
def shard_counts(spark, sf):
    sharded = packing.assign_shards(full_records(spark, sf), max_records=O.SHARD_RECORDS, max_nodes=O.SHARD_NODES)
    return checks.shard_counts(G.build_graphs(sharded))


@query()
def dataset_checksum(spark, sf):
    g = G.build_graphs(full_records(spark, sf)).withColumn("shard_id", F.shiftright("record_ord", R.WINDOW_BITS + 16))
    return shards.shard_checksums(g)


@query(
    f"with {O.RNA} select doc_id as shard_id, count(*) as records, true as same_reordered, bool_or(sequence like 'A%') as value_changed, "
    "bool_or(sequence like 'A%' and n > 1) as element_moved, bool_or(sequence like 'A%') as ends_exchanged from rec group by doc_id"
)
def checksum_damage(spark, sf):
    """Which kinds of damage to the molecules that start with A change the checksum of their shard."""
    g = sharded_by_document(spark, sf).withColumn("end", F.col("node_count"))
    kinds = ["intact", "value", "moved", "ends"]
    each = g.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))

    def hit(kind: str):
        return (F.col("kind") == kind) & F.col("sequence").startswith("A")

    def damaged(column: str, kind: str, value):
        return F.when(hit(kind), value).otherwise(F.col(column)).alias(column)

    raised = F.transform("node_features", lambda f: F.transform(f, lambda x: (x + 1).cast("float")))
    last = F.slice("edge_src", F.greatest(F.size("edge_src"), F.lit(1)), 1)
    changes = {
        "node_features": damaged("node_features", "value", raised),
        "edge_src": damaged("edge_src", "moved", F.slice("edge_src", 1, F.greatest(F.size("edge_src") - 1, F.lit(0)))),
        "edge_dst": damaged("edge_dst", "moved", F.concat(last, "edge_dst")),
        "start": damaged("start", "ends", F.col("end")),
        "end": damaged("end", "ends", F.col("start")),
    }
    bent = each.select("kind", *[changes.get(c, F.col(f"`{c}`")) for c in g.columns])
    sums = bent.groupBy("shard_id", "kind").agg(shards.content_hash(g.columns), F.count(F.lit(1)).alias("rows"))
    found = sums.groupBy("shard_id").agg(F.max("rows").alias("records"), *[F.max(F.when(F.col("kind") == k, F.col("checksum"))).alias(k) for k in kinds])
    # The records are reordered and not their graphs, which are some thirty times as long.
    reordered = sharded_by_document(spark, sf, "sequence").withColumn("end", F.col("node_count"))
    again = shards.shard_checksums(reordered).select("shard_id", "checksum")
    return found.join(again, "shard_id").select(
        "shard_id", "records", (F.col("checksum") == F.col("intact")).alias("same_reordered"), (F.col("value") != F.col("intact")).alias("value_changed"),
        (F.col("moved") != F.col("intact")).alias("element_moved"), (F.col("ends") != F.col("intact")).alias("ends_exchanged"),
    )


# Order and packing ---------------------------------------------------------


@query(f"with {O.RNA}{O.WINDOWS} select graph_id, row_number() over (order by record_ord) - 1 as place from wrec")
def preserve_order(spark, sf):
    rows = tables.read_records(spark, ordered_table(spark, sf)).records
    numbered = packing.greedy_parts(rows, "place", "record_ord", F.lit(1), 1, F.lit(1), 1)
    return numbered.select("graph_id", "place")


def ordered_table(spark, sf) -> str:
    path = scratch_dir(spark)
    rows = fixtures.rna_windows(spark, sf).repartitionByRange("row_ord").sortWithinPartitions("row_ord")
    return fixtures.write_table(rows.drop("row_ord"), path)


@query(f"with {O.RNA}{O.SHARDS} select graph_id, shard_id from shd")
def assign_shards(spark, sf):
    sharded = packing.assign_shards(full_records(spark, sf), max_records=O.SHARD_RECORDS, max_nodes=O.SHARD_NODES)
    return sharded.select("graph_id", "shard_id")


def sharded_by_document(spark, sf, *dealt_by: str) -> DataFrame:
    records = full_records(spark, sf)
    records = records.repartition(*dealt_by) if dealt_by else records
    return G.build_graphs(records).withColumn("shard_id", F.shiftright("record_ord", R.WINDOW_BITS + 16))


@query(
    f"""with {O.RNA}, ordered as (
  select graph_id, doc_id as shard_id, n, 2 * (n - 1) + 2 * (length(structure) - length(replace(structure, '(', ''))) + 2 * greatest(n - 2, 0) as m,
    row_number() over (order by record_ord) as rn from rec),
sums as (select *, sum(n) over (order by rn) as nodes, sum(m) over (order by rn) as edges from ordered),
follow as (
  select a.rn, min(b.rn) as next from sums a join sums b on b.shard_id = a.shard_id
  where b.rn > a.rn and (b.nodes - a.nodes + a.n > {O.BATCH_NODES} or b.edges - a.edges + a.m > {O.BATCH_EDGES}) group by a.rn),
heads as (
  with recursive h(rn) as (
    select min(rn) as rn from ordered group by shard_id union all select follow.next from h join follow on follow.rn = h.rn)
  select * from h),
spans as (select rn as low, lead(rn, 1, 9223372036854775807) over (order by rn) as high, row_number() over (order by rn) - 1 as batch_id from heads)
select o.graph_id, o.shard_id, s.batch_id from ordered o join spans s on o.rn >= s.low and o.rn < s.high"""
)
def assign_microbatches(spark, sf):
    got = packing.assign_microbatches(sharded_by_document(spark, sf), max_batch_nodes=O.BATCH_NODES, max_batch_edges=O.BATCH_EDGES)
    return got.select("graph_id", "shard_id", "batch_id")


OFFSETS = f"""with {O.RNA}, z as (
  select graph_id, doc_id as shard_id, record_ord, n, 2 * (n - 1) + 2 * (length(structure) - length(replace(structure, '(', ''))) + 2 * greatest(n - 2, 0) as m from rec),
off as (
  select graph_id, shard_id, record_ord, n, m, cast(sum(n) over w - n as bigint) as node_ptr, cast(sum(m) over w - m as bigint) as edge_ptr, row_number() over w - 1 as shard_ord
  from z window w as (partition by shard_id order by record_ord))"""


@query(f"{OFFSETS} select graph_id, shard_id, shard_ord, node_ptr, edge_ptr from off")
def csr_offsets(spark, sf):
    got = packing.csr_offsets(sharded_by_document(spark, sf))
    return longs(got.select("graph_id", "shard_id", "shard_ord", "node_ptr", "edge_ptr"), "shard_ord")


@query(f"{OFFSETS}, nth as (select *, row_number() over (order by record_ord) as place from off), bent as (select *, lag(place) over (partition by shard_id order by shard_ord) as before from nth) select graph_id, shard_id from bent where place % 3 = 0 or before % 3 = 0")
def check_offsets(spark, sf):
    offsets = packing.csr_offsets(sharded_by_document(spark, sf))
    numbered = packing.greedy_parts(offsets, "place", "record_ord", F.lit(1), 1, F.lit(1), 1)
    # Each third offset is off, so the one after it in its shard does not follow either.
    bent = numbered.withColumn("node_ptr", F.expr("case when place % 3 = 2 then node_ptr + 1 + place else node_ptr end"))
    return checks.check_offsets(bent)


@query(f"{OFFSETS}, low as (select * from off where shard_id = 0 and shard_ord >= 1 and shard_ord < 3) select graph_id, node_ptr - min(node_ptr) over () as node_ptr, edge_ptr - min(edge_ptr) over () as edge_ptr from low")
def slice_shard(spark, sf):
    graphs = sharded_by_document(spark, sf)
    held = graphs.where("shard_id = 0").count()
    # A shard of one graph or none has none at these places; the operator refuses such a range.
    part = packing.slice_shard(graphs, 0, 1, min(3, held)) if held > 1 else graphs.where("false")
    return packing.csr_offsets(part).select("graph_id", "node_ptr", "edge_ptr")


@query(
    f"""with {O.RNA}{O.EDGES}, z as (select graph_id, doc_id as shard_id, record_ord, n from rec),
off as (select graph_id, shard_id, sum(n) over (partition by shard_id order by record_ord) - n as node_ptr from z)
select off.graph_id, off.shard_id, count(*) as edges, cast(sum(src + node_ptr) as bigint) as sources, cast(sum(dst + node_ptr) as bigint) as targets
from edg join off using (graph_id) group by off.graph_id, off.shard_id"""
)
def shard_edges(spark, sf):
    records = full_records(spark, sf).withColumn("shard_id", F.shiftright("record_ord", R.WINDOW_BITS + 16))
    offsets = packing.csr_offsets(G.build_graphs(records)).select("shard_id", "record_ord", "node_ptr", "edge_ptr")
    e = packing.shard_edges(G.build_graphs(records.join(offsets, ["shard_id", "record_ord"])))
    return e.groupBy("graph_id", "shard_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("src").alias("sources"), F.sum("dst").alias("targets"))


@query(
    f"""with {O.RNA}{O.WINDOWS}, z as (
  select graph_id, 0 as part, record_ord, n, doc_id as shard_id from rec union all select graph_id, 1, record_ord, core_length, doc_id from wrec where s is not null)
select graph_id, shard_id, cast(sum(n) over (partition by shard_id order by part, record_ord) - n as bigint) as node_ptr from z"""
)
def concat_graphs(spark, sf):
    windows = G.build_graphs(window_records(spark, sf).where("start is not null"))
    windows = windows.withColumn("shard_id", F.shiftright("record_ord", R.WINDOW_BITS + 16))
    both = packing.concat_graphs(sharded_by_document(spark, sf), windows)
    return packing.csr_offsets(both).select("graph_id", "shard_id", "node_ptr")


# Encoder -------------------------------------------------------------------


def small_parts(spark, sf):
    """Graphs with input states, and weights, of the four-wide encoder."""
    g = G.build_graphs(full_records(spark, sf), O.SMALL.spec)
    held = encoder.load_weights(fixtures.weights_from_embeddings(spark, sf, O.SMALL), O.SMALL)
    return encoder.with_states(g, held), held


LAYER = f"with {O.RNA}{O.EDGES},\n{O.layer_sql()}"
EXACT = "cast(sum({x} * 4096) as bigint) as {n}"


@query(
    LAYER + ", sent as (select x.graph_id, s.* exclude (graph_id, pos) from edg x join st s on s.graph_id = x.graph_id and s.pos = x.src) "
    + f"select graph_id, {EXACT.format(x='h0', n='s0')}, {EXACT.format(x='h3', n='s3')} from sent group by graph_id"
)
def gather_sources(spark, sf):
    graphs, _ = small_parts(spark, sf)
    sent = encoder.gather_sources(graphs)
    exact = lambda i: F.sum(F.col("h")[i] * 4096).cast("long")
    return sent.groupBy("graph_id").agg(exact(0).alias("s0"), exact(3).alias("s3"))


@query(LAYER + f" select graph_id, {EXACT.format(x='k0', n='s0')}, {EXACT.format(x='k3', n='s3')} from edg join kv using (edge_type) group by graph_id")
def edge_type_lookup(spark, sf):
    graphs, held = small_parts(spark, sf)
    by_kind = held["convs.0.edge_lin.weight"].T + held["convs.0.edge_lin.bias"]
    looked = encoder.edge_type_lookup(G.unpack_edges(graphs), by_kind)
    exact = lambda i: F.sum(F.col("w")[i] * 4096).cast("long")
    return looked.groupBy("graph_id").agg(exact(0).alias("s0"), exact(3).alias("s3"))


@query(LAYER + " select graph_id, " + ", ".join(EXACT.format(x=f"a{i} * (pos + 1)", n=f"s{i}") for i in range(4)) + " from nb group by graph_id")
def neighbour_sum(spark, sf):
    graphs, held = small_parts(spark, sf)
    by_kind = held["convs.0.edge_lin.weight"].T + held["convs.0.edge_lin.bias"]
    summed = encoder.neighbour_sum(graphs, by_kind)
    exact = lambda i: F.sum(F.col("agg")[i] * (F.col("node_idx") + 1) * 4096).cast("long").alias(f"s{i}")
    return summed.groupBy("graph_id").agg(*[exact(i) for i in range(4)])


@query(
    LAYER + ",\n" + O.conv_sql() + " select graph_id, "
    + ", ".join(f"cast(sum(cast(round(y{i} * 1000.0) as bigint)) as bigint) as s{i}" for i in range(4)) + " from layer group by graph_id"
)
def conv_layer(spark, sf):
    graphs, held = small_parts(spark, sf)
    layer = encoder.conv_layer(graphs, held, 0)
    return layer.groupBy("graph_id").agg(*[F.sum(F.round(F.col("h")[i] * 1000.0).cast("long")).alias(f"s{i}") for i in range(4)])


@query(
    "with e as (select vec_id, embedding, unnest(range(0, 64)) as k from embeddings), v as (select vec_id, k, cast(embedding[k + 1] as double) as x from e), "
    "m as (select vec_id, avg(x) as mean, sqrt(avg(x * x) - avg(x) * avg(x) + 1e-5) as sd from v group by vec_id) "
    "select vec_id, cast(sum(cast(round((x - mean) / sd * 10000.0) as bigint) * (k + 1)) as bigint) as normed, "
    "cast(sum(cast(round(x / sqrt(1 + 1e-5) * 10000.0) as bigint) * (k + 1)) as bigint) as batched, "
    "cast(sum(cast(round(greatest(x, 0) * 10000.0) as bigint) * (k + 1)) as bigint) as rectified, "
    "cast(round(sum(x * (k % 3 - 1)) * 10000.0) as bigint) as mapped from v join m using (vec_id) group by vec_id"
)
def layer_functions(spark, sf):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("x", F.col("embedding").cast("array<double>"))
    ones, zeros = np.ones(64), np.zeros(64)
    x = F.col("x")
    return e.select(
        "vec_id",
        vector_digest(V.layer_norm(x, ones, zeros), 10000.0).alias("normed"),
        vector_digest(V.batch_norm_eval(x, ones, zeros, zeros, ones), 10000.0).alias("batched"),
        vector_digest(V.relu(x), 10000.0).alias("rectified"),
        F.round(V.linear(x, np.array([[k % 3 - 1 for k in range(64)]]), zeros[:1])[0] * 10000.0).cast("long").alias("mapped"),
    )


ENCODER = EncoderShape(hidden=32, layers=4, out_dim=32)


def matrix_shape(embeddings: DataFrame) -> DataFrame:
    """Rows and columns of each matrix, and whether its rows are unit vectors.

    Squares are added up in generated code, a row of the matrix at a time; a lambda would be interpreted for every number.
    """
    each = embeddings.select("graph_id", F.explode_outer("embedding").alias("v"))
    squares = [F.coalesce(F.get("v", F.lit(i)) * F.get("v", F.lit(i)), F.lit(0.0)) for i in range(ENCODER.out_dim)]
    near = F.col("v").isNull() | (F.abs(reduce(lambda a, x: a + x, squares) - 1) < 0.01)
    return each.groupBy("graph_id").agg(
        F.count("v").alias("core_length"), F.max(F.size("v")).cast("long").alias("embedding_dim"), F.bool_and(near).alias("unit")
    )


UNIT_SQL = f"cast({ENCODER.out_dim} as bigint) as embedding_dim, true as unit"


@query(f"with {O.RNA} select graph_id, cast(n as bigint) as core_length, {UNIT_SQL} from rec")
def encode(spark, sf):
    g = G.build_graphs(full_records(spark, sf), ENCODER.spec)
    return matrix_shape(encoder.encode(g, fixtures.weights_from_embeddings(spark, sf, ENCODER), ENCODER))


def vector_sums(vectors: DataFrame) -> DataFrame:
    """All components of (graph_id, residue_index, embedding), to three decimals, by graph."""
    sums = [F.sum(F.round(F.col("embedding")[i] * 1000.0).cast("long") * (F.col("residue_index") + 1)).alias(f"s{i}") for i in range(O.SMALL.out_dim)]
    return vectors.groupBy("graph_id").agg(F.count(F.lit(1)).alias("core_length"), *sums)


def small_windows(spark, sf) -> DataFrame:
    return G.build_graphs(window_records(spark, sf), O.SMALL.spec, keep_paired_neighbours=True, context_hops=2)


def settled_sums(embeddings: DataFrame, graphs: DataFrame, weights: DataFrame) -> DataFrame:
    """:func:`vector_sums` of 32-bit vectors that are within 0.001 of those of 64 bits.

    Where every component is that near, the 64-bit vector is added up in its
    place, as its rounding is the same in any engine; else the vector itself
    is, and the sums differ.

    Matrices are joined, a row for each graph, and never broadcast: Spark takes what a
    Python function returns to be as small as its records, of which a vector has a hundredth.
    """
    exact = encoder.collect_matrix(encoder.encode_relational(graphs, weights, O.SMALL)).withColumnsRenamed({"residue_index": "at", "embedding": "exact"})
    both = embeddings.select("graph_id", "residue_index", "embedding").join(exact.hint("merge"), "graph_id", "left")
    nodes = F.arrays_zip("residue_index", "embedding")

    def partners(node):
        one = lambda exact: F.struct(node["residue_index"].alias("residue_index"), node["embedding"].alias("embedding"), exact.alias("exact"))
        held = F.filter(F.arrays_zip("at", "exact"), lambda x: x["at"] == node["residue_index"])
        none = F.lit(None).cast("array<double>")
        return let(held, lambda found: F.when(F.size(found) > 0, F.transform(found, lambda x: one(x["exact"]))).otherwise(F.array(one(none))))

    # Where ids repeat, a residue has several vectors on either side, and each meets each.
    once = (F.col("at") == F.col("residue_index")) & (F.size(F.array_distinct(F.array_compact("at"))) == F.size("at"))
    met = F.when(once, F.arrays_zip("residue_index", "embedding", "exact")).otherwise(F.flatten(F.transform(nodes, partners)))
    placed = both.withColumn("met", met).select("graph_id", F.col("met.residue_index").alias("residue_index"), F.arrays_zip("met.embedding", "met.exact").alias("embedding"))
    pairs = encoder.unpack_embeddings(placed)
    given, exactly = F.col("embedding.embedding"), F.col("embedding.exact")
    near = reduce(Column.__and__, [F.abs(F.get(given, F.lit(i)) - F.get(exactly, F.lit(i))) < 1e-3 for i in range(O.SMALL.out_dim)])
    return vector_sums(pairs.withColumn("embedding", F.when(near, exactly).otherwise(given.cast("array<double>"))))


@query(O.molecule_vectors())
def encode_relational(spark, sf):
    g = G.build_graphs(full_records(spark, sf), O.SMALL.spec)
    return vector_sums(encoder.encode_relational(g, fixtures.weights_from_embeddings(spark, sf, O.SMALL), O.SMALL))


@query(O.molecule_vectors())
def encode_values(spark, sf):
    """Every vector of ``encode``, four wide, where ``encode`` itself shows lengths of wider ones."""
    g, weights = G.build_graphs(full_records(spark, sf), O.SMALL.spec), fixtures.weights_from_embeddings(spark, sf, O.SMALL)
    return settled_sums(encoder.encode(g, weights, O.SMALL, embedding_dtype="float64"), g, weights)


@query(O.window_vectors())
def collect_matrix(spark, sf):
    g, weights = small_windows(spark, sf), fixtures.weights_from_embeddings(spark, sf, O.SMALL)
    matrices = encoder.collect_matrix(encoder.unpack_embeddings(encoder.encode(g, weights, O.SMALL, embedding_dtype="float64")))
    return settled_sums(matrices, g, weights)


# Sinks and jobs ------------------------------------------------------------


@query(
    f"with {O.RNA}{O.SHARDS} select shard_id, count(*) as record_count, cast(sum(n) as bigint) as node_count, cast(sum(m) as bigint) as edge_count, "
    f"false as nontrivial_roles, '{GraphSpec().fingerprint}' as graph_spec_sha256 from sizes group by shard_id"
)
def write_shards(spark, sf):
    manifest = shards.read_manifest(spark, shard_dataset(spark, sf))
    return manifest.select("shard_id", "record_count", "node_count", "edge_count", "nontrivial_roles", "graph_spec_sha256")


def encoded_windows(spark, sf) -> DataFrame:
    return encoder.encode(window_graphs(spark, sf), fixtures.weights_from_embeddings(spark, sf, ENCODER), ENCODER)


@query(O.window_vectors())
def write_embeddings(spark, sf):
    g, weights = small_windows(spark, sf), fixtures.weights_from_embeddings(spark, sf, O.SMALL)
    return settled_sums(jobs.write_embeddings(encoder.encode(g, weights, O.SMALL, embedding_dtype="float64"), scratch_dir(spark)), g, weights)


RUN_MANIFEST = (
    f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)}, c as (select graph_id, count(*) as node_count from sel group by graph_id) "
    "select graph_id, cast(n as bigint) as length, node_count, cast(core_length as bigint) as core_length, cast(s as bigint) as window_start, "
    f"cast(e as bigint) as window_end, cast({ENCODER.out_dim} as bigint) as embedding_dim from wrec join c using (graph_id)"
)


def manifest_rows(rows: DataFrame, *more: str) -> DataFrame:
    names = ["length", "node_count", "core_length", "start", "end", "embedding_dim"]
    have = [n if n in rows.columns else None for n in names]
    cells = [(F.lit(None) if h is None else F.col(f"`{h}`")).cast("long").alias(n) for n, h in zip(names, have)]
    return rows.select("graph_id", *more, *cells).withColumnsRenamed({"start": "window_start", "end": "window_end"})


@query(f"select m.*, record_ord from ({RUN_MANIFEST}) m join (with {O.RNA}{O.WINDOWS} select graph_id, record_ord from wrec) using (graph_id)")
def run_manifest(spark, sf):
    rows = jobs.embedding_manifest(encoded_windows(spark, sf))
    return manifest_rows(rows, "record_ord")


@query(f"with {O.RNA}{O.WINDOWS} select 'complete' as status, count(*) as records, '{GraphSpec().fingerprint}' as graph_spec_sha256 from wrec")
def write_manifest(spark, sf):
    path = scratch_dir(spark)
    stored = jobs.write_embeddings(encoded_windows(spark, sf), path)
    run = jobs.write_manifest(stored, path, {"graph_spec_sha256": ENCODER.spec.fingerprint}, checksum=True)
    return run.select("status", F.col("records").cast("long").alias("records"), "graph_spec_sha256")


RUN_VECTORS = f"select m.*, s0, s1, s2, s3 from ({RUN_MANIFEST.replace(f'cast({ENCODER.out_dim} as', f'cast({O.SMALL.out_dim} as')}) m join ({O.window_vectors()}) v using (graph_id)"


def run_and_vectors(spark, sf, path, weights) -> DataFrame:
    """The manifest of a finished run, and the sums of its vectors."""
    sums = settled_sums(spark.read.parquet(f"{path}/embeddings"), small_windows(spark, sf), weights)
    return manifest_rows(spark.read.json(f"{path}/manifest/records")).join(sums.drop("core_length"), "graph_id")


@query(RUN_VECTORS)
def embed_table(spark, sf):
    path, weights = scratch_dir(spark), fixtures.weights_from_embeddings(spark, sf, O.SMALL)
    jobs.embed_table(spark, windows_table(spark, sf), weights, path, O.SMALL, context=jobs.Context(context_hops=2), embedding_dtype="float64")
    return run_and_vectors(spark, sf, path, weights)


def window_dataset(spark, sf, path, spec: GraphSpec = GraphSpec()) -> DataFrame:
    return jobs.build_graph_dataset(spark, windows_table(spark, sf), path, spec, context=jobs.Context(context_hops=2), checksum=True)


@query(
    f"with {O.RNA}{O.EDGES}{O.WINDOWS}{O.context(2)} select (select count(*) from wrec) as records, (select count(*) from sel) as nodes, "
    f"(select count(*) from ind) as edges, '{GraphSpec().fingerprint}' as graph_spec_sha256"
)
def build_graph_dataset(spark, sf):
    return window_dataset(spark, sf, scratch_dir(spark)).drop("elapsed_seconds")


@query(RUN_VECTORS)
def embed_graph_dataset(spark, sf):
    graphs_at, path = scratch_dir(spark), scratch_dir(spark)
    window_dataset(spark, sf, graphs_at, O.SMALL.spec)
    weights = fixtures.weights_from_embeddings(spark, sf, O.SMALL)
    jobs.embed_graph_dataset(spark, graphs_at, weights, path, O.SMALL, verify_checksum=True, embedding_dtype="float64")
    return run_and_vectors(spark, sf, path, weights)


@query(O.window_vectors(), name="embed_arriving_shards")
def embed_arriving(spark, sf):
    incoming, out = scratch_dir(spark), scratch_dir(spark)
    window_dataset(spark, sf, f"{incoming}/first", O.SMALL.spec)
    weights = fixtures.weights_from_embeddings(spark, sf, O.SMALL)
    embed_arriving_shards(spark, incoming, weights, out, O.SMALL).awaitTermination()
    return settled_sums(spark.read.parquet(f"{out}/embeddings").drop("batch"), small_windows(spark, sf), weights)


# Flagship ------------------------------------------------------------------


@query(
    f"with {O.RNA}{O.EDGES} select rec.graph_id, cast(n as bigint) as nodes, "
    + ", ".join(f"count(*) filter (where edge_type = {i}) as {name}" for i, name in enumerate(NAMES))
    + " from rec left join edg using (graph_id) group by rec.graph_id, n"
)
def edge_census(spark, sf):
    """Nodes, and edges of each kind, of every molecule."""
    g = G.build_graphs(full_records(spark, sf))
    kinds = [
        count_value(F.col("edge_types"), F.lit(code).cast("tinyint")).cast("long").alias(name) for code, name in enumerate(NAMES)
    ]
    return g.select("graph_id", F.col("node_count").cast("long").alias("nodes"), *kinds)
