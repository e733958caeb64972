"""Named queries of the engine's operators over the project's tables, with equivalent SQL.

``documents`` holds the articles with their Markdown links, ``stack_file`` the code files,
``tokenized_graph`` the graph and ``placement`` the packs; logits are read from
``embeddings``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import contentstats as cs
from corpusloom.functions import identifiers as idn
from corpusloom.functions import imports as imp
from corpusloom.functions import links as lnk
from corpusloom.functions import textclean as txt
from corpusloom.operators import codegraph, corpus, detectors, graph, logits, masks, nodesplits, packs, traversal
from corpusloom.operators.components import connected_components
from corpusloom.session import materialize
from corpusloom.sources import sinks
from corpusloom.sources import text as src
from corpusloom.streaming import context as ctx
from corpusloom.tables import cleaned_split, latest_files, table, trimmed, valid_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# ------------------------------------------------------------------------------ fixtures


def nodes(spark: SparkSession, d: str) -> DataFrame:
    columns = ("node_id", "raw_identifier", "char_count", "import_count", "links_in_repo", "outgoing", "incoming", "tok_shard_idx", "tok_offset_bytes", "tok_len", "split")
    return valid_lines(table(spark, d, "tokenized_graph"), *columns).withColumnRenamed("normed_identifier", "id")


def lines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The valid lines' wanted columns as a table, for plans that read them more than once."""
    return materialize(nodes(spark, d).select("id", *columns), "valid-lines")


def edges_of(valid: DataFrame) -> DataFrame:
    listed = valid.select(F.col("id").alias("src"), F.explode("outgoing").alias("dst"))
    return listed.select("src", trimmed("dst").alias("dst")).where("dst <> ''").distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(nodes(spark, d).select("id", "outgoing"))


def linked(spark: SparkSession, d: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with the wanted columns, edges by identifier), from one table."""
    valid = lines(spark, d, *columns, "outgoing")
    return valid.select("id", *columns), edges_of(valid)


def id_edges_of(valid: DataFrame) -> DataFrame:
    e = edges_of(valid).join(valid.select(F.col("id").alias("src"), F.col("node_id").alias("a")), "src")
    return e.join(valid.select(F.col("id").alias("dst"), F.col("node_id").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def id_edges(spark: SparkSession, d: str) -> DataFrame:
    return id_edges_of(lines(spark, d, "node_id", "outgoing"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Packs cleaned: one row per pack and document, of known documents with tokens."""
    rows = table(spark, d, "placement").where("doc_id is not null and pack_id is not null").groupBy("pack_id", "doc_id").agg(F.min("pos").alias("pos"), F.max("effective_len").alias("effective_len"))
    known = nodes(spark, d).where("tok_len > 0").select(F.col("node_id").alias("doc_id"), "id", "raw_identifier", "tok_len")
    return rows.join(known, "doc_id").withColumn("length", F.least("tok_len", F.col("effective_len").cast("bigint"))).where("length > 0")


def code_files(spark: SparkSession, d: str, **derived: Column) -> DataFrame:
    """One row per file with text: repository, path and what is derived from its ``content``."""
    rows = latest_files(
        table(spark, d, "stack_file", "file_id") if derived else table(spark, d, "stack_file"), repo=F.lower(F.trim("max_stars_repo_name")), path=F.col("max_stars_repo_path"), ord=F.col("file_id"),
        _text=F.coalesce(F.col("content") != "", F.lit(False)), **derived,
    )
    return rows.where("repo <> '' and path <> '' and _text").drop("_text")


def row_logits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "logit")).withColumn("logit", F.col("logit").cast("double"))


_T = "' ' || chr(9)"
_V = f"""valid as (select *, node_id as nid from (select *, trim(normed_identifier, {_T}) as id,
  row_number() over (partition by trim(normed_identifier, {_T}) order by line_no desc) as rn from tokenized_graph where normed_identifier is not null) where rn = 1)"""
_E = f"""{_V}, edge as (select distinct id as src, trim(dst, {_T}) as dst from (select id, unnest(outgoing) as dst from valid) where trim(dst, {_T}) <> '')"""
_IE = f"""{_E}, inner_edge as (select e.src, e.dst from edge e where e.src in (select id from valid) and e.dst in (select id from valid)),
 idedge as (select a.node_id as src, b.node_id as dst from inner_edge e join valid a on a.id = e.src join valid b on b.id = e.dst)"""
_UE = f"""{_IE}, ue as (select distinct a, b from (select src as a, dst as b from inner_edge union all select dst, src from inner_edge) where a <> b)"""
_P = f"""{_V}, placed as (select p.pack_id, p.doc_id, p.pos, v.id, v.raw_identifier, v.tok_len, least(v.tok_len, p.effective_len) as length from
  (select pack_id, doc_id, min(pos) as pos, max(effective_len) as effective_len from placement where doc_id is not null and pack_id is not null group by all) p
  join valid v on v.node_id = p.doc_id and v.tok_len > 0 where least(v.tok_len, p.effective_len) > 0)"""
_F = """files as (select file_id, lower(trim(max_stars_repo_name)) as repo, max_stars_repo_path as path, content from
  (select *, row_number() over (partition by file_id order by loaded_at desc) as rn from stack_file where file_id is not null)
  where rn = 1 and trim(max_stars_repo_name) <> '' and max_stars_repo_path <> '' and content <> '')"""
_L = "lg as (select vec_id as row_id, i - 1 as token_id, cast(embedding[i] as double) as logit from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))"
_SM = f"""{_L}, sm as (select *, exp(logit - m) / sum(exp(logit - m)) over (partition by row_id) as p from (select *, max(logit) over (partition by row_id) as m from lg))"""


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9\\-_]', '_', 'g'), '__+', '_', 'g'), '_')"


def _norm(x: str) -> str:
    canonical = f"replace(trim(lower({x})), ' ', '_')"
    return f"substr({_squeeze(canonical)}, 1, 193) || '_' || substr(md5({canonical}), 1, 6)"


# ------------------------------------------------------------------------------- graph


@query(f"""with {_E}, o as (select src as id, string_agg(dst, '|' order by dst) as outgoing, count(*) as n from edge group by 1),
 i as (select dst as id, string_agg(src, '|' order by src) as incoming, count(*) as n from edge where dst in (select id from valid) group by 1)
 select v.id, v.char_count, coalesce(o.outgoing, '') as outgoing, coalesce(i.incoming, '') as incoming, coalesce(o.n, 0) + coalesce(i.n, 0) as links
 from valid v left join o using (id) left join i using (id) where coalesce(o.n, 0) + coalesce(i.n, 0) >= 2""")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with sorted adjacency and at least two links."""
    full = graph.adjacency(*linked(spark, d, "char_count")).withColumn("links", (F.size("outgoing") + F.size("incoming")).cast("bigint")).where("links >= 2")
    return full.select("id", "char_count", F.array_join("outgoing", "|").alias("outgoing"), F.array_join("incoming", "|").alias("incoming"), "links")


@query(f"""with {_V}, l as (select id, unnest(range(1, len(outgoing) + 1)) as i, outgoing from valid)
 select id, i - 1 as pos, outgoing[i] as neighbour from l where outgoing[i] in (select id from valid)""")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(nodes(spark, d).select("id", "outgoing"), "outgoing").select("id", F.col("pos").cast("bigint").alias("pos"), "neighbour")


@query(f"with {_IE}, n as (select count(*) as n from valid), m as (select count(*) as m from inner_edge) select n.n as n_nodes, m.m as n_edges, round(m.m / (n.n * (n.n - 1)), 12) as density from n, m")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    n, e = linked(spark, d)
    return graph.internal_edges(n, e).agg(F.count("*").alias("n_edges")).withColumn("n_nodes", F.lit(n.count()).cast("bigint")).select(
        "n_nodes", "n_edges", F.round(F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))), 12).alias("density")
    )


@query(f"with {_E} select dst as target, count(*) as n_sources from edge where dst not in (select id from valid) group by 1")
def dangling_targets(spark: SparkSession, d: str) -> DataFrame:
    n, e = linked(spark, d)
    known = n.select(F.col("id").alias("dst"))
    return e.join(known, "dst", "left_anti").groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n_sources"))


_DEG = f"""{_IE}, deg as (select v.id, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) as in_degree from valid v
 left join (select src, count(*) as n from inner_edge group by 1) o on o.src = v.id left join (select dst, count(*) as n from inner_edge group by 1) i on i.dst = v.id)"""


@query(f"""with {_DEG} select count(*) as n_nodes, round(avg(out_degree), 6) as mean_out, max(out_degree) as max_out, median(out_degree) as median_out,
 round(avg(in_degree), 6) as mean_in, max(in_degree) as max_in, median(in_degree) as median_in, round(100.0 * avg(case when in_degree = 0 then 1 else 0 end), 6) as zero_in_pct from deg""")
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(*linked(spark, d))
    half = lambda c: F.percentile(c, F.lit(0.5))
    return deg.agg(
        F.count("*").alias("n_nodes"), F.round(F.avg("out_degree"), 6).alias("mean_out"), F.max("out_degree").alias("max_out"), half("out_degree").alias("median_out"),
        F.round(F.avg("in_degree"), 6).alias("mean_in"), F.max("in_degree").alias("max_in"), half("in_degree").alias("median_in"),
        F.round(100 * F.avg((F.col("in_degree") == 0).cast("int")), 6).alias("zero_in_pct"),
    )


@query(f"with {_DEG} select case when in_degree = 0 then 0 else cast(pow(2, floor(log2(in_degree))) as bigint) end as bucket, count(*) as n from deg group by 1")
def degree_hist_pow2(spark: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(*linked(spark, d))
    return deg.groupBy(cs.pow2_low(F.col("in_degree")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"with {_DEG}, w as (select greatest(max(out_degree), 1) / 50.0 as w from deg) select cast(least(floor(out_degree / w), 49) as int) as bin, count(*) as n from deg, w group by 1")
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    deg = materialize(graph.degrees(*linked(spark, d)), "degrees")
    return sinks.degree_histogram(deg, "out_degree").select("bin", "n")


@query(f"with {_DEG} select id, in_degree from deg order by in_degree desc, id limit 10")
def degree_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*linked(spark, d)).select("id", "in_degree").orderBy(F.desc("in_degree"), "id").limit(10)


@query(f"with {_UE} select v.id, count(u.b) as degree from valid v left join ue u on u.a = v.id group by 1")
def undirected_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected_degrees(*linked(spark, d))


def _core_sql(rounds: int, least: int) -> str:
    parts, last = [], "ue"
    for k in range(1, rounds + 1):
        parts.append(f"c{k} as (select e.a, e.b from {last} e where e.a in (select a from {last} group by 1 having count(*) >= {least}) and e.b in (select a from {last} group by 1 having count(*) >= {least}))")
        last = f"c{k}"
    return f"with {_UE}, {', '.join(parts)} select a as id, count(*) as degree from {last} group by 1"


@query(_core_sql(3, 3))
def kcore_three_rounds(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_core(*linked(spark, d), 3, rounds=3)


@query(_core_sql(40, 3).replace("select a as id, count(*) as degree from c40 group by 1", "select distinct a as id from c40"))
def kcore(spark: SparkSession, d: str) -> DataFrame:
    """Fixpoint of the pruning (the SQL unrolls more rounds than it takes)."""
    return graph.k_core(*linked(spark, d), 3)


@query(f"""with recursive {_IE}, lv(id, level) as (select node_id, 0 from valid where replace(lower(trim(split, {_T})), '-', '_') = 'val_random' union select e.dst, l.level + 1 from lv l join idedge e on e.src = l.id where l.level < 4)
 select id, min(level) as level from lv group by 1""")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    """Steps from the nodes of val_random, up to four."""
    valid = lines(spark, d, "node_id", "outgoing", "split")
    return graph.bfs_levels(id_edges_of(valid), valid.where(cleaned_split("split") == "val_random").select(F.col("node_id").alias("id")), 4)


@query(f"""with recursive {_UE}, up as (select a.node_id as a, b.node_id as b from ue join valid a on a.id = ue.a join valid b on b.id = ue.b),
 walk(id, label) as (select a, a from up union select u.b, w.label from walk w join up u on u.a = w.id where w.label < u.b)
 select id, min(label) as label from (select id, label from walk union all select a, a from up) group by 1""")
def wcc_labels(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(id_edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query()
def scc_labels(spark: SparkSession, d: str) -> DataFrame:
    """Strong components with their sizes, of two nodes or more."""
    labels = graph.strong_components(id_edges(spark, d))
    return labels.groupBy("label").agg(F.count("*").alias("n_nodes")).where("n_nodes > 1")


@query(f"""with {_P}, e as (select distinct src, dst from (select a.node_id as src, b.node_id as dst from (select id, trim(unnest(outgoing), {_T}) as t, node_id from valid) a join valid b on b.id = a.t))
 select a.pack_id, a.doc_id as src, b.doc_id as dst, a.pos as src_pos, b.pos as dst_pos from placed a join e on e.src = a.doc_id join placed b on b.pack_id = a.pack_id and b.doc_id = e.dst""")
def in_pack_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return corpus.pack_connectivity(placed(spark, d), id_edges(spark, d))


@query(f"with {_V} select replace(lower(trim(split, {_T})), '-', '_') as split, count(*) as n_nodes, cast(sum(tok_len) as bigint) as n_tokens from valid where trim(split, {_T}) <> '' group by 1")
def split_nodes_lookup(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select(cleaned_split("split").alias("split"), "tok_len").where("split is not null").groupBy("split").agg(F.count("*").alias("n_nodes"), F.sum("tok_len").alias("n_tokens"))


@query(f"with {_V} select id, node_id, tok_len from valid")
def graph_last_line_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokenized_graph").where("normed_identifier is not null").select(trimmed("normed_identifier").alias("id"), "node_id", "tok_len", "line_no")
    return graph.last_lines(rows, "id", "line_no").select("id", "node_id", "tok_len")


# -------------------------------------------------------------------------- identifiers


@query(f"select doc_id, {_norm('title')} as identifier from documents where title is not null")
def normalize_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title is not null").select("doc_id", idn.normalize_identifier("title").alias("identifier"))


_REPO = _squeeze("lower(translate(max_stars_repo_name, '/-', '__'))")


@query(f"select distinct max_stars_repo_name as name, {_REPO} || '_' || substr(md5({_REPO}), 1, 6) as identifier from stack_file where max_stars_repo_name is not null")
def normalize_repos(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stack_file").where("max_stars_repo_name is not null").select(F.col("max_stars_repo_name").alias("name")).distinct()
    return rows.select("name", idn.normalize_repository("name").alias("identifier"))


_PKG = _squeeze("lower(replace(m, '.', '_'))")


@query(f"select m as module, {_PKG} || '_' || substr(md5({_PKG}), 1, 6) as identifier from (select distinct unnest(imported_modules) as m from import_record) where m is not null")
def normalize_packages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "import_record").select(F.explode("imported_modules").alias("module")).where("module is not null").distinct()
    return rows.select("module", idn.normalize_package("module").alias("identifier"))


_GEN = "trim(regexp_replace(regexp_replace(replace(trim(lower(title)), ' ', '_'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"


@query(f"""select doc_id, substr({_GEN}, 1, 193) || '_' || substr(md5(title), 1, 6) as identifier, substr({_GEN}, 1, 193) as bare,
 (substr({_GEN}, 1, 193) || '_' || substr(md5(title), 1, 6)) = ({_norm('title')}) as same from documents where title is not null""")
def generation_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("title is not null").select("doc_id", "title", idn.generation_identifier("title").alias("identifier"))
    return rows.select("doc_id", "identifier", idn.strip_hash("identifier").alias("bare"), idn.hash_matches(idn.normalize_identifier("title"), "title").alias("same"))


@query("""select distinct max_stars_repo_path as path, trim(replace(replace(regexp_replace(max_stars_repo_path, '\\.py$', ''), '/', '.'), '\\', '.'), '.') as module,
 case when regexp_matches(max_stars_repo_path, '[^/.][^/]*?\\.[^./]+$') then lower(regexp_extract(max_stars_repo_path, '(\\.[^./]+)$', 1)) else '<none>' end as ext,
 regexp_matches(lower(max_stars_repo_path), '(^|/)tests?/|(^|/)test_[^/]*$|_test\\.py$') as is_test,
 (max_stars_repo_path like '%.py' or max_stars_repo_path like '%.pyw') as is_python from stack_file where max_stars_repo_path is not null""")
def path_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stack_file").where("max_stars_repo_path is not null").select(F.col("max_stars_repo_path").alias("path")).distinct()
    return rows.select("path", idn.module_of_path("path").alias("module"), idn.extension("path").alias("ext"), idn.is_test_path("path").alias("is_test"), idn.is_python_file("path").alias("is_python"))


@query(f"""with {_V} select raw_identifier as raw, case when contains(raw_identifier, ':') then substr(raw_identifier, strpos(raw_identifier, ':') + 1) else raw_identifier end as span_key
 from valid where raw_identifier is not null""")
def code_span_keys(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("raw_identifier is not null").select(F.col("raw_identifier").alias("raw"), idn.span_key("raw_identifier", "python").alias("span_key"))


@query("""select repo, list_reduce(list_prepend(0::bigint, [cast(ascii(c) as bigint) for c in string_split(repo, '')]), lambda h, x: (h * 131 + x) & 4294967295) % 256 as bucket
 from (select distinct trim(repo_name, ' ' || chr(9)) as repo from import_record where trim(repo_name, ' ' || chr(9)) <> '')""")
def repo_hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "import_record").select(trimmed("repo_name").alias("repo")).where("repo <> ''").distinct()
    return rows.select("repo", (idn.det_hash32("repo") % 256).alias("bucket"))


# ------------------------------------------------------------------------- links, imports

_LINKS = r"""select doc_id, unnest(regexp_extract_all(text, '\[[^!\]]*?\]\((.*?)\)', 1)) as t from documents"""


@query(f"select doc_id, string_agg(i, '|' order by i) as links from (select distinct doc_id, {_norm('t')} as i from ({_LINKS})) group by 1")
def md_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id").select("doc_id", lnk.link_identifiers(F.col("text")).alias("l"))
    return rows.where(F.size("l") > 0).select("doc_id", F.array_join("l", "|").alias("links"))


@query(f"""with e as (select distinct doc_id, {_norm('t')} as dst from ({_LINKS})), n as (select min(doc_id) as doc_id, {_norm('title')} as id from documents where title is not null group by 2)
 select e.doc_id as src_doc, n.doc_id as dst_doc, e.dst as target from e left join n on n.id = e.dst""")
def md_link_edges(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    e = docs.select("doc_id", F.explode(lnk.link_identifiers(F.col("text"))).alias("target"))
    known = docs.where("title is not null").groupBy(idn.normalize_identifier("title").alias("target")).agg(F.min("doc_id").alias("dst_doc"))
    return e.join(known, "target", "left").select(F.col("doc_id").alias("src_doc"), "dst_doc", "target")


@query(r"""select doc_id, regexp_extract(x, '^\[([^\]]*)\]', 1) as label, regexp_extract(x, '\(([^)]*)\)$', 1) as target from
 (select doc_id, unnest(regexp_extract_all(text, '(\[[^\]]{1,80}\]\([^)]{1,100}\))', 1)) as x from documents)""")
def display_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(lnk.display_links(F.col("text"))).alias("l")).select("doc_id", "l.label", "l.target")


_EXT = ", ".join(f"'{m}'" for m in imp.EXTERNAL_MODULES)
_FILE_IMPORTS = rf"""{_F}, fi as (select distinct file_id, repo, path, trim(m) as import from (
 select file_id, repo, path, unnest(list_concat(regexp_extract_all(content, '(?m)^\s*from\s+([^\s;]+)\s+import', 1), regexp_extract_all(content, '(?m)^\s*import\s+([^\s;]+)', 1))) as m from files)
 where trim(m) like '.%' or split_part(trim(m), '.', 1) not in ({_EXT}))"""


@query(f"with {_FILE_IMPORTS} select file_id, import from fi")
def py_file_imports(spark: SparkSession, d: str) -> DataFrame:
    return code_files(spark, d, imports=imp.file_imports(F.col("content"))).select("file_id", F.explode("imports").alias("import"))


@query()
def py_parsed_imports(spark: SparkSession, d: str) -> DataFrame:
    """All absolute imports with names and candidate paths (multi-line statements included)."""
    rows = code_files(spark, d, pairs=imp.parsed_imports(F.col("content"))).select("file_id", F.explode("pairs").alias("p"))
    return rows.select("file_id", "p.module", "p.name", F.array_join(imp.candidate_paths(F.col("p.module"), F.col("p.name")), "|").alias("candidates")).distinct()


@query("""select distinct m as module, replace(m, '.', '/') || '.py' || '|' || replace(m, '.', '/') || '/__init__.py' as candidates
 from (select unnest(imported_modules) as m from import_record) where m is not null""")
def module_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "import_record").select(F.explode("imported_modules").alias("module")).where("module is not null").distinct()
    return rows.select("module", F.array_join(imp.candidate_paths(F.col("module"), F.lit("")), "|").alias("candidates"))


_MODS = f"""{_FILE_IMPORTS}, raw as (select repo, path, file_id, trim(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '.') as module from files),
 mods as (select repo, module, arg_max(path, (file_id, path)) as path from (select repo, module, path, file_id from raw union all
   select repo, regexp_replace(module, '(^|\\.)__init__$', ''), path, file_id from raw where path like '%/__init__.py') group by 1, 2),
 asked as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, import like '.%' as relative, length(regexp_extract(import, '^(\\.+)', 1)) as dots, regexp_replace(import, '^\\.+', '') as rest from fi),
 based as (select *, array_to_string(list_slice(list_filter(string_split(dir, '/'), lambda x: x <> ''), 1, greatest(len(list_filter(string_split(dir, '/'), lambda x: x <> '')) - (dots - 1), 0)), '.') as base from asked),
 want as (select repo, path, import, dir, relative, case when relative then concat_ws('.', nullif(base, ''), nullif(rest, '')) else import end as wanted from based),
 w as (select * from want where wanted <> ''),
 exact as (select w.*, m.path as target, 0 as rank from w join mods m on m.repo = w.repo and m.module = w.wanted),
 left_over as (select w.* from w where not exists (select 1 from exact e where e.repo = w.repo and e.path = w.path and e.import = w.import)),
 cand as (select l.*, m.path as target from left_over l join mods m on m.repo = l.repo and (m.module like l.wanted || '.%' or (not l.relative and l.wanted like m.module || '.%'))),
 ranked as (select repo, path, import, target, case when ends_with(target, replace(wanted, '.', '/') || '/__init__.py') then 1 when regexp_extract(target, '^(.*)/[^/]*$', 1) = dir then 2 else 3 end as rank from cand
   union all select repo, path, import, target, rank from exact),
 res as (select repo, path, import, target from (select *, row_number() over (partition by repo, path, import order by rank, target) as n from ranked where target <> path) where n = 1)"""


def _import_files(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("content")
    return materialize(code_files(spark, d, char_count=F.length(content), imports=imp.file_imports(content)), "file-imports")


@query(f"with {_MODS} select repo, path, import, target from res")
def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    files = _import_files(spark, d)
    asked = files.select("repo", "path", F.explode("imports").alias("import")).distinct()
    return codegraph.resolve_imports(files, asked, codegraph.module_table(files))


@query(f"""with {_MODS}, e as (select distinct repo || ':' || path as src, repo || ':' || target as dst from res),
 o as (select src as id, string_agg(dst, '|' order by dst) as outgoing, count(*) as n from e group by 1), i as (select dst as id, string_agg(src, '|' order by src) as incoming, count(*) as n from e group by 1)
 select f.id, coalesce(outgoing, '') as outgoing, coalesce(incoming, '') as incoming, coalesce(o.n, 0) + coalesce(i.n, 0) as links_in_repo
 from (select distinct repo || ':' || path as id from files where repo in (select repo from files group by 1 having count(*) >= 2)) f left join o using (id) left join i using (id)
 where coalesce(o.n, 0) + coalesce(i.n, 0) >= 2""")
def code_graph(spark: SparkSession, d: str) -> DataFrame:
    files = _import_files(spark, d)
    asked = files.select("repo", "path", F.explode("imports").alias("import")).distinct()
    resolved = codegraph.resolve_imports(files, asked, codegraph.module_table(files))
    sized = files.select("repo", "path", "char_count", F.size("imports").alias("import_count"))
    out = codegraph.code_graph(sized, resolved)
    return out.select("id", F.array_join("outgoing", "|").alias("outgoing"), F.array_join("incoming", "|").alias("incoming"), F.col("links_in_repo").cast("bigint").alias("links_in_repo"))


@query(f"""with {_DEG}, s as (select d.*, v.import_count, v.raw_identifier from deg d join valid v using (id) where contains(v.raw_identifier, ':'))
 select count(*) as n_nodes, count(distinct split_part(raw_identifier, ':', 1)) as n_repos, round(avg(import_count), 6) as mean_imports, median(import_count) as median_imports,
 round(100.0 * avg(case when coalesce(import_count, 0) = 0 then 1 else 0 end), 6) as zero_import_pct, round(avg(out_degree), 6) as mean_out, round(100.0 * avg(case when regexp_matches(lower(split_part(raw_identifier, ':', 2)), '(^|/)tests?/|(^|/)test_[^/]*$|_test\\.py$') then 1 else 0 end), 6) as test_pct from s""")
def code_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    n, e = linked(spark, d, "raw_identifier", "import_count")
    s = n.where(F.contains("raw_identifier", F.lit(":"))).join(graph.degrees(n.select("id"), e), "id")
    path = F.split_part("raw_identifier", F.lit(":"), F.lit(2))
    return s.agg(
        F.count("*").alias("n_nodes"), F.countDistinct(F.substring_index("raw_identifier", ":", 1)).alias("n_repos"), F.round(F.avg("import_count"), 6).alias("mean_imports"),
        F.percentile("import_count", F.lit(0.5)).alias("median_imports"), F.round(100 * F.avg((F.coalesce("import_count", F.lit(0)) == 0).cast("int")), 6).alias("zero_import_pct"),
        F.round(F.avg("out_degree"), 6).alias("mean_out"), F.round(100 * F.avg(idn.is_test_path(path).cast("int")), 6).alias("test_pct"),
    )


@query(f"""with {_V} select max_stars_repo_name as repo, file_id, trim(normed_identifier, {_T}) as id from stack_file where content <> '' and max_stars_repo_name <> '' and max_stars_repo_path <> '' and trim(normed_identifier, {_T}) in (select id from valid)""")
def stack_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Code rows of graph nodes; repeated deliveries stay."""
    rows = table(spark, d, "stack_file").where("content <> '' and max_stars_repo_name <> '' and max_stars_repo_path <> ''")
    return rows.select(F.col("max_stars_repo_name").alias("repo"), "file_id", trimmed("normed_identifier").alias("id")).join(nodes(spark, d).select("id"), "id", "left_semi").select("repo", "file_id", "id")


@query("select file_id, length(content) as n, md5(case when length(content) > 2000 then substr(content, 1, 2000) || '...[truncated]' else content end) as h from stack_file where content is not null")
def sample_truncation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stack_file").where("content is not null").select("file_id", F.length("content").cast("bigint").alias("n"), "content")
    return src.truncated_sample(rows, chars=2000).select("file_id", "n", F.md5("content").alias("h"))


# ------------------------------------------------------------------------------ statistics

_STATS = """st as (select file_id, length(content) as chars, len(regexp_extract_all(content, '(\\S+)', 1)) as words,
 list_transform(case when lines[-1] = '' then list_slice(lines, 1, len(lines) - 1) else lines end, lambda x: length(x)) as ll,
 case when length(content) = 0 then 0.0 else 1 - length(regexp_replace(content, '[^\\p{L}\\p{N}_]', '', 'g')) / length(content) end as odd
 from (select file_id, content, string_split(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), chr(10)) as lines from files))"""


@query(f"with {_F}, {_STATS} select file_id, chars, words, len(ll) as n_lines, coalesce(list_max(ll), 0) as longest_line, round(coalesce(list_avg(ll), 0), 6) as mean_line, round(odd, 6) as odd_share from st")
def content_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = code_files(
        spark, d, chars=F.length("content").cast("bigint"), words=cs.word_count(F.col("content")).cast("bigint"), lines=cs.line_summary(F.col("content")), odd=cs.non_alnum_ratio(F.col("content"))
    )
    mean = F.when(F.col("lines.n") > 0, F.col("lines.total") / F.col("lines.n")).otherwise(0.0)
    return rows.select("file_id", "chars", "words", F.col("lines.n").alias("n_lines"), F.col("lines.longest").alias("longest_line"), F.round(mean, 6).alias("mean_line"), F.round("odd", 6).alias("odd_share"))


@query(f"""with {_F}, {_STATS} select count(*) as n_files, cast(sum(chars) as bigint) as total_chars, max(chars) as max_chars, cast(sum(words) as bigint) as total_words,
 round(100.0 * avg(case when chars < 200 then 1 else 0 end), 6) as tiny_pct, round(100.0 * avg(case when list_max(ll) > 1000 then 1 else 0 end), 6) as long_line_pct,
 round(100.0 * avg(case when odd > 0.35 then 1 else 0 end), 6) as odd_pct, max(words) as max_words, round(100.0 * avg(case when words > 0 and chars / words > 12 then 1 else 0 end), 6) as dense_pct, median(chars) as median_chars from st""")
def content_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the files, with the counters of suspicious ones."""
    s = code_files(spark, d, chars=F.length("content").cast("bigint"), words=cs.word_count(F.col("content")), longest=cs.longest_line(F.col("content")), odd=cs.non_alnum_ratio(F.col("content")))
    share = lambda c: F.round(100 * F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    return s.agg(
        F.count("*").alias("n_files"), F.sum("chars").alias("total_chars"), F.max("chars").alias("max_chars"), F.sum("words").alias("total_words"), share(F.col("chars") < 200).alias("tiny_pct"),
        share(F.col("longest") > 1000).alias("long_line_pct"), share(F.col("odd") > 0.35).alias("odd_pct"), F.max("words").cast("bigint").alias("max_words"),
        share((F.col("words") > 0) & (F.col("chars") / F.when(F.col("words") > 0, F.col("words")) > 12)).alias("dense_pct"), F.percentile("chars", F.lit(0.5)).alias("median_chars"),
    )


_HIST = f"with {_F}, h as (select cast(pow(2, floor(log2(length(content)))) as bigint) as low, count(*) as n from files group by 1)"


@query(f"{_HIST} select low || '-' || (2 * low - 1) as bucket, low, n from h")
def content_hist_pow2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("chars")
    return code_files(spark, d, chars=F.length("content").cast("bigint")).groupBy(cs.pow2_label(n).alias("bucket"), cs.pow2_low(n).alias("low")).agg(F.count("*").alias("n"))


@query(f"""{_HIST}, c as (select low, sum(n) over (order by low) as cum, sum(n) over () as total from h)
 select q, min(low) as low from c, (select unnest([0.5, 0.9, 0.99]::double[]) as q) where cum >= total * q group by 1""")
def hist_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return cs.histogram_quantiles(content_hist_pow2(spark, d), (0.5, 0.9, 0.99))


@query(f"""with {_F}, s as (select md5(trim(regexp_replace(substr(content, 1, 4096), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'))) as sig, count(*) as n from files group by 1)
 select cast(sum(n) as bigint) as n_files, cast(sum(n - 1) as bigint) as n_repeats, round(sum(n - 1) / sum(n), 9) as rate from s""")
def dup_signature_rate(spark: SparkSession, d: str) -> DataFrame:
    s = code_files(spark, d, sig=cs.content_signature(F.col("content"))).groupBy("sig").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("n_files"), F.sum(F.col("n") - 1).alias("n_repeats"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 9).alias("rate"))


@query("""with s as (select length(text) as c from documents order by md5(cast(doc_id as varchar)), doc_id limit 200)
 select (select count(*) from documents) as n_docs, avg(c) as mean_chars, round(avg(c) * (select count(*) from documents) / 4.0, 3) as estimated_tokens from s""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return corpus.estimate_tokens(table(spark, d, "documents"), 200)


# ----------------------------------------------------------------------------- splits


@query(f"with {_UE}, u as (select v.id, count(ue.b) as degree from valid v left join ue on ue.a = v.id group by 1) select id, degree from u where degree >= 2")
def split_eligible(spark: SparkSession, d: str) -> DataFrame:
    return nodesplits.eligible(*linked(spark, d), 2)


@query(f"with {_UE}, u as (select v.id, count(ue.b) as degree from valid v left join ue on ue.a = v.id group by 1), r as (select id, row_number() over (order by md5('7:' || id), id) as rn, count(*) over () as n from u where degree >= 2) select id from r where rn <= round_even(0.1 * n, 0)")
def split_random(spark: SparkSession, d: str) -> DataFrame:
    ok = materialize(nodesplits.eligible(*linked(spark, d), 2).select("id"), "eligible")
    return nodesplits.random_split(ok, 0.1, 7)


@query(f"""with {_UE}, u as (select v.id, v.char_count, count(ue.b) as degree, case when contains(v.id, ':') then 'code' else 'wiki' end as kind from valid v left join ue on ue.a = v.id group by all),
 b as (select kind, case when degree < 2 then 0 when degree < 4 then 1 when degree < 8 then 2 when degree < 16 then 3 else 4 end as db, case when char_count < 1000 then 0 when char_count < 5000 then 1 when char_count < 20000 then 2 else 3 end as cb from u)
 select kind, count(*) as n_nodes, {', '.join(f'count(*) filter (db = {k}) as degree_{k}' for k in range(5))}, {', '.join(f'count(*) filter (cb = {k}) as chars_{k}' for k in range(4))} from b group by 1""")
def bucket_profiles(spark: SparkSession, d: str) -> DataFrame:
    n, e = linked(spark, d, "char_count")
    u = graph.undirected_degrees(n, e).join(n, "id").withColumn("kind", F.when(F.contains("id", F.lit(":")), "code").otherwise("wiki"))
    return nodesplits.bucket_profiles(u, "kind")


@query()
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    return nodesplits.split_nodes(*linked(spark, d, "char_count"), 2, 0.05, 0.05, seed=7)


@query()
def lpa_communities(spark: SparkSession, d: str) -> DataFrame:
    labels = nodesplits.label_communities(*linked(spark, d))
    return labels.groupBy("community").agg(F.count("*").alias("n_nodes"))


_SPLIT = f"sp as (select id, replace(lower(trim(split, {_T})), '-', '_') as split from valid where trim(split, {_T}) <> '')"


@query(f"""with {_IE}, {_SPLIT}, pr as (select a.split as s, b.split as t, e.src, e.dst from inner_edge e join sp a on a.id = e.src join sp b on b.id = e.dst),
 dg as (select a, count(*) as n from (select src as a, dst as b from pr where s = t and src <> dst union select dst, src from pr where s = t and src <> dst) group by 1)
 select sp.split, count(*) as n_nodes, (select count(*) from pr where s = t and s = sp.split) as internal_edges,
 (select count(*) from pr where s <> t and ((s = 'train' and t = sp.split) or (t = 'train' and s = sp.split))) as edges_to_train,
 round(avg(coalesce(dg.n, 0)), 9) as mean_induced_degree, min(coalesce(dg.n, 0)) as least_induced_degree from sp left join dg on dg.a = sp.id group by 1""")
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    n, e = linked(spark, d, "split")
    assigned = n.select("id", cleaned_split("split").alias("split")).where("split is not null")
    return nodesplits.split_stats(assigned, graph.internal_edges(n.select("id"), e)).withColumn("mean_induced_degree", F.round("mean_induced_degree", 9))


@query(f"with {_V}, {_SPLIT} select split, substr(sha256(string_agg(id, ',' order by id)), 1, 16) as node_list_hash from sp group by 1")
def node_list_hash(spark: SparkSession, d: str) -> DataFrame:
    return nodesplits.node_list_hash(nodes(spark, d).select("id", cleaned_split("split").alias("split")).where("split is not null"))


# ------------------------------------------------------------------------------- packing


@query(f"""with {_V} select c.config_id, v.node_id, case when tok_len <= 0 then null when c.doc_budget is null or tok_len <= c.doc_budget then tok_len when c.overflow_policy = 'truncate' then c.doc_budget end as budgeted
 from valid v, pack_config c where v.tok_len is not null""")
def budgeted_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = nodes(spark, d).where("tok_len is not null").select("node_id", "tok_len")
    parts = docs.limit(0).select(F.lit(0).alias("config_id"), "node_id", F.col("tok_len").cast("bigint").alias("budgeted"))
    for c in table(spark, d, "pack_config").collect():
        part = docs.select(F.lit(c["config_id"]).alias("config_id"), "node_id", packs.budgeted_length(F.col("tok_len"), c["doc_budget"], c["overflow_policy"]).cast("bigint").alias("budgeted"))
        parts = parts.unionByName(part)
    return parts


@query(f"""with {_P} select pack_id, doc_id, pos, length, before as tokens_before from
 (select *, cast(coalesce(sum(length) over (partition by pack_id order by pos, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before from placed) where before < 1024""")
def pack_fill(spark: SparkSession, d: str) -> DataFrame:
    return packs.fill_packs(placed(spark, d), ["pack_id"], ["pos", "doc_id"], "length", 1024).select("pack_id", "doc_id", "pos", "length", "tokens_before")


def _trim_sql(order: str) -> str:
    return f"""with {_P}, r as (select *, row_number() over (partition by pack_id order by pos, doc_id) as k from placed),
 t as (select *, greatest(sum(length) over (partition by pack_id) - 1000, 0) as over_by, coalesce(sum(length) over (partition by pack_id order by k {order} rows between unbounded preceding and 1 preceding), 0) as done from r),
 c as (select pack_id, doc_id, length, least(length, greatest(over_by - done, 0)) as cut from t) select pack_id, doc_id, cast(length - cut as bigint) as kept_len, cut > 0 as was_cut from c where length > cut"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("pack_id").orderBy("pos", "doc_id")))


@query(_trim_sql(""))
def pack_truncate_head(spark: SparkSession, d: str) -> DataFrame:
    return packs.truncate_packs(_ranked(spark, d), 1000, "head", pos="k", body="length").select("pack_id", "doc_id", "kept_len", "was_cut")


@query(_trim_sql("desc"))
def pack_truncate_tail(spark: SparkSession, d: str) -> DataFrame:
    return packs.truncate_packs(_ranked(spark, d), 1000, "tail", pos="k", body="length").select("pack_id", "doc_id", "kept_len", "was_cut")


_SPANS = f"{_P}, r as (select *, row_number() over (partition by pack_id order by pos, doc_id) as k from placed), span as (select *, cast(sum(length) over (partition by pack_id order by k) as bigint) as span_end from r)"


@query(f"with {_SPANS} select pack_id, doc_id, span_end - length as span_start, span_end from span")
def pack_spans(spark: SparkSession, d: str) -> DataFrame:
    return packs.spans(_ranked(spark, d), pos="k").select("pack_id", "doc_id", "span_start", "span_end")


def _title(raw: Column) -> Column:
    return packs.char_codes(packs.title_text(raw))


@query(f"with {_P} select pack_id, doc_id, length('# ' || coalesce(raw_identifier, '') || chr(10) || chr(10)) + 1 as prefix_len, 1 as suffix_len, length + length('# ' || coalesce(raw_identifier, '') || chr(10) || chr(10)) + 2 as total_len from placed")
def layout_lengths(spark: SparkSession, d: str) -> DataFrame:
    layout = packs.make_layout("identifier_prefix_bos_eos")
    p = placed(spark, d).withColumn("prefix_len", F.size(layout.prefix(_title(F.col("raw_identifier")))).cast("bigint")).withColumn("suffix_len", F.size(layout.suffix()))
    return p.select("pack_id", "doc_id", "prefix_len", "suffix_len", (F.col("length") + F.col("prefix_len") + F.col("suffix_len")).alias("total_len"))


@query(f"""with {_P}, t as (select pack_id, row_number() over (partition by pack_id order by pos, doc_id) as k, least(length, 12) as n, '# ' || coalesce(raw_identifier, '') || chr(10) || chr(10) as title, id from placed)
 select pack_id, md5(string_agg('50256,' || array_to_string([ascii(c) for c in string_split(title, '')], ',') || ',' || array_to_string([ascii(c) for c in string_split(substr(id, 1, n), '')], ',') || ',50256', ',' order by k)) as tokens_md5 from t group by 1""")
def packed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token sequences of the packs with titles and end marks (identifiers as bodies)."""
    layout = packs.make_layout("identifier_prefix_bos_eos")
    p = _ranked(spark, d)
    body = packs.slice_body(packs.char_codes(F.col("id")), F.least("length", F.lit(12)).cast("int"), "tail")
    rows = p.select("pack_id", "k", F.concat(layout.prefix(_title(F.col("raw_identifier"))), body, layout.suffix()).alias("tokens"))
    return packs.collate(rows, pos="k").select("pack_id", F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")).alias("tokens_md5"))


@query(f"""with {_P}, r as (select pack_id, id, least(length, 6) as n from placed) select pack_id, id, substr(id, greatest(length(id) - n, 0) + 1, n) as kept from r""")
def slice_head_trimmed(spark: SparkSession, d: str) -> DataFrame:
    p = placed(spark, d)
    kept = packs.slice_body(packs.char_codes(F.col("id")), F.least("length", F.lit(6)).cast("int"), "head")
    return p.select("pack_id", "id", F.array_join(F.transform(kept, lambda c: F.char(c.cast("bigint"))), "").alias("kept"))


@query()
def pack_order_targets_first(spark: SparkSession, d: str) -> DataFrame:
    return packs.order_packs(placed(spark, d).select("pack_id", "doc_id", "pos"), id_edges(spark, d))


def _sampled(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    valid = lines(spark, d, "node_id", "tok_len", "outgoing").where("node_id is not null")
    out = traversal.sampled_packs(valid.select(F.col("node_id").alias("node"), F.col("tok_len").alias("length")), id_edges_of(valid), list(range(8)), 4, strategy, packs.PackSettings(2048, 1024, order_mode="prefer_targets_first"))
    return out.withColumnRenamed("node", "doc_id")


@query()
def pack_sampler_bfs(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d, "bfs")


@query()
def pack_sampler_dfs(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d, "dfs")


@query()
def pack_sampler_walk(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d, "random_walk")


@query()
def pack_sampler_composite(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d, "bfs_then_random")


@query()
def pack_sampler_random(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d, "random")


@query()
def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    sizes = nodes(spark, d).where("tok_len > 0").select(F.col("id").alias("key"), (F.col("tok_len") * 2).alias("n_bytes"))
    return packs.assign_shards(sizes, 1_000_000)


@query(f"with {_V} select id, tok_shard_idx, tok_offset_bytes, tok_len, (tok_offset_bytes - 1024) // 2 as first_token from valid where tok_len > 0")
def token_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of the nodes' tokens in their shards, in tokens."""
    n = nodes(spark, d).where("tok_len > 0")
    return n.select("id", "tok_shard_idx", "tok_offset_bytes", "tok_len", F.floor((F.col("tok_offset_bytes") - 1024) / 2).alias("first_token"))


# ------------------------------------------------------------------------ masks and grants


@query(f"""with {_SPANS}, g as (select pack_id, least(max(span_end), 2047) as t, sum(n * (n + 1) / 2) as tri, sum(n * n) as sq, sum(n) as covered from
 (select pack_id, span_end, greatest(least(span_end, 2047) - (span_end - length), 0) as n from span) group by 1)
 select pack_id, t as length, cast(tri as bigint) as doc_causal, cast(t * (t + 1) / 2 as bigint) as causal, cast(t * t as bigint) as full_pairs, cast(sq as bigint) as doc_bidirectional from g""")
def mask_density(spark: SparkSession, d: str) -> DataFrame:
    """Allowed pairs per pack and mask over sequences of at most 2,047 positions."""
    s = packs.spans(_ranked(spark, d), pos="k")
    t = F.least(F.max("span_end").over(Window.partitionBy("pack_id")), F.lit(2047))
    cut = s.withColumn("t", t).withColumn("span_end", F.greatest(F.least("span_end", F.lit(2047)), "span_start"))
    return masks.allowed_pairs(cut, F.col("t"))


def linked_packs(spark: SparkSession, d: str) -> DataFrame:
    """A pack for every node that names others: their documents in list order, then its own,
    each cut to 256 tokens."""
    valid = lines(spark, d, "node_id", "tok_len", "raw_identifier", "outgoing").where("tok_len > 0 and node_id is not null").withColumn("length", F.least("tok_len", F.lit(256)))
    out = valid.select("node_id", F.col("id").alias("source"), F.posexplode("outgoing").alias("k", "t")).select(F.col("node_id").alias("pack_id"), "source", "k", trimmed("t").alias("target"))
    there = valid.select(F.col("id").alias("target"), F.col("node_id").alias("doc_id"), "length")
    docs = out.where("target <> source").join(there, "target").groupBy("pack_id", "doc_id", F.col("target").alias("key"), "length").agg(F.min("k").alias("pos"))
    own = valid.select(F.col("node_id").alias("pack_id"), F.col("node_id").alias("doc_id"), F.col("id").alias("key"), "length", F.lit(1 << 20).alias("pos")).join(docs.select("pack_id"), "pack_id", "left_semi")
    return docs.unionByName(own)


def _span_keys(spark: SparkSession, d: str) -> DataFrame:
    return materialize(packs.spans(linked_packs(spark, d)).select("pack_id", "doc_id", "key", "span_start", "span_end"), "linked-spans")


def _pack_links(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    """Links at deterministic positions: a document's k-th outgoing link ends k tokens after its start."""
    out = nodes(spark, d).select(F.col("id").alias("key"), F.posexplode("outgoing").alias("k", "t")).select("key", "k", trimmed("t").alias("target")).where("target <> ''")
    return s.join(out, "key").select("pack_id", (F.col("span_start") + F.col("k") + 1).alias("link_end"), "target", F.col("span_end").alias("e")).where("link_end <= e").drop("e").distinct()


_LSPANS = f"""{_V}, lo as (select node_id as pack_id, id as source, k, trim(outgoing[k], {_T}) as target from (select *, unnest(range(1, len(outgoing) + 1)) as k from valid where tok_len > 0 and node_id is not null)),
 ld as (select o.pack_id, t.node_id as doc_id, t.id, least(t.tok_len, 256) as length, min(o.k) as pos from lo o join valid t on t.id = o.target and t.tok_len > 0 and t.node_id is not null where o.target <> o.source group by all),
 span as (select *, cast(sum(length) over (partition by pack_id order by pos) as bigint) as span_end from (select * from ld union all select node_id, node_id, id, least(tok_len, 256), 1048577 from valid where tok_len > 0 and node_id in (select pack_id from ld)))"""
_LINKED = f"""{_LSPANS}, ln as (select distinct s.pack_id, s.span_end - s.length + o.k as link_end, o.target from span s join
   (select id, k, trim(outgoing[k], {_T}) as target from (select id, outgoing, unnest(range(1, len(outgoing) + 1)) as k from valid)) o on o.id = s.id where o.target <> '' and s.span_end - s.length + o.k <= s.span_end),
 matched as (select l.pack_id, l.link_end, l.target, t.doc_id as target_id, t.span_end - t.length as target_start, t.span_end as target_end from ln l join
   (select *, row_number() over (partition by pack_id, id order by span_end desc) as n from span) t on t.pack_id = l.pack_id and t.id = l.target and t.n = 1 where t.span_end - t.length < l.link_end)"""


@query(f"with {_LINKED} select pack_id, link_end, target, target_id, target_start, target_end from matched")
def link_match(spark: SparkSession, d: str) -> DataFrame:
    s = _span_keys(spark, d)
    return masks.match_links(_pack_links(spark, d, s), s).select("pack_id", "link_end", "target", "target_id", "target_start", "target_end")


_GRANTS = f"""{_LINKED}, gr as (select m.pack_id, m.link_end, s.doc_id as source_id, m.target_id, m.link_end as q_start, least(s.span_end, 2047) as q_end, m.target_start as kv_start, least(m.target_end, 2047) as kv_end
  from matched m join span s on s.pack_id = m.pack_id and s.span_end - s.length < m.link_end and m.link_end <= s.span_end),
 num as (select *, row_number() over (partition by pack_id order by link_end, target_id, source_id) - 1 as grant_idx from gr where q_start < q_end and kv_start < kv_end)"""


def _grants(spark: SparkSession, d: str) -> DataFrame:
    return spans_and_grants(spark, d)[1]


def spans_and_grants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _span_keys(spark, d)
    return s, masks.grants(masks.match_links(_pack_links(spark, d, s), s), s, F.lit(2047))


@query(f"with {_GRANTS} select pack_id, grant_idx, source_id, target_id, q_start, q_end, kv_start, kv_end from num")
def grants(spark: SparkSession, d: str) -> DataFrame:
    return _grants(spark, d).select("pack_id", F.col("grant_idx").cast("bigint").alias("grant_idx"), "source_id", "target_id", "q_start", "q_end", "kv_start", "kv_end")


@query(f"""with {_GRANTS}, ps as (select pack_id, 'q' as side, grant_idx, unnest(range(q_start, q_end)) as position from num where grant_idx < 256 union all
   select pack_id, 'kv', grant_idx, unnest(range(kv_start, kv_end)) from num where grant_idx < 256),
 bits as (select pack_id, side, position, cast(grant_idx // 64 as int) as chunk, bit_or(case when grant_idx % 64 = 63 then (-9223372036854775808)::bigint else 1::bigint << cast(grant_idx % 64 as int) end) as bits from ps group by all)
 select pack_id, side, chunk, count(*) as n_positions, bit_xor(bits) as bits_xor from bits group by all""")
def grant_bitmask(spark: SparkSession, d: str) -> DataFrame:
    bits = masks.grant_bitmasks(_grants(spark, d))
    return bits.groupBy("pack_id", "side", "chunk").agg(F.count("*").alias("n_positions"), F.bit_xor("bits").alias("bits_xor"))


@query("select step, cast(round_even(64 + (256 - 64) * (1 - cos(pi() * least(step / 1000.0, 1.0))) / 2, 0) as int) as max_grants from (select unnest(range(0, 1201, 100)) as step)")
def grant_warmup(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 1201, 100).select(F.col("id").alias("step"), masks.grants_at_step(F.col("id").cast("double"), 64, 256, 1000).alias("max_grants"))


@query("""with w as (select doc_id, k, length(w[k]) + 1 as n from (select doc_id, string_split(title, ' ') as w, unnest(range(1, len(string_split(title, ' ')) + 1)) as k from documents where title is not null)),
 c as (select *, sum(n) over (partition by doc_id order by k) as cum from w), q as (select doc_id, length(title) // 2 as pos from documents where title is not null)
 select q.doc_id, q.pos, min(c.k) - 1 as token from q join c on c.doc_id = q.doc_id and c.cum >= q.pos group by all""")
def char_to_token(spark: SparkSession, d: str) -> DataFrame:
    """First token whose running length reaches a character position."""
    t = table(spark, d, "documents").where("title is not null")
    tokens = t.select("doc_id", F.posexplode(F.split("title", " ")).alias("k", "w")).withColumn("n", F.length("w") + 1)
    asked = t.select("doc_id", F.floor(F.length("title") / 2).alias("char"))
    found = detectors.positions_of_chars(tokens, asked, "doc_id", "k", "n")
    return found.select("doc_id", F.col("char").alias("pos"), F.col("token").cast("bigint").alias("token"))


# ------------------------------------------------------------------------------- logits


@query(f"with {_L} select row_id, token_id from (select *, row_number() over (partition by row_id order by logit desc, token_id) as n from lg) where n = 1")
def greedy_token(spark: SparkSession, d: str) -> DataFrame:
    return logits.greedy(row_logits(spark, d))


@query(f"with {_L} select row_id, token_id, round(logit / 0.7, 9) as logit from (select *, row_number() over (partition by row_id order by logit desc, token_id) as n from lg) where n <= 5")
def topk_filter(spark: SparkSession, d: str) -> DataFrame:
    return logits.top_k(logits.temperature(row_logits(spark, d), 0.7), 5).select("row_id", "token_id", F.round("logit", 9).alias("logit"))


@query(f"""with {_SM}, c as (select *, row_number() over w as n, coalesce(sum(p) over (w rows between unbounded preceding and 1 preceding), 0) as before from sm window w as (partition by row_id order by logit desc, token_id))
 select row_id, count(*) as n_kept from c where n <= 2 or before <= 0.9 group by 1""")
def topp_filter(spark: SparkSession, d: str) -> DataFrame:
    return logits.top_p(row_logits(spark, d), 0.9).groupBy("row_id").agg(F.count("*").alias("n_kept"))


@query(f"with {_L} select row_id, token_id, round(case when token_id % 3 = 0 then (case when logit > 0 then logit / 1.2 else logit * 1.2 end) else logit end, 9) as logit from lg")
def repetition_penalty(spark: SparkSession, d: str) -> DataFrame:
    rows = row_logits(spark, d)
    return logits.repetition_penalty(rows, rows.where("token_id % 3 = 0"), 1.2).select("row_id", "token_id", F.round("logit", 9).alias("logit"))


@query(f"with {_SM} select row_id, round(-sum(case when p > 0 then p * ln(p) else 0 end), 6) as entropy, round(-sum(case when p > 0 then p * ln(p) else 0 end) / ln(count(*)), 6) as entropy_share from sm group by 1")
def logit_entropy(spark: SparkSession, d: str) -> DataFrame:
    return logits.entropy(row_logits(spark, d)).select("row_id", F.round("entropy", 6).alias("entropy"), F.round("entropy_share", 6).alias("entropy_share"))


@query(f"""with {_SM}, e as (select row_id, -sum(case when p > 0 then p * ln(p) else 0 end) / ln(count(*)) as share from sm group by 1), t as (select s.row_id, s.row_id % 10 as doc_id, s.p, e.share from sm s join e using (row_id) where s.token_id = s.row_id % 7)
 select doc_id, round(avg(-log2(p)), 2) as bits_per_token, round(avg(share), 3) as entropy_share, round(exp(avg(-ln(p))), 4) as perplexity, count(*) as n_tokens from t group by 1""")
def token_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = row_logits(spark, d)
    came = rows.select("row_id").distinct().select("row_id", (F.col("row_id") % 10).alias("doc_id"), (F.col("row_id") % 7).cast("int").alias("token_id"))
    return logits.token_metrics(rows, came).withColumn("perplexity", F.round("perplexity", 4))


@query(f"""with {_SM}, c as (select row_id, token_id, sum(p) over (partition by row_id order by logit desc, token_id) as cum, p from sm)
 select row_id, arg_min(token_id, cum) as token_id from c where cum >= (row_id % 97) / 97.0 * (1 - 1e-12) group by 1""")
def draw_token(spark: SparkSession, d: str) -> DataFrame:
    rows = row_logits(spark, d)
    u = rows.select("row_id").distinct().select("row_id", ((F.col("row_id") % 97) / F.lit(97.0)).alias("u"))
    return logits.draw(rows, u)


@query(f"with {_P}, r as (select pack_id, row_number() over (partition by pack_id order by pos, doc_id) as k, doc_id from placed) select * from (select pack_id, k, doc_id as token_id, lead(doc_id) over (partition by pack_id order by k) as target from r) where target is not null")
def lm_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d).select("pack_id", F.col("k").cast("bigint").alias("k"), F.col("doc_id").alias("token_id"))
    return logits.shifted(rows, pos="k")


# ------------------------------------------------------------------------------- texts

# wikitext assembled from titles, the same on both engines
_WIKI = """(select doc_id, '<!-- ' || title || ' -->''''''' || title || ''''''' is [[' || title || '|' || lower(title) || ']]s.<ref name="a">x</ref> ''''italic'''' (18081877) {{val|' || doc_id || '|u}}' || chr(10) ||
 '* one' || chr(10) || '** two' || chr(10) || ': quote' || chr(10) || ';Term' || chr(10) || '[http://a.example/x ' || title || '] <math>a=b</math> H<sub>2</sub>O<br/>end' || chr(10) || 'File:x.png|y' || chr(10) || '{{ship-stub}}' || chr(10) || '{{-}}' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || chr(9) || chr(10) || 'tail' || chr(10) || chr(10) as t from documents where title is not null)"""


def _wiki(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    parts = [F.lit("<!-- "), t, F.lit(" -->'''"), t, F.lit("''' is [["), t, F.lit("|"), F.lower(t), F.lit("]]s.<ref name=\"a\">x</ref> ''italic'' (18081877) {{val|"), F.col("doc_id").cast("string"), F.lit("|u}}\n* one\n** two\n: quote\n;Term\n[http://a.example/x "), t, F.lit("] <math>a=b</math> H<sub>2</sub>O<br/>end\nFile:x.png|y\n{{ship-stub}}\n{{-}}\n\n \n\n\t\ntail\n\n")]
    return table(spark, d, "documents", "doc_id").where("title is not null").select("doc_id", F.concat(*parts).alias("t"))


_RX = {
    "comments": "regexp_replace(t, '(?s)<!--.*?-->', '', 'g')",
    "reference_tags": "regexp_replace(t, '(?s)<ref.*?>.*?</ref>|<ref.*?>', '', 'g')",
    "math_tags": "regexp_replace(t, '(?s)<math.*?>(.*?)</math>', '$$\\1$$', 'g')",
    "number_templates": "regexp_replace(regexp_replace(t, '(?i)\\{\\{val\\|([^|}]+).*?\\}\\}', '\\1', 'g'), '(?i)\\{\\{overline\\|(.*?)\\}\\}', '\\1', 'g')",
    "external_links": "regexp_replace(regexp_replace(t, '\\[https?://[^ ]+\\s+(.*?)\\]', '\\1', 'g'), '\\[https?://[^ ]+\\]', '', 'g')",
    "date_ranges": "regexp_replace(t, '\\((\\d{4})(\\d{4})\\)', '(\\1-\\2)', 'g')",
    "bold_and_italics": "regexp_replace(regexp_replace(t, '''''''(.*?)''''''', '**\\1**', 'g'), '''''(.*?)''''', '*\\1*', 'g')",
    "lists": "regexp_replace(regexp_replace(regexp_replace(t, '(?m)^:\\s*', '> ', 'g'), '(?m)^\\*{2}\\s*', '  - ', 'g'), '(?m)^\\*\\s*', '- ', 'g')",
    "definition_lists": "regexp_replace(t, '(?m)^;(.+)$', '#### \\1', 'g')",
    "file_references": "regexp_replace(t, '(?mi)^File:[^\\n]*$', '', 'g')",
    "scripts": "regexp_replace(t, '(?si)<sub.*?>(.*?)</sub>', '_\\1', 'g')",
    "plain_tags": "regexp_replace(t, '(?i)<br\\s*/?>', chr(10), 'g')",
    "stub_templates": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?mi)^\\s*\\{\\{[^}]*stub[^}]*\\}\\}\\s*$', '', 'g'), '(?mi)^\\s*\\{\\{-\\}\\}\\s*$', '', 'g'), '(?mi)^\\s*\\{\\{clear\\}\\}\\s*$', '', 'g'), '(?mi)^\\s*\\{\\{shapes\\}\\}\\s*$', '', 'g'), '(?mi)^\\s*\\{\\{[^}]*nav[^}]*\\}\\}\\s*$', '', 'g'), '(?mi)^\\s*\\{\\{[a-zA-Z-]{1,20}\\}\\}\\s*$', '', 'g')",
    "blank_lines": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\A\\s*\\z', ''), '\\A(?:[^\\S\\n]*\\n)+', ''), '(?:\\n[^\\S\\n]*)+\\z', ''), '(?m)(^(?:[^\\S\\n]*\\n){2})(?:[^\\S\\n]*\\n)+', '\\1', 'g')",
    "leftover_links": "replace(replace(t, '[[', ''), ']]', '')",
}


@query(" union all ".join(f"select doc_id, '{name}' as step, {sql} as result from {_WIKI}" for name, sql in _RX.items()))
def clean_steps(spark: SparkSession, d: str) -> DataFrame:
    """Substitution steps of the cleaner, each by itself, as column expressions."""
    w = _wiki(spark, d)
    steps = F.array(*[F.struct(F.lit(n).alias("step"), txt.step(n, F.col("t")).alias("result")) for n in _RX])
    return w.select("doc_id", F.explode(steps).alias("s")).select("doc_id", "s.*")


@query()
def clean_wikitext(spark: SparkSession, d: str) -> DataFrame:
    return _wiki(spark, d).select("doc_id", txt.clean_wikitext("t").alias("text"))


@query("""select doc_id, array_to_string([case when l like ' %' and substr(trim(l), 1, 1) not in ('*', '-', '#') and regexp_matches(trim(l), '[=+−\\\\×÷]') then '$$' || trim(l) || '$$' else l end for l in string_split(t, chr(10))], chr(10)) as text
 from (select doc_id, ' ' || title || ' = ' || doc_id || chr(10) || ' * ' || title || ' + 1' || chr(10) || title as t from documents where title is not null)""")
def indented_math(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit(" "), F.col("title"), F.lit(" = "), F.col("doc_id").cast("string"), F.lit("\n * "), F.col("title"), F.lit(" + 1\n"), F.col("title"))
    return table(spark, d, "documents").where("title is not null").select("doc_id", txt.indented_math(t).alias("text"))


@query("select a.doc_id from documents a join (select doc_id, case when doc_id % 3 = 0 then text || ' ' else text end as text from documents) b using (doc_id) where md5(a.text) <> md5(b.text)")
def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", "text")
    b = a.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return corpus.changed_documents(a, b, "doc_id", "text")


@query(f"""with n as (select min(doc_id) as doc_id, {_norm('title')} as id from documents where title is not null group by 2),
 asked as (select distinct title as identifier from documents where title is not null union select {_norm('title')} from documents where title is not null)
 select a.identifier, coalesce(x.doc_id, y.doc_id) as doc_id, case when x.doc_id is not null then 'exact' when y.doc_id is not null then 'normalised' end as found_by from asked a
 left join n x on x.id = a.identifier left join n y on y.id = {_GEN.replace('title', 'a.identifier')} || '_' || substr(md5(a.identifier), 1, 6)""")
def corpus_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("title is not null")
    known = docs.groupBy(idn.normalize_identifier("title").alias("normed_identifier")).agg(F.min("doc_id").alias("doc_id"))
    asked = docs.select(F.col("title").alias("identifier")).unionByName(docs.select(idn.normalize_identifier("title").alias("identifier"))).distinct()
    return corpus.lookup_documents(asked, known)


# ------------------------------------------------------------------------------ context


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as contexts know them: length and links."""
    valid = lines(spark, d, "tok_len", "outgoing").where("tok_len > 0")
    links = F.filter(F.transform(F.coalesce("outgoing", F.array().cast("array<string>")), trimmed), lambda t: t.isNotNull() & (t != ""))
    return valid.select(F.col("id").alias("target"), F.col("tok_len").alias("length"), links.alias("links"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """A session per pack, with the links of its documents."""
    out = nodes(spark, d).select(F.col("id").alias("source"), F.posexplode("outgoing").alias("k", "t")).select("source", "k", trimmed("t").alias("target")).where("target <> ''")
    first = placed(spark, d).select("pack_id", F.col("id").alias("source"), "pos").join(out, "source")
    order = F.row_number().over(Window.partitionBy("pack_id").orderBy("pos", "k", "target"))
    return materialize(first.select(F.col("pack_id").alias("session"), order.alias("ord"), "target", F.lit(100).alias("root_length")), "sessions")


@query()
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    return ctx.assemble_contexts(_sessions(spark, d), _corpus(spark, d), ctx.ContextSettings())


@query()
def context_document_spans(spark: SparkSession, d: str) -> DataFrame:
    return ctx.context_spans(ctx.assemble_contexts(_sessions(spark, d), _corpus(spark, d), ctx.ContextSettings())).select("session", "identifier", "span_start", "span_end")


@query()
def context_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stateful query over the pack sessions, run to the end of its input."""
    import uuid

    from corpusloom.session import shared_dir

    base = f"{shared_dir(spark)}/corpusloom/stream-{uuid.uuid4().hex}"
    events = _sessions(spark, d).select("session", "ord", F.lit("link").alias("kind"), "target", F.lit(None).cast("bigint").alias("length"))
    events.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    run = ctx.context_stream(stream, _corpus(spark, d), ctx.ContextSettings()).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    w = Window.partitionBy("session").orderBy(F.desc("batch"))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")
