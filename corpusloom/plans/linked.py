"""Named queries on linked masks, links in token sequences, written contexts, token stores and
packed datasets, with SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusloom.functions import identifiers as idn
from corpusloom.functions import imports as imp
from corpusloom.operators import corpus, detectors, graph, logits, masks, nodesplits, packs, traversal
from corpusloom.plans import catalog
from corpusloom.session import materialize, shared_dir
from corpusloom.sources import shards, sinks, vocabularies
from corpusloom.sources import text as src
from corpusloom.streaming import context as ctx
from corpusloom.tables import cleaned_split, table, trimmed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# ------------------------------------------------------------------------- linked masks

# keys that a query may see: those of its own document up to itself, and all of each granted one
_SEEN = f"""{catalog._GRANTS}, cutspan as (select pack_id, doc_id, span_end - length as a, least(span_end, 2047) as b from span where span_end - length < 2047),
 own as (select pack_id, cast(sum((b - a) * (b - a + 1) / 2) as bigint) as doc_causal, max(b) as n from cutspan group by 1),
 q as (select pack_id, source_id, target_id, kv_end - kv_start as n, unnest(range(q_start, q_end)) as q from num where source_id <> target_id),
 more as (select pack_id, cast(sum(n) as bigint) as granted from (select distinct pack_id, q, target_id, n from q) group by 1)"""


@query(f"""with {_SEEN} select own.pack_id, n as length, doc_causal, coalesce(granted, 0) as granted, doc_causal + coalesce(granted, 0) as allowed, round((doc_causal + coalesce(granted, 0)) / (n * (n + 1) / 2), 9) as share_of_causal
 from own left join more using (pack_id)""")
def linked_mask_density(spark: SparkSession, d: str) -> DataFrame:
    """Pairs allowed by the linked mask in packs of linked documents, over at most 2,047 positions."""
    spans, granted = catalog.spans_and_grants(spark, d)
    cut = spans.where("span_start < 2047").withColumn("span_end", F.least("span_end", F.lit(2047)))
    length = F.col("t")
    lengths = cut.groupBy("pack_id").agg(F.max("span_end").alias("t"))
    return masks.linked_pairs(cut.join(lengths, "pack_id"), granted, length).withColumn("share_of_causal", F.round("share_of_causal", 9))


@query(f"""with {_SEEN}, o as (select pack_id, unnest(range(a, b)) as q, a from cutspan),
 t as (select pack_id, q, sum(n) as n from (select pack_id, q, q - a + 1 as n from o union all select pack_id, q, n from (select distinct pack_id, q, target_id, n from q)) group by 1, 2)
 select pack_id, count(*) as n_queries, cast(sum(n) as bigint) as n_pairs, cast(max(n) as bigint) as most_keys from t group by 1""")
def dense_mask_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the dense linked mask, counted per pack."""
    spans, granted = catalog.spans_and_grants(spark, d)
    cut = spans.where("span_start < 2047").withColumn("span_end", F.least("span_end", F.lit(2047)))
    rows = masks.visible_ranges(cut, granted).groupBy("pack_id", "q").agg(F.sum(F.col("k_end") - F.col("k_start")).alias("n"))
    return rows.groupBy("pack_id").agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_pairs"), F.max("n").alias("most_keys"))


@query(f"""with {catalog._GRANTS}, ends as (select pack_id, least(max(span_end), 2047) - 1 as q from span group by 1),
 asked as (select s.pack_id, e.q, s.span_end - s.length as k from span s join ends e using (pack_id) union select pack_id, span_end - length, span_end - length - 1 from span where span_end > length
   union select pack_id, span_end - length, span_end - 1 from span),
 placed as (select a.*, x.doc_id as dq, y.doc_id as dk from asked a left join span x on x.pack_id = a.pack_id and a.q >= x.span_end - x.length and a.q < x.span_end
   left join span y on y.pack_id = a.pack_id and a.k >= y.span_end - y.length and a.k < y.span_end)
 select pack_id, q, k, q >= k and (dq is not distinct from dk or exists (select 1 from num g where g.pack_id = p.pack_id and p.q >= g.q_start and p.q < g.q_end and p.k >= g.kv_start and p.k < g.kv_end)) as allowed from placed p""")
def visible_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last position of a pack sees each document's first one, the first position of
    a document the one before it, and the first of a document its last."""
    spans, granted = catalog.spans_and_grants(spark, d)
    last = spans.groupBy("pack_id").agg((F.least(F.max("span_end"), F.lit(2047)) - 1).alias("q"))
    asked = spans.join(last, "pack_id").select("pack_id", "q", F.col("span_start").alias("k"))
    asked = asked.unionByName(spans.where("span_start > 0").select("pack_id", F.col("span_start").alias("q"), (F.col("span_start") - 1).alias("k")))
    asked = asked.unionByName(spans.select("pack_id", F.col("span_start").alias("q"), (F.col("span_end") - 1).alias("k")))
    return masks.may_see(asked, spans, granted)


# ---------------------------------------------------------------- links in token sequences


@F.pandas_udf(ArrayType(IntegerType()))
def _char_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(detectors.char_tokens, na_action="ignore")


@query("""with t as (select doc_id, replace(replace(text, chr(0), ' '), '](', chr(1)) as t from documents where text is not null and not contains(text, chr(1))),
 m as (select doc_id, t, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) = chr(1))) as i from t),
 w as (select doc_id, i, substr(t, greatest(i - 100, 1), least(i - 1, 100)) as before, substr(t, i + 1, 50) as ahead from m)
 select distinct doc_id, cast(i + strpos(ahead, ')') as bigint) as link_end, regexp_replace(replace(substr(ahead, 1, strpos(ahead, ')') - 1), chr(1), ']('), '^\\s+|\\s+$', '', 'g') as target
 from w where contains(before, '[') and contains(ahead, ')') and regexp_replace(substr(ahead, 1, strpos(ahead, ')') - 1), '\\s', '', 'g') <> ''""")
def md_token_links(spark: SparkSession, d: str) -> DataFrame:
    """Markdown links in the articles' character tokens, ``](`` being one token."""
    rows = table(spark, d, "documents", "doc_id").where(~F.contains("text", F.lit("\x01"))).select("doc_id", _char_tokens("text").alias("tokens"))
    return detectors.detected_links(rows, detectors.char_markdown_links, "doc_id")


def _sql_pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _statements(name: str, pattern: str) -> str:
    p = _sql_pattern(pattern)
    return f"""{name}_m as (select file_id, regexp_extract_all(content, {p}, 0) as ms, string_split_regex(content, {p}) as ps from files),
 {name}_k as (select file_id, ms, ps, unnest(range(1, len(ms) + 1)) as k from {name}_m),
 {name}_s as (select file_id, regexp_extract(ms[k], {p}, 1) as x, cast(list_sum(list_transform(ps[1:k], lambda s: length(s))) + list_sum(list_transform(ms[1:k], lambda s: length(s))) as bigint) as char_end from {name}_k)"""


_MODULE = "regexp_extract(x, '^([\\w.]+)', 1)"
_PARSED = rf"""{catalog._F}, {_statements("plain", imp.SIMPLE_IMPORT)}, {_statements("inl", imp.INLINE_FROM)}, {_statements("par", imp.PAREN_FROM)},
 parsed as (select file_id, char_end, {_TRIM.format("string_split(i, ' as ')[1]")} as module, '' as name from (select file_id, char_end, unnest(string_split(x, ',')) as i from plain_s)
  union all select file_id, char_end, module, {_TRIM.format("n")} from (select file_id, char_end, {_MODULE} as module, unnest(string_split(regexp_replace(x, '^[\w.]+\s+import\s+', ''), ',')) as n from inl_s)
  union all select file_id, char_end, module, {_TRIM.format("n")} from (select file_id, char_end, {_MODULE} as module,
   unnest(string_split(array_to_string(list_transform(string_split(regexp_replace(x, '^[\w.]+\s+import\s+\(', ''), chr(10)), lambda l: rtrim(split_part(l, '#', 1), '\')), ' '), ',')) as n from par_s)),
 imports as (select distinct * from parsed where module <> '' and module not like '.%' and (name <> '' or (file_id, char_end) in (select file_id, char_end from plain_s)))"""
_CANDIDATES = "case when name in ('', '*') then [b || '.py', b || '/__init__.py'] else [b || '/' || name || '.py', b || '/' || name || '/__init__.py', b || '.py', b || '/__init__.py'] end"


@query(f"with {_PARSED} select distinct file_id, char_end as link_end, unnest({_CANDIDATES}) as target from (select *, replace(module, '.', '/') as b from imports)")
def py_token_imports(spark: SparkSession, d: str) -> DataFrame:
    """Files that imports may stand for, in the character tokens of the code files, each with
    the position at which its statement ends."""
    kept = catalog.code_files(spark, d).select("file_id")
    files = table(spark, d, "stack_file", "file_id").where("content <> '' and file_id is not null").select("file_id", _char_tokens("content").alias("tokens"))
    found = detectors.detected_links(files, detectors.char_import_links, "file_id").distinct()
    return found.join(kept, "file_id", "left_semi")


ORACLES["py_parsed_imports"] = f"with {_PARSED} select distinct file_id, module, name, array_to_string({_CANDIDATES}, '|') as candidates from (select *, replace(module, '.', '/') as b from imports)"


# ------------------------------------------------------------------------ written contexts


def _closes(token: int) -> bool:
    return token == ord(")")


@query()
def context_generation(spark: SparkSession, d: str) -> DataFrame:
    """Every article written anew as the root of a context, its links followed while it is written."""
    docs = materialize(table(spark, d, "documents", "doc_id").where("doc_id is not null").select("doc_id", "title", _char_tokens("text").alias("tokens")), "article-tokens")
    found = detectors.detected_links(docs, detectors.char_markdown_links, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("target")).alias("links"))
    titled = docs.where("title <> ''").groupBy(F.col("title").alias("target")).agg(F.min("doc_id").alias("doc_id"))
    known = titled.join(docs.select("doc_id", F.size("tokens").cast("bigint").alias("length")), "doc_id").where("length > 0").join(found, "doc_id", "left").dropDuplicates(["target"])
    sessions = docs.select(F.col("doc_id").alias("session"), F.coalesce("title", F.lit("")).alias("identifier"), "tokens").dropDuplicates(["session"])
    settings = ctx.GenerationSettings(max_new_tokens=2000, max_tokens_per_document=2000)
    return ctx.written_contexts(sessions, known.select("target", "length", "links"), ctx.ContextSettings(max_context=8192), settings, detectors.char_markdown_links, _closes)


@query()
def context_documents_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the assembled contexts that came from the corpus, as text with a heading."""
    docs = ctx.result_filters(catalog.context_assembly(spark, d), source="corpus")
    return corpus.render_documents(docs.withColumn("raw_identifier", F.col("identifier")).withColumn("text", F.lit("")))


# ------------------------------------------------------------------------ stored tokens


def _code_points() -> Callable[[str], np.ndarray]:
    return lambda text: np.frombuffer(text.encode("utf-32-le"), dtype="<i4")


def _from_code_points() -> Callable[[np.ndarray], str]:
    return lambda tokens: tokens.astype("<u4").tobytes().decode("utf-32-le")


@query("""with f as (select trim(max_stars_repo_name) as r, * from stack_file where max_stars_repo_name <> '' and max_stars_repo_path <> '' and content <> ''),
 c as (select *, trim(regexp_replace(regexp_replace(lower(translate(max_stars_repo_name, '/-', '__')), '[^a-z0-9\\-_]', '_', 'g'), '__+', '_', 'g'), '_') as cl from f),
 n as (select cl || '_' || substr(md5(cl), 1, 6) || ':' || max_stars_repo_path as id, content from c)
 select id as normed_identifier, length(any_value(content)) as tok_len, md5(any_value(content)) as digest, true as placed from n group by 1 having count(distinct content) = 1""")
def token_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Code files by way of the reader, the tokenizer, the shards and the graph, and back: the
    text that is read from the shards (identifiers with one content)."""
    docs = src.stack_documents(table(spark, d, "stack_file"))
    counts = docs.groupBy("normed_identifier").agg(F.countDistinct(F.md5("content")).alias("n"), F.max(F.length("content")).cast("bigint").alias("n_tokens"))
    one = counts.where("n = 1").select("normed_identifier", "n_tokens")

    def digests(read: DataFrame) -> DataFrame:
        return read.select("normed_identifier", "tok_len", F.md5("text").alias("digest"), (F.col("tok_offset_bytes") >= 1024).alias("placed"))

    return shards.through_shards(docs, one, _code_points, _from_code_points, "code points", 0x110000, digests, capacity=8_000_000)


@query()
def packed_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The first packs of an endless dataset: sampled from the graph with the layout's tokens in
    the budget, collated with their bodies, and described by their spans."""
    layout = packs.make_layout("identifier_prefix_bos_eos")
    valid = catalog.lines(spark, d, "node_id", "tok_len", "raw_identifier", "outgoing").where("node_id is not null")
    files = table(spark, d, "stack_file").where("content <> ''").groupBy(trimmed("normed_identifier").alias("id")).agg(F.min_by("content", F.xxhash64("content")).alias("content"))
    bodies = materialize(valid.join(files, "id").select(F.col("node_id").alias("node"), packs.char_codes(F.col("content")).alias("tokens"), "raw_identifier", "outgoing"), "bodies")
    title = F.length(packs.title_text(F.col("raw_identifier")))
    nodes = bodies.select("node", F.size("tokens").cast("bigint").alias("length"), (title + 2).alias("extra"))
    settings = packs.PackSettings(4096, 1024, order_mode="prefer_targets_first")
    sampled = traversal.sampled_packs(nodes, catalog.id_edges_of(valid), list(range(6)), 4, "bfs", settings)
    rows = packs.packed_sequences(packs.first_packs(sampled, 20), bodies, layout)
    return rows.select("seed", "pack", F.size("tokens").alias("n_tokens"), F.size("spans").alias("n_docs"), F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")).alias("tokens_md5"))


# --------------------------------------------------------------------------- statistics


@query("""select case when regexp_matches(path, '[^/.][^/]*?\\.[^./]+$') then lower(regexp_extract(path, '(\\.[^./]+)$', 1)) else '<none>' end as extension, count(*) as n_files, count(distinct repo) as n_repos
 from files group by 1""".replace("select case", f"with {catalog._F} select case", 1))
def code_extensions(spark: SparkSession, d: str) -> DataFrame:
    files = catalog.code_files(spark, d)
    return files.groupBy(idn.extension("path").alias("extension")).agg(F.count("*").alias("n_files"), F.countDistinct("repo").alias("n_repos"))


@query(f"select count(*) as n_kept, (select count(*) from (with {catalog._F} select distinct repo, path from files)) as n_before, round(count(*) / (select count(*) from (with {catalog._F} select distinct repo, path from files)), 9) as kept_share from ({catalog.ORACLES['code_graph']})")
def code_kept_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the code files that stay in the graph after its filters."""
    before = catalog.code_files(spark, d).select("repo", "path").distinct().count()
    kept = catalog.code_graph(spark, d).agg(F.count("*").alias("n_kept"))
    return kept.select("n_kept", F.lit(before).cast("bigint").alias("n_before"), F.round(F.col("n_kept") / F.lit(max(before, 1)), 9).alias("kept_share"))


@query(f"""with {catalog._V}, {catalog._SPLIT}, u as (select v.id, sp.split, case when char_count < 1000 then 0 when char_count < 5000 then 1 when char_count < 20000 then 2 else 3 end as cb from valid v join sp using (id)),
 p as (select split, {', '.join(f'count(*) filter (cb = {k}) / count(*) as c{k}' for k in range(4))} from u group by 1), w as (select {', '.join(f'count(*) filter (cb = {k}) / count(*) as c{k}' for k in range(4))} from u)
 select p.split, round({' + '.join(f'abs(p.c{k} - w.c{k})' for k in range(4))}, 9) as distance from p, w""")
def split_profile_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far the splits' character buckets are from those of all split nodes."""
    n = catalog.nodes(spark, d).select("char_count", cleaned_split("split").alias("split"), F.lit(0).alias("degree")).where("split is not null")
    per = nodesplits.bucket_profiles(n, "split")
    whole = nodesplits.bucket_profiles(n.withColumn("g", F.lit(1)), "g").first()
    names = [f"chars_{k}" for k in range(4)]
    whole = whole.asDict() if whole else dict.fromkeys(names, 0)
    return per.select("split", F.round(nodesplits.profile_distance([F.col(c) for c in names], [F.lit(whole[c]) for c in names]), 9).alias("distance"))


@query("""with t as (select event_type as phase, user_id as rank, value as seconds from events where value is not null), r as (select phase, rank, avg(seconds) as m from t group by 1, 2)
 select t.phase, round(avg(seconds), 6) as mean_seconds, round(stddev_samp(seconds), 6) as std_seconds, count(*) as n, (select round(min(m), 6) from r where r.phase = t.phase) as least_rank,
 (select round(median(m), 6) from r where r.phase = t.phase) as median_rank, (select round(max(m), 6) from r where r.phase = t.phase) as greatest_rank from t group by 1""")
def phase_timings(spark: SparkSession, d: str) -> DataFrame:
    """Timing summary per phase over ranks (event values by type and user)."""
    rows = table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("phase"), F.col("user_id").alias("rank"), F.col("value").alias("seconds"))
    out = corpus.timing_summary(rows)
    return out.select("phase", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("phase", "n")])


@query(f"""with {catalog._L}, r as (select *, row_number() over (partition by row_id order by logit desc, token_id) as n from lg) select round(avg(case when n <= 5 then 1.0 else 0.0 end), 9) as top5 from r where token_id = row_id % 7""")
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.row_logits(spark, d)
    came = rows.select("row_id").distinct().select("row_id", (F.col("row_id") % 7).cast("int").alias("token_id"))
    return logits.accuracy(rows, came, 5).select(F.round("top5", 9).alias("top5"))


@query(f"""with {catalog._L}, o as (select row_id, token_id, case when row_id % 4 = 0 then null when row_id % 4 = 1 and token_id % 2 = 0 then null else 0.0 end as flat from lg),
 k as (select row_id, token_id, row_number() over (partition by row_id order by token_id) as i, count(*) over (partition by row_id) as n from o where flat is not null and row_id % 4 < 2),
 a as (select row_id, min(token_id) as token_id from k where i * 1.0 / n >= (row_id % 97) / 97.0 * (1 - 1e-12) group by 1)
 select l.row_id, coalesce(a.token_id, 0) as token_id from (select distinct row_id from lg where row_id % 4 < 2) l left join a using (row_id)""")
def draw_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Draws where logits are odd: rows with all tokens removed give 0, rows with a NaN draw
    evenly among their finite tokens."""
    rows = catalog.row_logits(spark, d).where("row_id % 4 < 2")
    gone, nan = F.lit(float("-inf")), F.lit(float("nan"))
    odd = rows.withColumn("logit", F.when(F.col("row_id") % 4 == 0, gone).when(F.col("token_id") % 2 == 0, nan).otherwise(F.col("logit")))
    u = rows.select("row_id").distinct().select("row_id", ((F.col("row_id") % 97) / F.lit(97.0)).alias("u"))
    return logits.draw(odd, u)


# ------------------------------------------------------------------- oracles of catalogue queries

# nodes that reach each other share a component; the walk stays within what reaches both ways
ORACLES["scc_labels"] = f"""with recursive {catalog._IE}, e as (select distinct src, dst from idedge where src <> dst),
 ahead(a, b) as (select src, dst from e union select r.a, e.dst from ahead r join e on e.src = r.b),
 mutual as (select x.a, x.b from ahead x join ahead y on y.a = x.b and y.b = x.a)
 select label, count(*) as n_nodes from (select a, greatest(a, max(b)) as label from mutual group by a) group by 1 having count(*) > 1"""

# one document at a time: the first placed whose targets within the pack are all out
ORACLES["pack_order_targets_first"] = f"""with recursive {catalog._P}, e as (select distinct src, dst from (select a.node_id as src, b.node_id as dst from (select node_id, trim(unnest(outgoing), {catalog._T}) as t from valid) a join valid b on b.id = a.t)),
 r as (select pack_id, doc_id, pos, row_number() over (partition by pack_id order by pos, doc_id) as k from placed),
 w as (select a.pack_id, a.k, list(b.k) filter (b.k is not null) as waits from r a left join (r b join e on e.dst = b.doc_id) on b.pack_id = a.pack_id and e.src = a.doc_id group by 1, 2),
 p as (select pack_id, list(struct_pack(k := k, waits := coalesce(waits, [])) order by k) as docs from w group by 1),
 step(pack_id, docs, done) as (select pack_id, docs, []::bigint[] from p
  union all select pack_id, docs, list_append(done, nxt) from (select pack_id, docs, done, list_filter(docs, lambda x: not list_contains(done, x.k) and list_has_all(done, x.waits))[1].k as nxt from step) where nxt is not null),
 last as (select pack_id, arg_max(docs, len(done)) as docs, arg_max(done, len(done)) as done from step group by 1),
 o as (select pack_id, list_concat(done, list_filter(list_transform(docs, lambda x: x.k), lambda k: not list_contains(done, k))) as ks from last)
 select o.pack_id, r.doc_id, r.pos, cast(list_position(ks, r.k) - 1 as int) as new_pos from o join r on r.pack_id = o.pack_id"""

# a running sum with resets, one document after the other
ORACLES["shard_assignment"] = f"""with recursive {catalog._V}, s as (select id as key, tok_len * 2 as n_bytes, row_number() over (order by id) as k from valid where tok_len > 0),
 walk(k, shard, nxt) as (select 0::bigint, -1, 0::bigint union all select s.k, case when w.shard < 0 or w.nxt + s.n_bytes > 1000000 then w.shard + 1 else w.shard end, (case when w.shard < 0 or w.nxt + s.n_bytes > 1000000 then 1024 else w.nxt end) + s.n_bytes
  from walk w join s on s.k = w.k + 1)
 select s.key, 0 as writer, w.shard, w.nxt - s.n_bytes as "offset", s.n_bytes from walk w join s using (k)"""


# ------------------------------------------------------------------- readers and writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


@query("select title, text as source_text, doc_id as page_id from documents where title is not null and text is not null and lang = 'en'")
def articles_read(spark: SparkSession, d: str) -> DataFrame:
    """Articles written as a dump (the main namespace holds the English ones) and read back."""
    folder = _folder(spark, "dump")
    namespace = F.when(F.col("lang") == "en", 0).otherwise(1).alias("namespace")
    docs = table(spark, d, "documents").select(namespace, "title", F.col("text").alias("source_text"), F.col("doc_id").alias("page_id"))
    docs.write.option("compression", "gzip").json(folder)
    return src.read_articles(spark, folder).where("title is not null").select("title", "source_text", "page_id")


@query("""with n as (select max_stars_repo_path as p, content from stack_file where max_stars_repo_name <> '' and max_stars_repo_path <> '' and content <> '')
 select p as max_stars_repo_path, count(*) as n_rows, cast(sum(length(content)) as bigint) as n_chars from n group by 1""")
def stack_rows_read(spark: SparkSession, d: str) -> DataFrame:
    """Code rows written as JSON lines and read back with the reader's schema."""
    folder = _folder(spark, "rows")
    table(spark, d, "stack_file").select("max_stars_repo_name", "max_stars_repo_path", "content").write.json(folder)
    rows = src.read_stack_rows(spark, folder).where("max_stars_repo_name <> '' and max_stars_repo_path <> '' and content <> ''")
    return rows.groupBy("max_stars_repo_path").agg(F.count("*").alias("n_rows"), F.sum(F.length("content")).alias("n_chars"))


@query("select 'item_' || item_id as normed_identifier, benchmark_name as raw_identifier, md5(passage) as digest from eval_item where passage is not null and benchmark_name is not null")
def markdown_folder_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as a folder of Markdown files and read back."""
    folder = _folder(spark, "markdown")
    items = table(spark, d, "eval_item").where("passage is not null and benchmark_name is not null").dropDuplicates(["item_id"])
    sinks.write_markdown_files(items.select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("normed_identifier"), F.col("benchmark_name").alias("raw_identifier"), F.col("passage").alias("body")), folder)
    return src.read_markdown_folder(spark, folder).select("normed_identifier", "raw_identifier", F.md5("content").alias("digest"))


@query(f"with {catalog._V} select id as normed_identifier, raw_identifier, char_count, tok_len, tok_shard_idx, tok_offset_bytes from valid where tok_len > 0 and tok_shard_idx is not null and tok_offset_bytes is not null")
def graph_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes written as sorted JSON lines and read back; nodes without tokens are left out."""
    folder = _folder(spark, "graph")
    valid = catalog.nodes(spark, d).where("tok_len > 0 and tok_shard_idx is not null and tok_offset_bytes is not null").withColumnRenamed("id", "normed_identifier")
    sinks.write_graph(valid.select("normed_identifier", "raw_identifier", "char_count", "outgoing", "incoming", "tok_shard_idx", "tok_offset_bytes", "tok_len"), folder)
    return src.checked_nodes(src.read_graph(spark, folder)).select("normed_identifier", "raw_identifier", "char_count", "tok_len", "tok_shard_idx", "tok_offset_bytes")


@query(f"with {catalog._V}, {catalog._SPLIT} select id as normed_identifier, split from sp")
def splits_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Splits written as their document and looked up again."""
    folder = _folder(spark, "splits")
    assigned = materialize(catalog.nodes(spark, d).select("id", cleaned_split("split").alias("split")).where("split is not null"), "splits")
    sinks.splits_document(assigned, f"{folder}/splits.json", {"seed": 7})
    return src.split_lookup(spark, f"{folder}/splits.json").select("normed_identifier", "split")


@query("select upper(substr(title, 1, 1)) as letter, count(*) as n from (select title from documents where regexp_matches(title, '^[A-Za-z0-9]')) group by 1")
def articles_by_letter(spark: SparkSession, d: str) -> DataFrame:
    """Articles written in folders by first letter."""
    folder = _folder(spark, "letters")
    docs = table(spark, d, "documents").where(F.regexp_like("title", F.lit("^[A-Za-z0-9]"))).select(F.col("title").alias("normed_identifier"), F.col("text").alias("body"))
    sinks.write_articles(docs, folder)
    return spark.read.schema("normed_identifier string, body string, letter string").parquet(folder).groupBy(F.col("letter").cast("string").alias("letter")).agg(F.count("*").alias("n"))


@query()
def code_with_import_links(spark: SparkSession, d: str) -> DataFrame:
    """Code files whose imported modules are written as links."""
    return catalog.code_files(spark, d, linked=imp.import_links(F.col("content"))).select("file_id", F.md5("linked").alias("digest"))


@query()
def document_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Unified differences between the two deliveries of a text in which line ends differ."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return docs.select("doc_id", corpus.unified_diff(F.col("text"), F.regexp_replace("text", r"\r\n?", "\n")).alias("diff")).where("diff <> ''")


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@query("select doc_id, length(text) as n_chars, true as same from documents where text <> ''")
def tokenizer_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Articles by way of a public byte-level vocabulary and back, compared with the text."""
    docs = table(spark, d, "documents", "doc_id").where("text <> ''").select("doc_id", "text")
    encoded = shards.encode_documents(docs, vocabularies.load(VOCABULARY), "text")

    @F.pandas_udf("string")
    def decoded(tokens: pd.Series) -> pd.Series:
        vocabulary = vocabularies.open_vocabulary(VOCABULARY)
        return tokens.map(lambda t: vocabulary.decode([int(x) for x in t]), na_action="ignore")

    return encoded.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), (decoded("tokens") == F.col("text")).alias("same"))


@query()
def bpe_token_links(spark: SparkSession, d: str) -> DataFrame:
    """Markdown links in the articles' tokens of a byte-level vocabulary, with token positions."""
    vocabulary = vocabularies.open_vocabulary(VOCABULARY)
    middles = tuple(k for k in range(vocabulary.size) if "](" in vocabulary.decode([k]))
    openers = tuple(k for k in range(vocabulary.size) if vocabulary.decode([k]).endswith("["))
    docs = table(spark, d, "documents", "doc_id").where("text <> ''").select("doc_id", "text")
    tokens = shards.encode_documents(docs, vocabularies.load(VOCABULARY), "text").select("doc_id", "tokens")
    return detectors.detected_links(tokens, _BpeLinks(VOCABULARY, middles, openers), "doc_id")


class _BpeLinks:
    """A detector that opens its vocabulary where it runs."""

    def __init__(self, path: str, middles: tuple[int, ...], openers: tuple[int, ...]) -> None:
        self.path, self.middles, self.openers = path, middles, openers

    def __call__(self, tokens: Sequence[int]) -> list[tuple[int, str]]:
        decode = vocabularies.open_vocabulary(self.path).decode
        return detectors.markdown_links(tokens, lambda ids: decode([int(i) for i in ids]), self.middles, self.openers)


# ------------------------------------- what every right answer of a query without SQL has in common


@query(f"with {catalog._V} select count(*) as n_nodes, 0 as n_unsettled from valid")
def lpa_settled(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose community isn't the most frequent, smallest one among their neighbours."""
    n, e = catalog.linked(spark, d)
    labels = nodesplits.label_communities(n, e)
    near = graph.undirected_edges(graph.internal_edges(n, e)).join(labels.select(F.col("id").alias("dst"), "community"), "dst")
    votes = near.groupBy("src", "community").agg(F.count("*").alias("n"))
    best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b")).select(F.col("src").alias("id"), F.col("b.community").alias("best"))
    return labels.join(best, "id", "left").agg(F.count("*").alias("n_nodes"), F.sum(F.coalesce((F.col("best") != F.col("community")).cast("bigint"), F.lit(0))).alias("n_unsettled"))


@query(f"""with {catalog._UE}, u as (select v.id, count(ue.b) as degree from valid v left join ue on ue.a = v.id group by 1), n as (select count(*) as n from u where degree >= 2)
 select n as n_nodes, cast(round_even(0.05 * n, 0) as bigint) as n_random, 0 as n_thin, true as near_fraction from n""")
def split_assignment_rules(spark: SparkSession, d: str) -> DataFrame:
    """Eligible nodes, those of val_random, nodes of val_community with fewer than two neighbours
    in it, and whether val_community has two to seven of the five percent asked for."""
    n, e = catalog.linked(spark, d, "char_count")
    done = materialize(nodesplits.split_nodes(n, e, 2, 0.05, 0.05, seed=7), "assigned")
    held = done.where("split = 'val_community'").select("id")
    thin = graph.undirected_degrees(held, e).where("degree < 2").count()
    share = F.sum((F.col("split") == "val_community").cast("int")) / F.count("*")
    return done.agg(F.count("*").alias("n_nodes"), F.sum((F.col("split") == "val_random").cast("bigint")).alias("n_random"), F.lit(thin).cast("bigint").alias("n_thin"), share.between(0.02, 0.07).alias("near_fraction"))


@query("select unnest(['random', 'random_walk', 'bfs', 'dfs', 'bfs_then_random']) as strategy, 32 as n_packs, 0 as n_wrong_packs, 0 as n_wrong_lengths")
def sampled_pack_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per strategy the packs of eight seeds, those over the budget or with a document twice, and
    documents longer than they are or than the document budget."""
    valid = catalog.lines(spark, d, "node_id", "tok_len", "outgoing").where("node_id is not null")
    nodes = valid.select(F.col("node_id").alias("node"), F.col("tok_len").alias("whole"))
    edges = materialize(catalog.id_edges_of(valid), "id-edges")
    out = None
    for strategy in ("random", "random_walk", "bfs", "dfs", "bfs_then_random"):
        packed = traversal.sampled_packs(nodes.withColumnRenamed("whole", "length"), edges, list(range(8)), 4, strategy, packs.PackSettings(2048, 1024, order_mode="prefer_targets_first"))
        rows = packed.join(nodes, "node").withColumn("bad", (F.col("length") > F.least("whole", F.lit(1024))) | (F.col("length") <= 0))
        per = rows.groupBy("seed", "pack").agg(F.sum("length").alias("n"), F.count("*").alias("docs"), F.countDistinct("node").alias("different"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
        wrong = (F.col("n") > 2048) | (F.col("docs") != F.col("different"))
        one = per.agg(F.lit(strategy).alias("strategy"), F.count("*").alias("n_packs"), F.sum(wrong.cast("bigint")).alias("n_wrong_packs"), F.sum("bad").alias("n_wrong_lengths"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {catalog._P}, l as (select p.pack_id from placed p join (select id, trim(unnest(outgoing), {catalog._T}) as t from valid) o on o.id = p.id where o.t <> '')
 select count(distinct pack_id) as n_sessions, 0 as n_wrong_sessions, 0 as n_wrong_documents from l""")
def context_rules(spark: SparkSession, d: str) -> DataFrame:
    """Sessions, those over the limits of the context or without just one root, and documents
    whose length isn't that of the corpus or whose depth is beyond the limit."""
    settings = ctx.ContextSettings()
    known = materialize(catalog._corpus(spark, d), "corpus")
    rows = ctx.assemble_contexts(catalog._sessions(spark, d), known, settings).join(known.select(F.col("target").alias("identifier"), F.col("length").alias("whole")), "identifier", "left")
    bad = ~F.col("is_root") & ((F.col("length") != F.coalesce("whole", F.lit(-1))) | ~F.col("depth").between(1, settings.max_link_depth + 1))
    size = F.sum(F.when(F.col("active"), F.col("length")).otherwise(0))
    per = rows.groupBy("session").agg(
        size.alias("size"), F.sum((F.col("active") & ~F.col("is_root")).cast("int")).alias("aux"), F.sum(F.col("is_root").cast("int")).alias("roots"), F.sum(bad.cast("bigint")).alias("bad"),
        (F.count(F.when(F.col("active"), 1)) - F.countDistinct(F.when(F.col("active"), F.col("identifier")))).alias("twice"),
    )
    wrong = (F.col("size") > settings.max_context) | (F.col("aux") > settings.max_aux_docs) | (F.col("roots") != 1) | (F.col("twice") > 0)
    return per.agg(F.count("*").alias("n_sessions"), F.sum(wrong.cast("bigint")).alias("n_wrong_sessions"), F.sum("bad").alias("n_wrong_documents"))


@query(f"""with {catalog._P}, l as (select p.pack_id from placed p join (select id, trim(unnest(outgoing), {catalog._T}) as t from valid) o on o.id = p.id where o.t <> '') select count(distinct pack_id) as n_sessions, 0 as n_different from l""")
def context_stream_agrees(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose streamed context differs from the one assembled in a batch."""
    streamed = catalog.context_stream(spark, d)
    batch = ctx.assemble_contexts(catalog._sessions(spark, d).withColumn("root_length", F.lit(0)), catalog._corpus(spark, d), ctx.ContextSettings())
    per = batch.groupBy("session").agg(F.sum(F.col("active").cast("int")).alias("docs"), F.sum((~F.col("active")).cast("int")).alias("gone"), F.sum(F.when(F.col("active"), F.col("length")).otherwise(0)).alias("size"))
    same = (F.col("docs") == F.col("n_docs")) & (F.col("gone") == F.col("n_evicted")) & (F.col("size") == F.col("total_tokens"))
    return per.join(streamed, "session", "full").agg(F.count("*").alias("n_sessions"), F.sum((~F.coalesce(same, F.lit(False))).cast("bigint")).alias("n_different"))
