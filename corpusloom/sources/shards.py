"""Binary token shards: a header of 256 little-endian int32 and flat token ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.joins import bounded
from corpusloom.session import discard, freed_shuffles, materialize, shared_folder
from corpusloom.sources.files import open_system, read_json, write_json

# Fixed values of the format: header words, magic number and version.
HEADER_WORDS = 256
MAGIC = 11041999
VERSION = 1
HEADER_BYTES = HEADER_WORDS * 4

#: Tokens from which a Python worker hands on the documents that it has encoded or read.
BATCH_TOKENS = 1 << 20
#: ``through_shards``: bytes of tokens from which they go in parts, the most parts, and bytes that a task reads.
PART_BYTES, MAX_PARTS, READ_BYTES = 128 << 20, 16, 8 << 20


def token_dtype(vocabulary: int) -> np.dtype:
    """Smallest of the two token types that holds all ids."""
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def shard_header(count: int, item: int) -> bytes:
    header = np.zeros(HEADER_WORDS, dtype="<i4")
    header[:4] = (MAGIC, VERSION, count, item)
    return header.tobytes()


def pack_shard(tokens: np.ndarray) -> bytes:
    return shard_header(len(tokens), tokens.dtype.itemsize) + tokens.tobytes()


def read_header(data: bytes) -> tuple[int, int]:
    """(token count, item size); raises on a foreign file."""
    header = np.frombuffer(data[:HEADER_BYTES], dtype="<i4")
    if len(header) < HEADER_WORDS or header[0] != MAGIC or header[1] != VERSION:
        raise ValueError("not a token shard")
    return int(header[2]), int(header[3])


def _batches(rows: Iterator, kind: pa.DataType) -> Iterator[pa.Array]:
    """Arrow arrays of rows, each ended by the row that fills it.  Tokens are put in as one flat
    array; as Python lists they would cost many times the work."""

    def made(out: list) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array(out, kind)
        flat = [np.asarray(x, dtype=kind.value_type.to_pandas_dtype()) for x in out if x is not None]
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in out)])
        values = pa.array(np.concatenate(flat) if flat else [], kind.value_type)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([x is None for x in out], pa.bool_()))

    out, n = [], 0
    for row in rows:
        out.append(row)
        n += 0 if row is None else len(row)
        if n >= BATCH_TOKENS:
            yield made(out)
            out, n = [], 0
    if out:
        yield made(out)


def encode_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], text: str = "content", out: str = "tokens") -> DataFrame:
    """Token arrays; the encoder is built once per worker, and texts it fails on become null."""

    @F.arrow_udf("array<int>")
    def encode(frames: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder()

        def one(t: str | None) -> list[int] | None:
            try:
                return coder(t) if t is not None else None
            except Exception:  # noqa: BLE001 - a text that can't be encoded is left out
                return None

        for texts in frames:
            yield from _batches(map(one, texts.to_pylist()), pa.list_(pa.int32()))

    return docs.withColumn(out, encode(text))


def write_shards(documents: DataFrame, folder: str, dtype: str, tokenizer: str, capacity: int = 2_000_000_000, writers: int = 1, unique: bool = False) -> DataFrame:
    """Write (normed_identifier, tokens) as shards and metadata; returns the documents' places.

    Shards are planned from sizes alone; each is then written by one task, streaming its
    documents in order.  ``folder`` is a path that all executors share.  ``unique``: no
    identifier repeats, so tokens aren't shuffled to find those that do.
    """
    from corpusloom.operators.packs import assign_shards

    item = np.dtype(dtype).itemsize
    sized = documents.where("tokens is not null and size(tokens) > 0").select(F.col("normed_identifier").alias("key"), "tokens")
    if not unique:
        sized = sized.dropDuplicates(["key"])
    places = materialize(assign_shards(sized.select("key", (F.size("tokens") * item).cast("bigint").alias("n_bytes")), capacity, HEADER_BYTES, writers), "places")
    names = places.groupBy("writer", "shard").agg((F.sum("n_bytes") / item).cast("bigint").alias("total")).orderBy("writer", "shard").toPandas()
    names["idx"] = np.arange(len(names), dtype=np.int64)
    spark = documents.sparkSession
    numbered = places.join(bounded(spark.createDataFrame(names), 1_000_000), ["writer", "shard"]) if len(names) else places.withColumn("idx", F.lit(0).cast("bigint"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_system(folder)
        system.create_dir(base, recursive=True)
        current, out, written = None, None, []
        for frame in frames:
            for idx, total, tokens in zip(frame["idx"], frame["total"], frame["tokens"], strict=True):
                if idx != current:  # rows come shard by shard
                    if out is not None:
                        out.close()
                    current, out = idx, system.open_output_stream(f"{base}/shard_{idx:06d}.bin")
                    out.write(shard_header(int(total), item))
                    written.append(idx)
                out.write(np.asarray(tokens).astype(dtype).tobytes())
        if out is not None:
            out.close()
        yield pd.DataFrame({"idx": np.array(written, dtype=np.int64)})

    if len(names):
        planned = bounded(numbered.select("key", "idx", "offset", "total"), 200_000)
        rows = sized.join(planned, "key").repartition(len(names), "idx").sortWithinPartitions("idx", "offset")
        rows.select("idx", "total", "tokens").mapInPandas(write, "idx bigint").count()
    write_json(folder, "metadata.json", {"tokenizer": tokenizer, "dtype_str": str(np.dtype(dtype)), "shard_filenames": [f"shard_{i:06d}.bin" for i in range(len(names))]})
    return numbered.select(F.col("key").alias("normed_identifier"), F.col("idx").alias("tok_shard_idx"), F.col("offset").alias("tok_offset_bytes"), (F.col("n_bytes") / item).cast("bigint").alias("tok_len"))


def read_tokens(spark: SparkSession, folder: str, nodes: DataFrame) -> DataFrame:
    """Adds ``tokens`` to nodes; a place outside its shard gives null.

    Only the needed byte ranges of a shard are read.
    """
    return nodes.withColumn("tokens", _fetch(folder, "array<bigint>", lambda: lambda tokens: tokens))


def read_texts(spark: SparkSession, folder: str, nodes: DataFrame, decoder: Callable[[], Callable[[np.ndarray], str]]) -> DataFrame:
    """Adds ``text``, the decoded tokens, to nodes; else like ``read_tokens``.  Tokens are decoded
    where they are read, as they are larger than texts; the decoder is built once per worker."""
    return nodes.withColumn("text", _fetch(folder, "string", decoder))


def _fetch(folder: str, kind: str, maker: Callable[[], Callable]) -> Column:
    info = read_json(folder, "metadata.json")
    files, dtype = info["shard_filenames"], np.dtype(info["dtype_str"])

    @F.arrow_udf(kind)
    def fetch(frames: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        system, base = open_system(folder)
        opened: dict[int, tuple] = {}
        made = maker()

        def one(s: int | None, o: int | None, n: int | None) -> object:
            if pd.isna(s) or pd.isna(o) or pd.isna(n) or not 0 <= int(s) < len(files):
                return None
            if int(s) not in opened:
                handle = system.open_input_file(f"{base}/{files[int(s)]}")
                count, item = read_header(handle.read_at(HEADER_BYTES, 0))
                if item != dtype.itemsize:
                    raise ValueError(f"{files[int(s)]} has items of {item} bytes")
                opened[int(s)] = (handle, HEADER_BYTES + count * item)
            handle, end = opened[int(s)]
            inside = HEADER_BYTES <= int(o) and int(o) + int(n) * dtype.itemsize <= end
            return made(np.frombuffer(handle.read_at(int(n) * dtype.itemsize, int(o)), dtype=dtype)) if inside else None

        for frame in frames:
            yield from _batches(map(one, *(x.to_pylist() for x in frame)), pa.string() if kind == "string" else pa.list_(pa.int64()))

    return fetch("tok_shard_idx", "tok_offset_bytes", "tok_len")


def attach_tokens(graph: DataFrame, places: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Graph nodes with token places (nodes without are dropped) and splits where known."""
    out = graph.join(places, "normed_identifier")
    return out.join(splits, "normed_identifier", "left") if splits is not None else out.withColumn("split", F.lit(None).cast("string"))


def pretokenize(documents: DataFrame, graph: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], folder: str, tokenizer: str, vocabulary: int, splits: DataFrame | None = None, capacity: int = 2_000_000_000, writers: int = 1) -> DataFrame:
    """From source texts to a graph with token places: texts of graph nodes are encoded, written
    as shards below ``folder`` with their metadata, and the nodes that got tokens are returned
    with their places and splits.

    ``documents`` has normed_identifier and content (``stack_documents``, ``read_markdown_folder``);
    texts without a node are not encoded; of several texts of a node the first by hash is taken.
    """
    wanted = documents.select("normed_identifier", "content").join(graph.select("normed_identifier"), "normed_identifier", "left_semi")
    one = wanted.groupBy("normed_identifier").agg(F.min_by("content", F.xxhash64("content")).alias("content"))
    encoded = materialize(encode_documents(one, encoder).select("normed_identifier", "tokens"), "tokens")
    places = write_shards(encoded, folder, str(token_dtype(vocabulary)), tokenizer, capacity, writers, unique=True)
    discard(encoded)
    return attach_tokens(graph, places, splits)


def through_shards(documents: DataFrame, graph: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], decoder: Callable[[], Callable[[np.ndarray], str]], tokenizer: str, vocabulary: int, result: Callable[[DataFrame], DataFrame], capacity: int = 2_000_000_000) -> DataFrame:
    """What ``result`` makes of all graph nodes that get tokens, with their places and the text that
    is read from their shards again (``pretokenize``, then ``read_texts``).

    Shards are many times as large as compressed texts.  So nodes are dealt by a hash to up to
    ``MAX_PARTS`` parts; each part's shards are deleted when its result, which should be narrow,
    is written.  ``graph`` has normed_identifier and n_tokens, an estimate that sizes the parts.
    """
    spark = documents.sparkSession
    with freed_shuffles(spark):
        nodes = materialize(graph, "nodes")
        n_bytes = (nodes.agg(F.sum("n_tokens")).first()[0] or 0) * token_dtype(vocabulary).itemsize
        parts = max(1, min(MAX_PARTS, -(-n_bytes // PART_BYTES)))
        tasks = max(1, -(-n_bytes // (parts * READ_BYTES)))
        part = F.pmod(F.xxhash64("normed_identifier"), F.lit(parts)).cast("int")
        texts = materialize(documents.select("normed_identifier", "content", part.alias("part")), "texts", "part") if parts > 1 else None
        found = []
        for k in range(parts):
            with shared_folder(spark, "shards") as folder:
                placed = pretokenize(documents if texts is None else texts.where(F.col("part") == k), nodes.where(part == k), encoder, folder, tokenizer, vocabulary, capacity=capacity)
                block = (F.col("tok_offset_bytes") / READ_BYTES).cast("bigint")
                found.append(materialize(result(read_texts(spark, folder, placed.repartition(tasks, "tok_shard_idx", block), decoder)), "through-shards"))
        for used in (nodes, texts):
            if used is not None:
                discard(used)
    return reduce(DataFrame.unionByName, found)
