"""Generated, minified, vendored and data files among source files, by Re-Pair grammars.

One pass over the files without a shuffle tokenises batches of them and infers grammars:

* High rule reuse: a grammar that is small against its text means one structure used again
  and again, which is how generated tables, minified scripts and listings of data look.
* Literals that no rule shortens: where most of a file's characters stand in them, it is a
  blob saved as code.
* Rules shared across repositories: the passages that a file has in common with a known
  package's file from another repository.  Files emit those of their rules that may occur in
  a package; they are joined with the packages' rules on the rule, so the number of packages
  is not limited.

Generators also sign files whose bodies look like hand-written code, which no statistic of
their grammars can tell; for these a signature in a comment of its own decides.

Defined results: null, empty and blank contents are hand-written; a file without
repository can't be at home anywhere; repeated deliveries give equal results and count
once; invalid surrogates are read as they are; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import grammar
from corpusloom.session import materialize

#: Grammar size per token up to which a file is one repeated structure, and, for files that
#: are packed like minified ones (few blanks, one-letter names, long lines), a higher limit.
REUSE_RATIO = 0.2
PACKED_RATIO = 0.45
REUSE_TOKENS = 60
#: Tokens up to which a file is one piece for its grammar; longer ones have several of equal
#: length, as grammars of longer texts are smaller per token whatever the text.
PIECE_TOKENS = 1024
#: Share of the characters other than blanks that stand in literals no rule shortens.
DATA_SHARE = 0.6
DATA_TOKENS = 20
#: Blanks per character and one-letter names per word of minified files.
MINIFIED_BLANKS = 0.07
MINIFIED_NAMES = 0.35
MINIFIED_LINE = 120
#: Tokens of the file, or of the package's file, that lie in shared rules.
VENDORED_SHARE = 0.5
#: Files with fewer tokens in rules must share all of them, as must the package's file.
SMALL_TOKENS = 16
#: Characters of one batch of texts, which bounds the kernels' memory.
BATCH_CHARS = 500_000
#: Bits of the filter that lets through rules which may occur in a package.
FILTER_BITS = 1 << 22

# The forms in which generators sign their output.
MARKER = re.compile(
    r"(?im)^[ \t\ufeff]*(?:#|//|/\*+|\*|--|;|<!--)+[^\n]*(?:@generated\b|<auto-?generated|\bauto-?generated (?:file|code|by|from)|-\*-\s*generated:|\bcode generated by\b|\bgenerated (?:by|from|with) [^\n]*(?:do not|don't)"
    r"|\bdo not (?:edit|modify)\b|\bthis file (?:was|is) (?:created|generated|produced|written) (?:automatically|by)\b|\bmachine[- ](?:made|generated)\b|\boutput of \S+,? edit\b|\bcreated by \S+ compiler\b|\bchanges will be lost\b)"
)


def has_marker(text: str) -> bool:
    """Whether a comment at the start of a line, outside strings, signs the file as generated."""
    for hit in MARKER.finditer(text):
        before = text[: hit.start()]
        if before.count('"""') % 2 == 0 and before.count("'''") % 2 == 0 and before.count("`") % 2 == 0:
            return True
    return False


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def _literals(data: np.ndarray, t: grammar.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens belong to data literals, and the characters each of them stands for."""
    end = t.start + t.length
    ups, lows, digs = (np.concatenate([[0], np.cumsum(kind[data])]) for kind in (_UPPER, grammar._LOWER, grammar._DIGIT))
    mixed = (ups[end] > ups[t.start]) & (lows[end] > lows[t.start]) & (digs[end] > digs[t.start])
    random = t.word & ((t.length >= 8) & mixed | (t.length >= 24))
    escape = t.word & (t.length == 3) & (data[t.start] == 120) & (t.start > 0) & (data[np.maximum(t.start - 1, 0)] == 92)
    literal = t.digit | random | escape
    # pieces between the +, / and - of an encoded literal and its commas and signs
    near = np.zeros(len(literal), dtype=bool)
    if len(literal) > 4:
        joint = ~t.word & np.isin(data[t.start], np.frombuffer(b"+/-,=\\'\"{}:[](),", dtype=np.uint8))
        near[1:-1] = literal[:-2] & literal[2:] & joint[1:-1]
        small = t.word & (t.length <= 24) & ~literal
        near[2:-2] |= small[2:-2] & (literal[:-4] & joint[1:-3] & joint[3:-1] & literal[4:])
    return literal | near, t.length + escape


def measure(texts: Sequence[str], tables: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    """Per text: tokens, grammar size per token, share of literals and of those that no rule
    shortens, blank share, one-letter names, line length; and its shared rules."""
    n = len(texts)
    data, offsets = grammar.batch_bytes(list(texts))
    t = grammar.tokenize(data, offsets)
    count = np.bincount(t.owner, minlength=n)
    pieces = np.maximum(1, -(-count // PIECE_TOKENS))
    starts = np.cumsum(pieces) - pieces
    place = np.arange(len(t.owner)) - (np.cumsum(count) - count)[t.owner]
    left, rules, _ = grammar.infer(t.shape, starts[t.owner] + place * pieces[t.owner] // np.maximum(count, 1)[t.owner], int(pieces.sum()))
    sizes = np.add.reduceat(left + 2 * rules, starts) if n else left
    blank = np.concatenate([[0], np.cumsum(grammar._SPACE[data])])
    size = offsets[1:] - offsets[:-1] - 1
    blanks = blank[offsets[1:] - 1] - blank[offsets[:-1]]
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    lines = newline[offsets[1:] - 1] - newline[offsets[:-1]] + 1
    literal, chars = _literals(data, t)
    solid = np.maximum(size - blanks, 1)
    data_share = np.bincount(t.owner, literal * chars, minlength=n) / solid
    # what is not in literals at all can't be in incompressible ones: only the rest needs grammars
    stiff = np.zeros(n)
    asked = (data_share >= DATA_SHARE)[t.owner]
    if asked.any():
        _, _, alone = grammar.infer(t.exact[asked], t.owner[asked], n)
        stiff = np.bincount(t.owner[asked], (literal[asked] & alone) * chars[asked], minlength=n) / solid
    names = t.word & ~t.digit
    single = np.bincount(t.owner[names & (t.length == 1)], minlength=n)
    words = np.bincount(t.owner[names], minlength=n)
    rule, owner, width = grammar.passages(t.exact, t.owner, tables)
    return {
        "tokens": count, "ratio": sizes / np.maximum(count, 1), "data": data_share, "stiff": stiff, "blanks": blanks / np.maximum(size, 1),
        "single": single / np.maximum(words, 1), "line": size / lines, "rule": rule.view(np.int64), "owner": owner, "width": width,
    }


def own_kinds(m: dict[str, np.ndarray], texts: Sequence[str]) -> list[str | None]:
    """Kind of each text by its own grammar, or by its signature."""
    packed = (m["blanks"] <= MINIFIED_BLANKS) & (m["single"] >= MINIFIED_NAMES) & (m["line"] >= MINIFIED_LINE)
    reused = (m["tokens"] >= REUSE_TOKENS) & (m["ratio"] <= np.where(packed, PACKED_RATIO, REUSE_RATIO))
    blob = (m["stiff"] >= DATA_SHARE) & (m["tokens"] >= DATA_TOKENS)
    out: list[str | None] = []
    for k, text in enumerate(texts):
        if reused[k]:
            out.append("minified" if packed[k] else "data" if m["data"][k] >= DATA_SHARE else "generated")
        elif blob[k] and "-----BEGIN" not in text:
            out.append("data")
        else:
            out.append("generated" if has_marker(text) else None)
    return out


def pair_tables(packages: DataFrame) -> list[np.ndarray]:
    """Frequencies, as powers of two, of the pairs of the first rounds in the packages' files.

    A table has a fixed number of buckets, however many packages there are; pairs that share a
    bucket share its frequency, in all files alike.
    """
    tables: list[np.ndarray] = []
    for number in range(grammar.PAIR_TABLES):

        def count(frames: Iterator[pd.DataFrame], number: int = number, known: tuple = tuple(tables)) -> Iterator[pd.DataFrame]:
            total = np.zeros(grammar.PAIR_BUCKETS, dtype=np.int64)
            for frame in frames:
                for lo, hi in _batches(list(frame["content"])):
                    data, offsets = grammar.batch_bytes(list(frame["content"][lo:hi]))
                    t = grammar.tokenize(data, offsets)
                    total += np.bincount(grammar.passages(t.exact, t.owner, known, count_round=number)[0], minlength=grammar.PAIR_BUCKETS)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"bucket": used, "n": total[used]})

        sums = packages.mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros(grammar.PAIR_BUCKETS, dtype=np.uint8)
        table[sums["bucket"].to_numpy(np.int64)] = np.log2(sums["n"].to_numpy(np.float64) + 1).astype(np.uint8)
        tables.append(table)
    return tables


def kinds(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file_id, kind): generated, minified, data, vendored; hand-written files are left out.

    ``files``: file_id, repo, content; ``packages``: home_repo, content.  The tables of pair
    frequencies (256 kB) and the filter of package rules (512 kB) are what tasks are sent.
    """
    spark = files.sparkSession
    known = packages.where("content is not null and trim(content) <> ''").select(F.lower(F.trim("home_repo")).alias("home"), "content").distinct()
    known = materialize(known.select("home", "content", F.xxhash64("content").alias("package"), F.md5("content").alias("digest")), "packages")
    tables = pair_tables(known.select("content"))

    def rules_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo, hi in _batches(list(frame["content"])):
                part = frame.iloc[lo:hi]
                data, offsets = grammar.batch_bytes(list(part["content"]))
                t = grammar.tokenize(data, offsets)
                rule, owner, width = grammar.passages(t.exact, t.owner, tables)
                total = np.bincount(owner, width, minlength=len(part)).astype(np.int64)
                if len(rule):
                    yield pd.DataFrame({"digest": part["digest"].to_numpy()[owner], "home": part["home"].to_numpy()[owner], "rule": rule.view(np.int64), "size": total[owner]}).drop_duplicates()

    package_rules = materialize(known.mapInPandas(rules_of, "digest string, home string, rule bigint, size bigint"), "package-rules")
    places = package_rules.select(F.pmod("rule", F.lit(FILTER_BITS)).cast("int").alias("place")).distinct().toPandas()["place"].to_numpy(np.int64)
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[places] = True
    shared = spark.sparkContext.broadcast((tables, np.packbits(bits)))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, packed = shared.value
        allowed = np.unpackbits(packed).astype(bool)
        for frame in frames:
            texts = list(frame["content"])
            for lo, hi in _batches(texts):
                part, own = frame.iloc[lo:hi], texts[lo:hi]
                m = measure(own, tables)
                found = own_kinds(m, own)
                told = np.array([k for k, kind in enumerate(found) if kind is not None], dtype=np.int64)
                if len(told):
                    yield pd.DataFrame({"file_id": part["file_id"].to_numpy()[told], "kind": [found[k] for k in told], "repo": part["repo"].to_numpy()[told], "rule": 0, "width": 0, "total": 0})
                total = np.bincount(m["owner"], m["width"], minlength=len(own)).astype(np.int64)
                hit = allowed[m["rule"] % FILTER_BITS]
                rows = pd.DataFrame({"at": m["owner"][hit], "rule": m["rule"][hit], "width": m["width"][hit]}).groupby(["at", "rule"], as_index=False)["width"].sum()
                at = rows["at"].to_numpy(np.int64)
                if len(at):
                    yield pd.DataFrame({"file_id": part["file_id"].to_numpy()[at], "kind": None, "repo": part["repo"].to_numpy()[at], "rule": rows["rule"], "width": rows["width"], "total": total[at]})

    source = files.where("file_id is not null and content is not null and trim(content) <> ''").select("file_id", F.lower(F.trim("repo")).alias("repo"), "content")
    looked = materialize(source.mapInPandas(look, "file_id bigint, kind string, repo string, rule bigint, width bigint, total bigint"), "file-rules")
    own = looked.where("kind is not null").select("file_id", "kind").distinct()
    # by file, so that neither the repeated deliveries nor the sums per package shuffle again
    theirs = looked.where("kind is null").select("file_id", "repo", "rule", "width", "total").repartition("file_id").distinct()
    pairs = theirs.join(package_rules.select("rule", "digest", "size").distinct(), "rule").groupBy("file_id", "repo", "total", "digest", "size").agg(F.sum("width").alias("common"))
    small = F.col("total") < SMALL_TOKENS
    close = F.when(small, (F.col("common") == F.col("total")) & (F.col("common") >= F.col("size"))).otherwise(F.greatest(F.col("common") / F.col("total"), F.col("common") / F.col("size")) >= VENDORED_SHARE)
    homes = package_rules.select("digest", "home").distinct()
    at_home = F.max(F.coalesce(F.col("repo") == F.col("home"), F.lit(False)))
    vendored = pairs.where(close).join(homes, "digest").groupBy("file_id").agg(at_home.alias("at_home")).where("not at_home").select("file_id", F.lit("vendored").alias("kind"))
    both = own.unionByName(vendored)
    # a copy of a package's file counts as vendored whatever its own grammar looks like
    return both.groupBy("file_id").agg(F.max_by("kind", F.when(F.col("kind") == "vendored", 1).otherwise(0)).alias("kind"))
