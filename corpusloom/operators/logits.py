"""Sampling and evaluation maths over rows of (row_id, token_id, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_rank() -> Window:
    return Window.partitionBy("row_id").orderBy(F.desc("logit"), F.asc("token_id"))


def greedy(logits: DataFrame) -> DataFrame:
    """The most probable token of each row, the smallest id among equals."""
    return logits.groupBy("row_id").agg(F.max_by("token_id", F.struct("logit", -F.col("token_id"))).alias("token_id"))


def temperature(logits: DataFrame, t: float) -> DataFrame:
    if t <= 0:
        return logits.join(greedy(logits), ["row_id", "token_id"], "left_semi")
    return logits.withColumn("logit", F.col("logit") / F.lit(t))


def top_k(logits: DataFrame, k: int | None) -> DataFrame:
    if not k:
        return logits
    return logits.withColumn("_n", F.row_number().over(_by_rank())).where(F.col("_n") <= k).drop("_n")


def softmax(logits: DataFrame) -> DataFrame:
    top = F.max("logit").over(Window.partitionBy("row_id"))
    e = logits.withColumn("_e", F.exp(F.col("logit") - top))
    return e.withColumn("probability", F.col("_e") / F.sum("_e").over(Window.partitionBy("row_id"))).drop("_e")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """Nucleus filter: the two first tokens always stay, the others while the sum of the
    tokens before them is at most ``p``; active for 0 < p < 1."""
    if not 0 < p < 1:
        return logits
    before = F.coalesce(F.sum("probability").over(_by_rank().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = softmax(logits).withColumn("_n", F.row_number().over(_by_rank())).withColumn("_before", before)
    return ranked.where((F.col("_n") <= 2) | (F.col("_before") <= p)).drop("_n", "_before", "probability")


def draw(logits: DataFrame, uniforms: DataFrame) -> DataFrame:
    """Inverse-distribution draw of a token per row with given uniform numbers (row_id, u).

    Removed tokens have a logit of minus infinity or no row.  Where a logit is NaN or infinite
    the finite ones of the row are equally probable; a row without any gives token 0.
    """
    whole = Window.partitionBy("row_id")
    odd = F.isnan("logit") | (F.col("logit") == F.lit(float("inf")))
    finite = ~F.isnan("logit") & (F.abs("logit") < F.lit(float("inf")))
    usable = logits.withColumn("_odd", F.max(odd).over(whole)).where(finite).withColumn("logit", F.when(F.col("_odd"), F.lit(0.0)).otherwise(F.col("logit"))).drop("_odd")
    cum = F.sum("probability").over(_by_rank().rowsBetween(Window.unboundedPreceding, 0))
    steps = softmax(usable).withColumn("_c", cum).join(uniforms, "row_id")
    hit = steps.where(F.col("_c") >= F.col("u") * F.lit(1 - 1e-12)).groupBy("row_id").agg(F.min_by("token_id", F.struct("_c", "token_id")).alias("token_id"))
    asked = logits.select("row_id").distinct().join(uniforms.select("row_id"), "row_id", "left_semi")
    return asked.join(hit, "row_id", "left").select("row_id", F.coalesce("token_id", F.lit(0)).cast(logits.schema["token_id"].dataType).alias("token_id"))


def repetition_penalty(logits: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Logits of seen tokens (row_id, token_id): positive ones divided, others multiplied."""
    marked = logits.join(seen.select("row_id", "token_id", F.lit(True).alias("_seen")).distinct(), ["row_id", "token_id"], "left")
    changed = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return marked.withColumn("logit", F.when(F.col("_seen"), changed).otherwise(F.col("logit"))).drop("_seen")


def entropy(logits: DataFrame) -> DataFrame:
    """Entropy in nats and its share of the greatest possible one, per row."""
    p = softmax(logits)
    return p.groupBy("row_id").agg((-F.sum(F.when(F.col("probability") > 0, F.col("probability") * F.log("probability")).otherwise(0.0))).alias("entropy"), F.count("*").alias("vocabulary")).withColumn(
        "entropy_share", F.when(F.col("vocabulary") > 1, F.col("entropy") / F.log(F.col("vocabulary").cast("double"))).otherwise(0.0)
    )


def token_metrics(logits: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per document: mean bits per token, entropy share and perplexity; ``tokens`` has
    row_id, doc_id and the token that came (token_id)."""
    p = softmax(logits).join(tokens, ["row_id", "token_id"]).join(entropy(logits).select("row_id", "entropy_share"), "row_id")
    bits = -F.log2("probability")
    return p.groupBy("doc_id").agg(F.round(F.avg(bits), 2).alias("bits_per_token"), F.round(F.avg("entropy_share"), 3).alias("entropy_share"), F.exp(F.avg(-F.log("probability"))).alias("perplexity"), F.count("*").alias("n_tokens"))


def accuracy(logits: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    ranked = logits.withColumn("_n", F.row_number().over(_by_rank())).join(tokens, ["row_id", "token_id"])
    return ranked.agg(F.avg((F.col("_n") <= k).cast("double")).alias(f"top{k}"))


def shifted(tokens: DataFrame, pack: str = "pack_id", pos: str = "pos") -> DataFrame:
    """Input and target token of each position: the next token of the pack."""
    return tokens.withColumn("target", F.lead("token_id").over(Window.partitionBy(pack).orderBy(pos))).where("target is not null")
