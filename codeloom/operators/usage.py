"""Usage logs and evaluation measures (inventory E15 to E19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, last: int | None = None) -> DataFrame:
    """Distinct sessions, the last ``last`` of them by time; doubled records count once."""
    keyed = rows.withColumn("_k", F.xxhash64("ts", "dur_s", "v", F.to_json("tools"), F.to_json("search"), F.to_json("index"))).dropDuplicates(["_k"]).drop("_k")
    return keyed if last is None else keyed.orderBy(F.desc("ts"), F.desc("dur_s")).limit(last)


def tool_usage(rows: DataFrame) -> DataFrame:
    """(tool, n, ms, err, max_ms, avg_ms) over the sessions."""
    t = rows.select(F.explode("tools").alias("tool", "s"))
    out = t.groupBy("tool").agg(F.sum("s.n").alias("n"), F.sum("s.ms").alias("ms"), F.sum("s.err").alias("err"), F.max("s.max_ms").alias("max_ms"))
    return out.withColumn("avg_ms", F.try_divide("ms", "n"))


def error_kinds(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tools").alias("tool", "s")).select(F.explode("s.err_kinds").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))


def search_quality(rows: DataFrame) -> DataFrame:
    """One row: queries, misses, query-weighted quality, incremental runs, files."""
    q = F.col("search.queries")
    return rows.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(q).alias("queries"),
        F.sum("search.zero").alias("zero"),
        F.try_divide(F.sum(F.col("search.avg_quality") * q), F.sum(q)).alias("avg_quality"),
        F.sum("index.incr").alias("incr"),
        F.max("index.files").alias("files"),
        F.max("index.full_ms").alias("full_ms"),
    )


#: Words that make a query read as natural language.
NATURAL = "the a an is are of in to for with how what where when why which that this does do can and or".split()


def classify(query):
    """Bucket of a search query column: empty, kw-single, kw-qualified, kw-word, concept-cjk, concept-nl, kw-multi or concept-mixed."""
    s = F.trim(F.regexp_replace(F.trim(query), r"""^"(.*)"$|^'(.*)'$""", "$1$2"))
    cjk = s.rlike(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]")
    words = F.split(s, r"\s+")
    ident = lambda t: t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & (t.contains("_") | t.rlike(r"[a-z][A-Z]|[A-Z]{2,}|[0-9]"))
    loose = lambda t: t.rlike(r"^[A-Za-z_][A-Za-z0-9_:./\-]*$") & t.rlike(r"[:./\-]")
    share = F.size(F.filter(words, lambda t: ident(t) | loose(t))) / F.size(words)
    natural = F.exists(words, lambda t: F.lower(t).isin(NATURAL))
    one = F.when(ident(s), "kw-single").when(loose(s), "kw-qualified").when(cjk, "concept-cjk").otherwise("kw-word")
    many = F.when(cjk, "concept-cjk").when(natural, "concept-nl").when(share >= 0.5, "kw-multi").otherwise("concept-mixed")
    return F.when(F.coalesce(s, F.lit("")) == "", "empty").when(F.size(words) == 1, one).otherwise(many)


def query_histogram(queries: DataFrame, column: str, samples: int = 20) -> DataFrame:
    """(bucket, n, share, samples): counts, percentages and the most frequent queries of each bucket."""
    c = queries.select(classify(F.col(column)).alias("bucket"), F.col(column).alias("q"))
    per = c.groupBy("bucket", "q").agg(F.count(F.lit(1)).alias("k"))
    top = per.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("k"), "q"))).where(F.col("r") <= samples)
    top = top.groupBy(F.col("bucket").alias("_b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "q"))), lambda x: x["q"]), "|").alias("samples"))
    n = per.groupBy("bucket").agg(F.sum("k").alias("n"))
    n = n.withColumn("share", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))  # a row a bucket
    return n.join(top, F.col("bucket") == F.col("_b")).select("bucket", "n", "share", "samples")


def evaluation(picks: DataFrame, decoys: tuple[str, ...] = ("Grep", "Read")) -> DataFrame:
    """One row with recall, fp_rate and overall of (query, expected, picked): a query whose expected answer is a decoy counts as held if a decoy was picked."""
    trap = F.col("expected").isin(*decoys)
    hit = ~trap & F.col("picked").eqNullSafe(F.col("expected"))
    held = trap & F.coalesce(F.col("picked").isin(*decoys), F.lit(False))
    n, t = F.count(F.lit(1)), F.count_if(trap)
    return picks.agg(
        F.try_divide(F.count_if(hit), n - t).alias("recall"), F.try_divide(t - F.count_if(held), t).alias("fp_rate"), F.try_divide(F.count_if(hit) + F.count_if(held), n).alias("overall")
    )


def majority(votes: DataFrame) -> DataFrame:
    """(query, picked) of (query, run, picked): the most frequent pick, ties to the earliest run."""
    n = votes.groupBy("query", "picked").agg(F.count(F.lit(1)).alias("k"), F.min("run").alias("first"))
    return n.groupBy("query").agg(F.max_by("picked", F.struct("k", (-F.col("first")).alias("neg"))).alias("picked"))


def latency(rows: DataFrame, column: str = "ms") -> DataFrame:
    """P50 as the discrete median and P99 as the largest of the samples."""
    return rows.agg(F.expr(f"percentile_disc(0.5) within group (order by {column})").cast("long").alias("p50"), F.max(column).alias("p99"))
