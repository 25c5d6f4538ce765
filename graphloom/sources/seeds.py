"""Seeds and samples: readers that check what they read, alias edges, scripts, synthetic cohorts, stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import risk as M

from .formats import first_of, read_jsonl, shred


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines at the path, or no rows where nothing lies there."""
    from pyspark.errors import AnalysisException

    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def intents(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """text and label from JSON (one list, or lines): texts that aren't empty, with a known label."""
    raw = spark.read.schema("text string, label string").option("multiLine", True).json(path)
    return raw.where(F.col("label").isin(labels) & (F.trim("text") != ""))


def dialogues(spark: SparkSession, path: str, system: str) -> DataFrame:
    """system, instruction, input, output from JSON lines under any of their names; rows without question or answer go."""
    raw = read_jsonl(spark, path, "system string, instruction string, question string, prompt string, input string, output string, answer string, response string")
    ask, reply = first_of("instruction", "question", "prompt", df=raw), first_of("output", "answer", "response", df=raw)
    return raw.where(ask.isNotNull() & reply.isNotNull()).select(F.coalesce(F.nullif("system", F.lit("")), F.lit(system)).alias("system"), F.trim(ask).alias("instruction"), F.trim(F.coalesce("input", F.lit(""))).alias("input"), F.trim(reply).alias("output"))


def with_aliases(docs: DataFrame, key: str = "name", alias: str = "alias", **kw) -> DataFrame:
    """Edges of nested documents, and HAS_ALIAS from each document to its aliases."""
    return shred(docs, key=key, **kw).unionByName(shred(docs, {alias: ("HAS_ALIAS", 0.99)}, key))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """file, place, line, statement: scripts cut at semicolons, comments after // gone, with the line that each starts on."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"(?m)//.*$", "").alias("t"))
    each = raw.select("file", F.posexplode(F.split("t", ";")).alias("place", "s"), "t")
    before = F.array_join(F.slice(F.split("t", ";"), F.lit(1), F.col("place")), ";")
    lead = F.regexp_extract("s", r"^\s*", 0)
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return each.select("file", "place", (1 + breaks(before) + breaks(lead)).alias("line"), F.regexp_replace("s", r"^\s+|\s+$", "").alias("statement")).where("statement <> ''")


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def synthetic_cohort(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """id and sixteen features of n persons, drawn inside the JVM; the same seed and partitions give the same rows.

    Counts of relatives are Poisson by inversion over 0 to 4, what lies above counts as 4.
    Symptom loads are gamma of shape 1.4 by one Wilson-Hilferty normal, near enough for a
    simulated load that is cut at 5.
    """
    u, g = (lambda k: F.rand(seed + k)), (lambda k: F.randn(seed + k))
    lognormal = lambda mean, sigma, k: mean * F.exp(sigma * g(k))
    c = F.col
    df = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism)
    df = df.withColumns({"age": 20 + 65 * u(1), "male": (u(2) < 0.49).cast("double")})
    df = df.withColumn("bmi", _clip(lognormal(23.0 + 0.045 * c("age") + 0.4 * c("male"), 0.16, 3), 15, 45))
    df = df.withColumns({"systolic_bp": _clip(102 + 0.46 * c("age") + 0.55 * c("bmi") + 3.0 * c("male") + 12 * g(4), 85, 220), "fasting_glucose": _clip(lognormal(4.7 + 0.006 * c("age") + 0.016 * c("bmi"), 0.13, 5), 3, 20), "total_cholesterol": _clip(4.5 + 0.012 * c("age") + 0.03 * c("bmi") + 0.9 * g(6), 2, 12)})
    df = df.withColumns({"diastolic_bp": _clip(0.62 * c("systolic_bp") + 6 + 7 * g(7), 50, 140), "ldl": _clip(0.62 * c("total_cholesterol") + 0.3 + 0.55 * g(8), 0.5, 8), "hdl": _clip(1.45 - 0.004 * c("age") - 0.02 * c("bmi") + 0.12 * (1 - c("male")) + 0.3 * g(9), 0.4, 3), "triglycerides": _clip(lognormal(1.1 + 0.012 * c("bmi") + 0.3 * (1 - c("male")), 0.42, 10), 0.3, 15), "heart_rate": _clip(72 + 0.06 * c("age") + 0.12 * c("bmi") + 10 * g(11), 40, 160)})
    df = df.withColumns({"smoking": (u(12) < _clip(0.10 + 0.0022 * c("age") + 0.16 * c("male"), 0, 0.65)).cast("double"), "drinking": (u(13) < 0.14 + 0.10 * c("male")).cast("double"), "_u": u(14), "low_activity": (u(15) < 0.42).cast("double"), "_g": g(16)})
    rate, shape, scale = 0.55, 1.4, 0.75
    upto, term, total = [], F.exp(F.lit(-rate)), F.lit(0.0)
    for k in range(4):
        total = total + term
        upto.append((c("_u") > total).cast("double"))
        term = term * rate / (k + 1)
    cube = F.greatest(F.lit(0.0), 1 - 1 / (9 * F.lit(shape)) + c("_g") / F.sqrt(9 * F.lit(shape)))
    return df.withColumns({"family_history": sum(upto[1:], upto[0]), "symptom_score": _clip(shape * scale * cube * cube * cube, 0, 5)}).drop("_u", "_g")


def synthetic_labels(cohort: DataFrame, disease: str, seed: int = 42) -> DataFrame:
    """The cohort with a 0/1 label drawn from the disease's logistic model plus a personal effect of deviation 0.85."""
    intercept, w = M.MODELS[disease]
    z = F.lit(intercept) + 0.85 * F.randn(seed + 17)
    for name, x in zip(M.FEATURES, w, strict=True):
        z = z + F.lit(x) * F.col(name)
    return cohort.withColumn("label", (F.rand(seed + 18) < M.sigmoid(z)).cast("int"))


def stratified_split(df: DataFrame, label: str, key: str, dev: float) -> DataFrame:
    """df with is_dev: floor(dev * n) rows of each label, those with the least md5 of their key; ties by the key.

    Counts of 4,096 hash buckets settle all but one bucket of a label, and only that bucket is
    ranked, so a label of any size is never one task's rows.  Keys are taken to be unique.
    """
    h = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    n = h.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(label)
    upto = F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    n = n.select(F.col(label).alias("_label"), F.col("_b").alias("_bucket"), "_n", F.coalesce(upto, F.lit(0)).alias("_before"), F.floor(dev * F.sum("_n").over(by)).alias("_want"))
    got = h.join(n, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_bucket")))
    edge = (F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") > F.col("_want"))
    sure = got.where(~edge).select(*df.columns, (F.col("_before") + F.col("_n") <= F.col("_want")).alias("is_dev"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    return sure.unionByName(got.where(edge).withColumn("_k", rank).select(*df.columns, (F.col("_before") + F.col("_k") <= F.col("_want")).alias("is_dev")))
