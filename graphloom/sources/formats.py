"""Sources and sinks: nested documents, JSON lines, XML records, CSV cohorts, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A disease document's list fields with relation and confidence.
RELATIONS = {"symptoms": ("HAS_SYMPTOM", 0.97), "treatments": ("TREATED_BY", 0.96), "drugs": ("USES_DRUG", 0.95), "checks": ("NEEDS_CHECK", 0.94), "complications": ("HAS_COMPLICATION", 0.92), "differential": ("DIFFERENTIAL_WITH", 0.90), "department": ("BELONGS_TO", 0.98), "population": ("AFFECTS", 0.88)}


def seed_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object with a `diseases` list, or a bare list, one row a document."""
    wrapped = spark.read.schema(f"diseases array<struct<{schema}>>").option("multiLine", True).json(path).where(F.col("diseases").isNotNull()).select(F.inline("diseases"))
    bare = spark.read.schema(schema.replace(":", " ")).option("multiLine", True).json(path)
    return wrapped.unionByName(bare.dropna("all"))


def relations(spark: SparkSession, path: str) -> DataFrame:
    """Relation rows with defaults for what is missing."""
    raw = spark.read.schema("head string, head_type string, relation string, tail string, tail_type string, confidence double, weight double, source_ref string").option("multiLine", True).json(path)
    defaults = {"head_type": "Disease", "tail_type": "Symptom", "confidence": 0.95, "weight": 1.0, "source_ref": ""}
    return raw.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def shred(docs: DataFrame, fields: dict[str, tuple[str, float]] = RELATIONS, key: str = "name") -> DataFrame:
    """Nested documents to edges: one row per distinct list entry, empty ones left out."""
    entries = F.array(*(F.struct(F.lit(rel).alias("rel"), F.lit(conf).alias("confidence"), F.coalesce(F.col(f), F.array().cast("array<string>")).alias("targets")) for f, (rel, conf) in fields.items() if f in docs.columns))
    each = docs.select(F.col(key).alias("source"), F.inline(entries))
    return each.select("source", "rel", "confidence", F.explode(F.array_distinct("targets")).alias("target")).where(F.trim("target") != "")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null, empty text and empty list fields are left out."""
    empty = {c: F.when(F.col(c) != "", F.col(c)) for c, t in df.dtypes if t == "string"} | {c: F.when(F.size(c) > 0, F.col(c)) for c, t in df.dtypes if t.startswith("array")}
    df.withColumns(empty).write.mode(mode).option("ignoreNullFields", "true").json(path)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Literature records from XML: labelled abstract parts joined, year from the first date there is."""
    schema = "PMID string, Title string, Abstract struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>, Year string, MedlineDate string, Keywords struct<Keyword:array<string>>"
    raw = spark.read.format("xml").option("rowTag", "Article").schema(schema).load(path)
    part = lambda x: F.concat(F.coalesce(F.concat(x["_Label"], F.lit(": ")), F.lit("")), F.coalesce(x["_VALUE"], F.lit("")))
    return raw.select(F.col("PMID").alias("pmid"), F.col("Title").alias("title"), F.array_join(F.transform("Abstract.AbstractText", part), "\n").alias("abstract"), F.coalesce(F.col("Year"), F.regexp_extract("MedlineDate", "([0-9]{4})", 1)).cast("int").alias("year"), F.col("Keywords.Keyword").alias("keywords"))


def cohort(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """CSV cohort: features (missing 0), and labels unpivoted from the dx_ columns."""
    raw = spark.read.option("header", True).csv(path).withColumn("row", F.monotonically_increasing_id())
    dx = [c for c in raw.columns if c.startswith("dx_")]
    features = raw.select("row", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in raw.columns if c not in (*dx, "row")))
    labels = raw.unpivot(["row"], dx, "disease", "label").select("row", F.substring("disease", 4, 1000).alias("disease"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"))
    return features, labels


def first_of(*names: str, df: DataFrame) -> Column:
    """The first non-empty of alternative columns, those that exist."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All keys of both; fields of the new row win where they aren't null."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, key, "full").select(*key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns if c not in key))


def source_url(url: Column, pmid: Column, title: Column) -> Column:
    """A stable address: the URL, else the article's, else a hash of the title."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(url), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), given(pmid), F.lit("/")), F.concat(F.lit("urn:"), F.sha2(F.coalesce(title, F.lit("")), 256)))
