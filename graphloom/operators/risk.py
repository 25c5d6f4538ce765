"""Logistic risk models as a coefficient table, explanations and health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a missing measurement counts as.
MEANS = {"bmi": 23.5, "systolic_bp": 122.0, "diastolic_bp": 76.0, "fasting_glucose": 5.2, "total_cholesterol": 4.8, "ldl": 2.9, "hdl": 1.3, "triglycerides": 1.4, "heart_rate": 74.0}
FEATURES = ("age", "male", "bmi", "systolic_bp", "diastolic_bp", "fasting_glucose", "total_cholesterol", "ldl", "hdl", "triglycerides", "smoking", "drinking", "family_history", "symptom_score", "low_activity")
#: Intercept and coefficients in the order of FEATURES, by disease.
MODELS = {
    "hypertension": (-14.196, (0.055, 0.20, 0.115, 0.042, 0.020, 0.24, 0.12, 0.0, -0.30, 0.10, 0.32, 0.25, 0.72, 0.30, 0.28)),
    "type_2_diabetes": (-15.077, (0.048, 0.12, 0.175, 0.014, 0.0, 1.05, 0.10, 0.0, -0.28, 0.22, 0.20, 0.08, 0.95, 0.26, 0.45)),
    "coronary_disease": (-14.916, (0.072, 0.42, 0.075, 0.028, 0.012, 0.32, 0.30, 0.42, -0.48, 0.16, 0.85, 0.18, 0.78, 0.42, 0.34)),
    "stroke": (-16.665, (0.082, 0.28, 0.062, 0.045, 0.014, 0.40, 0.18, 0.24, -0.26, 0.12, 0.62, 0.30, 0.58, 0.38, 0.28)),
    "kidney_disease": (-13.878, (0.058, 0.15, 0.070, 0.032, 0.010, 0.48, 0.08, 0.0, -0.16, 0.08, 0.30, 0.06, 0.50, 0.34, 0.16)),
    "fatty_liver": (-13.300, (0.030, 0.36, 0.195, 0.012, 0.008, 0.38, 0.16, 0.14, -0.24, 0.40, 0.14, 0.62, 0.34, 0.16, 0.42)),
    "dyslipidaemia": (-14.700, (0.032, 0.16, 0.130, 0.010, 0.006, 0.20, 0.72, 0.80, -0.62, 0.55, 0.20, 0.30, 0.82, 0.10, 0.36)),
    "copd": (-6.757, (0.060, 0.34, -0.045, 0.004, 0.002, 0.08, 0.02, 0.0, -0.05, 0.02, 1.15, 0.10, 0.30, 0.62, 0.20)),
    "osteoporosis": (-5.252, (0.088, -0.10, -0.120, 0.004, 0.002, 0.04, 0.02, 0.0, -0.04, 0.02, 0.34, 0.38, 0.56, 0.30, 0.48)),
    "depression": (-4.970, (-0.012, -0.20, 0.030, 0.004, 0.002, 0.10, -0.05, 0.0, -0.06, 0.04, 0.28, 0.34, 0.86, 0.72, 0.44)),
}


def imputed(df: DataFrame) -> DataFrame:
    """Missing measurements at their population mean, never 0; other missing features at 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MEANS.get(c, 0.0))) for c in FEATURES})


def features(requests: DataFrame) -> DataFrame:
    """All FEATURES, and the request's own columns beside them, from what a request says; a field it lacks, as a column or a value, counts as missing.

    Relatives with a disease count up to four; symptoms by their weights; activity only where it is low.
    """
    there = lambda c, kind: F.col(c) if c in requests.columns else F.lit(None).cast(kind)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "age": there("age", "double"), "male": yes(there("gender", "string") == "male"),
        "smoking": yes(there("smoking", "boolean")), "drinking": yes(there("drinking", "boolean")),
        "family_history": F.least(F.size(F.coalesce(there("family_history", "array<string>"), F.array().cast("array<string>"))), F.lit(4)),
        "symptom_score": symptom_score(there("symptoms", "array<string>")), "low_activity": yes(F.lower(there("physical_activity", "string")) == "low"),
    } | {c: there(c, "double") for c in MEANS}
    return requests.withColumns({c: F.coalesce(made[c].cast("double"), F.lit(MEANS.get(c, 0.0))) for c in made})


def coefficients(spark: SparkSession) -> DataFrame:
    """disease, intercept, w: a row per model."""
    return spark.createDataFrame([(d, i, list(w)) for d, (i, w) in MODELS.items()], "disease string, intercept double, w array<double>")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _logit(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Every person with every model (ten rows, a fixed table)."""
    x = df.withColumn("x", F.array(*(F.col(c) for c in FEATURES))).crossJoin(F.broadcast(coefficients(spark)))
    z = F.col("intercept") + F.aggregate(F.zip_with("w", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return x.withColumn("z", z)


def level(risk: Column) -> Column:
    return F.when(risk >= 0.75, "very_high").when(risk >= 0.5, "high").when(risk >= 0.25, "medium").otherwise("low")


def predict(people: DataFrame, key: str) -> DataFrame:
    """key, disease, risk and level."""
    got = _logit(imputed(people), people.sparkSession)
    return got.select(key, "disease", sigmoid(F.col("z")).alias("risk")).withColumn("level", level(F.col("risk")))


def contributions(people: DataFrame, key: str, best: int = 5) -> DataFrame:
    """Per person and disease the features whose removal lowers the risk most, as shares of all such drops."""
    got = _logit(imputed(people), people.sparkSession)
    each = got.select(key, "disease", "z", F.explode(F.arrays_zip(F.array(*map(F.lit, FEATURES)).alias("feature"), F.zip_with("w", "x", lambda a, b: a * b).alias("part"))).alias("f"))
    drop = each.select(key, "disease", F.col("f.feature").alias("feature"), F.greatest(F.lit(0.0), sigmoid(F.col("z")) - sigmoid(F.col("z") - F.col("f.part"))).alias("drop"))
    by = Window.partitionBy(key, "disease")
    share = F.coalesce(F.try_divide(F.col("drop"), F.sum("drop").over(by)), F.lit(0.0))
    ranked = drop.withColumn("share", share).withColumn("rank", F.row_number().over(by.orderBy(F.desc(F.round("share", 9)), "feature")))
    return ranked.where(F.col("rank") <= best).drop("drop")


def health(risks: DataFrame, key: str) -> DataFrame:
    """100 for no risk at all, less with the greatest and the mean risk."""
    s = 100 * (1 - 0.95 * (0.55 * F.max("risk") + 0.45 * F.avg("risk")))
    return risks.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)).alias("health"))


#: Weights of symptoms, in the order in which partial matches are tried.
SYMPTOM_WEIGHTS = {
    "头晕": 0.6, "头痛": 0.6, "胸痛": 1.0, "胸闷": 0.8, "心悸": 0.7,
    "呼吸困难": 1.0, "气促": 0.7, "咳嗽": 0.5, "咳痰": 0.4, "咯血": 0.9,
    "恶心": 0.4, "呕吐": 0.5, "腹痛": 0.6, "腹泻": 0.4, "便秘": 0.3,
    "乏力": 0.5, "消瘦": 0.7, "体重下降": 0.7, "水肿": 0.7, "发热": 0.6,
    "盗汗": 0.4, "皮疹": 0.3, "瘙痒": 0.2, "麻木": 0.5, "抽搐": 0.9,
    "视物模糊": 0.6, "多饮": 0.5, "多尿": 0.5, "夜尿增多": 0.4,
    "关节痛": 0.4, "腰背痛": 0.4, "失眠": 0.4, "情绪低落": 0.6,
    "活动后气促": 0.8, "下肢水肿": 0.8,
}


def symptom_score(symptoms: Column, weights: dict[str, float] | None = None) -> Column:
    """Sum of the symptoms' weights, 5 at most: a name's own, else 0.8 of the first name that holds it or is in it, else 0.3."""
    names = SYMPTOM_WEIGHTS if weights is None else weights

    def one(s: Column) -> Column:
        s = F.trim(F.coalesce(s, F.lit("")))
        exact = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[s]
        near = F.coalesce(*(F.when(F.contains(s, F.lit(k)) | F.contains(F.lit(k), s), 0.8 * v) for k, v in names.items()))
        return F.coalesce(exact, near, F.lit(0.3))

    each = F.transform(F.coalesce(symptoms, F.array().cast("array<string>")), one)
    return F.round(F.least(F.lit(5.0), F.aggregate(each, F.lit(0.0), lambda a, b: a + b)), 3)
