"""Shares, charts as rows, and evaluation metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import stored

#: Ranges of values that running totals are taken in, one window each.
RANGES = 256


def shares(df: DataFrame, by: Column) -> DataFrame:
    """name, n and percent of all."""
    got = df.groupBy(by.alias("name")).agg(F.count("*").alias("n"))
    # the window runs over one row per group
    return got.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


def top(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def prf(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per class: tp, fp, fn, precision, recall and f1 (0 where undefined)."""
    n = df.groupBy(gold, predicted).agg(F.count("*").alias("n"))
    side = n.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col(gold) != F.col(predicted), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col(gold) != F.col(predicted), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    c = side.groupBy("label").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    p, r = part("tp", "fp"), part("tp", "fn")
    return c.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))})


def averaged(c: DataFrame) -> DataFrame:
    """Micro and macro averages and accuracy of prf()'s rows, rounded to six digits."""
    share = lambda a, b: F.round(F.try_divide(F.sum(a).cast("double"), F.sum(a) + F.sum(b)), 6)
    mean = lambda x: F.round(F.avg(x), 6)
    return c.agg(share("tp", "fp").alias("micro_precision"), share("tp", "fn").alias("micro_recall"), mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"), share("tp", "fn").alias("accuracy"))


def running(rows: DataFrame, by: str, sums: dict[str, str], falling: bool = False) -> DataFrame:
    """Running sums, each new column of a column, over rows of distinct numbers in `by`.

    About RANGES quantiles cut the numbers; each range is summed by a window of its own and starts
    from the totals of the ranges before it, so no task sorts more than a range.  The quantiles are
    approximate, which moves the cuts but no sum.  A null comes before all numbers.
    """
    low = float("-inf")
    x = rows.withColumn("_x", F.coalesce(F.col(by).cast("double"), F.lit(low)))
    cuts = sorted(set(x.approxQuantile("_x", [k / RANGES for k in range(1, RANGES)], 0.001)) - {low, float("inf")})  # at most RANGES
    x = Bucketizer(splits=[low, *(cuts or [0.0]), float("inf")], inputCol="_x", outputCol="_range", handleInvalid="keep").transform(x)
    order = (lambda c: F.desc(c)) if falling else F.asc
    before = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows
    totals = x.groupBy("_range").agg(*(F.sum(c).alias(f"_{new}") for new, c in sums.items()))
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums))
    within = Window.partitionBy("_range").orderBy(order(by))
    got = x.join(F.broadcast(starts), "_range").withColumns({new: F.sum(c).over(within) + F.col(f"_{new}") for new, c in sums.items()})
    return got.select(*rows.columns, *sums)


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, descending: tp and fp of the rule "at least this score"; totals p and q."""
    n = df.groupBy(F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    return running(n, "score", {"tp": "pos", "fp": "neg"}, falling=True)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half, over one row per distinct score."""
    c = curve(df, label, score)
    return c.agg((F.sum((F.col("tp") - F.col("pos") / 2) * F.col("neg")) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision: each distinct score's share of the positives times the precision at it."""
    c = curve(df, label, score)
    total = df.agg(F.sum(label).alias("p"))
    return c.crossJoin(F.broadcast(total)).agg(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))  # one row


def youden(df: DataFrame, label: str, score: str) -> DataFrame:
    """The highest threshold with the greatest sensitivity plus specificity less one."""
    total = df.agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    c = curve(df, label, score).crossJoin(F.broadcast(total))  # one row
    j = F.round(F.col("tp") / F.col("p") - F.col("fp") / F.col("q"), 9)
    return c.select("score", j.alias("j")).agg(F.max(F.struct("j", "score")).alias("m")).select(F.col("m.score").alias("threshold"), F.col("m.j").alias("j"))


def index_percentiles(df: DataFrame, value: str, shares_: list[float]) -> DataFrame:
    """The value at place int(n * p), the last at most, for each p: picked, not interpolated.

    Equal values are counted first, so running totals are over distinct values.
    """
    n = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = running(n, "v", {"upto": "n"})
    total = n.agg(F.sum("n").alias("total"))
    p = df.sparkSession.createDataFrame([(float(x),) for x in shares_], "p double")
    place = F.least(F.floor(F.col("total") * F.col("p")), F.col("total") - 1)
    return upto.join(F.broadcast(p.crossJoin(total)), F.col("upto") > place).groupBy("p").agg(F.min("v").alias("value"))


def neighbour_mean(edges: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Each node's mean of its neighbours' vectors."""
    parts = edges.join(vectors, edges["other"] == vectors["id"]).select("node", F.posexplode("vector").alias("k", "x"))
    means = parts.groupBy("node", "k").agg(F.avg("x").alias("x"))
    return means.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Vectors in a block of queries, and of others.
ASKED, LOOKED_AT = 512, 4096


def _blocks(df: DataFrame, most: int) -> DataFrame:
    """ids, values and width of up to `most` vectors of one width; -1 for null vectors and such with a null in them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(width):
            ids, rows = zip(*held.pop(width), strict=True)
            values = np.array(rows, np.float64).tobytes() if width >= 0 else b""
            return pa.RecordBatch.from_pydict({"ids": [np.array(ids, np.int64).tobytes()], "values": [values], "width": pa.array([width], pa.int32())})

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid and not v.values.null_count else None
                width = -1 if x is None else len(x)
                held.setdefault(width, []).append((i, x))
                if len(held[width]) == most:
                    yield block(width)
        for width in list(held):
            yield block(width)

    return df.mapInArrow(run, "ids binary, values binary, width int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, id, s and k: each query's k vectors of other ids of the highest cosine (rounded to nine digits), ties by id.

    vectors and queries: id and vector (doubles).  All queries meet all vectors, in blocks: a pair of blocks is
    one product, of which only a query's best `k` come out.  These are taken again as a sum from left to right.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        dot = lambda x, y: np.cumsum(x * y, axis=-1)[..., -1] if x.shape[-1] else np.zeros(x.shape[:-1])
        for batch in batches:
            for r in batch.to_pylist():
                qi, vi = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                out: list[tuple] = []
                if r["q_width"] != r["width"] or r["width"] < 0:
                    first = np.sort(vi)[: k + 1].tolist()
                    out = [(q, i, None) for q in qi.tolist() for i in [x for x in first if x != q][:k]]
                else:
                    a, b = (np.frombuffer(r[c], np.float64).reshape(-1, r["width"]) for c in ("q_values", "values"))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        near = (a @ b.T) / np.sqrt(np.outer((a * a).sum(1), (b * b).sum(1)))
                        far = np.where(np.isnan(near), -np.inf, -near)
                        far[qi[:, None] == vi[None, :]] = np.inf
                        at = min(k, len(vi)) - 1
                        # no row that rounding could bring among the first k stays behind
                        x, y = np.nonzero((far <= np.partition(far, at, axis=1)[:, at : at + 1] + 3e-9) & (far < np.inf))
                        for j in range(0, len(x), 100_000):
                            p, o = a[x[j : j + 100_000]], b[y[j : j + 100_000]]
                            s = dot(p, o) / np.sqrt(dot(p, p) * dot(o, o))
                            out += zip(qi[x[j : j + 100_000]].tolist(), vi[y[j : j + 100_000]].tolist(), s.tolist(), strict=True)
                if out:
                    q, i, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "s": pa.array(s, pa.float64(), from_pandas=False)})

    of = lambda df: df.select(F.col("id").cast("long").alias("id"), "vector")
    asked = stored(_blocks(of(queries), ASKED).select(*(F.col(c).alias("q_" + c) for c in ("ids", "values", "width"))), "asked")
    pairs = stored(_blocks(of(vectors), LOOKED_AT), "vectors").crossJoin(asked)  # the stated query set
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "id"))
    return pairs.mapInArrow(run, "q long, id long, s double").withColumn("k", place.cast("long")).where(F.col("k") <= k)


#: Words that speak of a dose, the mark of a citation, the words of the disclaimer.
DOSE_WORDS, CITED, DISCLAIMER = ("mg", "毫克", "每日", "一天", "片/次", "tid", "bid"), "[KG-", "不能替代执业医师"


def dialogue_report(rows: DataFrame) -> DataFrame:
    """name and value: how many samples, picked percentiles of their lengths, and outputs with risks; from instruction and output."""
    size = F.length(F.concat(F.coalesce("instruction", F.lit("")), F.coalesce("output", F.lit("")))).cast("long")
    text = F.coalesce("output", F.lit(""))
    names = {0.0: "min", 0.25: "p25", 0.5: "median", 0.75: "p75", 0.95: "p95", 1.0: "max"}
    lengths = index_percentiles(rows.select(size.alias("size")), "size", list(names))
    name = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("p")]
    dosed = reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in DOSE_WORDS))
    counts = {"samples": F.count("*"), "outputs_with_dose_words": F.count_if(dosed), "outputs_without_kg_citation": F.count_if(~F.contains(text, F.lit(CITED))), "outputs_without_disclaimer": F.count_if(~F.contains(text, F.lit(DISCLAIMER)))}
    found = rows.agg(F.array(*(F.struct(F.lit(k).alias("name"), c.alias("value")) for k, c in counts.items())).alias("x")).select(F.inline("x"))
    return lengths.select(name.alias("name"), "value").unionByName(found)
