"""Corpus clean-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import corpus as P
from graphloom.operators import lexicon as L
from graphloom.operators import relations as R
from graphloom.operators.analytics import top
from graphloom.session import stored
from graphloom.sources import tables as S

from .base import query


def docs(spark, d):
    return S.table(spark, d, "documents")


@query("t_normalize", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\v\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g'))) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.normalize(F.col("text"))).alias("digest"))


@query("t_clean_html", r"""WITH a AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, 'https?://[^\s]+', ' ', 'g') AS t FROM a),
 c AS (SELECT page_id, regexp_replace(t, '[^\s]+@[^\s]+\.[^\s]+', ' ', 'g') AS t FROM b), e AS (SELECT page_id, regexp_replace(t, '\[[ ]*[0-9]+(?:[ ]*[-,][ ]*[0-9]+)*[ ]*\]', ' ', 'g') AS t FROM c)
 SELECT page_id, md5(trim(regexp_replace(t, '[\s\v\x1c-\x1f\x85\xa0]+', ' ', 'g'))) AS digest FROM e""")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.md5(X.clean_html(F.col("html"))).alias("digest"))


@query("t_truncate", "SELECT doc_id, CASE WHEN length(trim(text)) <= 60 THEN trim(text) ELSE substr(trim(text), 1, 59) || '…' END AS short FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.truncate(F.col("text")).alias("short"))


@query("t_sentences", r"WITH s AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[^。！？；!?;.\n]*[。！？；!?;.\n]|[^。！？；!?;.\n]+')), '^\s+|\s+$', '', 'g') AS s FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT s) AS n_distinct, count(*) FILTER (WHERE length(s) BETWEEN 10 AND 300) AS n_fit FROM s WHERE s <> '' GROUP BY doc_id")
def _(spark, d):
    s = X.sentences(F.col("text"))
    got = docs(spark, d).select("doc_id", s.alias("s")).where(F.size("s") > 0)
    return got.select("doc_id", F.size("s").cast("long").alias("n"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"), F.size(F.filter("s", lambda x: F.length(x).between(10, 300))).cast("long").alias("n_fit"))


@query("t_telling_sentences", r"WITH s AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_extract_all(text, '[^。！？；!?;.\n]*[。！？；!?;.\n]|[^。！？；!?;.\n]+')), '^\s+|\s+$', '', 'g'), ' 　') AS s FROM documents) SELECT doc_id, count(DISTINCT s) AS n, sum(DISTINCT length(s))::BIGINT AS n_lengths, min(s) AS first FROM s WHERE length(s) BETWEEN 10 AND 300 AND NOT regexp_matches(s, '^(abstract|introduction|methods|results|discussion|conclusion)\s*:?\s*$', 'i') AND (contains(s, 'tion') OR regexp_matches(s, '[0-9]+\s*(mg|mmHg|mmol)')) GROUP BY doc_id")
def _(spark, d):
    got = docs(spark, d).select("doc_id", P.telling_sentences(X.sentences(F.col("text")), "tion").alias("s")).where(F.size("s") > 0)
    lengths = F.array_distinct(F.transform("s", F.length))
    return got.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_lengths"), F.array_min("s").alias("first"))


_REASON = "CASE WHEN length(text) < 200 THEN 'too_short' WHEN contains(text, '###') OR contains(text, '!!') THEN 'ads' WHEN length(text) - length(replace(text, 'tion', '')) < 8 AND NOT regexp_matches(text, '[0-9]+\\s*(mg|mmHg|mmol)') THEN 'no_term' WHEN length(regexp_replace(text, '[^a-z]', '', 'g')) < length(text) * 0.6 THEN 'low_script' ELSE 'ok' END"


def reasons(spark, d):
    return docs(spark, d).select("doc_id", P.quality_reason(F.col("text"), "###|!!", "tion", "[a-z]", 200, 2, 0.6).alias("reason"))


@query("t_quality_reason", f"SELECT doc_id, {_REASON} AS reason FROM documents")
def _(spark, d):
    return reasons(spark, d)


@query("t_etl_counters", f"SELECT {_REASON} AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("t_quality_score", "SELECT doc_id, round(least(1.0, length(text) / 1500.0), 3)::DOUBLE AS score, substr(md5(text), 1, 16) AS key FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.round(F.least(F.lit(1.0), F.length("text") / 1500.0), 3).alias("score"), F.substring(F.md5("text"), 1, 16).alias("key"))


@query("t_exact_dup", "SELECT min(doc_id) AS doc_id, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY md5(text)")
def _(spark, d):
    return docs(spark, d).groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def prints(spark, d):
    return P.simhash(docs(spark, d), "doc_id", "text")


# all texts in full: the SQL counts 64 bits of each gram, too slow on whole tables; tests hold it against brute force
@query("t_simhash")
def _(spark, d):
    return prints(spark, d).select(F.col("key").alias("doc_id"), "hi", "lo")


@query("t_simhash_pairs")
def _(spark, d):
    """Pairs of first documents within three bits, and the copies (distance 0) of each first document."""
    p = stored(prints(spark, d), "prints")
    return P.near_pairs(p).unionByName(P.copies(p))


@query("t_greedy_keep")
def _(spark, d):
    first = docs(spark, d).groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))
    p = P.simhash(docs(spark, d).join(first.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text")
    same = p.groupBy("hi", "lo").agg(F.min("key").alias("key"))
    return P.greedy_kept(same, P.near_pairs(p)).select(F.col("key").alias("doc_id"))


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query("t_mask_email", f"SELECT doc_id, md5(regexp_replace(text, '{_MAIL}', 'EMAIL_MASKED', 'g')) AS digest FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.masked_email(F.col("text"))).alias("digest"))


@query("t_mask_audit")
def _(spark, d):
    return P.mask_audit(docs(spark, d), "text")


@query("t_mask_counts", f"SELECT count(*) FILTER (WHERE regexp_matches(text, '{_MAIL}')) AS with_email, sum(len(regexp_extract_all(text, '{_MAIL}')))::BIGINT AS emails FROM documents")
def _(spark, d):
    n = F.regexp_count("text", F.lit(_MAIL))
    return docs(spark, d).agg(F.count_if(n > 0).alias("with_email"), F.sum(n.cast("long")).alias("emails"))


@query("t_pseudonym", "SELECT c_custkey, 'anon_' || substr(sha256('salt:' || c_name), 1, 16) AS anon FROM customer")
def _(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", X.pseudonym(F.col("c_name"), "salt").alias("anon"))


@query("t_encrypt_roundtrip", "SELECT c_custkey, c_name AS plain FROM customer")
def _(spark, d):
    key = F.lit("0123456789abcdef0123456789abcdef")
    return S.table(spark, d, "customer").select("c_custkey", X.decrypted(X.encrypted(F.col("c_name"), key), key).alias("plain"))


_WORDS = "w AS (SELECT doc_id, lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) AS w FROM documents)"


def words(spark, d):
    return docs(spark, d).select("doc_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).select("doc_id", F.lower("w").alias("w")).where("w <> ''")


@query("t_keywords", f"WITH {_WORDS}, c AS (SELECT doc_id, w, count(*) * length(w) AS weight FROM w WHERE length(w) >= 2 GROUP BY doc_id, w), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, w) AS k FROM c) SELECT doc_id, w, weight, k FROM k WHERE k <= 8")
def _(spark, d):
    from pyspark.sql import Window

    c = words(spark, d).where(F.length("w") >= 2).groupBy("doc_id", "w").agg((F.count("*") * F.length("w")).alias("weight"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "w")).cast("long")
    return c.withColumn("k", k).where("k <= 8")


@query("t_vocab", f"WITH {_WORDS} SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY w HAVING count(*) >= 5")
def _(spark, d):
    return words(spark, d).groupBy("w").agg(F.count("*").alias("n")).where("n >= 5")


@query("t_ngrams", "WITH g AS (SELECT substr(n_name, i::INT, 2) AS g FROM nation, unnest(range(1, length(n_name))) t(i)) SELECT g, count(*) AS n FROM g GROUP BY g")
def _(spark, d):
    return S.table(spark, d, "nation").select(F.explode(X.char_ngrams(F.col("n_name"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


_TERMS = [("the", "article"), ("and", "conjunction"), ("for", "preposition"), ("from", "preposition"), ("und", "conjunction"), ("que", "pronoun")]


@query("t_dictionary_match", f"WITH {_WORDS}, t(term, canonical) AS (VALUES {', '.join(map(str, _TERMS))}) SELECT doc_id, canonical, count(*) AS n FROM w JOIN t ON w = term GROUP BY 1, 2")
def _(spark, d):
    terms = F.broadcast(spark.createDataFrame(_TERMS, "term string, canonical string"))  # a fixed table
    return P.term_matches(docs(spark, d), terms).groupBy("doc_id", "canonical").agg(F.count("*").alias("n"))


@query("t_pattern_triples", "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:the|of|and) ([a-z]{4,24})', 1)) AS tail FROM documents) SELECT DISTINCT doc_id, 'MENTIONS' AS rel, tail FROM m")
def _(spark, d):
    got = docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("\\b(?:the|of|and) ([a-z]{4,24})"), F.lit(1)))).alias("tail"))
    return got.select("doc_id", F.lit("MENTIONS").alias("rel"), "tail")


@query("t_infectious", "SELECT doc_id, CASE WHEN contains(text, 'license') THEN false ELSE (contains(text, 'tion'))::INT + (contains(text, 'ing'))::INT + (contains(text, 'und'))::INT >= 2 END AS flagged FROM documents")
def _(spark, d):
    hit = lambda s: F.contains("text", F.lit(s)).cast("int")
    return docs(spark, d).select("doc_id", F.when(F.contains("text", F.lit("license")), False).otherwise(hit("tion") + hit("ing") + hit("und") >= 2).alias("flagged"))


@query("t_overlap_snippet", "WITH b AS (SELECT item_id, lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) AS w FROM benchmark), q AS (SELECT DISTINCT item_id, w FROM b WHERE length(w) >= 8), x AS (SELECT DISTINCT doc_id, lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) AS w FROM documents), h AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN x ON q.w = x.w GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS k FROM h) SELECT item_id, doc_id, hits, k FROM k WHERE k <= 3")
def _(spark, d):
    from pyspark.sql import Window

    q = S.table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).select("item_id", F.lower("w").alias("w")).where(F.length("w") >= 8).distinct()
    hits = words(spark, d).distinct().join(q, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id")).cast("long")
    return hits.withColumn("k", k).where("k <= 3")


@query("t_source_class", "SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 'A' WHEN ends_with(source, '5') THEN 'B' ELSE 'C' END AS authority, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    grade = F.when(F.col("source").isin("src0", "src1"), "A").when(F.col("source").endswith("5"), "B").otherwise("C")
    return docs(spark, d).groupBy("source", grade.alias("authority")).agg(F.count("*").alias("n"))


@query("t_sentence_vocab", f"WITH {_WORDS} SELECT w AS name, count(*) AS n FROM w WHERE w <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 50")
def _(spark, d):
    return top(words(spark, d), "w", 50)


_RELATIONS = [("HAS_SYMPTOM", "(?:the|der) ([a-z, 0-9]{2,60})", 0.9), ("USES_DRUG", "(?:and|und) ([a-z]{2,10}(?:, [a-z]{2,10})*)", 0.86)]
_TAILS = " UNION ALL ".join(f"SELECT doc_id, '{rel}' AS rel, {base} AS base, {most} AS most, unnest(regexp_extract_all(text, '{pattern}', 1)) AS list FROM documents" for (rel, pattern, base), most in zip(_RELATIONS, (24, 30), strict=True))


@query("t_relation_triples", f"""WITH m AS ({_TAILS}), s AS (SELECT doc_id, rel, base, most, trim(unnest(string_split(trim(list, ' ,'), ',')), ' ') AS tail FROM m)
 SELECT DISTINCT doc_id, rel, tail, (CASE WHEN rel = 'HAS_SYMPTOM' AND contains(tail, 'tion') THEN base + 0.05 ELSE base END)::DOUBLE AS confidence FROM s WHERE length(tail) BETWEEN 2 AND most AND NOT regexp_full_match(tail, '[0-9 ]+')""")
def _(spark, d):
    return R.pattern_triples(docs(spark, d), ["doc_id"], "text", _RELATIONS, {"HAS_SYMPTOM": ["tion"]}, ",")


def vocabulary(df, least):
    """term and n, in how many rows each lower-case word of at least `least` letters occurs."""
    each = df.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("term"))
    return each.where(F.length("term") >= least).groupBy("term").agg(F.count("*").alias("n"))


# leftmost and longest of tens of thousands of terms has no plain SQL; a test holds it against brute force
@query("t_dictionary_matches")
def _(spark, d):
    """Matches of all words of six letters and more that two documents share, in all texts, inside other words too."""
    own = docs(spark, d).select("doc_id", F.lower("text").alias("text"))
    return L.matches(own, "doc_id", "text", vocabulary(own, 6).where("n > 1"))


@query("t_relation_samples")
def _(spark, d):
    """Sentences labelled by facts: words that stand together in a benchmark passage, and neighbouring ones that don't."""
    passages = S.table(spark, d, "benchmark").select(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 5).alias("w"))
    pairs = passages.select(F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("source"), F.slice("w", 2, F.size("w")).alias("target"))).alias("x")).select("x.source", "x.target").where("source <> target").distinct()
    facts = pairs.withColumn("rel", F.lit("FOLLOWED_BY"))
    terms = passages.select(F.explode("w").alias("term")).distinct()
    cut = docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.lower("text"))).alias("sentence", "text"))
    cut = stored(cut.withColumn("key", F.concat_ws(":", "doc_id", "sentence")), "sentences")
    found = L.matches(cut, "key", "text", terms).select(F.split_part("key", F.lit(":"), F.lit(1)).cast("long").alias("doc_id"), F.split_part("key", F.lit(":"), F.lit(2)).cast("int").alias("sentence"), "start", "term")
    return L.supervised(found, terms.withColumn("id", F.col("term")), facts, ["doc_id", "sentence"])
