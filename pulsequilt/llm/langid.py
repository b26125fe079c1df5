"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from hashed byte trigrams, fitted on a bounded sample of
labelled documents (``SAMPLE`` rows, those of the least hashes; of equal rows
one counts), whole texts and all labels in it. Grouped
aggregation over all rows then gives, from the text posteriors, how languages
go with declared markup languages and with address suffixes, and the soft
counts of each host and domain. A row's posterior combines its own text with
its host's prior (smoothed by its domain's, and that by the corpus's; the row
itself left out), its declared language and its suffix.

Declared languages and suffixes fall into closed sets, so their tables are
bounded and are broadcast; hosts, which grow with the corpus, are joined, and
rows of hosts that hold much of the corpus, as hosts of such domains, are dealt
to many tasks.

Null texts are empty. Rows without letters, or less like every language than
chance, are ``und`` (undetermined); so is everything if there are no labels.
Repeated rows are judged each. Null hosts and declarations count as unknown.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, among, dealt_join, hot_values, released, small_batches, stored

#: Labelled documents that the text model is fitted on, at most.
SAMPLE = 4000
BUCKETS = 1 << 14
DAMPED_UNIT = 1024
#: Neighbouring trigrams share letters, so each counts as a third of one.
TEMPER = 1 / 3
#: Rows of pseudo-evidence at each level of the host hierarchy, and for declarations and suffixes.
PRIOR_ROWS = 5.0
#: Under so many trigrams a text is too short to be less likely than chance.
SHORT = 20
SUFFIXES = ("com", "org", "net", "edu", "gov", "info", "io")

_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of lower-cased text, all but letters as spaces; trigrams with two spaces or more are left out."""
    b = np.frombuffer(text.lower().encode().translate(_LETTERS), np.uint8)
    b = np.concatenate([[32], b, [32]]).astype(np.uint32)
    space = (b == 32).astype(np.uint8)
    keep = space[:-2] + space[1:-1] + space[2:] < 2
    h = (b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917))[keep]
    return np.bincount((h ^ h >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(18), minlength=BUCKETS)


def damped(counts: np.ndarray) -> np.ndarray:
    """log(1 + count) in whole parts of 1 / DAMPED_UNIT, the usual damping of a multinomial model: what one document repeats says little more of its language. Whole numbers add up alike in any order."""
    return np.rint(np.log1p(counts) * DAMPED_UNIT).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # [BUCKETS, languages]

    def judge(self, text: str) -> tuple[int, float, np.ndarray]:
        """Trigrams, the best language's gain over chance a trigram, and tempered log likelihoods (their maximum is 0)."""
        counts = trigram_counts(text)
        n = int(counts.sum())
        log = counts @ self.log_p
        gain = (log.max() / n if n else 0.0) + np.log(BUCKETS)
        return n, float(gain), TEMPER * (log - log.max())


def fit_text_model(labelled: DataFrame, label: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Fits on the ``sample`` labelled rows of least hashes (of equal rows one counts); per language the damped trigram counts, added up in Spark, come to the driver (BUCKETS by languages numbers)."""
    rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.lower(F.col(label)).alias("label"), F.xxhash64("doc_id", "text", F.lower(F.col(label))).alias("h")).where("label is not null")
    least = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if least is None:
        return TextModel((), np.zeros((BUCKETS, 0)))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = damped(trigram_counts(text))
                sums[label] = sums[label] + c if label in sums else c
        for label, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([label] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["label", "bucket", "n"])

    small_batches(labelled.sparkSession)
    chosen = stored(rows.where(F.col("h") <= least).dropDuplicates(["h"]))
    names = sorted(r[0] for r in chosen.select("label").distinct().collect())  # at most sample
    place = {x: k for k, x in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    for label, bucket, n in chosen.select("text", "label").mapInArrow(released(run), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n")).collect():
        counts[bucket, place[label]] = n
    p = counts / DAMPED_UNIT + 0.1
    return TextModel(tuple(names), np.log(p / p.sum(axis=0)))


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows (key, host, domain, suffix, declared, text) with n_grams, gain, log_text and text_post (arrays by language) in place of text, as a stored table."""
    small_batches(rows.sparkSession)
    schema = "key long, host string, domain string, suffix string, declared string, n_grams long, gain double, log_text array<double>, text_post array<double>"

    def run(batches):
        for batch in batches:
            found = [model.judge(t) for t in batch.column(5).to_pylist()]
            logs = [log for _, _, log in found]
            posts = [(e := np.exp(log)) / e.sum() for log in logs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([n for n, _, _ in found], pa.int64()), pa.array([g for _, g, _ in found], pa.float64()), pa.array([x.tolist() for x in logs], pa.list_(pa.float64())), pa.array([x.tolist() for x in posts], pa.list_(pa.float64()))], names=["key", "host", "domain", "suffix", "declared", "n_grams", "gain", "log_text", "text_post"])

    return stored(rows.select("key", *(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "domain", "suffix", "declared")), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(run), schema))


def _sums(n: int, of: str = "text_post") -> Column:
    return F.array(*(F.sum(F.col(of)[i]) for i in range(n)))


def fused(rows: DataFrame, model: TextModel) -> DataFrame:
    """key, lang, confidence, text_lang, n_grams of rows with key, text, host, domain (that the host belongs to), suffix and declared."""
    n, names = len(model.languages), F.array(*(F.lit(x) for x in model.languages))
    if not n:
        return rows.select("key", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.lit(0).cast("long").alias("n_grams"))
    seen = text_evidence(rows, model)
    spark = rows.sparkSession
    voters = seen.where("n_grams > 0")
    total = np.array(voters.agg(_sums(n)).first()[0] if voters.take(1) else [0.0] * n, float)
    overall = (total + 1 / n) / (total.sum() + 1)

    def ratios(by: str) -> DataFrame:
        """How much likelier each language is with a value of ``by`` than overall; the values are a closed set."""
        made = []
        for value, soft in voters.groupBy(by).agg(_sums(n).alias("soft")).collect():
            soft = np.array(soft)
            p = (soft + PRIOR_ROWS * overall) / (soft.sum() + PRIOR_ROWS) if value else overall
            made.append((value, np.log(p / overall).tolist()))
        return F.broadcast(spark.createDataFrame(made, f"{by} string, log_{by} array<double>"))

    hosts = voters.groupBy("domain", "host").agg(_sums(n).alias("host_soft"), F.count(F.lit(1)).alias("n_rows"))
    hosts = stored(hosts)
    domains = stored(hosts.groupBy("domain").agg(_sums(n, "host_soft").alias("domain_soft"), F.count(F.lit(1)).alias("n_hosts")))
    of_many = among("domain", hot_values(domains, "domain", "n_hosts"))
    hosts = stored(dealt_join(hosts, domains.drop("n_hosts"), ["domain"], of_many, F.xxhash64("host")))
    hot = [r[0] for r in hosts.where(F.col("n_rows") * HOT > float(total.sum())).select("host").distinct().collect()]  # fewer than HOT
    x = dealt_join(seen, hosts.drop("n_rows"), ["domain", "host"], among("host", hot), F.xxhash64("key", F.spark_partition_id()), "left")
    x = x.join(ratios("suffix"), "suffix", "left").join(ratios("declared"), "declared", "left")
    own = lambda i: F.when(F.col("n_grams") > 0, F.col("text_post")[i]).otherwise(0.0)
    left = lambda c, i: F.greatest(F.coalesce(F.col(c)[i], F.lit(0.0)) - own(i), F.lit(0.0))
    all_left = lambda c: sum((left(c, i) for i in range(1, n)), left(c, 0))
    x = x.withColumn("domain_n", all_left("domain_soft")).withColumn("host_n", all_left("host_soft"))
    scores = []
    for i in range(n):
        domain = (left("domain_soft", i) + PRIOR_ROWS * float(overall[i])) / (F.col("domain_n") + PRIOR_ROWS)
        host = (left("host_soft", i) + PRIOR_ROWS * domain) / (F.col("host_n") + PRIOR_ROWS)
        scores.append(F.col("log_text")[i] + F.log(host) + F.coalesce(F.col("log_suffix")[i], F.lit(0.0)) + F.coalesce(F.col("log_declared")[i], F.lit(0.0)))
    x = x.withColumn("score", F.array(*scores)).withColumn("top", F.array_max("score"))
    x = x.withColumn("mass", F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top"))))
    known = (F.col("n_grams") > 0) & ((F.col("n_grams") < SHORT) | (F.col("gain") > 0))
    pick = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return x.select("key", F.when(known, pick("score")).otherwise("und").alias("lang"), F.when(known, F.round(1 / F.col("mass"), 6)).otherwise(0.0).alias("confidence"), F.when(known, pick("log_text")).otherwise("und").alias("text_lang"), "n_grams")


# ---------------------------------------------------------------- pages

_TAG = re.compile(r"<(?:!--|(?:(script|style)\b)?[^<>]*>)", re.I)
_ENDS = {"script": re.compile(r"</script\b[^<>]*>", re.I), "style": re.compile(r"</style\b[^<>]*>", re.I), "--": re.compile("-->")}


def visible(html: str) -> str:
    """html without tags, comments, scripts and styles; what is never closed runs to the end."""
    out, at = [], 0
    while m := _TAG.search(html, at):
        out.append(html[at : m.start()])
        at = m.end()
        if kind := (m[1] or ("--" if m[0] == "<!--" else "")).lower():
            end = _ENDS[kind].search(html, at)
            at = end.end() if end else len(html)
    return " ".join([*out, html[at:]])


def page_rows(pages: DataFrame) -> DataFrame:
    """key, text, host, domain, suffix, declared of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    last = F.regexp_extract("host", r"([a-z0-9-]+)$", 1)
    # at most 26 + 26^2 + 26^3 declared languages and 26^2 suffixes besides those listed
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^<>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1))
    suffix = F.when(last == "", "").when(last.rlike("^[a-z]{2}$") | last.isin(*SUFFIXES), last).otherwise("other")
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), declared.alias("declared"))
    rows = rows.select("key", "html", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), suffix.alias("suffix"), "declared")
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[1] = pa.array([visible(h) for h in columns[1].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=["key", "text", *batch.schema.names[2:]])

    return rows.mapInArrow(run, "key long, text string, host string, domain string, suffix string, declared string")


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, n_grams."""
    return fused(page_rows(pages), fit_text_model(labelled)).withColumnRenamed("key", "page_id")


def identify_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang, confidence, text_lang, n_grams of documents, whose source stands for the host and whose own lang is what they declare."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text", F.col("source").alias("host"), F.col("source").alias("domain"), F.lit("").alias("suffix"), F.lower(F.substring("lang", 1, 3)).alias("declared"))
    return fused(rows, fit_text_model(labelled)).withColumnRenamed("key", "doc_id")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs (documents) whose language can be told: neither ``und`` nor of a confidence under ``least``. All columns, whatever their names, stay as they are. Null texts count as empty; equal rows stay or go together."""
    h = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    rows = docs.select(h.alias("key"), "text", F.col("source").alias("host"), F.col("source").alias("domain"), F.lit("").alias("suffix"), F.lower(F.substring("lang", 1, 3)).alias("declared"))
    refused = fused(rows, fit_text_model(docs)).where((F.col("lang") == "und") | (F.col("confidence") < least)).select("key").distinct()
    return docs.select(F.struct("*").alias("row"), h.alias("key")).join(refused, "key", "left_anti").select("row.*")
