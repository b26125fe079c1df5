"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content (its
blob). The ledger is a stored table with one row for each pair of blob and rule
version that was ever scanned, with what was found, nothing included. A scan
takes only the pairs that the ledger lacks, adds them, and joins the findings
back to all paths and versions. Raising a rule's version scans all blobs for
that rule alone; new paths with known contents cost no scan.

Rules find spans: leftmost, non-overlapping within a kind, a failing match
dropped without another try. The first three are the base; the others add
spans. A null text is the empty blob; repeated rows give repeated rows; no rows
give no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, by_batch, dealt_join, hot_values, made, shared_dir, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` with a test of each match, worked only on texts that hold one of ``hints`` (lower-cased), if there are any."""

    kind: str
    version: int
    pattern: str
    test: Callable[[re.Match], bool] = bool
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def finder(self) -> Callable[[str, str], list[tuple[int, int]]]:
        found, test, hints = re.compile(self.pattern, re.ASCII), self.test, self.hints

        def find(text: str, low: str) -> list[tuple[int, int]]:
            if hints and not any(h in low for h in hints):
                return []
            return [m.span() for m in found.finditer(text) if test(m)]

        return find


BASE = ("assign", "access", "hex")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RULES = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6, _KEYS),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, ("akia",)),
    # the longest stretch of [0-9a-f] starts the leftmost match of 24 or more, so shorter ones need no match of their own
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    # added: private keys, signed web tokens, authorisation headers, passwords in addresses, keys with a vendor's mark
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:[^-]+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)?", hints=("private key-----",)),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", hints=("eyj",)),
    Rule("bearer", 1, r"(?i:authorization)[\"']?\x20*[:=]\x20*[\"']?(?i:bearer|basic)\x20+[A-Za-z0-9+/_.~=-]{12,}", hints=("authorization",)),
    Rule("login", 1, r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/@:\"'<>]{1,64}:[^\s/@:\"'<>]{3,128}@[A-Za-z0-9.-]+", hints=("://",)),
    Rule("vendor", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35})", hints=("gh", "glpat-", "xox", "sk_live_", "aiza")),
)

_SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, found {_SPANS}"
#: A list of unseen blobs of at most so many rows (64 hex digits each) is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 50_000


def new_ledger(spark: SparkSession) -> str:
    """A path for a ledger that lives as long as this process; a lasting one is any path in a shared store."""
    return made(shared_dir(spark))


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path, or None where no scan has written one."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def addressed(versions: DataFrame) -> DataFrame:
    """doc_id, version, blob, text of every version."""
    text = F.coalesce("text", F.lit(""))
    return versions.select(F.col("doc_id").cast("long").alias("doc_id"), "version", F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def _unseen(versions: DataFrame, before: DataFrame | None, names: list[str]) -> DataFrame:
    """blob, text, rules: every blob that lacks a rule's version in the ledger, once, with the rules that it lacks.

    Copies meet as partial aggregates, so a text with a third of all rows moves once a task. With a ledger,
    blobs that lack nothing are left out before any text is shuffled.
    """
    rules = F.array(*map(F.lit, names))
    if before is None:
        return addressed(versions).groupBy("blob").agg(F.any_value("text").alias("text")).withColumn("rules", rules)
    done = before.where(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("done"))  # as many as there are rules, at most
    lacks = stored(addressed(versions).select("blob").distinct().join(done, "blob", "left").select("blob", F.array_except(rules, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0))
    few = lacks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = addressed(versions).join(F.broadcast(lacks) if few else lacks.hint("shuffle_hash"), "blob")
    return chosen.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("rules").alias("rules"))


def scan_unseen(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the pairs of blob and rule version that the ledger at path lacks, and adds them to it."""
    wanted = {r.name: r for r in rules}

    def make():
        finders = {name: r.finder() for name, r in wanted.items()}

        def run(x):
            out = {"blob": [], "rule": [], "found": []}
            for blob, text, names in zip(x["blob"], x["text"], x["rules"], strict=True):
                low = text.lower()
                for name in names:
                    out["blob"].append(blob)
                    out["rule"].append(name)
                    out["found"].append([{"start": a, "end": b} for a, b in finders[name](text, low)])
            return out

        return run

    by_batch(_unseen(versions, ledger(versions.sparkSession, path), list(wanted)), make, LEDGER).write.mode("append").parquet(path)


def scan_history(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, version, blob, found (array of kind, start, end; by start, then by the rules' order) for every row of versions (doc_id, version, text), after the ledger was brought up to date."""
    scan_unseen(versions, path, rules)
    number = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))))
    known = ledger(versions.sparkSession, path).where(F.col("rule").isin([r.name for r in rules]) & (F.size("found") > 0))
    one = F.transform("found", lambda s: F.struct(s["start"].alias("start"), number[F.col("rule")].alias("rule"), s["end"].alias("end")))
    # a blob has as many ledger rows as there are rules; runs that raced may have written a pair twice
    by_blob = known.dropDuplicates(["blob", "rule"]).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("found"))
    paths = stored(addressed(versions).select("doc_id", "version", "blob").withColumn("salt", F.monotonically_increasing_id()))
    hot = hot_values(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n")), "blob")
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    joined = dealt_join(paths, by_blob, ["blob"], among("blob", hot), F.col("salt"), "left")
    named = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,rule:int,end:int>>")), lambda s: F.struct(F.element_at(kinds, s["rule"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", "version", "blob", named.alias("found"))


def digest_findings(found: DataFrame) -> DataFrame:
    """The columns of the query from scan_history: counts and digest of the base spans, all spans as text, and the blob."""
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, BASE), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"), "blob")


def _rule_sql(rule: Rule) -> str:
    """start, kind and end of a rule's matches: each match begins where the pieces between matches and the matches before it end."""
    pattern, test = rule.pattern.replace("'", "''"), {"assign": "len(regexp_extract_all(t, '{0}', 2)[k]) >= 6", "access": "len(m[k]) >= 20"}.get(rule.kind, "true")
    return f"""SELECT id, start, '{rule.kind}' AS kind, start + len(m[k]) AS stop FROM (SELECT id, k, m, list_sum(list_transform(p[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0) AS start
FROM (SELECT id, t, m, string_split_regex(t, '{pattern}') AS p, unnest(range(1, len(m) + 1)) AS k FROM (SELECT id, t, regexp_extract_all(t, '{pattern}') AS m FROM d)) WHERE {test.format(pattern)})"""


#: The same rows from matches and the pieces between them.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(map(_rule_sql, RULES))}),
o AS (SELECT *, list_position([{", ".join(f"'{r.kind}'" for r in RULES)}], kind) AS place, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said FROM s),
g AS (SELECT id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(said, ',' ORDER BY start, place) FILTER (place <= {len(BASE)}) AS base, string_agg(said, ',' ORDER BY start, place) AS spans FROM o GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN g USING (id)"""
