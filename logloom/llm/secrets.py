"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is content-addressed by its SHA-256. The ledger is a Parquet folder with one row for each blob and
rule-set version that has been scanned, with the spans found. An update takes the blobs of its input, leaves out the pairs
of blob and rule version that the ledger has, runs the rules on the rest once for each blob, however many paths hold
it, and appends what it found. Findings are the ledger joined back to all paths.

Which rows are to be scanned is settled on paths and hashes alone; texts are not shuffled as long as the rows to leave out are
few enough to be broadcast. Spans are in code points, end exclusive. They come from two parallel cuts of a text, the matches and
the pieces between them: the running sum of their lengths gives each match's place.

Defined results: a null text counts as the empty blob; an empty text has no spans; rows that repeat a path are each returned; null
paths are returned as they are; columns of the input other than path and text are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, wanted

SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"
LEDGER_SCHEMA = f"blob string, rules string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` (Java syntax); those whose `group` is shorter than `least` are dropped.

    `long_pattern`: where a match is a maximal run, a pattern that asks for the length at once; it finds the same.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    long_pattern: str = ""
    base: bool = True


# The base kinds, in the order in which ties are listed, and two kinds of whole blocks.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, long_pattern=r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", least=16, long_pattern=r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)


def rules_version(rules: tuple[Rule, ...]) -> str:
    """A name for this set of rules: it changes with any of them."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _cuts(text: Column, rules: tuple[Rule, ...]) -> Column:
    """For each kind with a match: the matches, the deciding groups and the pieces between the matches."""
    kinds = []
    for k, rule in enumerate(rules):
        pattern = F.lit(rule.long_pattern or rule.pattern)
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
        found = F.struct(F.lit(k).alias("kind_no"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), matches.alias("matches"), groups.alias("groups"), F.split(text, rule.long_pattern or rule.pattern, -1).alias("pieces"))
        kinds.append(F.when(F.regexp_like(text, pattern), found))
    return F.filter(F.array(*kinds), lambda x: x.isNotNull())


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rules, spans) for distinct blobs (blob, text)."""
    by_kind = blobs.select("blob", F.explode_outer(_cuts(F.col("text"), rules)).alias("cut")).select("blob", "cut.*")
    one = F.zip_with(F.zip_with("matches", "groups", lambda m, g: F.struct(F.length(m).alias("length"), F.length(g).alias("decides"))), F.col("pieces"), lambda m, p: F.struct(m["length"].alias("length"), m["decides"].alias("decides"), F.length(p).alias("gap")))
    matched = by_kind.select("blob", "kind_no", "kind", "least", F.posexplode_outer(one).alias("at", "m")).select("blob", "kind_no", "kind", "least", "at", "m.*")
    before = Window.partitionBy("blob", "kind_no").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = matched.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before).cast("int"))
    span = F.when(F.col("decides") >= F.col("least"), F.struct((F.col("end") - F.col("length")).cast("int").alias("start"), "kind_no", "kind", "end"))
    listed = placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return listed.select("blob", F.lit(rules_version(rules)).alias("rules"), F.col("spans").cast(SPANS).alias("spans"))


def _texts(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[path_col].alias("path"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


class Ledger:
    """The table of scanned blobs in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.begun = False

    def rows(self, rules: tuple[Rule, ...] | None = None) -> DataFrame:
        """(blob, rules, spans), of this rule-set version if one is given."""
        if not self.begun:
            self.spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(self.folder)
            self.begun = True
        rows = self.spark.read.schema(LEDGER_SCHEMA).parquet(self.folder)
        return rows if rules is None else rows.where(F.col("rules") == rules_version(rules))

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> int:
        """Scan what the ledger does not have yet, and append it; the number of blobs scanned."""
        scratch = Scratch(self.spark, "secrets")
        # 128 bits stand for a row: of its path and of its blob.
        own = F.xxhash64(F.coalesce(F.col("path").cast("string"), F.lit("\0null")), "blob").alias("own"), F.conv(F.substring("blob", 1, 15), 16, 10).cast("long").alias("of")
        texts = _texts(docs, path_col, text_col).select("text", "blob", *own)
        narrow = scratch.keep(texts.select("blob", "own", "of"), "rows")
        blobs = narrow.groupBy("blob").agg(F.min("own").alias("first"), F.count("*").alias("rows"))
        todo = scratch.keep(blobs.join(self.rows(rules).select("blob"), "blob", "left_anti"), "blobs")
        number = todo.count()
        if number:
            chosen = narrow.join(todo.select("blob", F.col("first").alias("own"), F.lit(True).alias("chosen")), ["blob", "own"], "left")
            # Rows that repeat path and text: one of them is scanned.
            scan = scratch.keep(chosen.where("chosen").groupBy("own", "of").count(), "scan")
            passed = scratch.keep(chosen.where("chosen IS NULL").select("own", "of").distinct(), "passed")
            again = scratch.keep(scan.where("count > 1").select("own", "of"), "again")
            # The smaller side names the rows: those to scan, or those to pass over.
            n_scan, n_passed = scan.count(), passed.count()
            left = wanted(texts, scan.select("own", "of"), ["own", "of"], "left_semi", n_scan) if n_scan <= n_passed else wanted(texts, passed, ["own", "of"], "left_anti", n_passed)
            n_again = again.count()
            once = wanted(left, again, ["own", "of"], "left_anti", n_again).select("blob", "text")
            if n_again:
                once = once.union(wanted(left, again, ["own", "of"], "left_semi", n_again).select("blob", "text").dropDuplicates(["blob"]))
            scan_blobs(once, rules).write.mode("append").parquet(self.folder)
        scratch.drop_all_but()
        return number

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(path, blob, spans) of every row; its blob must have been scanned, as `update` sees to (spans are NULL if not)."""
        known = self.rows(rules).select("blob", "spans")
        return _texts(docs, path_col, text_col).select("path", "blob").join(known, "blob", "left").select(F.col("path").alias(path_col), "blob", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _only(kind: str):
    return lambda k: F.when(k == kind, k).otherwise("")


def digest(findings: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans' list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in rules if r.base]))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, _only(r.kind)), "")).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return findings.select(path_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mark."""
    start = F.struct(F.lit(0).alias("to"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, span: Column) -> Column:
        piece = F.concat(F.substring(text, done["to"] + 1, span["start"] - done["to"]), F.lit(mark))
        apart = F.struct(span["end"].alias("to"), F.concat(done["parts"], F.array(piece)).alias("parts"))
        within = F.struct(F.greatest(done["to"], span["end"]).alias("to"), done["parts"].alias("parts"))
        return F.when(span["start"] >= done["to"], apart).otherwise(within)

    whole = F.aggregate(spans, start, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["to"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
