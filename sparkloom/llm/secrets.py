"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger, a folder of Parquet files, holds the
pairs (blob, rule, version) that were scanned, with what was found. A scan takes the blobs of its input, leaves out the
pairs that the ledger has, scans one copy of each remaining blob by just the rules that are missing for it, appends
these pairs to the ledger, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.marks import fresh, marks, parted
from sparkloom.scratch import new_path, saved


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` in which ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


ASSIGN = Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 16)
HEX = Rule("hex", r"[0-9a-f]+", 0, 32)
# a key up to its END line, or where that is missing, to the end of its header and base64 lines, also with line ends written as \\n
_BREAK = r"(?:\s|\\[nrt])"
_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_HEADERS = rf"(?:{_BREAK}*+[A-Za-z-]++:[^\r\n\\]*+)*+"
_LAST = rf"{_BREAK}++[A-Za-z0-9+/]++={{0,2}}(?=\x20*+(?:[\r\n\"']|\\[nr]|$))"
_LINES = rf"(?:{_HEADERS}(?:(?:{_BREAK}|[>\"'#*|+,])*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_LAST})?)?"
KEY_BLOCK = Rule("keyblock", rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:{_TO_END}|{_LINES})", 0, 1, 2)
PREFIXED = Rule("prefixed", r"(?:gh[oprsu]_|github_pat_|xox[abeoprs]-|[rs]k_live_)[A-Za-z0-9_-]+", 0, 20, 2)
BASE = (ASSIGN, ACCESS, HEX)
RULES = (*BASE, KEY_BLOCK, PREFIXED)
#: What a text must hold for the rule to match at all, cheap to test.
NEEDS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "keyblock": "PRIVATE KEY(?: BLOCK)?-----", "prefixed": "gh[oprsu]_|github_pat_|xox[abeoprs]-|[rs]k_live_"}


def _spans(text: Column, rule: Rule) -> Column:
    """The spans (begin, end, kind) of a rule in a text, in code points: the lengths of the pieces between matches and of the matches, summed up."""
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda s: F.length(s))
    held = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda s: F.length(s))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int,kind:string>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state.at + x.gap
        own = F.array(F.struct(begin.alias("begin"), (begin + x.whole).alias("end"), F.lit(rule.name).alias("kind")))
        return F.struct((begin + x.whole).alias("at"), F.when(x.held >= rule.least, F.concat(state.spans, own)).otherwise(state.spans).alias("spans"))

    return F.when(text.rlike(NEEDS[rule.name]), F.aggregate(pairs, start, step, lambda s: s.spans)).otherwise(F.array().cast("array<struct<begin:int,end:int,kind:string>>"))


FOUND = "blob string, rule string, version int, spans array<struct<begin:int,end:int,kind:string>>"
NO_SPANS = "array<struct<begin:int,end:int,kind:string>>"


def read_ledger(spark: SparkSession, folder: str | None) -> DataFrame:
    """(blob, rule, version, spans): what earlier scans left in the folder; none if there is no folder yet. A pair that two runs appended counts once."""
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(FOUND).parquet(folder).dropDuplicates(["blob", "rule", "version"])
    return spark.createDataFrame([], FOUND)


def _unseen(own: DataFrame, held: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``own`` with the array ``missing``: the rules whose pair with the row's blob the ledger lacks; rows that lack none are left out."""
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = saved(held.groupBy("blob").agg(F.collect_set("rule").alias("seen")), "seen")  # a few rules of one blob
    bitmap = marks(seen, ["blob"])
    maybe, fresh_ones = parted(own, ["blob"], bitmap)
    partly = maybe.join(seen.hint("merge"), "blob", "left").withColumn("missing", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
    return partly.select(*own.columns, "missing").unionAll(fresh_ones.withColumn("missing", names)).where("size(missing) > 0")


def scan(paths: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, additions): findings has (path, blob, spans) for every row of ``paths`` (path, text), additions the rows (blob, rule, version, spans) that this scan adds.

    ``spans`` are structs (begin, end, kind) in code points, ordered by begin, then as the rules are listed. Null is the
    empty text. Rows that repeat a path or a text each get their findings. ``ledger`` is a folder: only the pairs
    (rule, version) of a blob that it lacks are scanned, each once however many paths hold the blob, and the additions are appended to
    it, so that later scans need not read those texts again. Without one, everything is unseen and nothing is kept.
    A text that a rule's cheap test excludes has no match of it: only the others are shuffled, one copy of each blob.
    """
    spark = paths.sparkSession
    own = paths.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    wanted = F.broadcast(spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int"))  # a few rows
    held = saved(read_ledger(spark, ledger).join(wanted, ["rule", "version"]), "held")
    unseen = _unseen(own.select("blob", "text"), held, rules)
    asked = lambda r: F.array_contains("missing", r.name) & F.col("text").rlike(NEEDS[r.name])
    pairs = F.filter(F.array(*[F.when(asked(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    todo = unseen.withColumn("todo", pairs).where("size(todo) > 0").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    spans = F.array(*[F.when(F.array_contains("todo", r.name), F.struct(F.lit(r.name).alias("rule"), _spans(F.col("text"), r).alias("spans"))) for r in rules])
    scanned = todo.select("blob", F.explode(spans).alias("found")).where("size(found.spans) > 0").select("blob", "found.*")
    scanned = saved(scanned, "scanned")
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    each = unseen.select("blob", "missing").distinct().select("blob", F.explode("missing").alias("rule"))
    added = each.join(scanned.hint("merge"), ["blob", "rule"], "left").select("blob", "rule", version[F.col("rule")].cast("int").alias("version"), F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans"))
    if ledger is not None:
        added.write.mode("append").parquet(ledger)
        added = read_ledger(spark, ledger).join(held.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    hits = scanned.select("blob", "spans").unionAll(held.where("size(spans) > 0").select("blob", "spans")).select("blob", F.explode("spans").alias("s"))
    keyed = hits.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(F.col("s.begin").alias("begin"), order[F.col("s.kind")].alias("place"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")))).alias("spans"))
    keyed = saved(keyed.select("blob", F.transform("spans", lambda s: F.struct(s.begin.alias("begin"), s.end.alias("end"), s.kind.alias("kind"))).alias("spans")), "found")
    findings = own.select("path", "blob").join(keyed.hint("merge"), "blob", "left")
    return findings.select("path", "blob", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans")), added


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",")


def secret_digests(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text of ``docs`` (doc_id, text); blobs that the ledger's folder has are not scanned again.

    Without a folder the ledger is a new one in the shared folder. Null is the empty text; other columns are ignored; rows
    that repeat, also with one doc_id or none, are each given; no rows give none.
    """
    findings, _ = scan(docs.select(F.col("doc_id").alias("path"), "text"), ledger or new_path(docs.sparkSession, "ledger"))
    base = F.filter("spans", lambda s: s.kind.isin([r.name for r in BASE]))
    count = lambda name: F.size(F.filter("spans", lambda s: s.kind == name)).cast("long").alias(f"n_{name}")
    return findings.select(F.col("path").alias("doc_id"), *[count(r.name) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``docs`` with every span of a secret replaced by [kind], and n_chars, if there, counted anew.

    Rows are joined by content, so repeated rows stay as many; null texts stay null; columns of any other names are kept.
    Texts without a finding pass by the join.
    """
    findings, _ = scan(docs.select(F.lit(0).alias("path"), "text"), ledger)
    found = saved(findings.where("size(spans) > 0").select("blob", "spans").distinct(), "redactions")
    blob, spans, again = fresh(docs, "blob"), fresh(docs, "spans"), fresh(docs, "again")
    hit, rest = parted(docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)), [blob], marks(found.select(F.col("blob").alias(blob)), [blob]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(state: Column, s: Column) -> Column:
        first = s.begin >= state.at
        gap = F.substring(F.col("text"), state.at + 1, s.begin - state.at)
        new = F.when(first, F.concat(state.text, gap, F.lit("["), s.kind, F.lit("]"))).otherwise(state.text)
        return F.struct(F.greatest(state.at, s.end).alias("at"), new.alias("text"))

    cut = F.aggregate(F.col(spans), start, step, lambda s: F.concat(s.text, F.substring(F.col("text"), s.at + 1, F.length("text"))))
    out = hit.join(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)).hint("merge"), blob, "left")
    out = out.withColumn(again, F.size(spans) > 0).withColumn("text", F.when(F.col(again), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(again), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns).unionAll(rest.select(*docs.columns))
