"""Secret scans with an incremental ledger: each content is scanned once for each version of each rule."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import boxed, materialise, name, scratch_dir, sieved


def either_case(pattern: str) -> str:
    """A pattern of plain letters that takes each of them in either case, ASCII alone."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in pattern)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and not overlapping, of which ``group`` has ``least`` characters.

    A new version of a rule is scanned for in all contents; the findings of the old one stay in the ledger.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The words before an assigned secret, and what secrets are made of.
ASSIGNED = either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGNED, 2, 8),
    # A run that is too short holds none that is long enough, so the least length may stand in the pattern.
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Findings are (kind, start, end) in code points, the end exclusive.
_SPAN = "array<struct<start:long,end:long>>"
LEDGER = f"blob string, kind string, version int, spans {_SPAN}"


def spans(text: Column, rule: Rule) -> Column:
    """Where a rule matches, in order.

    A text is what it is parted into by the matches, with the matches in
    between; so the places follow from the lengths of both, which come from the
    same pattern.
    """
    gaps = F.split(text, f"({rule.pattern})", -1)
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    own = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
    # The gap before a match, the match, and whether it counts; what follows the last match is a gap without one.
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), (F.length(own(m)) >= rule.least).alias("counts")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(so_far: Column, m: Column) -> Column:
        begin = so_far["at"] + m["gap"]
        span = F.array(F.struct(begin.alias("start"), (begin + m["size"]).alias("end")))
        return F.struct((begin + m["size"]).alias("at"), F.when(m["counts"], F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    return F.aggregate(steps, start, add, lambda s: s["spans"])


class Ledger:
    """What was scanned for, and found, by content: a table that grows by the pairs of content and rule that are new.

    A row is a pair (blob, kind and version) with all its spans, so a row says
    both that a pair was scanned and what was found. If a run dies while it
    appends, the rows that are there are whole, and the next run scans the
    rest. Two runs at once may scan a pair twice; it is read once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
        # Makes the table, if there is none.
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def unseen(self, blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """(blob, kinds): the rules that a blob of ``blobs`` (its only column) wasn't scanned for; none is a blob without any."""
        asked = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))
        pairs = blobs.toDF("blob").distinct().select("blob", asked.alias("rule")).select("blob", "rule.*")
        new = pairs.join(self.read().select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        return new.groupBy("blob").agg(F.collect_set("kind").alias("kinds"))

    def scan(self, versions: DataFrame, rules: Sequence[Rule] = RULES) -> None:
        """Scan what is new in ``versions`` (blob, text), and append it."""
        wanted = materialise(self.unseen(versions.select("blob"), rules))
        # Texts of known blobs stay where they are; copies become one before the shuffle.
        hashed = versions.select("blob", "text", F.xxhash64("blob").alias("hash"))
        some = sieved(hashed, "hash", wanted.select(F.xxhash64("blob"))).where("maybe")
        contents = some.groupBy("blob").agg(F.first("text").alias("text")).join(wanted, "blob")
        found = F.array(*[F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules])
        rows = contents.select("blob", F.explode(F.array_compact(found)).alias("pair")).select("blob", "pair.*")
        rows.write.mode("append").parquet(self.path)

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """(blob, spans): kind, start and end by start, then by the order of the rules; blobs without findings aren't returned."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        rows = self.read().where(F.array_contains(now, F.struct("kind", "version")) & (F.size("spans") > 0)).groupBy("blob", "kind").agg(F.first("spans").alias("spans"))
        flat = F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("no"), s["end"].alias("end"), F.col("kind").alias("kind")))))
        return rows.groupBy("blob").agg(F.transform(F.array_sort(flat), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def address(text: Column) -> Column:
    """The address of a content."""
    return F.sha2(text, 256)


def scan_secrets(docs: DataFrame, *, text: str = "text", rules: Sequence[Rule] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, its ``blob`` and ``spans``: array of (kind, start, end), by start, then kind.

    A row is a historical version of a path, whatever its columns; its content
    is known by its hash. Contents that the ledger has for the rules' versions
    aren't scanned again; without a ledger a new one is begun. A null text is
    empty; repeated rows stay; the empty table gives the empty table. All is
    done by DataFrame operations; a content is scanned by one task.
    """
    content = F.coalesce(name(text), F.lit(""))
    versions = boxed(docs, blob=address(content), text=content)
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(versions, rules)
    found = materialise(ledger.findings(rules))
    # Most contents have no finding; their rows aren't dealt out.
    rows = sieved(versions.select("row", "blob", F.xxhash64("blob").alias("hash")), "hash", found.select(F.xxhash64("blob")))
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    met = rows.where("maybe").select("row", "blob").join(found, "blob", "left").select("row", "blob", F.coalesce("spans", none).alias("spans"))
    return rows.where("NOT maybe").select("row", "blob", none.alias("spans")).unionByName(met)


def span_text(of: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
