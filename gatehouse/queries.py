"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Policies, groups and callers are derived from the tables by fixed rules:
embeddings and documents get grants and denies from their label columns,
customers are members of nations, nations of regions, regions of staff.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import policy, text, vectors
from .operators import index as ix
from .operators import ingest as ing
from .operators import metrics, mih, simulate, store, topk
from .operators.index import VectorIndex
from .operators.retrieve import answer
from .plans.tables import Tables, shared_folder
from .principals import effective_principals, whoami
from .schemas import RAW
from .service.identity import header_groups
from .sources.drive import PERMISSIONS, grants_of
from .sources.filesystem import nearest_rules
from .streaming.acl_cache import replay_log

CALLERS = {"c1": ["everyone", "team1", "u1"], "c2": ["contractors", "everyone", "team3", "u2"], "c3": [], "c4": ["u3"]}
READER = ["everyone", "lang:en", "u1"]
#: The query vectors: embeddings whose id is divisible by this.
EVERY = 100
DIMENSION = 64
WINDOW = 1000
SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def some(condition: Column, value: str | Column) -> Column:
    """[value] if the condition holds, else []."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(value) if isinstance(value, str) else value)).otherwise(policy.no_ids())


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with policies."""
    e = table(spark, sf_dir, "embeddings")
    team = F.concat(F.lit("team"), (F.col("label") % 5).cast("string"))
    return e.select("vec_id", F.col("embedding").alias("vector"), F.concat(F.array(team), some(F.col("label") == 0, "everyone")).alias("grants"), some(F.col("label") == 3, "contractors").alias("denies"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with policies: none without a label."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    both = d.join(l, "doc_id", "left")
    lang = F.when(F.col("labelled"), F.array(F.concat(F.lit("lang:"), "lang"))).otherwise(policy.no_ids())
    return both.select("doc_id", "text", "lang", "source", "n_chars", policy.ids(F.concat(lang, some(F.col("quality") == 1, "everyone"))).alias("grants"), some(F.col("toxic") == 1, "contractors").alias("denies"))


ENTRIES = """entries AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector,
           CASE WHEN label = 0 THEN ['team0', 'everyone'] ELSE ['team' || CAST(label % 5 AS VARCHAR)] END AS grants,
           CASE WHEN label = 3 THEN ['contractors'] ELSE CAST([] AS VARCHAR[]) END AS denies
    FROM embeddings)"""
DOCUMENTS = """docs AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
           CASE WHEN l.doc_id IS NULL THEN CAST([] AS VARCHAR[]) WHEN l.quality = 1 THEN ['everyone', 'lang:' || d.lang] ELSE ['lang:' || d.lang] END AS grants,
           CASE WHEN l.toxic = 1 THEN ['contractors'] ELSE CAST([] AS VARCHAR[]) END AS denies
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _list(ids: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in ids) + "]" if ids else "CAST([] AS VARCHAR[])"


CALLER_ROWS = "callers AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {_list(p)})" for c, p in CALLERS.items()) + ") AS t(caller, perms))"
ADMITS = "(list_has_any(grants, perms) AND NOT list_has_any(denies, perms))"


def each_caller(rows: DataFrame) -> DataFrame:
    """Every row for each of the callers (a fixed list)."""
    them = F.array(*[F.struct(F.lit(c).alias("caller"), policy.ids(p).alias("perms")) for c, p in CALLERS.items()])
    return rows.withColumn("_c", F.explode(them)).select(*rows.columns, "_c.*")


@query(f"WITH {ENTRIES}, {CALLER_ROWS} SELECT vec_id, caller, {ADMITS} AS admitted FROM entries CROSS JOIN callers")
def acl_admits(spark, sf_dir):
    return each_caller(entries(spark, sf_dir)).select("vec_id", "caller", policy.admits("grants", "denies", "perms").alias("admitted"))


REASON = """CASE WHEN len(perms) = 0 THEN 'empty permission set'
    WHEN len(list_intersect(denies, perms)) > 0 THEN 'denied via ' || array_to_string(list_sort(list_intersect(denies, perms)), ', ')
    WHEN len(grants) = 0 THEN 'no grants'
    WHEN len(list_intersect(grants, perms)) > 0 THEN 'granted via ' || array_to_string(list_sort(list_intersect(grants, perms)), ', ')
    ELSE 'no matching grant' END"""


@query(f"""WITH {DOCUMENTS}, {CALLER_ROWS} SELECT doc_id, caller, {ADMITS} AS admitted,
    array_to_string(list_sort(list_intersect(grants, perms)), ',') AS matched_grants, array_to_string(list_sort(list_intersect(denies, perms)), ',') AS matched_denies, {REASON} AS reason
    FROM docs CROSS JOIN callers""")
def acl_explain(spark, sf_dir):
    rows = each_caller(documents(spark, sf_dir)).withColumn("d", policy.explain("grants", "denies", "perms"))
    return rows.select("doc_id", "caller", "d.admitted", F.array_join("d.matched_grants", ",").alias("matched_grants"), F.array_join("d.matched_denies", ",").alias("matched_denies"), "d.reason")


def _part(column: str, sign: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort({column}), lambda x: '{sign}' || CAST(length(x) AS VARCHAR) || ':' || x), ''), '')"


KEY = f"sha256({_part('grants', '+')} || {_part('denies', '-')})"


@query(f"""WITH {DOCUMENTS}, p AS (SELECT {KEY} AS policy_key, array_to_string(grants, ',') AS grants, array_to_string(denies, ',') AS denies, count(*) AS documents FROM docs GROUP BY 1, 2, 3)
    SELECT CAST(row_number() OVER (ORDER BY policy_key) - 1 AS BIGINT) AS policy_id, policy_key, grants, denies, documents FROM p""")
def acl_policy_intern(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("policy_key", policy.policy_key("grants", "denies"))
    used = docs.groupBy("policy_key").agg(F.count("*").alias("documents"))
    known = ix.intern_policies(docs).join(used, "policy_key")
    return known.select("policy_id", "policy_key", F.array_join("grants", ",").alias("grants"), F.array_join("denies", ",").alias("denies"), "documents")


@query(f"WITH {DOCUMENTS} SELECT doc_id FROM docs WHERE list_has_any(grants, {_list(READER)}) AND NOT list_has_any(denies, {_list(READER)})")
def acl_semi_anti(spark, sf_dir):
    docs = documents(spark, sf_dir)
    mine = spark.createDataFrame([(p,) for p in READER], "p string")
    granted = docs.select("doc_id", F.explode("grants").alias("p")).join(mine, "p", "left_semi")
    denied = docs.select("doc_id", F.explode("denies").alias("p")).join(mine, "p", "left_semi")
    return docs.select("doc_id").join(granted, "doc_id", "left_semi").join(denied, "doc_id", "left_anti")


@query(f"WITH {DOCUMENTS}, {CALLER_ROWS} SELECT caller, count(*) FILTER (WHERE {ADMITS}) AS visible_count, count(*) AS total FROM docs CROSS JOIN callers GROUP BY caller")
def acl_visible_counts(spark, sf_dir):
    rows = each_caller(documents(spark, sf_dir).select("grants", "denies"))
    return rows.groupBy("caller").agg(F.count_if(policy.admits("grants", "denies", "perms")).alias("visible_count"), F.count("*").alias("total"))


@query(f"""WITH {DOCUMENTS} SELECT doc_id, array_to_string(list_filter(grants, lambda x: x <> 'everyone'), ',') AS revoked,
    array_to_string(list_sort(list_distinct(list_concat(grants, ['team1']))), ',') AS granted, array_to_string(list_sort(list_distinct(list_concat(denies, ['team1']))), ',') AS denied,
    list_has_all({_list(READER)}, grants) AS within, list_contains(grants, 'everyone') AS public, len(grants) AS n_grants FROM docs""")
def acl_algebra(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",")
    return documents(spark, sf_dir).select("doc_id", joined(policy.revoke("grants", "everyone")).alias("revoked"), joined(policy.with_rule("grants", "team1")).alias("granted"), joined(policy.with_rule("denies", "team1")).alias("denied"), policy.is_subset(F.col("grants"), policy.ids(READER)).alias("within"), F.array_contains("grants", "everyone").alias("public"), F.size("grants").cast("long").alias("n_grants"))


def edges(spark: SparkSession, sf_dir: str, *more: tuple[str, str]) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nation, region = F.concat(F.lit("nation:"), "n_nationkey"), lambda c: F.concat(F.lit("region:"), c)
    out = n.select(nation.alias("child"), region("n_regionkey").alias("parent")).unionByName(r.select(region("r_regionkey").alias("child"), F.lit("staff").alias("parent")))
    return out.unionByName(spark.createDataFrame(more, "child string, parent string")) if more else out


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("cust:"), "c_custkey").alias("id"), F.array(F.concat(F.lit("nation:"), "c_nationkey")).alias("groups"))


def _closure(more: str = "", end: str = "SELECT id, principal FROM reached") -> str:
    return f"""WITH RECURSIVE edges AS (
        SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS child, 'region:' || CAST(n_regionkey AS VARCHAR) AS parent FROM nation
        UNION SELECT 'region:' || CAST(r_regionkey AS VARCHAR), 'staff' FROM region {more}),
    reached AS (
        SELECT 'cust:' || CAST(c_custkey AS VARCHAR) AS id, unnest(['cust:' || CAST(c_custkey AS VARCHAR), 'everyone', 'nation:' || CAST(c_nationkey AS VARCHAR)]) AS principal FROM customer
        UNION SELECT id, parent FROM reached JOIN edges ON child = principal)
    {end}"""


@query(_closure())
def principal_closure(spark, sf_dir):
    return effective_principals(customers(spark, sf_dir), edges(spark, sf_dir))


@query(_closure("UNION SELECT 'staff', 'nation:0'"))
def principal_closure_cyclic(spark, sf_dir):
    return effective_principals(customers(spark, sf_dir), edges(spark, sf_dir, ("staff", "nation:0")))


@query(_closure(end="SELECT id, string_agg(principal, ',' ORDER BY principal) AS principals FROM reached GROUP BY id"))
def whoami_all(spark, sf_dir):
    return whoami(customers(spark, sf_dir), edges(spark, sf_dir)).withColumn("principals", F.array_join("principals", ","))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of the store's table (schemas.DOCUMENTS)."""
    docs = documents(spark, sf_dir)
    shaped = docs.select(F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("document_id"), F.coalesce("source", F.lit("")).alias("connector"), F.concat(F.lit("file:///"), "doc_id").alias("uri"), F.coalesce("lang", F.lit("")).alias("title"), F.col("n_chars").cast("string").alias("version"), "grants", "denies", F.coalesce("text", F.lit("")).alias("text"))
    return store.with_fingerprints(shaped)


STORED = f"""{DOCUMENTS}, stored AS (
    SELECT 'doc:' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS document_id, coalesce(source, '') AS connector, 'file:///' || CAST(doc_id AS VARCHAR) AS uri,
           coalesce(lang, '') AS title, CAST(n_chars AS VARCHAR) AS version, sha256(coalesce(text, '')) AS content_hash, sha256(sha256(coalesce(text, '')) || {KEY}) AS fingerprint, grants, denies, coalesce(text, '') AS text FROM docs)"""
SUMMARY = "document_id, connector, uri, title, version, content_hash, array_to_string(grants, ',') AS grants, array_to_string(denies, ',') AS denies"


def flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"grants": F.array_join("grants", ","), "denies": F.array_join("denies", ",")})


@query(f"WITH {STORED} SELECT {SUMMARY} FROM stored ORDER BY document_id LIMIT 500")
def catalog(spark, sf_dir):
    return flat(store.catalog(stored(spark, sf_dir), 500))


@query(f"WITH {STORED}, p AS (SELECT {_list(READER)} AS perms) SELECT {SUMMARY} FROM stored, p WHERE {ADMITS} ORDER BY document_id LIMIT 200")
def list_documents(spark, sf_dir):
    return flat(store.list_documents(stored(spark, sf_dir), READER, 200))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (schemas.CHUNKS) of WINDOW code points, without overlap: a cut that SQL can make too."""
    docs = stored(spark, sf_dir)
    n = F.ceil(F.length("text") / F.lit(WINDOW)).cast("int")
    cut = docs.where(F.length("text") > 0).select("document_id", "grants", "denies", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("ordinal"))
    start = F.col("ordinal") * WINDOW
    return cut.select(ing.chunk_id("document_id", "ordinal").alias("chunk_id"), "document_id", "ordinal", start.alias("span_start"), F.least(start + WINDOW, F.length("text")).alias("span_end"), F.substring("text", start + 1, F.lit(WINDOW)).alias("text"), "grants", "denies")


WINDOWS = f"""{STORED}, chunks AS (
    SELECT document_id || '#' || CAST(i AS VARCHAR) AS chunk_id, document_id, CAST(i AS INTEGER) AS ordinal, CAST(i * {WINDOW} AS INTEGER) AS span_start,
           CAST(least((i + 1) * {WINDOW}, length(text)) AS INTEGER) AS span_end, substr(text, CAST(i * {WINDOW} + 1 AS BIGINT), {WINDOW}) AS text, grants, denies
    FROM (SELECT *, unnest(range(CAST(ceil(length(text) / {WINDOW}.0) AS BIGINT))) AS i FROM stored WHERE length(text) > 0))"""


@query(f"WITH {WINDOWS} SELECT chunk_id, c.document_id, ordinal, span_start, span_end, md5(c.text) AS text_md5, connector, uri, title, version FROM chunks c JOIN stored s ON c.document_id = s.document_id")
def chunk_source_join(spark, sf_dir):
    both = store.chunks_with_sources(windows(spark, sf_dir).drop("grants", "denies"), stored(spark, sf_dir))
    return both.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@query(f"""WITH {WINDOWS}, wanted AS (SELECT 'doc:' || lpad(CAST(vec_id AS VARCHAR), 9, '0') || '#0' AS chunk_id, CAST(label * 1000000 + vec_id AS BIGINT) AS position FROM embeddings), p AS (SELECT {_list(READER)} AS perms)
    SELECT position, c.chunk_id, md5(text) AS text_md5 FROM chunks c JOIN wanted w ON c.chunk_id = w.chunk_id CROSS JOIN p WHERE {ADMITS}""")
def get_chunks_ordered(spark, sf_dir):
    wanted = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc:"), F.lpad(F.col("vec_id").cast("string"), 9, "0"), F.lit("#0")).alias("chunk_id"), (F.col("label") * 1000000 + F.col("vec_id")).cast("long").alias("position"))
    got = store.get_chunks(windows(spark, sf_dir), stored(spark, sf_dir), wanted, READER)
    return got.select("position", "chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5")).orderBy("position")


@query("""SELECT '/r/' || coalesce(lang, '') || '/' || coalesce(source, '') || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path,
    CASE WHEN doc_id % 10 = 0 THEN '/r/' || coalesce(lang, '') || '/' || coalesce(source, '') || '/' || CAST(doc_id AS VARCHAR) || '.md.acl.json'
         WHEN source IN ('src1', 'src3') THEN '/r/' || coalesce(lang, '') || '/' || source || '/.rules' WHEN lang = 'de' THEN '/r/de/.rules' WHEN lang = 'fr' THEN NULL ELSE NULL END AS rules_path FROM documents""")
def nearest_acl(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(F.lit("/r/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), "doc_id", F.lit(".md")).alias("path"))
    own = docs.where("doc_id % 10 = 0").select(F.concat("path", F.lit(".acl.json")).alias("path"))
    folders = docs.where(F.col("source").isin("src1", "src3")).select(F.concat(F.lit("/r/"), F.coalesce("lang", F.lit("")), F.lit("/"), "source", F.lit("/.rules")).alias("path"))
    langs = docs.where("lang = 'de'").select(F.lit("/r/de/.rules").alias("path"))
    return nearest_rules(docs.select("path"), own.union(folders).union(langs).distinct(), "/r", ".rules")


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT CASE event_type WHEN 'view' THEN 'u' || CAST(user_id % 7 AS VARCHAR) || '@example.com' WHEN 'click' THEN 'g' || CAST(event_id % 5 AS VARCHAR) || '@example.com'
    WHEN 'purchase' THEN 'domain:d' || CAST(event_id % 3 AS VARCHAR) || '.example.com' WHEN 'signup' THEN 'everyone' END) FILTER (WHERE event_type <> 'error')), ',') AS grants FROM events GROUP BY user_id""")
def drive_acl_map(spark, sf_dir):
    kinds = {"view": "user", "click": "group", "purchase": "domain", "signup": "anyone", "error": "robot"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    mail = F.when(F.col("event_type") == "view", F.concat(F.lit("u"), F.col("user_id") % 7, F.lit("@example.com"))).otherwise(F.concat(F.lit("g"), F.col("event_id") % 5, F.lit("@example.com")))
    listed = F.struct(kind.alias("type"), mail.alias("emailAddress"), F.concat(F.lit("d"), F.col("event_id") % 3, F.lit(".example.com")).alias("domain"))
    by_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(listed).cast(PERMISSIONS).alias("permissions"))
    return by_user.select("user_id", F.array_join(grants_of("permissions"), ",").alias("grants"))


UNIT = """unit AS (SELECT vec_id, grants, denies, list_transform(vector, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v
    FROM (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM entries))"""


@query(f"WITH {ENTRIES}, {UNIT} SELECT vec_id, CAST(i AS INTEGER) AS dim, round(v[i], 9) AS value FROM unit, range(1, {DIMENSION + 1}) AS t(i)")
def vec_normalize(spark, sf_dir):
    unit = entries(spark, sf_dir).select("vec_id", F.posexplode(vectors.l2_normalize("vector")).alias("p", "x"))
    return unit.select("vec_id", (F.col("p") + 1).alias("dim"), F.round("x", 9).alias("value"))


BITS = """bits AS (SELECT vec_id, grants, denies, vector, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS bin
    FROM (SELECT *, list_sum(list_transform(range(64), lambda i: CASE WHEN vector[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS s FROM entries))"""


@query(f"WITH {ENTRIES}, {BITS} SELECT vec_id, bin AS code FROM bits")
def vec_binarize(spark, sf_dir):
    return entries(spark, sf_dir).select("vec_id", F.element_at(vectors.binarize("vector"), 1).alias("code"))


@query(f"""WITH {ENTRIES}, {BITS} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, far FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.bin, c.bin)) AS INTEGER) AS far, row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.bin, c.bin)), c.vec_id) AS rank
    FROM bits q JOIN bits c ON q.vec_id % {EVERY} = 0) WHERE rank <= 10""")
def vec_hamming_topk(spark, sf_dir):
    bits = entries(spark, sf_dir).select("vec_id", vectors.binarize("vector").alias("bin"))
    asked = bits.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "bin")
    best = topk.k_best(bits, asked, 10, topk.nearest_codes, key="vec_id", order="far long")
    return numbered(best, "far").withColumn("far", F.col("far").cast("int"))


def numbered(best: DataFrame, *order: str | Column) -> DataFrame:
    """Ranks of the few best rows of each query."""
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id")))


@query(SQL["vec_hamming_topk"])
def mih_hamming_topk(spark, sf_dir):
    """The same neighbours by multi-index hashing, which reads the buckets that may hold one."""
    bits = entries(spark, sf_dir).select("vec_id", vectors.binarize("vector").alias("bin"))
    asked = bits.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "bin")
    return mih.nearest(bits, asked, 10)[0].select("query_id", "rank", "vec_id", "far")


FIT = f"""fit AS (SELECT i, min(vector[i]) AS minimum, CASE WHEN max(vector[i]) = min(vector[i]) THEN 1 ELSE max(vector[i]) - min(vector[i]) END AS scale
    FROM entries, range(1, {DIMENSION + 1}) AS t(i) GROUP BY i), q AS (SELECT list(minimum ORDER BY i) AS minimum, list(scale ORDER BY i) AS scale FROM fit)"""


@query(f"WITH {ENTRIES}, {FIT} SELECT CAST(i AS INTEGER) AS dim, round(minimum, 9) AS minimum, round(scale, 9) AS scale FROM fit")
def quant_fit(spark, sf_dir):
    both = ix.fit_int8(entries(spark, sf_dir), dimension=DIMENSION).select(F.posexplode(F.arrays_zip("minimum", "scale")).alias("p", "x"))
    return both.select((F.col("p") + 1).alias("dim"), F.round(F.col("x.minimum").cast("double"), 9).alias("minimum"), F.round("x.scale", 9).alias("scale"))


CODES = f"{FIT}, codes AS (SELECT vec_id, grants, denies, list_transform(range(1, {DIMENSION + 1}), lambda i: greatest(-128, least(127, round_even((vector[i] - minimum[i]) / scale[i] * 255, 0) - 128))) AS i8, minimum, scale FROM entries, q)"


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their codes i8, and the ranges minimum and scale (one row, hence the broadcast)."""
    rows = entries(spark, sf_dir)
    q = ix.fit_int8(rows, dimension=DIMENSION)
    return rows.join(F.broadcast(q)).withColumn("i8", vectors.int8_encode("vector", "minimum", "scale"))


@query(f"WITH {ENTRIES}, {CODES} SELECT vec_id, CAST(i AS INTEGER) AS dim, CAST(i8[i] AS INTEGER) AS code FROM codes, range(1, {DIMENSION + 1}) AS t(i)")
def quant_encode(spark, sf_dir):
    return coded(spark, sf_dir).select("vec_id", F.posexplode("i8").alias("p", "c")).select("vec_id", (F.col("p") + 1).alias("dim"), F.col("c").cast("int").alias("code"))


@query(f"WITH {ENTRIES}, {CODES} SELECT vec_id, CAST(i AS INTEGER) AS dim, round((i8[i] + 128) / 255.0 * scale[i] + minimum[i], 9) AS value FROM codes, range(1, {DIMENSION + 1}) AS t(i)")
def quant_decode(spark, sf_dir):
    return coded(spark, sf_dir).select("vec_id", F.posexplode(vectors.int8_decode("i8", "minimum", "scale")).alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("dim"), F.round("x", 9).alias("value"))


DECODED = f"list_inner_product(list_transform(range(1, {DIMENSION + 1}), lambda i: (c.i8[i] + 128) / 255.0 * c.scale[i] + c.minimum[i]), a.vector)"


@query(f"WITH {ENTRIES}, {CODES} SELECT a.vec_id AS query_id, c.vec_id, round({DECODED}, 6) AS score FROM codes c JOIN entries a ON a.vec_id % {EVERY} = 0")
def quant_rescore(spark, sf_dir):
    """Every code against every query vector."""
    rows = entries(spark, sf_dir)
    asked = ix.folded(asked_vectors(rows), ix.fit_int8(rows, dimension=DIMENSION)).select("query_id", "weights", "bias")
    codes = text.spread(coded(spark, sf_dir).select("vec_id", "i8"))
    return topk.every_score(codes, asked, key="vec_id", digits=6)


def asked_vectors(rows: DataFrame) -> DataFrame:
    """The query set: query_id, vector."""
    return rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "vector")


@query(f"""WITH {ENTRIES} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, c.vec_id, list_inner_product(c.vector, a.vector) AS score FROM entries c JOIN entries a ON a.vec_id % {EVERY} = 0)) WHERE rank <= 10""")
def exact_topk(spark, sf_dir):
    rows = entries(spark, sf_dir).select("vec_id", "vector")
    return best_exact(rows, asked_vectors(rows)).withColumn("score", F.round("score", 6))


def best_exact(rows: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    best = topk.k_best(rows.select("vec_id", "vector"), asked, k, topk.largest_products, key="vec_id", order="under double")
    return numbered(best.select("query_id", "vec_id", (-F.col("under")).alias("score")), F.desc("score"))


#: The index holds normalised vectors.
UNITS = ENTRIES.replace("entries AS", "plain AS") + """, entries AS (SELECT vec_id, grants, denies, list_transform(vector, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS vector
    FROM (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM plain))"""


def _search_sql(kept: int, k: int, who: str, end: str) -> str:
    """Two stages for every (query, caller) of ``who``."""
    return f"""WITH {UNITS}, {BITS}, {CODES}, {CALLER_ROWS},
    asked AS (SELECT b.vec_id, b.bin, b.vector, caller, perms FROM bits b CROSS JOIN callers WHERE b.vec_id % {EVERY} = 0 AND {who}),
    near AS (SELECT * FROM (SELECT a.vec_id AS query, a.caller, a.vector, b.vec_id, row_number() OVER (PARTITION BY a.vec_id, a.caller ORDER BY bit_count(xor(a.bin, b.bin)), b.vec_id) AS n
        FROM asked a JOIN bits b ON list_has_any(b.grants, a.perms) AND NOT list_has_any(b.denies, a.perms)) WHERE n <= {kept}),
    scored AS (SELECT a.query, a.caller, c.vec_id, {DECODED} AS score FROM near a JOIN codes c ON c.vec_id = a.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query, caller ORDER BY score DESC, vec_id) AS rank FROM scored)
    {end.format(k=k)}"""


_STORED: dict[tuple[str, str], object] = {}


def chunk_of(vec_id: Column | str) -> Column:
    """The chunk id of a vector, in the order of the vectors' ids."""
    return F.lpad(F.col(vec_id).cast("string") if isinstance(vec_id, str) else vec_id, 12, "0")


def stored_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of the embeddings, built, published and validated once in an application, and read from its tables."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        tables = Tables(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        made = ix.VectorIndex.build(entries(spark, sf_dir).select(chunk_of("vec_id").alias("chunk_id"), F.lit("embeddings").alias("document_id"), "vector", "grants", "denies"))
        tables.publish({"index": made.codes, "policies": made.policies, "quant": made.quant})
        now = tables.read()
        _STORED[at] = ix.VectorIndex(now["index"], now["policies"], now["quant"], tables.bytes_of("index")).validate()
    return _STORED[at]


def _searched(spark: SparkSession, sf_dir: str, callers: dict, k: int, kept: int) -> DataFrame:
    """The query set for each caller, against the stored index: query_id (vec_id/caller), rank, vec_id, score."""
    them = F.explode(F.array(*[F.struct(F.lit(c).alias("caller"), policy.ids(p).alias("permissions")) for c, p in callers.items()]))
    asked = asked_vectors(entries(spark, sf_dir)).withColumn("c", them)
    asked = asked.select(F.concat("query_id", F.lit("/"), "c.caller").alias("query_id"), "c.permissions", "vector")
    found = ix.batch_search(stored_index(spark, sf_dir), asked, k, candidates=kept)
    return found.select("query_id", "rank", F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


ONE = "SELECT CAST(query AS VARCHAR) || '/' || caller AS query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= {k}"


@query(_search_sql(640, 10, "caller = 'c1'", ONE))
def scoped_search(spark, sf_dir):
    """The flagship: each query vector under one caller's permissions, k = 10."""
    return _searched(spark, sf_dir, {"c1": CALLERS["c1"]}, 10, 640)


@query(_search_sql(160, 10, "caller = 'c1'", ONE))
def scoped_search_narrow(spark, sf_dir):
    """With so few candidates that the Hamming stage cuts; its recall is a row of recall_by_setting."""
    return _searched(spark, sf_dir, {"c1": CALLERS["c1"]}, 10, 160)


@query(_search_sql(640, 10, "true", ONE))
def batch_scoped_search(spark, sf_dir):
    return _searched(spark, sf_dir, CALLERS, 10, 640)


@query(_search_sql(640, 10, "caller = 'c1'", """, exact AS (SELECT query, vec_id FROM (SELECT a.vec_id AS query, e.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(e.vector, a.vector) DESC, e.vec_id) AS n
    FROM asked a JOIN entries e ON list_has_any(e.grants, a.perms) AND NOT list_has_any(e.denies, a.perms)) WHERE n <= {k})
    SELECT CAST(count(DISTINCT x.query) AS BIGINT) AS queries, count(r.vec_id) AS hits, round(count(r.vec_id) / (count(DISTINCT x.query) * {k}.0), 9) AS recall FROM exact x LEFT JOIN ranked r ON r.query = x.query AND r.vec_id = x.vec_id AND r.rank <= {k}"""))
def recall_at_k(spark, sf_dir):
    """Recall at 10 of the flagship's setting (64 candidates for each row wanted) over the query set, against brute force."""
    found = _searched(spark, sf_dir, {"c1": CALLERS["c1"]}, 10, 640).withColumn("query_id", F.split("query_id", "/")[0].cast("long"))
    rows = entries(spark, sf_dir)
    mine = rows.where(policy.admits("grants", "denies", CALLERS["c1"])).select("vec_id", "vector")
    return ix.recall_at_k(best_exact(mine, asked_vectors(rows)), found, 10).withColumn("recall", F.round("recall", 9))


def _recall_sql(kept: int) -> str:
    """Recall of one setting for every caller who sees anything, as a row a caller."""
    return _search_sql(kept, 10, "len(perms) > 0", """, exact AS (SELECT query, caller, vec_id FROM (SELECT a.vec_id AS query, a.caller, e.vec_id, row_number() OVER (PARTITION BY a.vec_id, a.caller ORDER BY list_inner_product(e.vector, a.vector) DESC, e.vec_id) AS n
        FROM asked a JOIN plain e ON list_has_any(e.grants, a.perms) AND NOT list_has_any(e.denies, a.perms)) WHERE n <= {k})
        SELECT @kept AS candidates, x.caller, count(*) AS wanted, count(r.vec_id) AS hits, round(count(r.vec_id) / count(*), 9) AS recall
        FROM exact x LEFT JOIN ranked r ON r.query = x.query AND r.caller = x.caller AND r.vec_id = x.vec_id AND r.rank <= {k} GROUP BY x.caller""").replace("@kept", str(kept))


@query(" UNION ALL ".join(f"SELECT * FROM ({_recall_sql(kept)})" for kept in (160, 640)))
def recall_by_setting(spark, sf_dir):
    """Recall at 10 of each registered setting, for each caller who sees anything, over the query set, against brute force."""
    rows = entries(spark, sf_dir)
    who = {c: p for c, p in CALLERS.items() if p}
    asked = asked_vectors(rows)
    exact = None
    for c, p in who.items():
        own = best_exact(rows.where(policy.admits("grants", "denies", p)), asked).select(F.concat("query_id", F.lit(f"/{c}")).alias("query_id"), "vec_id")
        exact = own if exact is None else exact.unionByName(own)
    out = None
    for kept in (160, 640):
        found = _searched(spark, sf_dir, who, 10, kept).select("query_id", "vec_id", F.lit(1).alias("hit"))
        both = exact.join(found, ["query_id", "vec_id"], "left").groupBy(F.split("query_id", "/")[1].alias("caller")).agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
        of = both.select(F.lit(kept).alias("candidates"), "caller", "wanted", "hits", F.round(F.col("hits") / F.col("wanted"), 9).alias("recall"))
        out = of if out is None else out.unionByName(of)
    return out


#: Text chunks with the vector of the same number and their document's policy: what an index of the documents has.
FIRST_CHUNK = "'doc:' || lpad(CAST(vec_id AS VARCHAR), 9, '0')"
CHUNK_SEARCH = f"""{WINDOWS}, joined AS (SELECT {FIRST_CHUNK} || '#0' AS vec_id, vec_id AS number, CAST(embedding AS DOUBLE[]) AS plain_vector, grants, denies FROM embeddings JOIN stored ON document_id = {FIRST_CHUNK}),
    entries AS (SELECT vec_id, number, grants, denies, list_transform(plain_vector, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS vector
        FROM (SELECT *, sqrt(list_sum(list_transform(plain_vector, lambda x: x * x))) AS n FROM joined)),
    {BITS.replace("SELECT vec_id, grants", "SELECT vec_id, number, grants")}, {CODES}"""


@query(f"""WITH {CHUNK_SEARCH}, p AS (SELECT {_list(READER)} AS perms),
    asked AS (SELECT vec_id AS query_id, bin, vector FROM (SELECT vec_id, list_transform(x, lambda y: y / CASE WHEN n = 0 THEN 1 ELSE n END) AS vector, CAST(0 AS BIGINT) AS bin FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS n FROM embeddings WHERE vec_id % {EVERY} = 0))),
    coded AS (SELECT query_id, vector, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS bin
        FROM (SELECT *, list_sum(list_transform(range(64), lambda i: CASE WHEN vector[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS s FROM asked)),
    near AS (SELECT * FROM (SELECT a.query_id, a.vector, b.vec_id, row_number() OVER (PARTITION BY a.query_id ORDER BY bit_count(xor(a.bin, b.bin)), b.vec_id) AS n
        FROM coded a CROSS JOIN p JOIN bits b ON list_has_any(b.grants, perms) AND NOT list_has_any(b.denies, perms)) WHERE n <= 2560),
    hits AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n
        FROM (SELECT a.query_id, c.vec_id AS chunk_id, {DECODED} AS score FROM near a JOIN codes c ON c.vec_id = a.vec_id)) WHERE n <= 40),
    r AS (SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, c.chunk_id) AS rank, count(*) OVER (PARTITION BY h.query_id) AS candidates, c.chunk_id, c.document_id, md5(c.text) AS text_md5, round(h.score, 6) AS score, connector, uri, title, version, span_start, span_end
        FROM chunks c JOIN hits h ON c.chunk_id = h.chunk_id JOIN stored s ON s.document_id = c.document_id CROSS JOIN p WHERE list_has_any(c.grants, perms) AND NOT list_has_any(c.denies, perms))
    SELECT * REPLACE (CAST(rank AS INTEGER) AS rank, CAST(query_id AS VARCHAR) AS query_id) FROM r WHERE rank <= 10""")
def retrieve_cited(spark, sf_dir):
    """The whole path for each query of the set: the stored index of the texts' chunks is searched for the 40 best that
    the reader may see, their texts are fetched behind the policy, checked again, and the best 10 cited."""
    index, chunks, docs = stored_chunks(spark, sf_dir)
    asked = asked_vectors(entries(spark, sf_dir)).select(F.col("query_id").cast("string").alias("query_id"), F.lit("").alias("query"), policy.ids(READER).alias("permissions"), "vector")
    best = answer(index, chunks, docs, asked, 10, candidate_k=40)
    return best.withColumns({"text_md5": F.md5(F.col("text").cast("binary")), "score": F.round("score", 6)}).drop("text")


def stored_chunks(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame, DataFrame]:
    """The index of the documents' first chunks, each with the embedding of the same number, and the tables of chunks and documents: published once in an application."""
    at = (spark.sparkContext.applicationId, f"{sf_dir}#chunks")
    if at not in _STORED:
        tables = Tables(spark, f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}")
        chunk = F.concat(F.lit("doc:"), F.lpad(F.col("vec_id").cast("string"), 9, "0"), F.lit("#0")).alias("chunk_id")
        of_chunk = table(spark, sf_dir, "embeddings").select(chunk, F.col("embedding").alias("vector"))
        docs = tables.stage("documents", stored(spark, sf_dir))
        first = docs.select(ing.chunk_id("document_id", F.lit(0)).alias("chunk_id"), "document_id", "grants", "denies")
        made = ix.VectorIndex.build(tables.stage("entries", of_chunk.join(first, "chunk_id").select("chunk_id", "document_id", "vector", "grants", "denies")))
        tables.publish({"index": made.codes, "policies": made.policies, "quant": made.quant, "documents": docs, "chunks": windows(spark, sf_dir)})
        now = tables.read()
        _STORED[at] = ix.VectorIndex(now["index"], now["policies"], now["quant"]).validate(), now["chunks"], now["documents"]
    return _STORED[at]


@query(f"""WITH {DOCUMENTS}, p AS (SELECT {_list(READER)} AS perms) SELECT doc_id, CAST(length(text) % 997 AS INTEGER) AS score FROM docs, p WHERE {ADMITS} ORDER BY score DESC, doc_id LIMIT 10""")
def rerank_order(spark, sf_dir):
    """The order of a reranker (its score here: the text's length modulo 997), best 10 of what is admitted."""
    mine = documents(spark, sf_dir).where(policy.admits("grants", "denies", READER))
    return mine.select("doc_id", (F.length("text") % 997).cast("int").alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash("text").alias("content_hash"))


@query(f"WITH {STORED} SELECT document_id, fingerprint FROM stored")
def fingerprint(spark, sf_dir):
    return stored(spark, sf_dir).select("document_id", "fingerprint")


@query(f"WITH {STORED} SELECT document_id, content_hash FROM stored WHERE length(text) % 7 < 2")
def ingest_changed_only(spark, sf_dir):
    """Documents that changed since a stored state, in which every text with length % 7 < 2 was another."""
    now = stored(spark, sf_dir)
    before = store.with_fingerprints(now.withColumn("text", F.when(F.length("text") % 7 < 2, F.concat("text", F.lit("."))).otherwise(F.col("text"))))
    return store.changed_only(now, before).select("document_id", "content_hash")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("_order", F.struct("ts", "event_id"))
    return store.last_version(e, ["user_id"], "_order").select("user_id", "event_id", "event_type", "value")


@query(f"WITH {WINDOWS} SELECT document_id, count(*) AS chunks FROM chunks WHERE document_id NOT IN (SELECT document_id FROM stored WHERE connector = 'src0') GROUP BY document_id")
def prefix_delete(spark, sf_dir):
    """Chunks left after the documents of one source are deleted."""
    gone = stored(spark, sf_dir).where("connector = 'src0'")
    return store.delete_documents(windows(spark, sf_dir), gone).groupBy("document_id").agg(F.count("*").alias("chunks"))


WORDS = "words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)"


def _grams(spark, sf_dir, kind) -> DataFrame:
    return text.counted(table(spark, sf_dir, "documents"), "doc_id", kind)


@query(f"WITH {WORDS} SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest(w) AS feature FROM words) GROUP BY 1, 2")
def ngrams_words(spark, sf_dir):
    return _grams(spark, sf_dir, "words")


@query(f"WITH {WORDS} SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM words) GROUP BY 1, 2")
def ngrams_bigrams(spark, sf_dir):
    return _grams(spark, sf_dir, "pairs")


@query(f"""WITH {WORDS}, t AS (SELECT doc_id, ' ' || unnest(w) || ' ' AS p FROM words)
    SELECT doc_id, feature, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(p) - 1), lambda i: '#' || substr(p, i, 3))) AS feature FROM t) GROUP BY 1, 2""")
def ngrams_trigrams(spark, sf_dir):
    return _grams(spark, sf_dir, "trigrams")


#: CRC-32 of ASCII strings (fixed value: the reversed polynomial), of each distinct feature once.
HASHED = f"""{WORDS}, f AS (
        SELECT doc_id, unnest(w) AS feature FROM words
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, length(p) - 1), lambda i: '#' || substr(p, i, 3))) FROM (SELECT doc_id, ' ' || unnest(w) || ' ' AS p FROM words)),
    crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    h AS (SELECT feature, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(feature, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
        FROM (SELECT DISTINCT feature FROM f), crc),
    hashed AS (SELECT doc_id, CAST(h % 256 AS BIGINT) AS bucket, CAST(sum(CASE WHEN (h >> 31) & 1 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM f JOIN h USING (feature) GROUP BY 1, 2)"""


@query(f"WITH {HASHED} SELECT doc_id, bucket, value FROM hashed")
def feature_hash(spark, sf_dir):
    return text.hashed_features(table(spark, sf_dir, "documents"), "doc_id", 256)


@query(f"""WITH {HASHED}, n AS (SELECT doc_id, sqrt(sum(value * value)) AS n FROM hashed GROUP BY 1)
    SELECT doc_id, bucket, round(CAST(CAST(value / n AS FLOAT) AS DOUBLE), 6) AS value FROM hashed JOIN n USING (doc_id) WHERE value <> 0""")
def local_embedding(spark, sf_dir):
    """The dimensions other than 0 of every text's vector."""
    made = text.local_embeddings(table(spark, sf_dir, "documents"), "doc_id", 256)
    flat = made.select("doc_id", F.posexplode("vector").alias("bucket", "value")).where("value <> 0")
    return flat.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("value").cast("double"), 6).alias("value"))


#: White space as Python has it (fixed values), and the cut of a chunk that starts at s and may reach to e, w characters long.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LAST = "CASE WHEN instr(reverse(w), reverse({m})) > 0 AND length(w) - instr(reverse(w), reverse({m})) - 1 >= q THEN length(w) - instr(reverse(w), reverse({m})) + 1 END"
_MARKS = [f"'{m[0]}' || {'chr(10)' if m[1] == chr(10) else repr(m[1])}" for m in text.SENTENCE_ENDS]
CHUNKED = f"""cut AS (SELECT doc_id, t, n, ordinal, s, CASE WHEN e = n THEN n ELSE s + coalesce({_LAST.format(m='(chr(10) || chr(10))')}, greatest({', '.join(_LAST.format(m=f'({m})') for m in _MARKS)}),
        CASE WHEN regexp_matches(w, '{SPACE}') AND length(w) - 1 - length(regexp_extract(reverse(w), '^([^{SPACE[1:]}*){SPACE}', 1)) > q
            THEN length(w) - length(regexp_extract(reverse(w), '^([^{SPACE[1:]}*){SPACE}', 1)) END, length(w)) END AS e
    FROM (SELECT *, greatest(1, (e - s) // 4) AS q, substr(t, s + 1, e - s) AS w FROM (SELECT *, least(n, s + 1200) AS e FROM @rows)))"""


@query(f"""WITH RECURSIVE first AS (SELECT doc_id, text AS t, length(text) AS n, 0 AS ordinal, CAST(0 AS BIGINT) AS s FROM documents WHERE regexp_matches(text, '[^{SPACE[1:]}')),
    chunks AS (
        (WITH {CHUNKED.replace('@rows', 'first')} SELECT * FROM cut)
        UNION ALL
        (WITH {CHUNKED.replace('@rows', '(SELECT doc_id, t, n, ordinal + 1 AS ordinal, greatest(s + 1, e - 150) AS s FROM chunks WHERE e < n)')} SELECT * FROM cut))
    SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end, md5(substr(t, s + 1, e - s)) AS chunk_md5
    FROM chunks WHERE regexp_matches(substr(t, s + 1, e - s), '[^{SPACE[1:]}')""")
def split_text(spark, sf_dir):
    cut = text.split_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "ordinal", "span_start", "span_end", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
    '(?i)\bbearer\s+[A-Za-z0-9\-._~+/]+=*', 'Bearer [REDACTED]', 'g'), '\bya29\.[A-Za-z0-9\-._]+', '[REDACTED]', 'g'), '\bsk-[A-Za-z0-9_\-]{16,}', '[REDACTED]', 'g'), '\bAKIA[0-9A-Z]{16,}', '[REDACTED]', 'g'),
    '(?i)\b(token|secret|password|passwd|api[_-]?key|authorization)(\s*[=:]\s*)\S+', '\1\2[REDACTED]', 'g')) AS redacted_md5 FROM documents""")
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.coalesce("text", F.lit(""))).cast("binary")).alias("redacted_md5"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(h, ','), lambda x: trim(x)), lambda x: x <> ''))), ',') AS groups,
    len(list_filter(list_transform(string_split(h, ','), lambda x: trim(x)), lambda x: x <> '' AND (x = 'everyone' OR regexp_matches(x, '\\s')))) = 0 AS valid
    FROM (SELECT c_custkey, ' nation:' || CAST(c_nationkey AS VARCHAR) || ' ,, ' || CASE WHEN c_custkey % 11 = 0 THEN 'everyone' WHEN c_custkey % 7 = 0 THEN c_name || ' x' ELSE lower(c_mktsegment) END || ',nation:' || CAST(c_nationkey AS VARCHAR) AS h FROM customer)""".replace("\\\\", "\\"))
def header_group_lists(spark, sf_dir):
    segment = F.when(F.col("c_custkey") % 11 == 0, F.lit("everyone")).when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit(" x"))).otherwise(F.lower("c_mktsegment"))
    header = F.concat(F.lit(" nation:"), "c_nationkey", F.lit(" ,, "), segment, F.lit(",nation:"), "c_nationkey")
    rows = table(spark, sf_dir, "customer").withColumn("g", header_groups(header))
    return rows.select("c_custkey", F.array_join("g.groups", ",").alias("groups"), "g.valid")


@query(r"SELECT p_partkey, p_type AS id, length(p_type) BETWEEN 1 AND 256 AND NOT regexp_matches(p_type, '[\s\x00-\x1f]') AND p_type <> 'everyone' AS valid FROM part")
def id_validation(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("id"), policy.valid_id("p_type").alias("valid"))


@query(f"""WITH {ENTRIES} SELECT (SELECT count(*) FROM entries) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT grants, denies FROM entries)) AS policies,
    (SELECT count(DISTINCT p) FROM (SELECT unnest(list_concat(grants, denies)) AS p FROM entries)) AS principals""")
def index_stats(spark, sf_dir):
    return stored_index(spark, sf_dir).stats().select("chunks", "policies", "principals")


@query()
def index_bytes(spark, sf_dir):
    """The bytes of the stored index's files, in all and for each chunk."""
    return stored_index(spark, sf_dir).stats().select("bytes_on_disk", "bytes_per_chunk")


@query(f"WITH {STORED}, p AS (SELECT {_list(READER)} AS perms) SELECT document_id FROM stored, p WHERE {ADMITS} AND regexp_matches(text, '\\S')")
def ingest_two_versions(spark, sf_dir):
    """Documents that a reader finds in the index, after those without any grant were ingested first (one policy), and then all."""
    docs = stored(spark, sf_dir).select(RAW.names)
    tables = Tables(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}")
    for some in (docs.where("size(grants) = 0 AND size(denies) = 0"), docs):
        ing.ingest(tables, some, ing.local_embedder(DIMENSION))
    now = tables.read()
    index = ix.VectorIndex(now["index"], now["policies"], now["quant"]).validate(now["chunks"].count())
    return index.permitted(READER).select("document_id").distinct()


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
    round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    out = metrics.latency_summary(table(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99", "mean")})


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, true AS p50_within, true AS p95_within, true AS p99_within FROM events GROUP BY event_type")
def latency_sketch_errors(spark, sf_dir):
    """Percentiles of sketches of each day, merged: whether the exact rank of each is within the stated error."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value").where("value IS NOT NULL")
    told = metrics.sketched_summary(metrics.latency_sketches(events, "value", "event_type", "day"), "event_type")
    both = events.join(told, "event_type").groupBy("event_type", "n")
    # A value that is repeated has all the ranks from those below it to those up to it.
    below, upto = (lambda p: F.count_if(F.col("value") < F.col(p)) / F.count("*")), (lambda p: F.count_if(F.col("value") <= F.col(p)) / F.count("*"))
    within = lambda p: (below(p) <= int(p[1:]) / 100 + metrics.RANK_ERROR) & (upto(p) >= int(p[1:]) / 100 - metrics.RANK_ERROR)
    return both.agg(*[within(p).alias(f"{p}_within") for p in ("p50", "p95", "p99")])


@query("""WITH RECURSIVE m AS (SELECT user_id, event_id, ts, event_type, count(*) FILTER (WHERE event_type IN ('signup', 'error')) OVER w AS true_version, count(*) FILTER (WHERE event_type = 'error') OVER w AS epoch
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS i FROM m WHERE event_type NOT IN ('signup', 'error')),
    r AS (SELECT user_id, epoch, i, event_id, ts AS fetched, true_version AS cached_version, true_version, 'miss' AS outcome FROM a WHERE i = 1
        UNION ALL SELECT a.user_id, a.epoch, a.i, a.event_id, CASE WHEN a.ts - r.fetched < INTERVAL 3600 SECOND THEN r.fetched ELSE a.ts END, CASE WHEN a.ts - r.fetched < INTERVAL 3600 SECOND THEN r.cached_version ELSE a.true_version END, a.true_version,
            CASE WHEN a.ts - r.fetched < INTERVAL 3600 SECOND THEN 'hit' ELSE 'miss' END FROM r JOIN a ON a.user_id = r.user_id AND a.epoch = r.epoch AND a.i = r.i + 1)
    SELECT user_id, event_id, outcome, cached_version, true_version FROM r""")
def acl_cache_replay(spark, sf_dir):
    return replay_log(table(spark, sf_dir, "events"), 3600)


@query(f"WITH {STORED}, p AS (SELECT {_list(CALLERS['c2'])} AS perms) SELECT document_id, title, uri, connector, array_to_string(grants, ',') AS grants, array_to_string(denies, ',') AS denies, {ADMITS} AS visible, {REASON} AS reason FROM (SELECT * FROM stored ORDER BY document_id LIMIT 500), p")
def simulate_catalog(spark, sf_dir):
    """What a caller sees of the catalogue, and why."""
    return flat(simulate.simulate(stored(spark, sf_dir), CALLERS["c2"], 500))


@query(f"WITH {WINDOWS} SELECT (SELECT count(*) FROM stored) AS documents, count(*) AS chunks FROM chunks")
def table_counts(spark, sf_dir):
    return store.counts(stored(spark, sf_dir), windows(spark, sf_dir))


@query(f"""WITH {STORED} SELECT document_id, fingerprint FROM stored WHERE connector <> 'src1' OR length(text) % 2 = 0
    UNION ALL SELECT document_id || '+', fingerprint FROM stored WHERE connector = 'src1'""")
def replace_versions(spark, sf_dir):
    """A stored state with some documents replaced: anti-join and union."""
    now = stored(spark, sf_dir).select("document_id", "connector", "text", "fingerprint")
    odd = now.where("connector = 'src1' AND length(text) % 2 = 1")
    more = now.where("connector = 'src1'").withColumn("document_id", F.concat("document_id", F.lit("+")))
    return store.replace_documents(now, more, documents=odd).select("document_id", "fingerprint")
