"""Registered queries: one per operator, with the SQL that says what each returns."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.patterns import CATALOGUE, SECRETS, Pattern, all_packs, as_literal, catalogue_frame, load_packs, pattern, pii_types
from maskwright.functions.tokens import client_hash
from maskwright.functions.validators import CHECKS, duck
from maskwright.operators import confidence as C
from maskwright.operators import metrics as M
from maskwright.operators import routing as R
from maskwright.operators.anonymize import anonymize, delete_session, matches, raw_matches, spans, token_counts, token_map
from maskwright.operators.deanonymize import deanonymize, single_pass
from maskwright.operators.json_body import anonymize_bodies, found_in_bodies
from maskwright.operators.s3fifo import replay
from maskwright.plans import fixtures as X
from maskwright.plans.oracle import INPUT, chain_sql, detect_sql
from maskwright.sources.tables import VerdictTable, compressed, decompress, event_lines, materialize, shared_dir, spread, table
from maskwright.streaming.restore import choose_path, restore_batch, restore_streaming, with_tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ALL = ["GLOBAL", "US", "DE", "FR", "NL", "FINANCE_EU", "HEALTHCARE"]
DEFAULT = ["SECRETS", "GLOBAL", "DE"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and the fixture texts; spread out where the input is one small file, as patterns are CPU work."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs).unionByName(X.texts_frame(spark).coalesce(1))


def chain(spark: SparkSession, sf_dir: str, packs: list[str]) -> DataFrame:
    return anonymize(texts(spark, sf_dir), "text", packs)


# ---- detection ------------------------------------------------------------------------------------------------------


def _detect(p: Pattern) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = texts(spark, sf_dir).select("doc_id", raw_matches("text", p).alias("r"), matches("text", p).alias("f")).where(F.size("r") > 0)
        return found.select("doc_id", F.size("r").cast("long").alias("n_matches"), F.size("f").cast("long").alias("n_hits"), F.get("f", F.lit(0)).alias("first_hit"))

    return run


for _p in CATALOGUE:
    query(f"detect_{_p.name}", detect_sql(_p))(_detect(_p))

# ---- validators -----------------------------------------------------------------------------------------------------

#: validator -> (digits of a generated value, its shape with {d}); values come from the orders' keys.
_SHAPES = {
    "card_luhn": (16, "{0}"), "email_local_part": (6, "{0}"), "ssn": (9, "{0}"), "us_phone": (10, "{0}"), "steuer_id": (11, "{0}"), "nir": (15, "{0}"),
    "luhn": (12, "{0}"), "siret": (14, "{0}"), "siren": (9, "{0}"), "bsn": (9, "{0}"), "iban": (20, "DE{0}"),
}
_CASES = {
    "email_local_part": ("alice@x.com", ".a@x.com", "a.@x.com", "a..b@x.com", "@x.com"), "us_phone": ("(212) 555-0100", "555.867.5309", "+15558675309", "555\t867\t5309"),
    "ssn": ("123-45-6789", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-6789", "123-45-0000"), "nir": ("1 90 03 2A 014 012 75", "2 87 11 2B 033 001 59", "185127510804279", "1 85 12 75 108 042 78"),
    "iban": ("GB29NWBK60161331926819", "DE89 3704 0044 0532 0130 00", "DE00370400440532013000", "NL91ABNA0417164300"), "steuer_id": ("65929970489", "65929970488", "05929970489"),
    "card_luhn": ("4111 1111 1111 1111", "411111"), "siret": ("362 521 874 00036", "36252187400037"), "siren": ("443 061 841", "362521879"), "bsn": ("111222333", "000000000"), "luhn": ("79927398713", "1"),
}


def _validate(name: str) -> None:
    n, shape = _SHAPES[name]
    head, low = shape.split("{0}")[0], min(n, 9)
    parts = [f"lpad(CAST((o_orderkey * 104729 + 77) % {10**low} AS VARCHAR), {low}, '0')"]
    if n > low:
        parts.append(f"lpad(CAST((o_orderkey * 7919 + o_custkey * 31 + 5) % {10 ** min(9, n - low)} AS VARCHAR), {min(9, n - low)}, '0')")
    if n > 18:
        parts.append(f"lpad(CAST((o_custkey * 97 + 3) % {10 ** (n - 18)} AS VARCHAR), {n - 18}, '0')")
    made = " || ".join([f"'{head}'", *parts])
    sql = f"SELECT value, {duck(name, 'value')} AS ok FROM (SELECT {made} AS value FROM orders UNION ALL {X.values_sql(_CASES[name], 'value')})"

    @query(f"validate_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = table(spark, sf_dir, "orders").select(F.expr(made.replace("VARCHAR", "STRING")).alias("value"))
        values = values.unionByName(spark.createDataFrame([(v,) for v in _CASES[name]], "value string"))
        return values.select("value", F.expr(CHECKS[name]("value")).alias("ok"))


for _name in CHECKS:
    _validate(_name)

# ---- anonymisation and reversal -------------------------------------------------------------------------------------


def _anonymize(name: str, packs: list[str]) -> None:
    sql = chain_sql(packs) + "SELECT doc_id, t AS anonymized, len(f) AS n_found FROM chain"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chain(spark, sf_dir, packs).select("doc_id", "anonymized", F.size("found").cast("long").alias("n_found"))


_anonymize("anonymize_global", ["GLOBAL"])
_anonymize("anonymize_global_us", ["GLOBAL", "US"])
_anonymize("anonymize_all_packs", ALL)
_anonymize("anonymize_reordered_packs", ["FINANCE_EU", "NL", "FR", "DE", "US", "GLOBAL"])


@query("anonymize_secrets", chain_sql(DEFAULT, patterns=(*CATALOGUE, *SECRETS)) + "SELECT doc_id, t AS anonymized, len(f) AS n_found FROM chain")
def anonymize_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = anonymize(texts(spark, sf_dir), "text", DEFAULT, patterns=(*CATALOGUE, *SECRETS))
    return done.select("doc_id", "anonymized", F.size("found").cast("long").alias("n_found"))


@query("pii_spans", chain_sql(ALL) + "SELECT doc_id, place, s.ordinal AS ordinal, s.pii_type AS pii_type, s.original AS original, s.token AS token FROM spans")
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(chain(spark, sf_dir, ALL), "doc_id").select("doc_id", F.col("place").cast("long").alias("place"), "ordinal", "pii_type", "original", "token")


@query("token_map", chain_sql(ALL) + "SELECT doc_id, s.token AS token, min(s.original) AS original, max(s.ordinal) AS ordinal FROM spans GROUP BY 1, 2")
def token_map_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_map(chain(spark, sf_dir, ALL), "doc_id")


@query("token_counts", chain_sql(ALL) + "SELECT doc_id, len(f) AS n_occurrences, len(list_distinct(list_transform(f, lambda x: x.token))) AS n_tokens FROM chain")
def token_counts_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(chain(spark, sf_dir, ALL), "doc_id")


@query("deanonymize_roundtrip", chain_sql(ALL) + "SELECT count(*) AS n, count(*) FILTER (WHERE t <> text) AS n_changed, count(*) AS n_restored FROM chain")
def deanonymize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = materialize(chain(spark, sf_dir, ALL), "chain")  # read twice: the texts and the map
    back = deanonymize(done.select("doc_id", "text", "anonymized"), "anonymized", token_map(done, "doc_id"), "doc_id")
    changed, same = F.col("anonymized") != F.col("text"), F.col("restored").eqNullSafe(F.col("text"))
    return back.agg(F.count("*").alias("n"), F.count_if(changed).alias("n_changed"), F.count_if(same).alias("n_restored"))


@query("deanonymize_single_pass", chain_sql(["GLOBAL"]) + "SELECT doc_id, text AS restored FROM chain WHERE len(f) > 0")
def deanonymize_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chain(spark, sf_dir, ["GLOBAL"]).where(F.size("found") > 0)
    pairs = F.array_distinct(F.transform("found", lambda f: F.struct(f.token, f.original)))
    return done.select("doc_id", single_pass(F.col("anonymized"), F.map_from_entries(pairs)).alias("restored"))


@query("session_delete", chain_sql(["GLOBAL"]) + "SELECT doc_id, s.token AS token, min(s.original) AS original, max(s.ordinal) AS ordinal FROM spans WHERE doc_id % 2 <> 0 GROUP BY 1, 2")
def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of all sessions of even number are deleted."""
    tokens = token_map(chain(spark, sf_dir, ["GLOBAL"]), "doc_id")
    return delete_session(tokens, "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))


@query("literal_pattern", "SELECT doc_id, len(regexp_extract_all(text, 'the[.]|the,')) AS n FROM documents WHERE contains(text, 'the.') OR contains(text, 'the,')")
def literal_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal patterns match their own text only: the full stop is no wild card."""
    docs = table(spark, sf_dir, "documents")
    a, b = (matches("text", as_literal(pattern("kvk"), x)) for x in ("the.", "the,"))
    return docs.select("doc_id", (F.size(a) + F.size(b)).cast("long").alias("n")).where("n > 0")


# ---- confidence and verdicts ----------------------------------------------------------------------------------------

_CATALOGUE = [(s.ordinal, s.pattern.pack, s.pattern.name, s.pattern.pii_type, s.pattern.confidence, s.position) for s in load_packs(ALL)[0]]


@query(
    "pack_catalogue_decay",
    "SELECT ordinal, pack, name, pii_type, base_confidence, pack_pos, round(greatest(0, base_confidence * (1 - pack_pos * CAST(0.05 AS DOUBLE))), 9) AS effective_confidence FROM ("
    + X.values_sql(_CATALOGUE, "ordinal, pack, name, pii_type, b, pack_pos").replace("SELECT *", "SELECT *, CAST(b AS DOUBLE) AS base_confidence") + ")",
)
def pack_catalogue_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue_frame(spark, ALL)
    return rows.select("ordinal", "pack", "name", "pii_type", "base_confidence", "pack_pos", F.round(C.effective_confidence(F.col("base_confidence"), F.col("pack_pos")), 9).alias("effective_confidence"))


_VERDICTS = "verdicts AS (SELECT DISTINCT s.original AS original, '[PII_NAME_' || substr(md5(s.original), 1, 16) || ']' AS token FROM spans WHERE substr(md5(s.original), 1, 1) < '8')\n"


def _verdicts(found: DataFrame) -> DataFrame:
    from maskwright.functions.tokens import token

    return found.where(F.substring(F.md5("original"), 1, 1) < "8").select("original", token("NAME", F.col("original")).alias("token")).distinct()


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(chain(spark, sf_dir, ALL), "doc_id")


@query("confidence_routing", chain_sql(ALL) + "SELECT s.pii_type AS pii_type, s.confidence < 0.7 AS needs_verdict, count(*) AS n FROM spans GROUP BY 1, 2")
def confidence_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.route(_spans(spark, sf_dir)).groupBy("pii_type", "needs_verdict").agg(F.count("*").alias("n"))


@query(
    "verdict_lookup",
    chain_sql(ALL).rstrip() + ",\n" + _VERDICTS
    + "SELECT doc_id, place, CASE WHEN s.confidence < 0.7 THEN coalesce(v.token, s.token) ELSE s.token END AS token, CASE WHEN s.confidence >= 0.7 THEN NULL WHEN v.token IS NULL THEN 'miss' ELSE 'hit' END AS cache"
    " FROM spans LEFT JOIN verdicts v ON s.original = v.original",
)
def verdict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_spans(spark, sf_dir), "spans")
    return C.resolve(found, _verdicts(found)).select("doc_id", F.col("place").cast("long").alias("place"), "token", "cache")


@query(
    "verification_worklist",
    chain_sql(ALL).rstrip() + ",\n" + _VERDICTS + "SELECT s.original AS original, count(*) AS n FROM spans WHERE s.confidence < 0.7 AND s.original NOT IN (SELECT original FROM verdicts) GROUP BY 1",
)
def verification_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_spans(spark, sf_dir), "spans")
    return C.work_list(found, _verdicts(found))


_ANSWERS = (
    'Here: [{"original": "Jane Roe", "type": "name", "confidence": 0.9}, {"original": "x", "type": "NAME", "confidence": 0.5}] done', "nothing", '[{"original": "", "type": "NAME", "confidence": 1.0}]',
    '[{"original": "ACME", "type": "COMPANY", "confidence": 0.7}]', "[]",
)


#: A model's answer for each order, as SQL of both dialects: one detection, or no array at all.
_ANSWER = """CASE WHEN o_orderkey % 7 = 0 THEN 'nothing found' ELSE concat('Here: [{"original": "Clerk ', o_custkey % 50, '", "type": "', CASE WHEN o_custkey % 2 = 0 THEN 'name' ELSE 'COMPANY' END, '", "confidence": 0.', o_orderkey % 10, '}] done') END"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select(F.expr(_ANSWER).alias("response"))
    return made.unionByName(spark.createDataFrame([(a,) for a in _ANSWERS], "response string"))


@query(
    "verdicts_parsed",
    "SELECT original, '[PII_' || kind || '_' || substr(md5(original), 1, 16) || ']' AS token FROM (" + X.values_sql([("Jane Roe", "NAME"), ("ACME", "COMPANY")], "original, kind")
    + " UNION SELECT concat('Clerk ', o_custkey % 50), CASE WHEN o_custkey % 2 = 0 THEN 'NAME' ELSE 'COMPANY' END FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 10 >= 7)",
)
def verdicts_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.verdicts_of(_answers(spark, sf_dir))


_HALF = _VERDICTS.replace("< '8'", "BETWEEN '4' AND '7'")


@query(
    "verdict_table",
    chain_sql(["GLOBAL", "US"]).rstrip() + ",\n" + _HALF
    + "SELECT doc_id, place, CASE WHEN s.confidence < 0.7 THEN coalesce(v.token, s.token) ELSE s.token END AS token FROM spans LEFT JOIN verdicts v ON s.original = v.original",
)
def verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of verdicts from first write to lookup: written, partly deleted, folded, read and joined."""
    found = materialize(spans(chain(spark, sf_dir, ["GLOBAL", "US"]), "doc_id"), "spans")
    store = VerdictTable(spark, f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}")
    store.put(_verdicts(found))
    store.delete(found.where(F.substring(F.md5("original"), 1, 1) < "4").select("original").distinct())
    store.compact()
    return C.resolve(found, store.read()).select("doc_id", F.col("place").cast("long").alias("place"), "token")


_MODEL = "concat(CASE event_id % 5 WHEN 0 THEN 'claude-sonnet' WHEN 1 THEN 'claude-3-opus' WHEN 2 THEN 'gpt-4o' WHEN 3 THEN 'mistral' ELSE 'claud' END, '-', user_id % 20)"
_RULES = (("claude", "keep tokens"), ("claude-3", "keep all tokens"), ("gpt", "copy tokens"), ("default", "tokens stay"))


@query("model_instruction", f"WITH m AS (SELECT DISTINCT {_MODEL} AS model FROM events UNION SELECT ''), r AS ({X.values_sql(_RULES, 'key, instruction')}) SELECT model, coalesce((SELECT instruction FROM r WHERE key <> 'default' AND starts_with(model, key) ORDER BY length(key) DESC LIMIT 1), (SELECT instruction FROM r WHERE key = 'default')) AS instruction FROM m")
def model_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "events").select(F.expr(_MODEL).alias("model")).union(spark.createDataFrame([("",)], "model string")).distinct()
    return C.instruction_for(models, spark.createDataFrame(list(_RULES), "key string, instruction string"), "").select("model", "instruction")


@query("default_packs", X.values_sql(list(enumerate(("DE", "FINANCE_EU", "FR", "GLOBAL", "HEALTHCARE", "NL", "US"))), "place, pack"))
def default_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(all_packs())), "place int, pack string")


# ---- routing --------------------------------------------------------------------------------------------------------

_HOSTS_SQL = f"SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages UNION ALL {X.values_sql(X.HOSTS, 'host')}"
_NORMAL = "(CASE WHEN length(host) > 1 AND right(host, 1) = '.' THEN left(lower(host), length(host) - 1) ELSE lower(host) END)"
_GLOBS = [d for d in R.AI_DOMAINS if "*" in d]


def _duck_glob(glob: str, host: str) -> str:
    return f"regexp_full_match({host}, {X.sql_text('[.]'.join('[^.]+'.join(x.split('*')) for x in glob.split('.')))})"


_AI_SQL = f"({_NORMAL} IN ({', '.join(X.sql_text(d) for d in R.AI_DOMAINS if '*' not in d)}) OR " + " OR ".join(_duck_glob(g, _NORMAL) for g in _GLOBS) + ")"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    return found.unionByName(spark.createDataFrame([(h,) for h in X.HOSTS], "host string"))


@query("host_normalize", f"SELECT host, {_NORMAL} AS normalized FROM ({_HOSTS_SQL})")
def host_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(spark, sf_dir).select("host", R.normalize_host(F.col("host")).alias("normalized"))


@query("glob_match", X.values_sql(X.GLOBS, "pat, host, hit") + "".join(f" UNION ALL SELECT {X.sql_text(g)}, host, {_duck_glob(g, _NORMAL)} FROM ({_HOSTS_SQL})" for g in _GLOBS))
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([g[:2] for g in X.GLOBS], "pat string, host string")
    rows = rows.unionByName(hosts(spark, sf_dir).select(F.explode(F.array(*map(F.lit, _GLOBS))).alias("pat"), "host"))
    return rows.select("pat", "host", R.glob_match(F.col("pat"), F.col("host")).alias("hit"))


@query("ai_domain_semi_join", f"SELECT host, count(*) AS n FROM ({_HOSTS_SQL}) WHERE {_AI_SQL} GROUP BY 1")
def ai_domain_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ai_hosts(hosts(spark, sf_dir)).groupBy("host").agg(F.count("*").alias("n"))


@query(
    "provider_lookup",
    f"SELECT host, CASE {' '.join(f'WHEN {_NORMAL} = {X.sql_text(d)} THEN {X.sql_text(p)}' for d, p in R.PROVIDERS.items())} {' '.join(f'WHEN {_duck_glob(g, _NORMAL)} THEN {X.sql_text(p)}' for g, p in R.GLOB_PROVIDERS)} ELSE 'passthrough' END AS provider FROM ({_HOSTS_SQL})",
)
def provider_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(spark, sf_dir).select("host", R.provider(F.col("host")).alias("provider"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_AUTH_HOST = "(host IN (" + ", ".join(map(X.sql_text, R.AUTH_DOMAINS)) + ") OR " + " OR ".join(f"starts_with(host, '{p}')" for p in R.AUTH_PREFIXES) + ")"
_AUTH_PATH = "(" + " OR ".join(f"p = '{a}' OR starts_with(p, '{a}/')" for a in R.AUTH_PATHS) + ")"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    rows = R.with_clean_path(pages.unionByName(spark.createDataFrame([c[:2] for c in X.AUTH_CASES], "host string, path string")))
    return rows.withColumn("is_auth", R.is_auth_request(F.col("host"), F.col("clean_path")))


_REQUESTS_SQL = (
    f"SELECT host, path, {_AUTH_HOST} OR {_AUTH_PATH} AS is_auth FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, {_PATH} AS path, '/' || trim({_PATH}, '/') AS p FROM pages)"
    f" UNION ALL {X.values_sql(X.AUTH_CASES, 'host, path, is_auth')}"
)


@query("auth_request", _REQUESTS_SQL)
def auth_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("host", "path", "is_auth")


@query("request_class", f"SELECT CASE WHEN is_auth THEN 'auth' WHEN {_AI_SQL} THEN 'ai' ELSE 'passthrough' END AS class, count(*) AS n FROM ({_REQUESTS_SQL}) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM ({_REQUESTS_SQL})")
def request_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.is_ai_host(_requests(spark, sf_dir))
    return M.request_counts(rows.select(R.request_class(F.col("is_auth"), F.col("is_ai")).alias("class")))


_IP = "concat_ws('.', (event_id * 7 + 3) % 256, (event_id * 13) % 256, user_id % 256, event_id % 256)"
_NUM = "((event_id * 7 + 3) % 256 * 16777216 + (event_id * 13) % 256 * 65536 + user_id % 256 * 256 + event_id % 256)"


@query(
    "private_ip",
    f"SELECT {_IP} AS host, ({_NUM} BETWEEN 167772160 AND 184549375 OR {_NUM} BETWEEN 2886729728 AND 2887778303 OR {_NUM} BETWEEN 3232235520 AND 3232301055 OR {_NUM} BETWEEN 2130706432 AND 2147483647 OR {_NUM} BETWEEN 2851995648 AND 2852061183) AS is_private"
    f" FROM events UNION ALL {X.values_sql(X.ADDRESSES, 'host, is_private')}",
)
def private_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.expr(_IP).alias("host"))
    return R.with_private(rows.unionByName(spark.createDataFrame([a[:1] for a in X.ADDRESSES], "host string")))


@query("client_hash", f"SELECT {_IP} AS address, substr(sha256({_IP}), 1, 8) AS client, count(*) AS n FROM events GROUP BY 1, 2")
def client_hash_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.expr(_IP).alias("address"))
    return rows.groupBy("address").agg(F.count("*").alias("n")).select("address", client_hash(F.col("address")).alias("client"), "n")


_LABEL = "regexp_full_match(x, '[*]|[A-Za-z0-9-]*[*][A-Za-z0-9-]*|[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?') AND (contains(x, '*') OR length(x) <= 63)"


_VALID = f"length(domain) BETWEEN 1 AND 253 AND len(list_filter(s, lambda x: NOT ({_LABEL}))) = 0 AND (NOT contains(domain, '*') OR (len(s) >= 3 AND s[-1] <> '*' AND NOT (s[1] = '*' AND s[2] = '*')))"
#: The pages' hosts, as they are and bent three ways.
_BENT = ("host", "concat('*.', host)", "concat(host, '-')", "concat('*.*.', host)")
_DOMAINS_SQL = " UNION ALL ".join(f"SELECT DISTINCT {b} AS domain FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)" for b in _BENT)


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).distinct()
    return found.select(F.explode(F.array(*map(F.expr, _BENT))).alias("domain"))


@query("valid_domain", f"SELECT domain, {_VALID} AS valid FROM (SELECT domain, string_split(domain, '.') AS s FROM ({X.values_sql(X.DOMAINS, 'domain')} UNION ALL {_DOMAINS_SQL}))")
def valid_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(d,) for d in X.DOMAINS], "domain string").unionByName(_domains(spark, sf_dir))
    return rows.select("domain", R.valid_domain(F.col("domain")).alias("valid"))


_ADD, _GONE = ("new.example.com", "*.com", "api.openai.com", "*.my.example.com"), ("api.cohere.ai", "*.openai.azure.com", "absent.com")


@query(
    "registry_add_remove",
    "SELECT domain FROM (" + X.values_sql(R.AI_DOMAINS, "domain") + " UNION " + X.values_sql([d for d in _ADD if d != "*.com"], "domain")
    + f" UNION SELECT domain FROM (SELECT domain, string_split(domain, '.') AS s FROM ({_DOMAINS_SQL})) WHERE {_VALID}) EXCEPT " + X.values_sql(_GONE, "domain"),
)
def registry_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "domain string")
    return R.registry_after(frame(R.AI_DOMAINS), frame(_ADD).unionByName(_domains(spark, sf_dir)), frame(_GONE))


_TYPE = "CASE event_id % 5 WHEN 0 THEN 'text/event-stream' WHEN 1 THEN 'application/json' WHEN 2 THEN 'Text/Event-Stream' WHEN 3 THEN concat('text/event-stream; of=', event_type) ELSE event_type END"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_TYPE).alias("content_type"))


@query("streaming_response", f"SELECT event_id, content_type, contains(content_type, 'text/event-stream') AS is_stream FROM (SELECT event_id, {_TYPE} AS content_type FROM events)")
def streaming_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select("event_id", "content_type", R.is_streaming(F.col("content_type")).alias("is_stream"))


@query("body_size_cap", "SELECT doc_id, strlen(text) <= 4096 AS within FROM documents")
def body_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.within_size(F.col("text"), 4096).alias("within"))


@query("response_path", f"SELECT event_id, content_type, CASE WHEN contains(content_type, 'text/event-stream') THEN 'stream' ELSE 'buffered' END AS path FROM (SELECT event_id, {_TYPE} AS content_type FROM events)")
def response_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose_path(_responses(spark, sf_dir))


@query("decompress_bodies", "SELECT doc_id, text, CASE WHEN doc_id % 3 = 2 THEN 'br' END AS encoding FROM documents")
def decompress_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    kind = F.element_at(F.array(F.lit("gzip"), F.lit("deflate"), F.lit("br")), (F.col("doc_id") % 3 + 1).cast("int"))
    packed = docs.select("doc_id", kind.alias("encoding"), "raw").withColumn("body", compressed(F.col("raw"), F.col("encoding")))
    return decompress(packed).select("doc_id", F.decode(F.col("body"), "UTF-8").alias("text"), "encoding")


@query("event_lines", "SELECT conv_id, turn, CAST(unnest(range(0, len(l))) AS BIGINT) AS seq, unnest(l) AS line FROM (SELECT conv_id, turn, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM conversations)")
def event_lines_(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return event_lines(turns, "text", "key").select("key.conv_id", "key.turn", "seq", "line")


# ---- JSON bodies ----------------------------------------------------------------------------------------------------


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("text", F.concat("text", F.lit(" reach me at user"), F.col("conv_id"), F.lit("@example.com")))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    model = F.when(F.col("conv_id") % 2 == 0, "gpt-4o").otherwise("claude-sonnet")
    return chats.select("conv_id", F.to_json(F.struct(model.alias("model"), F.lit(0.5).alias("temperature"), messages.alias("messages"))).alias("body"))


_BODY_SOURCE = "SELECT {'conv_id': conv_id, 'turn': turn, 'role': role} AS doc_id, text || ' reach me at user' || conv_id || '@example.com' AS text FROM conversations WHERE text IS NOT NULL"


def _go_json(value: str) -> str:
    """A JSON string as the bodies are written, with three signs escaped."""
    return f"replace(replace(replace(CAST(to_json({value}) AS VARCHAR), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"


def _body_sql(injected: bool) -> str:
    rule = "CASE WHEN doc_id.conv_id % 2 = 0 THEN 'copy tokens' ELSE 'keep tokens' END"
    said = f"CASE WHEN first_system = doc_id.turn THEN t || chr(10) || chr(10) || {rule} ELSE t END" if injected else "t"
    first = f"max(CASE WHEN first_system IS NULL THEN '{{\"content\":' || {_go_json(rule)} || ',\"role\":\"system\"}},' ELSE '' END)" if injected else "''"
    one = f"'{{\"content\":' || {_go_json(said)} || ',\"role\":' || {_go_json('doc_id.role')} || '}}'"
    return (
        chain_sql(["GLOBAL"], source=_BODY_SOURCE).rstrip()
        + ",\nturns AS (SELECT *, min(CASE WHEN doc_id.role = 'system' THEN doc_id.turn END) OVER (PARTITION BY doc_id.conv_id) AS first_system FROM chain)\n"
        + f"SELECT doc_id.conv_id AS conv_id, '{{\"messages\":[' || {first} || string_agg({one}, ',' ORDER BY doc_id.turn) || '],\"model\":' ||"
        + " CASE WHEN doc_id.conv_id % 2 = 0 THEN '\"gpt-4o\"' ELSE '\"claude-sonnet\"' END || ',\"temperature\":0.5}' AS anonymized FROM turns GROUP BY 1"
    )


@query("json_body_anonymize", _body_sql(False))
def json_body_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize_bodies(_bodies(spark, sf_dir), "conv_id", "body", ["GLOBAL"])


@query("json_inject", _body_sql(True))
def json_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize_bodies(_bodies(spark, sf_dir), "conv_id", "body", ["GLOBAL"], instructions=dict(_RULES))


_MAIL = "'user' || conv_id || '@example.com'"


@query("json_tokens", f"SELECT conv_id, count(*) AS n_occurrences, '[PII_EMAIL_' || substr(md5({_MAIL}), 1, 16) || ']' AS token FROM conversations GROUP BY conv_id")
def json_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(found_in_bodies(_bodies(spark, sf_dir), "conv_id", "body", ["GLOBAL"]), "conv_id").where(F.col("original") == F.concat(F.lit("user"), F.col("conv_id"), F.lit("@example.com")))
    return found.groupBy("conv_id", "token").agg(F.count("*").alias("n_occurrences"))


# ---- metrics --------------------------------------------------------------------------------------------------------


@query("metrics_by_type", chain_sql(ALL).rstrip() + ",\n" + _VERDICTS + "SELECT s.pii_type AS pii_type, count(*) FILTER (WHERE v.token IS NOT NULL) AS n_hits, count(*) FILTER (WHERE v.token IS NULL) AS n_misses FROM spans LEFT JOIN verdicts v ON s.original = v.original WHERE s.confidence < 0.7 GROUP BY 1")
def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_spans(spark, sf_dir), "spans")
    return M.verdict_counts(C.resolve(found, _verdicts(found)))


@query("token_volume", chain_sql(ALL) + "SELECT CAST(sum(a) AS BIGINT) AS n_replaced, CAST(sum(b) AS BIGINT) AS n_deanonymized FROM (SELECT doc_id, count(*) AS a, count(DISTINCT s.token) AS b FROM spans GROUP BY 1)")
def token_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.token_volume(_spans(spark, sf_dir), "doc_id")


@query("latency_summary", "SELECT event_type AS dimension, count(*) AS n, round(min(value), 2) AS min_ms, round(avg(value), 2) AS mean_ms, round(max(value), 2) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency(table(spark, sf_dir, "events").select(F.col("event_type").alias("dimension"), F.col("value").alias("ms")))


_FAILED = {"upstream_error": "CASE WHEN event_id % 9 = 0 THEN 'timeout' WHEN event_id % 9 = 1 THEN '' END", "anonymize_error": "CASE WHEN value IS NULL OR user_id % 13 = 0 THEN 'bad body' END"}


@query("error_counts", f"SELECT count(*) FILTER (WHERE u <> '') AS n_upstream_errors, count(*) FILTER (WHERE a <> '') AS n_anonymize_errors FROM (SELECT {_FAILED['upstream_error']} AS u, {_FAILED['anonymize_error']} AS a FROM events)")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.error_counts(table(spark, sf_dir, "events").select(*(F.expr(e).alias(c) for c, e in _FAILED.items())))


_LANGS = "lang AS (SELECT doc_id, lang FROM documents)\n"


@query("pii_rollup", chain_sql(ALL).rstrip() + ",\n" + _LANGS + "SELECT lang, s.pii_type AS pii_type, count(*) AS n, count(DISTINCT s.token) AS n_tokens FROM spans JOIN lang USING (doc_id) GROUP BY ROLLUP (lang, s.pii_type)")
def pii_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return M.rollup(_spans(spark, sf_dir).join(langs, "doc_id"), "lang", "pii_type")


@query("model_counts", chain_sql(ALL).rstrip() + ",\n" + _VERDICTS + "SELECT count(DISTINCT s.original) AS n_dispatches, count(*) AS n_fallbacks, (SELECT count(*) + 1 FROM orders WHERE o_orderkey % 7 = 0) AS n_errors FROM spans WHERE s.confidence < 0.7 AND s.original NOT IN (SELECT original FROM verdicts)")
def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_spans(spark, sf_dir), "spans")
    return M.model_counts(C.resolve(found, _verdicts(found)), _answers(spark, sf_dir))


@query(
    "metrics_snapshot",
    chain_sql(ALL).rstrip()
    + """,
volume AS (SELECT CAST(sum(a) AS BIGINT) AS n_replaced, CAST(sum(b) AS BIGINT) AS n_deanonymized FROM (SELECT doc_id, count(*) AS a, count(DISTINCT s.token) AS b FROM spans GROUP BY 1)),
kinds AS (SELECT string_agg('"' || k || '":' || n, ',' ORDER BY k) AS types FROM (SELECT s.pii_type AS k, count(*) AS n FROM spans GROUP BY 1)),
times AS (SELECT string_agg('{"dimension":' || to_json(d) || ',"n":' || n || ',"min_ms":' || a || ',"mean_ms":' || b || ',"max_ms":' || c || '}', ',' ORDER BY d) AS latency
  FROM (SELECT event_type AS d, count(*) AS n, round(min(value), 2) AS a, round(avg(value), 2) AS b, round(max(value), 2) AS c FROM events WHERE value IS NOT NULL GROUP BY 1))
SELECT '{"n_replaced":' || n_replaced || ',"n_deanonymized":' || n_deanonymized || ',"types":{' || types || '},"latency":[' || latency || ']}' AS snapshot FROM volume, kinds, times""",
)
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("dimension"), F.col("value").alias("ms"))
    return M.snapshot(materialize(_spans(spark, sf_dir), "spans"), samples, "doc_id")


@query("pii_types", X.values_sql(pii_types(), "pii_type") + " UNION " + X.values_sql(("NAME", "MEDICAL", "SALARY", "COMPANY", "JOBTITLE"), "pii_type"))
def pii_types_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.known_types(spark)


# ---- streams and replay ---------------------------------------------------------------------------------------------


def _event(name: str, text: str) -> str:
    """An event of a provider that shows `text`, as a JSON template."""
    docs = {
        "anthropic": {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": text}},
        "openai": {"id": "c", "object": "chat.completion.chunk", "choices": [{"index": 0, "delta": {"content": text}, "finish_reason": None}]},
        "gemini": {"candidates": [{"content": {"parts": [{"text": text}], "role": "model"}}]},
        "cohere": {"type": "content-delta", "index": 0, "delta": {"message": {"content": {"text": text}}}},
        "passthrough": {"text": text},
    }
    return "data: " + (text if name == "replicate" else json.dumps(docs[name], separators=(",", ":")))


_HOST = {"anthropic": "api.anthropic.com", "openai": "api.openai.com", "gemini": "aiplatform.googleapis.com", "cohere": "api.cohere.ai", "replicate": "api.replicate.com", "passthrough": "gateway.ai.cloudflare.com"}


def _said(name: str, mail: str) -> str:
    """What a turn's stream says, as SQL of both dialects: its whole text, and the mail address twice. A plain-text format has no
    line ends within a text."""
    text = "coalesce(text, '')" if name != "replicate" else "replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ')"
    return f"concat({text}, ' hello ', {mail}, ' and ', {mail}, '!')"


def stream_lines(spark: SparkSession, sf_dir: str, name: str, width: int = 24) -> tuple[DataFrame, DataFrame]:
    """(lines, token map): each turn of each conversation as a stream of its whole text and of tokens, cut in pieces of `width`
    characters (for the passthrough provider in one piece, as it does not rejoin)."""
    from maskwright.functions.tokens import token

    mail = F.concat(F.lit("user"), F.col("conv_id"), F.lit("@example.com"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", mail.alias("original"), token("EMAIL", mail).alias("token"))
    text = F.expr(_said(name, "token"))
    # one pass over the text: a substring for each piece would count, and make, the whole text again for every one
    pieces = F.array(text) if name == "passthrough" else F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    before, after = _event(name, "@@").split("@@")
    # pieces first: what stands beside a generator is computed anew for each of its rows
    cut = turns.select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.col("conv_id").alias("session_id"), pieces.alias("pieces"), F.size(pieces).alias("n"))
    lines = cut.select("stream_id", "session_id", "n", F.posexplode("pieces").alias("seq", "piece"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("piece").alias("x"))), '^[{]"x":"(.*)"[}]$', 1) if name != "replicate" else F.col("piece")
    lines = lines.select("stream_id", "session_id", F.col("seq").cast("long").alias("seq"), F.lit(_HOST[name]).alias("host"), F.concat(F.lit(before), quoted, F.lit(after)).alias("line"), (F.col("seq") == F.col("n") - 1).alias("last"))
    return lines, turns.select(F.col("conv_id").alias("session_id"), "token", "original").distinct()


_TEXT_AT = {"anthropic": "$.delta.text", "openai": "$.choices[0].delta.content", "gemini": "$.candidates[0].content.parts[0].text", "cohere": "$.delta.message.content.text", "passthrough": "$.text"}


def _shown(out: DataFrame, name: str) -> DataFrame:
    """(stream_id, shown): the text that a reader of the restored lines sees."""
    payload = F.substr("line", F.lit(len("data: ") + 1))
    text = F.get_json_object(payload, _TEXT_AT[name]) if name in _TEXT_AT else payload
    parts = out.select("stream_id", "seq", "part", text.alias("text")).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part", "text"))).alias("p"))  # a response's lines
    return parts.select("stream_id", F.array_join(F.col("p.text"), "").alias("shown"))


def _shown_sql(name: str) -> str:
    return f"SELECT concat(conv_id, '-', turn) AS stream_id, {_said(name, _MAIL)} AS shown FROM conversations"


def _stream(name: str) -> None:
    @query(f"stream_deanonymize_{name}", _shown_sql(name))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines, tokens = stream_lines(spark, sf_dir, name)
        return _shown(restore_batch(with_tokens(lines, tokens)), name)


for _name in _HOST:
    _stream(_name)


@query("stream_restore_stateful", " UNION ALL ".join(f"{_shown_sql(n)} WHERE conv_id % {len(_HOST)} = {i}" for i, n in enumerate(_HOST)))
def stream_restore_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn through the stateful operator: a file source of three micro-batches, of which the first has the lines of seq 1,
    4, 7, ... of all streams, the next those of 2, 5, 8, ..., the last the rest. Conversations take turns in provider."""
    folder = f"{shared_dir(spark)}/streams-{uuid.uuid4().hex}"
    for i, name in enumerate(_HOST):
        lines, tokens = stream_lines(spark, sf_dir, name)
        own = with_tokens(lines.where(F.col("session_id") % len(_HOST) == i), tokens).withColumn("batch", (F.col("seq") + 2) % 3)
        own.write.mode("append").partitionBy("batch").parquet(f"{folder}/lines")
    schema = "stream_id string, seq long, line string, last boolean, provider string, tokens map<string,string>"
    for batch in range(3):  # one run a batch, as the source orders files by time
        source = spark.readStream.schema(schema + ", batch int").option("basePath", f"{folder}/lines").parquet(f"{folder}/lines/batch=[0-{batch}]")
        run = restore_streaming(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.schema("stream_id string, seq long, part long, line string").parquet(f"{folder}/out")
    conversation = F.split_part("stream_id", F.lit("-"), F.lit(1)).cast("long") % len(_HOST)
    shown = [_shown(out.where(conversation == i), name) for i, name in enumerate(_HOST)]
    return reduce(DataFrame.unionByName, shown)


@query("s3fifo_replay")
def s3fifo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 11 == 0, "delete").when(F.col("event_id") % 3 == 0, "set").otherwise("get")
    trace = events.select((F.col("user_id") % 16).alias("cache_id"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("k"), F.pmod(F.xxhash64("user_id", "event_type"), F.lit(97))).alias("key"), F.concat(F.lit("v"), F.col("event_id")).alias("value"))
    return replay(trace, capacity=20)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of replaced values by language and type over the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = anonymize(spread(docs), "text", ALL)
    return found.select("lang", F.explode("found").alias("f")).groupBy("lang", "f.pii_type").agg(F.count("*").alias("n"), F.count_distinct("f.token").alias("n_tokens"))


assert pattern("email") and all_packs()
