"""Routing predicates over hosts, paths and addresses."""

from __future__ import annotations

import ipaddress
import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default hosts, paths, prefixes and networks of the routing rules.
AI_DOMAINS = (
    "api.anthropic.com", "api.openai.com", "api.cohere.ai", "generativelanguage.googleapis.com", "api.mistral.ai", "api.together.xyz",
    "api.perplexity.ai", "api.replicate.com", "api.huggingface.co", "api.groq.com", "api.deepseek.com", "api.fireworks.ai", "api.x.ai",
    "api.endpoints.anyscale.com", "openrouter.ai", "api.portkey.ai", "api.githubcopilot.com", "gateway.ai.cloudflare.com",
    "*.openai.azure.com", "aiplatform.googleapis.com", "*-aiplatform.googleapis.com", "*.aiplatform.googleapis.com",
    "bedrock-runtime.*.amazonaws.com", "bedrock-agent-runtime.*.amazonaws.com",
)
PROVIDERS = {
    "api.anthropic.com": "anthropic", "api.openai.com": "openai", "api.mistral.ai": "openai", "api.together.xyz": "openai",
    "api.perplexity.ai": "openai", "api.huggingface.co": "openai", "generativelanguage.googleapis.com": "gemini",
    "aiplatform.googleapis.com": "gemini", "api.cohere.ai": "cohere", "api.replicate.com": "replicate", "api.groq.com": "openai",
    "api.deepseek.com": "openai", "api.fireworks.ai": "openai", "api.x.ai": "openai", "api.endpoints.anyscale.com": "openai",
    "openrouter.ai": "openai", "api.portkey.ai": "openai", "api.githubcopilot.com": "passthrough", "gateway.ai.cloudflare.com": "passthrough",
}
GLOB_PROVIDERS = (
    ("*.openai.azure.com", "openai"), ("*-aiplatform.googleapis.com", "gemini"), ("*.aiplatform.googleapis.com", "gemini"),
    ("bedrock-runtime.*.amazonaws.com", "passthrough"), ("bedrock-agent-runtime.*.amazonaws.com", "passthrough"),
)
AUTH_DOMAINS = ("accounts.google.com", "login.microsoftonline.com", "auth0.com", "okta.com", "oauth2.googleapis.com", "github.com")
AUTH_PATHS = (
    "/auth", "/login", "/signin", "/signup", "/register", "/token", "/oauth", "/authenticate", "/session",
    "/v1/auth", "/api/auth", "/api/login", "/api/token",
)
AUTH_PREFIXES = ("auth.", "login.", "accounts.", "sso.", "oauth.")
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")


def normalize_host(host: Column) -> Column:
    """Lower case, without one trailing dot (a lone dot stays)."""
    return F.regexp_replace(F.lower(host), r"(?<=.)\.$", "")


def is_glob(pattern: Column) -> Column:
    return pattern.contains("*")


def glob_regex(glob: str) -> str:
    """An anchored expression of a glob: a star is a label, or one non-empty part of a label; labels with two stars are literal."""
    labels = re.sub(r"(?<=.)\.$", "", glob.lower()).split(".")
    return "^" + r"\.".join("[^.]+".join(map(re.escape, x.split("*"))) if x.count("*") == 1 else re.escape(x) for x in labels) + "$"


def glob_match(glob: Column, host: Column) -> Column:
    """Label by label, both as columns."""
    labels, parts = F.split(normalize_host(glob), r"\."), F.split(normalize_host(host), r"\.")

    def one(p: Column, x: Column) -> Column:
        before, after = F.substring_index(p, "*", 1), F.substring_index(p, "*", -1)
        stars = F.length(p) - F.length(F.replace(p, F.lit("*"), F.lit("")))
        wild = (F.length(before) + F.length(after) < F.length(x)) & x.startswith(before) & x.endswith(after)
        return F.when(stars == 1, wild).otherwise(p == x)

    return (F.size(labels) == F.size(parts)) & F.forall(F.zip_with(labels, parts, lambda p, x: F.when(x.isNull() | p.isNull(), False).otherwise(one(p, x))), lambda ok: ok)


def _registry(domains: list[str]) -> tuple[list[str], list[str]]:
    """(exact names, expressions of globs)."""
    exact = dict.fromkeys(re.sub(r"(?<=.)\.$", "", d.lower()) for d in domains if "*" not in d)
    return list(exact), [glob_regex(d) for d in domains if "*" in d]


def is_ai_host(hosts: DataFrame, column: str = "host", domains: list[str] = list(AI_DOMAINS)) -> DataFrame:
    """`hosts` with is_ai: registered exactly, or by a glob. The registry is configuration: a set lookup and one expression."""
    h = normalize_host(F.col(column))
    names, globs = _registry(domains)
    return hosts.withColumn("is_ai", F.coalesce(h.isin(names) | (h.rlike("|".join(globs)) if globs else F.lit(False)), F.lit(False)))


def ai_hosts(hosts: DataFrame, column: str = "host", domains: list[str] = list(AI_DOMAINS)) -> DataFrame:
    """The semi-join of hosts with the registry."""
    return is_ai_host(hosts, column, domains).where("is_ai").drop("is_ai")


def provider(host: Column) -> Column:
    """The streaming format of a host: exact names first, then globs in order, else passthrough."""
    h = normalize_host(host)
    out = F.element_at(F.create_map(*(F.lit(x) for kv in PROVIDERS.items() for x in kv)), h)
    by_glob = F.lit("passthrough")
    for glob, name in reversed(GLOB_PROVIDERS):
        by_glob = F.when(h.rlike(glob_regex(glob)), name).otherwise(by_glob)
    return F.coalesce(out, by_glob, F.lit("passthrough"))


def clean_path(path: str | None) -> str:
    """The shortest equal path: no dot segments, no doubled slashes, rooted."""
    out = posixpath.normpath(path or "/")
    out = "/" + out.lstrip("/") if out.startswith("/") else "/" + out
    return "/" if out == "/." else out


@F.pandas_udf(T.StringType())
def cleaned_path(paths: pd.Series) -> pd.Series:
    return paths.map(clean_path)


def needs_cleaning(path: Column) -> Column:
    return path.isNull() | ~path.startswith("/") | path.rlike(r"//|/\.|/$")


def is_auth_request(host: Column, cleaned: Column, domains=AUTH_DOMAINS, paths=AUTH_PATHS) -> Column:
    """Host rules as given (no normalisation), or a cleaned path that is an auth path or below one."""
    by_host = host.isin(*domains)
    for prefix in AUTH_PREFIXES:
        by_host = by_host | host.startswith(prefix)
    by_path = F.lit(False)
    for p in paths:
        by_path = by_path | (cleaned == p) | cleaned.startswith(p + "/")
    return F.coalesce(by_host, F.lit(False)) | F.coalesce(by_path, F.lit(False))


def with_clean_path(df: DataFrame, column: str = "path", out: str = "clean_path") -> DataFrame:
    """Only paths that are not clean already go to Python."""
    dirty = needs_cleaning(F.col(column))
    plain = df.where(~dirty).withColumn(out, F.col(column))
    return plain.unionByName(df.where(dirty).withColumn(out, cleaned_path(F.col(column))))


def split_host(host: Column) -> Column:
    """A host without its port: `h:p`, `[v6]:p`; anything else as it is."""
    return F.when(host.rlike(r"^\[[^\]]*\]:[^:]*$"), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).when(host.rlike(r"^[^:\[\]]*:[^:]*$"), F.regexp_extract(host, "^([^:]*):", 1)).otherwise(host)


def is_private_v4(host: Column) -> Column:
    """Native test of a dotted IPv4 literal (no leading zeros) against the private ranges; false for anything else."""
    h = split_host(host)
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    part = F.split(h, r"\.")
    number = sum((F.get(part, F.lit(i)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    inside = F.lit(False)
    for net in (ipaddress.ip_network(n) for n in PRIVATE_NETWORKS if ":" not in n):
        inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(h.rlike(rf"^(?:{octet}\.){{3}}{octet}$") & inside, F.lit(False))


@F.pandas_udf(T.BooleanType())
def is_private_v6(hosts: pd.Series) -> pd.Series:
    """IPv6 literals, mapped IPv4 addresses included."""
    nets = [ipaddress.ip_network(n) for n in PRIVATE_NETWORKS]

    def one(host: str | None) -> bool:
        try:
            ip = ipaddress.ip_address(host or "")
        except ValueError:
            return False
        if getattr(ip, "scope_id", None):
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return any(ip.version == n.version and ip in n for n in nets)

    return hosts.map(one)


def with_private(df: DataFrame, column: str = "host", out: str = "is_private") -> DataFrame:
    """Whether a host is a private IP literal. Only hosts with two colons, as IPv6 has, go to Python."""
    v6 = F.coalesce(split_host(F.col(column)).rlike(":.*:"), F.lit(False))
    native = df.where(~v6).withColumn(out, is_private_v4(F.col(column)))
    return native.unionByName(df.where(v6).withColumn(out, is_private_v6(split_host(F.col(column)))))


def valid_domain(d: Column) -> Column:
    """Syntax of a host name or glob: labels of 1 to 63 letters, digits and inner hyphens; one star a label at most; globs
    have three labels or more, don't end in a bare star, and don't begin with two."""
    labels = F.split(d, r"\.")
    ok = F.forall(labels, lambda x: x.rlike(r"^(?:\*|[A-Za-z0-9-]*\*[A-Za-z0-9-]*|[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)$"))
    glob = (F.size(labels) >= 3) & (F.element_at(labels, -1) != "*") & ~d.startswith("*.*.")
    return F.coalesce((F.octet_length(d).between(1, 253)) & ok & (~d.contains("*") | glob), F.lit(False))


def request_class(auth: Column, ai: Column) -> Column:
    return F.when(auth, "auth").when(ai, "ai").otherwise("passthrough")


def is_streaming(content_type: Column) -> Column:
    return F.coalesce(content_type.contains("text/event-stream"), F.lit(False))


def within_size(body: Column, most: int = 50 << 20) -> Column:
    """Whether a request body is within the size that is read at all."""
    return F.coalesce(F.octet_length(body), F.lit(0)) <= most


class Registry:
    """Domains as a set of exact names and globs: add, remove by exact text, list in order. A configuration, not data."""

    def __init__(self, domains: list[str]):
        self.domains = set(domains)

    def add(self, *domains: str) -> Registry:
        return Registry([*self.domains, *domains])

    def remove(self, *domains: str) -> Registry:
        return Registry([d for d in self.domains if d not in domains])

    def all(self) -> list[str]:
        return sorted(self.domains)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d,) for d in self.all()], "domain string")


def registry_after(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(domain) after additions and removals, as set operations."""
    valid = added.where(valid_domain(F.col("domain")))
    return current.union(valid).distinct().join(removed, "domain", "left_anti")
