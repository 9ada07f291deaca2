"""Small inputs that the driver tables lack; each query and its SQL read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = (
    "write to alice@example.com or user.name+tag@domain.co.uk, not to user..name@example.com or user.@example.com",
    "a..b@x.com .lead@x.org test@sub.domain.org",
    "api_key=abc123def456ghi789jklmno secret=\"xxxxxxxxxxxxxxxxxxxxxxxx\" bearer XYZabc123def456ghi789jk",
    "api_key=abc token: short tolen=abc123def456ghi789jklmno",
    "cards 4111111111111111 4111 1111 1111 1111, 4111-1111-1111-1111; 5500000000000004 378282246310005 30569309025904",
    "not cards 1234567890123456 4111111111111112 411111",
    "\"4111111111111111 and more\"",
    "ssn 123-45-6789 001-01-0001 899-99-9999 or 000-12-3456 666-12-3456 900-12-3456 123-00-6789 123-45-0000 123456789",
    "phones 555-867-5309 (212) 555-0100 +1-800-555-1234 555 867 5309 not 555.867.5309 5558675309",
    "lives at 123 Main Street, 321 Oak St; 789 42nd Street. 1 1st Street",
    "12345 ist falsch 123 456 Street 123 Court 12 Foo 34 Bar Street 7 Main St_x",
    "hosts 192.168.1.1 999.1.1.1 ::1 fe80:: 2001:db8::1 2001:0db8:85a3:0000:0000:8a2e:0370:7334 std::x",
    "zip 90210 and 90210-1234 but 902101",
    "Steuer 65929970489 86095742719 659 299 704 89 659-299-704-89 no 65929970488 05929970489 6592997048",
    "SVNR 12150385A123 12 150385 A 123 no 12151385A123",
    "KFZ B AB 1234, M-XY 12 and Ö DE89 BY-NC 4",
    "NIR 1 85 12 75 108 042 79, 1 90 03 2A 014 012 75; 2 78 06 99 341 002 50 / 2 87 11 2B 033 001 59",
    "SIRET 362 521 874 00036, 443 061 841 00013; SIREN 362 521 874, 443 061 841 not 362521879",
    "BSN 123456782 111222333 010464554 not 123456789 000000000",
    "KVK 12345678 1234567 12345678A",
    "IBAN DE89370400440532013000, GB29NWBK60161331926819; NL91ABNA0417164300. FR7630006000011234567890189",
    "IBAN DE89 3704 0044 0532 0130 00, DE00370400440532013000 DE8937040044",
    "BIC DEUTDEFF, DEUTDEFF500; COBADEFFXXX BNPAFRPPXXX deutdeff 12UTDEFF DEUT",
    "VAT DE123456789, NL123456789B01; FR12345678901 ATU12345678 BE0123456789 ES12345678A XX123456789 US123456789",
    "MRN123456 MRN-1234567890 MR 12345678 PAT#987654 mrn:123456 MRN12345 MRN12345678901 ABC123456",
    "diagnosis: J18.9 dx: M54.5 ICD-10 E11.65 code E11.65 A01.2 random Z00",
    "insurance ID12345678 policy AB-123456789 EHIC DE123456789012 subscriber ID1234567890 ID12345678",
    "é123456782 Ö123-45-6789 x\t90210\n12345",
    "12\tMain\nStreet and 5 Große Straße",
    "mail bob@example.com pays with 4111111111111111 from 10.0.0.1, call 555-867-5309",
)

#: value, expected: hosts of every kind that routing treats.
HOSTS = (
    "api.anthropic.com", "API.OpenAI.com.", "my-res.openai.azure.com", "us-east4-aiplatform.googleapis.com", "a.b.aiplatform.googleapis.com",
    "x.aiplatform.googleapis.com", "bedrock-runtime.eu-west-1.amazonaws.com", "bedrock-runtime..amazonaws.com", "-aiplatform.googleapis.com",
    "aiplatform.googleapis.com", "github.com", "login.example.com", "sso.corp.example", "oauth.example", "auth0.com", "example.com", ".", "gateway.ai.cloudflare.com", "api.githubcopilot.com",
)
DOMAINS = (
    "example.com", "*.openai.azure.com", "*", "*.com", "foo.*", "*.*.com", "a.*.b.*.c", "-bad.com", "bad-.com", "a..b", "", "x_y.com", "*-aiplatform.googleapis.com",
    "a*b*c.d.e", "a.b.*", "bedrock-runtime.*.amazonaws.com", "localhost", "a" * 63 + ".com", "a" * 64 + ".com", ".".join(["abcdefgh"] * 29), "foo*.bar.baz", "*.a.*b.c",
)
#: host, path, whether it is an auth request
AUTH_CASES = (
    ("example.com", "/oauth", True), ("example.com", "/oauth/callback", True), ("example.com", "/oauthx", False), ("example.com", "/oauth/../admin", False),
    ("example.com", "//oauth", True), ("example.com", "/x/../login", True), ("example.com", "token", True), ("example.com", "", False), ("example.com", "/api/token/refresh", True),
    ("example.com", "/v1/chat", False), ("login.example.com", "/v1/chat", True), ("github.com", "/", True), ("GitHub.com", "/", False), ("example.com", "/./session/", True),
)
#: host, whether it is a private address
ADDRESSES = (
    ("10.0.0.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1:8080", True), ("127.0.0.1", True), ("169.254.1.1", True), ("8.8.8.8", False),
    ("::1", True), ("[::1]:443", True), ("fe80::1", True), ("fd00::1", True), ("2001:db8::1", False), ("::ffff:10.0.0.1", True), ("localhost", False), ("010.0.0.1", False), ("", False), ("10.0.0", False),
)
GLOBS = (
    ("*.openai.azure.com", "x.openai.azure.com", True), ("*.openai.azure.com", "x.y.openai.azure.com", False), ("*-aiplatform.googleapis.com", "us-aiplatform.googleapis.com", True),
    ("*-aiplatform.googleapis.com", "-aiplatform.googleapis.com", False), ("foo*.bar", "foo123.BAR.", True), ("foo*.bar", "foo.bar", False), ("f*o.bar", "fo.bar", False), ("f*o.bar", "fxo.bar", True),
    ("a**.b", "axx.b", False), ("a**.b", "a**.b", True), ("*.b", ".b", False), ("*.*", "a.b", True), ("A.B", "a.b.", True),
)


def texts_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def texts_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {sql_text(t)})" for i, t in enumerate(TEXTS)) + ") AS v(doc_id, text)"


def values_sql(rows, names: str) -> str:
    def one(x) -> str:
        return sql_text(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else "NULL" if x is None else str(x)

    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names})"
