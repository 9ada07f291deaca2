"""Patterns and validators: the literal tables, and the traps between the two regex dialects."""

import hashlib

import pytest
from pyspark.sql import functions as F

from maskwright.functions import patterns
from maskwright.functions.patterns import CATALOGUE, SECRETS, Pattern, all_packs, as_literal, load_packs, pattern, pii_types, to_java
from maskwright.functions.tokens import TOKEN, longest_token
from maskwright.functions.validators import CHECKS, register_check
from maskwright.operators.anonymize import anonymize, matches

HITS = {
    "email": (["alice@example.com", "user.name+tag@domain.co.uk", "test@sub.domain.org"], ["user..name@example.com", "user.@example.com", "missing-domain@"]),
    "api_key": (["api_key=abc123def456ghi789jklmno", 'secret="xxxxxxxxxxxxxxxxxxxxxxxx"', "bearer XYZabc123def456ghi789jk"], ["api_key=abc", "token: short"]),
    "credit_card": (["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "378282246310005"], ["1234567890123456", "4111111111111112", "411111", ""]),
    "ssn": (["123-45-6789", "001-01-0001", "899-99-9999"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-6789", "123-45-0000", "123456789"]),
    "phone_us": (["555-867-5309", "(212) 555-0100", "+1-800-555-1234", "555 867 5309"], ["555.867.5309", "5558675309"]),
    "address_us": (["123 Main Street", "321 Oak St", "789 42nd Street", "1 1st Street"], ["12345 ist falsch", "123 456 Street", "123 Court", "7 Main St_x"]),
    "ipv6": (["::1", "fe80::", "2001:db8::1", "std::x"], ["10:30"]),
    "ipv4": (["192.168.1.1", "999.1.1.1"], ["1.2.3"]),
    "zip_us": (["90210", "90210-1234"], ["902101"]),
    "steuer_id": (["65929970489", "86095742719", "659 299 704 89", "659-299-704-89"], ["65929970488", "05929970489", "6592997048", "659299704891"]),
    "svnr": (["12150385A123", "12 150385 A 123"], ["12151385A123"]),
    "kfz": (["B AB 1234"], ["Ö DE89"]),
    "nir": (["1 85 12 75 108 042 79", "1 90 03 2A 014 012 75", "2 78 06 99 341 002 50", "2 87 11 2B 033 001 59"], ["1 85 12 75 108 042 78"]),
    "siret": (["362 521 874 00036", "443 061 841 00013"], ["362 521 874 00037"]),
    "siren": (["362 521 874", "443 061 841"], ["362521879"]),
    "bsn": (["123456782", "111222333", "010464554", "é123456782"], ["123456789", "000000000"]),
    "kvk": (["12345678"], ["1234567", "12345678A"]),
    "iban": (["DE89370400440532013000", "GB29NWBK60161331926819", "NL91ABNA0417164300", "FR7630006000011234567890189", "DE89 3704 0044 0532 0130 00"], ["DE00370400440532013000", "DE8937040044"]),
    "swift_bic": (["DEUTDEFF", "DEUTDEFF500", "COBADEFFXXX"], ["deutdeff", "12UTDEFF", "DEUT"]),
    "vat_eu": (["DE123456789", "NL123456789B01", "FR12345678901", "ATU12345678", "BE0123456789", "ES12345678A"], ["XX123456789", "US123456789"]),
    "mrn": (["MRN123456", "MRN-1234567890", "MR 12345678", "PAT#987654", "mrn:123456"], ["MRN12345", "MRN12345678901", "ABC123456"]),
    "icd10": (["diagnosis: J18.9", "dx: M54.5", "ICD-10 E11.65", "code E11.65"], ["A01.2", "random Z00"]),
    "insurance_id": (["insurance ID12345678", "policy AB-123456789", "EHIC DE123456789012"], ["ID12345678"]),
}


def test_every_pattern_has_cases():
    assert set(HITS) == {p.name for p in CATALOGUE} and len(CATALOGUE) == 23 and len(SECRETS) == 24


def test_hits_and_misses(spark):
    rows = [(name, text, ok) for name, (good, bad) in HITS.items() for ok, texts in ((True, good), (False, bad)) for text in texts]
    df = spark.createDataFrame(rows, "name string, text string, ok boolean")
    got = df.select("name", "text", "ok", *(F.when(F.col("name") == n, F.size(matches("text", pattern(n))) > 0).alias(n) for n in HITS)).collect()
    assert [(r.name, r.text) for r in got if r[r.name] != r.ok] == []


def test_dialect():
    assert to_java(r"\b\d{9}\b").startswith("(?<![0-9A-Za-z_])")
    assert to_java(r"[\s\-:#]") == r"[\t\n\f\r \-:#]" and to_java(r"a\s") == "a[\\t\\n\\f\\r ]"
    assert to_java("(?i)x") == "(?iu)x" and to_java("[[]") == "[\\[]"


def test_vertical_tab_and_folding(spark):
    df = spark.createDataFrame([("1\x0b85127510804279", "555\x0b867\x0b5309", "toKen=abc123def456ghi789jklmno")], "a string, b string, c string")
    got = df.select(F.size(matches("b", pattern("phone_us"))), F.size(matches("c", pattern("api_key")))).first()
    assert tuple(got) == (0, 1)


def test_long_addresses_do_not_recurse(spark):
    df = spark.createDataFrame([("5 " + "word " * 20_000 + "Street",)], "t string")
    assert df.select(F.size(matches("t", pattern("address_us")))).first()[0] == 1


def test_validators_null_and_odd(spark):
    df = spark.createDataFrame([("",), ("x",), ("8" * 40 + "1",), ("é",)], "v string")
    for check in CHECKS.values():
        assert not any(r[0] for r in df.select(F.expr(check("v"))).collect())


def test_packs_decay_and_unknown():
    stages, unknown = load_packs(["SECRETS", "GLOBAL", "DE"])
    assert unknown == ["SECRETS"] and stages[0].position == 1
    assert stages[0].confidence == pytest.approx(0.95 * 0.95) and len(stages) == 6
    assert all(s.confidence == 0 for s in load_packs(["US", "GLOBAL"], decay=5)[0] if s.position)


def test_literal_and_types(spark):
    lit = as_literal(pattern("kvk"), "a.b*c")
    df = spark.createDataFrame([("xa.b*c axbbc",)], "t string")
    assert df.select(matches("t", lit)).first()[0] == ["a.b*c"]
    assert longest_token(["INSURANCEID"]) == 34 and "EMAIL" in pii_types()
    assert isinstance(lit, Pattern) and TOKEN


def test_catalogue_is_pinned():
    """The expressions as they must be, by digest of "pack name regex type confidence validator" lines: a change must be meant."""
    lines = "\n".join(f"{p.pack} {p.name} {p.regex} {p.pii_type} {p.confidence} {p.validator}" for p in CATALOGUE)
    assert hashlib.sha256(lines.encode()).hexdigest() == "ed247f0704a2f40775a9a052bd567a75e824808978c720d56cfca4990ddebf30"
    by = {p.name: p.regex for p in CATALOGUE}
    assert by["ssn"] == r"\b\d{3}-\d{2}-\d{4}\b" and by["zip_us"] == r"\b\d{5}(?:-\d{4})?\b" and by["kvk"] == r"\b\d{8}\b" and by["bsn"] == r"\b\d{9}\b"


def test_default_pack_order():
    assert all_packs() == ["DE", "FINANCE_EU", "FR", "GLOBAL", "HEALTHCARE", "NL", "US"]


def test_registered_packs_and_checks(spark, monkeypatch):
    monkeypatch.setattr(patterns, "_REGISTERED", [*CATALOGUE])
    patterns.register(Pattern("badge", "OWN", r"\bB-\d{4}\b", "BADGE", 0.9, "even"))
    register_check("even", lambda v: f"try_cast(substring({v}, 3) AS INT) % 2 = 0")
    try:
        df = spark.createDataFrame([("B-1234 B-1235",)], "t string")
        done = anonymize(df, "t", ["OWN"]).first()
        assert done.anonymized.startswith("[PII_BADGE_") and done.anonymized.endswith(" B-1235") and all_packs()[-1] == "OWN"
        with pytest.warns(UserWarning, match="NONE"):
            anonymize(df, "t", ["OWN", "NONE"])
    finally:
        del CHECKS["even"]
