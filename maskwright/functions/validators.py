"""Checks of matched values, as Spark SQL text: a check is a function from a value's expression to a boolean expression.

Text, not Column objects: a chain of all packs holds some thousand expression nodes, which the parser reads at once and which
would each cost a call to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

Check = Callable[[str], str]


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _bare(v: str) -> str:
    return f"replace(replace({v}, ' ', ''), '-', '')"


def card_luhn(v: str) -> str:
    d = _digits(v)
    return f"(length({d}) BETWEEN 13 AND 19 AND luhn_check({d}))"


def email_local_part(v: str) -> str:
    local = f"split_part({v}, '@', 1)"
    return f"(contains({v}, '@') AND {local} <> '' AND NOT startswith({local}, '.') AND NOT endswith({local}, '.') AND NOT contains({local}, '..'))"


def ssn(v: str) -> str:
    d = _digits(v)
    area = f"substring({d}, 1, 3)"
    return f"(length({d}) = 9 AND {area} NOT IN ('000', '666') AND {area} < '900' AND substring({d}, 4, 2) <> '00' AND substring({d}, 6, 4) <> '0000')"


def us_phone(v: str) -> str:
    return f"({v} RLIKE '[-() ]' OR startswith({v}, '+'))"


def steuer_id(v: str) -> str:
    """ISO 7064 MOD 11,10 over the first ten of eleven digits; the first is not zero."""
    d = _digits(v)
    product = (
        f"aggregate(sequence(1, 10), 10, (p, i) -> CAST(if((try_cast(substring({d}, i, 1) AS INT) + p) % 10 = 0, 10,"
        f" (try_cast(substring({d}, i, 1) AS INT) + p) % 10) * 2 % 11 AS INT))"
    )
    return f"coalesce(length({d}) = 11 AND substring({d}, 1, 1) <> '0' AND (11 - {product}) % 10 = try_cast(substring({d}, 11, 1) AS INT), false)"


def nir(v: str) -> str:
    """97 minus the thirteen leading digits modulo 97 is the key; Corsican departments count as 19 and 18."""
    s = _bare(v)
    department = f"upper(substring({s}, 6, 2))"
    number = f"concat(substring({s}, 1, 5), CASE {department} WHEN '2A' THEN '19' WHEN '2B' THEN '18' ELSE {department} END, substring({s}, 8))"
    return f"coalesce({number} RLIKE '^[0-9]{{15}}$' AND 97 - try_cast(substring({number}, 1, 13) AS BIGINT) % 97 = try_cast(substring({number}, 14, 2) AS BIGINT), false)"


def luhn(v: str) -> str:
    d = _digits(v)
    return f"(length({d}) >= 2 AND luhn_check({d}))"


def siret(v: str) -> str:
    s = _bare(v)
    return f"({s} RLIKE '^[0-9]{{14}}$' AND luhn_check({s}))"


def siren(v: str) -> str:
    s = _bare(v)
    return f"({s} RLIKE '^[0-9]{{9}}$' AND luhn_check({s}))"


def bsn(v: str) -> str:
    """The weights 9 to 2 and then -1 give a sum that 11 divides and that is not zero."""
    d = _digits(v)
    total = f"aggregate(sequence(1, 9), 0, (t, i) -> t + if(i = 9, -1, 10 - i) * try_cast(substring({d}, i, 1) AS INT))"
    return f"coalesce(length({d}) = 9 AND {total} % 11 = 0 AND {total} <> 0, false)"


def iban(v: str) -> str:
    """Remainder 1 modulo 97 of the number that the moved and spelled-out account makes, digit by digit."""
    s = f"upper({_bare(v)})"
    moved = f"concat(substring({s}, 5), substring({s}, 1, 4))"
    rest = (
        f"aggregate(filter(split({moved}, ''), c -> c <> ''), 0,"
        " (r, c) -> if(ascii(c) >= 65, (r * 100 + ascii(c) - 55) % 97, (r * 10 + ascii(c) - 48) % 97))"
    )
    return f"coalesce({s} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' AND {rest} = 1, false)"


CHECKS: dict[str, Check] = {f.__name__: f for f in (card_luhn, email_local_part, ssn, us_phone, steuer_id, nir, luhn, siret, siren, bsn, iban)}


def register_check(name: str, check: Check) -> None:
    """Make a check known as a pattern's validator; its text may call any function that the session knows."""
    CHECKS[name] = check


# The same checks in DuckDB's dialect, written apart from the above; {m} is the value.
_DUCK_LUHN = (
    "(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN"
    " (CASE WHEN CAST(substr({d}, length({d}) + 1 - i, 1) AS INT) > 4 THEN CAST(substr({d}, length({d}) + 1 - i, 1) AS INT) * 2 - 9 ELSE CAST(substr({d}, length({d}) + 1 - i, 1) AS INT) * 2 END)"
    " ELSE CAST(substr({d}, length({d}) + 1 - i, 1) AS INT) END)) % 10 = 0)"
)
_D, _B = "regexp_replace({m}, '[^0-9]', '', 'g')", "regexp_replace({m}, '[ -]', '', 'g')"
_NIR = "(substr(" + _B + ", 1, 5) || CASE upper(substr(" + _B + ", 6, 2)) WHEN '2A' THEN '19' WHEN '2B' THEN '18' ELSE substr(" + _B + ", 6, 2) END || substr(" + _B + ", 8))"
_MOVED = "(substr(upper(" + _B + "), 5) || substr(upper(" + _B + "), 1, 4))"
_DUCK = {
    "card_luhn": f"(length({_D}) BETWEEN 13 AND 19 AND {_DUCK_LUHN.replace('{d}', _D)})",
    "email_local_part": "contains({m}, '@') AND regexp_matches({m}, '^[^@.]') AND NOT regexp_matches({m}, '^[^@]*[.]@') AND NOT regexp_matches({m}, '^[^@]*[.][.]')",
    "ssn": f"(length({_D}) = 9 AND CAST('0' || substr({_D}, 1, 3) AS INT) NOT IN (0, 666) AND CAST('0' || substr({_D}, 1, 3) AS INT) < 900 AND CAST('0' || substr({_D}, 4, 2) AS INT) > 0 AND CAST('0' || substr({_D}, 6, 4) AS INT) > 0)",
    "us_phone": "(contains({m}, '(') OR contains({m}, ')') OR contains({m}, '-') OR contains({m}, ' ') OR left({m}, 1) = '+')",
    "steuer_id": f"(length({_D}) = 11 AND left({_D}, 1) <> '0' AND (11 - list_reduce(list_concat([10], list_transform(string_split({_D}[:10], ''), lambda c: CAST(c AS INT))), lambda p, d: ((CASE WHEN (d + p) % 10 = 0 THEN 10 ELSE (d + p) % 10 END) * 2) % 11)) % 10 = CAST(right({_D}, 1) AS INT))",
    "nir": f"(regexp_full_match({_NIR}, '[0-9]{{15}}') AND 97 - TRY_CAST(left({_NIR}, 13) AS BIGINT) % 97 = TRY_CAST(substr({_NIR}, 14, 2) AS BIGINT))",
    "luhn": f"(length({_D}) >= 2 AND {_DUCK_LUHN.replace('{d}', _D)})",
    "siret": f"(regexp_full_match({_B}, '[0-9]{{14}}') AND {_DUCK_LUHN.replace('{d}', _D)})",
    "siren": f"(regexp_full_match({_B}, '[0-9]{{9}}') AND {_DUCK_LUHN.replace('{d}', _D)})",
    "bsn": f"(length({_D}) = 9 AND {_D} <> '000000000' AND list_sum(list_transform(range(1, 10), lambda i: (CASE WHEN i = 9 THEN -1 ELSE 10 - i END) * TRY_CAST(substr({_D}, i, 1) AS INT))) % 11 = 0)",
    "iban": f"(regexp_full_match(upper({_B}), '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND list_reduce(list_concat([0], list_transform(string_split({_MOVED}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda r, v: CASE WHEN v >= 10 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END) = 1)",
}


def duck(name: str | None, value: str) -> str:
    """The check of `value` (an SQL expression) as DuckDB SQL."""
    return "true" if name is None else f"coalesce({_DUCK[name].replace('{m}', value)}, false)"
