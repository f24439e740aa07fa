"""Value features of database columns, one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules

MOBILE_PREFIXES = ("010", "011", "016", "017", "018", "019", "050")


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def _longest(v: Column, pattern: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), lambda x: F.length(x))), F.lit(0)).cast("long")


def basic(v: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("long")
    return {
        "length": F.length(v).cast("long"), "num_digits": count("[0-9]"), "num_letters": count("[a-zA-Z가-힣]"), "num_special": count(r"[^a-zA-Z0-9가-힣\s]"),
        "num_spaces": count(r"\s"), "num_hyphens": count("-"), "num_dots": count(r"\."), "num_at": count("@"), "num_colons": count(":"),
    }


def ratios(v: Column) -> dict[str, Column]:
    b, n = basic(v), F.greatest(F.length(v), F.lit(1))
    return {f"{k}_ratio": b[f"num_{k}s" if k != "special" else "num_special"] / n for k in ("digit", "letter", "special")}


def masks(v: Column) -> dict[str, Column]:
    stars = F.regexp_count(v, F.lit(r"\*"))
    return {"has_asterisk": _flag(stars > 0), "num_asterisks": stars.cast("double"), "has_masking_pattern": _flag(stars >= 2), "has_consecutive_asterisks": _flag(v.contains("**"))}


def patterns(v: Column) -> dict[str, Column]:
    bare = F.replace(v, F.lit("-"), F.lit(""))
    plain, hyphens = ~v.contains("*"), F.regexp_count(v, F.lit("-"))
    account = v.rlike("^[0-9]{3}") & (((hyphens >= 1) & F.length(bare).between(10, 20)) | ((hyphens == 0) & F.length(v).between(10, 16)))
    match = {"phone": "^0[0-9]{1,2}-?[0-9]{3,4}-?[0-9]{4}$", "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "pp": "^[A-Z][0-9]{8}$", "ip": r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$", "date": "^[0-9]{4}[-/]?[0-9]{2}[-/]?[0-9]{2}$"}
    out = {f"has_{k}_pattern": _flag(plain & v.rlike(p)) for k, p in match.items()}
    return out | {"has_rrn_pattern": _flag(plain & bare.rlike("^[0-9]{13}$")), "has_acn_pattern": _flag(plain & account)}


def names_and_shapes(v: Column) -> dict[str, Column]:
    bare = F.length(F.replace(v, F.lit("-"), F.lit("")))
    n, at = F.length(v), v.contains("@")
    return {
        "has_korean_name_pattern": _flag(v.rlike("^[가-힣]{2,4}$")), "is_korean_only": _flag(v.rlike("^[가-힣]+$")), "name_like_length": _flag(n.between(2, 4) & v.rlike("^[가-힣]+$")),
        "has_at_symbol": _flag(at), "has_dot_after_at": _flag(at & F.get(F.split(v, "@"), F.lit(1)).contains(".")), "email_like_length": _flag(n.between(5, 50) & at),
        "has_address_keywords": _flag(v.rlike("시|구|동|군|면|리|번지|로|길|대로")), "address_like_length": _flag((n >= 10) & v.rlike("[가-힣]")),
        "has_date_keywords": _flag(v.rlike("년|월|일")), "is_korean_date": _flag(v.rlike("[0-9]{4}년")),
        "is_length_13_14": _flag(bare.between(13, 14)), "is_length_10_11": _flag(bare.between(10, 11)), "is_length_9": _flag(bare == 9), "is_length_10_16": _flag(bare.between(10, 16)),
        "starts_with_digit": _flag(v.rlike("^[0-9]")), "ends_with_digit": _flag(v.rlike("[0-9]$")), "starts_with_letter": _flag(v.rlike(r"^\p{L}")),
        "hyphen_position_ratio": F.when(v.contains("-"), (F.instr(v, "-") - 1) / F.greatest(n, F.lit(1))).otherwise(0.0), "has_multiple_hyphens": _flag(F.regexp_count(v, F.lit("-")) >= 2),
        "starts_with_mobile_prefix": _flag(F.substring(v, 1, 3).isin(*MOBILE_PREFIXES)),
        "max_consecutive_digits": _longest(v, "[0-9]+"), "max_consecutive_letters": _longest(v, "[a-zA-Z가-힣]+"),
    }


def n_grams(v: Column, wanted: tuple[str, ...]) -> dict[str, Column]:
    """Overlapping occurrences of each wanted string."""
    every = lambda n: F.when(F.length(v) >= n, F.transform(F.sequence(F.lit(1), F.length(v) - n + 1), lambda i: F.substring(v, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    count = lambda g: F.size(F.filter(every(len(g)), lambda x: x == F.lit(g))).cast("long")
    return {f"gram_{g}": count(g) for g in wanted}


def accounts(v: Column) -> dict[str, Column]:
    """Whether a value looks like an account number of a bank, or like a phone number."""
    bare = F.replace(v, F.lit("-"), F.lit(""))
    head, n = F.substring(bare, 1, 3), F.length(bare)
    numeric = bare.rlike("^[0-9]{3}")
    bank, mobile = numeric & head.isin(*rules.BANK_CODES), numeric & head.isin(*MOBILE_PREFIXES)
    usual = F.lit(False)
    for code, digits in rules.ACCOUNT_DIGITS.items():
        usual = usual | ((head == code) & n.isin(*digits))
    special = bare.rlike(rules.SPECIAL_ACCOUNT)
    prefixed = bare.rlike("^(" + "|".join(rules.ACCOUNT_PREFIXES) + ")")
    return {
        "starts_with_bank_code": _flag(bank | special),
        "is_suspicious_01X": F.when(bank & mobile, F.when(n >= 12, -1.0).otherwise(1.0)).otherwise(0.0),
        "bank_structure_score": F.when(numeric & usual, 1.0).when(numeric & head.isin(*rules.ACCOUNT_DIGITS), 0.5).when(bank, 0.8).otherwise(0.0),
        "starts_with_acct_prefix": _flag(numeric & prefixed), "is_special_acct_pattern": _flag(special),
    }


def hyphens(v: Column) -> dict[str, Column]:
    """Digits between hyphens of three-part numbers."""
    three = v.rlike("^[0-9]+-[0-9]+-[0-9]+$")
    part = lambda k: F.when(three, F.length(F.get(F.split(v, "-"), F.lit(k)))).otherwise(0).cast("double")
    return {"is_strict_mobile_format": _flag(v.rlike(rules.STRICT_MOBILE)), "no_letters_in_acn": _flag(v.rlike("^[0-9-]+$"))} | {f"hyphen_structure_{k + 1}": part(k) for k in range(3)}
