"""Queries on value features, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import columns as C
from ..sources.derived import as_sql, view


def _features(make):
    def run(spark, d):
        v = F.trim(F.coalesce("value", F.lit("")))
        return view(spark, d, "col_values").select("k", *(c.alias(k) for k, c in make(v).items()))

    return run


_N = lambda p: f"cast(len(regexp_extract_all(v, '{p}')) as bigint)"
_IF = lambda p: f"case when regexp_matches(v, '{p}') then 1.0::double else 0.0::double end"
_WHEN = lambda t: f"case when {t} then 1.0::double else 0.0::double end"
_BARE = "len(replace(v, '-', ''))"
_PLAIN = lambda p: _WHEN(f"not contains(v, '*') and regexp_matches(v, '{p}')")
_LONGEST = lambda p: f"cast(coalesce(list_max(list_transform(regexp_extract_all(v, '{p}'), lambda x: len(x))), 0) as bigint)"
_GRAMS = ("01", "10", "com", "김철")


def _sql(columns: dict[str, str]) -> str:
    return "select k, " + ", ".join(f'{x} as "{k}"' for k, x in columns.items()) + f" from (select k, trim(coalesce(value, '')) as v from {as_sql('col_values')})"


QUERIES = {
    "col_features_basic": _features(C.basic),
    "col_features_ratio": _features(lambda v: {k: F.round(c, 6) for k, c in C.ratios(v).items()}),
    "col_features_mask": _features(C.masks),
    "col_features_pattern": _features(C.patterns),
    "col_features_shape": _features(lambda v: {k: F.round(c, 6) if k == "hyphen_position_ratio" else c for k, c in C.names_and_shapes(v).items()}),
    "col_features_ngrams": _features(lambda v: C.n_grams(v, _GRAMS)),
    "col_features_bank": _features(C.accounts),
    "col_features_hyphen": _features(C.hyphens),
}

_HEAD, _IN = "substr(replace(v, '-', ''), 1, 3)", lambda values: "(" + ", ".join(f"'{x}'" for x in values) + ")"
_NUMERIC = "regexp_matches(replace(v, '-', ''), '^[0-9]{3}')"
_BANK, _SPECIAL = f"({_NUMERIC} and {_HEAD} in {_IN(rules.BANK_CODES)})", f"regexp_matches(replace(v, '-', ''), '{rules.SPECIAL_ACCOUNT}')"
_USUAL = "(" + " or ".join(f"({_HEAD} = '{k}' and {_BARE} in ({', '.join(map(str, x))}))" for k, x in rules.ACCOUNT_DIGITS.items()) + ")"
_PART = lambda k: f"case when regexp_matches(v, '^[0-9]+-[0-9]+-[0-9]+$') then len(split_part(v, '-', {k})) else 0 end::double"

ORACLES = {
    "col_features_basic": _sql({"length": "cast(len(v) as bigint)", "num_digits": _N("[0-9]"), "num_letters": _N("[a-zA-Z가-힣]"), "num_special": _N("[^a-zA-Z0-9가-힣\\s]"), "num_spaces": _N("\\s"), "num_hyphens": _N("-"), "num_dots": _N("\\."), "num_at": _N("@"), "num_colons": _N(":")}),
    "col_features_ratio": _sql({f"{k}_ratio": f"round({_N(p)} / greatest(len(v), 1)::double, 6)" for k, p in (("digit", "[0-9]"), ("letter", "[a-zA-Z가-힣]"), ("special", "[^a-zA-Z0-9가-힣\\s]"))}),
    "col_features_mask": _sql({"has_asterisk": _IF("\\*"), "num_asterisks": f"{_N('\\*')}::double", "has_masking_pattern": _WHEN(f"{_N('\\*')} >= 2"), "has_consecutive_asterisks": _WHEN("contains(v, '**')")}),
    "col_features_pattern": _sql({
        "has_phone_pattern": _PLAIN("^0[0-9]{1,2}-?[0-9]{3,4}-?[0-9]{4}$"), "has_email_pattern": _PLAIN("^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$"), "has_pp_pattern": _PLAIN("^[A-Z][0-9]{8}$"),
        "has_ip_pattern": _PLAIN("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"), "has_date_pattern": _PLAIN("^[0-9]{4}[-/]?[0-9]{2}[-/]?[0-9]{2}$"), "has_rrn_pattern": _WHEN("not contains(v, '*') and regexp_matches(replace(v, '-', ''), '^[0-9]{13}$')"),
        "has_acn_pattern": _WHEN(f"not contains(v, '*') and regexp_matches(v, '^[0-9]{{3}}') and ((contains(v, '-') and {_BARE} between 10 and 20) or (not contains(v, '-') and len(v) between 10 and 16))"),
    }),
    "col_features_shape": _sql({
        "has_korean_name_pattern": _IF("^[가-힣]{2,4}$"), "is_korean_only": _IF("^[가-힣]+$"), "name_like_length": _WHEN("len(v) between 2 and 4 and regexp_matches(v, '^[가-힣]+$')"), "has_at_symbol": _IF("@"), "has_dot_after_at": _WHEN("contains(split_part(v, '@', 2), '.')"),
        "email_like_length": _WHEN("len(v) between 5 and 50 and contains(v, '@')"), "has_address_keywords": _IF("시|구|동|군|면|리|번지|로|길|대로"), "address_like_length": _WHEN("len(v) >= 10 and regexp_matches(v, '[가-힣]')"), "has_date_keywords": _IF("년|월|일"), "is_korean_date": _IF("[0-9]{4}년"),
        "is_length_13_14": _WHEN(f"{_BARE} between 13 and 14"), "is_length_10_11": _WHEN(f"{_BARE} between 10 and 11"), "is_length_9": _WHEN(f"{_BARE} = 9"), "is_length_10_16": _WHEN(f"{_BARE} between 10 and 16"),
        "starts_with_digit": _IF("^[0-9]"), "ends_with_digit": _IF("[0-9]$"), "starts_with_letter": _IF("^\\p{L}"), "hyphen_position_ratio": "case when contains(v, '-') then round((strpos(v, '-') - 1) / greatest(len(v), 1)::double, 6) else 0.0::double end",
        "has_multiple_hyphens": _WHEN(f"{_N('-')} >= 2"), "starts_with_mobile_prefix": _WHEN("substr(v, 1, 3) in ('010', '011', '016', '017', '018', '019', '050')"), "max_consecutive_digits": _LONGEST("[0-9]+"), "max_consecutive_letters": _LONGEST("[a-zA-Z가-힣]+"),
    }),
    "col_features_bank": _sql({
        "starts_with_bank_code": _WHEN(f"{_BANK} or {_SPECIAL}"), "is_suspicious_01X": f"case when {_BANK} and {_HEAD} in {_IN(C.MOBILE_PREFIXES)} then case when {_BARE} >= 12 then -1.0 else 1.0 end else 0.0 end::double",
        "bank_structure_score": f"case when {_NUMERIC} and {_USUAL} then 1.0 when {_NUMERIC} and {_HEAD} in {_IN(rules.ACCOUNT_DIGITS)} then 0.5 when {_BANK} then 0.8 else 0.0 end::double",
        "starts_with_acct_prefix": _WHEN(_NUMERIC + " and (" + " or ".join(f"starts_with(replace(v, '-', ''), '{p}')" for p in rules.ACCOUNT_PREFIXES) + ")"), "is_special_acct_pattern": _WHEN(_SPECIAL),
    }),
    "col_features_hyphen": _sql({"is_strict_mobile_format": _IF(rules.STRICT_MOBILE), "no_letters_in_acn": _IF("^[0-9-]+$")} | {f"hyphen_structure_{k}": _PART(k) for k in (1, 2, 3)}),
    "col_features_ngrams": _sql({f"gram_{g}": f"cast(len(list_filter(range(1, len(v) - {len(g)} + 2), lambda i: substr(v, i, {len(g)}) = '{g}')) as bigint)" for g in _GRAMS}),
}
