"""The corpus operators that SQL can express, as SQL over the same tables (DuckDB's dialect)."""

from __future__ import annotations

from collections.abc import Sequence

from .sharding import PARTS, Leaf

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _shingles(table: str, key: str) -> str:
    """(key, s): the distinct five-word shingles of a table's texts; shorter ones have their whole sequence."""
    return f"""select distinct {key}, array_to_string(w[i : i + 4], ' ') as s
        from (select {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from (select {key}, {_words(_LOWERED)} as w from {table}) where len(w) > 0)"""


NEAR_DEDUP = f"""
with recursive sets as materialized ({_shingles("documents", "doc_id")}),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as common from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as materialized (
    select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
ways as (select a, b from links union all select b, a from links),
reach as (
    select doc_id as a, doc_id as b from documents
    union
    select r.a, w.b from reach r join ways w on w.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)"""

SUBSTRINGS = f"""
with texts as materialized (select doc_id, {_words("coalesce(text, '')")} as w from documents),
windows as materialized (
    select doc_id, i, array_to_string(w[i : i + 19], ' ') as s
    from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from texts where len(w) >= 20)),
again as (select doc_id, i from windows qualify row_number() over (partition by s order by doc_id, i) > 1),
gone as materialized (select distinct doc_id, unnest(range(i, i + 20)) as p from again),
left_over as (
    select t.doc_id, string_agg(t.word, ' ' order by t.p) as kept, count(*) as n
    from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from texts) t anti join gone using (doc_id, p) group by t.doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts left join left_over using (doc_id)"""

CONTAINMENT = f"""
with docs as ({_shingles("documents", "doc_id")}), items as materialized ({_shingles("benchmark", "item_id")}),
sizes as (select item_id, count(*) as n_shingles from items group by item_id),
met as (select doc_id, item_id, count(*) as n_shared from docs join items using (s) group by 1, 2)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment
from met join sizes using (item_id) where 100 * n_shared >= 75 * n_shingles"""


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


RANKED = f"""
with texts as materialized (select doc_id, a, cast(len(a) as bigint) as n from (select doc_id, {_terms("text")} as a from documents) where len(a) > 0),
totals as materialized (select count(*) as docs, cast(sum(n) as bigint) as words from texts),
asked as materialized (select item_id, unnest(list_distinct({_terms("text")})) as term from benchmark),
held as materialized (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(a) as term from texts) semi join asked using (term) group by 1, 2, 3),
weights as (select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1))) as bigint) as w from held, totals group by term, docs),
scores as (
    select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) as bigint) as score
    from asked join held using (term) join weights using (term), totals group by 1, 2)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 10"""


def _uniform(field: str, child: int) -> str:
    at = 1 + 8 * (child % 4)
    return f"(cast(concat('0x', substring(md5(concat(k, ':{field}:{child // 4}')), {at}, 8)) as bigint) + 0.5) / 4294967296.0"


def _descent(leaves: Sequence[Leaf]) -> str:
    """The shard of the row with text k: at each node the child with the largest ln(u) / weight."""

    def best(below: Sequence[Leaf], levels: Sequence[str]) -> str:
        if not levels:
            return str(below[0].shard)
        field, weights = levels[0], {}
        for x in below:
            weights[getattr(x, field)] = weights.get(getattr(x, field), 0) + x.weight
        children = sorted(weights)
        deeper = {c: best([x for x in below if getattr(x, field) == c], levels[1:]) for c in children}
        if len(children) == 1:
            return deeper[children[0]]
        draws = ", ".join(f"ln({_uniform(field, i)}) / {float(weights[c])}" for i, c in enumerate(children))
        ways = " ".join(f"when {i + 1} then {deeper[c]}" for i, c in enumerate(children))
        return f"(case list_position([{draws}], list_max([{draws}])) {ways} end)"

    return best(leaves, ("region", "rack", "shard"))


def sharding(leaves: Sequence[Leaf], more: Sequence[Leaf]) -> str:
    """Shards, slots and sizes; the polynomial of the checksums is reduced a byte at a time."""
    remainder = "list_reduce(list_prepend(b, range(8)), lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)"
    step = "xor(a // 256, steps[1 + xor(a % 256, b)])"
    return f"""
with steps as (select list(r order by b) as steps from (select b, {remainder} as r from (select unnest(range(256)) as b))),
texts as (select doc_id, coalesce(text, '') as t, coalesce(cast(doc_id as varchar), '') as k from documents),
summed as (
    select doc_id, k, cast(octet_length(encode(t)) + 1 as bigint) as size,
        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: cast(concat('0x', x) as bigint))), lambda a, b: {step}), 4294967295) as text_crc32
    from texts, steps),
placed as (
    select doc_id, size, text_crc32, cast({_descent(leaves)} as integer) as shard, cast({_descent(more)} as integer) as grown_shard,
        cast(concat('0x', substring(md5(concat_ws(':', k, size, text_crc32)), 25, 8)) as bigint) % {PARTS} as part
    from summed)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by part, doc_id, size, text_crc32) - 1 as slot, grown_shard
from placed"""
