"""Personal data in texts: spans by detector, per-text totals, form slots, merging and decoding of model spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import rules
from ..functions.text import SPANS, held, masked, spans, strip
from .along import Along, along

CHARACTERS = 100_000  # in a piece of a unit of tokens
SURE_SPANS = "array<struct<start:int,end:int,text:string,confidence:double,method:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phones(text: Column) -> Column:
    """Phone numbers by pattern, then place; a number met before in the text (by its digits) is left out. With confidence and the pattern's method."""
    found = F.concat(*(_sure(spans(text, p), method) for p, method in zip(rules.PHONES, rules.PHONE_METHODS)))
    found = F.filter(found, lambda x: F.length(_digits(x["text"])).between(9, 11))
    new = lambda every, digits: F.filter(every, lambda x, i: F.array_position(digits, F.get(digits, i)) == i + 1)
    return held(found, lambda every: held(F.transform(every, lambda x: _digits(x["text"])), lambda digits: new(every, digits)))


def emails(text: Column) -> Column:
    """Mail addresses, then those that lost the dot before a known suffix: the dot is put back, so their text is one longer than the span. With confidence and method."""
    domain = lambda x: F.get(F.split(x["text"], "@"), F.lit(1))

    def mended(x: Column) -> Column:
        ways = lambda d: F.coalesce(*(F.when(d.endswith(k) & (F.length(d) - len(k) >= 2) & ~d.contains("."), F.concat(F.substring(x["text"], F.lit(1), F.length(x["text"]) - len(k)), F.lit(f".{k}"))) for k in rules.OCR_SUFFIXES))
        return held(domain(x), ways)

    def every(whole: Column) -> Column:
        starts = F.transform(whole, lambda x: x["start"])
        lost = held(starts, lambda known: F.filter(spans(text, rules.OCR_EMAIL), lambda x: ~F.array_contains(known, x["start"])))
        lost = F.transform(lost, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), mended(x).alias("text"), F.lit(0.95).alias("confidence"), F.lit("regex").alias("method")))
        return F.concat(_sure(whole, "regex-standard"), F.when(text.rlike(rules.OCR_EMAIL), F.filter(lost, lambda x: x["text"].isNotNull())).otherwise(F.array().cast(SURE_SPANS)))

    return F.when(text.contains("@"), held(spans(text, rules.EMAIL), every)).otherwise(F.array().cast(SURE_SPANS))


def _sure(found: Column, method: str = "regex") -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(1.0).alias("confidence"), F.lit(method).alias("method")))


def addresses(text: Column) -> Column:
    """Address candidates whose stripped text has the structure of an address; a span ends where the unstripped match ends."""

    def valid(x: Column) -> Column:
        a = x["text"]
        dense = F.replace(a, F.lit(" "), F.lit(""))
        share = F.length(F.regexp_replace(dense, "[^가-힣]", "")) / F.greatest(F.length(dense), F.lit(1))
        return (F.length(a) >= 8) & a.rlike(rules.ADDRESS_AREA) & a.rlike(rules.ADDRESS_PLACE) & (share >= 0.6) & ~a.rlike("[구시]$")

    every = F.concat(*(spans(text, p) for p in rules.ADDRESSES))
    return F.filter(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), strip(x["text"]).alias("text"))), valid)


def ips(text: Column) -> Column:
    return F.filter(spans(text, rules.IP), lambda x: F.forall(F.split(x["text"], r"\."), lambda o: o.cast("int") <= 255))


def _where(text: Column, shape: str, find, sure=_sure) -> Column:
    """Spans with confidence of a detector, for texts that hold a plain shape without which it finds nothing."""
    return F.when(text.rlike(shape), sure(find(text))).otherwise(F.array().cast(SURE_SPANS))


DETECTORS = {
    "p_rrn": lambda t: _where(t, "[0-9]{6}", lambda x: F.concat(spans(x, rules.RRN_HYPHEN), spans(x, rules.RRN_PLAIN))),
    "p_ph": lambda t: _where(t, "[0-9]{4}", phones, lambda found: found),
    "p_em": emails,
    "p_add": lambda t: _where(t, "[가-힣]{2}", addresses),
    "p_ip": lambda t: _where(t, r"[0-9]\.[0-9]", ips),
    "p_pp": lambda t: _where(t, "[0-9]{4}", lambda x: spans(x, rules.PASSPORT)),
}


def found_in(text: Column, labels: tuple[str, ...] = tuple(DETECTORS)) -> Column:
    """Array of (label, start, end, text, confidence, method) of all detectors by start, then detector; one for each label and span. Null text: empty."""
    tagged = lambda label: F.transform(DETECTORS[label](text), lambda x: F.struct(F.lit(label).alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["confidence"].alias("confidence"), x["method"].alias("method")))
    return F.array_distinct(_by_start(F.concat(*(tagged(x) for x in labels))))


def addresses_extended(text: Column, found: Column) -> Column:
    """found with addresses going on over the parts of buildings that follow them; a changed address has its whole span as text."""

    def one(x: Column) -> Column:
        end = x["end"] + F.length(F.regexp_extract(F.substring(text, x["end"] + 1, F.length(text)), rules.ADDRESS_PARTS, 0))
        longer = lambda end: x.withField("end", end).withField("text", F.when(end > x["end"], F.substring(text, x["start"] + 1, end - x["start"])).otherwise(x["text"]))
        return F.when(x["label"] == "p_add", held(end, longer)).otherwise(x)

    return F.transform(found, one)


def refined(found: Column) -> Column:
    """found without labels before values and particles after addresses; blank ones, and names that are short or hold digits or punctuation, are left out."""

    def one(x: Column) -> Column:
        label = F.coalesce(*(F.when(x["text"].rlike(p), F.regexp_extract(x["text"], p, 0)) for p in rules.VALUE_LABELS), F.lit(""))
        bare = lambda n: x.withField("start", x["start"] + n).withField("text", F.substring(x["text"], n + 1, F.length(x["text"])))
        return held(F.length(label), bare)

    def without_tail(x: Column) -> Column:
        before = lambda tail: F.substring(x["text"], F.lit(1), F.length(x["text"]) - F.length(tail))
        cut = lambda tail: tail.startswith("에") | tail.startswith("으로") | (tail.startswith("로") & before(tail).rlike(rules.ADDRESS_ROAD_PARTICLE))
        shorter = lambda tail: F.when(cut(tail), x.withField("end", x["end"] - F.length(tail)).withField("text", before(tail))).otherwise(x)
        return F.when(x["label"] == "p_add", held(F.regexp_extract(x["text"], rules.ADDRESS_PARTICLE, 0), shorter)).otherwise(x)

    def kept(x: Column) -> Column:
        good = lambda bare: (bare != "") & ~((x["label"] == "p_nm") & ((F.length(bare) <= 1) | bare.rlike(rules.NO_NAME)))
        return held(strip(x["text"]), good)

    return F.filter(F.transform(F.transform(found, one), without_tail), kept)


ENTITIES = "array<struct<label:string,start:int,end:int,text:string,confidence:double,method:string>>"


def _entity(label, x: Column, confidence, method) -> Column:
    return F.struct(F.lit(label).alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(confidence).cast("double").alias("confidence"), F.lit(method).cast("string").alias("method"))


def _by_start(every: Column) -> Column:
    """Entities by start; those that start together stay in their order."""
    keyed = F.transform(every, lambda x, i: F.struct(x["start"].alias("start"), i.alias("place"), x.alias("entity")))
    return F.transform(F.array_sort(keyed), lambda x: x["entity"])


def united(found: Column, names: Column, model: Column | None = None) -> Column:
    """Entities of patterns and names by context, all of them, and the model's spans (label, start, end, text, confidence) that overlap none of these nor a model's span before; by start."""
    every = F.concat(found, F.transform(names, lambda n: _entity("p_nm", n, *rules.CONTEXT_NAME)))
    if model is not None:
        clash = lambda kept, m: F.exists(kept, lambda x: (m["start"] < x["end"]) & (x["start"] < m["end"]))
        one = lambda m: F.array(F.struct(m["label"].alias("label"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["confidence"].alias("confidence"), F.lit(rules.MODEL).alias("method")))
        every = F.aggregate(F.coalesce(model, F.slice(model, 1, 0), F.array()), every.cast(ENTITIES), lambda kept, m: F.when(clash(kept, m), kept).otherwise(F.concat(kept, one(m))))
    return _by_start(every)


def stretched(text: Column, patterns: Column, model: Column | None = None) -> Column:
    """Entities of patterns united with names by context and the model's spans, short names and addresses made longer."""
    return addresses_extended(text, lengthened(text, united(patterns, names_by_context(text), model)))


def detected(rows: DataFrame, known: Column | None = None, model: Column | None = None) -> DataFrame:
    """rows (text, ..) with found, the entities of the whole chain: patterns, names by context and the model's spans united; short names and addresses
    made longer; further places of these names and of names known from elsewhere (an array of texts); refinement. Further places
    come after the others. Null text: empty."""
    text = F.col("text")
    rows = rows.withColumn("_every", stretched(text, found_in(text), model))
    names = F.transform(F.filter("_every", lambda x: x["label"] == "p_nm"), lambda x: x["text"])
    rows = rows.withColumn("_terms", name_terms(names if known is None else F.concat(names, F.coalesce(known, F.array().cast("array<string>")))))
    again = F.transform("_again", lambda x: _entity("p_nm", x, rules.KNOWN_NAME, None))
    return with_places(rows).withColumn("found", refined(F.concat("_every", again))).drop("_every", "_terms", "_again")


def detected_in_units(units: DataFrame, model: str | None = None) -> DataFrame:
    """units (doc_id, ord, text, ..) with found: entities of each unit, names of a document's earlier units being known to it.

    What a unit adds to the known names doesn't depend on earlier units, as further places have the texts of known ones: names are
    gathered at once, each with the first unit that has it, and join the units as one array for each document. model: a column of
    model's spans. Units with the same ord don't know each other's names; a null doc_id or ord knows none.
    """
    spans_of = F.col(model) if model else None
    patterns = found_in(F.col("text")) if model else F.array().cast(ENTITIES)  # without a model names don't depend on other entities
    own = units.select("doc_id", "ord", F.explode(refined(stretched(F.col("text"), patterns, spans_of))).alias("_x")).where("_x.label = 'p_nm'")
    first = own.groupBy("doc_id", F.col("_x.text").alias("name")).agg(F.min("ord").alias("since"))
    names = first.groupBy("doc_id").agg(F.collect_list(F.struct("name", "since")).alias("_names"))
    earlier = lambda x: x["since"] < F.col("ord")
    known = F.transform(F.filter("_names", earlier), lambda x: x["name"])
    return detected(units.join(names, "doc_id", "left"), known, spans_of).drop("_names")


def known_before(units: DataFrame) -> DataFrame:
    """units (doc_id, ord, names array) with the names of all earlier units of the document, in order and once each, as known."""
    earlier = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return units.withColumn("known", F.array_sort(F.array_distinct(F.flatten(F.collect_list("names").over(earlier)))))


def entities(units: DataFrame, text: str = "text", labels: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """One row for each entity of each unit: the other columns of units, and label, start, end, text, code. Texts are read once."""
    keep = [c for c in units.columns if c != text]
    rows = units.select(*keep, F.explode(found_in(F.col(text), labels)).alias("_e")).select(*keep, "_e.*")
    return rows.withColumn("code", code(F.col("label")))


def code(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in rules.CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, label), label)


def mask_entities(units: DataFrame, labels: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """units with text masked."""
    return units.withColumn("text", masked(F.col("text"), found_in(F.col("text"), labels)))


def mask_lines(units: DataFrame, labels: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """units with text masked line by line; a line with an entity also loses the blanks at its ends."""

    def one(line: Column) -> Column:
        starred = lambda bare: held(found_in(bare, labels), lambda found: F.when(F.size(found) > 0, masked(bare, found)).otherwise(line))
        return held(strip(line), starred)

    return units.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), one), "\n"))


def slots(forms: DataFrame) -> DataFrame:
    """(doc_id, line_ord, code, value): labelled fields of form lines; the first keyword that fits a line decides."""
    lines = forms.where(F.col("text").rlike("[가-힣]|e-mail")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "line")).where(F.col("line").contains(":"))
    choices = []
    for field, keywords in rules.FIELDS.items():
        for k in keywords:
            rest = F.expr(f"substring(line, instr(line, '{k}') + {len(k)})")
            value = strip(F.regexp_replace(rest, "^[ :\t]+", ""))
            choices.append(F.when(F.col("line").contains(f"{k}:") | F.col("line").contains(f"{k} :"), F.struct(F.lit(field).alias("code"), value.alias("value"))))
    slot = F.explode(F.array(F.coalesce(*choices))).alias("slot")  # worked out once, whatever is asked of it later
    return lines.select("doc_id", "line_ord", slot).select("doc_id", "line_ord", "slot.code", "slot.value").where("code is not null")


def is_masked(value: Column) -> Column:
    """Blank values, and values of a masked shape in which no detector finds anything; of such shapes only phone numbers can be found."""
    shape = F.lit(False)
    for p in rules.MASKED_SHAPES:
        shape = shape | value.rlike(p)
    return (value == "") | (shape & (F.size(found_in(value, ("p_ph",))) == 0))


def scan_rollup(forms: DataFrame) -> DataFrame:
    """(doc_id, code, total_count, masked_count) over detected entities and masked form slots."""
    total = entities(forms.select("doc_id", "text")).select("doc_id", "code", F.lit(1).alias("t"), F.lit(0).alias("m"))
    blank = slots(forms).where(is_masked(F.col("value"))).select("doc_id", "code", F.lit(0).alias("t"), F.lit(1).alias("m"))
    return total.unionByName(blank).groupBy("doc_id", "code").agg(F.sum("t").alias("total_count"), F.sum("m").alias("masked_count"))


def confident(spans_: DataFrame) -> DataFrame:
    """Spans whose confidence reaches the threshold of their label."""
    known = F.create_map(*(F.lit(x) for pair in rules.THRESHOLDS.items() for x in pair))
    return spans_.where(F.col("confidence") >= F.coalesce(F.try_element_at(known, F.col("label")), F.lit(rules.DEFAULT_THRESHOLD)))


def not_overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (unit, s, e, ..) that overlap no row of right in the same unit; rows of left with a null unit, start or end overlap none.

    A sweep over each unit, no pairs: a span overlaps another if the largest end among those that start before its own end lies behind its
    start. One row of each side goes in, one comes out, however many spans a unit has.
    """
    sweep = W.partitionBy("_unit").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    none = F.lit(None)
    rows = left.select(F.col("unit").alias("_unit"), F.col("e").alias("_at"), F.lit(0).alias("_side"), none.cast(right.schema["e"].dataType).alias("_end"), F.struct(*left.columns).alias("_row"))
    other = right.where("unit is not null and s is not null and e is not null").select(F.col("unit").alias("_unit"), F.col("s").alias("_at"), F.lit(1).alias("_side"), F.col("e").alias("_end"), none.cast(rows.schema["_row"].dataType).alias("_row"))
    swept = rows.unionByName(other).withColumn("_end", F.max("_end").over(sweep)).where("_side = 0")
    return swept.where(F.col("_unit").isNull() | ~F.coalesce(F.col("_end") > F.col("_row.s"), F.lit(False))).select("_row.*")


def bio_spans(tokens: DataFrame) -> DataFrame:
    """(unit, s, e, label, confidence) of tagged token runs. Starts don't fall along a unit's tokens, so they cut long units into pieces of CHARACTERS."""
    label = F.substring("tag", 3, 100)

    def run(rows: DataFrame, way: Along) -> DataFrame:
        rows = way.before(rows, "_before", F.col("tag"))
        before = F.col("_before")
        opens = F.col("tag").startswith("B-") | (F.col("tag").startswith("I-") & (before.isNull() | (before == "O") | (F.substring(before, 3, 100) != F.col("label"))))
        return way.total(rows, "_span", opens)

    rows = along(tokens.withColumn("label", label), "unit", ["ord"], run, CHARACTERS, "s").where("tag <> 'O'")
    return rows.groupBy("unit", "_span").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("label").alias("label"), F.avg("prob").alias("confidence")).drop("_span")


def span_stats(spans_: DataFrame) -> DataFrame:
    """(label, method, n, avg_confidence); a missing method counts as the model's."""
    return spans_.groupBy("label", F.coalesce("method", F.lit("koelectra")).alias("method")).agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def media_of(path: Column) -> Column:
    """Media kind by lower-cased extension; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"[^./](\.[^./]*)$", 1))
    return F.coalesce(*(F.when(suffix.isin(*x), k) for k, x in rules.MEDIA.items()))


def names_by_context(text: Column) -> Column:
    """Array of (start, end, text): names after a label, with the offsets of the name alone."""

    def own(pattern: str, name: str) -> Column:
        n = lambda x: F.length(F.regexp_extract(x["text"], f"({name})$", 1))
        cut = lambda x: F.struct((x["end"] - n(x)).alias("start"), x["end"].alias("end"), F.right(x["text"], n(x)).alias("text"))
        return F.transform(spans(text, pattern), cut)

    return F.concat(own(rules.NAME_AFTER_LABEL, "[가-힣]{2,4}"), own(rules.NAME_AFTER_NAME, "[가-힣a-zA-Z]{2,20}"))


def lengthened(text: Column, found: Column) -> Column:
    """Entities, names of two characters among them with the Hangul character after them, unless it is a particle or title."""

    def one(x: Column) -> Column:
        after = F.substring(text, x["end"] + 1, F.lit(1))
        short = (x["label"] == "p_nm") & (F.length(strip(x["text"])) == 2)
        longer = lambda c: F.when(c.rlike("^[가-힣]$") & ~c.rlike(f"[{rules.NAME_STOPS}]"), x.withField("end", x["end"] + 1).withField("text", F.concat(x["text"], c))).otherwise(x)
        return F.when(short, held(after, longer)).otherwise(x)

    return F.transform(found, one)


def name_terms(names: Column) -> Column:
    """What known names are searched by, each once and in order: the last two characters of longer ones, names of two as they are."""
    bare = F.filter(F.transform(names, strip), lambda x: F.length(x) >= 2)
    return F.array_sort(F.array_distinct(F.transform(bare, lambda x: F.right(x, F.lit(2)))))


def places_in(text: str, terms: list[str], taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of all terms in a text, found in one pass by an automaton of them; in order of term, then place.

    Places of one term don't overlap each other. A place that overlaps one of taken, or a place kept before, is left out.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        automaton.add_word(t, (k, t))
    automaton.make_automaton()
    covered = bytearray(len(text) + 1)
    for a, b in taken:
        covered[a:b] = b"\1" * len(covered[a:b])
    out, free = [], [0] * len(terms)  # from where on a term's next place may start
    for k, start, t in sorted((k, end + 1 - len(t), t) for end, (k, t) in automaton.iter(text)):
        if start >= free[k]:
            free[k] = end = start + len(t)
            if not any(covered[start:end]):
                covered[start:end] = b"\1" * len(t)
                out.append((start, end, t))
    return out


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text, terms, every in zip(*(batch.column(c) for c in ("text", "_terms", "_every"))):
            words = terms.as_py() if text.is_valid else None
            taken = [(x["start"], x["end"]) for x in every.as_py() or ()] if words else []
            found.append([{"start": a, "end": b, "text": t} for a, b, t in places_in(text.as_py(), words, taken)] if words else [])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "_again"])


_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())])


def with_places(rows: DataFrame) -> DataFrame:
    """rows (text, _terms, _every, ..) with _again: places of the terms in the text that overlap no entity of _every, by places_in."""
    return rows.mapInArrow(_with_places, StructType([*rows.schema.fields, StructField("_again", ArrayType(_SPAN))]))


def names_after_label_blocks(units: DataFrame) -> DataFrame:
    """(doc_id, ord, text): units that are a Hangul name of two to four characters right after a short unit that holds a name label."""
    bare = F.replace(F.col("text"), F.lit(" "), F.lit(""))
    label = (F.length(bare) < 20) & bare.rlike("|".join(rules.NAME_LABELS))
    rows = units.withColumn("_label", F.lag(label).over(W.partitionBy("doc_id").orderBy("ord")))
    return rows.where(F.col("_label") & bare.rlike("^[가-힣]{2,4}$") & ~bare.rlike("|".join(rules.NOT_NAMES))).select("doc_id", "ord", "text")


def _disjoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in the order of unit, start and end, less the spans that start before the end of the last one kept of their unit."""
    unit, end = None, None
    for batch in batches:
        kept = []
        for i, (u, s, e) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            if u != unit or end is None or s >= end:
                kept.append(i)
                unit, end = u, e
        yield batch.take(pa.array(kept, pa.int64()))


def greedy_spans(spans_: DataFrame) -> DataFrame:
    """(unit, s, e): by start, then end, spans that start at or behind the end of the last one kept; spans with a null or an end before their start are left out. One pass over the sorted spans of many units, of which only the last end is kept."""
    rows = spans_.select("unit", "s", "e").where("s <= e")
    return rows.repartition("unit").sortWithinPartitions("unit", "s", "e").mapInArrow(_disjoint, rows.schema)
