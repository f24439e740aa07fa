"""Page blocks and lines of legal texts: noise removal, line repair, chunking."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions import rules
from ..functions.text import joined_in_order, strip
from .along import Along, along

PAGES = 200  # in a piece of a law
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # what strip cuts


def blocks(docs: DataFrame, per_page: int = 20) -> DataFrame:
    """(doc_id, ord, page, y0, y1, text): the lines of texts laid out on pages of height per_page + 2, with one header block on each page."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("_k", "text"))
    body = lines.select("doc_id", (F.col("_k") * 2 + 1).alias("ord"), (1 + F.floor(F.col("_k") / per_page)).cast("int").alias("page"), (F.col("_k") % per_page + 1).cast("double").alias("y0"), (F.col("_k") % per_page + 2).cast("double").alias("y1"), "text")
    head = lines.where(F.col("_k") % per_page == 0).select("doc_id", (F.col("_k") * 2).alias("ord"), (1 + F.floor(F.col("_k") / per_page)).cast("int").alias("page"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"), F.concat(F.lit("Report  "), "source").alias("text"))
    return body.unionByName(head)


def _inside(height: float, top: float, bottom: float) -> Column:
    return F.coalesce((F.col("y1") > top * height) & (F.col("y0") < bottom * height), F.lit(False))


def without_margins(rows: DataFrame, height: float, top: float = rules.TOP_SHARE, bottom: float = rules.BOTTOM_SHARE) -> DataFrame:
    """Blocks that lie in neither margin of their page; blocks without a place count as margin."""
    return rows.where(_inside(height, top, bottom))


def normalized(text: Column) -> Column:
    """Text for comparison between pages: one space for white space, page numbers blanked, lower case."""
    t = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"^\s*[-–—]?\s*[0-9]+\s*[-–—]?\s*$", "")
    return strip(F.lower(F.regexp_replace(t, r"(?i)^(page\s*)?[0-9]+\s*(of\s*[0-9]+)?$", "")))


def _least_pages(pages: Column, share: float) -> Column:
    return F.greatest(F.lit(2), F.floor(pages * share)).cast("long")


def repeated(rows: DataFrame, share: float = rules.REPEAT_SHARE, longest: int = rules.REPEAT_LONGEST) -> DataFrame:
    """(doc_id, norm) of short texts, other than beginnings of structural units, on a large share of a document's pages that have blocks."""
    pages = rows.groupBy("doc_id").agg(_least_pages(F.count_distinct("page"), share).alias("least"))
    loose = rows.where(~strip(F.col("text")).rlike(rules.STRUCTURE)).select("doc_id", "page", normalized(F.col("text")).alias("norm"))
    seen = loose.where((F.col("norm") != "") & (F.length("norm") <= longest))
    counts = seen.distinct().groupBy("doc_id", "norm").agg(F.count("*").alias("n"))
    return counts.join(pages, "doc_id").where("n >= least").select("doc_id", "norm")


def without_repeated(rows: DataFrame) -> DataFrame:
    norm = rows.withColumn("norm", normalized(F.col("text")))
    loose = repeated(rows).select(F.col("doc_id").alias("_d"), F.col("norm").alias("_n"))
    away = (F.col("doc_id") == F.col("_d")) & (F.col("norm") == F.col("_n")) & ~strip(F.col("text")).rlike(rules.STRUCTURE)
    return norm.join(loose, away, "left_anti").drop("norm")


def without_noise(rows: DataFrame, height: float, top: float = rules.TOP_SHARE, bottom: float = rules.BOTTOM_SHARE) -> DataFrame:
    """Blocks outside of the margins whose text isn't repeated among those."""
    return without_repeated(without_margins(rows, height, top, bottom))


def noise_counters(rows: DataFrame, height: float, top: float = rules.TOP_SHARE, bottom: float = rules.BOTTOM_SHARE, share: float = rules.REPEAT_SHARE) -> DataFrame:
    """(doc_id and seven counters) of what without_noise removes from each document, removed blocks and repeated texts both.

    total_pages and repeated_threshold_pages count pages of all blocks. Blocks that stay are counted by their text, so those that are
    alike meet the repeated texts as one row. Documents are those with blocks; null is one of them and has no repeated texts.
    """
    inside = _inside(height, top, bottom)
    raw = rows.groupBy("doc_id").agg(F.count_distinct("page").alias("total_pages"), F.count("*").alias("raw_blocks"), F.count_if(~inside).alias("removed_by_position"), F.count_if(inside).alias("kept_after_position"))
    kept = without_margins(rows, height, top, bottom)
    alike = kept.where(~strip(F.col("text")).rlike(rules.STRUCTURE)).groupBy("doc_id", normalized(F.col("text")).alias("norm")).agg(F.count("*").alias("n"))
    gone = repeated(kept, share).join(alike, ["doc_id", "norm"]).groupBy("doc_id").agg(F.count("*").alias("repeated_text_count"), F.sum("n").alias("_gone"))
    counts = raw.join(gone, "doc_id", "left").fillna(0, ["repeated_text_count", "_gone"])
    return counts.withColumns({"kept_after_repeat": F.col("kept_after_position") - F.col("_gone"), "repeated_threshold_pages": _least_pages(F.col("total_pages"), share)}).drop("_gone")


def page_texts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "page").agg(joined_in_order(F.col("ord"), F.col("text")).alias("text"))


def soft_breaks(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, part, text): lines joined where a break was only one of layout; lines: doc, ord, line.

    A line goes on unless it or the one before is blank, it begins a structural unit, or the one before ends a sentence. A null line is a blank one.
    """
    edge = r"[A-Za-z0-9가-힣]"

    def run(rows: DataFrame, way: Along) -> DataFrame:
        rows = way.before(rows, "_before", F.col("_line"))
        line, before = F.col("_line"), F.col("_before")
        fresh = before.isNull() | (line == "") | (before == "") | line.rlike(rules.STRUCTURE) | before.rlike(rules.SENTENCE_END)
        glue = F.when(F.col("_fresh"), "").when(before.rlike(f"{edge}$") & line.rlike(f"^{edge}"), " ").otherwise("")
        rows = rows.withColumn("_fresh", fresh).withColumn("_text", F.concat(glue, line))
        return way.total(rows, "part", F.col("_fresh")).select(doc, "ord", "part", "_text")

    rows = along(lines.select(doc, "ord", F.coalesce(strip(F.col("line")), F.lit("")).alias("_line")), doc, ["ord"], run)
    return rows.groupBy(doc, "part").agg(joined_in_order(F.col("ord"), F.col("_text"), "").alias("text"))


def article_chunks(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, chunk, article, n_lines, text): lines of each article; lines before the first article are dropped."""
    head = F.regexp_extract("line", rules.ARTICLE, 0)
    rows = lines.select(doc, "ord", "line", F.when(head != "", F.regexp_replace(head, r"\s", "")).alias("_a"))
    rows = along(rows, doc, ["ord"], lambda x, way: way.total(x, "chunk", F.col("_a").isNotNull())).where("chunk > 0")
    return rows.groupBy(doc, "chunk").agg(F.max("_a").alias("article"), F.count("*").alias("n_lines"), joined_in_order(F.col("ord"), F.col("line")).alias("text"))


class _Cutter:
    """Cuts the joined pages of one document as they come: pieces of CHUNK characters, drawn out to the next sentence end near by, that overlap; short ones are left out. Only the text from the next start on is held."""

    def __init__(self, doc):
        self.doc, self.held, self.blank, self.start, self.n = doc, "", "", 0, 0  # blank: white space that may be the end of the text
        self.end, self.places, self.page, self.empty = 0, deque(), None, True

    def add(self, page, text: str) -> Iterator[tuple]:
        self.places.append((self.end, page))
        self.end += len(text) + 2
        text = self.blank + text if self.empty else f"{self.blank}\n\n{text}"
        if self.start == 0 and not self.held:
            text = text.lstrip(_SPACES)
        self.empty = False
        bare = text.rstrip(_SPACES)
        self.held, self.blank = (self.held + bare, text[len(bare) :]) if bare else (self.held, text)
        return self._pieces(rules.CHUNK + rules.CHUNK_REACH + 1)

    def last(self) -> Iterator[tuple]:
        return self._pieces(1)

    def _pieces(self, least: int) -> Iterator[tuple]:
        held, at = self.held, 0  # at: the next start's place in what is held
        while len(held) - at >= least:
            end = min(at + rules.CHUNK, len(held))
            if end < len(held):
                reach = held[end : end + rules.CHUNK_REACH]
                end += next((k + 1 for k, c in enumerate(reach) if c in rules.CHUNK_ENDS), 0)
            piece = held[at:end].strip()
            if len(piece) < rules.CHUNK_LEAST:
                at += rules.CHUNK
                continue
            self.n += 1
            start = self.start + at
            while self.places and self.places[0][0] <= start:
                page = self.places.popleft()[1]
                self.page = self.page if page is None else page
            yield self.doc, self.n, start, self.page, piece
            at = end - rules.CHUNK_OVERLAP if end - rules.CHUNK_OVERLAP > at else end
        self.held, self.start = held[at:], self.start + at


def _cut_all(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for batch in batches:
            rows = []
            for doc, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                if cutter is None or doc != cutter.doc:
                    rows.extend(cutter.last() if cutter else ())
                    cutter = _Cutter(doc)
                rows.extend(cutter.add(page, text))
            yield _batch(rows, schema)
        yield _batch(list(cutter.last()) if cutter else [], schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def fixed_chunks(pages: DataFrame) -> DataFrame:
    """(doc_id, chunk, start, page, text) of the joined pages (doc_id, page, text) of each document.

    A chunk's page is the last one that begins at or before its start; pages are placed before blanks at the ends of the whole text are cut.
    One pass over the sorted pages, of which a task holds what the next chunk needs; pages without a text are none.
    """
    rows = pages.select("doc_id", "page", "text").where("doc_id is not null and text is not null")
    kind = lambda c: pages.schema[c].dataType
    schema = StructType().add("doc_id", kind("doc_id")).add("chunk", IntegerType()).add("start", IntegerType()).add("page", kind("page")).add("text", StringType())
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page", "text").mapInArrow(_cut_all(kinds), schema)


def dictionary_entries(lines: DataFrame) -> DataFrame:
    """(doc, block, abbr, korean, english, description, text): five-line records of column dictionaries; lines: doc, ord, line.

    A block begins with five lines that hold all headers and ends before the next header or a line like `3.1`. Records
    begin at an abbreviation that no abbreviation follows; what fits nowhere is skipped line by line.
    """
    by = W.partitionBy("doc").orderBy("ord")
    n = len(rules.DICTIONARY_HEADERS)
    near = F.collect_list("line").over(by.rowsBetween(0, n - 1))
    holds = lambda h: F.exists(near, lambda x: x.contains(h))
    header = reduce(and_, map(holds, rules.DICTIONARY_HEADERS)) & (F.size(near) == n)
    rows = lines.withColumns({"_at": F.row_number().over(by), "_head": header})
    rows = rows.withColumns({"block": F.count_if("_head").over(by), "_from": F.max(F.when(F.col("_head"), F.col("_at"))).over(by)}).where(F.col("_at") >= F.col("_from") + n)
    section = F.max(F.col("line").rlike(r"^[0-9]+\.[0-9]+").cast("int")).over(W.partitionBy("doc", "block").orderBy("ord"))
    rows = rows.withColumn("_gone", section).where("_gone = 0").groupBy("doc", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("l"))
    abbr = lambda i: F.get("l", i).rlike("^[A-Z]{1,10}$")
    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("picks"))

    def step(done: Column, i: Column) -> Column:
        pick = (i >= done["next"]) & abbr(i) & ~abbr(i + 1)
        return F.struct(F.when(pick, i + n).otherwise(done["next"]).alias("next"), F.when(pick, F.concat(done["picks"], F.array(i))).otherwise(done["picks"]).alias("picks"))

    picks = F.aggregate(F.sequence(F.lit(0), F.size("l") - n), zero, step, lambda x: x["picks"])
    found = rows.where(F.size("l") >= n).select("doc", "block", "l", F.explode(picks).alias("i"))
    field = {k: F.get("l", F.col("i") + j).alias(k) for j, k in enumerate(("abbr", "korean", "english", "description"))}
    out = found.select("doc", "block", *field.values())
    return out.withColumn("text", F.format_string("%s(%s)은 %s을 의미한다. 데이터베이스 표준 약어는 %s이다.", "korean", "english", "description", "abbr"))


def law_mark(line: Column) -> Column:
    """(kind, mark) of a line of a law that begins an article, paragraph, item or subitem, in one spelling; nulls for other lines."""
    found = {k: F.regexp_extract(line, p, 1) for k, p in rules.LAW_LINES.items()}
    bare = {k: F.regexp_replace(x, r"\s+", "") for k, x in found.items()}
    circle = F.array_position(F.array(*(F.lit(c) for c in rules.CIRCLES)), bare["paragraph"])
    spelled = {
        "article": bare["article"],
        "paragraph": F.when(bare["paragraph"].startswith("제"), bare["paragraph"]).otherwise(F.concat(F.lit("제"), circle.cast("string"), F.lit("항"))),
        "item": F.concat(F.lit("제"), bare["item"], F.lit("호")),
        "subitem": F.concat(bare["subitem"], F.lit("목")),
    }
    return F.coalesce(*(F.when(found[k] != "", F.struct(F.lit(k).alias("kind"), spelled[k].alias("mark"))) for k in rules.LAW_LINES))


def law_line(line: Column) -> Column:
    """A line of a law with its mark in one spelling and one space behind it; lines of a mark alone, and others, stay."""
    shown = line
    for pattern in reversed(rules.LAW_LINES.values()):
        mark = F.regexp_extract(line, pattern, 0)
        rest = strip(F.substring(line, F.length(mark) + 1, F.length(line)))
        shown = F.when((mark != "") & (rest != ""), F.concat(F.regexp_replace(mark, r"\s+", ""), F.lit(" "), rest)).when(mark != "", line).otherwise(shown)
    return shown


def law_chunks(pages: DataFrame, least: float = rules.CHUNKS_A_PAGE) -> DataFrame:
    """(doc_id, chunk, article, page, text) of the pages (doc_id, page, text) of laws: one chunk for each article, from the page it begins on.

    Marked lines before the first article, and what follows them, are a chunk without article; lines before any mark and blank
    lines are dropped. Documents with fewer chunks than least for each page, null and empty ones among them, are cut by fixed_chunks instead, whose chunks are
    labelled with their number in place of an article.
    Lines are numbered within a document; pages of equal number are read as one.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\R|[\x1c-\x1e]")).alias("_k", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    mark = law_mark(F.col("line"))
    rows = lines.withColumns({"_head": F.when(mark["kind"] == "article", mark["mark"]), "_mark": mark.isNotNull()})
    run = lambda x, way: way.most(way.total(x, "_part", F.col("_head").isNotNull()), "_begun", F.col("_mark"))
    rows = along(rows, "doc_id", ["page", "_k"], run, PAGES).where("_begun")
    shown = joined_in_order(F.struct("page", "_k"), law_line(F.col("line")))
    chunks = rows.groupBy("doc_id", "_part").agg(F.max("_head").alias("article"), F.min("page").alias("page"), shown.alias("text"))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("_pages")).join(chunks.groupBy("doc_id").agg(F.count("*").alias("_chunks")), "doc_id", "left")
    thin = counts.where(F.coalesce("_chunks", F.lit(0)) < least * F.col("_pages")).select("doc_id")
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("_part"))
    articles = chunks.join(thin, "doc_id", "left_anti").select("doc_id", number.alias("chunk"), "article", "page", "text")
    fixed = fixed_chunks(pages.join(thin, "doc_id", "left_semi"))
    return articles.unionByName(fixed.select("doc_id", "chunk", F.format_string(rules.PIECE_LABEL, "chunk").alias("article"), "page", "text"))


def law_pieces(pages: DataFrame, paths: DataFrame, least: float = rules.CHUNKS_A_PAGE) -> DataFrame:
    """The rows of law_chunks with the (title, law_name, effective_date) of their document, from its path (doc_id, path) and the text of its first page.

    Documents are met by id; pieces of a document without a path, or without an id, have no metadata.
    """
    first = pages.groupBy("doc_id").agg(F.min_by("text", "page").alias("_head"))
    about = paths.dropDuplicates(["doc_id"]).join(first, "doc_id").select("doc_id", law_metadata(F.col("path"), F.coalesce("_head", F.lit(""))).alias("_m"))
    return law_chunks(pages, least).join(about, "doc_id", "left").select("doc_id", "chunk", "article", "page", "text", "_m.*")


def law_metadata(path: Column, text: Column) -> Column:
    """(title, law_name, effective_date) of a law's file from its path and the text of its first page."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    title = F.when(path.rlike("^https?://"), path).otherwise(strip(F.replace(F.replace(name, F.lit(".pdf"), F.lit("")), F.lit(".PDF"), F.lit(""))))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, rules.LAW_HEAD_LINES), strip)
    names = F.filter(F.transform(lines, lambda x: strip(F.regexp_extract(x, rules.LAW_NAME, 1))), lambda x: x != "")
    least, most = rules.LAW_NAME_LENGTHS
    fitting = F.filter(names, lambda x: F.length(x).between(least, most))
    law = F.coalesce(F.get(fitting, F.lit(0)), F.get(names, F.size(names) - 1), title)
    found = F.concat(*(F.regexp_extract_all(text, F.lit(f"{w}{rules.DATE}"), F.lit(0)) for w in (*(f"{w}.*?" for w in rules.DATE_WORDS), "")))
    part = lambda x, i: F.regexp_extract(x, f"{rules.DATE}$", i)
    valid = F.filter(found, lambda x: part(x, 1).cast("int").between(1900, 2100) & part(x, 2).cast("int").between(1, 12) & part(x, 3).cast("int").between(1, 31))
    dates = F.transform(valid, lambda x: F.concat_ws("-", part(x, 1), F.lpad(part(x, 2), 2, "0"), F.lpad(part(x, 3), 2, "0")))
    return F.struct(title.alias("title"), law.alias("law_name"), F.array_max(dates).alias("effective_date"))


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_ord, text): stripped lines that are not blank, with their place among all lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "line"))
    return lines.select("doc_id", "line_ord", strip(F.col("line")).alias("text")).where("text <> ''")
