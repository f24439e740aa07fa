"""Conversation memory, question tiers, score lines, routing between dialogue steps, answer checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import joined_in_order, strip, words


def last_messages(turns: DataFrame, n: int = rules.MESSAGES) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def answers(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): assistant turns with the user turn right before."""
    by = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("answer"), F.lag("text").over(by).alias("question"), F.lag("role").over(by).alias("_before"))
    return rows.where("role = 'assistant' and _before = 'user'").select("conv_id", "turn", "question", "answer")


def overlap(question: Column, answer: Column) -> Column:
    """Share of the question's distinct words that the answer holds."""
    q = F.array_distinct(words(question))
    return F.size(F.array_intersect(q, words(answer))) / F.greatest(F.size(q), F.lit(1))


def repeats_itself(answer: Column) -> Column:
    """More than one and a half sentences for each distinct one."""
    parts = F.filter(F.transform(F.split(answer, "[.!?\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.size(parts) > 1.5 * F.size(F.array_distinct(parts))


def question_tier(question: Column) -> Column:
    low = F.lower(question)
    has = lambda keywords: low.rlike("|".join(keywords))
    return (
        F.when(low.rlike(rules.NOT_DB) & has(rules.NOT_DB_WORDS) | low.rlike(rules.NOT_FILE) & has(rules.NOT_FILE_WORDS), "db_query")
        .when(low.rlike(rules.LAW_QUESTIONS), F.when(has(rules.OPERATION_WORDS), "both").otherwise("vector_search"))
        .when(low.rlike(rules.ARTICLE_NUMBER), "vector_search")
        .when(has(rules.SYSTEM_WORDS), F.when(has(rules.LAW_WORDS), "both").otherwise("db_query"))
        .when(has(rules.RULE_WORDS), "vector_search")
        .when(has(rules.DATA_WORDS), "db_query")
        .otherwise("general")
    )


def expanded(question: Column, version: Column) -> Column:
    a, b, c = rules.EXPANSIONS
    return F.concat(question, F.when(version == 1, a).when(version == 2, b).otherwise(c))


def score_of(reply: Column) -> Column:
    """The number of the first score line that has one, within 0 to 1; else 0."""
    lines = F.filter(F.split(reply, "\n"), lambda x: x.contains("점수") & x.rlike("[0-9]"))
    number = F.regexp_extract(F.get(lines, F.lit(0)), r"[0-9]+\.?[0-9]*", 0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number.try_cast("double"), F.lit(0.0))))


def after_question(kind: Column) -> Column:
    return F.when(kind == "general", "generate_answer").when(kind == "both", "both_query").otherwise(kind)


def after_relevance(relevant: Column, score: Column, retries: Column) -> Column:
    return F.when(relevant & (score >= rules.RELEVANCE), "rerank").when(retries < rules.SEARCH_RETRIES, "vector_search").otherwise("generate_answer")


def after_grounding(grounded: Column, score: Column, retries: Column) -> Column:
    return F.when(~(grounded & (score >= rules.GROUNDING)) & (retries < rules.GENERATION_RETRIES), "generate_answer").otherwise("multi_aspect_evaluation")


def counter(left: Column, right: Column) -> Column:
    return F.when(right == 0, 0).when(left == 0, right).otherwise(F.greatest(left, right))


def merged_memory(left: Column, right: Column) -> Column:
    """Values of both maps by key, without repeats, ordered."""
    return F.map_zip_with(left, right, lambda _, a, b: F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))))


def plain_text(answer: Column) -> Column:
    """An answer without marks of emphasis, code, headings, links and strike-through."""
    for pattern, kept in (
        (r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1"), (r"(?<!_)_(?!_)(.+?)(?<!_)_(?!_)", "$1"),
        (r"`(.+?)`", "$1"), (r"(?m)^#+\s+", ""), (r"\[(.+?)\]\(.+?\)", "$1"), (r"~~(.+?)~~", "$1"),
    ):
        answer = F.regexp_replace(answer, pattern, kept)
    return strip(answer)


def answer_issues(question: Column, answer: Column) -> Column:
    """Codes of what is wrong with an answer, in order; none for an empty one."""
    n, (least, most) = F.length(strip(answer)), rules.ANSWER_LENGTHS
    allowed = lambda text, parts: reduce(or_, (text.contains(p) for p in parts))
    sentences = F.split(answer, "[.]", -1)
    distinct = F.array_distinct(F.filter(F.transform(sentences, lambda x: F.lower(strip(x))), lambda x: x != ""))
    checks = (
        ("too_short", n < least), ("too_long", n > most), ("incomplete", answer.rlike(rules.INCOMPLETE) & ~allowed(answer, rules.INCOMPLETE_ALLOWED)),
        ("error", answer.rlike(rules.ERRORS) & ~allowed(F.lower(answer), rules.ERROR_ALLOWED)), ("repeats", F.size(sentences) > 1.5 * F.size(distinct)),
        ("off_topic", (F.size(words(question)) > 0) & (overlap(question, answer) < 0.2)),
    )
    found = F.filter(F.array(*(F.when(test, code) for code, test in checks)), lambda x: x.isNotNull())
    return F.when(answer != "", found).otherwise(F.array().cast("array<string>"))


def result_note(result: Column) -> Column:
    """What a query result's text is followed by: its lines and numbers; results under ten characters have no note."""
    lines = F.size(F.filter(F.split(strip(result), "\n"), lambda x: strip(x) != ""))
    numbers = F.regexp_count(result, F.lit("[0-9]+"))
    rows = F.when(lines == 1, F.format_string("[단일 결과: %d개 행]", lines)).otherwise(F.format_string("[조회 결과: %d개 행]", lines))
    return F.when(F.length(strip(result)) >= 10, F.concat(rows, F.when(numbers > 0, F.format_string(" [수치 데이터 포함: %d개 숫자]", numbers)).otherwise("")))


def overall_confidence(accuracy: Column, completeness: Column, certainty: Column) -> Column:
    return 0.4 * accuracy + 0.3 * completeness + 0.3 * certainty


def kind_named(reply: Column) -> Column:
    """The first question kind that a model's reply names as a word, else the first in order that it holds; null if none."""
    low = F.lower(reply)
    word = F.regexp_extract(low, r"(?U)\b(" + "|".join(rules.KINDS) + r")\b", 1)
    return F.when(word != "", word).otherwise(F.coalesce(*(F.when(low.contains(k), k) for k in rules.KINDS)))


def column_labels(reply: Column) -> Column:
    """Array of (tableName, columnName, piiType) from a model's reply: a fenced JSON block, else the widest brackets; items without all three keys are left out."""
    fenced = F.regexp_extract(reply, r"(?s)```json\s*(.*?)\s*```", 1)
    text = F.when(reply.contains("```json") & (fenced != ""), fenced).otherwise(F.regexp_extract(reply, r"(?s)\[.*\]", 0))
    items = F.when(text.startswith("["), F.from_json(text, "array<struct<tableName:string,columnName:string,piiType:string>>"))
    whole = F.filter(items, lambda x: x["tableName"].isNotNull() & x["columnName"].isNotNull() & x["piiType"].isNotNull())
    return F.coalesce(whole, F.array().cast("array<struct<tableName:string,columnName:string,piiType:string>>"))


def merged_messages(left: Column, right: Column, most: int = rules.MESSAGES) -> Column:
    """Messages of a dialogue's state after an update: a short update replaces, a long state is replaced, else both are joined and the last ones kept."""
    joined = F.concat(left, right)
    kept = F.slice(joined, F.greatest(F.size(joined) - 2 * most + 1, F.lit(1)), F.lit(2 * most))
    return F.when(F.size(left) == 0, right).when(F.size(right) == 0, left).when((F.size(right) <= most) | (F.size(left) > 10 * most), right).otherwise(kept)


def assistant_text(reply: Column) -> Column:
    """What follows the last mark of the assistant's turn, without end marks."""
    parts = F.split(reply, rules.TURN_MARK.replace("|", r"\|"), -1)
    own = F.when(F.size(parts) > 1, strip(F.element_at(parts, -1))).otherwise(reply)
    return strip(F.replace(own, F.lit(rules.TURN_END), F.lit("")))


def memory_of(reply: Column) -> Column:
    """(entities, facts) of the widest braces of a reply; null where they hold no such object."""
    text = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(text != "", text).otherwise(reply), "struct<entities:map<string,array<string>>,facts:array<string>>")


def _number(line: Column) -> Column:
    found = F.regexp_extract(line, r"[0-9]+\.?[0-9]*", 0).try_cast("double")
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def relevance_of(reply: Column) -> Column:
    """(score, relevant): the first line with a scored number or with a yes decides, the later ones are not read."""
    scored = lambda x: x.contains("점수") & x.rlike("[0-9]")
    yes = lambda x: x.contains("여부") & (F.lower(x).contains("yes") | x.contains("예") | x.contains("있"))
    line = F.get(F.filter(F.split(reply, "\n"), lambda x: scored(x) | yes(x)), F.lit(0))
    score = F.when(scored(line), _number(line)).otherwise(0.0)
    relevant = F.coalesce((yes(line) & ~scored(line)) | (score >= rules.RELEVANCE), F.lit(False))
    return F.struct(score.alias("score"), relevant.alias("relevant"))


def grounding_of(reply: Column) -> Column:
    """(score, grounded) of a reply on an answer's grounds: the first line on them with a number as score, or with a yes, decides; null reply: no score."""
    about = lambda x, what: x.contains("근거") & x.contains(what)
    scored = lambda x: about(x, "점수") & x.rlike("[0-9]")
    yes = lambda x: about(x, "여부") & (F.lower(x).contains("yes") | x.contains("예") | x.contains("있") | x.contains("충분"))
    line = F.get(F.filter(F.split(reply, "\n"), lambda x: scored(x) | yes(x)), F.lit(0))
    score = F.when(reply.isNotNull(), F.when(scored(line), _number(line)).otherwise(0.0))
    grounded = F.coalesce((yes(line) & ~scored(line)) | (score >= rules.GROUNDING), F.lit(False))
    return F.struct(score.alias("score"), grounded.alias("grounded"))


def aspects_of(reply: Column) -> Column:
    """(accuracy, completeness, confidence): the number of the last line for each; a line counts for the first aspect it names."""
    lines, out, before = F.split(reply, "\n"), [], []

    def named(x: Column, name: str) -> Column:
        korean, english = rules.ASPECTS[name]
        return x.contains(korean) | F.lower(x).contains(english)

    for name in rules.ASPECTS:
        others = tuple(before)
        own = F.filter(lines, lambda x: named(x, name) & ~reduce(or_, (named(x, o) for o in others), F.lit(False)) & x.rlike("[0-9]"))  # noqa: B023
        out.append(F.coalesce(_number(F.get(own, F.size(own) - 1)), F.lit(rules.ASPECT_DEFAULT)).alias(name))
        before.append(name)
    return F.struct(*out)


def asks_for_secrets(question: Column) -> Column:
    low = F.lower(question)
    return reduce(or_, (low.contains(k) for k in rules.ASKED_SECRETS + rules.ASKED_TABLES))


def agent_stopped(output: Column) -> Column:
    return F.lower(F.coalesce(output, F.lit(""))).contains(rules.STOPPED)


def data_of(output: Column) -> Column:
    """The lines with data of an output whose parsing failed, without marks; other outputs, and those without such lines, as they are; null for none."""
    low = lambda x, parts: reduce(or_, (F.lower(x).contains(p) for p in parts))
    lines = F.filter(F.split(output, "\n"), lambda x: ~low(x, rules.SKIPPED_LINES) & x.rlike(rules.DATA_LINE))
    kept = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, rules.LINE_MARKS, ""))), lambda x: F.length(x) > 3)
    return F.when(output == "", None).when(low(output, rules.PARSE_FAILED) & (F.size(kept) > 0), F.array_join(kept, "\n")).otherwise(output)


def after_search_in_tables(kind: Column) -> Column:
    """Where a dialogue goes after a query on tables: on to the law search if its kind was changed to that, else to the answer."""
    return F.when(kind == "vector_search", "vector_search").otherwise("generate_answer")


def after_search() -> Column:
    return F.lit("check_relevance")


def latest(left: Column, right: Column) -> Column:
    return F.coalesce(right, left)


def latest_text(left: Column, right: Column, default: str | None = "") -> Column:
    """The newer text that is not empty, else the default."""
    return F.when(right != "", right).when(left != "", left).otherwise(F.lit(default))


def larger(left: Column, right: Column) -> Column:
    return F.greatest(left, right)


def replaced_list(left: Column, right: Column) -> Column:
    """The newer list, an empty one too; else the older one, else an empty one."""
    return F.coalesce(right, left, F.slice(F.coalesce(left, right), 1, 0))


def joined_lists(left: Column, right: Column) -> Column:
    """Both lists end to end; a missing one counts as empty, two missing ones give null."""
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.concat(left, right))


def merged_map(left: Column, right: Column) -> Column:
    """Entries of both maps; the newer one's win, null values too; two missing ones give null."""
    both = F.map_zip_with(left, right, lambda k, a, b: F.when(F.array_contains(F.map_keys(right), k), b).otherwise(a))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(both)


def contexts(docs: DataFrame, most: int = rules.CONTEXT_DOCS, chars: int = rules.CONTEXT_CHARS) -> DataFrame:
    """(q_id, context): the first documents by rank from docs (q_id, rank from 1, law, article, content), cut and joined."""
    head = F.concat(F.lit("문서 "), F.col("rank").cast("string"), F.lit(" ("), F.coalesce("law", F.lit("")), F.lit(" "), F.coalesce("article", F.lit("")), F.lit("):\n"), F.substring("content", 1, chars))
    return docs.where(F.col("rank") <= most).groupBy("q_id").agg(joined_in_order(F.col("rank"), head, rules.CONTEXT_BREAK).alias("context"))


def prompt_columns(columns: DataFrame) -> DataFrame:
    """(table_schema, table_name, lines): `- table.column` for each column by position; equal names in two schemas are two tables."""
    line = F.concat(F.lit("- "), F.col("table_name"), F.lit("."), F.col("column_name"))
    return columns.groupBy("table_schema", "table_name").agg(joined_in_order(F.col("ordinal_position"), line).alias("lines"))


def instruction(task: str, query: Column) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def reranked(rows: DataFrame, score: Column | None = None) -> DataFrame:
    """The best RERANK_KEPT of each question's first RERANK_INPUT rows (q_id, rank) by score, then rank; without scores the first ones. Adds place, from 1."""
    first = rows.where(F.col("rank") <= rules.RERANK_INPUT)
    order = [F.col("rank")] if score is None else [F.desc("_score"), F.col("rank")]
    first = first.withColumn("_score", F.lit(None) if score is None else score)
    return first.withColumn("place", F.row_number().over(W.partitionBy("q_id").orderBy(*order))).where(F.col("place") <= rules.RERANK_KEPT).drop("_score")


def pooled(hidden: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is set, scaled to length one; null where none is set."""
    kept = F.filter(F.arrays_zip(hidden.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    total = F.aggregate(kept, F.transform(F.get(hidden, F.lit(0)), lambda _: F.lit(0.0)), lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((F.size(kept) > 0) & (norm > 0), F.transform(total, lambda x: x / norm))
