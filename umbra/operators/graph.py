"""Dialogues as rows of a state table that move from node to node, in rounds.

A row is a question of a conversation. In a round every row does what its node says, and is routed on by
its own columns; nodes that always follow each other are one step. A round has one plan
for each node that rows stand at, and ends in a checkpoint. Rows at the end leave the
table. All loops are counted; rows that could go on forever are stopped after MOST rounds.
Questions of one conversation are answered one after the other, in waves over all conversations, as each
starts from the last messages of the one before.

What needs a model or tables comes in as functions on tables: each gets the rows that stand
at its node and gives them back with one more column (Services). A null reply is a failed call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import strip
from ..sources.shared import cut
from . import dialogue as D

MOST = 10  # the longest way with an end takes nine
MESSAGES = "array<struct<role:string,content:string>>"
DOCS = "array<struct<content:string,law:string,article:string,score:double>>"
#: What a state holds besides its conv_id, turn, question and messages, as it starts.
FRESH = {
    "kind": ("string", ""), "db_result": ("string", None), "docs": (DOCS, []), "ranked": (DOCS, []), "relevance": ("double", None), "relevant": ("boolean", None),
    "grounding": ("double", None), "grounded": ("boolean", None), "retries": ("int", 0), "version": ("int", 0), "rewrites": ("int", 0), "answer": ("string", ""),
    "accuracy": ("double", None), "completeness": ("double", None), "confidence": ("double", None), "entities": ("map<string,array<string>>", None), "facts": ("array<string>", []),
    "issues": ("array<string>", []), "node": ("string", "start"), "path": ("array<string>", []),
}

Service = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Services:
    """Functions from rows to rows with a column more. All see the state's columns, and what is named here.

    classify, relevance, answer, grounding, aspects, memory: `reply`, a text; answer sees history, tables and context, relevance
    and grounding see context. tables: `reply`, from question and the message before (previous). search: `found`, documents (DOCS), for the text
    `query`. rerank: `found`, the best documents.
    """

    classify: Service
    tables: Service
    search: Service
    relevance: Service
    rerank: Service
    answer: Service
    grounding: Service
    aspects: Service
    memory: Service


def fresh(questions: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """States of questions (conv_id, turn, question): the conversation's last messages from memory (conv_id, messages), all else as at the start."""
    rows = questions.select("conv_id", "turn", "question")
    none = F.array().cast(MESSAGES)
    if memory is None:
        rows = rows.withColumn("messages", none)
    else:
        rows = rows.join(memory.select("conv_id", "messages"), "conv_id", "left").withColumn("messages", last_of(F.coalesce("messages", none)))
    first = {c: (F.array().cast(kind) if start == [] else F.lit(start).cast(kind)) for c, (kind, start) in FRESH.items()}
    return rows.select("conv_id", "turn", "question", "messages", *(v.alias(c) for c, v in first.items()))


def last_of(messages: Column, most: int = rules.MESSAGES) -> Column:
    return F.slice(messages, F.greatest(F.size(messages) - most + 1, F.lit(1)), F.lit(most))


def _context(docs: Column, count: int, chars: int, mark: str = "", titled: bool = False) -> Column:
    head = lambda x, i: F.concat(F.lit("문서 "), (i + 1).cast("string"), *((F.lit(" ("), F.coalesce(x["law"], F.lit("")), F.lit(" "), F.coalesce(x["article"], F.lit("")), F.lit(")")) if titled else ()), F.lit(":\n"))
    parts = F.transform(F.slice(docs, 1, count), lambda x, i: F.concat(head(x, i), F.substring(F.coalesce(x["content"], F.lit("")), 1, chars), F.lit(mark)))
    return F.when(F.size(docs) > 0, F.array_join(parts, rules.CONTEXT_BREAK)).otherwise(rules.NO_CONTEXT)


def _sources() -> Column:
    return F.when(F.size("ranked") > 0, F.col("ranked")).otherwise(F.col("docs"))


def _went(*nodes: str) -> Column:
    return F.concat("path", F.array(*map(F.lit, nodes)))


def classified(rows: DataFrame, s: Services) -> DataFrame:
    kind = F.when(F.col("reply").isNull(), "general").otherwise(F.coalesce(D.kind_named(F.col("reply")), D.question_tier(F.col("question"))))
    rows = s.classify(rows).withColumn("kind", kind)
    return rows.withColumns({"node": D.after_question(F.col("kind")), "path": _went("load_memory", "classify")})


def asked_tables(rows: DataFrame, s: Services) -> DataFrame:
    """The reply of the tables; an empty one, and one that says that there is none, as that there is none. A failed call has its own text."""
    rows = s.tables(rows.withColumn("previous", F.get("messages", F.size("messages") - 1)))
    reply = F.col("reply")
    result = F.when(reply.isNull(), rules.TABLES_FAILED).when((reply == "") | reply.isin(*rules.TABLES_SILENT), rules.TABLES_SILENT[0]).otherwise(reply)
    rows = rows.withColumns({"db_result": result, "path": _went("db_query")}).drop("reply")
    return rows.withColumn("node", D.after_search_in_tables(F.col("kind")))


def searched(rows: DataFrame, s: Services) -> DataFrame:
    """A search that follows one with documents is another try, with a longer query; documents then are judged."""
    again = (F.size("docs") > 0) & (F.col("retries") < rules.SEARCH_RETRIES)
    retries = F.when(again, F.col("retries") + 1).otherwise(F.col("retries"))
    version = F.when(retries > 0, retries).otherwise(F.col("version"))
    query = F.when(version > 0, D.expanded(F.col("question"), version)).otherwise(F.col("question"))
    rows = rows.withColumns({"query": query, "version": F.when(again, retries).otherwise(F.col("version")), "retries": retries})
    rows = s.search(rows).withColumn("docs", F.coalesce(F.col("found"), F.array().cast(DOCS))).drop("found")
    rows = s.relevance(rows.withColumn("context", _context(F.col("docs"), 3, 500, "...")))
    told = D.relevance_of(F.coalesce("reply", F.lit("")))
    some = F.size("docs") > 0
    rows = rows.withColumns({"relevance": F.when(some, told["score"]).otherwise(0.0), "relevant": some & told["relevant"], "path": F.concat("path", F.array(F.lit("vector_search"), F.lit("check_relevance")))})
    return rows.withColumn("node", D.after_relevance(F.col("relevant"), F.col("relevance"), F.col("retries")))


def asked_both(rows: DataFrame, s: Services) -> DataFrame:
    rows = searched(asked_tables(rows, s), s)
    kept = F.slice("path", 1, F.size("path") - 3)
    return rows.withColumn("path", F.concat(kept, F.array(F.lit("both_query"), F.lit("check_relevance"))))


def ranked(rows: DataFrame, s: Services) -> DataFrame:
    """The documents reranked: without any none, after a failed call the first ones."""
    first = F.slice("docs", 1, rules.RERANK_KEPT)
    rows = s.rerank(rows).withColumn("ranked", F.when(F.size("docs") == 0, F.col("docs")).otherwise(F.coalesce("found", first))).drop("found")
    return answered(rows.withColumn("path", _went("rerank")), s)


def answered(rows: DataFrame, s: Services) -> DataFrame:
    """An answer, and whether it has grounds. One that follows another answer counts as written again."""
    again = ((F.col("rewrites") > 0) | (strip(F.col("answer")) != "")) & (F.col("rewrites") < rules.GENERATION_RETRIES)
    line = lambda m: F.concat(F.coalesce(m["role"], F.lit("unknown")), F.lit(": "), F.coalesce(m["content"], F.lit("")))
    history = F.when(F.size("messages") > 0, F.array_join(F.transform(last_of(F.col("messages")), line), "\n")).otherwise(rules.NO_HISTORY)
    failed = F.lit(False)
    for phrase in rules.TABLES_SAY_NOTHING:
        failed = failed | F.col("db_result").contains(phrase)
    tables = F.when((strip(F.coalesce("db_result", F.lit(""))) != "") & ~failed, F.concat(F.lit(rules.TABLES_SAY), F.col("db_result"))).otherwise(rules.TABLES_SILENT[1])
    rows = rows.withColumns({"rewrites": F.when(again, F.col("rewrites") + 1).otherwise(F.col("rewrites")), "history": history, "tables": tables, "context": _context(_sources(), rules.CONTEXT_DOCS, rules.CONTEXT_CHARS, titled=True)})
    text = D.plain_text(D.assistant_text(strip(F.col("reply"))))
    rows = s.answer(rows).withColumn("answer", F.when(F.col("reply").isNull(), rules.ANSWER_FAILED).otherwise(text)).drop("reply", "history", "tables")

    no_docs = (F.size("docs") == 0) & (F.size("ranked") == 0)
    refused = F.lit(False)
    for phrase in rules.NO_DATA:
        refused = refused | F.col("answer").contains(phrase)
    sure = no_docs & ((F.coalesce("db_result", F.lit("")) != "") | refused | (F.col("kind") == "general"))
    rows = s.grounding(rows.withColumn("context", _context(_sources(), rules.CONTEXT_DOCS, 500)))
    told = D.grounding_of(F.col("reply"))
    score = F.when(sure, 1.0).when(no_docs | F.col("reply").isNull(), 0.5).otherwise(told["score"])
    grounded = sure | (~no_docs & F.coalesce(told["grounded"], F.lit(False)))
    rows = rows.withColumns({"grounding": score, "grounded": grounded, "path": _went("generate_answer", "check_hallucination")})
    return rows.withColumn("node", D.after_grounding(F.col("grounded"), F.col("grounding"), F.col("rewrites")))


def evaluated(rows: DataFrame, s: Services) -> DataFrame:
    """Scores, what is worth remembering, what is wrong with the answer, and the messages that are kept."""
    told = D.aspects_of(F.col("reply"))
    half = lambda c: F.when(F.col("reply").isNull(), rules.ASPECT_DEFAULT).otherwise(c)
    rows = s.aspects(rows.withColumn("context", _context(_sources(), rules.CONTEXT_DOCS, 500)))
    rows = rows.withColumns({"accuracy": half(told["accuracy"]), "completeness": half(told["completeness"]), "confidence": half(D.overall_confidence(told["accuracy"], told["completeness"], told["confidence"]))}).drop("reply")
    kept = D.memory_of(D.assistant_text(strip(F.col("reply"))))
    new = F.when((F.col("question") != "") & (F.col("answer") != ""), kept)
    rows = s.memory(rows).withColumn("_new", new)
    rows = rows.withColumns({"entities": F.coalesce(F.col("_new.entities"), F.col("entities")), "facts": F.coalesce(F.col("_new.facts"), F.col("facts")), "issues": D.answer_issues(F.col("question"), F.col("answer"))})
    warned = F.when((F.col("rewrites") > rules.GENERATION_RETRIES) & ~F.col("answer").startswith(rules.WARNING[:2]), F.concat(F.lit(rules.WARNING), F.col("answer"))).otherwise(F.col("answer"))
    said = F.array(*(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")) for role, c in (("user", "question"), ("assistant", "answer"))))
    rows = rows.withColumn("answer", warned).withColumn("messages", last_of(F.concat("messages", said)))
    return rows.withColumns({"node": F.lit("end"), "path": _went("multi_aspect_evaluation", "extract_entities", "validate_output", "save_memory")})


NODES = {"start": classified, "db_query": asked_tables, "vector_search": searched, "both_query": asked_both, "rerank": ranked, "generate_answer": answered, "multi_aspect_evaluation": evaluated}


def rounds(states: DataFrame, services: Services, most: int = MOST) -> DataFrame:
    """States moved on until all are at the end; those that are not after so many rounds come back with node 'stopped'."""
    columns, states, done = states.columns, cut(states), []
    parts = states.rdd.getNumPartitions()
    for left in range(most, -1, -1):
        at = [r.node for r in states.select("node").distinct().collect()]
        if "end" in at:
            done.append(states.where("node = 'end'"))
        going = [n for n in NODES if n in at]
        if not going:
            break
        if not left:
            done.append(states.where("node <> 'end'").withColumn("node", F.lit("stopped")))
            break
        moved = None
        for n in going:
            rows = NODES[n](states.where(F.col("node") == n), services).select(columns)
            moved = rows if moved is None else moved.unionByName(rows)
        states = cut(moved.coalesce(parts))  # the union has every part once for each node
    out = done[0] if done else states
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def run(questions: DataFrame, services: Services, memory: DataFrame | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(states of all questions (conv_id, turn, question) at their end, memory (conv_id, messages) after them).

    A conversation's questions follow each other by turn, of equal turns in any order. A stopped dialogue leaves no messages. Null questions are empty ones;
    an empty table gives empty tables.
    """
    wave = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    asked = cut(questions.select("conv_id", "turn", F.coalesce("question", F.lit("")).alias("question")).withColumn("_wave", wave))
    waves = asked.agg(F.max("_wave")).head()[0] or 0
    out = fresh(asked.limit(0))
    store = memory.select("conv_id", "messages") if memory is not None else fresh(asked.limit(0)).select("conv_id", "messages")
    for w in range(1, waves + 1):
        ended = rounds(fresh(asked.where(F.col("_wave") == w), store), services, most)
        saved = ended.where("node = 'end'").select("conv_id", F.col("messages").alias("_new"))
        store = cut(store.join(saved, "conv_id", "full_outer").select("conv_id", F.coalesce("_new", "messages").alias("messages")))
        out = ended if w == 1 else out.unionByName(ended)
    return out, store
