"""Dialogues in rounds against a version that takes each question through the graph step by step."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from umbra.operators import graph as G

KINDS = ["db_query", "vector_search", "both", "general", "nonsense", None]
RELEVANT = ["관련성 점수: 0.9", "관련성 점수: 0.3", "관련성 여부: yes", "모름", None, "관련성 점수: 0.1"]
GROUNDS = ["근거 점수: 0.9", "근거 점수: 0.2", "근거 여부: 충분", "점수: 1", None]
TABLES = ["3개 행", "", "DB 조회 결과 없음", None]
ANSWERS = ["**답** 입니다. 충분히 긴 답변", "자료 없음", "<|start_header_id|>assistant<|end_header_id|> 다른 `답`<|eot_id|>", None]
ASPECTS = ["정확성: 0.9\n완전성 0.4\n신뢰도: 1", "없음", None]
MEMORY = ['{"entities": {"law": ["b"]}, "facts": ["f"]}', "없음", None]
HITS = [[("내용 하나", "법", "제1조", 0.5), ("내용 둘", None, None, 0.4)], [("내용 셋", "법", None, 0.1)], [("내용 넷", None, "제2조", 0.2)], [], None]
RERANKED = [[("내용 둘", None, None, 0.4)], None]


def dice(*parts):
    return zlib.crc32(":".join(map(str, parts)).encode())


def pick(choices, *parts):
    return choices[dice(*parts) % len(choices)]


def picked(choices, kind, name, *columns):
    """The same choice as a column, from an array of all."""
    values = F.array(*(F.lit(c).cast(kind) if not isinstance(c, list) else (F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(x, (("content", "string"), ("law", "string"), ("article", "string"), ("score", "double"))))) for x in c)) if c else F.array()).cast(kind) for c in choices))
    return F.get(values, (F.crc32(F.concat_ws(":", F.lit(name), *map(F.expr, columns)).cast("binary")) % len(choices)).cast("int"))


def adds(column, choices, kind, name, *columns):
    return lambda rows: rows.withColumn(column, picked(choices, kind, name, *columns))


SERVICES = G.Services(
    classify=adds("reply", KINDS, "string", "kind", "question"), tables=adds("reply", TABLES, "string", "tables", "question", "coalesce(previous.content, '')"),
    search=adds("found", HITS, G.DOCS, "search", "query"), relevance=adds("reply", RELEVANT, "string", "relevance", "question", "retries", "crc32(cast(context as binary))"),
    rerank=adds("found", RERANKED, G.DOCS, "rerank", "question"), answer=adds("reply", ANSWERS, "string", "answer", "question", "rewrites", "crc32(cast(history as binary))", "crc32(cast(tables as binary))", "crc32(cast(context as binary))"),
    grounding=adds("reply", GROUNDS, "string", "grounds", "question", "rewrites", "crc32(cast(context as binary))"), aspects=adds("reply", ASPECTS, "string", "aspects", "question"), memory=adds("reply", MEMORY, "string", "memory", "question"),
)


def crc(text):
    return zlib.crc32(text.encode())


def texts(docs, count, chars, mark="", titled=False):
    if not docs:
        return "참고 문서 없음"
    return "\n\n---\n\n".join(f"문서 {i + 1}" + (f" ({d[1] or ''} {d[2] or ''})" if titled else "") + f":\n{d[0][:chars]}{mark}" for i, d in enumerate(docs[:count]))


def first_number(line):
    m = re.search(r"[0-9]+\.?[0-9]*", line)
    return max(0.0, min(1.0, float(m[0]))) if m else None


def judged(reply, score_words, asked_words, yes, least):
    score, good = 0.0, False
    for line in reply.split("\n"):
        if all(w in line for w in score_words) and first_number(line) is not None:
            score = first_number(line)
            break
        if all(w in line for w in asked_words) and any(w in line.lower() for w in yes):
            good = True
            break
    return score, good or score >= least


def step_by_step(question, messages, most=10):
    """(path, answer, kind, scores, messages, ..) of one question, or None if it never ends."""
    path, docs, ranked, db, retries, version, rewrites, answer = ["load_memory", "classify"], [], [], None, 0, 0, 0, ""
    reply = pick(KINDS, "kind", question)
    kind = "general" if reply is None or reply == "nonsense" else reply  # no word of these questions tells a kind
    node = {"general": "generate_answer", "both": "both_query"}.get(kind, kind)
    relevance = None
    for _ in range(most - 1):
        if node in ("db_query", "both_query"):
            reply = pick(TABLES, "tables", question, messages[-1][1] if messages else "")
            db = "DB 조회 중 오류가 발생했습니다" if reply is None else "DB 조회를 수행할 수 없습니다." if reply in ("", "DB 조회 결과 없음") else reply
        if node == "db_query":
            path.append("db_query")
            node = "generate_answer"
        elif node in ("vector_search", "both_query"):
            if docs and retries < 3:
                retries += 1
                version = retries
            v = retries or version
            query = question + (["", " 관련 법령 조항", " 법적 근거 및 규정"][v] if v < 3 else " 법률 규정 법령")
            docs = pick(HITS, "search", query) or []
            path += [node, "check_relevance"]
            reply = pick(RELEVANT, "relevance", question, retries, crc(texts(docs, 3, 500, "..."))) or ""
            relevance, good = judged(reply, ["점수"], ["여부"], ["yes", "예", "있"], 0.6) if docs else (0.0, False)
            node = "rerank" if good and relevance >= 0.6 else "vector_search" if retries < 3 else "generate_answer"
        elif node in ("rerank", "generate_answer"):
            if node == "rerank":
                path.append("rerank")
                found = pick(RERANKED, "rerank", question)
                ranked = (docs[:5] if found is None else found) if docs else []
            if (rewrites > 0 or answer.strip()) and rewrites < 2:
                rewrites += 1
            history = "\n".join(f"{r}: {c}" for r, c in messages[-2:]) if messages else "대화 이력 없음"
            told = f"[DB 조회 성공] {db}" if db and not db.startswith("DB 조회") else "DB 조회 결과 없음"
            reply = pick(ANSWERS, "answer", question, rewrites, crc(history), crc(told), crc(texts(ranked or docs, 5, 800, titled=True)))
            answer = "죄송합니다. 답변 생성 중 오류가 발생했습니다." if reply is None else {0: "답 입니다. 충분히 긴 답변", 1: "자료 없음", 2: "다른 답"}[ANSWERS.index(reply)]
            path += ["generate_answer", "check_hallucination"]
            if not docs and not ranked:
                score, good = (1.0, True) if db or "자료 없음" in answer or kind == "general" else (0.5, False)
            else:
                reply = pick(GROUNDS, "grounds", question, rewrites, crc(texts(ranked or docs, 5, 500)))
                score, good = (0.5, False) if reply is None else judged(reply, ["근거", "점수"], ["근거", "여부"], ["yes", "예", "있", "충분"], 0.7)
            node = "generate_answer" if not (good and score >= 0.7) and rewrites < 2 else "multi_aspect_evaluation"
        else:
            path += ["multi_aspect_evaluation", "extract_entities", "validate_output", "save_memory"]
            confidence = 0.4 * 0.9 + 0.3 * 0.4 + 0.3 if pick(ASPECTS, "aspects", question) == ASPECTS[0] else 0.5
            facts = ["f"] if pick(MEMORY, "memory", question) == MEMORY[0] else []
            messages = [*messages, ("user", question), ("assistant", answer)][-2:]
            return path, answer, kind, relevance, score, good, retries, rewrites, round(confidence, 9), facts, messages
    return None


@pytest.fixture(scope="module")
def questions():
    return [(conv, turn, f"q{conv}x{turn}") for conv in range(90) for turn in (1, 4)]


def test_as_step_by_step(spark, questions):
    df = spark.createDataFrame(questions, "conv_id long, turn long, question string")
    states, store = G.run(df, SERVICES)
    got = {(r.conv_id, r.turn): r for r in states.collect()}
    memory, kinds, loops, stopped = {}, set(), set(), 0
    for conv, turn, question in questions:
        want, r = step_by_step(question, memory.get(conv, [])), got[conv, turn]
        if want is None:
            stopped += 1
            assert r.node == "stopped"
            continue
        memory[conv] = want[-1]
        found = (r.path, r.answer, r.kind, r.relevance, r.grounding, r.grounded, r.retries, r.rewrites, round(r.confidence, 9), r.facts, [tuple(m) for m in r.messages])
        assert found == want, question
        kinds.add(r.kind)
        loops |= {("retries", r.retries), ("rewrites", r.rewrites)}
    assert len(got) == len(questions) and kinds == {"db_query", "vector_search", "both", "general"}
    assert loops == {("retries", n) for n in range(4)} | {("rewrites", n) for n in range(3)} and stopped
    assert {r.conv_id: [tuple(m) for m in r.messages] for r in store.collect()} == memory


def test_memory_is_taken_up(spark):
    memory = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b"), ("user", "c")]), (9, [("user", "x")])], f"conv_id long, messages {G.MESSAGES}")
    states, store = G.run(spark.createDataFrame([(1, 1, "q"), (2, 1, None)], "conv_id long, turn long, question string"), SERVICES, memory)
    got = {r.conv_id: r for r in states.collect()}
    assert got[1].messages[0].content == "q" and got[2].question == ""
    assert {1, 9} <= {r.conv_id for r in store.collect()}
    empty, store = G.run(spark.createDataFrame([], "conv_id long, turn long, question string"), SERVICES)
    assert empty.count() == store.count() == 0


def test_grounds(spark):
    replies = ["근거 점수: 0.9", "점수: 1", "근거 여부: no\n근거 점수 3", "근거 점수 없음\n근거 여부: 예", "", None, "여부와 근거: YES\n근거 점수: 0.1"]
    rows = spark.createDataFrame(list(enumerate(replies)), "id long, reply string").select("id", G.D.grounding_of(F.col("reply")).alias("g")).orderBy("id").collect()
    assert [tuple(r.g) for r in rows] == [(0.9, True), (0.0, False), (1.0, True), (0.0, True), (0.0, False), (None, False), (0.0, True)]
