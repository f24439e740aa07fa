"""Queries on frame boxes and word times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import faces as T
from ..operators import media as M
from ..operators.detect import entities
from ..sources.derived import as_sql, view

_B, _LENGTH = as_sql("frame_boxes"), 400_000

def _word_parts(words):
    first, last = M.times_within(F.col("start_time"), F.col("end_time"), F.col("ord") % 3, 3 + F.col("ord") % 2, F.length("word"))
    return words.select("audio", "ord", F.round(first, 6).alias("first"), F.round(last, 6).alias("last"))


def _messages(s, d):
    n = lambda label: F.count_if(F.col("label") == label)
    rows = view(s, d, "frame_boxes").where("id % 5 > 0").groupBy("video").agg(n("click").alias("f"), n("purchase").alias("a"), n("view").alias("t"))
    return rows.select("video", M.video_message(F.col("f"), F.col("a"), F.col("t")).alias("m")).select("video", "m.*")


def _media_counts(s, d):
    boxes = view(s, d, "frame_boxes")
    none = F.lit(0).cast("long")
    found = entities(view(s, d, "documents").select((F.col("doc_id") % 20).alias("file"), "text"), labels=("p_em", "p_ip", "p_pp")).groupBy("file", "code").agg(F.count("*").alias("total_count"), none.alias("masked_count"))
    faces = boxes.where("label = 'click'").groupBy(F.col("video").alias("file"), F.lit("FACE").alias("code")).agg(F.count("*").alias("total_count"), none.alias("masked_count"))
    slots = view(s, d, "files").select((F.col("id") % 20).alias("file"), F.lit("PH").alias("code"), none.alias("total_count"), F.lit(1).cast("long").alias("masked_count"))
    return M.media_rollup(found, faces, slots)


def _stats(s, d):
    spans = view(s, d, "spans_ner").where("label <> 'p_other'").withColumnRenamed("unit", "file")
    files = view(s, d, "orders").select(F.col("o_orderkey").alias("file"))
    flat = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws(":", x["key"], x["value"])), ","), F.lit(""))
    return M.file_stats(files, spans).select("file", "n", F.round("avg_confidence", 6).alias("avg_confidence"), flat("labels").alias("labels"), flat("methods").alias("methods"))


def _lines(s, d):
    t = view(s, d, "frame_boxes").where("w > 0 and h > 0")
    return M.lines_of(t.select((F.col("video") * 1000 + F.col("frame")).cast("long").alias("page"), F.col("id").alias("token"), *(e.cast("double").alias(n) for n, e in (("x1", F.col("x")), ("y1", F.col("y")), ("x2", F.col("x") + F.col("w")), ("y2", F.col("y") + F.col("h")))), F.col("label").alias("text"), F.col("confidence").cast("double").alias("confidence")))


def _zipped(s, d):
    """Units of a file and the entity lists of a model for them, by position."""
    units = view(s, d, "dict_lines").select("doc", "ord", F.col("line").alias("text"))
    lists = view(s, d, "dict_lines").where("ord % 2 = 0").select("doc", "ord", F.length("line").alias("n"))
    return units.join(lists, ["doc", "ord"]).select("doc", "ord", "text", "n")


QUERIES = {
    "frames_for_text": lambda s, d: M.sampled_for_text(view(s, d, "frame_boxes")).select("id"),
    "video_messages": _messages,
    "media_rollup": _media_counts,
    "file_stats": _stats,
    "transcript_matches": lambda s, d: M.word_matches(view(s, d, "file_words"), view(s, d, "wanted_texts").select("audio", "entity", "text")).withColumns({"start_time": F.round("start_time", 6), "end_time": F.round("end_time", 6)}),
    "ocr_lines": _lines,
    "faces_followed": lambda s, d: T.faces_followed(view(s, d, "frame_boxes"), (640, 480)).groupBy("video").agg(F.count_distinct("track").alias("n_tracks"), F.count("*").alias("n")),
    "units_with_lists": _zipped,
    "faces_by_frame": lambda s, d: T.faces_by_frame(view(s, d, "frame_boxes"), (640, 480)),
    "frame_sampling": lambda s, d: M.clipped(view(s, d, "frame_boxes"), 40, 30).select("id", "x", "y", "w", "h"),
    "image_conf_gate": lambda s, d: M.confident_pictures(view(s, d, "frame_boxes")).select("id"),
    "text_region_expand": lambda s, d: M.regions_by_frame(view(s, d, "frame_boxes")).groupBy("video", "frame").agg(F.count("*").alias("n")),
    "iou_pairs": lambda s, d: M.iou_with_last(view(s, d, "frame_boxes")).withColumn("iou", F.round("iou", 6)),
    "audio_intervals": lambda s, d: M.intervals(view(s, d, "word_times"), _LENGTH),
    "word_time_interp": lambda s, d: _word_parts(view(s, d, "word_times")),
    "track_dedup": lambda s, d: M.tracks(view(s, d, "frame_boxes").withColumn("video", F.col("video").cast("long"))).groupBy("video", "label").agg(F.count_distinct("track").alias("n_tracks")),
}

_WANTED = f"""with w as (select audio, ord, trim(word) as w, start_time as a, end_time as b, row_number() over (partition by audio order by ord) as r from {as_sql('file_words')}),
    t as (select distinct audio, entity, trim(text) as t from {as_sql('wanted_texts')} where trim(text) <> ''),
    x1 as (select entity, t.audio, arg_min(a, ord) as a, arg_min(b, ord) as b, 1 as tier from w join t on w.audio = t.audio and w.w = t.t group by 1, 2),
    x2 as (select entity, t.audio, arg_min(a + (b - a) * (strpos(w, t) - 1) / len(w), ord) as a, arg_min(a + (b - a) * (strpos(w, t) - 1 + len(t)) / len(w), ord) as b, 2 as tier from w join t on w.audio = t.audio and contains(w.w, t.t) group by 1, 2),
    p as (select y.audio, y.r, y.b, string_agg(z.w, '' order by z.r) as said, arg_min(z.a, z.r) as a from w y join w z on y.audio = z.audio and z.r <= y.r where y.r <= 11 group by 1, 2, 3),
    x3 as (select entity, t.audio, arg_min(p.a, r) as a, arg_min(p.b, r) as b, 3 as tier from p join t on p.audio = t.audio and contains(replace(said, ' ', ''), replace(t, ' ', '')) group by 1, 2),
    every as (select * from x1 union all select * from x2 union all select * from x3)
    select audio, entity, round(a, 6) as start_time, round(b, 6) as end_time from (select * from every qualify row_number() over (partition by audio, entity order by tier) = 1) where a < b"""
_MAIL, _PASS = "[a-zA-Z0-9][a-zA-Z0-9._+-]*@[a-zA-Z0-9][a-zA-Z0-9.-]*\\.[a-zA-Z]{2,}", "[a-zA-Z][0-9]{3}[a-zA-Z0-9][0-9]{4}"
_DOT = "list_filter(regexp_extract_all(regexp_replace(text, '([^0-9.])', '\\1\\1', 'g'), '(?:^|[^0-9.])([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})(?:$|[^0-9.])', 1), lambda x: len(list_filter(string_split(x, '.'), lambda o: cast(o as int) > 255)) = 0)"

ORACLES = {
    "frames_for_text": f"select id from {_B} where frame % 20 = 0",
    "video_messages": f"""with n as (select video, count(*) filter (label = 'click') as f, count(*) filter (label = 'purchase') as a, count(*) filter (label = 'view') as t from {_B} where id % 5 > 0 group by 1)
        select video, case when f + a + t > 0 then 'detected' else 'no_pii' end as status, case when f + a + t > 0 then format('개인정보가 탐지되었습니다. (얼굴: {{}}개, 오디오: {{}}개, 화면 텍스트 PII: {{}}개)', f, a, t) else '개인정보가 탐지되지 않았습니다.' end as message from n""",
    "media_rollup": f"""select file, code, cast(sum(t) as bigint) as total_count, cast(sum(m) as bigint) as masked_count from (select doc_id % 20 as file, 'EM' as code, len(regexp_extract_all(text, '{_MAIL}')) as t, 0 as m from documents
        union all select doc_id % 20, 'PP', len(regexp_extract_all(text, '{_PASS}')), 0 from documents union all select doc_id % 20, 'IP', len({_DOT}), 0 from documents
        union all select video, 'FACE', 1, 0 from {_B} where label = 'click' union all select doc_id % 20, 'PH', 0, 1 from documents) group by 1, 2 having sum(t) + sum(m) > 0""",
    "file_stats": f"""with x as (select unit, label, coalesce(method, 'koelectra') as method, confidence from {as_sql('spans_ner')} where label <> 'p_other'), l as (select unit, label, count(*) as n from x group by 1, 2), m as (select unit, method, count(*) as n from x group by 1, 2),
        a as (select unit, count(*) as n, avg(confidence) as c from x group by 1), ls as (select unit, string_agg(concat(label, ':', n), ',' order by label) as s from l group by 1), ms as (select unit, string_agg(concat(method, ':', n), ',' order by method) as s from m group by 1)
        select o_orderkey as file, coalesce(a.n, 0) as n, round(coalesce(a.c, 0.0), 6) as avg_confidence, coalesce(ls.s, '') as labels, coalesce(ms.s, '') as methods from orders left join a on a.unit = o_orderkey left join ls on ls.unit = o_orderkey left join ms on ms.unit = o_orderkey""",
    "transcript_matches": _WANTED,
    "units_with_lists": f"select doc, ord, line as text, len(line) as n from {as_sql('dict_lines')} where ord % 2 = 0",
    "frame_sampling": f"select * from (select id, x, y, least(w, 40 - x) as w, least(h, 30 - y) as h from {_B} where x >= 0 and y >= 0 and w > 0 and h > 0 and frame % 2 = 1) where w > 0 and h > 0",
    "image_conf_gate": f"select id from (select id, min(confidence) over (partition by video, frame) as m from {_B}) where m >= 0.3",
    "text_region_expand": f"select video, cast(f as int) as frame, count(*) as n from (select video, unnest(range(greatest(1, frame - 25), frame + 26)) as f from {_B} where w > 0 and h > 0) group by 1, 2",
    "iou_pairs": f"""with p as (select *, lag(x) over w1 as x2, lag(y) over w1 as y2, lag(w) over w1 as w2, lag(h) over w1 as h2 from {_B} window w1 as (partition by video, label order by frame, x, id)),
        o as (select *, greatest(least(x + w, x2 + w2) - greatest(x, x2), 0) * greatest(least(y + h, y2 + h2) - greatest(y, y2), 0) as i from p where x2 is not null)
        select id, case when w * h + w2 * h2 - i > 0 then round(i / (w * h + w2 * h2 - i)::double, 6) else 0.0 end as iou from o union all select id, 0.0 from p where x2 is null""",
    "word_time_interp": f"select audio, ord, round(start_time + (end_time - start_time) * ((ord % 3) / len(word)::double), 6) as first, round(start_time + (end_time - start_time) * ((3 + ord % 2) / len(word)::double), 6) as last from {as_sql('word_times')}",
    "audio_intervals": f"""with a as (select audio, ord, start_time, cast(trunc(start_time * 1000) as int) as a, cast(trunc(end_time * 1000) as int) as b from {as_sql('word_times')}),
        c as (select *, greatest(0, a - 25) as s, least(b + 25, {_LENGTH}) as e from a where a < b), g as (select audio, ord, start_time, case when e - s < 50 then a else s end as s, case when e - s < 50 then b else e end as e from c),
        h as (select audio, ord, start_time, greatest(0, least(s, {_LENGTH})) as start_ms, greatest(greatest(0, least(s, {_LENGTH})) + 50, least(e, {_LENGTH})) as end_ms from g)
        select audio, ord, start_ms, end_ms, greatest(0, start_ms - coalesce(lag(end_ms) over (partition by audio order by start_time, ord), 0)) as quiet_ms from h""",
}

QUERIES |= {
    "audio_untouched": lambda s, d: M.untouched(view(s, d, "word_times"), view(s, d, "word_times"), _LENGTH),
    "media_codes": lambda s, d: M.codes_listed(QUERIES["media_rollup"](s, d)).select("file", F.array_join(F.transform("codes", lambda x: F.concat_ws(":", x["code"], x["total_count"], x["masked_count"])), ",").alias("codes")),
}
ORACLES |= {
    "audio_untouched": f"""with t as materialized (select audio, ord, start_time, start_ms, end_ms, quiet_ms from ({ORACLES['audio_intervals']}) join (select audio, ord, start_time from {as_sql('word_times')}) using (audio, ord))
        select audio, start_ms - quiet_ms as from_ms, start_ms as to_ms from t where quiet_ms > 0 union all
        select audio, end_ms, {_LENGTH} from (select *, row_number() over (partition by audio order by start_time desc, ord desc) as r from t) where r = 1 and end_ms < {_LENGTH}
        union all select distinct audio, 0, {_LENGTH} from {as_sql('word_times')} where audio not in (select audio from t)""",
    "media_codes": f"select file, string_agg(concat(code, ':', total_count, ':', masked_count), ',' order by code) as codes from ({ORACLES['media_rollup']}) group by 1",
}
