"""Boxes of video frames and words of transcripts: clipping, sampling, tracks, masking intervals."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import strip

LEAST_CONFIDENCE, REACH, BUFFER_MS, LEAST_MS = 0.3, 25, 25, 50
TRACK_GAP, TRACK_IOU = 30, 0.25


def clipped(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes cut to the picture; those without area or with a negative corner are left out."""
    ok = boxes.where("x >= 0 and y >= 0 and w > 0 and h > 0 and frame % 2 = 1")
    return ok.withColumns({"w": F.least(F.col("w"), F.lit(width) - F.col("x")), "h": F.least(F.col("h"), F.lit(height) - F.col("y"))}).where("w > 0 and h > 0")


def confident_pictures(boxes: DataFrame) -> DataFrame:
    """Boxes of pictures whose least confidence is not below the gate: others count as masked already."""
    least = F.min("confidence").over(W.partitionBy("video", "frame"))
    return boxes.withColumn("_least", least).where(F.col("_least") >= LEAST_CONFIDENCE).drop("_least")


def regions_by_frame(boxes: DataFrame) -> DataFrame:
    """Boxes repeated for every frame within reach of theirs."""
    return boxes.where("w > 0 and h > 0").withColumn("frame", F.explode(F.sequence(F.greatest(F.lit(1), F.col("frame") - REACH), F.col("frame") + REACH)))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def iou_with_last(boxes: DataFrame) -> DataFrame:
    """(id, iou) with the box before in the same video and label."""
    by = W.partitionBy("video", "label").orderBy("frame", "x", "id")
    now, last = ({k: f(k) for k in "xywh"} for f in (F.col, lambda k: F.lag(k).over(by)))
    return boxes.select("id", iou(now, last).alias("iou"))


def intervals(words: DataFrame, length_ms: int) -> DataFrame:
    """(audio, ord, start_ms, end_ms, quiet_ms): tones over words; quiet_ms is the untouched time before each."""
    a, b = (F.col("start_time") * 1000).cast("int"), (F.col("end_time") * 1000).cast("int")
    rows = words.withColumns({"_a": a, "_b": b}).where("_a < _b")
    rows = rows.withColumns({"_s": F.greatest(F.lit(0), F.col("_a") - BUFFER_MS), "_e": F.least(F.col("_b") + BUFFER_MS, F.lit(length_ms))})
    short = F.col("_e") - F.col("_s") < LEAST_MS
    rows = rows.withColumns({"_s": F.when(short, F.col("_a")).otherwise(F.col("_s")), "_e": F.when(short, F.col("_b")).otherwise(F.col("_e"))})
    rows = rows.withColumn("start_ms", F.greatest(F.lit(0), F.least("_s", F.lit(length_ms))))
    rows = rows.withColumn("end_ms", F.greatest(F.col("start_ms") + LEAST_MS, F.least("_e", F.lit(length_ms))))
    before = F.coalesce(F.lag("end_ms").over(W.partitionBy("audio").orderBy("start_time", "ord")), F.lit(0))
    return rows.withColumn("quiet_ms", F.greatest(F.lit(0), F.col("start_ms") - before)).select("audio", "ord", "start_ms", "end_ms", "quiet_ms")


def untouched(words: DataFrame, files: DataFrame, length_ms: int) -> DataFrame:
    """(audio, from_ms, to_ms): the stretches of files (audio) without a tone, each from the end of the tone before; the last one reaches to the end. Files without words are one stretch."""
    tones = intervals(words, length_ms)
    before = tones.where("quiet_ms > 0").select("audio", (F.col("start_ms") - F.col("quiet_ms")).alias("from_ms"), F.col("start_ms").alias("to_ms"))
    last = words.select("audio", "ord", "start_time").join(tones, ["audio", "ord"]).groupBy("audio").agg(F.max_by("end_ms", F.struct("start_time", "ord")).alias("from_ms"))
    ends = files.select("audio").distinct().join(last, "audio", "left").select("audio", F.coalesce("from_ms", F.lit(0)).alias("from_ms"), F.lit(length_ms).alias("to_ms"))
    return before.unionByName(ends.where("from_ms < to_ms"))


def codes_listed(rollup: DataFrame) -> DataFrame:
    """(file, codes) of rows of media_rollup: an array of (code, total_count, masked_count), codes ascending."""
    return rollup.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("code", "total_count", "masked_count"))).alias("codes"))


def _tracks(group: pd.DataFrame) -> pd.DataFrame:
    last: dict[int, tuple[int, int, int, int, int]] = {}  # tracks that can go on
    ids, total = [], 0
    group = group.sort_values(["frame", "x", "id"])
    for frame, x, y, w, h in group[["frame", "x", "y", "w", "h"]].itertuples(index=False):
        for k, (f, x2, y2, w2, h2) in list(last.items()):
            if frame - f > TRACK_GAP:
                del last[k]
                continue
            both = max(0, min(x + w, x2 + w2) - max(x, x2)) * max(0, min(y + h, y2 + h2) - max(y, y2))
            union = w * h + w2 * h2 - both
            if f != frame and union > 0 and both / union >= TRACK_IOU:
                break
        else:
            k, total = total, total + 1
        last[k] = (frame, x, y, w, h)
        ids.append(k)
    return group[["video", "label", "part", "id"]].assign(track=ids)


def tracks(boxes: DataFrame) -> DataFrame:
    """(video, label, id, track): boxes joined to the first track whose last box is near in time and place.

    A gap of more than TRACK_GAP frames ends all tracks: what lies between two gaps is a part of its own, and state is kept for
    one part of a video and label. Tracks are numbered on from part to part.
    """
    by = W.partitionBy("video", "label").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(by) > TRACK_GAP
    rows = boxes.where("w > 0 and h > 0").withColumn("part", F.coalesce(gap.cast("long"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("part").over(by))
    found = rows.groupBy("video", "label", "part").applyInPandas(_tracks, "video long, label string, part long, id long, track long")
    number = F.dense_rank().over(W.partitionBy("video", "label").orderBy("part", "track"))
    return found.select("video", "label", "id", (number - 1).cast("long").alias("track"))


def times_within(start: Column, end: Column, first: Column, last: Column, length: Column) -> tuple[Column, Column]:
    """Start and end time of the characters first to last of a word of a length that is spoken from start to end."""
    share = lambda n, empty: F.when(length > 0, n / length).otherwise(empty)
    return start + (end - start) * share(first, 0.0), start + (end - start) * share(last, 1.0)


def sampled_for_text(boxes: DataFrame, every: int = 20) -> DataFrame:
    """Boxes of the frames in which text is looked for."""
    return boxes.where(F.col("frame") % every == 0)


def video_message(faces: Column, audio: Column, texts: Column) -> Column:
    """(status, message) of a video's scan from what was counted."""
    found = (faces > 0) | (audio > 0) | (texts > 0)
    return F.struct(F.when(found, "detected").otherwise("no_pii").alias("status"), F.when(found, F.format_string(rules.VIDEO_FOUND, faces, audio, texts)).otherwise(rules.VIDEO_CLEAN).alias("message"))


def media_rollup(*counts: DataFrame) -> DataFrame:
    """(file, code, total_count, masked_count) over counts of documents, pictures, audio and video, each with these columns."""
    rows = reduce(DataFrame.unionByName, (c.select("file", "code", "total_count", "masked_count") for c in counts))
    return rows.groupBy("file", "code").agg(F.sum("total_count").alias("total_count"), F.sum("masked_count").alias("masked_count"))


def file_stats(files: DataFrame, spans_: DataFrame) -> DataFrame:
    """(file, n, avg_confidence, labels, methods) of every file: entities, their mean confidence (0 without any), and counts by label and by method, a missing one being the model's."""
    method = F.coalesce("method", F.lit("koelectra"))
    small = spans_.groupBy("file", "label", method.alias("method")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))  # a few rows for each file

    def counts(name: str) -> DataFrame:
        by = small.groupBy("file", name).agg(F.sum("n").alias("n"))
        return by.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias(f"{name}s"))

    total = small.groupBy("file").agg(F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("avg_confidence"))
    return files.join(total, "file", "left").join(counts("label"), "file", "left").join(counts("method"), "file", "left").fillna(0, ["n"]).fillna(0.0, ["avg_confidence"])


def word_matches(words: DataFrame, wanted: DataFrame, most: int = 11) -> DataFrame:
    """(audio, entity, start_time, end_time) of wanted texts (audio, entity, text) in transcripts (audio, ord, word, start_time, end_time).

    First word that is the text; else the first that holds it, by its share of the word; else
    the words from the transcript's start, most at most, whose joined text holds it. Texts
    without a match, blank ones and empty times are left out. A tie goes to the lower ord.
    """
    said = words.select("audio", "ord", strip(F.col("word")).alias("w"), F.col("start_time").alias("a"), F.col("end_time").alias("b"))
    asked = wanted.select("audio", "entity", strip(F.col("text")).alias("t")).where("t <> ''").distinct()
    times = lambda first, last: F.struct(first.alias("start_time"), last.alias("end_time"))
    by_order = lambda value: F.min_by(value, "ord")
    exact = said.join(asked, (said["audio"] == asked["audio"]) & (said["w"] == asked["t"])).groupBy(asked["audio"], "entity", "t").agg(by_order(times(F.col("a"), F.col("b"))).alias("exact"))
    inner = said.groupBy("audio", "w").agg(F.min("ord").alias("ord"), F.min_by("a", "ord").alias("a"), F.min_by("b", "ord").alias("b"))  # each word once
    at = F.expr("instr(w, t)") - 1
    share = lambda n: F.col("a") + (F.col("b") - F.col("a")) * n / F.length("w")
    part = inner.join(asked, (inner["audio"] == asked["audio"]) & F.expr("instr(w, t) > 0")).groupBy(asked["audio"], "entity", "t").agg(by_order(times(share(at), share(at + F.length("t")))).alias("part"))
    head = said.withColumn("r", F.row_number().over(W.partitionBy("audio").orderBy("ord"))).where(F.col("r") <= most)
    upto = W.partitionBy("audio").orderBy("r")
    head = head.select("audio", F.col("r").alias("ord"), F.replace(F.array_join(F.collect_list("w").over(upto), ""), F.lit(" "), F.lit("")).alias("said"), F.first("a").over(upto).alias("a"), "b")
    joined = head.join(asked, (head["audio"] == asked["audio"]) & F.expr("instr(said, replace(t, ' ', '')) > 0")).groupBy(asked["audio"], "entity", "t").agg(by_order(times(F.col("a"), F.col("b"))).alias("joined"))
    by = ["audio", "entity", "t"]
    rows = asked.join(exact, by, "left").join(part, by, "left").join(joined, by, "left").select("audio", "entity", F.coalesce("exact", "part", "joined").alias("x"))
    return rows.select("audio", "entity", "x.*").where("start_time < end_time")


def _lines(page: pd.DataFrame) -> pd.DataFrame:
    out: list[list] = []
    for t in page.sort_values(["y1", "x1", "token"]).itertuples(index=False):
        if out:
            x1, y1, x2, y2, text, confidence = out[-1]
            high = (y2 - y1 + t.y2 - t.y1) / 2
            if abs((y1 + y2) / 2 - (t.y1 + t.y2) / 2) < 0.5 * high and t.x1 - x2 < 1.5 * high:
                out[-1] = [min(x1, t.x1), min(y1, t.y1), max(x2, t.x2), max(y2, t.y2), f"{text} {t.text}", (confidence + t.confidence) / 2]
                continue
        out.append([t.x1, t.y1, t.x2, t.y2, t.text, t.confidence])
    lines = pd.DataFrame(out, columns=["x1", "y1", "x2", "y2", "text", "confidence"])
    return lines.assign(page=page["page"].iloc[0], line=range(len(lines)))


def lines_of(tokens: DataFrame) -> DataFrame:
    """(page, line, x1, y1, x2, y2, text, confidence): upright boxes of read text joined from the top left while they go on in their line; one page in a task."""
    return tokens.groupBy("page").applyInPandas(_lines, "page long, line long, x1 double, y1 double, x2 double, y2 double, text string, confidence double")
