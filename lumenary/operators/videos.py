"""Video records from metadata and transcript segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions.dates import video_date
from lumenary.functions.folds import merge_transcript
from lumenary.functions.text import lines, present, strip

METADATA = ("id string, title string, channel string, uploader string, upload_date string, description string, view_count bigint, "
            "like_count bigint, duration bigint, categories array<string>, tags array<string>")


def transcripts(segments: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """key and blocks: the merged segments of each video in order. A transcript is one video's, so its array is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    blocks = merge_transcript(F.transform("segments", lambda s: F.coalesce(s["t"], F.lit(""))))
    return segments.groupBy(key).agg(ordered.alias("segments")).select(key, blocks.alias("blocks"))


def transcript_blocks(segments: DataFrame, key: str, position: str, text: str, block: int = R.TRANSCRIPT_BLOCK) -> DataFrame:
    """key, pos and block: the merged segments of each video, one row a block. As ``transcripts``, but no transcript is ever held: segments come
    sorted, and what is carried on from one to the next is the block being built, so a video of any length takes bounded memory."""
    kind = dict(segments.dtypes)[key]
    ordered = segments.select(F.col(key).alias("k"), F.col(position).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = ordered.filter(strip(F.col("t")) != "").repartition("k").sortWithinPartitions("k", "p", "t")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, held = None, 0, []  # the video, its blocks so far and the pieces of the next one
        size = 0
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((key_type, pa.int64(), pa.string()))], ["k", "pos", "raw"])
            out.clear()
            return made

        def close() -> None:
            nonlocal n, size
            if held:
                out.append((now, n, "".join(held)))
                n += 1
            held.clear()
            size = 0

        key_type = pa.string()
        first = True
        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if first or k != now:
                    close()
                    now, n, first = k, 0, False
                held += (" ", t)
                size += 1 + len(t)
                if size > block:
                    close()
            yield told()
        close()
        yield told()

    made = rows.select("k", "p", "t").mapInArrow(fold, f"k {kind}, pos long, raw string")
    return made.select(F.col("k").alias(key), "pos", strip(F.col("raw")).alias("block"))


def video_records(videos: DataFrame, metadata: DataFrame, blocks: DataFrame) -> DataFrame:
    """``videos`` (url, video_id) as raw records: metadata where there is any, and as content the transcript or else the
    lines of the description. A video without an id or metadata keeps its row."""
    m = metadata.select(F.col("id").alias("_id"), "title", "channel", "uploader", "upload_date", "description",
                        *[c for c in ("view_count", "like_count", "duration", "categories", "tags") if c in metadata.columns])
    b = blocks.select(F.col(blocks.columns[0]).alias("_video"), F.col("blocks"))
    both = videos.join(m, F.col("video_id") == F.col("_id"), "left").join(b, F.col("video_id") == F.col("_video"), "left")
    channel = F.coalesce(present(F.col("channel")), F.col("uploader"), F.lit(""))
    text = F.coalesce("description", F.lit(""))
    return both.select(
        *videos.columns, F.coalesce("title", F.lit("")).alias("title"), channel.alias("author"), F.array().cast("array<string>").alias("authors"),
        channel.alias("channel_name"), video_date(F.coalesce("upload_date", F.lit(""))).alias("published_date"), text.alias("description"),
        F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(lines(text, R.DESCRIPTION_LINE_CHARS)).alias("raw_text_sections"))
