"""Streams with state: admission, feedback, chunk streams and maintenance; and windows over the same metrics.

Every operator takes a streaming frame and gives one; run() drives one through what is there and returns the
result, with its checkpoint in the session's shared folder.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linewright.sources.tables import shared_folder

TAIL_BYTES, FLUSH_BYTES = 8192, 32_768
#: What a stream without a reason to finish is ended with.
TERMINATOR = (
    'data: {"id":"synthetic","object":"chat.completion.chunk","created":0,"model":"synthetic","choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}'
    "\n\ndata: [DONE]\n\n"
)
FINISHED = tuple(f'"finish_reason":"{r}"' for r in ("stop", "length", "tool_calls"))


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    import_path = f"{folder}/{name}.parquet*"
    return spark.readStream.schema(schema).parquet(import_path)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there, as a table in the shared folder (append) or in memory (complete)."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:
        name = f"lw_{uuid.uuid4().hex}"
        writer = stream.writeStream.format("memory").queryName(name)
    writer.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if mode == "append" else spark.table(name)


def admit(stream: DataFrame, key: str, time: str, limit: int, seconds: int, id_col: str = "event_id", expire: bool = False) -> DataFrame:
    """(id, key, allowed): up to `limit` of a key in the window of seconds that begins with its first event.

    State is one count and one time a key; with `expire`, for streams that go on, it goes ten windows after the
    key was last seen. Events of a batch are taken in order of time and id.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["us", id_col])
        allowed = []
        for t in rows["us"]:
            if begin is None or t - begin > seconds * 1_000_000:
                begin, n = int(t), 0
            allowed.append(n < limit)
            n += n < limit
        state.update((begin, int(n)))
        if expire:
            state.setTimeoutDuration(10 * seconds * 1000)
        yield pd.DataFrame({id_col: rows[id_col].to_numpy(), key: [k[0]] * len(rows), "allowed": allowed})

    timed = stream.select(id_col, key, F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    return timed.groupBy(key).applyInPandasWithState(
        step, f"{id_col} long, {key} {kind}, allowed boolean", "begin long, n int", "append",
        GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def feedback(stream: DataFrame, key: str, order: str, low: float = 0.30, high: float = 0.80, keep: int = 32, pause_us: int | None = None) -> DataFrame:
    """(order, key, paused) of turns (hit, total): a mean of the last five ratios under `low` pauses, over `high` resumes.

    With `pause_us`, turns that also have `us`, a pause ends after that time without a decision.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratios, since = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for hit, total, us in zip(rows["hit"], rows["total"], rows["us"], strict=True):
            if total > 0:
                ratios = [*ratios, float(hit / total)][-keep:]
                # added from the left, as SQL does; sum() compensates, which moves means that lie at a limit
                mean = reduce(operator.add, ratios[-5:]) / len(ratios[-5:])
                if mean < low:
                    since = int(us) if since is None else since
                elif since is not None and (mean > high or (pause_us is not None and us - since > pause_us)):
                    since = None
                out.append(mean < low or since is not None)
            else:
                out.append(since is not None)
        state.update((ratios, since))
        yield pd.DataFrame({order: rows[order].to_numpy(), key: [k[0]] * len(rows), "paused": out})

    timed = stream if "us" in stream.columns else stream.withColumn("us", F.lit(0).cast("long"))
    return timed.select(key, order, "hit", "total", "us").groupBy(key).applyInPandasWithState(
        step, f"{order} long, {key} {kind}, paused boolean", "ratios array<double>, since long", "append", GroupStateTimeout.NoTimeout)


def finished_streams(chunks: DataFrame, key: str = "stream", seq: str = "seq", text: str = "chunk", last: str = "last") -> DataFrame:
    """(key, finished, terminator): whether each ended stream of chunks named a reason to finish, wherever chunks were cut.

    State is the last bytes of a stream. One that ends without a reason gets a synthetic chunk, and others null.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, seen = state.get if state.exists else ("", False)
        rows = pd.concat(list(frames)).sort_values(seq)
        ended = False
        for chunk, end in zip(rows[text], rows[last], strict=True):
            tail = (tail.encode() + str(chunk).encode())[-TAIL_BYTES:].decode(errors="ignore")
            seen = bool(seen) or any(mark in tail for mark in FINISHED)
            ended = ended or bool(end)
        if ended:
            state.remove() if state.exists else None
            yield pd.DataFrame({key: [k[0]], "finished": [seen], "terminator": [None if seen else TERMINATOR]})
        else:
            state.update((tail, seen))

    return chunks.select(key, seq, text, last).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, finished boolean, terminator string", "tail string, seen boolean", "append", GroupStateTimeout.NoTimeout)


def flushed(chunks: DataFrame, key: str = "stream", seq: str = "seq", text: str = "chunk", last: str = "last", least: int = FLUSH_BYTES) -> DataFrame:
    """(key, n, bytes): chunks handed on together whenever they reach `least` bytes, and at a stream's end."""
    kind = chunks.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, size = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(seq)
        out = []
        for chunk, end in zip(rows[text], rows[last], strict=True):
            n, size = n + 1, size + len(str(chunk).encode())
            if size >= least or (end and size):
                out.append((n, size))
                n, size = 0, 0
        state.update((n, size))
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), "n": [x[0] for x in out], "bytes": [x[1] for x in out]})

    return chunks.select(key, seq, text, last).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, n int, bytes long", "n int, size long", "append", GroupStateTimeout.NoTimeout)


def stream_usage(chunks: DataFrame, key: str = "stream", seq: str = "seq", text: str = "chunk") -> DataFrame:
    """(key, prompt_tokens, completion_tokens, hit_tokens) of the last chunk that speaks of usage; 0 where a number is missing. A table, or a stream in complete mode."""
    said = chunks.filter(F.col(text).contains('"usage"') | F.col(text).contains('"prompt_tokens"'))
    last = said.groupBy(key).agg(F.max_by(text, seq).alias("t"))
    number = lambda n: F.coalesce(F.regexp_extract("t", f'"{n}":\\s*([0-9]+)', 1).try_cast("long"), F.lit(0))
    return last.select(key, number("prompt_tokens").alias("prompt_tokens"), number("completion_tokens").alias("completion_tokens"), number("prompt_cache_hit_tokens").alias("hit_tokens"))


def windowed_counts(stream: DataFrame, time: str, length: str, by: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, by, n, total) in windows of event time; events later than the watermark are left out."""
    timed = stream.withColumn("_lw_t", F.col(time).cast("timestamp")).withWatermark("_lw_t", late)
    counted = timed.groupBy(F.window("_lw_t", length, slide), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), by, "n", "total")


def first_seen(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """The first event of equal keys within a span of event time."""
    return stream.withColumn("_lw_t", F.col(time).cast("timestamp")).withWatermark("_lw_t", within).dropDuplicatesWithinWatermark(keys).drop("_lw_t")


def rounds_of(work: Callable[[], None], rounds: int, wait: Callable[[float], None], clock: Callable[[], float], pause: int = 120, slow: int = 60, longest: int = 1800) -> None:
    """Run maintenance again and again, waiting between rounds: twice as long after each slow one, as maintenance_delays tells."""
    delay = pause
    for _ in range(rounds):
        wait(delay)
        began = clock()
        work()
        delay = min(delay * 2, longest) if clock() - began > slow else pause


def maintain_index(docs: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], key: str = "doc_id", order: str | None = None, buckets: int = 64) -> DataFrame:
    """Postings kept in step with a stream of changed texts: each batch replaces the postings of its texts.

    Of several versions of a text in a batch the last by `order` counts, or any without one. A batch rewrites only
    the buckets of keys that it touches, which should be many for a large index. Returns the index after what is there.
    """
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def renew(batch: DataFrame, epoch: int) -> None:
        if order is not None:
            rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
            batch = batch.withColumn("_lw_rank", rank).filter("_lw_rank = 1").drop("_lw_rank")
        newest = batch.dropDuplicates([key]).persist()
        try:
            replace(newest, build(newest).withColumn("bucket", bucket), epoch)
        finally:
            newest.unpersist()

    def replace(newest: DataFrame, fresh: DataFrame, epoch: int) -> None:
        try:
            old = spark.read.parquet(path)
        except Exception as e:  # the first batch finds no index
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            fresh.write.partitionBy("bucket").parquet(path)
            return
        touched = [r[0] for r in newest.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        kept = old.filter(F.col("bucket").isin(touched)).join(newest.select(key), key, "left_anti")
        merged = kept.unionByName(fresh)
        staged = f"{path}-stage-{epoch}"
        merged.write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    docs.writeStream.foreachBatch(renew).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("bucket")
