"""The chain from raw capture rows to stored captures, for tables and for streams.

A capture row has ts, capture_id, user_id, app, title, idle_ms, diff_ratio, width, height, ocr_raw.
On tables the chain uses windows over each user's captures in order (ts, capture_id), cut by the hour: the
last state of every hour is handed on to the user's next one, so that a busy user's captures lie over many
tasks. On streams the same chain keeps a small state for each user. The gates, in order: idle users; overlay windows; no
change of title and too few changed pixels; short texts; the text that was seen last. With ``forget`` a user of whom
nothing was shown for so many seconds is new again, on tables and streams alike; a stream drops the state then. Captures
without a time are left out there.

The streams here keep their state by transformWithState, which needs the RocksDB state store: ``store_batches`` starts
them with it; who starts them otherwise sets ``STATE_STORE`` in the session first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.storage import with_settings

IDLE_MS, LEAST_DIFF, LEAST_TEXT, RESIZE, WATCH_SECONDS = 300_000, 0.15, 10, 100, 300
OVERLAY_APPS = ("Electron",)
#: A stream forgets a user after thirty days, and takes captures up to a day behind the newest.
FORGET_SECONDS, LATE = 30 * 86_400, "1 day"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Captures of one user are taken together by this length of time.
BUCKET = "hour"
#: Groups of users on a stream of many.
GROUPS = 4096


def _handed_on(captures: DataFrame, value: Column) -> tuple[DataFrame, Window]:
    """Rows with __value, and the window of a user's hour, which a row (with __real false) opens that holds the last value before the hour.

    Values that are null are passed over. The rows that open hours are one for each user and hour.
    """
    rows = captures.withColumn("__value", value).withColumn("__hour", F.date_trunc(BUCKET, "ts")).withColumn("__real", F.lit(True))
    last = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct("ts", "capture_id")))
    ends = rows.groupBy("user_id", "__hour").agg(last.alias("__value"))
    earlier = Window.partitionBy("user_id").orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    opened = ends.withColumn("__value", F.last("__value", ignorenulls=True).over(earlier)).where("__value IS NOT NULL").withColumn("__real", F.lit(False))
    return rows.unionByName(opened, allowMissingColumns=True), Window.partitionBy("user_id", "__hour").orderBy("__real", "ts", "capture_id")


def _with_before(captures: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the value (a struct) of the user's row before; null for the first."""
    rows, w = _handed_on(captures, value)
    return rows.withColumn(name, F.lag("__value").over(w)).where("__real").drop("__value", "__hour", "__real")


def is_overlay(app: Column, overlays: Sequence[str] = OVERLAY_APPS) -> Column:
    out = F.lit(False)
    for o in overlays:
        out = out | F.coalesce(app, F.lit("")).contains(o)
    return out


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def last_real_app(captures: DataFrame, overlays: Sequence[str] = OVERLAY_APPS) -> DataFrame:
    """Adds real_app: the newest app up to the row that is no overlay."""
    rows, w = _handed_on(captures, F.when(~is_overlay(F.col("app"), overlays), F.col("app")))
    newest = F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("real_app", newest).where("__real").drop("__value", "__hour", "__real")


def title_changes(captures: DataFrame) -> DataFrame:
    """Adds changed: app or title differ from the user's row before; a first row is a change."""
    held = _with_before(captures, F.struct("app", "title"), "__before")
    before = F.col("__before")
    same = before["app"].eqNullSafe(F.col("app")) & before["title"].eqNullSafe(F.col("title"))
    return held.withColumn("changed", before.isNull() | ~same).drop("__before")


def resizes(captures: DataFrame, most: int = RESIZE) -> DataFrame:
    """Rows whose width or height moved by more than ``most`` from the row before."""
    held = _with_before(captures, F.struct("width", "height"), "__before")
    before = F.col("__before")
    moved = (F.abs(F.col("width") - before["width"]) > most) | (F.abs(F.col("height") - before["height"]) > most)
    return held.where(F.coalesce(moved, F.lit(False))).drop("__before")


def drop_repeats(captures: DataFrame, text: str = "ocr_raw", keep: Column | None = None, run: Column | None = None) -> DataFrame:
    """Rows whose text differs from that of the user's row before (A, B, A stays whole); ``keep`` overrides.

    With ``run`` a row before of another run does not count.
    """
    own = F.struct(text_hash(F.col(text)).alias("hash"), (F.lit(0) if run is None else run).alias("run"))
    held = _with_before(captures, own, "__before")
    wanted = ~F.coalesce(F.col("__before") == own, F.lit(False))
    return held.where(wanted if keep is None else wanted | keep).drop("__before")


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def _in_runs(captures: DataFrame, forget: int) -> DataFrame:
    """Adds __run, the time of the row that opened the user's run (rows with no gap above ``forget`` seconds), and __opens."""
    held = _with_before(captures.withColumn("__at", _micros("ts")), F.struct(F.col("__at").alias("at")), "__before")
    opens = F.coalesce(F.col("__at") - F.col("__before")["at"] > forget * 1_000_000, F.lit(True))
    rows, w = _handed_on(held.withColumn("__opens", opens).drop("__before"), F.when(F.col("__opens"), F.col("__at")))
    newest = F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__run", newest).where("__real").drop("__value", "__hour", "__real", "__at")


def _shown(captures: DataFrame, overlays: Sequence[str]) -> DataFrame:
    return captures.where((F.coalesce("idle_ms", F.lit(0)) <= IDLE_MS) & ~is_overlay(F.col("app"), overlays))


def gated(captures: DataFrame, overlays: Sequence[str] = OVERLAY_APPS, forget: int | None = None) -> DataFrame:
    """The captures of a table that the chain stores, with changed."""
    shown = _shown(captures, overlays)
    if forget is not None:
        shown = _in_runs(shown.where("ts IS NOT NULL"), forget)
    titled = title_changes(shown)
    if forget is not None:
        titled = titled.withColumn("changed", F.col("changed") | F.col("__opens"))
    moved = titled.where(F.col("changed") | (F.coalesce("diff_ratio", F.lit(1.0)) > LEAST_DIFF))
    told = moved.where(F.length(F.coalesce("ocr_raw", F.lit(""))) >= LEAST_TEXT)
    return drop_repeats(told, keep=F.col("changed"), run=None if forget is None else F.col("__run")).drop("__run", "__opens")


def new_lines(current: Column, baseline: Column, least: int = 5) -> Column:
    """Trimmed lines longer than ``least`` that the baseline lacks; repeats stay."""
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    old = lines(baseline)
    return F.filter(lines(current), lambda x: (F.length(x) > least) & ~F.array_contains(old, x))


def _watched(captures: DataFrame, sessions: DataFrame, seconds: int) -> DataFrame:
    """Captures beside the sessions that watch them, with __ends (null where a session does not say when it started)."""
    pairs = captures.join(sessions, ["user_id", "app"])
    if "started_at" not in sessions.columns:
        return pairs.withColumn("__ends", F.lit(None).cast("timestamp"))
    start = F.col("started_at").cast("timestamp")
    ends, at = start + F.make_dt_interval(secs=F.lit(seconds)), F.col("ts").cast("timestamp")
    return pairs.withColumn("__ends", ends).where(start.isNull() | ((at >= start) & (at <= ends)))


def watch(captures: DataFrame, sessions: DataFrame, seconds: int = WATCH_SECONDS) -> DataFrame:
    """New lines of each watch session (session_id, user_id, app, baseline): each capture against the one before.

    Where sessions have started_at, a session takes captures from then on, ``seconds`` long.
    """
    pairs = _watched(captures, sessions, seconds)
    w = Window.partitionBy("session_id").orderBy("ts", "capture_id")
    fresh = new_lines(F.col("ocr_raw"), F.coalesce(F.lag("ocr_raw").over(w), F.col("baseline")))
    return pairs.withColumn("new_lines", fresh).where(F.size("new_lines") > 0).select("session_id", "capture_id", "ts", "new_lines")


def gated_stream(captures: DataFrame, overlays: Sequence[str] = OVERLAY_APPS, forget: int | None = FORGET_SECONDS, late: str = LATE, keep: Sequence[str] | None = None, groups: int | None = None) -> DataFrame:
    """The same chain on a stream: users' last windows, text hashes and times are the state.

    The state of a user is dropped ``forget`` seconds after the last capture, by a timer on the time of the captures.
    Captures that come more than ``late`` behind the newest are then left out by Spark, which counts them. None keeps every
    user, and takes captures however late. ``keep`` names the columns that the stored captures have (all, unless stated);
    what neither they nor the gates need is not sent to Python. Python is called once a user and batch, which costs more
    than a user's few captures; with ``groups`` once for each of so many groups of users (by a hash), whose timer looks for
    those whose time is over. State lies by group, so a stream goes on with the number that it began with.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    names = list(captures.columns if keep is None else keep)
    schema = ", ".join(f"`{n}` {captures.schema[n].dataType.simpleString()}" for n in names) + ", changed boolean"

    class Gate(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getMapState("last", "user string", "app string, title string, hash string, at long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(rows)).set_axis(columns, axis=1).sort_values(["__user", "ts", "capture_id"], kind="stable")
            kept, flags, user, held, oldest = [], [], None, None, None
            for i, (own, app, title, moved, long, digest, at) in enumerate(zip(*(rows[c].tolist() for c in gates))):
                if own != user:
                    if user is not None:
                        self.last.updateValue((user,), held)
                        oldest = held[3] if oldest is None else min(oldest, held[3])
                    user, held = own, self.last.getValue((own,))
                if held and forget is not None and at - held[3] > forget * 1_000_000:
                    held = None
                seen, before = held[2:] if held else (None, at)
                changed = held is None or (app, title) != tuple(held[:2])
                told = (changed or moved) and long
                if told and (changed or digest != seen):
                    kept.append(i)
                    flags.append(changed)
                held = (app, title, digest if told else seen, max(at, before))
            self.last.updateValue((user,), held)
            if forget is not None:
                self._look_at(ends(held[3] if oldest is None else min(oldest, held[3])))
            if kept:
                yield rows.iloc[kept][names].assign(changed=flags)

        def _look_at(self, end: int) -> None:
            """Look for users whose time is over at ``end`` or before."""
            if end < min(self.handle.listTimers(), default=end + 1):
                self.handle.registerTimer(end)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now, left = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), []
            for user, held in list(self.last.iterator()):
                if ends(held[3]) <= now:
                    self.last.removeKey(user)
                else:
                    left.append(ends(held[3]))
            if left:
                self.handle.registerTimer(min(left))
            return iter(())

        def close(self) -> None:
            pass

    def ends(at: int) -> int:
        # the first whole millisecond at which a capture would find the state forgotten
        return at // 1000 + forget * 1000 + 1

    # the user as text: null users are one user, as on tables
    user = F.to_json(F.struct("user_id"))
    own = {
        "__moved": F.coalesce("diff_ratio", F.lit(1.0)) > LEAST_DIFF, "__long": F.length(F.coalesce("ocr_raw", F.lit(""))) >= LEAST_TEXT,
        "__hash": text_hash(F.col("ocr_raw")), "__at": F.coalesce(_micros("ts"), F.lit(0)), "__user": user,
        "__group": user if groups is None else F.pmod(F.xxhash64(user), F.lit(groups)).cast("int"),
    }
    gates = ["__user", "app", "title", "__moved", "__long", "__hash", "__at"]
    shown = _shown(captures, overlays).withColumns(own)
    columns = list(dict.fromkeys([*names, "ts", "capture_id", *gates, "__group"]))
    if forget is not None:
        shown = shown.where("ts IS NOT NULL").withColumn("__event", F.col("ts").cast("timestamp")).withWatermark("__event", late)
        columns.append("__event")
    return shown.select(*columns).groupBy("__group").transformWithStateInPandas(Gate(), schema, "Append", "None" if forget is None else "EventTime")


def watch_stream(captures: DataFrame, sessions: DataFrame, seconds: int = WATCH_SECONDS, late: str = "0 seconds") -> DataFrame:
    """Watch sessions on a stream: the last text is the state, dropped by a timer when the stream's time is past the
    session's end. Sessions that do not say when they started have none, and keep their state.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    timed = captures.withColumn("__event", F.col("ts").cast("timestamp")).withWatermark("__event", late)
    pairs = _watched(timed, sessions, seconds)
    joined = pairs.select("session_id", "capture_id", "ts", "ocr_raw", "baseline", F.unix_millis("__ends").alias("ends"), "__event")
    ident = captures.schema["capture_id"].dataType.simpleString()
    when = captures.schema["ts"].dataType.simpleString()

    def lines(text: str | None) -> list[str]:
        return [x for x in (y.strip() for y in (text or "").split("\n")) if x]

    class Watch(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.base = handle.getValueState("base", "text string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            base = self.base.get()[0] if self.base.exists() else None
            new, out = base is None, []
            rows = pd.concat(list(rows)).sort_values(["ts", "capture_id"], kind="stable")
            for r in rows.itertuples(index=False):
                old = set(lines(r.baseline if base is None else base))
                fresh = [x for x in lines(r.ocr_raw) if len(x) > 5 and x not in old]
                base = r.ocr_raw or ""
                if fresh:
                    out.append((key[0], r.capture_id, r.ts, fresh))
            self.base.update((base,))
            ends = rows["ends"].iloc[0]
            if new and not pd.isna(ends):
                self.handle.registerTimer(int(ends) + 1)
            yield pd.DataFrame(out, columns=["session_id", "capture_id", "ts", "new_lines"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.base.clear()
            return iter(())

        def close(self) -> None:
            pass

    schema = f"session_id string, capture_id {ident}, ts {when}, new_lines array<string>"
    return joined.groupBy("session_id").transformWithStateInPandas(Watch(), schema, "Append", "EventTime")


def hourly_counts(captures: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Captures by user, app and hour of a stream, with bounded state for late rows."""
    return captures.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "user_id", "app").agg(F.count("*").alias("captures"))


def capture_entities(captures: DataFrame, most_files: int = 10, title_chars: int = 255) -> DataFrame:
    """APP, WINDOW_TITLE and FILE entities of stored captures (files: an array column)."""
    e = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("entity"))
    files = F.transform(F.slice(F.coalesce("files", F.array().cast("array<string>")), 1, most_files), lambda x: e("FILE", x))
    every = F.concat(F.array(e("APP", F.col("app")), e("WINDOW_TITLE", F.substring("title", 1, title_chars))), files)
    named = F.filter(every, lambda x: F.coalesce(x["entity"], F.lit("")) != "")
    return captures.select(F.col("capture_id").alias("memory_id"), F.explode(named).alias("e")).select("memory_id", "e.type", "e.entity", F.lower("e.entity").alias("normalized_value"))


def store_batches(captures: DataFrame, folder: str, checkpoint: str, once: bool = False):
    """Start a query that appends each micro-batch as Parquet; a batch written twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    writer = captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with with_settings(captures.sparkSession, STATE_STORE):
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
