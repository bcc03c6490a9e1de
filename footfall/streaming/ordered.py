"""Keyed streams in event-time order.

Events arrive out of order: devices send old ones later, feeds lag.  The
processors here hold a key's rows until the watermark has passed them and only
then hand them on, oldest first, woken by event-time timers.  A row that comes
behind the watermark can no longer take its place: it is put out at once with
``late`` set, so every input row comes out once, or is still held.

Many small keys share a group (``buckets``), since each group costs its own
state calls.  A group is dealt over ``salts`` sub-groups where its rows don't
depend on each other: rows that set a state (consent changes, content marks) go
to every sub-group, rows that read it to one; frames go by their time.  A hot
key is then ``salts`` tasks' work.

What is held per sub-group are the rows of the watermark's delay, as Arrow
tables, and the small state named with each processor.

Where only a tick's newest rows can matter (``Ticks``), the tasks that read the
input sort them out before the shuffle (``thinned``).  The rows left over go on
packed, many to a row, since those behind the watermark must come out as late."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from footfall.operators.trailing import SUMMED, TRENDED, trailing_state, window_starts

try:  # as in jobs.py: the workers need not have the package
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

#: What every ordered row has: its event time, its rank among rows of that time, a tie-breaker, the rest as JSON, and its key.
ROW = "ts_us bigint, kind int, id string, payload string, name string"
OUT = "key string, ts_us bigint, id string, payload string, extra string, late boolean"
#: Kind of a frame that others can reach back to but that comes out elsewhere.
COPY = 2
#: Kind of a row that stands for many rows (``ts_us`` and ``id`` as an Arrow stream in ``spare``) which no figure needs.
SPARE = 3
#: Sub-groups beside a key's own that its spare rows are dealt over.
SPARES = 8


def stream_of(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def table_of(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(stream)).read_all()


class Newest:
    """Keeps the newest ``most`` rows (by ts_us, then id) of each tick of a key, of as many rows as fit ``limit``.

    No window of at most ``most`` rows that ends at a tick's last row reaches the others.  They are newer than the rest of their
    tick, so if one of the rest came in time they did too.  Where ticks are sparse nothing is left out, and rows are handed on
    whenever more than half of ``limit`` would stay."""

    def __init__(self, most: int, every_us: int, name: str, limit: int = 500_000) -> None:
        self.most, self.every_us, self.name, self.limit = most, every_us, name, limit
        self.held, self.rows = [], 0

    def place(self, table: pa.Table) -> tuple[pa.Table, pa.Table]:
        """The rows kept and the others, both in order of key and time; a row without a time has no place."""
        table = table.filter(pc.is_valid(table["ts_us"]))
        if not len(table):
            return table, table
        code = pc.fill_null(pc.cast(pc.dictionary_encode(table[self.name]).combine_chunks().indices, pa.int64()), -1)
        order = pc.sort_indices(pa.table({"code": code, "ts_us": table["ts_us"], "id": table["id"]}),
                                [("code", "ascending"), ("ts_us", "ascending"), ("id", "ascending")])
        codes = code.take(order).to_numpy(zero_copy_only=False)
        ticks = table["ts_us"].take(order).to_numpy() // self.every_us
        last = np.append(np.flatnonzero((codes[1:] != codes[:-1]) | (ticks[1:] != ticks[:-1])), len(ticks) - 1)
        newer = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(ticks))
        order = order.to_numpy(zero_copy_only=False)
        return tuple(table.take(pa.array(order[x])) for x in (newer < self.most, newer >= self.most))

    def add(self, table: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
        """Tables of rows to go on with and of others, as far as they are known."""
        self.held.append(table)
        self.rows += len(table)
        if self.rows >= self.limit:
            kept, others = self.place(pa.concat_tables(self.held))
            self.held, self.rows = [], 0
            if 2 * len(kept) <= self.limit:
                self.held, self.rows, kept = [kept], len(kept), kept.slice(0, 0)
            yield kept, others

    def rest(self) -> Iterator[tuple[pa.Table, pa.Table]]:
        if self.held:
            yield self.place(pa.concat_tables(self.held))
        self.held, self.rows = [], 0


def thinned(most: int, every_us: int, limit: int = 500_000, piece: int = 100_000):
    """A function for ``mapInArrow``: rows key, ts_us, kind, id, payload come out with ``spare`` and ``salt``, all but the
    :class:`Newest` of each tick packed in rows of kind ``SPARE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newest = Newest(most, every_us, "key", limit)

        def batch_of(columns, like):
            types = [*(pa.field(f.name, f.type) for f in like.schema), pa.field("spare", pa.binary()), pa.field("salt", pa.int32())]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=pa.schema(types))

        def out(parts):
            for kept, others in parts:
                for a in range(0, len(kept), 10_000):
                    t = kept.slice(a, 10_000)
                    yield batch_of([*t.columns, pa.nulls(len(t), pa.binary()), pa.array(np.zeros(len(t), np.int32))], t)
                if not len(others):
                    continue
                code = pc.fill_null(pc.cast(pc.dictionary_encode(others["key"]).combine_chunks().indices, pa.int64()), -1).to_numpy(zero_copy_only=False)
                at = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
                for a, b in ((x, min(x + piece, end)) for begin, end in zip(at, at[1:]) for x in range(begin, end, piece)):
                    t = others.slice(a, b - a)
                    first = t["ts_us"][0].as_py()
                    row = {"key": t["key"][:1], "ts_us": pa.array([first], pa.int64()), "kind": pa.array([SPARE], pa.int32())}
                    row |= {c: pa.nulls(1, t[c].type) for c in ("id", "payload")}
                    yield batch_of([*(row[c] for c in t.column_names), pa.array([stream_of(t.select(["ts_us", "id"]))], pa.binary()),
                                    pa.array([1 + first // every_us % SPARES], pa.int32())], t)

        for batch in batches:
            yield from out(newest.add(pa.Table.from_batches([batch])))
        yield from out(newest.rest())

    return run


class InOrder(StatefulProcessor):
    """Holds rows, releases them in order to ``step``; late rows come out marked."""

    COLUMNS = (("ts_us", pa.int64()), ("kind", pa.int32()), ("id", pa.string()), ("payload", pa.string()), ("name", pa.string()))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.state = handle.getValueState("state", "value string")
        self.schema = pa.schema(self.COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000, None
        for batch in rows:
            gone = batch[(batch["ts_us"] < passed) & (batch["kind"] != COPY)]
            if len(gone):
                yield self.frame([(k, int(t), i, p, None, True) for k, t, i, p in zip(gone["name"], gone["ts_us"], gone["id"], gone["payload"])])
            fresh = batch[batch["ts_us"] >= passed]
            if len(fresh):
                self.hold(pa.Table.from_pandas(fresh[self.schema.names], self.schema, preserve_index=False))
                first = min(int(fresh["ts_us"].min()), first if first is not None else 2**62)
        if first is not None:
            self.held()
            self.wake(first)

    def hold(self, table: pa.Table) -> None:
        """Puts rows ahead of the watermark with those that wait."""
        for a in range(0, len(table), 100_000):
            self.waiting.appendValue((stream_of(table.slice(a, 100_000)),))

    def held(self) -> None:
        """All rows of a key in a batch have gone through ``hold``."""

    def wake(self, ts_us: int) -> None:
        """A timer for the moment at which ``ts_us`` lies behind the watermark."""
        self.handle.registerTimer(ts_us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [table_of(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        table = pa.concat_tables(held) if held else self.schema.empty_table()
        ripe = table.filter(pc.less(table["ts_us"], passed))
        if len(ripe):
            rest = table.filter(pc.greater_equal(table["ts_us"], passed))
            if len(rest):
                self.waiting.put([(stream_of(t),) for t in (rest.slice(a, 100_000) for a in range(0, len(rest), 100_000))])
                self.wake(pc.min(rest["ts_us"]).as_py())
            else:
                self.waiting.clear()
            ripe = ripe.take(pc.sort_indices(ripe, [("ts_us", "ascending"), ("kind", "ascending"), ("id", "ascending")]))
        del held, table
        for out in self.released(key[0], ripe, passed):
            for a in range(0, len(out), 10_000):
                yield self.frame(out[a : a + 10_000])

    def released(self, key, ripe: pa.Table, passed_us: int) -> Iterator[list[tuple]]:
        """What comes out for the rows behind ``passed_us``, which are in order."""
        yield self.step(key, zip(*(ripe[c].to_pylist() for c in self.schema.names)), passed_us)

    def recall(self, default):
        return json.loads(self.state.get()[0]) if self.state.exists() else default

    def remember(self, value) -> None:
        self.state.update((json.dumps(value),))

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        name, ts, ids, payload, extra, late = zip(*rows)
        return pd.DataFrame({"key": list(name), "ts_us": np.array(ts, np.int64), "id": list(ids), "payload": list(payload), "extra": list(extra), "late": np.array(late, bool)})

    def step(self, key, rows: Iterator[tuple], passed_us: int) -> list[tuple]:
        """What comes out, as tuples of OUT, for the rows (tuples of ROW) behind ``passed_us``."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class LastMark(InOrder):
    """Rows of kind 0 set their key's mark (payload; null clears it), rows of kind 1 come out with it as ``extra``."""

    def step(self, key, rows, passed_us):
        marks, out, known = dict(self.recall([])), [], False
        for ts, kind, ident, payload, name in rows:
            if kind == 0:
                marks[name], known = payload, True
            else:
                out.append((name, ts, ident, payload, marks.get(name), False))
        if known:
            self.remember([[name, mark] for name, mark in marks.items() if mark is not None])
        return out


class Retained(InOrder):
    """Frames held for as long as the privacy mode of their time says; the log of what is held.

    Rows of kind 0 switch the mode (payload), rows of kind 1 are frames.  Out
    comes ``hold`` for each frame, then once ``expire`` at its time plus the
    mode's seconds or ``clear`` at the moment the mode turns to ``wipe``.
    A frame leaves the state with that row.  A group is one key.
    """

    def __init__(self, seconds: dict[str, int], default: str, wipe: str) -> None:
        self.seconds, self.default, self.wipe = seconds, default, wipe

    def step(self, key, rows, passed_us):
        state = self.recall({"mode": self.default, "held": []})
        held, out = state["held"], []
        for ts, kind, ident, payload, _ in rows:
            if kind == 0:
                state["mode"] = payload
                if payload == self.wipe:
                    out += [(key, e, i, m, "expire", False) if e <= ts else (key, ts, i, m, "clear", False) for e, i, m in held]
                    held = []
            else:
                held.append((ts + self.seconds[state["mode"]] * 1_000_000, ident, state["mode"]))
                out.append((key, ts, ident, state["mode"], "hold", False))
        out += [(key, e, i, m, "expire", False) for e, i, m in held if e < passed_us]
        state["held"] = [h for h in held if h[0] >= passed_us]
        if state["held"]:
            self.wake(min(h[0] for h in state["held"]))
        self.remember(state)
        return out


#: A window's figures as JSON, see :func:`footfall.operators.trailing.trailing_state`.
FIGURES = ("struct<n:bigint,s:struct<{s}>,h1:struct<{h}>,h2:struct<{h}>,ss:struct<cc:double,dn:double>,flow:string,flows:int,"
           "peak:double,peak_ts:bigint>").format(s=",".join(f"{m}:double" for m in SUMMED), h=",".join(f"{m}:double" for m in TRENDED))


class Recent(InOrder):
    """Frames with the figures of the last ``most`` frames that are at most ``horizon_us`` old.

    ``payload`` is a frame's metrics as JSON, ``extra`` of what comes out the
    figures as JSON.  A group is one key, or every n-th stretch of its time with
    copies of the frames that the stretch can reach back to."""

    def __init__(self, most: int, horizon_us: int) -> None:
        self.most, self.horizon_us = most, horizon_us

    def figures(self, rows: list[tuple], wanted: list[int]) -> list[str]:
        """The figures at the places ``wanted`` of ``rows``; ``self.recent`` goes on to what the next row can reach."""
        every, old = [*self.recent, *rows], len(self.recent)
        if not rows:
            return []
        us = np.array([r[0] for r in every], np.int64)
        start = window_starts(us, np.arange(1, len(us) + 1), self.most, self.horizon_us)
        # The next frame can reach back no further than the last one's window, less its oldest if that is full.
        self.recent = [list(r) for r in every[max(int(start[-1]), len(every) - self.most + 1) :]]
        out, hi = [], np.array(wanted, np.int64) + old
        for at in (hi[a : a + 8192] for a in range(0, len(hi), 8192)):
            lo, base = start[at], int(start[at[0]])
            need = np.cumsum(np.bincount(lo - base, minlength=at[-1] - base + 2) - np.bincount(at - base + 1, minlength=at[-1] - base + 2)) > 0
            items = [json.loads(every[base + i][3]) if need[i] else {} for i in range(at[-1] - base + 1)]
            x = {m: np.nan_to_num(np.array([i.get(m) or 0.0 for i in items], float), nan=0.0, posinf=np.inf, neginf=-np.inf) for m in SUMMED}
            flows = [i.get("flow_direction") for i in items]
            kinds = {f: n for n, f in enumerate(dict.fromkeys(flows))}
            labels = list(dict.fromkeys("unknown" if f is None else f for f in kinds))
            label_of = np.array([labels.index("unknown" if f is None else f) for f in kinds])
            f = {c: v.tolist() for c, v in trailing_state(x, np.array([kinds[f] for f in flows]), label_of, lo - base, at - base).items()}
            out += [json.dumps({
                "n": f["n"][i], "s": {m: f[f"s_{m}"][i] for m in SUMMED}, "h1": {m: f[f"h1_{m}"][i] for m in TRENDED},
                "h2": {m: f[f"h2_{m}"][i] for m in TRENDED}, "ss": {"cc": f["ss_cc"][i], "dn": f["ss_dn"][i]}, "flow": labels[f["label"][i]],
                "flows": f["kinds"][i], "peak": f["peak"][i], "peak_ts": int(us[base + f["peak_at"][i]])}) for i in range(len(at))]
        return out

    def step(self, key, rows, passed_us):
        rows = list(rows)
        if not rows:
            return []
        self.recent = self.recall([])
        wanted = [i for i, r in enumerate(rows) if r[1] != COPY]
        out = [(rows[i][4], rows[i][0], rows[i][2], None, x, False) for i, x in zip(wanted, self.figures(rows, wanted))]
        self.remember(self.recent)
        return out


class Ticks(Recent):
    """The figures of :class:`Recent` as they stand at the end of every tick of ``every_us``.

    A tick without a frame repeats the last one's figures (payload ``repeated``),
    woken by a timer, until ``quiet_us`` after the last frame; then the key is
    silent until it sends again.  ``ts_us`` is the tick's end.  A group is one key.
    Of a tick only the last ``most`` frames wait, and frames are looked at ``piece`` at a time."""

    def __init__(self, most: int, horizon_us: int, every_us: int, quiet_us: int, piece: int = 50_000) -> None:
        super().__init__(most, horizon_us)
        self.every_us, self.quiet_us, self.piece = every_us, quiet_us, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = Newest(self.most, self.every_us, "name")

    def handleInputRows(self, key, rows, timerValues):
        yield from super().handleInputRows(key, self.opened(rows, max(timerValues.getCurrentWatermarkInMs(), 0) * 1000), timerValues)

    def opened(self, rows: Iterator[pd.DataFrame], passed_us: int) -> Iterator[pd.DataFrame]:
        """The rows, and of those that are packed the ones behind ``passed_us``."""
        for batch in rows:
            spare = batch["kind"] == SPARE
            yield batch[~spare]
            for name, stream in batch.loc[spare & (batch["ts_us"] < passed_us), ["name", "spare"]].itertuples(index=False):
                t = table_of(stream)
                t = t.filter(pc.less(t["ts_us"], passed_us))
                yield pd.DataFrame({"ts_us": t["ts_us"].to_numpy(), "kind": 1, "id": t["id"].to_pylist(), "payload": None, "name": name})

    def hold(self, table):
        for kept, _ in self.newest.add(table):
            super().hold(kept)

    def held(self):
        for kept, _ in self.newest.rest():
            super().hold(kept)

    def released(self, key, ripe, passed_us):
        state = self.recall({"recent": [], "tick": None})
        self.recent = state["recent"]
        if len(ripe):
            ripe = self.newest.place(ripe)[0]
        for a in range(0, len(ripe), self.piece):
            yield self.ticks(key, state, [*zip(*(ripe[c].slice(a, self.piece).to_pylist() for c in self.schema.names))])
        yield self.until(key, state, passed_us)
        if state["tick"] is not None:
            self.wake(state["tick"])
        state["recent"] = self.recent
        self.remember(state)

    def until(self, key, state: dict, end: int) -> list[tuple]:
        """The open tick and its repeats that end at or before ``end``."""
        out = []
        while state["tick"] is not None and state["tick"] <= end:
            if state["tick"] > state["last"] + self.quiet_us + self.every_us:
                state["tick"] = None
                break
            out.append((key, state["tick"], state["id"], state["is"], state["list"], False))
            state["tick"], state["is"] = state["tick"] + self.every_us, "repeated"
        return out

    def ticks(self, key, state: dict, rows: list[tuple]) -> list[tuple]:
        """What comes out before the tick of the last of ``rows``, which is then open."""
        ticks = [r[0] // self.every_us for r in rows]
        last = [i for i, t in enumerate(ticks) if i + 1 == len(ticks) or ticks[i + 1] != t]
        out = []
        for i, text in zip(last, self.figures(rows, last)):
            end = (ticks[i] + 1) * self.every_us
            out += self.until(key, state, end - self.every_us)
            state.update({"tick": end, "last": rows[i][0], "id": rows[i][2], "is": "frame", "list": text})
        return out


class Crossing(InOrder):
    """Rows of a key whose trailing weight of ``horizon_us`` reaches ``threshold`` while the row before was under it.

    ``payload`` is a row's weight; ``extra`` of what comes out the trailing
    weight, all rows of one time counted.  The state per key is the weights that
    its last row could still reach, and its trailing weight."""

    def __init__(self, horizon_us: int, threshold: float) -> None:
        self.horizon_us, self.threshold = horizon_us, threshold

    def step(self, key, rows, passed_us):
        keys, out = {}, []
        for row in rows:
            keys.setdefault(row[4], []).append(row)
        if not keys:
            return out
        state = {name: (recent, before) for name, recent, before in self.recall([])}
        for name, mine in keys.items():
            recent, before = state.get(name, ([], None))
            n = len(recent)
            recent = recent + [[r[0], float(r[3])] for r in mine]
            whole = all(w.is_integer() for _, w in recent)
            weight, a, b, i = 0.0, 0, 0, 0
            while i < len(mine):
                ts, j = mine[i][0], i
                while j < len(mine) and mine[j][0] == ts:
                    j += 1
                while b < n + j:
                    weight, b = weight + recent[b][1], b + 1
                while recent[a][0] <= ts - self.horizon_us:
                    weight, a = weight - recent[a][1], a + 1
                if not whole:  # fractions are added up afresh, so that no error stays behind
                    weight = sum(w for _, w in recent[a:b])
                for row in mine[i:j]:
                    if weight >= self.threshold and (before is None or before < self.threshold):
                        out.append((name, ts, row[2], row[3], repr(weight), False))
                    before = weight
                i = j
            state[name] = (recent[a:], before)
        self.remember([[name, recent, before] for name, (recent, before) in state.items()])
        return out


def in_order(rows: DataFrame, processor: StatefulProcessor, delay: str, salts: int = 1, buckets: int | None = None,
             stretch_us: int = 0, reach_us: int = 0, newest: tuple[int, int] | None = None) -> DataFrame:
    """Runs ``rows`` (key, ts, kind, id, payload) through ``processor``: columns OUT.

    A group is a key, or with ``buckets`` the keys of one hash.  Rows of kind 0 go to all ``salts`` sub-groups,
    others to one by their id, or with ``stretch_us`` by the stretch of time they lie in; then the last ``reach_us``
    of a stretch also go to the next one, as kind ``COPY``.  Only marks may come with more than one salt by id, and
    a late mark then comes out once per sub-group.  With ``newest`` (rows, tick in microseconds) the ``processor``
    gets a tick's newest rows and the others packed (:func:`thinned`); ``payload`` is then a struct, made JSON here."""
    us = F.unix_micros("ts")
    dealt = rows.withWatermark("ts", delay)
    kind = F.col("kind").cast("int")
    if newest:
        # the time as plain micros here too, see below
        dealt = dealt.select("key", us.alias("ts_us"), kind.alias("kind"), "id", "payload")
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
        dealt = dealt.mapInArrow(thinned(*newest), f"{types}, spare binary, salt int")
        text = F.to_json("payload", {"ignoreNullFields": "false"})
        dealt = dealt.select("key", "salt", "ts_us", "kind", "id", text.alias("payload"), F.col("key").alias("name"), "spare")
        return dealt.groupBy("key", "salt").transformWithStateInPandas(processor, OUT, "Append", "EventTime")
    if salts > 1 and stretch_us:
        at = F.floor(us / F.lit(stretch_us))
        near = us - at * stretch_us >= F.lit(stretch_us - reach_us)
        to = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        dealt = dealt.withColumn("_on", F.explode(to)).withColumn("salt", F.coalesce(F.pmod(at + F.col("_on"), F.lit(salts)), F.lit(0)).cast("int"))
        kind = F.when(F.col("_on") == 1, COPY).otherwise(kind)
    elif salts > 1:
        own = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
        dealt = dealt.withColumn("salt", F.explode(F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(own))))
    else:
        dealt = dealt.withColumn("salt", F.lit(0))
    group = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string") if buckets else F.col("key")
    # As plain micros the time is no watermark column any more, so late rows reach the processor instead of being dropped.
    dealt = dealt.select(group.alias("key"), "salt", us.alias("ts_us"), kind.alias("kind"), "id", "payload", F.col("key").alias("name"))
    return dealt.groupBy("key", "salt").transformWithStateInPandas(processor, OUT, "Append", "EventTime")


#: Timestamps of packed rows keep their microseconds.
JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one JSON text (with nulls)."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false", **JSON_TIME})
