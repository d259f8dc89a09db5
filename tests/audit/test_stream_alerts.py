"""Alerts from a stream in several batches: equal to the batch detection, linear in rows, state that expires."""

import random
import time
from datetime import datetime, timedelta

import pytest
from auditweft.operators import alerts
from auditweft.plans import more_queries
from auditweft.streaming import jobs
from pyspark.sql import functions as F
from test_rules import START, event, frame, rule

RULES = [
    dict(rule="mass-delete", severity="high", threshold=3, secondary_threshold=None, secondary_severity=None),
    dict(rule="possible-ransomware", severity="high", threshold=4, secondary_threshold=2, secondary_severity="critical"),
    dict(rule="permission-change", severity="high", threshold=1, secondary_threshold=None, secondary_severity=None),
]
WINDOW, DEDUP = 300, 600


class Held:
    """A list or map state kept in memory."""

    def __init__(self):
        self.rows, self.map = [], {}

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def exists(self):
        return bool(self.rows or self.map)

    def clear(self):
        self.rows, self.map = [], {}

    def containsKey(self, k):
        return k in self.map

    def getValue(self, k):
        return self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]

    def iterator(self):
        return iter(list(self.map.items()))


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, *_):
        return Held()

    getMapState = getListState

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


def processor(window=WINDOW, dedup=DEDUP):
    p = jobs.AlertProcessor(RULES, window, dedup)
    p.init(Handle())
    return p


def plain(rows):
    """Every rule at every time over all rows up to it, from the definition."""
    out, last = [], {}
    for t in sorted({r[0] for r in rows}):
        for i, rule_ in enumerate(RULES):
            hits = sorted(r for r in rows if t - WINDOW <= r[0] <= t and r[1] == i)
            upper = rule_["secondary_threshold"] and sum(r[2] for r in hits) >= rule_["secondary_threshold"]
            if hits and (upper or len(hits) >= rule_["threshold"]) and t - last.get(i, -(10**9)) > DEDUP:
                last[i] = t
                single = rule_["rule"] == "permission-change"
                out.append((rule_["rule"], "critical" if upper else "high", 1 if single else len(hits), hits[0][0], hits[0][0] if single else hits[-1][0], t))
    return sorted(out)


def test_queues_equal_the_definition_whatever_the_batches():
    rng = random.Random(4)
    for case in range(60):
        rows = [(rng.randint(0, 4000), rng.choice([-1, 0, 0, 1, 1, 2]), rng.random() < 0.3) for _ in range(rng.randint(1, 90))]
        p, got = processor(), []
        # a row comes in any batch before the mark that passes it
        marks = sorted(rng.sample(range(4000), rng.randint(1, 6))) + [4001]
        arrives = [rng.randint(0, next(i for i, m in enumerate(marks) if r[0] <= m)) for r in rows]
        for b, mark in enumerate(marks):
            p.waiting.appendList([r for r, a in zip(rows, arrives) if a == b])
            got += [tuple(x) for x in p._judge(("s", "u"), mark).drop(columns=["server", "user"]).itertuples(index=False)]
        assert sorted(got) == plain(rows)
        p._judge(("s", "u"), 4001 + WINDOW + DEDUP + 1)
        assert not (p.waiting.exists() or p.queue.exists() or p.last.exists())


def test_linear_in_rows():
    """60,000 hits in one window: looking at the window's rows for each would be billions of steps."""
    p = processor(window=10**9, dedup=10)
    p.waiting.appendList([(i, 0, False) for i in range(60_000)])
    start = time.time()
    out = p._judge(("s", "u"), 10**8)
    assert time.time() - start < 10 and out["event_count"].max() > 59_900


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def written(spark, tmp_path, batches):
    src = str(tmp_path / "src")
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    return src


def test_batches_out_of_order_equal_the_batch_detection(spark, rocks, tmp_path):
    """Rows come up to ten minutes late, within the watermark; a last row moves it past all others."""
    rng = random.Random(5)
    rows = [event(i, rng.randint(0, 7200), user=rng.choice(["ana", "bo"]), action=rng.choice(["deleted", "deleted", "accessed"])) for i in range(240)]
    at = FIELD_AT
    rows.sort(key=lambda r: r[at] + timedelta(seconds=rng.randint(0, 500)))
    batches = [rows[i : i + 80] for i in range(0, 240, 80)] + [[event("end", 10**7, user="end", action="accessed")]]
    src, r = written(spark, tmp_path, batches), rule(spark, threshold=3)
    live = jobs.stream_alerts(spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(src), r, 5, 10, "10 minutes")
    out = jobs.run_available(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    key = lambda d: sorted((x.user, x.event_count, x.first_us, x.last_us, x.fired_us) for x in d.collect())
    want = key(alerts.detect_alerts(frame(spark, rows), r, 5, 10))
    assert key(out) == want and len(want) > 4


def test_late_rows_are_stored_but_not_judged(spark, rocks, tmp_path):
    """Two deletions, far later ones, then a third of the first minutes: stored, though no alert counts it.

    A row is late once it lies behind the watermark of the batch before, so another batch comes in between.
    """
    first = [event(i, i, action="deleted") for i in range(2)]
    later = [event(10 + i, 7200 + i, action="deleted") for i in range(3)]
    late = [event(20, 2, action="deleted"), event(21, 9000, action="accessed")]
    end = [event("end", 10**6, user="end", action="accessed")]
    src, r = written(spark, tmp_path, [first, later, [event(30, 8000, action="accessed")], late, end]), rule(spark, threshold=3)
    schema = frame(spark, first).schema
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.write_events(source(), str(tmp_path / "table"), str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).filter("id = '20'").count() == 1
    out = jobs.run_available(jobs.stream_alerts(source(), r, 5, 10, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert [(x.event_count, x.first_us) for x in out.collect()] == [(3, out_us(spark, 7200))]


def out_us(spark, seconds):
    return spark.range(1).select(F.unix_micros(F.lit(START + timedelta(seconds=seconds)))).first()[0]


FIELD_AT = next(i for i, v in enumerate(event(0)) if isinstance(v, datetime))


def test_state_is_asked_a_fixed_number_of_times_a_key():
    p, asked = processor(), []
    for name in ("containsKey", "getValue", "updateValue", "iterator", "exists", "put", "clear", "get"):
        for state in (p.waiting, p.queue, p.last):
            setattr(state, name, lambda *a, f=getattr(state, name), n=name: asked.append(n) or f(*a))
    p.waiting.rows = [(t, t % 3, False) for t in range(3000)]
    assert len(p._judge(("s", "u"), 4000)) > 3 and len(asked) <= 10


def test_each_batch_of_a_played_stream_is_read_by_many_tasks(spark, tmp_path):
    frames = [spark.range(lo, lo + 1000, 1, 4) for lo in (0, 1000)]
    seen = []

    def put(batch, n):
        seen.append((n, batch.count(), batch.agg(F.min("id")).first()[0], batch.select(F.input_file_name()).distinct().count()))

    def run(live):
        live.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return len(seen)

    assert more_queries._played(spark, run, *frames) == 2
    assert [s[1:] for s in seen] == [(1000, 0, 4), (1000, 1000, 4)]
