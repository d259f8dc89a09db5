"""Correlation of the journal with the security log, and rename pairing inside the journal."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import classify_transition, is_blank, is_provisional, path_key, promote_object_type
from .hydrate import cut
from .skew import CELL, grid_join, met_sides

NOISE = ["changed", "modified", "created", "created_or_appended"]
MARKERS = ["renamed_old", "renamed_new"]
ECHOES = ["accessed", "created_or_appended", "modified", "deleted", "renamed"]
_S = 1_000_000


def is_usn() -> Column:
    return F.lower("cursor_type") == "usn"


def with_row(df: DataFrame) -> DataFrame:
    """Adds _row, a repeatable key of the whole row's origin; exact repetitions of a row become one."""
    if "_row" in df.columns:
        return df
    parts = [F.lower("cursor_type"), F.lower("server"), F.lower("share"), F.lower("volume"), F.col("usn"), F.col("record_id"), F.col("timestamp_utc"), F.col("path"), F.col("action")]
    keyed = df.withColumn("_row", F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in parts))))
    # repetitions are rare: sorted once behind the shuffle, not before it as well
    return keyed.repartition("_row").dropDuplicates(["_row"])


def _offers(part: Column, whole: Column, inside: str, around: str, leaves: bool) -> Column:
    """Keys by which a path can meet related ones, as an array of (tag, key), from its parts and its whole folders.

    Equal leaves meet under ``l``. A path y that lies within a path x holds x's folders whole between its
    first and last separator, so y offers its last two whole folders under ``inside`` and x each two
    neighbouring ones under ``around``; a y with one whole folder or none has tags of its own.
    """
    n = F.size(part)
    at = lambda i: F.try_element_at(part, i.cast("int"))
    one = lambda tag, key: F.struct(F.lit(tag).alias("tag"), key.alias("key"))
    leaf = one("l", at(n))
    held = (
        F.when(n >= 4, one(f"{inside}2", F.concat(at(n - 2), F.lit("\\"), at(n - 1))))
        .when(n == 3, one(f"{inside}1", at(n - 1)))
        .otherwise(one(f"{inside}0", F.lit("")))
    )
    pairs = F.transform(F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))), lambda p, i: one(f"{around}2", F.concat(p, F.lit("\\"), F.try_element_at(whole, i + 2))))
    alone = F.transform(whole, lambda p: one(f"{around}1", p))
    return F.concat(F.array(*[leaf][: int(leaves)], held, one(f"{around}0", F.lit(""))), pairs, alone)


def _offered(rows: DataFrame, path: Column, previous: Column, inside: str, around: str, wide: list[str], leaves: bool) -> DataFrame:
    """A row for each key that a row's path or previous path offers; ``_main`` says which of them it is.

    Of two related rows the one with fewer keys (tags in ``wide``) stands in three time slots, the other in one.
    """
    key = lambda c: F.when(~is_blank(c), path_key(c))
    both = rows.withColumn("_path", F.explode(F.array(F.struct(key(path).alias("x"), F.lit(True).alias("main")), F.struct(key(previous).alias("x"), F.lit(False).alias("main")))))
    both = both.filter("_path.x IS NOT NULL").withColumn("_part", F.split("_path.x", r"\\"))
    both = both.withColumn("_whole", F.slice("_part", 2, F.greatest(F.size("_part") - 2, F.lit(0))))
    both = both.withColumn("_offer", F.explode(_offers(F.col("_part"), F.col("_whole"), inside, around, leaves)))
    both = both.select("*", F.col("_path.x").alias("_x"), F.col("_path.main").alias("_main"), F.col("_offer.tag").alias("_tag"), F.col("_offer.key").alias("_key")).drop("_path", "_offer", "_part", "_whole")
    slots = F.when(F.substring("_tag", 1, 1).isin(wide), F.sequence(F.col("_at") - 1, F.col("_at") + 1)).otherwise(F.array("_at"))
    return both.withColumn("_slot", F.explode(slots)).drop("_at")


def _is_known() -> Column:
    return ~is_blank(F.col("path")) & ~is_blank(F.col("user")) & (F.upper("user") != "UNKNOWN")


def _may_echo() -> Column:
    return F.col("record_id").isNotNull() & F.coalesce(F.lower("action").isin(ECHOES), F.lit(False))


def match_sides(usn: DataFrame, security: DataFrame, window_s: int = 10, leaves: bool = True) -> tuple[DataFrame, DataFrame]:
    """Journal and security rows by (_server, _slot, _tag, _key), the keys by which related ones meet.

    Paths are cleaned once a row.
    """
    width = max(1, window_s) * _S
    slot = F.floor(F.unix_micros("timestamp_utc") / width)
    s = security.filter(_is_known()).select(
        F.col("_row").alias("_sec"), F.lower("server").alias("_server"), "path", "previous_path", F.unix_micros("timestamp_utc").alias("_sus"), "record_id", _may_echo().alias("_echo"), slot.alias("_at"),
    )
    s = _offered(s, F.col("path"), F.col("previous_path"), "a", "b", ["l", "a"], leaves).drop("path", "previous_path").withColumnsRenamed({"_x": "_y", "_main": "_smain"})
    # a blank path of a journal row starts any path, once the rows are related by the other one
    blank = F.coalesce(path_key(F.col("path")) == "", F.lit(False)) | F.coalesce(path_key(F.col("previous_path")) == "", F.lit(False))
    u = usn.select("_row", F.lower("server").alias("_server"), "path", "previous_path", F.unix_micros("timestamp_utc").alias("_us"), slot.alias("_at"), blank.alias("_blank"))
    u = _offered(u, F.col("path"), F.col("previous_path"), "b", "a", ["b"], leaves).drop("path", "previous_path", "_main")
    return u, s


def match_pairs(usn: DataFrame, security: DataFrame, window_s: int = 10, cell: int = CELL, leaves: bool = True) -> DataFrame:
    """(_row, _sec, record_id, score, distance, echo) of compatible pairs: same server, near in time, related paths.

    A pair stands once for each key it meets by; its score is the highest of these: 100 equal paths, 60
    same leaf, 30 one path holds the other, over path and previous path. ``echo`` marks a security row that
    repeats the journal row: one of its recorded actions at a path that starts the other or is started by
    it. Without ``leaves`` only paths that hold one another are looked for. Rows meet only by equal keys, and keys with many rows in a slot are cut into a grid of cells.
    """
    u, s = match_sides(usn, security, window_s, leaves)
    near = grid_join(u, s, ["_server", "_slot", "_tag", "_key"], ("_row", "_sec"), cell).withColumn("distance", F.abs(F.col("_us") - F.col("_sus")))
    x, y, tag = F.col("_x"), F.col("_y"), F.substring("_tag", 1, 1)
    held = (x != y) & F.when(tag == "a", x.contains(y)).otherwise(y.contains(x))
    score = F.when((tag == "l") & (x == y), 100).when(tag == "l", 60).when(held, 30).otherwise(0)
    echo = F.col("_echo") & (F.col("_blank") | (F.col("_smain") & (F.startswith(x, y) | F.startswith(y, x))))
    return near.filter(F.col("distance") <= window_s * _S).select("_row", "_sec", "record_id", score.alias("score"), "distance", echo.alias("echo")).filter("score > 0")


def _paths() -> Column:
    """The cleaned path and previous path of a row, as an array without those that are blank."""
    return F.array_compact(F.array(*(F.when(~is_blank(F.col(c)), path_key(F.col(c))) for c in ("path", "previous_path"))))


def _nearest(asks: DataFrame, holds: DataFrame, width: int) -> DataFrame:
    """Adds _a and _b, the last and the next row (us, rank, id) of ``holds`` with an ask's _server and _key, of rows of
    one time that of least rank and id.

    One sorted pass over slices of time with a window at either side: linear in rows however many share a key.
    """
    slot = lambda t: F.floor(t / (4 * width))
    asks, holds = met_sides(asks, holds, ["_server", "_key"])
    holds = holds.withColumn("_slot", F.explode(F.sequence(slot(F.col("us") - width), slot(F.col("us") + width)))).withColumn("_kind", F.lit(0))
    rows = asks.withColumn("_slot", slot(F.col("us"))).withColumn("_kind", F.lit(1)).unionByName(holds, True)
    w = Window.partitionBy("_server", "_key", "_slot")
    held = F.when(F.col("_kind") == 0, F.struct("us", "rank", "id"))
    near = lambda order: F.last(held, ignorenulls=True).over(w.orderBy(order, "_kind", F.desc("rank"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_a": near(F.asc("us")), "_b": near(F.desc("us"))}).filter("_kind = 1")


def best_by_leaf(usn: DataFrame, security: DataFrame, window_s: int = 10) -> DataFrame:
    """(_row, _sec): the best match of each journal row that has one with an equal path or leaf, without forming pairs.

    Of the rows under a path or leaf only the last one before a journal row and the next one can be the best.
    """
    width = max(1, window_s) * _S
    keys = F.explode(F.array_distinct(F.flatten(F.transform(_paths(), lambda p: F.array(F.concat(F.lit("p"), p), F.concat(F.lit("l"), F.element_at(F.split(p, r"\\"), -1)))))))
    both = [F.lower("server").alias("_server"), F.unix_micros("timestamp_utc").alias("us"), keys.alias("_key")]
    held = security.filter(_is_known()).select(*both, F.coalesce("record_id", F.lit(1 << 62)).alias("rank"), F.col("_row").alias("id"))
    found = _nearest(usn.select("_row", *both), held, width)
    score = F.when(F.startswith(F.col("_key"), F.lit("p")), 100).otherwise(60)
    gap = lambda c: F.abs(F.col("us") - F.col(f"{c}.us"))
    match = lambda c: F.when(gap(c) <= window_s * _S, F.struct((-score).alias("score"), gap(c).alias("gap"), F.col(f"{c}.rank").alias("rank"), F.col(f"{c}.id").alias("id")))
    return found.select("_row", F.least(match("_a"), match("_b")).alias("m")).filter("m IS NOT NULL").groupBy("_row").agg(F.min("m")["id"].alias("_sec"))


def best_matches(usn: DataFrame, security: DataFrame, window_s: int = 10) -> DataFrame:
    """(_row, _sec) of journal rows and their best match; pairs are formed only for rows without an equal path or leaf."""
    found = cut(best_by_leaf(usn, security, window_s))
    rest = usn.join(found, "_row", "left_anti")
    return found.unionByName(_best(match_pairs(rest, security, window_s, leaves=False)))


def _best(pairs: DataFrame) -> DataFrame:
    rank = F.struct(-F.col("score"), "distance", F.coalesce(F.col("record_id"), F.lit(1 << 62)), F.col("_sec").alias("_sec"))
    return pairs.groupBy("_row").agg(F.min(rank)["_sec"].alias("_sec"))


def echoes_by_path(usn: DataFrame, security: DataFrame, window_s: int = 10) -> DataFrame:
    """(_row) of security rows that repeat a journal row at an equal path, or one above or below it, without forming pairs."""
    width = max(1, window_s) * _S
    split = lambda p: F.split(p, r"\\")
    above = lambda x: F.when(F.size(x) > 1, F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda n: F.array_join(F.slice(x, F.lit(1), n), "\\"))).otherwise(F.array().cast("array<string>"))
    tag = lambda t, values: F.transform(values, lambda x: F.concat(F.lit(t), x))
    both = [F.lower("server").alias("_server"), F.unix_micros("timestamp_utc").alias("us")]
    own = path_key(F.col("path"))
    asks = security.filter(_is_known() & _may_echo()).select("_row", *both, F.explode(F.concat(tag("at:", F.array(own)), tag("at:", above(split(own))), tag("in:", F.array(own)))).alias("_key"))
    parts = F.flatten(F.transform(_paths(), lambda p: above(split(p))))
    holds = usn.select(*both, F.lit(0).alias("rank"), F.lit("").alias("id"), F.explode(F.array_distinct(F.concat(tag("at:", _paths()), tag("in:", parts)))).alias("_key"))
    near = lambda c: F.coalesce(F.abs(F.col("us") - F.col(f"{c}.us")) <= window_s * _S, F.lit(False))
    return _nearest(asks, holds, width).filter(near("_a") | near("_b")).select("_row").distinct()


def correlate_feeds(usn: DataFrame, security: DataFrame, window_s: int = 10, pairs: DataFrame | None = None) -> DataFrame:
    """Journal rows enriched from their best security match; rows without one stay as they are.

    Best: highest score, then nearest in time, then lowest record id.
    """
    usn, security = with_row(usn), with_row(security)
    best = best_matches(usn, security, window_s) if pairs is None else _best(pairs)
    fields = ["user", "sid", "source_host", "source_ip", "process_name", "action", "path", "record_id"]
    side = security.select(F.col("_row").alias("_sec"), F.struct(*fields).alias("m"))
    out = usn.join(best.join(side, "_sec").select("_row", "m"), "_row", "left")
    hit = F.col("m").isNotNull()
    changed = F.lower("action").isin("changed", "modified") & (F.lower("m.action") == "created_or_appended")
    created = changed & is_provisional(F.col("path")) & (path_key(F.col("path")) == path_key(F.col("m.path")))
    new = {
        "user": F.when(hit, F.col("m.user")).otherwise(F.col("user")),
        "sid": F.coalesce("sid", "m.sid"),
        "source_host": F.coalesce("source_host", "m.source_host"),
        "source_ip": F.coalesce("source_ip", "m.source_ip"),
        "process_name": F.when(hit & (F.col("process_name") == "fsutil.exe"), F.col("m.process_name")).otherwise(F.col("process_name")),
        "action": F.when(created, "created").otherwise(F.col("action")),
        "severity": F.when(hit, "info").otherwise(F.col("severity")),
        "source": F.when(hit, "usn-journal+security-log").otherwise(F.col("source")),
    }
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in usn.columns))


def suppress_matched_security(usn: DataFrame, security: DataFrame, window_s: int = 10, pairs: DataFrame | None = None) -> DataFrame:
    """Security rows without those that repeat a journal row they matched (not only as its best)."""
    usn, security = with_row(usn), with_row(security)
    if pairs is not None:
        numbers = pairs.filter("echo").select("record_id")
    else:  # pairs are formed only for rows without a journal row at an equal path, or one above or below it
        found = cut(echoes_by_path(usn, security, window_s))
        rest = security.filter(_may_echo()).join(found, "_row", "left_anti")
        numbers = security.join(found, "_row", "left_semi").select("record_id").union(match_pairs(usn, rest, window_s).filter("echo").select("record_id"))
    return security.join(numbers.distinct(), "record_id", "left_anti").select(*security.columns)


FILE = ["_server", "_share", "_volume", "_file"]


def _named(usn: DataFrame) -> DataFrame:
    """Markers and noise of the journal with the keys that pairing needs."""
    keys = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(k) for c, k in zip(("server", "share", "volume", "file_reference_id"), FILE)]
    return usn.filter(F.lower("action").isin(NOISE + MARKERS)).select(
        "_row", F.lower("action").alias("action"), F.coalesce("usn", F.lit(1 << 62)).alias("usn"), F.unix_micros("timestamp_utc").alias("us"), path_key(F.col("path")).alias("key"), *keys
    )


#: Journal numbers of a segment, as powers of two, from the finest to the coarsest level.
SEGMENT_BITS = (20, 40)


def _with_next(rows: DataFrame, keys: list[str], cols: list[str], bits: tuple[int, ...] = SEGMENT_BITS) -> DataFrame:
    """Adds _next: ``cols`` of the row right behind in the order of (usn, us, _row) within ``keys``.

    The order is cut into segments of 2^bits journal numbers (rows without one: of 4096 times as many
    microseconds). A segment's last row takes the first row of the next segment that has any, which is the
    same question over the segments' first rows, put to the next level; so no window holds a whole journal.
    The result doesn't depend on ``bits``.
    """
    order = ["usn", "us", "_row"]
    item = F.struct(*(c for c in cols))
    if not bits:
        return rows.withColumn("_next", F.lead(item).over(Window.partitionBy(*keys).orderBy(*order)))
    late = F.col("usn") >= F.lit(1 << 62)
    segment = F.when(late, F.shiftright("us", min(63, bits[0] + 12))).otherwise(F.shiftright("usn", bits[0]))
    place = [*keys, f"_late{len(bits)}", f"_segment{len(bits)}"]
    own = rows.withColumns({place[-2]: late, place[-1]: segment})
    own = own.withColumn("_next", F.lead(item).over(Window.partitionBy(*place).orderBy(*order)))
    first = own.groupBy(*place).agg(F.min(F.struct(*order, *(c for c in cols if c not in order))).alias("_first")).select(*place, "_first.*")
    behind = _with_next(first, keys, cols, bits[1:]).select(*place, F.col("_next").alias("_carried"))
    return own.join(behind, place).withColumn("_next", F.coalesce("_next", "_carried")).drop("_carried", *place[-2:])


def _marker_pairs(own: DataFrame) -> DataFrame:
    """(_row of the new row, _old, how, at) of rename markers; ``at`` is the journal number at which the pair is made.

    Rows are taken in journal order. An old name takes the next new name of its file, else the last one
    before it, even if that has a partner; a new name that nothing has taken takes the last old name
    before it, else the next one. All partners are the last or next markers of a kind, so that sorted
    windows find them. Without a file id, an old name takes a new name that comes right behind it.
    """
    order = ["usn", "us", "_row"]
    marks = own.filter(F.col("action").isin(MARKERS) & (F.col("_file") != ""))
    ahead = Window.partitionBy(*FILE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*FILE).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    old, new = F.col("action") == "renamed_old", F.col("action") == "renamed_new"
    found = lambda kind, w: F.last(F.when(kind, F.struct(*order, "taken")), ignorenulls=True).over(w)
    # an old name that a new name before it has taken: the file's first one, behind a new name
    first = F.last(F.when(old, F.lit(1)), ignorenulls=True).over(ahead).isNull()
    marks = marks.withColumn("taken", old & first & F.last(F.when(new, F.lit(1)), ignorenulls=True).over(ahead).isNotNull())
    marks = marks.withColumn("old_before", found(old, ahead)).withColumn("new_before", found(new, ahead)).withColumn("old_next", found(old, behind)).withColumn("new_next", found(new, behind))
    at = lambda c: F.struct(*(F.col(f"{c}.{x}") for x in order))
    by_old = F.col("old_before").isNotNull() & ~F.col("old_before.taken") & (F.col("new_before").isNull() | (at("new_before") < at("old_before")))
    olds = marks.filter(old & ~F.col("taken")).select(F.coalesce("new_next._row", "new_before._row").alias("_row"), F.col("_row").alias("_old"), "usn")
    news = marks.filter(new & ~by_old).select("_row", F.coalesce("old_before._row", "old_next._row").alias("_old"), "usn")
    bare = _with_next(own.filter("_file = ''"), FILE[:3], ["action", "_row"])
    bare = bare.filter("action = 'renamed_old' and _next.action = 'renamed_new'").select(F.col("_next._row").alias("_row"), F.col("_row").alias("_old"), "usn")
    both = olds.union(news).filter("_row is not null and _old is not null").union(bare)
    return both.select("_row", "_old", F.lit("pair").alias("how"), F.col("usn").alias("at"))


def _consumed(noise: DataFrame, own: DataFrame, found: DataFrame, window_s: int) -> DataFrame:
    """(_row, gone) of noise of the same file or at either path of a transition, near its new row in time.

    ``gone`` is the journal number from which on the noise is gone; noise up to it has been seen before.
    """
    width = max(1, window_s) * _S
    ends = found.select("_row", "_old", "at").join(own, "_row").join(own.select(F.col("_row").alias("_old"), F.col("key").alias("_oldkey"), F.col("_file").alias("_oldfile")), "_old")
    ends = ends.select(*(F.col(c).alias(f"{c}_") for c in FILE[:3]), F.when(F.col("_file") != "", F.col("_file")).otherwise(F.col("_oldfile")).alias("_id"), "key", "_oldkey", F.col("us").alias("_t"), "at")
    zones = ends.withColumn("slot_", F.explode(F.sequence(F.floor(F.col("_t") / width) - 1, F.floor(F.col("_t") / width) + 1)))
    rows = noise.select("_row", "us", *FILE, "key", F.floor(F.col("us") / width).alias("slot"))
    same = (F.col("slot") == F.col("slot_")) & (F.abs(F.col("us") - F.col("_t")) <= window_s * _S)
    for c in FILE[:3]:
        same = same & (F.col(c) == F.col(f"{c}_"))
    by_file = rows.filter("_file <> ''").join(zones, same & (F.col("_file") == F.col("_id")))
    by_path = rows.join(zones.withColumn("_at_path", F.explode(F.array_distinct(F.array("key", "_oldkey")))).drop("key"), same & (F.col("key") == F.col("_at_path")))
    return by_file.select("_row", "at").union(by_path.select("_row", "at")).groupBy("_row").agg(F.min("at").alias("gone"))


def _infer(window_us: int):
    """Greedy pass in journal order over one file's noise rows under changing paths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["usn", "us", "_row"], kind="stable").to_dict("records")
        by_time = sorted(range(len(rows)), key=lambda i: (rows[i]["us"], rows[i]["usn"]))
        times = [rows[i]["us"] for i in by_time]
        used, out = [False] * len(rows), []
        for i, r in enumerate(rows):
            if used[i] or r["usn"] > r["gone"]:
                continue
            near = by_time[bisect_left(times, r["us"] - window_us) : bisect_right(times, r["us"] + window_us)]
            j = next((j for j in near if j != i and not used[j] and rows[j]["gone"] >= r["usn"] and rows[j]["key"] != r["key"]), None)
            if j is None:
                continue
            old, new = sorted((r, rows[j]), key=lambda x: (x["us"], x["usn"]))
            for k in by_time[bisect_left(times, new["us"] - window_us) : bisect_right(times, new["us"] + window_us)]:
                used[k] = used[k] or k != i
            used[j] = True
            out.append((new["_row"], old["_row"], "inferred", r["usn"]))
        return pd.DataFrame(out, columns=["_row", "_old", "how", "at"])

    return run


def transitions(usn: DataFrame, window_s: int = 10) -> DataFrame:
    """(_row of the new row, _old, how, at) of paired markers and renames inferred from noise.

    ``at`` is the journal number at which the transition is made: noise that it explains goes from there
    on, also before it can be taken for a rename itself. Only noise rows with another path of their file
    within the window go to Python, a file's rows in parts where they lie further apart than the window.
    Noise at a path that another file's inferred rename explains is dropped after the inference.
    """
    own = cut(_named(usn))
    pairs = cut(_marker_pairs(own))
    noise = own.filter(F.col("action").isin(NOISE))
    w, back = Window.partitionBy(*FILE).orderBy("us", "usn", "_row"), Window.partitionBy(*FILE).orderBy(F.desc("us"), F.desc("usn"), F.desc("_row"))
    named = noise.filter("_file <> ''").withColumn("_change", F.when(F.lag("key").over(w) != F.col("key"), F.lag("us").over(w))).withColumn(
        "_changes", F.when(F.lag("key").over(back) != F.col("key"), F.lag("us").over(back))
    )
    gap = lambda c, over: F.abs(F.col("us") - F.last(c, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))) <= window_s * _S
    mixed = named.withColumn("_a", gap("_change", w)).withColumn("_b", gap("_changes", back)).filter("_a or _b").drop("_change", "_changes", "_a", "_b")
    mixed = mixed.withColumn("_part", F.sum(F.coalesce((F.col("us") - F.lag("us").over(w) > window_s * _S).cast("int"), F.lit(0))).over(w))
    mixed = mixed.join(_consumed(noise, own, pairs, window_s), "_row", "left").withColumn("gone", F.coalesce("gone", F.lit((1 << 62) + 1)))
    inferred = mixed.select("_row", "usn", "us", "key", "gone", *FILE, "_part").groupBy(*FILE, "_part").applyInPandas(_infer(window_s * _S), "_row string, _old string, how string, at long")
    return pairs.union(inferred)


def drop_rename_noise(usn: DataFrame, found: DataFrame, window_s: int = 10) -> DataFrame:
    """Journal rows without the noise that transitions explain (nor the transitions' ends)."""
    own = _named(usn)
    noise = own.filter(F.col("action").isin(NOISE))
    gone = noise.join(_consumed(noise, own, found, window_s), "_row").filter("usn > gone").select("_row")
    ends = found.select("_row").union(found.select(F.col("_old").alias("_row")))
    return usn.join(gone.union(ends).distinct(), "_row", "left_anti").select(*usn.columns)


def apply_transitions(usn: DataFrame, found: DataFrame, window_s: int = 10) -> DataFrame:
    """Journal rows with transitions in place of their ends, explained noise dropped, lone markers as renames."""
    found = cut(found)
    old = usn.select(F.col("_row").alias("_old"), F.col("path").alias("_opath"), F.col("object_type").alias("_otype"))
    made = usn.join(found.select("_row", "_old").join(old, "_old"), "_row")
    lone = F.lower("action").isin(MARKERS)
    rest = drop_rename_noise(usn, found, window_s).withColumn("action", F.when(lone, "renamed").otherwise(F.col("action")))
    new = {
        "previous_path": F.col("_opath"),
        "action": classify_transition(F.col("_opath"), F.col("path")),
        "object_type": promote_object_type(F.col("_otype"), F.col("object_type")),
    }
    return made.select(*(new.get(c, F.col(c)).alias(c) for c in usn.columns)).unionByName(rest)


def finalize_actions(df: DataFrame) -> DataFrame:
    """Changes of a new document are its creation; a creation keeps no provisional previous path."""
    fresh = F.lower("action").isin("changed", "modified") & is_provisional(F.col("path")) & is_blank(F.col("previous_path"))
    drop = (F.lower("action") == "created") & is_provisional(F.col("previous_path"))
    return df.withColumn("previous_path", F.when(drop, None).otherwise(F.col("previous_path"))).withColumn("action", F.when(fresh, "created").otherwise(F.col("action")))


def correlate(collected: DataFrame, window_s: int = 10, drop_security: bool = False) -> DataFrame:
    """The whole pass over both feeds: pairing, noise, correlation, echoes, final actions."""
    own = cut(with_row(collected))
    usn, security = own.filter(is_usn()), own.filter(~is_usn())
    usn = cut(apply_transitions(usn, transitions(usn, window_s), window_s))
    # a journal row may stand in two transitions, so its new row needs a key with the old path in it
    usn = usn.withColumn("_row", F.md5(F.concat_ws("\x1f", "_row", F.coalesce("previous_path", F.lit("")))))
    pairs = cut(match_pairs(usn, security, window_s))
    out = correlate_feeds(usn, security, window_s, pairs)
    if not drop_security:
        out = out.unionByName(suppress_matched_security(usn, security, window_s, pairs))
    return finalize_actions(out).filter(~is_blank(F.col("path"))).drop("_row")
