"""A human-level timeline from audit events: doubles, echoes and noise removed, users filled in."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import is_blank, is_operational_noise, is_provisional_folder, is_transient_artifact, leaf_name, parent_path, path_key, provisional_kind
from .components import components
from .hydrate import cut
from .skew import dealt, met_sides

CHANGED = ["changed", "modified"]
CREATED = ["created", "created_or_appended"]
TURNED = ["renamed", "moved"]
_S = 1_000_000


def weight() -> Column:
    source = F.when(F.contains(F.col("source"), F.lit("usn-journal+security-log")), 30).when(F.contains(F.col("source"), F.lit("usn-journal")), 20).otherwise(10)
    return source + F.when(F.col("action").isin(TURNED), 30).when(F.col("action") == "deleted", 20).when(F.col("action").isin(CREATED), 15).otherwise(5)


def timeline_dedup(df: DataFrame) -> DataFrame:
    """One row per user, source, action, paths and second: the heaviest, first on ties."""
    w = Window.partitionBy("user", "source", "action", "path", F.coalesce("previous_path", F.lit("")), F.date_trunc("second", "timestamp_utc")).orderBy(
        weight().desc(), F.desc("timestamp_utc"), "id"
    )
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def semantic_key() -> Column:
    return F.concat_ws(
        "|",
        "user",
        F.when(F.contains(F.col("source"), F.lit("usn-journal")), "usn").otherwise(F.col("source")),
        F.when(F.col("action").isin(CHANGED), "changed").otherwise(F.col("action")),
        path_key(F.col("path")),
        F.coalesce(path_key(F.col("previous_path")), F.lit("")),
        F.date_format(F.date_trunc("second", "timestamp_utc"), "yyyy-MM-dd HH:mm:ss"),
    )


def provisional(c: str) -> Column:
    return provisional_kind(F.col(c)).isNotNull() | is_provisional_folder(F.col(c))


def provisional_creates(df: DataFrame) -> DataFrame:
    """Renames and moves from a provisional name are creations without a previous path."""
    hit = F.col("action").isin(TURNED) & ~is_blank(F.col("previous_path")) & provisional("previous_path")
    return df.withColumns({"action": F.when(hit, "created").otherwise(F.col("action")), "previous_path": F.when(hit, None).otherwise(F.col("previous_path"))})


def resolve_unknown_users(df: DataFrame, window_s: int = 60) -> DataFrame:
    """UNKNOWN users become the nearest known user with a related path on the same server and share.

    Paths are related if equal, one above the other, or in one folder. Relations become equality of
    a shared ancestor key; ties: newest, then id. Of all known rows under a key only the last one before an
    unknown row and the next one after it can be the nearest, so that a sorted pass in slices of time finds
    them, linear in rows however many share a key. Keys that only one side has go before the shuffle.
    """
    width = window_s * _S
    us = F.unix_micros("timestamp_utc")
    paths = F.filter(F.array(path_key(F.col("path")), path_key(F.col("previous_path"))), lambda p: p.isNotNull() & (p != ""))
    base = df.select("id", "server", "share", "user", us.alias("us"), paths.alias("paths")).filter("server IS NOT NULL AND share IS NOT NULL AND us IS NOT NULL")
    up = lambda p: F.substring_index(p, "\\", -1)
    parent = lambda p: F.when(F.length(p) > F.length(up(p)) + 1, F.substring(p, F.lit(1), F.length(p) - F.length(up(p)) - 1)).otherwise(p)
    parts = F.transform("paths", lambda p: F.split(p, r"\\"))
    above = lambda x: F.when(F.size(x) > 1, F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda n: F.array_join(F.slice(x, F.lit(1), n), "\\"))).otherwise(F.array().cast("array<string>"))
    tag = lambda t, values: F.transform(values, lambda x: F.concat(F.lit(t), x))
    all_above = F.flatten(F.transform(parts, above))
    # asked|held: own path below theirs, theirs below own, same folder (equal paths are in one folder as well)
    asks = F.array_distinct(F.concat(tag("at:", all_above), tag("in:", F.col("paths")), tag("by:", F.transform("paths", parent))))
    holds = F.array_distinct(F.concat(tag("at:", F.col("paths")), tag("in:", all_above), tag("by:", F.transform("paths", parent))))
    slot = lambda t: F.floor(t / (4 * width))
    ask = base.filter("user = 'UNKNOWN'").select("id", "server", "share", "us", F.lit(None).cast("string").alias("user"), F.lit(1).alias("kind"), F.explode(asks).alias("key"))
    hold = base.filter("user <> 'UNKNOWN'").select("id", "server", "share", "us", "user", F.lit(0).alias("kind"), F.explode(holds).alias("key"))
    ask, hold = met_sides(ask, hold, ["server", "share", "key"])
    hold = hold.withColumn("slot", F.explode(F.sequence(slot(F.col("us") - width), slot(F.col("us") + width))))
    rows = dealt(ask.withColumn("slot", slot(F.col("us"))).unionByName(hold), 4 * df.count(), "server", "share", "key", "slot")
    w = Window.partitionBy("server", "share", "key", "slot")
    held = F.when(F.col("kind") == 0, F.struct("us", "id", "user"))
    # of rows of one time the least id stands last
    near = lambda order: F.last(held, ignorenulls=True).over(w.orderBy(order, "kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select("id", "us", "kind", near(F.asc("us")).alias("_a"), near(F.desc("us")).alias("_b")).filter("kind = 1")
    gap = lambda c: F.struct(F.abs(F.col("us") - F.col(f"{c}.us")).alias("gap"), (-F.col(f"{c}.us")).alias("us"), F.col(f"{c}.id").alias("id"), F.col(f"{c}.user").alias("user"))
    close = lambda c: F.when(F.abs(F.col("us") - F.col(f"{c}.us")) <= width, gap(c))
    best = found.groupBy("id").agg(F.min(F.least(close("_a"), close("_b"))).alias("_best")).select("id", F.col("_best.user").alias("_user"))
    return df.join(best, "id", "left").select(*(F.coalesce("_user", "user").alias("user") if c == "user" else F.col(c) for c in df.columns))


def suppress_echoes(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Rows that others make redundant go; every rule looks at all rows, so order doesn't matter.

    ``scale`` stretches the rules' windows (15, 30, 45 and 8 seconds) for sparse data. All rules share one sweep:
    a row stands under its path, previous path and folder with the roles it has there, in slices of time with one
    window to either side; the last and next time of each role answer every rule. Rows of one time and id aren't
    company to each other; of rows that share an id all go or none.
    """
    own = df.select(
        "*", path_key(F.col("path")).alias("_p"), F.coalesce(path_key(F.col("previous_path")), F.lit("")).alias("_q"), F.lower(parent_path(F.col("path"))).alias("_pp"),
        F.coalesce(F.lower(parent_path(F.col("previous_path"))), F.lit("")).alias("_qp"), F.unix_micros("timestamp_utc").alias("_us"), provisional("path").alias("_prov"),
        F.coalesce(provisional("previous_path"), F.lit(False)).alias("_qprov"), provisional_kind(F.col("path")).alias("_kind"), provisional_kind(F.col("previous_path")).alias("_qkind"),
        F.contains(leaf_name(F.col("path")), F.lit(".")).alias("_dot"),
    )
    own = cut(own.filter(~is_transient_artifact(F.col("path")) & ~is_transient_artifact(F.col("previous_path"))))
    act = lambda *names: F.col("action").isin(*names)
    micros = lambda seconds: F.lit(int(seconds * scale * _S))

    # where a row stands: under paths, and for provisional names under folders, of any or of one kind
    made, fresh = act("created", *TURNED), act(*CREATED) & F.col("_prov")
    spot = lambda key, kind, when: F.when(when, F.struct(F.col(key).alias("key"), kind.alias("kind")))
    path, folder = F.lit(""), F.lit("folder")
    spots = F.array(
        spot("_p", path, F.lit(True)), spot("_q", path, act(*TURNED, *CREATED, "deleted")), spot("_pp", path, act("moved")), spot("_pp", folder, made & ~F.col("_prov") | fresh),
        spot("_pp", F.col("_qkind"), made & (F.col("_q") != "")), spot("_pp", F.col("_kind"), fresh),
    )
    there = F.array_distinct(F.filter(spots, lambda x: x["key"].isNotNull() & (x["key"] != "") & x["kind"].isNotNull()))
    stands = own.select("id", "action", "_us", "_p", "_q", "_pp", "_qp", "_prov", "_qprov", "_kind", "_qkind", "_dot", F.explode(there).alias("_at")).select("*", "_at.*")

    by_path = F.col("kind") == ""
    at_p, at_q, at_pp = (by_path & (F.col("key") == F.col(c)) for c in ("_p", "_q", "_pp"))
    makes = F.when(F.col("kind") == "folder", ~F.col("_prov")).otherwise((F.col("_q") != "") & (F.col("kind") == F.col("_qkind")))
    roles = {
        "from": act(*TURNED) & at_q,
        "to": act(*TURNED) & at_p,
        "gone": act("deleted") & at_p,
        "alive": (F.col("action") != "deleted") & at_p,
        "into": act("moved") & at_pp,
        "new": act(*CREATED) & at_p,
        "strong": act(*TURNED, *CREATED, "deleted") & (at_p | at_q),
        "makes": made & ~by_path & makes,
    }
    move = act("moved") & (F.col("_q") != "") & F.startswith(F.col("_qp"), F.concat(F.col("_pp"), F.lit("\\")))
    # (rows that may go, role that lets them, seconds); a move out of a folder below also needs nothing at its new path
    rules = [
        (act("deleted") & at_p, "from", 15), (act(*CHANGED) & ~F.col("_dot") & at_p, "into", 30), (fresh & ~by_path, "makes", 45), (act(*TURNED) & F.col("_qprov") & at_p, "new", 15),
        (act(*CREATED) & at_p, "to", 15), (act(*CHANGED) & at_p, "strong", 15),
    ]
    left, landed = (move & at_q, "gone", 30), (move & at_p, "alive", 8)

    halo = micros(45)
    slot = lambda us: F.floor(us / (4 * halo))
    stands = stands.select("*", *(F.when(r, F.col("_us")).alias(f"_is_{n}") for n, r in roles.items()))
    stands = stands.withColumn("_slot", F.explode(F.sequence(slot(F.col("_us") - halo), slot(F.col("_us") + halo)))).withColumn("_home", F.col("_slot") == slot(F.col("_us")))
    stands = stands.filter(F.col("_home") | F.coalesce(*(F.col(f"_is_{n}") for n in roles)).isNotNull())
    stands = dealt(stands, 4 * own.count(), "key", "kind", "_slot")
    w = Window.partitionBy("key", "kind", "_slot")
    stands = stands.withColumn("_n", F.dense_rank().over(w.orderBy("_us", "id")))
    before, after = (w.orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in (F.asc("_n"), F.desc("_n")))
    stands = stands.select("*", *(F.max(f"_is_{n}").over(before).alias(f"_last_{n}") for n in roles)).select("*", *(F.min(f"_is_{n}").over(after).alias(f"_next_{n}") for n in roles))

    def holds(rows: Column, role: str, seconds: float) -> Column:
        near = lambda gap: F.coalesce(gap <= micros(seconds), F.lit(False))
        return F.coalesce(rows, F.lit(False)) & (near(F.col("_us") - F.col(f"_last_{role}")) | near(F.col(f"_next_{role}") - F.col("_us")))

    any_rule = reduce(lambda a, b: a | b, (holds(*r) for r in rules))
    found = stands.filter("_home").select("id", any_rule.alias("_drop"), holds(*left).alias("_left"), holds(*landed).alias("_landed")).filter("_drop or _left or _landed")
    gone = found.groupBy("id").agg(F.bool_or("_drop").alias("_drop"), F.bool_or("_left").alias("_left"), F.bool_or("_landed").alias("_landed")).filter("_drop or (_left and not _landed)")
    return own.join(gone, "id", "left_anti").select(*df.columns)


def _sessions(pdfs: Iterator[pd.DataFrame]) -> Iterator[Iterator[dict]]:
    """Sorted rows of a partition, component by component."""
    rows = (dict(zip(pdf.columns, r)) for pdf in pdfs for r in zip(*(pdf[c].tolist() for c in pdf.columns)))
    return (group for _, group in groupby(rows, key=lambda r: r["_s"]))


def _consolidator(window_us: int):
    """Greedy newest-first pass over the components of a partition; gives kept ids with final columns.

    Only rows within the window around the current one are held, and a row looks only at those at its paths and
    in its folders.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned, created, changed = set(TURNED), set(CREATED), set(CHANGED)

        def explicit(c) -> bool:
            return bool(c["q"]) and c["action"] in turned and c["dot"] == c["qdot"]

        def places(e) -> set:
            return {("at", e["p"]), ("at", e["q"]), ("in", e["pp"])}

        def redundant(c, index) -> bool:
            a, p = c["action"], c["p"]
            far = lambda kind, key: (e for e in index.get((kind, key), ()) if e["id"] != c["id"])
            others = lambda kind, key: (e for e in far(kind, key) if not e.get("used"))
            if c["prov"] and (a in created or any(not e["prov"] and e["action"] in turned | created | changed | {"deleted"} for e in far("in", c["pp"]))):
                return True
            if a == "renamed" and c["qprov"] and any(e["action"] in created and e["p"] == p for e in far("at", p)):
                return True
            if (a == "deleted" or a in created) and any(e["action"] in turned | {"created"} for e in others("at", p)):
                return True
            if not c["dot"] and (c["root"] or any(e["dot"] for e in others("in", p))):
                return True
            if a == "created_or_appended" and c["source"] == "windows-security-log" and any(e["user"] == c["user"] and e["action"] in {"deleted", "renamed"} | changed for e in others("in", p)):
                return True
            if a in changed and c["source"] == "usn-journal" and c["user"] == "UNKNOWN" and any(e["p"] == p and e["source"] != "usn-journal" and e["action"] not in changed for e in others("at", p)):
                return True
            if a in changed and "usn-journal" in c["source"]:
                for e in others("at", p):
                    later = e["action"] in changed and "usn-journal" in e["source"] and e["us"] > c["us"]
                    if e["action"] in turned | {"deleted"} or e["action"] in created and e["dot"] or later:
                        return True
            return False

        def session(rows: Iterator[dict]) -> Iterator[tuple]:
            held: deque[dict] = deque()  # newest first
            index: dict[tuple, deque[dict]] = {}  # the same rows by their paths and folders, in the same order

            def hold(e: dict) -> None:
                todo.append(e)
                held.append(e)
                for k in places(e):
                    index.setdefault(k, deque()).append(e)

            def release() -> None:
                for k in places(held.popleft()):
                    index[k].popleft()
                    if not index[k]:
                        del index[k]

            keys: dict[int, set] = {}  # by second
            ahead = next(rows, None)
            todo: deque[dict] = deque()
            while todo or ahead:
                if not todo:
                    hold(ahead)
                    ahead = next(rows, None)
                c = todo.popleft()
                while ahead and ahead["us"] >= c["us"] - window_us:
                    hold(ahead)
                    ahead = next(rows, None)
                while held[0]["us"] > c["us"] + window_us:
                    release()
                for second in [x for x in keys if x > c["us"] // _S]:
                    del keys[second]
                if c.get("used"):
                    continue
                if c["noise"]:
                    c["used"] = True
                    continue
                own = keys.setdefault(c["us"] // _S, set())
                if explicit(c):
                    ends = {c["p"], c["q"]}
                    for e in chain(*(index.get(("at", x), ()) for x in ends)):
                        same = (e["p"], e["q"]) == (c["p"], c["q"]) if e["action"] in turned else bool({e["p"], e["q"]} & ends)
                        if not e["noise"] and same:
                            e["used"] = True
                    final = "created" if c["qprov"] else "moved" if c["pp"] != c["qp"] else "renamed"
                    own.add((c["user"], c["src"], final, c["p"], "" if c["qprov"] else c["q"]))
                    yield c["id"], final, None if c["qprov"] else c["previous_path"], c["leaf"]
                    continue
                c["used"] = True
                if redundant(c, index):
                    continue
                key = (c["user"], c["src"], "changed" if c["action"] in changed else c["action"], c["p"], c["q"])
                if key not in own:
                    own.add(key)
                    yield c["id"], c["action"], c["previous_path"], None if c["action"] == "accessed" else c["leaf"]

        # most components are small: frames hold rows of many
        found = chain.from_iterable(map(session, _sessions(pdfs)))
        while some := list(islice(found, 10_000)):
            yield pd.DataFrame(some, columns=["id", "action", "previous_path", "display_target"])

    return run


def _touching(own: DataFrame, window_s: int) -> DataFrame:
    """(id, _s): rows of a share that any rule can hold against each other, directly or over others, share _s.

    Rules look at rows within the window with the same path or previous path (t), from a folder's row or a
    creation at rows in the folder (f), and from a provisional document at its neighbours (s). Rows of a
    key form a run that ends where the window passes without any; of the folder kinds only rows near an
    asking one count. Runs that a row stands in are connected. A share may go on forever: its paths part it.
    """
    width = window_s * _S
    key = lambda tag, c, asks, when: F.when(when, F.struct(F.lit(tag).alias("tag"), F.col(c).alias("key"), asks.alias("asks")))
    yes = F.lit(True)
    folder = ~F.col("dot") | ((F.col("action") == "created_or_appended") & (F.col("source") == "windows-security-log"))
    offers = F.array(
        key("t", "p", yes, yes), key("t", "q", yes, F.col("q") != ""), key("f", "p", yes, folder), key("f", "pp", F.lit(False), yes), key("s", "pp", yes, F.col("prov")),
        key("s", "pp", F.lit(False), ~F.col("prov") & F.col("action").isin(*TURNED, *CREATED, *CHANGED, "deleted")),
    )
    rows = own.select("id", "server", "share", "us", F.col("p").alias("_p"), F.explode(F.array_compact(offers)).alias("o")).select("id", "server", "share", "us", "_p", "o.*")
    by = Window.partitionBy("server", "share", "tag", "key")
    w, back = by.orderBy("us", "id"), by.orderBy(F.desc("us"), F.desc("id"))
    asked = F.when(F.col("asks"), F.col("us"))
    near = lambda over: F.abs(F.col("us") - F.last(asked, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))) <= width
    rows = rows.withColumn("_a", near(w)).withColumn("_b", near(back)).filter("_a OR _b").drop("_a", "_b")
    rows = rows.withColumn("_n", F.sum(F.coalesce((F.col("us") - F.lag("us").over(w) > width).cast("int"), F.lit(0))).over(w))
    # equal marks of different runs would only join components, which changes nothing
    rows = rows.withColumn("_run", F.xxhash64("server", "share", "tag", "key", "_n"))
    main = F.max(F.when((F.col("tag") == "t") & F.col("key").eqNullSafe(F.col("_p")), F.col("_run")))
    runs = cut(rows.groupBy("id").agg(main.alias("a"), F.collect_set("_run").alias("runs")))  # at most five runs
    found = components(runs.select("a", F.explode("runs").alias("b")).distinct())
    return runs.join(found, F.col("a") == F.col("node"), "left").select("id", F.coalesce("root", "a").alias("_s"))


def timeline_consolidate(df: DataFrame, window_s: int = 15) -> DataFrame:
    """One row per human-level operation, with display_target.

    Rows of a share that no rule can hold against each other are parted into components. Each is read
    newest first by one task, which holds the rows of one window at a time; tasks read many components.
    Doubles of a second should be removed first; ids are unique.
    """
    us = F.unix_micros("timestamp_utc")
    root = (F.lower(leaf_name(F.col("path"))) == F.lower("share")) & F.lower(parent_path(F.col("path"))).rlike(r"^([a-z]:|\\\\[^\\]+)$")
    own = df.select(
        "id", "server", "share", "user", "source", "action", "previous_path", us.alias("us"), path_key(F.col("path")).alias("p"), F.coalesce(path_key(F.col("previous_path")), F.lit("")).alias("q"),
        F.lower(parent_path(F.col("path"))).alias("pp"), F.coalesce(F.lower(parent_path(F.col("previous_path"))), F.lit("")).alias("qp"), leaf_name(F.col("path")).alias("leaf"),
        F.contains(leaf_name(F.col("path")), F.lit(".")).alias("dot"), F.coalesce(F.contains(leaf_name(F.col("previous_path")), F.lit(".")), F.lit(False)).alias("qdot"),
        provisional("path").alias("prov"), F.coalesce(provisional("previous_path"), F.lit(False)).alias("qprov"), is_operational_noise(F.col("path"), F.col("previous_path")).alias("noise"),
        F.when(F.contains(F.col("source"), F.lit("usn-journal")), "usn").otherwise(F.col("source")).alias("src"), root.alias("root"),
    )
    own = cut(own)
    own = own.join(_touching(own, window_s), "id")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "action", "previous_path", "display_target")])
    dealt = own.repartition("_s").sortWithinPartitions("_s", F.desc("us"), "id")
    kept = dealt.mapInPandas(_consolidator(window_s * _S), schema)
    rest = [c for c in df.columns if c not in ("action", "previous_path")]
    return df.select(*rest).join(kept, "id").select(*df.columns, "display_target")


def build_timeline(df: DataFrame, window_s: int = 15, user_window_s: int = 60) -> DataFrame:
    out = timeline_consolidate(timeline_dedup(df), window_s)
    return suppress_echoes(resolve_unknown_users(provisional_creates(out), user_window_s), window_s / 15)
