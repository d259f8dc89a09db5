"""Secret scan with base patterns and character Markov models, in DataFrame functions only.

Two first-order models give the likelihood of a run of token characters: one counted from random
strings (values that the base patterns found, and their digests in base 64), one from ordinary
identifiers (the texts' other words, alone and with numbers, dates and paths). The mean log-likelihood
ratio per character decides, above a threshold taken from strings left out of the counts. Counting,
scoring and locating are SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base rule.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run is one match; shorter runs fail as a whole
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(ALPHABET) + 1  # state 0 is the start of a run
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _empty() -> Column:
    return F.array().cast(_SPAN)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Spans (s, e in code points, end exclusive; v: the group's text) of the leftmost matches.

    The text is split by the same pattern it is searched with: lengths of the parts between matches
    and of the matches give the places.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("p"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
    )

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["p"])
        end = at + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(at.alias("s"), end.alias("e"), x["g"].alias("v"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), _empty().alias("out"))
    return F.aggregate(found, start, step)["out"]


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the three base kinds; cheap substring tests keep most texts from the expressions."""
    low = F.lower(text)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    return {
        "assign": F.when(named, F.filter(located(text, ASSIGN, 2), lambda x: F.length(x["v"]) >= 8)).otherwise(_empty()),
        "access": F.when(F.contains(text, F.lit("AKIA")), located(text, ACCESS)).otherwise(_empty()),
        "hex": F.when(text.rlike("[0-9a-f]{32}"), located(text, HEX)).otherwise(_empty()),
    }


def _literal(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def llr(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per character of a run, random over ordinary."""
    places = [0] * 128
    for i, c in enumerate(ALPHABET):
        places[ord(c)] = i + 1
    place, scores = _literal(places, "int"), _literal([round(x, 5) for x in table], "double")

    def step(acc: Column, c: Column) -> Column:
        to = F.element_at(place, F.ascii(c) + 1)
        return F.struct(to.alias("p"), (acc["t"] + F.element_at(scores, acc["p"] * _N + to + 1)).alias("t"))

    total = F.aggregate(F.split(token, ""), F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("t")), step)["t"]
    return total / F.length(token)


def identifier(word: Column) -> Column:
    """An ordinary identifier made of a word: alone, with a number, a date, a path, a version or in camel case, by its hash."""
    h = F.xxhash64(word, F.lit(5))
    n = lambda k, least=0: (F.pmod(F.shiftright(h, 7 * least + 4), F.lit(k)) + least).cast("string")
    two = lambda k, shift: F.lpad((F.pmod(F.shiftright(h, shift), F.lit(k)) + 1).cast("string"), 2, "0")
    day = F.concat_ws("-", F.concat(F.lit("20"), two(40, 8)), two(12, 14), two(28, 20))
    low, half = F.lower(word), F.ceil(F.length(word) / 2).cast("int")
    camel = F.concat(low.substr(F.lit(1), half), F.initcap(low.substr(half + 1, F.length(word))), n(1000))
    made = [
        F.concat(low, n(100)), F.concat(low, F.lit("_"), n(10000, 1)), F.concat(low, F.lit("-"), day), F.concat(F.lit("img_"), F.regexp_replace(day, "-", ""), F.lit("_"), low),
        F.concat(low, F.lit("/v"), n(10), F.lit("/"), F.reverse(low)), F.concat(F.upper(low), F.lit("_"), n(100, 2)), camel, F.concat(day, F.lit("_"), low, F.lit("-final"), n(10)),
    ]
    kind = F.pmod(h, F.lit(len(made) + 1))
    out = F.when(kind == 0, made[0])
    for i, m in enumerate(made[1:], 1):
        out = out.when(kind == i, m)
    return out.otherwise(word)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, least: int = 8) -> tuple[list[float], float]:
    """Log-ratio table and decision threshold from labelled samples.

    Labels come from the texts: values of base spans, and their digests in base 64, are random strings;
    runs of ``least`` or more token characters outside base spans and without digits are words of which
    ordinary identifiers are made, one of each, most with digits. About ``sample_rows`` documents are used,
    chosen by a hash of their id over the whole table. A quarter of the strings isn't counted: the
    threshold lies above all but one in a thousand of its ordinary ones and, where that leaves room,
    halfway to its random ones. Only transition counts (at most 2 x 66 x 66 rows) reach the driver.
    """
    n = docs.count()
    share = min(1.0, sample_rows / max(1, n))
    picked = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 60)) < int(share * (1 << 60))) if share < 1 else docs
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = base_spans(text)
    values = F.concat(*(F.transform(s, lambda x: x["v"]) for s in spans.values()))
    digests = F.transform(values, lambda v: F.base64(F.unhex(F.sha2(v, 256))))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.filter(F.array_distinct(F.regexp_extract_all(rest, F.lit(RUN % least), F.lit(0))), lambda x: ~x.rlike("[0-9]") & (F.length(x) <= 60))
    made = F.transform(plain, identifier)
    labelled = picked.select(F.explode(F.array(F.struct(F.lit(1).alias("y"), F.concat(values, digests).alias("r")), F.struct(F.lit(0).alias("y"), made.alias("r")))).alias("l"))
    runs = labelled.select("l.y", F.explode("l.r").alias("run")).withColumn("run", F.regexp_replace("run", r"[^A-Za-z0-9+/_-]", "")).filter(F.length("run").between(1, 200))
    held = F.pmod(F.xxhash64("run", F.lit(7)), F.lit(4)) == 0
    pairs = F.transform(F.split("run", ""), lambda c, i: F.concat(F.substring(F.concat(F.lit("^"), F.col("run")), i + 1, F.lit(1)), c))
    counts = runs.filter(~held).select("y", F.explode(pairs).alias("pair")).groupBy("y", "pair").count().collect()

    seen = {0: [0.5] * (_N * _N), 1: [0.5] * (_N * _N)}
    at = {c: i + 1 for i, c in enumerate(ALPHABET)} | {"^": 0}
    for r in counts:
        if len(r["pair"]) == 2:
            seen[r["y"]][at[r["pair"][0]] * _N + at[r["pair"][1]]] += r["count"]
    table = [0.0] * (_N * _N)
    for i in range(_N):
        total = {y: sum(seen[y][i * _N : (i + 1) * _N]) for y in seen}
        for j in range(i * _N, (i + 1) * _N):
            table[j] = math.log(seen[1][j] / total[1]) - math.log(seen[0][j] / total[0])
    scored = runs.filter(held & (F.length("run") >= least)).select("y", llr(F.col("run"), table).alias("r"))
    cut = scored.groupBy("y").agg(F.percentile_approx("r", F.array(F.lit(0.02), F.lit(0.999)), 1000).alias("q")).collect()
    at_y = {r["y"]: r["q"] for r in cut}
    high = at_y[0][1] if 0 in at_y else 0.0
    low = at_y[1][0] if 1 in at_y else high
    return table, max(0.0, high, (high + low) / 2)


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["v"].alias("v")))


def scan(
    docs: DataFrame, model: tuple[list[float], float] | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 20, sample_rows: int = 20_000
) -> DataFrame:
    """Per row: doc_id, base (array of kind, s, e, v), markov (array of s, e, v).

    Markov spans are runs of ``least`` or more token characters with a letter and a digit, outside
    base spans, whose mean log-likelihood ratio passes the trained threshold. A null text counts as
    empty; rows with null ids and repeated rows are scanned like any other; other columns are
    ignored. Without any labelled run the models are uniform and add nothing beyond the threshold 0.
    """
    table, threshold = model or train(docs, id_col, text_col, sample_rows)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    spans = base_spans(F.col("t"))
    own = own.select("doc_id", "t", *(c.alias(k) for k, c in spans.items()))
    tagged = [_tagged(F.col(k), i) for i, k in enumerate(KINDS[:3])]
    own = own.select("doc_id", "t", F.array_sort(F.concat(*tagged)).alias("base"))
    runs = F.when(F.col("t").rlike(RUN % least), located(F.col("t"), RUN % least)).otherwise(_empty())
    own = own.select("doc_id", "base", runs.alias("runs"))
    random = F.filter(
        "runs",
        lambda x: x["v"].rlike("[0-9]")
        & x["v"].rlike("[A-Za-z]")
        & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        & (llr(x["v"], table) > F.lit(threshold)),
    )
    return own.select("doc_id", "base", random.alias("markov"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, checksum of the base spans, and all spans as text."""
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", _tagged(F.col("markov"), 3)))).alias("spans"),
    )
