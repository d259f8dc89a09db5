"""Personal data: base patterns, high-recall candidate spans, and boosted trees that select among them.

Generators propose overlapping spans. Their format and context features go to boosted trees trained on
the corpus itself: where a base rule finds personal data, the span is rewritten into the formats that
only the generators propose (no plus, other separators, spelled-out signs, an account number with right
check digits), which are positive, and replaced by dates, versions, ids and the like, which are negative;
so are matches that a base rule turns down. Spans of the corpus whose kind nobody knows aren't used.
Calibrated thresholds pick the further spans; base spans always stay.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted

KINDS = ["email", "ip", "card", "phone", "extra"]

# Fixed values of the base rule.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")

# Generators beside the base patterns; each is linear in the text.
_GENERATORS = [
    re.compile(r"(?<![0-9A-Za-z])[(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"),
    re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    re.compile(r"(?<![\w.])[\w.+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[\w-]{1,64} ?(?:[(\[](?:dot|DOT)[)\]]|\.) ?[A-Za-z]{2,12}"),
]
# Context words near a span, by what they hint at.
_HINTS = [
    re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|cell|contact|telefon|llame|appel)"),
    re.compile(r"(?i)\b(?:card|visa|account|iban|konto|carte|tarjeta|ssn|passport)"),
    re.compile(r"(?i)\b(?:mail|write|contact|e-mail|correo)"),
    re.compile(r"(?i)\b(?:page|version|year|no|nr|chapter|isbn|id|order|ref)\b"),
]
# Words put before training spans, personal and other.
_PERSONAL = ["call ", "phone: ", "my number is ", "tel. ", "mail ", "contact: ", "account ", "card ", "IBAN ", "Telefon ", "llame al ", "appelez le "]
_OTHER = ["page ", "order no ", "version ", "ISBN ", "in the year ", "ref ", "id ", "on ", "chapter ", "a total of ", "Nr. ", "between "]
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|[0-3]?[0-9][-/. ][01]?[0-9][-/. ](?:19|20)[0-9]{2}")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(t: str):
    done = before = 0
    at = t.find("@")
    while at >= 0:
        local = t[max(done, before) : at]
        k = len(local) - len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(t, at + 1) if k else None
        before = at + 1
        if m:
            yield at - k, m.end(), True
            done = m.end()
        at = t.find("@", max(before, done))


def _ips(t: str):
    for chain in _DOTTED.finditer(t):
        if chain.group().count(".") < 3:
            continue
        s = chain.start()
        fields = chain.group().split(".")
        for i in range(0, len(fields) - 3, 4):
            four = fields[i : i + 4]
            e = s + sum(map(len, four)) + 3
            yield s, e, all(len(f.lstrip("0")) <= 3 and int(f.lstrip("0") or 0) <= 255 for f in four)
            s = e + 1


def _cards(t: str):
    for m in _CARD.finditer(t):
        digits = m.group().replace(" ", "").replace("-", "")
        yield m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)


def _phones(t: str):
    for m in _PHONE.finditer(t):
        yield m.start(), m.end(), 9 <= sum(c.isdigit() for c in m.group()) <= 15


def base(t: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, passes) of every leftmost non-overlapping match per base kind."""
    if not _ANY.search(t):
        return []
    return [(s, k, e, ok) for k, f in enumerate((_emails, _ips, _cards, _phones)) for s, e, ok in f(t)]


def candidates(t: str) -> list[tuple[int, int, int, bool]]:
    """Base matches, passing or not, and the generators' spans (kind 4); spans may overlap."""
    if not _ANY.search(t):
        return []
    out = base(t)
    out += [(m.start(), 4, m.end(), False) for g in _GENERATORS for m in g.finditer(t)]
    return [c for c in out if c[3] or c[2] - c[0] >= 7]


def check_digits(account: str) -> int:
    """Remainder by 97 of an account number with letters as numbers and its first four characters last; 1 if right."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


N_FEATURES = 28


def features(t: str, s: int, e: int) -> list[float]:
    """Format of the span and words around it; no label of a row is used."""
    v = t[s:e]
    digits = "".join(c for c in v if "0" <= c <= "9")
    before, after = t[max(0, s - 32) : s], t[e : e + 16]
    groups = re.split(r"[^0-9]+", v)
    sizes = [len(g) for g in groups if g] or [0]
    account = v.replace(" ", "")
    return [
        len(v), len(digits), sum(c.isalpha() for c in v), v.count(" "), v.count("-"), v.count("."), v.count("("), v.count("@"),
        v[0] == "+", len(sizes), max(sizes), min(sizes), sizes == sorted(sizes), max((int(g[:6] or 0) for g in groups), default=0),
        luhn(digits) if digits else 0, before[-1:].isalnum(), after[:1].isalnum(), *(bool(h.search(before)) for h in _HINTS), v.count("/"),
        sizes[0], sizes[-1], bool(_DATE.search(v)), digits[:3] in ("978", "979"), bool(_ACCOUNT.fullmatch(account)) and check_digits(account) == 1, bool(re.search("(?i)[(\\[]at", v)),
    ]


def _rewritten(v: str, kind: int, rng: random.Random) -> str | None:
    """A base span in a format that is no base span."""
    d = "".join(c for c in v if "0" <= c <= "9")
    if kind == 0:
        local, _, host = v.partition("@")
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" [AT] ", " [DOT] ")])
        name, _, end = host.rpartition(".")
        return f"{local}{at}{name}{dot}{end}"
    if kind == 2 and rng.random() < 0.5:  # an account number made of the card's digits
        head = rng.choice(["DE", "GB", "FR", "ES", "NL", "IT"])
        body = (d * 2)[: rng.randint(14, 20)]
        account = f"{head}{98 - check_digits(head + '00' + body):02d}{body}"
        return account if rng.random() < 0.5 else " ".join(account[i : i + 4] for i in range(0, len(account), 4))
    if kind == 2:
        return rng.choice("./").join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == 3 and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{d[:-10]} {a} {b}{c}", f"0{a} {b} {c}", f"{d[:-10]}-{a}-{b}-{c}", f"{a}/{b}{c}"])
    return None


def _number(rng: random.Random) -> str:
    """Digits that are no personal data: dates, book numbers, versions, amounts, ids."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    y, m, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 31)
    return rng.choice([
        f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y}", f"{y}-{m:02d}-{d:02d} {rng.randint(0, 23):02d}", f"{y}-{y + rng.randint(1, 9)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}",
        f"{n(1)}-{n(3)}-{n(5)}-{n(1)}", f"{n(1)}.{n(2)}.{n(1)}.{n(5)}", f"{rng.randint(1, 999)} {n(3)} {n(3)}", f"{rng.randint(1, 999)}.{n(3)}.{n(3)}", f"{n(1)}.{n(9)}", n(rng.randint(7, 9)), n(rng.randint(10, 18)),
        f"{n(2)}-{n(7)}", f"{n(4)}/{n(6)}", f"{n(3)}-{n(2)}-{n(4)}-{n(2)}-{n(3)}", f"{n(4)}.{n(4)}.{n(4)}.{n(4)}",
    ])


def examples(t: str) -> list[tuple[int, str, int, int]]:
    """(label, text around, start, end) of training spans made from a text; the same for the same text."""
    found = base(t)
    out = [(0, t[max(0, s - 64) : e + 64], min(s, 64), min(s, 64) + e - s) for s, k, e, ok in found if not ok and (k == 1 or k == 2 and t[s:e].isdigit() and 13 <= e - s <= 19)]
    for s, k, e, ok in found:
        if not ok or e - s > 200:
            continue
        rng = random.Random(zlib.crc32(t[max(0, s - 32) : e].encode()))
        for label, v, hints in ((1, _rewritten(t[s:e], k, rng), _PERSONAL), (0, _number(rng), _OTHER), (0, _number(rng), _OTHER)):
            before = t[max(0, s - 64) : s] + (rng.choice(hints) if rng.random() < 0.6 else "")
            if v:
                out.append((label, before + v + t[e : e + 64], len(before), len(before) + len(v)))
    return out


def _proposed(around: str, s: int, e: int) -> tuple[int, int] | None:
    """The generators' span that covers most of a training span."""
    spans = [(m.start(), m.end()) for g in _GENERATORS for m in g.finditer(around)]
    best = max(spans, key=lambda x: (min(e, x[1]) - max(s, x[0]), x[0] - x[1]), default=None)
    return best if best and min(e, best[1]) - max(s, best[0]) > 0.6 * (e - s) else None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, sample_spans: int = 40_000, precision: float = 0.98):
    """(model, threshold), fitted on training spans from about ``sample_docs`` documents and at most
    ``sample_spans`` spans, chosen by a hash of the id over the whole table; None without both labels.

    A quarter of the documents is left out; on their spans probabilities are calibrated, and the
    threshold is the least from which on ``precision`` of them are positive.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(1, n))
    picked = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) <= int(share * 1_000_000)) if share < 1 else docs

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                doc = zlib.crc32((t or "").encode("utf-8", "replace"))
                for y, around, s, e in examples(t or ""):
                    span = _proposed(around, s, e)
                    if span:
                        rows.append((y, doc, hash_of(around, span[0]), features(around, *span)))
            cols = [pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(cols, names=["y", "doc", "h", "x"])

    spans = picked.select(F.col(text_col).cast("string")).mapInArrow(run, "y long, doc long, h long, x array<double>")
    rows = spans.orderBy("h", "doc", "y").limit(sample_spans).collect()
    if not rows or len({r["y"] for r in rows}) < 2:
        return None
    y, x = np.array([r["y"] for r in rows]), np.array([r["x"] for r in rows])
    held = np.array([r["doc"] for r in rows]) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
        held[::2] = True
    model = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p = model.probability(x[held])
    order = np.argsort(-p, kind="stable")
    right = y[held][order].cumsum() / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(right >= precision)
    return model, float(max(0.5, p[order][ok[-1]])) if len(ok) else 1.0


def hash_of(t: str, s: int) -> int:
    """Repeatable order of sampled spans."""
    return zlib.crc32(f"{len(t)}:{s}:{t[max(0, s - 20) : s + 20]}".encode())


def find(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """Per row: doc_id, text_hash and spans, an array of (s, k, e, p): start, kind number, end (code points), probability.

    Base spans have probability 1. Null texts count as empty; null ids and repeated rows are searched
    like others; other columns are ignored; an empty table gives an empty result. Without training spans
    of both labels in the sample there is no model and only base spans are returned.
    """
    model = model or train(docs, id_col, text_col, **fit)

    def run(batches):
        for batch in batches:
            out, asked, x, seen = [], [], [], set()
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = candidates(t or "")
                good = [c for c in found if c[3]]
                out.append([(s, k, e, 1.0) for s, k, e, _ in good])
                if model:
                    good.sort()
                    starts = [g[0] for g in good]
                    reach = list(accumulate((g[2] for g in good), max))  # how far the spans up to here go
                    for s, k, e, ok in found:
                        before = bisect_left(starts, e)
                        if k == 4 and not (before and reach[before - 1] > s):
                            asked.append((i, s, e))
                            x.append(features(t, s, e))
            if asked:
                for (i, s, e), p in zip(asked, model[0].probability(np.array(x, float))):
                    if p >= model[1] and (i, s, e) not in seen:
                        seen.add((i, s, e))
                        out[i].append((s, 4, e, float(p)))
            spans = [[{"s": s, "k": k, "e": e, "p": p} for s, k, e, p in sorted(o)] for o in out]
            kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), batch.column(2)], names=["doc_id", "spans", "text_hash"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, spans array<struct<s:int,k:int,e:int,p:double>>, text_hash long")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (of overlapping spans, the first).

    Spans belong to an id and its text, so that texts that share an id are redacted by their own.
    """
    spans = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_hash"])
    own = docs.join(spans, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_hash")), "left")
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    text = F.col(text_col)

    def step(acc, x):
        part = F.concat(acc["t"], text.substr(acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1))
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), part.alias("t")))

    done = F.aggregate(F.coalesce("_spans", F.array().cast("array<struct<s:int,k:int,e:int,p:double>>")), F.struct(F.lit(0).alias("at"), F.lit("").alias("t")), step)
    full = F.concat(done["t"], text.substr(done["at"] + 1, F.length(text)))
    return own.withColumn(text_col, full).drop("_id", "_hash", "_spans")


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")

    def count(i):
        return F.size(F.filter("spans", lambda x: x["k"] == F.lit(i))).cast("long").alias(f"n_{KINDS[i]}")

    return found.select("doc_id", *map(count, range(4)), F.sha2(joined(F.filter("spans", lambda x: x["k"] < 4)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
