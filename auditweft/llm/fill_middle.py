"""Fill-in-the-middle training texts: documents cut at line ends and rearranged around sentinels.

One Arrow compute pipeline per batch, without a loop over rows: texts are split into list arrays of
lines, flattened with their parents' indices, numbered within the parent, filtered by the part they
belong to, built up into lists again and joined piece by piece. The cuts come from a SHA-256 of the
document's id, so a run repeats exactly on any number of executors; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices

#: Sentinels before prefix, suffix and middle; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SLICE = 4 << 20


def _joined(*parts: pa.Array | str) -> pa.Array:
    """Element-wise concatenation of large strings and constants."""
    wide = [pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in parts]
    return pc.binary_join_element_wise(*wide, pa.scalar("", pa.large_string()))


def _draws(seed: int, id_col: Column) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex SHA-256 of ``seed:id`` as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _mod(x: pa.Array, by: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _pieces(units: pa.Array, role: pa.Array, counts: list[pa.Array]) -> list[pa.Array]:
    """Per part the joined units of each parent; counts[i] says how many units of part i each parent has."""
    out = []
    for i, n in enumerate(counts):
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(n)])
        lists = pa.LargeListArray.from_arrays(offsets, units.filter(pc.equal(role, i)))
        out.append(pc.binary_join(lists, pa.scalar("", pa.large_string())))
    return out


def rearranged(text: pa.Array, h: list[pa.Array], fim_percent: int, spm_percent: int) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text of a batch (no nulls)."""
    lines = pc.split_pattern(text, "\n")
    parent, flat = pc.list_parent_indices(lines).cast(pa.int64()), pc.list_flatten(lines)
    n_pieces = pc.list_value_length(lines).cast(pa.int64())
    starts = pc.subtract(pc.cumulative_sum(n_pieces), n_pieces)
    ordinal = pc.subtract(pa.array(range(len(flat)), pa.int64()), starts.take(parent))
    # Every piece but the last ends with its line break; an empty last piece is no unit.
    last = pc.equal(ordinal, pc.subtract(n_pieces, 1).take(parent))
    units = pc.if_else(last, flat, _joined(flat, "\n"))
    real = pc.invert(pc.and_(last, pc.equal(pc.binary_length(flat), 0)))
    unended = pc.invert(pc.or_(pc.ends_with(text, "\n"), pc.equal(pc.binary_length(text), 0)))
    n = pc.add(pc.subtract(n_pieces, 1), unended.cast(pa.int64()))
    cuts = [_mod(x, pc.add(n, 1)) for x in h[:2]]
    first, second = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    units, ordinal, parent = units.filter(real), ordinal.filter(real), parent.filter(real)
    role = pc.add(
        pc.greater_equal(ordinal, first.take(parent)).cast(pa.int8()), pc.greater_equal(ordinal, second.take(parent)).cast(pa.int8())
    )
    prefix, middle, suffix = _pieces(units, role, [first, pc.subtract(second, first), pc.subtract(n, second)])
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_mod(h[2], 100), fim_percent))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, mark))
    spm = pc.less(_mod(h[3], 100), spm_percent)
    psm_text = _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    spm_text = _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    no = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, no, pc.utf8_length(prefix).cast(pa.int64())),
        "middle_chars": pc.if_else(plain, no, pc.utf8_length(middle).cast(pa.int64())),
        "output": pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text)),
    }


def _batches(fim_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
            for a, b in slices(text, _SLICE):
                h = [batch.column(f"h{i}")[a:b] for i in (1, 2, 3, 4)]
                out = rearranged(text[a:b], h, fim_percent, spm_percent)
                out = {"doc_id": batch.column("doc_id")[a:b]} | out
                out |= {c: out[c].cast(pa.string()) for c in ("form", "output")}
                yield pa.RecordBatch.from_pydict(out)

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of ``docs``.

    A text is n lines, each with its line break. Prefix and middle end after two cuts drawn from the
    id; the form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain. Null and
    empty texts give an empty plain output; a text that holds a sentinel is plain as it is. A null id
    draws like an empty one, repeated rows give repeated rows, an empty table an empty one. Columns
    other than id and text are not carried, so their names can't clash. A text is joined whole, in one
    task; a batch holds 4 MB of texts or one longer text.
    """
    id_type = docs.schema[id_col].dataType
    kinds = StructType().add("doc_id", id_type)
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        kinds = kinds.add(name, kind)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *_draws(seed, F.col(f"`{id_col}`")))
    return source.mapInArrow(_batches(fim_percent, spm_percent), kinds)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` rearranged, rebuilt from its output and form alone."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
