"""Text, path and severity columns. All comparisons ignore case; blank counts as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stems of names that a shell gives to new documents, with their kinds.
PROVISIONAL_STEMS = [
    "novo documento de texto",
    "new text document",
    "nova imagem de bitmap",
    "new bitmap image",
    "novo(a) planilha do microsoft excel",
    "new microsoft excel worksheet",
    "novo(a) documento do microsoft word",
    "new microsoft word document",
    "new microsoft powerpoint presentation",
    "novo(a) microsoft publisher document",
    "new microsoft publisher document",
]
PROVISIONAL_KINDS = {
    "text": r"^(novo documento de texto|new text document)\.txt$",
    "excel": r"^(novo\(a\) planilha do microsoft excel|new microsoft excel worksheet).*\.xlsx$",
    "word": r"^(novo\(a\) documento do microsoft word|new microsoft word document).*\.docx$",
    "powerpoint": r"^(novo\(a\) apresenta.*microsoft powerpoint|new microsoft powerpoint presentation).*\.pptx$",
    "publisher": r"^(novo\(a\).*microsoft publisher document|new microsoft publisher document).*\.pub$",
    "bitmap": r"^(nova imagem de bitmap|new bitmap image).*\.bmp$",
}
SEVERITIES = ["info", "low", "medium", "warning", "high", "critical"]


def clean(c: Column) -> Column:
    """Trim all Unicode white space (SQL trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    t = clean(c)
    return F.when(t != "", t)


def is_blank(c: Column) -> Column:
    return c.isNull() | (clean(c) == "")


def normalize_path(c: Column) -> Column:
    return F.regexp_replace(F.translate(clean(c), "/", "\\"), r"\\+$", "")


def path_key(c: Column) -> Column:
    return F.lower(normalize_path(c))


def leaf_name(c: Column) -> Column:
    return F.substring_index(normalize_path(c), "\\", -1)


def parent_path(c: Column) -> Column:
    """Everything before the last separator; the whole path without one, or with it at the start."""
    p = normalize_path(c)
    at = F.length(p) - F.length(F.substring_index(p, "\\", -1))
    return F.when(at <= 1, p).otherwise(p.substr(F.lit(1), at - 1))


def windows_volume(c: Column) -> Column:
    v = F.regexp_extract(clean(c), r"^([A-Za-z]:)", 1)
    return F.when(v != "", F.upper(v))


def derive_extension(ext: Column, path: Column) -> Column:
    """A given extension with its dot; else the text from the leaf's last dot on, if any follows it."""
    given = F.lower(clean(ext))
    leaf = F.regexp_extract(F.translate(path, "/", "\\"), r"([^\\]*)$", 1)
    own = F.lower(F.regexp_extract(leaf, r"(\.[^.]+)$", 1))
    return F.when(~is_blank(ext), F.when(given.startswith("."), given).otherwise(F.concat(F.lit("."), given))).when(own != "", own)


def path_score(a: Column, b: Column) -> Column:
    """100 equal, 60 same leaf, 30 one holds the other, else 0."""
    x, y = path_key(a), path_key(b)
    score = F.when(x == y, 100).when(F.substring_index(x, "\\", -1) == F.substring_index(y, "\\", -1), 60).when(x.contains(y) | y.contains(x), 30).otherwise(0)
    return F.when(is_blank(a) | is_blank(b), 0).otherwise(score).cast("int")


def is_provisional(path: Column) -> Column:
    leaf = F.lower(leaf_name(path))
    found = leaf.startswith("novo(a) apresenta") & leaf.contains("microsoft powerpoint")
    for stem in PROVISIONAL_STEMS:
        found = found | leaf.startswith(stem)
    return F.coalesce(~is_blank(path) & found, F.lit(False))


def provisional_kind(path: Column) -> Column:
    leaf = F.regexp_replace(F.lower(leaf_name(path)), r" \(\d+\)(?=\.[^.]+$)", "")
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PROVISIONAL_KINDS.items()):
        out = F.when(leaf.rlike(pattern), kind).otherwise(out)
    return out


def is_provisional_folder(path: Column) -> Column:
    return F.coalesce(F.lower(leaf_name(path)).isin("nova pasta", "new folder"), F.lit(False))


def classify_transition(before: Column, after: Column) -> Column:
    moved = F.lower(parent_path(before)) != F.lower(parent_path(after))
    return F.when(is_provisional(before), "created").when(moved, "moved").otherwise("renamed")


def promote_object_type(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    either = lambda v: F.coalesce(x == v, F.lit(False)) | F.coalesce(y == v, F.lit(False))
    return F.when(either("file"), "file").when(either("directory"), "directory").otherwise(b)


def is_transient_artifact(path: Column) -> Column:
    """Recycle-bin parts, $-names, temporary and thumbnail files, storage-job files."""
    key = path_key(path)
    leaf = F.substring_index(key, "\\", -1)
    part = F.exists(F.split(key, r"\\"), lambda s: (s == "$recycle.bin") | s.rlike(r"^\$[ir][a-z0-9]{5,}$") | s.rlike(r"^\$[a-z0-9]{7,}$"))
    name = (
        leaf.startswith("$") | leaf.startswith("~$") | leaf.isin("thumbs.db", "desktop.ini", "volumejoblock.bin") | leaf.endswith(".tmp")
        | leaf.startswith("optimizationstate.xml") | leaf.startswith("chunkstorestatistics.xml") | leaf.startswith("changes.optimization.")
    )
    return F.coalesce(part | name, F.lit(False))


def is_operational_noise(path: Column, previous: Column) -> Column:
    p = F.lower(path)
    own = p.endswith("\\appsettings.agent.json") | p.endswith("\\agent-state.json") | p.endswith("\\pending-events.ndjson") | p.contains("\\logs\\") | p.endswith("\\logs")
    return F.coalesce(own, F.lit(False)) | is_transient_artifact(path) | is_transient_artifact(previous)


def severity_rank(c: Column) -> Column:
    ranks = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(F.element_at(ranks, F.lower(clean(c))), F.lit(0))
