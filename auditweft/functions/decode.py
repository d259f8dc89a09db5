"""Decoding of security-log and change-journal fields into the audit vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, clean, is_blank

# Mask bits and message codes per action, in order of precedence.
ACCESS_RULES = [
    ("permission_changed", 0x40000, ["1539"]),
    ("owner_changed", 0x80000, ["1540"]),
    ("deleted", 0x10000 | 0x40, ["1537", "4422"]),
    ("write", 0x2 | 0x4, ["4417", "4418"]),
    ("modified", 0x10 | 0x100, ["4420", "4424"]),
]
USN_REASONS = [
    ("created", "FILE_CREATE|NAMED_DATA_EXTEND|Criação de arquivo|Criacao de arquivo"),
    ("deleted", "FILE_DELETE|Arquivo morto|Exclusão|Exclusao"),
    ("renamed_old", "RENAME_OLD_NAME|Renomear: nome antigo"),
    ("renamed_new", "RENAME_NEW_NAME|Renomear: novo nome"),
    ("permission_changed", "SECURITY_CHANGE|Alteração de segurança|Alteracao de seguranca"),
    (
        "modified",
        "DATA_OVERWRITE|DATA_EXTEND|DATA_TRUNCATION|BASIC_INFO_CHANGE|Extensao de dados|Extensão de dados|Fechar|Alteração de ID de objeto|Alteracao de ID de objeto",
    ),
]
TIME_PATTERNS = ["MM/dd/yyyy HH:mm:ss", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "d/M/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a"]


def decode_security_action(event_id: Column, mask: Column, codes: Column, object_type: Column) -> Column:
    """Action of a security event. The mask is hexadecimal with 0x, else decimal; a bad one is 0."""
    text = clean(mask)
    bits = F.coalesce(
        F.when(text.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 15), 16, 10).cast("long")).when(text.rlike("^[0-9]{1,18}$"), text.cast("long")),
        F.lit(0).cast("long"),
    )
    named = F.coalesce(F.regexp_extract_all(codes, F.lit(r"%%(\d+)"), F.lit(1)), F.array().cast("array<string>"))
    out = F.lit("accessed")
    written = F.when(F.coalesce(F.lower(clean(object_type)).contains("directory"), F.lit(False)), "created").otherwise("created_or_appended")
    for action, bit, numbers in reversed(ACCESS_RULES):
        hit = (bits.bitwiseAND(F.lit(bit).cast("long")) != 0) | F.arrays_overlap(named, F.array(*map(F.lit, numbers)))
        out = F.when(hit, written if action == "write" else F.lit(action)).otherwise(out)
    return F.when(event_id == 4660, "deleted").when(event_id == 4670, "permission_changed").otherwise(out)


def resolve_security_path(base: Column, *relatives: Column) -> Column:
    """The object's name, with the first non-blank relative name appended unless it ends in it."""
    b, r = blank_to_null(base), F.coalesce(*map(blank_to_null, relatives))
    joined = F.concat(F.regexp_replace(b, r"\\+$", ""), F.lit("\\"), F.regexp_replace(r, r"^\\+", ""))
    return F.when(b.isNull(), r).when(r.isNull() | F.lower(b).endswith(F.lower(r)), b).otherwise(joined)


def security_object_type(c: Column) -> Column:
    t = F.lower(clean(c))
    return F.when(is_blank(c), "unknown").when(t.contains("directory"), "directory").otherwise("file")


def security_user(domain: Column, name: Column) -> Column:
    return F.when(is_blank(domain), name).otherwise(F.concat(domain, F.lit("\\"), name))


def decode_usn_reason(reason: Column) -> Column:
    out = F.lit("changed")
    for action, pattern in reversed(USN_REASONS):
        out = F.when(reason.rlike(f"(?iu)({pattern})"), action).otherwise(out)
    return F.when(is_blank(reason), "changed").otherwise(out)


def parse_usn_timestamp(text: Column, zone: str, fallback: Column) -> Column:
    """Local time in the first pattern that fits, as UTC."""
    local = F.coalesce(*(F.try_to_timestamp(clean(text), F.lit(p)) for p in TIME_PATTERNS))
    return F.coalesce(F.to_utc_timestamp(local, zone), fallback)


def normalize_reference_id(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)\s+", "")
    return F.when(t != "", t)
