"""Scalar column expressions (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotpack.schema import ERROR_TEXT_MAX, GAS_PER_SLOT, SLOT_SIZE

CLASS_FULL, CLASS_PACKABLE, CLASS_DYNAMIC = "full", "packable", "dynamic"
# Order of the classes in a recommended layout: full slots, packed groups, dynamic handles.
CLASS_RANK = {CLASS_FULL: 0, CLASS_PACKABLE: 1, CLASS_DYNAMIC: 2}


def once(value: Column | str) -> Column:
    """``value`` as a generated column: filters and projections above name it without computing it again."""
    return F.explode(F.array(F.col(value) if isinstance(value, str) else value))


def is_inplace(encoding: Column | str) -> Column:
    """Encoding equals "inplace", ignoring case."""
    return F.lower(F.col(encoding) if isinstance(encoding, str) else encoding) == F.lit("inplace")


def is_packable(encoding: Column | str, nbytes: Column | str) -> Column:
    """Inplace and 0 < bytes < 32 (used by the order detector)."""
    b = F.col(nbytes) if isinstance(nbytes, str) else nbytes
    return is_inplace(encoding) & (b > 0) & (b < SLOT_SIZE)


def item_class(encoding: Column | str, nbytes: Column | str) -> Column:
    """Dynamic (not inplace) / full (>= 32 bytes) / packable (< 32 bytes, zero included)."""
    b = F.col(nbytes) if isinstance(nbytes, str) else nbytes
    return (F.when(~is_inplace(encoding), F.lit(CLASS_DYNAMIC))
            .when(b >= SLOT_SIZE, F.lit(CLASS_FULL))
            .otherwise(F.lit(CLASS_PACKABLE)))


def class_rank(cls: Column | str) -> Column:
    c = F.col(cls) if isinstance(cls, str) else cls
    return (F.when(c == CLASS_FULL, 0).when(c == CLASS_PACKABLE, 1).otherwise(2)).cast("int")


def slots_needed(nbytes: Column | str) -> Column:
    """1 if bytes <= 0 else ceil(bytes / 32)."""
    b = F.col(nbytes) if isinstance(nbytes, str) else nbytes
    return F.when(b <= 0, F.lit(1)).otherwise(F.floor((b + (SLOT_SIZE - 1)) / SLOT_SIZE).cast("int"))


def ceil_slots(nbytes: Column | str) -> Column:
    """Struct form of O18: ceil(bytes / 32) without the 1-slot minimum."""
    b = F.col(nbytes) if isinstance(nbytes, str) else nbytes
    return F.floor((b + (SLOT_SIZE - 1)) / SLOT_SIZE).cast("int")


def kind_of(file: Column | str) -> Column:
    """Dataset kind from the path prefix after normalising backslashes."""
    f = F.translate(F.col(file) if isinstance(file, str) else file, "\\", "/")
    return (F.when(f.startswith("real/"), F.lit("real"))
            .when(f.startswith("synthetic/"), F.lit("synthetic"))
            .otherwise(F.lit("other")))


def short_error(message: Column | str, class_name: Column | str | None = None) -> Column:
    """Class name when the message is null, first line only, at most 240 chars."""
    m = F.col(message) if isinstance(message, str) else message
    if class_name is not None:
        m = F.coalesce(m, F.col(class_name) if isinstance(class_name, str) else class_name)
    nl = F.instr(m, "\n")
    first = F.when(nl > 1, F.substring_index(m, "\n", 1)).otherwise(m)
    return (F.when(F.length(first) > ERROR_TEXT_MAX,
                   F.concat(F.substring(first, 1, ERROR_TEXT_MAX - 3), F.lit("...")))
            .otherwise(first))


def gas(slots: Column | str) -> Column:
    """Deployment gas estimate for a number of slots."""
    s = F.col(slots) if isinstance(slots, str) else slots
    return (s.cast("bigint") * F.lit(GAS_PER_SLOT)).cast("bigint")


def address_from_text(text: Column | str) -> Column:
    """First 0x-prefixed 40-hex address in free text, else NULL."""
    t = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(t, r"(0x[a-fA-F0-9]{40})", 1), F.lit(""))


def address_from_path(path: Column | str) -> Column:
    """Address encoded in a file name `(0x)?<40 hex>_...`, returned with 0x, else NULL."""
    p = F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
    base = F.substring_index(p, "/", -1)
    hexpart = F.regexp_extract(base, r"^(?:0x)?([0-9a-fA-F]{40})_", 1)
    return F.when(hexpart != "", F.concat(F.lit("0x"), hexpart))
