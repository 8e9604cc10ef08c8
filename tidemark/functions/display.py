"""Names, initials, labels and colours that lists show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of avatars, by number.
PALETTE_SIZE = 10
#: Labels of task sources.
SOURCE_LABELS = {"apple_reminders": "Reminders", "caldav": "CalDAV Tasks", "caldav_tasks": "CalDAV Tasks", "obsidian_tasks": "Obsidian Tasks", "obsidian": "Obsidian Tasks"}


def initials(name: Column) -> Column:
    """First letters of the first and last word; two letters of a single word; '?' without any."""
    words = F.array_remove(F.split(F.regexp_replace(name, r"[<>()\[\]]", ""), r"\s+"), "")
    two = F.concat(F.substring(F.try_element_at(words, F.lit(1)), 1, 1), F.substring(F.try_element_at(words, F.lit(-1)), 1, 1))
    return F.when(F.size(words) == 0, "?").when(F.size(words) == 1, F.upper(F.substring(F.try_element_at(words, F.lit(1)), 1, 2))).otherwise(F.upper(two))


def palette_index(name: Column) -> Column:
    """h = h * 31 + code, in 31 bits, over the characters; then a place in the palette."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0x7FFFFFFF))) % PALETTE_SIZE).cast("int")


def conversation_name(display_name: Column, origin_ref: Column) -> Column:
    """The given name, else what follows the reference's first colon, else the reference."""
    after = F.when(F.instr(origin_ref, ":") > 0, F.trim(F.regexp_replace(origin_ref, "^[^:]*:", ""))).otherwise("")
    return F.coalesce(F.when(display_name != "", display_name), F.when(after != "", after), origin_ref)


def title_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def adapter_label(adapter_id: Column) -> Column:
    return title_label(F.substring_index(adapter_id, ":", 1))


def source_label(source_type: Column) -> Column:
    out = title_label(source_type)
    for k, v in SOURCE_LABELS.items():
        out = F.when(F.lower(source_type) == k, v).otherwise(out)
    return out
